"""Wikitext to positioned tokens, entity links and infobox parameters.

The text is scanned twice. The first scan pairs what encloses other markup (templates, arguments, links, tags); what has
no partner stays text. The second walks the pairs from the outside in and gives tokens straight away; there is no tree.
Quotes, headings and list marks need no rule of their own, as words are split at them in any case. Nothing recurses and
no mark looks further than the next one of its kind twice, so that markup of any depth takes time in proportion to its length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html.entities import name2codepoint

# Prefixes of links that are no entities; words that format text; tags whose content isn't parsed; tags without content.
MEDIA = ("File:", "Media:", "Audio:", "Video:", ":File:", ":Media:", ":Audio:", ":Video:")
MAGIC = {"lc", "lcfirst", "uc", "ucfirst", "formatnum", "#dateformat", "#formatdate"}
VERBATIM = {"categorytree", "ce", "chem", "gallery", "graph", "hiero", "imagemap", "inputbox", "math", "nowiki", "pre", "score", "section", "source", "syntaxhighlight", "templatedata", "timeline"}
SINGLE = {"br", "hr", "wbr", "img", "meta", "link"}
SCHEMES = "bitcoin:|ftp://|ftps://|geo:|git://|gopher://|http://|https://|irc://|ircs://|magnet:|mailto:|mms://|news:|nntp://|redis://|sftp://|sip:|sips:|sms:|ssh://|svn://|tel:|telnet://|urn:|worldwind://|xmpp:|//"

WORD = re.compile(r"\w+")
MARK = re.compile(r"<!--|\{\{+|\}\}+|\[\[|\]\]|</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>|\[(?=" + SCHEMES + r")|&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});|^[ \t:]*\{\|", re.I | re.M)
TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)[^<>]*?(/?)>")
EXTERNAL = re.compile(r"\[((?:" + SCHEMES + r")[^\s\[\]<>\"]+)", re.I)
TITLE_END = re.compile(r"[|\n\[\]{}<>]")
TABLE_END = re.compile(r"^[ \t:]*\|\}(?!\})", re.M)
SQUARE = re.compile(r"\[\[|\]")
COMMENT_END = re.compile("-->")
VERBATIM_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in sorted(VERBATIM)}
LINE = re.compile(r"^.*$", re.M)

#: Spark type of a parsed text.
PARSED = "struct<structured_part: array<struct<name: string, text: string, link: string>>, unstructured_part: array<struct<text: string, link: string, position: int>>>"

#: kind, end of the opening mark, start of the closing mark, end of the closing mark
Span = tuple[str, int, int, int]


def character(entity: str) -> str | None:
    """The character of ``&name;``, or None if there is none."""
    name = entity[1:-1]
    try:
        code = (int(name[2:], 16) if name[1:2] in "xX" else int(name[1:])) if name[0] == "#" else name2codepoint[name]
        return chr(code) if not 0xD800 <= code < 0xE000 else None
    except (KeyError, ValueError, OverflowError):
        return None


def spans(text: str) -> dict[int, Span]:
    """What encloses something, by its start: templates, arguments, links, tags, comments, tables, entities, external links."""
    found: dict[int, Span] = {}
    stack: list[list] = []  # kind, start, count of braces left, end of mark
    places: dict[str, list[int]] = {}  # where in the stack each kind is open

    def push(*entry) -> None:
        places.setdefault(entry[0], []).append(len(stack))
        stack.append(list(entry))

    def last(kind: str) -> int | None:
        return places[kind][-1] if places.get(kind) else None

    def drop(k: int) -> None:
        while len(stack) > k:
            places[stack.pop()[0]].pop()

    nexts: dict[str, tuple[int, int] | None] = {}  # the next end of comments, tables and each verbatim tag, None if there is no more

    def following(kind: str, end: re.Pattern) -> tuple[int, int] | None:
        known = nexts.get(kind, (-1, -1))
        if known is not None and known[0] < at:
            m = end.search(text, at)
            known = nexts[kind] = m.span() if m else None
        return known

    brackets = Brackets(text)
    at = 0
    while m := MARK.search(text, at):
        start, mark = m.start(), m.group()
        at = m.end()
        if mark == "<!--":
            end = following("<!--", COMMENT_END)
            if end:
                found[start] = ("comment", at, *end)
                at = end[1]
        elif mark[-1] == "|":
            end = following("{|", TABLE_END)
            if end:
                found[at - 2] = ("table", at, *end)
        elif mark[0] == "{":
            push("{", start, len(mark), at)
        elif mark[0] == "}":
            left, close = len(mark), start
            while left >= 2 and (k := last("{")) is not None:
                top = stack[k]
                n = 3 if top[2] >= 3 and left >= 3 else 2
                begin = top[1] + top[2] - n
                found[begin] = ("argument" if n == 3 else "template", begin + n, close, close + n)
                top[2] -= n
                drop(k + (top[2] >= 2))
                left, close = left - n, close + n
        elif mark == "[[":
            push("[[", start, 2, at)
        elif mark == "]]":
            k = last("[[")
            if k is not None and k > (-1 if last("{") is None else last("{")):
                found[stack[k][1]] = ("link", stack[k][3], start, at)
                drop(k)
        elif mark[0] == "[":
            x = EXTERNAL.match(text, start)
            end = brackets.closing(x.end(1)) if x else None
            if end is not None:
                found[start] = ("external", x.end(1), end, end + 1)
        elif mark[0] == "&":
            if character(mark) is not None:
                found[start] = ("entity", start, at, at)
        elif mark[0] == "<":
            closes, name, ends = TAG.match(mark).groups()
            name = name.lower()
            if ends or (name in SINGLE and not closes):
                found[start] = ("single", start, at, at)
            elif closes:
                k = last(f"<{name}")
                if k is not None:
                    found[stack[k][1]] = ("tag", stack[k][3], start, at)
                    drop(k)
            elif name in VERBATIM:
                end = following(name, VERBATIM_END[name])
                if end:
                    found[start] = ("verbatim", at, *end)
                    at = end[1]
            else:
                push(f"<{name}", start, 0, at)
    return found


class Brackets:
    """The bracket that ends an external link: the next single one on its line that isn't within a link."""

    def __init__(self, text: str):
        self.text, self.line = text, (1, 0)

    def read(self, at: int) -> None:
        """Take in the line of a place: its marks, and for each link's opening mark the number of the mark after the link."""
        low, high = self.text.rfind("\n", 0, at) + 1, self.text.find("\n", at)
        self.line = low, len(self.text) if high < 0 else high
        self.marks = [m.start() for m in SQUARE.finditer(self.text, *self.line)]
        self.after: dict[int, int] = {}
        self.ends: dict[int, int | None] = {}
        opened, i = [], 0
        while i < len(self.marks):
            if self.text[self.marks[i]] == "[":
                opened.append(i)
            elif opened and self.text.startswith("]]", self.marks[i]):
                i += 1
                self.after[opened.pop()] = i + 1
            i += 1

    def closing(self, at: int) -> int | None:
        if not self.line[0] <= at <= self.line[1]:
            self.read(at)
        i: int | None = bisect_left(self.marks, at)
        passed, end = [], None
        while i is not None and i < len(self.marks):
            if i in self.ends:
                end = self.ends[i]
                break
            passed.append(i)
            if self.text[self.marks[i]] == "]":
                end = self.marks[i]
                break
            i = self.after.get(i)
        self.ends.update(dict.fromkeys(passed, end))
        return end


class Text:
    """One wikitext with its spans: those that can't be what they look like, a link without a title or a template without
    a name, are left out and stay text."""

    def __init__(self, source: str, magic_word_chars: bool = True):
        self.source, self.spans, self.magic_word_chars = source, spans(source), magic_word_chars
        self.names: dict[int, str] = {}
        self.broken: set[int] = set()  # templates whose name would have a line break, and so would that of what begins around them
        self.starts = sorted(self.spans)
        # what ends first is within what ends later
        for start in sorted(self.starts, key=lambda s: (self.spans[s][3], -s)):
            if self.spans[start][0] == "template":
                self.names[start] = self.name(start)

    def valid(self, start: int) -> bool:
        kind, low, high, _ = self.spans[start]
        if kind == "link":
            end = TITLE_END.search(self.source, low, high)
            return end is None or end.group() == "|"
        return kind != "template" or bool(self.names[start])

    def name(self, start: int) -> str:
        """A template's name, up to its first bar; empty if it can't be one, as it is blank or has a line break."""
        _, low, high, _ = self.spans[start]
        i, at = bisect_left(self.starts, low), low
        bar = self.source.find("|", at, high)
        while i < len(self.starts) and self.starts[i] < high and (bar < 0 or self.starts[i] <= bar):
            inner = self.starts[i]
            end = self.spans[inner][3]
            if inner < at or end > high or not self.valid(inner):
                if inner in self.broken and inner >= at and end <= high:
                    self.broken.add(start)
                    return ""
                i += 1
                continue
            at = end
            i = bisect_left(self.starts, at)
            if 0 <= bar < at:
                bar = self.source.find("|", at, high)
        name = self.source[low : high if bar < 0 else bar].strip()
        if "\n" in name:
            self.broken.add(start)
            return ""
        return name

    def within(self, low: int, high: int) -> Iterator[tuple[int, Span | None, int]]:
        """Pieces of a range in order: (start, span, end) of each outermost span, (start, None, end) of the text between."""
        i, at = bisect_left(self.starts, low), low
        while i < len(self.starts) and self.starts[i] < high:
            start = self.starts[i]
            span = self.spans[start]
            if start < at or span[3] > high or not self.valid(start):
                i += 1
                continue
            if start > at:
                yield at, None, start
            yield start, span, span[3]
            at = span[3]
            i = max(i + 1, bisect_left(self.starts, at))
        if at < high:
            yield at, None, high

    def parts(self, low: int, high: int, at: str = "|", once: bool = False) -> list[tuple[int, int]]:
        """The range cut at a mark, where that isn't inside a span."""
        out, begin = [], low
        for start, span, end in self.within(low, high):
            while span is None and (p := self.source.find(at, start, end)) >= 0 and not (once and out):
                out.append((begin, p))
                begin = start = p + len(at)
        return [*out, (begin, high)]

    def words(self, low: int, high: int) -> Iterator[tuple[str, str | None]]:
        """(word, link) of everything in the range; infoboxes and other templates give nothing but magic words' characters."""
        for kind, value in self.events(low, high):
            if kind == "word":
                yield value

    def events(self, low: int, high: int) -> Iterator[tuple[str, object]]:
        """("word", (text, link)) and ("infobox", span) in the order of the text.

        What is still to be done is kept in a list: ranges, and the ends of external links, whose titles' words are held
        back until the outermost is complete.
        """
        todo: list[tuple] = [(low, high)]
        held: list[str | list[str]] = []  # words, or lists of them
        begins: list[int] = []  # where in them each title begins
        mixed: list[int] = []  # where something else than a word stands
        while todo:
            low, high = todo.pop()
            if low < 0:
                self.titled(held, begins.pop(), mixed, *high)
                if not begins:
                    yield from (("word", (w, None)) for x in held for w in ([x] if isinstance(x, str) else x))
                    held.clear()
                    mixed.clear()
                continue
            for kind, value in self.piece(low, high, todo):
                if kind == "begin":
                    begins.append(len(held))
                elif not begins:
                    yield kind, value
                elif kind == "word":
                    if not WORD.fullmatch(value[0]):
                        mixed.append(len(held))
                    held.append(value[0])

    def piece(self, low: int, high: int, todo: list[tuple]) -> Iterator[tuple[str, object]]:
        """What a range gives up to the first span that has to be opened; that and the rest go to ``todo``."""
        source = self.source
        for start, span, end in self.within(low, high):
            if span is None:
                for w in WORD.findall(source, start, end):
                    yield "word", (w, None)
                continue
            kind, inner, close, after = span
            if kind in ("tag", "table", "verbatim", "external"):
                if after < high:
                    todo.append((after, high))
                if kind == "tag":
                    todo.append((inner, close))
                elif kind == "table":
                    todo += reversed(list(self.cells(inner, close)))
                elif kind == "verbatim":
                    for w in WORD.findall(source, inner, close):
                        yield "word", (w, None)
                else:
                    todo += [(-1, (start, span)), (inner, close)]
                    yield "begin", span
                break
            if kind == "link":
                if not source.startswith(MEDIA, inner):
                    yield "word", self.link(span)
            elif kind == "entity":
                yield "word", (character(source[inner:close]), None)
            elif kind == "template":
                name = self.names[start]
                if name.startswith("Infobox"):
                    yield "infobox", span
                elif value := magic(name):
                    yield from (("word", (c, None)) for c in (value if self.magic_word_chars else [value]))

    def titled(self, held: list, begin: int, mixed: list[int], start: int, span: Span) -> None:
        """Turn what is held of an external link's title into its words and its url; without a title the words of the url."""
        url = self.source[start + 1 : span[1]].strip()
        if span[1] == span[2]:
            held.append(WORD.findall(url))
            return
        same = held[begin:] == [url] if len(held) == begin + 1 else False
        while mixed and mixed[-1] >= begin:
            k = mixed.pop()
            held[k] = WORD.findall(held[k])
        if not same:
            mixed.append(len(held))
            held.append(url)

    def link(self, span: Span) -> tuple[str, str]:
        title, bar, shown = self.source[span[1] : span[2]].partition("|")
        url = title.split("#")[0]
        return (shown.split("|")[-1].strip() if shown.strip() else url), url

    def cells(self, low: int, high: int) -> Iterator[tuple[int, int]]:
        """Contents of a table's cells; attributes of the table, of rows and of cells are left out."""
        first = self.source.find("\n", low, high)
        if first < 0:
            return
        covered = [(s, e) for s, span, e in self.within(first + 1, high) if span is not None]
        begins = [s for s, _ in covered]

        def inside(at: int) -> bool:
            k = bisect_left(begins, at) - 1
            return k >= 0 and at < covered[k][1]

        edges: list[tuple[int, int, str]] = []  # start of a row or cell mark, end of it, kind
        for m in LINE.finditer(self.source, first + 1, high):
            line, at = m.group(), m.start() + len(m.group()) - len(m.group().lstrip(" \t:"))
            if inside(at):
                continue
            if self.source.startswith("|-", at):
                edges.append((at, m.end(), "row"))
            elif self.source[at : at + 1] in ("|", "!") and line.strip():
                edges.append((at, at + 1, "cell"))
                double = re.compile(r"\|\||!!" if self.source[at] == "!" else r"\|\|")
                edges += [(x.start(), x.end(), "cell") for x in double.finditer(self.source, at + 1, m.end()) if not inside(x.start())]
        for i, (_, end, kind) in enumerate(edges):
            stop = edges[i + 1][0] if i + 1 < len(edges) else high
            if kind == "cell":
                pieces = self.parts(end, stop, "|", once=True)
                yield pieces[-1]

    def infobox(self, span: Span) -> dict[str, tuple[str, str | None]]:
        """Trimmed names with text and last link, in the order of first appearance; the last of repeated names counts."""
        out: dict[str, tuple[str, str | None]] = {}
        number = 0
        for low, high in self.parts(span[1], span[2])[1:]:
            pieces = self.parts(low, high, "=", once=True)
            if len(pieces) == 2:
                name, (low, high) = self.source[slice(*pieces[0])].strip(), pieces[1]
            else:
                number += 1
                name = str(number)
            words = list(self.words(low, high))
            links = [link for _, link in words if link is not None]
            out[name] = " ".join(w for w, _ in words), links[-1] if links else None
        return out


def magic(name: str) -> str:
    """The value of a word that formats text, unformatted; else nothing."""
    pieces = name.split(":")
    return pieces[1].strip() if len(pieces) > 1 and pieces[0].strip() in MAGIC else ""


def parse(source: str | None, magic_word_chars: bool = True) -> dict:
    """``structured_part`` (of the first infobox) and ``unstructured_part`` (positions from 1) of a wikitext.

    A null text has no tokens. A magic word's value gives one token per character, or one in all without
    ``magic_word_chars``.
    """
    text = Text(source or "", magic_word_chars)
    box: dict | None = None
    tokens = []
    for kind, value in text.events(0, len(text.source)):
        if kind == "word":
            tokens.append(value)
        elif box is None:
            box = text.infobox(value)
    return {
        "structured_part": [{"name": n, "text": t, "link": k} for n, (t, k) in (box or {}).items()],
        "unstructured_part": [{"text": w, "link": k, "position": i} for i, (w, k) in enumerate(tokens, 1)],
    }

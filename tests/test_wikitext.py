import random
import time

import pytest

from pagelathe.functions.wikitext import parse


def words(s, **k):
    return [(t["text"], t["link"]) for t in parse(s, **k)["unstructured_part"]]


def box(s):
    return [(p["name"], p["text"], p["link"]) for p in parse(s)["structured_part"]]


def plain(*ws):
    return [(w, None) for w in ws]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Hello, world_x don't", plain("Hello", "world_x", "don", "t")),
        ("[[Rome|the city]] a", [("the city", "Rome"), ("a", None)]),
        ("[[Rome#History]]", [("Rome", "Rome")]),
        ("[[#History]]", [("", "")]),
        ("[[A|b|c]]", [("c", "A")]),
        ("[[A|]]", [("A", "A")]),
        ("[[File:x.png|cap [[Rome]]]]", []),
        ("[[:File:x.png]]", []),
        ("[[file:x.png]]", [("file:x.png", "file:x.png")]),
        ("[[Image:x.png]]", [("Image:x.png", "Image:x.png")]),
        ("&nbsp;", plain("\xa0")),
        ("&#65;&#x42;&nope;", plain("A", "B", "nope")),
        ("[http://a.b/c my site]", plain("my", "site", "http://a.b/c")),
        ("[http://a.b/c]", plain("http", "a", "b", "c")),
        ("http://a.b/c", plain("http", "a", "b", "c")),
        ("[http://a.b see [[Rome|city]] now] z", plain("see", "city", "now", "http://a.b", "z")),
        ("[not a link]", plain("not", "a", "link")),
        ("{{lc:ABC}}", plain("A", "B", "C")),
        ("{{ uc : x y }}", plain("x", " ", "y")),
        ("{{lc}}", []),
        ("{{cite|x}}", []),
        ("a {{b|{{c|d}}|e}} f", plain("a", "f")),
        ("<!-- c -->", []),
        ("{{{arg}}}", []),
        ("== H [[A]] ==", [("H", None), ("A", "A")]),
        ("<ref>see b</ref>", plain("see", "b")),
        ("<ref name='x'/> y", plain("y")),
        ("'''bold''' ''x''", plain("bold", "x")),
        ("<nowiki>a [[b]]</nowiki> c", plain("a", "b", "c")),
        ("x<br/>y<br>z", plain("x", "y", "z")),
        ('{| class="w"\n|-\n| style="c" | one || two\n! h1 !! [[A|x]]\n|}\nafter', [*plain("one", "two", "h1"), ("x", "A"), ("after", None)]),
        ("* a\n# b\n----\n:c", plain("a", "b", "c")),
    ],
)
def test_tokens(text, want):
    assert words(text) == want


def test_positions_count_tokens_from_one():
    assert [t["position"] for t in parse("a [[b]] {{lc:xy}} c")["unstructured_part"]] == [1, 2, 3, 4, 5]


def test_magic_words_as_wholes():
    assert words("{{lc:ABC}} d", magic_word_chars=False) == plain("ABC", "d")


@pytest.mark.parametrize(
    "text, want",
    [
        ("{{Infobox p|name=Ann|home=[[Rome]] x}}", [("name", "Ann", None), ("home", "Rome x", "Rome")]),
        ("{{Infobox a|x=1}}{{Infobox b|y=2}}", [("x", "1", None)]),
        ("{{infobox a|x=1}}", []),
        ("{{Infobox p\n| name = Ann {{cite}}\n| other= o\n| name = B &amp; c\n| pos\n}}", [("name", "B & c", None), ("other", "o", None), ("1", "pos", None)]),
        ("{{Infobox|a=[[X|x]] and [[Y#s|y]]}}", [("a", "x and y", "Y")]),
        ("{{Infobox|a={{Infobox|b=2}}|c=[[p|q]]=r}}", [("a", "", None), ("c", "q r", "p")]),
        ("<div>{{Infobox|a=1}}</div>", [("a", "1", None)]),
    ],
)
def test_infobox(text, want):
    assert box(text) == want and all(w[0] not in ("Ann", "name") for w in words(text))


@pytest.mark.parametrize("text", ["[[a b", "a]] b", "{{a b", "a}} b", "<div>a b", "a</div> b", "{| a\nb", "[http://x a\nb", "[[a\nb]]", "&a b", "<!-- a b"])
def test_broken_markup_is_text(text):
    assert [w for w, _ in words(text)][-1] == "b"


def test_any_text_ends():
    rng = random.Random(12)
    pieces = ["{{", "}}", "{{{", "}}}", "[[", "]]", "[", "]", "|", "=", "<b>", "</b>", "<ref", ">", "{|", "|}", "\n|-\n", "\n", "a", " ", "Infobox", "&amp;", "<!--", "-->", "http://x", "''"]
    for _ in range(3000):
        got = parse("".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))))
        assert [t["position"] for t in got["unstructured_part"]] == list(range(1, len(got["unstructured_part"]) + 1))
    for unit in ("{{", "[[", "<b>", "}}", "]]", "</b>", "{{a|", "[[a|", "{{{", "<b></b>", "{{a}}"):
        parse(unit * 20_000)
    assert parse(None) == {"structured_part": [], "unstructured_part": []}


@pytest.mark.parametrize(
    "text, n",
    [
        ("{{a|" * 10_000 + "}}" * 10_000, 0),
        ("{{Infobox a|b=" * 10_000 + "}}" * 10_000, 0),
        ("{{\n x " * 10_000 + "}}" * 10_000, 9_999),
        ("<!-- " * 100_000, 0),
        ("{|\n" * 20_000 + "|}\n" * 20_000, None),
        ("<nowiki>" * 50_000, 50_000),
        ("<b>" * 20_000 + "x" + "</b>" * 20_000, 1),
        ("[http://a [[x " * 5_000 + "]] ]" * 5_000, None),
        ("[[a|" * 20_000 + "]]" * 20_000, None),
    ],
)
def test_deep_and_unbalanced_markup_takes_linear_time(text, n):
    start = time.process_time()
    found = words(text)
    assert time.process_time() - start < 5
    assert n is None or len(found) == n


def test_titles_of_nested_external_links():
    assert words("[http://a.b [[x [http://c.d y] ]] z]") == plain("x", "y", "http", "c", "d", "z", "http://a.b")
    assert words("[http://a.b [[x [http://c.d [[Rome|the city]] ]] ]]]") == plain("x", "the", "city", "http", "c", "d", "http://a.b")

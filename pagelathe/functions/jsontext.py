"""Complete JSON of any depth."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring
from json.scanner import NUMBER_RE

SPACE = re.compile(r"[ \t\n\r]*")
WORDS = {"true": True, "false": False, "null": None}


def number(digits: str) -> int | str:
    """A whole number; one of thousands of digits stays text."""
    return int(digits) if len(digits) < 4000 else digits


def no_constant(name: str):
    """NaN and Infinity are no JSON."""
    raise ValueError(name)


def loads(text: str):
    """The value of a JSON text; ValueError if it isn't complete JSON."""
    try:
        return json.loads(text, parse_int=number, parse_constant=no_constant)
    except RecursionError:
        return deep(text)


def deep(text: str):
    """The same without recursion. Containers that are open wait in a list; a name waits in its object until its value is there."""
    opened: list[tuple[list | dict, list[str]]] = []
    at, n = SPACE.match(text).end(), len(text)
    while True:
        # a value
        c = text[at : at + 1]
        if c in ("[", "{") and c:
            value: object = [] if c == "[" else {}
            at = SPACE.match(text, at + 1).end()
            if text[at : at + 1] != ("]" if c == "[" else "}"):
                opened.append((value, []))
                if c == "{":
                    at = name(text, at, opened[-1][1])
                continue
            at += 1
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        elif m := NUMBER_RE.match(text, at):
            whole, fraction, power = m.groups()
            value, at = (float(m.group()) if fraction or power else number(whole)), m.end()
        elif word := next((w for w in WORDS if text.startswith(w, at)), None):
            value, at = WORDS[word], at + len(word)
        else:
            raise ValueError(f"no value at {at}")
        # what it completes
        while True:
            at = SPACE.match(text, at).end()
            if not opened:
                if at < n:
                    raise ValueError(f"more at {at}")
                return value
            inside, names = opened[-1]
            if isinstance(inside, list):
                inside.append(value)
            else:
                inside[names.pop()] = value
            c = text[at : at + 1]
            if c == ",":
                at = SPACE.match(text, at + 1).end()
                if isinstance(inside, dict):
                    at = name(text, at, names)
                break
            if c != ("]" if isinstance(inside, list) else "}"):
                raise ValueError(f"not closed at {at}")
            value, at = opened.pop()[0], at + 1


def name(text: str, at: int, names: list[str]) -> int:
    """Take in a member's name; where its value begins."""
    if text[at : at + 1] != '"':
        raise ValueError(f"no name at {at}")
    key, at = scanstring(text, at + 1, True)
    at = SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError(f"no colon at {at}")
    names.append(key)
    return SPACE.match(text, at + 1).end()

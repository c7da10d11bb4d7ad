"""A tokenizer for languages with braces: enough to tell code from strings and comments."""

from __future__ import annotations

import re
from dataclasses import dataclass

_SCAN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<hash>\#(?!\[)[^\n]*)
    |(?P<string>"(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?)
    |(?P<template>`(?:\\.|[^`\\])*`?)
    |(?P<name>[$A-Za-z_\u0080-￿][$\w\u0080-￿]*)
    |(?P<number>\d[\w.]*)
    |(?P<sign>=>|->|\?->|\?\.(?!\d)|::|\.\.\.|===?|!==?|[-+*/%&|^<>]=?|.)""",
    re.DOTALL | re.VERBOSE,
)
#: Words after which a slash begins a regular expression.
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do".split())
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")


@dataclass
class Token:
    kind: str
    text: str
    line: int
    start: int
    end: int


def tokens(text: str, hash_comments: bool = False, regexes: bool = True) -> list[Token]:
    """All tokens but white space and comments."""
    out: list[Token] = []
    at, line = 0, 1
    while at < len(text):
        last = out[-1] if out else None
        literal = regexes and text[at] == "/" and text[at + 1 : at + 2] not in ("/", "*") and (
            last is None or (last.kind == "sign" and last.text not in (")", "]", "}")) or last.text in _BEFORE_REGEX
        )
        m = (_REGEX.match(text, at) if literal else None) or _SCAN.match(text, at)
        kind = m.lastgroup or "regex"
        if kind == "hash":
            kind = "space" if hash_comments else "sign"
            if not hash_comments:
                m = re.compile("#").match(text, at)
        if kind != "space":
            out.append(Token(kind, m[0], line, at, m.end()))
        line += m[0].count("\n")
        at = m.end()
    return out


def partners(found: list[Token]) -> dict[int, int]:
    """The index of the closing bracket of each opening one, and the reverse."""
    pairs, stack = {}, []
    for k, t in enumerate(found):
        if t.kind == "sign" and t.text in "([{":
            stack.append(k)
        elif t.kind == "sign" and t.text in ")]}" and stack:
            a = stack.pop()
            pairs[a], pairs[k] = k, a
    return pairs


def unquoted(literal: str) -> str:
    """The inner text of a string literal."""
    return literal[1:-1] if len(literal) > 1 and literal[0] == literal[-1] else literal[1:]

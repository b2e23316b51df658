r"""Selector language: ``{app="web", level=~"warn|error"} |= "timeout"``.

A selector is a block of label matchers, a keyword, or both. Values are double-quoted with backslash escapes. Anything else that
log query languages know (line regexes, negated or repeated keywords, unquoted values, trailing commas) is an error.
"""

from __future__ import annotations

import re

from .request import Matcher

SHORTEST_KEYWORD = 3  # characters
_QUOTED = r'"(?:\\.|[^"\\\n])*"'
_CLAUSE = re.compile(rf'\s*(?P<name>[^=!,}}"]*?)\s*(?P<op>=~|!~|!=|=)\s*(?P<value>{_QUOTED})\s*')
_KEYWORD = re.compile(rf"\|=\s*(?P<value>{_QUOTED})\s*\Z")
_ESCAPE = re.compile(rb'\\(?:(?P<plain>[abfnrtv\\"])|x(?P<hex>[0-9a-fA-F]{2})|(?P<octal>[0-3][0-7]{2})|u(?P<short>[0-9a-fA-F]{4})|U(?P<long>[0-9a-fA-F]{8}))|\\')
_PLAIN = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\", '"': '"'}


class SelectorError(ValueError):
    """The selector can't be parsed."""


def unquote(quoted: str) -> str:
    """Value of a double-quoted string; \\x and octal escapes stand for single bytes of UTF-8."""

    def value(m: re.Match) -> bytes:
        if m["plain"]:
            return _PLAIN[m["plain"].decode()].encode()
        if m["hex"] or m["octal"]:
            return bytes([int(m["hex"], 16) if m["hex"] else int(m["octal"], 8)])
        if code := m["short"] or m["long"]:
            point = int(code, 16)
            if point > 0x10FFFF or 0xD800 <= point <= 0xDFFF:
                raise SelectorError(f"escape out of range in {quoted}")
            return chr(point).encode()
        raise SelectorError(f"unknown escape in {quoted}")

    return _ESCAPE.sub(value, quoted[1:-1].encode()).decode("utf-8", "replace")


def _block(text: str) -> tuple[list[Matcher], str]:
    """Matchers of the block that ``text`` begins with, and the rest."""
    at = 1
    if (empty := re.compile(r"\s*\}").match(text, at)) is not None:
        return [], text[empty.end() :]
    found = []
    while True:
        m = _CLAUSE.match(text, at)
        if m is None:
            raise SelectorError(f"expected a label matcher at {text[at:]!r}")
        if not m["name"]:
            raise SelectorError(f"a label matcher lacks its name: {m[0].strip()!r}")
        found.append(Matcher(m["name"], unquote(m["value"]), m["op"]))
        at = m.end()
        if text[at : at + 1] == "}":
            return found, text[at + 1 :]
        if text[at : at + 1] != ",":
            raise SelectorError(f"expected , or }} at {text[at:]!r}")
        at += 1


def parse_selector(selector: str) -> tuple[tuple[Matcher, ...], str]:
    """Matchers and keyword ("" for none)."""
    text = selector.strip()
    if text[:1] not in ("{", "|"):
        raise SelectorError("a selector begins with { or |=" if text else "the selector is empty")
    found, rest = _block(text) if text[0] == "{" else ([], text)
    if not (rest := rest.strip()):
        return tuple(found), ""
    m = _KEYWORD.match(rest)
    if m is None:
        raise SelectorError(f'expected a single |= "keyword" at {rest!r}')
    if len(line := unquote(m["value"])) < SHORTEST_KEYWORD:
        raise SelectorError(f"a keyword has {SHORTEST_KEYWORD} characters at least")
    return tuple(found), line

"""RE2 patterns, as users write them, in the terms of Java's engine, which Spark runs."""

from __future__ import annotations

import re

#: Classes and escapes that the two dialects spell or define differently.
POSIX = {"alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}", "graph": r"\p{Graph}", "lower": r"\p{Lower}", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\s", "upper": r"\p{Upper}", "word": r"\w", "xdigit": r"\p{XDigit}"}
OUTSIDE = {"s": r"[\t\n\f\r ]", "S": r"[^\t\n\f\r ]", "b": r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))", "B": r"(?:(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<![0-9A-Za-z_])(?![0-9A-Za-z_]))", "z": r"\z", "A": r"\A"}
INSIDE = {"s": r"\t\n\f\r ", "S": r"\S"}
MOST_REPEATS = 1000

_TOKEN = re.compile(
    r"(?P<quote>\\Q.*?(?:\\E|\Z))|(?P<escape>\\(?:[pP]\{\^?\w+\}|[pP]\w|x\{[0-9a-fA-F]+\}|x[0-9a-fA-F]{2}|.))|(?P<group>\(\?(?:P?<\w+>|[imsU]*(?:-[imsU]+)?[:)]|.?.?))"
    r"|(?P<cls>\[\^?\]?(?:\[:\^?\w+:\]|\\.|[^\]\\])*\])|(?P<rep>(?:[*+?]|\{\d+(?:,\d*)?\})[?+]?)|(?P<one>.)",
    re.DOTALL,
)


class RegexError(ValueError):
    """The pattern isn't one of RE2's, or Java can't run it."""


def _class(text: str) -> str:
    negated = text.startswith("[^")
    body, out = text[2 if negated else 1 : -1], []
    for m in re.finditer(r"\[:(\^?)(\w+):\]|\\(.)|(.)", body, re.DOTALL):
        if m[2]:
            if m[2] not in POSIX:
                raise RegexError(f"unknown class [:{m[2]}:]")
            out.append(f"[^{POSIX[m[2]]}]" if m[1] else POSIX[m[2]])
        elif m[3]:
            out.append(INSIDE.get(m[3], "\\" + m[3]))
        else:
            out.append("\\" + m[4] if m[4] in "[&]" else m[4])
    return f"[{'^' * negated}{''.join(out)}]"


def _with_flags(kind: tuple[bool, bool], on: str, off: str) -> tuple[bool, bool]:
    return kind[0] and "m" not in off or "m" in on, kind[1] and "s" not in off or "s" in on


def re2_to_java(pattern: str) -> str:
    """The Java pattern that finds what RE2 finds for ``pattern``. Look-around, backreferences and possessive repeats are errors.

    Lines end at newlines only ((?d)). Flags hold to the end of their group. Names of groups are numbered, as Java allows fewer of them.
    """
    out, flags, open_groups, names = ["(?d)"], (False, False), [], set()  # flags: multi-line, dot matches all
    for m in _TOKEN.finditer(pattern):
        text, kind = m[0], m.lastgroup
        multiline, dot_all = flags
        if kind == "escape":
            c = text[1:]
            if c.isdigit() and c != "0":
                raise RegexError(f"backreference {text}")
            if c in ("C", "G", "Z", "h", "H", "R", "X", "k", "e", "c"):
                raise RegexError(f"unknown escape {text}")
            out.append(OUTSIDE.get(c, text))
        elif kind == "group":
            if named := re.fullmatch(r"\(\?P?<(\w+)>", text):
                if named[1] in names:
                    raise RegexError(f"two groups named {named[1]}")
                names.add(named[1])
                open_groups.append(flags)
                out.append(f"(?<g{len(names)}>")
            elif given := re.fullmatch(r"\(\?([imsU]*)(-[imsU]+)?([:)])", text):
                on, off = given[1], given[2] or ""
                if "U" in on + off:
                    raise RegexError("the flag U is not supported")
                if given[3] == ":":
                    open_groups.append(flags)
                flags = _with_flags(flags, on, off)
                out.append(f"(?{on}{'u' * ('i' in on)}{off}{given[3]}")
            else:
                raise RegexError(f"not supported: {text}")
        elif kind == "cls":
            out.append(_class(text))
        elif kind == "rep":
            if text[-1] == "+" and len(text) > 1:
                raise RegexError(f"possessive repeat {text}")
            if any(int(n) > MOST_REPEATS for n in re.findall(r"\d+", text)):
                raise RegexError(f"too many repeats: {text}")
            out.append(text)
        elif text == "$" and not multiline:
            out.append(r"\z")
        elif text == "$":
            out.append(r"(?=\n|\z)")  # Java's own doesn't hold between a carriage return and its newline
        elif text == "^":
            out.append(r"(?:(?<=\n)|\A)" if multiline else r"\A")
        elif text == "." and not dot_all:
            out.append(r"[^\n]")
        else:
            if text == "(":
                open_groups.append(flags)
            elif text == ")" and open_groups:
                flags = open_groups.pop()
            out.append(text)
    return "".join(out)


def checked(spark, pattern: str) -> str:
    """``re2_to_java``, and compiled once on the driver, so that an invalid pattern fails before anything is read."""
    java = re2_to_java(pattern)
    try:
        spark._jvm.java.util.regex.Pattern.compile(java)
    except Exception as error:
        raise RegexError(f"invalid pattern {pattern!r}") from error
    return java

"""Regex substitution with Python semantics, inside the JVM whenever both dialects agree."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.context import MaskError
from maskframe.functions.text import SPACES

# Accepted flag names.
REGEX_FLAGS = frozenset({
    "ASCII", "DEBUG", "DOTALL", "IGNORECASE", "LOCALE", "MULTILINE", "TEMPLATE", "UNICODE",
    "VERBOSE",
})

# Pieces written the same in both dialects, once the class shorthands are spelled out.
_SHARED_PIECE = re.compile(
    r"""
      (?P<shorthand>\\[dDwWsS])
    | (?P<boundary>\\b)
    | (?P<escape>\\[^A-Za-z0-9]|\\[tnrf])
    | (?P<dot>\.)
    | (?P<finish>\$)
    | (?P<group>\(\?:|\((?!\?)|\))
    | (?P<quantifier>(?:[*+?]|\{\d+(?:,\d*)?\})\??(?![+]))
    | (?P<set>\[\^?(?:\\[dws]|\\[^A-Za-z0-9]|[^\[\]\\&~|\-]|(?<=[\w])-(?=[\w])|-(?=\]))+\])
    | (?P<plain>[^\\()\[\]{}*+?.^$|])
    | (?P<bar>\|)
    | (?P<start>\^)
    """,
    re.VERBOSE,
)
_UNICODE_CLASSES = {"d": r"\p{Nd}", "w": r"\p{L}\p{N}_", "s": SPACES}
_ASCII_CLASSES = {"d": "0-9", "w": "A-Za-z0-9_", "s": r"\x09-\x0d\x20"}


def check_pattern(pattern: str, flags: tuple[str, ...] = ()) -> None:
    """Reject patterns that do not compile or whose shape risks runaway backtracking."""
    unknown = [f for f in flags if f.upper() not in REGEX_FLAGS]
    if unknown:
        raise MaskError(f"unknown regex flag: {unknown[0]}")
    try:
        re.compile(pattern)
    except re.error as exc:
        raise MaskError(f"invalid regex: {exc}") from exc
    if _may_explode(pattern):
        raise MaskError("a group that can match in several ways is repeated without bound")


_UNBOUNDED = re.compile(r"[*+]|\{\d*,\}")


def _may_explode(pattern: str) -> bool:
    """Whether an unbounded quantifier repeats a group that itself holds one, or a choice.

    Walks the pattern once and keeps, for every open group, whether it holds such a thing;
    a group inside hands its answer on to the one around it.
    """
    open_groups, at = [False], 0
    while at < len(pattern):
        char, at = pattern[at], at + 1
        if char == "\\":
            at += 1
        elif char == "[":
            at += pattern[at:at + 1] == "^"
            at += pattern[at:at + 1] == "]"
            while at < len(pattern) and pattern[at] != "]":
                at += 2 if pattern[at] == "\\" else 1
            at += 1
        elif char == "(":
            open_groups.append(False)
        elif char == "|":
            open_groups[-1] = True
        elif char == ")" and len(open_groups) > 1:
            varied = open_groups.pop()
            if varied and _UNBOUNDED.match(pattern, at):
                return True
            open_groups[-1] |= varied
        elif _UNBOUNDED.match(pattern, at - 1):
            open_groups[-1] = True
    return False


def java_pattern(pattern: str, flags: tuple[str, ...] = ()) -> str | None:
    """The same pattern for the JVM, or None when it uses anything outside the shared subset."""
    names = {f.upper() for f in flags}
    if names - {"IGNORECASE", "ASCII", "UNICODE"} or names >= {"IGNORECASE", "ASCII"}:
        return None
    classes = _ASCII_CLASSES if "ASCII" in names else _UNICODE_CLASSES
    out, at = [], 0
    while at < len(pattern):
        piece = _SHARED_PIECE.match(pattern, at)
        if piece is None:
            return None
        text = piece.group()
        if piece.lastgroup == "shorthand":
            text = f"[{'^' if text[1].isupper() else ''}{classes[text[1].lower()]}]"
        elif piece.lastgroup == "boundary":
            word = f"[{classes['w']}]"
            text = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
        elif piece.lastgroup == "dot":
            text = r"[^\n]"
        elif piece.lastgroup == "finish":
            text = r"(?=\n?\z)"
        elif piece.lastgroup == "set":
            text = re.sub(r"\\([dws])", lambda m: classes[m[1]], text)
        out.append(text)
        at = piece.end()
    return ("(?iu)" if "IGNORECASE" in names else "") + "".join(out)


def java_replacement(replacement: str) -> str | None:
    """The replacement with ``\\1`` as ``$1``, or None when it holds any other escape."""
    parts = re.split(r"\\([1-9])(?![0-9])", replacement)
    if any("\\" in literal for literal in parts[::2]):
        return None
    return "".join(p.replace("$", r"\$") if i % 2 == 0 else f"${p}" for i, p in enumerate(parts))


def _compiled_flags(flags: tuple[str, ...]) -> int:
    value = 0
    for name in flags:
        value |= getattr(re, name.upper(), 0)
    return value


def _arrow_substitute(pattern: str, replacement: str, flags: tuple[str, ...]):
    bits = _compiled_flags(flags) & ~int(re.DEBUG)

    @F.pandas_udf(T.StringType())
    def substitute(values: pd.Series) -> pd.Series:
        compiled = re.compile(pattern, bits)
        return values.map(lambda v: v if v is None else compiled.sub(replacement, v))

    return substitute


def regex_replace(
    c: Column,
    pattern: str,
    replacement: str,
    flags: tuple[str, ...] = (),
    path: str = "column",
    max_chars: int | None = None,
) -> Column:
    """``re.sub`` over each value, whatever its length.

    ``max_chars`` ends the job on a longer value, with an error that names only the column.
    """
    check_pattern(pattern, flags)
    if max_chars is not None:
        failure = F.raise_error(F.lit(f"{path}: value exceeds {max_chars} characters")).cast("string")
        c = F.when(F.char_length(c) <= max_chars, c).when(c.isNotNull(), failure)
    native, replaced = java_pattern(pattern, flags), java_replacement(replacement)
    if native is not None and replaced is not None:
        return F.regexp_replace(c, native, replaced)
    return _arrow_substitute(pattern, replacement, flags)(c)

"""Unicode NFC as deterministic expressions, with tables drawn from ``unicodedata``.

A text is left alone unless it holds a *doubtful* character: one that carries a combining class,
may join the character before it, or never stands in composed text. Otherwise only the
doubtful runs, each with the character before it, are decomposed, ordered and composed; the
standard guarantees that nothing beyond such a run takes part. Every expression is deterministic,
so Catalyst moves filters and column pruning through it. Unassigned code points stay as they are.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# The arithmetic of Hangul syllables.
_LEADS, _VOWELS, _TRAILS = (0x1100, 19), (0x1161, 21), (0x11A7, 28)
_SYLLABLES = 0xAC00
_BLOCK = 4096
# Doubtful ranges of the Brahmic scripts and beyond are drawn together over gaps this wide. That only
# sends a few more texts the long way, most of which hold such marks anyhow, and keeps plans short.
_GAP = 64


class Tables(NamedTuple):
    doubtful: str  # regex classes
    marks: str
    decomposed: dict[str, str]  # every character with a decomposition
    ordered: str  # characters with a combining class, and characters that stand for the class
    classes: str
    pairs: dict[str, str]


@lru_cache(maxsize=1)
def tables() -> Tables:
    syllables = range(_SYLLABLES, _SYLLABLES + _LEADS[1] * _VOWELS[1] * _TRAILS[1])
    chars = [chr(n) for n in range(128, sys.maxunicode + 1) if not 0xD800 <= n < 0xE000 and n not in syllables]
    full = {c: unicodedata.normalize("NFD", c) for c in chars}
    full = {c: d for c, d in full.items() if d != c}
    pairs = {}
    for c in full:
        parts = "".join(chr(int(p, 16)) for p in unicodedata.decomposition(c).split())
        if len(parts) == 2 and unicodedata.normalize("NFC", c) == c:
            pairs[parts] = c
    marks = {c for c in chars if unicodedata.combining(c)}
    joining = {p[1] for p in pairs} | {chr(_VOWELS[0] + i) for i in range(_VOWELS[1])}
    joining |= {chr(_TRAILS[0] + i) for i in range(1, _TRAILS[1])}
    never = {c for c in full if unicodedata.normalize("NFC", c) != c}
    ordered = "".join(sorted(marks))
    return Tables(
        # Nothing below U+0300 is doubtful; said first, it spares such characters the other tests.
        r"\x{300}-\x{10ffff}&&[" + char_class(marks | joining | never, gap=_GAP) + "]", char_class(marks), full, ordered,
        "".join(chr(0xE000 + unicodedata.combining(c)) for c in ordered), pairs,
    )


def char_class(chars: set[str], gap: int = 0) -> str:
    """Body of a regex class, its ranges grouped by block so that most characters meet few tests."""
    blocks: dict[int, list[list[int]]] = {}
    for n in sorted(map(ord, chars)):
        ranges = blocks.setdefault(n // _BLOCK, [])
        if ranges and n - ranges[-1][1] - 1 <= (gap if n >= 0x900 else 0):
            ranges[-1][1] = n
        else:
            ranges.append([n, n])
    return "".join(
        f"[\\x{{{b * _BLOCK:x}}}-\\x{{{b * _BLOCK + _BLOCK - 1:x}}}&&["
        + "".join(f"\\x{{{low:x}}}" + (f"-\\x{{{high:x}}}" if high > low else "") for low, high in ranges) + "]]"
        for b, ranges in blocks.items()
    )


def compose(c: Column) -> Column:
    """NFC of a text column; null stays null."""
    doubtful = (F.octet_length(c) != F.char_length(c)) & c.rlike(f"[{tables().doubtful}]")
    fixed = F.element_at(F.call_function("transform", F.array(c), F.expr(_composer())), 1)
    return F.when(doubtful, fixed).otherwise(c)


@lru_cache(maxsize=1)
def _composer() -> str:
    """The lambda that composes one text. As one parsed text it is built fast for many columns.

    Most runs (p) are two characters that make one, found at once. Others are decomposed and cut
    into pieces (q) that cannot join each other; in a piece the marks behind each starter are
    ordered by class, then joined from left to right. The state holds what is done, the starter,
    the marks behind it and the class of the last of them.
    """
    t = tables()
    q, m = t.doubtful, t.marks
    groups = f"regexp_extract_all(q, r'[^{m}][{m}]*|[{m}]+', 0)"
    rank = f"ascii(translate(h, {_text(t.ordered)}, {_text(t.classes)})) - {0xE000}"
    ranked = f"transform(array({rank}), k -> named_struct('k', if(k BETWEEN 1 AND 255, k, 0), 'i', i, 'c', h))[0]"
    state = "named_struct('done', {}, 'starter', {}, 'tail', {}, 'last', {})"
    joined = (
        "IF(s.starter <> '' AND (s.tail = '' OR s.last < e.k), "
        f"coalesce({_pair('s.starter', 'e.c')}, {_syllable('s.starter', 'e.c')}), NULL)"
    )
    step = (
        f"transform(array({joined}), y -> CASE"
        f" WHEN y IS NOT NULL THEN {state.format('s.done', 'y', 's.tail', 's.last')}"
        f" WHEN e.k = 0 THEN {state.format('s.done || s.starter || s.tail', 'e.c', _EMPTY, '0')}"
        f" ELSE {state.format('s.done', 's.starter', 's.tail || e.c', 'e.k')} END)[0]"
    )
    piece = (
        f"aggregate(flatten(transform({groups}, g -> array_sort(transform(split(g, ''), (h, i) -> {ranked})))),"
        f" {state.format(_EMPTY, _EMPTY, _EMPTY, '0')}, (s, e) -> {step}, s -> s.done || s.starter || s.tail)"
    )
    decomposed = f"array_join(transform(split(p, ''), d -> coalesce({_decomposed('d')}, d)), '')"
    run = f"array_join(transform(regexp_extract_all({decomposed}, r'[^{q}][{q}]*|[{q}]+', 0), q -> {piece}), '')"
    two = f"IF(char_length(p) = 2, {_pair('substring(p, 1, 1)', 'substring(p, 2, 1)')}, NULL)"
    runs = f"regexp_extract_all(x, r'(?s).?[{q}]+|[\\x00-\\x{{2ff}}]+(?![{q}])|[^{q}]+(?![{q}])', 0)"
    long_way = f"octet_length(p) <> char_length(p) AND rlike(p, r'[{q}]')"
    return f"x -> array_join(transform({runs}, p -> IF({long_way}, coalesce({two}, {run}), p)), '')"


_EMPTY = "''"
_SPREAD = 31
_SLOTS = 1024  # parts of a lookup table, so that a lookup passes two or three entries


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _pair(first: str, second: str) -> str:
    """What two characters make; null if they stay two."""
    number = f"(ascii({first}) * {_SPREAD} + ascii({second}))"
    return _lookup(tables().pairs, lambda pair: ord(pair[0]) * _SPREAD + ord(pair[1]), number, f"{first} || {second}")


def _decomposed(char: str) -> str:
    """The full decomposition of a character, or null."""
    return _lookup(tables().decomposed, ord, f"ascii({char})", char)


def _lookup(entries: dict[str, str], number: Callable[[str], int], at: str, key: str) -> str:
    """``entries`` at ``key``, which lies in the slot of its number; a slot reads ``,`` key value ``,`` key value ``,``."""
    slots = [""] * _SLOTS
    for k, value in entries.items():
        slots[number(k) % _SLOTS] += f",{k}{value}"
    table = _text("/".join(f"{s}," if s else s for s in slots))
    slot = f"split({table}, '/')[{at} % {_SLOTS}]"
    return f"nullif(substring_index(substring_index({slot}, ',' || {key}, -1), ',', 1), '')"


def _syllable(first: str, second: str) -> str:
    """The Hangul syllable of a lead and a vowel, or of an open syllable and a trail; else null."""
    (lead, leads), (vowel, vowels), (trail, trails) = _LEADS, _VOWELS, _TRAILS
    a, b, last = f"ascii({first})", f"ascii({second})", _SYLLABLES + leads * vowels * trails - 1
    code = (
        f"CASE WHEN {a} BETWEEN {lead} AND {lead + leads - 1} AND {b} BETWEEN {vowel} AND {vowel + vowels - 1}"
        f" THEN {_SYLLABLES} + (({a} - {lead}) * {vowels} + {b} - {vowel}) * {trails}"
        f" WHEN {a} BETWEEN {_SYLLABLES} AND {last} AND ({a} - {_SYLLABLES}) % {trails} = 0"
        f" AND {b} BETWEEN {trail + 1} AND {trail + trails - 1} THEN {a} + {b} - {trail} END"
    )
    return f"decode(unhex(hex({code})), 'UTF-16BE')"

"""JSON documents as text: the members of an object, to the letter, by regular expressions in the JVM.

Every quantifier is possessive, so matching is linear and does not recurse for long strings or
lists; only nesting does, and it is bounded.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels of lists and objects inside of one member; what is deeper is not recognised.
MAX_DEPTH = 64

_BLANK = r"[ \t\n\r]*+"
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def _nested(depth: int) -> str:
    inner = rf"[^\[\]{{}}\"]++|{_STRING}"
    out = rf"[\[{{](?:{inner})*+[\]}}]"
    for _ in range(depth - 1):
        out = rf"[\[{{](?:{inner}|{out})*+[\]}}]"
    return out


_VALUE = rf'(?:{_STRING}|[^ \t\n\r,:\[\]{{}}"]++|{_nested(MAX_DEPTH)})'
_LEAD = rf"{_BLANK}[{{,]{_BLANK}"
_MEMBER = rf"(?s)\G({_LEAD})({_STRING})({_BLANK}:{_BLANK})({_VALUE})"
# Characters that no JSON document holds unescaped; they part members and what makes up a member.
_PART, _NEXT = "\x01", "\x02"
_PLAIN = r"\A[\x20\x21\x23-\x5b\x5d-\x7e]*\z"
_END = rf"^{_BLANK}(?:\{{{_BLANK})?\}}{_BLANK}$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` applied to ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def string_value(literal: Column) -> Column:
    """What a JSON string literal says; NULL where it is none."""
    plain = F.substring(literal, F.lit(2), F.length(literal) - 2)
    read = F.get(F.from_json(F.concat(F.lit("["), literal, F.lit("]")), "array<string>"), F.lit(0))
    return F.when(F.contains(literal, F.lit("\\")), read).otherwise(plain)


def string_literal(value: Column) -> Column:
    """A text as a JSON string literal. Plain ASCII is put in quotes, anything else read off a list written by Spark."""
    quote = F.lit('"')
    return let(value, lambda v: F.when(F.rlike(v, F.lit(_PLAIN)), F.concat(quote, v, quote)).otherwise(
        F.rtrim(F.ltrim(F.to_json(F.array(v)), F.lit("[")), F.lit("]"))
    ))


def starts_with(text: Column, character: str) -> Column:
    return F.startswith(F.ltrim(text, F.lit(" \t\n\r")), F.lit(character))


def members(text: Column) -> Column:
    """The members of an object's text and, last, what follows them; only the latter where it is no object.

    A member is ``[lead, key, colon, value]`` as written, lead being the brace or comma before the
    key. All parts together are the whole text.
    """
    parted = F.regexp_replace(text, F.lit(_MEMBER), F.lit(f"$1{_PART}$2{_PART}$3{_PART}$4{_NEXT}"))
    return F.transform(F.split(parted, _NEXT), lambda m: F.split(m, _PART))


def key_is(member: Column, name: str, ignore_case: bool = False) -> Column:
    """Whether a member's key reads ``name``, however it is written."""
    written = F.get(member, F.lit(1))
    escaped = F.contains(written, F.lit("\\"))
    if ignore_case:
        return F.coalesce(F.lower(string_value(written)) == name.lower(), F.lit(False))
    plain = json.dumps(name, ensure_ascii=False)
    return F.coalesce((written == plain) | (escaped & (string_value(written) == name)), F.lit(False))


def _is_unreadable(literal: Column) -> Column:
    return F.contains(literal, F.lit("\\")) & string_value(literal).isNull()


def is_whole(parts: Column) -> Column:
    """Whether :func:`members` took in the whole object, so that nothing in it went unseen."""
    return F.rlike(F.get(F.get(parts, F.size(parts) - 1), F.lit(0)), F.lit(_END)) & ~F.exists(
        F.slice(parts, F.lit(1), F.size(parts) - 1), lambda m: (F.size(m) != 4) | _is_unreadable(F.get(m, F.lit(1)))
    )


def is_single_value(text: Column) -> Column:
    """Whether the text is one value and nothing else."""
    return F.rlike(text, F.lit(f"(?s)^{_BLANK}{_VALUE}{_BLANK}$"))


def holds_object(text: Column) -> Column:
    """Whether there is an object anywhere in the text."""
    return F.contains(F.regexp_replace(text, f"(?s){_STRING}", ""), F.lit("{"))

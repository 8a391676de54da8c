"""Suffixes that keep faked values of unique columns apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskframe.functions.seeds import Seed

_SEED_DIGITS = 54


def _token(seed: Seed) -> Column:
    return F.substring(seed.hex, 1, 16)


def unique_email(base: Column, seed: Seed) -> Column:
    """Insert ``+token`` before the last ``@``, or append it when there is none."""
    local = F.regexp_extract(base, r"(?s)^(.*)@([^@]*)$", 1)
    domain = F.regexp_extract(base, r"(?s)^(.*)@([^@]*)$", 2)
    tagged = F.concat(local, F.lit("+"), _token(seed), F.lit("@"), domain)
    return F.when(base.contains("@"), tagged).otherwise(F.concat(base, F.lit("+"), _token(seed)))


def unique_date(base: Column, seed: Seed) -> Column:
    """Shift an ISO date by 1 to 3650 days. Dates can still collide."""
    return F.date_add(base.cast("date"), (seed.mod(3650) + F.lit(1)).cast("int")).cast("string")


def unique_numeric(base: Column, seed: Seed) -> Column:
    """Remap a digit string to the seed modulo ten to its width; a minus sign stays in front.

    The residue is the last digits of the seed, so every width is served alike.
    """
    sign = F.when(base.startswith("-"), F.lit("-")).otherwise("")
    width = F.length(base) - F.length(sign)
    digits = F.lpad(seed.digits(), F.greatest(width, F.lit(_SEED_DIGITS)), F.lit("0"))
    return F.when(base == "", base).otherwise(F.concat(sign, F.right(digits, width)))


def unique_text(base: Column, seed: Seed) -> Column:
    return F.concat(base, F.lit("__"), _token(seed))


def unique_suffix(base: Column, seed: Seed, shape: str) -> Column:
    """Pick the suffix by output shape; ``any`` (custom providers) decides per value.

    Empty text stays empty.
    """
    return F.when(base == "", base).otherwise(_suffixed(base, seed, shape))


def _suffixed(base: Column, seed: Seed, shape: str) -> Column:
    if shape == "email":
        return unique_email(base, seed)
    if shape == "fixed":
        return base
    if shape == "date":
        return unique_date(base, seed)
    if shape == "numeric":
        return unique_numeric(base, seed)
    if shape == "text":
        return unique_text(base, seed)
    is_date = base.rlike(r"^\d{4}-\d{2}-\d{2}$")
    digits = F.when(base.rlike(r"^-?\d+$"), base)
    return (
        F.when(is_date, unique_date(F.when(is_date, base), seed))
        .when(digits.isNotNull(), unique_numeric(digits, seed))
        .otherwise(unique_text(base, seed))
    )

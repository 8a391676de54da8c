"""Bring masked text back to a column's own type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.functions.text import SPACES, strip

# Accepted boolean spellings.
TRUE_LITERALS = ("t", "true", "y", "yes", "1", "on")
FALSE_LITERALS = ("f", "false", "n", "no", "0", "off")


def coerce_to(c: Column, dtype: T.DataType, path: str) -> Column:
    """Cast masked text; a value that does not fit raises an error naming only the column."""
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return c
    converted = _convert(c, dtype)
    failure = F.raise_error(
        F.lit(f"masked value for {path} is not a valid {dtype.simpleString()}")
    ).cast(dtype)
    return F.when(c.isNotNull(), F.coalesce(converted, failure))


def _convert(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        text = F.lower(strip(c))
        return F.when(text.isin(*TRUE_LITERALS), True).when(text.isin(*FALSE_LITERALS), False)
    if isinstance(dtype, T.BinaryType):
        digits = F.regexp_replace(F.regexp_replace(c, r"^\\x", ""), f"[{SPACES}]", "")
        whole = digits.rlike(r"^([0-9A-Fa-f]{2})*$")
        return F.when(whole, F.unhex(F.when(whole, digits)))
    if isinstance(dtype, T.IntegralType):
        # int() accepts surrounding space, a sign and digits; a decimal point is an error.
        text = strip(c)
        return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast(dtype))
    return c.try_cast(dtype)

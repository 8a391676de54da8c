"""Text primitives shared by every seeded expression."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.functions.compose import compose

# The whitespace str.strip() removes, as a regex character class body.
SPACES = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_LENGTHS = b"".join(n.to_bytes(4, "big") for n in range(256))


def quoted(name: str) -> Column:
    """Column by its literal name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACES}]+|[{SPACES}]+$", "")


@F.pandas_udf(T.StringType())
def _nfc_arrow(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None else unicodedata.normalize("NFC", v))


def nfc(c: Column, mode: str = "jvm") -> Column:
    """Unicode NFC, by deterministic expressions or (``"arrow"``) in Python workers."""
    if mode == "off":
        return c
    return _nfc_arrow(c) if mode == "arrow" else compose(c)


def segment(value: str) -> bytes:
    """Length-prefixed UTF-8 bytes, for the constant parts of a digest message."""
    data = value.encode()
    return len(data).to_bytes(4, "big") + data


def segment_column(c: Column) -> Column:
    """Length-prefixed UTF-8 bytes of each value. Short lengths come from a constant table."""
    size = F.octet_length(c)
    short = F.substring(F.lit(bytearray(_LENGTHS)), size * 4 + 1, F.lit(4))
    prefix = F.when(size < 256, short).otherwise(F.unhex(F.lpad(F.hex(size), 8, "0")))
    return F.concat(prefix, c.cast("binary"))


def python_str(c: Column, dtype: T.DataType) -> Column:
    """The text ``str(value)`` gives in Python, which is what the digests are defined on."""
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return c
    if isinstance(dtype, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return _float_text(c.cast("double"))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return _timestamp_text(c, zoned=isinstance(dtype, T.TimestampType))
    if isinstance(dtype, (T.IntegralType, T.DecimalType, T.DateType)):
        return c.cast("string")
    raise TypeError(f"values of type {dtype.simpleString()} have no text form to mask")


def _float_text(c: Column) -> Column:
    """Re-layout the JVM's shortest digits: exponent form only below 1e-4 and from 1e16."""
    text = c.cast("string")
    mantissa = F.regexp_extract(text, r"^-?([0-9.]+)E", 1)
    exponent = F.regexp_extract(text, r"E(-?[0-9]+)$", 1)
    power = F.when(exponent != "", exponent.cast("int"))
    sign = F.when(text.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), r"\.", "")
    large = F.when(
        F.length(digits) <= power + 1, F.concat(F.rpad(digits, power + 1, F.lit("0")), F.lit(".0"))
    ).otherwise(
        F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2))
    )
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    scientific = F.concat(
        F.regexp_replace(mantissa, r"\.0$", ""),
        F.when(power < 0, "e-").otherwise("e+"),
        F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")),
    )
    laid_out = F.when((power >= 0) & (power < 16), large).when(
        (power < 0) & (power >= -4), small
    ).otherwise(scientific)
    special = F.when(F.isnan(c), "nan").when(text == "Infinity", "inf").when(
        text == "-Infinity", "-inf"
    )
    return F.coalesce(special, F.when(power.isNull(), text).otherwise(F.concat(sign, laid_out)))


def _timestamp_text(c: Column, *, zoned: bool) -> Column:
    whole = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    micros = F.date_format(c, "SSSSSS")
    text = F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
    return F.concat(text, F.lit("+00:00")) if zoned else text

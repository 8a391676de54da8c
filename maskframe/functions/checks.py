"""Shape checks and value-free previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.functions.text import python_str, quoted

# Field names whose text is structural metadata and never personal data.
STRUCTURAL_FIELDS = frozenset({
    "action", "cause", "code", "column_name", "commercial_layer_present", "config_hash",
    "detail", "duration_ms", "engine_version", "errors", "estimated_rows", "event", "kind",
    "level", "matched_pattern", "message", "object_name", "provider", "reason", "remediation",
    "rows_affected", "rows_processed", "run_id", "salt_fingerprint", "schema_name",
    "source_column_path", "source_db_hash", "status", "strategy", "table", "table_id",
    "table_name", "tables_created", "tables_processed", "uri_scheme",
})


def passes_luhn(c: Column) -> Column:
    """True for digit strings of two or more characters with a valid Luhn checksum."""
    return (F.length(c) >= 2) & F.call_function("luhn_check", c)


def is_fake_ssn(c: Column) -> Column:
    """True for ``ddd-dd-dddd`` values in the area range 000 to 099 the ssn provider emits."""
    return c.rlike(r"(?d)^0\d{2}-\d{2}-\d{4}$")


def redact(c: Column, pepper: str) -> Column:
    """``***`` for null or empty text, otherwise its length and 8 digits of a peppered hash."""
    digest = F.sha2(F.concat(F.lit(pepper + ":"), c).cast("binary"), 256)
    hint = F.concat(
        F.lit("***len="), F.char_length(c).cast("string"), F.lit(":"), F.substring(digest, 1, 8)
    )
    return F.when(c.isNull() | (c == ""), "***").otherwise(hint)


def safe_preview(c: Column, pepper: str) -> Column:
    """A log-safe marker: ``<NULL>``, ``<EMPTY>`` or ``<SENSITIVE:hint>``."""
    return (
        F.when(c.isNull(), "<NULL>")
        .when(c == "", "<EMPTY>")
        .otherwise(F.concat(F.lit("<SENSITIVE:"), redact(c, pepper), F.lit(">")))
    )


def redact_fields(
    df: DataFrame, pepper: str, allow: frozenset[str] = STRUCTURAL_FIELDS
) -> DataFrame:
    """Redact every column that is no integer, float, boolean or allow-listed name.

    Nulls stay null, since a missing value tells nothing about anyone.
    """
    plain = (T.IntegralType, T.FloatType, T.DoubleType, T.BooleanType)
    out = []
    for f in df.schema.fields:
        c = quoted(f.name)
        if f.name in allow or isinstance(f.dataType, plain):
            out.append(c)
            continue
        nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        text = F.to_json(c) if nested else python_str(c, f.dataType)
        out.append(F.when(c.isNotNull(), redact(text, pepper)).alias(f.name))
    return df.select(*out)

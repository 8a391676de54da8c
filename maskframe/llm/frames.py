"""Column names, tables and folders shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.functions.text import quoted
from maskframe.session import run_dir

#: The white space that separates words: space, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The wished names, each with underscores added until no column is called so."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def text_of(column: str) -> Column:
    """A text column, null read as empty."""
    return F.coalesce(quoted(column).cast("string"), F.lit(""))


def space_words(text: Column) -> Column:
    """The words between :data:`SPACES`, in order; an empty array where there is none."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(
        F.split(trimmed, SPACE_PATTERN)
    )


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z only, whatever the locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` applied to ``value``, which is computed once however often ``use`` names it.

    A chain of such steps stays one projection, and arrays pass from step to step without
    being copied into rows.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def without(text: Column, characters: str) -> Column:
    """``text`` less every one of ``characters``; a search per character beats one translation."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the folder all executors share and read it back.

    Losing executors then costs no more than the tasks that were running.
    """
    spark = df.sparkSession
    path = run_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

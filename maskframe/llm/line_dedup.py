"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskframe.functions.text import quoted
from maskframe.llm.frames import SPACES, fresh, table, text_of
from maskframe.llm.registry import query

#: A line on this share of a site's pages, and on so many of them, is boilerplate.
MAX_SHARE = 0.05
MIN_PAGES = 5


def line_key(line: Column) -> Column:
    """What makes lines equal: their text without outer white space, as a 64-bit hash."""
    return F.xxhash64(F.btrim(line, F.lit(SPACES)))


def _keys(text: Column) -> Column:
    """The distinct keys of the lines of one page that have a word."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    return F.array_distinct(F.transform(lines, line_key))


def boilerplate(
    docs: DataFrame, text: str, site: str, max_share: float = MAX_SHARE, min_pages: int = MIN_PAGES,
    copies_once: bool = False,
) -> DataFrame:
    """``(site, line)`` of the lines above the share; ``line`` is :func:`line_key`.

    Pages are rows, or with ``copies_once`` the different texts of a site (by a 64-bit hash).
    Each page's distinct lines are counted before the shuffle, so a hot site or line travels as
    one row per task, and so does a text with many copies.
    """
    body = text_of(text)
    pages = docs.select(quoted(site).alias("site"), F.xxhash64(body).alias("t"), _keys(body).alias("keys"))
    if copies_once:
        pages = pages.groupBy("site", "t").agg(F.first("keys").alias("keys"))
    often = (
        pages.select("site", F.explode("keys").alias("line"))
        .groupBy("site", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    )
    rows = pages.select("site") if copies_once else docs.select(quoted(site).alias("site"))
    totals = rows.groupBy(F.col("site").alias("of")).agg(F.count(F.lit(1)).alias("pages"))
    return often.join(totals, F.col("site").eqNullSafe(F.col("of"))).where(
        F.col("n") / F.col("pages") >= F.lit(float(max_share))
    ).select("site", "line", "n", "pages")


def drop_boilerplate(
    docs: DataFrame,
    text: str = "text",
    site: str = "source",
    key: str = "doc_id",
    max_share: float = MAX_SHARE,
    min_pages: int = MIN_PAGES,
    count_as: str | None = None,
    copies_once: bool = False,
) -> DataFrame:
    """``docs`` without the lines that stand on too many pages of their site.

    The share is the number of the site's pages (rows) that hold the line, divided by the
    site's pages; a line is dropped from ``max_share`` on if ``min_pages`` pages hold it.
    Lines are parted by line feeds and compared without outer white space; blank lines stay.
    Rows are never dropped: a text of nothing but boilerplate becomes empty. A null text stays
    null and counts as a page without lines; a null site is a site of its own; repeated rows
    are pages each unless ``copies_once`` counts equal texts of a site as one page, so that
    many copies of a page make no boilerplate of it; rows sharing a ``key`` are told apart by their text. An empty table
    gives an empty one. Other columns keep their names and values. ``count_as`` names a
    further column with the number of lines dropped from the row.
    """
    name_drop, name_kept = fresh([*docs.columns, "k", "s", "t"], "__drop", "__kept")
    marked = boilerplate(docs, text, site, max_share, min_pages, copies_once)
    body = text_of(text)
    pages = docs.select(
        quoted(key).alias("k"), quoted(site).alias("s"), F.xxhash64(body).alias("t"), _keys(body).alias("keys")
    )
    # One row for each distinct line of a page meets the few marked lines; hits gather by page.
    hits = (
        pages.select("k", "s", "t", F.explode("keys").alias("l"))
        .join(marked.select("site", "line"), F.col("s").eqNullSafe(F.col("site")) & (F.col("l") == F.col("line")))
        .groupBy("k", "s", "t").agg(F.collect_set("l").alias(name_drop))
    )
    k, sk, t = fresh(docs.columns, "__k", "__s", "__t")
    joined = docs.join(
        hits.toDF(k, sk, t, name_drop),
        quoted(key).eqNullSafe(F.col(k)) & quoted(site).eqNullSafe(F.col(sk)) & (F.xxhash64(body) == F.col(t)),
        "left",
    )
    kept = F.filter(F.split(body, "\n"), lambda x: ~F.array_contains(F.col(name_drop), line_key(x)))
    done = joined.withColumn(name_kept, F.when(F.col(name_drop).isNotNull(), kept))
    cleaned = F.when(F.col(name_kept).isNull(), quoted(text)).otherwise(F.array_join(name_kept, "\n"))
    out = [cleaned.alias(c) if c == text else quoted(c) for c in docs.columns]
    if count_as:
        lost = F.size(F.split(body, "\n")) - F.size(name_kept)
        out.append(F.coalesce(F.when(F.col(name_kept).isNotNull(), lost), F.lit(0)).cast("long").alias(count_as))
    return done.select(*out)


_SPACES_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: Expects the documents in {docs}; gives l_kept(doc_id, source, text, n_lines, kept).
KEPT_LINES_SQL = f"""
l_lines AS (
  SELECT DISTINCT doc_id, source, trim(line, {_SPACES_SQL}) AS line FROM (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM {{docs}})),
l_marked AS (
  SELECT c.source, list(c.line) AS lines FROM (
    SELECT source, line, count(*) AS n FROM l_lines WHERE line <> '' GROUP BY source, line) c
  JOIN (SELECT source, count(*) AS pages FROM {{docs}} GROUP BY source) p
    ON c.source IS NOT DISTINCT FROM p.source
  WHERE n >= {MIN_PAGES} AND n::DOUBLE / pages >= {MAX_SHARE}::DOUBLE GROUP BY c.source),
l_kept AS (
  SELECT d.doc_id, d.source, d.lang, string_split(d.text, chr(10)) AS before,
    list_filter(string_split(d.text, chr(10)),
                lambda x: NOT coalesce(list_contains(m.lines, trim(x, {_SPACES_SQL})), FALSE)) AS after
  FROM {{docs}} d LEFT JOIN l_marked m ON d.source IS NOT DISTINCT FROM m.source)"""

OP9_SQL = f"""WITH {KEPT_LINES_SQL.format(docs="documents")}
SELECT doc_id, source, len(before)::BIGINT AS n_lines, (len(before) - len(after))::BIGINT AS n_dropped,
  length(array_to_string(after, chr(10)))::BIGINT AS n_chars, md5(array_to_string(after, chr(10))) AS text_md5
FROM l_kept"""


@query("op9_line_dedup", OP9_SQL)
def op9_line_dedup(spark, sf_dir):
    """Every document less the boilerplate lines of its source, as counts and a digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    counted = docs.withColumn("n_lines", F.size(F.split("text", "\n")).cast("long"))
    return drop_boilerplate(counted, count_as="n_dropped").select(
        "doc_id", "source", "n_lines", "n_dropped",
        F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"),
    )

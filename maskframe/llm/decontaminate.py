"""Benchmark decontamination by template canonicalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskframe.functions.text import quoted
from maskframe.llm.frames import fresh, let, table, text_of, written
from maskframe.llm.registry import query

#: Words in a template window, and how many of them must be words rather than placeholders.
WINDOW = 5
LEAST_LITERAL = 3
#: A text holds an item when so much of the item's words is matched, in percent.
MIN_PERCENT = 80
#: Up to this many template windows of the benchmark are broadcast; beyond it the join shuffles.
MAX_BROADCAST_WINDOWS = 500_000

_MARK = "\x01"
#: A capital before a small letter, inside a sentence, starts a name; the mark goes before it.
NAME_PATTERN = r"([\p{Ll}\p{Nd},;)] )(\p{Lu}\p{Ll})"
#: In lower-cased text: numbers, and words with or without the mark.
TOKEN_PATTERN = r"[0-9]+(?:[.,][0-9]+)*|\x01?[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UNITS = (
    "mm cm km kg mg ml kmh mph usd eur gbp percent cent cents dollar dollars euro euros second seconds minute "
    "minutes hour hours day days week weeks month months year years mile miles meter meters metre metres foot "
    "feet inch inches pound pounds ounce ounces gram grams liter liters litre litres degree degrees"
).split()
#: What stands for a typed placeholder among the hashes of words.
_NAME, _NUMBER, _UNIT = -1, -2, -3


def _tokens(text: Column) -> Column:
    marked = F.regexp_replace(F.translate(text, _MARK, " "), NAME_PATTERN, "$1" + _MARK + "$2")
    return F.regexp_extract_all(F.lower(marked), F.lit(TOKEN_PATTERN), F.lit(0))


def template_windows(text: Column) -> Column:
    """Array of ``(pos, key, slots)``: the windows of both template views of a text.

    In the first view names, numbers and units are placeholders; in the second names are
    words like any other, so that a copy that lost its capitals is still found. A window that
    both views have alike is listed once. ``key`` hashes the template, ``slots`` holds the
    values that the placeholders stand for, in order; it is null in texts without any.
    """

    # Marked names and numbers are the only tokens that sort before the letter a.
    def is_unit(x: Column) -> Column:
        return x.isin(UNITS)

    def typed(x: Column) -> Column:
        return F.when(x < "a", F.when(x < "0", _NAME).otherwise(_NUMBER)).when(is_unit(x), _UNIT).otherwise(F.xxhash64(x))

    def spoken(x: Column) -> Column:
        literal = F.xxhash64(F.ltrim(x, F.lit(_MARK)))
        return F.when((x < "a") & (x >= "0"), _NUMBER).when(is_unit(x), _UNIT).otherwise(literal)

    def windows(hashes: Column, values: Column, any_slot: Column) -> Column:
        def one(h: Column, i: Column) -> Column:
            key = F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, WINDOW)])
            slots = F.array_compact(F.array(*[F.get(values, i + k) for k in range(WINDOW)]))
            return F.struct(i.alias("pos"), key.alias("key"), F.when(any_slot, slots).alias("slots"))

        return F.slice(F.transform(hashes, one), F.lit(1), F.size(hashes) - (WINDOW - 1))

    def both(words: Column) -> Column:
        slots = F.transform(words, lambda x: F.when((x < "a") | is_unit(x), x))
        numbers = F.transform(words, lambda x: F.when(((x < "a") & (x >= "0")) | is_unit(x), x))
        named = F.exists(words, lambda x: x < "0")

        def first(values: Column) -> Column:
            # Bound outside of the windows: asked once per text, not once per window.
            return let(F.transform(words, typed), lambda h: let(
                F.exists(values, lambda v: v.isNotNull()), lambda some: windows(h, values, some)
            ))

        def second(values: Column) -> Column:
            return let(F.transform(words, spoken), lambda h: windows(h, values, F.lit(True)))

        def joined(a: Column) -> Column:
            more = F.filter(let(numbers, second), lambda w, i: w["key"] != F.get(a, i)["key"])
            return F.when(named, F.concat(a, more)).otherwise(a)

        return let(let(slots, first), joined)

    empty = "array<struct<pos:int,key:bigint,slots:array<string>>>"
    return let(_tokens(text), lambda w: F.when(F.size(w) >= WINDOW, both(w)).otherwise(F.array().cast(empty)))


def _covered(places: Column) -> Column:
    """Words under the windows that start at the given distinct places."""
    def total(p: Column) -> Column:
        step = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    return let(F.array_sort(places), total)


def _agreeing(hits: Column) -> Column:
    """Places of the windows of one alignment whose values agree with those of the others.

    An item value stands for the text value that most windows have for it, more than any
    other; an unchanged value always agrees. A window with another value is left out.
    """
    pairs = F.array_distinct(F.flatten(F.transform(hits, lambda h: h["pairs"])))

    def votes(p: Column) -> Column:
        # Both views may have the same place.
        return F.size(F.array_distinct(F.transform(
            F.filter(hits, lambda h: F.array_contains(h["pairs"], p)), lambda h: h["place"]
        )))

    def fits(counted: Column) -> Column:
        def leads(c: Column) -> Column:
            rivals = F.filter(counted, lambda d: (d["pair"]["given"] == c["pair"]["given"]) & (d["pair"] != c["pair"]))
            return F.forall(rivals, lambda d: d["votes"] < c["votes"])

        kept = F.filter(counted, lambda c: (c["pair"]["given"] == c["pair"]["slots"]) | leads(c))
        return F.transform(kept, lambda c: c["pair"])

    def places(of: Column) -> Column:
        return F.array_distinct(F.transform(of, lambda h: h["place"]))

    def chosen(p: Column) -> Column:
        counted = F.transform(p, lambda x: F.struct(x.alias("pair"), votes(x).alias("votes")))
        agreeing = let(let(counted, fits), lambda good: places(
            F.filter(hits, lambda h: F.forall(h["pairs"], lambda x: F.array_contains(good, x)))
        ))
        one_each = F.size(F.array_distinct(F.transform(p, lambda x: x["given"]))) == F.size(p)
        return F.when(one_each, places(hits)).otherwise(agreeing)

    return let(pairs, chosen)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    min_percent: int = MIN_PERCENT,
) -> DataFrame:
    """``(id, hash, item, matched, words)``: which texts hold which benchmark items.

    Windows of five words join on their template. Along one alignment of text and item each
    value of the item stands for one value of the text, the one that most windows have;
    windows with another value do not count, unless it is the item's own. Two values of the
    item may become the same one. ``words`` is the number of the item's words under windows with at least three
    words that are no placeholders, ``matched`` those of them that were found; a pair is
    returned from ``min_percent`` on. ``hash`` tells texts of equal ids apart.

    Null and empty texts hold nothing; items of fewer than five words, or without a window of
    three literal words, are never found; repeated items are found each under its id, repeated
    rows once per id and text; an empty table on either side gives an empty result. Other
    columns play no part.
    """
    items = benchmark.select(
        quoted(item).alias("item"), F.inline(template_windows(text_of(item_text)))
    ).where(F.col("slots").isNull() | (F.size("slots") <= WINDOW - LEAST_LITERAL)).distinct()
    items = written(items.select("item", F.col("pos").alias("place"), "key", F.col("slots").alias("given")), "items")
    sizes = items.groupBy("item").agg(_covered(F.collect_set("place")).alias("words"))
    if items.count() <= MAX_BROADCAST_WINDOWS:
        items = F.broadcast(items)
    body = text_of(text)
    windows = docs.select(
        quoted(key).alias("id"), F.xxhash64(body).alias("hash"), template_windows(body).alias("windows")
    ).select("id", "hash", F.inline_outer("windows"))  # unlike inline, not computed once more as a filter
    hits = windows.join(items, "key").select(
        "id", "hash", "item", "place", (F.col("pos") - F.col("place")).alias("shift"),
        F.coalesce(F.arrays_zip("given", "slots"), F.array().cast("array<struct<given:string,slots:string>>")).alias("pairs"),
    )
    aligned = hits.groupBy("id", "hash", "item", "shift").agg(F.collect_set(F.struct("place", "pairs")).alias("hits"))
    found = (
        aligned.select("id", "hash", "item", F.explode(_agreeing(F.col("hits"))).alias("place"))
        .groupBy("id", "hash", "item").agg(_covered(F.collect_set("place")).alias("matched"))
    )
    same = found["item"].eqNullSafe(sizes["item"])
    return found.join(sizes, same).where(F.col("matched") * 100 >= F.col("words") * min_percent).select(
        "id", "hash", found["item"], F.col("matched").cast("long"), F.col("words").cast("long")
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with the columns of ``docs``."""
    ids, hashes = fresh(docs.columns, "__id", "__hash")
    found = contaminated(docs, benchmark, key, text, **options).select("id", "hash").distinct().toDF(ids, hashes)
    return docs.join(
        found, quoted(key).eqNullSafe(F.col(ids)) & (F.xxhash64(text_of(text)) == F.col(hashes)), "left_anti"
    )


_UNITS_SQL = ", ".join(f"'{u}'" for u in UNITS)
#: Expects the documents in {docs}; gives c_found(doc_id, item_id, matched, words). Stricter than
#: the operator: it leaves out all windows of an alignment that does not map one to one.
FOUND_SQL = rf"""
c_tokens AS (
  SELECT side, id, regexp_extract_all(lower(regexp_replace(translate(coalesce(text, ''), chr(1), ' '),
      '{NAME_PATTERN}', '\1' || chr(1) || '\2', 'g')), '{TOKEN_PATTERN}') AS w
  FROM (SELECT 'd' AS side, doc_id AS id, text FROM {{docs}} UNION ALL SELECT 'b', item_id, text FROM benchmark)),
c_views AS (
  SELECT side, id,
    list_transform(w, lambda x: CASE WHEN x < '0' THEN '<name>' WHEN x < 'a' THEN '<number>'
                                     WHEN x IN ({_UNITS_SQL}) THEN '<unit>' ELSE x END) AS tokens,
    list_transform(w, lambda x: CASE WHEN x < 'a' OR x IN ({_UNITS_SQL}) THEN x END) AS slots
  FROM c_tokens
  UNION ALL
  SELECT side, id,
    list_transform(w, lambda x: CASE WHEN x >= '0' AND x < 'a' THEN '<number>'
                                     WHEN x IN ({_UNITS_SQL}) THEN '<unit>' ELSE ltrim(x, chr(1)) END),
    list_transform(w, lambda x: CASE WHEN (x >= '0' AND x < 'a') OR x IN ({_UNITS_SQL}) THEN x END)
  FROM c_tokens),
c_windows AS (
  SELECT DISTINCT side, id, i, tokens[i:i + {WINDOW - 1}] AS key,
    list_filter(slots[i:i + {WINDOW - 1}], lambda x: x IS NOT NULL) AS slots
  FROM (SELECT *, unnest(range(1, len(tokens) - {WINDOW - 2})) AS i FROM c_views WHERE len(tokens) >= {WINDOW})),
c_items AS (SELECT id, i, key, slots FROM c_windows WHERE side = 'b' AND len(slots) <= {WINDOW - LEAST_LITERAL}),
c_sizes AS (
  SELECT id, sum(step) AS words FROM (
    SELECT id, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY id ORDER BY i) - i, {WINDOW})) AS step
    FROM (SELECT DISTINCT id, i FROM c_items)) GROUP BY id),
c_hits AS (
  SELECT d.id AS doc_id, b.id AS item_id, b.i AS place, d.i - b.i AS shift, list_zip(b.slots, d.slots) AS pairs
  FROM c_windows d JOIN c_items b ON d.key = b.key WHERE d.side = 'd'),
c_aligned AS (
  SELECT doc_id, item_id, shift, list(DISTINCT place) AS places, list_distinct(flatten(list(pairs))) AS pairs
  FROM c_hits GROUP BY doc_id, item_id, shift),
c_places AS (
  SELECT DISTINCT doc_id, item_id, unnest(places) AS place FROM c_aligned
  WHERE len(list_distinct(list_transform(pairs, lambda p: p[1]))) = len(pairs)
    AND len(list_distinct(list_transform(pairs, lambda p: p[2]))) = len(pairs)),
c_found AS (
  SELECT doc_id, item_id, matched::BIGINT AS matched, words::BIGINT AS words FROM (
    SELECT doc_id, item_id, sum(step) AS matched FROM (
      SELECT doc_id, item_id, least({WINDOW}, coalesce(
        lead(place) OVER (PARTITION BY doc_id, item_id ORDER BY place) - place, {WINDOW})) AS step FROM c_places)
    GROUP BY doc_id, item_id) JOIN c_sizes ON id = item_id
  WHERE matched * 100 >= words * {MIN_PERCENT})"""

OP1_SQL = f"""WITH {FOUND_SQL.replace("{docs}", "documents")}
SELECT doc_id, item_id, matched, words, matched::DOUBLE / words AS score FROM c_found"""


@query("op1_benchmark_decontamination", OP1_SQL)
def op1_benchmark_decontamination(spark, sf_dir):
    """Every document that holds a benchmark item, with the item and how much of it."""
    found = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "matched", "words",
        (F.col("matched") / F.col("words")).alias("score"),
    )

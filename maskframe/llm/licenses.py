"""License scans by a positional index of licence words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskframe.functions.text import quoted
from maskframe.llm.frames import ascii_lower, let, table, text_of, written
from maskframe.llm.registry import query

WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that name a family of licences wherever they stand, and its label.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices as they are usually worded: label, text, and the phrase that must stand in place.
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
     "associated documentation files", "permission is hereby granted free of charge"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
     "general public license as published by the free software foundation", "gnu general public license as published"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd 4 0"),
    ("cc0-1.0", "licensed under cc0 1 0 universal", "cc0 1 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
     "that the following conditions are met", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
     "hereby granted", "permission to use copy modify and or distribute this software"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "free and unencumbered software"),
)
#: Words of the notices too common in any text to be looked up.
COMMON = frozenset(
    "a an and any are as by can copy for free in into is it of or person person's that the this to under use with "
    "without you 0 1 2 3 4 v".split()
)
#: So many of a text's rarest licence words the statement looks up; the operator has no such limit.
TOP_WORDS = 12
#: A notice is found when so many percent of the places looked up agree on one position.
MIN_PERCENT = 60


def _split(text: str) -> list[str]:
    return text.split(" ")


#: word, number of the template, place of the word in it
POSTINGS = tuple(
    (word, t, place)
    for t, (_, text, _) in enumerate(TEMPLATES) for place, word in enumerate(_split(text)) if word not in COMMON
)
VOCABULARY = sorted({word for word, _, _ in POSTINGS})
#: Place of the mandatory phrase in each template.
PHRASE_PLACES = tuple(
    next(i for i in range(len(_split(text))) if _split(text)[i:i + len(_split(phrase))] == _split(phrase))
    for _, text, phrase in TEMPLATES
)


def _places(words: Column, phrase: str) -> Column:
    """Where the words of ``phrase`` stand consecutively, as an array of starts."""
    parts = _split(phrase)
    starts = F.array_compact(F.transform(words, lambda x, i: F.when(x == parts[0], i)))
    rest = [lambda i, k=k, w=w: F.get(words, i + k) == w for k, w in enumerate(parts[1:], 1)]

    def whole(i: Column) -> Column:
        return reduce(lambda a, b: a & b, [r(i) for r in rest], F.lit(True))

    return F.filter(starts, whole)


def _scan(words: Column) -> Column:
    """What one text has: base places by label, licence words with places, mandatory phrases.

    Only texts with a licence word are searched for phrases.
    """
    phrases = sorted({*BASE, *(p for _, _, p in TEMPLATES)})
    none = F.array().cast("array<int>")
    seen = F.array_compact(
        F.transform(words, lambda x, i: F.when(x.isin(VOCABULARY), F.struct(x.alias("word"), i.alias("pos"))))
    )

    def found(rare: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            rare.alias("rare"),
            F.when(F.size(rare) > 0, F.array(*[
                F.struct(F.lit(p).alias("phrase"), _places(words, p).alias("starts")) for p in phrases
            ])).otherwise(F.array(*[F.struct(F.lit(p).alias("phrase"), none.alias("starts")) for p in phrases]))
            .alias("phrases"),
        )

    return let(seen, found)


def rarest_first(looked: DataFrame, postings: DataFrame) -> DataFrame:
    """Template places to look up per text and template, those of the rarest words first.

    ``asked`` are all places whose word occurs in the text, ordered by the number of texts that
    hold the word; ``rarest`` the first of them, just so many that a notice on which enough places
    agree has at least one among them. Looking up no more loses no notice.
    """
    words = looked.select("doc", F.explode(F.array_distinct("rare.word")).alias("word"))
    holding = words.groupBy("word").agg(F.count(F.lit(1)).alias("texts"))  # the vocabulary at most
    asked = (
        words.join(postings, "word").join(F.broadcast(holding), "word")
        .groupBy("doc", "template").agg(F.array_sort(F.collect_list(F.struct("texts", "word", "place"))).alias("asked"))
    )
    enough = F.ceil(F.size("asked") * MIN_PERCENT / 100)
    return asked.withColumn("rarest", F.slice("asked", F.lit(1), (F.size("asked") - enough + 1).cast("int")))


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, hash and what licences its text names.

    ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` tell of the :data:`BASE`
    phrases: all places, the first and last of them (null without one), the distinct labels.
    ``labels`` adds those of :data:`TEMPLATES`: licence words are ranked by the number of texts that hold
    them, the rarest of each template are looked up in a text and propose relative positions, and a template is found
    where enough of all its places in the text agree on such a position and its mandatory phrase stands there. ``score``
    is the best share of agreeing places, zero without a found template. ``hash`` tells texts of equal ids apart.

    Words are runs of ASCII letters, digits and characters beyond ASCII, A to Z lower-cased.
    A null or empty text has no words and no labels; repeated rows come out as often as they
    come in; an empty table gives an empty one; other columns play no part. The index is a
    fixed table of a few hundred postings.
    """
    body = text_of(text)
    words = F.regexp_extract_all(ascii_lower(body), F.lit(WORD_PATTERN), F.lit(0))
    scanned = docs.select(quoted(key).alias("id"), F.xxhash64(body).alias("hash"), let(words, _scan).alias("s"))
    scanned = written(scanned.select("id", "hash", "s.*"), "licenses")

    spark = docs.sparkSession
    postings = F.broadcast(spark.createDataFrame([*POSTINGS], "word string, template int, place int"))
    needed = F.broadcast(spark.createDataFrame(
        [(t, label, phrase, at) for t, ((label, _, phrase), at) in enumerate(zip(TEMPLATES, PHRASE_PLACES, strict=True))],
        "template int, label string, phrase string, at int",
    ))
    # From here on one row per text: those with licence words are few, and equal rows agree.
    looked = scanned.where(F.size("rare") > 0).dropDuplicates(["id", "hash"]).select(
        F.struct("id", "hash").alias("doc"), "rare", "phrases"  # as a whole never null, though ids may be
    )
    places = looked.select("doc", F.inline("rare"))
    ranked = rarest_first(looked, postings)
    proposed = (
        ranked.select("doc", "template", F.inline("rarest")).join(places, ["doc", "word"])
        .select("doc", "template", (F.col("pos") - F.col("place")).alias("start")).distinct()
    )
    stands = (
        looked.select("doc", F.inline("phrases")).select("doc", "phrase", F.explode("starts").alias("begin"))
        .join(needed, "phrase").select("doc", "template", "label", (F.col("begin") - F.col("at")).alias("start"))
    )
    votes = (
        proposed.join(stands, ["doc", "template", "start"]).join(ranked, ["doc", "template"])
        .select("doc", "template", "label", "start", F.size("asked").alias("n"), F.inline("asked"))
        .withColumn("pos", F.col("start") + F.col("place")).join(places, ["doc", "word", "pos"])
        .groupBy("doc", "template", "label", "start", "n").agg(F.count(F.lit(1)).alias("votes"))
    )
    found = (
        votes.where(F.col("votes") * 100 >= F.col("n") * MIN_PERCENT)
        .groupBy("doc").agg(F.collect_set("label").alias("more"), F.max(F.col("votes") / F.col("n")).alias("best"))
        .select(F.col("doc.id").alias("of"), F.col("doc.hash").alias("of_hash"), "more", "best")
    )
    joined = scanned.join(found, scanned["id"].eqNullSafe(F.col("of")) & (scanned["hash"] == F.col("of_hash")), "left")
    starts = {phrase: _starts_of(phrase) for phrase in BASE}
    base = F.array_distinct(F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(BASE[p])) for p, c in starts.items()])))
    every = F.flatten(F.array(*starts.values()))
    return joined.select(
        "id", "hash", "n_words", F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("more", F.array().cast("array<string>")))), ",")
        .alias("labels"),
        F.coalesce("best", F.lit(0.0)).alias("score"),
    )


def _starts_of(phrase: str) -> Column:
    return F.get(F.filter("phrases", lambda x: x["phrase"] == phrase), F.lit(0))["starts"]


def _values(rows) -> str:
    def cell(x) -> str:
        return "[" + ", ".join(map(cell, x)) + "]" if isinstance(x, list) else f"'{x}'" if isinstance(x, str) else str(x)

    return ", ".join("(" + ", ".join(cell(x) for x in row) + ")" for row in rows)


OP2_SQL = rf"""WITH
postings(word, template, place) AS (VALUES {_values(POSTINGS)}),
needed(template, label, phrase, spot) AS (VALUES {_values(
    (t, label, _split(phrase), at) for t, ((label, _, phrase), at) in enumerate(zip(TEMPLATES, PHRASE_PLACES, strict=True)))}),
base(phrase, label) AS (VALUES {_values((_split(p), label) for p, label in BASE.items())}),
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{WORD_PATTERN}') AS w FROM documents),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words),
rare AS (SELECT doc_id, w[i] AS word, i - 1 AS pos FROM spots WHERE w[i] IN (SELECT word FROM postings)),
df AS (SELECT word, count(DISTINCT doc_id) AS df FROM rare GROUP BY word),
top AS (
  SELECT doc_id, word FROM (
    SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY df, word) AS r
    FROM (SELECT DISTINCT doc_id, word FROM rare) JOIN df USING (word)) WHERE r <= {TOP_WORDS}),
votes AS (
  SELECT doc_id, template, pos - place AS start, count(*) AS votes
  FROM rare JOIN top USING (doc_id, word) JOIN postings USING (word) GROUP BY ALL),
asked AS (SELECT doc_id, template, count(*) AS asked FROM top JOIN postings USING (word) GROUP BY ALL),
stands AS (
  SELECT doc_id, template, label, i - 1 - n.spot AS start FROM spots a JOIN needed n
    ON a.w[a.i] = n.phrase[1] AND a.w[a.i:a.i + len(n.phrase) - 1] = n.phrase),
found AS (
  SELECT doc_id, list(DISTINCT label) AS more, max(votes::DOUBLE / asked) AS best
  FROM votes JOIN stands USING (doc_id, template, start) JOIN asked USING (doc_id, template)
  WHERE votes * 100 >= asked * {MIN_PERCENT} GROUP BY doc_id),
places AS (
  SELECT doc_id, label, i - 1 AS pos FROM spots a JOIN base b
    ON a.w[a.i] = b.phrase[1] AND a.w[a.i:a.i + len(b.phrase) - 1] = b.phrase),
named AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels
  FROM places GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, array_to_string(list_sort(coalesce(n.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(n.labels, []), coalesce(more, [])))), ',') AS labels,
  coalesce(best, 0.0)::DOUBLE AS score
FROM words LEFT JOIN named n USING (doc_id) LEFT JOIN found USING (doc_id)"""


@query("op2_license_scan", OP2_SQL)
def op2_license_scan(spark, sf_dir):
    """Licence phrases, labels and score of every document."""
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumnRenamed("id", "doc_id").drop("hash")

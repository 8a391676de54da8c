import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from maskframe.llm.collocations import (
    collocations, cut_text, merged_stretch, phrase_counts, sorted_block, top_collocations,
)

SMALL = {"chunk_bytes": 600, "stretch_bytes": 500}


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n\x0b\x0c\r]", low)]


def counted(rows):
    out = {}
    for text, lang in rows:
        f = out.setdefault(lang if lang is not None else "und", Counter())
        for words in pieces(text):
            for i in range(len(words)):
                for m in range(1, 5):
                    if i + m <= len(words):
                        f[tuple(words[i:i + m])] += 1
    return out


def expected(rows, min_count, top=2000):
    out = []
    for lang, f in counted(rows).items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        candidates = {g: c for g, c in f.items() if 2 <= len(g) and c >= min_count}
        found = []
        for g, a in candidates.items():
            inside = any(
                len(h) > len(g) and 100 * c >= 80 * a and any(h[i:i + len(g)] == g for i in range(len(h)))
                for h, c in candidates.items()
            )
            if not inside:
                score, k = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
                found.append((" ".join(g), a, f[g[:k]], f[g[k:]], n, score))
        found.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(found[:top])]
    return sorted(out)


def rows_of(seed, texts):
    rnd = random.Random(seed)
    words = ["a", "b", "a\x01", "é", "C", "c", "ab", "b\x00", "\x7f", "zz"]
    ends = [" ", " ", " ", " ", "\t ", ". ", "\n", "!?", "\x0b"]
    return [
        ("".join(rnd.choice(words) + rnd.choice(ends) for _ in range(rnd.randrange(0, 60))), rnd.choice(["en", "de", None]))
        for _ in range(texts)
    ]


@pytest.mark.parametrize("options", [{}, SMALL])
def test_like_brute_force(spark, options):
    rows = [*rows_of(1, 120), (None, "en"), ("", None), *[("new york city hall", "en")] * 7]
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = top_collocations(docs, min_count=5, **options)
    assert sorted(tuple(r) for r in got.collect()) == expected(rows, 5)


def test_counts_do_not_depend_on_the_cuts(spark):
    rows = rows_of(2, 150) + [("the the the the the " * 40, "en")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(7)
    want = {
        (lang, " ".join(g), len(g), c) for lang, f in counted(rows).items() for g, c in f.items() if c >= 4
    }
    for options in ({}, SMALL, {"chunk_bytes": 40, "stretch_bytes": 100}):
        got = {tuple(r) for r in phrase_counts(docs, min_count=4, **options).where("length > 0").collect()}
        assert got == want


def test_parts_of_a_long_text_hold_every_window_once():
    rnd = random.Random(3)
    body = b"".join(rnd.choice([b"a", b"bb", b"x" * 90]) + rnd.choice([b" ", b"  ", b" ", b"\n"]) for _ in range(400)) + b"end" * 50
    for size in (10, 50, 1000):
        parts = list(cut_text(body, size))
        assert len(parts) > 1
        blocks = [b for _, _, b in sorted_block(parts, [b"a", b"bb bb"])]
        whole = [b for _, _, b in sorted_block([(body, b"")], [])]
        assert [p.to_pylist() for p, *_ in merged_stretch(blocks, 1)[0]] == [p.to_pylist() for p, *_ in merged_stretch(whole, 1)[0]]
        assert merged_stretch(blocks, 1)[1] == merged_stretch(whole, 1)[1] == len(body.split())


def test_odd_tables(edge_docs, no_docs, edge_rows):
    rows = [(r[1], r[2]) for r in edge_rows]
    got = [tuple(r) for r in top_collocations(edge_docs).collect()]
    assert sorted(got) == expected(rows, 30)
    assert top_collocations(no_docs).count() == 0
    assert collocations(edge_docs.where("text IS NULL")).count() == 0


def test_only_the_first_of_a_language(spark):
    docs = spark.createDataFrame([(f"a{i % 9} b{i % 9}. ", "en") for i in range(360)], "text string, lang string")
    got = top_collocations(docs, top=4).orderBy("rank").collect()
    assert [(r["rank"], r["phrase"]) for r in got] == [(i + 1, f"a{i} b{i}") for i in range(4)]


def test_no_hash_join_in_the_merges(spark):
    docs = spark.createDataFrame([("x y. " * 40, "en")], "text string, lang string")
    plan = collocations(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
    assert collocations(docs).select(F.sum("a")).first()[0] == 40

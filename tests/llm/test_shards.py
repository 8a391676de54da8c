import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskframe.llm.shards import LARGE, assign_shards, differencing, divide_groups, op13_kk_shards, write_shards


def plain(sizes, shards):
    """The same rule with lists of members: combine the two largest spreads, oppositely ordered."""
    parts = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        parts.append([(sizes[i], [i])] + [(0, [])] * (shards - 1))
    number = list(range(len(parts)))
    while len(parts) > 1:
        order = sorted(range(len(parts)), key=lambda p: (-(parts[p][0][0] - parts[p][-1][0]), number[p]))
        a, b = parts[order[0]], parts[order[1]]
        joined = [(x + y, m + n) for (x, m), (y, n) in zip(a, reversed(b), strict=True)]
        joined.sort(key=lambda s: -s[0])
        gone = set(order[:2])
        number = [n for i, n in enumerate(number) if i not in gone] + [max(number) + 1]
        parts = [p for i, p in enumerate(parts) if i not in gone] + [joined]
    out = [0] * len(sizes)
    for shard, (_, members) in enumerate(parts[0] if parts else []):
        for m in members:
            out[m] = shard
    return out


def loads(sizes, placed, shards):
    return np.bincount(placed, weights=sizes, minlength=shards)


@pytest.mark.parametrize("shards", [2, 3, 24])
def test_like_the_plain_rule(shards):
    rnd = random.Random(shards)
    for n in (0, 1, 5, 60, 300):
        sizes = [rnd.choice([8, rnd.randrange(8, 5000), rnd.randrange(8, 100)]) for _ in range(n)]
        assert differencing(sizes, shards).tolist() == plain(sizes, shards)


def test_near_the_optimum():
    rnd = random.Random(9)
    for _ in range(20):
        sizes = [rnd.randrange(1, 50) for _ in range(9)]
        got = loads(sizes, differencing(sizes, 2), 2)
        best = min(abs(sum(sizes) - 2 * sum(c)) for r in range(10) for c in itertools.combinations(sizes, r))
        assert abs(got[0] - got[1]) <= best + 12


def test_given_loads_are_evened_out():
    rnd = random.Random(5)
    sizes = [rnd.randrange(8, 900) for _ in range(4000)]
    given = np.array([200_000, 0, 50_000, 7])
    total = loads(sizes, differencing(sizes, 4, given), 4) + given
    assert total.max() - total.min() <= 8


def rows_of(seed, n):
    rnd = random.Random(seed)
    texts = [None, "", "copy " * 50, *["word " * rnd.randrange(1, 400) + str(i) for i in range(n)]]
    return [(i, rnd.choice(texts)) for i in range(2 * n)] + [(10_000 + i, "hot copy") for i in range(n)]


@pytest.mark.parametrize("groups_per_task", [16_384, 40])
def test_assignment(spark, groups_per_task):
    rows = rows_of(1, 500) + [(3, "twice"), (3, "twice"), (None, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = assign_shards(docs, groups_per_task=groups_per_task).toPandas()
    texts = {}
    assert sorted((-1 if np.isnan(k) else int(k), s, c) for k, s, c in zip(got.doc_id, got["size"], got.text_crc32, strict=True)) == sorted(
        (-1 if k is None else k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in rows
    )
    for digest, shard in zip(got.digest, got["shard"], strict=True):
        assert texts.setdefault(digest, shard) == shard
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
        assert part.sort_values("slot").doc_id.dropna().is_monotonic_increasing
    by_shard = got.groupby("shard")["size"].sum().reindex(range(24), fill_value=0)
    groups = got.groupby("digest")["size"].sum()
    small = groups[groups <= groups.sum() // (24 * LARGE)]
    assert by_shard.max() - by_shard.min() <= small.max()


def test_small_groups_fill_up_beside_a_large_one(spark):
    """One group has as much as three shards, another one and a half; the others share the rest."""
    groups = [("big", 3_000_000), ("half", 1_500_000)] + [(f"g{i:05d}", 900 + i % 257) for i in range(19_000)]
    placed = divide_groups(spark.createDataFrame(groups, "digest string, bytes long"), groups_per_task=500).toPandas()
    assert sorted(zip(placed["digest"], placed["bytes"], strict=True)) == sorted(groups)
    sizes = placed.groupby("shard")["bytes"].sum()
    others = sizes.sort_values()[:-2]
    assert sizes.max() == 3_000_000 and sizes.sort_values().iloc[-2] == 1_500_000
    assert others.max() - others.min() <= 1_200


def test_deterministic(spark):
    docs = spark.createDataFrame(rows_of(4, 200), "doc_id long, text string")
    a = sorted(map(tuple, assign_shards(docs.repartition(3), groups_per_task=50).collect()))
    b = sorted(map(tuple, assign_shards(docs.repartition(11), groups_per_task=50).collect()))
    assert a == b


def test_odd_tables(edge_docs, no_docs):
    got = assign_shards(edge_docs)
    assert got.count() == edge_docs.count()
    assert got.groupBy("shard").agg(F.max("slot").alias("m"), F.count("*").alias("n")).where("m <> n - 1").count() == 0
    assert assign_shards(no_docs).count() == 0


def test_other_groups_and_files(spark, tmp_path):
    rows = [(i, f"text {i}", f"site{i % 40}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = assign_shards(docs, shards=4, group=["source"]).join(docs.select("doc_id", "source"), "doc_id")
    assert got.groupBy("source").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() == 0
    write_shards(docs, str(tmp_path / "out"), shards=4, group=["source"])
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["doc_id"], r["text"], r["source"]) for r in back.collect()) == sorted(rows)
    assert {(r["source"], r["shard"]) for r in back.collect()} == {(r["source"], r["shard"]) for r in got.collect()}


def test_query(spark, sf):
    rows = op13_kk_shards(spark, sf)
    assert rows.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert dict(rows.dtypes)["shard"] == "int" and dict(rows.dtypes)["slot"] == "bigint"

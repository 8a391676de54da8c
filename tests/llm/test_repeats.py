import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import prose

from maskframe.llm import repeats


def plain(rows, length, keep_first=False):
    """Removed bytes, maximal runs and what is kept of every row, by looking up every string."""
    seen = {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    for i in order:
        data = (rows[i][1] or "").encode()
        for at in range(len(data) - length + 1):
            seen.setdefault(data[at:at + length], []).append((i, at))
    out = []
    for i, (key, text) in enumerate(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - length + 1):
            places = seen[data[at:at + length]]
            if len(places) > 1 and not (keep_first and places[0] == (i, at)):
                gone[at:at + length] = True
        runs = int((np.diff(np.append(0, gone.astype(np.int8))) == 1).sum())
        out.append((key, len(data), int(gone.sum()), runs, np.frombuffer(data, np.uint8)[~gone].tobytes()))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def removed(docs, **options):
    return [(r.id, r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in repeats.remove_repeats(docs, **options).collect()]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(6)
    passage, other = prose(rnd, 160), prose(rnd, 90)
    out = [(i, prose(rnd, rnd.randrange(150)) + passage[rnd.randrange(3):] + prose(rnd, 40)) for i in range(12)]
    out += [(20, other), (21, other + " x"), (22, "x " + other), (23, other + other), (24, "ab" * 700), (25, "é" * 900)]
    out += [(30, passage[:399]), (31, passage[:400]), (32, passage[1:401]), (33, ""), (34, None), (None, other)]
    out += [(i, passage[:300] + prose(rnd, 20) + passage[300:]) for i in range(40, 44)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS hash", "3 AS spans")


@pytest.mark.parametrize("group", [2000, 2])
def test_every_repeated_byte_goes(docs, rows, monkeypatch, group):
    monkeypatch.setattr(repeats, "MAX_GROUP", group)
    assert order(removed(docs)) == order(plain(rows, 400))


@pytest.mark.parametrize("group", [2000, 2])
def test_the_first_copy_can_stay(docs, rows, monkeypatch, group):
    monkeypatch.setattr(repeats, "MAX_GROUP", group)
    assert order(removed(docs, keep_first=True)) == order(plain(rows, 400, keep_first=True))


def test_other_lengths(docs, rows):
    assert order(removed(docs, length=150)) == order(plain(rows, 150))


def test_repeated_rows_repeat_each_other(spark):
    text = prose(random.Random(8), 200)
    docs = spark.createDataFrame([(1, text), (1, text), (2, "short"), (2, "short")], "doc_id long, text string")
    assert sorted(r[2] for r in removed(docs)) == [0, 0, len(text.encode()), len(text.encode())]


def test_odd_tables(edge_docs, edge_rows, no_docs):
    got = removed(edge_docs)
    small = [(k, t) for k, t, *_ in edge_rows]
    assert order(got) == order(plain(small, 400)) and removed(no_docs) == []


def test_pieces_of_a_long_text_give_the_same_blocks(monkeypatch):
    rnd = np.random.RandomState(1)
    data = rnd.randint(97, 105, 120_000).astype(np.uint8)
    data[90_000:92_000] = data[20_000:22_000]
    data[60_000:60_900] = 97
    whole = repeats.blocks(data, np.array([0, len(data)]), 400)
    monkeypatch.setattr(repeats, "_CHUNK", 5000)
    parts = [np.concatenate(c) for c in zip(*repeats._blocks_of_long(data, 400), strict=True)]
    assert sorted(zip(*[p.tolist() for p in parts], strict=True)) == sorted(zip(*[w.tolist() for w in whole[1:]], strict=True))


def test_previous_factors():
    rnd = np.random.RandomState(2)
    ranks, places = rnd.randint(0, 30, 200).astype(np.uint64), rnd.permutation(200)
    earlier, elsewhere = repeats.previous_factors(ranks, places)
    for i in range(200):
        same = places[(ranks == ranks[i])]
        assert earlier[i] == (same.min() < places[i]) and elsewhere[i] == (len(same) > 1)


@pytest.mark.parametrize("group", [2000, 2])
@pytest.mark.parametrize("keep_first", [False, True])
def test_dealing_out_frequent_keys_changes_nothing(docs, rows, monkeypatch, group, keep_first):
    for name, value in (("MAX_GROUP", group), ("OFTEN", 2), ("PARTS", 3)):
        monkeypatch.setattr(repeats, name, value)
    assert order(removed(docs, keep_first=keep_first)) == order(plain(rows, 400, keep_first))


def test_rows_of_a_frequent_key_meet_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "OFTEN", 100)
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        places = spark.range(4000).selectExpr(
            "if(id % 9 = 0, null, id) AS id", "id AS hash", "if(id < 3000, 5L, id div 2) AS rank", "int(id) AS first"
        )
        found = places.groupBy("rank").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
        met = repeats._joined(places, found, "rank").select("id", "hash", "rank", "first", "times")
        task = F.spark_partition_id().alias("task")
        tasks = [r.task for r in met.select(task, "rank").collect() if r["rank"] == 5]
        want = places.join(found, "rank").select("id", "hash", "rank", "first", "times")
        assert sorted(map(str, met.collect())) == sorted(map(str, want.collect())) and len(tasks) == 3000
        assert max(Counter(tasks).values()) < 600
        assert len({r.task for r in want.select(task, "rank").collect() if r["rank"] == 5}) == 1  # the plain join
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)

"""Shards of near equal size from indivisible groups, by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskframe.functions.text import quoted
from maskframe.llm.frames import fresh, table, text_of, written
from maskframe.llm.registry import query
from maskframe.operators.skew import key_join

SHARDS = 24
#: Bytes that a row costs besides its text.
ROW_BYTES = 8
#: Groups that one task divides.
GROUPS_PER_TASK = 16_384
#: A group of more than this share of a shard is placed before all others; there are at most
#: ``shards * LARGE`` of them.
LARGE = 64


def differencing(sizes: Sequence[int], shards: int, given: Sequence[int] | None = None) -> np.ndarray:
    """The shard of each size, by repeatedly combining the two partial partitions with the largest spread.

    A partial partition is a tuple of sums in falling order, a single size one with zeros
    besides. Combining adds the largest sum of one to the smallest of the other and so on. ``given``
    are sums that the shards have already: one more partial partition, which also tells which
    sum is which shard; without it the shards come in falling order of their sums. Equal spreads
    are taken in the order of the sizes, larger and earlier ones first.
    """
    n = len(sizes)
    order = sorted(range(n), key=lambda i: (-sizes[i], i))
    sums: dict[int, np.ndarray] = {}
    heap = []
    for node, i in enumerate(order):
        sums[node] = np.zeros(shards, np.int64)
        sums[node][0] = sizes[i]
        heap.append((-int(sizes[i]) if shards > 1 else 0, node))
    names = np.arange(shards)
    if given is not None:
        names = np.argsort(-np.asarray(given, np.int64), kind="stable")
        sums[n] = np.asarray(given, np.int64)[names]
        heap.append((int(sums[n][-1] - sums[n][0]), n))
    heapq.heapify(heap)
    merged: list[tuple[int, int, np.ndarray]] = []
    made = n + 1
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        total = sums.pop(a) + sums.pop(b)[::-1]
        places = np.argsort(-total, kind="stable")
        sums[made] = total[places]
        merged.append((a, b, places))
        heapq.heappush(heap, (int(sums[made][-1] - sums[made][0]), made))
        made += 1
    # From the whole partition back to its parts: which place of a part went where.
    place = {heap[0][1]: np.arange(shards)} if heap else {}
    for node in range(made - 1, n, -1):
        a, b, places = merged[node - n - 1]
        whole = place.pop(node)
        place[a], place[b] = np.empty(shards, np.int64), np.empty(shards, np.int64)
        place[a][places] = whole
        place[b][shards - 1 - places] = whole
    out = np.empty(n, np.int64)
    label = np.arange(shards)
    if given is not None:
        label = np.empty(shards, np.int64)
        label[place[n]] = names
    for node, i in enumerate(order):
        out[i] = label[place[node][0]]
    return out


def divide_groups(groups: DataFrame, shards: int = SHARDS, groups_per_task: int = GROUPS_PER_TASK) -> DataFrame:
    """``(digest, shard, bytes)`` for ``groups (digest, bytes)``, whose digests are distinct.

    Groups above a fixed share of a shard, of which there can be only a few, are divided first, by
    one task. The others are dealt into buckets of about ``groups_per_task``. Every bucket takes its part
    of what the large groups weigh as one more partial partition and differences it with its own
    groups, so that small groups even out the large ones everywhere. One bucket waits until the
    others are done and takes the sums they leave, which evens out their remainders. A group that
    is heavier than a shard's share fills a shard alone as far as the others allow.
    """
    kind = "digest string, shard int, bytes long"
    groups = written(groups.select("digest", "bytes"), "shard-groups")
    whole = groups.agg(F.sum("bytes").alias("bytes")).first()["bytes"] or 0
    bound = whole // (shards * LARGE)

    def divided(rows: pd.DataFrame, given: np.ndarray | None) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "digest"], ascending=[False, True], ignore_index=True)
        shard = differencing(rows["bytes"].tolist(), shards, given).astype("int32")
        return pd.DataFrame({"digest": rows["digest"], "shard": shard, "bytes": rows["bytes"]})

    def loads(placed: DataFrame) -> np.ndarray:
        out = np.zeros(shards, np.int64)
        for row in placed.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect():
            out[row["shard"]] = row["bytes"]
        return out

    few = groups.where(F.col("bytes") > bound).withColumn("bucket", F.lit(0)).groupBy("bucket")
    first = written(few.applyInPandas(lambda rows: divided(rows, None), kind), "shard-large")
    rest = groups.where(F.col("bytes") <= bound)
    buckets = max(1, -(-rest.count() // groups_per_task))
    dealt = rest.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int"))
    large = loads(first)
    small = max(1, whole - int(large.sum()))

    def share(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["bytes"].sum())
        # Turned by the bucket, so that ties among the shards do not always fall to the same one.
        turn = int(key[0]) % shards
        given = np.roll([int(x) * part // small for x in large], -turn)
        out = divided(rows, given)
        return out.assign(shard=((out["shard"] + turn) % shards).astype("int32"))

    most = written(dealt.where("bucket > 0").groupBy("bucket").applyInPandas(share, kind), "shard-buckets")
    so_far = large + loads(most)
    last = dealt.where("bucket = 0").groupBy("bucket").applyInPandas(lambda rows: divided(rows, so_far), kind)
    return first.unionByName(most).unionByName(written(last, "shard-last"))


def _group_digest(docs: DataFrame, text: str, group: Sequence[str]) -> Column:
    """128 bits of what must stay together: equal texts, or equal values of ``group``."""
    if not group:
        return F.md5(text_of(text).cast("binary"))
    return F.md5(F.to_json(F.struct(*[quoted(c).alias(f"g{i}") for i, c in enumerate(group)])).cast("binary"))


def assign_shards(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shards: int = SHARDS,
    group: Sequence[str] = (),
    groups_per_task: int = GROUPS_PER_TASK,
) -> DataFrame:
    """``(key, size, text_crc32, digest, shard, slot)`` for every row of ``docs``.

    Sizes are the UTF-8 bytes of the text, none for a null one, and 8. Rows with equal texts, or with
    equal values in the ``group`` columns, share a shard; the null text and the empty one are
    equal. Sizes of shards are as equal as whole groups allow. ``slot`` numbers the rows of a shard
    without gaps from 0, by key (nulls first); of rows equal in key and text any may come first.
    Repeated rows are rows of one group, an empty table gives an empty one, other columns play no
    part and may be called anything. A group may hold any share of the rows: it is one row
    while it is divided, and its rows are dealt out by key afterwards.
    """
    body = text_of(text)
    rows = written(
        docs.select(
            quoted(key).alias("key"), (F.octet_length(body) + F.lit(ROW_BYTES)).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"), _group_digest(docs, text, group).alias("digest"),
        ), "shard-rows",
    )
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    placed = divide_groups(groups, shards, groups_per_task).select(F.col("digest").alias("of"), "shard")
    joined = written(key_join(rows, placed, [("digest", "of")], "inner"), "shard-placed")
    # In the order of shards and keys, whatever the cuts between tasks: numbers that only grow within a task.
    ordered = written(
        joined.repartitionByRange("shard", "key", "digest").sortWithinPartitions("shard", "key", "digest")
        .withColumn("at", F.monotonically_increasing_id()), "shard-order",
    )
    task = F.shiftright("at", 33)
    counts = ordered.groupBy("shard", task.alias("task")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("least"))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("shard").alias("s"), F.col("task").alias("t"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least")).alias("shift")
    )
    return ordered.join(offsets, (F.col("shard") == F.col("s")) & (task == F.col("t"))).select(
        F.col("key").alias(key), "size", "text_crc32", "digest", "shard", (F.col("at") + F.col("shift")).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, path: str, text: str = "text", shards: int = SHARDS, group: Sequence[str] = (), tasks: int = 4) -> None:
    """All columns of ``docs`` below ``path``, a folder ``shard=<n>`` for each, by ``tasks`` writers each.

    Groups stay whole, sizes are balanced as by :func:`assign_shards`. A column of ``docs`` that
    is called ``shard`` would be lost, so it is refused.
    """
    if "shard" in (c.lower() for c in docs.columns):
        raise ValueError("docs has a column 'shard' already")
    name, of = fresh(docs.columns, "__digest", "__of")
    body = text_of(text)
    digest = docs.select("*", _group_digest(docs, text, group).alias(name))
    groups = digest.groupBy(name).agg(F.sum(F.octet_length(body) + F.lit(ROW_BYTES)).cast("long").alias("bytes"))
    placed = divide_groups(groups.select(F.col(name).alias("digest"), "bytes"), shards).select(F.col("digest").alias(of), "shard")
    joined = key_join(digest, placed, [(name, of)], "inner").drop(name)
    writer = F.pmod(F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(tasks))
    dealt = joined.withColumn(name, writer).repartition(shards * tasks, "shard", quoted(name)).drop(name)
    dealt.write.partitionBy("shard").parquet(path)


@query("op13_kk_shards")
def op13_kk_shards(spark, sf_dir):
    """Every document with its shard and its place there; equal texts stay together."""
    rows = assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

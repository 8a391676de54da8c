"""SimHash near-dedup by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskframe.functions.text import quoted
from maskframe.llm.components import components
from maskframe.llm.frames import fresh, table, text_of, written
from maskframe.llm.registry import query

BITS = 64
#: Fingerprints that differ in at most so many bits are linked.
MAX_DISTANCE = 3
SHINGLE = 3
SEED = 42
#: Shingles whose bits are summed at a time.
_BLOCK = 1 << 14


def fingerprint(text: bytes) -> int:
    """Signed 64-bit SimHash of the word shingles of one text; zero without words."""
    words = text.lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > SHINGLE:
        starts, ends = starts[: -SHINGLE + 1], ends[SHINGLE - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones, n, digest = np.zeros(BITS, np.int64), len(starts), xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        spans = zip(starts[at:at + _BLOCK].tolist(), ends[at:at + _BLOCK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, hash, fp)`` of every row; ``hash`` tells texts apart, a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([fingerprint(x.as_py()) for x in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values], names=["id", "hash", "fp"])

    body = text_of(text)
    rows = docs.select(quoted(key).cast("long").alias("id"), F.xxhash64(body).alias("hash"), body.cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, hash long, fp long")


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j set (a 64 x 64 matrix).

    Every task sends the 64 x 64 counts of its rows, whatever the number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            fps = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
            for at in range(0, len(fps), 1 << 16):
                part = fps[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
                bits = np.unpackbits(part, axis=1, bitorder="little").astype(np.float32)
                both += bits.T @ bits
                n += len(bits)
        cells = [pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(both.ravel(), n).astype(np.int64))]
        yield pa.RecordBatch.from_arrays(cells, names=["cell", "n"])

    rows = distinct.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect()
    cells = np.zeros(BITS * BITS + 1)
    for cell, n in rows:
        cells[cell] = n
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def _agreement(n: int, both: np.ndarray) -> np.ndarray:
    """Chance that two random fingerprints agree on bit i and on bit j."""
    one = np.diag(both) / n
    p11 = both / n
    p10, p01 = one[:, None] - p11, one[None, :] - p11
    return p11**2 + p10**2 + p01**2 + (1 - p11 - p10 - p01) ** 2


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt into equal parts, each filled with the bits that go together most."""
    one = np.diag(both) / n
    spread = np.sqrt(np.maximum(one * (1 - one), 1e-12))
    related = np.abs(both / n - np.outer(one, one)) / np.outer(spread, spread)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        take = len(left) // (parts - k)
        seed = max(left, key=lambda i: related[i, left].sum() - related[i, i])
        group = [seed]
        left.remove(seed)
        while len(group) < take:
            nearest = max(left, key=lambda i: related[i, group].mean())
            group.append(nearest)
            left.remove(nearest)
        groups.append(group)
    return groups


def within(agree: np.ndarray, bits: list[int], most: int) -> np.ndarray:
    """Chance that two random fingerprints differ in at most 0, 1, ... ``most`` of ``bits``.

    Each bit depends on the one before it, which carries the correlation inside a part.
    """
    first = bits[0]
    state = np.zeros((2, most + 2))  # agreed or not on the last bit; the distance, capped
    state[0, 0], state[1, 1] = agree[first, first], 1 - agree[first, first]
    for i, j in zip(bits, bits[1:], strict=False):
        a, b, ab = agree[i, i], agree[j, j], agree[i, j]
        joint = np.clip(np.array([[ab, a - ab], [b - ab, 1 - a - b + ab]]), 0, None)
        step = joint / np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)
        same = step[:, 0] @ state
        other = step[:, 1] @ state
        state = np.stack([same, np.concatenate([[0], other[:-2], [other[-2] + other[-1]]])])
    return np.cumsum(state.sum(axis=0))[: most + 1]


def variants(width: int, threshold: int) -> int:
    total, term = 1, 1
    for r in range(1, threshold + 1):
        term = term * (width - r + 1) // r
        total += term
    return total


def allot(n: int, both: np.ndarray, max_distance: int = MAX_DISTANCE) -> list[tuple[list[int], int]]:
    """Parts and their thresholds, at the least estimated number of probes and candidates.

    Two fingerprints within ``d`` bits differ in at most ``t`` bits of some part whenever the
    parts' ``t + 1`` add up to ``d + 1``. Dynamic programming shares these units out; a part
    with none is not probed at all.
    """
    agree, units = _agreement(n, both), max_distance + 1
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for parts in range(1, units + 1):
        groups = group_bits(n, both, parts)
        costs: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * units
        for bits in groups:
            chance = within(agree, bits, max_distance)
            price = [0.0] + [n * (1 + variants(len(bits), t)) + n * (n - 1) / 2 * chance[t] for t in range(units)]
            costs = [
                min((costs[u - v][0] + price[v], [*costs[u - v][1], v]) for v in range(u + 1))
                for u in range(units + 1)
            ]
        total, shares = costs[units]
        if best is None or total < best[0]:
            best = (total, [(g, v - 1) for g, v in zip(groups, shares, strict=True) if v])
    return best[1]


def _mask(bits: list[int]) -> int:
    return int(np.array([sum(1 << i for i in bits)], np.uint64).view(np.int64)[0])


def _flips(bits: list[int], threshold: int) -> list[int]:
    """Every way to flip at most ``threshold`` of ``bits``, as signed masks."""
    out, last = [0], [(0, -1)]
    for _ in range(threshold):
        last = [(m | 1 << bits[j], j) for m, i in last for j in range(i + 1, len(bits))]
        out += [m for m, _ in last]
    return np.array(out, np.uint64).view(np.int64).tolist()


def links(distinct: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``(a, b)``, a < b: the pairs of different fingerprints within ``max_distance`` bits.

    ``distinct`` holds every fingerprint once, in ``fp``. Probes meet the index on a part's
    bits, and the join itself keeps only pairs that are near enough; a pair met by way of
    several parts is returned once.
    """
    n, both = bit_statistics(distinct)
    if n < 2:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    plan = allot(n, both, max_distance)

    def probes(part: int, bits: list[int], flips: list[int]) -> Column:
        own = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        return F.transform(
            F.array(*[F.lit(x) for x in flips]),
            lambda x: F.struct(F.lit(part).alias("part"), own.bitwiseXOR(x).cast("long").alias("key")),
        )

    def keys(flips: list[list[int]]) -> Column:
        parts = [probes(k, bits, flips[k]) for k, (bits, _) in enumerate(plan)]
        return F.explode(F.concat(*parts)).alias("at")

    probe = distinct.select(F.col("fp").alias("a"), keys([_flips(bits, t) for bits, t in plan]))
    index = distinct.select(F.col("fp").alias("b"), keys([[0] for _ in plan]))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance
    met = probe.select("a", "at.part", "at.key").join(
        index.select("b", F.col("at.part").alias("part_b"), F.col("at.key").alias("key_b")),
        (F.col("part") == F.col("part_b")) & (F.col("key") == F.col("key_b")) & (F.col("a") < F.col("b")) & near,
    )
    return met.select("a", "b").distinct()


def _classes(docs: DataFrame, key: str, text: str, max_distance: int) -> tuple[DataFrame, DataFrame]:
    """The rows ``(id, hash, fp)``, and ``(fp, least, n, label)`` of every fingerprint.

    ``least`` is the first (null flag, id, hash) of the fingerprint's ``n`` rows, ``label`` the
    least fingerprint of its component.
    """
    rows = written(fingerprints(docs, key, text), "simhash")
    first = F.struct(F.col("id").isNull().alias("missing"), F.col("id"), F.col("hash"))
    distinct = written(rows.groupBy("fp").agg(F.min(first).alias("least"), F.count(F.lit(1)).alias("n")), "simhash")
    found = components(links(distinct, max_distance))
    labelled = distinct.join(found, distinct["fp"] == found["node"], "left")
    return rows, labelled.select("fp", "least", "n", F.coalesce("label", "fp").alias("label"))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", max_distance: int = MAX_DISTANCE
) -> DataFrame:
    """``(id, fp, component)`` for every row of ``docs``.

    ``component`` is the smallest id reachable over fingerprints that differ in at most
    ``max_distance`` bits; rows with equal fingerprints are always together. Texts without
    words (null, empty, white space) have fingerprint zero and are linked like any other.
    A null id keeps its row and its links; it names a component only if there is no other id.
    Repeated rows are returned as often as they come; an empty table gives an empty one.
    Other columns of ``docs`` play no part.
    """
    rows, labelled = _classes(docs, key, text, max_distance)
    heads = labelled.groupBy(F.col("label").alias("of")).agg(
        F.min("least")["id"].alias("component"), F.sum("n").alias("rows")
    )
    # Only fingerprints of several rows, or with links, can have another row's id.
    named = labelled.join(heads.where("rows > 1"), F.col("label") == F.col("of"))
    named = written(named.select(F.col("fp").alias("of"), "component"), "simhash")
    return rows.join(named, rows["fp"] == named["of"], "left").select(
        "id", "fp", F.coalesce("component", "id").alias("component")
    )


def keep_one(
    docs: DataFrame, key: str = "doc_id", text: str = "text", max_distance: int = MAX_DISTANCE
) -> DataFrame:
    """``docs`` with one row of each component of :func:`near_duplicates`: that of the smallest id.

    Rows with equal ids are told apart by their text, null ids come last, and of rows equal in
    id and text any one stays. The columns of ``docs`` and their names stay as they are.
    """
    rows, labelled = _classes(docs, key, text, max_distance)
    heads = written(labelled.groupBy("label").agg(F.min("least").alias("least")).select("least.id", "least.hash"), "simhash")
    ids, hashes = fresh(docs.columns, "__id", "__hash")
    same = quoted(key).cast("long").eqNullSafe(F.col(ids)) & (F.xxhash64(text_of(text)) == F.col(hashes))
    if rows.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return docs.join(heads.toDF(ids, hashes), same, "left_semi")
    kept = docs.join(heads.toDF(ids, hashes), same)
    return kept.dropDuplicates([ids, hashes]).select(*[quoted(c) for c in docs.columns])


@query("op5_simhash_near_dedup")
def op5_simhash_near_dedup(spark, sf_dir):
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )

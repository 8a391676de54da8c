"""Removal of repeated byte strings by longest-previous-factor arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskframe.functions.text import quoted
from maskframe.llm.frames import table, text_of, written
from maskframe.llm.registry import query

#: Strings of so many bytes are compared.
LENGTH = 400
#: Bytes of the grams that choose an anchor in each string.
GRAM = 32
#: String starts that share an anchor are taken together in blocks of so many.
STEP = 128
#: Blocks with one core are compared in one task up to this many different ones; the starts of
#: a core with more are compared by a shuffle of their own.
MAX_GROUP = 2_000
#: Rows of a key that stands more often than this are dealt over several tasks where they are joined,
#: over as many parts as the second number.
OFTEN, PARTS = 4_000, 512
#: Bytes of text worked on at a time.
_CHUNK = 1 << 20
#: Bits of the filter that tells texts that have to be looked at from others: 1 MB.
_FILTER_BITS = 1 << 23

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_INDEX_BITS = 24


class _Powers:
    """Powers of the hash base and of its inverse, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                grown = np.full(size, base, np.uint64)
                grown[0] = 1
                setattr(self, name, np.multiply.accumulate(grown))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a hash over all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _Hashes:
    """Hashes of any stretch of a byte buffer, from sums of its bytes times powers modulo 2**64."""

    def __init__(self, data: np.ndarray):
        up, self.down = _POWERS.get(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of ``width`` values, in a constant number of passes."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    table_ = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(table_, axis=1).ravel()
    backward = np.minimum.accumulate(table_[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1:width - 1 + n])


def blocks(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Blocks of string starts in texts laid end to end: text, core, wide, first start, count.

    The anchor of a string is its leftmost gram of least hash, so equal strings have equal
    anchors in equal places. Starts are taken together by anchor and by their distance to it in
    steps of :data:`STEP`; a block's ``core`` hashes the bytes that its strings have in common,
    ``wide`` all bytes that they cover and how the ends of the text cut the block. Equal wide
    blocks hold equal strings throughout, blocks of different cores hold none in common.
    """
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    hashes = _Hashes(data)
    at = np.arange(n - GRAM + 1)
    grams = hashes.of(at, at + GRAM)
    index = np.uint64((1 << _INDEX_BITS) - 1)
    ranked = (grams & ~index) | at.astype(np.uint64)
    anchor = (_least(ranked, length - GRAM + 1) & index).astype(np.int64)
    starts = np.arange(n - length + 1)
    text = np.searchsorted(offsets, starts, side="right") - 1
    whole = starts + length <= offsets[text + 1]
    starts, anchor, text = starts[whole], anchor[whole], text[whole]
    if not len(starts):
        return blocks(data[:0], offsets[:1], length)
    part = (anchor - starts) // STEP
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]) | (text[1:] != text[:-1])
    anchor, part, text = anchor[new], part[new], text[new]
    last = anchor - STEP * part
    first = np.maximum(last - STEP + 1, anchor - (length - GRAM))
    core = hashes.of(last, first + length) + part.astype(np.uint64)
    low = np.maximum(first, offsets[text])
    high = np.minimum(last, offsets[text + 1] - length)
    cut = ((low - first) * STEP + (last - high)).astype(np.uint64)
    wide = _mix(hashes.of(low, high + length) + cut * _BASE)
    return text, _mix(core), wide, low - offsets[text], high - low + 1


def _blocks_of(texts: pa.Array, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """:func:`blocks` of a column of texts, with row numbers in place of text numbers.

    Short texts are laid end to end, about :data:`_CHUNK` bytes at a time.
    """
    row, held, size = 0, [], 0
    for i, x in enumerate(texts):
        data = np.frombuffer(x.as_buffer(), np.uint8)
        if len(data) > _CHUNK:
            yield from ((np.full(len(core), i), core, *rest) for core, *rest in _blocks_of_long(data, length))
            data = data[:0]
        held.append(data)
        size += len(data)
        if size >= _CHUNK or i == len(texts) - 1:
            offsets = np.append(0, np.cumsum([len(p) for p in held])).astype(np.int64)
            text, *rest = blocks(np.concatenate(held), offsets, length)
            yield text + row, *rest
            row, held, size = i + 1, [], 0


def _blocks_of_long(data: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """:func:`blocks` of one text in pieces, each block from the piece that its first start is in.

    Pieces overlap by all that a block, its strings and their anchors can reach.
    """
    reach = 2 * length + STEP
    for begin in range(0, len(data), _CHUNK):
        low, high = max(0, begin - reach), min(len(data), begin + _CHUNK + reach)
        _, core, wide, first, n = blocks(data[low:high], np.array([0, high - low]), length)
        first = first + low
        own = (first >= begin) & (first < begin + _CHUNK)
        yield core[own], wide[own], first[own], n[own]


_ROW = "id long, hash long, core long, wide long, first int, n int"


def _all_blocks(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, core, wide, first, n in _blocks_of(batch.column(2), length):
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(core.view(np.int64)),
                     pa.array(wide.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["id", "hash", "core", "wide", "first", "n"],
                )

    return docs.mapInArrow(run, _ROW)


def previous_factors(ranks: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix whether a string of full length stands earlier, and whether elsewhere at all.

    ``ranks`` order suffixes by the string of full length that they begin with, ``places`` by
    where they stand. In suffix order, ties by place, the longest previous factor of a suffix
    reaches the full length exactly if the previous smaller place shares its rank, and that is
    the neighbour before it; the next smaller place is the neighbour's business behind it.
    """
    order = np.lexsort((places, ranks))
    # Blocks of one text may overlap; a place that was handed in twice is one suffix.
    once = np.ones(len(order), bool)
    once[1:] = (ranks[order][1:] != ranks[order][:-1]) | (places[order][1:] != places[order][:-1])
    order = order[once]
    alike = ranks[order][1:] == ranks[order][:-1]
    earlier, elsewhere = np.zeros(len(ranks), bool), np.zeros(len(ranks), bool)
    earlier[order[1:]] = alike
    elsewhere[order[1:]] = alike
    elsewhere[order[:-1]] |= alike
    return earlier, elsewhere


def _starts(contexts: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, offset in it and hash of every string of full length in the contexts."""
    sizes = np.array([x.as_buffer().size for x in contexts], np.int64)
    data = np.frombuffer(b"".join(x.as_py() for x in contexts), np.uint8)
    begins = np.cumsum(sizes) - sizes
    counts = sizes - length + 1
    context = np.repeat(np.arange(len(sizes)), counts)
    offset = np.arange(len(context)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = begins[context] + offset
    return context, offset, _Hashes(data).of(at, at + length)


def _runs(context: np.ndarray, offset: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of flagged starts: context, first offset, count."""
    context, offset = context[flag], offset[flag]
    new = np.ones(len(context), bool)
    new[1:] = (context[1:] != context[:-1]) | (offset[1:] != offset[:-1] + 1)
    first = np.flatnonzero(new)
    return context[first], offset[first], np.diff(np.append(first, len(context)))


_SPAN = "id long, hash long, first int, n int"


def _compare_groups(contexts: DataFrame, length: int, earlier_only: bool) -> DataFrame:
    """Spans of repeated starts among the contexts of one core, core by core."""

    def spans(rows: pa.Table) -> pa.RecordBatch:
        column = [pa.concat_arrays(c.chunks) for c in rows.columns]
        ids, hashes, cores, firsts, bodies = column
        context, offset, rank = _starts(bodies, length)
        # Contexts come sorted by core and text, so a running number orders the texts of a core.
        core, owner, text = cores.to_numpy(), ids.fill_null(0).to_numpy(), hashes.to_numpy()
        new = np.zeros(len(core), bool)
        new[1:] = (core[1:] != core[:-1]) | (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])
        number = np.cumsum(new) << 32
        places = number[context] + firsts.to_numpy()[context] + offset
        earlier, elsewhere = previous_factors(_mix(rank ^ core[context].view(np.uint64)), places)
        which, at, n = _runs(context, offset, earlier if earlier_only else elsewhere)
        take = pa.array(which)
        return pa.RecordBatch.from_arrays(
            [ids.take(take), hashes.take(take), pa.array((firsts.to_numpy()[which] + at).astype(np.int32)),
             pa.array(n.astype(np.int32))], names=["id", "hash", "first", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < _CHUNK:
                continue
            rows = pa.Table.from_batches(held)
            cores = rows.column(2).to_numpy()
            cut = int(np.searchsorted(cores, cores[-1]))  # the last core may go on in the next batch
            for at, end in _slices(cores[:cut]):
                yield spans(rows.slice(at, end - at))
            held = rows.slice(cut).to_batches()
            size = sum(b.nbytes for b in held)
        if held:
            rows = pa.Table.from_batches(held)
            for at, end in _slices(rows.column(2).to_numpy()):
                yield spans(rows.slice(at, end - at))

    ordered = contexts.repartition("core").sortWithinPartitions("core", F.col("id").isNull(), "id", "hash", "first")
    return ordered.select("id", "hash", "core", "first", "body").mapInArrow(run, _SPAN)


def _slices(cores: np.ndarray, most: int = MAX_GROUP) -> Iterator[tuple[int, int]]:
    """Whole cores, so many together that a slice has about ``most`` contexts."""
    begins = np.append(np.flatnonzero(np.append(True, cores[1:] != cores[:-1])), len(cores)) if len(cores) else [0]
    at = 0
    for begin in begins[1:]:
        if begin - at >= most:
            yield at, int(begin)
            at = int(begin)
    if at < len(cores):
        yield at, len(cores)


def _compare_starts(contexts: DataFrame, length: int, earlier_only: bool) -> DataFrame:
    """The same spans, start by start, for cores with too many contexts for one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, MAX_GROUP):
                part = batch.slice(low, MAX_GROUP)
                context, offset, rank = _starts(part.column(4), length)
                take = pa.array(context)
                core = part.column(2).to_numpy()[context].view(np.uint64)
                first = part.column(3).to_numpy()[context] + offset
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(first.astype(np.int32)),
                     pa.array(_mix(rank ^ core).view(np.int64))], names=["id", "hash", "first", "rank"],
                )

    rows = written(
        contexts.select("id", "hash", "core", "first", "body")
        .mapInArrow(run, "id long, hash long, first int, rank long").distinct(),  # blocks of one text may overlap
        "repeat-starts",
    )
    place = F.struct(F.col("id").isNull().alias("missing"), "id", "hash", "first")
    often = rows.groupBy("rank").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("least"))
    met = _joined(rows, written(often.where("times > 1"), "repeat-starts"), "rank")
    if earlier_only:
        met = met.where(place != F.col("least"))
    return met.select("id", "hash", "first", F.lit(1).alias("n"))


def _marked(base: DataFrame, keys: DataFrame, by: str = "hash") -> tuple[DataFrame, Column]:
    """``base`` with more columns, and whether the hash ``by`` of a row may be among those of ``keys``.

    The answer comes from a bitmap of fixed size, broadcast, and is the same for equal hashes.
    It grows fuller with the keys, never larger, and a full one only tells less.
    """
    slot = f"pmod({by}, {_FILTER_BITS}L)"
    marks = keys.selectExpr(f"shiftright({slot}, 6) AS word", f"shiftleft(1L, cast({slot} % 64 AS int)) AS bit")
    marks = marks.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    marked = base.join(F.broadcast(marks), F.expr(f"shiftright({slot}, 6)") == F.col("word"), "left")
    return marked, F.expr(f"coalesce(shiftright(bits, cast({slot} % 64 AS int)) & 1L, 0L) = 1L")


def _divided(base: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``base`` whose hash may be among those of ``keys``, and rows whose hash is not.

    This spares the texts that nothing is known of a shuffle.
    """
    marked, may_be = _marked(base, keys)
    columns = base.columns
    return marked.where(may_be).select(*columns), marked.where(~may_be).select(*columns)


def _joined(rows: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """Rows of places with what is found of their key, of which ``found`` has one row with its ``times``.

    Spark can split a large group only between the tasks that wrote it, and rows of one key
    shrink so much on disk that one task may read them all. So rows of keys that stand over
    :data:`OFTEN` times go to :data:`PARTS` parts by their place, and what is found of such a
    key to each of them.
    """
    by, often = f"xxhash64({', '.join(keys)})", found.where(F.col("times") > OFTEN)
    dealt, may_be = _marked(rows, often, by)
    part = F.when(may_be, F.pmod(F.xxhash64("id", "hash", "first"), F.lit(PARTS)).cast("int")).otherwise(0)
    dealt = dealt.select(*rows.columns, part.alias("part"))
    copied, may_be = _marked(found, often, by)
    parts = F.when(may_be, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    copied = copied.select(*found.columns, F.explode(parts).alias("part"))
    return dealt.join(copied, [*keys, "part"])


def _contexts(base: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``(id, hash, core, first, body)``: the bytes of the wanted blocks, cut from their texts."""
    per_text = wanted.groupBy(F.col("id").alias("of"), F.col("hash").alias("of_hash")).agg(
        F.collect_set(F.struct("core", "first", "n")).alias("wanted")
    )
    likely, _ = _divided(base, wanted)
    rows = likely.join(per_text, F.col("id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("of_hash")))
    cut = F.transform(
        "wanted",
        lambda w: F.struct(
            w["core"].alias("core"), w["first"].alias("first"),
            F.substring(F.col("text"), w["first"] + 1, w["n"] + (length - 1)).alias("body"),
        ),
    )
    # Rows that are equal in id and text hand in the same places, which count once.
    return rows.select("id", "hash", F.inline(cut))


def repeated_spans(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, keep_first: bool = False
) -> DataFrame:
    """``(id, hash, text, spans)`` for every row: its bytes and where strings start that are repeated.

    ``spans`` are pairs ``(first, n)``: the ``length`` bytes from each of the ``n`` starts on
    stand somewhere else as well, in the same text or another; with ``keep_first`` only those
    are listed that stand earlier, in the order of ids (nulls last), text hashes and places.
    Spans may overlap. Texts are compared as UTF-8 bytes and never across rows; a null text is
    empty; texts of fewer than ``length`` bytes have no spans; of rows equal in id and text
    each is a repetition of the other, but with ``keep_first`` they count as one. An empty table
    gives an empty one; other columns play no part.

    Only blocks of starts whose core stands twice go on. Starts in equal wide blocks are
    repeated without further ado; one block of each kind is compared with the others of its
    core start by start, in suffix order.
    """
    body = text_of(text)
    base = docs.select(
        quoted(key).cast("long").alias("id"), F.xxhash64(body).alias("hash"), body.cast("binary").alias("text")
    )
    every = written(_all_blocks(base, length), "repeat-blocks")
    cores = every.groupBy(F.col("core").alias("of")).agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    cores = written(cores.select("of"), "repeat-cores")
    alike = written(every.join(cores, F.col("core") == F.col("of"), "left_semi"), "repeat-alike")
    place = F.struct(F.col("id").isNull().alias("missing"), "id", "hash", "first", "n")
    kinds = written(
        alike.groupBy("core", "wide").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("least")), "repeat-kinds"
    )
    twice = _joined(alike, kinds.where("times > 1"), "core", "wide")
    if keep_first:
        twice = twice.where(place != F.col("least"))
    groups = written(
        kinds.groupBy("core").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "repeat-groups"
    )
    wanted = _joined(kinds.select("core", "least.*"), groups, "core").select(
        "id", "hash", "core", "first", "n", F.col("times").alias("kinds")
    )
    wanted = written(wanted, "repeat-wanted")
    some = wanted.where(F.col("kinds") <= MAX_GROUP)
    many = wanted.where(F.col("kinds") > MAX_GROUP)
    spans = twice.select("id", "hash", "first", "n").unionByName(
        _compare_groups(_contexts(base, some, length), length, keep_first)
    )
    if not many.isEmpty():
        spans = spans.unionByName(_compare_starts(_contexts(base, many, length), length, keep_first))
    spans = written(spans, "repeat-spans")
    per_text = spans.groupBy(F.col("id").alias("of"), F.col("hash").alias("of_hash")).agg(
        F.collect_list(F.struct("first", "n")).alias("spans")
    )
    likely, others = _divided(base, spans)
    with_spans = likely.join(
        per_text, F.col("id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("of_hash")), "left"
    ).select("id", "hash", "text", "spans")
    return with_spans.unionByName(others.withColumn("spans", F.lit(None).cast("array<struct<first:int,n:int>>")))


def _merged(first: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal stretches that the strings from the given starts cover."""
    order = np.argsort(first, kind="stable")
    begins, ends = first[order], (first + n - 1 + length)[order]
    reach = np.maximum.accumulate(ends)
    new = np.append(True, begins[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return begins[at], np.append(reach[at[1:] - 1], reach[-1])


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, keep_first: bool = False
) -> DataFrame:
    """``(id, n_bytes, n_removed, removed, kept)`` for every row of ``docs``.

    ``removed`` are the maximal stretches ``(start, end)`` of bytes in strings of ``length``
    bytes that :func:`repeated_spans` lists, ``kept`` the bytes outside of them, which need not
    be UTF-8 any more. What is said there of nulls, ties and repeated rows holds here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, stretches, kept = [], [], [], []
            for x, spans in zip(batch.column(1), batch.column(2), strict=True):
                body = x.as_py()
                parts, pairs, at, lost = [], [], 0, 0
                if spans.is_valid and len(spans.values):
                    values = spans.values
                    begins, ends = _merged(
                        values.field("first").to_numpy().astype(np.int64), values.field("n").to_numpy().astype(np.int64), length
                    )
                    for begin, end in zip(begins.tolist(), ends.tolist(), strict=True):
                        parts.append(body[at:begin])
                        pairs.append({"start": begin, "end": end})
                        lost += end - begin
                        at = end
                parts.append(body[at:])
                sizes.append(len(body))
                gone.append(lost)
                stretches.append(pairs)
                kept.append(b"".join(parts))
            pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(stretches, pair),
                 pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "removed", "kept"],
            )

    return repeated_spans(docs, key, text, length, keep_first).select("id", "text", "spans").mapInArrow(
        run, "id long, n_bytes long, n_removed long, removed array<struct<start:bigint,end:bigint>>, kept binary"
    )


@query("op10_repeated_strings")
def op10_repeated_strings(spark, sf_dir):
    """Every document less its repeated strings, as counts and a digest."""
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )

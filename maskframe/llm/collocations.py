"""Phrase collocations from count streams in prefix and suffix order.

Every word starts one window of four words. Tasks sort and count the windows of their texts, cut
the sorted lists at common boundaries and hand them on as compressed blocks. Whoever gets a
stretch of the order merges its blocks; phrases of every length are then runs of equal prefixes, so
one pass counts them all. The counted phrases are few. Sorted by their first words and by their last
words they are merged with the stream of the shorter phrases, which gives the counts to the left and
to the right of each cut and those of the extensions.
"""

from __future__ import annotations

import itertools
import re
import struct
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskframe.functions.text import quoted
from maskframe.llm.frames import table, text_of, written
from maskframe.llm.registry import query

#: Words in the longest phrase, and so in a window.
MAX_WORDS = 4
#: A phrase with fewer occurrences is no candidate.
MIN_COUNT = 30
#: A candidate is dropped for a longer one that has this share (of 100) of its occurrences.
ABSORBED = 80
#: Phrases a language reports.
TOP = 2000
#: Bytes of text that a task sorts at a time, and about as many as one stretch of the order holds.
CHUNK_BYTES = 6 << 20
STRETCH_BYTES = 6 << 20
#: Boundaries are taken from the windows of one text in so many, every so manieth of them.
SAMPLED_TEXTS = 64
SAMPLED_WINDOWS = 1024
#: The language of texts that have none.
NO_LANG = "und"

# A to Z become small; what ends a piece becomes a line feed, a tab a space.
_TABLE = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n "
)


def _tokens(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words in byte order, each token's place among them (from 1) and its line."""
    body = np.frombuffer(data, np.uint8)
    inside = (body != 32) & (body != 10)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    at = np.flatnonzero(starts)
    lines = np.cumsum(body == 10, dtype=np.int32)[at]
    letters = body[inside]
    offsets = np.append(np.flatnonzero(starts[inside]), len(letters)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(1, len(order) + 1)
    return coded.dictionary.take(order), rank[coded.indices.to_numpy()], lines


def _following(codes: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """For each token the four words from it on, as columns; zero beyond the end of its line."""
    out = np.zeros((MAX_WORDS, len(codes)), np.int64)
    out[0] = codes
    for k in range(1, min(MAX_WORDS, len(codes))):
        out[k, :-k] = np.where(lines[k:] == lines[:-k], codes[k:], 0)
    return out


def _runs(windows: np.ndarray, weights: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows in order and their summed weights."""
    base = words + 1
    left, right = windows[0] * base + windows[1], windows[2] * base + windows[3]
    order = np.lexsort((right, left))
    left, right = left[order], right[order]
    new = np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1]))
    at = np.flatnonzero(new)
    return windows[:, order[at]], np.add.reduceat(weights[order], at)


def _joined(vocabulary: pa.Array, windows: np.ndarray, end: bytes | None = None) -> pa.Array:
    """The windows as space-joined text, ``end`` after each."""
    columns = [vocabulary.take(pa.array(w - 1, mask=w == 0)) for w in windows]
    text = pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.binary()), null_handling="skip")
    if end is None:
        return text
    return pc.binary_join_element_wise(text, pa.scalar(b"", pa.binary()), pa.scalar(end, pa.binary()))


_WORD = re.compile(rb"[^ \n]+")


def cut_text(body: bytes, size: int) -> Iterator[tuple[bytes, bytes]]:
    """A translated text in parts of about ``size`` bytes, each with the words that follow it in its piece.

    Parts end at the end of a piece or, where a piece is longer, between two words; the part then
    goes on with up to three words of the next one, so that no window is cut short. Those
    words come second: they start windows of the next part, not of this one.
    """
    at = 0
    while len(body) - at > size:
        end = body.rfind(b"\n", at, at + size) + 1 or body.rfind(b" ", at, at + size) + 1
        if not end:  # one long word, which stays whole
            end = _WORD.match(body, at).end()
        extra = b""
        if body[end - 1:end] != b"\n":
            line = body.find(b"\n", end)
            words = itertools.islice(_WORD.finditer(body, end, len(body) if line < 0 else line), MAX_WORDS - 1)
            extra = b" ".join(w.group() for w in words)
        yield body[at:end] + b" " + extra, extra
        at = end
    yield body[at:], b""


def sorted_block(parts: list[tuple[bytes, bytes]], boundaries: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """``(stretch, windows, block)`` for the windows of translated texts, in order.

    ``parts`` are pairs as of :func:`cut_text`; windows of the second do not count. ``boundaries``
    are windows in order; a window belongs to the stretch numbered by the boundaries that are not
    greater. They are sorted along with the text's own windows, so they need no search.
    """
    extras = [extra for _, extra in parts if extra]
    body = b"\n".join([*boundaries, *extras, *(part for part, _ in parts)])
    vocabulary, codes, lines = _tokens(body)
    if not len(codes):
        return
    windows = _following(codes, lines)
    marks, own = lines < len(boundaries), lines >= len(boundaries) + len(extras)
    first = np.append(True, lines[1:] != lines[:-1])
    # Own windows weigh one, those of extra words less one; the heads of the boundary lines are counted in the upper half.
    use = ~marks | first
    weights = np.where(own, 1, np.where(marks, 1 << 40, -1))[use]
    distinct, sums = _runs(windows[:, use], weights, len(vocabulary))
    stretch, counts = np.cumsum(sums >> 40), sums & ((1 << 40) - 1)
    there = counts > 0
    distinct, stretch, counts = distinct[:, there], stretch[there], counts[there]
    if not len(counts):
        return
    text = _joined(vocabulary, distinct, b"\n")
    ends = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, 0)
    letters = memoryview(text.buffers()[2])
    cuts = np.append(np.flatnonzero(np.append(True, stretch[1:] != stretch[:-1])), len(stretch))
    packer = zstandard.ZstdCompressor(level=1)
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        block = struct.pack("<q", hi - lo) + counts[lo:hi].tobytes() + bytes(letters[ends[lo]:ends[hi]])
        yield int(stretch[lo]), hi - lo, packer.compress(block)


def merged_stretch(blocks: list[bytes], min_count: int) -> tuple[list[tuple[pa.Array, int, np.ndarray, np.ndarray]], int]:
    """Phrases counted by merging sorted blocks: ``(phrases, length, counts, at the edge)`` by length.

    Phrases whose run reaches an end of the stretch may go on beyond it; they are listed with
    whatever count they have here, others from ``min_count`` on. Second comes the number of words.
    """
    reader = zstandard.ZstdDecompressor()
    texts, weights = [], []
    for block in blocks:
        raw = reader.decompress(block)
        n = struct.unpack_from("<q", raw)[0]
        weights.append(np.frombuffer(raw, np.int64, n, 8))
        texts.append(raw[8 + 8 * n:])
    vocabulary, codes, lines = _tokens(b"".join(texts))
    del texts
    heads = np.append(True, lines[1:] != lines[:-1])
    windows, sums = _runs(_following(codes, lines)[:, heads], np.concatenate(weights), len(vocabulary))
    found = []
    new = np.zeros(windows.shape[1], bool)
    new[0] = True
    for length in range(1, MAX_WORDS + 1):
        new[1:] |= windows[length - 1, 1:] != windows[length - 1, :-1]
        at = np.flatnonzero(new)
        counts = np.add.reduceat(sums, at)
        edge = np.zeros(len(at), bool)
        edge[[0, -1]] = True
        keep = (windows[length - 1, at] > 0) & (edge | (counts >= min_count))
        chosen = windows[:, at[keep]].copy()
        chosen[length:] = 0
        found.append((_joined(vocabulary, chosen), length, counts[keep], edge[keep]))
    return found, int(sums.sum())


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(
        F.coalesce(quoted(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), text_of(text).cast("binary").alias("body")
    )


def _boundaries(texts: DataFrame, stretch_bytes: int) -> dict[str, list[bytes]]:
    """Windows that cut each language's order into stretches of about ``stretch_bytes`` of text.

    They come from the windows of a share of the texts, and only set where tasks begin and end.
    The driver gets a few windows for each stretch.
    """
    sizes = texts.groupBy("lang").agg(F.sum(F.octet_length("body")).alias("bytes")).where(F.col("bytes") > stretch_bytes)
    stretches = {r["lang"]: -(-r["bytes"] // stretch_bytes) for r in sizes.collect()}
    if not stretches:
        return {}

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                vocabulary, codes, lines = _tokens(body.as_py().translate(_TABLE))
                if len(codes):
                    start = len(codes) * 7919 % SAMPLED_WINDOWS  # not always the first words
                    some = _following(codes, lines)[:, start::SAMPLED_WINDOWS]
                    cut = _joined(vocabulary, some)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cut), pa.string()), cut], names=["lang", "cut"])

    large = F.col("lang").isin(*stretches)
    some = texts.where(large & (F.pmod(F.xxhash64("body", F.monotonically_increasing_id()), F.lit(SAMPLED_TEXTS)) == 0))
    order: dict[str, list[tuple[bytes, ...]]] = {}
    for row in some.mapInArrow(heads, "lang string, cut binary").toLocalIterator():
        order.setdefault(row["lang"], []).append(tuple(bytes(row["cut"]).split(b" ")))
    out = {}
    for name, n in stretches.items():
        cuts = sorted(order.get(name, []))
        picked = [cuts[len(cuts) * i // n] for i in range(1, n)] if cuts else []
        out[name] = [b" ".join(c) for c in sorted(set(picked))]
    return out


def _blocks(texts: DataFrame, boundaries: Mapping[str, list[bytes]], chunk_bytes: int) -> DataFrame:
    """``(lang, stretch, windows, block)``: the sorted windows of every task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[bytes, bytes]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                made = list(sorted_block(parts, boundaries.get(lang, [])))
                if made:
                    stretch, n, blocks = zip(*made, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(made), pa.string()), pa.array(stretch, pa.int32()),
                         pa.array(n, pa.int64()), pa.array(blocks, pa.binary())],
                        names=["lang", "stretch", "windows", "block"],
                    )
            held.clear()

        for batch in batches:
            for lang, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for part in cut_text(body.as_py().translate(_TABLE), chunk_bytes):
                    held.setdefault(lang, []).append(part)
                    size += len(part[0])
                    if size >= chunk_bytes:
                        yield from flush()
                        size = 0
        yield from flush()

    return texts.mapInArrow(run, "lang string, stretch int, windows long, block binary")


def phrase_counts(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    min_count: int = MIN_COUNT,
    chunk_bytes: int = CHUNK_BYTES,
    stretch_bytes: int = STRETCH_BYTES,
) -> DataFrame:
    """``(lang, phrase, length, f)`` of all phrases of one to four words with ``min_count`` occurrences.

    A row of length zero with the empty phrase holds the number of all words of the language.
    ``chunk_bytes`` and ``stretch_bytes`` bound what a task holds; they never change results.
    A stretch holds windows in the order of their words, so a frequent first word spans several;
    the counts of phrases that reach over a boundary are added up afterwards.
    """
    texts = _texts(docs, text, lang)
    blocks = _blocks(texts, _boundaries(texts, stretch_bytes), chunk_bytes)

    def merge(key: tuple, batch: pa.Table) -> pa.Table:
        found, words = merged_stretch([b.as_py() for b in batch.column("block")], min_count)
        phrases = pa.concat_arrays([p for p, _, _, _ in found] + [pa.array([b""], pa.binary())])
        lengths = np.concatenate([np.full(len(p), n) for p, n, _, _ in found] + [[0]])
        counts = np.concatenate([c for _, _, c, _ in found] + [[words]])
        edges = np.concatenate([e for _, _, _, e in found] + [[True]])
        return pa.table({
            "lang": pa.array([key[0].as_py()] * len(phrases), pa.string()), "phrase": phrases.cast(pa.string()),
            "length": pa.array(lengths.astype(np.int32)), "f": pa.array(counts.astype(np.int64)),
            "edge": pa.array(edges.astype(bool)),
        })

    counted = written(
        blocks.groupBy("lang", "stretch").applyInArrow(merge, "lang string, phrase string, length int, f long, edge boolean"),
        "phrase-stretches",
    )
    across = counted.where("edge").groupBy("lang", "phrase", "length").agg(F.sum("f").alias("f"))
    inside = counted.where("NOT edge").select("lang", "phrase", "length", "f")
    return inside.unionByName(across.where((F.col("f") >= min_count) | (F.col("length") == 0)))


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, absorbed: int = ABSORBED, **sizes: int
) -> DataFrame:
    """``(lang, phrase, length, a, l, r, n, score)`` of the candidates that no longer one absorbs.

    Texts are cut at ``.,;:!?`` and line ends, words parted by spaces and tabs, A to Z compared as
    small letters. ``a`` counts the phrase, ``l`` and ``r`` its two parts at the cut with the
    lowest score (the leftmost of equals), ``n`` all words of the language; the score is
    ``floor(2000000 * a / (l + r))``, in decimals, so that no product overflows. A null text is
    empty, a null language ``und``; repeated rows count as often as they stand there; an empty
    table gives an empty one; other columns play no part.

    If a longer candidate holds a phrase often enough, so does the one that is a word longer
    and lies between; extensions by one word therefore decide.
    """
    counts = written(phrase_counts(docs, text, lang, min_count, **sizes), "phrase-counts")
    phrases = counts.where("length > 0")
    words = F.split("phrase", " ")
    # Prefix order and suffix order of the phrases that are longer than their extensions' base.
    longer = phrases.where("length > 2").withColumn("w", words)
    shorter = F.explode(F.array(F.slice("w", F.lit(1), F.col("length") - 1), F.slice("w", F.lit(2), F.col("length") - 1)))
    extended = (
        longer.select("lang", "f", shorter.alias("part")).select("lang", F.array_join("part", " ").alias("base"), "f")
        .groupBy("lang", "base").agg(F.max("f").alias("most"))
    )
    candidates = phrases.where("length > 1").select("lang", "phrase", "length", F.col("f").alias("a"))
    free = candidates.alias("c").join(
        extended.alias("e").hint("merge"),
        (F.col("c.lang") == F.col("e.lang")) & (F.col("c.phrase") == F.col("e.base")), "left",
    ).where(F.coalesce(F.col("most"), F.lit(0)).cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * absorbed).select(
        "c.lang", "c.phrase", "c.length", "c.a"
    )
    cuts = free.withColumn("w", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1))).select(
        "lang", "phrase", "length", "a", "k",
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("length") - F.col("k")), " ").alias("tail"),
    )
    left = phrases.select(F.col("lang").alias("l_lang"), F.col("phrase").alias("l_phrase"), F.col("f").alias("l"))
    right = phrases.select(F.col("lang").alias("r_lang"), F.col("phrase").alias("r_phrase"), F.col("f").alias("r"))
    scored = (
        cuts.join(left.hint("merge"), (F.col("lang") == F.col("l_lang")) & (F.col("head") == F.col("l_phrase")))
        .join(right.hint("merge"), (F.col("lang") == F.col("r_lang")) & (F.col("tail") == F.col("r_phrase")))
        .withColumn("score", F.expr(
            "(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))"
        ))
    )
    best = scored.groupBy("lang", "phrase", "length", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    totals = counts.where("length = 0").select(F.col("lang").alias("of"), F.col("f").alias("n"))
    return best.join(totals, F.col("lang") == F.col("of")).select(
        "lang", "phrase", "length", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
        F.col("cut.score").alias("score"),
    )


def top_collocations(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP, **options: int) -> DataFrame:
    """The ``top`` collocations of each language with their ``rank``: by score, count and bytes of the phrase."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = collocations(docs, text, lang, **options).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


OP12_SQL = f"""WITH pieces AS (
  SELECT lang, unnest(regexp_split_to_array(body, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM (
    SELECT coalesce(lang, '{NO_LANG}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
    FROM documents)),
worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded WHERE len(w) > 0),
grams AS (SELECT lang, w[i:i + m - 1] AS g FROM starts, (VALUES (1), (2), (3), (4)) v(m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY lang, g HAVING count(*) >= {MIN_COUNT}),
totals AS (SELECT lang, count(*) AS n FROM starts GROUP BY lang),
ext AS (
  SELECT lang, base, max(f) AS most FROM (
    SELECT lang, g[1:len(g) - 1] AS base, f FROM f WHERE len(g) > 2 UNION ALL
    SELECT lang, g[2:len(g)], f FROM f WHERE len(g) > 2 UNION ALL
    SELECT lang, g[1:2], f FROM f WHERE len(g) = 4 UNION ALL SELECT lang, g[2:3], f FROM f WHERE len(g) = 4 UNION ALL
    SELECT lang, g[3:4], f FROM f WHERE len(g) = 4) GROUP BY lang, base),
free AS (
  SELECT c.lang, c.g, c.f AS a FROM f c LEFT JOIN ext e ON c.lang = e.lang AND c.g = e.base
  WHERE len(c.g) > 1 AND coalesce(100 * e.most, 0) < {ABSORBED} * c.f),
cuts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM free),
scored AS (
  SELECT c.lang, c.g, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
  FROM cuts c JOIN f x ON c.lang = x.lang AND c.g[1:c.k] = x.g JOIN f y ON c.lang = y.lang AND c.g[c.k + 1:len(c.g)] = y.g),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
named AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM best),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase) ASC) AS rank FROM named)
SELECT r.lang, r.rank::BIGINT AS rank, r.phrase, r.a::BIGINT AS a, r.l::BIGINT AS l, r.r::BIGINT AS r, t.n::BIGINT AS n,
  r.score::BIGINT AS score
FROM ranked r JOIN totals t ON r.lang = t.lang WHERE r.rank <= {TOP}"""


@query("op12_phrase_collocations", OP12_SQL)
def op12_phrase_collocations(spark, sf_dir):
    """The first 2,000 collocations of every language of ``documents``."""
    return top_collocations(table(spark, sf_dir, "documents"))

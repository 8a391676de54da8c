"""Token counts by a longest-match automaton."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.functions.text import quoted
from maskframe.llm.bpe import VOCABULARY, read_ranks, vocabulary_bytes
from maskframe.llm.frames import table, text_of
from maskframe.llm.registry import query

#: Words kept before the younger of two generations becomes the older.
_MAX_WORDS = 1 << 18
_MAX_WORD = 64


class LongestMatch:
    """Number of pieces that greedy longest match cuts a word into, in one pass over its bytes.

    A trie holds the vocabulary. Where the path ``s`` of a node cannot go on, its failure link
    leads to the node of what remains of ``s`` after the pieces that greedy matching is by then
    certain to take off its front, and ``popped`` says how many these are. So a word is read
    once and its pieces are counted without being built. A byte that no piece starts with makes
    the word unknown; :meth:`count` then returns 1, as for an unknown token.
    """

    def __init__(self, pieces: list[bytes]):
        child: dict[int, int] = {}
        nodes, depth_order, whole = 1, [], set()
        for piece in pieces:
            node = 0
            for b in piece:
                after = child.get(node << 8 | b)
                if after is None:
                    after = child[node << 8 | b] = nodes
                    nodes += 1
                    depth_order.append((node, b, after))
                node = after
            if piece:
                whole.add(node)
        depth = [0] * nodes
        for parent, _, node in depth_order:
            depth[node] = depth[parent] + 1
        fail, popped = [-1] * nodes, [0] * nodes
        for parent, b, node in sorted(depth_order, key=lambda e: depth[e[2]]):
            if node in whole:
                fail[node], popped[node] = 0, 1
                continue
            at, taken = fail[parent], popped[parent]
            while at >= 0 and (at << 8 | b) not in child:
                taken += popped[at]
                at = fail[at]
            if at >= 0:
                fail[node], popped[node] = child[at << 8 | b], taken
        self.child, self.fail, self.popped = child, fail, popped

    def count(self, word: bytes) -> int:
        child, fail, popped = self.child, self.fail, self.popped
        node = total = 0
        for b in word:
            while (after := child.get(node << 8 | b)) is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = after
        while node > 0:
            total += popped[node]
            node = fail[node]
        return total if node == 0 else 1


class _Counts(dict):
    """Counts of the words seen lately: a bounded cache of two generations."""

    def __init__(self, automaton: LongestMatch, prefix: bytes):
        super().__init__()
        self.automaton, self.prefix, self.older = automaton, prefix, {}

    def __missing__(self, word: bytes) -> int:
        n = self.older.get(word)
        if n is None:
            n = self.automaton.count(self.prefix + word)
        if len(word) <= _MAX_WORD:
            if len(self) >= _MAX_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = n
        return n


_COUNTERS: dict[tuple[str, bytes], _Counts] = {}


def _counter(content: bytes, prefix: bytes) -> _Counts:
    key = hashlib.sha256(content).hexdigest(), prefix
    if key not in _COUNTERS:
        _COUNTERS[key] = _Counts(LongestMatch(list(read_ranks(content))), prefix)
    return _COUNTERS[key]


def piece_counts(
    docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", prefix: bytes = b" "
) -> DataFrame:
    """``(id, n_words, n_pieces, longest)`` for every row of ``docs``.

    Words are parted by ASCII white space; each is cut, with ``prefix`` before it as in the
    vocabulary of the rank file ``path``, into the longest pieces from the left. ``longest``
    is the most pieces of any word. A null or empty text has no words and no pieces; repeated
    rows are counted each, other columns play no part, an empty table gives an empty one.
    Rows are independent, and memory is bounded by the vocabulary and the longest text.
    """
    content = docs.sparkSession.sparkContext.broadcast(
        vocabulary_bytes(path or public_tokenizers.path(VOCABULARY))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(content.value, prefix).__getitem__
        for batch in batches:
            words, pieces, longest = [], [], []
            for x in batch.column(1):
                numbers = list(map(count, x.as_py().split()))
                words.append(len(numbers))
                pieces.append(sum(numbers))
                longest.append(max(numbers, default=0))
            made = [pa.array(c, pa.int64()) for c in (words, pieces, longest)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["id", "n_words", "n_pieces", "longest"])

    rows = docs.select(quoted(key).cast("long").alias("id"), text_of(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, n_words long, n_pieces long, longest long")


@query("op6_token_counts")
def op6_token_counts(spark, sf_dir):
    """Words and greedy pieces of every document."""
    counted = piece_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select(F.col("id").alias("doc_id"), "n_words", "n_pieces", "longest")

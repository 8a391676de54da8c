"""Byte-level BPE: encoding by a lazily determinised transducer, decoding as a stream."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.llm.frames import fresh, table
from maskframe.llm.registry import query

VOCABULARY = "byte_bpe_50k.tiktoken"
#: States and words kept before a table is emptied, and the longest word kept.
_MAX_STATES = 1 << 18
_MAX_WORDS = 1 << 16
_MAX_WORD = 64
#: Longer texts are split, encoded and decoded a block of words at a time.
_LONG = 1 << 20
_BLOCK = 1 << 16


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: merge the adjacent pair of lowest rank, leftmost first, while there is one."""
    parts = [word[i:i + 1] for i in range(len(word))]
    none = len(ranks) + 1
    pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs and (best := min(pairs)) != none:
        i = pairs.index(best)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


class Transducer:
    """Reads bytes, writes token ids; equal to :func:`merge` on every word.

    A row of tokens is the encoding of its bytes exactly if each token encodes to itself and
    each two neighbours encode to themselves, because merges inside a pair do not depend on
    what stands outside it. That gives a non-deterministic transducer whose states are (last
    token, node of the vocabulary trie): on reaching a token that may follow the last one it
    guesses that the token ends there. It is determinised while it reads: a deterministic state
    is the row of states still possible, and a step writes the token that ends at the byte just
    read, of which there is one at most. Guesses that are not taken up again die within the
    longest token, so the tokens up to the last place that all live guesses go back to are
    settled; they are written out from time to time and at the end of the word.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.sizes = {r: len(t) for t, r in ranks.items()}
        self.child: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        self.depth = [0]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                after = self.child.get(node << 8 | b)
                if after is None:
                    after = self.child[node << 8 | b] = len(self.depth)
                    self.depth.append(self.depth[node] + 1)
                node = after
            self.token_at[node] = rank
        self.fits: dict[int, bool] = {}
        self._clear((0,))

    def _clear(self, *states: tuple[int, ...]) -> None:
        """Forget all steps; a guess is the number (last token + 1) << 32 | node."""
        self.states = list(states)
        self.number = {state: i for i, state in enumerate(states)}
        self.steps: dict[int, int] = {}  # state << 8 | byte: next state << 32 | written token + 1

    def _may_follow(self, last: int, token: int) -> bool:
        """Whether ``last`` and ``token`` stay apart and whole; ``last`` is -1 at the start."""
        key = (last + 1) << 32 | token
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= _MAX_STATES:
                self.fits.clear()
            before = self.tokens[last] if last >= 0 else b""
            wanted = [last, token] if last >= 0 else [token]
            known = self.fits[key] = merge(before + self.tokens[token], self.ranks) == wanted
        return known

    def _step(self, state: int, byte: int) -> int:
        found, written = [], -1
        for guess in self.states[state]:
            after = self.child.get((guess & 0xFFFFFFFF) << 8 | byte)
            if after is None:
                continue
            found.append(guess >> 32 << 32 | after)
            token = self.token_at.get(after)
            if token is not None and self._may_follow((guess >> 32) - 1, token):
                written = token
        if written >= 0:
            found.append((written + 1) << 32)
        key = tuple(found)
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
        made = self.steps[state << 8 | byte] = number << 32 | written + 1
        return made

    def _back(self, ends: list[int], at: int) -> list[int]:
        """The tokens up to place ``at``, last one first."""
        out = []
        while at:
            out.append(ends[at])
            at -= self.sizes[ends[at]]
        return out

    def encode(self, word: bytes) -> bytes:
        """Ids of one word as little-endian unsigned 32-bit integers."""
        whole = self.ranks.get(word)
        if whole is not None:
            return whole.to_bytes(4, "little")
        if len(self.states) > _MAX_STATES:
            self._clear((0,))
        state, settled = 0, []
        ends = [-1]  # the token that ends at each place since the last settled one
        for byte in word:
            step = self.steps.get(state << 8 | byte) or self._step(state, byte)
            state = step >> 32
            ends.append((step & 0xFFFFFFFF) - 1)
            if len(ends) > _BLOCK:
                state, ends = self._settle(state, ends, settled)
        return b"".join(settled) + _packed(self._back(ends, len(ends) - 1))

    def _settle(self, state: int, ends: list[int], settled: list[bytes]) -> tuple[int, list[int]]:
        """Write the tokens that all live guesses have in common; keep the places after them."""
        live, at = self.states[state], len(ends) - 1
        rows = [self._back(ends, at - self.depth[guess & 0xFFFFFFFF])[::-1] for guess in live]
        common = 0
        while common < min(map(len, rows)) and len({row[common] for row in rows}) == 1:
            common += 1
        tokens = rows[0][:common]
        settled.append(_packed(tokens[::-1]))
        if len(self.states) > _MAX_STATES:
            self._clear((0,), live)
            state = 1
        return state, [-1, *ends[1 + sum(self.sizes[t] for t in tokens):]]


def _packed(backwards: list[int]) -> bytes:
    return array("I", backwards[::-1]).tobytes()


class _Words(dict):
    """Ids of the words seen lately: a bounded cache of two generations before the transducer."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.transducer.encode(word.encode())
        if len(word) <= _MAX_WORD:
            if len(self) >= _MAX_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, content: bytes, pattern: str):
        ranks = read_ranks(content)
        self.pattern = regex.compile(pattern)
        self._ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    @cached_property
    def words(self) -> _Words:
        return _Words(Transducer(self._ranks))

    def encode(self, text: str) -> bytes:
        get = self.words.__getitem__
        if len(text) <= _LONG:
            return b"".join(map(get, self.pattern.findall(text)))
        found, out = (m.group() for m in self.pattern.finditer(text)), []
        while block := list(islice(found, _BLOCK)):
            out.append(b"".join(map(get, block)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        stream = Utf8Stream()
        return "".join(stream.feed(part) for part in self.parts(ids)) + stream.end()

    def parts(self, ids: bytes) -> Iterator[bytes]:
        numbers = np.frombuffer(ids, "<u4")
        for at in range(0, len(numbers), _BLOCK):
            yield b"".join(map(self.tokens.__getitem__, numbers[at:at + _BLOCK].tolist()))


class Utf8Stream:
    """Turns bytes that come in pieces into text, although tokens may cut a character.

    The state is the beginning of a character that is not complete yet, at most three bytes.
    Bytes that are no UTF-8 become replacement characters.
    """

    def __init__(self):
        self.open = b""

    def feed(self, piece: bytes) -> str:
        piece = self.open + piece
        keep = self._unfinished(piece[-3:])
        self.open = piece[len(piece) - keep:]
        return piece[:len(piece) - keep].decode("utf-8", "replace")

    @staticmethod
    def _unfinished(tail: bytes) -> int:
        """How many of the last bytes begin a character that needs more."""
        for back in range(1, len(tail) + 1):
            byte = tail[-back]
            if byte < 0x80:
                return 0
            if byte >= 0xC0:
                wanted = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4 if byte < 0xF8 else 1
                return back if back < wanted else 0
        return 0

    def end(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(content: bytes, pattern: str) -> Codec:
    """One codec per vocabulary and process."""
    key = hashlib.sha256(content).hexdigest(), pattern
    if key not in _CODECS:
        _CODECS[key] = Codec(content, pattern)
    return _CODECS[key]


def vocabulary_bytes(path: str) -> bytes:
    """The vocabulary file, read where the query is built and sent along with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def _mapped(df: DataFrame, column: str, out: str, kind: T.DataType, run) -> DataFrame:
    """``df`` with column ``out`` made from ``column`` batch by batch; see :func:`encode`."""
    if out in df.columns:
        raise ValueError(f"there is a column {out} already")
    schema = T.StructType([*df.schema.fields, T.StructField(out, kind)])
    at = df.columns.index(column)

    def batches(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            made = pa.array(run(batch.column(at)), pa.binary() if isinstance(kind, T.BinaryType) else pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, out])

    return df.mapInArrow(batches, schema)


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``docs`` with the binary column ``out``: ids as little-endian unsigned 32-bit integers.

    Each match of ``pattern`` is encoded by itself, without special tokens. A null text counts
    as empty and has no ids. Rows are independent: repeated rows, other columns and an empty
    table come through as they are; a column already called ``out`` is refused, choose another
    name. Memory is bounded by the longest text.
    """
    content = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(path))

    def run(column: pa.Array) -> list[bytes]:
        own = codec(content.value, pattern)
        return [own.encode(x.as_py() or "") for x in column]

    return _mapped(docs, text, out, T.BinaryType(), run)


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``encoded`` with the text column ``out``, decoded from ``ids``; null counts as no ids."""
    content = encoded.sparkSession.sparkContext.broadcast(vocabulary_bytes(path))

    def run(column: pa.Array) -> list[str]:
        own = codec(content.value, pattern)
        return [own.decode(x.as_py() or b"") for x in column]

    return _mapped(encoded, ids, out, T.StringType(), run)


def round_trip(
    docs: DataFrame, path: str, text: str = "text", pattern: str = public_tokenizers.PATTERN
) -> DataFrame:
    """``docs`` less ``text``, with ``ids`` as of :func:`encode` and ``decoded`` as of :func:`decode`.

    One pass does both, so that a task keeps the tables of one worker in memory, not of two.
    """
    content = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(path))
    kept = [f for f in docs.schema.fields if f.name != text]
    ids, decoded = fresh([f.name for f in kept], "ids", "decoded")
    schema = T.StructType([*kept, T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())])

    def batches(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(content.value, pattern)
        for batch in rows:
            encoded = [own.encode(x.as_py() or "") for x in batch.column(text)]
            made = [pa.array(encoded, pa.binary()), pa.array(map(own.decode, encoded), pa.string())]
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, *made], names=schema.names)

    return docs.mapInArrow(batches, schema)


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document the number and digest of its ids and the digest of what they decode to."""
    tripped = round_trip(docs.select("doc_id", "text"), path or public_tokenizers.path(VOCABULARY))
    return tripped.select(
        "doc_id", F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op4_byte_bpe")
def op4_byte_bpe(spark, sf_dir):
    """Ids of every document and the text that they decode to, as digests."""
    return token_digests(table(spark, sf_dir, "documents"))

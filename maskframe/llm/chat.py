"""Chat formatting by columnar byte assembly."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.functions.text import quoted
from maskframe.llm.frames import table
from maskframe.llm.registry import query

#: A turn is ``<s>role``, a line feed, its content and ``</s>``; a user's text stands in [INST] marks.
#: Inside texts and roles a control string gets a backslash after its first character, and one
#: that has backslashes there gets one more, so that taking one away gives the text back.
_ESCAPES = ((r"<(\\*)(/?s>)", "<"), (r"\[(\\*)(/?INST\])", "["))
LOSS_ROLE = "assistant"
_USER = "user"

_FORMATTED = "id long, formatted string, loss array<struct<start:bigint,end:bigint>>"


def _escaped(texts: pa.Array) -> pa.Array:
    for pattern, first in _ESCAPES:
        texts = pc.replace_substring_regex(texts, pattern, first + r"\\\1\2")
    return texts


def _unescaped(text: str) -> str:
    for pattern, first in _ESCAPES:
        text = re.sub(pattern.replace(r"(\\*)", r"\\(\\*)", 1), lambda m, first=first: first + m[1] + m[2], text)
    return text


def _escaped_role(roles: pa.Array) -> pa.Array:
    """Roles are one line each: a backslash is doubled and a line feed becomes \\n."""
    roles = pc.replace_substring(pc.replace_substring(_escaped(roles), "\\", "\\\\"), "\n", "\\n")
    return roles


def _unescaped_role(role: str) -> str:
    return _unescaped(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S))


def _copy(out: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, to: np.ndarray) -> None:
    """Scatter pieces of ``data`` to the places ``to`` of ``out``, all at once."""
    total = int(lengths.sum())
    if total:
        within = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[np.repeat(to, lengths) + within] = data[np.repeat(starts, lengths) + within]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a binary-like array with the starts and lengths of its values."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets[:-1], np.diff(offsets)


def assemble(ids: pa.Array, roles: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """Whole conversations, turns in order, as ``(id, formatted, loss)``.

    Headers, contents and footers get their lengths and cumulative offsets in numpy and are
    copied into one buffer, which becomes the text column. ``loss`` has byte offsets in it.
    """
    roles, texts = pc.fill_null(roles, ""), pc.fill_null(texts, "")
    kinds = roles.dictionary_encode()
    names = kinds.dictionary
    user, learn = pc.equal(names, _USER).to_numpy(zero_copy_only=False), pc.equal(names, LOSS_ROLE).to_numpy(zero_copy_only=False)
    plain = _escaped_role(names).to_pylist()
    heads = pa.array([f"<s>{r}\n" + ("[INST] " if u else "") for r, u in zip(plain, user, strict=True)], pa.string())
    feet = pa.array([(" [/INST]" if u else "") + "</s>" for u in user], pa.string())
    kind = kinds.indices.to_numpy()
    head_data, head_starts, head_sizes = _bytes_of(heads)
    foot_data, foot_starts, foot_sizes = _bytes_of(feet)
    text_data, text_starts, text_sizes = _bytes_of(_escaped(texts))

    sizes = np.stack([head_sizes[kind], text_sizes, foot_sizes[kind]], axis=1).ravel()
    ends = np.cumsum(sizes)
    begins = ends - sizes
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    _copy(out, head_data, head_starts[kind], sizes[0::3], begins[0::3])
    _copy(out, text_data, text_starts, sizes[1::3], begins[1::3])
    _copy(out, foot_data, foot_starts[kind], sizes[2::3], begins[2::3])

    number = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    new = np.ones(len(ids), bool)
    new[1:] = (number[1:] != number[:-1]) | (missing[1:] != missing[:-1])
    first = np.flatnonzero(new)
    offsets = np.append(begins[0::3][first], len(out)).astype(np.int64)
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())

    conversation = np.cumsum(new) - 1
    masked = np.flatnonzero(learn[kind]) if len(kind) else np.zeros(0, np.int64)
    base = offsets[conversation[masked]]
    spans = pa.StructArray.from_arrays(
        [pa.array(begins[1::3][masked] - base), pa.array(ends[1::3][masked] - base)], names=["start", "end"]
    )
    counts = np.bincount(conversation[masked], minlength=len(first))
    loss = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), spans)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), formatted, loss], names=["id", "formatted", "loss"])


#: Turns are assembled once so many bytes of text have come together.
_BLOCK_BYTES = 4 << 20


def format_conversations(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``(id, formatted, loss)``: every conversation as one text, with the spans to learn from.

    Turns are ordered by ``turn``, then role and text, so that ties and repeated rows have one
    order; nulls come first. A null role or text counts as empty, null ids are a conversation
    of their own. ``loss`` holds the byte ranges of the assistant's texts in ``formatted``. An
    empty table gives an empty one; other columns play no part.

    Turns are dealt by conversation and sorted; a task holds a few megabytes of turns, or one
    conversation if that is longer, since it becomes one value.
    """
    rows = turns.select(
        quoted(key).cast("long").alias("id"), quoted(turn).alias("turn"), quoted(role).cast("string").alias("role"),
        quoted(text).cast("string").alias("text"),
    )
    ordered = rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text").select("id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < _BLOCK_BYTES:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            ids = whole.column(0).combine_chunks()
            last = ids[-1].as_py()
            same = ids.is_null() if last is None else pc.fill_null(pc.equal(ids, last), False)
            cut = len(ids) - int(pc.sum(same).as_py())  # sorted: the open conversation comes last
            if cut:
                yield _of(whole.slice(0, cut))
                held = whole.slice(cut).to_batches()
                size = sum(b.nbytes for b in held)
        if held:
            yield _of(pa.Table.from_batches(held))

    def _of(whole: pa.Table) -> pa.RecordBatch:
        return assemble(*[pa.concat_arrays(c.chunks) for c in whole.columns])

    return ordered.mapInArrow(run, _FORMATTED)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns = []
    for part in formatted.split("</s>")[:-1]:
        role, _, content = part.removeprefix("<s>").partition("\n")
        role = _unescaped_role(role)
        if role == _USER:
            content = content.removeprefix("[INST] ").removesuffix(" [/INST]")
        turns.append((role, _unescaped(content)))
    return turns


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What the output of :func:`format_conversations` says, read back from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                text, data = text.as_py(), text.as_py().encode()
                turns = read_back(text)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                learnt = "".join(_unescaped(data[s["start"]:s["end"]].decode()) for s in spans.as_py())
                rows.append((
                    len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt),
                    hashlib.sha256(learnt.encode()).hexdigest(), len(text),
                ))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            columns = [pa.array(c) for c in zip(*rows, strict=True)] if rows else [
                pa.array([], pa.string() if n.endswith("256") else pa.int64()) for n in names[1:]
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return formatted.mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


@query("op7_chat_format")
def op7_chat_format(spark, sf_dir):
    """Every conversation, and one whose texts are control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame(
        [(-1, 0, _USER, said), (-1, 1, LOSS_ROLE, said)], "conv_id long, turn long, role string, text string"
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    )
    return conversation_digests(format_conversations(turns.unionByName(probe)))

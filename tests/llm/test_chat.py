import hashlib
import random

import pyarrow as pa
import pytest

from maskframe.llm import chat
from maskframe.llm.registry import QUERIES

PIECES = ["<s>", "</s>", "[INST] ", " [/INST]", "[INST]", "\\", "<", "s>", "\n", "a", "é😀", " ", "[/INST"]


def said(rnd):
    return "".join(rnd.choices(PIECES, k=rnd.randrange(8)))


def test_escapes_are_undone_and_leave_no_control_string():
    rnd = random.Random(1)
    for _ in range(2000):
        text = said(rnd)
        escaped = chat._escaped(pa.array([text]))[0].as_py()
        assert chat._unescaped(escaped) == text
        assert not any(c in escaped for c in ("<s>", "</s>", "[INST]", "[/INST]"))
    assert chat._escaped(pa.array(["plain < text [1]"]))[0].as_py() == "plain < text [1]"


@pytest.fixture(scope="module")
def turns():
    rnd, rows = random.Random(2), []
    for conv in [None, *range(40)]:
        for turn in range(rnd.randrange(1, 7)):
            role = rnd.choice(["user", "assistant", "system", None, "<s>odd\n\\role"])
            rows.append((conv, turn, role, rnd.choice([None, "", said(rnd)])))
    rows += [(50, 0, "user", "x" * 300_000), (50, 1, "assistant", "y" * 300_000)]
    rows += [(60, 1, "assistant", "b"), (60, 1, "assistant", "b"), (60, None, "assistant", "first"), (60, 1, "assistant", "a")]
    return rows


@pytest.mark.parametrize("block", [1, 200, 4 << 20])
def test_every_turn_is_read_back(spark, turns, monkeypatch, block):
    monkeypatch.setattr(chat, "_BLOCK_BYTES", block)
    frame = spark.createDataFrame(random.Random(3).sample(turns, len(turns)), "conv_id long, turn long, role string, text string")
    frame = frame.selectExpr("*", "1 AS id", "2 AS formatted", "3 AS loss")
    out = chat.format_conversations(frame).collect()
    none_first = lambda x: (x is not None, x)
    want = {}
    for conv, turn, role, text in sorted(turns, key=lambda r: (none_first(r[1]), none_first(r[2]), none_first(r[3]))):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert len(out) == len(want)
    for r in out:
        assert chat.read_back(r.formatted) == want[r.id]
        data = r.formatted.encode()
        learnt = [chat._unescaped(data[s.start:s.end].decode()) for s in r.loss]
        assert learnt == [t for role, t in want[r.id] if role == "assistant"]
    digests = {r.conv_id: r for r in chat.conversation_digests(chat.format_conversations(frame)).collect()}
    for conv, known in want.items():
        text = "".join(f"{r}\n{t}\n" for r, t in known)
        learnt = "".join(t for r, t in known if r == "assistant")
        assert digests[conv].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (digests[conv].n_turns, digests[conv].loss_chars) == (len(known), len(learnt))
        assert digests[conv].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()


def test_no_turns(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(none).count() == 0
    assert chat.conversation_digests(chat.format_conversations(none)).count() == 0


def test_the_query_has_the_control_conversation(spark, sf):
    rows = {r.conv_id: r for r in QUERIES["op7_chat_format"](spark, sf).collect()}
    given = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        given.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    given[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert set(rows) == set(given)
    for conv, known in given.items():
        text = "".join(f"{r}\n{t}\n" for r, t in known)
        assert rows[conv].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()

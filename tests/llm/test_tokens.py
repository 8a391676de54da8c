import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from maskframe.llm import bpe
from maskframe.llm.wordpiece import LongestMatch, piece_counts

PATH = public_tokenizers.path(bpe.VOCABULARY)
ALPHABET = "ab  \n\té😀中１٣'s'LL<|endoftext|>0123.,!?́​\x00\x1f "


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.codec(bpe.vocabulary_bytes(PATH), public_tokenizers.PATTERN)


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_encoding_equals_the_library(library, own):
    rnd = random.Random(1)
    for _ in range(800):
        text = "".join(rnd.choices(ALPHABET, k=rnd.randrange(60))) + rnd.choice("a-= é") * rnd.randrange(80)
        ids = own.encode(text)
        assert ids == packed(library.encode_ordinary(text)), text
        assert own.decode(ids) == text


def test_long_words_are_settled_in_blocks(own, monkeypatch):
    rnd, ranks = random.Random(2), own.words.transducer.ranks
    for block, states in ((8, 1 << 18), (50, 1 << 18), (20, 200)):
        monkeypatch.setattr(bpe, "_BLOCK", block)
        monkeypatch.setattr(bpe, "_MAX_STATES", states)
        transducer = bpe.Transducer(ranks)
        for _ in range(60):
            word = bytes(rnd.choices(b"abcdething ", k=rnd.randrange(1, 300)))
            assert transducer.encode(word) == packed([ranks[word]] if word in ranks else bpe.merge(word, ranks))


def test_long_texts_go_block_by_block(library, own, monkeypatch):
    monkeypatch.setattr(bpe, "_LONG", 10)
    monkeypatch.setattr(bpe, "_BLOCK", 7)
    text = "Längere Texte, 中文 und 😀😀 in Stücken. " * 9
    ids = own.encode(text)
    assert ids == packed(library.encode_ordinary(text)) and own.decode(ids) == text


def test_characters_cut_anywhere_are_put_together():
    data = "aé中😀z".encode() + b"\xff\xc3"
    for i in range(len(data)):
        for j in range(i, len(data)):
            stream = bpe.Utf8Stream()
            text = stream.feed(data[:i]) + stream.feed(data[i:j]) + stream.feed(data[j:]) + stream.end()
            assert text == "aé中😀z��"


def test_rows_of_odd_tables(edge_docs, edge_rows, no_docs, library):
    encoded = bpe.encode(edge_docs, PATH)
    assert encoded.columns == [*edge_docs.columns, "ids"]
    rows = bpe.decode(encoded, PATH).collect()
    assert len(rows) == len(edge_rows)
    for r in rows:
        assert r.ids == packed(library.encode_ordinary(r.text or "")) and r.decoded == (r.text or "")
    assert bpe.encode(no_docs, PATH).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(edge_docs, PATH, out="lang")


def greedy(word, pieces):
    n = at = 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if word[at:end] in pieces:
                break
        else:
            return 1
        at, n = end, n + 1
    return n


def test_longest_match_on_small_vocabularies():
    rnd = random.Random(4)
    for _ in range(300):
        pieces = [bytes(rnd.choices(b"ab", k=rnd.randrange(1, 6))) for _ in range(rnd.randrange(1, 9))]
        automaton = LongestMatch(pieces)
        for _ in range(30):
            word = bytes(rnd.choices(b"abc" if rnd.random() < 0.1 else b"ab", k=rnd.randrange(14)))
            assert automaton.count(word) == greedy(word, set(pieces))


def test_counts_of_odd_tables(edge_docs, edge_rows, no_docs):
    pieces = set(bpe.read_ranks(bpe.vocabulary_bytes(PATH)))
    cache = {}

    def count(word):
        if word not in cache:
            cache[word] = greedy(b" " + word, pieces)
        return cache[word]

    want = sorted(
        (k or -1, len(n), sum(n), max(n, default=0))
        for k, n in ((k, [count(w) for w in (t or "").encode().split()]) for k, t, *_ in edge_rows)
    )
    assert sorted((r.id or -1, r.n_words, r.n_pieces, r.longest) for r in piece_counts(edge_docs).collect()) == want
    assert piece_counts(no_docs).count() == 0

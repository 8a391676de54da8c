import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from maskframe.llm.spelling import LEVELS, near_words, one_edit, spelling_variants, word_counts


def runs(rows):
    n = Counter()
    for key, text in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    return n


def edits(word):
    alphabet = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
    for i in range(len(word) + 1):
        for c in alphabet:
            yield word[:i] + c + word[i:]
            if i < len(word):
                yield word[:i] + c + word[i + 1:]
        yield word[:i] + word[i + 1:]


def variants(words):
    forms, out = {}, {}
    for w, n in words.items():
        near = {x for x in edits(w) if x != w and x in words}
        best = min(near, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * n else None
        out[w] = len(near)
    rows = []
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.append((w, forms[w], root, n, out[w], words[forms[w]] if forms[w] else None))
    return sorted(rows)


def vocabulary(seed, size):
    rnd = random.Random(seed)
    words = {}
    while len(words) < size:
        base = "".join(rnd.choices("etaoxéÀ", k=rnd.randrange(6, 9)))
        words[base] = rnd.choice([5, 7, 40, 300, 4000])
        for _ in range(4):
            words[rnd.choice(list(edits(base)))] = rnd.choice([5, 6, 9, 50])
    return {w: n for w, n in words.items() if len(w) >= 6}


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


@pytest.mark.parametrize("max_words", [20_000, 50, 3])
def test_like_brute_force(spark, max_words):
    words = vocabulary(7, 400)
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    got = spelling_variants(table, max_words=max_words).select(*COLUMNS).collect()
    assert sorted(tuple(r) for r in got) == variants(words)


def test_equal_vectors_in_many_blocks(spark):
    """Anagrams all land in one leaf, which more than one task has to share."""
    rnd = random.Random(1)
    words = {"".join(rnd.sample("eetaoins", 8)): rnd.choice([5, 25, 125, 625]) for _ in range(150)}
    words |= {w[:-1]: 3000 for w in list(words)[:20]}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    got = spelling_variants(table, max_words=8).select(*COLUMNS).collect()
    assert sorted(tuple(r) for r in got) == variants(words)


def test_chains_of_forms(spark):
    words = {"abcdef" + "x" * i: 5 ** (i + 1) for i in range(12)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r["word"]: r["root"] for r in spelling_variants(table).collect()}
    assert set(got.values()) == {"abcdef" + "x" * 11}


def test_counts(spark, edge_docs, no_docs, edge_rows):
    rnd = random.Random(2)
    words = ["letters", "LETTERS", "straße", "naïveté", "short", "a" * 3000, "ÀÉÎõü×÷", "mixed7digits"]
    rows = [(rnd.choice([None, *range(900)]), " ".join(rnd.choices(words, k=30))) for _ in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {w: n for w, n in runs(rows).items() if len(w) >= 6 and n >= 5}
    assert any(len(w) == 6 for w in want)
    assert {r["word"]: r["n"] for r in word_counts(docs).collect()} == want
    odd = {w: n for w, n in runs([r[:2] for r in edge_rows]).items() if len(w) >= 6 and n >= 5}
    assert {r["word"]: r["n"] for r in word_counts(edge_docs).collect()} == odd
    got = spelling_variants(word_counts(edge_docs)).select(*COLUMNS).collect()
    assert sorted(tuple(r) for r in got) == variants(odd)
    assert word_counts(no_docs).count() == 0 and spelling_variants(word_counts(no_docs)).count() == 0


def test_one_edit():
    rnd = random.Random(4)
    for _ in range(3000):
        a = "".join(rnd.choices("ab", k=rnd.randrange(0, 6)))
        b = "".join(rnd.choices("ab", k=rnd.randrange(0, 6)))
        want = a != b and b in {a[:i] + c + a[i + r:] for i in range(len(a) + 1) for c in ("a", "b", "") for r in (0, 1)}
        assert one_edit(a, b) == want, (a, b)


def test_no_words():
    empty = np.zeros((0, LEVELS), np.int64)
    count, _ = near_words([], empty, [], empty, np.zeros(0, np.int64))
    assert len(count) == 0

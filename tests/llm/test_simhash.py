import random

import numpy as np
import pytest
import xxhash

from maskframe.llm import simhash
from maskframe.llm.components import components
from tests.llm.conftest import prose


def plain_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, heads=False):
    """Smallest id reachable, by comparing every fingerprint with every other; or one id per class."""
    fps = sorted({fp for _, fp in rows})
    parent = {fp: fp for fp in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array(fps, np.uint64)
    for fp in fps:
        for other in values[np.bitwise_count(values ^ np.uint64(fp)) <= 3].tolist():
            a, b = sorted((root(fp), root(other)))
            parent[b] = a
    least = {}
    for key, fp in rows:
        if key is not None:
            least[root(fp)] = min(least.get(root(fp), key), key)
    if heads:
        return sorted(least.values())
    return {(key, fp): least.get(root(fp)) for key, fp in rows}


def test_fingerprints(edge_rows):
    for _, text, *_ in edge_rows:
        assert simhash.fingerprint((text or "").encode()) % (1 << 64) == plain_fingerprint(text)


def test_components_of_odd_rows(edge_docs, edge_rows, no_docs):
    found = [(r.id, r.fp % (1 << 64), r.component) for r in simhash.near_duplicates(edge_docs).collect()]
    want = plain_components([(k, plain_fingerprint(t)) for k, t, *_ in edge_rows])
    assert len(found) == len(edge_rows) and all(want[k, fp] == c for k, fp, c in found)
    assert simhash.near_duplicates(no_docs).count() == 0 == simhash.keep_one(no_docs).count()


def test_one_row_of_each_component_stays(edge_docs, edge_rows):
    want = plain_components([(k, plain_fingerprint(t)) for k, t, *_ in edge_rows], heads=True)
    kept = simhash.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == want


@pytest.fixture(scope="module")
def crowded(spark):
    """Fingerprints in clusters, with correlated bits and chains."""
    rnd = random.Random(3)
    fps = set()
    for _ in range(60):
        seed = rnd.getrandbits(64)
        seed = seed & ~0xFFFF | (0xFFFF if seed & 1 else 0)  # sixteen bits that go together
        for _ in range(rnd.randrange(1, 30)):
            fps.add(seed)
            for _ in range(rnd.randrange(0, 4)):
                seed ^= 1 << rnd.randrange(64)
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    return spark.createDataFrame([(f,) for f in signed], "fp long"), sorted(fps)


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 5])
def test_links_are_all_near_pairs(crowded, distance):
    frame, fps = crowded
    got = sorted((r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(frame, distance).collect())
    want = {tuple(sorted((a, b))) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= distance}
    assert sorted(tuple(sorted(p)) for p in got) == sorted(want) and len(got) == len(set(got))


@pytest.mark.parametrize("n", [100, 10**6, 10**9, 10**11])
def test_thresholds_keep_the_pigeonhole(n):
    rnd = np.random.RandomState(1)
    bits = rnd.rand(5000, 64) < np.linspace(0.2, 0.8, 64)
    bits[:, 1] = bits[:, 0]
    both = (bits.T.astype(float) @ bits) * n / 5000
    plan = simhash.allot(n, both)
    assert sum(t + 1 for _, t in plan) == simhash.MAX_DISTANCE + 1
    used = [b for group, _ in plan for b in group]
    assert len(used) == len(set(used))
    widths = [len(g) for g, t in plan]
    assert n < 10**9 or min(widths) >= 21  # many fingerprints need selective parts


def test_correlated_bits_share_a_part():
    rnd = np.random.RandomState(2)
    bits = rnd.rand(4000, 64) < 0.5
    bits[:, 63] = bits[:, 5]
    groups = simhash.group_bits(4000, bits.T.astype(float) @ bits, 4)
    assert any({5, 63} <= set(g) for g in groups) and sorted(len(g) for g in groups) == [16] * 4


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (200, 202)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 1 for i in range(1, 41)) and all(found[i] == 100 for i in range(100, 160))
    assert {found[i] for i in (200, 201, 202)} == {200} and len(found) == 40 + 60 + 3
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_are_linked(spark):
    rnd = random.Random(9)
    text = prose(rnd, 900)
    near = text.replace(" ", "  ", 5) + " tail"
    rows = [(5, text), (3, "".join(c.upper() if c.isascii() else c for c in text)), (9, near), (1, prose(rnd, 900))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id: r.component for r in simhash.near_duplicates(docs).collect()} == {5: 3, 3: 3, 9: 3, 1: 1}
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 3]

import base64
import hashlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from checks.compare import connect
from maskframe.llm import bpe
from maskframe.llm.decontaminate import FOUND_SQL
from maskframe.llm.line_dedup import MAX_SHARE, MIN_PAGES
from maskframe.llm.quality import MEASURES_SQL
from tests.llm.test_simhash import plain_components, plain_fingerprint

SPACE = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Input and output rows of every stage."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet").cache(), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf).cache()
        out.append((name, docs, after))
        docs = after
    return out


def test_the_stages_are_the_ones_asked_for(stages):
    assert [n for n, *_ in stages] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "byte_bpe"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert after.schema == before.schema


def test_quality_stage(stages, sf):
    _, before, after = stages[0]
    kept = connect(sf).execute(f"WITH {MEASURES_SQL.format(docs='documents')} SELECT doc_id FROM q_verdicts WHERE kept").fetchall()
    assert sorted(r.doc_id for r in after.collect()) == sorted(k for k, in kept)
    assert 0 < after.count() < before.count()


def test_line_stage(stages):
    _, before, after = stages[1]
    rows = before.collect()
    pages, lines = Counter(r.source for r in rows), Counter()
    for r in rows:
        lines.update({(r.source, x.strip(SPACE)) for x in r.text.split("\n") if x.strip(SPACE)})
    want = {}
    for r in rows:
        kept = []
        for x in r.text.split("\n"):
            n = lines[r.source, x.strip(SPACE)]
            if not (n >= MIN_PAGES and n / pages[r.source] >= MAX_SHARE):
                kept.append(x)
        want[r.doc_id] = "\n".join(kept)
    got = {r.doc_id: (r.text, r.n_chars) for r in after.collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()}


def test_near_duplicate_stage(stages):
    _, before, after = stages[2]
    heads = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in before.collect()], heads=True)
    assert sorted(r.doc_id for r in after.collect()) == heads


def test_decontamination_stage(stages, sf):
    _, before, after = stages[3]
    con = connect(sf)
    con.register("kept_docs", before.toPandas())
    found = con.execute("WITH " + FOUND_SQL.replace("{docs}", "kept_docs") + " SELECT DISTINCT doc_id FROM c_found").fetchall()
    assert sorted(r.doc_id for r in after.collect()) == sorted({r.doc_id for r in before.collect()} - {k for k, in found})


def test_token_stage(stages):
    _, before, after = stages[4]
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in after.collect()}
    texts = {r.doc_id: r.text for r in before.collect()}
    assert set(got) == set(texts)
    for key, text in texts.items():
        ids = library.encode_ordinary(text)
        assert got[key].n_tokens == len(ids)
        assert got[key].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[key].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_run_gives_the_last_stage(stages, spark, sf):
    assert sorted(corpus_pipeline.run(spark, sf).collect()) == sorted(stages[-1][2].collect())


def test_a_large_group_of_copies_survives_once(spark, sf):
    copy = "\n".join(f"Line {i} of the page that many rows repeat, told in words of its own." for i in range(6))
    texts = [copy] * 20 + [f"Page {i} tells of {i * 7} things.\nIt ends with number {i * i}." for i in range(40)]
    texts[20:30] = [t + "\nAll rights reserved" for t in texts[20:30]]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, sf).collect()}
    assert len(out) == 60 and all(out[i] == copy for i in range(20))
    assert not any("rights" in t for t in out.values()) and all(out.values())
    kept = corpus_pipeline.near_duplicates(spark, corpus_pipeline.line_dedup(spark, docs, sf), sf).collect()
    assert [r.doc_id for r in kept if r.text == copy] == [0]


def test_stages_survive_odd_tables(spark, sf, edge_rows):
    docs = spark.createDataFrame(edge_rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, sf)
        assert frame.count() >= 0

import re

from pyspark.sql import functions as F

from maskframe.llm.line_dedup import drop_boilerplate
from maskframe.llm.quality import RULES, WINDOW, Rule, keep_good, measure

SPACE = " \t\n\x0b\x0c\r"


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, covered = {}, set()
    for i in range(len(words) - WINDOW + 1):
        seen.setdefault(tuple(words[i:i + WINDOW]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered |= {p + k for p in places for k in range(WINDOW)}
    lines = [x for x in (text or "").split("\n") if x.strip(SPACE)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def test_measures_of_odd_texts(edge_docs, edge_rows):
    judged, name = measure(edge_docs)
    assert judged.columns[:-1] == edge_docs.columns and name not in edge_docs.columns
    got = [(r["doc_id"], r["text"], r[name].asDict()) for r in judged.collect()]
    assert len(got) == len(edge_rows)
    for _, text, found in got:
        want = plain_measures(text)
        assert {k: found[k] for k in want} == want
        base = want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"]
        assert found["base_failed"] == base and not (base and found["kept"])
        assert found["kept"] == (not found["failed"])


def test_kept_rows_are_unchanged(edge_docs, no_docs):
    kept = keep_good(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 2, 6, 7]
    assert keep_good(no_docs).count() == 0


def test_rules_compile_into_one_projection(edge_docs):
    judged, _ = measure(edge_docs, rules=[*RULES, Rule("few_lines", "n_lines", low=2)])
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_lines_of_a_site(spark):
    pages = [(i, f"Menu\nown line {i}\n Menu \n\nend", "a", 0) for i in range(10)]
    pages += [(100 + i, "Menu\nonly here", "b" if i else None, 0) for i in range(2)]
    docs = spark.createDataFrame(pages, "doc_id long, text string, source string, line int")
    out = {r.doc_id: (r.text, r.gone) for r in drop_boilerplate(docs, max_share=0.5, min_pages=3, count_as="gone").collect()}
    assert out[3] == ("own line 3\n", 3)  # "Menu" twice and "end"
    assert out[100] == ("Menu\nonly here", 0) == out[101]


def test_lines_of_odd_tables(edge_docs, edge_rows, no_docs):
    for share, least in ((0.05, 5), (0.01, 1)):
        out = drop_boilerplate(edge_docs, max_share=share, min_pages=least)
        assert out.columns == edge_docs.columns and out.count() == len(edge_rows)
    by_id = {(r.doc_id, r.lang): r.text for r in out.where("doc_id IS NOT NULL").collect()}
    assert by_id[3, "en"] is None and by_id[4, "en"] == "" and by_id[8, "en"] == ""
    assert drop_boilerplate(no_docs).count() == 0


def test_null_sites_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "x\ny", None)] * 6 + [(1, "z", None)], "doc_id long, text string, source string")
    texts = sorted(r.text for r in drop_boilerplate(docs, max_share=0.5).collect())
    assert texts == [""] * 6 + ["z"]
    assert drop_boilerplate(docs.withColumn("text", F.lit(None).cast("string"))).where("text IS NOT NULL").count() == 0

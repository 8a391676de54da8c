import random
import re

import pytest

from maskframe.llm import licenses

GPL = "This work is licensed under the GNU General Public License, version 3."
MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files"
)


def plain_base(text):
    words = re.findall(licenses.WORD_PATTERN, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [
        (i, label) for phrase, label in licenses.BASE.items() for i in range(len(words))
        if words[i:i + len(phrase.split())] == phrase.split()
    ]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def scanned(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.id: r for r in licenses.scan_licenses(docs).collect()}


def test_notices_get_their_labels(spark):
    out = scanned(
        spark, GPL, "x " + MIT + " y", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.",
        "Released under the MIT License.", "mit der GNU in the public", "software and files, free of charge",
    )
    assert [out[i].labels for i in range(7)] == ["gpl,gpl-3.0", "mit", "cc-by,cc-by-nc-4.0", "apache,apache-2.0", "mit", "", ""]
    assert [out[i].base_labels for i in range(7)] == ["gpl", "", "cc-by", "apache", "mit", "", ""]
    assert all(0.6 <= out[i].score <= 1 for i in range(5)) and out[5].score == out[6].score == 0


def test_every_notice_of_a_text_is_found(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted."
    apache = "Licensed under the Apache License, Version 2.0."
    out = scanned(spark, f"{bsd} {MIT}. {apache}", *[f"File {i}. {apache}" for i in range(40)])
    assert out[0].labels == "apache,apache-2.0,bsd,mit" and out[1].labels == "apache,apache-2.0"
    every = ". ".join(text for _, text, _ in licenses.TEMPLATES)
    assert set(scanned(spark, every)[0].labels.split(",")) >= {label for label, _, _ in licenses.TEMPLATES}


def test_the_rarest_words_are_looked_up_first(spark):
    """By the number of texts that hold a word, and as few as any notice that is found must have one of."""
    rare = [("mozilla", 0), ("public", 1), ("license", 2), ("terms", 3), ("subject", 4)]
    texts = [(("a", 1), rare), *[((f"b{i}", 1), [("public", 7), ("license", 8)]) for i in range(4)], (("c", 1), [("license", 0)])]
    looked = spark.createDataFrame(texts, "doc struct<id:string,hash:int>, rare array<struct<word:string,pos:int>>")
    postings = spark.createDataFrame([*licenses.POSTINGS], "word string, template int, place int")
    mpl = next(t for t, (label, *_) in enumerate(licenses.TEMPLATES) if label == "mpl-2.0")
    out = {r.doc.id: r for r in licenses.rarest_first(looked, postings).where(f"template = {mpl}").collect()}
    assert [(x.word, x.texts) for x in out["a"].asked] == [("mozilla", 1), ("subject", 1), ("terms", 1), ("public", 5), ("license", 6)]
    assert [x.word for x in out["a"].rarest] == ["mozilla", "subject", "terms"]  # three of five must agree
    assert [x.word for x in out["b0"].rarest] == ["public"] and [x.word for x in out["c"].rarest] == ["license"]


def test_notices_with_words_missing_are_found_as_by_all_places(spark):
    """Whatever three fifths of a notice's places stand in order, the rarest words propose its position."""
    rnd, label_of = random.Random(4), {}
    _, notice, phrase = licenses.TEMPLATES[2]
    words, texts = notice.split(), []
    fixed = set(range(licenses.PHRASE_PLACES[2], licenses.PHRASE_PLACES[2] + len(phrase.split())))
    for i in range(60):
        gone = set(rnd.sample([p for p in range(len(words)) if p not in fixed], rnd.randint(0, 10)))
        swapped = [f"x{p}" if p in gone else w for p, w in enumerate(words)]
        moved = [words[p] for p in sorted(gone)]
        texts.append(" ".join([*moved, "y", *swapped]))
        listed = [p for p, w in enumerate(words) if w not in licenses.COMMON]
        label_of[i] = "mit" if sum(p not in gone for p in listed) * 100 >= len(listed) * licenses.MIN_PERCENT else ""
    out = scanned(spark, *texts)
    assert {i: out[i].labels for i in out} == label_of and set(label_of.values()) == {"mit", ""}


def test_words_out_of_place_are_no_notice(spark):
    shuffled = "version 3 public the License under GNU licensed General"
    assert scanned(spark, shuffled)[0].labels == ""


@pytest.mark.parametrize("times", [1, 300])
def test_base_phrases_by_brute_force(spark, times):
    texts = [None, "", GPL * times, (MIT + " MIT License cc By; mit-license ") * times, "ÄGNU General Public License", "CC BY" * times]
    out = scanned(spark, *texts)
    for i, text in enumerate(texts):
        r = out[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(text)


def test_odd_tables(edge_docs, edge_rows, no_docs):
    rows = licenses.scan_licenses(edge_docs).collect()
    assert len(rows) == len(edge_rows) and {r.labels for r in rows} == {""}
    assert sorted(r.n_words for r in rows) == sorted(plain_base(t)[0] for _, t, *_ in edge_rows)
    assert licenses.scan_licenses(no_docs).count() == 0


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, GPL), (None, GPL), (1, GPL), (1, GPL), (1, None)], "doc_id long, text string")
    assert sorted(r.labels for r in licenses.scan_licenses(docs).collect()) == ["", *["gpl,gpl-3.0"] * 4]


def test_main_path_is_native(edge_docs):
    plan = licenses.scan_licenses(edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan

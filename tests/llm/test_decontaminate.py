import pytest
from pyspark.sql import functions as F

from maskframe.llm.decontaminate import contaminated, drop_contaminated, template_windows

ITEM = (
    "A farmer called Anna has 12 baskets with 30 apples each. Each evening Anna sells 12 apples at the market for 2 "
    "euros and walks home 5 km."
)
FILLER = "some words that stand before and after it and have nothing to do with any of the items at all "


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, ITEM), (2, ITEM), (3, "too short"), (4, None), (5, ""), (None, "the cat sat on the mat and looked at the moon")]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("id", F.lit(1))


def found(spark, benchmark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.id, r.item) for r in contaminated(docs, benchmark).collect()}


def test_copies_are_found(spark, benchmark):
    both = {(0, 1), (0, 2)}
    assert found(spark, benchmark, FILLER + ITEM + " " + FILLER) == both
    assert found(spark, benchmark, ITEM.lower()) == both and found(spark, benchmark, ITEM.upper()) == both
    assert found(spark, benchmark, ITEM.replace(" ", "\n").replace(".", " ;")) == both
    assert found(spark, benchmark, FILLER) == set()


def test_other_names_and_numbers_are_found_if_they_fit(spark, benchmark):
    changed = ITEM.replace("Anna", "Otto").replace("12", "700").replace("30", "4").replace("euros", "dollars")
    assert found(spark, benchmark, FILLER + changed) == {(0, 1), (0, 2)}
    # One name for two people, and 12 read once as 7 and once as 8, is another question.
    torn = ITEM.replace("Anna has 12", "Otto has 7").replace("sells 12", "sells 8")
    assert found(spark, benchmark, FILLER + torn) == set()


def test_a_clash_costs_only_its_own_windows(spark, benchmark):
    both = {(0, 1), (0, 2)}
    # One number altered that also stands elsewhere.
    assert found(spark, benchmark, FILLER + ITEM.replace("sells 12", "sells 13")) == both
    assert found(spark, benchmark, FILLER + ITEM.replace("has 12", "has 13")) == both
    # Two numbers that become the same one.
    assert found(spark, benchmark, FILLER + ITEM.replace("30", "4").replace("12", "4")) == both
    docs = spark.createDataFrame([(0, ITEM.replace("sells 12", "sells 13"))], "doc_id long, text string")
    assert {(r.matched, r.words) for r in contaminated(docs, benchmark).collect()} == {(27, 28)}


def test_part_of_an_item_is_not_enough(spark, benchmark):
    words = ITEM.split()
    assert found(spark, benchmark, FILLER + " ".join(words[:15])) == set()
    assert found(spark, benchmark, " ".join([*words[:20], "suddenly", *words[20:]])) == {(0, 1), (0, 2)}


def test_null_items_and_ids(spark, benchmark):
    assert found(spark, benchmark, "yes the cat sat on the mat and looked at the moon") == {(0, None)}


def test_odd_tables(edge_docs, edge_rows, no_docs, benchmark, spark):
    assert contaminated(edge_docs, benchmark).count() == 0
    kept = drop_contaminated(edge_docs, benchmark)
    assert kept.columns == edge_docs.columns and kept.count() == len(edge_rows)
    assert drop_contaminated(no_docs, benchmark).count() == 0
    assert drop_contaminated(edge_docs, benchmark.limit(0)).count() == len(edge_rows)
    docs = spark.createDataFrame([(None, ITEM), (None, ITEM), (7, ITEM), (7, "other"), (8, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in drop_contaminated(docs, benchmark).collect()) == [(7, "other"), (8, None)]


def test_windows_join_without_a_broadcast_too(spark, benchmark, monkeypatch):
    from maskframe.llm import decontaminate

    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_WINDOWS", 0)
    assert found(spark, benchmark, FILLER + ITEM, FILLER) == {(0, 1), (0, 2)}


def test_main_path_is_native(spark):
    df = spark.createDataFrame([(ITEM,)], "text string").select(template_windows(F.col("text")).alias("w"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert len(df.first().w) > 20

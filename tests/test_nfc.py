import random
import sys
import time
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from maskframe import Fake, Hash, TableSpec, mask_table
from maskframe.functions import nfc
from maskframe.functions.compose import tables


def composed(spark, texts):
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(texts)), "v": texts}))
    return [r.o for r in df.repartition(8, "i").select("i", nfc(F.col("v")).alias("o")).orderBy("i").collect()]


def test_equals_the_standard_on_every_assigned_character(spark):
    texts = [chr(n) for n in range(1, sys.maxunicode + 1) if not 0xD800 <= n < 0xE000]
    texts = [c for c in texts if unicodedata.category(c) not in ("Cn", "Co")]
    texts += [d for c in texts if (d := unicodedata.normalize("NFD", c)) != c]
    assert composed(spark, texts) == [unicodedata.normalize("NFC", t) for t in texts]


def test_equals_the_standard_on_mixed_runs(spark):
    t, rnd = tables(), random.Random(11)
    jamo = [chr(n) for n in (*range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A7, 0x11C3))]
    pool = [*t.decomposed, *t.ordered, *"".join(t.pairs), *jamo, *list("aeiou xyz,\n") * 30, *"가각漢" * 20]
    texts = ["".join(rnd.choices(pool, k=rnd.randint(0, 14))) for _ in range(30_000)]
    assert composed(spark, texts) == [unicodedata.normalize("NFC", x) for x in texts]


@pytest.mark.parametrize("text", [
    "", "plain", "Café", "́ leading mark", "ạ̇ ạ̇", "한",
    "é" * 20_000, "x" * 200_000 + "Å", "a" + "̣́" * 500,
])
def test_short_long_and_marked_texts(spark, text):
    assert composed(spark, [text]) == [unicodedata.normalize("NFC", text)]


def test_null_stays_null(spark):
    assert spark.createDataFrame([(None,)], "v string").select(nfc(F.col("v")).alias("o")).first().o is None


def test_filters_after_masking_reach_the_scan(spark, ctx, tmp_path):
    rows = [(i, f"u{i}@x.test", f"José {i}", "de" if i % 2 else "fr") for i in range(20)]
    path = str(tmp_path / "people")
    spark.createDataFrame(rows, "id int, email string, name string, country string").write.partitionBy("country").parquet(path)
    users = TableSpec("public.users", pk=("id",), uniques=(("email",),))
    masked = mask_table(spark.read.parquet(path), {"email": Fake("email"), "name": Hash()}, ctx, table=users)
    kept = masked.where("country = 'de' AND id > 10")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,10)" in plan.split("PushedFilters:")[1].split("]")[0]
    assert "= de" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert {tuple(r) for r in kept.collect()} == {
        tuple(r) for r in masked.collect() if r.country == "de" and r.id > 10
    }
    unread = masked.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "email" not in unread.split("ReadSchema:")[1] and "name" not in unread.split("ReadSchema:")[1].split(">")[0]


def test_marked_texts_cost_little(spark):
    """What a text costs must not grow with the tables, nor are patterns compiled for every text: 0.4 ms a text once."""
    df = spark.range(40_000, numPartitions=1).select(F.concat(F.lit("Cafe\u0301 A\u030a "), F.col("id").cast("string")).alias("v"))
    composed_once = df.select(F.sum(F.length(nfc(F.col("v")))).alias("n"))
    composed_once.collect()
    began = time.monotonic()
    total = composed_once.first().n
    assert time.monotonic() - began < 8
    assert total == sum(len(f"Caf\u00e9 \u00c5 {i}") for i in range(40_000))

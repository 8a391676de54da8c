"""How often subsetting reads its tables and what it writes, and tables without a primary key."""

import random
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from maskframe import ForeignKey, TableSpec
from maskframe.operators import referential


def counted(df, folder):
    """``df`` leaving a file in ``folder`` for every time one of its partitions is worked out."""
    Path(folder).mkdir(parents=True)

    def note(batches):
        (Path(folder) / uuid.uuid4().hex).touch()
        yield from batches

    return df.coalesce(1).mapInArrow(note, df.schema)


def star(spark):
    rnd = random.Random(3)
    tables = {
        "org": spark.range(6).selectExpr("id", "concat('o', id) AS name"),
        "usr": spark.createDataFrame([(i, rnd.randrange(6)) for i in range(60)], "id long, org long"),
        "ord": spark.createDataFrame([(i, rnd.randrange(60)) for i in range(300)], "id long, usr long"),
        "itm": spark.createDataFrame([(rnd.randrange(300), rnd.choice([None, *range(40)]), i % 9) for i in range(900)], "ord long, prt long, n int"),
        "prt": spark.range(40).selectExpr("id", "id % 5 AS kind"),
    }
    specs = {
        "org": TableSpec("org", pk=("id",)), "usr": TableSpec("usr", pk=("id",), fks=(ForeignKey(("org",), "org", ("id",)),)),
        "ord": TableSpec("ord", pk=("id",), fks=(ForeignKey(("usr",), "usr", ("id",)),)),
        "itm": TableSpec("itm", fks=(ForeignKey(("ord",), "ord", ("id",)), ForeignKey(("prt",), "prt", ("id",)))),
        "prt": TableSpec("prt", pk=("id",)),
    }
    return tables, specs


def test_every_table_is_read_at_most_twice(spark, tmp_path):
    tables, specs = star(spark)
    watched = {n: counted(df, tmp_path / n) for n, df in tables.items()}
    out = referential.subset(watched, specs, {"org": "id = 2"})
    assert {n: len(list((tmp_path / n).iterdir())) for n in tables} == dict.fromkeys(tables, 1)
    kept = {n: df.collect() for n, df in out.items()}
    assert {n: len(list((tmp_path / n).iterdir())) for n in tables} == dict.fromkeys(tables, 2)
    users = {r.id for r in tables["usr"].collect() if r.org == 2}
    orders = {r.id for r in tables["ord"].collect() if r.usr in users}
    items = [r for r in tables["itm"].collect() if r.ord in orders]
    assert {r.id for r in kept["usr"]} == users and {r.id for r in kept["ord"]} == orders
    assert sorted(map(str, kept["itm"])) == sorted(map(str, items))
    assert {r.id for r in kept["prt"]} == {r.prt for r in items if r.prt is not None} and len(kept["org"]) == 1


def test_a_key_is_written_once_however_many_rounds(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(24)], "id int, boss int")
    spec = {"e": TableSpec("e", pk=("id",), fks=(ForeignKey(("boss",), "e", ("id",)),))}
    out = referential.subset({"e": chain}, spec, {"e": "id = 4"})["e"]
    assert out.count() == 24
    plan = out._jdf.queryExecution().optimizedPlan()
    paths = {f.rsplit("/", 1)[0] for f in out.inputFiles() if "/subset-" in f}
    assert len(paths) == 24 and "Relation" in plan.toString()
    assert spark.read.parquet(*sorted(paths)).count() == 24


@pytest.mark.parametrize("predicate,roots", [("n = 3", "itm"), ("id < 2", "org")])
def test_tables_without_a_key(spark, predicate, roots):
    """Rows equal in their key values may differ in whether they are roots."""
    tables, specs = star(spark)
    out = referential.subset(tables, specs, {roots: predicate})
    items = [tuple(r) for r in tables["itm"].collect()]
    if roots == "itm":
        want = [r for r in items if r[2] == 3]
    else:
        users = {r.id for r in tables["usr"].collect() if r.org < 2}
        orders = {r.id for r in tables["ord"].collect() if r.usr in users}
        want = [r for r in items if r[0] in orders]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in out["itm"].collect())
    assert {r.id for r in out["ord"].collect()} >= {r[0] for r in want}
    assert {r.id for r in out["prt"].collect()} == {r[1] for r in want if r[1] is not None}


def test_roots_that_are_reached_as_well(spark):
    """A row without a key is kept for either reason, once."""
    parent = spark.createDataFrame([(1,), (2,)], "id long")
    child = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (None, "a"), (None, "c")], "p long, v string")
    specs = {"p": TableSpec("p", pk=("id",)), "c": TableSpec("c", fks=(ForeignKey(("p",), "p", ("id",)),))}
    out = referential.subset({"p": parent, "c": child}, specs, {"p": "id = 1", "c": "v = 'a'"})
    assert sorted(map(str, out["c"].collect())) == sorted(map(str, child.where("v = 'a' OR p = 1").collect()))
    assert sorted(r.id for r in out["p"].collect()) == [1, 2]


def test_no_roots_and_empty_tables(spark):
    tables, specs = star(spark)
    assert all(df.isEmpty() for df in referential.subset(tables, specs, {}).values())
    empty = {n: df.limit(0) for n, df in tables.items()}
    assert all(df.isEmpty() for df in referential.subset(empty, specs, {"org": "id = 2"}).values())
    none = referential.subset(tables, specs, {"org": "id = 77"})
    assert all(df.isEmpty() for df in none.values()) and none["itm"].columns == ["ord", "prt", "n"]

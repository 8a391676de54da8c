from maskframe import ForeignKey, TableSpec
from maskframe.operators import drift, profile


def changes(df):
    return {(r.table_id, r.kind, r.name): r.change for r in df.collect() if r.has_drift}


def test_declarations_are_compared_one_by_one(spark):
    a = spark.createDataFrame([], "id int not null, ref int, note string, price decimal(8,2), old int")
    b = spark.createDataFrame([], "id int, ref bigint, note string, price decimal(10,2), `new, col` int")
    was = TableSpec("t", pk=("id",), uniques=(("note",),), fks=(ForeignKey(("ref",), "p", ("id",)),))
    now = TableSpec(
        "t", pk=("id", "ref"), uniques=(("note", "ref"),), fks=(ForeignKey(("ref",), "p", ("other",)),), not_null=frozenset({"note"})
    )
    before = drift.declared_schema(spark, {"t": a, "gone": a.select("id")}, {"t": was})
    after = drift.declared_schema(spark, {"t": b, "fresh": b.select("id")}, {"t": now})
    assert changes(drift.drift_declared(before, after)) == {
        ("t", "column", "ref"): "retyped", ("t", "column", "note"): "nullability", ("t", "column", "price"): "retyped",
        ("t", "column", "old"): "removed", ("t", "column", "new, col"): "added",
        ("t", "primary_key", "primary key"): "changed", ("t", "unique", '["note"]'): "removed",
        ("t", "unique", '["note", "ref"]'): "added", ("t", "foreign_key", '[["ref"], "p"]'): "changed",
        ("gone", "column", "id"): "dropped_table", ("fresh", "column", "id"): "new_table",
    }
    assert changes(drift.drift_declared(before, before)) == {}


def test_snapshots_survive_storage_and_empty_ones_compare(spark, tmp_path):
    df = spark.createDataFrame([], "id int")
    snapshot = drift.declared_schema(spark, {"t": df}, {"t": TableSpec("t", types={"id": "uuid"})})
    snapshot.write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    assert changes(drift.drift_declared(stored, snapshot)) == {} and stored.first().definition == "uuid"
    nothing = drift.declared_schema(spark, {})
    assert changes(drift.drift_declared(nothing, stored)) == {("t", "column", "id"): "new_table"}
    assert drift.drift_declared(nothing, nothing).isEmpty()


def test_first_null_of_a_nullable_column_is_no_drift(spark):
    a = spark.createDataFrame([(1, "x")], "id int, note string")
    b = spark.createDataFrame([(1, None)], "id int, note string")
    same = drift.drift_declared(*[drift.declared_schema(spark, {"t": df}) for df in (a, b)])
    pa, pb = profile.profile(a, "t"), profile.profile(b, "t")
    assert {r.column_name: r.change for r in drift.drift(pa, pb).collect()}["note"] == "nullability"
    assert {r.change for r in drift.drift(pa, pb, same).collect()} == {"none"}

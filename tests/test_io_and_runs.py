import json

import pytest
from pyspark.sql import functions as F

from maskframe import Fake, Hash, MaskContext, MaskError, Null, TableSpec, mask_table
from maskframe.operators.verify import diff_runs, is_ok
from maskframe.plans import RunConfig, dry_run, report_lines, run, verify_run
from maskframe.sources import (
    apply_strategy, copy_passthrough, dual_write, read_after, read_files, row_filter,
    synth_customers, write_files, write_table,
)
from maskframe.spec import ForeignKey
from maskframe.streaming import foreach_batch_sink, mask_stream, read_stream, write_available


def test_collision_policies(spark, tmp_path):
    out = str(tmp_path / "t")
    df = spark.range(5)
    write_table(df, out)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_table(df, out)
    for policy in ("truncate", "drop_create"):
        write_table(df.limit(2), out, policy=policy)
        assert spark.read.parquet(out).count() == 2
    with pytest.raises(ValueError, match="append"):
        write_table(df, out, policy="append")
    with pytest.raises(ValueError, match="unknown"):
        write_table(df, out, policy="merge")


def test_copy_keeps_every_value(spark, tmp_path, sf):
    copy_passthrough(spark, f"{sf}/orders.parquet", str(tmp_path / "c"))
    a, b = spark.read.parquet(f"{sf}/orders.parquet"), spark.read.parquet(str(tmp_path / "c"))
    assert a.schema == b.schema and diff_runs(a, b).isEmpty()


def test_keyset_reads_push_their_filter(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    after = read_after(df.select("o_orderkey"), "o_orderkey", 100, 10)
    assert [r[0] for r in after.collect()] == list(range(101, 111))
    plan = after._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,100)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan and "TakeOrderedAndProject" in plan
    assert read_after(df, "o_orderkey", None).count() == df.count()


def test_filters_compose_with_and(spark):
    df = spark.range(10)
    assert row_filter(df, "id > 2 OR id = 0", None, F.col("id") < 5).count() == 3
    assert row_filter(df).count() == 10


def test_strategies(spark):
    tables = {"a": spark.range(3), "b": spark.range(3), "c": spark.range(3), "d": spark.range(3)}
    out = apply_strategy(tables, {"b": "empty", "c": "exclude", "d": "truncate"})
    assert {n: df.count() for n, df in out.items()} == {"a": 3, "b": 0, "d": 0}
    with pytest.raises(MaskError, match="absent"):
        apply_strategy(tables, {"zz": "empty"})
    with pytest.raises(MaskError, match="unknown table strategy"):
        apply_strategy(tables, {"a": "drop"})


def test_file_round_trips(spark, ctx, tmp_path):
    df = spark.createDataFrame([(2, "b@x", None, 1.5), (1, "a@x", "q\"uote, comma", None)], "id long, email string, note string, amount double")
    masked = mask_table(df, {"email": Fake("email")}, ctx, table="public.users")
    write_files(masked, str(tmp_path / "j"), "jsonl", key=["id"])
    lines = [json.loads(x) for f in sorted((tmp_path / "j").glob("part-*")) for x in f.read_text().splitlines()]
    assert [x["id"] for x in lines] == [1, 2] and lines[1]["note"] is None
    assert "a@x" not in json.dumps(lines)
    back = read_files(spark, str(tmp_path / "j"), "jsonl", schema=masked.schema)
    assert diff_runs(back, masked).isEmpty()
    first = dual_write(masked, str(tmp_path / "d1"), str(tmp_path / "d2"))
    assert diff_runs(first, read_files(spark, str(tmp_path / "d2"), "jsonl", schema=masked.schema)).isEmpty()
    df.write.csv(str(tmp_path / "c"), header=True, escape='"')
    csv = read_files(spark, str(tmp_path / "c"), "csv", schema=df.schema, rename={"email": "mail"})
    assert csv.columns == ["id", "mail", "note", "amount"] and csv.where("id = 1").first().note == 'q"uote, comma'
    with pytest.raises(MaskError):
        read_files(spark, "x", "avro")
    with pytest.raises(MaskError):
        read_files(spark, "x", "jsonl")


def test_synthetic_rows(spark):
    import hashlib

    df = synth_customers(spark, 250, 100)
    r = df.where("id = 101").first()
    assert (r.org_id, r.email, r.full_name, r.ssn, len(r.bio)) == (2, "customer101@example.test", "Customer Number 101", "000000101", 1024)
    assert r.bio.startswith(hashlib.md5(b"202").hexdigest()) and df.select("email").distinct().count() == 250


def stream_parts(spark, folder, start, n):
    spark.range(start, start + n).select("id", F.concat(F.lit("user"), "id", F.lit("@x.test")).alias("email")).coalesce(1).write.mode("append").parquet(folder)


def test_stream_equals_batch_and_resumes(spark, ctx, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    stream_parts(spark, source, 0, 100)
    schema = spark.read.parquet(source).schema
    rules, spec = {"email": Fake("email")}, TableSpec("public.records", pk=("id",), uniques=(("email",),))
    for start in (100, 200):
        masked = mask_stream(read_stream(spark, source, schema, max_files_per_trigger=1), rules, ctx, table=spec)
        write_available(masked, out, check).awaitTermination()
        batch = mask_table(spark.read.parquet(source), rules, ctx, table=spec)
        assert diff_runs(spark.read.parquet(out), batch).isEmpty()
        stream_parts(spark, source, start, 50)


def test_batch_sink_replays_without_loss_or_doubles(spark, ctx, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(4):
        stream_parts(spark, source, i * 25, 25)
    schema = spark.read.parquet(source).schema

    def start(check):
        masked = mask_stream(read_stream(spark, source, schema, max_files_per_trigger=1), {"email": Hash()}, ctx, table="public.records")
        foreach_batch_sink(masked, out, check, table="public.records", run_id="r", cursor="id").awaitTermination()

    start(str(tmp_path / "check"))
    # A lost checkpoint could cut other batches and leave old ones behind: it is refused.
    with pytest.raises(MaskError):
        start(str(tmp_path / "check2"))
    # A batch that was not committed is replayed; its folders are replaced, not added to.
    for name in ("3", ".3.crc"):
        (tmp_path / "check" / "commits" / name).unlink()
    start(str(tmp_path / "check"))
    assert spark.read.parquet(f"{out}/rows").count() == 100
    progress = spark.read.parquet(f"{out}/progress")
    assert progress.agg(F.sum("rows"), F.count("*")).first() == (100, 4)


def demo(spark):
    tables = {
        "public.users": spark.createDataFrame([(i, f"u{i}@x.test", f"User {i}") for i in range(20)], "id long, email string, full_name string"),
        "public.logins": spark.createDataFrame([(i, i % 25, f"10.0.0.{i}") for i in range(60)], "id long, user_id long, last_ip string"),
        "public.scratch": spark.range(3),
    }
    specs = {
        "public.users": TableSpec("public.users", pk=("id",), uniques=(("email",),), not_null=frozenset({"email"})),
        "public.logins": TableSpec("public.logins", pk=("id",), fks=(ForeignKey(("user_id",), "public.users", ("id",)),)),
    }
    document = {
        "version": "1.0", "on_existing_data": "fail",
        "tables": {
            "public.users": {"columns": {"full_name": {"action": "fake", "provider": "full_name"}}},
            "public.logins": {"null_orphan_fks": True}, "public.scratch": {"strategy": "exclude"},
        },
    }
    return tables, specs, RunConfig.from_dict(document)


def test_whole_run_verifies_and_resumes(spark, ctx, tmp_path):
    tables, specs, config = demo(spark)
    inspection = dry_run(tables, specs, config)
    summary = {r.table_id: r for r in inspection.summary.collect()}
    assert summary["public.users"].masked == ["email"] and summary["public.users"].explicit == ["full_name"]
    assert "- `email`: fake, provider=email, pattern=email (high)" in [r.line for r in report_lines(inspection).collect()]
    result = run(spark, tables, specs, config, ctx, str(tmp_path / "out"), run_id="r1")
    assert set(result.paths) == {"public.users", "public.logins"}
    logins = spark.read.parquet(result.paths["public.logins"])
    assert logins.where("user_id IS NULL").count() == 10
    report = verify_run(spark, {n: tables[n] for n in result.paths}, result, specs, config)
    failed = [(r["check"], r.target) for r in report.where("verdict = 'fail'").collect()]
    assert failed == [("column.passthrough_drift", "public.logins.user_id")]
    events = spark.read.parquet(result.audit_path)
    assert events.where("table_id = 'public.users' AND column_name = 'email'").first().cells_changed == 20
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        run(spark, tables, specs, config, ctx, str(tmp_path / "out"))
    # Half of the users went missing: continuing adds exactly those.
    full = spark.read.parquet(result.paths["public.users"])
    half = str(tmp_path / "again")
    run(spark, {**tables, "public.users": tables["public.users"].where("id < 10")}, specs, config, ctx, half)
    other = MaskContext(salt="b" * 64, key=ctx.key, as_of=ctx.as_of)
    with pytest.raises(MaskError, match="public.logins"):
        run(spark, tables, specs, config, other, half, resume=True)
    resumed = run(spark, tables, specs, config, ctx, half, resume=True)
    assert diff_runs(spark.read.parquet(resumed.paths["public.users"]), full).isEmpty()
    again = spark.read.parquet(resumed.audit_path)
    assert again.where("table_id = 'public.users' AND column_name = 'email'").first().cells_changed == 10


def test_run_with_roots(spark, ctx, tmp_path):
    tables, specs, config = demo(spark)
    result = run(spark, tables, specs, config, ctx, str(tmp_path / "out"), roots={"public.users": "id = 4"})
    counts = {n: spark.read.parquet(p).count() for n, p in result.paths.items()}
    assert counts == {"public.users": 1, "public.logins": 3}
    assert not is_ok(verify_run(spark, tables, result, specs, config))  # fewer rows than the whole source
    report = verify_run(spark, tables, result, specs, config, roots={"public.users": "id = 4"})
    assert is_ok(report)


def test_preflight_refusals(spark, ctx, tmp_path):
    tables, specs, _ = demo(spark)
    with pytest.raises(MaskError, match="public.users.email"):
        run(spark, tables, specs, RunConfig(rules={"public.users": {"email": Null()}}), ctx, str(tmp_path / "a"))
    strict = RunConfig(strict_autodetect=True)
    with pytest.raises(MaskError, match="public.logins.last_ip"):
        run(spark, tables, specs, strict, ctx, str(tmp_path / "b"))
    for document in ({"tabels": {}}, {"tables": {"t": {"colums": {}}}}, {"on_existing_data": "append"}, {"tables": {"t": {"strategy": "x"}}}, {"tables": {"t": {"columns": {"c": {"action": "nope"}}}}}):
        with pytest.raises(MaskError):
            RunConfig.from_dict(document)


def test_rows_behind_the_first_thousand_are_verified(spark, ctx, tmp_path):
    source = spark.range(1_500).selectExpr("id", "concat('n', id) AS shelf", "concat('u', id, '@x.org') AS email")
    specs = {"public.users": TableSpec("public.users", pk=("id",))}
    config = RunConfig(rules={"public.users": {"email": Fake("email")}})
    result = run(spark, {"public.users": source}, specs, config, ctx, str(tmp_path / "out"), run_id="r1")
    assert is_ok(verify_run(spark, {"public.users": source}, result, specs, config))
    moved = source.withColumn("shelf", F.expr("if(id = 1400, 'elsewhere', shelf)"))
    report = verify_run(spark, {"public.users": moved}, result, specs, config)
    assert [(r["check"], r.target) for r in report.where("verdict = 'fail'").collect()] == [
        ("column.passthrough_drift", "public.users.shelf")
    ]

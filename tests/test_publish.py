"""Runs that die at any point, the manifests that make them safe, and the ledger."""

import pytest
from pyspark.sql import functions as F

from maskframe import Fake, MaskContext, MaskError, TableSpec
from maskframe.operators.verify import diff_runs
from maskframe.plans import RunConfig, audit_of_tables, latest_status, run, run_events, settle, summary_of_run
from maskframe.plans import run as run_function
from maskframe.plans.ledger import Ledger
from maskframe.plans.publish import Store, leftovers, live, manifests, published, staging

SPECS = {"t.users": TableSpec("t.users", pk=("id",)), "t.log": TableSpec("t.log")}
CONFIG = RunConfig(rules={"t.users": {"name": Fake("full_name")}, "t.log": {"note": Fake("city")}}, auto_detect=False)
RUN = run_function.__globals__


def tables(spark, n=40):
    return {
        "t.users": spark.range(n).selectExpr("id", "concat('n', id) AS name").repartition(4),
        "t.log": spark.range(30).selectExpr("id % 7 AS k", "concat('x', id % 5) AS note").repartition(3),
    }


@pytest.fixture(scope="module")
def whole(spark, ctx, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("whole"))
    result = run(spark, tables(spark), SPECS, CONFIG, ctx, out, run_id="r")
    return {n: spark.read.parquet(p) for n, p in result.paths.items()}


def same(spark, out, whole):
    return all(diff_runs(spark.read.parquet(f"{out}/{n}"), df).isEmpty() for n, df in whole.items())


class Died(BaseException):
    """A process that is killed runs no handler for ordinary errors."""


@pytest.mark.parametrize("where", ["write_table", "staged", "commit", "committed", "half_moved"])
def test_a_run_killed_anywhere_is_finished_by_the_next(spark, ctx, tmp_path, monkeypatch, whole, where):
    out = str(tmp_path / "out")
    real = {k: RUN[k] for k in ("write_table", "commit", "settle")}

    def dies(name, after):
        def call(*args, **kwargs):
            if after:
                real[name](*args, **kwargs)
            raise Died

        monkeypatch.setitem(RUN, name, call)

    def half(spark_, out_, table, **kwargs):
        m = manifests(spark_, out_, table)[-1]
        store = Store(spark_, out_)
        for f in m.files[: len(m.files) // 2 or 1]:
            store.move(f"{staging(out_, m.attempt, table)}/{f}", f"{out_}/{table}/{f}")
        raise Died

    if where == "half_moved":
        monkeypatch.setitem(RUN, "settle", half)
    else:
        dies(*{"write_table": ("write_table", False), "staged": ("write_table", True), "commit": ("commit", False),
               "committed": ("commit", True)}[where])
    with pytest.raises(Died):
        run(spark, tables(spark), SPECS, CONFIG, ctx, out, run_id="a", concurrent_tables=1)
    for name, f in real.items():
        monkeypatch.setitem(RUN, name, f)
    if where == "staged":
        assert len(leftovers(spark, out)) == 1
    run(spark, tables(spark), SPECS, CONFIG, ctx, out, run_id="b", resume=True)
    assert same(spark, out, whole)
    status = {(r["run_id"], r["table_id"]): r["status"] for r in latest_status(run_events(spark, out)).collect()}
    assert status["b", "t.users"] == status["b", "t.log"] == "done" and status["b", None] == "succeeded"
    seen = {(r["table_id"], r["column_name"]): r["cells_seen"] for r in audit_of_tables(spark, out).collect()}
    assert seen["t.users", "name"] == 40 and seen["t.log", "note"] == 30
    # Going on once more changes nothing.
    run(spark, tables(spark), SPECS, CONFIG, ctx, out, run_id="c", resume=True)
    assert same(spark, out, whole)


def test_rows_no_manifest_lists_are_set_aside(spark, ctx, tmp_path, whole):
    out = str(tmp_path / "out")
    whole["t.users"].where("id < 10").write.parquet(f"{out}/t.users")
    (tmp_path / "out" / "t.log" / "_temporary" / "0").mkdir(parents=True)
    run(spark, tables(spark), SPECS, CONFIG, ctx, out, resume=True)
    assert same(spark, out, whole)
    assert spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/_orphans/t.users").count() == 10


def test_new_rows_are_added_by_key(spark, ctx, tmp_path, whole):
    out = str(tmp_path / "out")
    run(spark, tables(spark, 25), SPECS, CONFIG, ctx, out, run_id="a")
    run(spark, tables(spark), SPECS, CONFIG, ctx, out, run_id="b", resume=True)
    assert same(spark, out, whole)
    found = manifests(spark, out, "t.users")
    assert [(m.run_id, m.rows, m.replaces) for m in found] == [("a", 25, True), ("b", 15, False)] and live(found) == found
    summary = {r["table_id"]: r for r in summary_of_run(spark, out, "b").collect()}
    assert (summary["t.users"]["rows"], summary["t.users"]["status"], summary["t.log"]["rows"]) == (15, "done", 0)
    assert summary["t.users"]["bytes"] == found[1].bytes > 0


def test_other_salt_or_rules_are_refused(spark, ctx, tmp_path):
    out = str(tmp_path / "out")
    run(spark, tables(spark), SPECS, CONFIG, ctx, out)
    other = MaskContext(salt="b" * 64, key=ctx.key, as_of=ctx.as_of)
    with pytest.raises(MaskError, match="t.log"):
        run(spark, tables(spark), SPECS, CONFIG, other, out, resume=True)
    with pytest.raises(MaskError, match="t.users"):
        run(spark, tables(spark), SPECS, RunConfig(rules={"t.log": CONFIG.rules["t.log"]}, auto_detect=False), ctx, out, resume=True)
    with pytest.raises(MaskError, match="PATH_ALREADY_EXISTS"):
        run(spark, tables(spark), SPECS, CONFIG, ctx, out)


def test_replacing_a_table(spark, ctx, tmp_path, whole):
    out = str(tmp_path / "out")
    replace = RunConfig(rules=CONFIG.rules, auto_detect=False, on_existing_data="truncate")
    spark.range(5).write.parquet(f"{out}/t.users")  # written by something else
    for n in (7, 40):
        run(spark, tables(spark, n), SPECS, replace, ctx, out)
    assert same(spark, out, whole)
    assert [m.replaces for m in manifests(spark, out, "t.users")] == [True, True]
    assert settle(spark, out, "t.users") == live(manifests(spark, out, "t.users"))
    assert published(spark, out, "t.users").count() == 40 and published(spark, out, "absent") is None


def test_lost_files_are_noticed(spark, ctx, tmp_path):
    out = str(tmp_path / "out")
    run(spark, tables(spark), SPECS, CONFIG, ctx, out)
    next((tmp_path / "out" / "t.users").glob("part-*")).unlink()
    with pytest.raises(Exception, match="missing|cannot move|FileNotFound"):
        settle(spark, out, "t.users")


def test_events_of_a_refused_run(spark, ctx, tmp_path):
    out = str(tmp_path / "out")
    strict = RunConfig(strict_autodetect=True)
    source = {"t.users": spark.range(3).selectExpr("id", "concat(id, '@x.test') AS email")}
    with pytest.raises(MaskError, match="t.users.email"):
        run(spark, source, SPECS, strict, ctx, out, run_id="a")
    events = run_events(spark, out, "a").orderBy("seq").collect()
    assert [e["event_type"] for e in events] == [
        "run.started", "column.pii_detected", "column.pii_detected", "strict_mode_violation", "run.failed"
    ]
    assert (events[3]["column_name"], events[3]["level"]) == ("email", "error")
    assert [e["seq"] for e in events] == list(range(5))
    assert "x.test" not in "".join(e["payload"] for e in events)


def test_ledger_goes_on_under_the_same_id(spark, tmp_path):
    out = str(tmp_path / "out")
    Ledger(spark, out, "a").append([{"event_type": "run.started"}, {"event_type": "table.pending", "table_id": "t"}])
    Ledger(spark, out, "a").append([{"event_type": "table.done", "table_id": "t", "rows": 3}])
    Ledger(spark, out, "b").append([])
    assert [r["seq"] for r in run_events(spark, out).orderBy("seq").collect()] == [0, 1, 2]
    got = {r["table_id"]: (r["status"], r["rows"]) for r in latest_status(run_events(spark, out)).collect()}
    assert got == {None: ("in_progress", None), "t": ("done", 3)}
    assert run_events(spark, str(tmp_path / "none")).count() == 0
    assert summary_of_run(spark, out, "a").select(F.sum("rows")).first()[0] == 0

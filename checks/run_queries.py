"""Queries over runs that die and go on, and over what a run reports about itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import sqlgen as g
from checks.inputs import PEOPLE_SQL, SPECS, people, table
from checks.registry import query
from maskframe import Fake, Hash, TableSpec
from maskframe.operators import audit, profile
from maskframe.plans import RunConfig, audit_of_tables, latest_status, run, run_events, summary_of_run
from maskframe.plans.publish import Store, manifests, staging
from maskframe.session import run_dir
from maskframe.sources import read_table

CTX = g.CTX
_RULES = {
    "customer": {"c_name": Fake("full_name"), "c_mktsegment": Hash()},
    "orders": {"o_orderpriority": Fake("company")},
    "nation": {"n_name": Fake("country")},
}
_CONFIG = RunConfig(rules=_RULES, auto_detect=False)


def _tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf, n) for n in _RULES}


def crashed(spark: SparkSession, sf: str) -> str:
    """A folder as a run leaves it that died in several ways at once.

    Orders failed on the way and left half of its rows and a writer's scratch folder where the table
    should be; customers were listed as finished but their files not moved; nations never began.
    """
    out = run_dir(spark, "crashed")
    tables = _tables(spark, sf)
    bad = F.expr("if(o_orderkey % 1000 = 999, raise_error('executor lost'), o_orderpriority)")
    broken = {"customer": tables["customer"], "orders": tables["orders"].withColumn("o_orderpriority", bad)}
    try:
        run(spark, broken, SPECS, _CONFIG, CTX, out, run_id="run-1", concurrent_tables=1)
    except Exception as exc:  # the planted failure; anything else is one
        if "executor lost" not in str(exc):
            raise
    store = Store(spark, out)
    first = manifests(spark, out, "customer")[0]
    store.move(f"{out}/customer", staging(out, first.attempt, "customer"))
    tables["orders"].where("o_orderkey % 2 = 0").write.parquet(f"{out}/orders")
    tables["orders"].limit(3).write.parquet(f"{out}/orders/_temporary/0")
    return out


def _resumed(spark: SparkSession, sf: str) -> str:
    out = crashed(spark, sf)
    run(spark, _tables(spark, sf), SPECS, _CONFIG, CTX, out, run_id="run-2", resume=True)
    return out


@query(
    "run_resumed_after_crash",
    f"""SELECT 'customer' AS table_id, c_custkey AS id, c_nationkey AS ref, {g.fake('full_name', 'c_name', 'customer.c_name', unique=True)} AS masked FROM customer
        UNION ALL SELECT 'orders', o_orderkey, o_custkey, {g.fake('company', 'o_orderpriority', 'orders.o_orderpriority')} FROM orders
        UNION ALL SELECT 'nation', n_nationkey, n_regionkey, {g.fake('country', 'n_name', 'nation.n_name')} FROM nation""",
)
def run_resumed_after_crash(spark: SparkSession, sf: str) -> DataFrame:
    """Every row of every table once, as if the run had never died."""
    out = _resumed(spark, sf)
    parts = {"customer": ("c_custkey", "c_nationkey", "c_name"), "orders": ("o_orderkey", "o_custkey", "o_orderpriority"),
             "nation": ("n_nationkey", "n_regionkey", "n_name")}
    frames = [
        read_table(spark, f"{out}/{t}").select(F.lit(t).alias("table_id"), F.col(k).cast("long").alias("id"), F.col(r).cast("long").alias("ref"), F.col(v).alias("masked"))
        for t, (k, r, v) in parts.items()
    ]
    return frames[0].unionAll(frames[1]).unionAll(frames[2])


@query(
    "run_audit_across_resume",
    """SELECT 'column.masked' AS event_type, 'customer' AS table_id, c AS column_name, a AS action, count(*) AS cells_seen, count(*) AS cells_changed
        FROM customer, (VALUES ('c_name', 'fake'), ('c_mktsegment', 'hash')) v(c, a) GROUP BY c, a
       UNION ALL SELECT 'column.passed_through', 'customer', c, 'passthrough', count(*), 0 FROM customer, (VALUES ('c_custkey'), ('c_nationkey'), ('c_acctbal')) v(c) GROUP BY c
       UNION ALL SELECT 'column.masked', 'orders', 'o_orderpriority', 'fake', count(*), count(*) FROM orders
       UNION ALL SELECT 'column.passed_through', 'orders', c, 'passthrough', count(*), 0 FROM orders, (VALUES ('o_orderkey'), ('o_custkey'), ('o_orderstatus'), ('o_totalprice'), ('o_orderdate')) v(c) GROUP BY c
       UNION ALL SELECT 'column.masked', 'nation', 'n_name', 'fake', count(*), count(*) FROM nation
       UNION ALL SELECT 'column.passed_through', 'nation', c, 'passthrough', count(*), 0 FROM nation, (VALUES ('n_nationkey'), ('n_regionkey')) v(c) GROUP BY c""",
)
def run_audit_across_resume(spark: SparkSession, sf: str) -> DataFrame:
    """Cells counted before the crash and after it add up to those of a whole run."""
    return audit_of_tables(spark, _resumed(spark, sf))


# What a run reports --------------------------------------------------------------------------

_EVENT_SPECS = {
    "app.people": TableSpec("app.people", pk=("id",), uniques=(("email",),)),
    "app.invoices": TableSpec("app.invoices", pk=("o_orderkey",)), "app.clicks": TableSpec("app.clicks", pk=("event_key",)),
}
_EVENT_CONFIG = RunConfig(
    rules={"app.people": {"phone": Hash()}}, on_existing_data="drop_create", implied_fk_ignore=("app.invoices.ship_email",)
)


def _event_inputs(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    mail = F.concat(F.lit("customer#"), F.col("o_custkey").cast("string"), F.lit("@example.test"))
    invoices = table(spark, sf, "orders").select("o_orderkey", mail.alias("billing_email"), mail.alias("ship_email"))
    clicks = table(spark, sf, "events").select(
        F.col("event_id").alias("event_key"), F.col("event_type").alias("subject_type"), F.col("user_id").alias("subject_id")
    )
    return {"app.people": people(spark, sf).select("id", "email", "phone"), "app.invoices": invoices, "app.clicks": clicks}


@query(
    "run_events",
    """SELECT run_id, level, event_type, table_id, column_name, status, rows, count(*) AS events FROM (
        SELECT 'run-2' AS run_id, 'info' AS level, 'run.started' AS event_type, NULL AS table_id, NULL AS column_name, 'in_progress' AS status, NULL::BIGINT AS rows
        UNION ALL SELECT 'run-2', 'info', 'run.succeeded', NULL, NULL, 'succeeded', NULL
        UNION ALL SELECT 'run-2', 'warning', 'implied_fk_warning', 'app.invoices', 'billing_email', NULL, NULL
        UNION ALL SELECT 'run-2', 'warning', 'polymorphic_fk_warning', 'app.clicks', 'subject_id', NULL, NULL
        UNION ALL SELECT 'run-2', 'info', 'new_table', 'app.clicks', NULL, NULL, NULL
        UNION ALL SELECT 'run-2', 'info', 'column.pii_detected', t, c, NULL, NULL FROM (VALUES
          ('app.people', 'id'), ('app.people', 'email'), ('app.people', 'phone'), ('app.invoices', 'o_orderkey'),
          ('app.invoices', 'billing_email'), ('app.invoices', 'ship_email'), ('app.clicks', 'event_key'),
          ('app.clicks', 'subject_type'), ('app.clicks', 'subject_id')) v(t, c)
        UNION ALL SELECT 'run-2', 'info', 'table.' || s, t, NULL, CASE s WHEN 'started' THEN 'in_progress' ELSE s END, CASE WHEN s = 'done' THEN n END
          FROM (SELECT 'app.people' AS t, count(*) AS n FROM customer UNION ALL SELECT 'app.invoices', count(*) FROM orders
                UNION ALL SELECT 'app.clicks', count(*) FROM events), (VALUES ('pending'), ('started'), ('done')) v(s)) GROUP BY ALL""",
)
def events_of_a_run(spark: SparkSession, sf: str) -> DataFrame:
    """The second run over a folder knows one table more than the first."""
    out = run_dir(spark, "events")
    tables = _event_inputs(spark, sf)
    first = {n: df for n, df in tables.items() if n != "app.clicks"}
    run(spark, first, _EVENT_SPECS, _EVENT_CONFIG, CTX, out, run_id="run-1")
    run(spark, tables, _EVENT_SPECS, _EVENT_CONFIG, CTX, out, run_id="run-2")
    return run_events(spark, out, "run-2").groupBy(
        "run_id", "level", "event_type", "table_id", "column_name", "status", "rows"
    ).agg(F.count("*").alias("events"))


@query(
    "run_status_after_crash",
    """SELECT 'run-1' AS run_id, NULL AS table_id, 'failed' AS status, NULL::BIGINT AS rows
       UNION ALL SELECT 'run-1', 'customer', 'done', count(*) FROM customer UNION ALL SELECT 'run-1', 'orders', 'failed', NULL
       UNION ALL SELECT 'run-2', NULL, 'succeeded', NULL UNION ALL SELECT 'run-2', 'customer', 'done', count(*) FROM customer
       UNION ALL SELECT 'run-2', 'orders', 'done', count(*) FROM orders UNION ALL SELECT 'run-2', 'nation', 'done', count(*) FROM nation""",
)
def run_status_after_crash(spark: SparkSession, sf: str) -> DataFrame:
    return latest_status(run_events(spark, _resumed(spark, sf)))


@query(
    "run_summary_from_run",
    f"""WITH {PEOPLE_SQL}, w AS (
        SELECT 'app.people' AS table_id, count(*) AS n, avg(octet_length(encode(id::VARCHAR))) + avg(octet_length(encode(email))) + avg(octet_length(encode(phone))) AS w FROM people)
        SELECT 'run-1' AS run_id, table_id, 1 AS attempts, n AS rows, floor(w * n)::BIGINT AS bytes, 'done' AS status,
          '{CTX.salt_fingerprint}' AS salt_fingerprint, '{audit.rules_hash({"app.people": _EVENT_CONFIG.rules["app.people"]})}' AS rules_hash FROM w""",
)
def run_summary_from_run(spark: SparkSession, sf: str) -> DataFrame:
    out = run_dir(spark, "summary")
    source = people(spark, sf).select("id", "email", "phone")
    config = RunConfig(rules=_EVENT_CONFIG.rules, auto_detect=False)
    run(spark, {"app.people": source}, _EVENT_SPECS, config, CTX, out, run_id="run-1")
    return summary_of_run(spark, out, "run-1", profile.profile(source, "app.people")).drop("last_attempt")

"""Queries over readers, writers, streaming sinks and whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import sqlgen as g
from checks.inputs import PEOPLE_SQL, SPECS, people, star, table
from checks.registry import query
from maskframe import Fake, Hash, Null, mask_table
from maskframe.operators.verify import diff_runs
from maskframe.plans import RunConfig, run, verify_run
from maskframe.session import run_dir
from maskframe.sources import (
    apply_strategy, copy_passthrough, dual_write, range_predicates, read_after, read_files, read_table, row_filter,
    sink_stats, write_files, write_table,
)
from maskframe.sources.synth import BIO_FACTORS, customer_columns
from maskframe.streaming import foreach_batch_sink, mask_stream, read_stream, write_available

CTX = g.CTX
W = "WITH " + PEOPLE_SQL


@query("read_table", "SELECT * FROM orders")
def whole_table(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, f"{sf}/orders.parquet")


@query("read_after", "SELECT * FROM events WHERE event_id > 300")
def after_cursor(spark: SparkSession, sf: str) -> DataFrame:
    return read_after(table(spark, sf, "events"), "event_id", 300)


@query("read_after_slice", "SELECT * FROM orders WHERE o_orderkey > 250 ORDER BY o_orderkey LIMIT 1000")
def after_cursor_slice(spark: SparkSession, sf: str) -> DataFrame:
    """One keyset batch: the batch size is the operator's own parameter."""
    return read_after(table(spark, sf, "orders"), "o_orderkey", 250, 1000)


@query(
    "read_after_composite",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM lineitem
       WHERE l_orderkey > 300 OR (l_orderkey = 300 AND l_linenumber > 2)""",
)
def after_composite_cursor(spark: SparkSession, sf: str) -> DataFrame:
    after = read_after(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], (300, 2))
    return after.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")


_CUTS = [("A", 40), ("N", 20), ("N", 300), ("R", 1)]


@query(
    "read_key_ranges",
    """SELECT CASE WHEN l_returnflag < 'A' OR (l_returnflag = 'A' AND l_partkey < 40) THEN 0
                WHEN l_returnflag < 'N' OR (l_returnflag = 'N' AND l_partkey < 20) THEN 1
                WHEN l_returnflag = 'N' AND l_partkey < 300 THEN 2
                WHEN l_returnflag < 'R' OR (l_returnflag = 'R' AND l_partkey < 1) THEN 3 ELSE 4 END AS range_no,
              l_returnflag, l_partkey, l_orderkey, l_linenumber FROM lineitem""",
)
def key_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The whole table, range by range of a key of a text and a number, as a database would be asked."""
    lineitem, out = table(spark, sf, "lineitem"), None
    for i, predicate in enumerate(range_predicates(["l_returnflag", "l_partkey"], _CUTS, quote="`")):
        part = row_filter(lineitem, predicate).select(
            F.lit(i).alias("range_no"), "l_returnflag", "l_partkey", "l_orderkey", "l_linenumber"
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "row_filter",
    "SELECT * FROM lineitem WHERE (l_quantity > 10 OR l_discount = 0.0) AND (l_returnflag = 'R') AND (l_tax < 0.05)",
)
def filtered(spark: SparkSession, sf: str) -> DataFrame:
    return row_filter(
        table(spark, sf, "lineitem"), "l_quantity > 10 OR l_discount = 0.0", None, "l_returnflag = 'R'", F.col("l_tax") < 0.05
    )


@query("copy_passthrough", "SELECT * FROM part")
def copied(spark: SparkSession, sf: str) -> DataFrame:
    out = run_dir(spark, "copy")
    copy_passthrough(spark, f"{sf}/part.parquet", out)
    return read_table(spark, out)


@query("write_table", "SELECT * FROM supplier")
def written(spark: SparkSession, sf: str) -> DataFrame:
    """The second write replaces the first one under the truncate policy."""
    out = run_dir(spark, "write")
    supplier = table(spark, sf, "supplier")
    write_table(supplier.where("s_acctbal > 0"), out)
    write_table(supplier, out, policy="truncate")
    return read_table(spark, out)


@query("write_table_partitioned", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def written_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    out = run_dir(spark, "write-partitioned")
    write_table(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), out, partition_by=["o_orderstatus"])
    return read_table(spark, out)


@query(
    "apply_strategy",
    """SELECT 'orders' AS table_id, count(*) AS n_rows FROM orders UNION ALL SELECT 'customer', 0
       UNION ALL SELECT 'part', 0 UNION ALL SELECT 'supplier', count(*) FROM supplier""",
)
def strategies(spark: SparkSession, sf: str) -> DataFrame:
    kept = apply_strategy(
        star(spark, sf, "orders", "customer", "part", "region", "supplier"),
        {"customer": "empty", "part": "truncate", "region": "exclude", "orders": "transform"},
    )
    out = None
    for name, df in kept.items():
        part = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_id"), "n_rows")
        out = part if out is None else out.unionAll(part)
    return out


_RENAMED_SQL = "SELECT o_orderkey AS id, o_custkey AS customer_id, o_totalprice AS total, o_orderpriority AS priority FROM orders"


@query("read_files_csv", _RENAMED_SQL)
def from_csv(spark: SparkSession, sf: str) -> DataFrame:
    out = run_dir(spark, "csv")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    orders.write.csv(out, header=True)
    names = {"o_orderkey": "id", "o_custkey": "customer_id", "o_totalprice": "total", "o_orderpriority": "priority"}
    schema = "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string"
    return read_files(spark, out, "csv", schema=schema, rename=names)


@query("read_files_jsonl", "SELECT conv_id, turn, role, text FROM conversations")
def from_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    out = run_dir(spark, "jsonl")
    conversations = table(spark, sf, "conversations")
    conversations.write.json(out)
    return read_files(spark, out, "jsonl", schema=conversations.schema).select("conv_id", "turn", "role", "text")


@query("read_files_parquet", "SELECT page_id AS id, url FROM pages")
def from_parquet(spark: SparkSession, sf: str) -> DataFrame:
    return read_files(spark, f"{sf}/pages.parquet", "parquet", rename={"page_id": "id"}).select("id", "url")


_MASKED_PEOPLE_SQL = f"""{W} SELECT id, {g.fake('email', 'email', 'app.people.email')} AS email,
    {g.salted_hash('phone')} AS phone, nation_id FROM people"""


def _masked_people(spark: SparkSession, sf: str) -> DataFrame:
    df = people(spark, sf).select("id", "email", "phone", "nation_id")
    return mask_table(df, {"email": Fake("email"), "phone": Hash()}, CTX, table="app.people")


@query("write_files_jsonl", _MASKED_PEOPLE_SQL)
def export_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    out = run_dir(spark, "export-jsonl")
    masked = _masked_people(spark, sf)
    write_files(masked, out, "jsonl", key=["id"])
    return read_files(spark, out, "jsonl", schema=masked.schema)


@query("write_files_parquet", _MASKED_PEOPLE_SQL)
def export_parquet(spark: SparkSession, sf: str) -> DataFrame:
    out = run_dir(spark, "export-parquet")
    write_files(_masked_people(spark, sf), out, "parquet", key=["id"])
    return read_files(spark, out, "parquet")


@query("dual_write", "SELECT 'app.people' AS table_id, 'jsonl' AS sink_format, count(*) AS rows, 0 AS differing FROM customer")
def dual(spark: SparkSession, sf: str) -> DataFrame:
    """Both targets hold the same rows."""
    out = run_dir(spark, "dual")
    masked = _masked_people(spark, sf)
    first = dual_write(masked, f"{out}/table", f"{out}/export")
    second = read_files(spark, f"{out}/export", "jsonl", schema=masked.schema)
    differing = diff_runs(first, second).agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("differing"))
    stats = sink_stats(second, "app.people", "jsonl")
    return stats.select("*", F.lit(0).alias("differing")).unionByName(
        differing.select(F.lit(None).alias("table_id"), F.lit(None).alias("sink_format"), F.lit(0).alias("rows"), "differing")
    ).agg(
        F.max("table_id").alias("table_id"), F.max("sink_format").alias("sink_format"),
        F.sum("rows").alias("rows"), F.sum("differing").alias("differing"),
    )


@query(
    "synth_customers",
    f"""SELECT l_orderkey AS id, l_orderkey % 100 + 1 AS org_id, 'customer' || l_orderkey || '@example.test' AS email,
        'Customer Number ' || l_orderkey AS full_name, lpad((l_orderkey % 1000000000)::VARCHAR, 9, '0') AS ssn,
        md5({' || '.join(f"md5((l_orderkey * {k})::VARCHAR)" for k in BIO_FACTORS)}) AS bio_digest FROM lineitem""",
)
def synthetic(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(*customer_columns(F.col("l_orderkey"), 100))
    return rows.withColumn("bio_digest", F.md5(F.col("bio").cast("binary"))).drop("bio")


# Streaming ----------------------------------------------------------------------------------

_EVENT_RULES = {"user_id": Null(when="event_type = 'signup'"), "event_type": Fake("company"), "props": Hash()}
_EVENTS_SQL = f"""SELECT event_id, CASE WHEN event_type = 'signup' THEN NULL ELSE user_id END AS user_id,
    {g.fake('company', 'event_type', 'events.event_type')} AS event_type, {g.salted_hash('props')} AS props, value FROM events"""


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    # A pattern, because a streaming source path must not name a single file.
    stream = read_stream(spark, f"{sf}/events.parque[t]", schema)
    masked = mask_stream(stream, _EVENT_RULES, CTX, table="events")
    return masked.select("event_id", "user_id", "event_type", "props", "value")


@query("mask_stream", _EVENTS_SQL)
def streamed(spark: SparkSession, sf: str) -> DataFrame:
    out = run_dir(spark, "stream")
    write_available(_event_stream(spark, sf), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return read_table(spark, f"{out}/rows")


@query("foreach_batch_sink", _EVENTS_SQL)
def batch_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Started twice on the same checkpoint: the second run finds nothing left to do."""
    out = run_dir(spark, "batches")
    for _ in range(2):
        foreach_batch_sink(
            _event_stream(spark, sf), out, f"{out}/checkpoint", table="events", run_id="run-1", cursor="event_id"
        ).awaitTermination()
    return read_table(spark, f"{out}/rows").drop("batch_id")


@query(
    "foreach_batch_progress",
    """SELECT 'run-1' AS run_id, 'events' AS table_id, count(*) AS rows, max(event_id)::VARCHAR AS cursor, 'in_progress' AS status, 0 AS batch_id FROM events""",
)
def batch_progress(spark: SparkSession, sf: str) -> DataFrame:
    out = run_dir(spark, "progress")
    foreach_batch_sink(
        _event_stream(spark, sf), out, f"{out}/checkpoint", table="events", run_id="run-1", cursor="event_id"
    ).awaitTermination()
    return read_table(spark, f"{out}/progress")


# Whole runs ---------------------------------------------------------------------------------

_RUN_DOCUMENT = {
    "version": "1.0", "on_existing_data": "drop_create", "auto_detect": False,
    "tables": {
        "customer": {"columns": {"c_name": {"action": "fake", "provider": "full_name"}, "c_mktsegment": {"action": "hash"}}},
        "orders": {"columns": {"o_orderpriority": {"action": "fake", "provider": "company"}}, "null_orphan_fks": True},
        "nation": {"strategy": "empty"}, "region": {"strategy": "exclude"},
    },
}


def _run(spark: SparkSession, sf: str):
    tables = star(spark, sf, "customer", "orders", "nation", "region")
    config = RunConfig.from_dict(_RUN_DOCUMENT)
    return tables, config, run(spark, tables, SPECS, config, CTX, run_dir(spark, "run"), run_id="run-1")


@query(
    "run_masked_orders",
    f"SELECT o_orderkey, o_custkey, {g.fake('company', 'o_orderpriority', 'orders.o_orderpriority')} AS o_orderpriority FROM orders",
)
def run_masked_orders(spark: SparkSession, sf: str) -> DataFrame:
    _, _, result = _run(spark, sf)
    return read_table(spark, result.paths["orders"]).select("o_orderkey", "o_custkey", "o_orderpriority")


@query(
    "run_audit",
    """SELECT 'column.masked' AS event_type, 'customer' AS table_id, c AS column_name, a AS action, count(*) AS cells_seen, count(*) AS cells_changed
        FROM customer, (VALUES ('c_name', 'fake'), ('c_mktsegment', 'hash')) v(c, a) GROUP BY c, a
       UNION ALL SELECT 'column.passed_through', 'customer', c, 'passthrough', count(*), 0 FROM customer, (VALUES ('c_custkey'), ('c_nationkey'), ('c_acctbal')) v(c) GROUP BY c
       UNION ALL SELECT 'column.masked', 'orders', 'o_orderpriority', 'fake', count(*), count(*) FROM orders
       UNION ALL SELECT 'column.passed_through', 'orders', c, 'passthrough', count(*), 0 FROM orders, (VALUES ('o_orderkey'), ('o_custkey'), ('o_orderstatus'), ('o_totalprice'), ('o_orderdate')) v(c) GROUP BY c
       UNION ALL SELECT 'column.passed_through', 'nation', c, 'passthrough', 0, 0 FROM (VALUES ('n_nationkey'), ('n_name'), ('n_regionkey')) v(c)""",
)
def run_audit(spark: SparkSession, sf: str) -> DataFrame:
    _, _, result = _run(spark, sf)
    return read_table(spark, result.audit_path)


@query(
    "run_verified",
    """SELECT "check", verdict, count(*) AS checks FROM (VALUES ('table.row_count', 'pass'), ('table.row_count', 'pass'),
        ('table.uniqueness', 'pass'), ('table.uniqueness', 'pass'), ('table.uniqueness', 'pass'),
        ('table.fk_integrity', 'pass'), ('table.fk_integrity', 'fail'),
        ('column.change_rate', 'pass'), ('column.change_rate', 'pass'), ('column.change_rate', 'pass'),
        ('column.passthrough_drift', 'pass'), ('column.passthrough_drift', 'pass'), ('column.passthrough_drift', 'pass'),
        ('column.passthrough_drift', 'pass'), ('column.passthrough_drift', 'pass'), ('column.passthrough_drift', 'pass'),
        ('column.passthrough_drift', 'pass'), ('column.passthrough_drift', 'pass')) v("check", verdict) GROUP BY ALL""",
)
def run_verified(spark: SparkSession, sf: str) -> DataFrame:
    """Customers keep their nation keys although nations are emptied, hence the one failure."""
    tables, config, result = _run(spark, sf)
    report = verify_run(spark, tables, result, SPECS, config, sample=None)
    return report.groupBy("check", "verdict").agg(F.count("*").alias("checks"))

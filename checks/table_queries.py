"""Queries over profiling, detection, verification, referential and audit operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import sqlgen as g
from checks.inputs import PEOPLE_SQL, SPECS, people, star, table
from checks.masking_queries import NER_PATTERNS, ner_sql
from checks.registry import query
from maskframe import Fake, ForeignKey, Hash, Null, Static, TableSpec, mask_table, mask_tables
from maskframe.operators import audit, detect, drift, profile, references, referential, verify
from maskframe.operators.ner import pattern_finder, phrase_finder

CTX = g.CTX
W = "WITH " + PEOPLE_SQL


def _stats_sql(source: str, table_id: str, columns: dict[str, str]) -> str:
    """One profile row per column; ``columns`` maps name to reported type."""
    parts = [
        f"""SELECT '{table_id}' AS table_id, '{c}' AS column_name, '{t}' AS data_type, count(*) AS n_rows,
            count(*) FILTER (WHERE "{c}" IS NULL) AS nulls, count(DISTINCT "{c}") AS n_distinct,
            round(avg(octet_length(encode("{c}"::VARCHAR))), 6) AS avg_width,
            max(length("{c}"::VARCHAR)) AS max_length FROM {source}"""
        for c, t in columns.items()
    ]
    return " UNION ALL ".join(parts)


_ORDER_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_orderpriority": "string"}
_DOC_TYPES = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
_LINE_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_returnflag": "string", "l_linestatus": "string",
}


def _rounded(stats: DataFrame) -> DataFrame:
    return stats.withColumn("avg_width", F.round("avg_width", 6))


@query(
    "profile_exact",
    " UNION ALL ".join([
        _stats_sql("orders", "orders", _ORDER_TYPES), _stats_sql("documents", "documents", _DOC_TYPES),
        _stats_sql("lineitem", "lineitem", _LINE_TYPES),
    ]),
)
def profile_exact(spark: SparkSession, sf: str) -> DataFrame:
    frames = {
        "orders": table(spark, sf, "orders").select(*_ORDER_TYPES),
        "documents": table(spark, sf, "documents").select(*_DOC_TYPES),
        "lineitem": table(spark, sf, "lineitem").select(*_LINE_TYPES),
    }
    return _rounded(profile.profile_tables(frames, exact_distinct=True))


@query("profile_people", f"""{W}, base AS (SELECT id, email, dob, nickname FROM people)
    {_stats_sql('base', 'app.people', {'id': 'bigint', 'email': 'string', 'dob': 'string', 'nickname': 'string'})}""")
def profile_people(spark: SparkSession, sf: str) -> DataFrame:
    df = people(spark, sf).select("id", "email", "dob", "nickname")
    return _rounded(profile.profile(df, "app.people", exact_distinct=True))


_ALL_COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props", "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label", "pages": "page_id url html", "benchmark": "item_id text",
    "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}


@query(
    "profile_approximate",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_id, '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER (WHERE \"{c}\" IS NULL) AS nulls, true AS distinct_is_close FROM {t}"
        for t, cols in _ALL_COLUMNS.items() for c in cols.split()
    ),
)
def profile_approximate(spark: SparkSession, sf: str) -> DataFrame:
    """All tables; the sketched distinct counts must lie within a quarter of the exact ones."""
    frames = {t: table(spark, sf, t).select(*cols.split()) for t, cols in _ALL_COLUMNS.items()}
    exact = profile.profile_tables(frames, exact_distinct=True).select("table_id", "column_name", F.col("n_distinct").alias("exact"))
    close = F.abs(F.col("n_distinct") - F.col("exact")) * 4 <= F.col("exact")
    return profile.profile_tables(frames).join(exact, ["table_id", "column_name"]).select(
        "table_id", "column_name", "n_rows", "nulls", close.alias("distinct_is_close")
    )


_MERGED = {"orders": "o_orderstatus", "lineitem": "l_returnflag", "documents": "lang"}


@query(
    "profile_merged",
    "SELECT * EXCLUDE (n_distinct), true AS distinct_is_close FROM (" + " UNION ALL ".join([
        _stats_sql("orders", "orders", _ORDER_TYPES), _stats_sql("documents", "documents", _DOC_TYPES),
        _stats_sql("lineitem", "lineitem", _LINE_TYPES),
    ]) + ")",
)
def profile_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Tables profiled in two parts each, whose states are merged without another scan."""
    whole, merged = {}, []
    for name, types in {"orders": _ORDER_TYPES, "documents": _DOC_TYPES, "lineitem": _LINE_TYPES}.items():
        whole[name] = df = table(spark, sf, name).select(*types)
        first = F.coalesce(F.col(_MERGED[name]).isin("F", "R", "en"), F.lit(False))
        merged += [profile.profile_state(df.where(first), name), profile.profile_state(df.where(~first), name)]
    exact = profile.profile_tables(whole, exact_distinct=True).select("table_id", "column_name", F.col("n_distinct").alias("exact"))
    close = F.abs(F.col("n_distinct") - F.col("exact")) * 10 <= F.col("exact")
    out = _rounded(profile.profile_of(profile.merge_profiles(*merged))).join(exact, ["table_id", "column_name"])
    return out.withColumn("distinct_is_close", close).drop("n_distinct", "exact")


@query(
    "value_evidence",
    f"""{W}, masked AS (SELECT id, email, phone, ssn, dob,
        {g.fake('credit_card', 'name', 'app.people.card')} AS card, {g.fake('ip_address', 'name', 'app.people.ip')} AS ip,
        {g.salted_hash('name')} AS token FROM people)
      """ + " UNION ALL ".join(
        f"""SELECT 'app.people' AS table_id, '{c}' AS column_name, count(*) FILTER ({c} <> '') AS n_values,
          count(*) FILTER (regexp_full_match({c}, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+')) AS email,
          count(*) FILTER (regexp_full_match({c}, '\\+[0-9]{{11,13}}')) AS phone,
          count(*) FILTER (regexp_full_match({c}, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}')) AS ssn,
          count(*) FILTER (regexp_full_match({c}, '[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}')) AS ip_address,
          count(*) FILTER (regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) AS dob,
          count(*) FILTER (regexp_full_match({c}, '[0-9a-f]{{64}}')) AS hash,
          count(*) FILTER (regexp_full_match({c}, '[0-9]{{15,16}}')) AS credit_card FROM masked"""
        for c in ("email", "phone", "ssn", "dob", "card", "ip", "token")
    ),
)
def value_evidence(spark: SparkSession, sf: str) -> DataFrame:
    df = people(spark, sf).select(
        "id", "email", "phone", "ssn", "dob", F.col("name").alias("card"), F.col("name").alias("ip"), F.col("name").alias("token")
    )
    rules = {"card": Fake("credit_card"), "ip": Fake("ip_address"), "token": Hash()}
    return profile.value_evidence(mask_table(df, rules, CTX, table="app.people"), "app.people")


def _detection_inputs(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The given tables under column names an application would use."""
    documents = table(spark, sf, "documents")
    return {
        "app.customers": people(spark, sf).select(
            "id", "email", F.col("phone").alias("home_phone"), F.col("ssn").alias("tax_id"),
            F.col("dob").cast("string").alias("birth_date"), F.col("name").alias("full_name"),
            F.col("nickname").alias("notes"), F.col("nation_id").alias("country_id"), F.lit("k").alias("session_token"),
        ),
        "app.products": documents.select(F.col("doc_id").alias("id"), F.col("text").alias("description"), F.col("lang").alias("about_lang")),
        "app.tickets": documents.select(F.col("doc_id").alias("id"), F.col("text").alias("comment_body"), F.col("source").alias("bio")),
        "app.pages": table(spark, sf, "pages").select("page_id", F.col("html").alias("note_html"), F.col("url").alias("ip")),
        "app.secrets": table(spark, sf, "supplier").select(F.col("s_name").alias("password")),
    }


_DETECTION_SPECS = {
    "app.customers": TableSpec("app.customers", pk=("id",), types={"session_token": "uuid"}),
    "app.pages": TableSpec("app.pages", types={"ip": "inet"}),
}
_DETECTION_RULES = {"app.customers": {"full_name": Static("x")}}


def _free_text_sql(table_id: str, column: str, pattern: str, source: str, expr: str) -> str:
    """Findings for a free-text match, with the thresholds applied to the measured width."""
    name = table_id.split(".")[1]
    context = "sensitive" if name in ("customers", "tickets") else "low" if name == "products" else "neutral"
    wide = {
        "sensitive": ("high", "table name speaks for it"), "neutral": ("high", None),
        "low": ("medium", "table name speaks against it"),
    }[context]
    middle = "medium" if context == "sensitive" else "low"
    middle_note = "short text, but the table name speaks for it" if context == "sensitive" else "text too short for prose"
    wide_note = f" || '; {wide[1]}'" if wide[1] else ""
    action = "'ner_mask'" if wide[0] == "high" else "NULL"
    return f"""SELECT '{table_id}' AS table_id, '{column}' AS column_name,
        CASE WHEN w >= 200 THEN '{wide[0]}' WHEN w >= 100 THEN '{middle}' ELSE 'low' END AS confidence,
        'matched pattern {pattern}; column can hold prose; mean bytes ' || round_even(w, 0)::BIGINT::VARCHAR ||
          CASE WHEN w >= 200 THEN ''{wide_note} WHEN w >= 100 THEN '; {middle_note}' ELSE '; text too short for prose' END AS reasons,
        CASE WHEN w >= 200 THEN {action} END AS action, NULL AS provider, '{pattern}' AS matched_pattern, 'autodetect' AS source
        FROM (SELECT avg(octet_length(encode({expr}))) AS w FROM {source})"""


def _fixed_finding_sql(*values: str | None) -> str:
    names = ("table_id", "column_name", "confidence", "reasons", "action", "provider", "matched_pattern", "source")
    return "SELECT " + ", ".join(
        f"{'NULL' if v is None else g.lit(v)} AS {n}" for n, v in zip(names, values, strict=True)
    )


_FINDINGS_SQL = f"{W} " + " UNION ALL ".join([
    _fixed_finding_sql("app.customers", "id", "low", "no pattern match", None, None, None, "autodetect"),
    _fixed_finding_sql("app.customers", "email", "high", "matched pattern email", "fake", "email", "email", "autodetect"),
    _fixed_finding_sql("app.customers", "home_phone", "high", "matched pattern phone", "fake", "phone", "phone", "autodetect"),
    _fixed_finding_sql("app.customers", "tax_id", "high", "matched pattern tax_id", "fake", "ssn", "tax_id", "autodetect"),
    _fixed_finding_sql("app.customers", "birth_date", "high", "matched pattern birth_date", "fake", "dob", "birth_date", "autodetect"),
    _fixed_finding_sql("app.customers", "full_name", "high", "explicit config", "static", None, None, "config"),
    _free_text_sql("app.customers", "notes", "notes_substring", "people", "nickname"),
    _fixed_finding_sql("app.customers", "country_id", "low", "matched pattern country; action fake incompatible with type int", None, None, "country", "autodetect"),
    _fixed_finding_sql("app.customers", "session_token", "high", "matched pattern token", "fake", "uuid", "token", "autodetect"),
    _fixed_finding_sql("app.products", "id", "low", "no pattern match", None, None, None, "autodetect"),
    _free_text_sql("app.products", "description", "description", "documents", "text"),
    _free_text_sql("app.products", "about_lang", "about", "documents", "lang"),
    _fixed_finding_sql("app.tickets", "id", "low", "no pattern match", None, None, None, "autodetect"),
    _free_text_sql("app.tickets", "comment_body", "comments", "documents", "text"),
    _free_text_sql("app.tickets", "bio", "bio", "documents", "source"),
    _fixed_finding_sql("app.pages", "page_id", "low", "no pattern match", None, None, None, "autodetect"),
    _free_text_sql("app.pages", "note_html", "notes", "pages", "html"),
    _fixed_finding_sql("app.pages", "ip", "high", "matched pattern ip_exact", "fake", "ip_address", "ip_exact", "autodetect"),
    _fixed_finding_sql("app.secrets", "password", "high", "matched pattern password", "static", None, "password", "autodetect"),
])


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    return detect.detect_pii(_detection_inputs(spark, sf), _DETECTION_RULES, specs=_DETECTION_SPECS)


@query("detect_pii", _FINDINGS_SQL)
def detect_pii(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(spark, sf).withColumn("reasons", F.concat_ws("; ", "reasons"))


@query(
    "detection_summary",
    f"""WITH f AS ({_FINDINGS_SQL}) SELECT table_id,
        coalesce(string_agg(column_name, ',' ORDER BY column_name) FILTER (action IS NOT NULL AND source = 'autodetect'), '') AS masked,
        coalesce(string_agg(column_name, ',' ORDER BY column_name) FILTER (source = 'config'), '') AS explicit,
        coalesce(string_agg(column_name, ',' ORDER BY column_name) FILTER (confidence = 'medium'), '') AS uncertain,
        coalesce(string_agg(column_name, ',' ORDER BY column_name) FILTER (action IS NULL AND confidence <> 'medium'), '') AS passthrough
        FROM f GROUP BY table_id""",
)
def detection_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = detect.detection_summary(_findings(spark, sf))
    return out.select("table_id", *[F.concat_ws(",", c).alias(c) for c in ("masked", "explicit", "uncertain", "passthrough")])


@query(
    "uncovered_columns",
    f"""SELECT table_id, column_name, confidence, matched_pattern FROM ({_FINDINGS_SQL})
        WHERE confidence IN ('high', 'medium') AND matched_pattern IS NOT NULL""",
)
def uncovered_columns(spark: SparkSession, sf: str) -> DataFrame:
    return detect.uncovered_columns(_findings(spark, sf))


@query(
    "auto_mask",
    f"""{W} SELECT id, {g.fake('email', 'email', 'app.customers.email')} AS email,
        {g.fake('phone', 'phone', 'app.customers.home_phone')} AS home_phone,
        {g.fake('ssn', 'ssn', 'app.customers.tax_id')} AS tax_id, {g.fake('dob', 'dob', 'app.customers.birth_date')} AS birth_date,
        'x' AS full_name, nickname AS notes, nation_id AS country_id,
        {g.fake('uuid', "'k'", 'app.customers.session_token')} AS session_token FROM people""",
)
def auto_mask(spark: SparkSession, sf: str) -> DataFrame:
    masked = detect.auto_mask(
        _detection_inputs(spark, sf), CTX, _DETECTION_RULES, specs=_DETECTION_SPECS,
        finder=phrase_finder({"Ada Lovelace": "PERSON"}),
    )
    return masked["app.customers"]


def _cells_sql(table_id: str, key: str, source: str, cells: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table_id}' AS table_id, {key}::VARCHAR AS row_key, '{name}' AS column_name, ({value})::VARCHAR AS value FROM {source}"
        for name, value in cells.items()
    )


@query(
    "auto_mask_tables",
    f"{W}, " + ", ".join([
        f"tickets AS ({ner_sql('documents', 'doc_id', 'text', 'app.tickets.comment_body')})",
        f"noted AS ({ner_sql('pages', 'page_id', 'html', 'app.pages.note_html')}) ",
    ]) + " UNION ALL ".join([
        _cells_sql("app.customers", "id", "people", {
            "email": g.fake("email", "email", "app.customers.email"), "home_phone": g.fake("phone", "phone", "app.customers.home_phone"),
            "tax_id": g.fake("ssn", "ssn", "app.customers.tax_id"), "birth_date": g.fake("dob", "dob", "app.customers.birth_date"),
            "full_name": "'x'", "notes": "nickname", "country_id": "nation_id",
            "session_token": g.fake("uuid", "'k'", "app.customers.session_token"),
        }),
        _cells_sql("app.products", "doc_id", "documents", {"description": "text", "about_lang": "lang"}),
        _cells_sql("app.tickets", "doc_id", "tickets", {"comment_body": "text"}),
        _cells_sql("app.tickets", "doc_id", "documents", {"bio": "source"}),
        _cells_sql("app.pages", "page_id", "noted", {"note_html": "html"}),
        _cells_sql("app.pages", "page_id", "pages", {"ip": g.fake("ip_address", "url", "app.pages.ip")}),
        _cells_sql("app.secrets", "NULL", "supplier", {"password": g.lit(CTX.password)}),
    ]),
)
def auto_mask_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Every cell of all five tables that detection decided about, masked or passed through."""
    masked = detect.auto_mask(
        _detection_inputs(spark, sf), CTX, _DETECTION_RULES, specs=_DETECTION_SPECS, finder=pattern_finder(NER_PATTERNS)
    )
    out = None
    for name, df in masked.items():
        keys = [c for c in df.columns if c in ("id", "page_id")]
        cells = [
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in df.columns if c not in keys
        ]
        row_key = F.col(keys[0]) if keys else F.lit(None)
        part = df.select(
            F.lit(name).alias("table_id"), row_key.cast("string").alias("row_key"), F.explode(F.array(*cells)).alias("cell")
        ).select("table_id", "row_key", "cell.*")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "unique_columns",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_id, '{c}' AS column_name, count({c}) = count(DISTINCT {c}) AS is_unique FROM {t}"
        for t, cols in {
            "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
            "lineitem": ("l_orderkey", "l_linenumber", "l_extendedprice"),
            "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
        }.items() for c in cols
    ),
)
def unique_columns(spark: SparkSession, sf: str) -> DataFrame:
    lineitem = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return (
        profile.unique_columns(table(spark, sf, "customer"), "customer")
        .unionByName(profile.unique_columns(lineitem, "lineitem"))
        .unionByName(profile.unique_columns(table(spark, sf, "events"), "events"))
    )


@query(
    "implied_fks",
    """SELECT 'orders' AS source_table, 'o_custkey' AS source_column, 'customer.custkey' AS suggested_alias,
        (SELECT count(o_custkey) FROM orders) AS n_rows,
        (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)) AS matched_rows,
        (SELECT count(*) FILTER (o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)) / count(*) FROM orders) AS containment
       UNION ALL SELECT 'events', 'author_user_id', 'users.user_id', (SELECT count(user_id) FROM events),
        (SELECT count(*) FROM events WHERE user_id IN (SELECT c_custkey FROM customer)), 1.0""",
)
def implied_fks(spark: SparkSession, sf: str) -> DataFrame:
    customer, orders, events = (table(spark, sf, n) for n in ("customer", "orders", "events"))
    tables = {
        "orders": orders.select("o_orderkey", "o_custkey"),
        "customer": customer.where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("custkey"), "c_name"),
        "users": customer.select(F.col("c_custkey").alias("user_id")),
        "events": events.select("event_id", F.col("user_id").alias("author_user_id")),
    }
    specs = {"users": TableSpec("users", pk=("user_id",))}
    return references.implied_fks(tables, specs, suffixes=("user_id", "custkey"), infer_unique=True)


@query(
    "polymorphic_refs",
    """SELECT 'events' AS table_id, 'event_type' AS type_column, 'event_id' AS id_column, event_type AS type_value,
        count(*) AS n_rows, count(DISTINCT event_id) AS n_ids FROM events GROUP BY event_type""",
)
def polymorphic_refs(spark: SparkSession, sf: str) -> DataFrame:
    return references.polymorphic_refs(star(spark, sf, "events", "orders", "customer"))


_DRIFT_BEFORE = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_orderpriority": "string"}
_DRIFT_AFTER = {"o_orderkey": "string", "o_custkey": "bigint", "o_orderstatus": "string", "o_clerk": "string"}


@query(
    "drift",
    f"""WITH cur_orders AS (SELECT o_orderkey::VARCHAR AS o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
          o_orderstatus, 'clerk' || o_custkey::VARCHAR AS o_clerk FROM orders WHERE o_orderkey % 3 <> 0),
        prev AS ({_stats_sql('orders', 'orders', _DRIFT_BEFORE)}), cur AS ({_stats_sql('cur_orders', 'orders', _DRIFT_AFTER)})
        SELECT coalesce(p.table_id, c.table_id) AS table_id, coalesce(p.column_name, c.column_name) AS column_name,
          CASE WHEN p.data_type IS NULL THEN 'added' WHEN c.data_type IS NULL THEN 'removed' WHEN p.data_type <> c.data_type THEN 'retyped'
               WHEN (p.nulls > 0) <> (c.nulls > 0) THEN 'nullability' ELSE 'none' END AS change, change <> 'none' AS has_drift,
          p.data_type AS prev_data_type, c.data_type AS cur_data_type, c.n_rows - p.n_rows AS rows_delta,
          round(c.nulls / c.n_rows - p.nulls / p.n_rows, 6) AS null_share_delta, round(c.avg_width - p.avg_width, 4) AS avg_width_delta
        FROM prev p FULL JOIN cur c ON p.column_name = c.column_name""",
)
def schema_drift(spark: SparkSession, sf: str) -> DataFrame:
    before = table(spark, sf, "orders").select(*_DRIFT_BEFORE)
    after = before.where("o_orderkey % 3 <> 0").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("o_custkey"), "o_orderstatus",
        F.concat(F.lit("clerk"), F.col("o_custkey").cast("string")).alias("o_clerk"),
    )
    out = drift.drift(profile.profile(before, "orders"), profile.profile(after, "orders"))
    return out.withColumn("null_share_delta", F.round("null_share_delta", 6)).withColumn("avg_width_delta", F.round("avg_width_delta", 4))


@query(
    "drift_declared",
    """WITH cur AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0), p AS (SELECT count(*) AS n FROM orders),
         c AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 5 = 0) AS nulls FROM cur)
       SELECT 'orders' AS table_id, v.column_name, v.change, v.change <> 'none' AS has_drift,
         CASE WHEN v.change IN ('added', 'removed') THEN NULL ELSE c.n - p.n END AS rows_delta,
         CASE WHEN v.change IN ('added', 'removed') THEN NULL WHEN v.column_name = 'o_custkey' THEN round(c.nulls / c.n, 6)
              ELSE 0.0 END AS null_share_delta
       FROM p, c, (VALUES ('o_orderkey', 'none'), ('o_custkey', 'none'), ('o_orderstatus', 'nullability'), ('o_totalprice', 'retyped'),
         ('o_orderpriority', 'removed'), ('o_clerk', 'added')) v(column_name, change)""",
)
def declared_drift(spark: SparkSession, sf: str) -> DataFrame:
    """First NULLs in a nullable column are no drift; a declared NOT NULL and a wider decimal are."""
    orders = table(spark, sf, "orders")
    price = F.col("o_totalprice")
    before = orders.select("o_orderkey", "o_custkey", "o_orderstatus", price.cast("decimal(14,2)").alias("o_totalprice"), "o_orderpriority")
    after = orders.where("o_orderkey % 3 <> 0").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("o_custkey"), "o_orderstatus",
        price.cast("decimal(16,2)").alias("o_totalprice"), F.concat(F.lit("clerk"), F.col("o_custkey").cast("string")).alias("o_clerk"),
    )
    was = TableSpec("orders", pk=("o_orderkey",))
    now = TableSpec("orders", pk=("o_orderkey",), not_null=frozenset({"o_orderstatus"}))
    declared = drift.drift_declared(
        drift.declared_schema(spark, {"orders": before}, {"orders": was}), drift.declared_schema(spark, {"orders": after}, {"orders": now})
    )
    out = drift.drift(profile.profile(before, "orders"), profile.profile(after, "orders"), declared)
    return out.select("table_id", "column_name", "change", "has_drift", "rows_delta", F.round("null_share_delta", 6).alias("null_share_delta"))


@query(
    "new_partitions",
    """SELECT DISTINCT year(o_orderdate)::INT AS order_year, o_orderstatus FROM orders
       EXCEPT SELECT DISTINCT year(o_orderdate)::INT, o_orderstatus FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'""",
)
def new_partitions(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumn("order_year", F.year("o_orderdate"))
    previous = orders.where("o_orderdate < timestamp_ntz'1997-01-01 00:00:00'")
    return drift.new_partitions(previous, orders, ["order_year", "o_orderstatus"])


@query(
    "not_null_conflicts",
    """SELECT 'orders' AS table_id, 'o_custkey' AS column_name, count(*) FILTER (o_orderkey % 10 = 3) AS null_rows FROM orders
       UNION ALL SELECT 'orders', 'o_orderpriority', count(*) FROM orders UNION ALL SELECT 'orders', 'o_orderstatus', 0""",
)
def not_null_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    masked = mask_table(orders, {"o_custkey": Null(when="o_orderkey % 10 = 3"), "o_orderpriority": Null()}, CTX, table="orders")
    return profile.not_null_conflicts(masked, "orders", {"o_custkey", "o_orderpriority", "o_orderstatus"})


# Verification -------------------------------------------------------------------------------


@query(
    "row_count_parity",
    """SELECT 'table.row_count' AS "check", 'fail' AS verdict, 'lineitem' AS target,
        s || ' source rows against ' || t AS detail, t - s AS metric
        FROM (SELECT count(*) AS s, count(*) FILTER (l_quantity > 5) AS t FROM lineitem)
       UNION ALL SELECT 'table.row_count', 'pass', 'orders', count(*) || ' rows on both sides', 0 FROM orders""",
)
def row_count_parity(spark: SparkSession, sf: str) -> DataFrame:
    lineitem, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return verify.row_count_parity(lineitem, lineitem.where("l_quantity > 5"), "lineitem").unionByName(
        verify.row_count_parity(orders, orders, "orders")
    )


@query(
    "uniqueness",
    """SELECT 'table.uniqueness' AS "check", CASE WHEN n = 0 THEN 'pass' ELSE 'fail' END AS verdict, target,
        CASE WHEN n = 0 THEN 'no key repeats' ELSE n || ' repeated key(s)' END AS detail, n AS metric FROM (
        SELECT 'lineitem(l_orderkey, l_linenumber)' AS target, count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
        UNION ALL SELECT 'lineitem(l_comment_id)', 0
        UNION ALL SELECT 'customer(c_custkey)', 0 UNION ALL SELECT 'customer(c_name)', 0)""",
)
def uniqueness(spark: SparkSession, sf: str) -> DataFrame:
    lineitem = table(spark, sf, "lineitem").withColumn("l_comment_id", F.lit(None).cast("long"))
    spec = TableSpec("lineitem", uniques=(("l_orderkey", "l_linenumber"), ("l_comment_id",)))
    return verify.uniqueness(lineitem, spec).unionByName(verify.uniqueness(table(spark, sf, "customer"), SPECS["customer"]))


@query(
    "fk_integrity",
    """SELECT 'table.fk_integrity' AS "check", CASE WHEN n = 0 THEN 'pass' ELSE 'fail' END AS verdict, target,
        CASE WHEN n = 0 THEN 'every key has its parent' ELSE n || ' row(s) without a parent' END AS detail, n AS metric FROM (
        SELECT 'orders(o_custkey)' AS target, count(*) FILTER (o_custkey % 7 = 0) AS n FROM orders
        UNION ALL SELECT 'lineitem(l_orderkey)', count(*) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM orders)) FROM lineitem
        UNION ALL SELECT 'lineitem(l_partkey)', 0 UNION ALL SELECT 'lineitem(l_suppkey)', 0)""",
)
def fk_integrity(spark: SparkSession, sf: str) -> DataFrame:
    tables = star(spark, sf, "customer", "orders", "lineitem", "part", "supplier")
    tables["customer"] = tables["customer"].where("c_custkey % 7 <> 0")
    return verify.fk_integrity(tables, SPECS["orders"]).unionByName(verify.fk_integrity(tables, SPECS["lineitem"]))


@query(
    "fk_integrity_composite",
    """SELECT count(*) AS orphans FROM lineitem l WHERE l_suppkey IS NOT NULL AND NOT EXISTS
        (SELECT 1 FROM lineitem p WHERE p.l_returnflag = 'R' AND p.l_partkey = l.l_partkey AND p.l_suppkey = l.l_suppkey)""",
)
def fk_integrity_composite(spark: SparkSession, sf: str) -> DataFrame:
    lineitem = table(spark, sf, "lineitem")
    fk = ForeignKey(("l_partkey", "l_suppkey"), "returned", ("l_partkey", "l_suppkey"))
    return verify.orphan_count(lineitem, lineitem.where("l_returnflag = 'R'"), fk).withColumnRenamed("n", "orphans")


def _masked_orders(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf, "orders")
    rules = {"o_orderpriority": Fake("company", when="o_orderkey % 4 <> 0"), "o_orderstatus": Hash()}
    return orders, mask_table(orders, rules, CTX, table="orders")


@query(
    "sample_match",
    f"""SELECT o_orderkey, o_orderpriority AS before,
        CASE WHEN o_orderkey % 4 <> 0 THEN {g.fake('company', 'o_orderpriority', 'orders.o_orderpriority')} ELSE o_orderpriority END AS after
        FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000) WHERE o_orderkey % 3 <> 0""",
)
def sample_match(spark: SparkSession, sf: str) -> DataFrame:
    source, target = _masked_orders(spark, sf)
    pairs = verify.sample_match(source, target.where("o_orderkey % 3 <> 0"), ["o_orderkey"])
    return pairs.select(
        F.col("s.o_orderkey").alias("o_orderkey"), F.col("s.o_orderpriority").alias("before"), F.col("t.o_orderpriority").alias("after")
    )


_STATS_SQL = """SELECT 'o_custkey' AS column_name, count(*) AS total, 0 AS changed, 0 AS both_null FROM orders
    UNION ALL SELECT 'o_orderdate', count(*), 0, 0 FROM orders UNION ALL SELECT 'o_orderkey', count(*), 0, 0 FROM orders
    UNION ALL SELECT 'o_orderpriority', count(*), count(*) FILTER (o_orderkey % 4 <> 0), 0 FROM orders
    UNION ALL SELECT 'o_orderstatus', count(*), count(*), 0 FROM orders UNION ALL SELECT 'o_totalprice', count(*), 0, 0 FROM orders"""


@query("column_stats", _STATS_SQL)
def column_stats(spark: SparkSession, sf: str) -> DataFrame:
    source, target = _masked_orders(spark, sf)
    return verify.column_stats(source, target, ["o_orderkey"], sample=None)


@query(
    "change_rate",
    f"""SELECT 'column.change_rate' AS "check", CASE WHEN changed = 0 THEN 'fail' WHEN changed < total THEN 'warn' ELSE 'pass' END AS verdict,
        'orders.' || column_name AS target, CASE WHEN changed = 0 THEN 'no value differs from its original'
          WHEN changed < total THEN round_even(100.0 * changed / total, 0)::BIGINT || '% changed, originals left: ' || (total - changed)
          ELSE 'changed: all of ' || total END AS detail, changed AS metric
        FROM ({_STATS_SQL}) WHERE column_name IN ('o_custkey', 'o_orderpriority', 'o_orderstatus')""",
)
def change_rate(spark: SparkSession, sf: str) -> DataFrame:
    source, target = _masked_orders(spark, sf)
    stats = verify.column_stats(source, target, ["o_orderkey"], ["o_custkey", "o_orderpriority", "o_orderstatus"], sample=None)
    return verify.change_rate(stats, "orders")


@query(
    "passthrough_drift",
    f"""SELECT 'column.passthrough_drift' AS "check", CASE WHEN changed > 0 THEN 'fail' ELSE 'pass' END AS verdict, 'orders.' || column_name AS target,
        CASE WHEN changed > 0 THEN changed || ' value(s) differ where none should' ELSE 'every value is the original' END AS detail,
        changed AS metric FROM ({_STATS_SQL})""",
)
def passthrough_drift(spark: SparkSession, sf: str) -> DataFrame:
    source, target = _masked_orders(spark, sf)
    return verify.passthrough_drift(verify.column_stats(source, target, ["o_orderkey"], sample=None), "orders")


def _verification(spark: SparkSession, sf: str) -> DataFrame:
    source = star(spark, sf, "customer", "nation", "orders", "lineitem")
    rules = {
        "customer": {"c_name": Fake("full_name"), "c_mktsegment": Hash()},
        "orders": {"o_orderpriority": Fake("company", when="o_orderkey % 4 <> 0")},
    }
    target = mask_tables(source, rules, CTX, SPECS)
    target["customer"] = target["customer"].where("c_custkey % 7 <> 0")
    rules["nation"] = {"n_name": Hash()}
    return verify.verify(source, target, SPECS, rules, sample=None)


_VERIFY_SQL = """
  SELECT 'table.row_count' AS "check", 'fail' AS verdict, 'customer' AS target,
    count(*) || ' source rows against ' || count(*) FILTER (c_custkey % 7 <> 0) AS detail,
    count(*) FILTER (c_custkey % 7 <> 0) - count(*) AS metric FROM customer
  UNION ALL SELECT 'table.row_count', 'pass', 'nation', count(*) || ' rows on both sides', 0 FROM nation
  UNION ALL SELECT 'table.row_count', 'pass', 'orders', count(*) || ' rows on both sides', 0 FROM orders
  UNION ALL SELECT 'table.row_count', 'pass', 'lineitem', count(*) || ' rows on both sides', 0 FROM lineitem
  UNION ALL SELECT 'table.uniqueness', 'pass', u, 'no key repeats', 0 FROM (VALUES ('customer(c_custkey)'), ('customer(c_name)'), ('nation(n_nationkey)'), ('orders(o_orderkey)')) v(u)
  UNION ALL SELECT 'table.fk_integrity', 'pass', 'customer(c_nationkey)', 'every key has its parent', 0
  UNION ALL SELECT 'table.fk_integrity', 'fail', 'orders(o_custkey)', count(*) || ' row(s) without a parent', count(*) FROM orders WHERE o_custkey % 7 = 0
  UNION ALL SELECT 'table.fk_integrity', 'pass', 'lineitem(l_orderkey)', 'every key has its parent', 0
  UNION ALL SELECT 'table.no_pk', 'warn', 'lineitem', 'rows not compared for want of a primary key', NULL
  UNION ALL SELECT 'column.passthrough_drift', 'pass', c, 'every value is the original', 0 FROM (VALUES
    ('customer.c_custkey'), ('customer.c_nationkey'), ('customer.c_acctbal'), ('nation.n_nationkey'), ('nation.n_regionkey'),
    ('orders.o_orderkey'), ('orders.o_custkey'), ('orders.o_orderstatus'), ('orders.o_totalprice'), ('orders.o_orderdate')) v(c)
  UNION ALL SELECT 'column.change_rate', 'pass', c, 'changed: all of ' || n, n
    FROM (VALUES ('customer.c_name'), ('customer.c_mktsegment')) v(c), (SELECT count(*) AS n FROM customer WHERE c_custkey % 7 <> 0)
  UNION ALL SELECT 'column.change_rate', 'fail', 'nation.n_name', 'no value differs from its original', 0
  UNION ALL SELECT 'column.change_rate', 'warn', 'orders.o_orderpriority', round_even(100.0 * c / n, 0)::BIGINT || '% changed, originals left: ' || (n - c), c
    FROM (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 4 <> 0) AS c FROM orders)
"""


@query("verify", _VERIFY_SQL)
def verify_tables(spark: SparkSession, sf: str) -> DataFrame:
    return _verification(spark, sf)


@query("verdict_counts", f"SELECT verdict, count(*) AS checks FROM ({_VERIFY_SQL}) GROUP BY verdict")
def verdict_counts(spark: SparkSession, sf: str) -> DataFrame:
    return verify.verdict_counts(_verification(spark, sf))


@query(
    "leak_probe",
    """SELECT 'orders' AS table_id, 'o_orderpriority' AS column_name, count(DISTINCT o_orderpriority) AS surviving_values,
        count(*) AS surviving_rows FROM orders WHERE o_orderkey % 4 = 0
       UNION ALL SELECT 'orders', 'o_orderpriority', 2, count(*) FROM orders WHERE o_orderkey % 4 = 0 AND o_orderpriority IN ('1-URGENT', '5-LOW')
       UNION ALL SELECT 'orders', 'o_orderstatus', 0, 0""",
)
def leak_probe(spark: SparkSession, sf: str) -> DataFrame:
    source, target = _masked_orders(spark, sf)
    return (
        verify.leak_probe(target, "orders", "o_orderpriority", (source, "o_orderpriority"))
        .unionByName(verify.leak_probe(target, "orders", "o_orderpriority", ["1-URGENT", "5-LOW", "absent"]))
        .unionByName(verify.leak_probe(target, "orders", "o_orderstatus", (source, "o_orderstatus")))
    )


@query(
    "shape_check",
    """SELECT 'orders' AS table_id, 'o_orderstatus' AS column_name, count(*) AS n_values, 0 AS n_mismatched FROM orders
       UNION ALL SELECT 'orders', 'o_orderpriority', count(*), count(*) FILTER (o_orderkey % 4 = 0) FROM orders""",
)
def shape_check(spark: SparkSession, sf: str) -> DataFrame:
    _, target = _masked_orders(spark, sf)
    return verify.shape_check(target, "orders", {"o_orderstatus": "^[0-9a-f]{64}$", "o_orderpriority": "^[A-Z][a-z]+ "})


@query(
    "diff_runs",
    f"""WITH a AS (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem),
        b AS (SELECT l_returnflag, l_linestatus, CASE WHEN l_linenumber = 1 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity FROM lineitem),
        n AS (SELECT l_returnflag, l_linestatus, l_quantity, sum(w) AS w FROM (SELECT *, 1 AS w FROM a UNION ALL SELECT *, -1 FROM b) GROUP BY ALL)
        SELECT l_returnflag, l_linestatus, l_quantity, CASE WHEN w > 0 THEN 'a_only' ELSE 'b_only' END AS side, abs(w)::BIGINT AS copies FROM n WHERE w <> 0""",
)
def diff_runs(spark: SparkSession, sf: str) -> DataFrame:
    lineitem = table(spark, sf, "lineitem")
    a = lineitem.select("l_returnflag", "l_linestatus", "l_quantity")
    bumped = F.when(F.col("l_linenumber") == 1, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    return verify.diff_runs(a, lineitem.select("l_returnflag", "l_linestatus", bumped.alias("l_quantity")))


@query(
    "diff_runs_determinism",
    """SELECT 'same salt' AS comparison, 0 AS differing UNION ALL SELECT 'other salt', 2 * count(*) FROM customer""",
)
def diff_runs_determinism(spark: SparkSession, sf: str) -> DataFrame:
    from dataclasses import replace

    customer = table(spark, sf, "customer")
    rules = {"c_name": Fake("username"), "c_mktsegment": Hash()}
    one = mask_table(customer, rules, CTX, table=SPECS["customer"])
    again = mask_table(customer.repartition(5, "c_nationkey"), rules, CTX, table=SPECS["customer"])
    other = mask_table(customer, rules, replace(CTX, salt="another salt"), table=SPECS["customer"])

    def differing(label: str, b: DataFrame) -> DataFrame:
        return verify.diff_runs(one, b, fanout=()).agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("differing")).select(F.lit(label).alias("comparison"), "differing")

    return differing("same salt", again).unionByName(differing("other salt", other))


@query(
    "retention",
    """SELECT t AS table_id, sum(s)::BIGINT AS source_rows, sum(k)::BIGINT AS target_rows, round(100.0 * sum(k) / sum(s), 2) AS retention_pct FROM (
        SELECT 'customer' AS t, count(*) AS s, count(*) FILTER (c_nationkey = 3) AS k FROM customer
        UNION ALL SELECT 'orders', count(*), count(*) FILTER (o_orderstatus = 'F') FROM orders
        UNION ALL SELECT 'lineitem', count(*), count(*) FILTER (l_quantity < 7) FROM lineitem) GROUP BY ROLLUP (t)""",
)
def retention(spark: SparkSession, sf: str) -> DataFrame:
    source = star(spark, sf, "customer", "orders", "lineitem")
    target = {
        "customer": source["customer"].where("c_nationkey = 3"), "orders": source["orders"].where("o_orderstatus = 'F'"),
        "lineitem": source["lineitem"].where("l_quantity < 7"),
    }
    return verify.retention(source, target)


# Referential operators ----------------------------------------------------------------------

def _subset(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    names = ("region", "nation", "customer", "orders", "lineitem", "part", "supplier")
    return referential.subset(star(spark, sf, *names), SPECS, {"customer": "c_nationkey = 3 AND c_acctbal > 0"})


_SUBSET_SQL = """c AS (SELECT * FROM customer WHERE c_nationkey = 3 AND c_acctbal > 0),
    o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)),
    l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)),
    p AS (SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM l)),
    s AS (SELECT * FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM l)),
    n AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c UNION SELECT s_nationkey FROM s)),
    r AS (SELECT * FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM n))"""


@query("subset_lineitem", f"WITH {_SUBSET_SQL} SELECT * FROM l")
def subset_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return _subset(spark, sf)["lineitem"]


@query("subset_nation", f"WITH {_SUBSET_SQL} SELECT * FROM n")
def subset_nation(spark: SparkSession, sf: str) -> DataFrame:
    return _subset(spark, sf)["nation"]


@query(
    "subset_counts",
    f"""WITH {_SUBSET_SQL} SELECT 'customer' AS table_id, count(*) AS n_rows FROM c UNION ALL SELECT 'orders', count(*) FROM o
        UNION ALL SELECT 'lineitem', count(*) FROM l UNION ALL SELECT 'part', count(*) FROM p UNION ALL SELECT 'supplier', count(*) FROM s
        UNION ALL SELECT 'nation', count(*) FROM n UNION ALL SELECT 'region', count(*) FROM r""",
)
def subset_counts(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name, df in _subset(spark, sf).items():
        part = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_id"), "n_rows")
        out = part if out is None else out.unionAll(part)
    return out


@query(
    "subset_from_region",
    """WITH n AS (SELECT * FROM nation WHERE n_regionkey = 1), c AS (SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n)),
        s AS (SELECT * FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM n)),
        o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
       SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o) OR l_suppkey IN (SELECT s_suppkey FROM s)""",
)
def subset_from_region(spark: SparkSession, sf: str) -> DataFrame:
    """Line items are reached twice here, over their order and over their supplier."""
    names = ("region", "nation", "customer", "orders", "lineitem", "supplier")
    return referential.subset(star(spark, sf, *names), SPECS, {"region": "r_regionkey = 1"})["lineitem"]


_CHAIN_SPEC = TableSpec("orders", pk=("o_orderkey",), fks=(ForeignKey(("boss",), "orders", ("o_orderkey",)),))


@query(
    "subset_self_reference",
    """WITH RECURSIVE e AS (SELECT o_orderkey, CASE WHEN o_orderkey > 0 THEN o_orderkey // 4 END AS boss FROM orders),
        down AS (SELECT o_orderkey, boss FROM e WHERE o_orderkey % 211 = 3 UNION SELECT e.o_orderkey, e.boss FROM e JOIN down d ON e.boss = d.o_orderkey),
        up AS (SELECT o_orderkey, boss FROM down UNION SELECT e.o_orderkey, e.boss FROM e JOIN up u ON u.boss = e.o_orderkey)
       SELECT o_orderkey, boss FROM up""",
)
def subset_self_reference(spark: SparkSession, sf: str) -> DataFrame:
    """A reporting tree over the order keys: subordinates first, then their managers."""
    key = F.col("o_orderkey")
    orders = table(spark, sf, "orders").select("o_orderkey", F.when(key > 0, F.floor(key / 4)).alias("boss"))
    return referential.subset({"orders": orders}, {"orders": _CHAIN_SPEC}, {"orders": "o_orderkey % 211 = 3"})["orders"]


@query(
    "null_orphan_fks",
    """SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS o_custkey, o_orderstatus FROM orders""",
)
def null_orphan_fks(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    customer = table(spark, sf, "customer").where("c_custkey % 7 <> 0")
    return referential.null_orphan_fks(orders, {"customer": customer}, SPECS["orders"])


@query(
    "null_orphan_fks_hot_key",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 WHEN user_id % 7 <> 0 THEN user_id END AS user_id FROM events""",
)
def null_orphan_fks_hot_key(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the events belong to one user, which takes the salted path."""
    hot = F.when(F.col("event_id") % 3 == 0, F.lit(1).cast("long")).otherwise(F.col("user_id"))
    events = table(spark, sf, "events").select("event_id", hot.alias("user_id"))
    customer = table(spark, sf, "customer").where("c_custkey % 7 <> 0")
    return referential.null_orphan_fks(events, {"customer": customer}, SPECS["events"])


@query(
    "exclude_conflicts",
    """SELECT 'orders' AS table_id, 'o_custkey' AS column_name, 'customer' AS excluded_parent, count(o_custkey) AS affected_rows FROM orders""",
)
def exclude_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    tables = star(spark, sf, "region", "nation", "customer", "orders", "lineitem", "supplier", "part")
    return referential.exclude_conflicts(tables, SPECS, {"customer": "exclude", "part": "exclude"})


@query(
    "fk_mask_consistency",
    """SELECT 'orders(o_cname)' AS foreign_key, count(*) AS joined_before, count(*) AS joined_after, true AS consistent FROM orders
       UNION ALL SELECT 'orders(o_cname)', count(*), 0, false FROM orders""",
)
def fk_mask_consistency(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer").select("c_custkey", "c_name")
    orders = table(spark, sf, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_name").alias("o_cname"))
    fk = ForeignKey(("o_cname",), "customer", ("c_name",))
    specs = {"customer": SPECS["customer"], "orders": TableSpec("orders", pk=("o_orderkey",), fks=(fk,))}
    rules = {"customer": {"c_name": Fake("full_name")}, "orders": {"o_cname": Fake("full_name")}}
    tables = {"customer": customer, "orders": orders}
    out = None
    for fk_paths in (True, False):
        masked = mask_tables(tables, rules, CTX, specs, fk_paths=fk_paths)
        part = referential.fk_mask_consistency((orders, customer), (masked["orders"], masked["customer"]), fk, "orders")
        out = part if out is None else out.unionByName(part)
    return out


@query("remaining", "SELECT * FROM orders WHERE o_orderkey % 3 <> 1")
def remaining(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    return referential.remaining(orders, orders.where("o_orderkey % 3 = 1"), ["o_orderkey"])


# Audit --------------------------------------------------------------------------------------


@query(
    "audit_masking",
    """SELECT 'run-1' AS run_id, 'column.masked' AS event_type, 'orders' AS table_id, 'o_orderpriority' AS column_name, 'fake' AS action,
        count(*) AS cells_seen, count(*) FILTER (o_orderkey % 4 <> 0) AS cells_changed FROM orders
       UNION ALL SELECT 'run-1', 'column.masked', 'orders', 'o_orderstatus', 'hash', count(*), count(*) FROM orders
       UNION ALL SELECT 'run-1', 'column.masked', 'orders', 'o_totalprice', 'null', count(*), count(*) FROM orders
       UNION ALL SELECT 'run-1', 'column.passed_through', 'orders', 'o_orderkey', 'passthrough', count(*), 0 FROM orders""",
)
def audit_masking(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    rules = {"o_orderpriority": Fake("company", when="o_orderkey % 4 <> 0"), "o_orderstatus": Hash(), "o_totalprice": Null()}
    return audit.audit_masking(orders, rules, CTX, table="orders", run_id="run-1")


@query("audit_detection", f"SELECT 'run-1' AS run_id, 'column.pii_detected' AS event_type, * FROM ({_FINDINGS_SQL})")
def audit_detection(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit_detection(_findings(spark, sf), "run-1").withColumn("reasons", F.concat_ws("; ", "reasons"))


_SUMMARY_RULES = {"orders": {"o_orderstatus": Hash()}}


@query(
    "run_summary",
    f"""WITH b AS (SELECT 'run-1' AS run_id, 'orders' AS table_id, o_orderkey // 1000 AS batch_id, count(*) AS n, max(o_orderkey)::VARCHAR AS cur FROM orders GROUP BY 3),
        w AS (SELECT sum(x) AS w FROM (SELECT avg(octet_length(encode(o_orderkey::VARCHAR))) AS x FROM orders UNION ALL SELECT avg(octet_length(encode(o_orderstatus))) FROM orders))
        SELECT run_id, table_id, count(*) AS batches, sum(n)::BIGINT AS rows, floor(max(w) * sum(n))::BIGINT AS bytes, max_by(cur, batch_id) AS last_cursor,
          max_by(CASE WHEN batch_id = (SELECT max(batch_id) FROM b) THEN 'succeeded' ELSE 'in_progress' END, batch_id) AS status,
          '{CTX.salt_fingerprint}' AS salt_fingerprint, '{audit.rules_hash(_SUMMARY_RULES)}' AS config_hash FROM b, w GROUP BY run_id, table_id""",
)
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    batches = (
        orders.groupBy(F.floor(F.col("o_orderkey") / 1000).alias("batch_id"))
        .agg(F.count("*").alias("rows"), F.max("o_orderkey").alias("top"))
        .select(F.lit("run-1").alias("run_id"), F.lit("orders").alias("table_id"), "batch_id", "rows", F.col("top").cast("string").alias("cursor"))
    )
    last = batches.agg(F.max("batch_id").alias("batch_id")).withColumn("status", F.lit("succeeded"))
    marked = batches.join(last, "batch_id", "left_outer").withColumn("status", F.coalesce("status", F.lit("in_progress")))
    return audit.run_summary(marked, profile.profile(orders, "orders"), CTX, _SUMMARY_RULES)


_GUARDS = {
    "o_orderpriority": Fake("company", when="o_orderstatus = 'F'"),
    "o_totalprice": Null(when="nullif(o_custkey % 2, 1) = 0"), "o_orderstatus": Hash(),
}


@query(
    "conditional_skips",
    """SELECT 'run-1' AS run_id, 'conditional_skip' AS event_type, 'orders' AS table_id, 'o_orderpriority' AS column_name,
        sha256('o_orderstatus = ''F''') AS predicate_hash, count(*) FILTER (o_orderstatus <> 'F') AS skipped FROM orders
       UNION ALL SELECT 'run-1', 'conditional_skip', 'orders', 'o_totalprice', sha256('nullif(o_custkey % 2, 1) = 0'), count(*) FILTER (o_custkey % 2 = 1) FROM orders""",
)
def conditional_skips(spark: SparkSession, sf: str) -> DataFrame:
    return audit.conditional_skips(table(spark, sf, "orders"), _GUARDS, table="orders", run_id="run-1")


# Text keys against whole numbers, one key with a third of the rows ------------------------------

_TEXT_ORDERS = """text_orders AS (SELECT o_orderkey, o_totalprice,
    CASE WHEN o_orderkey % 3 = 0 THEN '0000000001' ELSE lpad(o_custkey::VARCHAR, 10, '0') END AS cust FROM orders)"""
_TEXT_SPECS = {
    "customer": TableSpec("customer", pk=("c_custkey",)),
    "orders": TableSpec("orders", pk=("o_orderkey",), fks=(ForeignKey(("cust",), "customer", ("c_custkey",)),)),
}


def _text_orders(spark: SparkSession, sf: str) -> DataFrame:
    key = F.when(F.col("o_orderkey") % 3 == 0, "0000000001").otherwise(F.lpad(F.col("o_custkey").cast("string"), 10, "0"))
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice", key.alias("cust"))


@query(
    "subset_text_keys",
    f"""WITH {_TEXT_ORDERS} SELECT o_orderkey, o_totalprice, cust FROM text_orders
        WHERE cust::BIGINT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 1)""",
)
def subset_text_keys(spark: SparkSession, sf: str) -> DataFrame:
    tables = {"customer": table(spark, sf, "customer"), "orders": _text_orders(spark, sf)}
    return referential.subset(tables, _TEXT_SPECS, {"customer": "c_custkey % 2 = 1"})["orders"]


@query(
    "null_orphan_fks_text_keys",
    f"""WITH {_TEXT_ORDERS} SELECT o_orderkey, o_totalprice,
        CASE WHEN cust::BIGINT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0) THEN cust END AS cust
        FROM text_orders""",
)
def null_orphan_fks_text_keys(spark: SparkSession, sf: str) -> DataFrame:
    parents = {"customer": table(spark, sf, "customer").where("c_custkey % 7 <> 0")}
    return referential.null_orphan_fks(_text_orders(spark, sf), parents, _TEXT_SPECS["orders"])

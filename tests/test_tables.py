import pytest
from pyspark.sql import functions as F

from maskframe import Fake, ForeignKey, Hash, MaskError, Null, Static, TableSpec, mask_table, mask_tables
from maskframe.operators import audit, detect, drift, profile, references, referential, rules, verify
from maskframe.operators.skew import NO_HEAVY_KEYS, heavy_keys, key_join


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# Detection


@pytest.mark.parametrize("name,rule", [
    ("user_email", "email_suffix"), ("email_address", "email_prefix"), ("EMAIL", "email"), ("work_tel_no", "tel"),
    ("hotel", None), ("cell", "cell"), ("cancelled", None), ("name", "name_exact"), ("username", None),
    ("ip_address", "ip_address"), ("last_login_ip", "ip_suffix"), ("shipping", None), ("zip_code", "zip"), ("capacity", "city"),
    ("company_id", None), ("pan_number", "pan"), ("password_hash", "password_hash"), ("api_key", "api_key"),
    ("auth_method", "auth_prefix"), ("visit_notes", "notes_suffix"), ("notepad", "notes"), ("commentable_type", "comments"),
    ("biography", "bio"), ("display_name", "display_name"), ("card_number", "card_number"), ("token_email", "email_suffix"),
])
def test_first_matching_rule_wins(name, rule):
    found = rules.match_name(name)
    assert (found.rule_id if found else None) == rule


def test_rule_order_and_types():
    assert len(rules.NAME_RULES) == 57 and len({r.rule_id for r in rules.NAME_RULES}) == 57
    by_id = {r.rule_id: r for r in rules.NAME_RULES}
    assert rules.compatible_action(by_id["token"], "uuid") == ("fake", "uuid")
    assert rules.compatible_action(by_id["token"], "bigint") is None
    assert rules.compatible_action(by_id["dob"], "date") == ("fake", "dob")
    assert rules.compatible_action(by_id["phone"], "bigint") is None
    assert rules.compatible_action(by_id["ip_suffix"], "inet") == ("fake", "ip_address")
    assert rules.is_free_text_type("varchar(500)") and not rules.is_free_text_type("varchar(499)")
    assert [rules.table_sensitivity(t) for t in ("user_items", "line_items", "ledger")] == ["sensitive", "low", "neutral"]


def free_text(spark, table, width, dtype="text"):
    df = spark.createDataFrame([("x" * width,)] if width else [(None,)], "notes string")
    spec = TableSpec(table, types={"notes": dtype})
    return detect.detect_pii({table: df}, specs={table: spec}).first()


@pytest.mark.parametrize("table,width,dtype,confidence,action", [
    ("app.patients", 200, "text", "high", "ner_mask"), ("app.ledger", 250, "text", "high", "ner_mask"),
    ("app.products", 250, "text", "medium", None), ("app.patients", 150, "text", "medium", None),
    ("app.ledger", 150, "text", "low", None), ("app.patients", 50, "text", "low", None),
    ("app.patients", 0, "text", "medium", None), ("app.ledger", 0, "text", "low", None),
    ("app.patients", 300, "varchar(100)", "low", None), ("app.patients", 300, "character varying(600)", "high", "ner_mask"),
])
def test_free_text_scoring(spark, table, width, dtype, confidence, action):
    f = free_text(spark, table, width, dtype)
    assert (f.confidence, f.action, f.matched_pattern) == (confidence, action, "notes_substring")


def test_detection_sources_and_strict(spark, ctx):
    df = spark.createDataFrame([("a@b", "n", "s")], "email string, notes string, status string")
    tables = {"public.contacts": df}
    explicit = {"public.contacts": {"email": Static("x")}}
    found = {r.column_name: r for r in detect.detect_pii(tables, explicit).collect()}
    assert (found["email"].source, found["email"].action, found["email"].reasons) == ("config", "static", ["explicit config"])
    assert found["status"].reasons == ["no pattern match"]
    off = detect.detect_pii(tables, auto_detect=False).collect()
    assert {r.reasons[0] for r in off} == {"auto-detect disabled"}
    with pytest.raises(MaskError, match="public.contacts.email"):
        detect.auto_mask(tables, ctx, strict=True)
    detect.auto_mask({"public.c": df.select("email", "status")}, ctx, {"public.c": {"email": Hash()}}, strict=True)
    with pytest.raises(MaskError):
        detect.detect_pii(tables, strategies={"public.contacts": "exclude"})


# Profile


def test_profile_counts(spark):
    df = spark.createDataFrame([("é", 1, [1]), (None, 1, [1, 2]), ("abc", 3, None)], "s string, n int, a array<int>")
    got = {r.column_name: r for r in profile.profile(df, "t", exact_distinct=True).collect()}
    assert (got["s"].n_rows, got["s"].nulls, got["s"].n_distinct, got["s"].avg_width, got["s"].max_length) == (3, 1, 2, 2.5, 3)
    assert (got["n"].n_distinct, got["a"].nulls, got["a"].data_type) == (2, 1, "array")


def test_unique_columns_screen_is_exact_for_near_unique_columns(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") == 4999, 0).otherwise(F.col("id")).alias("almost"), (F.col("id") % 7).alias("few"), F.lit(None).cast("int").alias("none"))
    assert {r.column_name: r.is_unique for r in profile.unique_columns(df, "t").collect()} == {"id": True, "almost": False, "few": False, "none": True}


def test_drift_kinds(spark):
    a = spark.createDataFrame([(1, "x", "y", 1)], "a int, b string, c string, d int")
    b = spark.createDataFrame([("1", None, 1, 2.0)], "a string, b string, d int, e double")
    out = {r.column_name: (r.change, r.has_drift) for r in drift.drift(profile.profile(a, "t"), profile.profile(b, "t")).collect()}
    assert out == {"a": ("retyped", True), "b": ("nullability", True), "c": ("removed", True), "d": ("none", False), "e": ("added", True)}


# References


def test_implied_fk_prefers_the_named_table(spark):
    emails = spark.createDataFrame([("a",), ("b",)], "email string")
    tables = {
        "public.users": emails, "clinical.providers": emails.where("email = 'a'"),
        "clinical.documents": spark.createDataFrame([("a", "b", "a"), ("c", None, "a")], "provider_email string, uploaded_by_user_email string, email string"),
    }
    specs = {
        "public.users": TableSpec("public.users", uniques=(("email",),)),
        "clinical.providers": TableSpec("clinical.providers", uniques=(("email",),)),
    }
    out = {r.source_column: r for r in references.implied_fks(tables, specs).collect()}
    assert set(out) == {"provider_email", "uploaded_by_user_email"}
    assert (out["provider_email"].suggested_alias, out["provider_email"].containment) == ("clinical.providers.email", 0.5)
    assert (out["uploaded_by_user_email"].suggested_alias, out["uploaded_by_user_email"].matched_rows) == ("public.users.email", 1)
    silenced = references.implied_fks(tables, specs, ignore=["clinical.documents.provider_email"])
    assert [r.source_column for r in silenced.collect()] == ["uploaded_by_user_email"]
    declared = {**specs, "clinical.documents": TableSpec("clinical.documents", fks=(ForeignKey(("provider_email",), "clinical.providers", ("email",)),))}
    assert [r.source_column for r in references.implied_fks(tables, declared).collect()] == ["uploaded_by_user_email"]


def test_polymorphic_pairs(spark):
    comments = spark.createDataFrame([("Post", 1), ("Post", 1), ("Photo", 2)], "commentable_type string, commentable_id long")
    other = spark.createDataFrame([(1, 2.0)], "kind_type int, kind_id double")
    out = references.polymorphic_refs({"public.comments": comments, "public.other": other})
    assert rows(out.select("type_value", "n_rows", "n_ids")) == [("Photo", 1, 1), ("Post", 2, 1)]


# Verification


@pytest.mark.parametrize("pairs,verdict,detail", [
    ([("a", "x"), ("b", "y")], "pass", "changed: all of 2"),
    ([("a", "a"), ("b", "b")], "fail", "no value differs from its original"),
    ([("a", "a"), ("b", "y"), (None, None)], "warn", "50% changed, originals left: 1"),
    ([(None, None)], "warn", "nothing but NULLs to compare"),
    ([(None, "x")], "pass", "changed: all of 1"),
])
@pytest.mark.parametrize("sample", [1000, None])
def test_change_rate_verdicts(spark, pairs, verdict, detail, sample):
    src = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "id int, v string")
    tgt = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(pairs)], "id int, v string")
    out = verify.row_checks(src, tgt, TableSpec("public.t", pk=("id",)), ["v"], sample).where("target = 'public.t.v'").first()
    assert (out["check"], out.verdict, out.detail) == ("column.change_rate", verdict, detail)


def test_row_check_edges(spark):
    spec = TableSpec("public.t", pk=("id",))
    src = spark.createDataFrame([(1, "a")], "id int, v string")
    far = spark.createDataFrame([(2, "a")], "id int, v string")
    out = verify.row_checks(src, far, spec, ["v"]).collect()
    assert [(r["check"], r.verdict, r.target) for r in out] == [("table.sample_match", "warn", "public.t")]
    assert verify.row_checks(src.limit(0), far, spec, ["v"]).collect() == []
    for pk, found in (((), "table.no_pk"), (("id", "v"), "table.sample_match")):
        out = verify.row_checks(src, far, TableSpec("public.t", pk=pk), ["v"]).collect()
        assert [r["check"] for r in out] == [found]
    moved = spark.createDataFrame([(1, "b")], "id int, v string")
    out = verify.row_checks(src, moved, spec, []).where("verdict = 'fail'").first()
    assert out.detail == "1 value(s) differ where none should"


def test_verify_report_gate(spark):
    src = spark.createDataFrame([(1, "a")], "id int, v string")
    spec = {"t": TableSpec("t", pk=("id",))}
    good = verify.verify({"t": src}, {"t": src.withColumn("v", F.lit("z"))}, spec, {"t": {"v": Hash()}})
    bad = verify.verify({"t": src}, {"t": src}, spec, {"t": {"v": Hash()}})
    assert verify.is_ok(good) and not verify.is_ok(bad)
    assert {r.verdict: r.checks for r in verify.verdict_counts(bad).collect()} == {"pass": 3, "warn": 0, "fail": 1}
    assert verify.verify({"t": src}, {}, spec, {}, strategies={"t": "empty"}) is None


def test_orphans_ignore_null_and_composite_parts(spark):
    child = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "a"), (1, None)], "x int, y string")
    parent = spark.createDataFrame([(1, "a"), (1, "a")], "px int, py string")
    fk = ForeignKey(("x", "y"), "p", ("px", "py"))
    assert verify.orphan_count(child, parent, fk).first().n == 2


def test_leak_probe_and_shapes(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "v string")
    assert tuple(verify.leak_probe(df, "t", "v", ["a", "zz"]).first())[2:] == (1, 2)
    assert tuple(verify.leak_probe(df, "t", "v", (df.where("v = 'b'"), "v")).first())[2:] == (1, 1)
    assert tuple(verify.shape_check(df, "t", {"v": "^a$"}).first())[2:] == (3, 1)


# Referential operators


def demo(spark):
    orgs = spark.createDataFrame([(1, "Acme"), (2, "Beta"), (3, "Gamma")], "id long, name string")
    users = spark.createDataFrame([(o * 100 + i, o) for o, n in ((1, 2), (2, 3), (3, 5)) for i in range(1, n + 1)], "id long, org_id long")
    counts = {101: 2, 102: 2, 201: 3, 202: 3, 203: 3, 301: 2, 302: 2, 303: 2, 304: 2, 305: 2}
    orders = spark.createDataFrame([(u * 10 + i, u) for u, n in counts.items() for i in range(n)], "id long, user_id long")
    specs = {
        "organizations": TableSpec("organizations", pk=("id",)),
        "users": TableSpec("users", pk=("id",), fks=(ForeignKey(("org_id",), "organizations", ("id",)),)),
        "orders": TableSpec("orders", pk=("id",), fks=(ForeignKey(("user_id",), "users", ("id",)),)),
        "unrelated": TableSpec("unrelated", pk=("id",)),
    }
    return {"organizations": orgs, "users": users, "orders": orders, "unrelated": spark.range(5)}, specs


def test_subset_of_one_tenant(spark):
    tables, specs = demo(spark)
    out = referential.subset(tables, specs, {"organizations": "id = 1"})
    assert {n: df.count() for n, df in out.items()} == {"organizations": 1, "users": 2, "orders": 4, "unrelated": 0}
    up = referential.subset(tables, specs, {"orders": "id = 3050"})
    assert {n: rows(df.select("id")) for n, df in up.items()} == {"organizations": [(3,)], "users": [(305,)], "orders": [(3050,)], "unrelated": []}
    both = referential.subset(tables, specs, {"organizations": "id = 1", "users": "id = 201"})
    assert {n: df.count() for n, df in both.items()} == {"organizations": 2, "users": 3, "orders": 7, "unrelated": 0}
    with pytest.raises(MaskError):
        referential.subset(tables, specs, {"nope": "true"})


def closure(edges, seeds):
    """Brute-force reachability over (child row, parent row) pairs."""
    down, grown = set(seeds), True
    while grown:
        new = {c for c, p in edges if p in down} - down
        down |= new
        grown = bool(new)
    kept, grown = set(down), True
    while grown:
        new = {p for c, p in edges if c in kept} - kept
        kept |= new
        grown = bool(new)
    return kept


def test_subset_over_a_two_table_cycle(spark):
    import random

    rng = random.Random(5)
    users = [(i, rng.choice([None, *range(1, 30)])) for i in range(1, 40)]
    orders = [(i, rng.choice([None, *range(1, 40)])) for i in range(1, 30)]
    tables = {
        "users": spark.createDataFrame(users, "id int, last_order_id int"),
        "orders": spark.createDataFrame(orders, "id int, user_id int"),
    }
    specs = {
        "users": TableSpec("users", pk=("id",), fks=(ForeignKey(("last_order_id",), "orders", ("id",)),)),
        "orders": TableSpec("orders", pk=("id",), fks=(ForeignKey(("user_id",), "users", ("id",)),)),
    }
    edges = [(("u", i), ("o", o)) for i, o in users if o] + [(("o", i), ("u", u)) for i, u in orders if u]
    for root in (1, 7, 20):
        out = referential.subset(tables, specs, {"users": f"id = {root}"})
        got = {("u", r.id) for r in out["users"].collect()} | {("o", r.id) for r in out["orders"].collect()}
        assert got == closure(edges, {("u", root)})


def test_subset_bounds_its_rounds(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(12)], "id int, boss int")
    spec = {"e": TableSpec("e", pk=("id",), fks=(ForeignKey(("boss",), "e", ("id",)),))}
    assert referential.subset({"e": chain}, spec, {"e": "id = 3"})["e"].count() == 12
    with pytest.raises(MaskError, match="settle"):
        referential.subset({"e": chain}, spec, {"e": "id = 3"}, max_rounds=2)


def test_orphans_become_null_and_others_stay(spark):
    child = spark.createDataFrame([(1, 1, "x"), (2, 9, "y"), (3, None, "z")], "id int, p int, note string")
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    spec = TableSpec("c", fks=(ForeignKey(("p",), "par", ("id",)),))
    assert rows(referential.null_orphan_fks(child, {"par": parent}, spec).fillna(-1)) == [(1, 1, "x"), (2, -1, "y"), (3, -1, "z")]


def test_exclude_conflicts(spark):
    child = spark.createDataFrame([(1, 1, "n"), (2, 2, None)], "id int, parent_id int, note string")
    specs = {
        "parent": TableSpec("parent", pk=("id",)),
        "child": TableSpec("child", fks=(ForeignKey(("parent_id",), "parent", ("id",)),), not_null=frozenset({"parent_id"})),
    }
    tables = {"parent": spark.range(3), "child": child}
    assert [tuple(r) for r in referential.exclude_conflicts(tables, specs, {"parent": "exclude"}).collect()] == [("child", "parent_id", "parent", 2)]
    assert referential.exclude_conflicts(tables, specs, {"parent": "exclude"}, nulling=["child"]).count() == 0
    assert referential.exclude_conflicts(tables, specs, {"parent": "exclude", "child": "exclude"}).count() == 0


# Skew


@pytest.mark.parametrize("how", ["inner", "left_outer", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot_known", [True, False])
def test_heavy_keys_give_the_same_rows(spark, how, hot_known):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, None).otherwise(F.col("id") % 500).alias("k"))
    right = spark.range(400).where("id <> 7" if not hot_known else "true").select(F.col("id").cast("int").alias("r"), F.concat(F.lit("v"), "id").alias("v"))
    assert len(heavy_keys(left, ["k"], rows_per_task=500).hashes) == 2
    salted = key_join(left, right, [("k", "r")], how, rows_per_task=500)
    plain = key_join(left, right, [("k", "r")], how, heavy=NO_HEAVY_KEYS)
    assert salted.columns == plain.columns
    assert verify.diff_runs(salted, plain).count() == 0


MIXED = {
    "text and int": ("concat('0', id % 3)", "cast(id AS int)"),
    "int and text": ("cast(id % 3 AS int)", "concat('00', id)"),
    "decimal scales": ("cast(id % 3 AS decimal(10,2))", "cast(id AS decimal(12,4))"),
    "double and bigint": ("cast(id % 3 AS double)", "id"),
    "date and timestamp": ("date_add(date'2020-01-01', cast(id % 3 AS int))", "cast(date_add(date'2020-01-01', cast(id AS int)) AS timestamp)"),
    "text that is no number": ("if(id % 3 = 0, 'x', '1')", "cast(id AS int)"),
}


@pytest.mark.parametrize("case", MIXED)
def test_unequal_key_types_survive_salting(spark, case):
    own, other = MIXED[case]
    left, right = spark.range(900).selectExpr(f"{own} AS k"), spark.range(2).selectExpr(f"{other} AS r")
    for how in ("left_semi", "left_anti"):
        salted = key_join(left, right, [("k", "r")], how, rows_per_task=100)
        plain = key_join(left, right, [("k", "r")], how, heavy=NO_HEAVY_KEYS)
        hits = 600
        assert salted.count() == plain.count() == (hits if how == "left_semi" else 900 - hits)


def test_equal_rows_of_a_heavy_key_are_spread(spark):
    left = spark.range(0, 1000, 1, 8).select(F.lit(7).alias("k"))
    joined = key_join(left, spark.range(10), [("k", "id")], "left_semi", rows_per_task=100)
    plan = joined._jdf.queryExecution().toString()
    assert "__salt" in plan and "SPARK_PARTITION_ID" in plan
    assert joined.count() == 1000


def test_keys_of_other_types_are_refused(spark):
    with pytest.raises(MaskError):
        key_join(spark.range(3), spark.range(3).selectExpr("array(id) AS r"), [("id", "r")], "left_semi")


def test_text_keys_keep_their_children_and_parents(spark):
    parents = spark.range(20).selectExpr("cast(id AS int) AS id")
    children = spark.range(1000).selectExpr("id AS n", "lpad(cast(if(id % 3 = 0, 7, id % 20) AS string), 4, '0') AS p")
    specs = {"p": TableSpec("p", pk=("id",)), "c": TableSpec("c", pk=("n",), fks=(ForeignKey(("p",), "p", ("id",)),))}
    kept = referential.subset({"p": parents, "c": children}, specs, {"p": "true"})
    assert kept["c"].count() == 1000
    assert referential.null_orphan_fks(children, {"p": parents}, specs["c"]).where("p IS NULL").count() == 0


def test_no_heavy_key_leaves_the_join_alone(spark):
    left = spark.range(10_000).withColumnRenamed("id", "k")
    assert heavy_keys(left, ["k"]) == NO_HEAVY_KEYS
    assert "__salt" not in key_join(left, spark.range(5), [("k", "id")], "left_semi")._jdf.queryExecution().toString()


# Audit


def test_audit_counts_match_the_observed_ones(spark, ctx):
    from maskframe.operators.mask import plan_mask

    df = spark.createDataFrame([(1, "a", None), (2, None, "x"), (3, "", "y")], "id int, v string, w string")
    table_rules = {"v": Fake("city"), "w": Null(when="id = 2")}
    direct = audit.audit_masking(df, table_rules, ctx, table="t", run_id="r")
    masked, observation = audit.observed_mask(plan_mask(df, table_rules, ctx, table="t"), "obs")
    assert rows(masked.fillna("-")) == rows(mask_table(df, table_rules, ctx, table="t").fillna("-"))
    masked.write.format("noop").mode("overwrite").save()
    observed = audit.observed_events(spark, plan_mask(df, table_rules, ctx, table="t"), observation, table="t", run_id="r")
    assert rows(direct) == rows(observed)
    assert ("r", "column.masked", "t", "v", "fake", 2, 1) in rows(direct)
    skipped = audit.conditional_skips(df, table_rules, table="t", run_id="r")
    assert [(r.column_name, r.skipped) for r in skipped.collect()] == [("w", 2)]


def test_rules_hash_ignores_order():
    a = {"t": {"x": Hash(), "y": Fake("email", params={"domain": "d"})}}
    b = {"t": {"y": Fake("email", params={"domain": "d"}), "x": Hash()}}
    assert audit.rules_hash(a) == audit.rules_hash(b) != audit.rules_hash({"t": {"x": Hash()}})


def test_secrets_stay_out_of_plans_and_reprs(spark, ctx):
    df = spark.createDataFrame([("a",)], "v string")
    assert ctx.salt not in repr(ctx) and ctx.key not in repr(ctx)
    from contextlib import redirect_stdout
    from io import StringIO

    out = StringIO()
    with redirect_stdout(out):
        mask_table(df, {"v": Hash()}, ctx, table="t").explain()
    assert ctx.salt.encode().hex().upper()[:16] not in out.getvalue().upper()


# Consistency of masked keys


def test_masked_keys_are_counted_without_conditions_on_them(spark, ctx):
    customer = spark.createDataFrame([(1, "José"), (2, "b"), (3, None)], "id int, name string")
    orders = spark.createDataFrame([(1, "José"), (2, "José"), (3, "b"), (4, None), (5, "x")], "id int, cname string")
    fk = ForeignKey(("cname",), "customer", ("name",))
    specs = {"customer": TableSpec("customer", pk=("id",), uniques=(("name",),)), "orders": TableSpec("orders", pk=("id",), fks=(fk,))}
    fakes = {"customer": {"name": Fake("full_name")}, "orders": {"cname": Fake("full_name")}}
    masked = mask_tables({"customer": customer, "orders": orders}, fakes, ctx, specs, fk_paths=True)
    out = referential.fk_mask_consistency((orders, customer), (masked["orders"], masked["customer"]), fk, "orders")
    # A condition on a masked key took the expressions below the masking, gigabytes of plan text.
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "Filter" not in plan and "Join" not in plan
    assert rows(out) == [("orders(cname)", 3, 3, True)]


def test_keys_of_two_types_and_null_parts_join_as_before(spark):
    fk = ForeignKey(("a", "b"), "parent", ("x", "y"))
    parent = spark.createDataFrame([(1, "p"), (1, "p"), (2, "q"), (None, "p"), (3, None)], "x bigint, y string")
    child = spark.createDataFrame([(1, "p"), (1, "p"), (1, None), (None, "p"), (2, "q"), (4, "q"), (3, None)], "a int, b string")
    masked = child.withColumn("b", F.lit("p"))
    assert rows(referential.fk_mask_consistency((child, parent), (masked, parent), fk, "child")) == [("child(a, b)", 5, 6, False)]
    nothing = (child.limit(0), parent)
    assert rows(referential.fk_mask_consistency(nothing, nothing, fk, "child")) == [("child(a, b)", 0, 0, True)]

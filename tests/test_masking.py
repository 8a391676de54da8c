import base64
import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskframe import (
    Fake, Hash, HmacHash, MaskError, Null, Passthrough, Pseudonym, RegexMask, Static, TableSpec,
    mask_partitioned, mask_table, mask_tables,
)
from maskframe.functions import known_providers
from maskframe.spec import ForeignKey
from tests import golden

VALUES = [
    None, "", "alice@acme.example", "+44 20 7946 0000", "5551234567", " 1-800", "1990-02-30",
    "1990-02-28", "2031-01-01", "Ünï cödé", "é vs é", "日本語 テキスト", "😀 emoji", "a" * 300,
    "Åbc", "ﬁ ligature", " 1988-12-01 ", "x\ny", "'quote' \\ back",
]


def frame(spark, values=VALUES):
    return spark.createDataFrame(list(enumerate(values)), "id int, v string")


@pytest.mark.parametrize("unique", [False, True])
@pytest.mark.parametrize("provider", sorted(known_providers()))
def test_every_provider_matches_the_plain_definition(spark, ctx, provider, unique):
    df = frame(spark)
    spec = TableSpec("public.t", pk=("v",) if unique else ())
    rows = mask_table(df, {"v": Fake(provider)}, ctx, table=spec).collect()
    for r in rows:
        assert r.v == golden.fake(provider, VALUES[r.id], ctx, "public.t.v", unique), VALUES[r.id]
    keyed = mask_table(df, {"v": Pseudonym(provider)}, ctx, table=spec).collect()
    for r in keyed:
        assert r.v == golden.pseudonym(provider, VALUES[r.id], ctx, "public.t.v", unique)


def test_many_seeds_agree(spark, ctx):
    values = [f"value {i}" for i in range(3000)]
    df = frame(spark, values)
    names = sorted(known_providers())
    wide = df.select("id", *[F.col("v").alias(n) for n in names])
    rows = mask_table(wide, {n: Fake(n) for n in names}, ctx, table="public.t").collect()
    for r in rows:
        for n in names:
            assert r[n] == golden.fake(n, values[r.id], ctx, f"public.t.{n}")


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"])), min_size=1, max_size=60))
def test_random_unicode_is_total_and_matches(spark, ctx, values):
    df = frame(spark, values)
    rules = {"v": Fake("email")}
    for mode in ("jvm", "arrow"):
        from dataclasses import replace

        got = {r.id: r.v for r in mask_table(df, rules, replace(ctx, nfc=mode), table="t").collect()}
        assert got == {i: golden.fake("email", v, ctx, "t.v") for i, v in enumerate(values)}


def test_hash_and_hmac(spark, ctx):
    df = frame(spark).select("id", "v", F.col("v").alias("w"), F.col("v").alias("x"))
    rules = {"v": Hash(), "w": HmacHash(), "x": HmacHash("base64url")}
    for r in mask_table(df, rules, ctx, table="t").collect():
        v = VALUES[r.id]
        if not v:
            assert (r.v, r.w, r.x) == (v, v, v)
            continue
        assert r.v == hashlib.sha256((ctx.salt + v).encode()).hexdigest()
        assert r.w == golden.keyed(ctx.key, "t.w", v).hex()
        expected = base64.urlsafe_b64encode(golden.keyed(ctx.key, "t.x", v)).rstrip(b"=").decode()
        assert r.x == expected


def test_null_and_empty_contract(spark, ctx):
    df = spark.createDataFrame([(None, None, None), ("", "", ""), ("x", "x", "x")], "a string, b string, c string")
    rules = {"a": Null(), "b": Static("S"), "c": Passthrough()}
    assert [tuple(r) for r in mask_table(df, rules, ctx, table="t").collect()] == [
        (None, None, None), (None, "S", ""), (None, "S", "x"),
    ]


def test_python_text_of_typed_values(spark, ctx):
    import datetime as dt
    import struct

    doubles = [1.0, 0.1, 1e7, 12345678.9, 1e15, 1e16, 1.5e16, 1e-4, 1.25e-5, -2.5e20, 123456789012345.6, 0.001, 5e-7]
    df = spark.createDataFrame([(d,) for d in doubles], "v double").select("v", F.col("v").alias("h"))
    out = mask_table(df, {"h": Hash()}, ctx, table="t", coerce=False).collect()
    for r in out:
        assert r.h == hashlib.sha256((ctx.salt + str(r.v)).encode()).hexdigest(), r.v
    stamps = [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4, 5, 120000)]
    df = spark.createDataFrame([(s, s.date(), True, 7) for s in stamps], "t timestamp_ntz, d date, b boolean, n bigint")
    wide = df.select(*[F.col(c) for c in df.columns], *[F.col(c).alias("h" + c) for c in df.columns])
    out = mask_table(wide, {"h" + c: Hash() for c in df.columns}, ctx, table="t", coerce=False).collect()
    for r in out:
        for c in df.columns:
            assert r["h" + c] == hashlib.sha256((ctx.salt + str(r[c])).encode()).hexdigest()
    floats = spark.createDataFrame([(0.1,), (3.5,)], "f float").select("f", F.col("f").alias("h"))
    for r in mask_table(floats, {"h": Hash()}, ctx, table="t", coerce=False).collect():
        widened = struct.unpack("f", struct.pack("f", r.f))[0]
        assert r.h == hashlib.sha256((ctx.salt + str(widened)).encode()).hexdigest()


def test_values_return_to_their_column_type(spark, ctx):
    df = spark.createDataFrame([(7, "1990-01-01"), (None, None)], "n bigint, d string")
    df = df.withColumn("d", F.col("d").cast("date"))
    out = mask_table(df, {"n": Fake("postcode"), "d": Fake("dob")}, ctx, table="t")
    assert out.schema.simpleString() == "struct<n:bigint,d:date>"
    rows = out.collect()
    assert rows[0].n == int(golden.fake("postcode", "7", ctx, "t.n"))
    assert str(rows[0].d) == golden.fake("dob", "1990-01-01", ctx, "t.d")
    assert tuple(rows[1]) == (None, None)


def test_failed_coercion_names_the_column_and_no_value(spark, ctx):
    df = spark.createDataFrame([(123456789,)], "n bigint")
    with pytest.raises(Exception) as info:
        mask_table(df, {"n": Fake("city")}, ctx, table="public.t").collect()
    text = str(info.value)
    assert "public.t.n" in text and golden.fake("city", "123456789", ctx, "public.t.n") not in text


def test_rules_are_checked_before_reading(spark, ctx):
    df = frame(spark)
    with pytest.raises(MaskError, match="public.t.v -> nope"):
        mask_table(df, {"v": Fake("nope")}, ctx, table="public.t")
    with pytest.raises(MaskError, match="no such column"):
        mask_table(df, {"w": Hash()}, ctx, table="public.t")
    with pytest.raises(MaskError, match="requires a text column"):
        mask_table(df, {"id": RegexMask("a", "b")}, ctx, table="public.t")


def test_hostile_names_and_order(spark, ctx):
    df = spark.createDataFrame([("x", "a@b", 1)], ['we"ird `name`', "e.mail", "n"])
    out = mask_table(df, {'we"ird `name`': Hash(), "e.mail": Fake("email")}, ctx, table="t")
    assert out.columns == df.columns
    assert out.first()["e.mail"] == golden.fake("email", "a@b", ctx, "t.e.mail")


def test_salt_isolation_and_determinism(spark, ctx):
    from dataclasses import replace

    df = frame(spark, [f"user{i}@x.test" for i in range(200)])
    rules = {"v": Fake("email")}
    spec = TableSpec("t", pk=("v",))
    one = mask_table(df, rules, ctx, table=spec).orderBy("id").collect()
    two = mask_table(df.repartition(7), rules, ctx, table=spec).orderBy("id").collect()
    other = mask_table(df, rules, replace(ctx, salt="b" * 64), table=spec).orderBy("id").collect()
    assert one == two
    assert all(a.v != b.v for a, b in zip(one, other, strict=True))
    assert len({r.v for r in one}) == 200


def test_alias_keeps_joins_when_the_parent_is_unique(spark, ctx):
    users = spark.createDataFrame([(i, f"u{i}@x.test") for i in range(50)], "id int, email string")
    docs = spark.createDataFrame([(i, f"u{i % 50}@x.test") for i in range(120)], "id int, by_email string")
    specs = {
        "public.users": TableSpec("public.users", pk=("id",), uniques=(("email",),)),
        "public.docs": TableSpec("public.docs", pk=("id",), fks=(ForeignKey(("by_email",), "public.users", ("email",)),)),
    }
    tables = {"public.users": users, "public.docs": docs}
    explicit = {"public.users": {"email": Fake("email")}, "public.docs": {"by_email": Fake("email", seed_alias="public.users.email")}}
    implied = {"public.users": {"email": Fake("email")}, "public.docs": {"by_email": Fake("email")}}
    for rules, fk_paths in ((explicit, False), (implied, True)):
        out = mask_tables(tables, rules, ctx, specs, fk_paths=fk_paths)
        joined = out["public.docs"].join(out["public.users"], F.col("by_email") == F.col("email"))
        assert joined.count() == 120
    apart = mask_tables(tables, implied, ctx, specs)
    assert apart["public.docs"].join(apart["public.users"], F.col("by_email") == F.col("email")).count() == 0


def test_guard_leaves_other_cells_alone(spark, ctx):
    df = frame(spark, ["a", "b", None, ""])
    out = mask_table(df, {"v": Fake("city", when="id % 2 = 1")}, ctx, table="t").orderBy("id").collect()
    assert out[0].v == "a" and out[1].v == golden.fake("city", "b", ctx, "t.v")
    assert out[2].v is None and out[3].v == ""


def test_partition_children_share_the_parent_seed(spark, ctx):
    a = spark.createDataFrame([(1, "x")], "id int, v string")
    b = spark.createDataFrame([(2, "x")], "id int, v string")
    children = {"public.e_2024": a, "public.e_2025": b}
    parent = TableSpec("public.e")
    rules = {"v": Fake("uuid")}
    same = {r.v for r in mask_partitioned(children, rules, ctx, parent=parent).collect()}
    apart = {r.v for r in mask_partitioned(children, rules, ctx, parent=parent, seed_by="child").collect()}
    assert same == {golden.fake("uuid", "x", ctx, "public.e.v")}
    assert apart == {golden.fake("uuid", "x", ctx, f"{c}.v") for c in children}


def test_custom_provider_and_hook(spark, ctx):
    from maskframe.functions import register_provider, restore_builtin_providers

    register_provider("badge", lambda seed, value, params, c: F.lpad(seed.mod(10**6).cast("string"), 6, "0"))
    try:
        df = frame(spark, ["a", "b", "c"])
        rows = mask_table(df, {"v": Fake("badge")}, ctx, table=TableSpec("t", pk=("v",))).collect()
        for r in rows:
            s = golden.seed(ctx.salt, "t.v", "abc"[r.id])
            assert r.v == f"{golden.num(s) % 10**6:06d}"
        hooked = mask_table(df, {"v": Fake("badge")}, ctx, table="t", post_process={"v": F.reverse})
        plain = mask_table(df, {"v": Fake("badge")}, ctx, table="t")
        assert [r.v[::-1] for r in plain.orderBy("id").collect()] == [r.v for r in hooked.orderBy("id").collect()]
    finally:
        restore_builtin_providers()
    with pytest.raises(ValueError):
        register_provider("", lambda *a: None)

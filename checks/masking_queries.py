"""Queries over the masking projection, its actions and the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import sqlgen as g
from checks.inputs import PEOPLE_SQL, SPECS, people, table
from checks.registry import query
from maskframe import (
    Fake, Hash, HmacHash, JsonMask, NerMask, Null, Passthrough, Pseudonym, RegexMask, Static,
    TableSpec, mask_partitioned, mask_table, mask_tables,
)
from maskframe import functions as mf
from maskframe.functions.seeds import Seed
from maskframe.operators.ner import pattern_finder

CTX = g.CTX
PEOPLE = TableSpec("app.people", pk=("id",))
W = "WITH " + PEOPLE_SQL


@query(
    "mask_table",
    f"""SELECT c_custkey, {g.fake('full_name', 'c_name', 'customer.c_name', unique=True)} AS c_name,
        c_nationkey, c_acctbal, {g.salted_hash('c_mktsegment')} AS c_mktsegment FROM customer""",
)
def mask_customer(spark: SparkSession, sf: str) -> DataFrame:
    rules = {"c_name": Fake("full_name"), "c_mktsegment": Hash()}
    return mask_table(table(spark, sf, "customer"), rules, CTX, table=SPECS["customer"])


@query("mask_passthrough", "SELECT * FROM supplier")
def mask_passthrough(spark: SparkSession, sf: str) -> DataFrame:
    rules = {"s_name": Passthrough()}
    return mask_table(table(spark, sf, "supplier"), rules, CTX, table="supplier")


@query("mask_null", f"{W} SELECT id, NULL::VARCHAR AS email, phone, NULL::INT AS nation_id FROM people")
def mask_null(spark: SparkSession, sf: str) -> DataFrame:
    df = people(spark, sf).select("id", "email", "phone", "nation_id")
    return mask_table(df, {"email": Null(), "nation_id": Null()}, CTX, table=PEOPLE)


@query("mask_static", f"{W} SELECT id, CASE WHEN email IS NOT NULL THEN 'hidden' END AS email, 7 AS nation_id FROM people")
def mask_static(spark: SparkSession, sf: str) -> DataFrame:
    df = people(spark, sf).select("id", "email", "nation_id")
    return mask_table(df, {"email": Static("hidden"), "nation_id": Static("7")}, CTX, table=PEOPLE)


@query(
    "mask_hash",
    f"""SELECT o_orderkey, {g.salted_hash('o_orderpriority')} AS o_orderpriority,
        {g.salted_hash('o_custkey::VARCHAR')} AS cust_hash,
        {g.salted_hash("strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')")} AS date_hash FROM orders""",
)
def mask_hash(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderpriority", F.col("o_custkey").alias("cust_hash"), F.col("o_orderdate").alias("date_hash")
    )
    rules = {"o_orderpriority": Hash(), "cust_hash": Hash(), "date_hash": Hash()}
    return mask_table(df, rules, CTX, table="orders", coerce=False)


def _base64url(digest: str) -> str:
    return f"rtrim(translate(to_base64(unhex({digest})), '+/', '-_'), '=')"


@query(
    "mask_hmac_hash",
    f"""{W} SELECT id, CASE WHEN email IS NULL OR email = '' THEN email ELSE {g.digest('email', 'app.people.email')} END AS email,
        {_base64url(g.digest('phone', 'app.people.phone'))} AS phone FROM people""",
)
def mask_hmac_hash(spark: SparkSession, sf: str) -> DataFrame:
    df = people(spark, sf).select("id", "email", "phone")
    return mask_table(df, {"email": HmacHash(), "phone": HmacHash("base64url")}, CTX, table=PEOPLE)


@query(
    "mask_pseudonym",
    f"""{W} SELECT id, {g.pseudonym('email', 'email', 'app.people.email')} AS email,
        {g.pseudonym('full_name', 'name', 'crm.contacts.name')} AS name,
        {g.pseudonym('dob', 'dob', 'app.people.dob')} AS dob FROM people""",
)
def mask_pseudonym(spark: SparkSession, sf: str) -> DataFrame:
    df = people(spark, sf).select("id", "email", "name", "dob")
    rules = {
        "email": Pseudonym("email"), "name": Pseudonym("full_name", seed_alias="crm.contacts.name"),
        "dob": Pseudonym("dob"),
    }
    return mask_table(df, rules, CTX, table=PEOPLE)


@query(
    "mask_fake",
    f"""{W} SELECT id, {g.fake('email', 'email', 'app.people.email', unique=True)} AS email,
        {g.fake('phone', 'phone', 'app.people.phone')} AS phone,
        {g.fake('ssn', 'ssn', 'app.people.ssn')} AS ssn,
        {g.fake('dob', 'dob', 'app.people.dob')} AS dob,
        {g.fake('full_name', 'name', 'app.people.name')} AS name FROM people""",
)
def mask_fake(spark: SparkSession, sf: str) -> DataFrame:
    df = people(spark, sf).select("id", "email", "phone", "ssn", "dob", "name")
    rules = {c: Fake(p) for c, p in {"email": "email", "phone": "phone", "ssn": "ssn", "dob": "dob", "name": "full_name"}.items()}
    return mask_table(df, rules, CTX, table=TableSpec("app.people", pk=("id",), uniques=(("email",),)))


@query(
    "mask_lineitem",
    f"""SELECT l_linenumber, l_quantity, l_extendedprice,
        {g.fake('uuid', 'l_orderkey::VARCHAR', 'lineitem.l_orderkey')} AS l_orderkey,
        {g.fake('company', 'l_suppkey::VARCHAR', 'lineitem.l_suppkey')} AS l_suppkey,
        {g.salted_hash('l_partkey::VARCHAR')} AS l_partkey FROM lineitem""",
)
def mask_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").select(
        "l_linenumber", "l_quantity", "l_extendedprice", "l_orderkey", "l_suppkey", "l_partkey"
    )
    rules = {"l_orderkey": Fake("uuid"), "l_suppkey": Fake("company"), "l_partkey": Hash()}
    return mask_table(df, rules, CTX, table="lineitem", coerce=False)


@query(
    "mask_regex",
    r"""SELECT page_id, regexp_replace(regexp_replace(url, '([a-z0-9.]+)\.example\.(com|net|org)', 'host-\1', 'g'), '\d+', '#', 'g') AS url
        FROM (SELECT page_id, url FROM pages)""",
)
def mask_regex(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "pages").select("page_id", "url")
    once = mask_table(df, {"url": RegexMask(r"([a-z0-9.]+)\.example\.(com|net|org)", r"host-\1")}, CTX, table="pages")
    return mask_table(once, {"url": RegexMask(r"\d+", "#")}, CTX, table="pages")


@query(
    "mask_regex_in_python",
    r"""SELECT conv_id, turn, regexp_replace(regexp_replace(text, '[aeiou]{2}', '<>', 'g'), '([.,]) ', '\1_', 'g') AS text FROM conversations""",
)
def mask_regex_in_python(spark: SparkSession, sf: str) -> DataFrame:
    """The named group and the non-translatable escape send this one through the Arrow path."""
    df = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    once = mask_table(df, {"text": RegexMask(r"(?P<pair>[aeiou]{2})", "<>")}, CTX, table="conversations")
    return mask_table(once, {"text": RegexMask(r"(?P<mark>[.,]) ", r"\g<mark>_")}, CTX, table="conversations")


NER_PATTERNS = {"PERSON": "Ea[a-z]+", "ORG": "Th[a-z]+"}


def ner_sql(source: str = "documents", key: str = "doc_id", column: str = "text", path: str = "documents.text") -> str:
    """``key`` and ``column`` of a table, the latter with what ``NER_PATTERNS`` find replaced."""
    pattern = "Ea[a-z]+|Th[a-z]+"
    person = g.provider("full_name", "h")
    company = g.provider("company", "h")
    fake = (
        f"CASE WHEN starts_with(e, 'Th') THEN list_transform([{g.seed('e', path + '#ner:ORG')}], lambda h: {company})[1] "
        f"ELSE list_transform([{g.seed('e', path + '#ner:PERSON')}], lambda h: {person})[1] END"
    )
    return f"""SELECT {key}, CASE WHEN len(ents) = 0 THEN {column} ELSE
        array_to_string(list_transform(list_zip(parts, ents), lambda p: p[1] || coalesce(
          list_transform([p[2]], lambda e: CASE WHEN e IS NULL THEN '' ELSE {fake} END)[1], '')), '') END AS {column}
      FROM (SELECT {key}, {column}, regexp_extract_all({column}, '{pattern}') AS ents,
            string_split_regex({column}, '{pattern}') AS parts FROM {source})"""


@query("mask_ner", ner_sql())
def mask_ner(spark: SparkSession, sf: str) -> DataFrame:
    """Entity spans over whole documents, with a pattern-based span finder."""
    df = table(spark, sf, "documents").select("doc_id", "text")
    return mask_table(df, {"text": NerMask()}, CTX, table="documents", finder=pattern_finder(NER_PATTERNS))


_EVENT_JSON = """json_object('contact', json_object('email', 'u' || user_id || '@x.test', 'name', event_type),
    'token', 't' || event_id, 'debug', 'trace', 'note', 'hello', 'k', value)"""


def _event_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id",
        F.to_json(
            F.struct(
                F.struct(
                    F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@x.test")).alias("email"),
                    F.col("event_type").alias("name"),
                ).alias("contact"),
                F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("token"),
                F.lit("trace").alias("debug"),
                F.lit("hello").alias("note"),
                F.col("value").alias("k"),
            )
        ).alias("payload"),
    )


_JSON_PATHS = {"contact.email": Fake("email"), "token": Hash(), "debug": "remove", "note": Null()}
_JSON_SQL = f"""SELECT event_id,
    {g.fake('email', "'u' || user_id::VARCHAR || '@x.test'", 'events.payload#json:contact.email')} AS email,
    event_type AS name, {g.salted_hash("'t' || event_id::VARCHAR")} AS token, NULL::VARCHAR AS debug,
    NULL::VARCHAR AS note, value AS k FROM events"""


def _json_fields(masked: DataFrame) -> DataFrame:
    doc = F.from_json("payload", "contact struct<email:string,name:string>, token string, debug string, note string, k double")
    # In a select of its own: otherwise every field has the document read once more.
    return masked.select("event_id", doc.alias("d")).select(
        "event_id", "d.contact.email", "d.contact.name", "d.token", "d.debug", "d.note", "d.k"
    )


@query("mask_json_with_schema", _JSON_SQL)
def mask_json_with_schema(spark: SparkSession, sf: str) -> DataFrame:
    schema = "contact struct<email:string,name:string>, token string, debug string, note string, k double"
    rules = {"payload": JsonMask(_JSON_PATHS, schema=schema)}
    return _json_fields(mask_table(_event_documents(spark, sf), rules, CTX, table="events"))


@query("mask_json_open_schema", _JSON_SQL)
def mask_json_open_schema(spark: SparkSession, sf: str) -> DataFrame:
    rules = {"payload": JsonMask(_JSON_PATHS)}
    return _json_fields(mask_table(_event_documents(spark, sf), rules, CTX, table="events"))


_TEXT_PARTS = (
    '{"contact":{"email":"u', '@x.test","tags":["a",{"email":null}]}, "n" : "abc","debug":[1,{"k":2}],"big":12345678901234567890.10,"v":', '.50,"none":null,"token":"t', '"}'
)


@query(
    "mask_json_document_text",
    f"""SELECT event_id, '{{"contact":{{"email":"' || {g.fake('email', "'u' || user_id::VARCHAR || '@x.test'", 'events.payload#json:contact.email')}
        || '","tags":["a",{{"email":null}}]}}, "n" : "abc","big":12345678901234567890.10,"v":' || event_id::VARCHAR || '.50,"none":null,"token":"'
        || {g.salted_hash("'t' || event_id::VARCHAR")} || '"}}' AS payload FROM events""",
)
def mask_json_document_text(spark: SparkSession, sf: str) -> DataFrame:
    """The text of the documents: what no path names stays, though the schema knows less and says otherwise."""
    user, event = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    a, b, c, d = (F.lit(p) for p in _TEXT_PARTS)
    documents = table(spark, sf, "events").select("event_id", F.concat(a, user, b, event, c, event, d).alias("payload"))
    paths = {"contact.email": Fake("email"), "token": Hash(), "debug": "remove"}
    schema = "contact struct<email:string>, n int, token string, debug string, d double"
    return mask_table(documents, {"payload": JsonMask(paths, schema=schema)}, CTX, table="events")


@query(
    "mask_json_props",
    f"""SELECT event_id, ('{{"k": "' || {g.salted_hash("json_extract_string(props, '$.k')")} || '"}}') AS props FROM events""",
)
def mask_json_props(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").select("event_id", "props")
    return mask_table(df, {"props": JsonMask({"k": Hash()}, schema="k long")}, CTX, table="events")


@query(
    "mask_when",
    f"""SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000
        THEN {g.fake('company', 'o_orderpriority', 'orders.o_orderpriority')} ELSE o_orderpriority END AS o_orderpriority,
        CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders""",
)
def mask_when(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    rules = {
        "o_orderpriority": Fake("company", when="o_orderstatus = 'F' AND o_totalprice > 100000"),
        "o_totalprice": Null(when="o_orderkey % 2 = 0"),
    }
    return mask_table(df, rules, CTX, table="orders")


@query(
    "mask_null_and_empty",
    f"""{W} SELECT id, {g.fake('city', 'email', 'app.people.e_fake')} AS e_fake,
        CASE WHEN email IS NULL OR email = '' THEN email ELSE {g.salted_hash('email')} END AS e_hash,
        CASE WHEN email IS NULL OR email = '' THEN email ELSE {g.digest('email', 'app.people.e_hmac')} END AS e_hmac,
        regexp_replace(email, '[0-9]', 'x', 'g') AS e_regex, NULL::VARCHAR AS e_null,
        CASE WHEN email IS NOT NULL THEN 's' END AS e_static, email AS e_pass FROM people""",
)
def mask_null_and_empty(spark: SparkSession, sf: str) -> DataFrame:
    names = ["e_fake", "e_hash", "e_hmac", "e_regex", "e_null", "e_static", "e_pass"]
    df = people(spark, sf).select("id", *[F.col("email").alias(n) for n in names])
    rules = {
        "e_fake": Fake("city"), "e_hash": Hash(), "e_hmac": HmacHash(), "e_regex": RegexMask("[0-9]", "x"),
        "e_null": Null(), "e_static": Static("s"), "e_pass": Passthrough(),
    }
    return mask_table(df, rules, CTX, table=PEOPLE)


@query(
    "coerce_to",
    f"""{W} SELECT id, {g.fake('postcode', 'nation_id::VARCHAR', 'app.people.nation_id')}::INT AS nation_id,
        ({g.fake('dob', 'd', 'app.people.d')})::DATE AS d, id % 2 = 0 AS flag, hex(encode('hex' || id::VARCHAR)) AS raw,
        (id::VARCHAR || '.50')::DECIMAL(12,2)::VARCHAR AS amount
        FROM (SELECT *, (DATE '1950-01-01' + (id % 20000)::INT)::DATE::VARCHAR AS d FROM people)""",
)
def coerce_values(spark: SparkSession, sf: str) -> DataFrame:
    df = people(spark, sf).select(
        "id", "nation_id", F.date_add(F.lit("1950-01-01").cast("date"), (F.col("id") % 20000).cast("int")).alias("d")
    )
    masked = mask_table(df, {"nation_id": Fake("postcode"), "d": Fake("dob")}, CTX, table=PEOPLE)
    from pyspark.sql import types as T

    return masked.select(
        "id", "nation_id", "d",
        mf.coerce_to(F.when(F.col("id") % 2 == 0, "ON").otherwise(" off "), T.BooleanType(), "flag").alias("flag"),
        F.hex(mf.coerce_to(F.concat(F.lit("\\x"), F.hex(F.concat(F.lit("hex"), F.col("id").cast("string")).cast("binary"))), T.BinaryType(), "raw")).alias("raw"),
        mf.coerce_to(F.concat(F.col("id").cast("string"), F.lit(".5")), T.DecimalType(12, 2), "amount").cast("string").alias("amount"),
    )


@query(
    "seed_alias_join",
    """SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def seed_alias_join(spark: SparkSession, sf: str) -> DataFrame:
    """Orders carry the customer's name; masked separately, both sides still join."""
    customer = table(spark, sf, "customer").select("c_custkey", "c_name")
    orders = table(spark, sf, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_name").alias("o_cname"))
    rules = {
        "customer": {"c_name": Fake("username")},
        "orders": {"o_cname": Fake("username", seed_alias="customer.c_name")},
    }
    out = mask_tables({"customer": customer, "orders": orders}, rules, CTX, SPECS)
    return out["orders"].join(out["customer"], F.col("o_cname") == F.col("c_name")).select("o_orderkey", "c_custkey")


@query(
    "mask_partitioned",
    f"""SELECT o_orderkey, o_orderstatus, {g.fake('job_title', 'o_orderpriority', 'orders.o_orderpriority')} AS o_orderpriority FROM orders""",
)
def mask_partitions(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    status = F.col("o_orderstatus")
    children = {f"orders_{s.lower()}": orders.where(status == s) for s in ("F", "O")}
    children["orders_default"] = orders.where(status.isNull() | ~status.isin("F", "O"))
    return mask_partitioned(children, {"o_orderpriority": Fake("job_title")}, CTX, parent=SPECS["orders"])


# Scalar functions ---------------------------------------------------------------------------


@query("nfc", f"{W} SELECT id, nfc_normalize(nickname) AS composed, length(nfc_normalize(nickname)) AS n FROM people")
def nfc(spark: SparkSession, sf: str) -> DataFrame:
    df = people(spark, sf).select("id", mf.nfc(F.col("nickname")).alias("composed"))
    return df.select("id", "composed", F.char_length("composed").cast("long").alias("n"))


@query("nfc_documents", "SELECT doc_id, md5(nfc_normalize(text)) AS digest FROM documents")
def nfc_documents(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "documents").select("doc_id", mf.nfc(F.col("text")).alias("t"))
    return df.select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"))


@query("seed", f"SELECT page_id, {g.seed('url', 'pages.url')} AS seed, {g.seed('html', 'pages.html')} AS html_seed FROM pages")
def seeds(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "pages").select("page_id", mf.nfc(F.col("url")).alias("u"), mf.nfc(F.col("html")).alias("p"))
    return df.select(
        "page_id", mf.seed_hex(F.col("u"), CTX.salt, "pages.url").alias("seed"),
        mf.seed_hex(F.col("p"), CTX.salt, "pages.html").alias("html_seed"),
    )


@query(
    "seed_mod",
    f"""SELECT o_orderkey, {g.mod('h', 25)}::BIGINT AS m25, {g.mod('h', 7, 3)}::BIGINT AS m7_from3,
        {g.mod('h', 10**10)}::BIGINT AS m10e10, {g.mod('h', 10**16)}::BIGINT AS m10e16,
        {g.mod('h', 10_000, 8)}::BIGINT AS m10e4_from8, {g.byte('h', 9)} AS byte9
        FROM (SELECT o_orderkey, {g.seed('o_orderkey::VARCHAR', 'orders.o_orderkey')} AS h FROM orders)""",
)
def seed_mod(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "orders").select("o_orderkey")
    hexes = keys.withColumn("h", mf.seed_hex(F.col("o_orderkey").cast("string"), CTX.salt, "orders.o_orderkey"))
    seed = Seed(F.col("h"))
    return hexes.select(
        "o_orderkey", seed.mod(25).alias("m25"), seed.mod(7, skip=3).alias("m7_from3"),
        seed.mod(10**10).alias("m10e10"), seed.mod(10**16).alias("m10e16"),
        seed.mod(10_000, skip=8).alias("m10e4_from8"), seed.byte(9).alias("byte9"),
    )


@query("keyed_digest", f"{W} SELECT id, {g.digest('nickname', 'app.people.nickname')} AS digest FROM people")
def keyed(spark: SparkSession, sf: str) -> DataFrame:
    df = people(spark, sf).select("id", mf.nfc(F.col("nickname")).alias("n"))
    return df.select("id", mf.keyed_digest(F.col("n"), CTX.key, "app.people.nickname").alias("digest"))


def _provider_query(name: str, source: str, unique: bool) -> None:
    label = f"fake_{name}" if not unique else f"unique_{name}"
    value = {"nickname": "nickname"}.get(source, source)
    sql = f"{W} SELECT id, {g.fake(name, value, f'app.people.{source}', unique=unique)} AS {source} FROM people"

    @query(label, sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = people(spark, sf).select("id", source)
        spec = TableSpec("app.people", pk=("id",), uniques=((source,),) if unique else ())
        return mask_table(df, {source: Fake(name)}, CTX, table=spec)


_SOURCES = {
    "first_name": "name", "last_name": "name", "full_name": "nickname", "email": "email",
    "street": "name", "address": "nickname", "city": "name", "postcode": "name", "country": "name",
    "phone": "phone", "dob": "dob", "ip_address": "name", "ssn": "ssn", "credit_card": "ssn",
    "uuid": "nickname", "company": "name", "job_title": "name", "username": "name", "password": "email",
}
for _name, _source in _SOURCES.items():
    _provider_query(_name, _source, unique=False)
for _name in ("email", "dob", "postcode", "credit_card", "full_name", "uuid", "password"):
    _provider_query(_name, _SOURCES[_name], unique=True)


@query(
    "fake_email_domain",
    f"{W} SELECT id, {g.fake('email', 'email', 'app.people.email', domain='corp.test')} AS email FROM people",
)
def fake_email_domain(spark: SparkSession, sf: str) -> DataFrame:
    df = people(spark, sf).select("id", "email")
    return mask_table(df, {"email": Fake("email", params={"domain": "corp.test"})}, CTX, table=PEOPLE)


@query(
    "passes_luhn",
    """SELECT o_orderkey, length(d) >= 2 AND regexp_full_match(d, '[0-9]+') AND list_sum(list_transform(
          list_reverse(regexp_extract_all(d, '.')), lambda c, i: CASE WHEN i % 2 = 0
            THEN (c::INT * 2) // 10 + (c::INT * 2) % 10 ELSE c::INT END)) % 10 = 0 AS valid
       FROM (SELECT o_orderkey, (o_orderkey * 7919)::VARCHAR AS d FROM orders)""",
)
def luhn(spark: SparkSession, sf: str) -> DataFrame:
    digits = (F.col("o_orderkey") * 7919).cast("string")
    return table(spark, sf, "orders").select("o_orderkey", mf.passes_luhn(digits).alias("valid"))


@query(
    "is_fake_ssn",
    f"""{W} SELECT id, regexp_full_match(ssn, '0[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}') AS original_fake,
        regexp_full_match({g.fake('ssn', 'ssn', 'app.people.ssn')}, '0[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}') AS masked_fake FROM people""",
)
def fake_ssn(spark: SparkSession, sf: str) -> DataFrame:
    df = people(spark, sf).select("id", "ssn")
    masked = mask_table(df.withColumn("original", F.col("ssn")), {"ssn": Fake("ssn")}, CTX, table=PEOPLE)
    return masked.select("id", mf.is_fake_ssn(F.col("original")).alias("original_fake"), mf.is_fake_ssn(F.col("ssn")).alias("masked_fake"))


def _redact_sql(c: str) -> str:
    return (
        f"CASE WHEN {c} IS NULL OR {c} = '' THEN '***' ELSE '***len=' || length({c})::VARCHAR || ':' || "
        f"substr(sha256(encode({g.lit(CTX.redact_pepper + ':')} || {c})), 1, 8) END"
    )


@query("redact", f"{W} SELECT id, {_redact_sql('email')} AS email, {_redact_sql('nickname')} AS nickname FROM people")
def redact(spark: SparkSession, sf: str) -> DataFrame:
    return people(spark, sf).select(
        "id", mf.redact(F.col("email"), CTX.redact_pepper).alias("email"),
        mf.redact(F.col("nickname"), CTX.redact_pepper).alias("nickname"),
    )


@query(
    "redact_fields",
    f"""SELECT event_id, user_id, {_redact_sql('event_type')} AS event_type, value, {_redact_sql('props')} AS props,
        event_type AS action FROM events""",
)
def redact_event_fields(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props", F.col("event_type").alias("action"))
    return mf.redact_fields(df, CTX.redact_pepper)


@query(
    "safe_preview",
    f"""{W} SELECT id, CASE WHEN email IS NULL THEN '<NULL>' WHEN email = '' THEN '<EMPTY>'
        ELSE '<SENSITIVE:' || {_redact_sql('email')} || '>' END AS preview FROM people""",
)
def preview(spark: SparkSession, sf: str) -> DataFrame:
    return people(spark, sf).select("id", mf.safe_preview(F.col("email"), CTX.redact_pepper).alias("preview"))


@query(
    "unique_suffixes",
    f"""SELECT c_custkey, regexp_replace(c_name || '@a@b', '^(.*)@([^@]*)$', '\\1+' || substr(h, 1, 16) || '@\\2') AS email,
        c_name || '+' || substr(h, 1, 16) AS no_at, (DATE '2000-02-28' + ({g.mod('h', 3650)}::INT + 1))::DATE::VARCHAR AS day,
        {g.padded(g.mod('h', 10**5), 5)} AS number, c_name || '__' || substr(h, 1, 16) AS text
        FROM (SELECT *, {g.seed('c_name', 'customer.c_name')} AS h FROM customer)""",
)
def unique_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "customer").select(
        "c_custkey", "c_name", mf.seed_hex(F.col("c_name"), CTX.salt, "customer.c_name").alias("h")
    )
    seed, name = Seed(F.col("h")), F.col("c_name")
    return df.select(
        "c_custkey", mf.unique_email(F.concat(name, F.lit("@a@b")), seed).alias("email"),
        mf.unique_email(name, seed).alias("no_at"), mf.unique_date(F.lit("2000-02-28"), seed).alias("day"),
        mf.unique_numeric(F.lit("12345"), seed).alias("number"), mf.unique_text(name, seed).alias("text"),
    )


# Extension points ---------------------------------------------------------------------------


@query(
    "register_provider",
    f"""SELECT c_custkey, 'B' || {g.padded(g.mod(g.seed('c_name', 'customer.c_name'), 10**6), 6)} AS c_name FROM customer""",
)
def custom_provider(spark: SparkSession, sf: str) -> DataFrame:
    mf.register_provider(
        "badge", lambda seed, value, params, ctx: F.concat(F.lit("B"), F.lpad(seed.mod(10**6).cast("string"), 6, "0"))
    )
    df = table(spark, sf, "customer").select("c_custkey", "c_name")
    return mask_table(df, {"c_name": Fake("badge")}, CTX, table="customer")


@query(
    "post_process",
    f"SELECT c_custkey, upper({g.fake('city', 'c_name', 'customer.c_name')}) AS c_name, lower(c_mktsegment) AS c_mktsegment FROM customer",
)
def hooks(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return mask_table(
        df, {"c_name": Fake("city")}, CTX, table="customer", post_process={"c_name": F.upper, "c_mktsegment": F.lower}
    )


@query(
    "mask_where",
    f"SELECT c_custkey, {g.fake('city', 'c_name', 'customer.c_name')} AS c_name, c_nationkey FROM customer WHERE c_nationkey = 3",
)
def mask_where(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    return mask_table(df, {"c_name": Fake("city")}, CTX, table="customer", where="c_nationkey = 3")

"""DuckDB expressions for the masking semantics, written independently of the Spark ones."""

from __future__ import annotations

import datetime as dt
import hashlib

from maskframe import MaskContext
from maskframe.functions import libraries as lib

CTX = MaskContext(
    salt="table-salt-0123456789-0123456789-abcdef", key="pseudonym-key-0123456789-0123456789",
    as_of=dt.date(2026, 1, 15),
)


def seg(text: str) -> bytes:
    data = text.encode()
    return len(data).to_bytes(4, "big") + data


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def blob(data: bytes) -> str:
    return f"unhex('{data.hex()}')"


def segment(value: str) -> str:
    return f"(unhex(printf('%08x', octet_length(encode({value})))) || encode({value}))"


def seed(value: str, path: str) -> str:
    return f"substr(sha256({blob(seg(CTX.salt) + seg(path))} || {segment(f'nfc_normalize({value})')}), 1, 32)"


def digest(value: str, path: str) -> str:
    raw = CTX.key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner = blob(bytes(b ^ 0x36 for b in raw) + seg(path))
    outer = blob(bytes(b ^ 0x5C for b in raw))
    return f"sha256({outer} || unhex(sha256({inner} || {segment(f'nfc_normalize({value})')})))"


def salted_hash(value: str) -> str:
    return f"sha256({blob(CTX.salt.encode())} || encode({value}))"


def mod(h: str, n: int, skip: int = 0) -> str:
    return f"(('0x' || substr({h}, {2 * skip + 1}))::UHUGEINT % {n})"


def byte(h: str, k: int) -> str:
    return f"('0x' || substr({h}, {2 * k + 1}, 2))::UHUGEINT::BIGINT"


def pick(library: tuple[str, ...], index: str) -> str:
    return f"([{', '.join(lit(v) for v in library)}])[({index})::BIGINT + 1]"


def padded(number: str, width: int) -> str:
    return f"lpad(({number})::VARCHAR, {width}, '0')"


SINGLE = {
    "first_name": lib.FIRST_NAMES, "last_name": lib.LAST_NAMES, "street": lib.STREETS,
    "city": lib.CITIES, "postcode": lib.POSTCODES, "country": lib.COUNTRIES,
    "company": lib.COMPANIES, "job_title": lib.JOB_TITLES, "username": lib.USERNAMES,
}


def provider(name: str, h: str, value: str = "''", domain: str | None = None) -> str:
    if name in SINGLE:
        return pick(SINGLE[name], mod(h, len(SINGLE[name])))
    if name == "full_name":
        backwards = f"array_to_string(list_reverse(regexp_extract_all({h}, '..')), '')"
        return f"{pick(lib.FIRST_NAMES, mod(h, 25))} || ' ' || {pick(lib.LAST_NAMES, mod(backwards, 25))}"
    if name == "email":
        where = lit(domain) if domain else pick(CTX.email_domains, mod(h, len(CTX.email_domains), 4))
        return f"{pick(lib.EMAIL_LOCALS, mod(h, 20))} || '@' || {where}"
    if name == "address":
        return (
            f"{pick(lib.STREETS, mod(h, 10))} || ', ' || {pick(lib.CITIES, mod(h, 10, 1))} || ' ' || "
            f"{pick(lib.POSTCODES, mod(h, 10, 2))} || ', ' || {pick(lib.COUNTRIES, mod(h, 10, 3))}"
        )
    if name == "phone":
        code = f"coalesce(nullif(regexp_extract(trim({value}), '^\\+?([0-9]{{1,3}})', 1), ''), '1')"
        return f"'+' || {code} || {padded(mod(h, 10**10), 10)}"
    if name == "dob":
        anchor = f"coalesce(try_cast(nullif(regexp_extract(trim({value}), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$'), '') AS DATE), DATE '{lib.DOB_ANCHOR}')"
        today = f"DATE '{CTX.as_of}'"
        age = f"floor(datediff('day', {anchor}, {today}) / 365.0)::BIGINT"
        years = f"greatest(0, {age} + {mod(h, 11)}::BIGINT - 5)"
        return f"({today} - ({years} * 365 + {byte(h, 0)} % 365)::INT)::DATE::VARCHAR"
    if name == "ip_address":
        return f"{pick(lib.IP_BLOCKS, mod(h, 3))} || '.' || ({byte(h, 0)} % 254 + 1)::VARCHAR"
    if name == "ssn":
        return f"{padded(mod(h, 100), 3)} || '-' || {padded(f'{byte(h, 4)} % 100', 2)} || '-' || {padded(mod(h, 10_000, 8), 4)}"
    if name == "credit_card":
        which = f"{mod(h, 5)}::BIGINT"
        body = (
            f"({pick(lib.CARD_BINS, which)} || CASE WHEN {which} = 3 THEN {padded(mod(h, 10**8, 2), 8)} "
            f"ELSE {padded(mod(h, 10**9, 2), 9)} END)"
        )
        # 15 digits after left-padding, so odd positions are the doubled ones.
        total = (
            f"list_sum(list_transform(regexp_extract_all(lpad({body}, 15, '0'), '.'), "
            f"lambda d, i: CASE WHEN i % 2 = 1 THEN (d::INT * 2) // 10 + (d::INT * 2) % 10 ELSE d::INT END))"
        )
        return f"{body} || ((10 - {total} % 10) % 10)::INT::VARCHAR"
    if name == "uuid":
        variant = f"translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab')"
        return (
            f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-4' || substr({h}, 14, 3) || '-' || "
            f"{variant} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"
        )
    if name == "password":
        return lit(CTX.password)
    raise KeyError(name)


def suffix(name: str, base: str, h: str) -> str:
    token = f"substr({h}, 1, 16)"
    if name == "email":
        return f"regexp_replace({base}, '^(.*)@([^@]*)$', '\\1+' || {token} || '@\\2')"
    if name in ("uuid", "password"):
        return base
    if name == "dob":
        return f"(({base})::DATE + ({mod(h, 3650)}::INT + 1))::DATE::VARCHAR"
    if name == "postcode":
        return padded(mod(h, 10**5), 5)
    if name == "credit_card":
        return f"CASE WHEN length({base}) = 15 THEN {padded(mod(h, 10**15), 15)} ELSE {padded(mod(h, 10**16), 16)} END"
    return f"({base}) || '__' || {token}"


def fake(name: str, value: str, path: str, unique: bool = False, domain: str | None = None) -> str:
    """A whole masked cell: NULL and empty text stay as they are."""
    return _cell(name, value, seed(value, path), unique, domain)


def pseudonym(name: str, value: str, path: str, unique: bool = False) -> str:
    return _cell(name, value, f"substr({digest(value, path)}, 1, 32)", unique, None)


def _cell(name: str, value: str, h: str, unique: bool, domain: str | None) -> str:
    base = provider(name, "h", value, domain)
    out = suffix(name, f"({base})", "h") if unique else base
    # The list comprehension binds the seed once instead of repeating its text.
    return f"CASE WHEN {value} IS NULL OR {value} = '' THEN {value} ELSE list_transform([{h}], lambda h: {out})[1] END"

"""Straight-line Python statement of the value semantics, used to check the expressions."""

import datetime as dt
import hashlib
import hmac
import re
import unicodedata
import uuid

from maskframe.functions import libraries as lib


def seg(text):
    data = text.encode()
    return len(data).to_bytes(4, "big") + data


def nfc(text):
    return unicodedata.normalize("NFC", text)


def seed(salt, path, value):
    return hashlib.sha256(seg(salt) + seg(path) + seg(nfc(value))).digest()[:16]


def keyed(key, path, value):
    return hmac.new(key.encode(), seg(path) + seg(nfc(value)), hashlib.sha256).digest()


def num(data):
    return int.from_bytes(data, "big")


def luhn_digit(body):
    total = 0
    for place, ch in enumerate(body[::-1]):
        d = int(ch) * (2 if place % 2 == 0 else 1)
        total += d // 10 + d % 10
    return str(-total % 10)


def provide(name, s, value, ctx, params=None):
    params = params or {}
    single = {
        "first_name": lib.FIRST_NAMES, "last_name": lib.LAST_NAMES, "street": lib.STREETS,
        "city": lib.CITIES, "postcode": lib.POSTCODES, "country": lib.COUNTRIES,
        "company": lib.COMPANIES, "job_title": lib.JOB_TITLES, "username": lib.USERNAMES,
    }
    if name in single:
        return single[name][num(s) % len(single[name])]
    if name == "full_name":
        return f"{lib.FIRST_NAMES[num(s) % 25]} {lib.LAST_NAMES[num(s[::-1]) % 25]}"
    if name == "email":
        domain = params.get("domain") or ctx.email_domains[num(s[4:]) % len(ctx.email_domains)]
        return f"{lib.EMAIL_LOCALS[num(s) % 20]}@{domain}"
    if name == "address":
        return (
            f"{lib.STREETS[num(s) % 10]}, {lib.CITIES[num(s[1:]) % 10]} "
            f"{lib.POSTCODES[num(s[2:]) % 10]}, {lib.COUNTRIES[num(s[3:]) % 10]}"
        )
    if name == "phone":
        code = re.match(r"\+?(\d{0,3})", value.strip()).group(1) or "1"
        return f"+{code}{num(s) % 10**10:010d}"
    if name == "dob":
        anchor = dt.date(1985, 6, 15)
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", value.strip()):
            try:
                anchor = dt.date.fromisoformat(value.strip())
            except ValueError:
                pass
        age = max(0, (ctx.as_of - anchor).days // 365 + num(s) % 11 - 5)
        return str(ctx.as_of - dt.timedelta(days=age * 365 + s[0] % 365))
    if name == "ip_address":
        return f"{lib.IP_BLOCKS[num(s) % 3]}.{s[0] % 254 + 1}"
    if name == "ssn":
        return f"{num(s) % 100:03d}-{s[4] % 100:02d}-{num(s[8:]) % 10_000:04d}"
    if name == "credit_card":
        prefix = lib.CARD_BINS[num(s) % 5]
        width = 8 if prefix.startswith("37") else 9
        body = f"{prefix}{num(s[2:]) % 10**width:0{width}d}"
        return body + luhn_digit(body)
    if name == "uuid":
        return str(uuid.UUID(bytes=s, version=4))
    if name == "password":
        return ctx.password
    raise KeyError(name)


def suffixed(name, base, s):
    token = s.hex()[:16]
    if name == "email":
        local, _, domain = base.rpartition("@")
        return f"{local}+{token}@{domain}"
    if name in ("uuid", "password"):
        return base
    if name == "dob":
        return str(dt.date.fromisoformat(base) + dt.timedelta(days=num(s) % 3650 + 1))
    if base.isdigit():
        return f"{num(s) % 10 ** len(base):0{len(base)}d}"
    return f"{base}__{token}"


def fake(name, value, ctx, path, unique=False, params=None):
    if value in (None, ""):
        return value
    s = seed(ctx.salt, path, value)
    base = provide(name, s, nfc(value), ctx, params)
    return suffixed(name, base, s) if unique else base


def pseudonym(name, value, ctx, path, unique=False, params=None):
    if value in (None, ""):
        return value
    s = keyed(ctx.key, path, value)[:16]
    base = provide(name, s, nfc(value), ctx, params)
    return suffixed(name, base, s) if unique else base

"""Synthetic-value providers: expressions from a seed to a replacement string."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskframe.context import MaskContext, MaskError
from maskframe.functions import libraries as lib
from maskframe.functions.seeds import Seed
from maskframe.functions.text import SPACES

ProviderFn = Callable[[Seed, Column, Mapping[str, str], MaskContext], Column]


@dataclass(frozen=True)
class Provider:
    """``shape`` says what the output looks like, which decides its uniqueness suffix.

    ``strict`` providers give NULL exactly for NULL input, as anything built from the seed does.
    """

    name: str
    fn: ProviderFn
    shape: str = "any"
    strict: bool = True


def _pick(library: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in library]), index.cast("int"))


def _padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _from_library(library: tuple[str, ...]) -> ProviderFn:
    def pick(seed: Seed, value: Column, params: Mapping[str, str], ctx: MaskContext) -> Column:
        return _pick(library, seed.mod(len(library)))

    return pick


def _full_name(seed: Seed, value: Column, params: Mapping[str, str], ctx: MaskContext) -> Column:
    first = _pick(lib.FIRST_NAMES, seed.mod(len(lib.FIRST_NAMES)))
    last = _pick(lib.LAST_NAMES, seed.reversed_mod(len(lib.LAST_NAMES)))
    return F.concat(first, F.lit(" "), last)


def _email(seed: Seed, value: Column, params: Mapping[str, str], ctx: MaskContext) -> Column:
    local = _pick(lib.EMAIL_LOCALS, seed.mod(len(lib.EMAIL_LOCALS)))
    if "domain" in params:
        domain = F.lit(params["domain"])
    else:
        domain = _pick(ctx.email_domains, seed.mod(len(ctx.email_domains), skip=4))
    return F.concat(local, F.lit("@"), domain)


def _address(seed: Seed, value: Column, params: Mapping[str, str], ctx: MaskContext) -> Column:
    street = _pick(lib.STREETS, seed.mod(len(lib.STREETS)))
    city = _pick(lib.CITIES, seed.mod(len(lib.CITIES), skip=1))
    postcode = _pick(lib.POSTCODES, seed.mod(len(lib.POSTCODES), skip=2))
    country = _pick(lib.COUNTRIES, seed.mod(len(lib.COUNTRIES), skip=3))
    return F.concat(street, F.lit(", "), city, F.lit(" "), postcode, F.lit(", "), country)


def _phone(seed: Seed, value: Column, params: Mapping[str, str], ctx: MaskContext) -> Column:
    code = F.regexp_extract(value, rf"^[{SPACES}]*\+?(\p{{Nd}}{{1,3}})", 1)
    return F.concat(
        F.lit("+"), F.when(code == "", "1").otherwise(code), _padded(seed.mod(10**10), 10)
    )


def _dob(seed: Seed, value: Column, params: Mapping[str, str], ctx: MaskContext) -> Column:
    today = F.lit(ctx.require_as_of("fake dob"))
    iso = F.regexp_extract(value, rf"^[{SPACES}]*(\d{{4}}-\d{{2}}-\d{{2}})[{SPACES}]*\z", 1)
    anchor = F.coalesce(iso.try_cast("date"), F.lit(lib.DOB_ANCHOR).cast("date"))
    age = F.floor(F.datediff(today, anchor) / F.lit(365))
    years = F.greatest(F.lit(0).cast("long"), age + seed.mod(11) - F.lit(5))
    days = years * F.lit(365) + seed.byte(0) % F.lit(365)
    return F.date_sub(today, days.cast("int")).cast("string")


def _ip_address(seed: Seed, value: Column, params: Mapping[str, str], ctx: MaskContext) -> Column:
    block = _pick(lib.IP_BLOCKS, seed.mod(len(lib.IP_BLOCKS)))
    host = seed.byte(0) % F.lit(254) + F.lit(1)
    return F.concat(block, F.lit("."), host.cast("string"))


def _ssn(seed: Seed, value: Column, params: Mapping[str, str], ctx: MaskContext) -> Column:
    return F.concat(
        _padded(seed.mod(100), 3),
        F.lit("-"),
        _padded(seed.byte(4) % F.lit(100), 2),
        F.lit("-"),
        _padded(seed.mod(10_000, skip=8), 4),
    )


def _doubled(digit: int) -> int:
    return 2 * digit - 9 if digit > 4 else 2 * digit


def _credit_card(seed: Seed, value: Column, params: Mapping[str, str], ctx: MaskContext) -> Column:
    """Card prefix, serial and Luhn digit. The prefix's share of the checksum is a constant."""
    which = seed.mod(len(lib.CARD_BINS))
    cards = None
    for width in (8, 9):
        serial = seed.mod(10**width, skip=2)
        prefixes = [b for b in lib.CARD_BINS if (8 if b.startswith("37") else 9) == width]
        known = {
            b: sum(
                _doubled(int(d)) if (width + i) % 2 == 0 else int(d)
                for i, d in enumerate(reversed(b))
            )
            for b in prefixes
        }
        total = F.get(
            F.array(*[F.lit(known.get(b, 0)) for b in lib.CARD_BINS]), which.cast("int")
        )
        for place in range(width):
            digit = F.floor((serial % F.lit(10 ** (place + 1))) / F.lit(10**place))
            if place % 2 == 0:
                digit = F.get(F.array(*[F.lit(_doubled(d)) for d in range(10)]), digit.cast("int"))
            total = total + digit
        check = (F.lit(10) - total % F.lit(10)) % F.lit(10)
        card = F.concat(
            _pick(lib.CARD_BINS, which), _padded(serial, width), check.cast("string")
        )
        member = which.isin([lib.CARD_BINS.index(b) for b in prefixes])
        cards = F.when(member, card) if cards is None else cards.when(member, card)
    return cards


def _uuid(seed: Seed, value: Column, params: Mapping[str, str], ctx: MaskContext) -> Column:
    h = seed.hex
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(h, 1, 8),
        F.lit("-"),
        F.substring(h, 9, 4),
        F.lit("-4"),
        F.substring(h, 14, 3),
        F.lit("-"),
        variant,
        F.substring(h, 18, 3),
        F.lit("-"),
        F.substring(h, 21, 12),
    )


def _password(seed: Seed, value: Column, params: Mapping[str, str], ctx: MaskContext) -> Column:
    return F.lit(ctx.password)


_BUILTIN = (
    Provider("first_name", _from_library(lib.FIRST_NAMES), "text"),
    Provider("last_name", _from_library(lib.LAST_NAMES), "text"),
    Provider("full_name", _full_name, "text"),
    Provider("email", _email, "email"),
    Provider("street", _from_library(lib.STREETS), "text"),
    Provider("address", _address, "text"),
    Provider("city", _from_library(lib.CITIES), "text"),
    Provider("postcode", _from_library(lib.POSTCODES), "numeric"),
    Provider("country", _from_library(lib.COUNTRIES), "text"),
    Provider("phone", _phone, "text"),
    Provider("dob", _dob, "date"),
    Provider("ip_address", _ip_address, "text"),
    Provider("ssn", _ssn, "text"),
    Provider("credit_card", _credit_card, "numeric"),
    Provider("uuid", _uuid, "fixed"),
    Provider("company", _from_library(lib.COMPANIES), "text"),
    Provider("job_title", _from_library(lib.JOB_TITLES), "text"),
    Provider("username", _from_library(lib.USERNAMES), "text"),
    Provider("password", _password, "fixed", strict=False),
)
_REGISTRY: dict[str, Provider] = {p.name: p for p in _BUILTIN}

# Suffix treatment that follows the provider's name even when a custom one takes it over.
_SHAPE_BY_NAME = {"email": "email", "dob": "date", "uuid": "fixed", "password": "fixed"}


def register_provider(name: str, fn: ProviderFn) -> None:
    """Add or replace a provider. ``fn(seed, value, params, ctx)`` must be deterministic.

    The function returns a Column; it may wrap a pandas UDF over ``seed.hex`` and ``value``.
    """
    if not name:
        raise ValueError("provider name must be non-empty")
    _REGISTRY[name] = Provider(name, fn, _SHAPE_BY_NAME.get(name, "any"), strict=False)


def restore_builtin_providers() -> None:
    """Forget every registered provider."""
    _REGISTRY.clear()
    _REGISTRY.update({p.name: p for p in _BUILTIN})


def known_providers() -> frozenset[str]:
    return frozenset(_REGISTRY)


def get_provider(name: str) -> Provider:
    try:
        return _REGISTRY[name]
    except KeyError:
        raise MaskError(f"unknown provider: {name}") from None


def check_providers(wanted: Iterable[tuple[str, str]]) -> None:
    """Reject unknown names, reported as ``table.column -> name``, before any data is read."""
    missing = sorted(f"{path} -> {name}" for path, name in wanted if name not in _REGISTRY)
    if missing:
        raise MaskError("unknown provider(s): " + "; ".join(missing))

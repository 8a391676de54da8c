"""Name rules of the PII detector and the table-name context they are weighed with."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class NameRule:
    rule_id: str
    kind: str
    text: str
    provider: str | None
    action: str


# The rule list, in order of precedence.
NAME_RULES = tuple(NameRule(*row) for row in (
    ("email_suffix", "suffix", "_email", "email", "fake"),
    ("email_prefix", "prefix", "email_", "email", "fake"),
    ("email", "substring", "email", "email", "fake"),
    ("e_mail", "substring", "e_mail", "email", "fake"),
    ("phone", "substring", "phone", "phone", "fake"),
    ("mobile", "substring", "mobile", "phone", "fake"),
    ("tel", "bounded", "tel", "phone", "fake"),
    ("cell", "bounded", "cell", "phone", "fake"),
    ("phone_suffix", "suffix", "_phone", "phone", "fake"),
    ("ssn", "substring", "ssn", "ssn", "fake"),
    ("social_security", "substring", "social_security", "ssn", "fake"),
    ("tax_id", "substring", "tax_id", "ssn", "fake"),
    ("national_id", "substring", "national_id", "ssn", "fake"),
    ("first_name", "substring", "first_name", "first_name", "fake"),
    ("fname", "substring", "fname", "first_name", "fake"),
    ("given_name", "substring", "given_name", "first_name", "fake"),
    ("last_name", "substring", "last_name", "last_name", "fake"),
    ("lname", "substring", "lname", "last_name", "fake"),
    ("surname", "substring", "surname", "last_name", "fake"),
    ("family_name", "substring", "family_name", "last_name", "fake"),
    ("full_name", "substring", "full_name", "full_name", "fake"),
    ("display_name", "substring", "display_name", "full_name", "fake"),
    ("name_exact", "whole", "name", "full_name", "fake"),
    ("ip_address", "substring", "ip_address", "ip_address", "fake"),
    ("ip_suffix", "suffix", "_ip", "ip_address", "fake"),
    ("ip_prefix", "prefix", "ip_", "ip_address", "fake"),
    ("ip_exact", "whole", "ip", "ip_address", "fake"),
    ("address", "substring", "address", "address", "fake"),
    ("street", "substring", "street", "street", "fake"),
    ("city", "substring", "city", "city", "fake"),
    ("postcode", "substring", "postcode", "postcode", "fake"),
    ("zip", "substring", "zip", "postcode", "fake"),
    ("country", "substring", "country", "country", "fake"),
    ("dob", "substring", "dob", "dob", "fake"),
    ("date_of_birth", "substring", "date_of_birth", "dob", "fake"),
    ("birth_date", "substring", "birth_date", "dob", "fake"),
    ("birthday", "substring", "birthday", "dob", "fake"),
    ("credit_card", "substring", "credit_card", "credit_card", "fake"),
    ("card_number", "substring", "card_number", "credit_card", "fake"),
    ("cc_number", "substring", "cc_number", "credit_card", "fake"),
    ("pan", "bounded", "pan", "credit_card", "fake"),
    ("password_hash", "substring", "password_hash", "password", "static"),
    ("password", "substring", "password", "password", "static"),
    ("passwd", "substring", "passwd", "password", "static"),
    ("pwd", "substring", "pwd", "password", "static"),
    ("token", "substring", "token", None, "hash"),
    ("api_key", "substring", "api_key", None, "hash"),
    ("secret", "substring", "secret", None, "hash"),
    ("token_suffix", "suffix", "_token", None, "hash"),
    ("auth_prefix", "prefix", "auth_", None, "hash"),
    ("notes_suffix", "suffix", "_notes", None, "ner_mask"),
    ("notes_substring", "substring", "notes", None, "ner_mask"),
    ("notes", "prefix", "note", None, "ner_mask"),
    ("comments", "prefix", "comment", None, "ner_mask"),
    ("description", "substring", "description", None, "ner_mask"),
    ("bio", "substring", "bio", None, "ner_mask"),
    ("about", "substring", "about", None, "ner_mask"),
))

# Table-name tokens that raise or lower confidence in free-text columns.
SENSITIVE_TABLES = (
    "patient", "user", "customer", "member", "employee", "visit", "clinical", "provider",
    "ticket", "support", "auth", "session", "contact", "person", "client",
)
LOW_SENSITIVITY_TABLES = (
    "product", "catalog", "config", "system", "inventory", "sku", "item", "warehouse",
)

# Logical types and the providers that can fill them besides text.
TEXT_TYPES = frozenset({
    "text", "character varying", "character", "varchar", "char", "citext", "name",
})
PROVIDER_TYPES = {
    "dob": TEXT_TYPES | {"date"},
    "ip_address": TEXT_TYPES | {"inet", "cidr"},
    "uuid": TEXT_TYPES | {"uuid"},
}

# Average widths, in bytes, that make a free-text column certain or doubtful.
FREE_TEXT_WIDTH = 200
DOUBTFUL_WIDTH = 100
FREE_TEXT_MIN_VARCHAR = 500

_MATCHERS = {
    "substring": lambda name, text: text in name,
    "bounded": lambda name, text: f"_{text}_" in f"_{name}_",
    "suffix": str.endswith,
    "prefix": str.startswith,
    "whole": str.__eq__,
}


def match_name(column: str) -> NameRule | None:
    """The first rule a column name satisfies, ignoring case."""
    name = column.lower()
    return next((r for r in NAME_RULES if _MATCHERS[r.kind](name, r.text)), None)


def table_sensitivity(table: str) -> str:
    """``sensitive``, ``low`` or ``neutral``, by the bare table name."""
    name = table.lower()
    if any(token in name for token in SENSITIVE_TABLES):
        return "sensitive"
    return "low" if any(token in name for token in LOW_SENSITIVITY_TABLES) else "neutral"


def compatible_action(rule: NameRule, logical_type: str) -> tuple[str, str | None] | None:
    """(action, provider) the rule can apply to the type, or None."""
    base = logical_type.strip().lower().partition("(")[0].strip()
    if rule.action == "fake":
        allowed = PROVIDER_TYPES.get(rule.provider, TEXT_TYPES)
        return ("fake", rule.provider) if base in allowed else None
    if rule.action == "hash" and base == "uuid":
        return "fake", "uuid"
    return (rule.action, None) if base in TEXT_TYPES else None


def is_free_text_type(logical_type: str) -> bool:
    """Whether the type is wide enough for narrative text."""
    name = logical_type.strip().lower()
    limit = re.fullmatch(r"(?:character varying|varchar)\((\d+)\)", name)
    return name == "text" or (limit is not None and int(limit[1]) >= FREE_TEXT_MIN_VARCHAR)

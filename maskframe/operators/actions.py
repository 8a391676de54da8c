"""Column actions. Each is a small frozen value; ``mask_table`` turns them into expressions."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from maskframe.context import MaskError
from maskframe.functions.regex import check_pattern

DEFAULT_ENTITIES = ("PERSON", "ORG", "GPE", "LOC")


@dataclass(frozen=True)
class Action:
    """``when`` is an optional Spark SQL row predicate: cells where it is not true stay as is."""

    when: str | None = field(default=None, kw_only=True)

    @property
    def kind(self) -> str:
        return _KIND_BY_CLASS[type(self)]


@dataclass(frozen=True)
class Passthrough(Action):
    pass


@dataclass(frozen=True)
class Null(Action):
    pass


@dataclass(frozen=True)
class Static(Action):
    value: str


@dataclass(frozen=True)
class Hash(Action):
    pass


@dataclass(frozen=True)
class HmacHash(Action):
    encoding: str = "hex"

    def __post_init__(self) -> None:
        if self.encoding not in ("hex", "base64url"):
            raise MaskError(f"unsupported hmac_hash encoding: {self.encoding!r}")


@dataclass(frozen=True)
class Fake(Action):
    provider: str
    seed_alias: str | None = None
    params: Mapping[str, str] = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Pseudonym(Action):
    provider: str
    seed_alias: str | None = None
    params: Mapping[str, str] = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class RegexMask(Action):
    pattern: str
    replace: str
    flags: tuple[str, ...] = ()
    max_chars: int | None = None

    def __post_init__(self) -> None:
        check_pattern(self.pattern, self.flags)


@dataclass(frozen=True)
class NerMask(Action):
    entities: tuple[str, ...] = DEFAULT_ENTITIES


@dataclass(frozen=True)
class JsonMask(Action):
    """Rules by JSON path (``contact.email``): Fake, Hash, Null or the string ``"remove"``.

    Paths name members of objects by their exact spelling, or by any with ``ignore_case``; lists are
    not entered. ``schema`` (a DDL string) declares fields that documents may have: a path that is not
    among them is refused when the plan is built. Fields it does not name are kept like all others.
    """

    paths: Mapping[str, Action | str] = field(hash=False)
    schema: str | None = None
    ignore_case: bool = False


_KIND_BY_CLASS: dict[type, str] = {
    Passthrough: "passthrough",
    Null: "null",
    Static: "static",
    Hash: "hash",
    HmacHash: "hmac_hash",
    Fake: "fake",
    Pseudonym: "pseudonym",
    RegexMask: "regex_mask",
    NerMask: "ner_mask",
    JsonMask: "json_mask",
}
ACTION_CLASSES = {kind: cls for cls, kind in _KIND_BY_CLASS.items()}

Rules = Mapping[str, Action]


def action_from_dict(entry: Mapping[str, Any]) -> Action:
    """Build an action from a plain mapping such as ``{"action": "fake", "provider": "email"}``."""
    options = dict(entry)
    kind = options.pop("action", None)
    if kind not in ACTION_CLASSES:
        raise MaskError(f"unknown action {kind!r}; expected one of {sorted(ACTION_CLASSES)}")
    for name in ("flags", "entities"):
        if name in options:
            options[name] = tuple(options[name])
    if kind == "json_mask":
        options["paths"] = {
            path: rule if rule == "remove" else action_from_dict(rule)
            for path, rule in options["paths"].items()
        }
    try:
        return ACTION_CLASSES[kind](**options)
    except TypeError as exc:
        raise MaskError(f"invalid options for action {kind!r}: {exc}") from None


def rules_from_dict(columns: Mapping[str, Mapping[str, Any]]) -> dict[str, Action]:
    return {name: action_from_dict(entry) for name, entry in columns.items()}

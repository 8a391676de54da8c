"""Run settings, from code or from an already parsed rules document."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from maskframe.context import MaskError
from maskframe.operators import actions as act
from maskframe.spec import STRATEGIES

_TOP_KEYS = {
    "version", "on_existing_data", "strict_autodetect", "auto_detect", "audit_log",
    "implied_fk_ignore", "tables", "global_salt", "pseudonym_key", "batch_size",
    "replicate_all_indexes",
}
_TABLE_KEYS = {"strategy", "columns", "null_orphan_fks", "batch_size"}


@dataclass(frozen=True)
class RunConfig:
    """Rules and strategies per table plus run-wide switches."""

    rules: Mapping[str, act.Rules] = field(default_factory=dict)
    strategies: Mapping[str, str] = field(default_factory=dict)
    null_orphan_fks: frozenset[str] = frozenset()
    on_existing_data: str = "fail"
    strict_autodetect: bool = False
    auto_detect: bool = True
    audit_log: bool = True
    implied_fk_ignore: tuple[str, ...] = ()
    fk_paths: bool = False

    @classmethod
    def from_dict(cls, document: Mapping[str, Any]) -> RunConfig:
        """Read a parsed rules document. Batch sizes and index options have no effect here."""
        _reject_unknown(document, _TOP_KEYS, "document")
        tables = document.get("tables", {})
        for name, entry in tables.items():
            _reject_unknown(entry, _TABLE_KEYS, name)
            if entry.get("strategy", "transform") not in STRATEGIES:
                raise MaskError(f"{name}: unknown strategy {entry['strategy']!r}")
        if document.get("on_existing_data") == "append":
            raise MaskError("append is not supported; use truncate or drop_create")
        return cls(
            rules={t: act.rules_from_dict(e.get("columns", {})) for t, e in tables.items()},
            strategies={t: e.get("strategy", "transform") for t, e in tables.items()},
            null_orphan_fks=frozenset(t for t, e in tables.items() if e.get("null_orphan_fks")),
            on_existing_data=document.get("on_existing_data", "fail"),
            strict_autodetect=document.get("strict_autodetect", False),
            auto_detect=document.get("auto_detect", True),
            audit_log=document.get("audit_log", True),
            implied_fk_ignore=tuple(document.get("implied_fk_ignore", ())),
        )


def _reject_unknown(entry: Mapping[str, Any], allowed: set[str], where: str) -> None:
    unknown = sorted(set(entry) - allowed)
    if unknown:
        raise MaskError(f"{where}: unknown key(s) {', '.join(unknown)}")

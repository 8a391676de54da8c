"""Table constraints a Parquet schema cannot carry."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

STRATEGIES = ("transform", "exclude", "empty", "truncate")


@dataclass(frozen=True)
class ForeignKey:
    """``child(cols)`` references ``parent(parent_cols)``; composite keys are allowed."""

    cols: tuple[str, ...]
    parent: str
    parent_cols: tuple[str, ...]

    def __post_init__(self) -> None:
        if len(self.cols) != len(self.parent_cols) or not self.cols:
            raise ValueError(f"foreign key to {self.parent}: column lists differ in length")


@dataclass(frozen=True)
class TableSpec:
    """Constraints of one table. ``name`` is the schema-qualified id used in seed paths.

    ``types`` names the logical type of columns Spark stores as strings (``uuid``, ``inet``,
    ``varchar(120)``); detection uses it to choose compatible actions.
    """

    name: str
    pk: tuple[str, ...] = ()
    uniques: tuple[tuple[str, ...], ...] = ()
    fks: tuple[ForeignKey, ...] = ()
    not_null: frozenset[str] = field(default_factory=frozenset)
    types: Mapping[str, str] = field(default_factory=dict, hash=False)

    @property
    def unique_groups(self) -> tuple[tuple[str, ...], ...]:
        """Primary key first, then every unique constraint or index, without repeats."""
        groups = ((self.pk,) if self.pk else ()) + tuple(self.uniques)
        return tuple(dict.fromkeys(groups))

    @property
    def unique_columns(self) -> frozenset[str]:
        """Columns taking part in any uniqueness guarantee; these get a suffix when faked."""
        return frozenset(c for group in self.unique_groups for c in group)

    @property
    def single_unique_columns(self) -> frozenset[str]:
        return frozenset(g[0] for g in self.unique_groups if len(g) == 1)

    @property
    def schema_name(self) -> str:
        return self.name.rpartition(".")[0]

    @property
    def table_name(self) -> str:
        return self.name.rpartition(".")[2]

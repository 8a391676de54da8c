"""Crash-safe tables: rows are staged, listed in a manifest and only then moved into place.

Below the folder of a run, ``_staging/<attempt>/<table>`` takes what is being written and
``_manifests/<table>`` one small file for each finished attempt. A manifest appears by a rename, all at
once, and is what makes rows part of the table; moving the staged files into the table's folder
can be repeated at any time. A process that dies leaves either a staged folder nobody refers to
or a manifest whose files :func:`settle` brings into place.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from maskframe.context import MaskError

AUDIT_FIELDS = "event_type string, column_name string, action string, cells_seen long, cells_changed long"
_SCHEMA = (
    "table_id string, attempt string, run_id string, seq long, replaces boolean, salt_fingerprint string, "
    f"rules_hash string, rows long, bytes long, files array<string>, audit array<struct<{AUDIT_FIELDS.replace(' ', ':').replace(',:', ',')}>>"
)


@dataclass(frozen=True)
class Manifest:
    """One finished attempt: which files it added, under which salt and rules, and what it counted.

    ``replaces`` says that earlier attempts no longer belong to the table.
    """

    table_id: str
    attempt: str
    run_id: str
    seq: int
    replaces: bool
    salt_fingerprint: str
    rules_hash: str
    rows: int
    bytes: int
    files: tuple[str, ...]
    audit: tuple[dict[str, Any], ...] = field(default=())


class Store:
    """The few file operations needed, in whatever store the path names."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark._jvm
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def sizes(self, folder: str) -> dict[str, int]:
        """Data files of a folder with their length; names that readers skip are left out."""
        if not self.exists(folder):
            return {}
        entries = [(s.getPath().getName(), s) for s in self._fs.listStatus(self._path(folder))]
        return {n: s.getLen() for n, s in entries if s.isFile() and not n.startswith(("_", "."))}

    def names(self, folder: str) -> list[str]:
        """Everything in a folder, nothing if there is no such folder."""
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))] if self.exists(folder) else []

    def move(self, source: str, target: str) -> None:
        parent = self._path(target).getParent()
        self._fs.mkdirs(parent)
        if not self._fs.rename(self._path(source), self._path(target)):
            raise MaskError(f"cannot move {source} to {target}")

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def write_text(self, path: str, text: str) -> None:
        """Write a small file that appears whole or not at all."""
        folder, _, name = path.rpartition("/")
        hidden = f"{folder}/.{name}.tmp"
        stream = self._fs.create(self._path(hidden), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self._fs.rename(self._path(hidden), self._path(path)):
            raise MaskError(f"{path} is there already")


def _folder(out: str, table: str) -> str:
    return f"{out}/_manifests/{table}"


def staging(out: str, attempt: str, table: str) -> str:
    """Where an attempt writes the rows of a table before they belong to it."""
    return f"{out}/_staging/{attempt}/{table}"


def manifests(spark: SparkSession, out: str, table: str) -> list[Manifest]:
    """Every finished attempt at a table, in order."""
    folder = _folder(out, table)
    if not any(n.endswith(".json") for n in Store(spark, out).names(folder)):
        return []
    rows = spark.read.schema(_SCHEMA).option("mode", "FAILFAST").json(folder).collect()
    found = [
        Manifest(**{**r.asDict(), "files": tuple(r["files"]), "audit": tuple(a.asDict() for a in r["audit"])}) for r in rows
    ]
    return sorted(found, key=lambda m: (m.seq, m.attempt))


def live(found: Sequence[Manifest]) -> list[Manifest]:
    """The attempts that make up the table: the last one that replaced it and those after it."""
    start = max((i for i, m in enumerate(found) if m.replaces), default=0)
    return list(found[start:])


def commit(spark: SparkSession, out: str, manifest: Manifest) -> None:
    """Make a staged attempt part of its table. From here on a crash no longer undoes it."""
    name = f"{manifest.seq:08d}-{manifest.attempt}.json"
    Store(spark, out).write_text(f"{_folder(out, manifest.table_id)}/{name}", json.dumps(asdict(manifest)) + "\n")


def settle(spark: SparkSession, out: str, table: str, *, drop_unlisted: bool = False) -> list[Manifest]:
    """Bring the table's folder to what its manifests say, and return the live ones.

    Files of live attempts that are still staged are moved into place. Files of replaced attempts
    go. Whatever else lies in the folder was never finished: it is set aside below
    ``_orphans``, or deleted with ``drop_unlisted``. Doing this twice changes nothing.
    """
    store, target = Store(spark, out), f"{out}/{table}"
    found = manifests(spark, out, table)
    current = live(found)
    wanted = {f for m in current for f in m.files}
    replaced = {f for m in found for f in m.files} - wanted
    here = store.names(target)
    for name in here:
        if name in wanted or name in ("_SUCCESS", "._SUCCESS.crc"):
            continue
        listed = name in replaced or (name.startswith(".") and name.endswith(".crc"))
        if drop_unlisted or listed:
            store.delete(f"{target}/{name}")
        else:
            store.move(f"{target}/{name}", f"{out}/_orphans/{table}/{len(found):08d}/{name}")
    left = set(here) & wanted
    for m in current:
        source = staging(out, m.attempt, table)
        missing = [f for f in m.files if f not in left]
        if missing and not left and not store.exists(target):
            store.move(source, target)
            left.update(m.files)
            continue
        for f in missing:
            store.move(f"{source}/{f}", f"{target}/{f}")
            left.add(f)
    lost = wanted - left
    if lost:
        raise MaskError(f"{table}: {len(lost)} file(s) of finished attempts are missing")
    for m in current:
        store.delete(staging(out, m.attempt, table))
    return current


def published(spark: SparkSession, out: str, table: str) -> DataFrame | None:
    """The rows of all finished attempts, None if there is none. Unfinished ones are put aside first."""
    return spark.read.parquet(f"{out}/{table}") if settle(spark, out, table) else None


def leftovers(spark: SparkSession, out: str) -> list[str]:
    """Staged folders that no manifest refers to: attempts that died. Safe to delete when nothing is running."""
    store = Store(spark, out)
    known = {m.attempt for t in store.names(f"{out}/_manifests") for m in manifests(spark, out, t)}
    return [f"{out}/_staging/{a}" for a in sorted(store.names(f"{out}/_staging")) if a not in known]

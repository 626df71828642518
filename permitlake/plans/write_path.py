"""The write path: stage rows, check the staged copy, log the changes, publish all at once.

Every write computes its rows once, into files that no reader sees yet. The rules read these
files, so what was checked is what gets published. Nothing is published when a rule is
broken; the error carries all violations as a DataFrame.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce, wraps

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permitlake.operators.changes import (
    audit_changes, audit_deletes, audit_inserts, update_entries,
)
from permitlake.operators.ids import assign_ids
from permitlake.operators.joins import matching
from permitlake.operators.keyed import (
    HIT, OLD, conform, one_per_key, tagged_delete, tagged_update,
)
from permitlake.operators.quality import (
    check_children, check_clash, check_foreign_key, check_rows, check_unique, children_of,
)
from permitlake.registry import Registry
from permitlake.schemas import TABLES
from permitlake.session import remove_dir, shared_dir
from permitlake.sources.store import Conflict, Store

# Tables whose changes are logged.
AUDITED = ("businesses", "permits", "payments")
# How often a write starts before it gives up against other writers.
ATTEMPTS = 5


class RuleViolation(ValueError):
    """A refused write. `violations` has a row for each broken rule and row; the message
    counts them by rule."""

    def __init__(self, violations: DataFrame):
        self.violations = violations
        counts = violations.groupBy("table_name", "rule").count().orderBy("table_name", "rule")
        # One row per rule of the tables, however many rows break it.
        super().__init__("; ".join(f"{r[0]} {r[1]}: {r[2]}" for r in counts.collect()))


class InexactValue(ValueError):
    """A refused write: its type could not hold a value as it was given."""


def violations(
    registry: Registry, table: str, rows: DataFrame, *, gone: DataFrame | None = None
) -> DataFrame:
    """All broken rules of rows of a table: row rules, unique keys, references to parents,
    and references of children to the keys in `gone`."""
    found = [check_rows(rows, table), check_unique(rows, table)]
    for column, parent in TABLES[table].parents.items():
        known = rows if parent == table else registry.table(parent)
        found.append(check_foreign_key(rows, table, column, known))
    if gone is not None:
        for child, column in children_of(table):
            found.append(check_children(gone, table, registry.table(child), child, column))
    return reduce(DataFrame.unionByName, found)


class _Write:
    """One write from a version of the store: staged batches that go again if it fails."""

    def __init__(self, store: Store, now: dt.datetime):
        self.store, self.now = store, now
        self.version = store.version()
        self.registry = store.registry(self.version)
        self.staged: list[tuple[str, list[str]]] = []
        self.aside: list[str] = []

    def stage(
        self, table: str, rows: DataFrame, also: tuple[str, ...] = ()
    ) -> tuple[list[str], int]:
        """Write rows to files of their own; returns the folders and the number of rows."""
        try:
            folders, count = self.store.stage(table, conform(rows, table, self.now, also))
        except PySparkException as error:
            if "would change as" in str(error):
                raise InexactValue(str(error).split("\n")[0]) from error
            raise
        self.staged.append((table, folders))
        return folders, count

    def deal(self, table: str, rows: DataFrame) -> tuple[list[str], DataFrame]:
        """The folders of the rows that stay, and the rows that HIT marks; one write of both."""
        folders, path = self.store.deal(table, rows, HIT)
        self.staged.append((table, folders))
        self.aside.append(path)
        return folders, self.store.set_aside(table, path, HIT).select(*TABLES[table].columns)

    def rows(self, table: str, folders: list[str], also: T.StructType | None = None) -> DataFrame:
        extra = also.names if also else []
        return self.store.read(table, folders, also).select(*TABLES[table].columns, *extra)

    def touched(self, table: str, keys: DataFrame) -> tuple[list[str], list[str]]:
        """The table's folders that hold one of the keys, and all others. Of the table only the
        keys are read, as folders say the rest; a table without folders is not read."""
        folders = self.version.folders.get(table, [])
        column = self.store.folder_column(table)
        if not column:
            return folders, []
        key = TABLES[table].key
        known = self.store.read(table, folders).select(key, column)
        names = self.store.folder_names(table, matching(known, key, keys.select(key)))
        hit = [f for f in folders if f.rsplit("/", 1)[-1] in names]
        return hit, [f for f in folders if f not in hit]

    def check(self, broken: DataFrame) -> None:
        """Refuse the write if there is a violation. They are kept in the shared folder, for
        the staged files they were found in go."""
        shared_dir(self.store.spark)
        found = broken.checkpoint(eager=True)
        if not found.isEmpty():
            raise RuleViolation(found)

    def publish(self, table: str, folders: list[str], entries: DataFrame | None) -> Registry:
        """The table's new folders, and the entries numbered after those of the log."""
        tables, ids = {table: folders}, {}
        if entries is not None:
            last = self.version.last_ids.get("audit_logs", 0)
            numbered = assign_ids(entries, "log_id", ["target_id"], start_after=last)
            staged, count = self.stage("audit_logs", numbered)
            ids["audit_logs"] = last + count
            tables["audit_logs"] = self.version.folders.get("audit_logs", []) + staged
        self.version = self.store.publish(self.version, tables, ids)
        self.staged = []
        return self.store.registry(self.version)

    def __enter__(self) -> _Write:
        return self

    def __exit__(self, *error) -> None:
        for table, folders in self.staged:
            self.store.discard(table, folders)
        for path in self.aside:
            remove_dir(self.store.spark, path)


def _started_again(write: Callable[..., Registry]) -> Callable[..., Registry]:
    """A write that starts again, from the new version, when another writer was faster."""

    @wraps(write)
    def attempt(*args, **kwargs) -> Registry:
        for _ in range(ATTEMPTS - 1):
            try:
                return write(*args, **kwargs)
            except Conflict:
                continue
        return write(*args, **kwargs)

    return attempt


def replace(
    store: Store, table: str, state: DataFrame, *, now: dt.datetime, user_id: int = 0
) -> Registry:
    """Make `state` the content of a table. Rows that are no longer there must have no
    children; returns the registry of the new version. A `Conflict` is left to the caller, whose
    state may come from the older version."""
    with _Write(store, now) as write:
        folders, _ = write.stage(table, state)
        rows, old = write.rows(table, folders), write.registry.table(table)
        key = TABLES[table].key
        gone = old.select(key).join(rows.select(key), key, "left_anti")
        write.check(violations(write.registry, table, rows, gone=gone))
        entries = None
        if table in AUDITED:
            entries = audit_changes(old, rows, table, now=now, user_id=user_id)
        return write.publish(table, folders, entries)


@_started_again
def append(
    store: Store, table: str, rows: DataFrame, *, now: dt.datetime, user_id: int = 0
) -> Registry:
    """Add rows to a table. Only the new rows are checked, also against the keys the table
    has, and logged; the stored rows are neither read whole nor rewritten."""
    with _Write(store, now) as write:
        folders, _ = write.stage(table, rows)
        new = write.rows(table, folders)
        clash = check_clash(new, table, write.registry.table(table))
        write.check(violations(write.registry, table, new).unionByName(clash))
        entries = audit_inserts(new, table, now=now, user_id=user_id) if table in AUDITED else None
        return write.publish(table, write.version.folders.get(table, []) + folders, entries)


@_started_again
def update(
    store: Store,
    table: str,
    changes: DataFrame,
    *,
    now: dt.datetime,
    user_id: int = 0,
    keep_if_null: tuple[str, ...] = (),
) -> Registry:
    """Set columns by key. Only the folders that hold changed rows are written again, by one
    join with the changes. The files it writes also tell which rows were named and what they
    were before: rules and audit rows are read from them. Unique columns are checked against the
    whole table if the changes set one."""
    key = TABLES[table].key
    with _Write(store, now) as write:
        shared_dir(store.spark)
        changes = one_per_key(changes, key).checkpoint(eager=True)
        hit, others = write.touched(table, changes)
        after = tagged_update(write.rows(table, hit), changes, key, keep_if_null=keep_if_null)
        tags = T.StructType([T.StructField(HIT, T.BooleanType()), T.StructField(OLD, TABLES[table].schema)])
        folders, _ = write.stage(table, after, also=(HIT, OLD))
        tagged = write.rows(table, folders, tags).filter(HIT)
        changed = tagged.drop(HIT, OLD)
        found = [check_rows(changed, table)]
        for column, parent in TABLES[table].parents.items():
            if column in changes.columns:
                found.append(
                    check_foreign_key(changed, table, column, write.registry.table(parent))
                )
        if set(TABLES[table].unique) & set(changes.columns):
            found.append(check_unique(write.rows(table, others + folders), table))
        write.check(reduce(DataFrame.unionByName, found))
        entries = None
        if table in AUDITED:
            pairs = tagged.select(
                F.col(OLD).alias("old"), F.struct(*TABLES[table].columns).alias("new")
            )
            entries = update_entries(pairs, table, now=now, user_id=user_id)
        return write.publish(table, others + folders, entries)


@_started_again
def delete(
    store: Store, table: str, doomed: DataFrame, *, now: dt.datetime, user_id: int = 0
) -> Registry:
    """Delete rows by key; refused while another row refers to one of them. One join deals the
    rows of the folders that it concerns into those that stay and those that go; references and
    audit rows are looked up from the latter."""
    key = TABLES[table].key
    with _Write(store, now) as write:
        shared_dir(store.spark)
        doomed = doomed.select(key).distinct().checkpoint(eager=True)
        hit, others = write.touched(table, doomed)
        kept, gone = write.deal(table, tagged_delete(write.rows(table, hit), doomed, key))
        found = [
            check_children(gone.select(key), table, write.registry.table(child), child, column)
            for child, column in children_of(table)
        ]
        if found:
            write.check(reduce(DataFrame.unionByName, found))
        entries = audit_deletes(gone, table, now=now, user_id=user_id) if table in AUDITED else None
        return write.publish(table, others + kept, entries)


def refused_deletes(registry: Registry, table: str, doomed: DataFrame) -> DataFrame:
    """All rows of other tables that refer to rows that are to go: why a delete of these
    keys would be refused."""
    key = TABLES[table].key
    gone = matching(registry.table(table), key, doomed.select(key)).select(key)
    found = [
        check_children(gone, table, registry.table(child), child, column)
        for child, column in children_of(table) if child in registry.names()
    ]
    return reduce(DataFrame.unionByName, found)


__all__ = [
    "AUDITED", "InexactValue", "RuleViolation", "append", "delete",
    "refused_deletes", "replace", "update", "violations",
]

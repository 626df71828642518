"""Data rules: one row per violation, as (table_name, rule, row_key).

As in SQL constraints, a null passes the domain, range, unique and foreign-key rules.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permitlake.operators.keyed import loses
from permitlake.schemas import TABLES, Table

NOT_NULL, DOMAIN, RANGE = "not_null", "domain", "range"
JSON, EXACT = "json", "exact"


def _row_rules(spec: Table, kinds: Iterable[str]) -> list[tuple[str, str, Column]]:
    """(rule, column, condition under which a row breaks it)."""
    rules = []
    if NOT_NULL in kinds:
        for c in (spec.key, *spec.required):
            rules.append((f"{NOT_NULL}:{c}", c, F.col(c).isNull()))
    if DOMAIN in kinds:
        for c, allowed in spec.domains.items():
            rules.append((f"{DOMAIN}:{c}", c, ~F.col(c).isin(*allowed)))
    if RANGE in kinds:
        for c, (low, high) in spec.ranges.items():
            rules.append((f"{RANGE}:{c}", c, ~F.col(c).between(low, high)))
    if JSON in kinds:
        for c in spec.json:
            rules.append((f"{JSON}:{c}", c, ~is_json(F.col(c))))
    return rules


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value; null for null.

    It has to be the only element of a list, and the only member of an object: brackets in
    the text that close one of them leave the other broken.
    """
    listed = F.concat(F.lit("["), text, F.lit("]"))
    member = F.concat(F.lit('{"v":'), text, F.lit("}"))
    one = (
        F.try_parse_json(listed).isNotNull()
        & F.try_parse_json(member).isNotNull()
        & (F.json_array_length(listed) == 1)
    )
    return F.when(text.isNotNull(), F.coalesce(one, F.lit(False)))


def _violations(rows: DataFrame, table: str, rule: Column, key: Column) -> DataFrame:
    return rows.select(
        F.lit(table).alias("table_name"), rule.alias("rule"), key.cast("string").alias("row_key")
    )


def check_rows(
    rows: DataFrame, table: str, kinds: Iterable[str] = (NOT_NULL, DOMAIN, RANGE, JSON)
) -> DataFrame:
    """Row-wise rules in one scan, without a shuffle. A rule on a column that the rows do
    not have cannot be checked: that is an error, not a pass."""
    spec = TABLES[table]
    found = _row_rules(spec, tuple(kinds))
    absent = sorted({column for _, column, _ in found if column not in rows.columns})
    if absent:
        raise ValueError(f"{table}: no column {absent} to check")
    rules = [(rule, condition) for rule, _, condition in found]
    if EXACT in kinds:
        for c, kind in spec.columns.items():
            given = rows.schema[c].dataType if c in rows.columns else kind
            if given != kind:
                rules.append((f"{EXACT}:{c}", loses(F.col(c), given, kind)))
    if not rules:
        return _violations(rows.limit(0), table, F.lit(""), F.col(spec.key))
    # The filter reaches the reader; only rows that break a rule are worked on further.
    faulty = rows.filter(reduce(Column.__or__, [condition for _, condition in rules]))
    broken = F.array_compact(F.array(*(F.when(c, F.lit(rule)) for rule, c in rules)))
    failed = faulty.select(F.col(spec.key), F.explode(broken).alias("_rule"))
    return _violations(failed, table, F.col("_rule"), F.col(spec.key))


def check_unique(rows: DataFrame, table: str) -> DataFrame:
    """Values of key columns that occur more than once. All key columns of a table are one scan:
    each row gives its (column, value) pairs, which are counted before the one shuffle. A key
    column that the rows lack is an error."""
    columns = _key_columns(rows, table)
    values = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    pairs = rows.select(F.inline(F.array(*values))).filter(F.col("value").isNotNull())
    twice = pairs.groupBy("column", "value").agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > 1)
    return _violations(twice, table, F.concat(F.lit("unique:"), "column"), F.col("value"))


def _key_columns(rows: DataFrame, table: str) -> list[str]:
    spec = TABLES[table]
    columns = [spec.key, *spec.unique]
    absent = [c for c in columns if c not in rows.columns]
    if absent:
        raise ValueError(f"{table}: no column {absent} to check")
    return columns


def check_clash(rows: DataFrame, table: str, existing: DataFrame) -> DataFrame:
    """Values of key columns in new rows that the table already has.

    The batch bounds what is looked at: its smallest and largest value of each key column (one
    small job) go to the reader of the stored table as a filter, so that files and row groups
    beyond them are skipped; serial ids, which continue the table's, meet none. Within these
    bounds the batch's keys meet the stored ones in an inner join, where a small batch can be
    the side that is sent, and for a large one Spark builds a Bloom filter on the batch and
    applies it to the stored rows before they are shuffled.
    """
    columns = [c for c in _key_columns(rows, table) if c in existing.columns]
    ends = rows.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max)))).first()
    found = []
    for c in columns:
        within = F.col(c).between(ends[f"min_{c}"], ends[f"max_{c}"])
        new, stored = (frame.select(c).filter(within) for frame in (rows, existing))
        taken = stored.join(new, c).distinct()
        found.append(_violations(taken, table, F.lit(f"unique:{c}"), F.col(c)))
    return reduce(DataFrame.unionByName, found)


def check_foreign_key(rows: DataFrame, table: str, column: str, parent: DataFrame) -> DataFrame:
    """Rows whose reference is set but not found in the parent table. Parent keys are
    unique and need no grouping, so a reference that very many rows share can be split."""
    spec = TABLES[table]
    parent_key = TABLES[spec.parents[column]].key
    known = parent.select(F.col(parent_key).alias("_ref"))
    refs = rows.filter(F.col(column).isNotNull()).select(
        F.col(spec.key).alias("_key"), F.col(column).alias("_ref")
    )
    orphans = refs.join(known, "_ref", "left_anti")
    return _violations(orphans, table, F.lit(f"foreign_key:{column}"), F.col("_key"))


def check_children(
    gone: DataFrame, table: str, child: DataFrame, child_table: str, column: str
) -> DataFrame:
    """Rows of a child table that refer to a parent row that is to go: (key of the parent's
    table) `gone` holds the keys. A database refuses such a delete."""
    key = TABLES[table].key
    refs = child.filter(F.col(column).isNotNull()).select(
        F.col(TABLES[child_table].key).alias("_key"), F.col(column).alias("_ref")
    )
    left = refs.join(gone.select(F.col(key).alias("_ref")), "_ref", "left_semi")
    return _violations(left, child_table, F.lit(f"foreign_key:{column}"), F.col("_key"))


def children_of(table: str) -> list[tuple[str, str]]:
    """(child table, column) of every reference to a table."""
    return [(t.name, c) for t in TABLES.values() for c, parent in t.parents.items() if parent == table]


def check_registry(registry) -> DataFrame:
    """All rules over all tables of a registry."""
    found = []
    for name in registry.names():
        rows = registry.table(name)
        found += [check_rows(rows, name), check_unique(rows, name)]
        for column, parent in TABLES[name].parents.items():
            if column in rows.columns and parent in registry.names():
                found.append(check_foreign_key(rows, name, column, registry.table(parent)))
    return reduce(DataFrame.unionByName, found)

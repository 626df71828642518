"""Insert, update, delete and upsert by key, as joins whose result is the new table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permitlake.functions.literals import moment
from permitlake.operators.joins import keys_of, spread_keys_of
from permitlake.schemas import TABLES, WRITE_TIME


def _default(value, now: dt.datetime) -> Column:
    return moment(now) if value == WRITE_TIME else F.lit(value)


def loses(value: Column, given: T.DataType, kind: T.DataType) -> Column:
    """Whether a cast would change the value: null, rounded or cut."""
    if given == kind or isinstance(given, T.NullType):
        return F.lit(False)
    there = value.try_cast(kind)
    if isinstance(given, T.StringType):
        # Text has many forms for a number or a time; what counts are the digits.
        changed = F.lit(False)
        if isinstance(kind, T.DecimalType):
            fraction = F.length(F.regexp_extract(value, r"\.([0-9]*?)0*\s*$", 1))
            power = value.rlike("[eE]") & (there.try_cast("double") != value.try_cast("double"))
            changed = (fraction > kind.scale) | power
    else:
        changed = ~there.try_cast(given).eqNullSafe(value)
    return value.isNotNull() & (there.isNull() | changed)


def exact(value: Column, given: T.DataType, kind: T.DataType, name: str) -> Column:
    """The value under another type; an error if that would change it."""
    if given == kind or isinstance(given, T.NullType):
        return value.cast(kind)
    message = F.concat(F.lit(f"{name} would change as {kind.simpleString()}: "), value.cast("string"))
    return F.when(loses(value, given, kind), F.raise_error(message)).otherwise(value.try_cast(kind))


def conform(
    rows: DataFrame, table: str, now: dt.datetime, also: tuple[str, ...] = ()
) -> DataFrame:
    """Rows in the column order and types of the table. A column the rows lack gets its
    default, else null; a null that is given stays null. A value that its type cannot hold
    as it is raises an error. Columns in `also` follow as they are."""
    spec = TABLES[table]
    unknown = [c for c in rows.columns if c not in spec.columns and c not in also]
    if unknown:
        raise ValueError(f"{table} has no column {unknown}")
    return rows.select(
        *(
            (
                exact(F.col(c), rows.schema[c].dataType, kind, f"{table}.{c}")
                if c in rows.columns
                else _default(spec.defaults.get(c), now).cast(kind)
            ).alias(c)
            for c, kind in spec.columns.items()
        ),
        *also,
    )


def append_records(target: DataFrame, rows: DataFrame) -> DataFrame:
    """The table after the rows are added; columns go by name, absent ones become null."""
    unknown = [c for c in rows.columns if c not in target.columns]
    if unknown:
        raise ValueError(f"the table has no column {unknown}")
    return target.unionByName(rows, allowMissingColumns=True)


def one_per_key(
    rows: DataFrame, key: str, newest_by: list[str] | None = None, *, spread: bool = False
) -> DataFrame:
    """One row per non-null key: the newest one by the given columns, or, without them,
    an error when a key occurs twice. Combined before the shuffle.

    With `spread`, the result is not partitioned by the key, so that a join with a table
    in which the key is hot can be split (see `spread_keys_of`).
    """
    values = [c for c in rows.columns if c != key]
    given = rows.filter(F.col(key).isNotNull())
    by = [key, F.hash(key)] if spread else [key]
    if not newest_by:
        # One shuffle by the key, which the join that follows goes on with.
        counted = given.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*by)))
        message = F.concat(F.lit("several rows for key "), F.col(key).cast("string"))
        single = F.when(F.col("_rows") > 1, F.raise_error(message).cast("boolean"))
        return counted.filter(single.otherwise(F.lit(True))).select(key, *values)
    newest = F.max_by(F.struct(*values), F.struct(*newest_by)).alias("_row")
    found = given.groupBy(*by).agg(newest)
    return found.select(key, *(F.col("_row")[c].alias(c) for c in values))


def update_by_key(
    target: DataFrame,
    changes: DataFrame,
    key: str,
    *,
    newest_by: list[str] | None = None,
    keep_if_null: tuple[str, ...] = (),
    unique: bool = False,
) -> DataFrame:
    """Set the columns of `changes` where the key matches; other rows stay as they are.

    Columns in `newest_by` that the table lacks only rank the changes of one key. A null
    among the changes is written, but for the columns in `keep_if_null`. `unique` says
    that the key is unique in the table; that saves a shuffle of the changes.
    """
    new, after = _update(target, changes, key, newest_by, keep_if_null, unique)
    return target.join(new, key, "left").select(*(after(c) for c in target.columns))


def updated_pairs(
    target: DataFrame,
    changes: DataFrame,
    key: str,
    *,
    newest_by: list[str] | None = None,
    keep_if_null: tuple[str, ...] = (),
) -> DataFrame:
    """The rows that an update meets, as structs `old` and `new`: an inner join of the
    changes with a table whose key is unique. All other rows stay and are not moved on."""
    new, after = _update(target, changes, key, newest_by, keep_if_null, unique=True)
    old = F.struct(*target.columns).alias("old")
    return target.join(new, key).select(
        old, F.struct(*(after(c).alias(c) for c in target.columns)).alias("new")
    )


# Columns that a tagged pass adds: whether the row was named, and the row before.
HIT, OLD = "was_named", "row_before"


def tagged_update(
    target: DataFrame, changes: DataFrame, key: str, *, keep_if_null: tuple[str, ...] = ()
) -> DataFrame:
    """The table after an update, each row with HIT, whether the changes name it, and OLD, the
    row before if they do. One join gives the new table and all that is to be logged of it.
    The key is unique in the table and among the changes."""
    new, after = _update(target, changes, key, None, keep_if_null, unique=True)
    hit = F.col("_hit").isNotNull()
    return target.join(new, key, "left").select(
        *(after(c) for c in target.columns),
        hit.alias(HIT), F.when(hit, F.struct(*target.columns)).alias(OLD),
    )


def tagged_delete(target: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    """All rows of the table, each with HIT, whether it is to go."""
    named = spread_keys_of(doomed, key).withColumn(HIT, F.lit(True))
    return target.join(named, key, "left").select(
        *target.columns, F.col(HIT).isNotNull().alias(HIT)
    )


def _update(target, changes, key, newest_by, keep_if_null, unique):
    """The changes by key, and a function from a column to its value after the join."""
    names = [c for c in changes.columns if c != key and c in target.columns]
    unknown = set(changes.columns) - set(target.columns) - set(newest_by or ())
    if unknown:
        raise ValueError(f"the table has no column {sorted(unknown)}")
    if not names:
        raise ValueError("no data to update")
    new = one_per_key(changes, key, newest_by, spread=not unique).select(
        key, F.lit(True).alias("_hit"), *(F.col(c).alias(f"_new_{c}") for c in names)
    )

    def after(column: str) -> Column:
        if column not in names:
            return F.col(column)
        given = exact(
            F.col(f"_new_{column}"), changes.schema[column].dataType,
            target.schema[column].dataType, column,
        )
        if column in keep_if_null:
            return F.coalesce(given, F.col(column)).alias(column)
        return F.when(F.col("_hit"), given).otherwise(F.col(column)).alias(column)

    return new, after


def delete_by_key(target: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    """The table without the rows whose key is listed; a null key matches nothing."""
    return target.join(spread_keys_of(doomed, key), key, "left_anti").select(*target.columns)


def new_by_key(
    target: DataFrame, incoming: DataFrame, key: str, first_by: list[str]
) -> DataFrame:
    """Incoming rows an insert-or-ignore would keep: the first of each key that the table
    does not have. Null keys never clash, so those rows are all kept, without a shuffle."""
    keyed = incoming.filter(F.col(key).isNotNull())
    whole = F.struct(*incoming.columns)
    first = keyed.groupBy(key).agg(F.min_by(whole, F.struct(*first_by)).alias("_row"))
    absent = first.join(keys_of(target, key), key, "left_anti")
    kept = absent.select(*(F.col("_row")[c].alias(c) for c in incoming.columns))
    return kept.unionByName(incoming.filter(F.col(key).isNull()))


def insert_ignore(
    target: DataFrame, incoming: DataFrame, key: str, first_by: list[str]
) -> DataFrame:
    return append_records(target, new_by_key(target, incoming, key, first_by))

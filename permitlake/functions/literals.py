"""Literals and text helpers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(value: dt.date) -> Column:
    return F.lit(value.isoformat()).cast("date")


def moment(value: dt.datetime | dt.date) -> Column:
    """A timestamp without zone; a bare date means its midnight."""
    if not isinstance(value, dt.datetime):
        value = dt.datetime.combine(value, dt.time.min)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def choose(value: Column, options: dict, otherwise) -> Column:
    """The option for the value, by equality; `otherwise` for any other value and null."""
    (name, result), *others = options.items()
    chosen = F.when(value == name, result)
    for name, result in others:
        chosen = chosen.when(value == name, result)
    return chosen.otherwise(otherwise)


def like_escape(term: str) -> str:
    """The term with the wildcards of LIKE taken literally."""
    return "".join("\\" + c if c in "\\%_" else c for c in term)


def slug(text: Column) -> Column:
    return F.lower(F.replace(text, F.lit(" "), F.lit("-")))

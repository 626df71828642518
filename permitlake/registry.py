"""A named set of registry tables, each a lazy DataFrame."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permitlake.functions.literals import day, moment
from permitlake.schemas import MONTH, TABLES


def _first(value: dt.date) -> dt.date:
    return dt.date(value.year, value.month, 1)


class Registry:
    """The tables a report or job reads. Nothing runs until a result is used."""

    def __init__(
        self,
        spark: SparkSession,
        tables: Mapping[str, DataFrame],
        by_month: Mapping[str, DataFrame] | None = None,
    ):
        """`by_month` has those tables again that are stored in a folder per month, with the
        folder's column MONTH."""
        self.spark = spark
        self._tables = dict(tables)
        self._by_month = dict(by_month or {})

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            raise ValueError(f"unknown table {name!r}; have {sorted(self._tables)}")
        return self._tables[name]

    def names(self) -> list[str]:
        return list(self._tables)

    def replace(self, **tables: DataFrame) -> Registry:
        """A registry with some tables exchanged, e.g. after an update job."""
        stored = {n: rows for n, rows in self._by_month.items() if n not in tables}
        return Registry(self.spark, {**self._tables, **tables}, stored)

    def months(self, name: str) -> list[dt.date | None] | None:
        """The months that a table has folders of, rows without a time first, then the newest;
        None for a table that is not stored by month. The file listing tells; nothing is read."""
        if name not in self._by_month:
            return None
        found = {
            m[1] for f in self._by_month[name].inputFiles() if (m := re.search(rf"/{MONTH}=([^/]+)/", f))
        }
        dated = sorted((dt.date.fromisoformat(m) for m in found if m[0].isdigit()), reverse=True)
        return [None] * any(not m[0].isdigit() for m in found) + dated

    def of_month(self, name: str, month: dt.date | None) -> DataFrame:
        """Rows of one month of a table; of its folder only, where there is one."""
        rows = self._by_month.get(name, self.table(name))
        stored = F.col(MONTH) if name in self._by_month else F.trunc(TABLES[name].month_of, "month")
        wanted = stored.isNull() if month is None else stored == day(month)
        return rows.filter(wanted).select(*self.table(name).columns)

    def between(
        self, name: str, start: dt.date | None = None, end: dt.date | None = None
    ) -> DataFrame:
        """Rows of a table whose time lies between two bounds, both included; a missing bound
        is open. Where the table is stored by month, other months' folders are not read."""
        column = F.col(TABLES[name].month_of)
        own = self.table(name)
        rows = self._by_month.get(name, own)
        by_month = name in self._by_month
        if start is not None:
            rows = rows.filter(column >= moment(start))
            if by_month:
                rows = rows.filter(F.col(MONTH) >= day(_first(start)))
        if end is not None:
            rows = rows.filter(column <= moment(end))
            if by_month:
                rows = rows.filter(F.col(MONTH) <= day(_first(end)))
        return rows.select(*own.columns)

    def permits_of_year(self, year: int) -> DataFrame:
        """Permits of one year; prunes partitions where permits are stored by year."""
        return self.table("permits").filter(F.col("permit_year") == year)

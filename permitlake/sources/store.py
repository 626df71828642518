"""A registry stored in versions: files that never change, and a pointer per version.

Below `data/<table>/batch=<id>` lie the files of each write, by year or month where the table
has such folders. `versions/<number>.json` names the folders that make up every table, and
the last id of the log. A write stages its files first, so that they can be checked, and
then creates the next pointer. That one step makes all its tables visible together. It fails
if another writer has taken the number: nothing of the later write is seen, and it starts
again from the new version. Folders that a change does not touch stay as they are, and are
named again.

A pointer is written to a hidden file and then gets its name in one step that refuses a name
that is taken: a rename on HDFS, a hard link on a local disk. A writer that dies between the
two leaves a hidden file that nobody reads. Stores without such a step (object stores, where a
rename copies) are refused.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permitlake.registry import Registry
from permitlake.schemas import DATE, MONTH, TABLES
from permitlake.session import remove_dir
from permitlake.sources.parquet import with_folders

BATCH = "batch"
# File systems whose rename is one step that refuses an existing target.
ATOMIC_RENAME = ("hdfs", "viewfs")


class Conflict(RuntimeError):
    """Another writer has published first; start again from the new version."""


@dataclass(frozen=True)
class Version:
    """What a pointer says: for each table its folders, as paths below the table's own."""

    number: int = 0
    folders: dict[str, list[str]] = field(default_factory=dict)
    last_ids: dict[str, int] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._jvm = spark._jvm
        self._pointers = self._jvm.org.apache.hadoop.fs.Path(f"{folder}/versions")
        self._files = self._pointers.getFileSystem(spark._jsc.hadoopConfiguration())

    # --- versions ---

    def version(self) -> Version:
        """The last version; an empty one before the first write."""
        if not self._files.exists(self._pointers):
            return Version()
        names = [f.getPath().getName() for f in self._files.listStatus(self._pointers)]
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "."]
        if not numbers:
            return Version()
        rows = self.spark.read.text(f"{self.folder}/versions/{max(numbers)}.json", wholetext=True)
        return Version(**json.loads(rows.first()[0]))

    def publish(
        self, base: Version, folders: dict[str, list[str]], last_ids: dict[str, int] | None = None
    ) -> Version:
        """Make the given folders the content of their tables, as the version after `base`."""
        new = Version(
            base.number + 1, {**base.folders, **folders}, {**base.last_ids, **(last_ids or {})}
        )
        hadoop = self._jvm.org.apache.hadoop.fs
        path = hadoop.Path(self._pointers, f"{new.number}.json")
        hidden = hadoop.Path(self._pointers, f".{new.number}-{uuid.uuid4().hex}")
        out = self._files.create(hidden, False)
        out.write(bytearray(json.dumps(new.__dict__).encode()))
        out.close()
        try:
            self._name(hidden, path)
        except Py4JJavaError as error:
            if not self._files.exists(path):
                raise
            raise Conflict(f"version {new.number} is already there") from error
        finally:
            self._files.delete(hidden, False)
        return new

    def _name(self, hidden, path) -> None:
        """Give a complete file its name in one step; an error if the name is taken."""
        scheme = self._files.getUri().getScheme()
        if scheme == "file":
            paths = self._jvm.java.nio.file.Paths
            own, target = (paths.get(p.toUri().getPath(), self._strings()) for p in (hidden, path))
            self._jvm.java.nio.file.Files.createLink(target, own)
        elif scheme in ATOMIC_RENAME:
            rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
            options = self.spark.sparkContext._gateway.new_array(rename, 1)
            options[0] = rename.NONE
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri())
            context.rename(hidden, path, options)
        else:
            raise ValueError(f"{scheme}: no rename in one step, the store needs one")

    def _strings(self):
        return self.spark.sparkContext._gateway.new_array(self._jvm.java.lang.String, 0)

    # --- tables ---

    def _schema(self, table: str) -> T.StructType:
        schema = T.StructType(TABLES[table].schema.fields)
        if TABLES[table].month_of:
            schema = schema.add(MONTH, DATE)
        return schema

    def read(self, table: str, folders: list[str], also: T.StructType | None = None) -> DataFrame:
        """The rows of some folders of a table, with the folder column of the month, and columns
        that a tagged pass has added."""
        schema = T.StructType(self._schema(table).fields + (also.fields if also else []))
        if not folders:
            return self.spark.createDataFrame([], schema)
        base = f"{self.folder}/data/{table}"
        reader = self.spark.read.schema(schema).option("basePath", base)
        return reader.parquet(*[f"{base}/{f}" for f in folders]).select(*schema.names)

    def registry(self, version: Version | None = None) -> Registry:
        version = version or self.version()
        full = {name: self.read(name, version.folders.get(name, [])) for name in TABLES}
        tables = {name: rows.select(*TABLES[name].columns) for name, rows in full.items()}
        by_month = {name: full[name] for name in TABLES if TABLES[name].month_of}
        return Registry(self.spark, tables, by_month)

    def stage(self, table: str, rows: DataFrame) -> tuple[list[str], int]:
        """Write rows to a batch of their own, not visible yet; returns its folders and the
        number of rows, counted as they are written."""
        batch = f"{BATCH}={uuid.uuid4().hex}"
        path = f"{self.folder}/data/{table}/{batch}"
        by, count = self._write(table, rows, path, ())
        return self._folders(table, batch, by), count

    def deal(self, table: str, rows: DataFrame, flag: str) -> tuple[list[str], str]:
        """Write rows once, those whose boolean `flag` is false to a batch as `stage` does, the
        others to a folder of their own, which is no part of the table. Returns the batch's
        folders and that folder's parent; `set_aside` reads it."""
        name = uuid.uuid4().hex
        path = f"{self.folder}/dealt/{table}/{name}"
        by, _ = self._write(table, rows, path, (flag,))
        hadoop, batch = self._jvm.org.apache.hadoop.fs, f"{BATCH}={name}"
        kept = hadoop.Path(path, f"{flag}=false")
        if not self._files.exists(kept):
            return [], path
        target = hadoop.Path(f"{self.folder}/data/{table}/{batch}")
        self._files.mkdirs(target.getParent())
        if not self._files.rename(kept, target):
            raise OSError(f"{kept} could not be moved")
        return self._folders(table, batch, by), path

    def set_aside(self, table: str, path: str, flag: str) -> DataFrame:
        """The rows that `deal` has not put into the batch."""
        folder = f"{path}/{flag}=true"
        if not self._files.exists(self._jvm.org.apache.hadoop.fs.Path(folder)):
            return self.spark.createDataFrame([], self._schema(table))
        return self.spark.read.schema(self._schema(table)).parquet(folder)

    def _write(self, table: str, rows: DataFrame, path: str, apart: tuple[str, ...]):
        rows, by = with_folders(rows, table)
        if apart + by:
            rows = rows.hint("rebalance", *apart, *by)
        counted = Observation()
        rows = rows.observe(counted, F.count(F.lit(1)).alias("rows"))
        try:
            rows.write.partitionBy(*apart, *by).parquet(path)
        except Exception:
            remove_dir(self.spark, path)
            raise
        return by, counted.get["rows"]

    def _folders(self, table: str, batch: str, by: tuple[str, ...]) -> list[str]:
        if not by:
            return [batch]
        target = self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/data/{table}/{batch}")
        names = [f.getPath().getName() for f in self._files.listStatus(target) if f.isDirectory()]
        return [f"{batch}/{name}" for name in sorted(names)]

    def discard(self, table: str, folders: list[str]) -> None:
        """Remove the files of a batch that was not published."""
        for batch in {f.split("/")[0] for f in folders}:
            remove_dir(self.spark, f"{self.folder}/data/{table}/{batch}")

    def folder_column(self, table: str) -> str | None:
        """The column that a table's folders are named by."""
        spec = TABLES[table]
        return MONTH if spec.month_of else (spec.partition_by or (None,))[0]

    def folder_names(self, table: str, rows: DataFrame) -> set[str]:
        """Names of the folders that the rows, which have the folder column, are read from."""
        column = self.folder_column(table)
        found = rows.select(F.col(column).cast("string").alias("name")).distinct().collect()
        missing = "__HIVE_DEFAULT_PARTITION__"
        return {f"{column}={r['name'] if r['name'] is not None else missing}" for r in found}

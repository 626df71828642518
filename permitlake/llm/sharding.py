"""Operator 7: shards cut from a Hilbert curve over several metadata dimensions.

Each dimension is quantised to 2**bits cells that keep its order: texts (language, source) by
the rank of the value among all that occur, sizes by quantiles of the rows. The cell's index on
a Hilbert curve orders the rows, and runs of that order become shards. Rows near each other on
the curve are near in every dimension, so the minimum and maximum of a shard's files prune on
all of them.

DataFrame functions only. The order is written once to the shared folder; only the number of
rows per written partition goes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permitlake.llm.common import cut_lineage, pick, sized

SHARDS = 24
BITS = 10  # per dimension
SIZE_OVERHEAD = 8  # bytes a row takes besides its text


def hilbert_index(cells: Sequence[Column], bits: int) -> Column:
    """The place on the Hilbert curve of a point of integer cells, each below 2**bits.

    Walks from the coarsest bit to the finest. At each level the bits of all dimensions form
    the number of a sub-cube; undoing the entry point and direction of the curve in the cube
    and decoding the Gray code gives its turn. The state is the entry point and direction.
    With n dimensions and n * bits below 64, the index is a non-negative long.
    """
    n = len(cells)
    full = (1 << n) - 1

    def turn(value: Column, by: Column) -> Column:
        """The low n bits rotated right by `by` (0 to n - 1)."""
        right = F.call_function("shiftright", value, by)
        left = F.call_function("shiftleft", value, (F.lit(n) - by).cast("int"))
        return right.bitwiseOR(left).bitwiseAND(F.lit(full))

    def turn_back(value: Column, by: Column) -> Column:
        return turn(value, F.pmod(F.lit(n) - by, F.lit(n)).cast("int"))

    def sub_cube(level: Column) -> Column:
        number = F.lit(0)
        for place, cell in enumerate(cells):
            bit = F.call_function("shiftright", cell.cast("int"), level).bitwiseAND(F.lit(1))
            number = number.bitwiseOR(F.shiftleft(bit, place))
        return number

    # Small tables over the 2**n turns: entry point and direction of each turn's sub-cube.
    def gray(i: int) -> int:
        return i ^ i >> 1

    def ones(i: int) -> int:
        return ((i ^ i + 1).bit_length() - 1) if i >= 0 else 0

    entry = [0 if i == 0 else gray(2 * ((i - 1) // 2)) for i in range(1 << n)]
    direction = [
        0 if i == 0 else (ones(i - 1) if i % 2 == 0 else ones(i)) % n for i in range(1 << n)
    ]
    decode = [0] * (1 << n)
    for i in range(1 << n):
        decode[gray(i)] = i
    lookup = {k: F.array(*[F.lit(x) for x in v]) for k, v in
              {"entry": entry, "direction": direction, "decode": decode}.items()}

    def step(state: Column, level: Column) -> Column:
        inside = turn(
            sub_cube(level).bitwiseXOR(state["entry"]), F.pmod(state["direction"] + 1, F.lit(n))
        )
        at = F.element_at(lookup["decode"], inside + 1)
        # Reached only through a one-element array, so that `at` is evaluated once.
        return F.transform(
            F.array(at),
            lambda w: F.struct(
                state["entry"].bitwiseXOR(
                    turn_back(
                        F.element_at(lookup["entry"], w + 1),
                        F.pmod(state["direction"] + 1, F.lit(n)),
                    )
                ).alias("entry"),
                F.pmod(
                    state["direction"] + F.element_at(lookup["direction"], w + 1) + 1, F.lit(n)
                ).alias("direction"),
                F.shiftleft(state["index"], n).bitwiseOR(w.cast("bigint")).alias("index"),
            ),
        )[0]

    start = F.struct(
        F.lit(0).alias("entry"), F.lit(0).alias("direction"), F.lit(0).cast("bigint").alias("index")
    )
    levels = F.array(*[F.lit(level) for level in reversed(range(bits))])
    return F.aggregate(levels, start, step, lambda state: state["index"])


def ranked_cells(rows: DataFrame, column: str, bits: int) -> DataFrame:
    """value, cell: each distinct value of a column with a cell that keeps the order of values.

    The values spread evenly over the cells, a null lowest. Where there are more values than
    cells, neighbours share one.
    """
    values, total = _ranked(rows.select(F.col(column).alias("value")).distinct(), ["value"])
    return values.select("value", F.floor(F.col("_rank") * (1 << bits) / max(total, 1)).cast("int").alias("cell"))


QUANTILES = 16


def quantile_cell(rows: DataFrame, column: str, bits: int) -> Column:
    """A cell for a number of which the rows tell the distribution: QUANTILES parts of as many
    rows each get as many cells, linear inside a part. Nulls share the lowest cell."""
    asked = F.percentile_approx(column, [k / QUANTILES for k in range(QUANTILES + 1)], 10_000)
    ends = rows.agg(asked.alias("q")).first()["q"] or [0] * (QUANTILES + 1)
    width = (1 << bits) // QUANTILES
    cell = F.lit(0)
    for k, (low, high) in enumerate(zip(ends, ends[1:], strict=False)):
        inside = F.least(F.floor((F.col(column) - low) * width / max(high - low, 1)), F.lit(width - 1))
        cell = F.when(F.col(column) >= low, k * width + inside).otherwise(cell)
    return F.coalesce(cell, F.lit(0)).cast("int")


ROW_BYTES = 64  # of a row that is put in order, about
RANGE_BYTES = 128 << 20


def _ranges(rows: DataFrame, count: int) -> int:
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-count * ROW_BYTES // RANGE_BYTES))


def _ranked(rows: DataFrame, order: Sequence[str], count: int = 0) -> tuple[DataFrame, int]:
    """The rows with `_rank`, their place in the order from 0, and their number.

    Ranges of the order are sorted and kept in the shared folder, more of them for a larger
    `count` of rows; the rows per range, one number each, are added up outside and joined back.
    """
    ordered = cut_lineage(
        rows.repartitionByRange(_ranges(rows, count), *order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_place", 33))
    total, offsets = 0, []
    for part, own in sorted(ordered.groupBy("_part").count().collect()):
        offsets.append((part, total))
        total += own
    before = rows.sparkSession.createDataFrame(offsets, "_part bigint, _before bigint")
    rank = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = ordered.join(F.broadcast(before), "_part").withColumn("_rank", rank)  # one row per range
    return ranked.drop("_part", "_place", "_before"), total


def cut_runs(
    rows: DataFrame, order: Sequence[str], n_shards: int = SHARDS, count: int = 0
) -> DataFrame:
    """Cut the rows, in the given order, into runs whose counts differ by one at most.

    Adds `shard` (0 to n_shards - 1) and `slot` (the place in the shard from 0). The order
    should end in a unique column; rows equal in all of it take any order among themselves.
    An empty table gives no shard. A hot value is no obstacle: ranges of the whole order are
    sorted, and a run may begin inside a group of equal values. `count`, about the number of
    rows, only sets the number of ranges.
    """
    ranked, total = _ranked(rows, order, count)
    small, rest = divmod(total, n_shards)
    # The first `rest` shards have one row more.
    wide = rest * (small + 1)
    shard = F.when(F.col("_rank") < wide, F.floor(F.col("_rank") / (small + 1))).otherwise(
        rest + F.floor((F.col("_rank") - wide) / max(small, 1))
    )
    begin = F.when(F.col("shard") < rest, F.col("shard") * (small + 1)).otherwise(
        wide + (F.col("shard") - rest) * small
    )
    return (
        ranked.withColumn("shard", shard.cast("int"))
        .withColumn("slot", (F.col("_rank") - begin).cast("bigint"))
        .drop("_rank")
    )


def _placed(documents: DataFrame, whole: bool, n_shards: int) -> DataFrame:
    """Every row with its shard and slot; with `row`, all of its columns, if they are wanted."""
    given = pick(documents, "doc_id", "text", "lang", "source")
    if whole:
        plain = [f"_{i}" for i in range(len(documents.columns))]
        at = {c: f"_{documents.columns.index(c)}" for c in given.columns}
        given = documents.toDF(*plain).select(
            F.struct(*plain).alias("row"), *(F.col(own).alias(c) for c, own in at.items())
        )
    more = ["row"] if whole else []
    rows = given.select(
        "doc_id", "lang", "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + SIZE_OVERHEAD).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.encode("text", "utf-8"), F.lit(b""))).alias("text_crc32"),
        F.xxhash64("text").alias("text_hash"),
        F.col("text").isNull().alias("missing"), *more,
    )
    group = ["size", "text_crc32", "text_hash", "missing"]
    digests = rows.select("doc_id", "lang", "source", *group)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "lang", "source"))
    # Grouped by one more column, so that the join below shuffles both of its sides itself:
    # only then can adaptive execution split a group that holds a large share of the rows.
    where = F.struct("lang", "source")
    groups = digests.groupBy(*group, F.hash("text_hash").alias("h")).agg(
        first.alias("first"), (~F.min(where).eqNullSafe(F.max(where))).alias("mixed")
    ).select(
        *group, F.col("first.lang").alias("group_lang"), F.col("first.source").alias("group_source"),
        F.col("first.doc_id").alias("group_id"), "mixed",
    )
    for name, column in (("lang_cell", "lang"), ("source_cell", "source")):
        cells = sized(cut_lineage(ranked_cells(digests, column, BITS))).withColumnRenamed("cell", name)
        groups = groups.join(cells, F.col(f"group_{column}").eqNullSafe(F.col("value"))).drop("value")
    curve = hilbert_index(
        [F.col("lang_cell"), F.col("source_cell"), quantile_cell(digests, "size", BITS)], BITS
    )
    # Copies from several places spoil the minimum and maximum of the shard they are in; such
    # groups come after all others, in the same order.
    last = F.when(F.col("mixed"), F.lit(1 << 3 * BITS)).otherwise(0)
    placed = rows.join(groups.withColumn("hilbert", curve + last), group).select(
        "doc_id", "size", "text_crc32", "text_hash", "hilbert", "group_id", *more
    )
    count = given.count()
    return cut_runs(placed, ["hilbert", "text_hash", "group_id", "doc_id"], n_shards, count)


def shard_documents(documents: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """Put all documents into shards of equal row counts along a Hilbert curve.

    Dimensions: language, source and size, as of the group of equal
    texts that a document belongs to, by the group's smallest doc_id; so copies stay next to
    each other and a group is cut only where it meets the end of a shard. Ids order a group.
    Groups from several languages or sources come after all others.
    Null texts are one group, apart from empty ones; null languages, sources and ids are
    values like others. Equal rows get places of their own.
    Returns doc_id, size, text_crc32, shard, slot, hilbert.
    """
    return _placed(documents, False, n_shards).select(
        "doc_id", "size", "text_crc32", "shard", "slot", "hilbert"
    )


def write_shards(
    documents: DataFrame, path: str, n_shards: int = SHARDS, column: str = "shard"
) -> None:
    """Write the documents, all rows and columns, in the folders of their shards, in curve order
    in each. `column` names the folders and must not be a column of the documents.

    Rows are carried through the order, not looked up by id, so missing and repeated ids are
    written like others. A shard is spread over files by ranges of the slot, so that no task
    writes a whole shard alone.
    """
    if column.lower() in {c.lower() for c in documents.columns}:
        raise ValueError(f"the documents have a column {column!r}")
    placed = _placed(documents, True, n_shards)
    names = [f"row._{i}" for i in range(len(documents.columns))]
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] if "text" in documents.columns else 0
    ranges = max(
        int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")),
        -(-(size or 0) // RANGE_BYTES),
    )
    # Names may differ by case only, so each is given where nothing resolves it any more.
    ordered = placed.repartitionByRange(ranges, "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.select(*names, F.col("shard")).toDF(*documents.columns, column).write.partitionBy(column).parquet(path)

"""Shapes of the physical plans: what is pushed down, split, broadcast and avoided."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from permitlake.operators import changes, keyed, quality
from permitlake.operators.ids import assign_ids
from permitlake.operators.joins import left_join_hot_right
from permitlake.plans import businesses, compliance, inspections, payments, permits
from permitlake.registry import Registry
from permitlake.schemas import TABLES
from permitlake.session import tune
from permitlake.sources.sample_tables import SampleRegistry

FOLDER = "/root/testdata/sf0.001"
AS_OF = dt.date(2024, 6, 15)
ROWS = 30_000


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Joins as at a size where nothing can be broadcast, and a low bar for skew."""
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "500b",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "500b",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    for key, value in wanted.items():
        spark.conf.set(key, value)
    yield tune(spark)
    for key in wanted:
        spark.conf.unset(key)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.fixture
def hot(spark, tmp_path):
    """A registry in which business 1, permit 1 and inspector 1 hold half of all rows."""
    def key(n):
        return F.when(F.col("id") % 2 == 0, F.lit(1)).otherwise(F.col("id") % n)

    base = spark.range(ROWS, numPartitions=8)
    month = F.lit(dt.datetime(2024, 6, 1)).cast("timestamp_ntz")
    tables = {
        "businesses": spark.range(2000).select(
            F.col("id").alias("business_id"), F.lit(1).cast("long").alias("owner_id"),
            F.concat(F.lit("A"), "id").alias("kra_pin"), F.concat(F.lit("n"), "id").alias("name"),
            F.lit("Retail").alias("category"), F.lit("Small").alias("size"),
            F.lit("l").alias("location"), F.lit("w").alias("ward"), F.lit("active").alias("status"),
            month.alias("created_at"),
        ),
        "users": spark.range(50).select(F.col("id").alias("user_id"), F.lit("u").alias("name")),
        "permits": base.select(
            F.col("id").alias("permit_id"), key(1500).alias("business_id"),
            F.lit(2024).alias("permit_year"), F.lit(5).cast("decimal(18,2)").alias("fee_amount"),
            F.lit("issued").alias("status"), F.lit(AS_OF).alias("issue_date"),
            F.lit(AS_OF).alias("expiry_date"), F.md5(F.col("id").cast("string")).alias("pdf_url"),
        ),
        "payments": base.select(
            F.col("id").alias("payment_id"), key(1500).alias("permit_id"),
            F.lit(2).cast("decimal(18,2)").alias("amount"), F.lit("cash").alias("payment_method"),
            F.lit("success").alias("status"), month.alias("paid_at"),
        ),
        "compliance_scores": spark.range(3000).select(
            F.col("id").alias("score_id"), (F.col("id") % 1900 + 50).alias("business_id"),
            F.lit("0.5").cast("decimal(5,4)").alias("score"), F.lit("v").alias("model_version"),
            F.lit("c").alias("cluster_label"), F.lit(None).cast("string").alias("features_json"),
        ),
        "inspections": base.select(
            F.col("id").alias("inspection_id"), key(1500).alias("business_id"),
            key(50).alias("inspector_id"), F.md5(F.col("id").cast("string")).alias("notes"),
            F.lit("visited").alias("status"), month.alias("inspected_at"),
        ),
    }
    for name, rows in tables.items():
        rows.write.parquet(f"{tmp_path}/{name}")
    return Registry(spark, {n: spark.read.parquet(f"{tmp_path}/{n}") for n in tables})


def skewed_joins(frame) -> tuple[int, int]:
    """Rows, and joins that were split for skew, of the finished plan."""
    count = len(frame.collect())
    final = plan_of(frame).split("== Initial Plan ==")[0]
    return count, len(re.findall(r"Join\(skew=true\)", final))


def test_hot_key_joins_are_split(no_broadcast, hot):
    """Every join that meets a hot key is split, and loses no row."""
    reports = {
        "summary": (businesses.business_summary(hot, as_of=AS_OF), None),
        "search": (businesses.search_businesses(hot, as_of=AS_OF), None),
        "expiring": (permits.expiring_permits(hot, as_of=AS_OF), ROWS),
        "payments": (payments.payment_summary(hot), ROWS),
        "inspections": (inspections.inspection_summary(hot, now=dt.datetime(2024, 7, 1)), ROWS),
        "orphans": (
            quality.check_foreign_key(
                hot.table("permits"), "permits", "business_id",
                hot.table("businesses").filter("business_id <> 1"),
            ),
            ROWS // 2,
        ),
        "by owner": (businesses.businesses_by_owner(hot, hot.table("businesses").select("owner_id")), 2000),
        "by permit": (payments.payments_by_permit(hot, hot.table("payments").select("permit_id")), ROWS),
        "deleted": (
            keyed.delete_by_key(
                hot.table("payments"), hot.table("users").filter("user_id > 1").select(
                    F.col("user_id").alias("permit_id")), "permit_id"
            ),
            None,
        ),
    }
    for name, (report, rows) in reports.items():
        count, split = skewed_joins(report)
        assert split >= 1, name
        assert rows is None or abs(count - rows) <= 20, (name, count)


def test_hot_key_stays_split_below_a_second_join(no_broadcast, hot):
    count, split = skewed_joins(businesses.business_permit_summary(hot, as_of=AS_OF))
    plain = (
        hot.table("businesses")
        .join(hot.table("permits").select("business_id"), "business_id", "left")
        .join(hot.table("compliance_scores").select("business_id"), "business_id", "left")
    )
    assert split >= 1 and count == plain.count()


def test_updates_by_a_hot_column_are_split(no_broadcast, hot):
    wards = hot.table("businesses").select("business_id", F.lit("cancelled").alias("status"))
    after = keyed.update_by_key(hot.table("permits"), wards, "business_id")
    count, split = skewed_joins(after)
    assert count == ROWS and split >= 1


def test_padded_join_equals_a_left_join(spark, no_broadcast):
    left = spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("a"))
    right = spark.range(300).select((F.col("id") % 70).alias("k"), F.col("id").alias("b"))
    right = right.unionByName(spark.createDataFrame([(None, 5)], "k bigint, b bigint"))
    found = left_join_hot_right(left, right, "k")
    assert sorted(found.collect(), key=str) == sorted(left.join(right, "k", "left").collect(), key=str)
    wider = spark.range(150).select(F.col("id").alias("k"))
    again = left_join_hot_right(left, right, "k", left_keys=wider)
    assert sorted(again.collect(), key=str) == sorted(found.collect(), key=str)


def test_one_value_in_all_rows_does_not_fill_one_sort_task(no_broadcast, hot):
    """All payments have the same time; the tie-break lets the sort split them."""
    rows = payments.payment_summary(hot)
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    parts = rows.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    assert sum(parts) == sum(sizes) and max(parts) < 0.5 * sum(parts)


def test_hot_keys_combine_before_the_shuffle(no_broadcast, hot):
    for frame in (
        businesses.business_statistics(hot, as_of=AS_OF),
        payments.outstanding_by_permit(hot),
        payments.payment_statistics(hot),
    ):
        assert re.search(r"partial_(count|sum)", plan_of(frame))


@pytest.mark.parametrize("name", entry._queries())
def test_no_python_and_no_products(spark, name):
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    # A checkpoint is read as an existing RDD; rows made in Python would be one, too.
    for word in ("Python", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan, word


def test_year_reaches_the_reader(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = plan_of(SampleRegistry(spark, FOLDER).permits_of_year(1998))
    assert "GreaterThanOrEqual(o_orderdate,1998-01-01" in plan
    assert "LessThan(o_orderdate,1999-01-01" in plan


def test_statistics_read_few_columns(spark):
    reg = SampleRegistry(spark, FOLDER)
    plan = plan_of(payments.payment_statistics(reg, start=dt.date(1998, 1, 1)))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {
        "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate",
    }
    assert "GreaterThanOrEqual(l_shipdate" in plan


def test_stored_permits_are_pruned_by_year(spark, tmp_path, hot):
    from permitlake.sources import parquet

    rows = hot.table("permits").withColumn("permit_year", F.lit(2020) + F.col("permit_id") % 3)
    parquet.write_table(rows, f"{tmp_path}/store/permits", "permits")
    reg = parquet.open_registry(spark, f"{tmp_path}/store", ["permits"])
    assert re.search(r"PartitionFilters: \[.*permit_year#\d+ = 2021", plan_of(reg.permits_of_year(2021)))
    assert reg.permits_of_year(2021).count() == ROWS // 3


def test_payments_are_shuffled_once_for_their_summary(no_broadcast, hot):
    plan = plan_of(payments.payment_summary(hot, ordered=False))
    assert plan.count("Exchange hashpartitioning(permit_id") == 2
    assert plan.count("Exchange hashpartitioning") == 4
    grouped = plan_of(payments.outstanding_by_payment(hot))
    assert grouped.count("Exchange") == plan.count("Exchange")


def test_audit_pairs_by_one_full_join(no_broadcast, hot):
    old = hot.table("permits")
    plan = plan_of(
        changes.audit_changes(old, old.withColumn("status", F.lit("x")), "permits",
                              now=dt.datetime(2024, 7, 1))
    )
    assert plan.count("FullOuter") == 1 and plan.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("name", ["audit_permits", "audit_payments"])
def test_audit_of_an_update_is_its_join(no_broadcast, spark, name):
    """The table meets the changes once; each is read and shuffled once."""
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    assert len(re.findall(r"Join \[", plan)) == 1 and "Inner" in plan
    assert plan.count("FileScan") == 2 and plan.count("Exchange hashpartitioning") == 2


def test_upsert_of_a_hot_business_has_no_hot_join(no_broadcast, hot, spark):
    """The table is joined on its unique key; the hot one is only grouped."""
    scores = spark.range(ROWS).select(
        F.col("id").alias("score_id"), F.lit(1).cast("long").alias("business_id"),
        F.lit("0.5").cast("decimal(5,4)").alias("score"), F.lit("v").alias("model_version"),
        F.lit(None).cast("string").alias("features_json"), F.lit("c").alias("cluster_label"),
    )
    updates = scores.limit(1).drop("score_id").withColumn("model_version", F.lit("w"))
    after = compliance.upsert_scores(
        hot.replace(compliance_scores=scores), updates, now=dt.datetime(2024, 7, 1)
    )
    counts = {r.action: r["count"] for r in after.groupBy("action").count().collect()}
    assert counts == {"update": 1, "keep": ROWS - 1}


def test_tune_only_raises_the_shuffle_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        tune(spark, shuffle_bytes=2**30)
        assert spark.conf.get("spark.sql.shuffle.partitions") == before
        tune(spark, shuffle_bytes=100 * 2**40)
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(200 * 1024)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_tasks_that_count_keys_stay_small(spark, tmp_path, monkeypatch):
    """One task of `check_unique` gets no more of a large table than some two million keys:
    neither from the files, nor by the shuffle, nor where partitions are merged."""
    sizes = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    fewest = "spark.sql.files.minPartitionNum"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    keys = spark.range(0, 4_000_000, 1, 1).select(F.xxhash64("id").alias("permit_id"))
    keys.write.option("parquet.block.size", 2**20).parquet(f"{tmp_path}/permits")  # 32 MB
    monkeypatch.setattr(entry.parquet, "stored_bytes", lambda *_: 2**31)
    for name in sizes:
        spark.conf.unset(name)
    spark.conf.set(fewest, "1")
    try:
        found = entry.queries()["check_unique"](spark, FOLDER)
        dealt = re.findall(r"hashpartitioning\(column#\d+, value#\d+, (\d+)\)", plan_of(found))
        assert dealt and set(dealt) == {str(2**31 // 2**24)}
        assert [spark.conf.get(name) for name in sizes] == [f"{2**24}b", f"{2**23}b"]
        assert spark.read.parquet(f"{tmp_path}/permits").rdd.getNumPartitions() >= 2
        tune(spark, shuffle_bytes=2**44)  # sizes are only lowered; Spark's own hold beyond
        assert [spark.conf.get(name) for name in sizes] == [f"{2**24}b", f"{2**23}b"]
        for name in sizes:
            spark.conf.unset(name)
        own = [spark.conf.get(name) for name in sizes]
        tune(spark, shuffle_bytes=2**44)
        assert [spark.conf.get(name) for name in sizes] == own
    finally:
        for name in (*sizes, fewest):
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ids_keep_only_their_order_columns(spark):
    """What is stored to number rows has no column of the rows but those of the order."""
    rows = spark.range(100).select(
        "id", F.col("id").cast("string").alias("text"), (F.col("id") % 7).alias("k")
    )
    numbered = assign_ids(rows, "n", ["k", "id"], keep=["id", "text"])
    stored = [line for line in plan_of(numbered).splitlines() if "Scan ExistingRDD" in line]
    assert stored and all("text" not in line for line in stored)
    assert any("_order_0" in line and "_rows" not in line.split("[")[0] for line in stored)
    assert "Window" not in plan_of(numbered)  # no ties, no sorting of rows
    tied = assign_ids(rows, "n", ["k"], keep=["id", "text"])
    assert "Window" in plan_of(tied)


def test_all_key_columns_of_a_table_are_one_scan(spark, tmp_path):
    users = SampleRegistry(spark, FOLDER).table("users").withColumns(
        {c: F.col("name") for c in ("phone", "password_hash")}
    )
    users.write.parquet(f"{tmp_path}/users")
    found = quality.check_unique(spark.read.parquet(f"{tmp_path}/users"), "users")
    plan = plan_of(found)
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    assert plan.index("HashAggregate", plan.index("Exchange")) > 0  # counted before it, too


def test_stored_keys_are_filtered_by_the_batch(spark, tmp_path, no_broadcast):
    """A Bloom filter of the batch, and its bounds, reach the scan of the stored keys."""
    spec = TABLES["payments"].schema
    keys = spark.range(60_000).select(
        (F.col("id") * 3).alias("payment_id"), F.concat(F.lit("M"), "id").alias("mpesa_code")
    )
    rows = keys.select(*[
        (F.col(f.name) if f.name in keys.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in spec.fields
    ])
    rows.write.parquet(f"{tmp_path}/stored")
    rows.filter("payment_id % 9000 = 0").withColumn("mpesa_code", F.lit("new")).write.parquet(f"{tmp_path}/batch")
    stored, batch = (spark.read.parquet(f"{tmp_path}/{t}") for t in ("stored", "batch"))
    wanted = {
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1",
        "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "50KB",
    }
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        found = quality.check_clash(batch, "payments", stored)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 20
    finally:
        for name in wanted:
            spark.conf.unset(name)
    lines = plan.splitlines()
    scans = [n for n, line in enumerate(lines) if "FileScan" in line and "/stored" in line]
    assert len(scans) == 2  # of payment_id and mpesa_code
    assert ">= 0" in lines[scans[0]] and "<= 171000" in lines[scans[0]]
    assert "might_contain" in "".join(lines[: scans[0]])
    none = quality.check_clash(batch.limit(0), "payments", stored)
    assert none.count() == 0


def test_both_padded_joins_read_one_presence(no_broadcast, hot):
    """Six scans, two of each table; the keys of all three are grouped in one shuffle."""
    found = businesses.business_permit_summary(hot, as_of=AS_OF)
    found.collect()
    final = plan_of(found).split("+- == Initial Plan ==")[0]
    assert "ReusedExchange" in final and final.count("FileScan") == 6

"""The registry tables as views over the sample order tables (see FIXTURES.md)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from permitlake.functions.literals import choose, day, moment
from permitlake.plans.intake import BACKFILL_FEATURES
from permitlake.registry import Registry
from permitlake.schemas import MONEY, SCORE

# Columns of the sample files.
RAW_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
}



def _padded(key: Column, width: int) -> Column:
    """The key with leading zeros; a longer key stays whole."""
    text = key.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


class SampleRegistry(Registry):
    """Builds each view when it is first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, {})
        self.folder = folder
        self._builders = {
            "users": self._users,
            "businesses": self._businesses,
            "permits": self._permits,
            "payments": self._payments,
            "inspections": self._inspections,
            "compliance_scores": self._compliance_scores,
            "score_updates": self._score_updates,
            "businesses_old": self._businesses_old,
            "businesses_new": self._businesses_new,
            "businesses_dirty": self._businesses_dirty,
            "users_incoming": self._users_incoming,
        }

    def names(self) -> list[str]:
        """The registry's own tables, without the inputs of the write jobs."""
        return list(self._builders)[:6]

    def table(self, name: str) -> DataFrame:
        if name not in self._tables and name in self._builders:
            self._tables[name] = self._builders[name]()
        return super().table(name)

    def replace(self, **tables: DataFrame) -> Registry:
        own = {name: self.table(name) for name in self.names()}
        return Registry(self.spark, {**own, **tables})

    def permits_of_year(self, year: int) -> DataFrame:
        """The year as a range of order dates, which reaches the Parquet reader; a
        condition on the derived year would not."""
        start, end = dt.date(year, 1, 1), dt.date(year + 1, 1, 1)
        ordered = F.col("o_orderdate")
        in_year = (ordered >= moment(start)) & (ordered < moment(end))
        return self._permits(self.raw("orders").filter(in_year))

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(RAW_SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    def _users(self) -> DataFrame:
        key = F.col("s_suppkey")
        roles = {0: "admin", 1: "officer", 2: "inspector"}
        return self.raw("supplier").select(
            key.alias("user_id"),
            F.col("s_name").alias("name"),
            F.concat(
                F.lower(F.replace("s_name", F.lit("#"), F.lit("."))), F.lit("@permits.example")
            ).alias("email"),
            F.concat(F.lit("+2547"), _padded(key, 8)).alias("phone"),
            choose(key % 4, roles, "finance").alias("role"),
            (F.col("s_acctbal") >= 0).alias("is_active"),
        )

    def _businesses(self) -> DataFrame:
        key = F.col("c_custkey")
        categories = {
            "BUILDING": "Retail",
            "FURNITURE": "Services",
            "MACHINERY": "Manufacturing",
            "AUTOMOBILE": "Restaurant",
        }
        balance = F.col("c_acctbal")
        size = F.when(balance < 2000, "Small").when(balance < 6000, "Medium").otherwise("Large")
        places = self.raw("nation").join(
            self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        return self.raw("customer").join(
            places, F.col("c_nationkey") == F.col("n_nationkey")
        ).select(
            key.alias("business_id"),
            (key % 10).alias("owner_id"),
            F.concat(F.lit("A"), _padded(key, 9), F.lit("Z")).alias("kra_pin"),
            F.col("c_name").alias("name"),
            choose(F.col("c_mktsegment"), categories, "Technology").alias("category"),
            size.alias("size"),
            F.col("r_name").alias("location"),
            (key % 181 - 90).cast("double").alias("latitude"),
            (key % 361 - 180).cast("double").alias("longitude"),
            F.col("n_name").alias("ward"),
            F.when(balance >= 0, "active").otherwise("closed").alias("status"),
            F.date_add(day(dt.date(1995, 1, 1)), (key % 1000).cast("int")).alias("created_at"),
        )

    def _permits(self, orders: DataFrame | None = None) -> DataFrame:
        orders = self.raw("orders") if orders is None else orders
        issued = F.to_date("o_orderdate")
        states = {"O": "issued", "F": "expired"}
        return orders.select(
            F.col("o_orderkey").alias("permit_id"),
            F.col("o_custkey").alias("business_id"),
            F.year("o_orderdate").alias("permit_year"),
            F.col("o_totalprice").cast("decimal(18,2)").cast(MONEY).alias("fee_amount"),
            choose(F.col("o_orderstatus"), states, "cancelled").alias("status"),
            issued.alias("issue_date"),
            F.when(F.col("o_orderkey") % 50 != 0, F.date_add(issued, 180)).alias("expiry_date"),
            F.lit(0).cast(MONEY).alias("penalty_amount"),
        )

    def _payments(self) -> DataFrame:
        line = F.col("l_linenumber")
        outcomes = {"A": "success", "N": "pending"}
        # Prices have two decimals, so rounding to whole cents never meets a tie.
        cents = F.rint(F.col("l_extendedprice") * 100).cast("bigint")
        return self.raw("lineitem").select(
            F.concat_ws(
                "-", "l_orderkey", line, "l_partkey", "l_suppkey",
                F.col("l_quantity").cast("int"), cents,
            ).alias("payment_id"),
            F.col("l_orderkey").alias("permit_id"),
            F.col("l_extendedprice").cast("decimal(18,2)").cast(MONEY).alias("amount"),
            choose(line % 3, {0: "mpesa", 1: "cash"}, "bank").alias("payment_method"),
            choose(F.col("l_returnflag"), outcomes, "failed").alias("status"),
            F.col("l_shipdate").alias("paid_at"),
        )

    def _inspections(self) -> DataFrame:
        outcomes = {"error": "noncompliant", "view": "not_found"}
        return self.raw("events").select(
            F.col("event_id").alias("inspection_id"),
            F.col("user_id").alias("business_id"),
            (F.col("event_id") % 10).alias("inspector_id"),
            F.col("props").alias("notes"),
            choose(F.col("event_type"), outcomes, "visited").alias("status"),
            F.col("ts").alias("inspected_at"),
        )

    def _compliance_scores(self) -> DataFrame:
        key = F.col("c_custkey")
        points = (key * 7919) % 1001
        cluster = F.when(points <= 300, "high_risk").when(points < 700, "medium_risk")
        return self.raw("customer").filter(key % 3 != 0).select(
            key.alias("score_id"),
            key.alias("business_id"),
            # Beyond four digits: a score just above a bound must not fall on it.
            (points.cast("decimal(4,0)") / 1000 + (key % 7).cast("decimal(1,0)") / 100000)
            .cast(SCORE).alias("score"),
            F.lit("v1.0").alias("model_version"),
            F.lit(BACKFILL_FEATURES).alias("features_json"),
            cluster.otherwise("low_risk").alias("cluster_label"),
        )

    def _score_updates(self) -> DataFrame:
        return self.table("businesses").filter(F.col("business_id") % 2 == 0).select(
            "business_id",
            F.lit("0.50004").cast(SCORE).alias("score"),
            F.lit("v2.0").alias("model_version"),
            F.lit(None).cast("string").alias("features_json"),
            F.lit("medium_risk").alias("cluster_label"),
        )

    def _businesses_old(self) -> DataFrame:
        return self.table("businesses").filter(F.col("business_id") % 10 != 0)

    def _businesses_new(self) -> DataFrame:
        key = F.col("business_id")
        grown = F.when(key % 10 == 2, "Large").otherwise(F.col("size"))
        return self.table("businesses").filter(key % 10 != 1).withColumn("size", grown)

    def _businesses_dirty(self) -> DataFrame:
        key = F.col("business_id")
        return self.table("businesses").select(
            key,
            F.when(key % 13 == 0, -1).otherwise(F.col("owner_id")).alias("owner_id"),
            F.when(key % 19 != 0, F.col("kra_pin")).alias("kra_pin"),
            F.when(key % 17 == 0, "Huge").when(key % 23 != 0, F.col("size")).alias("size"),
            F.when(key % 11 != 0, F.col("latitude") + 60).alias("latitude"),
            "longitude",
            F.when(key % 29 != 0, F.col("name")).alias("name"),
            "category", "location", "ward", "status", "created_at",
        )

    def _users_incoming(self) -> DataFrame:
        users = self.table("users")
        key = F.col("user_id")
        # Negative ids: none of a user's own, and each one its own.
        again = users.filter(key % 2 == 0).withColumn("user_id", -key * 2 - 2)
        fresh = users.withColumn("user_id", -key * 2 - 1).withColumn(
            "email", F.concat(F.lit("new."), "email")
        )
        return again.unionByName(fresh)

"""Trigram postings of business names and PINs, for searches that need not read all of them.

A text that holds a term holds all its trigrams. The postings list, for each trigram, the
businesses whose name or PIN has it; those in all lists of a term are candidates, which the
search then verifies with its pattern. Lists are sorted by trigram, so that a search reads the
files and row groups of its own ones only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("name", "kra_pin")
GRAM = 3
SCHEMA = "gram string, field string, business_id bigint"


def _grams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case; none for a shorter one or null."""
    lowered = F.lower(text)
    starts = F.sequence(F.lit(1), F.length(lowered) - GRAM + 1)
    each = F.transform(starts, lambda i: F.substr(lowered, i, F.lit(GRAM)))
    return F.when(F.length(lowered) >= GRAM, F.array_distinct(each))


def build_postings(businesses: DataFrame) -> DataFrame:
    """One row per trigram, field and business: the content of the index."""
    lists = [
        businesses.select(
            F.explode(_grams(F.col(field))).alias("gram"), F.lit(field).alias("field"),
            F.col("business_id").cast("bigint").alias("business_id"),
        )
        for field in FIELDS
    ]
    return lists[0].unionByName(lists[1])


def write_postings(businesses: DataFrame, path: str, partitions: int | None = None) -> None:
    """Store the postings in ranges of trigrams. The range also ends in the business, so that
    the list of a trigram that most businesses have is cut into several files."""
    order = ["gram", "business_id", "field"]
    wanted = partitions or int(businesses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    build_postings(businesses).repartitionByRange(wanted, *order).sortWithinPartitions(*order).write.parquet(path)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def term_grams(spark: SparkSession, term: str, raw: bool = False) -> list[str]:
    """The trigrams that a text with the term must have; of a raw pattern, those of the parts
    between its wildcards. Lower case is Spark's, as in the pattern that verifies."""
    parts = re.split(r"\\.|[%_]", term) if raw else [term]
    rows = spark.createDataFrame([(p,) for p in parts], "part string").select(_grams(F.col("part")))
    return sorted({gram for row in rows.collect() for gram in row[0] or ()})


def holders_of(postings: DataFrame, grams: list[str]) -> DataFrame:
    """Ids of the businesses with a field that has all the trigrams."""
    listed = postings.filter(F.col("gram").isin(grams))
    full = listed.groupBy("business_id", "field").agg(F.count(F.lit(1)).alias("_grams"))
    return full.filter(F.col("_grams") == len(grams)).select("business_id")

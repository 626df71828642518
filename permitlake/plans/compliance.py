"""Compliance scores: lists and the batch upsert."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from permitlake.functions.literals import moment
from permitlake.operators.ids import assign_ids, highest_id
from permitlake.operators.keyed import exact, one_per_key
from permitlake.operators.ordering import down, in_order, up
from permitlake.registry import Registry
from permitlake.session import shared_dir

HIGH_RISK = Decimal("0.3")


def compliance_scores(
    registry: Registry,
    *,
    min_score: Decimal | None = None,
    max_score: Decimal | None = None,
    cluster_label: str | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Scores with their business, highest first; each filter is optional, bounds count."""
    scores = registry.table("compliance_scores")
    kept = scores
    if min_score is not None:
        kept = kept.filter(F.col("score") >= F.lit(min_score))
    if max_score is not None:
        kept = kept.filter(F.col("score") <= F.lit(max_score))
    if cluster_label is not None:
        kept = kept.filter(F.col("cluster_label") == cluster_label)
    holders = registry.table("businesses").select(
        "business_id", F.col("name").alias("business_name"), "kra_pin", "category", "size"
    )
    rows = kept.join(holders, "business_id").select(
        *scores.columns, "business_name", "kra_pin", "category", "size"
    )
    return in_order(rows, ordered, down("score"), up("score_id"))


def high_risk_businesses(
    registry: Registry, *, threshold: Decimal = HIGH_RISK, ordered: bool = True
) -> DataFrame:
    """Scores up to the threshold with their business, lowest first."""
    scores = registry.table("compliance_scores")
    holders = registry.table("businesses").select(
        "business_id", F.col("name").alias("business_name"), "kra_pin", "location", "ward"
    )
    rows = scores.filter(F.col("score") <= F.lit(threshold)).join(holders, "business_id")
    rows = rows.select(*scores.columns, "business_name", "kra_pin", "location", "ward")
    return in_order(rows, ordered, up("score"), up("score_id"))


def upsert_scores(
    registry: Registry,
    updates: DataFrame,
    *,
    now: dt.datetime,
    newest_by: list[str] | None = None,
) -> DataFrame:
    """The score table after one update per business, with an `action` column: the first
    score of the business is updated ('update'), or a new one added ('insert'); all other
    rows stay ('keep').

    `updates` holds business_id, score, model_version, features_json and cluster_label;
    the features may be JSON text, or a struct or map to be written as JSON.
    First scores are found by a grouping that combines before the shuffle, and the update
    joins on the unique score id, so a business with very many scores makes no hot task.
    """
    scores = registry.table("compliance_scores")
    values = ["score", "model_version", "features_json", "cluster_label"]
    if not isinstance(updates.schema["features_json"].dataType, StringType):
        updates = updates.withColumn("features_json", F.to_json("features_json"))
    wanted = updates.select(
        "business_id", *values, *(c for c in newest_by or () if c not in values)
    )
    given = one_per_key(wanted, "business_id", newest_by).select("business_id", *values)
    first = scores.groupBy("business_id").agg(F.min("score_id").alias("_first"))
    # Computed once, and read for the update as well as for the insert.
    shared_dir(registry.spark)
    placed = given.join(first, "business_id", "left").checkpoint(eager=True)

    change = placed.filter(F.col("_first").isNotNull()).select(
        F.col("_first").alias("score_id"),
        F.lit(True).alias("_hit"),
        *(F.col(c).alias(f"_new_{c}") for c in values),
    )
    hit = F.col("_hit").isNotNull()

    def after(column):
        if column in values:
            given = updates.schema[column].dataType
            new = exact(F.col(f"_new_{column}"), given, scores.schema[column].dataType, column)
        elif column == "scored_at":
            new = moment(now)
        else:
            return F.col(column)
        return F.when(hit, new).otherwise(F.col(column)).alias(column)

    kept = scores.join(change, "score_id", "left").select(
        *(after(c) for c in scores.columns),
        F.when(hit, "update").otherwise("keep").alias("action"),
    )
    # An update without a business matches no score, so each one is a new row.
    nameless = wanted.filter(F.col("business_id").isNull()).select("business_id", *values)
    fresh = placed.filter(F.col("_first").isNull()).select("business_id", *values)
    typed = [
        exact(F.col(c), updates.schema[c].dataType, scores.schema[c].dataType, c).alias(c)
        for c in ("business_id", *values)
    ]
    added = assign_ids(
        fresh.unionByName(nameless).select(*typed),
        "score_id",
        ["business_id", *values],
        start_after=highest_id(scores, "score_id"),
    )
    if "scored_at" in scores.columns:
        added = added.withColumn("scored_at", moment(now))
    return kept.unionByName(added.withColumn("action", F.lit("insert")))

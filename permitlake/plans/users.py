"""User lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame

from permitlake.operators.joins import matching
from permitlake.registry import Registry


def users_by_email(registry: Registry, email) -> DataFrame:
    return matching(registry.table("users"), "email", email)


def users_by_id(registry: Registry, user_id) -> DataFrame:
    return matching(registry.table("users"), "user_id", user_id)

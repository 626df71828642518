"""Permit-registry analytics as Spark DataFrame functions."""

from permitlake.registry import Registry

__all__ = ["Registry"]

"""Code-review analytics as Spark DataFrame jobs."""

from patchloom.session import get_spark

__all__ = ["get_spark"]

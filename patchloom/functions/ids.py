"""Stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def comment_id(path: Column, start: Column, end: Column, category: Column) -> Column:
    key = F.concat_ws(":", path, start.cast("string"), end.cast("string"), category)
    return F.substring(F.sha2(key, 256), 1, 12)


def reference_id(repo_id: Column, path: Column, kind: Column, locator: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\n", repo_id, path, kind, locator), 256), 1, 20)


def marker(identifier: Column, bot: str) -> Column:
    return F.concat(F.lit(f"<!-- {bot}:id="), identifier, F.lit(" -->"))


def marker_pattern(bot: str) -> str:
    return rf"<!-- {bot}:id=(\w+) -->"


def summary_marker(bot: str) -> str:
    return f"<!-- {bot}:summary -->"

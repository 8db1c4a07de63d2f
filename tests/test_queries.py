"""Every registered query against its oracle at the smallest scale (slow; set
PATCHLOOM_ALL_QUERIES=1), and a few of them always."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, duck

SF = "/root/testdata/sf0.001"
ALWAYS = ("diff_files", "diff_changes", "severity_counts", "review_comments", "file_context",
          "prompt_chunks", "index_items", "lifecycle_stats")
NAMES = list(queries()) if os.environ.get("PATCHLOOM_ALL_QUERIES") else ALWAYS


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    ok, message, _ = compare(name, spark, duck(SF), SF, queries(), oracle_sql())
    assert ok, message


def test_entry_and_registry(spark):
    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())

"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def findings_json(findings: DataFrame) -> DataFrame:
    """One JSON object per finding."""
    return findings.select("change_id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
                           .alias("json"))


def write_findings(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").option("ignoreNullFields", "false").json(path)

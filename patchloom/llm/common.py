"""What several operators share: table reading, cuts of lineage, safe column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.session import cut_lineage

# White space as all text contracts here define it: space and 9 to 13.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared checkpoint folder, so that a lost
    executor costs a read, not the work before it."""
    return cut_lineage(df)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def words_of(text: Column) -> Column:
    """Words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), rf"[{SPACE}]+"), "")


def word_count(text: Column) -> Column:
    """Number of words, without an array of them; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")

"""The keyed store of guidance with vectors: a merge-on-read table in Parquet.

``rows/attempt=<a>/bucket=<b>`` holds what one attempt to write stored, repositories spread over a
fixed number of buckets by a hash. ``log/version=<v>`` names each repository that a version replaced
and the attempt that holds its rows; writing it is the commit. A reader takes each repository's latest
log row and opens only the buckets of attempts that these rows name, so what a failed attempt left
is never seen. Compaction rewrites buckets that many attempts share and sums the log up; vacuuming
removes what no recent version names. Each step leaves a sound table if the next one never comes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom import constants as C
from patchloom.operators.guidance import check_vectors

ROWS = ("repo_id string, source_id string, kind string, path string, revision string, "
        "locator string, excerpt string, scopes array<string>, embedder string, "
        "embedding array<float>")
LOG = "repo_id string, bucket int, attempt string"
BUCKETS = 64           # of a new table; at least a few per executor core
ATTEMPTS_PER_BUCKET = 8
KEPT_VERSIONS = 2


class GuidanceStore:
    """``buckets`` is the table's for good: the same value must be given each time."""

    def __init__(self, spark: SparkSession, folder: str, dimensions: int = C.DIMENSIONS,
                 buckets: int = BUCKETS):
        self.spark, self.folder, self.dimensions = spark, folder.rstrip("/"), dimensions
        self.buckets = buckets

    # --- folders ---

    def _folder(self, path: str):
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(context._jsc.hadoopConfiguration()), at

    def _names(self, path: str) -> list[str]:
        """Names of the folders in a folder, without what stands before their '='."""
        files, at = self._folder(path)
        if not files.exists(at):
            return []
        return sorted(s.getPath().getName().split("=", 1)[1] for s in files.listStatus(at)
                      if s.isDirectory() and "=" in s.getPath().getName())

    def _remove(self, path: str) -> None:
        files, at = self._folder(path)
        files.delete(at, True)

    def versions(self) -> list[int]:
        """Versions whose log is complete, in order."""
        done = []
        for name in self._names(f"{self.folder}/log"):
            files, at = self._folder(f"{self.folder}/log/version={name}/_SUCCESS")
            done += [int(name)] if files.exists(at) else []
        return sorted(done)

    # --- writing ---

    def _bucket(self):
        return F.pmod(F.xxhash64("repo_id"), F.lit(self.buckets)).cast("int")

    def write_rows(self, rows: DataFrame, attempt: str) -> None:
        """Store rows as an attempt that no version names yet. Keys must be unique and vectors sound."""
        columns = [c.split()[0] for c in ROWS.split(", ")]
        checked = check_vectors(rows, self.dimensions).withColumn(
            "embedding", F.when(F.col("valid"), F.col("embedding")).otherwise(
                F.raise_error(F.concat(F.lit("bad vector: "), F.col("source_id")))))
        target = f"{self.folder}/rows/attempt={attempt}"
        checked.select(*columns, self._bucket().alias("bucket")).repartition(
            "bucket").sortWithinPartitions("bucket", "repo_id", "source_id").write.mode(
            "overwrite").partitionBy("bucket").parquet(target)
        doubled = self.spark.read.schema(ROWS).parquet(target).groupBy(
            "repo_id", "source_id").count().filter("count > 1").take(1)
        if doubled:
            raise ValueError(f"duplicate key in attempt {attempt}: {doubled[0]}")

    def _commit(self, named: DataFrame, version: int) -> None:
        named.select("repo_id", "bucket", "attempt").coalesce(1).write.mode("overwrite").parquet(
            f"{self.folder}/log/version={version}")

    def write(self, rows: DataFrame, snapshots: DataFrame, version: int) -> None:
        """Store one version: the rows of the repositories in ``snapshots``, also of empty ones. A
        broken row fails the write before the commit; a version may be written again."""
        attempt = f"{version}-{uuid.uuid4().hex[:12]}"
        self.write_rows(rows, attempt)
        self._commit(snapshots.select("repo_id").distinct().select(
            "repo_id", self._bucket().alias("bucket"), F.lit(attempt).alias("attempt")), version)

    # --- reading ---

    def live(self, upto: int | None = None) -> DataFrame:
        """repo_id, bucket, attempt, version: where each repository's rows are."""
        seen = [v for v in self.versions() if upto is None or v <= upto]
        if not seen:
            return self.spark.createDataFrame([], LOG + ", version bigint")
        log = self.spark.read.schema(LOG + ", version bigint").option(
            "basePath", f"{self.folder}/log").parquet(
            *[f"{self.folder}/log/version={v}" for v in seen])
        return log.groupBy("repo_id").agg(F.max_by(
            F.struct("bucket", "attempt", "version"), "version").alias("at")).select("repo_id", "at.*")

    def read(self, repos: DataFrame | None = None) -> DataFrame:
        """Rows of every repository's latest version, or of those in ``repos`` (repo_id). Only the
        buckets and attempts that these repositories' log rows name are opened; after compaction
        these are at most ATTEMPTS_PER_BUCKET for each bucket."""
        live = self.live()
        if repos is not None:
            live = live.join(repos.select("repo_id").distinct(), "repo_id", "left_semi")
        return self._rows(live).select([c.split()[0] for c in ROWS.split(", ")])

    def _rows(self, live: DataFrame) -> DataFrame:
        base = f"{self.folder}/rows"
        there = {a: set(self._names(f"{base}/attempt={a}")) for a in self._names(base)}
        places = [f"{base}/attempt={r.attempt}/bucket={r.bucket}" for r in live.select(
            "attempt", "bucket").distinct().collect() if str(r.bucket) in there.get(r.attempt, ())]
        if not places:
            return self.spark.createDataFrame([], ROWS + ", bucket int, attempt string")
        rows = self.spark.read.schema(ROWS + ", attempt string, bucket int").option(
            "basePath", base).parquet(*sorted(places))
        return rows.join(live.select("repo_id", "attempt"), ["repo_id", "attempt"])

    # --- upkeep ---

    def compact(self, version: int, attempts: int = ATTEMPTS_PER_BUCKET) -> None:
        """Rewrite the live rows of every bucket that more than ``attempts`` attempts share as one,
        and write the whole log as this version, which must be new and the latest."""
        if version <= max(self.versions(), default=-1):
            raise ValueError(f"version {version} is not new")
        live = self.live()
        crowded = live.groupBy("bucket").agg(F.count_distinct("attempt").alias("n")).filter(
            F.col("n") > attempts).select("bucket")
        moving = live.join(crowded, "bucket", "left_semi")
        attempt = f"{version}-{uuid.uuid4().hex[:12]}"
        self.write_rows(self._rows(moving), attempt)
        self._commit(live.join(crowded.withColumn("moved", F.lit(True)), "bucket", "left").select(
            "repo_id", "bucket", F.when(F.col("moved"), attempt).otherwise(F.col("attempt"))
            .alias("attempt")), version)
        files, at = self._folder(f"{self.folder}/whole/version={version}")
        files.mkdirs(at)  # from here on, older logs are not needed

    def vacuum(self, keep: int = KEPT_VERSIONS) -> list[str]:
        """Remove attempts that none of the last ``keep`` versions names, among them those of failed
        writes up to the latest version, and logs that a whole log before those versions replaces. Returns the attempts removed."""
        versions = self.versions()
        if not versions:
            return []
        kept = versions[-keep:]
        named = set()
        for v in kept:
            named |= {r.attempt for r in self.live(v).select("attempt").distinct().collect()}
        gone = [a for a in self._names(f"{self.folder}/rows")
                if a not in named and int(a.split("-")[0]) <= versions[-1]]
        for a in gone:
            self._remove(f"{self.folder}/rows/attempt={a}")
        whole = [int(v) for v in self._names(f"{self.folder}/whole")]
        first = max((v for v in whole if v in versions and v <= kept[0]), default=None)
        for v in versions:
            if first is not None and v < first:
                self._remove(f"{self.folder}/log/version={v}")
        return gone

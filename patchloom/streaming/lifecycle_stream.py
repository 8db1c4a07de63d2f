"""The comment lifecycle over a stream of review runs.

Input rows are flat: (change_id, revision, comment_id), one per comment of a run and
one with a null id for the run itself, so that a run that found nothing exists too.
State is a table of what was ever posted per (change, comment id): the run that
posted it, the run that marked it resolved, and per change the last run applied. A
returning issue is not posted again and keeps its badge.

State rows lie in a fixed number of buckets of changes. A micro-batch stages its runs, reads the
buckets of its own changes, sorts runs into fresh and late ones, and appends one delta to each bucket
with fresh runs; a bucket with many deltas gets one merged from them in the delta's place, or a merged
base once they have grown to half of it, so a row is rewritten few times. Then it writes
the manifest, one row per bucket with its base and deltas, which is the commit; what no recent manifest
names is removed. So a batch costs what its buckets hold, however many batches came before. Values
merge by min or max and folders are named by the batch id, so repeating a batch overwrites it and
changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from patchloom.functions.ranking import bucketed_lead

IDS_SCHEMA = "change_id bigint, comment_id string, posted_revision bigint, resolved_revision bigint"
LAST_SCHEMA = "change_id bigint, last_revision bigint"
RUN_SCHEMA = "change_id bigint, revision bigint, comment_id string"


STATE_SCHEMA = IDS_SCHEMA + ", last_revision bigint"  # comment_id is null in a change's own row
MANIFEST_SCHEMA = "bucket int, base bigint, deltas array<bigint>"
BUCKETS = 64
COMPACT_EVERY = 20
LIGHT_DELTAS = 2    # deltas are merged among themselves until twice their size reaches the base's
KEPT_MANIFESTS = 2  # a batch may be repeated, which reads the one before


def stage_runs(runs: DataFrame, last: DataFrame) -> DataFrame:
    """Rows of runs with ``late`` set where their run is not newer than the last one
    applied to its change. Rows given twice count once."""
    return runs.distinct().join(last, "change_id", "left").select(
        "change_id", "revision", "comment_id",
        F.coalesce(F.col("revision") <= F.col("last_revision"), F.lit(False)).alias("late"))


def apply_fresh(ids: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of IDS_SCHEMA that the rows of fresh runs add or alter.

    Each run knows the next run of its change. An id is absent for the first time
    in the run after the first one that holds it while the next does not; that is
    seen from the rows of one (change, id) alone, so no pair of runs is formed and
    a change with very many comments is spread over its ids."""
    runs = fresh.select("change_id", "revision").distinct()
    linked = bucketed_lead(runs, ["change_id"], "revision", "next_revision", width=1000)
    starts = runs.groupBy("change_id").agg(F.min("revision").alias("first_revision"))
    present = fresh.filter(F.col("comment_id").isNotNull()).distinct().join(
        linked, ["change_id", "revision"])
    by_id = Window.partitionBy("change_id", "comment_id").orderBy("revision")
    ends = ~F.coalesce(F.lead("revision").over(by_id) == F.col("next_revision"), F.lit(False))
    seen = present.withColumn("ends", ends).groupBy("change_id", "comment_id").agg(
        F.min("revision").alias("seen_first"),
        F.min_by("next_revision", F.when(F.col("ends"), F.col("revision"))).alias("absent_at"))
    known = ids.join(starts, "change_id")
    merged = known.join(seen, ["change_id", "comment_id"], "full")
    is_new = F.col("posted_revision").isNull()
    goes_on = F.coalesce(F.col("seen_first") == F.col("first_revision"), F.lit(False))
    resolved = F.when(is_new | goes_on, F.col("absent_at")).otherwise(F.col("first_revision"))
    return merged.filter(F.col("resolved_revision").isNull()).select(
        "change_id", "comment_id", is_new.alias("is_new"),
        F.coalesce("posted_revision", "seen_first").alias("posted_revision"),
        resolved.alias("resolved_revision")
    ).filter(F.col("is_new") | F.col("resolved_revision").isNotNull()).drop("is_new")


def merge_ids(ids: DataFrame) -> DataFrame:
    return ids.groupBy("change_id", "comment_id").agg(
        F.min("posted_revision").alias("posted_revision"),
        F.min("resolved_revision").alias("resolved_revision"))


def history(runs: DataFrame) -> DataFrame:
    """Batch twin: all runs at once, in order."""
    spark = runs.sparkSession
    staged = stage_runs(runs, spark.createDataFrame([], LAST_SCHEMA))
    return apply_fresh(spark.createDataFrame([], IDS_SCHEMA), staged.drop("late"))


class StateTable:
    """The state's folders: ``input``, ``staged``, ``state`` and ``late`` rows by batch, and the manifests.
    ``buckets`` is the table's for good: the same value must be given each time."""

    def __init__(self, spark: SparkSession, folder: str, compact_every: int = COMPACT_EVERY,
                 buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.compact_every = compact_every

    # --- folders ---

    def _files(self, path: str):
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(context._jsc.hadoopConfiguration()), at

    def _batches(self, kind: str) -> list[int]:
        """Batches of a kind that were written to the end."""
        files, at = self._files(f"{self.folder}/{kind}")
        if not files.exists(at):
            return []
        names = [s.getPath() for s in files.listStatus(at) if s.getPath().getName().startswith("batch=")]
        done = [n for n in names if files.exists(self._files(f"{n.toString()}/_SUCCESS")[1])]
        return sorted(int(n.getName().split("=")[1]) for n in done)

    def _remove(self, kind: str, batch: int) -> None:
        files, at = self._files(f"{self.folder}/{kind}/batch={batch}")
        files.delete(at, True)

    def _write(self, df: DataFrame, kind: str, batch: int, *by: str) -> DataFrame:
        target = f"{self.folder}/{kind}/batch={batch}"
        df.write.mode("overwrite").partitionBy(*by).parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    # --- reading ---

    def manifest(self, before: int = 2 ** 62) -> dict[int, tuple[int | None, list[int]]]:
        """Base and deltas of each bucket as of the batches before one: a row per bucket at most."""
        seen = [b for b in self._batches("manifest") if b < before]
        if not seen:
            return {}
        rows = self.spark.read.schema(MANIFEST_SCHEMA).parquet(
            f"{self.folder}/manifest/batch={seen[-1]}").collect()
        return {r["bucket"]: (r["base"], list(r["deltas"])) for r in rows}

    def _state(self, manifest: dict, wanted=None) -> DataFrame:
        """State rows of some buckets, or of all; only their files are opened."""
        paths = [f"{self.folder}/state/batch={batch}/bucket={b}" for b, (base, deltas) in manifest.items()
                 if wanted is None or b in wanted for batch in ([] if base is None else [base]) + deltas]
        if not paths:
            return self.spark.createDataFrame([], STATE_SCHEMA)
        return self.spark.read.schema(STATE_SCHEMA).parquet(*paths)

    @staticmethod
    def _ids(state: DataFrame) -> DataFrame:
        return merge_ids(state.filter(F.col("comment_id").isNotNull()))

    @staticmethod
    def _last(state: DataFrame) -> DataFrame:
        return state.filter(F.col("comment_id").isNull()).groupBy("change_id").agg(
            F.max("last_revision").alias("last_revision"))

    def ids(self, before: int = 2 ** 62) -> DataFrame:
        """Posted and resolved runs per (change, id) as of the batches before one."""
        return self._ids(self._state(self.manifest(before)))

    def last(self, before: int = 2 ** 62) -> DataFrame:
        """Last run applied per change."""
        return self._last(self._state(self.manifest(before)))

    def late(self) -> DataFrame:
        """Runs that came too late to be applied."""
        paths = [f"{self.folder}/late/batch={b}" for b in self._batches("late")]
        if not paths:
            return self.spark.createDataFrame([], RUN_SCHEMA)
        return self.spark.read.schema(RUN_SCHEMA).parquet(*paths)

    def _is_light(self, bucket: int, base: int | None, deltas: list[int]) -> bool:
        """Whether a bucket's deltas are far smaller than its base, which then need not be rewritten."""
        def size(batch):
            files, at = self._files(f"{self.folder}/state/batch={batch}/bucket={bucket}")
            return files.getContentSummary(at).getLength()
        return base is not None and LIGHT_DELTAS * sum(map(size, deltas)) < size(base)

    # --- a micro-batch ---

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("change_id"), F.lit(self.buckets)).cast("int").alias("bucket")

    def apply(self, runs: DataFrame, batch_id: int) -> None:
        """One micro-batch."""
        # As it comes: a stream's own plans are not adaptive, so nothing is shuffled before this.
        runs = self._write(runs.select("change_id", "revision", "comment_id"), "input", batch_id)
        buckets_of = lambda df: {r["bucket"] for r in df.select(self._bucket()).distinct().collect()}
        known = self.manifest(batch_id)
        mine = self._state(known, buckets_of(runs))
        # Written, as the rows of fresh runs are read many times below.
        staged = self._write(stage_runs(runs, self._last(mine)), "staged", batch_id)
        self._write(staged.filter("late").drop("late"), "late", batch_id)
        fresh = staged.filter(~F.col("late")).drop("late")
        touched = buckets_of(fresh)
        # Of the buckets' rows only those of the batch's own changes go on.
        ids = self._ids(mine.join(fresh.select("change_id").distinct(), "change_id", "left_semi"))
        none = F.lit(None)
        delta = apply_fresh(ids, fresh).withColumn("last_revision", none.cast("bigint")).unionByName(
            fresh.groupBy("change_id").agg(F.max("revision").alias("last_revision")).select(
                "change_id", none.cast("string").alias("comment_id"),
                none.cast("bigint").alias("posted_revision"),
                none.cast("bigint").alias("resolved_revision"), "last_revision"))
        full = {b for b in touched if len(known.get(b, (None, []))[1]) >= self.compact_every}
        light = {b for b in full if self._is_light(b, *known[b])}
        if full:
            old = self._state({b: (None if b in light else known[b][0], known[b][1]) for b in full})
            in_full = self._bucket().isin(*full)
            merged = delta.filter(in_full).unionByName(old).groupBy("change_id", "comment_id").agg(
                F.min("posted_revision").alias("posted_revision"),
                F.min("resolved_revision").alias("resolved_revision"),
                F.max("last_revision").alias("last_revision"))
            delta = delta.filter(~in_full).unionByName(merged)
        self._write(delta.select("*", self._bucket()).repartition("bucket"), "state", batch_id, "bucket")
        now = dict(known)
        for b in touched:
            base, deltas = known.get(b, (None, []))
            now[b] = ((base, [batch_id]) if b in light else (batch_id, []) if b in full
                      else (base, deltas + [batch_id]))
        self._write(self.spark.createDataFrame(
            [(b, base, deltas) for b, (base, deltas) in sorted(now.items())], MANIFEST_SCHEMA).coalesce(1),
            "manifest", batch_id)
        self._clean(batch_id)

    def _clean(self, batch_id: int) -> None:
        """Remove folders that neither of the last manifests names."""
        manifests = [b for b in self._batches("manifest") if b <= batch_id]
        kept = manifests[-KEPT_MANIFESTS:]
        for b in manifests:
            if b not in kept:
                self._remove("manifest", b)
        for kind in ("input", "staged"):
            for b in self._batches(kind):
                if b < batch_id:
                    self._remove(kind, b)
        named = {k for m in kept for base, deltas in self.manifest(m + 1).values()
                 for k in (base, *deltas)}
        for b in self._batches("state"):
            if b <= batch_id and b not in named:
                self._remove("state", b)


def start(runs: DataFrame, table: StateTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the stream over streaming ``runs``; ``trigger`` as in writeStream."""
    return (runs.writeStream.foreachBatch(lambda df, batch_id: table.apply(df, batch_id))
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())

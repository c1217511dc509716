"""Incremental warning refresh: only the touched keys and days are rebuilt, and only their partitions are read.

Five tables live under one root: ``source`` (bucket, batch), ``queue`` (batch), ``core`` (bucket), ``core_day`` (month) and ``pub`` (month).
Buckets hash the natural key; months hold the local validity days. What exists is found in storage, never remembered, so any process can go on.

The keys of a batch and the days they had and will have are queued durably before ``core`` changes. A replayed batch finds its queue and
so still knows the days of versions that ``core`` has lost meanwhile. Every touched partition is rewritten, also one that has no rows left:
it then holds a single row of nulls, which ``table`` leaves out.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pavesa.operators import canonical
from pavesa.operators.merge import overwrite_partitions
from pavesa.session import discard, scratch_path

KEY = ["cap_identifier", "language", "area_code"]


def _month(rows: DataFrame) -> DataFrame:
    return rows.withColumn("month", (F.year("valid_date") * 100 + F.month("valid_date")).cast("int"))


class WarningRefresh:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root, buckets
        self.batches = 0
        self._staged: list[str] = []

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def table(self, name: str) -> DataFrame | None:
        """A stored table, or None before its first write."""
        try:
            return self.spark.read.parquet(self.path(name)).filter(F.col(KEY[0]).isNotNull())
        except AnalysisException as missing:
            if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def _stage(self, rows: DataFrame, label: str) -> DataFrame:
        path = scratch_path(self.spark, label)
        rows.write.parquet(path)
        self._staged.append(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _write(self, name: str, rows: DataFrame, partition: str, touched: list[int]) -> None:
        """Rows may be read from the table itself: its partitions are replaced when all tasks have written."""
        marks = self.spark.createDataFrame([(x,) for x in touched], f"{partition} int")
        overwrite_partitions(rows.unionByName(marks, allowMissingColumns=True), self.path(name), partition, derived=False)

    def _bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int"))

    def store(self, batch: DataFrame, batch_id: int) -> None:
        """Records that carry their archive's elaboration end, into ``source`` alone."""
        rows = self._bucket(batch).withColumn("batch", F.lit(batch_id).cast("int"))
        overwrite_partitions(rows, self.path("source"), "bucket", "batch", derived=False)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch. If ``core`` has nothing yet, all keys of ``source`` are due (bootstrap)."""
        self.store(batch, batch_id)
        self.refresh(None if self.table("core") is None else batch.select(*KEY), batch_id)
        self.batches += 1

    def refresh(self, keys: DataFrame | None, batch_id: int) -> None:
        """Rebuild core, core_day and pub for some keys (None: all of ``source``)."""
        source = self.table("source")
        if source is None:
            return
        due = self._stage(self._bucket((source if keys is None else keys).select(*KEY).distinct()), "due")
        buckets = [r["bucket"] for r in due.select("bucket").distinct().collect()]  # as many as there are buckets at most
        if buckets:
            # The keys alone are joined on, so that rows meet in the order in which the versions of a key are then compared.
            versions = source.filter(F.col("bucket").isin(buckets)).drop("bucket", "batch").join(due, KEY, "left_semi")
            fresh = self._stage(self._bucket(canonical.canonical_warnings(versions, None)), "fresh")
            self._queue(due, fresh, buckets, batch_id)
            self._refresh_core(due, fresh, buckets)
            self._refresh_days(due, fresh, buckets, batch_id)
        for path in self._staged:
            discard(self.spark, path)
        self._staged = []

    def _queued(self, batch_id: int) -> DataFrame | None:
        queue = self.table("queue")
        return None if queue is None else queue.filter(F.col("batch") == batch_id)

    def _queue(self, due: DataFrame, fresh: DataFrame, buckets: list[int], batch_id: int) -> None:
        """Old and new days of the due keys. What an earlier try of the batch has queued stays queued."""
        rows = canonical.explode_days(fresh.drop("bucket")).select(*KEY, "valid_date")
        core = self.table("core")
        if core is not None:
            old = core.filter(F.col("bucket").isin(buckets)).join(due, KEY, "left_semi")
            rows = rows.unionByName(canonical.explode_days(old.drop("bucket")).select(*KEY, "valid_date"))
        earlier = self._queued(batch_id)
        if earlier is not None:
            rows = rows.unionByName(earlier.select(*KEY, "valid_date"))
        rows = rows.distinct().withColumn("batch", F.lit(batch_id).cast("int"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.path("queue"))

    def _refresh_core(self, due: DataFrame, fresh: DataFrame, buckets: list[int]) -> None:
        core, rows = self.table("core"), fresh
        if core is not None:
            rows = core.filter(F.col("bucket").isin(buckets)).join(due, KEY, "left_anti").unionByName(fresh)
        self._write("core", rows, "bucket", buckets)

    def _refresh_days(self, due: DataFrame, fresh: DataFrame, buckets: list[int], batch_id: int) -> None:
        queued = self._queued(batch_id)
        if queued is None:
            return
        dates = self._stage(_month(queued.select("valid_date").distinct()), "dates")
        months = [r["month"] for r in dates.select("month").distinct().collect()]  # bounded by the calendar
        if not months:
            return
        # A batch with keys in all buckets has just rewritten all of core, which then gives the days without a look at the old ones.
        whole = len(buckets) == self.buckets
        days = _month(canonical.explode_days((self.table("core") if whole else fresh).drop("bucket"))).filter(F.col("month").isin(months))
        old_days, old_pub = self.table("core_day"), self.table("pub")
        if old_days is not None and not whole:
            days = old_days.filter(F.col("month").isin(months)).join(due, KEY, "left_anti").unionByName(days)
        self._write("core_day", days, "month", months)
        current = self.table("core_day").filter(F.col("month").isin(months)).join(dates, ["month", "valid_date"], "left_semi")
        pub = _month(canonical.daily_features(current.drop("month")))
        if old_pub is not None:
            pub = old_pub.filter(F.col("month").isin(months)).join(dates, ["month", "valid_date"], "left_anti").unionByName(pub)
        self._write("pub", pub, "month", months)


def run_refresh(spark: SparkSession, landing: str, schema: T.StructType, root: str, files_per_batch: int = 1, buckets: int = 64) -> WarningRefresh:
    """Consume all landed record files as micro-batches; the checkpoint makes re-imports no-ops."""
    job = WarningRefresh(spark, root, buckets)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    query = (
        stream.writeStream.foreachBatch(job.apply).option("checkpointLocation", os.path.join(root, "checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return job

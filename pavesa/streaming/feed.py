"""Live feeds: de-duplicated hotspots, late warnings, alert state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from pavesa.plans import reports
from pavesa.session import scratch_path


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream to the end of what has landed, into a Parquet sink, and read the result."""
    spark = stream.sparkSession
    out = scratch_path(spark, label)
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", out)
    else:
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
    query = writer.option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def distinct_hotspots(spark: SparkSession, landing: str, schema: T.StructType, keys: list[str], delay: str) -> DataFrame:
    stream = spark.readStream.schema(schema).option("header", "true").csv(landing)
    return stream.withWatermark("observed_at", delay).dropDuplicatesWithinWatermark(keys)


def late_warnings(spark: SparkSession, landing: str, schema: T.StructType, keys: list[str], files_per_batch: int | None = None) -> DataFrame:
    """First arrival of each warning, however late its file lands.

    There is no watermark: which archives are read is decided by the look-back of ``landing.archives_in_scope``, and within those no key may be
    lost. The state holds one key per warning, as the source table does.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(landing).dropDuplicates(keys)


def alert_states(spark: SparkSession, landing: str, schema: T.StructType, now: Column) -> DataFrame:
    return reports.alert_state_counts(spark.readStream.schema(schema).parquet(landing), now)

"""Table maintenance over Parquet: new states are built, written aside and swapped in."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pavesa.session import cut_lineage


def upsert(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old rows of the same key entirely."""
    return target.join(updates.select(*keys), keys, "left_anti").unionByName(updates)


def preserving_upsert(target: DataFrame, updates: DataFrame, keys: list[str], keep: list[str], status: str, initial: str) -> DataFrame:
    """Update a row but keep its local values, and its status once it has left the initial one."""
    o, n = target.alias("o"), updates.withColumn("_given", F.lit(True)).alias("n")
    joined = o.join(n, keys, "full_outer")
    known = F.col("n._given").isNotNull()

    def pick(name: str) -> Column:
        old, new = F.col(f"o.{name}"), F.col(f"n.{name}")
        if name == status:
            return F.when(old.isNotNull() & (old != initial), old).otherwise(F.coalesce(new, old))
        if name in keep:
            return F.coalesce(old, new)
        return F.when(known, new).otherwise(old)

    return joined.select(*keys, *[pick(c).alias(c) for c in target.columns if c not in keys])


def replace_range(target: DataFrame, fresh: DataFrame, inside: Column) -> DataFrame:
    """Drop the range, then add the rebuilt rows."""
    return target.filter(~F.coalesce(inside, F.lit(False))).unionByName(fresh)


def overwrite_partitions(rows: DataFrame, path: str, *partition: str, derived: bool = True) -> None:
    """Replace only the partitions present in ``rows``. To clear one, give it a row of nulls and leave those out when reading.

    Rows ``derived`` from the same table are staged first. The rebalance hint gathers each partition
    into few files and still splits one that holds much of the data over several tasks.
    """
    staged = cut_lineage(rows, "staged") if derived else rows
    balanced = staged.hint("rebalance", *[F.col(p) for p in partition])
    balanced.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def publish(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """Full reload of a serving table: a new version is written once, then the log names it. Until then readers see the old one."""
    version = uuid.uuid4().hex
    rows.write.parquet(f"{path}/version-{version}")
    log = f"{path}/log"
    step = spark.range(1).select(F.lit(version).alias("version"), F.lit(time.time_ns()).alias("at"))
    step.coalesce(1).write.mode("append").parquet(log)
    return published(spark, path)


def published(spark: SparkSession, path: str) -> DataFrame:
    """The latest version of a serving table."""
    latest = spark.read.parquet(f"{path}/log").agg(F.max_by("version", "at")).first()[0]
    return spark.read.parquet(f"{path}/version-{latest}")


def replace_file_rows(source: DataFrame, core: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove the rows of re-imported files, and the core rows they represented."""
    gone = source.join(files, "source_download_id", "left_semi")
    lost = gone.select(F.col("source_record_id").alias("warning_id"))
    return source.join(files, "source_download_id", "left_anti"), core.join(lost, "warning_id", "left_anti")


def latest_status(ledger: DataFrame, key: str) -> DataFrame:
    """Append-only ledger to the current state of each entry."""
    payload = F.struct("status", "rows_loaded", "error")
    return ledger.groupBy(key).agg(F.max_by(payload, "step").alias("s"), F.count("*").alias("entries")).select(key, "s.*", "entries")


def skip_unchanged(manifests: DataFrame, downloads: DataFrame, records: DataFrame, identity: list[str]) -> DataFrame:
    """Manifests still to import: unknown, changed, or stored with another row count than declared."""
    stored = records.groupBy("source_download_id").agg(F.count("*").alias("stored_rows"))
    complete = downloads.join(stored, "source_download_id", "left").filter(F.coalesce("stored_rows", F.lit(0)) == F.col("declared_rows"))
    return manifests.join(complete.select(*identity), identity, "left_anti")


def apply_manifests(core: DataFrame, manifests: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Publication manifests onto the core table: (new core, day stats to keep, manifests without a row)."""
    m = manifests.select(*keys, F.col("publication_status").alias("m_status"), "tiles_generated", "m_path", "burned_area_ha", F.lit(True).alias("hit"))
    joined = core.join(m, keys, "left")
    new_core = joined.select(
        *[c for c in core.columns if c not in ("publication_status", "local_tiles_path")],
        F.coalesce("m_status", "publication_status").alias("publication_status"),
        F.when(F.col("hit") & F.coalesce("tiles_generated", F.lit(False)), F.col("m_path"))
        .when(F.col("hit"), F.lit(None)).otherwise(F.col("local_tiles_path")).alias("local_tiles_path"),
    )
    stats = m.filter("m_status = 'published'").join(core.select(*keys), keys, "left_semi").select(*keys, "burned_area_ha")
    return new_core, stats, m.join(core.select(*keys), keys, "left_anti").select(*keys)

"""What the operators share: words, held-out rows, written tables, row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pavesa.session import cut_lineage, scratch_path

__all__ = ["SPACE", "crc_mod", "cut_lineage", "numbered", "scratch_path", "table", "word_list"]

#: Characters between words: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % n


def word_list(text: Column) -> Column:
    """Words of a text (null: none), split at SPACE."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))


def numbered(df: DataFrame, name: str = "row") -> DataFrame:
    """One number per row, so that repeated ids stay apart.

    The number depends on the file splits of the scan alone. Their size would follow the cores of the cluster, which change when executors are
    lost, so the least number of splits is fixed for the session at its present value.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return df.withColumn(name, F.monotonically_increasing_id())

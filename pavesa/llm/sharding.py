"""Extendible hashing: a directory of hash prefixes in which only oversized buckets split on another bit, until every shard fits its limit.

The directory is made from byte counts, not from rows: counts by prefix are taken once, LOOK bits beyond the current depth, and folded down
to find the shortest prefixes that fit. Only buckets still oversized at that depth are counted again, deeper. Rows are read once per such
round (usually once) and once more to get their shard.

A hash has 60 bits (of the md5 of the key as text), so at most 60 splits. A bucket that is oversized at that depth holds one key (equal keys,
or one row above the limit) and can't be split by any hash of the key: it stays one shard, with ``fits`` false.

Defined cases: a null key is the empty text; a null size is 0; an empty table has no shards; repeated rows go to one
shard; other columns pass through, and one that has the name of a result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pavesa.llm.common import cut_lineage

BITS = 60
LOOK = 16


def hash_of(key: Column) -> Column:
    """The first 60 bits of the md5 of a key as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def prefix(hashed: Column, depth: Column | int) -> Column:
    """The first ``depth`` bits of a hash, as a number."""
    places = F.lit(BITS) - depth if isinstance(depth, Column) else F.lit(BITS - depth)
    return F.call_function("shiftright", hashed, places.cast("int"))


def directory(sizes: DataFrame, limit: int, look: int = LOOK) -> DataFrame:
    """Buckets (depth, prefix, bytes, n_rows, fits) over rows of ``_hash`` and ``_bytes``."""
    done, open_ = None, None  # open_: prefixes at ``depth`` that are too large there
    depth = 0
    while True:
        deep = min(BITS, depth + look)
        rows = sizes.withColumn("_at", prefix(F.col("_hash"), depth))
        if open_ is not None:
            rows = rows.join(open_, "_at", "left_semi")
        fine = cut_lineage(rows.groupBy(prefix(F.col("_hash"), deep).alias("p")).agg(F.sum("_bytes").alias("bytes"), F.count(F.lit(1)).alias("n_rows")), "histogram")
        # Each fine bucket adds to the bucket of every shorter prefix; the shortest that fits, on the way down from ``depth``, is its shard.
        levels = fine.select("p", "bytes", "n_rows", F.explode(F.sequence(F.lit(depth), F.lit(deep))).alias("depth"))
        levels = levels.withColumn("prefix", F.call_function("shiftright", F.col("p"), (F.lit(deep) - F.col("depth")).cast("int")))
        sums = cut_lineage(levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows")), "levels")
        fit = F.col("bytes") <= limit
        above = sums.where(~fit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        split = sums.withColumn("parent", F.call_function("shiftright", F.col("prefix"), F.lit(1))).join(above, ["depth", "parent"], "left_semi").drop("parent")
        reached = sums.where(F.col("depth") == depth).unionByName(split) if depth == 0 else split
        buckets = reached.where(fit | (F.lit(deep == BITS) & (F.col("depth") == BITS))).select("depth", "prefix", "bytes", "n_rows", fit.alias("fits"))
        done = buckets if done is None else done.unionByName(buckets)
        open_ = sums.where(~fit & (F.col("depth") == deep)).select(F.col("prefix").alias("_at"))
        if deep == BITS or open_.isEmpty():
            return done
        depth = deep


def sharded(df: DataFrame, key: str, size: Column, limit: int, look: int = LOOK) -> DataFrame:
    """``df`` with shard (the prefix in bits, ``""`` for a single shard), shard_bytes and fits. ``size``: bytes of a row (null: 0)."""
    names = [c for c in df.columns if c not in ("shard", "shard_bytes", "fits")]
    rows = df.select(*(F.col(f"`{c}`") for c in names), hash_of(F.col(key)).alias("_hash"), F.coalesce(size, F.lit(0)).cast("long").alias("_bytes"))
    buckets = directory(rows.select("_hash", "_bytes"), limit, look)
    written = cut_lineage(buckets, "directory")
    depths = [r["depth"] for r in written.select("depth").distinct().orderBy("depth").collect()]  # 61 at most
    tries = F.array(*(F.struct(F.lit(d).alias("depth"), prefix(F.col("_hash"), d).alias("prefix")) for d in depths)) if depths else F.array(F.struct(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix")))
    keys = rows.select("_hash").distinct().withColumn("t", F.explode(tries)).select("_hash", "t.*").join(written, ["depth", "prefix"])
    bits = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    placed = keys.select("_hash", bits.alias("shard"), F.col("bytes").alias("shard_bytes"), "fits")
    return rows.join(placed, "_hash").drop("_hash", "_bytes")


def write(rows: DataFrame, path: str) -> None:
    """One folder per shard; all rows of a shard go through one task, which the limit allows."""
    rows.repartition("shard").write.partitionBy("shard").parquet(path)

"""Data-quality rules as frames of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def violations(rows: DataFrame, rules: dict[str, Column], id_col: str) -> DataFrame:
    """One row per broken rule and record, all rules in one pass."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(id_col, F.explode(broken).alias("rule"))


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    return child.join(parent, keys, "left_anti")


def outside_set(rows: DataFrame, name: str, allowed: list[str]) -> DataFrame:
    return rows.filter(F.col(name).isNotNull() & ~F.col(name).isin(*allowed))


def file_hash_mismatches(files: DataFrame, expected: DataFrame) -> DataFrame:
    """``files(path, content)`` against ``expected(path, sha256)``."""
    actual = files.select("path", F.sha2("content", 256).alias("actual"))
    return actual.join(expected, "path").filter("actual <> sha256")

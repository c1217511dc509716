"""Point-in-region tests against one boundary of any size, without exploding the points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pavesa.functions import geo


def strips(edges: DataFrame, height: float) -> DataFrame:
    """Boundary edges grouped by the latitude strips they span: per strip an array for each feature (``part``, if there is one).

    The result holds each edge once per strip it crosses, so its size follows the boundary and
    the strip height, never the points.
    """
    part = [F.col("part")] if "part" in edges.columns else [F.lit(0).alias("part")]
    lo = F.floor(F.least("y1", "y2") / height)
    hi = F.floor(F.greatest("y1", "y2") / height)
    return (
        edges.select("x1", "y1", "x2", "y2", *part, F.explode(F.sequence(lo, hi)).alias("strip"))
        .groupBy("strip", "part")
        .agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
        .groupBy("strip")
        .agg(F.collect_list("edges").alias("features"))
    )


def flag_in_region(
    points: DataFrame, edges: DataFrame, lon: str = "longitude", lat: str = "latitude",
    height: float = 0.25, flag: str = "in_region",
) -> DataFrame:
    """Adds a boolean: the point is covered by the region (its border counts as inside).

    Inside a feature an even number of crossings means outside (holes, islands); overlapping features are united.
    Only the edges of the point's own strip can be crossed by its ray, so one equi-join on the
    strip carries everything needed. Spark broadcasts the strip table when it is small enough
    and shuffles on the strip otherwise.
    """
    table = strips(edges, height).withColumnRenamed("strip", "_strip").withColumnRenamed("features", "_features")
    inside = F.exists("_features", lambda edges: geo.covered_by_edges(F.col(lon), F.col(lat), edges))
    return (
        points.withColumn("_strip", F.floor(F.col(lat) / height))
        .join(table, "_strip", "left")
        .withColumn(flag, F.coalesce(inside, F.lit(False)))
        .drop("_strip", "_features")
    )

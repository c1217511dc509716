"""Grid joins between shapes, zones and settlements, and roads near a point."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pavesa.functions import geo


BOUNDS = ["minx", "miny", "maxx", "maxy"]
ROW_GROUP_BYTES = 16 << 20


def cells(df: DataFrame, box: Column, size: float, mx=0.0, my=0.0) -> DataFrame:
    """One row per grid cell the (padded) box touches, as ``gx``, ``gy``."""
    gx = F.sequence(F.floor((box.minx - mx) / size), F.floor((box.maxx + mx) / size))
    gy = F.sequence(F.floor((box.miny - my) / size), F.floor((box.maxy + my) / size))
    return df.withColumn("gx", F.explode(gx)).withColumn("gy", F.explode(gy))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Even out rows that cost much CPU each, whatever cell or file they came from."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def candidate_pairs(left: DataFrame, right: DataFrame, distance_m: float, right_id: str, size: float = 0.25) -> DataFrame:
    """Shape pairs that may lie within the distance, with the distance of one corner of the right shape (its anchor).

    Both sides go to the grid cells their boxes touch and meet by equi-join. A pair that shares
    several cells is kept only in the cell holding the lower corner of the boxes' overlap, so
    no distinct is needed. The right shape lies within ``half_m`` (``half_deg``) of its anchor, and
    the anchor belongs to it, whatever parts and holes it has.
    """
    left, right = geo.with_shape(left), geo.with_shape(right)
    dy = distance_m / geo.M_PER_DEG
    a = left.withColumn("abox", geo.shape_bbox(F.col("shape"))).withColumn("aedges", geo.shape_edges(F.col("shape"))).drop("shape")
    cos = F.cos(F.radians(F.greatest(F.abs(F.col("abox.miny")), F.abs(F.col("abox.maxy"))) + dy))
    a = a.withColumn("mx", F.lit(dy) / cos)
    a = cells(a, F.col("abox"), size, F.col("mx"), F.lit(dy))
    b = right.withColumn("bbox_", geo.shape_bbox(F.col("shape"))).withColumn("bedges", geo.shape_edges(F.col("shape"))).drop("shape")
    b = b.withColumns({"cx": F.col("bedges")[0]["x1"], "cy": F.col("bedges")[0]["y1"]})
    sx, sy = geo.metre_scale(F.col("cy"))
    away = lambda e, u, v: F.sqrt(F.pow((e.x1 - F.col("cx")) * u, 2) + F.pow((e.y1 - F.col("cy")) * v, 2))
    half = lambda u, v: F.array_max(F.transform("bedges", lambda e: away(e, u, v)))
    one = F.lit(1.0)
    b = b.withColumns({"sx": sx, "sy": sy, "half_m": half(sx, sy), "half_deg": half(one, one)})
    b = cells(b, F.col("bbox_"), size)
    met = a.join(b, ["gx", "gy"])
    cornerx = F.floor(F.greatest(F.col("abox.minx") - F.col("mx"), F.col("bbox_.minx")) / size)
    cornery = F.floor(F.greatest(F.col("abox.miny") - dy, F.col("bbox_.miny")) / size)
    met = spread(met.filter((F.col("gx") == cornerx) & (F.col("gy") == cornery)).drop("gx", "gy", "mx", "abox", "bbox_"), right_id)
    cx, cy = F.col("cx"), F.col("cy")
    rough = geo.computed_once(
        met,
        centre_inside=geo.covered_by_edges(cx, cy, F.col("aedges")),
        centre_m=geo.edges_distance(cx, cy, F.col("aedges"), F.col("sx"), F.col("sy")),
        centre_deg=geo.edges_distance(cx, cy, F.col("aedges"), one, one),
    )
    return rough.filter(F.col("centre_inside") | (F.col("centre_m") - F.col("half_m") <= distance_m))


def exact_pairs(candidates: DataFrame, distance_m: float) -> DataFrame:
    """Candidates truly within the distance, with ``distance_m`` and ``distance_deg``."""
    # An anchor inside, or farther out than the shape reaches from it, settles the overlap question.
    touch = F.when(F.col("centre_inside"), True).when(F.col("centre_m") > F.col("half_m") * 1.01, False).otherwise(
        geo.edges_touch(F.col("aedges"), F.col("bedges"))
    )
    zero, one = F.lit(0.0), F.lit(1.0)
    gap = lambda x, y: F.when(F.col("touch"), zero).otherwise(geo.edges_gap(F.col("aedges"), F.col("bedges"), x, y))
    measured = geo.computed_once(
        geo.computed_once(candidates, touch=touch), distance_m=gap(F.col("sx"), F.col("sy")), distance_deg=gap(one, one)
    )
    helpers = ["aedges", "bedges", "cx", "cy", "sx", "sy", "half_m", "half_deg", "centre_inside", "centre_m", "centre_deg", "touch"]
    return measured.filter(F.col("distance_m") <= distance_m).drop(*helpers)


def pairs_within(left: DataFrame, right: DataFrame, distance_m: float, right_id: str) -> DataFrame:
    return exact_pairs(candidate_pairs(left, right, distance_m, right_id), distance_m)


def settlement_per_zone(zones: DataFrame, places: DataFrame, distance_m: float, strategy: str) -> DataFrame:
    """One settlement per zone within the distance: the closest, or the most populated.

    Anchor distances bound the true ones, so each zone first learns how good its winner surely is;
    only places that can still beat that are measured exactly.
    """
    pairs = candidate_pairs(zones, places, distance_m, "settlement_id")
    inside = F.col("centre_inside")
    sure = inside | (F.col("centre_m") <= distance_m)
    if strategy == "most_populated":
        bound = pairs.filter(sure).groupBy("area_code").agg(F.max("habitantes").alias("bound"))
        hopeful = F.col("habitantes") >= F.coalesce("bound", F.lit(0))
        rank = F.struct(-F.col("habitantes"), F.rint(F.col("distance_m") * 1e4), F.col("settlement_id"))
    else:
        centre = F.when(inside, 0.0).otherwise(F.col("centre_deg"))
        bound = pairs.filter(sure).groupBy("area_code").agg(F.min(centre).alias("bound"))
        hopeful = (centre - F.col("half_deg")) <= F.coalesce("bound", F.lit(float("inf"))) + 1e-8
        rank = F.struct(F.rint(F.col("distance_deg") * 1e9), F.col("settlement_id"))
    few = pairs.join(bound, "area_code", "left").filter(hopeful).drop("bound")
    payload = F.struct("settlement_id", "nombre", "habitantes", "distance_m")
    return exact_pairs(few, distance_m).groupBy("area_code").agg(F.min_by(payload, rank).alias("p")).select("area_code", "p.*")


def box_around(lon: float, lat: float, radius_m: float) -> tuple[float, float, float, float]:
    dy = radius_m / geo.M_PER_DEG
    dx = dy / math.cos(math.radians(min(abs(lat) + dy, 89.0)))
    return lon - dx, lat - dy, lon + dx, lat + dy


def in_box(rows: DataFrame, line: str, box: tuple[float, float, float, float]) -> Column:
    """Whether a line's box meets a box, by stored bounds where the rows have them."""
    own = [F.col(n) for n in BOUNDS] if set(BOUNDS) <= set(rows.columns) else [geo.ring_bbox(F.col(line))[n] for n in BOUNDS]
    return geo.box_overlaps(*own, box)


def z_order(x: Column, y: Column, bits: int = 24) -> Column:
    """Place on a Z curve over the world: nearby places mostly have nearby numbers."""

    def spread_bits(v: Column) -> Column:
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    side = float(1 << bits)
    whole = lambda v, low, width: F.least(F.greatest(F.floor((v - low) / width * side), F.lit(0)), F.lit((1 << bits) - 1)).cast("long")
    return spread_bits(whole(x, -180.0, 360.0)).bitwiseOR(F.shiftleft(spread_bits(whole(y, -90.0, 180.0)), 1))


def store_by_place(rows: DataFrame, line: str, path: str) -> None:
    """Write rows with their bounds, sorted along the Z curve of their centres, so that files and row groups cover small areas."""
    boxed = geo.computed_once(rows, _b=geo.ring_bbox(F.col(line))).select(*rows.columns, "_b.*")
    placed = boxed.withColumn("place", z_order((F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2))
    placed.repartitionByRange("place").sortWithinPartitions("place").drop("place").write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)


def stored_by_place(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Stored rows whose bounds meet a box; other files and row groups aren't read."""
    rows = spark.read.parquet(path)
    return rows.filter(geo.box_overlaps(*(F.col(n) for n in BOUNDS), box))


def roads_near(roads: DataFrame, lon: float, lat: float, radius_m: float, classes: list[str] | None = None) -> DataFrame:
    """Roads with any part within the radius; box filter first, exact segment distance after.

    Roads of ``stored_by_place`` bring their boxes, so the filter reaches the files.
    """
    rows = roads if not classes else roads.filter(F.col("clase").isin(*classes))
    hit = in_box(rows, "line", box_around(lon, lat, radius_m))
    px, py = F.lit(float(lon)), F.lit(float(lat))
    sx, sy = geo.metre_scale(py)
    return (
        geo.computed_once(rows.filter(hit), distance_exact_m=geo.line_distance(px, py, F.col("line"), sx, sy))
        .filter(F.col("distance_exact_m") <= radius_m)
        .withColumn("distance_m", F.rint("distance_exact_m").cast("int"))
    )


def shape_at_point(points: DataFrame, shapes: DataFrame, size: float = 0.03125) -> DataFrame:
    """``points(px, py)`` x ``shapes(shape_id, shape or ring)``: the lowest shape id covering each distinct point.

    Points are made distinct first, as many rows share one coordinate.
    """
    spots = points.select("px", "py").distinct()
    spots = spots.withColumn("gx", F.floor(F.col("px") / size)).withColumn("gy", F.floor(F.col("py") / size))
    edged = geo.with_shape(shapes).select("shape_id", geo.shape_edges(F.col("shape")).alias("edges"), geo.shape_bbox(F.col("shape")).alias("b"))
    few = lowest_of_cell(edged, size).withColumnRenamed("shape_id", "id")
    grid = few.join(edged, F.col("id").eqNullSafe(F.col("shape_id"))).drop("id")
    covered = (
        F.col("px").between(F.col("b.minx"), F.col("b.maxx"))
        & F.col("py").between(F.col("b.miny"), F.col("b.maxy"))
        & geo.covered_by_edges(F.col("px"), F.col("py"), F.col("edges"))
    )
    return spots.join(grid, ["gx", "gy"]).filter(covered).groupBy("px", "py").agg(F.min("shape_id").alias("shape_id"))


def lowest_of_cell(edged: DataFrame, size: float) -> DataFrame:
    """``(shape_id, gx, gy)`` of the shapes in each grid cell that may be the lowest one covering some point there.

    A shape without an edge in the cell covers all of it or nothing. The lowest that covers all of it wins over every higher id, so where
    shapes lie in many layers only a few are left. The box is a little larger than the cell, against rounding.
    """
    low = lambda n: (F.col(n) - 1e-9) * size
    high = lambda n: (F.col(n) + (1 + 1e-9)) * size
    met = F.exists("edges", lambda e: geo.edge_meets_box(e, low("gx"), low("gy"), high("gx"), high("gy")))
    whole = ~met & geo.covered_by_edges(low("gx"), low("gy"), F.col("edges"))
    bound = cells(spread(edged, "shape_id"), F.col("b"), size).filter(whole).groupBy("gx", "gy").agg(F.min("shape_id").alias("bound"))
    there = cells(edged.select("shape_id", "b"), F.col("b"), size).select("shape_id", "gx", "gy").distinct()
    return there.join(bound, ["gx", "gy"], "left").filter(F.col("bound").isNull() | (F.col("shape_id") <= F.col("bound"))).drop("bound")

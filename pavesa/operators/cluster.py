"""Exact density clustering (DBSCAN) on a grid, without pairing up the points of a dense place.

Cells have a diagonal of one radius, so all points of a cell are neighbours: a cell holding
``min_points`` needs no distances at all. Distances are computed for the points of thin cells
only, and between neighbouring cells just far enough to know whether they touch.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pavesa.session import cut_lineage

SPLIT = 4
DEPTH = 4
DIRECT_PAIRS = 4096


def dbscan(points: DataFrame, eps: float, min_points: int) -> DataFrame:
    """``points(id, x, y)`` -> ``(id, x, y, cluster_id)``; noise has a NULL cluster.

    Clusters are numbered from 0 by their smallest core id. A border point joins the smallest
    cluster it touches.
    """
    side = eps / math.sqrt(2) * (1 - 1e-9)
    spots = points.groupBy("x", "y").agg(F.count("*").alias("w"), F.min("id").alias("first_id"))
    for level in range(DEPTH):
        size = side / SPLIT**level
        spots = spots.withColumn(f"c{level}x", F.floor(F.col("x") / size)).withColumn(f"c{level}y", F.floor(F.col("y") / size))
    weights = spots.groupBy("c0x", "c0y").agg(F.sum("w").alias("cell_w"))
    spots = cut_lineage(spots.join(weights, ["c0x", "c0y"]), "spots")

    thin = spots.filter(F.col("cell_w") < min_points)
    near = _neighbour_cells(thin.select("x", "y", "c0x", "c0y")).join(
        spots.select(F.col("x").alias("ox"), F.col("y").alias("oy"), "w", F.col("c0x").alias("nx"), F.col("c0y").alias("ny")),
        ["nx", "ny"],
    )
    counted = near.filter(_dist() <= eps).groupBy("x", "y").agg(F.sum("w").alias("n"))
    thin_core = counted.filter(F.col("n") >= min_points).select("x", "y", F.lit(True).alias("thin_core"))
    marked = cut_lineage(
        spots.join(thin_core, ["x", "y"], "left").withColumn(
            "is_core", (F.col("cell_w") >= min_points) | F.coalesce("thin_core", F.lit(False))
        ).drop("thin_core"),
        "marked",
    )
    core = marked.filter("is_core")

    links = _cell_links(core, eps)
    cells = core.groupBy("c0x", "c0y").agg(F.min("first_id").alias("cell_min"))
    cells = cells.withColumn("cell", _cell_id("c0x", "c0y"))
    roots = connected_components(links)
    labelled = cells.join(roots, cells["cell"] == roots["node"], "left").withColumn("root", F.coalesce("root", "cell"))
    label = labelled.groupBy("root").agg(F.min("cell_min").alias("label"))
    cell_label = cut_lineage(labelled.join(label, "root").select("c0x", "c0y", "label"), "cell-label")

    core_label = core.join(cell_label, ["c0x", "c0y"]).select("x", "y", "c0x", "c0y", "label")
    border = _neighbour_cells(marked.filter("NOT is_core").select("x", "y", "c0x", "c0y")).join(
        core_label.select(F.col("x").alias("ox"), F.col("y").alias("oy"), "label", F.col("c0x").alias("nx"), F.col("c0y").alias("ny")),
        ["nx", "ny"],
    )
    border_label = border.filter(_dist() <= eps).groupBy("x", "y").agg(F.min("label").alias("label"))
    spot_label = core_label.select("x", "y", "label").unionByName(border_label)
    numbered = spot_label.join(dense_numbers(cell_label.select("label").distinct(), "label"), "label")
    return points.join(numbered.select("x", "y", "cluster_id"), ["x", "y"], "left").select("id", "x", "y", "cluster_id")


def _dist():
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    return F.sqrt(dx * dx + dy * dy)


def _neighbour_cells(rows: DataFrame) -> DataFrame:
    offsets = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) < 4]
    return rows.withColumn("o", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets]))).select(
        "x", "y", (F.col("c0x") + F.col("o.i")).alias("nx"), (F.col("c0y") + F.col("o.j")).alias("ny")
    )


def _cell_id(cx: str, cy: str):
    return F.concat_ws(":", cx, cy)


def _sub(core: DataFrame, level: int, tag: str) -> DataFrame:
    keys = ["c0x", "c0y"] + ([f"c{level}x", f"c{level}y"] if level else [])
    boxes = core.groupBy(*keys).agg(
        F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"), F.count("*").alias("n")
    )
    return boxes.select(
        F.col(f"c{level}x").alias(f"{tag}sx"), F.col(f"c{level}y").alias(f"{tag}sy"),
        F.floor(F.col(f"c{level}x") / SPLIT).alias(f"{tag}px"), F.floor(F.col(f"c{level}y") / SPLIT).alias(f"{tag}py"),
        F.col("c0x").alias(f"{tag}x"), F.col("c0y").alias(f"{tag}y"),
        F.struct("minx", "miny", "maxx", "maxy", "n").alias(f"{tag}box"),
    )


def _gap(a, b):
    dx = F.greatest(a.minx - b.maxx, b.minx - a.maxx, F.lit(0.0))
    dy = F.greatest(a.miny - b.maxy, b.miny - a.maxy, F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def _span(a, b):
    dx = F.greatest(a.maxx - b.minx, b.maxx - a.minx)
    dy = F.greatest(a.maxy - b.miny, b.maxy - a.miny)
    return F.sqrt(dx * dx + dy * dy)


def _cell_links(core: DataFrame, eps: float) -> DataFrame:
    """Pairs of core cells that hold two core points within the radius.

    Boxes decide most pairs. Undecided pairs compare their points when those are few, else both
    cells are split and the halves are judged again.
    """
    half = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) < 4 and (i, j) > (0, 0)]
    a = _sub(core, 0, "a").withColumn("o", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in half])))
    a = a.withColumn("bx", F.col("ax") + F.col("o.i")).withColumn("by", F.col("ay") + F.col("o.j"))
    pairs = a.join(_sub(core, 0, "b"), ["bx", "by"])
    keep = ["ax", "ay", "bx", "by", "asx", "asy", "bsx", "bsy", "abox", "bbox"]
    edge = ["ax", "ay", "bx", "by"]
    linked = None
    for level in range(DEPTH):
        pairs = pairs.select(*keep).filter(_gap(F.col("abox"), F.col("bbox")) <= eps)
        pairs = cut_lineage(
            pairs.withColumn("sure", _span(F.col("abox"), F.col("bbox")) <= eps), f"pairs{level}"
        )
        undecided = pairs.filter("NOT sure").join(pairs.filter("sure").select(*edge), edge, "left_anti")
        few = F.col("abox.n") * F.col("bbox.n") <= DIRECT_PAIRS
        direct = undecided if level == DEPTH - 1 else undecided.filter(few)
        found = pairs.filter("sure").select(*edge).unionByName(_compare_points(direct, core, level, eps).select(*edge))
        linked = found if linked is None else linked.unionByName(found)
        if level == DEPTH - 1:
            break
        large = undecided.filter(~few)
        if large.isEmpty():
            break
        up_a = _sub(core, level + 1, "a").drop("ax", "ay").withColumnsRenamed({"apx": "asx_", "apy": "asy_"})
        up_b = _sub(core, level + 1, "b").drop("bx", "by").withColumnsRenamed({"bpx": "bsx_", "bpy": "bsy_"})
        parents = large.select(*edge, F.col("asx").alias("asx_"), F.col("asy").alias("asy_"), F.col("bsx").alias("bsx_"), F.col("bsy").alias("bsy_"))
        pairs = parents.join(up_a, ["asx_", "asy_"]).join(up_b, ["bsx_", "bsy_"])
    return linked.distinct().select(_cell_id("ax", "ay").alias("u"), _cell_id("bx", "by").alias("v"))


def _compare_points(pairs: DataFrame, core: DataFrame, level: int, eps: float) -> DataFrame:
    sub = [F.col(f"c{level}x"), F.col(f"c{level}y")]
    pa = core.select(F.col("x"), F.col("y"), sub[0].alias("asx"), sub[1].alias("asy"))
    pb = core.select(F.col("x").alias("ox"), F.col("y").alias("oy"), sub[0].alias("bsx"), sub[1].alias("bsy"))
    edge = ["ax", "ay", "bx", "by"]
    return (
        pairs.select(*edge, "asx", "asy", "bsx", "bsy")
        .join(pa, ["asx", "asy"])
        .join(pb, ["bsx", "bsy"])
        .filter(_dist() <= eps)
        .select(*edge)
        .distinct()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` -> ``(node, root)`` by alternating large-star and small-star rounds.

    Each round is written to the shared folder, so a lost executor only repeats one round.
    """
    current = cut_lineage(edges.select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).filter("lo <> hi").distinct(), "edges")
    before = None
    while True:
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            current.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).filter("lo <> hi").distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi")
        small = small.select(F.col("m").alias("lo"), F.col("lo").alias("hi")).filter("lo <> hi").unionByName(
            down.select(F.col("m").alias("lo"), "hi")
        ).distinct()
        current = cut_lineage(small, "edges")
        mark = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("h")).first()
        if mark == before:
            return current.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = mark


def dense_numbers(values: DataFrame, name: str) -> DataFrame:
    """Number distinct sorted values 0, 1, 2, ... without bringing them to one task.

    Rows are range-partitioned; only the row count of each partition is accumulated in order.
    """
    ranged = values.repartitionByRange(name).withColumn("part", F.spark_partition_id())
    ranged = cut_lineage(ranged, "numbers")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(name))
    return ranged.join(offsets, "part").select(name, (inside - 1 + F.col("offset")).cast("int").alias("cluster_id"))

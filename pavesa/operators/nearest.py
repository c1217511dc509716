"""Nearest shape per point, exact, by branch and bound over a grid hierarchy.

Shapes are grouped into ever smaller grid cells; each cell keeps the tight box around its shapes.
The points of one small cell walk down together: they keep only the shape cells whose nearest edge is no farther
than the best guarantee found so far. The shapes left are listed in pieces of a bounded length, from which each point
takes those that can still be its nearest, so no group of points times shapes is ever measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pavesa.functions import geo
from pavesa.operators.spatial import spread
from pavesa.session import cut_lineage

LEVELS = [0.5, 0.0625, 0.0078125, 0.0009765625]
#: Cells above these, from which a search without a limit starts: a hundred of the first cover all degrees.
FAR = [32.0, 4.0]
SLACK = 2e-9
#: Cells of points that walk down together, by WIDE x WIDE of them to the second level; shapes in a piece of their list.
TOGETHER, WIDE = LEVELS[2], 8
PIECE = 64
BOX = ["minx", "miny", "maxx", "maxy"]


def _key(size: float) -> Column:
    return F.xxhash64(F.lit(size), F.floor(F.col("cx") / size), F.floor(F.col("cy") / size))


def _boxes(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy")
    )


class Reach:
    """Which shapes count for a point: a limit in degrees, in metres, and a half-box in degrees; without a limit all count."""

    def __init__(self, within_deg: float | None = None, within_m: float | None = None, box_deg: float | None = None):
        if within_deg is None and within_m is None and box_deg is not None:
            raise ValueError("give a limit in degrees or metres")
        self.within_deg, self.within_m, self.box_deg = within_deg, within_m, box_deg

    @property
    def limited(self) -> bool:
        return self.within_deg is not None or self.within_m is not None

    def margins(self, miny: Column, maxy: Column) -> tuple[Column, Column]:
        limits = [v for v in (self.within_deg, self.box_deg) if v is not None]
        if limits:
            return F.lit(min(limits)), F.lit(min(limits))
        dy = self.within_m / geo.M_PER_DEG
        widest = F.cos(F.radians(F.least(F.greatest(F.abs(miny), F.abs(maxy)) + dy, F.lit(89.0))))
        return F.lit(dy) / widest, F.lit(dy)

    def bounds(self, at: Column, box: Column) -> tuple[Column, Column, Column]:
        """(possible, least degrees, degrees within which a member surely lies), for all points of the box ``at``.

        Some member touches each side of a tight box, so from each side's farthest corner there is a guarantee.
        """
        zero = F.lit(0.0)
        dx = F.greatest(box.minx - at.maxx, at.minx - box.maxx, zero)
        dy = F.greatest(box.miny - at.maxy, at.miny - box.maxy, zero)
        fx = F.greatest(at.maxx - box.minx, box.maxx - at.minx)
        fy = F.greatest(at.maxy - box.miny, box.maxy - at.miny)
        side = lambda v, low, high: F.greatest(F.abs(low - v), F.abs(high - v))
        sidex = F.least(side(box.minx, at.minx, at.maxx), side(box.maxx, at.minx, at.maxx))
        sidey = F.least(side(box.miny, at.miny, at.maxy), side(box.maxy, at.miny, at.maxy))
        near, far = F.sqrt(dx * dx + dy * dy), F.sqrt(F.least(sidex * sidex + fy * fy, fx * fx + sidey * sidey))
        possible, sure = F.lit(True), F.lit(True)
        if self.within_deg is not None:
            possible = possible & (near <= self.within_deg * (1 + 1e-12))
        if self.within_m is not None:
            least_sx, sy = geo.metre_scale(F.greatest(F.abs(at.miny), F.abs(at.maxy)))
            most_sx, _ = geo.metre_scale(F.greatest(at.miny, -at.maxy, zero))
            possible = possible & (F.sqrt(F.pow(dx * least_sx, 2) + F.pow(dy * sy, 2)) <= self.within_m * (1 + 1e-9))
            sure = sure & (F.sqrt(F.pow(fx * most_sx, 2) + F.pow(fy * sy, 2)) <= self.within_m * (1 - 1e-9))
        if self.box_deg is not None:
            possible = possible & (dx <= self.box_deg) & (dy <= self.box_deg)
            sure = sure & (fx <= self.box_deg) & (fy <= self.box_deg)
        return possible, near, F.when(sure, far).otherwise(F.lit(float("inf")))


def _prune(frontier: DataFrame) -> DataFrame:
    best = F.min("ub").over(Window.partitionBy("qx", "qy"))
    return frontier.withColumn("best", F.least("best", best)).filter(F.col("lb") <= F.col("best") + SLACK).drop("ub")


def nearest_shape(points: DataFrame, shapes: DataFrame, reach: Reach, exact_m: float | None = None) -> DataFrame:
    """``points(pid, px, py)`` x ``shapes(shape_id, shape or ring)`` -> ``(pid, shape_id, distance_deg, distance_m)``.

    The nearest shape in planar degrees among those within reach, ties to the lowest id. With
    ``exact_m`` the winner is dropped when it is farther than that many metres.
    """
    distinct = geo.with_shape(shapes).groupBy("shape").agg(F.min("shape_id").alias("shape_id"))
    s = distinct.withColumn("_b", geo.shape_bbox(F.col("shape"))).select("shape_id", "shape", "_b.*").filter("minx IS NOT NULL AND miny IS NOT NULL")
    s = s.withColumn("cx", (F.col("minx") + F.col("maxx")) / 2).withColumn("cy", (F.col("miny") + F.col("maxy")) / 2)
    s = s.withColumn("shape_key", F.xxhash64("shape_id", *BOX))
    far = [] if reach.limited else [f"f{i}" for i in range(len(FAR))]
    chain = [*far, *(f"k{i}" for i in range(len(LEVELS)))]
    for name, size in zip(chain, (FAR if far else []) + LEVELS):
        s = s.withColumn(name, _key(size))

    px, py = F.col("px"), F.col("py")
    size = LEVELS[0]
    # The cells above come from the stored boxes of the first level, so the plan holds the shapes no more often than with a limit.
    top = cut_lineage(_boxes(s, *far, "k0"), "boxes") if far else _boxes(s, "k0")
    # Many rows share one place; each place is measured once.
    placed = points.select("px", "py").distinct().select("px", "py", F.floor(px / TOGETHER).alias("qx"), F.floor(py / TOGETHER).alias("qy"))
    around = lambda low, high: F.struct(*(f(F.col(n)).alias(k) for f, n, k in ((F.min, low[0], "minx"), (F.min, low[1], "miny"), (F.max, high[0], "maxx"), (F.max, high[1], "maxy")))).alias("at")
    groups = placed.groupBy("qx", "qy").agg(around(("px", "py"), ("px", "py")))
    wide = groups.groupBy(F.floor(F.col("qx") / WIDE).alias("qx"), F.floor(F.col("qy") / WIDE).alias("qy")).agg(around(("at.minx", "at.miny"), ("at.maxx", "at.maxy")))
    at = F.col("at")

    def judged(rows: DataFrame, box: str) -> DataFrame:
        """Bounds of one box for each row, without those out of reach."""
        possible, lb, ub = reach.bounds(at, F.col(box))
        return _prune(rows.filter(possible).select("qx", "qy", "at", box, lb.alias("lb"), ub.alias("ub"), "best"))

    def opened(rows: DataFrame, kids: str, where: Column) -> DataFrame:
        """A row for each kid of the list that may still hold the nearest shape."""

        def measured(c: Column) -> Column:
            ok, near, far = reach.bounds(where, c)
            return F.struct(c.alias("kid"), ok.alias("ok"), near.alias("lb"), far.alias("ub"))

        return (
            rows.withColumn("kids", F.filter(F.transform(kids, measured), lambda k: k.ok))
            .withColumn("best", F.least("best", F.array_min(F.transform("kids", lambda k: k.ub))))
            .withColumn("kid", F.explode(F.filter("kids", lambda k: k.lb <= F.col("best") + SLACK)))
        )

    def descended(rows: DataFrame) -> DataFrame:
        kids = opened(rows, "children", at)
        return _prune(kids.select("qx", "qy", "at", F.col("kid.kid").alias("child"), F.col("kid.lb").alias("lb"), F.col("kid.ub").alias("ub"), "best"))

    def split(rows: DataFrame, parts: DataFrame) -> DataFrame:
        """The parts of the cells of points go on with the cells of shapes that these have kept."""
        few = rows.select(F.col("qx").alias("wx"), F.col("qy").alias("wy"), "child", "best")
        parts = parts.withColumns({"wx": F.floor(F.col("qx") / WIDE), "wy": F.floor(F.col("qy") / WIDE)})
        return judged(parts.join(few, ["wx", "wy"]), "child")

    listed = lambda key: F.collect_list(F.struct(F.col(key).alias("key"), *BOX)).alias("children")
    unbound = F.lit(float("inf"))
    if far:
        # No limit tells which cells are near, so the points of a cell of the first level start from the few cells of the whole extent.
        blocks = wide.groupBy(F.floor(F.col("qx") / WIDE).alias("qx"), F.floor(F.col("qy") / WIDE).alias("qy")).agg(around(("at.minx", "at.miny"), ("at.maxx", "at.maxy")))
        frontier = descended(blocks.withColumns({"children": _boxes(top, far[0]).agg(listed(far[0])).scalar(), "best": unbound}))
    else:
        mx, my = reach.margins(F.col("miny"), F.col("maxy"))
        cover = (
            top.withColumn("gx", F.explode(F.sequence(F.floor((F.col("minx") - mx) / size), F.floor((F.col("maxx") + mx) / size))))
            .withColumn("gy", F.explode(F.sequence(F.floor((F.col("miny") - my) / size), F.floor((F.col("maxy") + my) / size))))
            .select("gx", "gy", F.struct(F.col("k0").alias("key"), *BOX).alias("child"))
        )
        near = wide.withColumns({"gx": F.floor(at.minx / size), "gy": F.floor(at.miny / size), "best": unbound})
        frontier = judged(near.join(cover, ["gx", "gy"]), "child")
    frontier = frontier.withColumn("node", F.col("child.key"))

    for above, below in zip(chain, chain[1:]):
        children = _boxes(top if above in far else s, below, above).groupBy(F.col(above).alias("node")).agg(listed(below))
        frontier = descended(frontier.join(children, "node"))
        if below == "k0":
            frontier = split(frontier, wide)
        if below == "k1":
            frontier = split(frontier, groups)
        frontier = frontier.withColumn("node", F.col("child.key"))

    leaf = s.select(F.col(f"k{len(LEVELS) - 1}").alias("node"), F.struct("shape_key", *BOX).alias("shape"))
    left = judged(frontier.join(leaf, "node"), "shape")
    order = F.row_number().over(Window.partitionBy("qx", "qy").orderBy("lb", "shape"))
    lists = left.withColumn("piece", F.floor((order - 1) / PIECE)).groupBy("qx", "qy", "piece").agg(F.collect_list("shape").alias("shapes"))
    here = F.struct(px.alias("minx"), py.alias("miny"), px.alias("maxx"), py.alias("maxy"))
    met = spread(placed, "qx", "qy").join(lists, ["qx", "qy"]).withColumns({"here": here, "best": F.lit(float("inf"))})
    wanted = opened(met, "shapes", F.col("here")).select("px", "py", "kid.kid.*")

    sx, sy = geo.metre_scale(py)
    one = F.lit(1.0)
    own = s.select("shape_key", "shape_id", geo.shape_edges(F.col("shape")).alias("edges"))
    candidates = spread(wanted.select("px", "py", "shape_key"), "shape_key").join(own, "shape_key")
    inside = geo.covered_by_edges(px, py, F.col("edges"))
    zero = F.lit(0.0)
    measured_rows = geo.computed_once(
        geo.computed_once(candidates.select("px", "py", "shape_id", "edges"), inside=inside),
        distance_deg=F.when(F.col("inside"), zero).otherwise(geo.edges_distance(px, py, F.col("edges"), one, one)),
        distance_m=F.when(F.col("inside"), zero).otherwise(geo.edges_distance(px, py, F.col("edges"), sx, sy)),
    )
    if reach.within_deg is not None:
        measured_rows = measured_rows.filter(F.col("distance_deg") <= reach.within_deg)
    if reach.within_m is not None:
        measured_rows = measured_rows.filter(F.col("distance_m") <= reach.within_m)
    rank = F.struct(F.rint(F.col("distance_deg") * 1e9).alias("r"), "shape_id", "distance_deg", "distance_m")
    found = measured_rows.groupBy("px", "py").agg(F.min(rank).alias("m"))
    best = points.select("pid", "px", "py").join(found, ["px", "py"]).groupBy("pid").agg(F.min("m").alias("m")).select("pid", "m.shape_id", "m.distance_deg", "m.distance_m")
    return best if exact_m is None else best.filter(F.col("distance_m") <= exact_m)

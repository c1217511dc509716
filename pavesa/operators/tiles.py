"""Features to map tiles, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pavesa.constants import MERCATOR_HALF_M
from pavesa.functions import geo
from pavesa.operators import shapes

EXTENT, BUFFER = 4096, 64


def tile_units(line: Column, zoom: Column) -> Column:
    """Vertices in tile units of a zoom: the tile (x, y) is the unit square at (x, y)."""
    side = F.pow(F.lit(2.0), zoom)

    def convert(p: Column) -> Column:
        r = F.radians(p.y)
        ty = (1 - F.log(F.tan(r) + 1 / F.cos(r)) / 3.141592653589793) / 2 * side
        return F.struct(((p.x + 180.0) / 360.0 * side).alias("x"), ty.alias("y"))

    return F.transform(line, convert)


def to_tiles(features: DataFrame, geometry: str, closed: bool = True, tolerance_m: Column | None = None) -> DataFrame:
    """One row per feature and tile it truly touches; ``zoom`` is a column of the input.

    ``geometry`` is a line, or a ``shape`` when closed; ``tile_geom`` is then the list of its rings. With a tolerance (metres of
    the map plane) ``tile_geom`` is simplified; the tiles are still those of the whole geometry.
    """
    units = lambda line: tile_units(line, F.col("zoom"))
    placed = geo.computed_once(features, tile_geom=F.transform(F.flatten(geometry), units) if closed else units(F.col(geometry))).drop(geometry)
    edges = F.flatten(F.transform("tile_geom", geo.ring_edges)) if closed else geo.ring_edges(F.col("tile_geom"))
    rows = geo.computed_once(geo.computed_once(placed, _e=edges), _runs=cover(F.col("_e"), closed)).drop("_e")
    if tolerance_m is not None:
        share = tolerance_m / (2 * MERCATOR_HALF_M) * F.pow(F.lit(2.0), F.col("zoom"))
        rows = shapes.simplify_lines(rows.withColumn("_tolerance", share), "tile_geom", "_tolerance").drop("_tolerance")
    runs = rows.withColumn("_run", F.explode("_runs")).drop("_runs")
    return runs.withColumn("x", F.col("_run.x")).withColumn("y", F.explode(F.sequence("_run.first", "_run.last"))).drop("_run")


def cover(edges: Column, closed: bool = True) -> Column:
    """Unit squares that edges reach into, with those inside when closed: runs ``(x, first, last)`` of squares in one column.

    Each edge gives its own squares, column by column, so the work follows the border and not the bounding box. Between two runs of a
    column no edge passes, so one point decides about the whole gap, which becomes one run however long it is.
    """

    def reached(e: Column) -> Column:
        flat = e.x1 == e.x2
        slope = (e.y2 - e.y1) / F.nullif(e.x2 - e.x1, F.lit(0.0))
        low_x, high_x = F.least(e.x1, e.x2), F.greatest(e.x1, e.x2)
        low_y, high_y = F.least(e.y1, e.y2), F.greatest(e.y1, e.y2)

        def column(x: Column) -> Column:
            at = lambda v: F.least(F.greatest(e.y1 + (v - e.x1) * slope, low_y), high_y)
            start, end = at(F.greatest(x.cast("double"), low_x)), at(F.least(x + 1.0, high_x))
            first = F.when(flat, low_y).otherwise(F.least(start, end))
            last = F.when(flat, high_y).otherwise(F.greatest(start, end))
            return F.struct(x.alias("x"), F.floor(first).alias("first"), F.floor(last).alias("last"))

        return F.transform(F.sequence(F.floor(low_x), F.floor(high_x)), column)

    def columns(runs: Column) -> Column:
        """Sorted runs as a list for each x."""
        begins = F.filter(F.transform(runs, lambda r, k: F.when((k == 0) | (F.get(runs, k - 1).x != r.x), k)), lambda k: k.isNotNull())
        return _stretches(begins, F.size(runs), lambda k, end: F.slice(runs, k + 1, end - k))

    def joined(runs: Column) -> Column:
        """Sorted runs of one column, those that meet or overlap made one; the state is (done runs, open run)."""
        start = F.struct(F.slice(runs, 1, 0).alias("done"), runs[0].alias("open"))

        def step(s: Column, r: Column) -> Column:
            longer = F.struct(s.open.x.alias("x"), s.open.first.alias("first"), F.greatest(s.open.last, r.last).alias("last"))
            return F.when(r.first <= s.open.last + 1, F.struct(s.done.alias("done"), longer.alias("open"))).otherwise(
                F.struct(F.concat(s.done, F.array(s.open)).alias("done"), r.alias("open"))
            )

        return F.aggregate(runs, start, step, lambda s: F.concat(s.done, F.array(s.open)))

    def with_gaps(runs: Column) -> Column:
        def gap(r: Column, k: Column) -> Column:
            after = F.get(runs, k + 1)
            inside = geo.covered_by_edges(r.x.cast("double"), (r.last + 1).cast("double"), edges)
            return F.when(after.isNotNull() & inside, F.struct(r.x.alias("x"), (r.last + 1).alias("first"), (after.first - 1).alias("last")))

        return F.concat(runs, F.filter(F.transform(runs, gap), lambda g: g.isNotNull()))

    # Lists of one element bind what comes before to a variable, so that it is computed once.
    sorted_ = F.array(F.sort_array(F.flatten(F.transform(edges, reached))))
    merged = F.transform(F.flatten(F.transform(sorted_, columns)), joined)
    return F.flatten(F.transform(merged, with_gaps) if closed else merged)


def _stretches(begins: Column, n: Column, make) -> Column:
    """``make(begin, end)`` for each stretch of a list of ``n`` that begins at one of ``begins``.

    Begins and ends are zipped, as a look at the next begin from within a lambda would compute all of them again each time.
    """
    ends = F.concat(F.slice(begins, F.lit(2), F.size(begins)), F.array(n))
    return F.filter(F.zip_with(begins, ends, lambda k, end: F.when(k.isNotNull(), make(k, end))), lambda made: made.isNotNull())


def settlement_tolerance(zoom: Column) -> Column:
    """Simplification tolerance in metres: a share of a pixel that falls with the zoom."""
    factor = F.when(zoom <= 8, 0.35).when(zoom <= 10, 0.18).when(zoom <= 12, 0.08).otherwise(0.03)
    return F.when(zoom >= 15, 0.0).otherwise(F.lit(156543.03392804097) / F.pow(F.lit(2.0), zoom) * factor)


def clip(rows: DataFrame, rings: str, lo: float, hi: float) -> DataFrame:
    """Clip a column of rings to the square [lo, hi] x [lo, hi], one side after the other.

    Each side is its own column step: nesting the four would multiply the expression.
    """
    for axis, bound, sign in (("x", lo, 1), ("x", hi, -1), ("y", lo, 1), ("y", hi, -1)):
        rows = rows.withColumn(rings, F.transform(rings, lambda r: _clip_side(r, axis, bound, sign)))
        rows = rows.withColumn(rings, F.transform(rings, lambda r: F.concat(r, F.slice(r, 1, 1))))
    return rows


def _clip_side(ring: Column, axis: str, bound: float, sign: int) -> Column:
    def depth(p: Column) -> Column:
        return (p[axis] - bound) * sign

    def walk(e: Column) -> Column:
        a = F.struct(e.x1.alias("x"), e.y1.alias("y"))
        b = F.struct(e.x2.alias("x"), e.y2.alias("y"))
        share = depth(a) / F.nullif(depth(a) - depth(b), F.lit(0.0))
        cut = F.struct((a.x + (b.x - a.x) * share).alias("x"), (a.y + (b.y - a.y) * share).alias("y"))
        inside_a, inside_b = depth(a) >= 0, depth(b) >= 0
        none = F.slice(F.array(b), 1, 0)
        return (
            F.when(inside_a & inside_b, F.array(b)).when(inside_a, F.array(cut)).when(inside_b, F.array(cut, b)).otherwise(none)
        )

    # A ring on the inner side gives the end of each edge, without a look at its edges; most rings lie within their tile.
    ends = F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0)))
    return F.when(F.forall(ring, lambda p: depth(p) >= 0), ends).otherwise(F.flatten(F.transform(geo.ring_edges(ring), walk)))


def clip_line(line: Column, lo: float, hi: float) -> Column:
    """Pieces of a line inside the square [lo, hi] x [lo, hi], in order; a line that leaves and comes back gives several."""

    def span(start: Column, step: Column) -> tuple[Column, Column]:
        a, b = (lo - start) / F.nullif(step, F.lit(0.0)), (hi - start) / F.nullif(step, F.lit(0.0))
        inside = start.between(lo, hi)
        enter = F.when(step == 0, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(a, b))
        return enter, F.when(step == 0, 1.0).otherwise(F.greatest(a, b))

    def within(e: Column, i: Column) -> Column:
        (in_x, out_x), (in_y, out_y) = span(e.x1, e.x2 - e.x1), span(e.y1, e.y2 - e.y1)
        return F.struct(i.alias("i"), *(e[n].alias(n) for n in ("x1", "y1", "x2", "y2")),
                        F.greatest(in_x, in_y, F.lit(0.0)).alias("enter"), F.least(out_x, out_y, F.lit(1.0)).alias("leave"))

    def at(e: Column, share: str) -> Column:
        part = lambda a, b: F.when(e[share] == 0, e[a]).when(e[share] == 1, e[b]).otherwise(e[a] + (e[b] - e[a]) * e[share])
        return F.struct(part("x1", "x2").alias("x"), part("y1", "y2").alias("y"))

    def pieces(kept: Column) -> Column:
        n = F.size(kept)
        begins = F.filter(
            F.transform(kept, lambda e, k: F.when((k == 0) | (e.enter > 0) | (F.get(kept, k - 1).i != e.i - 1), k)), lambda k: k.isNotNull()
        )

        def piece(k: Column, end: Column) -> Column:
            return F.concat(F.array(at(kept[k], "enter")), F.transform(F.slice(kept, k + 1, end - k), lambda e: at(e, "leave")))

        return _stretches(begins, n, piece)

    kept = F.filter(F.transform(geo.ring_edges(line), within), lambda e: e.enter <= e.leave)
    # A list of one element binds the kept edges to a variable, so that they are computed once.
    return F.flatten(F.transform(F.array(kept), pieces))


def _on_grid(p: Column) -> Column:
    return F.struct(((p.x - F.col("x")) * EXTENT).alias("x"), ((p.y - F.col("y")) * EXTENT).alias("y"))


def _snapped(p: Column) -> Column:
    return F.struct(F.rint(p.x).cast("int").alias("x"), F.rint(p.y).cast("int").alias("y"))


def quantise_lines(tiled: DataFrame) -> DataFrame:
    """``grid``: pieces of the line ``tile_geom`` on the integer grid, clipped to the buffered tile; pieces of one point are dropped,
    and so are rows without a piece."""
    cut = clip_line(F.transform("tile_geom", _on_grid), float(-BUFFER), float(EXTENT + BUFFER))
    whole = F.filter(F.transform(F.transform(cut, lambda r: F.transform(r, _snapped)), _without_repeats), lambda r: F.size(r) > 1)
    return geo.computed_once(tiled, grid=whole).filter("size(grid) > 0")


def quantise(tiled: DataFrame) -> DataFrame:
    """``grid``: rings on the integer grid, clipped to the buffered tile; vanished rings, and shapes without any, are dropped.

    ``tile_geom`` is a list of rings, or one ring, which gives one ring.
    """
    single = isinstance(tiled.schema["tile_geom"].dataType.elementType, T.StructType)
    rings = F.array("tile_geom") if single else F.col("tile_geom")
    rows = clip(tiled.withColumn("grid", F.transform(rings, lambda r: F.transform(r, _on_grid))), "grid", float(-BUFFER), float(EXTENT + BUFFER))
    out = rows.withColumn("grid", F.transform("grid", lambda r: F.transform(r, _snapped))).withColumn("grid", F.transform("grid", _without_repeats))

    def solid(ring: Column) -> Column:
        turns = F.transform(geo.ring_edges(ring), lambda e: (e.x1 * e.y2 - e.x2 * e.y1).cast("bigint"))
        return (F.size(ring) >= 4) & (F.aggregate(turns, F.lit(0).cast("bigint"), lambda s, v: s + v) != 0)

    # An outer explode keeps the test above the clipping steps; a plain filter would be pushed
    # down through them and copy their expressions many times over.
    left = F.filter("grid", solid)
    if single:
        return out.withColumn("grid", F.explode_outer(left)).filter("grid IS NOT NULL")
    kept = out.withColumn("grid", F.explode_outer(F.array(left)))
    return kept.filter("size(grid) > 0")


def _without_repeats(points: Column) -> Column:
    return F.filter(points, lambda p, i: (i == 0) | (p != F.get(points, i - 1)))


def rings_text(rings: Column) -> Column:
    """Integer rings as text, ``x y,x y;...``, each from its smallest vertex on, so that equal rings read alike."""

    def from_smallest(ring: Column) -> Column:
        open_ = F.slice(ring, F.lit(1), F.size(ring) - 1)
        at = F.array_position(open_, F.array_min(open_)).cast("int")
        turned = F.concat(F.slice(open_, at, F.size(open_)), F.slice(open_, F.lit(1), at))
        return F.array_join(F.transform(turned, lambda p: F.concat_ws(" ", p.x, p.y)), ",")

    return F.array_join(F.transform(rings, from_smallest), ";")


def lines_text(pieces: Column) -> Column:
    """Integer pieces as text, ``x y,x y;...``, in the direction of the line."""
    return F.array_join(F.transform(pieces, lambda r: F.array_join(F.transform(r, lambda p: F.concat_ws(" ", p.x, p.y)), ",")), ";")


def write_tiles(rows: DataFrame, path: str) -> None:
    """Tile rows as Parquet by ``zoom`` and ``strip`` (at most 32 ranges of x), by tile inside the files, so that a tile reads few of them."""
    strip = F.expr("shiftright(cast(x as bigint), cast(greatest(zoom - 5, 0) as int))")
    placed = rows.withColumn("strip", strip).hint("rebalance", "zoom", "strip")
    placed.sortWithinPartitions("zoom", "strip", "x", "y").write.partitionBy("zoom", "strip").parquet(path)

"""Geometry as plain columns: points are (lon, lat) doubles, rings are array<struct<x,y>>, shapes are polygons of rings.

A shape is an array of parts, a part an array of rings: its border, then its holes. ``oriented`` turns borders counterclockwise and holes
clockwise, so signed sums over all edges give area and centroid. Parts of one shape don't overlap.

Everything here is a pure Column expression, so it stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pavesa.constants import AUTHALIC_RADIUS_M, EARTH_RADIUS_M, MERCATOR_HALF_M

M_PER_DEG = EARTH_RADIUS_M * 3.141592653589793 / 180.0


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_ring(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    return F.array(point(minx, miny), point(maxx, miny), point(maxx, maxy), point(minx, maxy), point(minx, miny))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def ring_edges(ring: Column) -> Column:
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(
        F.slice(ring, F.lit(1), n),
        F.slice(ring, F.lit(2), n),
        lambda a, b: F.struct(a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2")),
    )


def metre_scale(lat: Column) -> tuple[Column, Column]:
    """Local plane at a latitude: metres per degree of longitude and of latitude."""
    return F.cos(F.radians(lat)) * M_PER_DEG, F.lit(M_PER_DEG)


def segment_distance(px, py, x1, y1, x2, y2, sx, sy) -> Column:
    ax, ay = (x1 - px) * sx, (y1 - py) * sy
    dx, dy = (x2 - x1) * sx, (y2 - y1) * sy
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / length2))).otherwise(0.0)
    ex, ey = ax + t * dx, ay + t * dy
    return F.sqrt(ex * ex + ey * ey)


def edge_crossed(px, py, e) -> Column:
    """True when a ray to the east from the point crosses the edge."""
    straddles = (e.y1 > py) != (e.y2 > py)
    at = (e.x2 - e.x1) * (py - e.y1) / F.nullif(e.y2 - e.y1, F.lit(0.0)) + e.x1
    return straddles & (px < at)


def on_edge(px, py, e) -> Column:
    cross = (e.x2 - e.x1) * (py - e.y1) - (e.y2 - e.y1) * (px - e.x1)
    return (
        (cross == 0)
        & px.between(F.least(e.x1, e.x2), F.greatest(e.x1, e.x2))
        & py.between(F.least(e.y1, e.y2), F.greatest(e.y1, e.y2))
    )


def covered_by_edges(px: Column, py: Column, edges: Column) -> Column:
    """Even-odd test over any set of ring edges; a point on an edge counts as inside."""
    crossings = F.aggregate(edges, F.lit(0), lambda n, e: n + F.when(edge_crossed(px, py, e), 1).otherwise(0))
    return ((crossings % 2) == 1) | F.exists(edges, lambda e: on_edge(px, py, e))


def ring_distance(px: Column, py: Column, ring: Column, sx, sy) -> Column:
    edges = ring_edges(ring)
    outside = F.array_min(
        F.transform(edges, lambda e: segment_distance(px, py, e.x1, e.y1, e.x2, e.y2, sx, sy))
    )
    return F.when(covered_by_edges(px, py, edges), F.lit(0.0)).otherwise(outside)


def line_distance(px: Column, py: Column, line: Column, sx, sy) -> Column:
    return F.array_min(
        F.transform(ring_edges(line), lambda e: segment_distance(px, py, e.x1, e.y1, e.x2, e.y2, sx, sy))
    )


def edges_touch(ea: Column, eb: Column) -> Column:
    """Two simple rings, given by their edges, touch or overlap."""
    return (
        F.exists(ea, lambda e: covered_by_edges(e.x1, e.y1, eb))
        | F.exists(eb, lambda e: covered_by_edges(e.x1, e.y1, ea))
        | F.exists(ea, lambda p: F.exists(eb, lambda q: segments_cross(p, q)))
    )


def edges_gap(ea: Column, eb: Column, sx, sy) -> Column:
    """Smallest vertex-to-edge distance between two disjoint rings.

    Pass stored edge columns: an edge expression would be rebuilt for every vertex.
    """

    def nearest(vertices: Column, edges: Column) -> Column:
        return F.array_min(
            F.transform(
                vertices,
                lambda v: F.array_min(
                    F.transform(edges, lambda e: segment_distance(v.x1, v.y1, e.x1, e.y1, e.x2, e.y2, sx, sy))
                ),
            )
        )

    return F.least(nearest(ea, eb), nearest(eb, ea))


def edges_distance(px: Column, py: Column, edges: Column, sx, sy) -> Column:
    return F.array_min(F.transform(edges, lambda e: segment_distance(px, py, e.x1, e.y1, e.x2, e.y2, sx, sy)))


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns so that later filters on them stay above.

    A plain projection would let the optimizer push such a filter below it and evaluate the
    expression twice.
    """
    packed = F.explode(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))).alias("_once")
    return df.select("*", packed).select(*df.columns, "_once.*")


def _side(ax, ay, bx, by, cx, cy) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def segments_cross(p, q) -> Column:
    """Proper crossing of two edges."""
    return (
        _side(p.x1, p.y1, p.x2, p.y2, q.x1, q.y1) * _side(p.x1, p.y1, p.x2, p.y2, q.x2, q.y2) < 0
    ) & (_side(q.x1, q.y1, q.x2, q.y2, p.x1, p.y1) * _side(q.x1, q.y1, q.x2, q.y2, p.x2, p.y2) < 0)


def ring_bbox(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p.x), F.transform(ring, lambda p: p.y)
    return F.struct(
        F.array_min(xs).alias("minx"),
        F.array_min(ys).alias("miny"),
        F.array_max(xs).alias("maxx"),
        F.array_max(ys).alias("maxy"),
    )


def box_overlaps(minx, miny, maxx, maxy, box) -> Column:
    bminx, bminy, bmaxx, bmaxy = box
    return (minx <= bmaxx) & (maxx >= bminx) & (miny <= bmaxy) & (maxy >= bminy)


def edge_meets_box(e: Column, minx, miny, maxx, maxy) -> Column:
    """The stretch of the edge inside both axis ranges is not empty."""

    def span(start: Column, step: Column, lo, hi) -> tuple[Column, Column]:
        inf = float("inf")
        a, b = (lo - start) / F.nullif(step, F.lit(0.0)), (hi - start) / F.nullif(step, F.lit(0.0))
        still = start.between(lo, hi)
        enter = F.when(step == 0, F.when(still, F.lit(-inf)).otherwise(F.lit(inf))).otherwise(F.least(a, b))
        leave = F.when(step == 0, F.when(still, F.lit(inf)).otherwise(F.lit(-inf))).otherwise(F.greatest(a, b))
        return enter, leave

    in_x, out_x = span(e.x1, e.x2 - e.x1, minx, maxx)
    in_y, out_y = span(e.y1, e.y2 - e.y1, miny, maxy)
    return F.greatest(in_x, in_y, F.lit(0.0)) <= F.least(out_x, out_y, F.lit(1.0))


def edges_meet_box(edges: Column, box, closed: bool = True) -> Column:
    """Exact shape-envelope test: an edge reaches into the box, or the box lies inside the ring."""
    minx, miny, maxx, maxy = [v if isinstance(v, Column) else F.lit(float(v)) for v in box]
    met = F.exists(edges, lambda e: edge_meets_box(e, minx, miny, maxx, maxy))
    return met | covered_by_edges(minx, miny, edges) if closed else met


def ring_meets_box(ring: Column, box, closed: bool = True) -> Column:
    return edges_meet_box(ring_edges(ring), box, closed)


def mercator_x(lon: Column) -> Column:
    return lon / 180.0 * MERCATOR_HALF_M


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.radians(lat) / 2 + 3.141592653589793 / 4)) / 3.141592653589793 * MERCATOR_HALF_M


def mercator_lon(x: Column) -> Column:
    return x / MERCATOR_HALF_M * 180.0


def mercator_lat(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / MERCATOR_HALF_M * 3.141592653589793)) - 3.141592653589793 / 2)


def tile_lon(tile_x: Column, zoom) -> Column:
    return tile_x / F.pow(F.lit(2.0), zoom) * 360.0 - 180.0


def tile_lat(tile_y: Column, zoom) -> Column:
    merc = 3.141592653589793 * (1 - 2 * tile_y / F.pow(F.lit(2.0), zoom))
    return F.degrees(F.atan(F.sinh(merc)))


def tile_x(lon: Column, zoom) -> Column:
    return F.floor((lon + 180.0) / 360.0 * F.pow(F.lit(2.0), zoom)).cast("int")


def tile_y(lat: Column, zoom) -> Column:
    r = F.radians(lat)
    return F.floor(
        (1 - F.log(F.tan(r) + 1 / F.cos(r)) / 3.141592653589793) / 2 * F.pow(F.lit(2.0), zoom)
    ).cast("int")


def ring_centroid(ring: Column) -> Column:
    return _edges_centroid(ring_edges(ring), ring[0])


def _edges_centroid(edges: Column, first: Column) -> Column:
    """Area-weighted centroid, computed around one vertex to keep precision."""
    acc = F.aggregate(
        edges,
        F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy")),
        lambda s, e: F.struct(
            (s.a + _turn(e, first)).alias("a"),
            (s.cx + (e.x1 + e.x2 - 2 * first.x) * _turn(e, first)).alias("cx"),
            (s.cy + (e.y1 + e.y2 - 2 * first.y) * _turn(e, first)).alias("cy"),
        ),
        lambda s: F.struct(
            (first.x + s.cx / (3 * F.nullif(s.a, F.lit(0.0)))).alias("x"),
            (first.y + s.cy / (3 * F.nullif(s.a, F.lit(0.0)))).alias("y"),
        ),
    )
    return acc


def with_shape(df: DataFrame) -> DataFrame:
    """A frame with ``shape``; a plain ``ring`` becomes a shape of one part without holes."""
    return df if "shape" in df.columns else df.withColumn("shape", F.array(F.array("ring"))).drop("ring")


def ring_turn(ring: Column) -> Column:
    """Twice the signed area: above zero when the ring runs counterclockwise."""
    first = ring[0]
    return F.aggregate(ring_edges(ring), F.lit(0.0), lambda s, e: s + _turn(e, first))


def oriented(shape: Column) -> Column:
    """Borders counterclockwise, holes clockwise."""
    turned = lambda r, i: F.when((ring_turn(r) > 0) == (i == 0), r).otherwise(F.reverse(r))
    return F.transform(shape, lambda part: F.transform(part, turned))


def shape_edges(shape: Column) -> Column:
    """Edges of all rings. Crossings over all of them tell inside from outside, holes and islands included."""
    return F.flatten(F.transform(F.flatten(shape), ring_edges))


def shape_bbox(shape: Column) -> Column:
    return ring_bbox(F.flatten(F.flatten(shape)))


def shape_distance(px: Column, py: Column, shape: Column, sx, sy) -> Column:
    edges = shape_edges(shape)
    return F.when(covered_by_edges(px, py, edges), F.lit(0.0)).otherwise(edges_distance(px, py, edges, sx, sy))


def shape_meets_box(shape: Column, box) -> Column:
    return edges_meet_box(shape_edges(shape), box)


def shape_area_ha(shape: Column) -> Column:
    """Hectares of all parts less their holes; the shape is ``oriented``."""
    return _edges_area_ha(shape_edges(shape))


def shape_centroid(shape: Column) -> Column:
    """Centroid by area over all parts; the shape is ``oriented``."""
    return _edges_centroid(shape_edges(shape), shape[0][0][0])


def _parts_text(shape: Column, number) -> Column:
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, number), ", "), F.lit(")"))
    return F.transform(shape, lambda part: F.concat(F.lit("("), F.array_join(F.transform(part, ring), ", "), F.lit(")")))


def shape_wkt(shape: Column) -> Column:
    parts = _parts_text(shape, lambda p: F.format_string("%.8f %.8f", p.x, p.y))
    return F.when(F.size(shape) == 1, F.concat(F.lit("POLYGON"), parts[0])).otherwise(F.concat(F.lit("MULTIPOLYGON("), F.array_join(parts, ", "), F.lit(")")))


def shape_geojson(shape: Column) -> Column:
    parts = F.transform(shape, lambda part: F.transform(part, lambda r: F.transform(r, lambda p: F.array(p.x, p.y))))
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), parts[0].alias("coordinates")))
    return F.when(F.size(shape) == 1, one).otherwise(F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), parts.alias("coordinates"))))


def _turn(e, o) -> Column:
    return (e.x1 - o.x) * (e.y2 - o.y) - (e.x2 - o.x) * (e.y1 - o.y)


def ring_area_ha(ring: Column) -> Column:
    return _edges_area_ha(ring_edges(ring))


def _edges_area_ha(edges: Column) -> Column:
    """Area on the authalic sphere in hectares (equal-area cylinder, exact for its edges)."""
    total = F.aggregate(
        edges,
        F.lit(0.0),
        lambda acc, e: acc
        + F.radians(e.x2 - e.x1) * (F.sin(F.radians(e.y1)) + F.sin(F.radians(e.y2))) / 2,
    )
    return F.abs(total) * AUTHALIC_RADIUS_M * AUTHALIC_RADIUS_M / 10000.0


def ring_wkt(ring: Column) -> Column:
    body = F.array_join(F.transform(ring, lambda p: F.format_string("%.8f %.8f", p.x, p.y)), ", ")
    return F.concat(F.lit("POLYGON(("), body, F.lit("))"))

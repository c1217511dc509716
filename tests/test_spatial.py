"""Spatial operators against brute force on small frames, with crowded places."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from pavesa.functions import geo
from pavesa.operators import cluster, nearest, regions, shapes, spatial, tiles
from pavesa.plans import spatial_queries
from pavesa.plans.catalog import tile_queries
from pavesa.sources.bridge import Tables

RING = "array<struct<x:double,y:double>>"


def square(x, y, h):
    return [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h), (x - h, y - h)]


def box_gap(px, py, x, y, h, sx=1.0, sy=1.0):
    dx, dy = max(abs(px - x) - h, 0) * sx, max(abs(py - y) - h, 0) * sy
    return math.hypot(dx, dy)


def test_nearest_matches_brute_force_with_copies(spark):
    rng = random.Random(7)
    shapes_in = [(i, rng.uniform(-4, -3), rng.uniform(40, 41), rng.choice([0.001, 0.004])) for i in range(150)]
    shapes_in += [(1000 + i, -3.5, 40.5, 0.002) for i in range(60)]
    shapes_in += [(2000 + i, -3.5 + i * 1e-6, 40.5, 0.002) for i in range(60)]
    points = [(i, rng.uniform(-4.1, -2.9), rng.uniform(39.9, 41.1)) for i in range(300)]
    points += [(500 + i, -3.51, 40.51) for i in range(100)]
    s = spark.createDataFrame([(i, square(x, y, h)) for i, x, y, h in shapes_in], f"shape_id bigint, ring {RING}")
    p = spark.createDataFrame(points, "pid bigint, px double, py double")
    got = {r["pid"]: r["shape_id"] for r in nearest.nearest_shape(p, s, nearest.Reach(within_deg=0.08)).collect()}
    live = {r["pid"]: r["shape_id"] for r in nearest.nearest_shape(p, s, nearest.Reach(within_m=5000.0, box_deg=0.06)).collect()}
    want, want_live = {}, {}
    for pid, px, py in points:
        ranked = sorted((round(box_gap(px, py, x, y, h) * 1e9), i, x, y, h) for i, x, y, h in shapes_in)
        if ranked[0][0] <= 0.08e9:
            want[pid] = ranked[0][1]
        sx, sy = math.cos(math.radians(py)) * geo.M_PER_DEG, geo.M_PER_DEG
        for _, i, x, y, h in ranked:
            if box_gap(px, py, x, y, h, sx, sy) <= 5000 and abs(px - x) <= h + 0.06 and abs(py - y) <= h + 0.06:
                want_live[pid] = i
                break
    assert got == want
    assert live == want_live


def brute_dbscan(points, eps, k):
    xy = np.array([(x, y) for _, x, y in points])
    near = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1)) <= eps
    core = near.sum(1) >= k
    label = [None] * len(points)
    for i in sorted(range(len(points)), key=lambda i: points[i][0]):
        if not core[i] or label[i] is not None:
            continue
        stack, label[i] = [i], points[i][0]
        while stack:
            a = stack.pop()
            for b in np.flatnonzero(near[a] & core):
                if label[b] is None:
                    label[b] = points[i][0]
                    stack.append(b)
    for i in range(len(points)):
        if not core[i]:
            touching = [label[j] for j in np.flatnonzero(near[i] & core)]
            label[i] = min(touching) if touching else None
    order = {v: n for n, v in enumerate(sorted({v for v in label if v is not None}))}
    return {p[0]: (None if v is None else order[v]) for p, v in zip(points, label)}


def test_dbscan_matches_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    points = [(i, rng.uniform(0, 6000), rng.uniform(0, 6000)) for i in range(150)]
    points += [(200 + i, 3000 + rng.gauss(0, 250), 3000 + rng.gauss(0, 250)) for i in range(150)]
    points += [(400 + i, 1234.5, 2345.6) for i in range(40)]
    rng.shuffle(points)
    df = spark.createDataFrame(points, "id bigint, x double, y double")
    want = brute_dbscan(points, 400.0, 4)
    got = {r["id"]: r["cluster_id"] for r in cluster.dbscan(df, 400.0, 4).collect()}
    assert got == want
    monkeypatch.setattr(cluster, "DIRECT_PAIRS", 2)
    again = {r["id"]: r["cluster_id"] for r in cluster.dbscan(df.orderBy("x"), 400.0, 4).collect()}
    assert again == want


def test_connected_components_chain(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("z1", "z2")], "u string, v string")
    roots = {r["node"]: r["root"] for r in cluster.connected_components(edges).collect()}
    assert set(roots.values()) == {"n000", "z1"} and len(roots) == 61


def test_region_with_hole_and_border(spark):
    outer, hole = square(0, 0, 2), square(0, 0, 1)
    sides = [(*a, *b) for ring in (outer, hole) for a, b in zip(ring, ring[1:])]
    edges = spark.createDataFrame([tuple(map(float, s)) for s in sides], "x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(0.0, 0.0), (1.5, 0.3), (2.0, 0.3), (3.0, 0.0), (0.0, 9.0)], "longitude double, latitude double")
    flags = {(r["longitude"], r["latitude"]): r["in_region"] for r in regions.flag_in_region(pts, edges).collect()}
    assert flags == {(0.0, 0.0): False, (1.5, 0.3): True, (2.0, 0.3): True, (3.0, 0.0): False, (0.0, 9.0): False}


def test_pairs_within_counts_each_pair_once(spark):
    zones = spark.createDataFrame([("A", square(0.0, 40.0, 0.6)), ("B", square(3.0, 40.0, 0.2))], f"area_code string, ring {RING}")
    towns = spark.createDataFrame([(1, 10, square(0.1, 40.1, 0.3)), (2, 20, square(0.8, 40.0, 0.05)), (3, 30, square(9.0, 40.0, 0.01))], f"settlement_id bigint, habitantes int, ring {RING}")
    got = {(r["area_code"], r["settlement_id"]): r["distance_m"] for r in spatial.pairs_within(zones, towns, 20000.0, "settlement_id").collect()}
    assert set(got) == {("A", 1), ("A", 2)} and got[("A", 1)] == 0.0
    assert abs(got[("A", 2)] - 0.15 * math.cos(math.radians(40.0)) * geo.M_PER_DEG) < 30


def test_known_haversine(spark):
    d = spark.range(1).select(geo.haversine_m(F.lit(-3.7038), F.lit(40.4168), F.lit(2.1734), F.lit(41.3851)).alias("d")).first()["d"]
    assert abs(d - 505_000) < 2_000


def test_clip_and_vanish(spark):
    rows = spark.createDataFrame([(0, 0, [(-0.5, 0.2), (0.5, 0.2), (0.5, 0.4), (-0.5, 0.4), (-0.5, 0.2)]), (0, 0, square(0.5, 0.5, 1e-6))], f"x int, y int, tile_geom {RING}")
    out = tiles.quantise(rows).select(geo.ring_bbox(F.col("grid")).alias("b")).collect()
    assert len(out) == 1
    assert (out[0]["b"]["minx"], out[0]["b"]["maxx"]) == (-64, 2048)


def test_simplify_keeps_ends_and_tolerance():
    xy = np.array([(0, 0), (1, 0.01), (2, 0), (3, 1), (4, 0)], float)
    assert shapes.simplify_line(xy, 0.1).tolist() == [True, False, True, True, True]
    assert shapes.simplify_line(xy, 5.0).tolist() == [True, False, False, False, True]


def test_cap_on_roads_by_class(spark):
    roads = spark.createDataFrame([(1, "A", [(0.0, 0.0), (0.0, 1.0)]), (2, "B", [(0.005, 0.0), (0.005, 1.0)])], f"id_tramo bigint, clase string, line {RING}")
    near = spatial.roads_near(roads, 0.001, 0.5, 1000.0).orderBy("distance_m").collect()
    assert [(r["id_tramo"], r["distance_m"]) for r in near] == [(1, 111), (2, 445)]
    assert spatial.roads_near(roads, 0.001, 0.5, 1000.0, ["B"]).count() == 1


def test_overlapping_features_are_united_and_holes_stay_out(spark):
    square = lambda part, a, b: [(part, x1, y1, x2, y2) for (x1, y1), (x2, y2) in zip([(a, a), (b, a), (b, b), (a, b)], [(b, a), (b, b), (a, b), (a, a)])]
    edges = spark.createDataFrame(square("p", 0.0, 4.0) + square("p", 1.0, 2.0) + square("q", 3.0, 6.0), "part string, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(0.5, 0.5), (1.5, 1.5), (3.5, 3.5), (5.0, 5.0), (6.5, 5.0), (0.0, 2.0)], "longitude double, latitude double")
    got = {(r["longitude"], r["latitude"]): r["in_region"] for r in regions.flag_in_region(points, edges).collect()}
    assert got == {(0.5, 0.5): True, (1.5, 1.5): False, (3.5, 3.5): True, (5.0, 5.0): True, (6.5, 5.0): False, (0.0, 2.0): True}


SHAPE = f"array<array<{RING}>>"


def odd_shape(x, y, h):
    """A square with a hole of half its width and an island to the north-east."""
    return [[square(x, y, h), square(x, y, h / 2)], [square(x + 3 * h, y + 2 * h, h / 2)]]


def odd_gap(px, py, x, y, h, sx=1.0, sy=1.0):
    in_hole = abs(px - x) < h / 2 and abs(py - y) < h / 2
    main = min((h / 2 - abs(px - x)) * sx, (h / 2 - abs(py - y)) * sy) if in_hole else box_gap(px, py, x, y, h, sx, sy)
    return min(main, box_gap(px, py, x + 3 * h, y + 2 * h, h / 2, sx, sy))


def test_nearest_of_shapes_with_parts_and_holes(spark):
    rng = random.Random(11)
    shapes_in = [(i, rng.uniform(-4, -3), rng.uniform(40, 41), rng.choice([0.01, 0.05])) for i in range(80)]
    points = [(i, rng.uniform(-4.1, -2.9), rng.uniform(39.9, 41.1)) for i in range(300)]
    points += [(1000 + i, x, y) for i, x, y, h in shapes_in] + [(2000 + i, x + 3 * h, y + 2 * h) for i, x, y, h in shapes_in]  # in holes, in islands
    s = spark.createDataFrame([(i, odd_shape(x, y, h)) for i, x, y, h in shapes_in], f"shape_id bigint, shape {SHAPE}")
    p = spark.createDataFrame(points, "pid bigint, px double, py double")
    got = {r["pid"]: (r["shape_id"], round(r["distance_deg"], 9)) for r in nearest.nearest_shape(p, s, nearest.Reach(within_deg=0.08)).collect()}
    want = {}
    for pid, px, py in points:
        rank, i, gap = min((round(odd_gap(px, py, x, y, h) * 1e9), i, odd_gap(px, py, x, y, h)) for i, x, y, h in shapes_in)
        if gap <= 0.08:
            want[pid] = (i, round(gap, 9))
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-8 for k in want)


def test_zone_meets_only_the_island(spark):
    """The middle of a shape with a hole isn't its own: a zone inside the hole is at a distance, one on the island is not."""
    towns = spark.createDataFrame([(1, 10, odd_shape(0.0, 40.0, 0.4))], f"settlement_id bigint, habitantes int, shape {SHAPE}")
    zones = spark.createDataFrame([("hole", square(0.0, 40.0, 0.05)), ("island", square(1.2, 40.8, 0.05)), ("far", square(5.0, 40.0, 0.1))], f"area_code string, ring {RING}")
    got = {r["area_code"]: r["distance_m"] for r in spatial.pairs_within(zones, towns, 20000.0, "settlement_id").collect()}
    assert set(got) == {"hole", "island"} and got["island"] == 0.0
    assert abs(got["hole"] - 0.15 * math.cos(math.radians(40.0)) * geo.M_PER_DEG) < 100


def test_area_centroid_and_text_of_parts(spark):
    wrong_way = [[square(0.0, 0.0, 0.4)[::-1], square(0.0, 0.0, 0.2)], [square(1.2, 0.8, 0.2)[::-1]]]
    df = spark.createDataFrame([(wrong_way,)], f"shape {SHAPE}").withColumn("shape", geo.oriented(F.col("shape")))
    centre = geo.shape_centroid(F.col("shape"))
    row = df.select(centre.x.alias("x"), centre.y.alias("y"), geo.shape_area_ha(F.col("shape")).alias("ha"), geo.shape_wkt(F.col("shape")).alias("wkt"), geo.shape_geojson(F.col("shape")).alias("json")).first()
    assert abs(row["x"] - 0.3) < 1e-12 and abs(row["y"] - 0.2) < 1e-12  # (0.48 * 0 + 0.16 * (1.2, 0.8)) / 0.64
    parts = spark.createDataFrame([(square(0.0, 0.0, 0.4), square(0.0, 0.0, 0.2), square(1.2, 0.8, 0.2))], f"a {RING}, b {RING}, c {RING}").select(*(geo.ring_area_ha(F.col(n)).alias(n) for n in "abc")).first()
    assert abs(row["ha"] - (parts["a"] - parts["b"] + parts["c"])) < 1e-6
    assert row["wkt"].startswith("MULTIPOLYGON(((") and row["wkt"].count("(") == 1 + 2 + 3 and row["json"].startswith('{"type":"MultiPolygon","coordinates":[[[[')


def test_tiles_of_parts(spark):
    """Tiles between the parts are left out, and each ring is clipped for itself."""
    rows = spark.createDataFrame([(1, 8, [[square(0.1, 40.0, 0.05)], [square(9.0, 40.0, 0.05)]])], f"id int, zoom int, shape {SHAPE}")
    out = tiles.quantise(tiles.to_tiles(rows, "shape")).select("x", tiles.rings_text(F.col("grid")).alias("rings")).collect()
    assert sorted({r["x"] for r in out}) == [128, 134] and all(r["rings"].count(";") == 0 and r["rings"].count(",") == 4 for r in out)


def test_layers_of_covers_leave_few_candidates(spark):
    """100 squares over the same place: only the lowest ids can win, and the answer is that of testing all."""
    rows = [(100 - i, [[square(0.01 * (i % 7), 40.0 + 0.01 * (i % 5), 0.2)]]) for i in range(100)] + [(None, [[square(0.0, 40.0, 0.2)]]), (200, [[square(3.0, 40.0, 0.01)]])]
    covers = spark.createDataFrame(rows, f"shape_id bigint, shape {SHAPE}")
    points = spark.createDataFrame([(0.013 * i - 0.3, 39.7 + 0.017 * (i * 7 % 40)) for i in range(50)] + [(3.0, 40.0)], "px double, py double")
    got = {(r["px"], r["py"]): r["shape_id"] for r in spatial.shape_at_point(points, covers).collect()}
    inside = geo.covered_by_edges(F.col("px"), F.col("py"), geo.shape_edges(F.col("shape")))
    plain = points.distinct().crossJoin(covers).filter(inside).groupBy("px", "py").agg(F.min("shape_id").alias("shape_id"))
    assert got == {(r["px"], r["py"]): r["shape_id"] for r in plain.collect()} and len(got) > 5
    edged = covers.select("shape_id", geo.shape_edges(F.col("shape")).alias("edges"), geo.shape_bbox(F.col("shape")).alias("b"))
    found = spatial.lowest_of_cell(edged, 0.03125).groupBy("gx", "gy").count().filter("gx = 0 AND gy = 1280").collect()
    assert found[0]["count"] <= 2


def test_roads_around_pick_the_line_among_all_rows(spark, tmp_path):
    """The row in the box isn't the one that stands for its id, so the id has no road there; ids without rows in the box are left out."""
    from types import SimpleNamespace

    from pavesa.plans import pipeline

    base = "0 AS id_vial, 'c' AS clased, ' n ' AS nombre, '1' AS ncarriles, 'RT_PROVINCIA_1_gpkg.zip' AS source_zip_name, timestamp'2024-01-01' AS imported_at"
    rows = spark.createDataFrame(
        [(1, 1, 5, [(0.0, 40.0), (0.1, 40.0)]), (1, 2, 1, [(5.0, 40.0), (5.1, 40.0)]), (2, 3, 1, [(0.0, 40.0), (0.0, 40.1)]), (3, 4, 1, [(7.0, 40.0), (7.1, 40.0)])],
        f"id_tramo bigint, source_fid bigint, clase_raw bigint, line {RING}",
    ).selectExpr("*", *base.split(", "))
    box = spatial.box_around(0.0, 40.0, 20000.0)
    around = pipeline.roads_around(SimpleNamespace(spark=spark, road_src=lambda: rows), box)
    assert sorted((r["id_tramo"], r["source_fid"]) for r in around.collect()) == [(1, 2), (2, 3)]
    assert [r["id_tramo"] for r in spatial.roads_near(around, 0.0, 40.0, 20000.0).collect()] == [2]


def test_landcover_hole_and_island(spark):
    covers = spark.createDataFrame([(5, odd_shape(0.0, 40.0, 0.4))], f"shape_id bigint, shape {SHAPE}")
    points = spark.createDataFrame([(0.0, 40.0), (0.3, 40.0), (1.2, 40.8), (0.8, 40.4), (0.2, 40.0)], "px double, py double")
    assert {(r["px"], r["py"]) for r in spatial.shape_at_point(points, covers).collect()} == {(0.3, 40.0), (1.2, 40.8), (0.2, 40.0)}


def test_roads_stored_by_place(spark, tmp_path):
    rng = random.Random(5)
    at = [(i, rng.uniform(-9, 3), rng.uniform(36, 43)) for i in range(4000)]
    roads = spark.createDataFrame([(i, "A", [(x, y), (x + 0.01, y + 0.01)]) for i, x, y in at], f"id_tramo bigint, clase string, line {RING}")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        spatial.store_by_place(roads, "line", str(tmp_path / "roads"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    point, radius = (-3.7, 40.4), 30000.0
    rows = spatial.stored_by_place(spark, str(tmp_path / "roads"), spatial.box_around(*point, radius))
    near = spatial.roads_near(rows, *point, radius)
    assert sorted(r["id_tramo"] for r in near.collect()) == sorted(r["id_tramo"] for r in spatial.roads_near(roads, *point, radius).collect()) != []
    plan = spark._jvm.PythonSQLUtils.explainString(near._jdf.queryExecution(), "formatted")
    assert "LessThanOrEqual(minx," in plan and "GreaterThanOrEqual(maxx," in plan
    # Few files have bounds that meet a small box, more meet a large one.
    import pyarrow.parquet as pq

    def met(box):
        n = 0
        for f in (tmp_path / "roads").glob("*.parquet"):
            g = pq.ParquetFile(f).metadata.row_group(0)
            stat = {c.path_in_schema: c.statistics for c in (g.column(i) for i in range(g.num_columns))}
            n += stat["minx"].min <= box[2] and stat["maxx"].max >= box[0] and stat["miny"].min <= box[3] and stat["maxy"].max >= box[1]
        return n

    files = len(list((tmp_path / "roads").glob("*.parquet")))
    assert met(spatial.box_around(*point, 1000.0)) <= 3 < met(spatial.box_around(*point, 500000.0)) <= files


def plain_simplify(points, tolerance):
    """Douglas-Peucker by recursion; ties go to the first point."""
    if len(points) < 3:
        return points
    (ax, ay), (bx, by) = points[0], points[-1]
    dx, dy = bx - ax, by - ay
    gaps = []
    for x, y in points[1:-1]:
        share = min(max(((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy), 0.0), 1.0) if dx or dy else 0.0
        gaps.append(round(math.hypot(x - ax - share * dx, y - ay - share * dy) / tolerance / 1e-6))
    far = gaps.index(max(gaps)) + 1
    if gaps[far - 1] <= 1e6:
        return [points[0], points[-1]]
    return plain_simplify(points[: far + 1], tolerance)[:-1] + plain_simplify(points[far:], tolerance)


def test_simplified_lines_and_rings(spark):
    rng = random.Random(3)
    lines = [(k, [(float(i), rng.gauss(0, 1)) for i in range(rng.randint(0, 40))], rng.choice([0.3, 1.0, 3.0])) for k in range(60)]
    lines += [(60, None, 1.0), (61, [(0.0, 0.0), (1.0, 0.1), (2.0, 0.0)], 0.0), (62, [(0.0, 0.0), (1.0, 0.1), (2.0, 0.0)], None)]
    df = spark.createDataFrame(lines, f"id int, line {RING}, tolerance double")
    got = {r["id"]: r["line"] and [tuple(p) for p in r["line"]] for r in shapes.simplify_lines(df).collect()}
    assert got[60] is None and len(got[61]) == len(got[62]) == 3
    for k, line, tolerance in lines[:60]:
        assert (got[k] or []) == plain_simplify(line, tolerance), k
    wavy = [(math.cos(a / 50 * math.pi), math.sin(a / 50 * math.pi)) for a in range(100)]
    wavy.append(wavy[0])
    rings = spark.createDataFrame([(1, [wavy, square(0.0, 0.0, 0.01)], 0.1), (2, [], 0.1), (3, None, 0.1)], f"id int, line array<{RING}>, tolerance double")
    out = {r["id"]: r["line"] for r in shapes.simplify_lines(rings).collect()}
    assert 4 <= len(out[1][0]) < 30 and len(out[1][1]) == 5 and out[2] == [] and out[3] is None


def test_line_pieces_in_a_tile(spark):
    """A line that leaves the tile and comes back gives several pieces; one that only touches a corner of the buffer gives none."""
    rows = [
        (1, 0, 0, [(-0.5, 0.25), (0.5, 0.25), (0.5, 2.0), (0.75, 2.0), (0.75, 0.5)]),
        (2, 0, 0, [(3.0, 3.0), (4.0, 4.0)]),
        (3, 0, 0, [(-1.0, 0.5), (2.0, 0.5)]),
        (4, 0, 0, [(0.25, 0.25), (0.25, 0.25)]),
        (5, 0, 0, []),
        (6, 0, 0, None),
    ]
    df = spark.createDataFrame(rows, f"id int, x int, y int, tile_geom {RING}")
    got = {r["id"]: r["text"] for r in tiles.quantise_lines(df).select("id", tiles.lines_text(F.col("grid")).alias("text")).collect()}
    assert got == {1: "-64 1024,2048 1024,2048 4160;3072 4160,3072 2048", 3: "-64 2048,4160 2048"}


def test_tiles_written_by_place(spark, tmp_path):
    rows = spark.range(4000).selectExpr("7 + id % 8 AS zoom", "id * 4 AS x", "id % 100 AS y", "'carreteras' AS layer", "cast(id AS string) AS feature")
    tiles.write_tiles(rows, str(tmp_path / "tiles"))
    back = spark.read.parquet(str(tmp_path / "tiles"))
    assert back.count() == 4000 and back.filter("zoom = 14 AND strip = shiftright(28, 9)").filter("x = 28").count() == 1


def test_cover_is_the_touched_squares(spark):
    """Against every square of the bounding box; the rows follow the border when a shape is long."""
    rng = random.Random(5)
    shapes_ = []
    for k in range(40):
        cx, cy, r, n = rng.uniform(-5, 5), rng.uniform(-5, 5), rng.choice([0.1, 2.0, 6.0]), rng.randint(3, 9)
        ring = [(cx + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * i / n), cy + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]
        shapes_.append((k, k % 2 == 0, ring + ring[:1]))
    df = geo.computed_once(spark.createDataFrame(shapes_, f"id int, closed boolean, ring {RING}"), e=geo.ring_edges(F.col("ring")), b=geo.ring_bbox(F.col("ring")))
    runs = F.explode(F.when(F.col("closed"), tiles.cover(F.col("e"))).otherwise(tiles.cover(F.col("e"), False))).alias("r")
    got = df.select("id", runs).select("id", "r.x", F.explode(F.sequence("r.first", "r.last")).alias("y"))
    box = df.withColumn("x", F.explode(F.sequence(F.floor("b.minx"), F.floor("b.maxx")))).withColumn("y", F.explode(F.sequence(F.floor("b.miny"), F.floor("b.maxy"))))
    square_ = (F.col("x").cast("double"), F.col("y").cast("double"), F.col("x") + 1.0, F.col("y") + 1.0)
    want = box.filter(F.when(F.col("closed"), geo.edges_meet_box(F.col("e"), square_)).otherwise(geo.edges_meet_box(F.col("e"), square_, False))).select("id", "x", "y")
    as_rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert as_rows(got) == as_rows(want)
    long_ = spark.createDataFrame([([(0.1, 0.2), (30000.3, 20000.7)],)], f"line {RING}").select(F.explode(tiles.cover(geo.ring_edges(F.col("line")), False)).alias("r"))
    assert long_.agg(F.sum(F.expr("r.last - r.first + 1"))).first()[0] <= 30001 + 20001
    country = spark.createDataFrame([(square(2000.5, 2000.5, 1500.25),)], f"ring {RING}").select(F.explode(tiles.cover(geo.ring_edges(F.col("ring")))).alias("r"))
    n, squares = country.agg(F.count("*"), F.sum(F.expr("r.last - r.first + 1"))).first()
    assert n <= 4 * 3001 and squares == 3001 * 3001
    empty = spark.createDataFrame([([],), (None,)], f"ring {RING}")
    assert empty.select(F.explode(tiles.cover(geo.ring_edges(F.col("ring")))).alias("r")).count() == 0


def test_points_of_one_cell_walk_down_together(spark):
    """Bounds hold for all points of a box, and the guarantee comes from the sides, not from the far corner alone."""
    box = lambda *v: F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(v, nearest.BOX)))
    _, lb, ub = nearest.Reach(within_deg=9.0).bounds(box(0, 0, 1, 1), box(3, 0, 4, 1))
    got = spark.range(1).select(lb.alias("lb"), ub.alias("ub")).first()
    assert got["lb"] == 2.0 and abs(got["ub"] - 10**0.5) < 1e-12

    rng = random.Random(5)
    squares = [(i, rng.uniform(0, 0.3), rng.uniform(0, 0.3), rng.uniform(0.001, 0.02)) for i in range(90)]
    spots = [(0.1 + rng.uniform(0, 0.004), 0.1 + rng.uniform(0, 0.004)) for _ in range(20)] + [(rng.uniform(0, 0.3), rng.uniform(0, 0.3)) for _ in range(20)]
    points = [(n, *spots[n % 40]) for n in range(80)]
    shapes = [(i, [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h), (x - h, y - h)]) for i, x, y, h in squares]
    p = spark.createDataFrame(points, "pid int, px double, py double")
    s = spark.createDataFrame(shapes, "shape_id int, ring array<struct<x:double,y:double>>")
    got = {r["pid"]: r["shape_id"] for r in nearest.nearest_shape(p, s, nearest.Reach(within_deg=1.0)).collect()}
    away = lambda px, py, q: math.hypot(max(abs(px - q[1]) - q[3], 0.0), max(abs(py - q[2]) - q[3], 0.0))
    assert got == {n: min(squares, key=lambda q: (round(away(px, py, q) * 1e9), q[0]))[0] for n, px, py in points}


def test_nearest_without_a_limit_is_found_at_any_distance(spark):
    """Points near, degrees away and on the other side of the globe from all shapes; nulls have no nearest."""
    rng = random.Random(3)
    squares = [(i, rng.uniform(-9, 3), rng.uniform(36, 43), rng.uniform(0.001, 0.2)) for i in range(200)] + [(500, -179.0, -80.0, 0.01), (501, 170.0, 60.0, 0.01)]
    points = [(i, rng.uniform(-9, 3), rng.uniform(36, 43)) for i in range(60)] + [(100 + i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(100)]
    p = spark.createDataFrame([*points, (999, None, 40.0)], "pid int, px double, py double")
    s = spark.createDataFrame([*((i, square(x, y, h)) for i, x, y, h in squares), (777, None)], f"shape_id int, ring {RING}")
    got = {r["pid"]: (r["shape_id"], r["distance_deg"]) for r in nearest.nearest_shape(p, s, nearest.Reach()).collect()}
    want = {n: min((round(box_gap(px, py, x, y, h) * 1e9), i, box_gap(px, py, x, y, h)) for i, x, y, h in squares) for n, px, py in points}
    assert {n: i for n, (i, _) in got.items()} == {n: i for n, (_, i, _) in want.items()}
    assert all(abs(d - want[n][2]) < 1e-8 for n, (_, d) in got.items()) and max(d for _, d in got.values()) > 30
    assert nearest.nearest_shape(p, s.limit(0), nearest.Reach()).count() == 0


def test_g06_keeps_hotspots_far_from_any_settlement(spark):
    """One settlement, hotspots degrees away from it: none is dropped by a limit."""
    row = (1, 1, "P1", "", 5000.0, "01", "", [[square(-8.0, 40.0, 0.002)]])
    kinds = f"source_fid bigint, source_objectid bigint, nombre string, etiqueta string, habit_0502 double, tipo_0502 string, capit_0502 string, shape array<array<{RING}>>"
    obs = [(n, 1, "SP", "A", "N", 40.0, x, "2024-01-01", "0100", "r", None, None, None, None, None, None, None, None, None, None) for n, x in ((1, -7.99), (2, -4.0), (3, 1.0))]
    fields = "source_observation_id int, source_download_id int, dataset_type string, firms_source string, satellite string, latitude double, longitude double, acq_date string, acq_time string, bbox_region string"
    fields += "".join(f", {n} string" for n in ("instrument", "confidence", "daynight", "version", "scan", "track", "bright_ti4", "bright_ti5", "frp", "observed_at"))

    class Landing:
        region_edges = Tables.region_edges

        def __init__(self):
            self.spark = spark

        def settlement_src(self):
            return spark.createDataFrame([row], kinds)

        def hotspot_obs(self):
            return spark.createDataFrame(obs, fields)

    assert {tuple(r) for r in spatial_queries.g06(Landing()).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_settlement_tiles_are_made_by_many_tasks(spark):
    """One file of settlements is one split; its tiles come from all tasks, each once."""

    class Landing:
        def settlement_src(self):
            rows = [(i, i, f"P{i}", "", 5000.0, "01", "", [[square(-3.0 + i * 0.01, 40.0, 0.002)]]) for i in range(40)]
            kinds = f"source_fid bigint, source_objectid bigint, nombre string, etiqueta string, habit_0502 double, tipo_0502 string, capit_0502 string, shape array<array<{RING}>>"
            return spark.createDataFrame(rows, kinds).coalesce(1)

    made = tile_queries.settlement_tiles(Landing()).select("settlement_id", "zoom", "x", "y", F.spark_partition_id().alias("task")).collect()
    assert len({r["task"] for r in made}) > 1
    assert len({(r["settlement_id"], r["zoom"], r["x"], r["y"]) for r in made}) == len(made) and len({r["settlement_id"] for r in made}) == 40


def test_shapes_of_one_tile_take_a_short_way(spark):
    """Rings within a tile, within its buffer, across a side, unclosed and empty ones: the same tiles and rings as by hand."""
    rings = [square(5.5, 7.5, 0.25), square(5.0, 7.5, 0.25), square(5.5, 7.5, 0.25)[:4], [(5.25, 7.5)], []]
    df = spark.createDataFrame(list(enumerate(rings)), f"id int, ring {RING}")
    runs = df.select("id", F.explode(tiles.cover(geo.ring_edges(F.col("ring")))).alias("r")).select("id", "r.*").collect()
    assert sorted(tuple(r) for r in runs) == [(0, 5, 7, 7), (1, 4, 7, 7), (1, 5, 7, 7), (2, 5, 7, 7)]
    placed = df.select("id", F.array("ring").alias("tile_geom"), F.lit(5).alias("x"), F.lit(7).alias("y"))
    got = {r["id"]: r["text"] for r in tiles.quantise(placed).select("id", tiles.rings_text(F.col("grid")).alias("text")).collect()}
    assert got == {0: "1024 1024,3072 1024,3072 3072,1024 3072,1024 1024", 1: "-64 1024,1024 1024,1024 3072,-64 3072,-64 1024", 2: "1024 3072,3072 1024,3072 3072,1024 3072"}

"""Spatial joins, geometry and clustering: families J (spatial), G and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pavesa import constants as K
from pavesa.functions import geo
from pavesa.functions import scalar as S
from pavesa.operators import cluster, nearest, spatial
from pavesa.operators.series import top_with_probe
from pavesa.plans import pipeline, reports
from pavesa.plans.domain_sql import MPD, ROAD_ATTRIBUTES, covers_sql, dr, hav, seg, view, with_views
from pavesa.plans.registry import query
from pavesa.session import scratch_path

FAR_M, NEAR_M, ZONE_M = 5000.0, 2000.0, 50000.0
POINT = (-3.7, 40.4)


def degree_margin(distance_m: float) -> float:
    return distance_m / K.METRES_PER_DEGREE * K.DEGREE_SLACK


def hotspots_near_settlements(hotspots, places, distance_m: float, sensor: str | None = None):
    """Historical rule: nearest in degrees inside the padded margin, then the metre limit."""
    rows = hotspots if sensor is None else hotspots.filter(F.col("firms_source") == sensor)
    points = rows.select(F.col("hotspot_id").alias("pid"), F.col("longitude").alias("px"), F.col("latitude").alias("py"))
    shapes = places.select(F.col("settlement_id").alias("shape_id"), "shape")
    best = nearest.nearest_shape(points, shapes, nearest.Reach(within_deg=degree_margin(distance_m)), exact_m=distance_m)
    return (
        best.join(rows, best["pid"] == rows["hotspot_id"])
        .join(places.select("settlement_id", "nombre", "habitantes"), F.col("shape_id") == F.col("settlement_id"))
        .drop("pid", "shape_id")
    )


def fires_near_settlements(fires, places, distance_m: float, population_max: int):
    """Live rule: only places under the population limit and within the metres; then nearest in degrees."""
    points = fires.select(F.col("fire_id").alias("pid"), F.col("longitude").alias("px"), F.col("latitude").alias("py"))
    small = places.filter((F.col("habitantes") > 0) & (F.col("habitantes") < population_max))
    reach = nearest.Reach(within_m=distance_m, box_deg=degree_margin(distance_m))
    best = nearest.nearest_shape(points, small.select(F.col("settlement_id").alias("shape_id"), "shape"), reach)
    centre = geo.shape_centroid(F.col("shape"))
    return (
        best.join(fires, best["pid"] == fires["fire_id"])
        .join(
            small.select("settlement_id", "nombre", "habitantes", centre.x.alias("nucleo_lon"), centre.y.alias("nucleo_lat")),
            F.col("shape_id") == F.col("settlement_id"),
        )
        .drop("pid", "shape_id")
    )


def live_fires(t):
    return pipeline.hotspots_flagged(t).filter("in_region AND confidence IN ('n', 'h')").select(
        F.col("source_observation_id").alias("fire_id"), F.col("firms_source").alias("sensor"), "latitude", "longitude", "frp",
        S.confidence_label(F.col("confidence")).alias("confidence_label"), S.frp_class(F.col("frp")).alias("intensity_label"),
        F.date_format("acq_date", "yyyy-MM-dd").alias("acq_date"), "acq_time", "satellite", "firms_source",
    )


view("live_fire", """SELECT source_observation_id AS fire_id, firms_source AS sensor, latitude, longitude, frp,
  CASE confidence WHEN 'n' THEN 'nominal' ELSE 'alta' END AS confidence_label,
  CASE WHEN coalesce(frp,0)>200 THEN 'Muy alto' WHEN coalesce(frp,0)>=50 THEN 'Alto' WHEN coalesce(frp,0)>=10 THEN 'Medio' ELSE 'Bajo' END AS intensity_label,
  strftime(acq_date,'%Y-%m-%d') AS acq_date, acq_time, satellite FROM hotspot_in WHERE in_region AND confidence IN ('n','h')""", ["hotspot_in"])



def town_sql(px: str, py: str, sx: str, sy: str) -> str:
    """Distance of a settlement: from the square or out of its hole, and from the island."""
    box = lambda a, b, c, d: f"sqrt(pow(greatest({a}-({px}),{px}-({b}),0.0)*{sx},2)+pow(greatest({c}-({py}),{py}-({d}),0.0)*{sy},2))"
    square, island = box("x0", "x1", "y0", "y1"), box("ix0", "ix1", "iy0", "iy1")
    hole = f"least(({px}-hx0)*{sx},(hx1-({px}))*{sx},({py}-hy0)*{sy},(hy1-({py}))*{sy})"
    return f"(CASE WHEN odd THEN least({island}, CASE WHEN {px}>hx0 AND {px}<hx1 AND {py}>hy0 AND {py}<hy1 THEN {hole} ELSE {square} END) ELSE {square} END)"


DEG = town_sql("longitude", "latitude", "cast(1.0 as double)", "cast(1.0 as double)")
MET = town_sql("longitude", "latitude", f"(cos(radians(latitude))*{MPD})", MPD)


def nearest_hist_sql(d: float) -> str:
    m = degree_margin(d)
    return f"""SELECT * EXCLUDE rn FROM (SELECT h.*, s.settlement_id, s.nombre, s.habitantes, {MET} AS distance_m,
      row_number() OVER (PARTITION BY hotspot_id ORDER BY round_even({DEG}*1e9,0), settlement_id) AS rn
     FROM hotspot h JOIN settlement s ON s.minx <= h.longitude+{m} AND s.maxx >= h.longitude-{m} AND s.miny <= h.latitude+{m} AND s.maxy >= h.latitude-{m}
     WHERE {DEG} <= {m}) WHERE rn=1 AND distance_m <= {d}"""


def nearest_live_sql(d: float, pop: int) -> str:
    m = degree_margin(d)
    return f"""SELECT * EXCLUDE rn FROM (SELECT f.*, s.settlement_id, s.nombre, s.habitantes, s.lon AS nucleo_lon, s.lat AS nucleo_lat, {MET} AS distance_m,
      row_number() OVER (PARTITION BY fire_id ORDER BY round_even({DEG}*1e9,0), settlement_id) AS rn
     FROM live_fire f JOIN settlement s ON s.minx <= f.longitude+{m} AND s.maxx >= f.longitude-{m} AND s.miny <= f.latitude+{m} AND s.maxy >= f.latitude-{m}
     WHERE habitantes < {pop} AND {MET} <= {d}) WHERE rn=1"""


view("near_hist", nearest_hist_sql(FAR_M), ["hotspot", "settlement"])
view("near_live", nearest_live_sql(NEAR_M, 50000), ["live_fire", "settlement"])


@query("j04_nearest_settlement_hist", with_views("near_hist", f"SELECT hotspot_id, settlement_id, nombre, habitantes, {dr('distance_m', 1)} AS distance_m FROM near_hist"))
def j04(t):
    near = hotspots_near_settlements(pipeline.hotspots(t), pipeline.settlements(t), FAR_M)
    return near.select("hotspot_id", "settlement_id", "nombre", "habitantes", S.dec_round(F.col("distance_m"), 1).alias("distance_m"))


@query("j05_nearest_settlement_live", with_views("near_live", f"""SELECT fire_id, settlement_id, nombre, habitantes, {dr('distance_m', 1)} AS distance_m,
  {dr('nucleo_lon', 5)} AS nucleo_lon, {dr('nucleo_lat', 5)} AS nucleo_lat FROM near_live"""))
def j05(t):
    near = fires_near_settlements(live_fires(t), pipeline.settlements(t), NEAR_M, 50000)
    return near.select(
        "fire_id", "settlement_id", "nombre", "habitantes", S.dec_round(F.col("distance_m"), 1).alias("distance_m"),
        S.dec_round(F.col("nucleo_lon"), 5).alias("nucleo_lon"), S.dec_round(F.col("nucleo_lat"), 5).alias("nucleo_lat"),
    )


view("zone_pair", f"""
 WITH corner AS (SELECT settlement_id, nombre, habitantes, lat, lon, y0, minx, miny, maxx, maxy, i, CASE WHEN i IN (0,3) THEN minx ELSE maxx END AS px,
    CASE WHEN i IN (0,1) THEN miny ELSE maxy END AS py, CASE WHEN i IN (2,3) THEN minx ELSE maxx END AS qx, CASE WHEN i IN (0,3) THEN miny ELSE maxy END AS qy
   FROM settlement_ring, (VALUES (0),(1),(2),(3)) t(i)),
 near AS (SELECT z.area_code, c.*, z.i AS zi, z.x1, z.y1, z.x2, z.y2, cos(radians(y0))*{MPD} AS sx FROM zone_edge z JOIN corner c
   ON c.minx <= z.cx+2.2 AND c.maxx >= z.cx-2.2 AND c.miny <= z.cy+1.2 AND c.maxy >= z.cy-1.2),
 inside AS (SELECT area_code, settlement_id, px, py, i, sum(CASE WHEN (y1>py)<>(y2>py) AND px<(x2-x1)*(py-y1)/(y2-y1)+x1 THEN 1 ELSE 0 END)%2=1 AS hit
   FROM near GROUP BY ALL),
 hits AS (SELECT DISTINCT area_code, settlement_id FROM inside WHERE hit UNION SELECT area_code, settlement_id FROM (SELECT DISTINCT area_code, settlement_id, minx, miny, maxx, maxy, x1, y1 FROM near)
   WHERE x1 BETWEEN minx AND maxx AND y1 BETWEEN miny AND maxy GROUP BY area_code, settlement_id, x1, y1 HAVING count(*) % 2 = 1),
 d AS (SELECT area_code, settlement_id, any_value(nombre) AS nombre, any_value(habitantes) AS habitantes, any_value(lon) AS lon, any_value(lat) AS lat,
   min(least({seg('px','py','x1','y1','x2','y2','sx',MPD)},{seg('x1','y1','px','py','qx','qy','sx',MPD)})) AS dm,
   min(least({seg('px','py','x1','y1','x2','y2','1.0','1.0')},{seg('x1','y1','px','py','qx','qy','1.0','1.0')})) AS dd FROM near GROUP BY area_code, settlement_id)
 SELECT d.area_code, d.settlement_id, nombre, habitantes, lon, lat, CASE WHEN h.area_code IS NULL THEN dm ELSE 0.0 END AS distance_m,
   CASE WHEN h.area_code IS NULL THEN dd ELSE 0.0 END AS distance_deg
 FROM d LEFT JOIN hits h ON h.area_code=d.area_code AND h.settlement_id=d.settlement_id""", ["zone_edge", "settlement_ring"])


def zone_sql(order: str) -> str:
    return f"""SELECT area_code, settlement_id, nombre, habitantes, {dr('distance_m', 1)} AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY area_code ORDER BY {order}) AS rn
      FROM zone_pair WHERE distance_m <= {ZONE_M}) WHERE rn=1"""


CLOSEST = "round_even(distance_deg*1e9,0), settlement_id"
POPULATED = "habitantes DESC, round_even(distance_m*1e4,0), settlement_id"


def zone_pick(t, strategy: str):
    return spatial.settlement_per_zone(
        t.zone(), pipeline.settlements(t).select("settlement_id", "nombre", "habitantes", "shape"), ZONE_M, strategy
    )


def _zone_out(df):
    return df.select("area_code", "settlement_id", "nombre", "habitantes", S.dec_round(F.col("distance_m"), 1).alias("distance_m"))


@query("j06_zone_settlement_closest", with_views("zone_pair", zone_sql(CLOSEST)))
def j06(t):
    return _zone_out(zone_pick(t, "closest"))


@query("j06_zone_settlement_most_populated", with_views("zone_pair", zone_sql(POPULATED)))
def j06p(t):
    return _zone_out(zone_pick(t, "most_populated"))


RX, RY = f"cos(radians({POINT[1]}))*{MPD}", MPD
view("road_near", f"""SELECT r.*, min({seg(str(POINT[0]), str(POINT[1]), 'x1', 'y1', 'x2', 'y2', RX, RY)}) AS d FROM road r JOIN road_edge e USING (id_tramo) GROUP BY ALL""", ["road", "road_edge"])


@query("j07_roads_near_point", with_views("road_near", f"""SELECT id_tramo, inspire_id, clase, nombre, n_carriles, {', '.join(ROAD_ATTRIBUTES)}, territory_code, cast(round_even(d,0) as integer) AS distance_m
  FROM road_near WHERE d <= 25000"""))
def j07(t):
    return spatial.roads_near(pipeline.roads_around(t, spatial.box_around(*POINT, 25000.0)), *POINT, 25000.0).select(
        "id_tramo", "inspire_id", "clase", "nombre", "n_carriles", *ROAD_ATTRIBUTES, "territory_code", "distance_m"
    )


@query("j07_stored_roads_near_point", with_views("road_near", f"""SELECT id_tramo, inspire_id, clase, n_carriles, territory_code, cast(round_even(d,0) as integer) AS distance_m
  FROM road_near WHERE d <= 60000"""))
def j07s(t):
    """The core table stored along a Z curve with its bounds, then read by them."""
    path = scratch_path(t.spark, "roads-by-place")
    spatial.store_by_place(pipeline.roads(t), "line", path)
    rows = spatial.stored_by_place(t.spark, path, spatial.box_around(*POINT, 60000.0))
    return spatial.roads_near(rows, *POINT, 60000.0).select("id_tramo", "inspire_id", "clase", "n_carriles", "territory_code", "distance_m")


@query("z09_roads_near_point", with_views("road_near", f"""SELECT id_tramo, inspire_id, clase, nombre, {', '.join(ROAD_ATTRIBUTES)}, n_carriles, territory_code, distance_m FROM (SELECT *, cast(round_even(d,0) as integer) AS distance_m FROM road_near
  WHERE d <= 100000 AND clase IN ('Autopista de peaje','Carretera convencional')) ORDER BY distance_m, id_tramo LIMIT 20"""))
def z09(t):
    near = spatial.roads_near(pipeline.roads_around(t, spatial.box_around(*POINT, 100000.0)), *POINT, 100000.0, ["Autopista de peaje", "Carretera convencional"])
    return near.orderBy("distance_m", "id_tramo").limit(20).select("id_tramo", "inspire_id", "clase", "nombre", *ROAD_ATTRIBUTES, "n_carriles", "territory_code", "distance_m")


@query("j11_point_in_region", with_views("hotspot_in", "SELECT source_observation_id, in_region FROM hotspot_in"))
def j11(t):
    return pipeline.hotspots_flagged(t).select("source_observation_id", "in_region")


@query("g01_points_per_region_side", with_views("hotspot_in", "SELECT in_region, count(*) AS n FROM hotspot_in GROUP BY 1"))
def g01(t):
    return pipeline.hotspots_flagged(t).groupBy("in_region").agg(F.count("*").alias("n"))


view("cover_hit", f"""SELECT px, py, min(cover_id) AS cover_id FROM (SELECT DISTINCT longitude AS px, latitude AS py FROM hotspot_obs) p
  JOIN landcover l ON p.px BETWEEN l.minx AND l.maxx+0.05 AND p.py BETWEEN l.miny AND l.maxy+0.05 WHERE {covers_sql('px', 'py')} GROUP BY px, py""", ["hotspot_obs", "landcover"])


@query("j15_fire_landcover", with_views("cover_hit", """SELECT source_observation_id, cover_id, trim(regexp_replace(coalesce(valor,''),'\\s+',' ','g')) AS valor FROM hotspot_obs o
  LEFT JOIN cover_hit c ON c.px=o.longitude AND c.py=o.latitude LEFT JOIN landcover l USING (cover_id)"""))
def j15(t):
    fires = t.hotspot_obs().select("source_observation_id", F.col("longitude").alias("px"), F.col("latitude").alias("py"))
    cover = t.landcover()
    hit = spatial.shape_at_point(fires, cover.select(F.col("cover_id").alias("shape_id"), "shape"))
    return (
        fires.join(hit, ["px", "py"], "left")
        .join(cover.select(F.col("cover_id").alias("shape_id"), S.squeeze(F.col("valor")).alias("label")), "shape_id", "left")
        .select("source_observation_id", F.col("shape_id").alias("cover_id"), F.coalesce("label", F.lit("")).alias("valor"))
    )


@query("g04_distance_forms", with_views("settlement zone", f"""SELECT settlement_id, {dr(hav('lon', 'lat', '-3.7', '40.4'), 2)} AS point_point_m,
  {dr(town_sql('cast(-3.7 as double)', 'cast(40.4 as double)', f'(cos(radians(40.4))*{MPD})', MPD), 2)} AS point_polygon_m FROM settlement"""))
def g04(t):
    centre = geo.shape_centroid(F.col("shape"))
    px, py = F.lit(-3.7), F.lit(40.4)
    sx, sy = geo.metre_scale(py)
    return pipeline.settlements(t).select(
        "settlement_id",
        S.dec_round(geo.haversine_m(centre.x, centre.y, px, py), 2).alias("point_point_m"),
        S.dec_round(geo.shape_distance(px, py, F.col("shape"), sx, sy), 2).alias("point_polygon_m"),
    )


@query("g05_within_distance", with_views("zone_pair", f"SELECT area_code, count(*) AS n, cast(sum(habitantes) as bigint) AS people FROM zone_pair WHERE distance_m <= 20000 GROUP BY area_code"))
def g05(t):
    pairs = spatial.pairs_within(
        t.zone(), pipeline.settlements(t).select("settlement_id", "habitantes", "shape"), 20000.0, "settlement_id"
    )
    return pairs.groupBy("area_code").agg(F.count("*").alias("n"), F.sum("habitantes").cast("bigint").alias("people"))


@query("g06_nearest_any_distance", with_views("hotspot settlement", f"""SELECT hotspot_id, settlement_id FROM (SELECT hotspot_id, settlement_id,
  row_number() OVER (PARTITION BY hotspot_id ORDER BY round_even({DEG}*1e9,0), settlement_id) AS rn FROM hotspot CROSS JOIN settlement) WHERE rn=1"""))
def g06(t):
    points = pipeline.hotspots(t).select(F.col("hotspot_id").alias("pid"), F.col("longitude").alias("px"), F.col("latitude").alias("py"))
    shapes = pipeline.settlements(t).select(F.col("settlement_id").alias("shape_id"), "shape")
    return nearest.nearest_shape(points, shapes, nearest.Reach()).select(
        F.col("pid").alias("hotspot_id"), F.col("shape_id").alias("settlement_id")
    )


EPS, MINPTS = 1500.0, 4
MX = "(longitude/180.0*20037508.34)"
MY = "(ln(tan(radians(latitude)/2+3.141592653589793/4))/3.141592653589793*20037508.34)"
view("cpt", f"SELECT hotspot_id AS id, {MX} AS x, {MY} AS y, frp, acq_date, longitude, latitude FROM hotspot", ["hotspot"])
view("cnb", f"SELECT a.id AS a, b.id AS b FROM cpt a JOIN cpt b ON b.x BETWEEN a.x-{EPS} AND a.x+{EPS} AND b.y BETWEEN a.y-{EPS} AND a.y+{EPS} WHERE sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) <= {EPS}", ["cpt"])
view("ccore", f"SELECT a AS id FROM cnb GROUP BY a HAVING count(*) >= {MINPTS}", ["cnb"])
view("cedge", "SELECT a, b FROM cnb WHERE a IN (SELECT id FROM ccore) AND b IN (SELECT id FROM ccore)", ["cnb", "ccore"])
view("creach", "SELECT id, id AS label FROM ccore UNION SELECT e.b, r.label FROM creach r JOIN cedge e ON e.a=r.id WHERE r.label < e.b", ["ccore", "cedge"])
view("clabel", "SELECT id, min(label) AS label FROM creach GROUP BY id", ["creach"])
view("cnum", "SELECT label, cast(row_number() OVER (ORDER BY label)-1 as integer) AS cluster_id FROM (SELECT DISTINCT label FROM clabel)", ["clabel"])
view("cpoint", """SELECT p.id, p.frp, p.acq_date, p.longitude, p.latitude, n.cluster_id FROM cpt p LEFT JOIN (SELECT id, label FROM clabel UNION ALL
   SELECT b, min(label) FROM cnb JOIN clabel ON a=id WHERE b NOT IN (SELECT id FROM ccore) GROUP BY b) l ON l.id=p.id LEFT JOIN cnum n ON n.label=l.label""", ["cpt", "clabel", "cnum"])


def clustered(t):
    pts = pipeline.hotspots(t).select(
        F.col("hotspot_id").alias("id"), geo.mercator_x(F.col("longitude")).alias("x"), geo.mercator_y(F.col("latitude")).alias("y")
    )
    return cluster.dbscan(pts, EPS, MINPTS)


@query("g07_dbscan", with_views("cpoint", "SELECT id, cluster_id FROM cpoint", recursive=True))
def g07(t):
    return clustered(t).select("id", "cluster_id")


@query("w06_cluster_sizes", with_views("cpoint", "SELECT cluster_id, count(*) AS n FROM cpoint GROUP BY 1", recursive=True))
def w06(t):
    return clustered(t).groupBy("cluster_id").agg(F.count("*").alias("n"))


view("csum", f"""SELECT cluster_id, count(*) AS hotspot_count, cast(round(cast(avg(frp) as decimal(20,8)),2) as double) AS avg_frp, cast(round(cast(max(frp) as decimal(20,8)),2) as double) AS max_frp,
  strftime(min(acq_date),'%Y-%m-%d') AS first_date, strftime(max(acq_date),'%Y-%m-%d') AS last_date, {dr('avg(longitude)', 5)} AS center_lon, {dr('avg(latitude)', 5)} AS center_lat
  FROM cpoint WHERE cluster_id IS NOT NULL GROUP BY cluster_id""", ["cpoint"])


def summarised(t):
    rows = pipeline.hotspots(t).select(F.col("hotspot_id").alias("id"), "frp", "acq_date", "longitude", "latitude")
    return reports.cluster_summary(rows.join(clustered(t).select("id", "cluster_id"), "id"))


@query("s21_cluster_summary", with_views("csum", "SELECT * FROM csum", recursive=True))
def s21(t):
    return summarised(t)


Z08_BOX = (-8.0, 36.0, 2.0, 43.0)
Z08_WHERE = "acq_date BETWEEN date '2024-01-05' AND date '2024-01-25' AND longitude BETWEEN -8.0 AND 2.0 AND latitude BETWEEN 36.0 AND 43.0"
for name, body in (
    ("zpt", f"SELECT hotspot_id AS id, {MX} AS x, {MY} AS y, frp, acq_date, longitude, latitude FROM hotspot WHERE {Z08_WHERE}"),
    ("znb", f"SELECT a.id AS a, b.id AS b FROM zpt a JOIN zpt b ON b.x BETWEEN a.x-{EPS} AND a.x+{EPS} AND b.y BETWEEN a.y-{EPS} AND a.y+{EPS} WHERE sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) <= {EPS}"),
    ("zcore", f"SELECT a AS id FROM znb GROUP BY a HAVING count(*) >= {MINPTS}"),
    ("zedge", "SELECT a, b FROM znb WHERE a IN (SELECT id FROM zcore) AND b IN (SELECT id FROM zcore)"),
    ("zreach", "SELECT id, id AS label FROM zcore UNION SELECT e.b, r.label FROM zreach r JOIN zedge e ON e.a=r.id WHERE r.label < e.b"),
    ("zlabel", "SELECT id, min(label) AS label FROM zreach GROUP BY id"),
    ("znum", "SELECT label, cast(row_number() OVER (ORDER BY label)-1 as integer) AS cluster_id FROM (SELECT DISTINCT label FROM zlabel)"),
    ("zpoint", """SELECT p.id, p.frp, p.acq_date, p.longitude, p.latitude, n.cluster_id FROM zpt p LEFT JOIN (SELECT id, label FROM zlabel UNION ALL
   SELECT b, min(label) FROM znb JOIN zlabel ON a=id WHERE b NOT IN (SELECT id FROM zcore) GROUP BY b) l ON l.id=p.id LEFT JOIN znum n ON n.label=l.label"""),
    ("zsum", f"""SELECT cluster_id, count(*) AS hotspot_count, cast(round(cast(avg(frp) as decimal(20,8)),2) as double) AS avg_frp, cast(round(cast(max(frp) as decimal(20,8)),2) as double) AS max_frp,
  strftime(min(acq_date),'%Y-%m-%d') AS first_date, strftime(max(acq_date),'%Y-%m-%d') AS last_date, {dr('avg(longitude)', 5)} AS center_lon, {dr('avg(latitude)', 5)} AS center_lat
  FROM zpoint WHERE cluster_id IS NOT NULL GROUP BY cluster_id"""),
):
    view(name, body, {"zpt": ["hotspot"], "znb": ["zpt"], "zcore": ["znb"], "zedge": ["znb", "zcore"], "zreach": ["zcore", "zedge"], "zlabel": ["zreach"], "znum": ["zlabel"], "zpoint": ["zpt", "zlabel", "znum"], "zsum": ["zpoint"]}[name])


@query("z08_hotspot_clusters", with_views("zsum", """SELECT *, (SELECT count(*) FROM zsum) > 50 AS truncated FROM zsum ORDER BY hotspot_count DESC, cluster_id LIMIT 50""", recursive=True))
def z08(t):
    found = reports.hotspot_clusters(pipeline.hotspots(t), "2024-01-05", "2024-01-25", Z08_BOX)
    return top_with_probe(found, [F.col("hotspot_count").desc(), F.col("cluster_id")], 50).drop("total_matched")

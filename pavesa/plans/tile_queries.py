"""Geometry and map tiles: families G (rest) and M."""

from __future__ import annotations

from pyspark.sql import functions as F

from pavesa import constants as K
from pavesa.functions import geo
from pavesa.functions import parameters as P
from pavesa.functions import scalar as S
from pavesa.operators import canonical, shapes, spatial, tiles
from pavesa.plans import pipeline
from pavesa.plans.domain_sql import cover_area_sql, dr, view, with_views
from pavesa.plans.registry import query
from pavesa.plans.scalar_queries import CLASS_ZOOM
from pavesa.session import scratch_path

c = F.col


def side_sql(ax, ay, bx, by, cx, cy) -> str:
    return f"sign((({bx})-({ax}))*(({cy})-({ay}))-(({by})-({ay}))*(({cx})-({ax})))"


def cross_sql(p: tuple, q: tuple) -> str:
    return (
        f"({side_sql(*p, q[0], q[1])}*{side_sql(*p, q[2], q[3])}<0 AND {side_sql(*q, p[0], p[1])}*{side_sql(*q, p[2], p[3])}<0)"
    )


def meets_sql(x1, y1, x2, y2, box: tuple, closed: bool = True) -> str:
    """Aggregate over the edges of one shape: does it touch the box?"""
    a, b, d, e = box
    sides = [(a, b, d, b), (d, b, d, e), (d, e, a, e), (a, e, a, b)]
    crossing = " OR ".join(cross_sql((x1, y1, x2, y2), s) for s in sides)
    vertex = f"({x1} BETWEEN {a} AND {d} AND {y1} BETWEEN {b} AND {e}) OR ({x2} BETWEEN {a} AND {d} AND {y2} BETWEEN {b} AND {e})"
    out = f"(bool_or({vertex}) OR bool_or({crossing})"
    if closed:
        out += f" OR sum(CASE WHEN ({y1}>{b})<>({y2}>{b}) AND {a}<({x2}-{x1})*({b}-{y1})/({y2}-{y1})+{x1} THEN 1 ELSE 0 END)%2=1"
    return out + ")"


def tx(lon: str, z: str) -> str:
    return f"(({lon}+180.0e0)/360.0e0*pow(2.0e0,{z}))"


def ty(lat: str, z: str) -> str:
    return f"((1-ln(tan(radians({lat}))+1/cos(radians({lat})))/3.141592653589793e0)/2*pow(2.0e0,{z}))"


BOX = (-4.0, 38.0, 0.0, 41.0)


@query("g02_point_in_envelope", with_views("hotspot_obs", "SELECT acq_time[1:2] AS hour, count(*) FILTER (longitude BETWEEN -4 AND 0 AND latitude BETWEEN 38 AND 41) AS inside FROM hotspot_obs GROUP BY 1"))
def g02(t):
    return t.hotspot_obs().groupBy(F.substring("acq_time", 1, 2).alias("hour")).agg(F.count_if(P.in_box("longitude", "latitude", BOX)).alias("inside"))


@query("g03_shape_meets_envelope", with_views("zone_edge", f"SELECT area_code, {meets_sql('x1', 'y1', 'x2', 'y2', ('-4.0e0', '38.0e0', '0.0e0', '41.0e0'))} AS meets FROM zone_edge GROUP BY area_code"))
def g03(t):
    return t.zone().select("area_code", geo.ring_meets_box(c("ring"), BOX).alias("meets"))


GX = "(longitude/180.0e0*20037508.34e0)"
GY = "(ln(tan(radians(latitude)/2+3.141592653589793e0/4))/3.141592653589793e0*20037508.34e0)"


@query("g08_mercator_round_trip", with_views("hotspot_obs", f"SELECT source_observation_id, {dr(GX, 2)} AS x, {dr(GY, 2)} AS y, {dr('longitude', 6)} AS lon, {dr('latitude', 6)} AS lat FROM hotspot_obs"))
def g08(t):
    x, y = geo.mercator_x(c("longitude")), geo.mercator_y(c("latitude"))
    return t.hotspot_obs().select(
        "source_observation_id", S.dec_round(x, 2).alias("x"), S.dec_round(y, 2).alias("y"),
        S.dec_round(geo.mercator_lon(x), 6).alias("lon"), S.dec_round(geo.mercator_lat(y), 6).alias("lat"),
    )


CRS = "CASE p_partkey % 5 WHEN 0 THEN 'urn:ogc:def:crs:epsg::3857' WHEN 1 THEN 'EPSG:4326' WHEN 2 THEN 'urn:ogc:def:crs:OGC::CRS84' WHEN 3 THEN 'OGC:1.3:CRS:84' ELSE '' END"


def crs_of(name, x, y):
    """Named system when known, else guessed from the size of the numbers."""
    up = F.upper(F.coalesce(name, F.lit("")))
    named = (
        F.when(up.endswith("EPSG::3857") | up.endswith("EPSG:3857"), "EPSG:3857")
        .when(up.endswith("EPSG::4326") | up.endswith("EPSG:4326"), "EPSG:4326")
        .when(up.endswith("CRS::84") | up.endswith("CRS:84"), "CRS:84")
    )
    return F.coalesce(named, F.when((F.abs(x) <= 180) & (F.abs(y) <= 90), "EPSG:4326").otherwise("EPSG:3857"))


@query("g09_crs_guess", "SELECT p_partkey, CASE p_partkey%5 WHEN 0 THEN 'EPSG:3857' WHEN 1 THEN 'EPSG:4326' WHEN 3 THEN 'CRS:84' ELSE CASE WHEN p_retailprice<=180 AND p_size<=90 THEN 'EPSG:4326' ELSE 'EPSG:3857' END END AS crs FROM part")
def g09(t):
    return t.raw("part").select("p_partkey", crs_of(F.expr(CRS), c("p_retailprice"), c("p_size")).alias("crs"))


@query("g10_extent", with_views("zone_edge", "SELECT area_code, " + ", ".join(f"{dr(f'{a}({v})', 6)} AS {n}" for a, v, n in (("min", "x1", "minx"), ("min", "y1", "miny"), ("max", "x1", "maxx"), ("max", "y1", "maxy"))) + " FROM zone_edge GROUP BY area_code"))
def g10(t):
    b = geo.ring_bbox(c("ring"))
    return t.zone().select("area_code", *[S.dec_round(b[n], 6).alias(n) for n in ("minx", "miny", "maxx", "maxy")])


@query("g11_centroids", with_views("zone_edge hotspot_obs", f"""SELECT 'zone' AS kind, area_code AS key, {dr('cx+sum((x1+x2-2*cx)*((x1-cx)*(y2-cy)-(x2-cx)*(y1-cy)))/(3*sum((x1-cx)*(y2-cy)-(x2-cx)*(y1-cy)))', 6)} AS lon,
  {dr('cy+sum((y1+y2-2*cy)*((x1-cx)*(y2-cy)-(x2-cx)*(y1-cy)))/(3*sum((x1-cx)*(y2-cy)-(x2-cx)*(y1-cy)))', 6)} AS lat FROM zone_edge GROUP BY area_code, cx, cy
  UNION ALL SELECT 'points', bbox_region, {dr('avg(longitude)', 5)}, {dr('avg(latitude)', 5)} FROM hotspot_obs GROUP BY 2"""))
def g11(t):
    centre = geo.ring_centroid(c("ring"))
    zones = t.zone().select(F.lit("zone").alias("kind"), c("area_code").alias("key"), S.dec_round(centre.x, 6).alias("lon"), S.dec_round(centre.y, 6).alias("lat"))
    means = t.hotspot_obs().groupBy(c("bbox_region").alias("key")).agg(S.dec_round(F.avg("longitude"), 5).alias("lon"), S.dec_round(F.avg("latitude"), 5).alias("lat"))
    return zones.unionByName(means.withColumn("kind", F.lit("points")))


FAULTY = (
    "CASE k WHEN 0 THEN slice(r, 1, 0) WHEN 1 THEN slice(r, 1, 3) WHEN 2 THEN slice(r, 1, 4) WHEN 3 THEN"
    " array(r[0], r[2], r[1], r[3], r[0]) WHEN 4 THEN array(r[0], r[1], r[0], r[1], r[0]) ELSE r END"
)


@query("g12_shape_screen", "SELECT c_custkey, CASE c_custkey%7 WHEN 0 THEN 'empty' WHEN 1 THEN 'too_short' WHEN 2 THEN 'not_closed' WHEN 3 THEN 'self_crossing' WHEN 4 THEN 'no_area' END AS reason, c_custkey%7>4 AS is_valid FROM customer")
def g12(t):
    solid = F.transform(c("shape")[0][0], lambda p: F.struct(p.x.alias("x"), p.y.alias("y"), F.lit(1.0).alias("z")))
    rows = t.settlement_src().select(c("source_fid").alias("c_custkey"), (c("source_fid") % 7).alias("k"), solid.alias("r"))
    reason = shapes.screen(shapes.flatten_2d(F.expr(FAULTY)))
    return rows.select("c_custkey", reason.alias("reason"), reason.isNull().alias("is_valid"))


LINE_AREA = "(abs(sum(radians(x2-x1)*(sin(radians(y1))+sin(radians(y2)))/2))*6371007.181e0*6371007.181e0/10000.0e0)"


@query("g13_polygon_area", with_views("zone_edge landcover", f"SELECT 'zone' AS kind, area_code AS key, {dr(LINE_AREA, 2)} AS area_ha FROM zone_edge GROUP BY area_code UNION ALL SELECT 'cover', cast(cover_id as varchar), {dr(cover_area_sql(), 2)} FROM landcover"))
def g13(t):
    area = S.dec_round(geo.shape_area_ha(c("shape")), 2).alias("area_ha")
    zones = geo.with_shape(t.zone()).select(F.lit("zone").alias("kind"), c("area_code").alias("key"), area)
    return zones.unionByName(t.landcover().select(F.lit("cover").alias("kind"), c("cover_id").cast("string").alias("key"), area))


def ring_sql(prefix: str, hole: bool, point) -> str:
    """A box ring: counterclockwise from its lower left corner, a hole the other way."""
    x0, x1, y0, y1 = (f"{prefix}{n}" for n in ("x0", "x1", "y0", "y1"))
    round_ = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return point(round_[::-1] if hole else round_)


def wkt_sql(prefix: str, hole: bool = False) -> str:
    return ring_sql(prefix, hole, lambda ps: "printf('(" + ", ".join(["%.8f %.8f"] * 5) + ")'," + ",".join(f"{x},{y}" for x, y in ps) + ")")


def json_sql(prefix: str, hole: bool = False) -> str:
    return ring_sql(prefix, hole, lambda ps: "'[" + ",".join(f"['||{x}||','||{y}||']" for x, y in ps) + "]'")


@query("g14_make_geometry", with_views("settlement", f"""SELECT settlement_id, CASE WHEN odd THEN 'MULTIPOLYGON(('||{wkt_sql('')}||', '||{wkt_sql('h', True)}||'), ('||{wkt_sql('i')}||'))'
  ELSE 'POLYGON('||{wkt_sql('')}||')' END AS wkt FROM settlement"""))
def g14(t):
    return pipeline.settlements(t).select("settlement_id", geo.shape_wkt(c("shape")).alias("wkt"))


@query("g15_geojson", with_views("settlement", f"""SELECT settlement_id, CASE WHEN odd THEN '{{"type":"MultiPolygon","coordinates":[['||{json_sql('')}||','||{json_sql('h', True)}||'],['||{json_sql('i')}||']]}}'
  ELSE '{{"type":"Polygon","coordinates":['||{json_sql('')}||']}}' END AS geojson FROM settlement"""))
def g15(t):
    return pipeline.settlements(t).select("settlement_id", geo.shape_geojson(c("shape")).alias("geojson"))


def split_views(name: str, points: str, keys: str, needs: list[str]) -> None:
    """Views of a Douglas-Peucker pass over lines of five points ``(keys, i, px, py, tol)``: ``{name}`` holds the points that stay.

    Three levels are all that three inner points can need.
    """
    on = " AND ".join(f"s.{k}=p.{k}" for k in keys.split(","))
    same = lambda t: " AND ".join(f"s.{k}={t}.{k}" for k in keys.split(","))
    own = ",".join(f"s.{k}" for k in keys.split(","))
    view(f"{name}_seg0", f"SELECT DISTINCT {keys}, 0 AS a, 4 AS b FROM {points}", [points])
    for level in range(3):
        share = "CASE WHEN dx*dx+dy*dy>0 THEN least(greatest((mx*dx+my*dy)/(dx*dx+dy*dy),0.0e0),1.0e0) ELSE 0.0e0 END"
        view(f"{name}_far{level}", f"""SELECT {keys}, a, b, i FROM (SELECT *, round_even(sqrt((mx-sh*dx)*(mx-sh*dx)+(my-sh*dy)*(my-sh*dy))/tol/1e-6,0) AS gap FROM (SELECT *, {share} AS sh FROM
   (SELECT {own}, s.a, s.b, p.i, p.tol, q.px-o.px AS dx, q.py-o.py AS dy, p.px-o.px AS mx, p.py-o.py AS my FROM {name}_seg{level} s JOIN {points} p ON {on} AND p.i>s.a AND p.i<s.b
    JOIN {points} o ON {same('o')} AND o.i=s.a JOIN {points} q ON {same('q')} AND q.i=s.b)))
   WHERE gap>1000000 QUALIFY row_number() OVER (PARTITION BY {keys}, a, b ORDER BY gap DESC, i)=1""", [f"{name}_seg{level}"])
        view(f"{name}_seg{level + 1}", f"SELECT {keys}, a, i AS b FROM {name}_far{level} UNION ALL SELECT {keys}, i, b FROM {name}_far{level}", [f"{name}_far{level}"])
    kept = " UNION ALL ".join(f"SELECT {keys}, i FROM {name}_far{level}" for level in range(3))
    view(name, f"SELECT {keys}, i, px, py FROM {points} SEMI JOIN (SELECT {keys}, unnest([0,4]) AS i FROM {name}_seg0 UNION ALL {kept}) USING ({keys}, i)", [f"{name}_far{level}" for level in range(3)])


view("road_tol_pt", "SELECT id_tramo, tol, i, x AS px, y AS py FROM road_pt SEMI JOIN road USING (id_tramo), (SELECT unnest([0.0002e0,0.002e0]) AS tol)", ["road_pt", "road"])
split_views("road_simple", "road_tol_pt", "id_tramo,tol", ["road_tol_pt"])


@query("g16_simplified_roads", with_views("road_simple", "SELECT id_tramo, tol AS tolerance, count(*) AS points, string_agg(printf('%.8f %.8f',px,py), ',' ORDER BY i) AS line FROM road_simple GROUP BY 1,2"))
def g16(t):
    lines = pipeline.roads(t).select("id_tramo", "line").withColumn("tolerance", F.explode(F.array(F.lit(0.0002), F.lit(0.002))))
    text = F.array_join(F.transform("line", lambda p: F.format_string("%.8f %.8f", p.x, p.y)), ",")
    return shapes.simplify_lines(lines).select("id_tramo", "tolerance", F.size("line").cast("bigint").alias("points"), text.alias("line"))


@query("m01_tile_coordinates", with_views("hotspot_obs", f"""SELECT source_observation_id, cast(floor({tx('longitude', '12')}) as integer) AS x, cast(floor({ty('latitude', '12')}) as integer) AS y,
  {dr('floor(' + tx('longitude', '12') + ')/4096.0e0*360.0e0-180.0e0', 6)} AS west FROM hotspot_obs"""))
def m01(t):
    x, y = geo.tile_x(c("longitude"), 12), geo.tile_y(c("latitude"), 12)
    return t.hotspot_obs().select("source_observation_id", x.alias("x"), y.alias("y"), S.dec_round(geo.tile_lon(x, 12), 6).alias("west"))


view("zone_tile", f"""WITH e AS (SELECT area_code, {tx('x1', '9')} AS x1, {ty('y1', '9')} AS y1, {tx('x2', '9')} AS x2, {ty('y2', '9')} AS y2 FROM zone_edge),
  b AS (SELECT area_code, cast(floor(min(x1)) as bigint) AS ax, cast(floor(max(x1)) as bigint) AS bx, cast(floor(min(y1)) as bigint) AS ay, cast(floor(max(y1)) as bigint) AS b_y FROM e GROUP BY 1),
  g AS (SELECT area_code, x, unnest(generate_series(ay,b_y)) AS y FROM (SELECT *, unnest(generate_series(ax,bx)) AS x FROM b))
  SELECT area_code, x, y FROM g JOIN e USING (area_code) GROUP BY area_code, x, y HAVING {meets_sql('x1', 'y1', 'x2', 'y2', ('cast(x as double)', 'cast(y as double)', '(x+1.0e0)', '(y+1.0e0)'))}""", ["zone_edge"])


def warning_tiles(t):
    """Zones are tiled once; the daily features then join their zone's tiles."""
    return warnings_of_zones(t, zone_tiles(t).select("area_code", "zoom", "x", "y"))


def zone_tiles(t):
    return tiles.to_tiles(geo.with_shape(t.zone()).withColumn("zoom", F.lit(9)), "shape")


def warnings_of_zones(t, zones):
    return pipeline.features(t).filter("is_warning").select("feature_id", "area_code", "valid_date", "level_label").join(zones, "area_code")


@query("m02_warning_tiles", with_views("feature zone_tile", "SELECT feature_id, x, y FROM feature JOIN zone_tile USING (area_code) WHERE is_warning"))
def m02(t):
    return warning_tiles(t).select("feature_id", "x", "y")


view("settlement_tile", f"""SELECT DISTINCT settlement_id, zoom, x, y FROM (SELECT *, unnest(generate_series(cast(floor({ty('maxy', 'zoom')}) as bigint),cast(floor({ty('miny', 'zoom')}) as bigint))) AS y FROM
  (SELECT *, unnest(generate_series(cast(floor({tx('minx', 'zoom')}) as bigint),cast(floor({tx('maxx', 'zoom')}) as bigint))) AS x FROM (SELECT * FROM settlement_ring WHERE ring_no<>1) JOIN (SELECT unnest(generate_series(7,11)) AS zoom)
   ON population_rank >= CASE WHEN zoom<=8 THEN 4 WHEN zoom=9 THEN 3 WHEN zoom=10 THEN 2 ELSE 1 END OR is_capital))""", ["settlement_ring"])


def settlement_tiles(t):
    """A landing is few bytes for the work that each settlement makes, so its rows are dealt to all tasks first."""
    landed = spatial.spread(t.settlement_src(), "source_fid")
    rows = canonical.settlements(landed).withColumn("zoom", F.explode(F.sequence(F.lit(7), F.lit(11)))).filter(P.rank_floor(c("zoom")))
    rows = rows.select("settlement_id", "nombre", "zoom", "shape")
    return tiles.quantise(tiles.to_tiles(rows, "shape", tolerance_m=tiles.settlement_tolerance(c("zoom"))))


CL = "round_even(least(greatest(({0}-{1})*4096,-64),4160),0)"

view("settlement_geom", f"""SELECT settlement_id, zoom, x, y, cast(min(ax) as integer) AS minqx, cast(min(ay) as integer) AS minqy, cast(max(bx) as integer) AS maxqx, cast(max(b_y) as integer) AS maxqy,
   string_agg(CASE WHEN ring_no=1 THEN printf('%d %d,%d %d,%d %d,%d %d,%d %d',ax,ay,bx,ay,bx,b_y,ax,b_y,ax,ay) ELSE printf('%d %d,%d %d,%d %d,%d %d,%d %d',ax,ay,ax,b_y,bx,b_y,bx,ay,ax,ay) END, ';' ORDER BY ring_no) AS rings
  FROM (SELECT settlement_id, zoom, x, y, ring_no, cast({CL.format(tx('minx', 'zoom'), 'x')} as integer) AS ax, cast({CL.format(tx('maxx', 'zoom'), 'x')} as integer) AS bx,
  cast({CL.format(ty('maxy', 'zoom'), 'y')} as integer) AS ay, cast({CL.format(ty('miny', 'zoom'), 'y')} as integer) AS b_y FROM settlement_tile JOIN settlement_ring USING (settlement_id)) WHERE ax<bx AND ay<b_y GROUP BY ALL""", ["settlement_tile", "settlement_ring"])


@query("m03_settlement_tiles", with_views("settlement_geom", f"SELECT settlement_id, zoom, x, y, rings AS geom, {dr('156543.03392804097e0/pow(2.0e0,zoom)*CASE WHEN zoom<=8 THEN 0.35e0 WHEN zoom<=10 THEN 0.18e0 ELSE 0.08e0 END', 4)} AS tolerance_m FROM settlement_geom"))
def m03(t):
    return settlement_tiles(t).select("settlement_id", "zoom", "x", "y", tiles.rings_text(c("grid")).alias("geom"), S.dec_round(tiles.settlement_tolerance(c("zoom")), 4).alias("tolerance_m"))


view("road_tile", f"""WITH e AS (SELECT id_tramo, zoom, {tx('x1', 'zoom')} AS x1, {ty('y1', 'zoom')} AS y1, {tx('x2', 'zoom')} AS x2, {ty('y2', 'zoom')} AS y2 FROM road_edge JOIN road USING (id_tramo)
   JOIN (VALUES {CLASS_ZOOM}) k(clase,min_zoom) USING (clase) JOIN (SELECT unnest(generate_series(7,14)) AS zoom) ON zoom>=min_zoom),
  b AS (SELECT id_tramo, zoom, cast(floor(least(min(x1),min(x2))) as bigint) AS ax, cast(floor(greatest(max(x1),max(x2))) as bigint) AS bx, cast(floor(least(min(y1),min(y2))) as bigint) AS ay, cast(floor(greatest(max(y1),max(y2))) as bigint) AS b_y FROM e GROUP BY 1,2),
  g AS (SELECT id_tramo, zoom, x, unnest(generate_series(ay,b_y)) AS y FROM (SELECT *, unnest(generate_series(ax,bx)) AS x FROM b))
  SELECT id_tramo, zoom, x, y FROM g JOIN e USING (id_tramo, zoom) GROUP BY id_tramo, zoom, x, y HAVING {meets_sql('x1', 'y1', 'x2', 'y2', ('cast(x as double)', 'cast(y as double)', '(x+1.0e0)', '(y+1.0e0)'), closed=False)}""", ["road_edge", "road"])


ROAD_TOL = "CASE zoom WHEN 7 THEN 500.0e0 WHEN 8 THEN 250.0e0 WHEN 9 THEN 120.0e0 WHEN 10 THEN 60.0e0 WHEN 11 THEN 30.0e0 WHEN 12 THEN 15.0e0 WHEN 13 THEN 8.0e0 ELSE 4.0e0 END"
view("road_zoom_pt", f"""SELECT id_tramo, zoom, i, {tx('x', 'zoom')} AS px, {ty('y', 'zoom')} AS py, {ROAD_TOL}/(2*20037508.34e0)*pow(2.0e0,zoom) AS tol FROM road_pt JOIN road USING (id_tramo)
  JOIN (VALUES {CLASS_ZOOM}) k(clase,min_zoom) USING (clase) JOIN (SELECT unnest(generate_series(7,14)) AS zoom) ON zoom>=min_zoom""", ["road_pt", "road"])
split_views("road_zoom_simple", "road_zoom_pt", "id_tramo,zoom", ["road_zoom_pt"])


def reach_sql(start: str, step: str) -> tuple[str, str]:
    a, b = f"(-64-{start})/{step}", f"(4160-{start})/{step}"
    enter = f"CASE WHEN {step}=0 THEN CASE WHEN {start} BETWEEN -64 AND 4160 THEN 0.0e0 ELSE 2.0e0 END ELSE least({a},{b}) END"
    return enter, f"CASE WHEN {step}=0 THEN 1.0e0 ELSE greatest({a},{b}) END"


IN_X, OUT_X = reach_sql("gx", "dx")
IN_Y, OUT_Y = reach_sql("gy", "dy")
view("road_cut", f"""SELECT *, greatest({IN_X},{IN_Y},0.0e0) AS t0, least({OUT_X},{OUT_Y},1.0e0) AS t1 FROM (SELECT id_tramo, zoom, x, y, i, gx, gy, hx, hy, hx-gx AS dx, hy-gy AS dy FROM (SELECT id_tramo, zoom, x, y, i,
   (px-x)*4096 AS gx, (py-y)*4096 AS gy, (qx-x)*4096 AS hx, (qy-y)*4096 AS hy FROM road_tile JOIN
   (SELECT id_tramo, zoom, row_number() OVER w AS i, px, py, lead(px) OVER w AS qx, lead(py) OVER w AS qy FROM road_zoom_simple WINDOW w AS (PARTITION BY id_tramo, zoom ORDER BY i)) USING (id_tramo, zoom) WHERE qx IS NOT NULL))""", ["road_tile", "road_zoom_simple"])
PART = "cast(round_even(CASE WHEN {t}=0 THEN {g} WHEN {t}=1 THEN {h} ELSE {g}+{d}*{t} END,0) as integer)"
END_ = lambda t: f"{PART.format(t=t, g='gx', h='hx', d='dx')} AS qx, {PART.format(t=t, g='gy', h='hy', d='dy')} AS qy"
view("road_geom", f"""WITH p AS (SELECT *, sum(fresh) OVER (PARTITION BY id_tramo, zoom, x, y ORDER BY i) AS piece FROM (SELECT *, CASE WHEN t0>0 OR lag(i) OVER v IS NULL OR lag(i) OVER v<>i-1 THEN 1 ELSE 0 END AS fresh
   FROM road_cut WHERE t0<=t1 WINDOW v AS (PARTITION BY id_tramo, zoom, x, y ORDER BY i))),
  q AS (SELECT id_tramo, zoom, x, y, piece, i, 0 AS k, {END_('t0')} FROM p WHERE fresh=1 UNION ALL SELECT id_tramo, zoom, x, y, piece, i, 1, {END_('t1')} FROM p),
  d AS (SELECT *, lag(qx) OVER u AS lx, lag(qy) OVER u AS ly FROM q WINDOW u AS (PARTITION BY id_tramo, zoom, x, y, piece ORDER BY i, k)),
  g AS (SELECT id_tramo, zoom, x, y, piece, string_agg(qx||' '||qy, ',' ORDER BY i, k) AS line FROM d WHERE lx IS DISTINCT FROM qx OR ly IS DISTINCT FROM qy GROUP BY ALL HAVING count(*)>1)
  SELECT id_tramo, zoom, x, y, string_agg(line, ';' ORDER BY piece) AS geom FROM g GROUP BY ALL""", ["road_cut"])


def road_tiles(t):
    first = S.lookup(K.ROAD_CLASS_MIN_ZOOM, c("clase"))
    rows = pipeline.roads(t).filter(first.isNotNull() & (first <= 14)).select("id_tramo", "clase", "line", F.explode(F.sequence(first, F.lit(14))).alias("zoom"))
    return tiles.quantise_lines(tiles.to_tiles(rows, "line", closed=False, tolerance_m=S.lookup(K.ROAD_TOLERANCE_M, c("zoom"))))


@query("m04_road_tiles", with_views("road_geom", f"SELECT id_tramo, zoom, x, y, geom, {ROAD_TOL} AS tolerance_m FROM road_geom"))
def m04(t):
    return road_tiles(t).select("id_tramo", "zoom", "x", "y", tiles.lines_text(c("grid")).alias("geom"), S.lookup(K.ROAD_TOLERANCE_M, c("zoom")).alias("tolerance_m"))


@query("m05_quantised_settlements", with_views("settlement_geom", "SELECT * FROM settlement_geom"))
def m05(t):
    b = geo.ring_bbox(F.flatten("grid"))
    return settlement_tiles(t).select(
        "settlement_id", "zoom", "x", "y", b.minx.alias("minqx"), b.miny.alias("minqy"), b.maxx.alias("maxqx"), b.maxy.alias("maxqy"), tiles.rings_text(c("grid")).alias("rings")
    )


def side_views(name: str, source: str, bound: str, axis: str, sign: str) -> None:
    """A view of rings ``(area_code, x, y, i, gx, gy)`` cut at one side of the tile."""
    a, b = f"({sign}(g{axis}-({bound})))", f"({sign}(h{axis}-({bound})))"
    cut = ", ".join(f"g{n}+(h{n}-g{n})*({a}/nullif({a}-{b},0))" for n in "xy")
    view(name, f"""WITH e AS (SELECT *, lead(gx) OVER w AS hx, lead(gy) OVER w AS hy FROM {source} WINDOW w AS (PARTITION BY area_code, x, y ORDER BY i)),
   o AS (SELECT area_code, x, y, i*2 AS i, {cut.split(', ')[0]} AS gx, {cut.split(', ')[1]} AS gy FROM e WHERE hx IS NOT NULL AND ({a}>=0)<>({b}>=0) UNION ALL SELECT area_code, x, y, i*2+1, hx, hy FROM e WHERE hx IS NOT NULL AND {b}>=0)
   SELECT * FROM o UNION ALL SELECT area_code, x, y, max(i)+1, arg_min(gx,i), arg_min(gy,i) FROM o GROUP BY 1,2,3""", [source])


view("zone_side0", f"""SELECT area_code, x, y, i, ({tx('px', '9')}-x)*4096 AS gx, ({ty('py', '9')}-y)*4096 AS gy FROM zone_tile JOIN
  (SELECT area_code, i, x1 AS px, y1 AS py FROM zone_edge UNION ALL SELECT area_code, 5, x2, y2 FROM zone_edge WHERE i=4) USING (area_code)""", ["zone_tile", "zone_edge"])
for _n, (_axis, _bound, _sign) in enumerate((("x", "-64", ""), ("x", "4160", "-"), ("y", "-64", ""), ("y", "4160", "-"))):
    side_views(f"zone_side{_n + 1}", f"zone_side{_n}", _bound, _axis, _sign)
view("zone_geom", """WITH s AS (SELECT area_code, x, y, i, cast(round_even(gx,0) as integer) AS qx, cast(round_even(gy,0) as integer) AS qy FROM zone_side4),
  d AS (SELECT *, lag(qx) OVER w AS lx, lag(qy) OVER w AS ly FROM s WINDOW w AS (PARTITION BY area_code, x, y ORDER BY i)),
  l AS (SELECT area_code, x, y, count(*) AS n, sum(lx*qy-qx*ly) AS turn, list({'x': qx, 'y': qy} ORDER BY i) AS ps FROM d WHERE lx IS DISTINCT FROM qx OR ly IS DISTINCT FROM qy GROUP BY 1,2,3),
  r AS (SELECT area_code, x, y, ps[:-2] AS ps FROM l WHERE n>=4 AND turn<>0),
  f AS (SELECT *, list_position(ps, list_min(ps)) AS a FROM r)
  SELECT area_code, x, y, array_to_string(list_transform(list_concat(ps[a:], ps[:a]), lambda p: p.x||' '||p.y), ',') AS geom FROM f""".replace("ps[:-2]", "ps[1:len(ps)-1]"), ["zone_side4"])


def tile_rows(t):
    """Every layer's content as (zoom, x, y, layer, feature, props, geom)."""
    towns = settlement_tiles(t).select("zoom", "x", "y", F.lit("nucleos").alias("layer"), c("settlement_id").cast("string").alias("feature"), c("nombre").alias("props"), tiles.rings_text(c("grid")).alias("geom"))
    roads = road_tiles(t).select("zoom", "x", "y", F.lit("carreteras").alias("layer"), c("id_tramo").cast("string").alias("feature"), c("clase").alias("props"), tiles.lines_text(c("grid")).alias("geom"))
    zones = tiles.quantise(zone_tiles(t)).select("area_code", "zoom", "x", "y", tiles.rings_text(c("grid")).alias("geom"))
    alerts = warnings_of_zones(t, zones).select("zoom", "x", "y", F.lit("avisos").alias("layer"), c("feature_id").alias("feature"), c("level_label").alias("props"), "geom")
    return towns.unionByName(roads).unionByName(alerts)


view("tile_row", """SELECT zoom, x, y, 'nucleos' AS layer, cast(settlement_id as varchar) AS feature, nombre AS props, rings AS geom FROM settlement_geom JOIN (SELECT settlement_id, nombre FROM settlement) USING (settlement_id)
  UNION ALL SELECT zoom, x, y, 'carreteras', cast(id_tramo as varchar), clase, geom FROM road_geom JOIN (SELECT id_tramo, clase FROM road) USING (id_tramo) UNION ALL SELECT 9, x, y, 'avisos', feature_id, level_label, geom FROM feature JOIN zone_geom USING (area_code) WHERE is_warning""",
     ["settlement_geom", "road_geom", "feature", "zone_geom"])


@query("m06_tile_rows", with_views("tile_row", "SELECT * FROM tile_row"))
def m06(t):
    path = scratch_path(t.spark, "tiles")
    tiles.write_tiles(tile_rows(t), path)
    return t.spark.read.parquet(path).drop("strip").withColumn("zoom", c("zoom").cast("int"))


@query("m07_tile_feature_counts", with_views("tile_row", "SELECT zoom, x, y, layer, count(*) AS feature_count FROM tile_row GROUP BY ALL"))
def m07(t):
    return tile_rows(t).groupBy("zoom", "x", "y", "layer").agg(F.count("*").alias("feature_count"))

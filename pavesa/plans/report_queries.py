"""Joins, totals, top-k, set operations and named reports: families J, S, T, U, W, Z."""

from __future__ import annotations

from pyspark.sql import functions as F

from pavesa import constants as K
from pavesa.functions import geo
from pavesa.functions import parameters as P
from pavesa.functions import scalar as S
from pavesa.operators import canonical, lookup, regions, series
from pavesa.plans import pipeline, reports
from pavesa.plans import spatial_queries as SQ
from pavesa.plans.domain_sql import cover_area_sql, covers_sql, dr, view, with_views
from pavesa.plans.raster_queries import burnt_days
from pavesa.plans.refine_queries import day_text, time_sql, time_text
from pavesa.plans.registry import query
from pavesa.plans.scalar_queries import landcover_attributes
from pavesa.session import cut_lineage

NOW = "1998-01-15 12:00:00"
DAY = "1998-01-15"
c = F.col


def now():
    return F.lit(NOW).cast("timestamp")


def alerts(t):
    return reports.live_alerts(t.alerts())


# ---- joins ---------------------------------------------------------------------------------

view("work_key", "SELECT DISTINCT cap_identifier, language, area_code FROM warning_src JOIN warning_download USING (source_download_id) WHERE request_elaboration_to>=timestamp '2000-01-01'", ["warning_src", "warning_download"])


def work_keys(t):
    """Keys touched by the newest archives."""
    fresh = t.warning_download().filter("request_elaboration_to >= timestamp'2000-01-01'").select("source_download_id")
    return t.warning_src().join(fresh, "source_download_id", "left_semi").select("cap_identifier", "language", "area_code").distinct()


@query("j01_join_work_keys", with_views("warning_src work_key", "SELECT source_record_id, s.cap_identifier FROM warning_src s JOIN work_key k USING (cap_identifier, language, area_code)"))
def j01(t):
    return t.warning_src().join(work_keys(t), ["cap_identifier", "language", "area_code"]).select("source_record_id", "cap_identifier")


@query("j02_calendar_left_joins", with_views("hotspot_series", "SELECT strftime(nominal_date,'%Y-%m-%d') AS nominal_date, coverage_unit_count, hotspot_count FROM hotspot_series"))
def j02(t):
    return pipeline.hotspot_series(t).select(day_text("nominal_date"), "coverage_unit_count", "hotspot_count")


@query("j03_date_in_interval", with_views("warning_day", "SELECT warning_id, strftime(valid_date,'%Y-%m-%d') AS valid_date FROM warning_day"))
def j03(t):
    return canonical.explode_days(pipeline.warnings(t)).select("warning_id", day_text("valid_date"))


SERVICE = ["p_partkey + 10 AS id_tramo", "concat('VIAL_TR', cast(p_partkey + 10 as string)) AS inspire_id"]
view("service_road", "SELECT p_partkey+10 AS id_tramo, 'VIAL_TR'||(p_partkey+10) AS inspire_id FROM part")


@query("j08_attribute_enrichment", with_views("service_road road", """SELECT s.id_tramo, s.inspire_id, clase, nombre, n_carriles, CASE WHEN r.id_tramo IS NULL THEN 'servicio (sin enriquecer)' ELSE 'servicio + local' END AS fuente FROM service_road s LEFT JOIN road r USING (id_tramo)"""))
def j08(t):
    local = pipeline.roads(t).select("id_tramo", "clase", "nombre", "n_carriles", F.lit(True).alias("known"))
    label = F.when(c("known"), "servicio + local").otherwise("servicio (sin enriquecer)")
    return t.raw("part").selectExpr(*SERVICE).join(local, "id_tramo", "left").select("id_tramo", "inspire_id", "clase", "nombre", "n_carriles", label.alias("fuente"))


def primary_or_fallback(primary, fallback, healthy):
    """The whole primary result, or the whole fallback when the health check is false."""
    flag = healthy.select("ok").scalar()
    return primary.filter(flag).unionByName(fallback.filter(~flag))


@query("j09_primary_or_fallback", with_views("road service_road", """WITH ok AS (SELECT count(*) FILTER (o_orderstatus='F')*2 > count(*) AS ok FROM orders) SELECT id_tramo, 'servicio' AS fuente FROM service_road WHERE (SELECT ok FROM ok)
  UNION ALL SELECT id_tramo, 'local' FROM road WHERE NOT (SELECT ok FROM ok)"""))
def j09(t):
    healthy = t.raw("orders").agg((F.count_if(c("o_orderstatus") == "F") * 2 > F.count("*")).alias("ok"))
    primary = t.raw("part").selectExpr(*SERVICE).select("id_tramo", F.lit("servicio").alias("fuente"))
    return primary_or_fallback(primary, pipeline.roads(t).select("id_tramo", F.lit("local").alias("fuente")), healthy)


view("cat_state", """SELECT i.dataset_version, i.delivery_format, i.nominal_date, coalesce(d.publication_status,'cataloged') AS publication_status, coalesce(d.local_tiles_path IS NOT NULL,false) AS has_local_tiles
  FROM (SELECT DISTINCT dataset_version, delivery_format, nominal_date FROM catalog_item) i LEFT JOIN (SELECT * FROM daily_file WHERE publication_status<>'cataloged') d USING (dataset_version, delivery_format, nominal_date)""", ["catalog_item", "daily_file"])


def catalog_state(t):
    files = canonical.daily_files(t.catalog_item())
    return reports.catalog_with_state(files, files.filter("publication_status <> 'cataloged'"))


@query("j10_catalog_publication_state", with_views("cat_state", "SELECT * REPLACE (strftime(nominal_date,'%Y-%m-%d') AS nominal_date) FROM cat_state"))
def j10(t):
    return catalog_state(t).withColumn("nominal_date", F.date_format("nominal_date", "yyyy-MM-dd"))


@query("j12_semi_anti", with_views("warning_src work_key", """SELECT source_record_id, (cap_identifier, language, area_code) IN (SELECT (cap_identifier, language, area_code) FROM work_key) AS affected FROM warning_src"""))
def j12(t):
    keys = ["cap_identifier", "language", "area_code"]
    rows, wanted = t.warning_src(), work_keys(t)
    hit = rows.join(wanted, keys, "left_semi").select("source_record_id", F.lit(True).alias("affected"))
    miss = rows.join(wanted, keys, "left_anti").select("source_record_id", F.lit(False).alias("affected"))
    return hit.unionByName(miss)


@query("j13_one_row_parameters", with_views("settlement", "SELECT settlement_id FROM settlement WHERE maxx>=-4 AND minx<=-3 AND maxy>=40 AND miny<=41"))
def j13(t):
    b = c("bbox")
    return pipeline.settlements(t).filter(geo.box_overlaps(b.minx, b.miny, b.maxx, b.maxy, (-4.0, 40.0, -3.0, 41.0))).select("settlement_id")


@query("j14_lateral_dates", with_views("hotspot_download", """SELECT source_download_id, strftime(cast(unnest(generate_series(cast(request_date_from as timestamp),cast(request_date_to as timestamp),interval 1 day)) as date),'%Y-%m-%d') AS day FROM hotspot_download"""))
def j14(t):
    days = F.explode(F.sequence("request_date_from", "request_date_to")).alias("day")
    return t.hotspot_download().select("source_download_id", days).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


NAMES = (
    "CASE c_custkey % 9 WHEN 0 THEN 'córdoba' WHEN 1 THEN ' Castilla' WHEN 2 THEN 'LEÓN' WHEN 3 THEN c_mktsegment WHEN 4 THEN 'Zaragoza'"
    " WHEN 5 THEN substring(c_mktsegment, 1, 5) WHEN 6 THEN 'xyz' WHEN 7 THEN concat(lower(c_mktsegment), ' ', cast(c_custkey % 100 as string)) ELSE '' END"
)
PLACES = ",".join(
    f"({i},'{kind}','{k}',{b[0]},{b[1]},{b[2]},{b[3]})"
    for i, (k, kind, b) in enumerate([(k, "ccaa", b) for k, b in K.PLACE_REGIONS.items()] + [(k, "provincia", b) for k, b in K.PLACE_PROVINCES.items()])
)
view("asked_name", f"SELECT DISTINCT {NAMES.replace('as string', 'as varchar')} AS name FROM customer")
view("place", f"SELECT * FROM (VALUES {PLACES}) t(ord,kind,name,minx,miny,maxx,maxy)")
view("place_hit", """SELECT a.name AS asked, p.* EXCLUDE (ord) FROM asked_name a JOIN place p ON contains(strip_accents(lower(p.name)), strip_accents(lower(trim(a.name)))) AND trim(a.name)<>'' QUALIFY row_number() OVER (PARTITION BY a.name ORDER BY p.ord)=1""", ["asked_name", "place"])
view("town_hit", """SELECT a.name AS asked, 'municipio' AS kind, s.nombre AS name, minx, miny, maxx, maxy FROM asked_name a JOIN settlement s ON contains(lower(s.nombre), lower(a.name)) WHERE trim(a.name)<>'' AND a.name NOT IN (SELECT asked FROM place_hit)
  QUALIFY row_number() OVER (PARTITION BY a.name ORDER BY habitantes DESC, settlement_id)=1""", ["asked_name", "settlement", "place_hit"])
view("resolved", "SELECT a.name AS asked, h.name AS place, kind, minx, miny, maxx, maxy FROM asked_name a LEFT JOIN (SELECT * FROM place_hit UNION ALL BY NAME SELECT * FROM town_hit) h ON h.asked=a.name", ["asked_name", "place_hit", "town_hit"])
BOX5 = ", ".join(f"{dr(f'cast({n} as double)', 5)} AS {n}" for n in ("minx", "miny", "maxx", "maxy"))


@query("j16_place_resolve", with_views("resolved", f"SELECT asked, place, kind, {BOX5} FROM resolved"))
def j16(t):
    names = t.raw("customer").select(F.expr(NAMES).alias("name"))
    found = lookup.resolve_places(names, pipeline.settlements(t))
    return found.select("asked", "place", "kind", *[S.dec_round(c(n), 5).alias(n) for n in ("minx", "miny", "maxx", "maxy")])


TERM = "CASE p_partkey % 6 WHEN 0 THEN ' frp' WHEN 1 THEN 'burnt area V4' WHEN 2 THEN 'drought' WHEN 3 THEN 'Land Cover' WHEN 4 THEN p_brand ELSE 't = 10' END"
GLOSS = ",".join(f"({i},'{k}','{n}','{lng}')" for i, (k, n, lng) in enumerate(K.GLOSSARY))


@query("j17_glossary_resolve", f"""WITH g AS (SELECT * FROM (VALUES {GLOSS}) t(ord,k,n,l)), a AS (SELECT p_partkey, {TERM} AS term FROM part)
  SELECT p_partkey, term, k IS NOT NULL AS found, k AS key, l AS long_name FROM a LEFT JOIN (SELECT DISTINCT term, k, l FROM (SELECT term, k, l, row_number() OVER (PARTITION BY term ORDER BY replace(upper(k),' ','')<>replace(upper(trim(term)),' ',''), ord) AS rn
   FROM (SELECT DISTINCT term FROM a) JOIN g ON contains(replace(upper(n),' ',''),replace(upper(trim(term)),' ','')) OR contains(replace(upper(l),' ',''),replace(upper(trim(term)),' ','')) OR contains(replace(upper(k),' ',''),replace(upper(trim(term)),' ',''))) WHERE rn=1) USING (term)""")
def j17(t):
    return lookup.explain_terms(t.raw("part").select("p_partkey", F.expr(TERM).alias("term")))


# ---- totals --------------------------------------------------------------------------------


@query("s12_counts_by_key", with_views("alert", "SELECT 'level' AS kind, level AS key, count(*) AS n FROM alert GROUP BY level UNION ALL SELECT 'event', coalesce(nullif(event,''),'Desconocido'), count(*) FROM alert GROUP BY 2"))
def s12(t):
    rows = alerts(t)
    return reports.counts_by(rows, "level").select(F.lit("level").alias("kind"), "key", "n").unionByName(
        reports.counts_by(rows, "event").select(F.lit("event").alias("kind"), "key", "n")
    )


STATES = f"""count(*) FILTER (onset<=timestamp '{NOW}' AND expires>=timestamp '{NOW}') AS active, count(*) FILTER (expires>=timestamp '{NOW}' AND onset>timestamp '{NOW}') AS upcoming, count(*) FILTER (expires<timestamp '{NOW}') AS expired"""


@query("s13_alert_states", with_views("alert", f"SELECT *, active+upcoming AS total FROM (SELECT {STATES} FROM alert)"))
def s13(t):
    return reports.alert_state_counts(alerts(t), now())


DASH = f"""WITH st AS (SELECT {STATES} FROM alert)
 SELECT 'alerts' AS component, 'total' AS metric, cast(active+upcoming as double) AS value FROM st UNION ALL SELECT 'alerts','active',active FROM st UNION ALL SELECT 'alerts','upcoming',upcoming FROM st UNION ALL SELECT 'alerts','expired',expired FROM st
 UNION ALL SELECT 'alerts_by_level', level, count(*) FROM alert WHERE expires>=timestamp '{NOW}' GROUP BY level
 UNION ALL SELECT 'fires','total',count(*) FROM live_fire UNION ALL SELECT 'fires','frp_max',coalesce(max(coalesce(frp,0)),0) FROM live_fire
 UNION ALL SELECT 'fires_by_intensity', intensity_label, count(*) FROM live_fire GROUP BY 2"""


@query("s14_dashboard_stats", with_views("alert live_fire", DASH))
def s14(t):
    return reports.dashboard(alerts(t), SQ.live_fires(t), now())


BSUM = f"""SELECT count(*) AS total_days, {dr('coalesce(sum(coalesce(burned_area_ha,0)),0)', 2)} AS total_burned_area_ha, strftime(arg_min(nominal_date, (-coalesce(burned_area_ha,0), nominal_date)),'%Y-%m-%d') AS peak_day, {dr('max(coalesce(burned_area_ha,0))', 2)} AS peak_area_ha FROM burnt_stat"""


@query("s15_burnt_area_period", with_views("burnt_stat", BSUM))
def s15(t):
    return reports.burnt_area_summary(burnt_days(t)).withColumn("peak_day", F.date_format("peak_day", "yyyy-MM-dd")).withColumn("peak_area_ha", S.dec_round(c("peak_area_ha"), 2))


WHIST = """SELECT count(*) AS total_days, cast(sum(warning_count) as bigint) AS total_warning_count, cast(sum(red_count) as bigint) AS total_red_count, cast(sum(orange_count) as bigint) AS total_orange_count,
  cast(sum(yellow_count) as bigint) AS total_yellow_count, cast(sum(green_count) as bigint) AS total_green_count,
  strftime(arg_min(nominal_date, (-max_temperature_c, nominal_date)) FILTER (max_temperature_c IS NOT NULL),'%Y-%m-%d') AS peak_day, max(max_temperature_c) AS peak_temperature_c FROM warning_series"""


@query("s16_warning_history", with_views("warning_series", WHIST))
def s16(t):
    return reports.warning_history(pipeline.warning_series(t)).withColumn("peak_day", F.date_format("peak_day", "yyyy-MM-dd"))


@query("s17_layer_variants", with_views("cat_state", """SELECT v AS dataset_version, f AS delivery_format, count(s.nominal_date) AS date_count, strftime(min(s.nominal_date),'%Y-%m-%d') AS min_date, strftime(max(s.nominal_date),'%Y-%m-%d') AS max_date,
  count(*) FILTER (has_local_tiles) AS published_date_count FROM (VALUES ('v3'),('v4')) a(v), (VALUES ('cog'),('nc'),('zarr')) b(f) LEFT JOIN cat_state s ON s.dataset_version=v AND s.delivery_format=f GROUP BY 1,2"""))
def s17(t):
    return reports.variant_metadata(catalog_state(t))


@query("s18_settlement_metadata", with_views("settlement", "SELECT count(*) AS feature_count, " + ", ".join(f"{dr(f'{a}({n})', 5)} AS {n}" for a, n in (("min", "minx"), ("min", "miny"), ("max", "maxx"), ("max", "maxy"))) + " FROM settlement"))
def s18(t):
    b = c("bbox")
    return pipeline.settlements(t).agg(
        F.count("*").alias("feature_count"), S.dec_round(F.min(b.minx), 5).alias("minx"), S.dec_round(F.min(b.miny), 5).alias("miny"),
        S.dec_round(F.max(b.maxx), 5).alias("maxx"), S.dec_round(F.max(b.maxy), 5).alias("maxy"),
    )


@query("s19_stage_verification", with_views("settlement settlement_src", """SELECT 'source' AS stage, 'all' AS key, count(*) AS total FROM settlement_src UNION ALL SELECT 'core','all',count(*) FROM settlement UNION ALL SELECT 'core_class',population_class,count(*) FROM settlement GROUP BY 2
  UNION ALL SELECT 'unpopulated','all',count(*) FROM settlement_src WHERE coalesce(habit_0502,0)<=0"""))
def s19(t):
    src, core = t.settlement_src(), pipeline.settlements(t)
    one = lambda df, stage: df.agg(F.count("*").alias("total")).select(F.lit(stage).alias("stage"), F.lit("all").alias("key"), "total")
    classes = core.groupBy(c("population_class").alias("key")).agg(F.count("*").alias("total")).select(F.lit("core_class").alias("stage"), "key", "total")
    idle = src.filter(F.coalesce("habit_0502", F.lit(0.0)) <= 0)
    return one(src, "source").unionByName(one(core, "core")).unionByName(classes).unionByName(one(idle, "unpopulated"))


@query("s20_territory_totals", with_views("road_src", "SELECT count(*) AS features, count(DISTINCT source_zip_name) AS territories, count(DISTINCT id_tramo) AS segments FROM road_src"))
def s20(t):
    return t.road_src().agg(F.count("*").alias("features"), F.countDistinct("source_zip_name").alias("territories"), F.countDistinct("id_tramo").alias("segments"))


def live_reasons(t):
    rows = regions.flag_in_region(t.hotspot_obs(), t.region_edges())
    reason = (
        F.when(c("latitude").isNull() | c("longitude").isNull(), "bad_coordinate")
        .when(~c("in_region"), "outside_region")
        .when(~F.coalesce(c("confidence").isin("n", "h"), F.lit(False)), "low_confidence")
        .otherwise("kept")
    )
    return rows.withColumn("reason", reason)


@query("s22_exclusion_counts", with_views("hotspot_in", """SELECT firms_source, CASE WHEN NOT in_region THEN 'outside_region' WHEN confidence IN ('n','h') THEN 'kept' ELSE 'low_confidence' END AS reason, count(*) AS n FROM hotspot_in GROUP BY 1,2"""))
def s22(t):
    return live_reasons(t).groupBy("firms_source", "reason").agg(F.count("*").alias("n"))


LOG = "to_json(named_struct('kind', 'chat_interaction', 'model', concat('model-', cast(conv_id % 3 as string)), 'latency_ms', length(text) * 7, 'iterations', turn + 1, 'truncated', turn = 6))"


@query("s23_interaction_metrics", """SELECT model, count(*) AS n, max(latency) AS max_latency_ms, cast(sum(latency) as bigint) AS total_latency_ms, quantile_disc(latency, 0.5) AS median_latency_ms, cast(sum(it) as bigint) AS iterations, count(*) FILTER (tr) AS truncated
  FROM (SELECT 'model-'||(conv_id%3) AS model, length(text)*7 AS latency, turn+1 AS it, turn=6 AS tr FROM conversations) GROUP BY model""")
def s23(t):
    schema = "kind string, model string, latency_ms bigint, iterations bigint, truncated boolean"
    log = t.raw("conversations").select(F.from_json(F.expr(LOG), schema).alias("e")).select("e.*").filter("kind = 'chat_interaction'")
    return log.groupBy("model").agg(
        F.count("*").alias("n"), F.max("latency_ms").alias("max_latency_ms"), F.sum("latency_ms").alias("total_latency_ms"),
        F.percentile_approx("latency_ms", 0.5, 100000).alias("median_latency_ms"), F.sum("iterations").alias("iterations"), F.count_if("truncated").alias("truncated"),
    )


GRID_T = "2001-07-01 00:00:00"


@query("s24_hour_grid", with_views("alerts", f"""SELECT strftime(h,'%Y-%m-%d %H:%M') AS hour, count(a.id) AS active_count FROM (SELECT unnest(generate_series(timestamp '{GRID_T}',(SELECT max(expires) FROM alerts),interval 1 hour)) AS h)
  LEFT JOIN alerts a ON a.onset<=h AND a.expires>=h GROUP BY h"""))
def s24(t):
    return reports.hour_grid(t.alerts(), GRID_T)


# ---- windows -------------------------------------------------------------------------------

view("timeline", f"""SELECT dataset_version, delivery_format, c.nominal_date, publication_status, has_local_tiles, burned_area_ha, burned_pixel_count,
  sum(burned_area_ha) OVER w AS cumulative_burned_area_ha, cast(sum(burned_pixel_count) OVER w as bigint) AS cumulative_burned_pixel_count, cast(sum(cast(has_local_tiles as integer)) OVER w as bigint) AS cumulative_tile_date_count
  FROM cat_state c LEFT JOIN burnt_stat b USING (nominal_date) WINDOW w AS (PARTITION BY dataset_version, delivery_format ORDER BY c.nominal_date ROWS UNBOUNDED PRECEDING)""", ["cat_state", "burnt_stat"])
TL = f"dataset_version, delivery_format, strftime(nominal_date,'%Y-%m-%d') AS nominal_date, has_local_tiles, {dr('cumulative_burned_area_ha', 2)} AS cumulative_burned_area_ha, cumulative_burned_pixel_count, cumulative_tile_date_count, cumulative_tile_date_count>0 AS has_cumulative_tiles"


def timeline(t):
    return reports.burnt_area_timeline(catalog_state(t), burnt_days(t))


def _timeline_out(df, *more):
    return df.select(
        "dataset_version", "delivery_format", day_text("nominal_date"), "has_local_tiles", S.dec_round(c("cumulative_burned_area_ha"), 2).alias("cumulative_burned_area_ha"),
        "cumulative_burned_pixel_count", "cumulative_tile_date_count", "has_cumulative_tiles", *more,
    )


@query("w04_running_totals", with_views("timeline", f"SELECT {TL} FROM timeline"))
def w04(t):
    return _timeline_out(timeline(t))


@query("w05_cumulative_as_of", with_views("timeline", f"""SELECT dataset_version, delivery_format, {dr('arg_max(cumulative_burned_area_ha, nominal_date)', 2)} AS area_ha, arg_max(cumulative_burned_pixel_count, nominal_date) AS pixels, arg_max(cumulative_tile_date_count, nominal_date) AS tile_dates
  FROM timeline WHERE nominal_date<=date '1999-06-30' GROUP BY 1,2"""))
def w05(t):
    upto = timeline(t).filter("nominal_date <= date'1999-06-30'").groupBy("dataset_version", "delivery_format")
    last = lambda n: F.max_by(n, "nominal_date")
    return upto.agg(
        S.dec_round(last("cumulative_burned_area_ha"), 2).alias("area_ha"), last("cumulative_burned_pixel_count").alias("pixels"), last("cumulative_tile_date_count").alias("tile_dates")
    )


# ---- top-k and set operations --------------------------------------------------------------


@query("t01_topk_probe", with_views("near_hist", f"SELECT hotspot_id, {dr('distance_m', 1)} AS distance_m, (SELECT count(*) FROM near_hist)>100 AS truncated FROM near_hist ORDER BY round_even(near_hist.distance_m*1e4,0), hotspot_id LIMIT 100"))
def t01(t):
    near = SQ.hotspots_near_settlements(pipeline.hotspots(t), pipeline.settlements(t), SQ.FAR_M)
    top = series.top_with_probe(near, [F.rint(c("distance_m") * 1e4), c("hotspot_id")], 100)
    return top.select("hotspot_id", S.dec_round(c("distance_m"), 1).alias("distance_m"), "truncated")


@query("t02_topk_total", with_views("alert", "SELECT id, level, (SELECT count(*) FROM alert WHERE level='Rojo') AS total_matched, true AS truncated FROM alert WHERE level='Rojo' ORDER BY onset, cast(id as bigint) LIMIT 25"))
def t02(t):
    rows = alerts(t).filter("level = 'Rojo'")
    return series.top_with_total(rows, [c("onset"), c("id").cast("bigint")], 25).select("id", "level", "total_matched", "truncated")


@query("t03_hotspot_features_order", with_views("hotspot", "SELECT hotspot_id, acq_time, frp, firms_source FROM hotspot WHERE acq_date=date '2024-01-10' ORDER BY observed_at DESC, frp DESC NULLS LAST, firms_source, hotspot_id LIMIT 50"))
def t03(t):
    rows = pipeline.hotspots(t).filter("acq_date = date'2024-01-10'")
    order = [c("observed_at").desc_nulls_last(), c("frp").desc_nulls_last(), c("firms_source"), c("hotspot_id")]
    return rows.orderBy(*order).limit(50).select("hotspot_id", "acq_time", "frp", "firms_source")


@query("t04_warning_features_order", with_views("feature", f"SELECT feature_id, level_rank, temperature_max_c FROM feature WHERE valid_date=date '{DAY}' AND is_warning ORDER BY level_rank DESC, temperature_max_c DESC NULLS LAST, area_name LIMIT 20"))
def t04(t):
    rows = pipeline.features(t).filter(f"valid_date = date'{DAY}' AND is_warning")
    return rows.orderBy(c("level_rank").desc(), c("temperature_max_c").desc_nulls_last(), c("area_name")).limit(20).select("feature_id", "level_rank", "temperature_max_c")


@query("t05_roads_in_box_order", with_views("road road_pt", "SELECT id_tramo, clase_code FROM road WHERE id_tramo IN (SELECT id_tramo FROM road_pt GROUP BY 1 HAVING min(x)<=-1 AND max(x)>=-5 AND min(y)<=42 AND max(y)>=38) ORDER BY clase_code NULLS LAST, id_tramo LIMIT 100"))
def t05(t):
    b = geo.ring_bbox(c("line"))
    rows = pipeline.roads(t).filter(geo.box_overlaps(b.minx, b.miny, b.maxx, b.maxy, (-5.0, 38.0, -1.0, 42.0)))
    return rows.orderBy(c("clase_code").asc_nulls_last(), c("id_tramo")).limit(100).select("id_tramo", c("clase_code").cast("bigint").alias("clase_code"))


LEVEL_ORDER = "CASE level WHEN 'Rojo' THEN 0 WHEN 'Naranja' THEN 1 WHEN 'Amarillo' THEN 2 WHEN 'Verde' THEN 3 ELSE 9 END"


@query("t06_alert_list_order", with_views("alert", f"SELECT id, level, onset<=timestamp '{NOW}' AND expires>=timestamp '{NOW}' AS is_active FROM alert WHERE expires>=timestamp '{NOW}' ORDER BY 3 DESC, {LEVEL_ORDER}, cast(id as bigint) LIMIT 200"))
def t06(t):
    rows = alerts(t).filter(c("expires") >= now()).withColumn("is_active", (c("onset") <= now()) & (c("expires") >= now()))
    return rows.orderBy(c("is_active").desc(), F.expr(LEVEL_ORDER), c("id").cast("bigint")).limit(200).select("id", "level", "is_active")


@query("t07_fires_by_frp", with_views("live_fire", "SELECT fire_id, frp, CASE WHEN coalesce(frp,0)>=200 THEN 0 WHEN coalesce(frp,0)>=50 THEN 1 WHEN coalesce(frp,0)>=10 THEN 2 ELSE 3 END AS frp_group FROM live_fire ORDER BY coalesce(frp,0) DESC, acq_date DESC, acq_time DESC, fire_id LIMIT 300"))
def t07(t):
    order = [F.coalesce("frp", F.lit(0.0)).desc(), c("acq_date").desc(), c("acq_time").desc(), c("fire_id")]
    return SQ.live_fires(t).orderBy(*order).limit(300).select("fire_id", "frp", S.frp_group(c("frp")).alias("frp_group"))


@query("t08_nearest_one_per_row", with_views("near_live", "SELECT fire_id, settlement_id FROM near_live"))
def t08(t):
    return SQ.fires_near_settlements(SQ.live_fires(t), pipeline.settlements(t), SQ.NEAR_M, 50000).select("fire_id", "settlement_id")


@query("u01_union_distinct_dates", with_views("warning_day work_key", "SELECT strftime(valid_date,'%Y-%m-%d') AS valid_date FROM (SELECT valid_date FROM warning_day JOIN work_key USING (cap_identifier, language, area_code) UNION SELECT cast(onset_at as date) FROM warning_src JOIN work_key USING (cap_identifier, language, area_code))"))
def u01(t):
    keys = ["cap_identifier", "language", "area_code"]
    wanted = work_keys(t)
    new = canonical.explode_days(pipeline.warnings(t).join(wanted, keys, "left_semi")).select("valid_date")
    old = t.warning_src().join(wanted, keys, "left_semi").select(F.to_date("onset_at").alias("valid_date"))
    return new.union(old).distinct().select(day_text("valid_date"))


@query("u02_union_all_stage_counts", with_views("warning_src warning feature", "SELECT 'source' AS stage, count(*) AS total FROM warning_src UNION ALL SELECT 'core', count(*) FROM warning UNION ALL SELECT 'pub', count(*) FROM feature"))
def u02(t):
    n = lambda df, stage: df.agg(F.count("*").alias("total")).select(F.lit(stage).alias("stage"), "total")
    return n(t.warning_src(), "source").unionByName(n(pipeline.warnings(t), "core")).unionByName(n(pipeline.features(t), "pub"))


ALL_DAYS = "SELECT nominal_date AS d FROM hotspot_series UNION SELECT nominal_date FROM warning_series UNION SELECT nominal_date FROM cat_state WHERE dataset_version='v4' AND delivery_format='cog'"


def layer_days(t):
    burnt = catalog_state(t).filter("dataset_version = 'v4' AND delivery_format = 'cog'").select("nominal_date")
    return pipeline.hotspot_calendar(t).unionByName(pipeline.warning_calendar(t)).unionByName(burnt).distinct()


@query("u03_timeline_union", with_views("hotspot_series warning_series cat_state", f"SELECT strftime(d,'%Y-%m-%d') AS day FROM ({ALL_DAYS})"))
def u03(t):
    return layer_days(t).orderBy("nominal_date").select(F.date_format("nominal_date", "yyyy-MM-dd").alias("day"))


@query("u04_timeline_bounds", with_views("hotspot_series warning_series cat_state", f"SELECT least(strftime(min(d),'%Y-%m-%d'),'2025-05-01') AS start_day, greatest(strftime(max(d),'%Y-%m-%d'),'2025-08-31') AS end_day FROM ({ALL_DAYS})"))
def u04(t):
    text = lambda v: F.date_format(v, "yyyy-MM-dd")
    return layer_days(t).agg(
        F.least(text(F.min("nominal_date")), F.lit(K.BURNT_DEFAULT_FROM)).alias("start_day"), F.greatest(text(F.max("nominal_date")), F.lit(K.BURNT_DEFAULT_TO)).alias("end_day")
    )


@query("u05_distinct_events", with_views("alert", "SELECT DISTINCT trim(regexp_replace(regexp_replace(event_text,'(?i)\\s*(amarillo|naranja|rojo|verde|nivel\\s*\\d)','','g'),'\\s+',' ','g')) AS event FROM alert"))
def u05(t):
    return t.alerts().select(S.display_event_title(c("event_text")).alias("event")).distinct().orderBy("event")


@query("u06_concat_pulls", with_views("hotspot_obs", "SELECT source_observation_id, firms_source, bbox_region FROM hotspot_obs"))
def u06(t):
    obs = t.hotspot_obs()
    pulls = [obs.filter(c("firms_source") == s).select("source_observation_id", "firms_source", "bbox_region") for s in K.HOTSPOT_SOURCES]
    return pulls[0].unionByName(pulls[1], allowMissingColumns=True)


# ---- named reports -------------------------------------------------------------------------


@query("z01_query_alerts", with_views("alert", f"""SELECT id, event, level, area_name, {time_sql('onset expires')}, (SELECT count(*) FROM alert WHERE onset<=timestamp '{NOW}' AND expires>=timestamp '{NOW}') AS total_matched
  FROM alert WHERE alert.onset<=timestamp '{NOW}' AND alert.expires>=timestamp '{NOW}' ORDER BY cast(id as bigint) LIMIT 25"""))
def z01(t):
    hits = reports.query_alerts(alerts(t), now())
    return series.top_with_total(hits, [c("id").cast("bigint")], 25).select("id", "event", "level", "area_name", time_text("onset"), time_text("expires"), "total_matched")


@query("z02_query_fires", with_views("live_fire", """SELECT fire_id, latitude, longitude, frp, acq_date, acq_time, satellite, sensor, confidence_label, intensity_label, (SELECT count(*) FROM live_fire WHERE coalesce(frp,0)>=5) AS total_matched,
  (SELECT max(frp) FROM live_fire) AS max_frp FROM live_fire WHERE coalesce(frp,0)>=5 ORDER BY coalesce(frp,0) DESC, fire_id LIMIT 25"""))
def z02(t):
    hits = SQ.live_fires(t).filter(P.fire_filter(min_frp=5.0))
    top = series.top_with_total(hits, [F.coalesce("frp", F.lit(0.0)).desc(), c("fire_id")], 25)
    top = series.join_one_row(top, hits.agg(F.max(F.coalesce("frp", F.lit(0.0))).alias("max_frp")))
    return top.drop("firms_source", "truncated")


@query("z03_query_burnt_area", with_views("burnt_stat", BSUM + " WHERE nominal_date BETWEEN date '1997-05-01' AND date '1997-08-31'"))
def z03(t):
    days = burnt_days(t).filter(P.date_range("nominal_date", "1997-05-01", "1997-08-31"))
    return reports.burnt_area_summary(days).withColumn("peak_day", F.date_format("peak_day", "yyyy-MM-dd")).withColumn("peak_area_ha", S.dec_round(c("peak_area_ha"), 2))


@query("z04_warning_history", with_views("warning_series", WHIST + " WHERE nominal_date BETWEEN date '1997-05-01' AND date '1997-08-31'"))
def z04(t):
    days = pipeline.warning_series(t).filter(P.date_range("nominal_date", "1997-05-01", "1997-08-31"))
    return reports.warning_history(days).withColumn("peak_day", F.date_format("peak_day", "yyyy-MM-dd"))


@query("z05_fires_near_population", with_views("near_hist", f"""SELECT hotspot_id, firms_source, strftime(acq_date,'%Y-%m-%d') AS acq_date, frp, confidence, latitude, longitude, nombre, habitantes, {dr('distance_m', 1)} AS distance_m,
  (SELECT count(*) FROM near_hist WHERE acq_date BETWEEN date '2024-01-03' AND date '2024-01-25')>100 AS truncated FROM near_hist WHERE near_hist.acq_date BETWEEN date '2024-01-03' AND date '2024-01-25' ORDER BY round_even(near_hist.distance_m*1e4,0), hotspot_id LIMIT 100"""))
def z05(t):
    spots = pipeline.hotspots(t).filter(P.date_range("acq_date", "2024-01-03", "2024-01-25"))
    near = SQ.hotspots_near_settlements(spots, pipeline.settlements(t), SQ.FAR_M)
    top = series.top_with_probe(near, [F.rint(c("distance_m") * 1e4), c("hotspot_id")], 100)
    return top.select(
        "hotspot_id", "firms_source", day_text("acq_date"), "frp", "confidence", "latitude", "longitude", "nombre", "habitantes", S.dec_round(c("distance_m"), 1).alias("distance_m"), "truncated"
    )


Z06_ORDER = "round_even(distance_m*1e4,0), frp DESC NULLS LAST, fire_id"
Z06_COLS = f"fire_id, sensor, frp, confidence_label, latitude, longitude, settlement_id, nombre, habitantes, {dr('nucleo_lon', 5)} AS nucleo_lon, {dr('nucleo_lat', 5)} AS nucleo_lat, {dr('x.distance_m', 1)} AS distance_m"


def near_live_top(t):
    near = SQ.fires_near_settlements(SQ.live_fires(t), pipeline.settlements(t), SQ.NEAR_M, 50000)
    top = series.top_with_probe(near, [F.rint(c("distance_m") * 1e4), c("frp").desc_nulls_last(), c("fire_id")], 50)
    return top.withColumn("distance_m", S.dec_round(c("distance_m"), 1)).withColumn("nucleo_lon", S.dec_round(c("nucleo_lon"), 5)).withColumn("nucleo_lat", S.dec_round(c("nucleo_lat"), 5))


@query("z06_active_fires_near_population", with_views("near_live", f"SELECT {Z06_COLS}, (SELECT count(*) FROM near_live)>50 AS truncated FROM (SELECT * FROM near_live ORDER BY {Z06_ORDER} LIMIT 50) x"))
def z06(t):
    return near_live_top(t).select(
        "fire_id", "sensor", "frp", "confidence_label", "latitude", "longitude", "settlement_id", "nombre", "habitantes", "nucleo_lon", "nucleo_lat", "distance_m", "truncated"
    )


@query("b11_result_map_rows", with_views("near_live", f"""WITH x AS (SELECT {Z06_COLS} FROM (SELECT * FROM near_live ORDER BY {Z06_ORDER} LIMIT 50) x)
  SELECT fire_id, kind, lon1, lat1, lon2, lat2, {dr('least(min(longitude) OVER (), min(nucleo_lon) OVER ())-0.03', 5)} AS minx, {dr('greatest(max(latitude) OVER (), max(nucleo_lat) OVER ())+0.03', 5)} AS maxy
  FROM (SELECT fire_id, k AS kind, longitude, latitude, nucleo_lon, nucleo_lat, CASE WHEN k='population' THEN nucleo_lon ELSE longitude END AS lon1, CASE WHEN k='population' THEN nucleo_lat ELSE latitude END AS lat1,
   CASE WHEN k='distance' THEN nucleo_lon END AS lon2, CASE WHEN k='distance' THEN nucleo_lat END AS lat2 FROM x, (VALUES ('distance'),('fire'),('population')) v(k))"""))
def b11(t):
    rows = near_live_top(t)
    none = F.lit(None).cast("double")
    part = lambda kind, a, b, d, e: F.struct(F.lit(kind).alias("kind"), a.alias("lon1"), b.alias("lat1"), d.alias("lon2"), e.alias("lat2"))
    features = F.array(
        part("distance", c("longitude"), c("latitude"), c("nucleo_lon"), c("nucleo_lat")),
        part("fire", c("longitude"), c("latitude"), none, none),
        part("population", c("nucleo_lon"), c("nucleo_lat"), none, none),
    )
    extent = rows.agg(
        S.dec_round(F.least(F.min("longitude"), F.min("nucleo_lon")) - 0.03, 5).alias("minx"), S.dec_round(F.greatest(F.max("latitude"), F.max("nucleo_lat")) + 0.03, 5).alias("maxy")
    )
    return series.join_one_row(rows.select("fire_id", F.explode(features).alias("f")).select("fire_id", "f.*"), extent)


@query("z07_warnings_near_population", with_views("feature zone_pair", f"""WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY area_code ORDER BY {SQ.CLOSEST}) AS rn FROM zone_pair WHERE distance_m<={SQ.ZONE_M}) WHERE rn=1)
  SELECT feature_id, area_name, level_label, temperature_max_c, settlement_id, nombre, habitantes, {dr('distance_m', 1)} AS distance_m, max(temperature_max_c) OVER () AS peak_temperature_c FROM (SELECT * FROM feature JOIN p USING (area_code)
   WHERE valid_date=date '{DAY}' AND is_warning ORDER BY temperature_max_c DESC NULLS LAST, level_rank DESC, area_name LIMIT 50)"""))
def z07(t):
    rows = pipeline.features_of_day(t, DAY).filter("is_warning").join(SQ.zone_pick(t, "closest"), "area_code")
    top = rows.orderBy(c("temperature_max_c").desc_nulls_last(), c("level_rank").desc(), c("area_name")).limit(50)
    top = series.join_one_row(top, top.agg(F.max("temperature_max_c").alias("peak_temperature_c")))
    return top.select("feature_id", "area_name", "level_label", "temperature_max_c", "settlement_id", "nombre", "habitantes", S.dec_round(c("distance_m"), 1).alias("distance_m"), "peak_temperature_c")


@query("z10_search_and_explain", with_views("resolved", "SELECT kind, count(*) AS n, count(place) AS found FROM resolved GROUP BY kind"))
def z10(t):
    names = t.raw("customer").select(F.expr(NAMES).alias("name"))
    return lookup.resolve_places(names, pipeline.settlements(t)).groupBy("kind").agg(F.count("*").alias("n"), F.count("place").alias("found"))


@query("z11_situation_summary", with_views("alert live_fire burnt_stat", f"""SELECT 'alerts' AS component, 'total_matched' AS metric, cast(count(*) as double) AS value FROM alert WHERE onset<=timestamp '{NOW}' AND expires>=timestamp '{NOW}'
  UNION ALL SELECT 'fires','total_matched',count(*) FROM live_fire UNION ALL SELECT 'fires','max_frp',max(coalesce(frp,0)) FROM live_fire
  UNION ALL SELECT 'burnt_area','total_burned_area_ha',{dr('sum(burned_area_ha)', 2)} FROM burnt_stat WHERE nominal_date BETWEEN date '{DAY}' - 30 AND date '{DAY}'"""))
def z11(t):
    hits = reports.query_alerts(alerts(t), now()).agg(F.count("*").alias("total_matched"))
    fires = SQ.live_fires(t).agg(F.count("*").alias("total_matched"), F.max(F.coalesce("frp", F.lit(0.0))).alias("max_frp"))
    recent = burnt_days(t).filter(c("nominal_date").between(F.date_sub(F.lit(DAY).cast("date"), 30), F.lit(DAY).cast("date")))
    return (
        reports.metrics(hits, "alerts", ["total_matched"])
        .unionByName(reports.metrics(fires, "fires", ["total_matched", "max_frp"]))
        .unionByName(reports.metrics(reports.burnt_area_summary(recent), "burnt_area", ["total_burned_area_ha"]))
    )


@query("z12_landcover_at_point", with_views("landcover_norm landcover", f"""SELECT n.*, CASE WHEN try_cast(superficie_ha as double)>=0 AND NOT isnan(try_cast(superficie_ha as double)) THEN {dr('try_cast(superficie_ha as double)', 2)} ELSE {dr(cover_area_sql(), 1)} END AS surface_ha,
  CASE WHEN try_cast(superficie_ha as double)>=0 AND NOT isnan(try_cast(superficie_ha as double)) THEN 'attribute' ELSE 'computed' END AS surface_ha_source FROM landcover_norm n JOIN landcover l USING (cover_id) WHERE {covers_sql('-2.87', '39.89')}"""))
def z12(t):
    px, py = F.lit(-2.87), F.lit(39.89)
    hit = t.landcover().withColumn("hilucs", F.lit("H")).filter(geo.covered_by_edges(px, py, geo.shape_edges(c("shape"))))
    given = S.clean_surface(c("superficie_ha"))
    return landcover_attributes(hit).select(
        "cover_id", "label", "code", "code_field", "source_dataset", "secondary_label", F.coalesce(given, S.dec_round(geo.shape_area_ha(c("shape")), 1)).alias("surface_ha"),
        F.when(given.isNotNull(), "attribute").otherwise("computed").alias("surface_ha_source"),
    )


@query("z13_burnt_area_timeline", with_views("timeline", f"SELECT {TL}, publication_status, {dr('burned_area_ha', 2)} AS burned_area_ha, burned_pixel_count FROM timeline WHERE dataset_version='v4' AND delivery_format='cog'"))
def z13(t):
    items = catalog_state(t).filter("dataset_version = 'v4' AND delivery_format = 'cog'")
    return _timeline_out(reports.burnt_area_timeline(items, burnt_days(t)), "publication_status", S.dec_round(c("burned_area_ha"), 2).alias("burned_area_ha"), "burned_pixel_count")


@query("z14_burnt_area_daily_stats", with_views("cat_state burnt_stat", f"""WITH s AS (SELECT nominal_date, burned_area_ha, burned_pixel_count FROM burnt_stat WHERE nominal_date>=date '2002-01-01')
  SELECT strftime(nominal_date,'%Y-%m-%d') AS nominal_date, {dr('burned_area_ha', 2)} AS burned_area_ha, burned_pixel_count, true AS has_stats FROM s
  UNION ALL SELECT strftime(nominal_date,'%Y-%m-%d'), NULL, NULL, false FROM cat_state WHERE dataset_version='v4' AND delivery_format='cog' AND (SELECT count(*) FROM s)=0"""))
def z14(t):
    stats = burnt_days(t).filter("nominal_date >= date'2002-01-01'")
    empty = stats.agg((F.count("*") == 0).alias("e")).scalar()
    real = stats.select(day_text("nominal_date"), S.dec_round(c("burned_area_ha"), 2).alias("burned_area_ha"), "burned_pixel_count", F.lit(True).alias("has_stats"))
    hollow = catalog_state(t).filter("dataset_version = 'v4' AND delivery_format = 'cog'").filter(empty).select(
        day_text("nominal_date"), F.lit(None).cast("double").alias("burned_area_ha"), F.lit(None).cast("bigint").alias("burned_pixel_count"), F.lit(False).alias("has_stats")
    )
    return real.unionByName(hollow)


@query("z15_hotspot_features", with_views("hotspot", """SELECT hotspot_id, '{"type":"Feature","geometry":{"type":"Point","coordinates":['||cast(longitude as varchar)||','||cast(latitude as varchar)||']},"properties":{"hotspot_id":'||hotspot_id||',"confidence":"'||confidence||'","acq_time":"'||acq_time||'"}}' AS feature
  FROM hotspot WHERE acq_date=date '2024-01-10' AND confidence IN ('n','h')"""))
def z15(t):
    rows = pipeline.hotspots(t).filter("acq_date = date'2024-01-10' AND confidence IN ('n', 'h')")
    point = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    return rows.select("hotspot_id", reports.feature_json("hotspot", point, ["hotspot_id", "confidence", "acq_time"]).alias("feature"))


@query("z15_hotspot_timeline", with_views("hotspot_series", "SELECT strftime(nominal_date,'%Y-%m-%d') AS nominal_date, hotspot_count, coverage_complete, hotspot_count>0 AS has_hotspots FROM hotspot_series WHERE nominal_date BETWEEN date '2024-01-05' AND date '2024-01-25'"))
def z15t(t):
    days = pipeline.hotspot_series(t).filter(P.date_range("nominal_date", "2024-01-05", "2024-01-25"))
    return days.select(day_text("nominal_date"), "hotspot_count", "coverage_complete", (c("hotspot_count") > 0).alias("has_hotspots"))


@query("z16_warning_timeline", with_views("warning_series", "SELECT strftime(nominal_date,'%Y-%m-%d') AS nominal_date, feature_count, warning_count, max_temperature_c, coverage_complete FROM warning_series WHERE nominal_date BETWEEN date '1997-05-01' AND date '1997-08-31'"))
def z16(t):
    days = pipeline.warning_series(t).filter(P.date_range("nominal_date", "1997-05-01", "1997-08-31"))
    return days.select(day_text("nominal_date"), "feature_count", "warning_count", "max_temperature_c", "coverage_complete")


@query("z17_roads_in_box", with_views("service_road road road_pt", """WITH v AS (SELECT s.id_tramo, s.inspire_id, r.clase, clase IN ('Autopista de peaje','Autopista libre / autovía','Carretera multicarril','Carretera convencional') AS seen FROM service_road s LEFT JOIN road r USING (id_tramo)
   WHERE s.id_tramo IN (SELECT id_tramo FROM road_pt GROUP BY 1 HAVING min(x)<=-1 AND max(x)>=-5 AND min(y)<=42 AND max(y)>=38))
  SELECT id_tramo, inspire_id, clase, (SELECT count(*) FROM v WHERE NOT coalesce(seen,false)) AS filtered_out_by_zoom FROM v WHERE seen ORDER BY id_tramo LIMIT 1500"""))
def z17(t):
    zoom = 10
    visible = [k for k, z in K.ROAD_CLASS_MIN_ZOOM.items() if z <= zoom]
    b, box = geo.ring_bbox(c("line")), (-5.0, 38.0, -1.0, 42.0)
    local = pipeline.roads_around(t, box).filter(geo.box_overlaps(b.minx, b.miny, b.maxx, b.maxy, box)).select("id_tramo", "clase")
    found = t.raw("part").selectExpr(*SERVICE).join(local, "id_tramo").withColumn("seen", F.coalesce(c("clase").isin(*visible), F.lit(False)))
    found = cut_lineage(found.select("id_tramo", "inspire_id", "clase", "seen"), "roads-in-box")  # the rows and their count both read it
    dropped = found.agg(F.count_if(~c("seen")).alias("filtered_out_by_zoom"))
    return series.join_one_row(found.filter("seen").orderBy("id_tramo").limit(1500), dropped).select("id_tramo", "inspire_id", "clase", "filtered_out_by_zoom")


@query("z18_dashboard", with_views("alert live_fire", DASH))
def z18(t):
    return reports.dashboard(alerts(t), SQ.live_fires(t), now())


@query("z19_combined_timeline", with_views("hotspot_series warning_series cat_state", f"""SELECT strftime(d,'%Y-%m-%d') AS day, h.hotspot_count, w.warning_count, b.has_local_tiles, strftime((SELECT min(nominal_date) FROM warning_series WHERE warning_count>0),'%Y-%m-%d') AS default_day FROM ({ALL_DAYS}) x
  LEFT JOIN hotspot_series h ON h.nominal_date=d LEFT JOIN warning_series w ON w.nominal_date=d LEFT JOIN (SELECT * FROM cat_state WHERE dataset_version='v4' AND delivery_format='cog') b ON b.nominal_date=d"""))
def z19(t):
    burnt = catalog_state(t).filter("dataset_version = 'v4' AND delivery_format = 'cog'").select("nominal_date", "has_local_tiles")
    hot, warn = pipeline.hotspot_series(t).select("nominal_date", "hotspot_count"), pipeline.warning_series(t).select("nominal_date", "warning_count")
    first = warn.filter("warning_count > 0").agg(F.date_format(F.min("nominal_date"), "yyyy-MM-dd").alias("default_day"))
    merged = hot.join(warn, "nominal_date", "full").join(burnt, "nominal_date", "full")
    return series.join_one_row(merged, first).select(F.date_format("nominal_date", "yyyy-MM-dd").alias("day"), "hotspot_count", "warning_count", "has_local_tiles", "default_day")

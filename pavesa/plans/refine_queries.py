"""Canonical tables, daily series, windows: families S and W."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pavesa.functions import scalar as S
from pavesa.operators import canonical, series
from pavesa.plans import pipeline
from pavesa.operators.canonical import ROAD_CODES
from pavesa.plans.domain_sql import ROAD_ATTRIBUTES, dr, view, with_views
from pavesa.plans.registry import query

DATE = "strftime({0},'%Y-%m-%d') AS {0}"


def time_text(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def time_sql(names: str) -> str:
    return ", ".join(f"strftime({n},'%Y-%m-%d %H:%M:%S') AS {n}" for n in names.split())


def day_text(name: str):
    return F.date_format(name, "yyyy-MM-dd").alias(name)


view("hotspot_cal", """SELECT cast(unnest(generate_series((SELECT cast(cast(min(ts) as date)-2 as timestamp) FROM events),
  (SELECT cast(cast(max(ts) as date)+2 as timestamp) FROM events), interval 1 day)) as date) AS nominal_date""")
view("warning_cal", """SELECT cast(unnest(generate_series((SELECT cast(cast(min(o_orderdate) as date)-2 as timestamp) FROM orders),
  (SELECT cast(cast(max(o_orderdate) as date)+5 as timestamp) FROM orders), interval 1 day)) as date) AS nominal_date""")
view("hotspot_stat", f"""SELECT acq_date AS nominal_date, count(*) AS hotspot_count, count(*) FILTER (confidence='h') AS high_confidence_count,
  count(*) FILTER (confidence='n') AS nominal_confidence_count, cast(0 as bigint) AS low_confidence_count,
  count(*) FILTER (daynight='D') AS day_count, count(*) FILTER (daynight='N') AS night_count,
  {dr('sum(coalesce(frp,0.0))', 4)} AS frp_sum_mw, max(frp) AS frp_max_mw, count(DISTINCT firms_source) AS source_count
  FROM hotspot WHERE confidence IN ('n','h') GROUP BY acq_date""", ["hotspot"])
view("hotspot_cov", """SELECT nominal_date, count(DISTINCT firms_source||'|'||bbox_region) AS coverage_unit_count,
  array_to_string(list_sort(list(DISTINCT firms_source)),',') AS source_list, array_to_string(list_sort(list(DISTINCT bbox_region)),',') AS bbox_region_list
  FROM (SELECT *, cast(unnest(generate_series(cast(request_date_from as timestamp),cast(request_date_to as timestamp),interval 1 day)) as date) AS nominal_date
    FROM hotspot_download) GROUP BY nominal_date""", ["hotspot_download"])
view("hotspot_series", """SELECT c.nominal_date, 'country' AS stat_scope, 'ES' AS area_code, 6 AS coverage_expected_unit_count,
  coalesce(coverage_unit_count,0) AS coverage_unit_count, coalesce(coverage_unit_count,0)=6 AS coverage_complete,
  coalesce(hotspot_count,0) AS hotspot_count, coalesce(high_confidence_count,0) AS high_confidence_count,
  coalesce(nominal_confidence_count,0) AS nominal_confidence_count, coalesce(low_confidence_count,0) AS low_confidence_count,
  coalesce(day_count,0) AS day_count, coalesce(night_count,0) AS night_count, coalesce(source_count,0) AS source_count,
  coalesce(frp_sum_mw,0.0) AS frp_sum_mw, frp_max_mw, coalesce(source_list,'') AS source_list, coalesce(bbox_region_list,'') AS bbox_region_list
  FROM hotspot_cal c LEFT JOIN hotspot_cov USING (nominal_date) LEFT JOIN hotspot_stat USING (nominal_date)""", ["hotspot_cal", "hotspot_cov", "hotspot_stat"])
view("warning_stat", """SELECT valid_date AS nominal_date, count(*) AS feature_count, count(*) FILTER (is_warning) AS warning_count,
  count(*) FILTER (level_label='Verde') AS green_count, count(*) FILTER (level_label='Amarillo') AS yellow_count,
  count(*) FILTER (level_label='Naranja') AS orange_count, count(*) FILTER (level_label='Rojo') AS red_count,
  max(temperature_max_c) FILTER (is_warning) AS max_temperature_c, count(DISTINCT area_code) FILTER (is_warning) AS warned_area_count,
  cast(sum(source_version_count) as bigint) AS source_feature_count FROM feature GROUP BY valid_date""", ["feature"])
view("warning_cov", """SELECT nominal_date, count(DISTINCT source_download_id) AS source_file_count FROM (SELECT *,
  cast(unnest(generate_series(cast(cast(request_elaboration_from as date) as timestamp),cast(cast(request_elaboration_to as date) as timestamp),interval 1 day)) as date) AS nominal_date
  FROM warning_download) GROUP BY nominal_date""", ["warning_download"])
view("warning_series", """SELECT c.nominal_date, 1 AS coverage_expected_unit_count, CASE WHEN coalesce(source_file_count,0)>0 THEN 1 ELSE 0 END AS coverage_unit_count,
  coalesce(source_file_count,0)>0 AS coverage_complete, coalesce(feature_count,0) AS feature_count, coalesce(warning_count,0) AS warning_count,
  coalesce(green_count,0) AS green_count, coalesce(yellow_count,0) AS yellow_count, coalesce(orange_count,0) AS orange_count, coalesce(red_count,0) AS red_count,
  coalesce(warned_area_count,0) AS warned_area_count, coalesce(source_feature_count,0) AS source_feature_count, max_temperature_c
  FROM warning_cal c LEFT JOIN warning_cov USING (nominal_date) LEFT JOIN warning_stat USING (nominal_date)""", ["warning_cal", "warning_cov", "warning_stat"])


@query("s01_canonical_hotspot", with_views("hotspot", """SELECT hotspot_id, firms_source, satellite, latitude, longitude,
  strftime(acq_date,'%Y-%m-%d') AS acq_date, acq_time, instrument, confidence, daynight, version, scan, track, bright_ti4, bright_ti5, frp, bbox_regions,
  source_download_count, source_observation_count FROM hotspot"""))
def s01(t):
    return pipeline.hotspots(t).select(
        "hotspot_id", "firms_source", "satellite", "latitude", "longitude", day_text("acq_date"), "acq_time", "instrument",
        "confidence", "daynight", "version", "scan", "track", "bright_ti4", "bright_ti5", "frp", F.array_join("bbox_regions", ",").alias("bbox_regions"),
        "source_download_count", "source_observation_count",
    )


@query("s02_live_dedupe", with_views("hotspot_obs", """SELECT firms_source, latitude, longitude, strftime(acq_date,'%Y-%m-%d') AS acq_date,
  acq_time, satellite, source_observation_id, frp FROM (SELECT *, row_number() OVER (PARTITION BY firms_source, latitude, longitude, acq_date,
  acq_time, satellite ORDER BY source_observation_id) AS rn FROM hotspot_obs) WHERE rn=1"""))
def s02(t):
    keys = ["firms_source", "latitude", "longitude", "acq_date", "acq_time", "satellite"]
    rows = t.hotspot_obs().select(*keys, "source_observation_id", "frp")
    return canonical.dedupe_first_seen(rows, keys, "source_observation_id").select(
        "firms_source", "latitude", "longitude", day_text("acq_date"), "acq_time", "satellite", "source_observation_id", "frp"
    )


@query("s03_canonical_warning", with_views("warning", f"""SELECT cap_identifier, language, area_code, level_label, level_rank, is_warning,
  temperature_max_c, {time_sql('onset_at expires_at sent_at')}, warning_id, source_file_path, duplicate_source_count FROM warning"""))
def s03(t):
    return pipeline.warnings(t).select(
        "cap_identifier", "language", "area_code", "level_label", "level_rank", "is_warning", "temperature_max_c",
        time_text("onset_at"), time_text("expires_at"), time_text("sent_at"), "warning_id", "source_file_path", "duplicate_source_count",
    )


@query("s04_canonical_road", with_views("road", f"""SELECT id_tramo, inspire_id, id_vial, source_fid, clase, clase_code, nombre, n_carriles, {', '.join(ROAD_ATTRIBUTES)}, {', '.join(f'{n}_code' for n in ROAD_CODES)},
  territory_code, {time_sql('imported_at')} FROM road"""))
def s04(t):
    return pipeline.roads(t).select(
        "id_tramo", "inspire_id", "id_vial", "source_fid", "clase", F.col("clase_code").cast("bigint").alias("clase_code"),
        "nombre", "n_carriles", *ROAD_ATTRIBUTES, *(f"{n}_code" for n in ROAD_CODES), "territory_code", time_text("imported_at"),
    )


@query("s05_canonical_catalog", with_views("daily_file", """SELECT dataset_version, delivery_format, strftime(nominal_date,'%Y-%m-%d') AS nominal_date,
  source_catalog_id, product_name, publication_status, local_tiles_path FROM daily_file"""))
def s05(t):
    return canonical.daily_files(t.catalog_item()).select(
        "dataset_version", "delivery_format", day_text("nominal_date"), "source_catalog_id", "product_name",
        "publication_status", "local_tiles_path",
    )


@query("s06_hotspot_day_stats", with_views("hotspot_stat", "SELECT * REPLACE (strftime(nominal_date,'%Y-%m-%d') AS nominal_date) FROM hotspot_stat"))
def s06(t):
    return series.hotspot_day_stats(pipeline.hotspots(t)).withColumn(
        "nominal_date", F.date_format("nominal_date", "yyyy-MM-dd")
    ).withColumn("frp_sum_mw", S.dec_round(F.col("frp_sum_mw"), 4))


@query("s07_hotspot_coverage", with_views("hotspot_cov", "SELECT * REPLACE (strftime(nominal_date,'%Y-%m-%d') AS nominal_date) FROM hotspot_cov"))
def s07(t):
    return series.hotspot_coverage(t.hotspot_download()).select(
        day_text("nominal_date"), "coverage_unit_count", F.array_join("source_list", ",").alias("source_list"),
        F.array_join("bbox_region_list", ",").alias("bbox_region_list"),
    )


@query("s08_warning_day_stats", with_views("warning_stat", "SELECT * REPLACE (strftime(nominal_date,'%Y-%m-%d') AS nominal_date) FROM warning_stat"))
def s08(t):
    return series.warning_day_stats(pipeline.features(t)).withColumn("nominal_date", F.date_format("nominal_date", "yyyy-MM-dd"))


@query("s09_warning_coverage", with_views("warning_cov", "SELECT strftime(nominal_date,'%Y-%m-%d') AS nominal_date, source_file_count FROM warning_cov"))
def s09(t):
    return series.warning_coverage(t.warning_download()).select(day_text("nominal_date"), "source_file_count")


def _series_text(df):
    return df.select(
        day_text("nominal_date"), *[c for c in df.columns if c not in ("nominal_date", "frp_sum_mw", "source_list", "bbox_region_list")],
        S.dec_round(F.col("frp_sum_mw"), 4).alias("frp_sum_mw"), F.array_join("source_list", ",").alias("source_list"),
        F.array_join("bbox_region_list", ",").alias("bbox_region_list"),
    )


@query("s10_hotspot_daily_series", with_views("hotspot_series", "SELECT * REPLACE (strftime(nominal_date,'%Y-%m-%d') AS nominal_date) FROM hotspot_series"))
def s10(t):
    return _series_text(pipeline.hotspot_series(t))


@query("s10_warning_daily_series", with_views("warning_series", "SELECT * REPLACE (strftime(nominal_date,'%Y-%m-%d') AS nominal_date) FROM warning_series"))
def s10w(t):
    return pipeline.warning_series(t).withColumn("nominal_date", F.date_format("nominal_date", "yyyy-MM-dd"))


@query("s11_run_summary", with_views("hotspot_series warning_series", """SELECT 'hotspot' AS layer, count(*) AS date_count, count(*) FILTER (coverage_complete) AS complete_days,
  cast(sum(hotspot_count) as bigint) AS total, max(hotspot_count) AS max_daily, max(frp_max_mw) AS max_value FROM hotspot_series
  UNION ALL SELECT 'warning', count(*), count(*) FILTER (coverage_complete), cast(coalesce(sum(warning_count),0) as bigint), max(warning_count), max(max_temperature_c) FROM warning_series"""))
def s11(t):
    def summary(df, layer, count, peak):
        return df.agg(
            F.lit(layer).alias("layer"), F.count("*").alias("date_count"), F.count_if("coverage_complete").alias("complete_days"),
            F.coalesce(F.sum(count), F.lit(0)).alias("total"), F.max(count).alias("max_daily"), F.max(peak).alias("max_value"),
        )

    return summary(pipeline.hotspot_series(t), "hotspot", "hotspot_count", "frp_max_mw").unionByName(
        summary(pipeline.warning_series(t), "warning", "warning_count", "max_temperature_c")
    )


@query("w01_representative_row", with_views("road", "SELECT id_tramo, source_fid FROM road"))
def w01(t):
    rows = t.road_src().select("id_tramo", "source_fid", "imported_at", S.no_sentinel(F.col("clase_raw")).alias("c"))
    order = [F.col("c").asc_nulls_last(), F.col("imported_at").desc(), F.col("source_fid").asc()]
    return canonical.first_per_key(rows, ["id_tramo"], order).select("id_tramo", "source_fid")


@query("w02_daily_representative", with_views("feature", f"""SELECT feature_id, warning_id, level_label, level_rank, is_warning, temperature_max_c,
  {time_sql('onset_at expires_at sent_at')}, source_version_count FROM feature"""))
def w02(t):
    return pipeline.features(t).select(
        "feature_id", "warning_id", "level_label", "level_rank", "is_warning", "temperature_max_c", time_text("onset_at"),
        time_text("expires_at"), time_text("sent_at"), "source_version_count",
    )


@query("w03_version_count", with_views("warning_src", """SELECT cap_identifier, language, area_code, source_record_id,
  count(*) OVER (PARTITION BY cap_identifier, language, area_code) AS version_count FROM warning_src"""))
def w03(t):
    keys = ["cap_identifier", "language", "area_code"]
    rows = t.warning_src().select(*keys, "source_record_id")
    counts = rows.groupBy(*keys).agg(F.count("*").alias("version_count"))
    return rows.join(counts, keys)

"""Scans, sinks, quality and streams: families A, B, Q, X.

Queries that need landed files write them from the tables into the shared folder first.
"""

from __future__ import annotations

import functools
import gzip
import json
import tarfile

import pyarrow as pa
from pyspark.sql import functions as F

from pavesa import constants as K
from pavesa.functions import geo
from pavesa.functions import parameters as P
from pavesa.functions import scalar as S
from pavesa.operators import canonical, lookup, merge, quality, regions, spatial
from pavesa.plans import pipeline, reports
from pavesa.plans.domain_sql import view, with_views
from pavesa.plans.refine_queries import day_text, time_sql, time_text
from pavesa.plans.registry import query
from pavesa.plans.report_queries import NAMES, NOW, TERM, catalog_state
from pavesa.session import cut_lineage, scratch_path
from pavesa.sources import cap, landing
from pavesa.streaming import feed, refresh

c = F.col


def landed(df, label, fmt="parquet", partition=None, **options):
    path = scratch_path(df.sparkSession, label)
    writer = df.write.format(fmt).options(**options)
    (writer.partitionBy(*partition) if partition else writer).save(path)
    return path


# ---- A: scans ------------------------------------------------------------------------------


def hotspot_csv(t):
    """Hotspot files as they would land: text fields, some unusable lines."""
    obs = t.hotspot_obs()
    bad = lambda n, col: F.when(c("source_observation_id") % n == 0, F.lit("")).otherwise(col.cast("string"))
    text = {
        "latitude": F.when(c("source_observation_id") % 37 == 0, F.lit("x")).otherwise(c("latitude").cast("string")),
        "longitude": bad(43, c("longitude")), "bright_ti4": c("bright_ti4").cast("string"), "scan": F.lit("0.4"), "track": F.lit("0.4"),
        "acq_date": F.date_format("acq_date", "yyyy-MM-dd"), "acq_time": c("acq_time").cast("int").cast("string"), "satellite": bad(41, c("satellite")),
        "instrument": c("instrument"), "confidence": F.coalesce(c("confidence"), F.lit("85")), "version": F.lit(" 2 "), "bright_ti5": F.lit("290"),
        "frp": c("frp").cast("string"), "daynight": c("daynight"),
    }
    return obs.select(*[v.alias(k) for k, v in text.items()], "firms_source", "bbox_region")


def landed_oddly(rows, label, partition=()):
    """CSV files of three kinds: columns in order, coordinates swapped and fields absent, and one without coordinates."""
    path = scratch_path(rows.sparkSession, label)
    kinds = rows.withColumn("_kind", F.xxhash64("acq_date", "frp") % 2 == 0)
    swapped = ["longitude", "latitude", *(f for f in landing.HOTSPOT_FIELDS if f not in ("latitude", "longitude", "track", "version"))]
    lost = rows.limit(5).select(*(f for f in landing.HOTSPOT_FIELDS if f not in ("latitude", "longitude")), *partition)
    for part in (kinds.filter("_kind").select(*landing.HOTSPOT_FIELDS, *partition), kinds.filter("NOT _kind").select(*swapped, *partition), lost):
        writer = part.write.mode("append").option("header", True)
        (writer.partitionBy(*partition) if partition else writer).csv(path)
    return path


view("csv_ok", "SELECT * FROM hotspot_obs WHERE source_observation_id%37<>0 AND source_observation_id%43<>0 AND source_observation_id%41<>0", ["hotspot_obs"])


@query("a01_hotspot_csv_scan", with_views("hotspot_obs csv_ok", """SELECT a.firms_source, a.bbox_region, kept, lines FROM (SELECT firms_source, bbox_region, count(*) AS kept FROM csv_ok GROUP BY 1,2) a
  JOIN (SELECT firms_source, bbox_region, count(*) AS lines FROM hotspot_obs GROUP BY 1,2) b USING (firms_source, bbox_region)"""))
def a01(t):
    path = landed_oddly(hotspot_csv(t), "hotspot-csv", ["firms_source", "bbox_region"])
    raw = landing.read_hotspot_csv(t.spark, path, ["firms_source", "bbox_region"])
    lines = raw.groupBy("firms_source", "bbox_region").agg(F.countDistinct("source_file", "source_row_number").alias("lines"))
    kept = landing.parse_hotspots(raw).groupBy("firms_source", "bbox_region").agg(F.count("*").alias("kept"))
    return kept.join(lines, ["firms_source", "bbox_region"]).select("firms_source", "bbox_region", "kept", "lines")


@query("a02_live_csv_scan", with_views("hotspot_in", """SELECT CASE WHEN source_observation_id%37=0 OR source_observation_id%43=0 THEN 'bad_coordinate' WHEN NOT in_region THEN 'outside_region' WHEN confidence IN ('n','h') THEN 'kept' ELSE 'low_confidence' END AS reason, count(*) AS n FROM hotspot_in GROUP BY 1"""))
def a02(t):
    path = landed_oddly(hotspot_csv(t), "live-csv")
    raw = landing.read_hotspot_csv(t.spark, path)
    rows = raw.withColumn("latitude", S.safe_double(c("latitude"))).withColumn("longitude", S.safe_double(c("longitude")))
    rows = regions.flag_in_region(rows, t.region_edges())
    reason = (
        F.when(c("latitude").isNull() | c("longitude").isNull(), "bad_coordinate").when(~c("in_region"), "outside_region")
        .when(~S.confidence_lenient(c("confidence")).isin("n", "h"), "low_confidence").otherwise("kept")
    )
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("a03_manifest_scope", with_views("hotspot_download", """SELECT source_download_id, firms_source, bbox_region FROM hotspot_download WHERE request_date_to>=date '2024-01-08' AND request_date_from<=date '2024-01-17' AND firms_source='VIIRS_SNPP_SP' AND bbox_region IN ('canarias','ceuta_melilla')"""))
def a03(t):
    text = t.hotspot_download().withColumns({n: F.date_format(n, "yyyy-MM-dd") for n in ("request_date_from", "request_date_to")})
    path = landed(text, "manifests", "json")
    manifests = t.spark.read.schema(text.schema).json(path)
    hit = landing.manifests_in_scope(manifests, "2024-01-08", "2024-01-17", ["VIIRS_SNPP_SP"], ["canarias", "ceuta_melilla"])
    return hit.select("source_download_id", "firms_source", "bbox_region")


@query("a04_archive_scope", with_views("warning_download", "SELECT source_download_id FROM warning_download WHERE request_elaboration_to>=timestamp '1998-01-07' AND request_elaboration_from<timestamp '1998-01-21'"))
def a04(t):
    return landing.archives_in_scope(t.warning_download(), "1998-01-10", "1998-01-20", 3).select("source_download_id")


def zone_texts(t):
    return t.zone().select("area_code", F.array_join(F.transform("ring", lambda p: F.concat_ws(",", p.y.cast("string"), p.x.cast("string"))), " ").alias("poly"))


def cap_payload():
    """The CAP message of a warning record and its zone's ``poly``, with a second info in English."""
    iso = lambda n: F.date_format(n, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    pair = lambda tag, name, value: F.concat(F.lit(f"<{tag}><valueName>{name}</valueName><value>"), value, F.lit(f"</value></{tag}>"))
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    temp = c("temperature_max_c").cast("int").cast("string")
    info = lambda lang: F.concat(
        F.lit("<info>"), tag("language", F.lit(lang)), tag("event", F.concat(F.lit("Aviso de temperaturas nivel "), F.lower("level_label"))),
        pair("eventCode", K.CAP_EVENT_NAME, F.concat(c("phenomenon_code"), F.lit(";Temperaturas"))), tag("onset", iso("onset_at")), tag("expires", iso("expires_at")),
        tag("description", F.lit("Sin detalle")), pair("parameter", K.CAP_LEVEL_NAME, F.lower("level_label")),
        pair("parameter", K.CAP_PARAMETER_NAME, F.concat(F.lit("TM;Maxima;"), temp, F.lit(" ºC"))),
        F.lit("<area>"), tag("areaDesc", c("area_name")), tag("polygon", c("poly")), pair("geocode", K.CAP_ZONE_NAME, c("area_code")), F.lit("</area></info>"),
    )
    return F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><alert xmlns="urn:oasis:names:tc:emergency:cap:1.2">'), tag("identifier", c("cap_identifier")),
        tag("sent", iso("sent_at")), info("es-ES"), info("en-GB"), F.lit("</alert>"),
    )


def cap_messages(t):
    """One CAP message per warning record."""
    # A message costs far more than its record, so the records go to all tasks before they are written out.
    records = spatial.spread(t.warning_src(), "source_record_id")
    return records.join(zone_texts(t), "area_code").select("source_record_id", "cap_identifier", cap_payload().alias("payload"))


#: Archives handed on at a time.
ARCHIVES = 256


def packed(t):
    """Messages of one identifier packed as a gzipped tar inside a tar."""
    # Records meet by identifier while they are small; their messages are written out behind the shuffle and go straight into the archives.
    records = t.warning_src().join(cut_lineage(zone_texts(t), "zones"), "area_code")
    rows = spatial.spread(records, "cap_identifier").sortWithinPartitions("cap_identifier").select("cap_identifier", cap_payload().alias("payload"))

    def pack(batches):
        @functools.lru_cache(4096)
        def header(name, size):
            info = tarfile.TarInfo(name)
            info.size = size
            return info.tobuf()

        def tar(members):
            """What ``TarFile.addfile`` writes, without a file object for each member."""
            parts = [x for name, body in members for x in (header(name, len(body)), body, bytes(-len(body) % tarfile.BLOCKSIZE))]
            whole = b"".join([*parts, bytes(2 * tarfile.BLOCKSIZE)])
            return whole + bytes(-len(whole) % tarfile.RECORDSIZE)

        def archive(items):
            inner = tar([(f"m{i}.xml", x) for i, x in enumerate(items)] + [("note.txt", b"no message")])
            return tar([("inner.tar.gz", gzip.compress(inner, 1))])

        def rows_of(groups):
            return pa.RecordBatch.from_arrays([pa.array([f"{k}.tar" for k, _ in groups], pa.string()), pa.array([archive(v) for _, v in groups], pa.binary())], ["path", "content"])

        groups = []
        for batch in batches:
            for key, payload in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if not groups or groups[-1][0] != key:
                    if len(groups) >= ARCHIVES:
                        yield rows_of(groups)
                        groups = []
                    groups.append((key, []))
                if payload is not None:
                    groups[-1][1].append(payload)
        if groups:
            yield rows_of(groups)

    return rows.mapInArrow(pack, "path string, content binary")


@query("a05_archive_unpack", with_views("warning_src", "SELECT cap_identifier||'.tar' AS path, count(*) AS members FROM warning_src GROUP BY cap_identifier"))
def a05(t):
    return cap.unpack(packed(t)).groupBy("path").agg(F.count("*").alias("members"))


@query("a06_cap_records", with_views("warning_src zone", f"""SELECT source_record_id, cap_identifier, area_code, area_name, lower(level_label) AS level_code, level_label, temperature_max_c, {time_sql('onset_at expires_at sent_at')}, 6 AS corners FROM warning_src JOIN zone USING (area_code) WHERE phenomenon_code='AT'"""))
def a06(t):
    return cap.parse(cap_messages(t).select("source_record_id", "payload")).select(
        "source_record_id", "cap_identifier", "area_code", "area_name", "level_code", "level_label", "temperature_max_c", time_text("onset_at"), time_text("expires_at"), time_text("sent_at"), F.size("ring").alias("corners")
    )


@query("a07_live_cap", with_views("warning_src", f"""SELECT cap_identifier AS id, level_label AS level, area_name, strftime(onset_at,'%Y-%m-%d %H:%M:%S') AS onset, 'Aviso de temperaturas' AS event, count(*) AS n FROM warning_src GROUP BY ALL"""))
def a07(t):
    live = cap.parse_live(cap_messages(t)).withColumn("onset", F.date_format("onset", "yyyy-MM-dd HH:mm:ss"))
    return live.groupBy("id", "level", "area_name", "onset", "event").agg(F.count("*").alias("n"))


def catalog_files(t):
    rows = t.catalog_item().selectExpr(
        "cast(source_catalog_id as string) AS id", "product_name AS name",
        "CASE WHEN source_catalog_id % 19 = 0 THEN '' ELSE concat(date_format(nominal_date, 'yyyy-MM-dd'), 'T00:00:00') END AS nominaldate",
        "date_format(catalog_ingested_at, \"yyyy-MM-dd'T'HH:mm:ss\") AS ingestiondate", "date_format(catalog_modified_at, \"yyyy-MM-dd'T'HH:mm:ss\") AS modificationdate",
        "cast(source_catalog_id * 10 as string) AS contentlength", "dataset_version", "delivery_format",
    )
    return landed(rows, "catalogue", "csv", ["dataset_version", "delivery_format"], header=True)


def read_catalogue(t, path):
    parts = [landing.read_catalog_variant(t.spark, f"{path}/dataset_version={v}/delivery_format={f}", v, f) for v in K.BURNT_VERSIONS for f in K.BURNT_FORMATS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


view("cat_rows", """SELECT dataset_version, delivery_format, cast(source_catalog_id as varchar) AS source_item_id, 'V'||(source_catalog_id%4)||'.'||split_part(product_name,'.',2) AS product_version, strftime(nominal_date,'%Y-%m-%d') AS nominal_date,
  catalog_ingested_at, source_catalog_id*10 AS content_length_bytes FROM catalog_item WHERE source_catalog_id%19<>0""", ["catalog_item"])


@query("a08_catalogue_csv", with_views("cat_rows", f"SELECT dataset_version, delivery_format, source_item_id, product_version, nominal_date, {time_sql('catalog_ingested_at')}, content_length_bytes FROM cat_rows"))
def a08(t):
    return read_catalogue(t, catalog_files(t)).select(
        "dataset_version", "delivery_format", "source_item_id", "product_version", "nominal_date", time_text("catalog_ingested_at"), "content_length_bytes"
    )


@query("a09_catalogue_or_core", with_views("cat_rows", "SELECT dataset_version, delivery_format, nominal_date, count(*) AS n FROM cat_rows GROUP BY ALL"))
def a09(t):
    keys = ["dataset_version", "delivery_format", "nominal_date"]
    core = catalog_state(t).withColumn("nominal_date", F.date_format("nominal_date", "yyyy-MM-dd")).select(*keys)
    return landing.catalogue_or_core(read_catalogue(t, catalog_files(t)).select(*keys), core).groupBy(*keys).agg(F.count("*").alias("n"))


@query("a10_boundary_edges", with_views("zone_edge", "SELECT area_code AS part, 0 AS ring_no, count(*) AS edges, cast(round(cast(sum(x1) as decimal(28,8)),5) as double) AS sx FROM zone_edge GROUP BY 1"))
def a10(t):
    """Every other zone is a MultiPolygon, every third file a single Feature."""
    ring = F.array(F.transform("ring", lambda p: F.array(p.x, p.y)))
    code, many = c("area_code"), F.xxhash64("area_code") % 2 == 0
    geometry = F.when(many, F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.array(ring).alias("coordinates")))).otherwise(F.to_json(F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates"))))
    feature = F.concat(F.lit('{"type":"Feature","properties":{"code":"'), code, F.lit('"},"geometry":'), geometry, F.lit("}"))
    document = F.when(F.xxhash64("area_code") % 3 == 0, feature).otherwise(F.concat(F.lit('{"type":"FeatureCollection","features":['), feature, F.lit("]}")))
    path = landed(t.zone().select("area_code", document.alias("value")).repartition("area_code"), "boundary", "text", ["area_code"])
    edges = landing.read_boundary_edges(t.spark, path, "code")
    return edges.groupBy("part", "ring_no").agg(F.count("*").alias("edges"), S.dec_round(F.sum("x1"), 5).alias("sx"))


A11 = ["clase", "ncarriles", "nombre", "nombre_alt", "codigo", "titulard", "titular", "sentidod", "sentido", "tipo_viald", "firmed", "orden"]


@query("a11_road_landing", with_views("road_src", f"""SELECT source_fid, id_tramo, regexp_extract(source_zip_name,'^RT_(.*)_gpkg.zip$',1) AS territory_code, 'Provincia '||regexp_extract(source_zip_name,'PROVINCIA_([0-9]+)',1) AS territory_name,
  clase_raw AS clase, nullif(ncarriles,'') AS ncarriles, {', '.join(f"nullif({n},'') AS {n}" for n in A11[2:] if n not in landing.ROAD_NUMBERS)}, titular, sentido, orden, cast(NULL as varchar) AS situaciond, 5 AS points FROM road_src"""))
def a11(t):
    path = landed(t.road_src().hint("rebalance", c("source_zip_name")), "roads", "parquet", ["source_zip_name"])
    return landing.read_road_landing(t.spark, path).select("source_fid", "id_tramo", "territory_code", "territory_name", *A11, "situaciond", F.size("line").alias("points"))


A12 = [
    ("ine_0502", "CASE WHEN source_fid % 3 = 0 THEN '' ELSE concat('I', source_fid) END"), ("fecha_ine", "CASE WHEN source_fid % 8 = 0 THEN '' WHEN source_fid % 8 = 1 THEN 'x' ELSE '2023' END"),
    ("codigo_ep", "concat('EP', source_fid % 90)"), ("id_ep", "source_fid * 3"), ("id_bicca", "''"), ("id_ng", "CASE WHEN source_fid % 2 = 0 THEN source_fid + 7 END"),
    ("prioridad", "source_fid % 4"), ("f_alta", "'2020-01-01'"),
]
A12_TEXT = ["nombre", "etiqueta", "tipo_0502", "capit_0502"]


@query("a12_settlement_landing", with_views("settlement_src", f"""SELECT source_objectid, {', '.join(f"nullif({n},'') AS {n}" for n in A12_TEXT)}, habit_0502, CASE WHEN source_fid%3<>0 THEN 'I'||source_fid END AS ine_0502,
  CASE WHEN source_fid%8>1 THEN 2023.0e0 END AS fecha_ine, 'EP'||(source_fid%90) AS codigo_ep, source_fid*3 AS id_ep, cast(NULL as varchar) AS id_bic, cast(NULL as varchar) AS id_bicca,
  CASE WHEN source_fid%2=0 THEN source_fid+7 END AS id_ng, cast(source_fid%4 as integer) AS prioridad, '2020-01-01' AS f_alta, CASE WHEN source_fid%5=2 THEN 2 ELSE 1 END AS parts FROM settlement_src"""))
def a12(t):
    """The landing lacks one field and has a bad number in another."""
    rows = t.settlement_src().select("source_objectid", *A12_TEXT, "habit_0502", *(F.expr(e).alias(n) for n, e in A12), "shape")
    found = landing.read_settlement_landing(t.spark, landed(rows, "settlements"))
    return found.select(*landing.SETTLEMENT_FIELDS, F.size("shape").alias("parts"))


@query("a13_settlement_page_filter", with_views("settlement_src", """SELECT nombre, cast(floor(habit_0502) as bigint) AS habitantes, CASE WHEN source_fid%7=0 THEN '' ELSE 'C'||source_fid END AS codine, source_fid%52 AS cpro,
  capit_0502 AS capital, CASE WHEN source_fid%6=0 THEN NULL ELSE tipo_0502 END AS tipo, lat AS latitud, lon AS longitud, CASE WHEN source_fid%5=2 THEN 2 ELSE 1 END AS parts
  FROM settlement_src WHERE floor(habit_0502)>=500 AND source_fid%13<>0 AND source_fid%11<>0"""))
def a13(t):
    """Pages of 100 features; some have no geometry, no number of people, an absent code, or a type of null."""
    fid = c("source_fid")
    given = F.struct("nombre", F.when(fid % 13 != 0, F.floor("habit_0502")).alias("habitantes"), F.when(fid % 7 != 0, F.concat(F.lit("C"), fid)).alias("codine"),
                     (fid % 52).alias("cpro"), c("capit_0502").alias("capital"), F.when(fid % 6 != 0, c("tipo_0502")).alias("tipo"), c("lat").alias("latitud"), c("lon").alias("longitud"))
    text = F.to_json(given)
    text = F.when(fid % 6 == 0, F.concat(F.lit('{"tipo":null,'), F.substr(text, F.lit(2)))).otherwise(text)
    shape = F.when(fid % 11 == 0, F.lit("null")).otherwise(geo.shape_geojson(c("shape")))
    feature = F.concat(F.lit('{"type":"Feature","properties":'), text, F.lit(',"geometry":'), shape, F.lit("}"))
    pages = t.settlement_src().groupBy(F.floor(fid / 100).alias("page")).agg(F.collect_list(feature).alias("features"))
    path = landed(pages.select(F.concat(F.lit('{"features":['), F.array_join("features", ","), F.lit("]}")).alias("value")), "settlement-pages", "text")
    found = landing.read_settlement_pages(t.spark, path)
    return found.select(*landing.PAGE_FIELDS, F.size("polygons").alias("parts"))


PLACES_JSON = json.dumps({"ccaa": K.PLACE_REGIONS, "provincias": K.PLACE_PROVINCES})
GLOSSARY_JSON = json.dumps({k: {"name": n, "long_name": lng} for k, n, lng in K.GLOSSARY}, ensure_ascii=False)


@query("a14_place_dictionary", with_views("place asked_name", """SELECT CASE p.kind WHEN 'ccaa' THEN 'ccaa' ELSE 'provincias' END AS kind, p.name, count(c.c_custkey) AS asked FROM place p LEFT JOIN (SELECT c_custkey, """ + NAMES.replace("as string", "as varchar") + """ AS name FROM customer) c ON strip_accents(lower(trim(c.name)))=lower(p.name) GROUP BY 1,2"""))
def a14(t):
    places = landing.read_places(t.spark, landed(t.spark.range(1).select(F.lit(PLACES_JSON).alias("value")), "places", "text"))
    asked = t.raw("customer").select(S.fold_name(F.expr(NAMES)).alias("folded")).groupBy("folded").agg(F.count("*").alias("n"))
    return places.join(asked, S.fold_name(c("name")) == c("folded"), "left").select("kind", "name", F.coalesce("n", F.lit(0)).alias("asked"))


@query("a15_glossary", f"SELECT k AS term, l AS long_name, (SELECT count(*) FROM part WHERE replace(upper(trim({TERM})),' ','')=replace(upper(k),' ','')) AS asked FROM (VALUES " + ",".join(f"('{k}','{lng}')" for k, _, lng in K.GLOSSARY) + ") t(k,l)")
def a15(t):
    path = landed(t.spark.range(1).select(F.lit(GLOSSARY_JSON).alias("value")), "glossary", "text")
    entries = landing.read_glossary(t.spark, path).withColumnRenamed("key", "term")
    asked = t.raw("part").select(S.fold_term(F.expr(TERM)).alias("folded")).groupBy("folded").agg(F.count("*").alias("n"))
    return entries.join(asked, S.fold_term(c("term")) == c("folded"), "left").select("term", "long_name", F.coalesce("n", F.lit(0)).alias("asked"))


@query("a16_road_service_members", with_views("road_pt", "SELECT id_tramo, count(*) AS points, cast(round(cast(sum(x) as decimal(28,8)),5) as double) AS sx FROM road_pt WHERE id_tramo%3<>0 GROUP BY id_tramo"))
def a16(t):
    roads = t.road_src().groupBy("id_tramo").agg(F.min_by("line", "source_fid").alias("line"))
    numbers = F.array_join(F.flatten(F.transform("line", lambda p: F.array(p.x.cast("string"), p.y.cast("string")))), " ")
    name = F.when(c("id_tramo") % 3 == 0, F.concat(F.lit("OTHER"), c("id_tramo").cast("string"))).otherwise(S.road_public_id(c("id_tramo")))
    payload = F.concat(
        F.lit('<member><tn-ro:RoadLink xmlns:tn-ro="urn:r" xmlns:gml="urn:g" gml:id="g1"><localId>'), name, F.lit("</localId><gml:posList>"), numbers, F.lit("</gml:posList></tn-ro:RoadLink></member>")
    )
    parsed = cap.parse_road_members(roads.select(payload.alias("payload")))
    return parsed.select("id_tramo", F.size("line").cast("bigint").alias("points"), S.dec_round(F.aggregate("line", F.lit(0.0), lambda s, p: s + p.x), 5).alias("sx"))


view("manifest", """SELECT dataset_version, delivery_format, nominal_date, CASE WHEN day(nominal_date)%3=0 THEN 'failed' ELSE 'published' END AS publication_status, day(nominal_date)%2=0 AS tiles_generated, '/tiles/'||strftime(nominal_date,'%Y-%m-%d') AS m_path, burned_area_ha
  FROM burnt_stat, (VALUES ('v4','cog')) v(dataset_version, delivery_format)""", ["burnt_stat"])
MANIFEST = "dataset_version string, delivery_format string, nominal_date string, publication_status string, tiles_generated boolean, m_path string, burned_area_ha double"


def manifests(t):
    from pavesa.plans.raster_queries import burnt_days

    return burnt_days(t).selectExpr(
        "'v4' AS dataset_version", "'cog' AS delivery_format", "date_format(nominal_date, 'yyyy-MM-dd') AS nominal_date",
        "CASE WHEN day(nominal_date) % 3 = 0 THEN 'failed' ELSE 'published' END AS publication_status", "day(nominal_date) % 2 = 0 AS tiles_generated",
        "concat('/tiles/', date_format(nominal_date, 'yyyy-MM-dd')) AS m_path", "burned_area_ha",
    )


@query("a17_day_manifests", with_views("manifest", "SELECT strftime(nominal_date,'%Y-%m-%d') AS file_day, publication_status FROM manifest WHERE nominal_date BETWEEN date '1998-02-01' AND date '1998-02-28'"))
def a17(t):
    rows = manifests(t).withColumn("day", c("nominal_date"))
    path = landed(rows.repartition("day").sortWithinPartitions("day"), "day-manifests", "json", ["day"])
    return landing.read_day_manifests(t.spark, path, MANIFEST, "1998-02-01", "1998-02-28").select("file_day", "publication_status")


@query("a18_optional_predicates", with_views("hotspot", "SELECT hotspot_id FROM hotspot WHERE acq_date>=date '2024-01-10' AND firms_source='VIIRS_SNPP_SP'"))
def a18(t):
    rows = pipeline.hotspots(t)
    return landing.scan(rows, P.date_range("acq_date", "2024-01-10", None), None, c("firms_source") == "VIIRS_SNPP_SP").select("hotspot_id")


@query("a19_date_block_plan", """SELECT o_custkey, strftime(b,'%Y-%m-%d') AS block_from, strftime(least(b+90,hi),'%Y-%m-%d') AS block_to, source FROM (SELECT o_custkey, cast(unnest(generate_series(cast(lo as timestamp),cast(hi as timestamp),interval 91 day)) as date) AS b, hi
  FROM (SELECT o_custkey, cast(min(o_orderdate) as date) AS lo, cast(max(o_orderdate) as date) AS hi FROM orders GROUP BY 1)), (VALUES ('VIIRS_NOAA20_SP'),('VIIRS_SNPP_SP')) s(source)""")
def a19(t):
    ranges = t.raw("orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("first_day"), F.to_date(F.max("o_orderdate")).alias("last_day"))
    plan = landing.date_blocks(ranges, 91).withColumn("source", F.explode(F.array(*[F.lit(s) for s in K.HOTSPOT_SOURCES])))
    return plan.select("o_custkey", day_text("block_from"), day_text("block_to"), "source")


# ---- B: sinks and table maintenance --------------------------------------------------------

view("old_state", "SELECT cap_identifier, language, area_code, 'old' AS origin, min(source_record_id) AS rid FROM warning_src WHERE source_download_id<3100 GROUP BY ALL", ["warning_src"])
view("new_state", "SELECT cap_identifier, language, area_code, 'new' AS origin, max(source_record_id) AS rid FROM warning_src WHERE source_download_id>=3000 GROUP BY ALL", ["warning_src"])
KEY = ["cap_identifier", "language", "area_code"]


def two_states(t):
    """Archives up to a day, and a later batch that overlaps them."""
    src = t.warning_src()
    old = src.filter("source_download_id < 3100").groupBy(*KEY).agg(F.lit("old").alias("origin"), F.min("source_record_id").alias("rid"))
    new = src.filter("source_download_id >= 3000").groupBy(*KEY).agg(F.lit("new").alias("origin"), F.max("source_record_id").alias("rid"))
    return old, new


@query("b01_upsert", with_views("old_state new_state", "SELECT coalesce(n.cap_identifier,o.cap_identifier) AS cap_identifier, coalesce(n.language,o.language) AS language, coalesce(n.area_code,o.area_code) AS area_code, coalesce(n.origin,o.origin) AS origin, coalesce(n.rid,o.rid) AS rid FROM old_state o FULL JOIN new_state n ON (o.cap_identifier,o.language,o.area_code)=(n.cap_identifier,n.language,n.area_code)"))
def b01(t):
    return merge.upsert(*two_states(t), KEY)


view("daily_new", "SELECT dataset_version, delivery_format, nominal_date, max(source_catalog_id) AS source_catalog_id, 'cataloged' AS publication_status, max('/new/'||source_catalog_id) AS local_tiles_path FROM catalog_item WHERE nominal_date>=date '1998-01-01' GROUP BY 1,2,3", ["catalog_item"])


@query("b02_preserving_upsert", with_views("daily_file daily_new", """SELECT dataset_version, delivery_format, strftime(nominal_date,'%Y-%m-%d') AS nominal_date, coalesce(n.source_catalog_id,o.source_catalog_id) AS source_catalog_id,
  CASE WHEN o.publication_status<>'cataloged' THEN o.publication_status ELSE coalesce(n.publication_status,o.publication_status) END AS publication_status, coalesce(o.local_tiles_path,n.local_tiles_path) AS local_tiles_path
  FROM (SELECT * FROM daily_file WHERE nominal_date<date '2000-01-01') o FULL JOIN daily_new n USING (dataset_version, delivery_format, nominal_date)"""))
def b02(t):
    keys = ["dataset_version", "delivery_format", "nominal_date"]
    cols = [*keys, "source_catalog_id", "publication_status", "local_tiles_path"]
    old = canonical.daily_files(t.catalog_item()).filter("nominal_date < date'2000-01-01'").select(*cols)
    new = t.catalog_item().filter("nominal_date >= date'1998-01-01'").groupBy(*keys).agg(
        F.max("source_catalog_id").alias("source_catalog_id"), F.lit("cataloged").alias("publication_status"),
        F.max(F.concat(F.lit("/new/"), c("source_catalog_id").cast("string"))).alias("local_tiles_path"),
    )
    out = merge.preserving_upsert(old, new, keys, ["local_tiles_path"], "publication_status", "cataloged")
    return out.withColumn("nominal_date", F.date_format("nominal_date", "yyyy-MM-dd"))


@query("b03_delete_range_insert", with_views("hotspot_series", "SELECT strftime(nominal_date,'%Y-%m-%d') AS nominal_date, CASE WHEN nominal_date BETWEEN date '2024-01-10' AND date '2024-01-12' THEN hotspot_count+1000 ELSE hotspot_count END AS hotspot_count FROM hotspot_series"))
def b03(t):
    days = cut_lineage(pipeline.hotspot_series(t).select("nominal_date", "hotspot_count"), "series")
    inside = P.date_range("nominal_date", "2024-01-10", "2024-01-12")
    return merge.replace_range(days, days.filter(inside).withColumn("hotspot_count", c("hotspot_count") + 1000), inside).select(day_text("nominal_date"), "hotspot_count")


@query("b03_partition_overwrite", with_views("road", "SELECT id_tramo, territory_code, CASE WHEN territory_code IN ('PROVINCIA_1','PROVINCIA_7') THEN 'v2' ELSE 'v1' END AS version FROM road"))
def b03p(t):
    rows = cut_lineage(pipeline.roads(t).select("id_tramo", "territory_code", F.lit("v1").alias("version")), "roads")
    path = scratch_path(t.spark, "road-table")
    merge.overwrite_partitions(rows, path, "territory_code")
    changed = t.spark.read.schema(rows.schema).parquet(path).filter("territory_code IN ('PROVINCIA_1', 'PROVINCIA_7')").withColumn("version", F.lit("v2"))
    merge.overwrite_partitions(changed, path, "territory_code")
    return t.spark.read.schema(rows.schema).parquet(path).select("id_tramo", "territory_code", "version")


@query("b04_truncate_reload", with_views("settlement", "SELECT settlement_id, nombre, habitantes FROM settlement"))
def b04(t):
    rows = pipeline.settlements(t).select("settlement_id", "nombre", "habitantes")
    path = scratch_path(t.spark, "settlements")
    merge.publish(t.spark, rows.filter("habitantes > 1000"), path)
    return merge.publish(t.spark, rows, path)


@query("b05_replace_file_rows", with_views("warning_src warning", "SELECT 'source' AS stage, count(*) AS n FROM warning_src WHERE source_download_id<>3000 UNION ALL SELECT 'core', count(*) FROM warning WHERE warning_id NOT IN (SELECT source_record_id FROM warning_src WHERE source_download_id=3000)"))
def b05(t):
    files = t.warning_download().filter("source_download_id = 3000").select("source_download_id")
    source, core = merge.replace_file_rows(t.warning_src(), pipeline.warnings(t), files)
    n = lambda df, stage: df.agg(F.count("*").alias("n")).select(F.lit(stage).alias("stage"), "n")
    return n(source, "source").unionByName(n(core, "core"))


@query("b06_replace_by_zip", with_views("road_src", "SELECT source_zip_name, count(*) AS n, CASE WHEN source_zip_name='RT_PROVINCIA_3_gpkg.zip' THEN 2 ELSE 1 END AS load FROM road_src GROUP BY 1"))
def b06(t):
    rows = cut_lineage(t.road_src().select("source_fid", F.lit(1).alias("load"), "source_zip_name"), "road-src")
    path = scratch_path(t.spark, "road-source")
    merge.overwrite_partitions(rows, path, "source_zip_name")
    merge.overwrite_partitions(rows.filter("source_zip_name = 'RT_PROVINCIA_3_gpkg.zip'").withColumn("load", F.lit(2)), path, "source_zip_name")
    return t.spark.read.schema(rows.schema).parquet(path).groupBy("source_zip_name").agg(F.count("*").alias("n"), F.max("load").alias("load"))


@query("b07_ingest_ledger", with_views("hotspot_download", "SELECT source_download_id, CASE WHEN source_download_id%4=0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN source_download_id%4<>0 THEN declared_rows END AS rows_loaded, CASE WHEN source_download_id%4=0 THEN '{\"error\":\"bad file\"}' END AS error, 2 AS entries FROM hotspot_download"))
def b07(t):
    files = t.hotspot_download().select("source_download_id", "declared_rows")
    bad = c("source_download_id") % 4 == 0
    started = files.select("source_download_id", F.lit(1).alias("step"), F.lit("running").alias("status"), F.lit(None).cast("bigint").alias("rows_loaded"), F.lit(None).cast("string").alias("error"))
    done = files.select(
        "source_download_id", F.lit(2).alias("step"), F.when(bad, "failed").otherwise("ok").alias("status"), F.when(~bad, c("declared_rows")).alias("rows_loaded"),
        F.when(bad, F.to_json(F.struct(F.lit("bad file").alias("error")))).alias("error"),
    )
    path = landed(started, "ledger")
    done.write.mode("append").parquet(path)
    return merge.latest_status(t.spark.read.schema(started.schema).parquet(path), "source_download_id").withColumn("entries", c("entries").cast("int"))


@query("b08_unchanged_file_skip", with_views("hotspot_download", "SELECT source_download_id FROM hotspot_download WHERE source_download_id%3=0 OR source_download_id%5=0"))
def b08(t):
    m = t.hotspot_download().withColumn("sha256", F.sha2(c("source_download_id").cast("string"), 256))
    known = m.withColumn("sha256", F.when(c("source_download_id") % 3 == 0, F.lit("old")).otherwise(c("sha256")))
    known = known.withColumn("declared_rows", F.when(c("source_download_id") % 5 == 0, c("declared_rows") + 1).otherwise(c("declared_rows")))
    identity = ["firms_source", "bbox_region", "sha256", "request_date_from", "request_date_to"]
    every = t.hotspot_obs().join(m.select("firms_source", "bbox_region", "request_date_from", c("source_download_id").alias("file_id")), ["firms_source", "bbox_region"])
    records = every.filter("datediff(acq_date, request_date_from) BETWEEN 0 AND 4").select(c("file_id").alias("source_download_id"))
    return merge.skip_unchanged(m, known, records, identity).select("source_download_id")


@query("b09_publish_serving_table", with_views("road", "SELECT id_tramo, clase, clase_code FROM road"))
def b09(t):
    line = F.transform("line", lambda p: F.struct(geo.mercator_x(p.x).alias("x"), geo.mercator_y(p.y).alias("y")))
    rows = pipeline.roads(t).select("id_tramo", "clase", c("clase_code").cast("bigint").alias("clase_code"), line.alias("line_webmercator"))
    return merge.publish(t.spark, rows, scratch_path(t.spark, "road-serving")).select("id_tramo", "clase", "clase_code")


@query("b10_feature_rows", with_views("feature", """SELECT feature_id, '{"type":"Feature","geometry":null,"properties":{"feature_id":"'||feature_id||'","level_label":"'||level_label||'","level_rank":'||level_rank||'}}' AS feature FROM feature WHERE is_warning"""))
def b10(t):
    rows = pipeline.features(t).filter("is_warning")
    return rows.select("feature_id", reports.feature_json("warning", F.lit(None).cast("string"), ["feature_id", "level_label", "level_rank"]).alias("feature"))


@query("b12_snapshot_log", with_views("alert", f"SELECT run, count(*) AS n FROM alert, (VALUES (1),(2)) r(run) WHERE onset<=timestamp '{NOW}' AND expires>=timestamp '{NOW}' GROUP BY run"))
def b12(t):
    hits = reports.query_alerts(reports.live_alerts(t.alerts()), F.lit(NOW).cast("timestamp"))
    path = scratch_path(t.spark, "snapshots")
    for run in (1, 2):
        answer = hits.select("id", "level", F.lit(run).alias("run"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"))
        answer.write.mode("append").json(path)
    return t.spark.read.schema("id string, level string, run int, ts string").json(path).groupBy("run").agg(F.count("*").alias("n"))


@query("b13_manifest_status", with_views("daily_file manifest", """SELECT 'core' AS kind, coalesce(m.publication_status,d.publication_status) AS status, count(*) AS n, count(*) FILTER (CASE WHEN m.nominal_date IS NULL THEN d.local_tiles_path IS NOT NULL ELSE m.tiles_generated END) AS with_tiles FROM daily_file d LEFT JOIN manifest m USING (dataset_version, delivery_format, nominal_date) GROUP BY 2
  UNION ALL SELECT 'stat', 'published', count(*), 0 FROM manifest m SEMI JOIN daily_file d USING (dataset_version, delivery_format, nominal_date) WHERE m.publication_status='published'
  UNION ALL SELECT 'reject', '', count(*), 0 FROM manifest m ANTI JOIN daily_file d USING (dataset_version, delivery_format, nominal_date)"""))
def b13(t):
    core = canonical.daily_files(t.catalog_item()).withColumn("nominal_date", F.date_format("nominal_date", "yyyy-MM-dd"))
    new_core, stats, rejects = merge.apply_manifests(core, manifests(t), ["dataset_version", "delivery_format", "nominal_date"])
    zero = F.lit(0).cast("bigint").alias("with_tiles")
    counts = new_core.groupBy(c("publication_status").alias("status")).agg(F.count("*").alias("n"), F.count_if(c("local_tiles_path").isNotNull()).alias("with_tiles"))
    n = lambda df, kind, status: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(status).alias("status"), "n", zero)
    return counts.select(F.lit("core").alias("kind"), "status", "n", "with_tiles").unionByName(n(stats, "stat", "published")).unionByName(n(rejects, "reject", ""))


# ---- Q: data quality -----------------------------------------------------------------------


@query("q01_duplicate_keys", with_views("hotspot_obs", "SELECT firms_source, satellite, latitude, longitude, strftime(acq_date,'%Y-%m-%d') AS acq_date, acq_time, count(*) AS n FROM hotspot_obs GROUP BY ALL HAVING count(*)>1"))
def q01(t):
    keys = ["firms_source", "satellite", "latitude", "longitude", "acq_date", "acq_time"]
    return quality.duplicate_keys(t.hotspot_obs(), keys).withColumn("acq_date", F.date_format("acq_date", "yyyy-MM-dd"))


@query("q02_range_checks", with_views("hotspot_obs", "SELECT source_observation_id, 'latitude' AS rule FROM hotspot_obs WHERE latitude>43.5 UNION ALL SELECT source_observation_id, 'frp' FROM hotspot_obs WHERE frp<1 UNION ALL SELECT source_observation_id, 'longitude' FROM hotspot_obs WHERE longitude<-8.5"))
def q02(t):
    rules = {"latitude": c("latitude").between(27.0, 43.5), "longitude": c("longitude").between(-8.5, 5.0), "frp": c("frp") >= 1}
    return quality.violations(t.hotspot_obs(), rules, "source_observation_id")


@query("q03_time_pattern", with_views("feed", "SELECT event_id, 'acq_time' AS rule FROM feed WHERE NOT regexp_matches(lpad(trim(time_text),4,'0'),'^[0-9]{4}$')"))
def q03(t):
    from pavesa.plans.scalar_queries import feed as feed_rows

    return quality.violations(feed_rows(t), {"acq_time": S.hhmm(c("time_text")).rlike("^[0-9]{4}$")}, "event_id")


@query("q04_orphans", with_views("feature warning", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"))
def q04(t):
    lines = t.raw("lineitem").select(c("l_orderkey").alias("o_orderkey"))
    return quality.orphans(t.raw("orders").select("o_orderkey"), lines, ["o_orderkey"])


@query("q05_closed_sets", with_views("catalog_item", "SELECT source_catalog_id, publication_status FROM catalog_item WHERE publication_status NOT IN ('cataloged','published')"))
def q05(t):
    return quality.outside_set(t.catalog_item(), "publication_status", ["cataloged", "published"]).select("source_catalog_id", "publication_status")


@query("q06_file_hash", "SELECT page_id FROM pages WHERE page_id%10=0")
def q06(t):
    rows = t.raw("pages").select(c("page_id").cast("string").alias("path"), c("html").cast("binary").alias("content"))
    expected = t.raw("pages").select(c("page_id").cast("string").alias("path"), F.when(c("page_id") % 10 == 0, F.lit("stale")).otherwise(F.sha2("html", 256)).alias("sha256"))
    return quality.file_hash_mismatches(rows, expected).select(c("path").cast("bigint").alias("page_id"))


# ---- X: streams ----------------------------------------------------------------------------


#: Landed files for each micro-batch.
FILES = 16


def record_files(t, parts: int = 3):
    """Warning records with their archive data, landed in elaboration order: FILES files for each of the parts, so that no task writes a whole part."""
    downloads = t.warning_download().select("source_download_id", "source_file_path", "request_elaboration_to")
    rows = t.warning_src().join(downloads, "source_download_id").repartitionByRange(parts * FILES, "source_download_id")
    return landed(rows, "records"), rows.schema


def refreshed(t):
    """The incrementally refreshed tables: half of the files by one process, the rest by another over the same root.

    Each half lands as two micro-batches, whatever its size: a batch whose keys are spread over all partitions rewrites them all.
    Queries of one session over the same input share one run.
    """
    done = t.spark.__dict__.setdefault("_pavesa_refreshed", {})
    if t.sf_dir not in done:
        root, landing_dir = scratch_path(t.spark, "refresh"), scratch_path(t.spark, "records")
        downloads = t.warning_download().select("source_download_id", "source_file_path", "request_elaboration_to")
        rows = t.warning_src().join(downloads, "source_download_id")
        for half in (1, 0):
            rows.filter(c("source_download_id") % 2 == half).repartition(2 * FILES, "source_record_id").write.mode("append").parquet(landing_dir)
            job = refresh.run_refresh(t.spark, landing_dir, rows.schema, root, files_per_batch=FILES, buckets=8)
        done[t.sf_dir] = job
    return done[t.sf_dir]


@query("x01_affected_keys", with_views("warning_src", "SELECT DISTINCT cap_identifier, language, area_code FROM warning_src"))
def x01(t):
    path, schema = record_files(t)
    batch = t.spark.readStream.schema(schema).parquet(path).select(*KEY, "sent_at")
    return feed.drain(batch.dropDuplicates(KEY).select(*KEY), "keys")


@query("x02_old_and_new_days", with_views("warning_day work_key", "SELECT strftime(valid_date,'%Y-%m-%d') AS valid_date, count(*) AS n FROM warning_day JOIN work_key USING (cap_identifier, language, area_code) GROUP BY 1"))
def x02(t):
    from pavesa.plans.report_queries import work_keys

    job = refreshed(t)
    return job.table("core_day").join(work_keys(t), KEY, "left_semi").groupBy("valid_date").agg(F.count("*").alias("n")).select(day_text("valid_date"), "n")


@query("x03_incremental_core", with_views("warning", f"SELECT cap_identifier, language, area_code, level_label, level_rank, temperature_max_c, {time_sql('onset_at expires_at')}, warning_id, duplicate_source_count FROM warning"))
def x03(t):
    return refreshed(t).table("core").select(
        *KEY, "level_label", "level_rank", "temperature_max_c", time_text("onset_at"), time_text("expires_at"), "warning_id", "duplicate_source_count"
    )


@query("x04_incremental_pub", with_views("feature", "SELECT feature_id, warning_id, level_label, level_rank, is_warning, temperature_max_c, source_version_count FROM feature"))
def x04(t):
    return refreshed(t).table("pub").select("feature_id", "warning_id", "level_label", "level_rank", "is_warning", "temperature_max_c", "source_version_count")


@query("x05_bootstrap", with_views("feature", "SELECT count(*) AS n, cast(sum(source_version_count) as bigint) AS versions FROM feature"))
def x05(t):
    """Records are in storage but nothing is built from them yet; another process finds that and builds all."""
    path, schema = record_files(t, 1)
    root = scratch_path(t.spark, "bootstrap")
    refresh.WarningRefresh(t.spark, root, 8).store(t.spark.read.schema(schema).parquet(path), 0)
    job = refresh.WarningRefresh(t.spark, root, 8)
    job.refresh(None, 1)
    return job.table("pub").agg(F.count("*").alias("n"), F.sum("source_version_count").alias("versions"))


@query("x06_late_warnings", with_views("warning_src", "SELECT DISTINCT cap_identifier, language, area_code FROM warning_src"))
def x06(t):
    """One part for each trigger, newest first; a part is FILES files."""
    path, schema = scratch_path(t.spark, "late-records"), t.warning_src().schema
    for part in (2, 1, 0):
        t.warning_src().filter(c("source_download_id") % 3 == part).repartition(FILES).write.mode("append").parquet(path)
    return feed.drain(feed.late_warnings(t.spark, path, schema, KEY, files_per_batch=FILES).select(*KEY), "late")


@query("x07_idempotent_reimport", with_views("warning", "SELECT count(*) AS n, count(DISTINCT cap_identifier) AS identifiers FROM warning"))
def x07(t):
    path, schema = record_files(t, 2)
    root = scratch_path(t.spark, "reimport")
    job = refresh.run_refresh(t.spark, path, schema, root, files_per_batch=FILES, buckets=8)
    again = refresh.run_refresh(t.spark, path, schema, root, files_per_batch=FILES, buckets=8)
    if again.batches:
        raise RuntimeError("a second run over the same files must not process anything")
    return job.table("core").agg(F.count("*").alias("n"), F.countDistinct("cap_identifier").alias("identifiers"))


@query("x08_live_hotspot_feed", with_views("hotspot_obs", "SELECT DISTINCT firms_source, latitude, longitude, acq_time, satellite FROM hotspot_obs"))
def x08(t):
    cols = ["firms_source", "latitude", "longitude", "acq_time", "satellite", "observed_at"]
    rows = t.hotspot_obs().select(*cols)
    path = landed(rows, "feed", "csv", header=True)
    keys = ["firms_source", "latitude", "longitude", "acq_time", "satellite"]
    return feed.drain(feed.distinct_hotspots(t.spark, path, rows.schema, keys, "40 days"), "feed-out").select(*keys)


@query("x09_state_at_time", with_views("alert", f"SELECT *, active+upcoming AS total FROM (SELECT count(*) FILTER (onset<=timestamp '{NOW}' AND expires>=timestamp '{NOW}') AS active, count(*) FILTER (onset>timestamp '{NOW}') AS upcoming, count(*) FILTER (expires<timestamp '{NOW}') AS expired FROM alert)"))
def x09(t):
    rows = t.alerts().select("id", "onset", "expires")
    return feed.drain(feed.alert_states(t.spark, landed(rows, "alerts"), rows.schema, F.lit(NOW).cast("timestamp")), "states", "complete")

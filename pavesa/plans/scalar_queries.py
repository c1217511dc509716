"""Projections, parsing and filters: families C and F."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pavesa import constants as K
from pavesa.functions import geo
from pavesa.functions import scalar as S
from pavesa.plans import pipeline
from pavesa.plans.domain_sql import view, with_views
from pavesa.plans.refine_queries import day_text
from pavesa.plans.registry import query
from pavesa.functions import parameters

# The wording a landed file could carry, derived from the event rows.
FEED_SPARK = [
    "event_id",
    "CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN cast(value as string) WHEN 2 THEN 'n/a' ELSE concat(' ', cast(value as string), ' ') END AS frp_text",
    "CASE event_id % 7 WHEN 0 THEN ' High' WHEN 1 THEN 'nominal' WHEN 2 THEN 'L' WHEN 3 THEN 'h ' WHEN 4 THEN '85' WHEN 5 THEN '' END AS confidence_text",
    "CASE event_id % 5 WHEN 0 THEN 'd' WHEN 1 THEN ' N ' WHEN 2 THEN 'X' WHEN 3 THEN '' END AS daynight_text",
    "CASE event_id % 6 WHEN 0 THEN '5' WHEN 1 THEN ' 45 ' WHEN 2 THEN '130' WHEN 3 THEN '2359' WHEN 4 THEN '1x30' ELSE '' END AS time_text",
    "CASE event_id % 3 WHEN 0 THEN 'VIIRS_SNPP_SP' WHEN 1 THEN 'MODIS_NRT' ELSE 'OTHER' END AS source_text",
    "CASE event_id % 5 WHEN 0 THEN ' MOD ' ELSE ' ' END AS instrument_text",
    "date_format(ts, 'yyyy-MM-dd') AS acq_date",
]
view("feed", """SELECT event_id, CASE event_id%4 WHEN 0 THEN '' WHEN 1 THEN cast(value as varchar) WHEN 2 THEN 'n/a' ELSE ' '||cast(value as varchar)||' ' END AS frp_text,
  CASE event_id%7 WHEN 0 THEN ' High' WHEN 1 THEN 'nominal' WHEN 2 THEN 'L' WHEN 3 THEN 'h ' WHEN 4 THEN '85' WHEN 5 THEN '' END AS confidence_text,
  CASE event_id%5 WHEN 0 THEN 'd' WHEN 1 THEN ' N ' WHEN 2 THEN 'X' WHEN 3 THEN '' END AS daynight_text,
  CASE event_id%6 WHEN 0 THEN '5' WHEN 1 THEN ' 45 ' WHEN 2 THEN '130' WHEN 3 THEN '2359' WHEN 4 THEN '1x30' ELSE '' END AS time_text,
  CASE event_id%3 WHEN 0 THEN 'VIIRS_SNPP_SP' WHEN 1 THEN 'MODIS_NRT' ELSE 'OTHER' END AS source_text,
  CASE event_id%5 WHEN 0 THEN ' MOD ' ELSE ' ' END AS instrument_text, strftime(ts,'%Y-%m-%d') AS acq_date FROM events""")
c = F.col


def feed(t):
    return t.raw("events").selectExpr(*FEED_SPARK)


@query("c01_safe_float", with_views("feed", "SELECT event_id, try_cast(trim(frp_text) as double) AS frp FROM feed"))
def c01(t):
    return feed(t).select("event_id", S.safe_double(c("frp_text")).alias("frp"))


@query("c02_confidence_alias", with_views("feed", """SELECT event_id, CASE lower(trim(confidence_text)) WHEN 'high' THEN 'h' WHEN 'h' THEN 'h' WHEN 'nominal' THEN 'n' WHEN 'n' THEN 'n' WHEN 'low' THEN 'l' WHEN 'l' THEN 'l' END AS strict,
  CASE lower(trim(coalesce(confidence_text,''))) WHEN 'high' THEN 'h' WHEN 'nominal' THEN 'n' WHEN 'low' THEN 'l' ELSE lower(trim(coalesce(confidence_text,''))) END AS lenient FROM feed"""))
def c02(t):
    return feed(t).select(
        "event_id", S.confidence_strict(c("confidence_text")).alias("strict"), S.confidence_lenient(c("confidence_text")).alias("lenient")
    )


@query("c03_confidence_label", with_views("feed", """SELECT event_id, CASE lower(trim(coalesce(confidence_text,''))) WHEN 'high' THEN 'alta' WHEN 'h' THEN 'alta' WHEN 'nominal' THEN 'nominal' WHEN 'l' THEN 'baja' WHEN '85' THEN '85'
  ELSE 'no indicada' END AS label FROM feed"""))
def c03(t):
    return feed(t).select("event_id", S.confidence_label(S.confidence_lenient(c("confidence_text"))).alias("label"))


@query("c04_day_night", with_views("feed", "SELECT event_id, CASE WHEN upper(trim(daynight_text)) IN ('D','N') THEN upper(trim(daynight_text)) END AS daynight FROM feed"))
def c04(t):
    return feed(t).select("event_id", S.day_night(c("daynight_text")).alias("daynight"))


@query("c05_observed_at", with_views("feed", """SELECT event_id, p AS acq_time, CASE WHEN regexp_matches(p,'^[0-9]{4}$') THEN acq_date||' '||p[1:2]||':'||p[3:4]||':00' END AS observed_at,
  acq_date||'T'||CASE WHEN regexp_matches(p,'^[0-9]{4}$') THEN p[1:2]||':'||p[3:4] ELSE '00:00' END||':00Z' AS live_text FROM (SELECT *, lpad(trim(time_text),4,'0') AS p FROM feed)"""))
def c05(t):
    return feed(t).select(
        "event_id", S.hhmm(c("time_text")).alias("acq_time"),
        F.date_format(S.observed_at(c("acq_date"), c("time_text")), "yyyy-MM-dd HH:mm:ss").alias("observed_at"),
        S.live_observed_text(c("acq_date"), c("time_text")).alias("live_text"),
    )


@query("c06_instrument", with_views("feed", """SELECT event_id, coalesce(nullif(trim(instrument_text),''), CASE WHEN source_text LIKE 'VIIRS\\_%' ESCAPE '\\' THEN 'VIIRS' WHEN source_text LIKE 'MODIS\\_%' ESCAPE '\\' THEN 'MODIS' END) AS instrument FROM feed"""))
def c06(t):
    return feed(t).select("event_id", S.instrument(c("instrument_text"), c("source_text")).alias("instrument"))


@query("c07_row_hash", with_views("feed", """SELECT event_id, sha256(cast(json_object('acq_date',acq_date,'confidence_text',confidence_text,'frp_text',frp_text,'time_text',time_text) as varchar)) AS row_hash FROM feed"""))
def c07(t):
    return feed(t).select("event_id", S.row_hash("time_text", "frp_text", "confidence_text", "acq_date").alias("row_hash"))


@query("c08_feature_id", with_views("hotspot_obs", """SELECT source_observation_id, printf('%s_%.6f_%.6f_%s_%s_%s', firms_source, latitude, longitude, strftime(acq_date,'%Y-%m-%d'), acq_time, satellite) AS feature_id FROM hotspot_obs"""))
def c08(t):
    fid = S.feature_id(c("firms_source"), c("latitude"), c("longitude"), F.date_format("acq_date", "yyyy-MM-dd"), c("acq_time"), c("satellite"))
    return t.hotspot_obs().select("source_observation_id", fid.alias("feature_id"))


CODED = "CASE p_partkey % 5 WHEN 0 THEN concat('AT; ', p_name, ';', p_brand, '; x') WHEN 1 THEN concat(p_brand, ';') WHEN 2 THEN '' WHEN 3 THEN concat(' ', p_brand, ';', p_type, ';') END"


@query("c09_coded_value_split", """SELECT p_partkey, CASE p_partkey%5 WHEN 0 THEN 'AT' WHEN 1 THEN p_brand WHEN 3 THEN p_brand END AS code, CASE p_partkey%5 WHEN 0 THEN trim(p_name) WHEN 3 THEN trim(p_type) END AS label,
  CASE p_partkey%5 WHEN 0 THEN p_brand||';x' WHEN 3 THEN '' END AS payload FROM part""")
def c09(t):
    code, label, payload = S.coded_parts(c("v"))
    return t.raw("part").selectExpr("p_partkey", f"{CODED} AS v").select("p_partkey", code.alias("code"), label.alias("label"), payload.alias("payload"))


@query("c10_first_coded_pair", """SELECT c_custkey, CASE WHEN c_custkey%3=0 THEN c_name WHEN c_custkey%3=1 THEN c_mktsegment END AS zone FROM customer""")
def c10(t):
    pairs = F.expr(
        "filter(array(named_struct('valueName', 'other', 'value', 'x'),"
        " named_struct('valueName', if(c_custkey % 3 = 0, 'zona', 'otra'), 'value', c_name),"
        " named_struct('valueName', if(c_custkey % 3 < 2, ' zona ', 'z'), 'value', c_mktsegment)), p -> p.value IS NOT NULL)"
    )
    return t.raw("customer").select("c_custkey", S.coded_value(pairs, "zona").alias("zone"))


PARAM = "CASE o_custkey % 4 WHEN 0 THEN ' Rojo' WHEN 1 THEN '' WHEN 2 THEN 'xx' END"


@query("c11_warning_level", with_views("alerts", f"""SELECT id, CASE WHEN p='rojo' THEN 'rojo' WHEN contains(e,'verde') THEN 'verde' WHEN contains(e,'amarillo') THEN 'amarillo' WHEN contains(e,'naranja') THEN 'naranja' WHEN contains(e,'rojo') THEN 'rojo'
   WHEN p='' THEN 'verde' ELSE p END AS level_code,
  CASE WHEN p='rojo' THEN 'Rojo' WHEN contains(e,'verde') THEN 'Verde' WHEN contains(e,'amarillo') THEN 'Amarillo' WHEN contains(e,'naranja') THEN 'Naranja' WHEN contains(e,'rojo') THEN 'Rojo' ELSE 'Verde' END AS level_label,
  CASE WHEN contains(e,'rojo') THEN 'Rojo' WHEN contains(e,'naranja') THEN 'Naranja' WHEN contains(e,'amarillo') THEN 'Amarillo' ELSE 'Verde' END AS live_level
  FROM (SELECT id, lower(trim(coalesce({PARAM.replace('o_custkey', 'cast(id as bigint)')},''))) AS p, lower(event_text) AS e FROM alerts)"""))
def c11(t):
    param = F.expr(PARAM.replace("o_custkey", "cast(id as bigint)"))
    return t.alerts().select(
        "id", S.level_code(param, c("event_text")).alias("level_code"), S.level_label(param, c("event_text")).alias("level_label"),
        S.live_level(c("event_text")).alias("live_level"),
    )


@query("c12_level_rank_color", with_views("warning_src", """SELECT source_record_id, CASE level_label WHEN 'Rojo' THEN 3 WHEN 'Naranja' THEN 2 WHEN 'Amarillo' THEN 1 ELSE 0 END AS level_rank,
  level_label IN ('Amarillo','Naranja','Rojo') AS is_warning, CASE level_label WHEN 'Rojo' THEN '#CC0000' WHEN 'Naranja' THEN '#FFA500' WHEN 'Amarillo' THEN '#FFD700' ELSE '#4CAF50' END AS level_color FROM warning_src"""))
def c12(t):
    lab = c("level_label")
    return t.warning_src().select(
        "source_record_id", S.level_rank(lab).alias("level_rank"), S.is_warning(lab).alias("is_warning"), S.level_color(lab).alias("level_color")
    )


TEMP_P = "CASE o_orderkey % 4 WHEN 0 THEN concat('Temperatura maxima: ', cast(o_orderkey % 45 as string), ' ºC') WHEN 1 THEN concat(cast(o_orderkey % 45 as string), ',5 c') WHEN 2 THEN '' END"
TEMP_D = "CASE o_orderkey % 3 WHEN 0 THEN 'minima de -3.2°C' WHEN 1 THEN 'sin dato' END"


@query("c13_temperature_from_text", """SELECT o_orderkey, CASE WHEN o_orderkey%4=0 THEN cast(o_orderkey%45 as double) WHEN o_orderkey%4=1 THEN o_orderkey%45+cast(0.5 as double) WHEN o_orderkey%3=0 THEN cast(-3.2 as double) END AS temperature_c FROM orders""")
def c13(t):
    return t.raw("orders").select("o_orderkey", S.temperature_c(F.expr(TEMP_P), F.expr(TEMP_D)).alias("temperature_c"))


RING_TEXT = (
    "CASE c_custkey % 4 WHEN 0 THEN concat(la, ',', lo, ' x,1 ', la2, ',', lo, '  95.0,2 ', la2, ',', lo2) WHEN 1 THEN"
    " concat(la, ',', lo, ' ', la2, ',', lo, ' ', la2, ',', lo2, ' ', la, ',', lo) WHEN 2 THEN concat(la, ',', lo, ' ', la2, ',', lo) END"
)


@query("c14_polygon_text", """SELECT c_custkey, CASE WHEN c_custkey%4<2 THEN 'POLYGON(('||printf('%.8f %.8f, %.8f %.8f, %.8f %.8f, %.8f %.8f', lo,la,lo,la2,lo2,la2,lo,la)||'))' END AS wkt
  FROM (SELECT c_custkey, 36.0+(c_custkey%80)*cast(0.125 as double) AS la, 36.5+(c_custkey%80)*cast(0.125 as double) AS la2, -9.0+(c_custkey%90)*cast(0.125 as double) AS lo, -8.5+(c_custkey%90)*cast(0.125 as double) AS lo2 FROM customer)""")
def c14(t):
    rows = t.raw("customer").selectExpr(
        "c_custkey", "cast(36.0D + (c_custkey % 80) * 0.125D as string) AS la", "cast(36.5D + (c_custkey % 80) * 0.125D as string) AS la2",
        "cast(-9.0D + (c_custkey % 90) * 0.125D as string) AS lo", "cast(-8.5D + (c_custkey % 90) * 0.125D as string) AS lo2",
    )
    return rows.select("c_custkey", geo.ring_wkt(S.polygon_ring(F.expr(RING_TEXT))).alias("wkt"))


@query("c15_event_titles", with_views("alert", """SELECT id, event AS live_title, trim(regexp_replace(regexp_replace(event_text,'(?i)\\s*(amarillo|naranja|rojo|verde|nivel\\s*\\d)','','g'),'\\s+',' ','g')) AS display_title FROM alert"""))
def c15(t):
    return t.alerts().select(
        "id", S.live_event_title(c("event_text")).alias("live_title"), S.display_event_title(c("event_text")).alias("display_title")
    )


@query("c16_flood_related", with_views("alerts", """SELECT id, contains(lower(event_text),'lluvia') OR contains(lower(event_text),'costero') OR contains(lower(event_text),'deshielo') AS flood FROM alerts"""))
def c16(t):
    return t.alerts().select("id", S.flood_related(c("event_text")).alias("flood"))


FRP = "CASE WHEN event_id % 40 = 0 THEN 200.0D WHEN event_id % 50 = 1 THEN NULL ELSE value * 3 END"


@query("c17_frp_class", """SELECT event_id, CASE WHEN v>200 THEN 'Muy alto' WHEN v>=50 THEN 'Alto' WHEN v>=10 THEN 'Medio' ELSE 'Bajo' END AS frp_class,
  CASE WHEN v>200 THEN '#8E1B1B' WHEN v>=50 THEN '#E94F37' WHEN v>=10 THEN '#F8961E' ELSE '#FFD166' END AS frp_color
  FROM (SELECT event_id, coalesce(CASE WHEN event_id%40=0 THEN 200.0 WHEN event_id%50=1 THEN NULL ELSE value*3 END,0) AS v FROM events)""")
def c17(t):
    return t.raw("events").select("event_id", S.frp_class(F.expr(FRP)).alias("frp_class"), S.frp_color(F.expr(FRP)).alias("frp_color"))


@query("c18_frp_group_radius", """SELECT event_id, CASE WHEN v>=200 THEN 0 WHEN v>=50 THEN 1 WHEN v>=10 THEN 2 ELSE 3 END AS frp_group, CASE WHEN v>200 THEN 11 WHEN v>=50 THEN 9 WHEN v>=10 THEN 7 ELSE 5 END AS radius
  FROM (SELECT event_id, coalesce(CASE WHEN event_id%40=0 THEN 200.0 WHEN event_id%50=1 THEN NULL ELSE value*3 END,0) AS v FROM events)""")
def c18(t):
    return t.raw("events").select("event_id", S.frp_group(F.expr(FRP)).alias("frp_group"), S.frp_radius(F.expr(FRP)).alias("radius"))


@query("c19_population_normalise", "SELECT c_custkey, CASE WHEN c_acctbal>=0 THEN cast(round_even(c_acctbal/2,0) as integer) END AS habitantes FROM customer")
def c19(t):
    return t.raw("customer").select("c_custkey", S.population(c("c_acctbal") / 2).alias("habitantes"))


@query("c20_population_class", """SELECT c_custkey, CASE WHEN p<100 THEN 'menor_100' WHEN p<500 THEN '100_499' WHEN p<5000 THEN '500_4999' WHEN p<50000 THEN '5000_49999' ELSE '50000_mas' END AS population_class,
  CASE WHEN p<100 THEN 1 WHEN p<500 THEN 2 WHEN p<5000 THEN 3 WHEN p<50000 THEN 4 ELSE 5 END AS population_rank FROM (SELECT c_custkey, CASE WHEN c_acctbal>=0 THEN cast(round_even(c_acctbal*10,0) as integer) END AS p FROM customer)""")
def c20(t):
    people = S.population(c("c_acctbal") * 10)
    return t.raw("customer").select("c_custkey", S.population_class(people).alias("population_class"), S.population_rank(people).alias("population_rank"))


@query("c21_settlement_attributes", with_views("settlement", "SELECT settlement_id, nombre, etiqueta, tipo_code, tipo_label, capital_code, is_capital FROM settlement"))
def c21(t):
    return pipeline.settlements(t).select("settlement_id", "nombre", "etiqueta", "tipo_code", "tipo_label", "capital_code", "is_capital")


@query("c22_sentinel_codes", with_views("road_src", "SELECT source_fid, CASE WHEN clase_raw IN (-997,-998) THEN NULL ELSE clase_raw END AS clase_code FROM road_src"))
def c22(t):
    return t.road_src().select("source_fid", S.no_sentinel(c("clase_raw")).cast("bigint").alias("clase_code"))


@query("c23_lane_count", with_views("road_src", "SELECT source_fid, CASE WHEN regexp_matches(trim(ncarriles),'^-?[0-9]+$') AND cast(trim(ncarriles) as integer) NOT IN (-997,-998) THEN cast(trim(ncarriles) as integer) END AS lanes FROM road_src"))
def c23(t):
    return t.road_src().select("source_fid", S.lane_count(c("ncarriles")).alias("lanes"))


@query("c24_road_public_id", with_views("road_src", "SELECT source_fid, 'VIAL_TR'||id_tramo AS public_id, id_tramo AS parsed, CASE WHEN id_tramo%2=0 THEN NULL ELSE id_tramo END AS parsed_mixed FROM road_src"))
def c24(t):
    mixed = F.when(c("id_tramo") % 2 == 0, F.concat(F.lit("OTHER"), c("id_tramo").cast("string"))).otherwise(S.road_public_id(c("id_tramo")))
    return t.road_src().select(
        "source_fid", S.road_public_id(c("id_tramo")).alias("public_id"), S.road_id_from_public(S.road_public_id(c("id_tramo"))).alias("parsed"),
        S.road_id_from_public(mixed).alias("parsed_mixed"),
    )


STAMP = "CASE o_orderkey % 4 WHEN 0 THEN concat('\"', d, '\"T\"10:20:30+02:00\"') WHEN 1 THEN concat(d, '\"\"T\"\"01:00:00') WHEN 2 THEN 'bad' ELSE '' END"


@query("c25_product_version_time", with_views("catalog_item", """SELECT source_catalog_id, 'V'||(source_catalog_id%4)||'.'||split_part(product_name,'.',2) AS product_version, strftime(nominal_date,'%Y-%m-%d') AS nominal_date,
  CASE source_catalog_id%4 WHEN 0 THEN strftime(nominal_date,'%Y-%m-%d')||' 08:20:30' WHEN 1 THEN strftime(nominal_date,'%Y-%m-%d')||' 01:00:00' END AS start_at FROM catalog_item"""))
def c25(t):
    rows = t.catalog_item().withColumn("d", F.date_format("nominal_date", "yyyy-MM-dd"))
    stamp = S.catalog_time(F.expr(STAMP.replace("o_orderkey", "source_catalog_id")))
    return rows.select(
        "source_catalog_id", S.product_version(c("product_name")).alias("product_version"), F.left(c("d"), F.lit(10)).alias("nominal_date"),
        F.date_format(stamp, "yyyy-MM-dd HH:mm:ss").alias("start_at"),
    )


@query("c26_name_fold", "SELECT doc_id, strip_accents(lower(trim(source||' É '||lang))) AS folded FROM documents")
def c26(t):
    return t.raw("documents").select("doc_id", S.fold_name(F.concat_ws(" É ", "source", "lang")).alias("folded"))


@query("c27_term_fold", "SELECT p_partkey, replace(upper(trim(p_name)),' ','') AS folded FROM part")
def c27(t):
    return t.raw("part").select("p_partkey", S.fold_term(c("p_name")).alias("folded"))


@query("c28_json_merge", """SELECT o_orderkey, CASE WHEN o_orderkey%2=0 THEN 'b='||o_orderpriority||'|k='||o_orderstatus||'|x=1' ELSE 'b=old|k='||o_orderstatus END AS merged FROM orders""")
def c28(t):
    left = F.create_map(F.lit("k"), c("o_orderstatus"), F.lit("b"), F.lit("old"))
    right = F.when(
        c("o_orderkey") % 2 == 0, F.create_map(F.lit("b"), c("o_orderpriority"), F.lit("x"), F.lit("1"))
    ).otherwise(F.create_map().cast("map<string,string>"))
    merged = F.transform(F.array_sort(F.map_entries(S.merge_json(left, right))), lambda e: F.concat_ws("=", e.key, e.value))
    return t.raw("orders").select("o_orderkey", F.array_join(merged, "|").alias("merged"))


SQ = "trim(regexp_replace({0},'\\s+',' ','g'))"
view("landcover_norm", f"""SELECT cover_id, coalesce(nullif({SQ.format('valor')},''),nullif({SQ.format('codiige_valor')},''),nullif({SQ.format('hilucs_valor')},''),'Uso del suelo') AS label,
  coalesce(nullif(codigo_n3,''),nullif(codiige,''),'H') AS code, CASE WHEN codigo_n3<>'' THEN 'codigo_n3' WHEN codiige<>'' THEN 'codiige' ELSE 'hilucs' END AS code_field,
  CASE WHEN feature_id LIKE 'corine2018.%' THEN 'CORINE 2018' WHEN feature_id LIKE 'siose2014.%' THEN 'SIOSE 2014' WHEN feature_id LIKE 'sioseAR2017.%' THEN 'SIOSE AR 2017' ELSE 'IGN WMS' END AS source_dataset,
  CASE WHEN codigo_n3='' AND codiige='' THEN '' ELSE {SQ.format('hilucs_valor')} END AS secondary_label FROM landcover""", ["landcover"])


def landcover_attributes(cover):
    """Label, code, dataset and secondary label by their fallback order."""
    blank = lambda n: F.nullif(S.squeeze(c(n)), F.lit(""))
    n3, cod, hil = (F.nullif(c(n), F.lit("")) for n in ("codigo_n3", "codiige", "hilucs"))
    field = F.when(n3.isNotNull(), "codigo_n3").when(cod.isNotNull(), "codiige").when(hil.isNotNull(), "hilucs")
    return cover.withColumns({
        "label": F.coalesce(blank("valor"), blank("codiige_valor"), blank("hilucs_valor"), F.lit("Uso del suelo")),
        "code": F.coalesce(n3, cod, hil),
        "code_field": field,
        "source_dataset": S.landcover_dataset(c("feature_id")),
        "secondary_label": F.when(F.coalesce(field, F.lit("")) == "hilucs", "").otherwise(S.squeeze(c("hilucs_valor"))),
    })


@query("c29_landcover_attributes", with_views("landcover_norm", "SELECT * FROM landcover_norm"))
def c29(t):
    return landcover_attributes(t.landcover().withColumn("hilucs", F.lit("H"))).select(
        "cover_id", "label", "code", "code_field", "source_dataset", "secondary_label"
    )


@query("c30_surface_clean", with_views("landcover", "SELECT cover_id, CASE WHEN try_cast(superficie_ha as double)>=0 AND NOT isnan(try_cast(superficie_ha as double)) THEN cast(round(cast(cast(superficie_ha as double) as decimal(28,8)),2) as double) END AS surface_ha FROM landcover"))
def c30(t):
    return t.landcover().select("cover_id", S.clean_surface(c("superficie_ha")).alias("surface_ha"))


@query("c31_secret_redaction", with_views("chat_text", """SELECT conv_id, turn, regexp_replace(regexp_replace(text,'\\bsk-[A-Za-z0-9_\\-]{16,}\\b','[REDACTED]','g'),'(?i)\\bBearer\\s+[A-Za-z0-9_\\-\\.=]{16,}\\b','[REDACTED]','g') AS text FROM chat_text"""))
def c31(t):
    return t.chat_text().select("conv_id", "turn", S.redact(c("text")).alias("text"))


def _sanitize_sql(col: str) -> str:
    out = col
    for p in K.SANITIZE_PATTERNS:
        out = f"regexp_replace({out},'{p}','[SANITIZED]','g')"
    return out


@query("c32_prompt_sanitising", with_views("chat_text", f"SELECT conv_id, turn, s AS text, length(substring(s,1,4000)) AS cut_chars FROM (SELECT conv_id, turn, {_sanitize_sql('text')} AS s FROM chat_text)"))
def c32(t):
    return t.chat_text().select(
        "conv_id", "turn", S.sanitize(c("text")).alias("text"), F.length(S.sanitize(c("text"), K.SANITIZE_MAX)).alias("cut_chars")
    )


@query("c32_document_sanitising", f"SELECT doc_id, md5(s) AS digest, length(s) AS n FROM (SELECT doc_id, {_sanitize_sql('text')} AS s FROM documents)")
def c32d(t):
    s = S.sanitize(c("text"))
    return t.raw("documents").select("doc_id", F.md5(s.cast("binary")).alias("digest"), F.length(s).alias("n"))


@query("c34_danger_class", """SELECT event_id, CASE WHEN value<11.2 THEN 'Bajo' WHEN value<21.3 THEN 'Moderado' WHEN value<38 THEN 'Alto' WHEN value<50 THEN 'Muy alto' WHEN value<70 THEN 'Extremo' ELSE 'Muy extremo' END AS fwi_class,
  CASE WHEN value*8<256.1 THEN 'Bajo' WHEN value*8<334.1 THEN 'Moderado' WHEN value*8<450.6 THEN 'Alto' WHEN value*8<600 THEN 'Muy alto' WHEN value*8<749.4 THEN 'Extremo' ELSE 'Muy extremo' END AS dc_class FROM events""")
def c34(t):
    return t.raw("events").select("event_id", S.danger_class(c("value"), "FWI").alias("fwi_class"), S.danger_class(c("value") * 8, "DC").alias("dc_class"))


@query("c35_territory_name", with_views("road_src", "SELECT source_fid, regexp_extract(source_zip_name,'^RT_(.*)_gpkg.zip$',1) AS territory_code, 'Provincia '||regexp_extract(source_zip_name,'PROVINCIA_([0-9]+)',1) AS territory_name FROM road_src"))
def c35(t):
    code = S.territory_code(c("source_zip_name"))
    return t.road_src().select("source_fid", code.alias("territory_code"), S.territory_name(code).alias("territory_name"))


def response_blocks(text):
    """The four blocks of a reply: from the end of a header to the next header; no header, all in block one."""
    clean = F.regexp_replace(text, r"(?is)<thinking>.*?</thinking>", "")
    clean = F.regexp_replace(F.regexp_replace(clean, r"<\|[^>]*\|>", ""), r"(?i)</?channel[^>]*>", "")
    found = []
    for name, pattern in K.BLOCK_HEADERS:
        at = F.regexp_instr(clean, F.lit(f"(?i){pattern}"))
        found.append(F.struct(at.alias("at"), F.length(F.regexp_extract(clean, f"(?i)({pattern})", 1)).alias("len"), F.lit(name).alias("name")))
    marks = F.array_sort(F.filter(F.array(*found), lambda m: m["at"] > 0))

    def body(name):
        me = F.get(F.filter(marks, lambda m: m["name"] == name), F.lit(0))
        after = F.filter(marks, lambda m: m["at"] > me["at"])
        end = F.coalesce(F.get(after, F.lit(0))["at"], F.length(clean) + 1)
        part = F.substring(clean, me["at"] + me["len"], end - me["at"] - me["len"])
        tidy = F.regexp_replace(F.regexp_replace(part, r"^[\]\*\s]+", ""), r"[\*\s\[\]]+$", "")
        return F.coalesce(tidy, F.lit(""))

    none = F.size(marks) == 0
    whole = F.regexp_replace(clean, r"^\s+|\s+$", "")
    return {
        name: (F.when(none, whole).otherwise(body(name)) if i == 0 else F.when(none, "").otherwise(body(name)))
        for i, (name, _) in enumerate(K.BLOCK_HEADERS)
    }


@query("c33_response_blocks", with_views("chat_text", """SELECT conv_id, turn, CASE WHEN turn%5=2 THEN regexp_replace(regexp_replace(': '||o,'^[\\]\\*\\s]+',''),'[\\*\\s\\[\\]]+$','')
    ELSE regexp_replace(regexp_replace(regexp_replace(text,'<\\|[^>]*\\|>','','g'),'^\\s+',''),'\\s+$','') END AS interpretacion, '' AS operaciones, CASE WHEN turn%5=2 THEN '12 focos.' ELSE '' END AS resultados,
   CASE WHEN turn%5=2 THEN '- vigilar' ELSE '' END AS interpretacion_emergencia
  FROM (SELECT c.*, k.text AS o FROM chat_text c JOIN conversations k ON k.conv_id=c.conv_id AND k.turn=c.turn)"""))
def c33(t):
    blocks = response_blocks(c("text"))
    return t.chat_text().select("conv_id", "turn", *[v.alias(k) for k, v in blocks.items()])


# ---- filters -------------------------------------------------------------------------------


@query("f01_date_range", with_views("hotspot_obs", """SELECT source_observation_id, strftime(acq_date,'%Y-%m-%d') AS acq_date FROM hotspot_obs WHERE acq_date BETWEEN date '2024-01-05' AND date '2024-01-20'"""))
def f01(t):
    keep = parameters.date_range("acq_date", "2024-01-05", "2024-01-20")
    return t.hotspot_obs().filter(keep).select("source_observation_id", day_text("acq_date"))


@query("f02_live_fire_filter", with_views("live_fire", """SELECT fire_id FROM live_fire WHERE sensor='VIIRS_NOAA20_SP' AND longitude BETWEEN -6 AND 1 AND latitude BETWEEN 37 AND 42 AND coalesce(frp,0)>=0 AND confidence_label='nominal'"""))
def f02(t):
    from pavesa.plans.spatial_queries import live_fires

    keep = parameters.fire_filter(sensor="VIIRS_NOAA20_SP", bbox=(-6, 37, 1, 42), min_frp=0.0, confidence="nominal", null_frp_is_zero=True)
    return live_fires(t).filter(keep).select("fire_id")


@query("f03_proximity_fire_filter", with_views("live_fire", "SELECT fire_id FROM live_fire WHERE longitude BETWEEN -6 AND 1 AND latitude BETWEEN 37 AND 42 AND frp>=0"))
def f03(t):
    from pavesa.plans.spatial_queries import live_fires

    return live_fires(t).filter(parameters.fire_filter(bbox=(-6, 37, 1, 42), min_frp=0.0, null_frp_is_zero=False)).select("fire_id")


NOW = "1998-01-15 12:00:00"


@query("f04_alert_state", with_views("alerts", f"""SELECT id, CASE WHEN onset<=timestamp '{NOW}' AND expires>=timestamp '{NOW}' THEN 'vigente' WHEN onset>timestamp '{NOW}' THEN 'proximo' ELSE 'expirado' END AS status FROM alerts"""))
def f04(t):
    return t.alerts().select("id", parameters.alert_state(F.lit(NOW).cast("timestamp")).alias("status"))


@query("f05_interval_overlap", with_views("alerts", "SELECT id FROM alerts WHERE expires>=timestamp '1997-01-01' AND onset<=timestamp '1997-03-01'"))
def f05(t):
    return t.alerts().filter(parameters.overlaps("onset", "expires", "1997-01-01", "1997-03-01")).select("id")


@query("f06_substring", with_views("alert", "SELECT id FROM alert WHERE contains(lower(event),'viento')"))
def f06(t):
    rows = t.alerts().select("id", S.live_event_title(c("event_text")).alias("event"))
    return rows.filter(parameters.mentions("event", "VIENTO")).select("id")


@query("f07_membership", with_views("road", "SELECT id_tramo FROM road WHERE clase IN ('Autopista de peaje','Autopista libre / autovía')"))
def f07(t):
    return pipeline.roads(t).filter(c("clase").isin("Autopista de peaje", "Autopista libre / autovía")).select("id_tramo")


@query("f08_bbox_filter", with_views("hotspot_obs", "SELECT source_observation_id FROM hotspot_obs WHERE longitude BETWEEN -4 AND 0 AND latitude BETWEEN 38 AND 40"))
def f08(t):
    return t.hotspot_obs().filter(parameters.in_box("longitude", "latitude", (-4, 38, 0, 40))).select("source_observation_id")


@query("f10_list_filter", with_views("alert", f"SELECT id FROM alert WHERE expires>=timestamp '{NOW}' AND level IN ('Rojo','Naranja') AND contains(event_text,'viento')"))
def f10(t):
    rows = t.alerts().withColumn("level", S.live_level(c("event_text"))).withColumn("event", S.display_event_title(c("event_text")))
    keep = (c("expires") >= F.lit(NOW).cast("timestamp")) & c("level").isin("Rojo", "Naranja") & c("event").contains("viento")
    return rows.filter(keep).select("id")


CLASS_ZOOM = ",".join(f"('{k}',{v})" for k, v in K.ROAD_CLASS_MIN_ZOOM.items())


@query("f11_zoom_classes", with_views("road", f"SELECT z.zoom, r.clase, count(*) AS n FROM road r JOIN (VALUES {CLASS_ZOOM}) k(clase,min_zoom) USING (clase) JOIN (SELECT unnest(generate_series(7,16)) AS zoom) z ON z.zoom>=k.min_zoom GROUP BY 1,2"))
def f11(t):
    min_zoom = S.lookup(K.ROAD_CLASS_MIN_ZOOM, c("clase"))
    counts = pipeline.roads(t).groupBy("clase").agg(F.count("*").alias("n")).withColumn("min_zoom", min_zoom)
    zooms = F.transform(F.sequence(c("min_zoom"), F.lit(16)), lambda z: z.cast("bigint"))
    return counts.select(F.explode(zooms).alias("zoom"), "clase", "n")


@query("f12_rank_floor", with_views("settlement", """SELECT zoom, count(*) AS n FROM settlement JOIN (SELECT unnest(generate_series(6,12)) AS zoom) ON population_rank >= CASE WHEN zoom<=8 THEN 4 WHEN zoom=9 THEN 3 WHEN zoom=10 THEN 2 ELSE 1 END OR is_capital GROUP BY 1"""))
def f12(t):
    rows = pipeline.settlements(t).select("population_rank", "is_capital", F.explode(F.sequence(F.lit(6), F.lit(12))).alias("zoom"))
    return rows.filter(parameters.rank_floor(c("zoom"))).groupBy(c("zoom").cast("bigint").alias("zoom")).agg(F.count("*").alias("n"))

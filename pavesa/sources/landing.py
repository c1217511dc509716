"""Scans of landed files: hotspot CSV, manifests, catalogues, boundaries, roads, settlements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pavesa.functions import geo
from pavesa.functions import parameters as P
from pavesa.functions import scalar as S

HOTSPOT_FIELDS = [
    "latitude", "longitude", "bright_ti4", "scan", "track", "acq_date", "acq_time", "satellite", "instrument", "confidence",
    "version", "bright_ti5", "frp", "daynight",
]


def with_row_numbers(rows: DataFrame, *file_keys: str) -> DataFrame:
    """Line number of each row in its file, from 1, without one task per file.

    ``rows`` carries ``_block`` (start of the file split) and ``_seq`` (read order). Rows are numbered
    inside their split; the lengths of the splits before it are added.
    """
    block = [*file_keys, "_block"]
    sizes = rows.groupBy(*block).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*file_keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy(*block).orderBy("_seq"))
    return (
        rows.withColumn("_i", inside).join(offsets, block).withColumn("source_row_number", F.col("_i") + F.col("_off"))
        .drop("_i", "_off", "_seq", "_block")
    )


def read_csv_by_name(spark: SparkSession, path: str, fields: list[str], required: list[str], file_keys: list[str] = [], quote: str = '"') -> DataFrame:
    """Lines of CSV files as text columns bound by each file's own header.

    Files may order, omit or add columns: an absent field is NULL, an unknown column is left out, and a file without one of
    ``required`` gives no rows. Lines are numbered in their file, from 1. One file's header is one row, so headers join by file.
    """
    keyed = T.StructType([T.StructField("value", T.StringType()), *(T.StructField(k, T.StringType()) for k in file_keys)])
    lines = spark.read.schema(keyed).text(path, recursiveFileLookup=not file_keys).select(
        "value", *file_keys, F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_seq")
    ).filter(F.trim("value") != "")
    at = F.struct("_block", "_seq")
    heads = lines.groupBy("source_file").agg(F.min_by("value", at).alias("head"), F.min(at).alias("first"))
    commas = heads.agg(F.max(F.length("head") - F.length(F.replace("head", F.lit(","), F.lit(""))))).first()[0]  # of the widest header
    columns = (commas or 0) + 1
    parts = lambda text: F.from_csv(text, F.lit(", ".join(f"c{i} string" for i in range(columns))), {"quote": quote, "escape": quote})
    cells = F.array(*(F.lower(F.trim(F.regexp_replace(F.col(f"h.c{i}"), "\ufeff", ""))) for i in range(columns)))
    places = heads.withColumn("h", parts(F.col("head"))).select("source_file", "first", cells.alias("names"))
    places = places.select("source_file", "first", *(F.array_position("names", F.lit(f)).alias(f"_{f}") for f in fields))
    usable = places.filter(P.all_of(*(F.col(f"_{f}") > 0 for f in required)))
    body = lines.join(usable, "source_file").filter((F.col("_block") != F.col("first._block")) | (F.col("_seq") != F.col("first._seq")))
    values = body.withColumn("r", parts(F.col("value"))).withColumn("r", F.array(*(F.col(f"r.c{i}") for i in range(columns))))
    named = values.select(
        *(F.when(F.col(f"_{f}") > 0, F.get("r", (F.col(f"_{f}") - 1).cast("int"))).alias(f) for f in fields), *file_keys, "source_file", "_block", "_seq"
    )
    return with_row_numbers(named, "source_file")


def read_hotspot_csv(spark: SparkSession, path: str, file_keys: list[str] = []) -> DataFrame:
    """Raw hotspot lines with their file and line number; a file without coordinates gives none."""
    return read_csv_by_name(spark, path, HOTSPOT_FIELDS, ["latitude", "longitude"], file_keys)


def parse_hotspots(raw: DataFrame) -> DataFrame:
    """Typed observations; lines without a position, day or satellite are skipped."""
    num = lambda n: S.safe_double(F.col(n)).alias(n)
    kept = raw.withColumn("latitude", S.safe_double(F.col("latitude"))).withColumn("longitude", S.safe_double(F.col("longitude")))
    kept = kept.filter(
        F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & S.blank_to_null(F.col("acq_date")).isNotNull()
        & S.blank_to_null(F.col("satellite")).isNotNull()
    )
    return kept.select(
        *[c for c in raw.columns if c not in HOTSPOT_FIELDS],
        "latitude", "longitude", num("bright_ti4"), num("scan"), num("track"), num("bright_ti5"), num("frp"),
        F.trim("acq_date").alias("acq_date"), S.hhmm(F.col("acq_time")).alias("acq_time"), F.trim("satellite").alias("satellite"),
        S.confidence_strict(F.col("confidence")).alias("confidence"), S.day_night(F.col("daynight")).alias("daynight"),
        S.blank_to_null(F.col("version")).alias("version"), S.observed_at(F.trim("acq_date"), F.col("acq_time")).alias("observed_at"),
    )


def manifests_in_scope(manifests: DataFrame, date_from: str, date_to: str, sources: list[str], regions: list[str]) -> DataFrame:
    return manifests.filter(
        (F.col("request_date_to") >= date_from) & (F.col("request_date_from") <= date_to)
        & F.col("firms_source").isin(*sources) & F.col("bbox_region").isin(*regions)
    )


def archives_in_scope(manifests: DataFrame, date_from: str, date_to: str, lookback_days: int) -> DataFrame:
    """Archives elaborated up to ``lookback_days`` before the first valid day, in UTC days."""
    lo = F.date_sub(F.lit(date_from).cast("date"), lookback_days).cast("timestamp")
    hi = F.date_add(F.lit(date_to).cast("date"), 1).cast("timestamp")
    return manifests.filter((F.col("request_elaboration_to") >= lo) & (F.col("request_elaboration_from") < hi))


CATALOG_FIELDS = ["id", "name", "nominaldate", "ingestiondate", "modificationdate", "contentlength"]


def read_catalog_variant(spark: SparkSession, path: str, version: str, fmt: str) -> DataFrame:
    raw = read_csv_by_name(spark, path, CATALOG_FIELDS, ["nominaldate"])
    day = F.left(F.coalesce("nominaldate", F.lit("")), F.lit(10))
    return raw.filter(day != "").select(
        F.lit(version).alias("dataset_version"), F.lit(fmt).alias("delivery_format"), F.col("id").alias("source_item_id"),
        F.col("name").alias("product_name"), S.product_version(F.col("name")).alias("product_version"), day.alias("nominal_date"),
        S.catalog_time(F.col("ingestiondate")).alias("catalog_ingested_at"), S.catalog_time(F.col("modificationdate")).alias("catalog_modified_at"),
        F.coalesce(F.col("contentlength").try_cast("bigint"), F.lit(0)).alias("content_length_bytes"),
    )


def catalogue_or_core(catalogue: DataFrame, core: DataFrame) -> DataFrame:
    """The file catalogue when it has rows, else the core table; decided inside the plan."""
    empty = catalogue.limit(1).agg((F.count("*") == 0).alias("e")).scalar()
    return catalogue.unionByName(core.filter(empty))


GEOMETRY = "geometry:struct<type:string, coordinates:string>"
GEOJSON = f"type string, features array<struct<type:string, properties:map<string,string>, {GEOMETRY}>>, properties map<string,string>, {GEOMETRY.replace(':struct', ' struct', 1)}"
RINGS = "array<array<array<double>>>"


def read_boundary_features(spark: SparkSession, path: str, id_property: str) -> DataFrame:
    """Features of GeoJSON files (collections or single features): part, geometry type, and polygons (NULL: not an area)."""
    files = spark.read.schema(GEOJSON).json(path, multiLine=True)
    single = F.array(F.struct(F.col("type"), F.col("properties"), F.col("geometry")))
    f = files.select(F.explode(F.when(F.col("type") == "FeatureCollection", F.col("features")).otherwise(single)).alias("f"))
    return f.select(F.col("f.properties")[id_property].alias("part"), F.col("f.geometry.type").alias("geometry_type"), _polygons("f.geometry").alias("polygons"))


def _polygons(geometry: str) -> Column:
    kind, text = F.col(f"{geometry}.type"), F.col(f"{geometry}.coordinates")
    return F.when(kind == "Polygon", F.array(F.from_json(text, RINGS))).when(kind == "MultiPolygon", F.from_json(text, f"array<{RINGS}>"))


def read_boundary_edges(spark: SparkSession, path: str, id_property: str) -> DataFrame:
    """Boundary files to an edge table: one row per ring side, of every ring of every polygon.

    ``ring_no`` counts a feature's rings from 0. Features that aren't areas have no edges; ``read_boundary_features`` shows them.
    """
    rings = read_boundary_features(spark, path, id_property).select("part", F.posexplode(F.flatten("polygons")).alias("ring_no", "ring"))
    n = F.size("ring") - 1
    sides = F.zip_with(
        F.slice("ring", F.lit(1), n), F.slice("ring", F.lit(2), n),
        lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")),
    )
    return rings.select("part", "ring_no", F.explode(sides).alias("e")).select("part", "ring_no", "e.*")


#: Fields of a landed road feature besides its file and territory; text unless named in ROAD_NUMBERS.
ROAD_FIELDS = (
    "id_tramo id_vial tipo_tramo tipo_tramd calzada calzadad acceso accesod firme firmed ncarriles sentido sentidod situacion situaciond estadofis estadofisd "
    "tipovehic tipovehicd titular titulard orden ordend fuente_t fuente_td codigo dgc_via clase clased tipo_vial tipo_viald nombre nombre_alt fuente_v fuente_vd alta_db"
).split()
ROAD_NUMBERS = "id_tramo id_vial tipo_tramo calzada acceso firme sentido situacion estadofis tipovehic titular orden fuente_t dgc_via clase tipo_vial fuente_v".split()


def read_road_landing(spark: SparkSession, path: str) -> DataFrame:
    """Road features landed per territory file, in a fixed projection: empty texts and absent fields are NULL, features without a line are left out."""
    zip_name = F.col("source_zip_name")
    rows = spark.read.parquet(path).filter("line IS NOT NULL")
    given = {"clase": "clase_raw"} if "clase_raw" in rows.columns else {}
    kind = lambda n: "bigint" if n in ROAD_NUMBERS else "string"

    def field(name: str) -> Column:
        source = given.get(name, name)
        value = F.col(source).cast(kind(name)) if source in rows.columns else F.lit(None).cast(kind(name))
        return (value if name in ROAD_NUMBERS else F.nullif(value, F.lit(""))).alias(name)

    return rows.select(
        "source_fid", "source_zip_name", S.territory_code(zip_name).alias("territory_code"), S.territory_name(S.territory_code(zip_name)).alias("territory_name"),
        *(field(n) for n in ROAD_FIELDS), "line",
    )


#: Fields of a landed settlement feature besides its shape, with their types.
SETTLEMENT_FIELDS = {
    "source_objectid": "bigint", "nombre": "string", "etiqueta": "string", "tipo_0502": "string", "ine_0502": "string", "fecha_ine": "double", "habit_0502": "double",
    "codigo_ep": "string", "id_ep": "bigint", "id_bic": "string", "id_bicca": "string", "id_ng": "bigint", "prioridad": "int", "f_alta": "string", "capit_0502": "string",
}


def read_settlement_landing(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """Settlement features landed as Parquet, in a fixed projection: empty texts, unreadable numbers and absent fields are NULL.

    A limit above 0 takes that many features, as a load on trial does.
    """
    rows = spark.read.parquet(path)

    def field(name: str, kind: str) -> Column:
        value = F.nullif(F.col(name).cast("string"), F.lit("")) if name in rows.columns else F.lit(None)
        return (value.cast("string") if kind == "string" else value.try_cast(kind)).alias(name)

    found = geo.with_shape(rows).select(*(field(n, k) for n, k in SETTLEMENT_FIELDS.items()), "shape")
    return found.limit(limit) if limit > 0 else found


#: Fields kept of a settlement on an answer page: type, and the value where a feature lacks the field.
PAGE_FIELDS = {
    "nombre": ("string", ""), "habitantes": ("bigint", 0), "codine": ("string", ""), "cpro": ("bigint", 0), "capital": ("string", ""), "tipo": ("string", ""),
    "latitud": ("double", 0.0), "longitud": ("double", 0.0),
}


def read_settlement_pages(spark: SparkSession, path: str, min_people: int = 500) -> DataFrame:
    """Answer pages (``{"features": [...]}``, a page per file or line): populous settlements with a geometry, as nine fields.

    A feature without the number of people counts as 0; a field given as null stays NULL, an absent one gets its default.
    """
    pages = spark.read.schema(f"features array<struct<properties:map<string,string>, {GEOMETRY}>>").json(path)
    f = pages.select(F.explode("features").alias("f")).filter("f.geometry IS NOT NULL")
    given = F.col("f.properties")
    people = F.coalesce(given["habitantes"].try_cast("bigint"), F.lit(0))

    def field(name: str, kind: str, default) -> Column:
        return F.when(F.map_contains_key(given, F.lit(name)), given[name].try_cast(kind)).otherwise(F.lit(default).cast(kind)).alias(name)

    kept = f.filter(people >= min_people)
    return kept.select(_polygons("f.geometry").alias("polygons"), *(field(n, k, v) for n, (k, v) in PAGE_FIELDS.items()))


def read_day_manifests(spark: SparkSession, path: str, schema: str, date_from: str, date_to: str) -> DataFrame:
    """One JSON manifest per day; the day in the file path decides."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)
    day = F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}-\d{2}-\d{2})", 1)
    return rows.withColumn("file_day", day).filter(F.col("file_day").between(date_from, date_to))


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """Glossary files (a map of term to record), a row per term in file order: position, key, name, long_name, unit, description, context.

    The context is the field whose name begins so.
    """
    entries = spark.read.text(path, wholetext=True).select(F.map_entries(F.from_json("value", "map<string,map<string,string>>")).alias("m"))
    rows = entries.select(F.posexplode("m").alias("position", "e")).select("position", "e.key", F.col("e.value").alias("v"))
    context = F.get(F.map_values(F.map_filter("v", lambda k, _: F.startswith(k, F.lit("context")))), F.lit(0))
    return rows.select("position", "key", *(F.col("v")[n].alias(n) for n in ("name", "long_name", "unit", "description")), context.alias("context"))


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """Place files (kind to name to box), a row per place."""
    nested = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,array<double>>>")).alias("kind", "inner"))
    return nested.select("kind", F.explode("inner").alias("name", "box"))


def date_blocks(ranges: DataFrame, days: int) -> DataFrame:
    """Split each ``first_day``..``last_day`` into blocks of ``days``; the last one is cut short."""
    starts = F.sequence("first_day", "last_day", F.expr(f"INTERVAL {days} DAY"))
    return ranges.withColumn("block_from", F.explode(starts)).withColumn(
        "block_to", F.least(F.date_add("block_from", days - 1), F.col("last_day"))
    )


def scan(rows: DataFrame, *conditions: Column | None) -> DataFrame:
    """A table scan with only the predicates that were asked for."""
    return rows.filter(P.all_of(*conditions))

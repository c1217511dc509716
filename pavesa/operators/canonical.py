"""One canonical row per natural key, for each data family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pavesa.functions import geo
from pavesa.functions import scalar as S

#: Words of 64 marks each for the rows that may be first.
MARK_WORDS = 1 << 20
HOTSPOT_KEY = ["dataset_type", "firms_source", "satellite", "latitude", "longitude", "acq_date", "acq_time"]


def canonical_hotspots(obs: DataFrame) -> DataFrame:
    """In-region observations merged by place, time and satellite; attributes take their maximum."""
    return (
        obs.filter("in_region")
        .groupBy(*HOTSPOT_KEY)
        .agg(
            *[F.max(c).alias(c) for c in ("instrument", "confidence", "daynight", "version", "scan", "track", "bright_ti4", "bright_ti5", "frp", "observed_at")],
            F.array_sort(F.collect_set("bbox_region")).alias("bbox_regions"),
            F.countDistinct("source_download_id").alias("source_download_count"),
            F.count("*").alias("source_observation_count"),
            F.min("source_observation_id").alias("hotspot_id"),
        )
    )


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column], count_as: str | None = None) -> DataFrame:
    """The first row of each key under ``order``, optionally with the number of rows of the key.

    Without the count Spark keeps only the first row per key and task before the shuffle.
    """
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("_rank", F.row_number().over(w.orderBy(*order)))
    if count_as:
        ranked = ranked.withColumn(count_as, F.count("*").over(w))
    return ranked.filter("_rank = 1").drop("_rank")


def may_be_first(rows: DataFrame, keys: list[str], order: list[Column], by: list[str]) -> DataFrame:
    """All rows that ``first_per_key`` could take, and few others, for rows that are wide beside the columns ``by`` of their order.

    The first rows are found on ``keys`` and ``by`` alone. Each sets three bits of one of MARK_WORDS long words, by a hash of these columns, and a
    row whose bits aren't all set can't be one of them. So wide rows are neither sorted nor shuffled to lose. The words are of a fixed size at every
    input size; where the keys are very many, more rows pass, and never fewer than needed.
    """
    firsts = first_per_key(rows.select(*keys, *by), keys, order)
    h = F.xxhash64(*keys, *by)
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int"))
    mask = bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12))
    word = F.pmod(F.shiftrightunsigned(h, 18), F.lit(MARK_WORDS))
    words = firsts.groupBy(word.alias("_word")).agg(F.bit_or(mask).alias("_bits"))
    marked = (word == F.col("_word")) & (F.col("_bits").bitwiseAND(mask) == mask)
    return rows.join(F.broadcast(words), marked, "left_semi")


def best_per_key(rows: DataFrame, keys: list[str], rank: Column, count_as: str | None = None) -> DataFrame:
    """Same result as ``first_per_key`` through an aggregate.

    ``rank`` is a struct, smallest wins. Partial aggregation runs before the shuffle, so a key that
    holds a third of all rows still sends one row per task.
    """
    payload = F.struct(*[F.col(c) for c in rows.columns if c not in keys])
    aggs = [F.min_by(payload, rank).alias("_row")]
    if count_as:
        aggs.append(F.count("*").alias(count_as))
    picked = rows.groupBy(*keys).agg(*aggs)
    extra = [count_as] if count_as else []
    return picked.select(*keys, "_row.*", *extra)


def descending(value: Column) -> Column:
    """A sortable stand-in for 'latest first' inside a rank struct."""
    return -F.unix_micros(value)


def canonical_warnings(records: DataFrame, downloads: DataFrame | None, keys: DataFrame | None = None) -> DataFrame:
    """Newest elaboration wins, then the highest record id. ``keys`` restricts the rebuild. Records that carry their archive's data need no ``downloads``."""
    rows = records.filter("phenomenon_code = 'AT' AND language = 'es-ES' AND area_code IS NOT NULL")
    if keys is not None:
        rows = rows.join(keys, ["cap_identifier", "language", "area_code"], "left_semi")
    if downloads is None:
        rows = rows.filter("source_download_id IS NOT NULL")
    else:
        rows = rows.join(downloads.select("source_download_id", "source_file_path", "request_elaboration_to"), "source_download_id")
    rank = F.struct(descending(F.col("request_elaboration_to")), -F.col("source_record_id"))
    return (
        best_per_key(rows, ["cap_identifier", "language", "area_code"], rank, "duplicate_source_count")
        .withColumnRenamed("source_record_id", "warning_id")
        .withColumn("level_rank", S.level_rank(F.col("level_label")))
        .withColumn("is_warning", S.is_warning(F.col("level_label")))
    )


def explode_days(warnings: DataFrame) -> DataFrame:
    return warnings.withColumn("valid_date", F.explode(S.valid_days(F.col("onset_at"), F.col("expires_at"))))


def daily_features(expanded: DataFrame) -> DataFrame:
    """One warning per local day, area and phenomenon: highest level, then latest sent."""
    rank = F.struct(
        -F.col("level_rank"),
        F.col("sent_at").isNull(),
        descending(F.col("sent_at")),
        descending(F.col("onset_at")),
        -F.col("warning_id"),
    )
    best = best_per_key(expanded, ["valid_date", "area_code", "phenomenon_code"], rank, "source_version_count")
    return best.withColumn(
        "feature_id",
        F.concat_ws(":", F.date_format("valid_date", "yyyy-MM-dd"), "area_code", "phenomenon_code"),
    ).withColumn("level_color", S.level_color(F.col("level_label")))


def settlements(src: DataFrame) -> DataFrame:
    """Clean settlement attributes; only populated places stay."""
    people = S.population(F.col("habit_0502"))
    src = geo.with_shape(src)
    src = src.withColumn("shape", geo.oriented(F.col("shape")))
    return (
        src.withColumn("habitantes", people)
        .filter("habitantes > 0")
        .select(
            F.col("source_fid").alias("settlement_id"),
            S.settlement_name(F.col("nombre"), F.col("source_objectid")).alias("nombre"),
            S.blank_to_null(F.col("etiqueta")).alias("etiqueta"),
            "habitantes",
            S.population_class(F.col("habitantes")).alias("population_class"),
            S.population_rank(F.col("habitantes")).alias("population_rank"),
            S.blank_to_null(F.col("tipo_0502")).alias("tipo_code"),
            S.type_label(S.blank_to_null(F.col("tipo_0502"))).alias("tipo_label"),
            S.capital_code(F.col("capit_0502")).alias("capital_code"),
            (S.capital_code(F.col("capit_0502")) != "0000").alias("is_capital"),
            "shape",
            geo.shape_bbox(F.col("shape")).alias("bbox"),
        )
    )


#: Coded road attributes: name in the core table -> landed (label, code).
ROAD_CODES = {
    "tipo": ("tipo_viald", "tipo_vial"), "titular": ("titulard", "titular"), "sentido": ("sentidod", "sentido"), "acceso": ("accesod", "acceso"),
    "estado_fisico": ("estadofisd", "estadofis"), "firme": ("firmed", "firme"), "orden": ("ordend", "orden"), "tipovehic": ("tipovehicd", "tipovehic"),
}
ROAD_TEXTS = ["nombre_alt", "codigo"]


def roads(src: DataFrame, few: bool = False) -> DataFrame:
    """One road segment per id: best class, newest import, lowest feature id.

    The winner is picked on the raw columns; only winners pay for the text cleaning. Attributes that the landing lacks are NULL. Rows that can't
    win are left out before the whole rows are shuffled, which a second look at the source pays for; not where the rows are ``few``.
    """
    landed = [*ROAD_TEXTS, *(c for pair in ROAD_CODES.values() for c in pair)]
    src = src.withColumns({c: F.lit(None).cast("string" if c in ROAD_TEXTS or c.endswith("d") else "int") for c in landed if c not in src.columns})
    raw = src.filter("line IS NOT NULL AND id_tramo IS NOT NULL AND size(line) >= 2").withColumn("clase_code", S.no_sentinel(F.col("clase_raw")))
    order = [
        F.col("clase_code").asc_nulls_last(), F.col("imported_at").desc_nulls_last(), F.col("source_fid").asc(),
    ]
    whole = raw.select("id_tramo", "id_vial", "source_fid", "clased", "clase_code", "nombre", "ncarriles", "source_zip_name", "imported_at", "line", *landed)
    hopeful = whole if few else may_be_first(whole, ["id_tramo"], order, ["clase_code", "imported_at", "source_fid"])
    picked = first_per_key(hopeful, ["id_tramo"], order)
    return picked.select(
        "id_tramo",
        S.road_public_id(F.col("id_tramo")).alias("inspire_id"),
        "id_vial",
        "source_fid",
        S.blank_to_null(F.col("clased")).alias("clase"),
        "clase_code",
        S.blank_to_null(F.col("nombre")).alias("nombre"),
        *(S.blank_to_null(F.col(c)).alias(c) for c in ROAD_TEXTS),
        *(S.blank_to_null(F.col(label)).alias(name) for name, (label, _) in ROAD_CODES.items()),
        *(S.no_sentinel(F.col(code)).alias(f"{name}_code") for name, (_, code) in ROAD_CODES.items()),
        S.lane_count(F.col("ncarriles")).alias("n_carriles"),
        S.territory_code(F.col("source_zip_name")).alias("territory_code"),
        "imported_at",
        "line",
    )


def daily_files(items: DataFrame) -> DataFrame:
    """One catalogue entry per variant and day: newest of the three timestamps, then the highest id."""
    newest = F.coalesce("catalog_modified_at", "catalog_ingested_at", "imported_at")
    rank = F.struct(descending(newest), -F.col("source_catalog_id"))
    return best_per_key(items, ["dataset_version", "delivery_format", "nominal_date"], rank)


def dedupe_first_seen(fires: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Live de-duplication: the earliest row of each key stays."""
    return best_per_key(fires, keys, F.col(order))

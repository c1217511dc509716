"""Parsing, normalising and classifying columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pavesa import constants as K


def lookup(mapping: dict, key: Column) -> Column:
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def dec_round(value: Column, digits: int) -> Column:
    """Half-up rounding through a decimal, as SQL numeric does."""
    return F.round(value.cast("decimal(28,8)"), digits).cast("double")


def safe_double(text: Column) -> Column:
    return F.when(~F.lower(text).rlike(r"[0-9.][df]\s*$"), text.try_cast("double"))


def confidence_strict(value: Column) -> Column:
    return lookup(K.CONFIDENCE_ALIASES, F.lower(F.trim(value)))


def confidence_lenient(value: Column) -> Column:
    raw = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.coalesce(lookup(K.CONFIDENCE_ALIASES, raw), raw)


def confidence_label(code: Column) -> Column:
    return F.coalesce(lookup(K.CONFIDENCE_LABELS, code), blank_to_null(code), F.lit("no indicada"))


def day_night(value: Column) -> Column:
    raw = F.upper(F.trim(value))
    return F.when(raw.isin("D", "N"), raw)


def hhmm(value: Column) -> Column:
    raw = F.trim(F.coalesce(value, F.lit("")))
    return F.when(F.length(raw) < 4, F.lpad(raw, 4, "0")).otherwise(raw)


def observed_at(date_text: Column, time_text: Column) -> Column:
    t = hhmm(time_text)
    return F.try_to_timestamp(
        F.concat(date_text, F.lit(" "), F.substring(t, 1, 2), F.lit(":"), F.substring(t, 3, 2)),
        F.lit("yyyy-MM-dd HH:mm"),
    )


def live_observed_text(date_text: Column, time_text: Column) -> Column:
    t = hhmm(time_text)
    clock = F.when(
        t.rlike("^[0-9]{4}$"), F.concat(F.substring(t, 1, 2), F.lit(":"), F.substring(t, 3, 2))
    ).otherwise("00:00")
    return F.when(
        F.coalesce(date_text, F.lit("")) == "", F.lit("")
    ).otherwise(F.concat(date_text, F.lit("T"), clock, F.lit(":00Z")))


def instrument(value: Column, source: Column) -> Column:
    return F.coalesce(
        blank_to_null(value),
        F.when(source.startswith("VIIRS_"), "VIIRS").when(source.startswith("MODIS_"), "MODIS"),
    )


def row_hash(*names: str) -> Column:
    """Stable hash: the JSON of the fields in name order."""
    return F.sha2(F.to_json(F.struct(*[F.col(n) for n in sorted(names)]), {"ignoreNullFields": "false"}), 256)


def feature_id(source, lat, lon, date_text, time_text, satellite) -> Column:
    return F.format_string("%s_%.6f_%.6f_%s_%s_%s", source, lat, lon, date_text, time_text, satellite)


def coded_parts(value: Column) -> tuple[Column, Column, Column]:
    parts = F.transform(F.split(value, ";"), lambda p: F.trim(p))
    has = F.coalesce(value, F.lit("")) != ""
    code = F.when(has, F.nullif(parts[0], F.lit("")))
    label = F.when(has, F.nullif(F.get(parts, F.lit(1)), F.lit("")))
    payload = F.when(
        has & (F.size(parts) >= 3), F.trim(F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), ";"))
    )
    return code, label, payload


def coded_value(pairs: Column, name: str) -> Column:
    return F.get(F.filter(pairs, lambda p: F.trim(p.valueName) == name), F.lit(0)).value


def _first_word(text: Column, words: list[str]) -> Column:
    lower = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda acc, w: acc.when(lower.contains(w), w), words[1:], F.when(lower.contains(words[0]), words[0]))


def level_code(value: Column, event: Column) -> Column:
    raw = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    found = F.when(raw.isin(*K.LEVEL_WORDS_IMPORT), raw).otherwise(
        F.coalesce(_first_word(event, K.LEVEL_WORDS_IMPORT), raw)
    )
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("verde"))


def level_label(value: Column, event: Column) -> Column:
    return F.coalesce(lookup(K.LEVEL_LABELS, level_code(value, event)), F.lit("Verde"))


def live_level(event: Column) -> Column:
    return F.coalesce(lookup(K.LEVEL_LABELS, _first_word(event, K.LEVEL_WORDS_LIVE)), F.lit("Verde"))


def level_rank(label: Column) -> Column:
    return F.coalesce(lookup(K.LEVEL_RANKS, label), F.lit(0))


def level_color(label: Column) -> Column:
    return F.coalesce(lookup(K.LEVEL_COLORS, label), F.lit(K.LEVEL_COLOR_DEFAULT))


def is_warning(label: Column) -> Column:
    return F.coalesce(label.isin("Amarillo", "Naranja", "Rojo"), F.lit(False))


def temperature_c(parameter: Column, description: Column) -> Column:
    hay = F.concat_ws(" ", F.nullif(parameter, F.lit("")), F.nullif(description, F.lit("")))
    hit = F.regexp_extract(hay, K.TEMPERATURE_PATTERN, 1)
    return F.translate(hit, ",", ".").try_cast("double")


def polygon_ring(text: Column) -> Column:
    """'lat,lon lat,lon ...' to a closed ring of (lon, lat); NULL when under three good pairs."""
    pairs = F.transform(
        F.split(F.trim(text), r"\s+"),
        lambda p: F.struct(
            F.get(F.split(p, ",", 2), F.lit(1)).try_cast("double").alias("x"),
            F.get(F.split(p, ",", 2), F.lit(0)).try_cast("double").alias("y"),
        ),
    )
    good = F.filter(pairs, lambda p: p.y.between(-90, 90) & p.x.between(-180, 180))
    n = F.size(good)
    closed = F.when(
        (F.get(good, F.lit(0)).x == F.get(good, n - 1).x) & (F.get(good, F.lit(0)).y == F.get(good, n - 1).y), good
    ).otherwise(F.concat(good, F.slice(good, 1, 1)))
    return F.when((n >= 3) & (F.size(closed) >= 4), closed)


def live_event_title(event: Column) -> Column:
    """Text before 'nivel <word>', with the stray separator letters removed at both ends."""
    lower = F.lower(event)
    cut = F.lit(None).cast("string")
    for word in reversed(K.LEVEL_WORDS_LIVE):
        at = F.locate(f"nivel {word}", lower)
        cut = F.when(
            at > 0,
            F.regexp_replace(F.substring(event, F.lit(1), at - 1), r"^[ ,;\-de]+|[ ,;\-de]+$", ""),
        ).otherwise(cut)
    return F.when(F.coalesce(event, F.lit("")) == "", "Desconocido").otherwise(F.coalesce(cut, F.trim(event)))


def display_event_title(event: Column) -> Column:
    stripped = F.regexp_replace(event, r"(?i)\s*(amarillo|naranja|rojo|verde|nivel\s*\d)", "")
    return F.when(F.coalesce(event, F.lit("")) == "", "Desconocido").otherwise(
        F.trim(F.regexp_replace(stripped, r"\s+", " "))
    )


def flood_related(event: Column) -> Column:
    return F.lower(F.coalesce(event, F.lit(""))).rlike("|".join(K.FLOOD_WORDS))


def frp_class(frp: Column) -> Column:
    v = F.coalesce(frp, F.lit(0.0))
    return F.when(v > 200, "Muy alto").when(v >= 50, "Alto").when(v >= 10, "Medio").otherwise("Bajo")


def frp_color(frp: Column) -> Column:
    v = F.coalesce(frp, F.lit(0.0))
    return F.when(v > 200, "#8E1B1B").when(v >= 50, "#E94F37").when(v >= 10, "#F8961E").otherwise("#FFD166")


def frp_group(frp: Column) -> Column:
    v = F.coalesce(frp, F.lit(0.0))
    return F.when(v >= 200, 0).when(v >= 50, 1).when(v >= 10, 2).otherwise(3)


def frp_radius(frp: Column) -> Column:
    v = F.coalesce(frp, F.lit(0.0))
    return F.when(v > 200, 11).when(v >= 50, 9).when(v >= 10, 7).otherwise(5)


def population(value: Column) -> Column:
    return F.when(value >= 0, F.rint(value).cast("int"))


def population_rank(people: Column) -> Column:
    """One to five; NULL falls in the last class, as an ELSE branch does."""
    bounds = F.array(*[F.lit(b) for b in K.POPULATION_BOUNDS])
    return F.when(people.isNull(), 5).otherwise(F.size(F.filter(bounds, lambda b: b <= people)) + 1)


def population_class(people: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in K.POPULATION_CLASSES]), population_rank(people) - 1)


def settlement_name(name: Column, object_id: Column) -> Column:
    return F.coalesce(blank_to_null(name), F.format_string("Nucleo %s", object_id.cast("string")))


def capital_code(value: Column) -> Column:
    return F.coalesce(blank_to_null(value), F.lit("0000"))


def type_label(code: Column) -> Column:
    return F.coalesce(F.concat(F.lit("Tipo "), code), F.lit("Sin tipo"))


def no_sentinel(code: Column) -> Column:
    return F.when(~code.isin(*K.ROAD_SENTINELS), code.cast("int"))


def lane_count(text: Column) -> Column:
    t = F.trim(text)
    return no_sentinel(F.when(t.rlike(r"^-?\d+$"), t.try_cast("int")))


def road_public_id(road_id: Column) -> Column:
    return F.concat(F.lit("VIAL_TR"), road_id.cast("string"))


def road_id_from_public(text: Column) -> Column:
    return F.when(text.startswith("VIAL_TR"), F.substring(text, 8, 40).try_cast("bigint"))


def product_version(name: Column) -> Column:
    return F.coalesce(F.get(F.filter(F.split(name, "_"), lambda p: p.startswith("V")), F.lit(0)), F.lit(""))


def catalog_time(text: Column) -> Column:
    fixed = F.replace(F.replace(text, F.lit('""'), F.lit('"')), F.lit('"T"'), F.lit("T"))
    return F.try_to_timestamp(F.nullif(F.btrim(fixed, F.lit('"')), F.lit("")))


def fold_name(text: Column) -> Column:
    return F.translate(F.lower(F.trim(text)), K.ACCENTED, K.PLAIN)


def fold_term(text: Column) -> Column:
    return F.replace(F.upper(F.trim(text)), F.lit(" "), F.lit(""))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def landcover_dataset(feature: Column) -> Column:
    return (
        F.when(feature.startswith("corine2018."), "CORINE 2018")
        .when(feature.startswith("siose2014."), "SIOSE 2014")
        .when(feature.startswith("sioseAR2017."), "SIOSE AR 2017")
        .otherwise("IGN WMS")
    )


def clean_surface(text: Column) -> Column:
    v = text.try_cast("double")
    return F.when(~F.isnan(v) & (v >= 0) & (v < float("inf")), dec_round(v, 2))


def scrub(text: Column, patterns: list[str], mark: str) -> Column:
    return reduce(lambda acc, p: F.regexp_replace(acc, p, mark.replace("$", r"\$")), patterns, text)


def redact(text: Column) -> Column:
    return scrub(text, K.REDACT_PATTERNS, K.REDACT_MARK)


def sanitize(text: Column, max_length: int | None = None) -> Column:
    cleaned = scrub(F.coalesce(text, F.lit("")), K.SANITIZE_PATTERNS, K.SANITIZE_MARK)
    return cleaned if max_length is None else F.substring(cleaned, 1, max_length)


def danger_class(value: Column, index: str) -> Column:
    bounds = K.FWI_BOUNDS if index == "FWI" else K.DC_BOUNDS
    rank = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= value))
    return F.when(value.isNotNull(), F.get(F.array(*[F.lit(n) for n in K.DANGER_NAMES]), rank))


def territory_code(file_name: Column) -> Column:
    stem = F.regexp_replace(file_name, r"(?i)\.zip$", "")
    return F.regexp_replace(F.regexp_replace(stem, "^RT_", ""), "_gpkg$", "")


def territory_name(code: Column) -> Column:
    return F.initcap(F.replace(code, F.lit("_"), F.lit(" ")))


def merge_json(left: Column, right: Column) -> Column:
    """Right-hand keys win, over flat text maps."""
    keep = F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k))
    return F.map_concat(keep, right)


def local_day(ts: Column, zone: str = K.LOCAL_ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def valid_days(onset: Column, expires: Column) -> Column:
    """Local calendar days a warning covers; its last second counts, the onset day always does."""
    first = local_day(onset)
    last = local_day(expires - F.expr("INTERVAL 1 SECOND"))
    return F.sequence(first, F.greatest(first, last))

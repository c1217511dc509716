"""Daily series, coverage, totals and running values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pavesa import constants as K


def calendar(bounds: DataFrame) -> DataFrame:
    """Every day between ``first_day`` and ``last_day`` of a one-row frame."""
    return bounds.select(F.explode(F.sequence("first_day", "last_day")).alias("nominal_date"))


def hotspot_day_stats(hotspots: DataFrame) -> DataFrame:
    return (
        hotspots.filter(F.col("confidence").isin(*K.PUBLISHED_CONFIDENCE))
        .groupBy(F.col("acq_date").alias("nominal_date"))
        .agg(
            F.count("*").alias("hotspot_count"),
            F.count_if(F.col("confidence") == "h").alias("high_confidence_count"),
            F.count_if(F.col("confidence") == "n").alias("nominal_confidence_count"),
            F.lit(0).cast("bigint").alias("low_confidence_count"),
            F.count_if(F.col("daynight") == "D").alias("day_count"),
            F.count_if(F.col("daynight") == "N").alias("night_count"),
            F.sum(F.coalesce("frp", F.lit(0.0))).alias("frp_sum_mw"),
            F.max("frp").alias("frp_max_mw"),
            F.size(F.collect_set("firms_source")).cast("bigint").alias("source_count"),
        )
    )


def hotspot_coverage(downloads: DataFrame) -> DataFrame:
    """Distinct source-region units that cover each day."""
    days = downloads.withColumn("nominal_date", F.explode(F.sequence("request_date_from", "request_date_to")))
    return days.groupBy("nominal_date").agg(
        F.size(F.collect_set(F.concat_ws("|", "firms_source", "bbox_region"))).cast("bigint").alias("coverage_unit_count"),
        F.array_sort(F.collect_set("firms_source")).alias("source_list"),
        F.array_sort(F.collect_set("bbox_region")).alias("bbox_region_list"),
    )


def hotspot_daily_series(days: DataFrame, coverage: DataFrame, stats: DataFrame) -> DataFrame:
    """Every calendar day is present; days without data carry zeros and their coverage."""
    zero = F.lit(0).cast("bigint")
    counts = [
        "hotspot_count", "high_confidence_count", "nominal_confidence_count", "low_confidence_count",
        "day_count", "night_count", "source_count",
    ]
    units = F.coalesce("coverage_unit_count", zero)
    joined = days.join(coverage, "nominal_date", "left").join(stats, "nominal_date", "left")
    return joined.select(
        "nominal_date",
        F.lit("country").alias("stat_scope"),
        F.lit("ES").alias("area_code"),
        F.lit(K.HOTSPOT_EXPECTED_UNITS).alias("coverage_expected_unit_count"),
        units.alias("coverage_unit_count"),
        (units == K.HOTSPOT_EXPECTED_UNITS).alias("coverage_complete"),
        *[F.coalesce(c, zero).alias(c) for c in counts],
        F.coalesce("frp_sum_mw", F.lit(0.0)).alias("frp_sum_mw"),
        "frp_max_mw",
        F.coalesce("source_list", F.array().cast("array<string>")).alias("source_list"),
        F.coalesce("bbox_region_list", F.array().cast("array<string>")).alias("bbox_region_list"),
    )


def warning_day_stats(features: DataFrame) -> DataFrame:
    level = F.col("level_label")
    return features.groupBy(F.col("valid_date").alias("nominal_date")).agg(
        F.count("*").alias("feature_count"),
        F.count_if("is_warning").alias("warning_count"),
        F.count_if(level == "Verde").alias("green_count"),
        F.count_if(level == "Amarillo").alias("yellow_count"),
        F.count_if(level == "Naranja").alias("orange_count"),
        F.count_if(level == "Rojo").alias("red_count"),
        F.max(F.when(F.col("is_warning"), F.col("temperature_max_c"))).alias("max_temperature_c"),
        F.countDistinct(F.when(F.col("is_warning"), F.col("area_code"))).alias("warned_area_count"),
        F.sum("source_version_count").alias("source_feature_count"),
    )


def warning_coverage(downloads: DataFrame) -> DataFrame:
    """Archives whose elaboration window touches each UTC day."""
    days = downloads.withColumn(
        "nominal_date",
        F.explode(F.sequence(F.to_date("request_elaboration_from"), F.to_date("request_elaboration_to"))),
    )
    return days.groupBy("nominal_date").agg(F.countDistinct("source_download_id").alias("source_file_count"))


def warning_daily_series(days: DataFrame, coverage: DataFrame, stats: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    counts = [
        "feature_count", "warning_count", "green_count", "yellow_count", "orange_count", "red_count",
        "warned_area_count", "source_feature_count",
    ]
    files = F.coalesce("source_file_count", zero)
    joined = days.join(coverage, "nominal_date", "left").join(stats, "nominal_date", "left")
    return joined.select(
        "nominal_date",
        F.lit(1).alias("coverage_expected_unit_count"),
        F.when(files > 0, 1).otherwise(0).alias("coverage_unit_count"),
        (files > 0).alias("coverage_complete"),
        *[F.coalesce(c, zero).alias(c) for c in counts],
        "max_temperature_c",
    )


def running_totals(days: DataFrame, variant: list[str]) -> DataFrame:
    """Cumulative area, pixels and tile days per variant; NULL until the first value.

    A window over one row per day and variant: its size follows the calendar, not the data.
    """
    w = Window.partitionBy(*variant).orderBy("nominal_date").rowsBetween(Window.unboundedPreceding, 0)
    tiles = F.sum(F.col("has_local_tiles").cast("int")).over(w)
    return (
        days.withColumn("cumulative_burned_area_ha", F.sum("burned_area_ha").over(w))
        .withColumn("cumulative_burned_pixel_count", F.sum("burned_pixel_count").over(w))
        .withColumn("cumulative_tile_date_count", tiles)
        .withColumn("has_cumulative_tiles", tiles > 0)
    )


def join_one_row(rows: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate through scalar subqueries."""
    packed = one_row.select(F.struct(*one_row.columns).alias("_one"))
    return rows.withColumn("_one", packed.scalar()).select("*", "_one.*").drop("_one")


def top_with_total(rows: DataFrame, order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows with the exact number of matches and a truncation flag."""
    total = rows.agg(F.count("*").alias("total_matched"))
    return join_one_row(rows.orderBy(*order).limit(limit), total).withColumn(
        "truncated", F.col("total_matched") > limit
    )


def top_with_probe(rows: DataFrame, order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows and a flag found by fetching one row more.

    ``total_matched`` is exact only when nothing was cut. The window sees at most limit + 1 rows.
    """
    probe = rows.orderBy(*order).limit(limit + 1)
    w = Window.orderBy(*order)
    return (
        probe.withColumn("_n", F.row_number().over(w))
        .withColumn("total_matched", F.count("*").over(Window.partitionBy(F.lit(1))))
        .filter(F.col("_n") <= limit)
        .withColumn("truncated", F.col("total_matched") > limit)
        .drop("_n")
    )

"""The refined tables, from raw domain rows to serving rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pavesa.functions import scalar as S
from pavesa.operators import canonical, regions, series, spatial
from pavesa.session import cut_lineage
from pavesa.sources.bridge import Tables


def hotspots_flagged(t: Tables) -> DataFrame:
    return regions.flag_in_region(t.hotspot_obs(), t.region_edges())


def hotspots(t: Tables) -> DataFrame:
    return canonical.canonical_hotspots(hotspots_flagged(t))


def settlements(t: Tables) -> DataFrame:
    return canonical.settlements(t.settlement_src())


def warnings(t: Tables) -> DataFrame:
    return canonical.canonical_warnings(t.warning_src(), t.warning_download())


def features(t: Tables) -> DataFrame:
    return canonical.daily_features(canonical.explode_days(warnings(t)))


def features_of_day(t: Tables, day: str) -> DataFrame:
    """The features of one local day; only the warnings that cover it are expanded."""
    date = F.lit(day).cast("date")
    there = warnings(t).filter(F.array_contains(S.valid_days(F.col("onset_at"), F.col("expires_at")), date))
    return canonical.daily_features(canonical.explode_days(there).filter(F.col("valid_date") == date))


def roads(t: Tables) -> DataFrame:
    return canonical.roads(t.road_src())


def roads_around(t: Tables, box: tuple[float, float, float, float]) -> DataFrame:
    """The refined roads of all ids that have a landed line in the box; others can't have one there.

    Which line stands for an id is picked among all of its rows, wherever they are. The ids are stored first, so that Spark knows their size
    when it chooses the join.
    """
    landed = t.road_src()
    ids = cut_lineage(landed.filter(spatial.in_box(landed, "line", box)).select("id_tramo").distinct(), "road-ids")
    return canonical.roads(landed.join(ids, "id_tramo", "left_semi"), few=True)


def hotspot_calendar(t: Tables) -> DataFrame:
    bounds = t.raw("events").agg(
        F.date_sub(F.to_date(F.min("ts")), 2).alias("first_day"), F.date_add(F.to_date(F.max("ts")), 2).alias("last_day")
    )
    return series.calendar(bounds)


def warning_calendar(t: Tables) -> DataFrame:
    bounds = t.raw("orders").agg(
        F.date_sub(F.to_date(F.min("o_orderdate")), 2).alias("first_day"),
        F.date_add(F.to_date(F.max("o_orderdate")), 5).alias("last_day"),
    )
    return series.calendar(bounds)


def hotspot_series(t: Tables) -> DataFrame:
    return series.hotspot_daily_series(
        hotspot_calendar(t), series.hotspot_coverage(t.hotspot_download()), series.hotspot_day_stats(hotspots(t))
    )


def warning_series(t: Tables) -> DataFrame:
    return series.warning_daily_series(
        warning_calendar(t), series.warning_coverage(t.warning_download()), series.warning_day_stats(features(t))
    )

"""Optional query parameters as filter columns; absent parameters add no predicate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pavesa import constants as K


def all_of(*conditions: Column | None) -> Column:
    given = [x for x in conditions if x is not None]
    return reduce(lambda a, b: a & b, given) if given else F.lit(True)


def date_range(name: str, date_from: str | None = None, date_to: str | None = None) -> Column:
    return all_of(
        None if date_from is None else F.col(name) >= F.lit(date_from).cast("date"),
        None if date_to is None else F.col(name) <= F.lit(date_to).cast("date"),
    )


def run_range(date_from: str | None, date_to: str | None) -> tuple[Column, Column]:
    """Both ends or neither; without them a job covers yesterday in local time."""
    if (date_from is None) != (date_to is None):
        raise ValueError("give both dates or none")
    if date_from is None:
        yesterday = F.date_sub(F.to_date(F.from_utc_timestamp(F.current_timestamp(), K.LOCAL_ZONE)), 1)
        return yesterday, yesterday
    return F.lit(date_from).cast("date"), F.lit(date_to).cast("date")


def in_box(lon: str, lat: str, box) -> Column:
    minx, miny, maxx, maxy = box
    return F.col(lon).between(minx, maxx) & F.col(lat).between(miny, maxy)


def fire_filter(sensor=None, bbox=None, min_frp=None, confidence=None, null_frp_is_zero: bool = True) -> Column:
    frp = F.coalesce("frp", F.lit(0.0)) if null_frp_is_zero else F.col("frp")
    return all_of(
        None if sensor is None else F.col("sensor") == sensor,
        None if bbox is None else in_box("longitude", "latitude", bbox),
        None if min_frp is None else frp >= min_frp,
        None if confidence is None else F.col("confidence_label") == confidence,
    )


def alert_state(now: Column) -> Column:
    onset, expires = F.col("onset"), F.col("expires")
    return (
        F.when(onset.isNull() | expires.isNull(), F.lit(None))
        .when((onset <= now) & (now <= expires), "vigente")
        .when(onset > now, "proximo")
        .otherwise("expirado")
    )


def alert_status_filter(status: str, now: Column) -> Column:
    """Alerts without readable dates only pass when any state is asked for."""
    return F.lit(True) if status == "cualquiera" else alert_state(now) == status


def overlaps(start: str, end: str, date_from: str | None, date_to: str | None) -> Column:
    return all_of(
        None if date_from is None else F.col(end) >= F.lit(date_from).cast("timestamp"),
        None if date_to is None else F.col(start) <= F.lit(date_to).cast("timestamp"),
    )


def mentions(name: str, needle: str) -> Column:
    return F.lower(F.coalesce(name, F.lit(""))).contains(needle.lower())


def rank_floor(zoom: Column) -> Column:
    floor = F.when(zoom <= 8, 4).when(zoom == 9, 3).when(zoom == 10, 2).otherwise(1)
    return (F.col("population_rank") >= floor) | F.col("is_capital")

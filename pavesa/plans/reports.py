"""User-level reports: plain functions of DataFrames and parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pavesa import constants as K
from pavesa.functions import geo
from pavesa.functions import parameters as P
from pavesa.functions import scalar as S
from pavesa.operators import cluster, series


def live_alerts(feed: DataFrame) -> DataFrame:
    text = F.col("event_text")
    return feed.withColumn("level", S.live_level(text)).withColumn("event", S.live_event_title(text))


def query_alerts(alerts, now: Column, phenomenon=None, level=None, status="vigente", date_from=None, date_to=None) -> DataFrame:
    """Alerts by phenomenon, level, state and window. Alerts without readable dates are in when any state is asked for, whatever the window."""
    undated = (F.col("onset").isNull() | F.col("expires").isNull()) & F.lit(status == "cualquiera")
    return alerts.filter(
        P.all_of(
            None if not phenomenon else P.mentions("event", phenomenon),
            None if not level else F.col("level") == level,
            P.alert_status_filter(status, now),
            undated | P.overlaps("onset", "expires", date_from, date_to),
        )
    )


def counts_by(rows: DataFrame, key: str, label: str = "Desconocido") -> DataFrame:
    return rows.groupBy(F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit(label)).alias("key")).agg(F.count("*").alias("n"))


def alert_state_counts(alerts: DataFrame, now: Column) -> DataFrame:
    state = P.alert_state(now)
    counted = alerts.agg(
        F.count_if(state == "vigente").alias("active"),
        F.count_if(state == "proximo").alias("upcoming"),
        F.count_if(state == "expirado").alias("expired"),
    )
    return counted.withColumn("total", F.col("active") + F.col("upcoming"))


def metrics(df: DataFrame, component: str, names: list[str]) -> DataFrame:
    """A one-row frame as (component, metric, value) rows."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return df.select(F.lit(component).alias("component"), F.explode(pairs).alias("m")).select("component", "m.*")


def dashboard(alerts: DataFrame, fires: DataFrame, now: Column) -> DataFrame:
    states = metrics(alert_state_counts(alerts, now), "alerts", ["total", "active", "upcoming", "expired"])
    levels = (
        alerts.filter(F.col("expires") >= now).groupBy("level").agg(F.count("*").alias("n"))
        .select(F.lit("alerts_by_level").alias("component"), F.col("level").alias("metric"), F.col("n").cast("double").alias("value"))
    )
    totals = metrics(
        fires.agg(F.count("*").alias("total"), F.coalesce(F.max(F.coalesce("frp", F.lit(0.0))), F.lit(0.0)).alias("frp_max")),
        "fires", ["total", "frp_max"],
    )
    bands = fires.groupBy("intensity_label").agg(F.count("*").alias("n")).select(
        F.lit("fires_by_intensity").alias("component"), F.col("intensity_label").alias("metric"), F.col("n").cast("double").alias("value")
    )
    return states.unionByName(levels).unionByName(totals).unionByName(bands)


def burnt_area_summary(days: DataFrame) -> DataFrame:
    """Period total and peak day; NULL days count as zero, the earliest day wins ties."""
    area = F.coalesce("burned_area_ha", F.lit(0.0))
    return days.agg(
        F.count("*").alias("total_days"),
        S.dec_round(F.coalesce(F.sum(area), F.lit(0.0)), 2).alias("total_burned_area_ha"),
        F.min_by("nominal_date", F.struct(-area, F.col("nominal_date"))).alias("peak_day"),
        F.max(area).alias("peak_area_ha"),
    )


def warning_history(days: DataFrame) -> DataFrame:
    rank = F.struct(-F.col("max_temperature_c"), F.col("nominal_date"))
    hot = F.col("max_temperature_c").isNotNull()
    return days.agg(
        F.count("*").alias("total_days"),
        *[F.sum(c).alias(f"total_{c}") for c in ("warning_count", "red_count", "orange_count", "yellow_count", "green_count")],
        F.min_by("nominal_date", F.when(hot, rank)).alias("peak_day"),
        F.max("max_temperature_c").alias("peak_temperature_c"),
    )


def catalog_with_state(items: DataFrame, published: DataFrame) -> DataFrame:
    """Every catalogue entry with its publication state; unknown entries are merely catalogued."""
    keys = ["dataset_version", "delivery_format", "nominal_date"]
    state = published.select(*keys, "publication_status", F.col("local_tiles_path").isNotNull().alias("has_local_tiles"))
    return items.select(*keys).join(state, keys, "left").select(
        *keys,
        F.coalesce("publication_status", F.lit("cataloged")).alias("publication_status"),
        F.coalesce("has_local_tiles", F.lit(False)).alias("has_local_tiles"),
    )


def burnt_area_timeline(items: DataFrame, stats: DataFrame) -> DataFrame:
    days = items.join(stats.select("nominal_date", "burned_area_ha", "burned_pixel_count"), "nominal_date", "left")
    return series.running_totals(days, ["dataset_version", "delivery_format"])


def feature_json(kind: str, geometry: Column, properties: list[str]) -> Column:
    """One GeoJSON feature as text."""
    props = F.struct(*[F.col(p) for p in properties])
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties")), {"ignoreNullFields": "false"})


def variant_metadata(items: DataFrame) -> DataFrame:
    """Counts per closed version x format variant, empty variants included."""
    spark = items.sparkSession
    closed = spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in K.BURNT_VERSIONS])).alias("dataset_version")).select(
        "dataset_version", F.explode(F.array(*[F.lit(v) for v in [*K.BURNT_FORMATS, "zarr"]])).alias("delivery_format")
    )
    counted = items.groupBy("dataset_version", "delivery_format").agg(
        F.count("*").alias("n"), F.min("nominal_date").alias("lo"), F.max("nominal_date").alias("hi"), F.count_if("has_local_tiles").alias("pub")
    )
    return closed.join(counted, ["dataset_version", "delivery_format"], "left").select(
        "dataset_version", "delivery_format", F.coalesce("n", F.lit(0)).alias("date_count"),
        F.date_format("lo", "yyyy-MM-dd").alias("min_date"), F.date_format("hi", "yyyy-MM-dd").alias("max_date"),
        F.coalesce("pub", F.lit(0)).alias("published_date_count"),
    )


def hour_grid(warnings: DataFrame, reference: str) -> DataFrame:
    """Active warnings in each hour from a reference time to the latest expiry."""
    t0 = F.lit(reference).cast("timestamp")
    seconds = lambda ts: F.unix_seconds(ts) - F.unix_seconds(t0)
    first = F.greatest(F.ceil(seconds(F.col("onset")) / 3600), F.lit(0))
    last = F.floor(seconds(F.col("expires")) / 3600)
    counts = (
        warnings.select(first.alias("a"), last.alias("b")).filter("b >= a")
        .select(F.explode(F.sequence("a", "b")).alias("h")).groupBy("h").agg(F.count("*").alias("active_count"))
    )
    grid = warnings.agg(F.max(last).alias("m")).filter("m >= 0").select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m"))).alias("h"))
    hour = F.timestamp_seconds(F.unix_seconds(t0) + F.col("h") * 3600)
    return grid.join(counts, "h", "left").select(
        F.date_format(hour, "yyyy-MM-dd HH:mm").alias("hour"), F.coalesce("active_count", F.lit(0)).alias("active_count")
    )


def hotspot_clusters(hotspots: DataFrame, date_from: str, date_to: str, bbox=None, sensors=None, eps_m: float = 1500.0, min_points: int = 4) -> DataFrame:
    """Density clusters of the hotspots of a period: members, radiative power, days and centre of each."""
    asked = hotspots.filter(
        P.all_of(
            P.date_range("acq_date", date_from, date_to),
            None if bbox is None else P.in_box("longitude", "latitude", bbox),
            None if not sensors else F.col("firms_source").isin(*sensors),
        )
    )
    points = asked.select(F.col("hotspot_id").alias("id"), geo.mercator_x(F.col("longitude")).alias("x"), geo.mercator_y(F.col("latitude")).alias("y"))
    member = cluster.dbscan(points, eps_m, min_points).select("id", "cluster_id")
    return cluster_summary(asked.withColumnRenamed("hotspot_id", "id").select("id", "frp", "acq_date", "longitude", "latitude").join(member, "id"))


def cluster_summary(points: DataFrame) -> DataFrame:
    r2 = lambda c: F.round(c.cast("decimal(20,8)"), 2).cast("double")
    return points.filter("cluster_id IS NOT NULL").groupBy("cluster_id").agg(
        F.count("*").alias("hotspot_count"),
        r2(F.avg("frp")).alias("avg_frp"),
        r2(F.max("frp")).alias("max_frp"),
        F.date_format(F.min("acq_date"), "yyyy-MM-dd").alias("first_date"),
        F.date_format(F.max("acq_date"), "yyyy-MM-dd").alias("last_date"),
        S.dec_round(F.avg("longitude"), 5).alias("center_lon"),
        S.dec_round(F.avg("latitude"), 5).alias("center_lat"),
    )

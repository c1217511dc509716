"""Rasters as pixel tables: one row per pixel and day."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pavesa.constants import AUTHALIC_RADIUS_M

TILE = 256


@dataclass(frozen=True)
class Grid:
    """Where a raster's pixels are: upper left corner, steps in degrees, size."""

    lon: float
    lat: float
    step_lon: float
    step_lat: float
    rows: int
    cols: int

    def centre_lon(self, col: Column) -> Column:
        return self.lon + (col + 0.5) * self.step_lon

    def centre_lat(self, row: Column) -> Column:
        return self.lat - (row + 0.5) * self.step_lat

    def area_ha(self, row: Column) -> Column:
        """Area of one pixel of a row on the authalic sphere."""
        top, bottom = F.radians(self.lat - row * self.step_lat), F.radians(self.lat - (row + 1.0) * self.step_lat)
        return (
            F.lit(AUTHALIC_RADIUS_M * AUTHALIC_RADIUS_M) * F.radians(F.lit(self.step_lon)) * F.abs(F.sin(top) - F.sin(bottom)) / 10000.0
        )

    def holds(self, row: Column, col: Column) -> Column:
        return row.between(0, self.rows - 1) & col.between(0, self.cols - 1)


def burn_mask(pixels: DataFrame, mode: str = "daily") -> DataFrame:
    day = F.dayofyear("nominal_date")
    when = F.col("dob") == day if mode == "daily" else (F.col("dob") > 0) & (F.col("dob") <= day)
    return pixels.filter((F.col("bf") > 0) & (F.coalesce("alpha", F.lit(255)) > 0) & when)


def burnt_stats(masked: DataFrame, grid: Grid, *by: str) -> DataFrame:
    fraction = F.col("bf") / 1000.0
    return masked.groupBy(*(by or ("nominal_date",))).agg(
        F.sum(fraction * grid.area_ha(F.col("prow"))).alias("burned_area_ha"),
        F.sum(fraction).alias("burned_fraction_sum"),
        F.count("*").alias("burned_pixel_count"),
    )


def dilate(masked: DataFrame, grid: Grid, radius: int = 1) -> DataFrame:
    """Mask plus halo inside the raster: ``is_core`` tells the two apart. No join; pixels seen several times a day become one before they spread."""
    masked = masked.groupBy("nominal_date", "prow", "pcol").agg(F.max("bf").alias("bf"))
    reach = range(-radius, radius + 1)
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in reach for j in reach])
    return (
        masked.withColumn("s", F.explode(steps))
        .select(
            "nominal_date", (F.col("prow") + F.col("s.i")).alias("prow"), (F.col("pcol") + F.col("s.j")).alias("pcol"),
            ((F.col("s.i") == 0) & (F.col("s.j") == 0)).alias("core"), F.when((F.col("s.i") == 0) & (F.col("s.j") == 0), F.col("bf")).alias("bf"),
        )
        .filter(grid.holds(F.col("prow"), F.col("pcol")))
        .groupBy("nominal_date", "prow", "pcol")
        .agg(F.max("core").alias("is_core"), F.max("bf").alias("bf"))
    )


def colours(dilated: DataFrame) -> DataFrame:
    """Ramp for burnt pixels, fixed amber for their halo."""
    level = F.least(F.greatest(F.rint(F.col("bf") / 1000.0 * 255.0), F.lit(0.0)), F.lit(255.0)).cast("int")

    def ramp(base: int, slope: int, lo: int, hi: int) -> Column:
        return F.least(F.greatest(F.lit(base) + F.floor(level * abs(slope) / 255).cast("int") * (1 if slope > 0 else -1), F.lit(lo)), F.lit(hi))

    core = F.col("is_core")
    return dilated.select(
        "nominal_date", "prow", "pcol",
        F.lit(255).alias("r"),
        F.when(core, ramp(240, -105, 88, 240)).otherwise(212).alias("g"),
        F.when(core, ramp(164, -112, 26, 164)).otherwise(82).alias("b"),
        F.when(core, ramp(182, 58, 182, 240)).otherwise(150).alias("a"),
    )


def pixel_runs(pixels: DataFrame, *by: str) -> DataFrame:
    """Horizontal runs of visible pixels inside each map tile row (at most one tile width per group)."""
    tiled = pixels.select(
        *by, F.floor(F.col("pcol") / TILE).cast("int").alias("tile_x"), F.floor(F.col("prow") / TILE).cast("int").alias("tile_y"),
        (F.col("prow") % TILE).alias("py"), (F.col("pcol") % TILE).alias("px"),
    ).distinct()
    row = [*by, "tile_x", "tile_y", "py"]
    island = F.col("px") - F.row_number().over(Window.partitionBy(*row).orderBy("px"))
    return (
        tiled.withColumn("island", island)
        .groupBy(*row, "island")
        .agg(F.min("px").alias("x_start"), F.max("px").alias("x_end"), F.count("*").alias("pixels"))
        .drop("island")
    )


def tile_summary(runs: DataFrame, *by: str) -> DataFrame:
    return runs.groupBy(*by, "tile_x", "tile_y").agg(F.count("*").alias("run_count"), F.sum("pixels").alias("pixel_count"))


def composite(layers: DataFrame) -> DataFrame:
    """Later days over earlier ones, per pixel, in 8-bit integer alpha compositing.

    A pixel has at most one layer per day, so each list is bounded by the calendar.
    """
    stack = F.array_sort(F.collect_list(F.struct("nominal_date", "r", "g", "b", "a")))

    def div255(x: Column) -> Column:
        return F.shiftright(F.shiftright(x, 8) + x, 8)

    def over(dst: Column, src: Column) -> Column:
        alpha = src["a"] * 255 + dst["a"] * (255 - src["a"])
        c1 = F.floor(src["a"] * 255 * 255 * 128 / F.greatest(alpha, F.lit(1))).cast("int")
        c2 = F.lit(255 * 128) - c1

        def mix(ch: str) -> Column:
            return F.shiftright(div255(src[ch] * c1 + dst[ch] * c2 + 16384), 7)

        out = F.struct(mix("r").alias("r"), mix("g").alias("g"), mix("b").alias("b"), div255(alpha + 128).alias("a"))
        return F.when(src["a"] == 0, dst).otherwise(out)

    clear = F.struct(*[F.lit(0).alias(ch) for ch in "rgba"])
    rgba = F.aggregate(stack, clear, over)
    return layers.groupBy("prow", "pcol").agg(rgba.alias("c")).select("prow", "pcol", "c.*")

"""Raster-as-table and burnt-area queries: family P."""

from __future__ import annotations

from pyspark.sql import functions as F

from pavesa.functions import geo
from pavesa.functions import scalar as S
from pavesa.operators import raster, regions
from pavesa.plans.domain_sql import REGION_TEST, dr, view, with_views
from pavesa.plans.refine_queries import day_text
from pavesa.plans.registry import query
from pavesa.sources.bridge import PIXEL_GRID

R2 = "(6371007.181e0*6371007.181e0)"
AREA = f"({R2}*radians(cast(0.03 as double))*abs(sin(radians(44.0-prow*cast(0.02 as double)))-sin(radians(44.0-(prow+1.0)*cast(0.02 as double))))/10000.0)"
view("burnt", "SELECT * FROM pixel WHERE bf>0 AND alpha>0 AND dob=dayofyear(nominal_date)", ["pixel"])
view("burnt_stat", f"""SELECT nominal_date, sum(bf/1000.0e0*{AREA}) AS burned_area_ha, sum(bf/1000.0e0) AS burned_fraction_sum, count(*) AS burned_pixel_count FROM burnt GROUP BY nominal_date""", ["burnt"])
view("dilated", """SELECT nominal_date, prow+i AS prow, pcol+j AS pcol, max(CASE WHEN i=0 AND j=0 THEN 1 ELSE 0 END) AS core, max(CASE WHEN i=0 AND j=0 THEN bf END) AS bf
  FROM burnt, (VALUES (-1),(0),(1)) a(i), (VALUES (-1),(0),(1)) b(j) WHERE prow+i BETWEEN 0 AND 399 AND pcol+j BETWEEN 0 AND 399 GROUP BY ALL""", ["burnt"])
view("rgba", """SELECT nominal_date, prow, pcol, 255 AS r, CASE WHEN core=1 THEN least(greatest(240-(v*105)//255,88),240) ELSE 212 END AS g,
  CASE WHEN core=1 THEN least(greatest(164-(v*112)//255,26),164) ELSE 82 END AS b, CASE WHEN core=1 THEN least(greatest(182+(v*58)//255,182),240) ELSE 150 END AS a
  FROM (SELECT *, cast(least(greatest(round_even(bf/1000.0e0*255.0e0,0),0),255) as integer) AS v FROM dilated)""", ["dilated"])
view("pix_pos", "SELECT DISTINCT nominal_date, pcol//256 AS tile_x, prow//256 AS tile_y, prow%256 AS py, pcol%256 AS px FROM burnt", ["burnt"])
view("runs", """SELECT nominal_date, tile_x, tile_y, py, min(px) AS x_start, max(px) AS x_end, count(*) AS pixels FROM (SELECT *, px-row_number() OVER (PARTITION BY nominal_date, tile_x, tile_y, py ORDER BY px) AS g FROM pix_pos)
  GROUP BY nominal_date, tile_x, tile_y, py, g""", ["pix_pos"])


def burnt(t):
    return raster.burn_mask(t.pixel())


def burnt_days(t):
    return raster.burnt_stats(burnt(t), PIXEL_GRID)


@query("p01_burn_mask", with_views("pixel", """SELECT strftime(nominal_date,'%Y-%m-%d') AS nominal_date, count(*) FILTER (dob=dayofyear(nominal_date)) AS daily, count(*) FILTER (dob>0 AND dob<=dayofyear(nominal_date)) AS cumulative FROM pixel WHERE bf>0 AND alpha>0 GROUP BY nominal_date"""))
def p01(t):
    day = raster.burn_mask(t.pixel(), "cumulative").withColumn("today", F.col("dob") == F.dayofyear("nominal_date"))
    return day.groupBy("nominal_date").agg(F.count_if("today").alias("daily"), F.count("*").alias("cumulative")).select(day_text("nominal_date"), "daily", "cumulative")


@query("p02_clip_to_region", with_views("pixel region_edge", f"""SELECT strftime(nominal_date,'%Y-%m-%d') AS nominal_date, count(*) AS n FROM (SELECT *, -9.0+(pcol+0.5)*cast(0.03 as double) AS longitude, 44.0-(prow+0.5)*cast(0.02 as double) AS latitude FROM pixel) WHERE {REGION_TEST} GROUP BY nominal_date"""))
def p02(t):
    located = t.pixel().withColumn("longitude", PIXEL_GRID.centre_lon(F.col("pcol"))).withColumn("latitude", PIXEL_GRID.centre_lat(F.col("prow")))
    return regions.flag_in_region(located, t.region_edges()).filter("in_region").groupBy("nominal_date").agg(F.count("*").alias("n")).select(day_text("nominal_date"), "n")


@query("p03_cell_area", with_views("pixel", f"SELECT prow, {dr(AREA, 4)} AS cell_ha, count(*) AS n FROM pixel GROUP BY prow"))
def p03(t):
    return t.pixel().groupBy("prow").agg(F.count("*").alias("n")).select("prow", S.dec_round(PIXEL_GRID.area_ha(F.col("prow")), 4).alias("cell_ha"), "n")


@query("p04_zonal_stats", with_views("burnt_stat", f"SELECT strftime(nominal_date,'%Y-%m-%d') AS nominal_date, {dr('burned_area_ha', 3)} AS burned_area_ha, {dr('burned_fraction_sum', 3)} AS burned_fraction_sum, burned_pixel_count FROM burnt_stat"))
def p04(t):
    return burnt_days(t).select(
        day_text("nominal_date"), S.dec_round(F.col("burned_area_ha"), 3).alias("burned_area_ha"),
        S.dec_round(F.col("burned_fraction_sum"), 3).alias("burned_fraction_sum"), "burned_pixel_count",
    )


@query("p05_dilated_halo", with_views("dilated", "SELECT strftime(nominal_date,'%Y-%m-%d') AS nominal_date, prow, pcol FROM dilated WHERE core=0"))
def p05(t):
    return raster.dilate(burnt(t), PIXEL_GRID).filter("NOT is_core").select(day_text("nominal_date"), "prow", "pcol")


@query("p06_colour_ramp", with_views("rgba", "SELECT strftime(nominal_date,'%Y-%m-%d') AS nominal_date, prow, pcol, r, g, b, a FROM rgba"))
def p06(t):
    return raster.colours(raster.dilate(burnt(t), PIXEL_GRID)).select(day_text("nominal_date"), "prow", "pcol", "r", "g", "b", "a")


@query("p07_pixel_runs", with_views("runs", "SELECT strftime(nominal_date,'%Y-%m-%d') AS nominal_date, tile_x, tile_y, py, x_start, x_end, pixels FROM runs"))
def p07(t):
    return raster.pixel_runs(burnt(t), "nominal_date").select(day_text("nominal_date"), "tile_x", "tile_y", "py", "x_start", "x_end", "pixels")


def _lat_sql(y: str) -> str:
    return f"degrees(atan(sinh(3.141592653589793e0*(1-2*({y})/pow(2.0e0,10)))))"


@query("p08_run_rectangles", with_views("runs", f"""SELECT strftime(nominal_date,'%Y-%m-%d') AS nominal_date, tile_x, tile_y, py, x_start, {dr('(480+tile_x+x_start/256.0e0)/pow(2.0e0,10)*360.0-180.0', 6)} AS west,
  {dr('(480+tile_x+(x_end+1)/256.0e0)/pow(2.0e0,10)*360.0-180.0', 6)} AS east, {dr(_lat_sql('380+tile_y+py/256.0e0'), 6)} AS north, {dr(_lat_sql('380+tile_y+(py+1)/256.0e0'), 6)} AS south FROM runs"""))
def p08(t):
    z, c = 10, F.col
    left, right = 480 + c("tile_x") + c("x_start") / 256.0, 480 + c("tile_x") + (c("x_end") + 1) / 256.0
    top, bottom = 380 + c("tile_y") + c("py") / 256.0, 380 + c("tile_y") + (c("py") + 1) / 256.0
    r6 = lambda v: S.dec_round(v, 6)
    return raster.pixel_runs(burnt(t), "nominal_date").select(
        day_text("nominal_date"), "tile_x", "tile_y", "py", "x_start", r6(geo.tile_lon(left, z)).alias("west"), r6(geo.tile_lon(right, z)).alias("east"),
        r6(geo.tile_lat(top, z)).alias("north"), r6(geo.tile_lat(bottom, z)).alias("south"),
    )


@query("p09_cumulative_locator", with_views("runs", """SELECT tile_x, tile_y, count(*) AS run_count, cast(sum(pixels) as bigint) AS pixel_count, count(DISTINCT nominal_date) AS included_date_count,
  md5(array_to_string(list_sort(list(DISTINCT strftime(nominal_date,'%Y-%m-%d'))),',')) AS included_dates_md5 FROM runs WHERE nominal_date<=date '1999-06-30' GROUP BY 1,2"""))
def p09(t):
    runs = raster.pixel_runs(burnt(t).filter("nominal_date <= date'1999-06-30'"), "nominal_date")
    days = F.collect_set(F.date_format("nominal_date", "yyyy-MM-dd"))
    return runs.groupBy("tile_x", "tile_y").agg(
        F.count("*").alias("run_count"), F.sum("pixels").alias("pixel_count"), F.size(days).cast("bigint").alias("included_date_count"),
        F.md5(F.array_join(F.array_sort(days), ",").cast("binary")).alias("included_dates_md5"),
    )


OVER = """CASE WHEN s.a=0 THEN d ELSE {'r': MIX(r), 'g': MIX(g), 'b': MIX(b), 'a': (((AL+128)>>8)+AL+128)>>8} END"""
_al = "(s.a*255+d.a*(255-s.a))"
_c1 = f"((s.a*8323200)//greatest({_al},1))"


def _mix(ch: str) -> str:
    x = f"(s.{ch}*{_c1}+d.{ch}*(32640-{_c1})+16384)"
    return f"((({x}>>8)+{x})>>8)>>7"


OVER = OVER.replace("AL", _al)
for _ch in "rgb":
    OVER = OVER.replace(f"MIX({_ch})", _mix(_ch))


@query("p10_alpha_composite", with_views("rgba", f"""SELECT prow, pcol, c.r AS r, c.g AS g, c.b AS b, c.a AS a FROM (SELECT prow, pcol, list_reduce(list({{'r': cast(r as bigint), 'g': cast(g as bigint), 'b': cast(b as bigint), 'a': cast(a as bigint)}} ORDER BY nominal_date),
  lambda d, s: {OVER}, {{'r': 0::bigint, 'g': 0::bigint, 'b': 0::bigint, 'a': 0::bigint}}) AS c FROM rgba GROUP BY prow, pcol)"""))
def p10(t):
    return raster.composite(raster.colours(raster.dilate(burnt(t), PIXEL_GRID)))


@query("p11_publication_index", with_views("daily_file", "SELECT dataset_version, delivery_format, strftime(nominal_date,'%Y-%m-%d') AS nominal_date, publication_status, local_tiles_path IS NOT NULL AS has_local_tiles FROM daily_file"))
def p11(t):
    from pavesa.operators import canonical

    return canonical.daily_files(t.catalog_item()).select(
        "dataset_version", "delivery_format", day_text("nominal_date"), "publication_status", F.col("local_tiles_path").isNotNull().alias("has_local_tiles")
    )

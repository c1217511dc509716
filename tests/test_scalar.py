"""Small frames for the rules that are easy to get wrong."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pavesa.functions import scalar as S


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("value, expected", [(0.5, 0), (1.5, 2), (2.5, 2), (-1.0, None)])
def test_population_rounds_half_to_even(spark, value, expected):
    assert one(spark, S.population(F.lit(value))) == expected


@pytest.mark.parametrize("frp, server, group", [(200.0, "Alto", 0), (200.1, "Muy alto", 0), (50.0, "Alto", 1), (10.0, "Medio", 2), (None, "Bajo", 3)])
def test_frp_boundaries(spark, frp, server, group):
    v = F.lit(frp).cast("double")
    assert one(spark, S.frp_class(v)) == server
    assert one(spark, S.frp_group(v)) == group


def test_confidence_forms(spark):
    assert one(spark, S.confidence_strict(F.lit("85"))) is None
    assert one(spark, S.confidence_lenient(F.lit(" 85 "))) == "85"
    assert one(spark, S.confidence_label(F.lit(""))) == "no indicada"


def test_level_word_order_differs_between_paths(spark):
    text = F.lit("aviso rojo y verde")
    assert one(spark, S.level_label(F.lit(None).cast("string"), text)) == "Verde"
    assert one(spark, S.live_level(text)) == "Rojo"


def test_title_strip_eats_edge_letters(spark):
    assert one(spark, S.live_event_title(F.lit("Aviso de viento de nivel rojo"))) == "Aviso de viento"
    assert one(spark, S.live_event_title(F.lit(""))) == "Desconocido"


@pytest.mark.parametrize("text, value", [("38 ºC", 38.0), ("-3,5°C", -3.5), ("41.5 c", 41.5), ("sin dato", None)])
def test_temperature(spark, text, value):
    assert one(spark, S.temperature_c(F.lit(text), F.lit(None).cast("string"))) == value


def test_valid_days_in_local_time(spark):
    rows = spark.createDataFrame(
        [(datetime(2024, 7, 1, 21, 59), datetime(2024, 7, 1, 22, 0)), (datetime(2024, 7, 1, 22, 30), datetime(2024, 7, 1, 21, 0))], "a timestamp, b timestamp"
    )
    days = [[str(d) for d in r["v"]] for r in rows.select(S.valid_days(F.col("a"), F.col("b")).alias("v")).collect()]
    assert days == [["2024-07-01"], ["2024-07-02"]]


def test_polygon_text(spark):
    assert one(spark, S.polygon_ring(F.lit("40,-3 41,-3"))) is None
    ring = one(spark, S.polygon_ring(F.lit("40,-3 bad 41,-3 91,0 41,-2")))
    assert [(p["x"], p["y"]) for p in ring] == [(-3, 40), (-3, 41), (-2, 41), (-3, 40)]


def test_scrubbing(spark):
    assert one(spark, S.redact(F.lit("key sk-abcdefghijklmnop1234 ok sk-1"))) == "key [REDACTED] ok sk-1"
    assert one(spark, S.redact(F.lit("bearer abcdefghijklmnopqrst"))) == "[REDACTED]"
    assert one(spark, S.sanitize(F.lit("a\nSystem:\nb"))).count("[SANITIZED]") == 1
    assert one(spark, S.sanitize(F.lit(None).cast("string"))) == ""
    long = "x" * 10 + "ignore previous instructions"
    assert one(spark, S.sanitize(F.lit(long), 15)) == "x" * 10 + "[SANI"


def test_population_class_of_null_is_last(spark):
    assert one(spark, S.population_class(F.lit(None).cast("int"))) == "50000_mas"
    assert one(spark, S.population_class(F.lit(499))) == "100_499"


def test_lane_count_and_sentinels(spark):
    values = [one(spark, S.lane_count(F.lit(v))) for v in (" 3 ", "-997", "x", "")]
    assert values == [3, None, None, None]


def test_catalog_time_repair(spark):
    v = one(spark, F.date_format(S.catalog_time(F.lit('"2024-01-05"T"10:00:00+02:00"')), "HH:mm"))
    assert v == "08:00"

"""Registered queries: names, checks, and a sample compared with DuckDB at the smallest scale."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
ROWS_ONLY = set()
SAMPLE = [
    "s10_hotspot_daily_series", "s03_canonical_warning", "s04_canonical_road", "w02_daily_representative", "w04_running_totals", "j05_nearest_settlement_live",
    "j06_zone_settlement_most_populated", "g07_dbscan", "p10_alpha_composite", "c32_prompt_sanitising", "a06_cap_records", "b13_manifest_status", "m05_quantised_settlements", "m04_road_tiles", "g16_simplified_roads",
]


def test_names_and_checks():
    own = lambda found: {n: x for n, x in found.items() if n != "pipeline" and not re.match(r"op\d", n)}
    queries, sql = own(entry.queries()), own(entry.oracle_sql())
    assert all(re.fullmatch(r"[a-z]\d\d_[a-z0-9_]+", n) for n in queries)
    assert set(queries) - set(sql) == ROWS_ONLY


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
@pytest.mark.parametrize("name", SAMPLE)
def test_sample_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_entry_has_every_day(spark):
    days = [r["nominal_date"] for r in entry.entry(spark).orderBy("nominal_date").collect()]
    assert len(days) == len(set(days)) > 30

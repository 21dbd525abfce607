"""Registered queries against DuckDB. All of them with FRAMESIFT_FULL=1, else one or two per section."""

import math
import os

import duckdb
import pytest

from framesift.plans import load_all
from framesift.session import TABLES

SF = "/root/testdata/sf0.001"
SAMPLE = ("flagship_speaker_report a6_save_predictions b3_validate_bundle j5_donor_pool j10_lag_join c2_mismatch_sweep c15_grid_resample "
          "d2_choose_single d11_components g7_reject_histogram v2_registry_match l4_video_state m9_breakdown w1_ranking t1_sessions").split()
NAMES = sorted(load_all()) if os.environ.get("FRAMESIFT_FULL") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def table(arrow):
    names = sorted(arrow.column_names)
    rows = zip(*[arrow.column(n).to_pylist() for n in names])
    clean = [tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows]
    return names, sorted(clean, key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    q = load_all()[name]
    got = table(q.build(spark, SF).toArrow())
    if q.sql is None:
        assert got[0]
    else:
        assert got == table(duck.execute(q.sql).to_arrow_table())


def test_every_row_has_a_query():
    rows = {r for q in load_all().values() for r in q.row.split()}
    sizes = {"A": 17, "B": 27, "J": 12, "C": 45, "D": 31, "G": 20, "V": 9, "L": 8, "M": 30, "W": 8, "S": 9, "T": 7, "U": 4}
    missing = [f"{s}{i}" for s, n in sizes.items() for i in range(1, n + 1) if f"{s}{i}" not in rows]
    assert missing == []

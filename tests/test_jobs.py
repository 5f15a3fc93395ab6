"""Registered jobs against their checker SQL on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from newsrank.plans.views import TABLES  # noqa: E402
from tools_check import rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
PICKED = ["src02_list_page_links", "src16_event_upsert", "flt01_freshness_gate", "flt13_post_quality_reasons", "ded06_fingerprints",
          "ded11_merged_clusters", "tag04_resolved_coins", "ver04_evidence_profile", "sco11_scored_events", "rnk09_final_rank",
          "sec05_gated_scores", "sig03_level_breaks", "agg03_scope_buckets", "dq07_excluded_and_stale", "pan05_rates_by_shock",
          "mnt04_clock_shift", "str05_previous_values", "src15_database_upsert", "src18_exported_groups", "tag09_title_entities",
          "rnk12_production_page", "str07_streamed_windows", "str08_idempotent_commit"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_contract():
    jobs, checks = entry.queries(), entry.oracle_sql()
    assert set(checks) <= set(jobs)
    assert len(jobs) > 150


@pytest.mark.parametrize("name", PICKED)
def test_job(spark, con, name):
    df = entry.queries()[name](spark, SF)
    res = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, res.fetchall())


def test_liquidation_records_are_not_gathered(spark):
    from types import SimpleNamespace

    from newsrank.plans.jobs_sources import liquidation_rows

    lines = spark.range(1000).selectExpr("id * 20 AS l_partkey", "DATE'2024-01-01' AS l_shipdate", "2.0 AS l_quantity", "10.0 * id AS l_extendedprice", "if(id % 2 = 0, 'A', 'N') AS l_returnflag")
    got = liquidation_rows(SimpleNamespace(lineitem=lines)).selectExpr("inst_id", "size(details) AS n").collect()
    assert len(got) == 1000 and {(r.inst_id, r.n) for r in got} == {("C0-USDT-SWAP", 1)}


def test_signal_run_takes_all_seven_kinds(spark):
    from newsrank import dictionaries as D
    from newsrank.plans import jobs_signals as J
    from newsrank.plans.views import Feed

    rows = J._signals(Feed(spark, "/root/testdata/sf0.01")).collect()
    jumps = [r.key.split(":")[1] for r in rows if r.kind == "oi_jump"]
    assert {r.kind for r in rows} == set(D.KIND_PRIORITY)
    assert len(jumps) == len(set(jumps))                               # one run: the last record of each base

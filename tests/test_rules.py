"""Column rules on small rows worked out by hand."""

import pytest
from pyspark.sql import functions as F

from newsrank.functions import scores as S
from newsrank.functions import text as X
from newsrank.functions import times as T
from newsrank.functions.percent import percent_move, title_move
from newsrank.operators import filters as FL
from newsrank.operators import signals as SG
from newsrank.operators.score import social_baseline


def value(spark, col, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return row.select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("title, want", [
    ("BlockBeats 消息，美国现货 BTC ETF 净流出 3.11 亿美元", "美国现货btcetf净流出<311000000>美元"),
    ("Raises $200M", "raises<200000000>"), ("募资 2 亿美元", "募资<200000000>美元"), ("200,000,000 美元", "<200000000>美元"),
    ("1 + 23", "<1><23>"), ("", ""), (None, ""),
])
def test_normalize_title(spark, title, want):
    assert value(spark, X.normalize_title(F.lit(title).cast("string"))) == want


@pytest.mark.parametrize("text, want", [
    ("份额升至67.4%", None), ("比特币跌8%", 8.0), ("关税威胁下比特币暴跌8%", 8.0), ("占比升至创纪录的72%", None),
    ("gold buying jumps 62%", None), ("塞地2025年升值约41%", None), ("2026年7月30日，比特币暴跌8%", 8.0),
    ("up 3% then up 12.5%", 12.5), ("rises 120%", None), ("rate stays 5%", None), ("BTC gains 1234%", None),
])
def test_percent_move(spark, text, want):
    assert value(spark, percent_move(F.lit(text))) == want


def test_title_decides_alone(spark):
    assert value(spark, title_move(F.lit("份额升至67.4%"), F.lit(""), F.lit("比特币跌8%"))) is None
    assert value(spark, title_move(F.lit("比特币回落"), F.lit(""), F.lit("比特币跌8%"))) == 8.0


@pytest.mark.parametrize("is_move, pct, horizon, want", [
    (False, None, "none", None), (True, 8.0, "intraday", 8.0), (True, 38.0, "long_term", None), (True, -8.0, "intraday", 8.0)])
def test_judged_move_wins(spark, is_move, pct, horizon, want):
    pm = F.struct(F.lit(is_move).alias("is_price_move"), F.lit(pct).cast("double").alias("move_pct"), F.lit(horizon).alias("move_horizon"))
    assert value(spark, S.punch_pct(pm, F.lit("比特币跌9%"), F.lit(""), F.lit(""))) == want


@pytest.mark.parametrize("url, key", [
    ("https://www.Example.com/a/b/?q=1#x", "example.com/a/b"), ("http://example.com:8080/a", "example.com:8080/a"), ("", ""),
    ("https://example.com", "example.com")])
def test_url_key(spark, url, key):
    assert value(spark, X.url_key(F.lit(url))) == key


@pytest.mark.parametrize("text, want", [
    ("2024-01-05T10:00:00Z", "2024-01-05 18:00:00"), ("2024-01-05T10:00:00+08:00", "2024-01-05 10:00:00"),
    ("2024-01-05T10:00:00", "2024-01-05 10:00:00"), ("2024-01-05T10:00:00.000Z", "2024-01-05 18:00:00"), ("soon", None), ("", None)])
def test_local_wall(spark, text, want):
    assert value(spark, T.wall_text(T.local_wall(F.lit(text)))) == want


def test_publish_gate(spark):
    now = "2024-02-01 00:00:00"
    rows = [("a", ""), ("b", "x"), ("c", "2024-01-20T00:00:00Z"), ("d", "2024-02-05T00:00:00Z"), ("e", "2024-01-30T01:00:00+08:00")]
    df = spark.createDataFrame([(s, "t", p) for s, p in rows], "source string, title string, published_at string")
    got = {r.source: str(r.published_ts) for r in FL.freshness_gate(df, now).collect()}
    assert got == {"d": "2024-02-01 00:00:00", "e": "2024-01-29 17:00:00"}


@pytest.mark.parametrize("values, want", [(list(range(0, 2000, 100)), 1900.0), ([1, 2], 500.0), ([], 500.0), ([0, 0], 500.0)])
def test_social_baseline(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "social_interactions int")
    assert social_baseline(df).first()["baseline"] == want


def test_scores_stay_in_bounds(spark):
    rows = [(None, "S"), (2.0, "A"), (0.0, "B"), (0.5, None), (0.9, "?")]
    df = spark.createDataFrame(rows, "raw double, tier string").select(S.impact(F.col("raw"), F.col("tier")).alias("v"))
    assert [r.v for r in df.collect()] == [0.85, 0.84, 0.35, 0.34, 0.9]


@pytest.mark.parametrize("px, want", [(64335.0, "6.43 万美元"), (60000.0, "6 万美元"), (2500.5, "2,500.50 美元"), (1.5, "1.500 美元"),
                                      (0.0123, "0.01230 美元"), (0.00001234, "0.00001234 美元")])
def test_price_text(spark, px, want):
    assert value(spark, SG.price_text(F.lit(px))) == want


def test_entity_and_outlet_keys(spark):
    assert value(spark, X.outlet_key(F.lit("X/TheBlock__"))) == value(spark, X.outlet_key(F.lit("The Block"))) == "theblock"


def test_result_title(spark):
    assert value(spark, X.clean_result_title(F.lit("Rates rise again - Daily News"), F.lit("Daily News"))) == "Rates rise again"
    assert value(spark, X.clean_result_title(F.lit("Short - Daily News"), F.lit("Daily News"))) == "Short"


def test_halves_of_a_total_go_up_in_whatever_order_they_were_added(spark):
    df = spark.createDataFrame([(0.41015, 0.41014999999999996, 0.41014)], "a double, b double, c double")
    assert tuple(df.select(*[X.round_settled(F.col(c), 4) for c in "abc"]).first()) == (0.4102, 0.4102, 0.4101)


def test_scores_that_differ_in_the_last_bit_keep_the_pool_order(spark):
    from newsrank.operators import rank as RK

    df = spark.createDataFrame([(0, 1, 0.3, 1), (0, 2, 0.1 + 0.2, 2), (0, 3, 0.31, 3)], "set_id int, id int, final_score double, pool_order int")
    assert [r.id for r in RK.ranked(df).orderBy("rank").collect()] == [3, 1, 2]


def test_only_runs_that_may_begin_a_name_are_kept(spark):
    import numpy as np

    from newsrank.operators import tags as TG

    known = np.zeros(TG._SLOTS, dtype=bool)
    known[TG._slots("acme", 4)] = True
    df = spark.createDataFrame([("the acme of acme 😀",), ("abc",), ("",)], "t string").coalesce(1)
    assert [r.g for r in df.select(TG._grams({("en", 4): known})(F.lit("acme"), F.col("t")).alias("g")).collect()] == [["enacme"], [], []]
    names = spark.createDataFrame([(0, "acme corp", "ACM", "us", "en", "Acme"), (1, "鹰", "YIN", "us", "zh", "鹰")],
                                  "turn int, name string, symbol string, market string, script string, shown string")
    events = spark.createDataFrame([(1, "鹰 Acme", "Corp"), (2, "a", "acme inc"), (3, None, None)], "id long, title_zh string, title_en string")
    got = sorted((r.id, r.symbol) for r in TG.title_entities(events, names).select("id", "entity.symbol").collect())
    assert got == [(1, "ACM"), (1, "YIN")]


def test_breaking_texts_are_read_once(spark):
    from newsrank.operators import verify as V

    titles = ["BREAKING: x", "Just In now", "breakingnews", "heartbreaking", "plain", "突发 y", None, "two Minutes Ago"]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(titles)], "id long, title_en string, title_zh string").selectExpr(
        "*", "'' AS description_short_zh", "TIMESTAMP_NTZ'2024-01-10 00:00:00' AS time_event", "'' AS event_date",
        "array(named_struct('type', 'rss')) AS sources")
    out = V.time_consistency(df, "2024-01-20 00:00:00")
    assert set(out.columns) == {*df.columns, "time_score", "time_flags"}
    assert {r.id for r in out.collect() if r.time_flags} == {0, 1, 5, 7}
    plan = out.select("id", "time_score", "time_flags")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\bmoments ago\b") == 1

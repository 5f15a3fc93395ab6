"""Event-study panel: holders by day and coin, with shock levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def cohort_sample(holdings: DataFrame, modulus: int = 300, min_usd: float = 100.0, key: Column | None = None) -> DataFrame:
    """Distinct users holding enough of a coin, one in ``modulus`` by the hash of the user."""
    h = key if key is not None else F.xxhash64("user_id")
    return holdings.where((F.col("usd") >= min_usd) & (F.col("qty") > 0) & (F.pmod(F.abs(h), F.lit(modulus)) == 0)).select(
        "user_id").distinct()


def behaviour_panel(log: DataFrame, cohort: DataFrame, orders: list[str], views: list[str], exposures: list[str]) -> DataFrame:
    """Counts of orders, views and exposures before and after noon, by day, coin and cohort user."""
    kinds = {"ord": orders, "view": views, "exp": exposures}
    rows = log.where(F.col("event_type").isin(*orders, *views, *exposures)).join(cohort, "user_id", "left_semi")
    cells = [F.count_if(F.col("event_type").isin(*events) & (F.col("hr") < 12 if half == "am" else F.col("hr") >= 12))
             .alias(f"{half}_{name}") for name, events in kinds.items() for half in ("am", "pm")]
    return rows.groupBy("day", "coin", "user_id").agg(*cells)


def shock_levels(ranges: DataFrame, days: int = 30) -> DataFrame:
    """Shock 0, 1, 2 of each coin and day against the 80th and 95th percentile of the days before."""
    past = Window.partitionBy("coin").orderBy("day").rowsBetween(-days, -1)
    p80, p95 = (F.percentile("rng", F.lit(q)).over(past) for q in (0.80, 0.95))
    r = ranges.withColumn("p80", p80).withColumn("p95", p95).where("p80 IS NOT NULL")
    return r.withColumn("shock", F.when(F.col("rng") > F.col("p95"), 2).when(F.col("rng") > F.col("p80"), 1).otherwise(0))


#: Rows (days by coins) up to which a shock table is shipped to all executors: a few megabytes.
SHIPPED_ROWS = 100_000


def with_shocks(holders: DataFrame, shocks: DataFrame, salts: int = 64, shipped_rows: int = SHIPPED_ROWS) -> DataFrame:
    """Every holder of a coin beside every labelled day of that coin.

    A shock table of at most ``shipped_rows`` rows is broadcast. Beyond that both sides are joined on coin and salt: a coin's
    holders are dealt into ``salts`` parts by user and its days are sent to each, so a coin that holds a third of all rows
    is the work of many tasks.
    """
    shocks = cut_lineage(shocks)
    if shocks.count() <= shipped_rows:
        return holders.join(F.broadcast(shocks), "coin")
    dealt = holders.withColumn("_salt", F.pmod(F.xxhash64("user_id"), F.lit(salts)))
    spread = shocks.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(spread, ["coin", "_salt"]).drop("_salt")


def balanced_panel(holders: DataFrame, shocks: DataFrame, behaviour: DataFrame, **spread) -> DataFrame:
    """Every holder of a coin on every labelled day of that coin, with zero for no behaviour.

    ``spread`` goes to ``with_shocks``; the holders of one coin are never collected.
    """
    cells = [c for c in behaviour.columns if c.startswith(("am_", "pm_"))]
    j = with_shocks(holders, shocks, **spread).join(behaviour, ["user_id", "coin", "day"], "left").na.fill(0, cells)
    return j.withColumn("viewed", (F.col("am_view") + F.col("pm_view") > 0).cast("int")).withColumn(
        "traded", (F.col("am_ord") + F.col("pm_ord") > 0).cast("int")).withColumn(
        "active", ((F.col("viewed") + F.col("traded")) > 0).cast("int"))


def _pct(flag: str, digits: int = 3) -> Column:
    return F.round(F.avg(F.col(flag)) * 100, digits)


def rates_by_shock(panel: DataFrame) -> DataFrame:
    return panel.groupBy("shock").agg(F.count("*").alias("n"), _pct("viewed").alias("p_view"), _pct("traded").alias("p_trade"))


def dose_response(panel: DataFrame, edges=(0, 1, 2, 3, 5, 10, 99)) -> DataFrame:
    bin_ = F.lit(None).cast("string")
    for lo, hi in zip(edges, edges[1:]):
        bin_ = F.when((F.col("rng") >= lo) & (F.col("rng") < hi), f"{lo}-{hi}").otherwise(bin_)
    return panel.withColumn("bin", bin_).where("bin IS NOT NULL").groupBy("bin").agg(
        F.count("*").alias("n"), _pct("viewed").alias("p_view"), _pct("traded").alias("p_trade"))


def segment_lift(panel: DataFrame, segment: Column) -> DataFrame:
    """View and trade rates on calm and extreme days by segment, their difference and ratio."""
    seg = panel.withColumn("segment", segment).where("segment IS NOT NULL")
    rate = lambda flag, level: F.coalesce(F.avg(F.when(F.col("shock") == level, F.col(flag))) * 100, F.lit(0.0))
    g = seg.groupBy("segment").agg(F.count_if(F.col("shock") == 0).alias("n_base"), rate("viewed", 0).alias("v0"),
                                   rate("viewed", 2).alias("v2"), rate("traded", 0).alias("t0"), rate("traded", 2).alias("t2"))
    return g.select("segment", "n_base", F.round("v0", 2).alias("view0"), F.round("v2", 2).alias("view2"),
                    F.round(F.col("v2") - F.col("v0"), 2).alias("lift_view"), F.round(F.try_divide("v2", "v0"), 2).alias("ratio_view"),
                    F.round("t0", 2).alias("trade0"), F.round("t2", 2).alias("trade2"),
                    F.round(F.col("t2") - F.col("t0"), 2).alias("lift_trade"), F.round(F.try_divide("t2", "t0"), 2).alias("ratio_trade"))


def half_day_rates(panel: DataFrame, day: str) -> DataFrame:
    """Half-day rates of the calm days and of one named day."""
    part = F.array_compact(F.array(F.when(F.col("shock") == 0, F.lit("normal")),
                                   F.when(F.col("day") == F.lit(day).cast("date"), F.lit("day"))))
    rows = panel.withColumn("part", F.explode(part))
    hit = lambda c: F.round(F.avg((F.col(c) > 0).cast("int")) * 100, 3)
    return rows.groupBy("part").agg(F.count("*").alias("n"), *[hit(f"{h}_{k}").alias(f"{h}_{k}")
                                                               for k in ("view", "ord", "exp") for h in ("am", "pm")])


def user_uplift(panel: DataFrame) -> DataFrame:
    """Active rate on extreme days minus calm days of each user with enough of both."""
    days = lambda level: F.count_if(F.col("shock") == level)
    rate = lambda level: F.avg(F.when(F.col("shock") == level, F.col("active")))
    g = panel.groupBy("user_id").agg(days(2).alias("n2"), days(0).alias("n0"), rate(2).alias("r2"), rate(0).alias("base"))
    up = g.where("n2 >= 1 AND n0 >= 10").withColumn("uplift", F.col("r2") - F.col("base"))
    u = F.col("uplift")
    cls = F.when(u > 0.30, "sensitive").when(u > 0, "mild").otherwise("flat")
    bin_ = (F.when(u < -0.10, "<-10%").when(u < 0, "-10~0%").when(u == 0, "0%").when(u <= 0.10, "0~10%").when(u <= 0.30, "10~30%")
            .when(u <= 0.60, "30~60%").otherwise(">60%"))
    return up.select("user_id", "base", "uplift", cls.alias("class"), bin_.alias("bin"))


def class_profile(uplift: DataFrame, users: DataFrame) -> DataFrame:
    """Median holdings, base rate and coin count of each class."""
    j = uplift.join(users, "user_id")
    return j.groupBy("class").agg(F.count("*").alias("n"), F.round(F.percentile("total", F.lit(0.5)), 0).alias("med_total"),
                                  F.round(F.percentile("base", F.lit(0.5)) * 100, 1).alias("med_base"),
                                  F.percentile("ncoin", F.lit(0.5)).alias("med_ncoin"))


def coin_day(panel: DataFrame, day: str) -> DataFrame:
    """Rates of each coin on one day against its calm days."""
    this = F.col("day") == F.lit(day).cast("date")
    calm = ~this & (F.col("shock") == 0)
    rate = lambda flag, cond: F.round(F.avg(F.when(cond, F.col(flag))) * 100, 2)
    return panel.groupBy("coin").agg(F.countDistinct("user_id").alias("holders"), rate("viewed", calm).alias("view0"),
                                     rate("viewed", this).alias("view1"), rate("traded", calm).alias("trade0"),
                                     rate("traded", this).alias("trade1"))

"""Scoring factors as Column expressions over one event row."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dictionaries as D
from .percent import joined, title_move
from .text import clamp, lookup
from .times import hours_between


def impact(raw: Column, tier: Column) -> Column:
    """Impact held inside the bounds of its tier; a missing score is 0.5, a missing tier is C."""
    value = F.coalesce(raw, F.lit(0.5))
    t = F.coalesce(tier, F.lit("C"))
    lo = lookup({k: v[0] for k, v in D.TIER_BOUNDS.items()}, t, 0.0)
    hi = lookup({k: v[1] for k, v in D.TIER_BOUNDS.items()}, t, 1.0)
    return F.greatest(lo, F.least(hi, value))


def timeliness(published: Column, now: Column) -> Column:
    hours = F.greatest(F.lit(0.0), hours_between(now, published))
    decayed = F.exp(-hours * F.lit(math.log(2) / D.TIMELINESS_HALFLIFE_HOURS))
    return F.when(published.isNull(), 0.5).otherwise(decayed)


def hotness(social: Column, source_count: Column, baseline: Column) -> Column:
    s = F.greatest(F.lit(0), F.coalesce(social, F.lit(0)))
    n = F.greatest(F.lit(1), F.coalesce(source_count, F.lit(1)))
    social_part = clamp(F.log10(s + F.lit(1.0)) / F.log10(baseline + F.lit(1.0)))
    return clamp(F.lit(0.6) * social_part + F.lit(0.4) * F.least(n / F.lit(float(D.HOTNESS_SOURCE_CAP)), F.lit(1.0)))


def authority(raw: Column, is_rumor: Column, status: Column) -> Column:
    base = clamp(F.coalesce(raw, F.lit(0.5)))
    rumor = F.when(F.coalesce(is_rumor, F.lit(False)), F.lit(0.7)).otherwise(F.lit(1.0))
    return clamp(base * rumor * lookup(D.STATUS_MULTIPLIER, F.coalesce(status, F.lit("")), 1.0))


def quality(raw: Column) -> Column:
    return clamp(F.coalesce(raw, F.lit(0.5)))


def breadth(level: Column) -> Column:
    return lookup(D.BREADTH_VALUES, F.coalesce(level, F.lit("")), D.BREADTH_VALUES["single_asset"])


def magnitude_band(pct: Column, text: Column) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    extreme = F.lit(False)
    for word in D.EXTREME_WORDS:
        extreme |= F.contains(lowered, F.lit(word))
    return (F.when(extreme, 1.0)
            .when(pct >= 15, 1.0).when(pct >= 8, 0.75).when(pct >= 4, 0.55).when(pct >= 2, 0.35)
            .otherwise(0.10))


def resonance(sources: Column) -> Column:
    """How many editorial sources of authority 4 and above report the event."""
    media = F.filter(sources, lambda s: ~F.coalesce(s["type"], F.lit("")).isin(*D.NON_MEDIA_TYPES)
                     & (F.coalesce(s["authority"], F.lit(0)) >= 4))
    n = F.coalesce(F.size(media), F.lit(0))
    top = F.coalesce(F.exists(media, lambda s: s["authority"] >= 5), F.lit(False))
    return F.when(n >= 3, 1.0).when(n == 2, 0.65).when(top, 0.45).otherwise(0.15)


def punch_pct(price_move: Column | None, title_zh: Column, title_en: Column, description: Column) -> Column:
    """The judged price move where there is one, else the move read from the titles."""
    by_text = title_move(title_zh, title_en, description)
    if price_move is None:
        return by_text
    judged = F.when(F.coalesce(price_move["is_price_move"], F.lit(False))
                    & (F.coalesce(price_move["move_horizon"], F.lit("")) != "long_term"),
                    F.abs(price_move["move_pct"]))
    return F.when(price_move.isNotNull() & price_move["is_price_move"].isNotNull(), judged).otherwise(by_text)


def punch(pct: Column, title_zh: Column, title_en: Column, description: Column, sources: Column) -> Column:
    text = joined(title_zh, title_en, description)
    return clamp(F.lit(0.65) * magnitude_band(pct, text) + F.lit(0.35) * resonance(sources))


def weighted_total(factors: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    weights = weights or D.FACTOR_WEIGHTS
    total = F.lit(0.0)
    for key, weight in weights.items():
        total = total + F.lit(weight) * factors[key]
    return total


def market_weight(scope: Column, breadth_level: Column, weights: dict[str, float] | None = None) -> Column:
    base = lookup({**D.MARKET_WEIGHTS, **(weights or {})}, F.coalesce(scope, F.lit("")), D.MARKET_DEFAULT)
    return F.when(breadth_level == "cross_market", F.greatest(base, F.lit(D.CROSS_MARKET_FLOOR))).otherwise(base)


def freshness(event_time: Column, now: Column) -> Column:
    hours = hours_between(now, event_time)
    decayed = F.exp(-hours * F.lit(math.log(2) / D.FRESHNESS_HALFLIFE_HOURS))
    return F.when(hours > 0, F.greatest(F.lit(D.FRESHNESS_FLOOR), F.least(F.lit(1.0), decayed))).otherwise(1.0)

"""Signals as columns, and the fixed catalogs of strategies."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F

from ..config import KEYS
from ..functions.scalars import flag, shifted_weekday
from . import features, frames


def next_weekday(w: WindowSpec, hours: Column | int = 0) -> Column:
    """The weekday of the next bar, its time moved by ``hours``."""
    return F.lead(shifted_weekday(F.col("open_time_utc"), hours)).over(w)


def long_weekday(w: WindowSpec, day: Column | int, hours: Column | int = 0) -> Column:
    """In the market during bars of weekday ``day``: the signal stands on the bar before."""
    return flag(next_weekday(w, hours) == day)


def avoid_weekday(w: WindowSpec, day: Column | int, hours: Column | int = 0) -> Column:
    """Out of the market during bars of weekday ``day``; the last bar, without a next, is in."""
    return F.lit(1.0) - long_weekday(w, day, hours)


def long_hour(w: WindowSpec, hour: int) -> Column:
    return flag(F.lead(F.hour("open_time_utc")).over(w) == hour)


def avoid_contraction(w: WindowSpec) -> Column:
    return flag(~F.col("low_range_contraction"))


def buy_and_hold(w: WindowSpec) -> Column:
    return F.lit(1.0)


def no_trade(w: WindowSpec) -> Column:
    return F.lit(0.0)


def sma_cross(fast: int = 20, slow: int = 100) -> Callable[[WindowSpec], Column]:
    if not 0 < fast < slow:
        raise ValueError("the fast window must be positive and below the slow one")

    def signal(w: WindowSpec) -> Column:
        means = [frames.full(F.avg("close"), F.col("close"), frames.rolling(w, n), n) for n in (fast, slow)]
        return flag(means[0] > means[1])

    return signal


@dataclass(frozen=True)
class Strategy:
    """A named rule: a function of the window that gives the signal, and the rows it reaches."""

    strategy_id: str
    rule: str
    signal: Callable[[WindowSpec], Column]
    back: int = 0
    ahead: int = 1
    needs_contraction: bool = False


#: Hypotheses of the strategy lab; weekdays count from Monday, 0.
CATALOG = (
    Strategy("S2_H1_TUESDAY_24H_LONG", "long on Tuesdays", lambda w: long_weekday(w, 1)),
    Strategy("S2_H2_WEDNESDAY_LONG", "long on Wednesdays", lambda w: long_weekday(w, 2)),
    Strategy("S2_H3_HOUR21_LONG", "long in the bar of 21:00", lambda w: long_hour(w, 21)),
    Strategy("S2_H4_AVOID_THURSDAY", "long but on Thursdays", lambda w: avoid_weekday(w, 3)),
    Strategy("S2_H5_AVOID_LOW_RANGE_CONTRACTION", "long but after a narrow range", avoid_contraction, needs_contraction=True),
    Strategy(
        "S2_H6_AVOID_THU_AND_CONTRACTION",
        "long but on Thursdays and after a narrow range",
        lambda w: avoid_weekday(w, 3) * avoid_contraction(w),
        needs_contraction=True,
    ),
)
BASELINES = (
    Strategy("BUY_AND_HOLD", "always long", buy_and_hold),
    Strategy("NO_TRADE", "never long", no_trade),
    Strategy("SMA_CROSS_20_100", "long while the fast mean is above the slow one", sma_cross(), back=100),
)


def sma_strategy(fast: int = 20, slow: int = 100) -> Strategy:
    return Strategy(f"SMA_CROSS_{fast}_{slow}", "long while the fast mean is above the slow one", sma_cross(fast, slow), back=slow)


#: The two rules that are audited.
AUDITED = tuple(s for s in CATALOG if s.strategy_id in ("S2_H2_WEDNESDAY_LONG", "S2_H4_AVOID_THURSDAY"))
REGISTRY = {s.strategy_id: s for s in (*CATALOG, *BASELINES)}


def build(name: str) -> Strategy:
    if name not in REGISTRY:
        raise ValueError(f"unknown strategy: {name}")
    return REGISTRY[name]


def frozen(spark: SparkSession, table: DataFrame) -> list[Strategy]:
    """The strategies that a table of frozen rules names and the registry can run."""
    names = [r.strategy_id for r in table.select("strategy_id").where(F.col("strategy_id").isin(list(REGISTRY))).distinct().orderBy("strategy_id").collect()]
    return [REGISTRY[n] for n in names]


def catalog_table(spark: SparkSession, strategies: Sequence[Strategy] = CATALOG) -> DataFrame:
    return spark.createDataFrame([(s.strategy_id, s.rule) for s in strategies], "strategy_id string, rule string")


def with_signals(bars: DataFrame, strategies: Sequence[Strategy], keys: Sequence[str] = KEYS, chunk: int | None = None) -> DataFrame:
    """Long form: a row for each bar and strategy, with strategy_id and signal; idx is kept."""
    if any(s.needs_contraction for s in strategies):
        bars = features.range_contraction(bars, keys=keys, chunk=chunk)
    rows = bars if "idx" in bars.columns else frames.indexed(bars, keys)
    names = {f"_s{k}": s for k, s in enumerate(strategies)}
    rows = features.windowed(
        rows, keys, max(s.back for s in strategies), max(s.ahead for s in strategies), [lambda w: {n: s.signal(w) for n, s in names.items()}], chunk
    )
    each = [F.struct(F.lit(s.strategy_id).alias("strategy_id"), F.col(n).alias("signal")) for n, s in names.items()]
    return rows.select("*", F.inline(F.array(*each))).drop(*names)


#: Parameter grids of the four hypotheses, 720 variants in all.
GRIDS = {
    "H1": {
        "lookback": [6, 12, 24, 48],
        "volume_window": [24, 168],
        "volume_z": [0.0, 0.5, 1.0],
        "min_return": [0.0, 0.005, 0.01],
        "use_trend_filter": [False, True],
        "avoid_weekend": [False, True],
    },
    "H2": {
        "lookback": [3, 6, 12, 24],
        "drop_threshold": [0.005, 0.01, 0.02],
        "vol_window": [24, 72, 168],
        "max_vol_quantile": [0.33, 0.50, 0.66],
        "avoid_weekend": [False, True],
    },
    "H3": {
        "breakout_window": [24, 72, 168],
        "volume_window": [24, 168],
        "volume_z": [0.0, 0.5, 1.0, 1.5],
        "trend_sma": [50, 100, 200],
        "avoid_weekend": [False, True],
    },
    "H4": {
        "trend_sma": [50, 100, 200],
        "confirm_return_window": [12, 24, 72, 168],
        "min_confirm_return": [-0.02, 0.0, 0.02],
        "avoid_weekend": [False, True],
    },
}


@dataclass(frozen=True)
class Variant:
    variant_id: str
    hypothesis_id: str
    params_json: str

    @property
    def params(self) -> dict:
        return json.loads(self.params_json)


def variants(grids: dict[str, dict[str, list]] = GRIDS) -> list[Variant]:
    """Every combination of every grid."""
    out = []
    for h, grid in grids.items():
        for k, values in enumerate(itertools.product(*grid.values()), start=1):
            out.append(Variant(f"{h}_{k:04d}", h, json.dumps(dict(zip(grid, values)), sort_keys=True)))
    return out


def variant_table(spark: SparkSession, chosen: Sequence[Variant]) -> DataFrame:
    return spark.createDataFrame([(v.variant_id, v.hypothesis_id, v.params_json) for v in chosen], "variant_id string, hypothesis_id string, params_json string")


def variant_conditions(v: Variant) -> dict[str, Column]:
    """The conditions over ``research_features`` that the variant asks for together, by name.

    Variants share conditions by name; quantiles of the whole sample are columns q_<window>_<q>.
    """
    p = v.params
    above = lambda column, limit: (f"{column}>{limit}", F.col(column) > limit)
    trend = lambda n: (f"close>sma_{n}", F.col("close") > F.col(f"sma_{n}"))
    if v.hypothesis_id == "H1":
        out = [above(f"return_{p['lookback']}h", p["min_return"]), above(f"volume_zscore_{p['volume_window']}h", p["volume_z"])]
        out += [trend(200)] if p["use_trend_filter"] else []
    elif v.hypothesis_id == "H2":
        fall, vol, limit = -abs(p["drop_threshold"]), f"rolling_vol_{p['vol_window']}h", quantile_column(p["vol_window"], p["max_vol_quantile"])
        out = [(f"return_{p['lookback']}h<{fall}", F.col(f"return_{p['lookback']}h") < fall), (f"{vol}<={limit}", F.col(vol) <= F.col(limit))]
    elif v.hypothesis_id == "H3":
        high = f"rolling_high_prev_{p['breakout_window']}h"
        out = [(f"close>{high}", F.col("close") > F.col(high)), above(f"volume_zscore_{p['volume_window']}h", p["volume_z"]), trend(p["trend_sma"])]
    else:
        out = [trend(p["trend_sma"]), above(f"return_{p['confirm_return_window']}h", p["min_confirm_return"])]
    return dict([*out, ("weekday", F.col("is_weekend") == 0)] if p["avoid_weekend"] else out)


def quantile_column(window: int, q: float) -> str:
    return f"q_{window}_{round(q * 100)}"


#: Conditions that one long holds.
BITS = 62


def grid_signals(bars: DataFrame, chosen: Sequence[Variant], keys: Sequence[str] = KEYS, chunk: int | None = None) -> DataFrame:
    """Long form over variants: keys, idx, prices, variant_id, hypothesis_id and signal.

    The features are computed once; a variant adds rows, not passes.
    """
    rows = frames.indexed(bars, keys) if "idx" not in bars.columns else bars
    rows = features.research_features(rows, keys, chunk)
    wanted = sorted({(v.params["vol_window"], v.params["max_vol_quantile"]) for v in chosen if v.hypothesis_id == "H2"})
    if wanted:
        # Full-sample quantiles, as the rule is stated; a row a series.
        limits = rows.groupBy(*keys).agg(*[F.percentile(f"rolling_vol_{w}h", q).alias(quantile_column(w, q)) for w, q in wanted])
        rows = rows.join(limits, list(keys))
    # Each condition is one bit, computed once a bar; a variant is the bits it needs.
    asked = [(v, variant_conditions(v)) for v in chosen]
    named = {name: c for _, conditions in asked for name, c in conditions.items()}
    place = {name: divmod(k, BITS) for k, name in enumerate(named)}
    words = range(-(-len(named) // BITS))
    met = [
        sum((F.when(c, F.lit(1 << place[n][1])).otherwise(F.lit(0).cast("long")) for n, c in named.items() if place[n][0] == w), F.lit(0).cast("long")).alias(f"_met{w}")
        for w in words
    ]
    need = lambda conditions, w: F.lit(sum(1 << place[n][1] for n in conditions if place[n][0] == w)).cast("long").alias(f"_need{w}")
    each = [
        F.struct(F.lit(v.variant_id).alias("variant_id"), F.lit(v.hypothesis_id).alias("hypothesis_id"), *[need(conditions, w) for w in words])
        for v, conditions in asked
    ]
    columns = [*keys, "idx", "open_time_utc", "open", "close"]
    rows = rows.select(*columns, *met).select("*", F.inline(F.array(*each)))
    has = F.lit(True)
    for w in words:
        has = has & (F.col(f"_met{w}").bitwiseAND(F.col(f"_need{w}")) == F.col(f"_need{w}"))
    return rows.select(*columns, "variant_id", "hypothesis_id", flag(has).alias("signal"))

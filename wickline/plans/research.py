"""The research flows end to end: lab, audit and institutional validation, with their reports.

    python -m wickline.plans.research {eda,backtest,lab,grid,patterns,audit} INPUT OUT
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AUDIT_COSTS, INSTITUTIONAL_COSTS, KEYS, BacktestConfig, CrisisConfig, PatternConfig, RegimeConfig
from ..operators import backtest as bt
from ..operators import eda, features, frames, montecarlo, patterns, signals, verdicts
from ..operators import walkforward as wf
from ..operators.drawdowns import drawdown_series, events
from ..session import session
from ..sources import cleaning, readers, sinks

#: The audited rules as (long on the day, day), and the controls they are ranked among.
RULES = {"S2_H2_WEDNESDAY_LONG": (True, 2), "S2_H4_AVOID_THURSDAY": (False, 3)}
FAMILIES = {"S2_H2_WEDNESDAY_LONG": "weekday_long", "S2_H4_AVOID_THURSDAY": "avoid_weekday"}


def grid_lab(bars: DataFrame, variants: Sequence[signals.Variant], config: BacktestConfig = BacktestConfig(), keys: Sequence[str] = KEYS) -> DataFrame:
    """One wide row of metrics for each series and variant, with params_json."""
    by = [*keys, "hypothesis_id", "variant_id"]
    run = bt.backtest(signals.grid_signals(bars, variants, keys), by, config)
    values = [f"strategy_{m}" for m in (*bt.METRICS, "trade_count")] + [f"benchmark_{m}" for m in bt.METRICS]
    wide = bt.wide_metrics(bt.metrics_by_sample(run, by, config), by, values)
    return wide.join(F.broadcast(signals.variant_table(bars.sparkSession, variants)).drop("hypothesis_id"), "variant_id")


def strategy_lab(bars: DataFrame, config: BacktestConfig = BacktestConfig(), keys: Sequence[str] = KEYS, strategies: Sequence[signals.Strategy] = signals.CATALOG) -> dict[str, DataFrame]:
    """Samples, years, resampling and status of fixed strategies."""
    by = [*keys, "strategy_id"]
    run = bt.backtest(signals.with_signals(bars, strategies, keys), by, config)
    samples, years = bt.metrics_by_sample(run, by, config), bt.yearly(run, by, config)
    mc = montecarlo.summary(montecarlo.block_bootstrap(run, by, config), by)
    return {"samples": samples, "years": years, "mc": mc, "status": verdicts.research_status(samples, years, mc, by, config)}


def audit(bars: DataFrame, config: BacktestConfig = BacktestConfig(), keys: Sequence[str] = KEYS) -> dict[str, DataFrame]:
    """Every test of the overfit audit, and its verdict."""
    by = [*keys, "strategy_id"]
    rows = frames.indexed(bars, keys)
    wf.require_windows(rows, config)
    run = bt.backtest(signals.with_signals(rows, signals.AUDITED, keys), by, config)
    tests = wf.frozen_rules(rows, signals.AUDITED, keys, config)
    out = {
        "walk_forward": tests,
        "aggregate": wf.aggregated(tests.where("side = 'test'"), by),
        "costs": wf.cost_stress(rows, signals.AUDITED, keys, AUDIT_COSTS, config),
        "years": wf.yearly_restarted(rows.drop("idx"), signals.AUDITED, keys, config),
        "shifts": wf.timezone_fragility(rows, RULES, keys, config),
        "controls": wf.selection_controls(rows, keys, config),
    }
    drawn = montecarlo.block_bootstrap(run, by, config)
    observed = montecarlo.worse_than_observed(drawn, bt.metrics(run, by, config), by)
    out["mc"] = montecarlo.summary(drawn, by).join(observed, by)
    out["verdict"] = verdicts.audit(out["aggregate"], out["costs"], out["years"], out["mc"], out["shifts"], out["controls"], keys, FAMILIES)
    return out


def institutional(
    bars: DataFrame, audited: DataFrame, config: BacktestConfig = BacktestConfig(), regime: RegimeConfig = RegimeConfig(), crisis: CrisisConfig = CrisisConfig(), keys: Sequence[str] = KEYS
) -> dict[str, DataFrame]:
    """Regimes, institutional costs, ruin and crises, and the verdict behind the audit's gate."""
    by = [*keys, "strategy_id"]
    rows = frames.indexed(bars, keys)
    labelled = features.trend_volatility_regimes(rows, regime, config.annualization_factor, keys)
    _, commission, slippage = INSTITUTIONAL_COSTS[1]
    realistic = config.with_costs(commission, slippage)
    tests = wf.frozen_rules(rows, signals.AUDITED, keys, realistic, sides=("test",))
    run = bt.backtest(signals.with_signals(rows, signals.AUDITED, keys), by, realistic)
    out = {
        "regimes": wf.by_regime(tests, wf.dominant_regimes(labelled, keys, config), keys),
        "costs": wf.cost_stress(rows, signals.AUDITED, keys, INSTITUTIONAL_COSTS, config),
        "mc": montecarlo.summary(montecarlo.block_bootstrap(run, by, realistic), by, crisis),
        "crises": wf.crisis_stress(rows, signals.AUDITED, keys, realistic, crisis),
    }
    out["verdict"] = verdicts.institutional(run.select(*by).distinct(), audited, out["regimes"], out["costs"], out["mc"], out["crises"], keys)
    return out


def pattern_discovery(bars: DataFrame, config: PatternConfig = PatternConfig(), keys: Sequence[str] = KEYS) -> DataFrame:
    rows = features.pattern_features(bars, config, keys)
    intervals = montecarlo.mean_difference_intervals(patterns.conditional_long(rows, config, keys), keys, config)
    return patterns.with_evidence(patterns.pattern_stats(rows, config, keys), intervals, config, keys)


def exploration(bars: DataFrame, annualization: float | None = 8760.0, lags: int = 48, keys: Sequence[str] = KEYS) -> dict[str, DataFrame]:
    rows = features.base_features(bars, keys=keys)
    found = eda.streaks(rows, keys)
    out = {
        "summary": eda.summary(rows, keys, annualization),
        "quantiles": eda.return_quantiles(rows, keys),
        "by_hour": eda.volatility_by_hour(rows, keys),
        "by_weekday": eda.volatility_by_weekday(rows, keys),
        "drawdowns": events(drawdown_series(bars, keys), keys),
        "streaks": found,
        "streak_summary": eda.streak_summary(found, keys),
        "persistence": eda.persistence(rows, keys),
        "autocorrelation": eda.autocorrelation(rows, lags, keys),
        "correlations": eda.correlations(rows, keys),
    }
    out["anomalies"] = eda.anomalies(rows, out["summary"], out["autocorrelation"], out["correlations"], out["drawdowns"], keys)
    return out


def load(spark: SparkSession, path: str, symbol: str, interval: str) -> DataFrame:
    """Standard bars of a file; of rows with one time the last in the file counts."""
    bars = cleaning.normalised_headers(cleaning.ingest_order(readers.read_table(spark, path)))
    chosen = cleaning.choose_time_column(bars)
    bars = bars if chosen == "open_time_utc" else bars.drop("open_time_utc").withColumnRenamed(chosen, "open_time_utc")
    named = bars.withColumns({"symbol": F.lit(symbol), "interval": F.lit(interval)})
    return cleaning.standardize(named, sequence=[cleaning.INGEST]).drop(cleaning.INGEST)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("flow", choices=["eda", "backtest", "lab", "grid", "patterns", "audit"])
    parser.add_argument("input")
    parser.add_argument("out")
    parser.add_argument("--symbol", default="BTCUSDT")
    parser.add_argument("--interval", default="1h")
    parser.add_argument("--strategy", default="SMA_CROSS_20_100", help="a registered name, or SMA_CROSS for the windows given")
    parser.add_argument("--fast-window", type=int, default=20)
    parser.add_argument("--slow-window", type=int, default=100)
    standard = BacktestConfig()
    parser.add_argument("--initial-capital", type=float, default=standard.initial_capital)
    parser.add_argument("--commission-rate", type=float, default=standard.commission_rate)
    parser.add_argument("--slippage-rate", type=float, default=standard.slippage_rate)
    parser.add_argument("--annualization-factor", type=float, default=standard.annualization_factor)
    parser.add_argument("--train-ratio", type=float, default=standard.split_ratio)
    parser.add_argument("--mc-runs", type=int, default=standard.mc_runs)
    parser.add_argument("--min-trades", type=int, default=standard.min_trades)
    parser.add_argument("--random-seed", type=int, default=standard.random_seed)
    args = parser.parse_args(argv)
    spark = session(f"research-{args.flow}")
    config = BacktestConfig(
        initial_capital=args.initial_capital,
        commission_rate=args.commission_rate,
        slippage_rate=args.slippage_rate,
        annualization_factor=args.annualization_factor,
        split_ratio=args.train_ratio,
        mc_runs=args.mc_runs,
        min_trades=args.min_trades,
        random_seed=args.random_seed,
    )
    bars = load(spark, args.input, args.symbol, args.interval)
    if args.flow == "eda":
        tables = exploration(bars)
    elif args.flow == "backtest":
        by = [*KEYS, "strategy_id"]
        chosen = signals.sma_strategy(args.fast_window, args.slow_window) if args.strategy == "SMA_CROSS" else signals.build(args.strategy)
        run = bt.backtest(signals.with_signals(bars, [chosen]), by, config, whole_positions=True)
        tables = {
            "metrics": wf.samples_restarted(bars, [chosen], KEYS, config),
            "buy_hold": bt.trade_metrics(bt.buy_hold_trade(run, by, config), by, "buy_hold"),
            "trades": bt.trades(run, by, config),
            "equity": run,
        }
    elif args.flow == "lab":
        tables = strategy_lab(bars, config)
    elif args.flow == "grid":
        wide = grid_lab(bars, signals.variants(), config)
        best, flags = verdicts.leaderboard(wide, KEYS, config.min_trades), verdicts.overfit_flags(wide, config.min_trades)
        tables = {
            "metrics": wide,
            "leaderboard": best,
            "overfit_flags": flags,
            "candidates": verdicts.on_leaderboard(flags, best, [*KEYS, "variant_id"]),
            "sensitivity": verdicts.parameter_sensitivity(wide, KEYS),
        }
    elif args.flow == "patterns":
        tables = {"patterns": pattern_discovery(bars)}
    else:
        tables = audit(bars, config)
        tables["institutional"] = institutional(bars, tables["verdict"], config)["verdict"]
    for name, table in tables.items():
        sinks.write_csv(table, f"{args.out}/{name}")
    sinks.write_json(spark, f"{args.out}/metadata.json", {"flow": args.flow, "input": args.input, "config": asdict(config)})
    sinks.report(spark, f"{args.out}/report.md", f"{args.flow} {args.symbol} {args.interval}", list(tables.items()))
    return 0


if __name__ == "__main__":
    sys.exit(main())

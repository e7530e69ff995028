"""Bars: cleaning, checks, features, backtests and what is built on them, on small frames."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wickline.config import KEYS, BacktestConfig, CrisisConfig, QualityConfig
from wickline.functions import scalars
from wickline.operators import backtest as bt
from wickline.operators import checks, drawdowns, eda, features, frames, montecarlo, signals, verdicts
from wickline.operators import walkforward as wf
from wickline.sources import cleaning, readers, sinks

K = list(KEYS)
DDL = "symbol string, interval string, open_time_utc timestamp, open double, high double, low double, close double, volume double"
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def bars(n=100, seed=42, symbol="AAA", step=1):
    rng = random.Random(seed)
    price, out = 40_000.0, []
    for i in range(n):
        o = price
        c = o + rng.gauss(0, 50)
        out.append((symbol, "1h", T0 + dt.timedelta(hours=i * step), o, max(o, c) + rng.random() * 20, min(o, c) - rng.random() * 20, c, rng.uniform(100, 500)))
        price = c + rng.gauss(0, 10)
    return out


@pytest.fixture(scope="module")
def clean(spark):
    return spark.createDataFrame(bars() + bars(seed=7, symbol="BBB"), DDL).repartition(3).cache()


def pdf(df, *order):
    return df.orderBy(*(order or ("symbol", "open_time_utc"))).toPandas()


# ------------------------------------------------------------ scalars and sources


@pytest.mark.parametrize("text,value", [("1h", 8760), ("4h", 2190), ("15m", 35040), ("1s", 31536000), ("1d", 365), ("1w", 52.1775), ("1mo", 12), ("x", None), ("0h", None)])
def test_bars_a_year(text, value):
    assert scalars.bars_a_year(text) == value


def test_formats_and_json(spark):
    row = spark.range(1).select(
        scalars.formatted_percent(F.lit(0.12345)).alias("p"),
        scalars.formatted_percent(F.lit(None).cast("double")).alias("none"),
        scalars.formatted_number(F.lit(1234.5678), 2).alias("n"),
        scalars.params_json(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2))).alias("j"),
        scalars.divide(F.lit(1.0), F.lit(0.0)).alias("d"),
        scalars.clipped(F.lit(None).cast("double")).alias("c"),
        scalars.finite(F.lit(float("nan"))).alias("f"),
    ).first()
    assert (row.p, row.none, row.n, row.j, row.d, row.c, row.f) == ("12.35%", "N/A", "1,234.57", '{"a":2,"b":1}', None, 0.0, None)


def test_epochs_of_any_unit(spark):
    want = dt.datetime(2024, 3, 1, 12, tzinfo=dt.timezone.utc)
    s = int(want.timestamp())
    rows = spark.createDataFrame([(str(s),), (str(s * 10**3),), (str(s * 10**6),), (str(s * 10**9),), ("2024-03-01 12:00:00",), ("junk",), (None,)], "t string")
    got = [r.x for r in rows.select(cleaning.parsed_time(rows, "t").alias("x")).collect()]
    assert [None if x is None else x.replace(tzinfo=None) for x in got] == [want.replace(tzinfo=None)] * 5 + [None, None]


def test_standardize(spark):
    rows = [("AAA", "1h", "2024-01-01 00:00:00", "1", "2", "0.5", "1.5", "10"), ("AAA", "1h", "2024-01-01 00:00:00", "3", "4", "2.5", "3.5", "20"), ("AAA", "1h", "2024-01-01 01:00:00", "bad", "2", "1", "1", "1")]
    raw = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq int, symbol string, interval string, ` Timestamp` string, OPEN string, High string, l string, Close string, vol string")
    last = cleaning.standardize(raw, sequence=["seq"]).collect()
    first = cleaning.standardize(raw, keep="first", sequence=["seq"]).collect()
    assert [r.open for r in last] == [3.0] and [r.open for r in first] == [1.0]
    with pytest.raises(ValueError, match="close"):
        cleaning.standardize(raw.drop("Close"))
    assert cleaning.choose_time_column(raw.toDF("seq", "symbol", "interval", "timestamp", "open", "date", "l", "close", "vol")) == "timestamp"


def test_guards(spark, clean):
    assert cleaning.guard(clean, 100) is clean
    with pytest.raises(ValueError, match="fewer"):
        cleaning.guard(clean, 1000)
    with pytest.raises(ValueError, match="price"):
        cleaning.guard(clean.withColumn("open", F.lit(-1.0)), 1)


def test_files(spark, clean, tmp_path):
    root = f"{tmp_path}/lake"
    one = clean.where("symbol = 'AAA'")
    one.coalesce(1).write.parquet(f"{root}/AAA/1h/a.parquet")
    one.withColumn("volume", F.lit(1.0)).coalesce(1).write.parquet(f"{root}/AAA/1h/b.parquet")
    one.drop("close").write.parquet(f"{root}/BAD/1h/x.parquet")
    assert readers.find_newest(spark, root, "AAA").endswith("b.parquet")
    got = readers.load_symbols(spark, root, ["AAA", "BAD", "NONE"])
    assert got.count() == 100 and {r.volume for r in got.collect()} == {1.0}
    with pytest.raises(ValueError):
        readers.read_table(spark, f"{root}/x.json")
    between = readers.klines_between(clean, "AAA", start=T0 + dt.timedelta(hours=5), end=T0 + dt.timedelta(hours=9))
    assert between.count() == 5
    assert readers.date_and_value_columns(["symbol", "open_time", "nav"]) == ("open_time", "nav")
    assert readers.jdbc_options({"DB_HOST": "h", "DB_PORT": "1", "DB_NAME": "n"})["url"] == "jdbc:postgresql://h:1/n"


def test_upsert_is_idempotent(spark, clean, tmp_path):
    path = f"{tmp_path}/klines"
    sinks.upsert(clean, path)
    newer = clean.where("symbol = 'AAA'").where(F.hour("open_time_utc") < 3).withColumn("close", F.lit(1.0))
    for _ in range(2):
        sinks.upsert(newer, path)
    got = spark.read.parquet(path)
    assert got.count() == 200 and got.where("close = 1.0").count() == newer.count()
    sinks.replace_partitions(newer, path)
    assert spark.read.parquet(path).groupBy("symbol").count().orderBy("symbol").collect()[0]["count"] == newer.count()


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1.5, None)], "x string, y double, z string")
    assert sinks.markdown(df).splitlines()[2] == "| a\\|b | 1.500000 |  |"
    sinks.report(spark, f"{tmp_path}/r.md", "Title", [("One", df), ("Two", "text")])
    text = (tmp_path / "r.md").read_text()
    assert text.startswith("# Title") and "## Two\n\ntext" in text
    sinks.write_json(spark, f"{tmp_path}/r.json", {"a": 1})
    assert '"a": 1' in (tmp_path / "r.json").read_text()
    sinks.write_csv(df, f"{tmp_path}/csv", "%.6f")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").first().y == "1.500000"


# ------------------------------------------------------------ checks


def results(df, **kw):
    return {r.check_name: r for r in checks.validate(df, K, **kw).collect() if r.symbol == "AAA"}


def test_clean_bars_pass(clean):
    assert all(r.severity == "PASS" for r in results(clean).values())


def test_bad_bars_are_found(spark):
    rows = [list(r) for r in bars()]
    rows[5][3] = None
    rows[10][4] = -100.0
    rows[20][4] = rows[20][5] - 1
    rows[30][7] = -1.0
    rows.append(list(rows[0]))
    got = results(spark.createDataFrame(rows, DDL))
    assert got["NULL_CHECK"].failed_rows == 1 and got["OHLC_VALIDITY"].failed_rows == 2
    assert got["NEGATIVE_PRICES"].severity == "FAIL" and got["NEGATIVE_VOLUME"].failed_rows == 1 and got["DUPLICATE_BARS"].failed_rows == 1
    assert "open: 1" in got["NULL_CHECK"].detail and got["RETURN_OUTLIER"].detail.startswith("Column not")


def test_validator(spark):
    rows = bars()
    del rows[40:46]
    rows[10], rows[11] = rows[11], rows[10]
    numbered = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos long, " + DDL)
    v = checks.BarValidator(numbered, order="pos").run_all()
    by = {r["check_name"]: r for r in v.results}
    assert by["TIME_GAPS"]["failed_rows"] == 6 and by["TEMPORAL_ORDER"]["failed_rows"] == 1
    assert v.has_failures and v.summary["PASS"] >= 5 and "TIME_GAPS" in v.to_json()
    assert checks.validate(numbered.limit(0), K).count() == 0
    outlier = numbered.withColumn("open_to_open_return", F.when(F.col("pos") == 50, 5.0).otherwise(0.001 * (F.col("pos") % 3)))
    assert {r.failed_rows for r in checks.validate(outlier, K).where("check_name = 'RETURN_OUTLIER'").collect()} == {1}


# ------------------------------------------------------------ features, in one piece and in chunks


@pytest.mark.parametrize("chunk", [None, 7, 64])
def test_enriched_against_pandas(clean, chunk):
    got = pdf(features.add_features(features.add_returns(clean, K, chunk), K, chunk))
    for _, g in got.groupby("symbol"):
        g = g.reset_index(drop=True)
        r = g.open.shift(-1) / g.open - 1
        np.testing.assert_allclose(g.open_to_open_return, r, rtol=1e-12)
        np.testing.assert_allclose(g.sma_20, g.close.rolling(20).mean(), rtol=1e-12)
        np.testing.assert_allclose(g.rolling_vol_24h, r.rolling(24).std(), rtol=1e-9)
        assert g.next_bar_weekday.iloc[:-1].tolist() == g.open_time_utc.shift(-1).dt.weekday.iloc[:-1].tolist()
        assert math.isnan(g.open_to_open_return.iloc[-1])


def test_chunks_change_nothing(spark, clean):
    whole, parts = (pdf(features.base_features(clean, 24, K, c)) for c in (None, 9))
    pd.testing.assert_frame_equal(whole, parts)
    rows = signals.with_signals(clean, [signals.build("SMA_CROSS_20_100"), signals.build("S2_H2_WEDNESDAY_LONG")], K)
    by = [*K, "strategy_id"]
    one, two = (pdf(bt.backtest(rows, by, chunk=c), "symbol", "strategy_id", "open_time_utc") for c in (None, 11))
    pd.testing.assert_frame_equal(one[sorted(one)], two[sorted(one)])
    spark.conf.set(frames.SETTING, "13")
    try:
        three = pdf(bt.backtest(signals.with_signals(clean, [signals.build("S2_H2_WEDNESDAY_LONG")], K), by), "symbol", "open_time_utc")
        t2 = bt.trades(bt.backtest(rows, by), by).count()
    finally:
        spark.conf.unset(frames.SETTING)
    np.testing.assert_allclose(three.equity, one[one.strategy_id == "S2_H2_WEDNESDAY_LONG"].equity, rtol=1e-12)
    assert t2 == bt.trades(bt.backtest(rows, by), by).count()


def test_daily_and_monthly(clean):
    day = pdf(features.daily_ohlcv(clean, K), "symbol", "trade_date").iloc[0]
    assert day.date_id == 20240101 and day.bars == 24 and day.daily_return == pytest.approx(day.close_price / day.open_price - 1)
    assert pdf(features.monthly_returns(clean, K), "symbol").year_month.tolist() == ["2024-01"] * 2
    assert {r.market_regime for r in features.add_regime(clean, K).collect()} <= {"Bull", "Bear", "Lateral"}


# ------------------------------------------------------------ backtests


def loop_backtest(opens, signal, cost):
    equity, position, out = 10_000.0, 0.0, []
    for i in range(len(opens) - 1):
        target = signal[i - 1] if i else 0.0
        r = target * (opens[i + 1] / opens[i] - 1) - abs(target - position) * cost
        position, equity = target, equity * (1 + r)
        out.append((target, r, equity))
    return out


def test_backtest_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(*r, float(rng.random() < 0.4)) for r in bars(80)]
    df = spark.createDataFrame(rows, DDL + ", signal double")
    got = pdf(bt.backtest(df, K))
    want = loop_backtest([r[3] for r in rows], [r[8] for r in rows], 0.0015)
    np.testing.assert_allclose(got[["position", "strategy_return", "equity"]].to_numpy(), np.array(want), rtol=1e-10)
    m = bt.metrics(bt.backtest(df, K), K).first()
    assert m.strategy_max_drawdown == pytest.approx((got.equity / got.equity.cummax() - 1).min())
    assert m.strategy_sharpe == pytest.approx(got.strategy_return.mean() / got.strategy_return.std() * math.sqrt(8760))
    assert m.benchmark_final_equity == pytest.approx(10_000 * rows[-1][3] / rows[0][3])
    pos, trades, entry = got.position.tolist(), [], None
    for i, p in enumerate(pos):
        if p > 0 and (i == 0 or pos[i - 1] <= 0):
            entry = i
        if entry is not None and (p <= 0 or i == len(pos) - 1):
            trades.append((entry, i, got.open[i] / got.open[entry] - 1 - 0.003))
            entry = None if p <= 0 else entry
    found = pdf(bt.trades(bt.backtest(df, K), K), "entry_time")
    assert len(found) == len(trades)
    np.testing.assert_allclose(found.net_return, [t[2] for t in trades], rtol=1e-9)
    assert found.bars_held.tolist() == [b - a for a, b, _ in trades]


def test_no_trade_and_costs(clean):
    flat = bt.evaluate(clean.withColumn("signal", F.lit(0.0)), K).collect()
    assert all(r.strategy_final_equity == 10_000 and r.strategy_sharpe is None and r.strategy_trade_count == 0 for r in flat)
    rows = signals.with_signals(clean, [signals.build("S2_H4_AVOID_THURSDAY")], K)
    cheap, dear = (bt.metrics(bt.backtest(rows, K, BacktestConfig(commission_rate=c)), K).orderBy("symbol").collect() for c in (0.0, 0.01))
    assert all(a.strategy_total_return > b.strategy_total_return for a, b in zip(cheap, dear))


def test_errors(clean):
    with pytest.raises(Exception, match="0 or 1"):
        bt.backtest(clean.withColumn("signal", F.lit(0.5)), K, whole_positions=True).collect()
    with pytest.raises(Exception, match="loses all"):
        bt.backtest(clean.withColumns({"signal": F.lit(1.0), "open": F.when(F.hour("open_time_utc") == 5, 1e9).otherwise(1.0)}), K, BacktestConfig(commission_rate=2.0)).collect()
    with pytest.raises(ValueError, match="needs"):
        wf.require_windows(frames.indexed(clean, K), BacktestConfig())
    with pytest.raises(ValueError):
        signals.sma_cross(50, 20)
    with pytest.raises(ValueError):
        signals.build("NONE")


def test_windows_match_membership(spark):
    c = BacktestConfig(train_bars=10, purge_bars=2, test_bars=5, step_bars=4)
    got = wf.windows(spark.createDataFrame([("a", 40), ("b", 16), ("c", 17)], "symbol string, n long"), c).orderBy("symbol", "window_id").collect()
    want, start = [], 0
    while start + 17 <= 40:
        want.append(("a", len(want) + 1, start, start + 10, start + 12, start + 17))
        start += 4
    assert [tuple(r) for r in got] == want + [("c", 1, 0, 10, 12, 17)]
    rows = spark.createDataFrame([("a", i, 40) for i in range(40)], "symbol string, idx long, n long")
    inside = {(r.window_id, r.side, r.idx) for r in wf.members(rows, c).collect()}
    assert inside == {(w, s, i) for _, w, a, b, d, e in want for s, lo, hi in (("train", a, b), ("test", d, e)) for i in range(lo, hi)}


def test_drawdowns_by_hand(spark):
    closes = [10, 11, 9, 8, 11, 12, 10, 13, 12]
    rows = [("AAA", "1h", T0 + dt.timedelta(hours=i), float(c)) for i, c in enumerate(closes)]
    series = drawdowns.drawdown_series(spark.createDataFrame(rows, "symbol string, interval string, open_time_utc timestamp, close double"), K)
    ev = drawdowns.events(series, K).orderBy("peak_time_utc").collect()
    assert [(r.peak_close, r.trough_close, r.recovered, r.duration_hours_peak_to_recovery) for r in ev] == [(11, 8, True, 3), (12, 10, True, 2), (13, 12, False, 1)]
    ep = drawdowns.episodes(series, K).orderBy("start_idx").collect()
    assert [(r.start_idx, r.trough_idx, r.end_idx) for r in ep] == [(2, 3, 4), (6, 6, 7), (8, 8, 8)]


def test_eda_against_pandas(clean):
    base = features.base_features(clean, 24, K).cache()
    p = base.where("symbol = 'AAA'").orderBy("open_time_utc").toPandas()
    s = {r.metric: r for r in eda.summary(base, K).where("symbol = 'AAA'").collect()}
    assert s["log_return"]["skew"] == pytest.approx(p.log_return.skew()) and s["volume"].excess_kurtosis == pytest.approx(p.volume.kurt())
    ac = {r.lag: r.autocorrelation for r in eda.autocorrelation(base, 5, K).where("symbol = 'AAA'").collect()}
    for lag in range(1, 6):
        assert ac[lag] == pytest.approx(p.log_return.dropna().autocorr(lag))
    co = {(r.x, r.y): r for r in eda.correlations(base, K).where("symbol = 'AAA'").collect()}
    r = co[("volume", "range_pct")]
    assert r.pearson_correlation == pytest.approx(p.volume.corr(p.range_pct)) and r.spearman_correlation == pytest.approx(p.volume.rank().corr(p.range_pct.rank()))
    assert sum(x["count"] for x in eda.histogram(clean, "close", 10, K).collect()) == 200
    assert eda.fixed_sample(clean, ["symbol", "open_time_utc"], 5).collect() == eda.fixed_sample(clean.repartition(7), ["symbol", "open_time_utc"], 5).collect()


def test_resampling_is_stable(clean):
    idx = montecarlo.block_indices(10, 4, np.random.default_rng(0))
    assert len(idx) == 10 and idx.min() >= 0 and idx.max() < 10 and (np.diff(idx[:4]) == 1).all()
    rows = signals.with_signals(clean, [signals.build("S2_H4_AVOID_THURSDAY")], K)
    run, c = bt.backtest(rows, K), BacktestConfig(mc_runs=60)
    one = montecarlo.block_bootstrap(run, K, c).orderBy("symbol", "mc_run").collect()
    two = montecarlo.block_bootstrap(run.repartition(5), K, c).orderBy("symbol", "mc_run").collect()
    assert one == two and len(one) == 120
    s = montecarlo.summary(montecarlo.block_bootstrap(run, K, c), K, CrisisConfig()).collect()
    assert all(0 <= r.mc_probability_loss <= 1 and r.mc_total_return_p05 <= r.mc_total_return_p95 for r in s)


def test_verdicts(spark):
    row = {f"{s}_{c}": 0.0 for s in ("full", "in_sample", "out_of_sample") for c in ("strategy_total_return", "strategy_sharpe", "strategy_max_drawdown", "benchmark_total_return", "strategy_trade_count")}
    cases = [
        ("REJECT_OVERFIT_RISK", {"in_sample_strategy_total_return": 1.0, "in_sample_strategy_sharpe": 1.0, "out_of_sample_strategy_total_return": -1.0}),
        ("INCONCLUSIVE_LOW_TRADES", {}),
        ("REJECT_OOS_WEAK", {"out_of_sample_strategy_total_return": -0.1, "full_strategy_trade_count": 50.0, "out_of_sample_strategy_trade_count": 20.0}),
        ("INCONCLUSIVE_RISK_TOO_HIGH", {"out_of_sample_strategy_max_drawdown": -0.6, "full_strategy_trade_count": 50.0, "out_of_sample_strategy_trade_count": 20.0}),
        (
            "CANDIDATE_NEEDS_ROBUSTNESS",
            {"out_of_sample_strategy_total_return": 0.2, "out_of_sample_strategy_sharpe": 1.0, "full_strategy_trade_count": 50.0, "out_of_sample_strategy_trade_count": 20.0},
        ),
    ]
    df = spark.createDataFrame(pd.DataFrame([{**row, **c, "want": w} for w, c in cases]))
    assert all(r.research_status == r.want for r in verdicts.overfit_flags(df).collect())
    assert [r.research_status for r in verdicts.overfit_flags(df.limit(1).select(*[F.lit(None).cast("double").alias(c) for c in row])).collect()] == ["INCONCLUSIVE_LOW_TRADES"]


def test_quality_thresholds(spark):
    got = spark.createDataFrame([(0, 10), (1, 1000), (10, 1000), (0, 0)], "f long, t long").select(checks.severity(F.col("f"), F.col("t"), QualityConfig().fail_threshold).alias("s")).collect()
    assert [r.s for r in got] == ["PASS", "WARN", "FAIL", "PASS"]

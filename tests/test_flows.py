"""The entry points, the ETL, the stream and the rule that the engine stands without the llm subpackage."""

import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from wickline import queries
from wickline.plans import etl
from wickline.sources import fixtures
from wickline.streaming import bars as stream

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(queries.oracle_sql()) >= 70


@needs_data
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5


@needs_data
def test_some_queries_equal_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("events", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("backtest_bars", "quality_checks_bad", "features_enriched", "drawdown_events", "time_gaps", "upsert_merge"):
        got, found = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
        order = sorted(got.columns)
        assert order == sorted(found.columns)
        want = sorted(str([r[found.columns.index(c)] for c in order]) for r in found.fetchall())
        assert sorted(str([r[c] for c in order]) for r in got.collect()) == want, name


@needs_data
def test_etl(spark, tmp_path):
    bars = fixtures.hourly(spark, SF)
    for symbol in ("click", "view"):
        rows = bars.where(F.col("symbol") == symbol)
        rows = rows.withColumn("high", F.when(F.hour("open_time_utc") == 4, -1.0).otherwise(F.col("high")))
        rows.coalesce(1).write.parquet(f"{tmp_path}/lake/{symbol}/1h/x.parquet")
    summary = etl.run(spark, f"{tmp_path}/lake", f"{tmp_path}/out", ["click", "view", "none"])
    assert summary["processed"] == ["click", "view"] and summary["failed"] == ["none"] and summary["quarantined"] > 0
    klines = spark.read.parquet(f"{tmp_path}/out/klines")
    assert klines.count() == summary["total_rows"] and "market_regime" in klines.columns
    quality = spark.read.parquet(f"{tmp_path}/out/data_quality")
    assert quality.where("check_name = 'OHLC_VALIDITY' AND severity = 'FAIL'").count() == 2
    assert etl.run(spark, f"{tmp_path}/lake", f"{tmp_path}/out", ["click"], dry_run=True)["total_rows"] > 0


@needs_data
def test_stream_equals_batch(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    shutil.copy(f"{SF}/events.parquet", f"{tmp_path}/in/events.parquet")
    bars = stream.stream_bars(stream.read_events(spark, f"{tmp_path}/in"))
    query = stream.load(bars, f"{tmp_path}/bars", f"{tmp_path}/checkpoint")
    query.awaitTermination()
    got = {(r.symbol, r.open_time_utc): (r.open, r.close, r.trades) for r in spark.read.parquet(f"{tmp_path}/bars").collect()}
    want = {(r.symbol, r.open_time_utc): (r.open, r.close, r.trades) for r in fixtures.hourly(spark, SF, 0.0).collect()}
    assert got and all(want[k] == v for k, v in got.items())
    assert len(want) - len(got) <= 10


def test_engine_without_llm(tmp_path):
    """Import and registry work when the llm folders and the pipeline are gone."""
    copy = f"{tmp_path}/repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op') for n in q); print(len(q), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": copy})
    assert done.returncode == 0, done.stderr[-500:]


@needs_data
def test_etl_keeps_the_last_row_of_a_file_and_checks_the_order(spark, tmp_path):
    bars = fixtures.hourly(spark, SF).where("symbol = 'click'").orderBy("open_time_utc").limit(60).coalesce(1)
    first = bars.first()
    lower = [{**first.asDict(), "open": first.low, "close": first.low}]
    spark.createDataFrame(bars.collect() + [tuple(lower[0][c] for c in bars.columns)], bars.schema).coalesce(1).write.parquet(f"{tmp_path}/lake/click/1h/x.parquet")
    etl.run(spark, f"{tmp_path}/lake", f"{tmp_path}/out", ["click"])
    kept = spark.read.parquet(f"{tmp_path}/out/klines").orderBy("open_time_utc").first()
    assert (float(kept.open), float(kept.close)) == (first.low, first.low)
    quality = spark.read.parquet(f"{tmp_path}/out/data_quality")
    assert quality.where("check_name = 'TEMPORAL_ORDER'").first().failed_rows == 1
    assert quality.select("check_name").distinct().count() == 7

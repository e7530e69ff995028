"""Ingest, validate, transform and load, in one lazy plan for all symbols.

    python -m wickline.plans.etl ROOT OUT --symbols A B --interval 1h [--dry-run] [--quality-report]
"""

from __future__ import annotations

import argparse
import logging
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import KEYS
from ..operators import checks, features
from ..schemas import ENRICHED, KLINES_KEY, PRICES, valid_bar
from ..session import session
from ..sources import cleaning, readers, sinks

log = logging.getLogger(__name__)
#: Columns that the klines table takes, of those there are.
KLINES_COLUMNS = (
    "symbol",
    "interval",
    "open_time_utc",
    "close_time_utc",
    *PRICES,
    "volume",
    "quote_asset_volume",
    "number_of_trades",
    "taker_buy_base_asset_volume",
    "taker_buy_quote_asset_volume",
    *ENRICHED,
)


def enriched(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid bars transformed, and the rows that break a constraint; one bad row doesn't stop its symbol.

    Of rows with one key the last in the file counts, so a correction further
    down replaces what it corrects.
    """
    marked = bars.withColumn("_ok", valid_bar())
    order = [cleaning.INGEST] if cleaning.INGEST in bars.columns else [c for c in bars.columns if c not in KLINES_KEY]
    good = cleaning.deduplicated(marked.where("_ok").drop("_ok"), list(KLINES_KEY), order).drop(cleaning.INGEST)
    return features.transform(good), marked.where("NOT _ok").drop("_ok", cleaning.INGEST)


def run(spark: SparkSession, root: str, out: str, symbols: list[str], interval: str = "1h", dry_run: bool = False, quality_report: bool = False) -> dict:
    """A summary {processed, failed, total_rows, quarantined}; failures of checks don't stop the load."""
    began = time.time()
    bars = readers.load_symbols(spark, root, symbols, interval, ordered=True)
    there = [r.symbol for r in bars.select("symbol").distinct().collect()]
    summary = {"processed": sorted(there), "failed": sorted(set(symbols) - set(there)), "total_rows": 0, "quarantined": 0}
    if not there:
        return summary
    quality = checks.validate(bars, order=cleaning.INGEST if cleaning.INGEST in bars.columns else None)
    if quality_report:
        print(checks.quality_report(bars))
    good, bad = enriched(bars)
    summary["quarantined"] = bad.count()
    klines = good.select(*[c for c in KLINES_COLUMNS if c in good.columns])
    if dry_run:
        summary["total_rows"] = klines.count()
    else:
        summary["total_rows"] = sinks.upsert(klines, f"{out}/klines")
        sinks.replace_partitions(quality.withColumn("run_at", F.current_timestamp()), f"{out}/data_quality", KEYS)
        sinks.write_json(spark, f"{out}/run.json", summary)
    log.info("done in %.1f s: %s", time.time() - began, summary)
    return summary


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("root")
    parser.add_argument("out")
    parser.add_argument("--symbols", nargs="+", required=True)
    parser.add_argument("--interval", default="1h")
    parser.add_argument("--dry-run", action="store_true")
    parser.add_argument("--quality-report", action="store_true")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    summary = run(session("etl"), args.root, args.out, args.symbols, args.interval, args.dry_run, args.quality_report)
    return 0 if not summary["failed"] else 1


if __name__ == "__main__":
    sys.exit(main())

"""Data-quality checks: one aggregate over the bars, unfolded to a row a check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import KEYS, QualityConfig
from ..schemas import PRICES
from . import frames

#: Columns of a result besides the keys.
RESULT = ("check_name", "severity", "total_rows", "passed_rows", "failed_rows", "pass_rate", "detail")


def severity(failed: Column, total: Column, fail_threshold: Column | float) -> Column:
    """PASS without failures, FAIL from the threshold's share on, else WARN."""
    limit = F.lit(fail_threshold) if isinstance(fail_threshold, float) else fail_threshold
    return F.when(failed == 0, "PASS").when(F.try_divide(failed, total) >= limit, "FAIL").otherwise("WARN")


def null_bar() -> Column:
    out = F.col("open_time_utc").isNull() | F.col("volume").isNull()
    for c in PRICES:
        out = out | F.col(c).isNull()
    return out


def broken_ohlc() -> Column:
    """high below, or low above, another price; nulls are passed over."""
    return F.coalesce(
        (F.col("high") < F.greatest("open", "close"))
        | (F.col("low") > F.least("open", "close"))
        | (F.col("high") < F.col("low")),
        F.lit(False),
    )


def negative_price() -> Column:
    return F.coalesce(F.least(*[F.col(c) for c in PRICES]) <= 0, F.lit(False))


def _unfold(counts: DataFrame, keys: Sequence[str], rows: list[tuple[str, Column, Column, float]]) -> DataFrame:
    """(check name, failed, detail, threshold) over columns of ``counts``, which has total."""
    each = [
        F.struct(F.lit(n).alias("check_name"), failed.cast("long").alias("failed_rows"), detail.alias("detail"), F.lit(t).alias("limit"))
        for n, failed, detail, t in rows
    ]
    out = counts.select(*keys, F.col("total").alias("total_rows"), F.inline(F.array(*each)))
    rate = F.when(F.col("total_rows") > 0, F.round((F.col("total_rows") - F.col("failed_rows")) / F.col("total_rows"), 4)).otherwise(0.0)
    return out.select(
        *keys,
        "check_name",
        severity(F.col("failed_rows"), F.col("total_rows"), F.col("limit")).alias("severity"),
        "total_rows",
        (F.col("total_rows") - F.col("failed_rows")).alias("passed_rows"),
        "failed_rows",
        rate.alias("pass_rate"),
        "detail",
    )


def duplicate_counts(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows after the first of each time; null is a time."""
    return bars.groupBy(*keys, "open_time_utc").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.sum(F.col("n") - 1).alias("duplicates"))


def validate(
    bars: DataFrame,
    keys: Sequence[str] = KEYS,
    config: QualityConfig = QualityConfig(),
    order: str | None = None,
    returns: str = "open_to_open_return",
) -> DataFrame:
    """A row for each key and check; no row for an empty table.

    ``order``: the column with the rows' physical order; without it the
    temporal order is not checked.  The outlier check needs the column
    ``returns`` and enough values, else it passes and says why.
    """
    nulls = [c for c in ("open_time_utc", *PRICES, "volume")]
    aggs = [
        F.count("*").alias("total"),
        F.count_if(null_bar()).alias("null_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in nulls],
        F.count_if(broken_ohlc()).alias("ohlc"),
        F.count_if(negative_price()).alias("prices"),
        F.count_if(F.coalesce(F.col("volume") < 0, F.lit(False))).alias("volumes"),
    ]
    has_returns = returns in bars.columns
    if has_returns:
        aggs += [F.avg(returns).alias("mean"), F.stddev_samp(returns).alias("std"), F.count(returns).alias("n_returns")]
    counts = bars.groupBy(*keys).agg(*aggs).join(duplicate_counts(bars, keys), list(keys))
    detail = F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.col(f"nulls_{c}")) for c in nulls])
    limit, strict = config.fail_threshold, config.strict_threshold
    rows = [
        ("NULL_CHECK", F.col("null_rows"), detail, limit),
        ("OHLC_VALIDITY", F.col("ohlc"), F.lit(""), limit),
        ("NEGATIVE_PRICES", F.col("prices"), F.lit(""), strict),
        ("NEGATIVE_VOLUME", F.col("volumes"), F.lit(""), strict),
        ("DUPLICATE_BARS", F.col("duplicates"), F.lit(""), strict),
    ]
    if order is not None:
        rows.append(("TEMPORAL_ORDER", F.col("unordered"), F.lit(""), limit))
        counts = counts.join(order_violations(bars, keys, order), list(keys), "left").withColumn("unordered", F.coalesce("unordered", F.lit(0)))
    if has_returns:
        far = bars.join(counts.select(*keys, "mean", "std", "n_returns"), list(keys))
        odd = (F.col("n_returns") >= config.outlier_min_rows) & (F.abs(F.col(returns) - F.col("mean")) > config.outlier_sigma * F.col("std"))
        found = far.groupBy(*keys).agg(F.count_if(F.coalesce(odd, F.lit(False))).alias("outliers"))
        counts = counts.join(found, list(keys))
        note = F.when(F.col("n_returns") >= config.outlier_min_rows, "").otherwise("Insufficient data - skipped")
        rows.append(("RETURN_OUTLIER", F.col("outliers"), note, config.outlier_threshold))
    else:
        rows.append(("RETURN_OUTLIER", F.lit(0), F.lit("Column not available - skipped"), config.outlier_threshold))
    return _unfold(counts, keys, rows)


def order_violations(bars: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows earlier than the row before them in physical order; steps from or to null are passed over."""
    rows = bars.select(*keys, "open_time_utc", F.col(order).alias("_order"))
    spread = frames.spread(_numbered(rows, keys), 1)
    before = F.lag("open_time_utc").over(frames.over(keys, spread))
    stepped = frames.trim(spread.withColumn("bad", F.col("open_time_utc") < before))
    return stepped.groupBy(*keys).agg(F.count_if(F.coalesce("bad", F.lit(False))).alias("unordered"))


def _numbered(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """idx by the long column _order: numbered in buckets of it."""
    size = frames.chunk_rows(rows)
    if not size:
        return rows.withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy("_order")) - 1)
    part = [*keys, "_bucket"]
    rows = rows.withColumn("_bucket", F.floor(F.col("_order") / size))
    counts = rows.groupBy(*part).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*part).orderBy("_order"))
    return rows.withColumn("_rank", inside).join(offsets, part).withColumn("idx", F.col("_offset") + F.col("_rank") - 1).drop("_bucket", "_rank", "_offset")


def time_gaps(bars: DataFrame, keys: Sequence[str] = KEYS, step_seconds: int = 3600, config: QualityConfig = QualityConfig()) -> DataFrame:
    """TIME_GAPS: the bars missing between neighbours; the total is the bars there are."""
    times = bars.select(*keys, "open_time_utc").where("open_time_utc IS NOT NULL").distinct()
    rows = frames.spread(frames.indexed(times, keys), 1)
    seconds = F.unix_timestamp("open_time_utc") - F.unix_timestamp(F.lag("open_time_utc").over(frames.over(keys, rows)))
    gaps = frames.trim(rows.withColumn("missing", F.floor(seconds / step_seconds) - 1))
    counts = gaps.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.coalesce(F.sum(F.when(F.col("missing") > 0, F.col("missing"))), F.lit(0)).alias("missing"),
        F.count_if(F.col("missing") > 0).alias("gaps"),
    )
    return _unfold(counts, keys, [("TIME_GAPS", F.col("missing"), F.concat(F.col("gaps").cast("string"), F.lit(" gaps")), config.fail_threshold)])


class BarValidator:
    """All checks of one table, with the results at hand; a handful of rows a series."""

    def __init__(self, bars: DataFrame, keys: Sequence[str] = (), fail_threshold: float = 0.01, expected_seconds: int | None = 3600, order: str | None = None):
        self.bars, self.order, self.step = bars, order, expected_seconds
        self.keys = tuple(keys)
        self.config = QualityConfig(fail_threshold=fail_threshold)
        self.results: list[dict] = []

    def run_all(self) -> BarValidator:
        bars, keys = self.bars, self.keys
        if not keys:
            bars, keys = bars.withColumn("_series", F.lit(0)), ("_series",)
        found = validate(bars, keys, self.config, self.order)
        if self.step:
            found = found.unionByName(time_gaps(bars, keys, self.step, self.config))
        self.results = [r.asDict() for r in found.drop("_series").collect()]
        return self

    @property
    def has_failures(self) -> bool:
        return any(r["severity"] == "FAIL" for r in self.results)

    @property
    def has_warnings(self) -> bool:
        return any(r["severity"] == "WARN" for r in self.results)

    @property
    def summary(self) -> dict[str, int]:
        return {s: sum(r["severity"] == s for r in self.results) for s in ("PASS", "WARN", "FAIL")}

    def to_json(self) -> str:
        import json

        return json.dumps(self.results, default=str)


def quality_report(bars: DataFrame, keys: Sequence[str] = KEYS) -> str:
    """The checks as text, one line each."""
    rows = validate(bars, keys).collect()
    return "\n".join(f"{' '.join(str(r[k]) for k in keys)} {r.check_name:16} {r.severity:4} failed {r.failed_rows} of {r.total_rows} {r.detail}".rstrip() for r in rows)

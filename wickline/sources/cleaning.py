"""From a raw table to standard bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import epoch_to_timestamp, finite
from ..schemas import PRICES, REQUIRED

#: Other names of the standard columns.
ALIASES = {
    "timestamp": "open_time_utc",
    "datetime": "open_time_utc",
    "date": "open_time_utc",
    "time": "open_time_utc",
    "open_time": "open_time_utc",
    "opentime": "open_time_utc",
    "o": "open",
    "h": "high",
    "l": "low",
    "c": "close",
    "v": "volume",
    "vol": "volume",
}
#: Time columns in the order they are tried.
TIME_COLUMNS = ("open_time_utc", "open_time", "timestamp", "datetime", "date", "time")
LEAST_VALID = 0.90
FIRST_YEAR = 2010


def normalised_headers(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Trimmed lower-case headers and standard names; columns that then share a name become one.

    Of columns with one name, the first non-null value from left to right counts.
    """
    aliases = ALIASES if aliases is None else aliases
    names = [aliases.get(n, n) for n in (c.strip().lower() for c in df.columns)]
    places: dict[str, list[str]] = {}
    unique = [f"_{k}" for k in range(len(names))]
    for u, n in zip(unique, names):
        places.setdefault(n, []).append(u)
    flat = df.toDF(*unique)
    return flat.select(*[(F.coalesce(*[F.col(u) for u in us]) if len(us) > 1 else F.col(us[0])).alias(n) for n, us in places.items()])


def require(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """``df`` if it has the columns, else an error that names those lacking."""
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {lacking}")
    return df


def parsed_time(df: DataFrame, name: str) -> Column:
    """Column ``name`` as a UTC timestamp, null where it can't be read.

    Times pass; numbers are epochs by size; text is a date or time, and where
    that fails a number.
    """
    kind = df.schema[name].dataType.typeName()
    col = F.col(name)
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return col.cast("timestamp")
    number = col.try_cast("decimal(38,0)") if kind != "string" else F.col(name).try_cast("decimal(38,0)")
    epoch = epoch_to_timestamp(number)
    return epoch if kind != "string" else F.coalesce(F.when(number.isNull(), F.try_to_timestamp(col)), epoch)


def choose_time_column(df: DataFrame, candidates: tuple[str, ...] = TIME_COLUMNS) -> str:
    """The best readable time column: plausible years first, then names with "utc", then the share that parses."""
    found = [c for c in candidates if c in df.columns]
    aggs = []
    for c in found:
        t = parsed_time(df, c)
        aggs += [F.avg(t.isNotNull().cast("double")).alias(f"r_{c}"), F.min(F.year(t)).alias(f"a_{c}"), F.max(F.year(t)).alias(f"b_{c}")]
    if not aggs:
        raise ValueError("no time column")
    row = df.agg(*aggs, F.year(F.current_timestamp()).alias("now")).first()
    usable = [c for c in found if (row[f"r_{c}"] or 0) >= LEAST_VALID]
    if not usable:
        raise ValueError("no time column parses")
    plausible = lambda c: FIRST_YEAR <= row[f"a_{c}"] and row[f"b_{c}"] <= row["now"] + 2
    return sorted(usable, key=lambda c: (plausible(c), "utc" in c, row[f"r_{c}"]), reverse=True)[0]


def numbers(df: DataFrame, columns: tuple[str, ...] = (*PRICES, "volume")) -> DataFrame:
    """The columns as finite doubles; what is none becomes null."""
    return df.withColumns({c: finite(F.col(c).try_cast("double")) for c in columns if c in df.columns})


def deduplicated(df: DataFrame, key: list[str], sequence: list[str], keep: str = "last") -> DataFrame:
    """One row a key: the last, or first, in ingest order ``sequence``.

    The row is chosen by an aggregate that combines before the shuffle, so a
    key with very many rows is no single group.
    """
    others = [c for c in df.columns if c not in key]
    pick = F.max_by if keep == "last" else F.min_by
    rows = df.groupBy(*key).agg(pick(F.struct(*others), F.struct(*sequence)).alias("_row"))
    return rows.select(*key, "_row.*").select(*df.columns)


#: The place of a row in its files, in their order.
INGEST = "_ingest"


def ingest_order(df: DataFrame) -> DataFrame:
    """``df``, straight from files, with the order of its rows as one long, ``INGEST``; null where it comes from no file.

    Files count by name.  Inside a Parquet file rows have numbers; in others a
    row follows the start of its part, which no part holds more rows than bytes of.
    """
    files = sorted(df.inputFiles())
    if not files:
        return df.withColumn(INGEST, F.lit(None).cast("long"))
    if "parquet" in files[0].rsplit("/", 1)[-1]:
        place = F.col("_metadata.row_index")
    else:
        place = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    if len(files) == 1:
        return df.withColumn(INGEST, place)
    spark = df.sparkSession
    numbers = spark.createDataFrame([(f, k << 43) for k, f in enumerate(files)], "_file string, _number long")
    rows = df.withColumns({"_file": F.col("_metadata.file_path"), INGEST: place})
    return rows.join(numbers, "_file", "left").withColumn(INGEST, F.col(INGEST) + F.col("_number")).drop("_file", "_number")


def standardize(
    df: DataFrame,
    keep: str = "last",
    required: tuple[str, ...] = REQUIRED,
    optional_volume: bool = False,
    key: tuple[str, ...] = ("symbol", "interval", "open_time_utc"),
    sequence: list[str] | None = None,
) -> DataFrame:
    """Headers, columns, times, numbers, nulls and duplicates put in order.

    ``sequence``: the columns that tell the ingest order of rows with one key;
    without them ties go by all columns, so that results do not depend on the
    layout.
    """
    df = normalised_headers(df)
    if optional_volume and "volume" not in df.columns:
        df = df.withColumn("volume", F.lit(None).cast("double"))
    require(df, required)
    df = df.withColumn("open_time_utc", parsed_time(df, "open_time_utc"))
    df = numbers(df).dropna(subset=["open_time_utc", *[c for c in PRICES if c in required]])
    key_columns = [c for c in key if c in df.columns]
    return deduplicated(df, key_columns, sequence or [c for c in df.columns if c not in key_columns], keep)


def guard(df: DataFrame, least_rows: int = 1000) -> DataFrame:
    """``df``, or an error for prices not above 0, negative volumes, too few rows or years before 2010."""
    row = df.agg(
        F.count("*").alias("n"),
        F.count_if(F.least(*[F.col(c) for c in PRICES]) <= 0).alias("prices"),
        F.count_if(F.col("volume") < 0).alias("volumes"),
        F.min(F.year("open_time_utc")).alias("year"),
    ).first()
    problems = [
        text
        for bad, text in (
            (row.n < least_rows, f"{row.n} rows, fewer than {least_rows}"),
            (row.prices, f"{row.prices} rows with a price of 0 or less"),
            (row.volumes, f"{row.volumes} rows with a negative volume"),
            (row.year is not None and row.year < FIRST_YEAR, f"times from {row.year}"),
        )
        if bad
    ]
    if problems:
        raise ValueError("; ".join(problems))
    return df


def without_last(df: DataFrame, keys: tuple[str, ...] = ("symbol", "interval")) -> DataFrame:
    """All but each series' last bar."""
    last = df.groupBy(*keys).agg(F.max("open_time_utc").alias("_last"))
    return df.join(last, list(keys)).where(F.col("open_time_utc") < F.col("_last")).drop("_last")



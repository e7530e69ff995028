"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark texts are normalised to word sequences; each window of ``width``
consecutive words (a shorter item: its whole sequence) is one pattern.  The
patterns of a benchmark part form one automaton over word numbers, and each
document is scanned once.  Hits are word ranges, mapped back to character
offsets of the original text.

Defined cases: null or wordless texts have no words, no hits and no items;
repeated benchmark rows count once; a null ``item_id`` reads as an empty id;
an empty benchmark leaves every document clean; a column of the input that
has the name of an output column is replaced.
"""

from __future__ import annotations

import re
import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hidden, table, utf8, with_columns

WIDTH = 10
#: Benchmark bytes per automaton; a larger benchmark is scanned in parts.
PART_BYTES = 32 << 20

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
#: ASCII letters lower-cased; every other ASCII byte but digits becomes a space.
_NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("hit_ranges", T.ArrayType(T.IntegerType())),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def build_automaton(items: list[tuple[str, bytes]], width: int):
    """An automaton over word numbers and the words' numbers, from 1; other words are 0."""
    numbers: dict[bytes, int] = {}
    patterns: dict[tuple[int, ...], set[str]] = {}
    for item_id, text in items:
        ids = tuple(numbers.setdefault(w, len(numbers) + 1) for w in words_of(text))
        for k in range(max(1, len(ids) - width + 1) if ids else 0):
            patterns.setdefault(ids[k : k + width], set()).add(item_id)
    if not patterns:
        return None, numbers
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for ids, owners in patterns.items():
        automaton.add_word(ids, (len(ids), tuple(owners)))
    automaton.make_automaton()
    return automaton, numbers


def scan(words: list[bytes], automaton, numbers: dict[bytes, int]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged word ranges [start, end) inside occurrences, and the items that own them."""
    get, found, owners = numbers.get, [], set()
    for last, (length, items) in automaton.iter(tuple([get(w, 0) for w in words])):
        found.append((last - length + 1, last + 1))
        owners.update(items)
    return merge(found), owners


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def benchmark_parts(benchmark: DataFrame, id_col: str, text_col: str, part_bytes: int) -> list[DataFrame]:
    """The benchmark, dealt into as many parts as keep each under ``part_bytes`` on average."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text")).where(
        F.col("text").isNotNull()
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // part_bytes) or 1
    return [rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)] if n > 1 else [rows]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WIDTH,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    part_bytes: int = PART_BYTES,
    spans: bool = True,
) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_ranges (flat word starts and ends), items and, if asked, hit_spans.

    The benchmark, a fixed test set, goes to the executors in parts whose size
    is checked; documents pass all parts in one row-wise plan without a
    shuffle, so a hot source or long document moves nothing.
    """
    out = docs
    for k, part in enumerate(benchmark_parts(benchmark, item_col, item_text_col, part_bytes)):
        items = sorted({(r.item, bytes(r.text, "utf-8")) for r in part.distinct().toLocalIterator()})
        sent = docs.sparkSession.sparkContext.broadcast(items)
        cache_key = uuid.uuid4().hex  # a broadcast's own id may be used again

        def factory(sent=sent, first=k == 0, cache_key=cache_key):
            automaton, numbers = _cached(cache_key, sent, width)

            def make(texts: pa.Array, *before: pa.Array) -> list:
                old = [(None, [])] * len(texts) if first else zip(before[0].to_pylist(), before[1].to_pylist())
                n_words, n_hit, ranges, owners = [], [], [], []
                for text, (had, had_items) in zip(utf8(texts), old):
                    words = words_of(text)
                    found, who = scan(words, automaton, numbers) if automaton and words else ([], set())
                    if had:
                        found = merge(found + list(zip(had[::2], had[1::2])))
                    n_words.append(len(words))
                    n_hit.append(sum(b - a for a, b in found))
                    ranges.append([x for r in found for x in r])
                    owners.append(sorted(who | set(had_items)))
                return [n_words, n_hit, ranges, owners]

            return make

        out = with_columns(out, [text_col] if k == 0 else [text_col, "hit_ranges", "items"], FIELDS, factory, keep=docs.columns)
    return with_spans(out, text_col) if spans else out


_CACHE: dict = {}


def _cached(key, sent, width):
    """The automaton of a broadcast, built once in each Python worker."""
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = build_automaton(sent.value, width)
    return _CACHE[key]


def with_spans(df: DataFrame, text_col: str = "text") -> DataFrame:
    """hit_spans: the character ranges of the original text for hit_ranges."""

    def factory():
        def make(texts: pa.Array, ranges: pa.Array) -> list:
            out = []
            for text, flat in zip(texts.to_pylist(), ranges.to_pylist()):
                at = [m.span() for m in _WORD.finditer(text.translate(_LOWER))] if flat else []
                out.append([{"start": at[a][0], "end": at[b - 1][1]} for a, b in zip(flat[::2], flat[1::2])])
            return [out]

        return make

    return with_columns(df, [text_col, "hit_ranges"], [T.StructField("hit_spans", SPAN)], factory)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from the operator's."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(decontaminate(docs, table(spark, sf_dir, "benchmark"), spans=False).select("doc_id", "n_words", "n_hit", "items"))


def without_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a benchmark hit, their columns untouched, whatever their names."""
    new = {f.name.lower(): hidden(docs, f"_own_{f.name}") for f in FIELDS}
    own = {c: new[c.lower()] for c in docs.columns if c.lower() in new}
    found = decontaminate(docs.withColumnsRenamed(own), benchmark, text_col=own.get(text_col, text_col), spans=False)
    kept = found.where(F.col("n_hit") == 0)
    return kept.select(*[kept[f"`{own.get(c, c)}`"].alias(c) for c in docs.columns])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents without a benchmark hit, with their own columns."""
    return without_hits(docs, table(spark, sf_dir, "benchmark"))


#: DuckDB: the same contract by window hashes instead of an automaton.
ORACLE_SQL = r"""
WITH b AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
p AS (
  SELECT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS pat
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
g AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS pat
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k)),
h AS (SELECT g.doc_id, g.i, g.k, p.item FROM g JOIN p ON g.k = p.k AND g.pat = p.pat),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(s.n_items, 0) AS n_items,
  sha256(coalesce(s.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""

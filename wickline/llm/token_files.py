r"""Token ids in length-delimited binary records with a separate offset index.

A shard file holds records in ascending doc_id order.  A record is

    u64 length | u32 masked crc32 of those 8 bytes | payload | u32 masked crc32 of the payload | "\n"

with little-endian numbers and a payload of u8 flags (bit 0: the doc_id is
null; bit 1: ids are four bytes wide, else two), i64 doc_id, then the ids, the
end id included.  The mask is that of the usual record files: rotate right by
15 bits and add a constant, so that a checksum stored inside checked data
does no harm.

Shards are written by Spark's own committed file writer, so they land on any
file system that Spark knows, and a lost executor or a repeated task leaves
no half file.  ``index`` is a Parquet table (shard, offset, length, doc_id,
n_tokens, first) for reads in any order.

Defined cases: null reads as the empty text (one record with the end id);
rows with equal doc_id keep all their records, ordered by text; null doc_ids
come first; an empty table gives no records.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import fresh_path, give_back, lighten, table, with_columns

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Bytes of text for a shard; its file is smaller.
SHARD_BYTES = 16 << 20
MEMO_PIECES = 500_000
#: In the pipeline workers also hold what earlier stages left, so fewer.
STAGE_PIECES = 150_000

_MASK_DELTA = 0xA282EAD8
_HEAD = struct.Struct("<QI")
_TAIL = struct.Struct("<I")
_INTRO = struct.Struct("<Bq")


def masked_crc(data) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    payload = _INTRO.pack((doc_id is None) | wide << 1, doc_id or 0) + ids
    length = struct.pack("<Q", len(payload))
    return b"".join((length, _TAIL.pack(masked_crc(length)), payload, _TAIL.pack(masked_crc(payload))))


def unframe(data, at: int, verify: bool = True) -> tuple[int | None, np.ndarray, int]:
    """The doc_id and ids of the record at ``at``, and the next record's place."""
    length, crc = _HEAD.unpack_from(data, at)
    if masked_crc(bytes(data[at : at + 8])) != crc:
        raise ValueError(f"record at {at}: bad length checksum")
    start, end = at + _HEAD.size, at + _HEAD.size + length
    if end + 5 > len(data):
        raise ValueError(f"record at {at}: cut off")
    if verify and masked_crc(data[start:end]) != _TAIL.unpack_from(data, end)[0]:
        raise ValueError(f"record at {at}: bad payload checksum")
    flags, doc_id = _INTRO.unpack_from(data, start)
    ids = np.frombuffer(data[start + _INTRO.size : end], "<u4" if flags & 2 else "<u2")
    return None if flags & 1 else doc_id, ids, end + 5


def _memo(path: str, pieces: int = MEMO_PIECES) -> tuple[tokens.IdMemo, bool]:
    def make():
        tokenizer = tokens.load(path)
        wide = tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        return tokens.IdMemo(tokenizer, np.dtype("<u4" if wide else "<u2"), pieces), wide

    return tokens.per_worker(("ids", path, pieces), make)


def encode(texts: list[str], memo: tokens.IdMemo) -> list[bytes]:
    """The ids of each text, as little-endian bytes."""
    # A text that itself starts a piece with the mark is encoded whole.
    lists = [tokens.space_led_pieces(t, memo.whole_words) if "\0" not in t else ["\0" + t] for t in texts]
    memo.learn(lists)
    get = memo.known.__getitem__
    return [b"".join(map(get, pieces)) for pieces in lists]


def estimated_bytes(df: DataFrame) -> int:
    """Spark's estimate from file sizes; 0 where it has none, as for rows that come from no file."""
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return found if found < 1 << 55 else 0


def write(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, memo_pieces: int = MEMO_PIECES) -> None:
    """Write the shards under ``path/shards`` and then ``path/index``.

    Range partitions of the ids become shards: long texts or a hot source
    make no partition larger than the rows of its id range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Parquet holds text at about a third to a half of its size.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), estimated_bytes(rows) * 2 // SHARD_BYTES)
    ordered = rows.repartitionByRange(min(n, 100_000), "doc_id").sortWithinPartitions("doc_id", "text")

    def factory():
        memo, wide = _memo(tokenizer_path, memo_pieces)
        end = np.array([end_id], "<u4" if wide else "<u2").tobytes()

        def make(ids: pa.Array, texts: pa.Array) -> list:
            out, doc_ids = [], iter(ids.to_pylist())
            for part in tokens.chunks(texts.to_pylist()):
                out += [frame(next(doc_ids), found + end, wide) for found in encode(part, memo)]
            return [out]

        return make

    framed = with_columns(ordered, ["doc_id", "text"], [T.StructField("value", T.BinaryType())], factory, keep=[])
    # Offsets need the bytes as they are, whatever the session compresses or ends lines with.
    framed.select(F.col("value").cast("string").alias("value")).write.options(compression="none", lineSep="\n").text(f"{path}/shards")
    lighten(spark)
    _records(spark, path, verify=False).select("shard", "path", "offset", "length", "doc_id", "n_tokens", "first").write.parquet(f"{path}/index")


RECORD = T.StructType(
    [
        T.StructField("shard", T.IntegerType()),
        T.StructField("path", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("first", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("ids", T.ArrayType(T.LongType())),
    ]
)


def _records(spark: SparkSession, path: str, verify: bool, with_ids: bool = False, rows: int = 20_000) -> DataFrame:
    """A row for each record; ``first`` counts the ids before it in its shard.

    Without ``verify`` only lengths are checked and the ids' checksum is null.
    """
    files = spark.read.format("binaryFile").load(f"{path}/shards").select(
        F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard"), "path", "content"
    )
    schema = RECORD if with_ids else T.StructType(RECORD.fields[:-1])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            for shard, file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data, at, first, out = memoryview(content.as_buffer()), 0, 0, []
                while at < len(data):
                    doc_id, ids, after = unframe(data, at, verify)
                    crc = zlib.crc32(ids.astype("<u4").tobytes()) if verify else None
                    out.append((shard, file, at, after - at, doc_id, len(ids), first, crc, ids.astype(np.int64) if with_ids else None)[: len(names)])
                    at, first = after, first + len(ids)
                    if len(out) == rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), target)], schema=target)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), target)], schema=target)
                del data, content
        give_back()

    return files.mapInArrow(run, schema)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """The records, checksums verified, with ``start``: the ids of all records before.

    Shard totals come from the index, one row a shard, and are summed in order.
    """
    totals = spark.read.parquet(f"{path}/index").groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("shard_start"))
    found = _records(spark, path, verify=True, with_ids=with_ids).join(starts, "shard")
    return found.withColumn("start", F.col("shard_start") + F.col("first")).drop("shard_start")


def read_shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """Every record once, in an order drawn by ``seed``: (position key, doc_id, ids).

    The index is put in order; each task then fetches its records by offset.
    The shards must be on a file system that pyarrow opens.
    """
    order = spark.read.parquet(f"{path}/index").select(
        F.xxhash64(F.lit(seed), "shard", "offset").alias("key"), "path", "offset", "length"
    )
    schema = T.StructType([T.StructField("key", T.LongType()), RECORD["doc_id"], RECORD["ids"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark.sql.pandas.types import to_arrow_schema

        target, opened = to_arrow_schema(schema), {}
        for batch in batches:
            out = []
            for key, file, offset, length in zip(*[c.to_pylist() for c in batch.columns]):
                if file not in opened:
                    for old in list(opened)[:-64]:
                        opened.pop(old).close()
                    store, place = fs.FileSystem.from_uri(file.replace("file:/", "file:///", 1) if file.startswith("file:/") and not file.startswith("file://") else file)
                    opened[file] = store.open_input_file(place)
                opened[file].seek(offset)
                doc_id, ids, _ = unframe(memoryview(opened[file].read(length)), 0)
                out.append((key, doc_id, ids.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * 3, target)], schema=target)

    return order.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, schema)


def digest(records: DataFrame) -> DataFrame:
    return records.select("doc_id", "start", "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, memo_pieces: int = MEMO_PIECES) -> DataFrame:
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    write(docs, path, tokens.public_path(VOCABULARY), memo_pieces=memo_pieces)
    return digest(read(spark, path, with_ids=False))


def op3_token_id_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write all rows as records and return one row for each from the files."""
    return write_and_read(docs, STAGE_PIECES)

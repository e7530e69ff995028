"""Mixing sources to target weights, in DataFrame operations only.

The words of a source, its documents in a fixed pseudorandom order, are
packed into blocks of at most ``block`` words, whose lengths differ by one at
most.  Each output shard of ``shard`` slots gets source counts by a
multinomial draw; the draw is without replacement from the mix's quotas, so
that each source's total is its target, rounded, and not only on average.  A
source's slots, numbered through the shards, are mapped through pseudorandom
permutations of its block indices (one a pass over the source; swap-or-not
shuffles, which permute any range in place), and blocks join documents by
index.  A pass that takes less than the source takes as many blocks as that
needs, and nearly equal shares of them, so that it adds up exactly.

Every window and join has the block, the chunk or a hash bucket in its key,
so a source with a third of all rows spreads like the others.  Tables with a
row a source are the only ones sorted as a whole or broadcast, the latter
behind a check of their count.  Rows alike in source, doc_id and text are
counted first and numbered as copies, so that a third of all rows may be one
text of one doc_id, null included.

Defined cases: null texts have size 0; documents without a word are returned
with 0 taken; a null source is a source of its own, after all others; rows
that repeat a doc_id, null or not, keep their rows apart, with a text or
without; ties are ordered by a hash of the text, so reruns agree; very long
texts are cut into blocks like others; an empty table gives an empty mix;
columns besides the named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, hidden, materialize, table

BLOCK = 64
SHARD = 4096
#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 20

ROUNDS = 24
#: Rows a bucket of the prefix sum holds on average, and the fewest buckets.
BUCKET_ROWS, LEAST_BUCKETS = 50_000, 64
#: Sources up to which their table is broadcast.
BROADCAST_SOURCES = 100_000
#: Slots that one row unfolds to.
CHUNK = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """Where a permutation of 0 .. n-1, drawn by ``key``, puts ``x``.

    Each swap-or-not round pairs x with (k - x) mod n and swaps the pair or
    not, by a bit that both members compute alike.
    """

    def step(at: Column, i: Column) -> Column:
        k = F.pmod(F.xxhash64(*key, i, F.lit(0)), n)
        other = F.pmod(k - at, n)
        bit = F.xxhash64(*key, i, F.greatest(at, other)).bitwiseAND(F.lit(1))
        return F.when(bit == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), step)


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """(sid, source, source_size, target): a row a source.

    Targets share ``share`` times all words by weight and stop at ``most``
    times the source's size; the excess goes to the others by weight until
    none is above.  That limit is the level at which the targets, each the
    lesser of cap and level times weight, add up to the whole: sources are
    taken by cap over weight until the rest's level is below their cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    rows = rows.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - before) / left)
    rows = rows.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
    return rows.select(
        "sid", "source", "source_size", F.least("cap", F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target")
    )


def _with_sources(df: DataFrame, sources: DataFrame, n_sources: int, on: Column | str) -> DataFrame:
    return df.join(F.broadcast(sources) if n_sources <= BROADCAST_SOURCES else sources, on)


#: What tells a row of the mix's input from all others.
ROW = ["sid", "doc_id", "mark", "size", "copy"]
#: Copies of one row that stay together.
COPIES = 4096


def counted(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(source, doc_id, mark, size, copies): the rows alike in source, doc_id and text, counted; mark hashes the text."""
    text = F.col(text_col)
    rows = docs.select(
        F.col(source_col).alias("source"), F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("mark"), n_words(text).alias("size")
    )
    return rows.groupBy("source", "doc_id", "mark", "size").agg(F.count("*").alias("copies"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with a row for each copy, numbered; few copies unfold in place, many are dealt out by chunks."""
    few = rows.where(F.col("copies") <= COPIES).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    many = unfolded(rows.where(F.col("copies") > COPIES), F.col("copies"), "copy")
    return few.unionByName(many).drop("copies")


def placed(rows: DataFrame, n_rows: int) -> DataFrame:
    """``rows`` (ROW, ...) with start: the words of their source before them.

    Documents are ordered by hash bucket and then doc_id; sums run inside
    buckets, and over the buckets' totals.
    """
    buckets = max(LEAST_BUCKETS, -(-n_rows // BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "mark", F.expr(f"copy div {COPIES}")), F.lit(buckets)))
    inside = Window.partitionBy("sid", "bucket").orderBy("doc_id", "size", "mark", "copy").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("total"))
    totals = totals.select("sid", "bucket", F.coalesce(F.sum("total").over(over), F.lit(0)).alias("bucket_start"))
    inner = rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return inner.join(totals, ["sid", "bucket"]).withColumn("start", F.col("start") + F.col("bucket_start")).drop("bucket", "bucket_start")


def with_blocks(sources: DataFrame, block: int) -> DataFrame:
    """``sources`` with blocks, their least length (short), and how many, the first ones, are longer by one (long)."""
    rows = sources.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    some = F.greatest("blocks", F.lit(1))
    return rows.withColumns({"short": F.expr("source_size div greatest(blocks, 1)"), "long": F.col("source_size") % some})


def quotas(sources: DataFrame) -> DataFrame:
    """Words to take, slots of each source and those of a partial pass (parts), and where its quota lies among all slots."""
    words = F.least(F.round("target").cast("long"), MOST * F.col("source_size"))
    rows = sources.withColumn("words", words).where("words > 0")
    rows = rows.withColumns({"rest": F.col("words") % F.col("source_size"), "whole": F.expr("words div source_size")})
    rows = rows.withColumn("parts", F.least(F.expr("(rest + short - 1) div short"), F.col("blocks")))
    rows = rows.withColumn("slots", F.col("whole") * F.col("blocks") + F.col("parts"))
    order = Window.orderBy("sid")
    first = F.sum("slots").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("slots")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumns({"first": first, "all_slots": F.sum("slots").over(everything)})


def unfolded(df: DataFrame, count: Column, name: str) -> DataFrame:
    """A row for each number 0 .. count-1: first by chunks, dealt out, then inside them."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunked = df.withColumn("_n", count).where("_n > 0").withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {CHUNK}"))))
    dealt = chunked.repartition(n, *[c for c in df.columns], "_chunk")
    last = F.least((F.col("_chunk") + 1) * CHUNK, F.col("_n")) - 1
    return dealt.withColumn(name, F.explode(F.sequence(F.col("_chunk") * CHUNK, last))).drop("_n", "_chunk")


def drawn_counts(quota: DataFrame, shard: int, seed: int) -> DataFrame:
    """(shard, sid, count): the multinomial draw of source counts for every shard.

    All slots of all quotas are permuted over the output; a shard's count of a
    source is how many of that source's land in the shard.
    """
    every = unfolded(quota.select("sid", "first", "slots", "all_slots"), F.col("slots"), "k")
    place = permuted(F.col("first") + F.col("k"), F.col("all_slots"), F.lit(seed))
    return every.withColumn("shard", (place / shard).cast("long")).groupBy("shard", "sid").agg(F.count("*").alias("count"))


def slots(quota: DataFrame, n_sources: int, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(shard, sid, pass, block, take): the output's slots; take is the words of the block to use, null for all."""
    before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = drawn_counts(quota, shard, seed).withColumn("done", F.coalesce(F.sum("count").over(before), F.lit(0)))
    rows = unfolded(counts.select("shard", "sid", "done", "count"), F.col("count"), "k")
    columns = ["sid", "blocks", "short", "long", "whole", "rest", "parts"]
    rows = _with_sources(rows.withColumn("slot", F.col("done") + F.col("k")), quota.select(*columns), n_sources, "sid")
    number = F.expr("slot div blocks")
    rows = rows.withColumn("block", permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.lit(seed + 1), F.col("sid"), number))
    # Nearly equal shares of the partial pass's blocks; where it needs all of them, the first long ones give the words beyond the least length.
    parts = F.greatest("parts", F.lit(1))
    share = F.expr("rest div greatest(parts, 1)") + (F.col("slot") % F.col("blocks") < F.col("rest") % parts).cast("long")
    beyond = F.col("rest") - F.col("blocks") * F.col("short")
    full = F.col("short") + (F.col("block") < beyond).cast("long")
    take = F.when(number == F.col("whole"), F.when(beyond > 0, full).otherwise(share))
    return rows.select("shard", "sid", number.alias("pass"), "block", take.alias("take"))


def pieces(rows: DataFrame) -> DataFrame:
    """The parts of documents in each block; documents without a word keep one row without a block.

    ``rows`` carry their source's short and long: its first ``long`` blocks have short + 1 words, the others short.
    """

    def block_of(word: str) -> Column:
        later = f"long + ({word} - long * (short + 1)) div greatest(short, 1)"
        return F.expr(f"CASE WHEN {word} < long * (short + 1) THEN {word} div (short + 1) ELSE {later} END")

    spans = F.when(F.col("size") > 0, F.sequence(block_of("start"), block_of("(start + size - 1)")))
    cut = rows.withColumn("block", F.explode_outer(spans))
    first = F.col("block") * F.col("short") + F.least("block", "long")
    begin = F.greatest(F.col("start"), first)
    end = F.least(F.col("start") + F.col("size"), first + F.col("short") + (F.col("block") < F.col("long")).cast("long"))
    return cut.withColumns({"at": begin - first, "from": begin - F.col("start"), "length": end - begin}).drop("short", "long")


def mix(rows: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> tuple[DataFrame, DataFrame, int]:
    """The mix of ``rows`` (as ``counted`` gives them, written).

    Returns its spans, the sources and their number.  A span is a row's (ROW)
    part with shard, pass, from (first word) and taken (words); rows that give
    nothing have one span with 0 taken.
    """
    n_rows = rows.agg(F.sum("copies")).first()[0] or 0
    every = rows.withColumn("size", F.col("size") * F.col("copies"))
    sources = materialize(with_blocks(source_targets(every), block), "sources")
    n_sources = sources.count()
    named = sources.select("sid", F.col("source").alias("_source"), "source_size", "target", "short", "long")
    of_source = _with_sources(numbered(rows), named, n_sources, F.col("_source").eqNullSafe(F.col("source"))).drop("_source", "source")
    cut = pieces(placed(of_source, n_rows))
    spans = cut.join(slots(quotas(sources), n_sources, shard, seed), ["sid", "block"], "left")
    taken = F.greatest(F.least("length", F.col("take") - F.col("at")), F.lit(0))
    # A block that no slot takes gives nothing; one without a take is taken whole.
    given = F.when(F.col("shard").isNull(), F.lit(0)).when(F.col("take").isNull(), F.col("length")).otherwise(taken).cast("long")
    return spans.withColumn("taken", given), sources, n_sources


def taken_words(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(sid, doc_id, size, source_size, target, taken): a row for each row of ``docs`` (source, doc_id, text)."""
    spans, _, _ = mix(materialize(counted(docs), "sizes"), block, shard, seed)
    return spans.groupBy(*ROW, "source_size", "target").agg(F.sum("taken").alias("taken")).drop("mark", "copy")


def op1_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """``docs`` as the mix takes them: a row for each pass over a document with the words it takes.

    A document taken whole keeps its text; else its taken words are joined by
    spaces.  n_chars follows the text.  Documents are matched by doc_id and a
    hash of the text, so rows that repeat both share their other columns.
    """
    spans, _, _ = mix(materialize(counted(docs), "sizes"), block, shard, seed)
    parts = F.array_sort(F.collect_list(F.struct("from", "taken")))
    taken = spans.where("taken > 0").groupBy(*ROW, "pass").agg(parts.alias("_parts"), F.sum("taken").alias("_taken"))
    id_key, null_key, mark_key = (hidden(docs, c) for c in ("_id", "_null", "_mark"))
    keys = [F.coalesce("doc_id", F.lit(0)).alias(id_key), F.col("doc_id").isNull().alias(null_key)]
    part_col, whole_col = hidden(docs, "_parts"), hidden(docs, "_whole")
    left = taken.select(*keys, F.col("mark").alias(mark_key), F.col("_parts").alias(part_col), (F.col("_taken") == F.col("size")).alias(whole_col))
    right = docs.select(*keys, F.xxhash64("text").alias(mark_key), *[docs[f"`{c}`"] for c in docs.columns]).dropDuplicates([id_key, null_key, mark_key])
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    chosen = F.flatten(F.transform(part_col, lambda p: F.slice(words, (p["from"] + 1).cast("int"), p["taken"].cast("int"))))
    out = left.join(right, [id_key, null_key, mark_key]).withColumn("text", F.when(F.col(whole_col), F.col("text")).otherwise(F.array_join(chosen, " ")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` mixed to the sources' targets; documents that the mix takes no word of, empty ones included, have no row."""
    return mixed_documents(docs)

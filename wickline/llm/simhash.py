"""Near duplicates by 64-bit SimHash with pigeonring filtering.

Fingerprints within ``TAU`` bits are linked.  The 64 bits form a ring of
TAU + 1 segments.  If two fingerprints differ in at most TAU bits, some start
segment exists from which every chain of l consecutive segments differs in at
most floor(l * TAU / (TAU + 1)) bits, that is in 0, 1, 2, ... bits.  The
index keys are made from the first ``CHAIN`` segments of such chains: the
start segment whole, and of each later segment those halves that must be
intact for some way of spending the chain's budgets.  Pairs that share a key
then pass the chain budgets one by one before the full Hamming distance.

Exact copies share a fingerprint and are one row from there on.  Inside a key
only a spanning forest of the links is emitted, which keeps components exact
without emitting all pairs of a group.

Defined cases: texts without a word, null included, have fingerprint zero and
link like others; repeated rows are copies; a null doc_id takes part but is
never a component id; an empty table gives an empty result.

The pipeline's stage has its own definition: sets of 5-word shingles with a
Jaccard similarity of at least 0.8.  The same fingerprints, keys and chain
budgets, at the wider ``STAGE_TAU``, link the sets; links are compared exactly.
Pairs at 0.8 differ in about ten of 64 bits, more than keys can be complete
for, so an exact way finds the rest: sets of different groups that share an
element of their prefixes, which misses none.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, hidden, materialize, slices, table, tables, utf8, with_columns
from .components import connected, joined
from .repeats import Words

SHINGLE = 4
SEED = 42
TAU = 4
CHAIN = 4
#: The pipeline's stage: words of a shingle and the least Jaccard similarity of near copies.
STAGE_SHINGLE = 5
NEAR = Fraction(4, 5)
#: Differing bits at which the stage links fingerprints, and the segments of its keys.
STAGE_TAU, STAGE_CHAIN = 5, 3
#: Sets of a key compared pair by pair at once.
GROUP = 16
#: Sets of a larger key that the others are compared with first.
GUIDES = 32
#: Every so many rows are searched for hot shingles: those in so many of them, and so many shingles at most.
HOT_PART, HOT_COUNT, HOT_KEYS = 16, 4, 500_000
#: Bins of the histogram that bounds what two sets share, and bits of a shingle that find candidates.
BINS, KEY_BITS = 256, 48
#: Words whose hashes a worker keeps.
SET_WORDS = 100_000
#: Dropped rows up to which their numbers are broadcast, so that texts stay where they are.
MOST_DROPPED = 2_000_000

_BYTE_BITS = np.array([[b >> k & 1 for k in range(8)] for b in range(256)], np.int64)


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The hashes of the word shingles of ``text``, its ASCII letters lower-cased; a shorter text is one shingle."""
    words = text.lower().split()
    n = max(1, len(words) - size + 1)
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    hash_of = xxhash.xxh64_intdigest
    if n == 1:
        return np.array([hash_of(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    return np.fromiter([hash_of(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist())], np.uint64, n)


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of the word shingles of ``text``, its ASCII letters lower-cased."""
    return print_of(shingle_hashes(text, size, seed))


def print_of(hashes: np.ndarray) -> int:
    """The bits that more than half of ``hashes`` have."""
    n = len(hashes)
    if not n:
        return 0
    octets = hashes.view(np.uint8).reshape(n, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with fp, the fingerprint's bits as a long."""

    def factory():
        def make(texts: pa.Array) -> list:
            return [np.array([fingerprint(t) for t in utf8(texts)], np.uint64).view(np.int64)]

        return make

    return with_columns(docs, [text_col], [T.StructField("fp", T.LongType())], factory, keep)


def ring(tau: int = TAU) -> list[tuple[int, int]]:
    """(first bit, bits) of the tau + 1 segments."""
    cuts = [round(k * 64 / (tau + 1)) for k in range(tau + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def key_masks(tau: int = TAU, chain: int = CHAIN) -> list[int]:
    """The bit masks whose equality makes a candidate pair, complete for ``tau``."""
    segments, later = ring(tau), min(chain, tau + 1) - 1
    kept: set[frozenset] = set()
    for spent in product(range(3), repeat=later):  # two differing bits can break both halves
        if all(sum(spent[: k + 1]) <= (k + 2) * tau // (tau + 1) for k in range(later)):
            for halves in product(*[list(combinations((0, 1), 2 - d)) for d in spent]):
                kept.add(frozenset((k, h) for k, hs in enumerate(halves) for h in hs))
    least = [s for s in kept if not any(t < s for t in kept)]
    masks = []
    for start in range(len(segments)):
        for choice in sorted(map(sorted, least)):
            first, bits = segments[start]
            mask = ((1 << bits) - 1) << first
            for k, half in choice:
                first, bits = segments[(start + 1 + k) % len(segments)]
                low = bits // 2
                mask |= (((1 << low) - 1) << first) if half == 0 else (((1 << (bits - low)) - 1) << (first + low))
            masks.append(mask)
    return masks


def chain_masks(tau: int = TAU) -> np.ndarray:
    """[start, l - 1]: the bits of the l segments from start on."""
    segments = ring(tau)
    m = len(segments)
    out = np.zeros((m, m), np.uint64)
    for i in range(m):
        mask = 0
        for k in range(m):
            first, bits = segments[(i + k) % m]
            mask |= ((1 << bits) - 1) << first
            out[i, k] = mask
    return out


def within(a: np.ndarray, b: np.ndarray, tau: int = TAU, chains: np.ndarray | None = None) -> np.ndarray:
    """Which pairs differ in at most ``tau`` bits: pigeonring budgets first, then all bits."""
    chains = chain_masks(tau) if chains is None else chains
    diff = a ^ b
    passed = np.zeros(len(diff), bool)
    for row in chains:
        alive = np.flatnonzero(~passed)
        for k, mask in enumerate(row[:-1]):
            alive = alive[np.bitwise_count(diff[alive] & mask) <= (k + 1) * tau // (tau + 1)]
        passed[alive] = True
    alive = np.flatnonzero(passed)
    passed[alive] = np.bitwise_count(diff[alive]) <= tau
    return passed


def forest(fps: np.ndarray, tau: int = TAU, block: int = 1024) -> list[tuple[int, int]]:
    """Edges of the links among distinct fingerprints, enough to keep their components.

    Up to ``block`` fingerprints are compared directly; more are split by
    slices of their varying bits, one of which any linked pair agrees in.
    """
    n = len(fps)
    if n <= block:
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= tau
        left, out = np.ones(n, bool), []
        for i in range(n):
            if left[i]:
                left[i] = False
                frontier = near[i] & left
                while frontier.any():
                    found = np.flatnonzero(frontier)
                    out += [(int(fps[i]), int(fps[j])) for j in found]
                    left[found] = False
                    frontier = near[found].any(0) & left
        return out
    varying = int(np.bitwise_or.reduce(fps ^ fps[0]))
    bits = [k for k in range(64) if varying >> k & 1]
    found: set[tuple[int, int]] = set()
    for part in np.array_split(np.array(bits), tau + 1):
        mask = np.uint64(sum(1 << int(k) for k in part))
        value = fps & mask
        order = np.argsort(value, kind="stable")
        edges = np.flatnonzero(np.diff(value[order])) + 1
        for group in np.split(order, edges):
            if len(group) > 1:
                found.update(forest(fps[group], tau, block if len(group) < n else n))
    return spanning(found)


def spanning(edges) -> list[tuple[int, int]]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((a, b))
    return out


def candidate_keys(fps: DataFrame, tau: int = TAU, chain: int = CHAIN) -> DataFrame:
    """(key, fp): a hash of the mask's number and the bits under it, for every mask."""
    masks = key_masks(tau, chain)
    keys = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for k, m in enumerate(masks)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def links(fps: DataFrame, tau: int = TAU, chain: int = CHAIN) -> DataFrame:
    """Edges (a, b) of a forest over the distinct fingerprints ``fps`` (fp).

    Rows of a key are sorted together and read as a stream: a task holds one
    key's fingerprints at a time, eight bytes each.  Equal key hashes of
    different bits only add pairs that the distance check drops.
    """
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains = chain_masks(tau)
        rest = (np.empty(0, np.int64), np.empty(0, np.uint64))

        def done(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1]) if len(keys) else np.empty(0, np.int64)
            sizes = np.diff(np.append(starts, len(keys)))
            firsts, seconds = [], []
            for size in range(2, 9):
                at = starts[sizes == size]
                for i, j in combinations(range(size), 2) if len(at) else ():
                    a, b = values[at + i], values[at + j]
                    good = within(a, b, tau, chains)
                    firsts.append(a[good])
                    seconds.append(b[good])
            for at, size in zip(starts[sizes > 8], sizes[sizes > 8]):
                pairs = np.array(forest(np.unique(values[at : at + size]), tau), np.uint64).reshape(-1, 2)
                firsts.append(pairs[:, 0])
                seconds.append(pairs[:, 1])
            a = np.concatenate(firsts) if firsts else np.empty(0, np.uint64)
            b = np.concatenate(seconds) if seconds else np.empty(0, np.uint64)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

        for batch in batches:
            keys = np.concatenate([rest[0], batch.column("key").to_numpy()])
            values = np.concatenate([rest[1], batch.column("fp").to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            rest = (keys[cut:], values[cut:])
            yield done(keys[:cut], values[:cut])
        yield done(*rest)

    keyed = candidate_keys(fps, tau, chain).repartition("key").sortWithinPartitions("key")
    return keyed.select("key", "fp").mapInArrow(run, schema).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, chain: int = CHAIN) -> DataFrame:
    """(doc_id, fp, component_id): a row for each row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = materialize(with_fingerprint(rows, keep=["doc_id"]), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    members = connected(links(classes.select("fp"), tau, chain), "near").withColumnRenamed("node", "fp")
    least = classes.join(members, "fp").groupBy("component").agg(F.min("first_id").alias("least_id"))
    of_fp = classes.join(members.join(least, "component").select("fp", "least_id"), "fp", "left").select(
        "fp", F.coalesce("least_id", "first_id").alias("component_id")
    )
    return prints.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def jaccard_prefix(n: int, near: Fraction = NEAR) -> int:
    """How many of n elements in a common order hold one that every set at ``near`` shares with them."""
    return n + (-n * near.numerator) // near.denominator + 1 if n else 0


class ShingleSets:
    """Sets of word shingles as sorted hashes: each word is hashed once a worker, and shingles mix their words' hashes."""

    def __init__(self, size: int):
        self.size, self.words = size, Words(size, size)
        self.words.MEMO = SET_WORDS

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """The set of each text, its ASCII letters lower-cased; a text of fewer words is one shingle, an empty one none."""
        docs = [t.lower().split() for t in texts]
        lengths = np.array([len(d) for d in docs], np.int64)
        ends = np.cumsum(lengths)
        if not len(docs) or not ends[-1]:
            return [np.empty(0, np.uint64) for _ in docs]
        codes = self.words.codes(docs)
        rolled = self.words.hashes(np.concatenate([codes, np.zeros(self.size, np.uint64)]), len(codes))
        out = []
        for start, n in zip((ends - lengths).tolist(), lengths.tolist()):
            if n >= self.size:
                out.append(np.unique(rolled[start : start + n - self.size + 1]))
            elif n:  # fewer words: the whole sequence, told from longer ones by its length
                out.append(np.array([xxhash.xxh3_64_intdigest(codes[start : start + n].tobytes(), n)], np.uint64))
            else:
                out.append(np.empty(0, np.uint64))
        return out


def hot_shingles(rows: DataFrame, row: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts hold, sorted, and their rank by how many.

    Found in a part of ``rows``, for they only order the elements of sets: any
    order gives the same pairs, and one that puts frequent shingles last gives
    the fewest to compare.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = ShingleSets(size)
        for batch in slices(batches, 1 << 20):
            found = sets(utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["key"])
        del sets
        give_back()

    part = rows.where(F.col(row) % HOT_PART == 0).select("text").mapInArrow(run, "key long")
    counts = part.groupBy("key").count().where(F.col("count") >= HOT_COUNT)
    top = counts.orderBy(F.desc("count"), "key").limit(HOT_KEYS).toArrow()
    keys, often = top.column("key").to_numpy().view(np.uint64), top.column("count").to_numpy()
    order = np.argsort(keys)
    return keys[order], often[order].astype(np.int32)


def with_sets(rows: DataFrame, keep: list[str], hot: tuple[np.ndarray, np.ndarray], size: int) -> DataFrame:
    """``rows`` with set_id, set_size, fp (the set's SimHash), the prefix of the set of shingles (the hotter ones later in the order) and bins.

    bins counts the set's elements by their lowest bits, up to 255: two sets
    share no more than the lesser counts add up to.  bits has whether each count is
    odd: two sets differ in at least as many elements as in bits.
    """
    shared = rows.sparkSession.sparkContext.broadcast(hot)

    def factory():
        (often, count), sets = shared.value, ShingleSets(size)

        def make(texts: pa.Array) -> list:
            ids, sizes, prints, prefixes, bins, bits = [], [], [], [], [], []
            for found in sets(utf8(texts)):
                ids.append(xxhash.xxh3_64_intdigest(found.tobytes(), SEED))
                sizes.append(len(found))
                prints.append(print_of(found))
                counts = np.bincount((found % np.uint64(BINS)).astype(np.int64), minlength=BINS)
                bins.append(np.minimum(counts, 255).astype(np.uint8).tobytes())
                bits.append(np.packbits(counts & 1).tobytes())
                if len(often) and len(found):
                    at = np.minimum(np.searchsorted(often, found), len(often) - 1)
                    heat = np.where(often[at] == found, count[at], 0)
                    found = found[np.argsort(heat, kind="stable")]
                prefixes.append((found[: jaccard_prefix(len(found))] >> np.uint64(64 - KEY_BITS)).view(np.int64))
            return [np.array(ids, np.uint64).view(np.int64), np.array(sizes, np.int32), np.array(prints, np.uint64).view(np.int64), prefixes, bins, bits]

        return make

    fields = [
        T.StructField("set_id", T.LongType()),
        T.StructField("set_size", T.IntegerType()),
        T.StructField("fp", T.LongType()),
        T.StructField("prefix", T.ArrayType(T.LongType())),
        T.StructField("bins", T.BinaryType()),
        T.StructField("bits", T.BinaryType()),
    ]
    return with_columns(rows, ["text"], fields, factory, keep)


POSTS = "key long, id long, n int, at int, held int"


def shared_posts(posts: DataFrame) -> DataFrame:
    """``posts`` (key, id, n, at) without the keys that one set holds, which can't make a pair; held counts a key's sets."""
    names = ["key", "id", "n", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.int64)] * 4

        def done(columns: list[np.ndarray]) -> pa.RecordBatch:
            keys = columns[0]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1]) if len(keys) else np.empty(0, np.int64)
            sizes = np.diff(np.append(starts, len(keys)))
            held = np.repeat(sizes, sizes)
            out = [c[held > 1] for c in (*columns, held)]
            return pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1]), *[pa.array(c.astype(np.int32)) for c in out[2:]]], names=[*names, "held"])

        for batch in batches:
            now = [np.concatenate([r, batch.column(c).to_numpy()]) for r, c in zip(rest, names)]
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            rest = [x[cut:] for x in now]
            yield done([x[:cut] for x in now])
        yield done(rest)
        give_back()

    return posts.select(*names).repartition("key").sortWithinPartitions("key").mapInArrow(run, POSTS)


def linked_sets(heads: DataFrame, tau: int = STAGE_TAU, chain: int = STAGE_CHAIN) -> DataFrame:
    """Pairs (a, b) of a forest over sets whose fingerprints differ in at most ``tau`` bits; ``heads`` (head, fp)."""
    classes = heads.groupBy("fp").agg(F.min("head").alias("least"))
    near = links(classes.select("fp"), tau, chain)
    for side in ("a", "b"):
        near = near.join(classes.select(F.col("fp").alias(side), F.col("least").alias(f"least_{side}")), side)
    same = heads.join(classes, "fp").where("head <> least").select(F.col("least").alias("a"), F.col("head").alias("b"))
    return same.union(near.select("least_a", "least_b"))


def candidate_pairs(posts: DataFrame, guided: bool) -> DataFrame:
    """Pairs (a, b) of sets that share a key of (key, comp, n, at, id, bits) and may be near by their sizes and its places.

    A pair's first shared element, at places i and j of sets of n and m, leaves
    it 1 + min(n - i, m - j) - 1 elements to share, so a key that leaves fewer
    than ``NEAR`` needs gives no pair.  Neither does a pair whose bits differ
    more than the sets may.  Sets of one comp need no pair.  If ``guided``,
    groups of more than ``GROUP`` give each set's pairs with the least one and
    with two of ``GUIDES`` others, those whose bits leave the most room: a few
    links a set that mostly join a group of copies, so that little is left to
    compare across components.
    """
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    up, down = NEAR.numerator, NEAR.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [*[np.empty(0, np.int64)] * 5, np.empty((0, BINS // 64), np.uint64)]

        def done(keys, comps, ns, ats, ids, bits) -> pa.RecordBatch:
            starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1]) if len(keys) else np.empty(0, np.int64)
            sizes = np.diff(np.append(starts, len(keys)))
            firsts, seconds = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            left = ns - ats

            def take(i, j) -> None:
                reach = np.minimum(left[i], left[j]) * (up + down) >= up * (ns[i] + ns[j])
                differ = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
                good = reach & (differ * (up + down) <= (down - up) * (ns[i] + ns[j])) & (ns[i] * down >= ns[j] * up) & (comps[i] != comps[j])
                firsts.append(ids[i[good]])
                seconds.append(ids[j[good]])

            for size in range(2, GROUP + 1):
                at = starts[sizes == size]
                for i, j in combinations(range(size), 2) if len(at) else ():
                    take(at + i, at + j)
            for at, size in zip(starts[sizes > GROUP].tolist(), sizes[sizes > GROUP].tolist()):
                every = np.arange(at, at + size)
                if (comps[every] == comps[at]).all():
                    continue
                if guided:
                    # Guides are the least by id: keys of one group of copies mostly name the same ones, and so the same pairs.
                    guides = at + np.sort(np.argsort(ids[at : at + size], kind="stable")[:GUIDES])
                    head = guides[np.argmin(ids[guides])]
                    for part in np.array_split(every, -(-size // 1024)):
                        excess = np.bitwise_count(bits[guides, None] ^ bits[part]).sum(axis=2, dtype=np.int64) * (up + down)
                        excess -= (down - up) * (ns[guides, None] + ns[part])
                        excess[guides[:, None] == part] = np.iinfo(np.int64).max
                        nearest = guides[np.argpartition(excess, 1, axis=0)[:2]]
                        for partner in (np.full(len(part), head), *nearest):
                            other = part != partner
                            take(np.minimum(part, partner)[other], np.maximum(part, partner)[other])
                else:
                    # Sorted by size: those too large for a set end its partners.
                    last = np.searchsorted(ns[every] * up, ns[every] * down, side="right")
                    for k in np.flatnonzero(last > np.arange(size) + 1).tolist():
                        take(np.full(int(last[k]) - 1 - k, at + k), every[k + 1 : int(last[k])])
            a, b = np.concatenate(firsts), np.concatenate(seconds)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "comp", "n", "at", "id")]
            new.append(np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(-1, BINS // 64))
            held = [np.concatenate(x) for x in zip(rest, new)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            rest = [x[cut:] for x in held]
            yield done(*[x[:cut] for x in held])
        yield done(*rest)
        give_back()

    dealt = posts.select("key", "comp", "n", "at", "id", "bits").repartition("key").sortWithinPartitions("key", "n", "id")
    return dealt.mapInArrow(run, schema).distinct()


PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def near_by_size(same, total) -> bool:
    """Whether sets of ``total`` elements together that share ``same`` have a Jaccard similarity of at least ``NEAR``."""
    return same * NEAR.denominator >= (total - same) * NEAR.numerator


def possible_pairs(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """``pairs`` (a, b) without those whose bins show that they are not near; ``heads`` (head, n, bins)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bins = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("bins_a", "bins_b")]
            most = np.minimum(*bins).astype(np.int64).sum(axis=1)
            full = (bins[0] == 255).any(axis=1) | (bins[1] == 255).any(axis=1)
            total = batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy()
            good = pa.array(full | near_by_size(most, total))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(good) for c in ("a", "b")], names=["a", "b"])
        give_back()

    sides = [heads.select(F.col("head").alias(c), F.col("n").alias(f"n_{c}"), F.col("bins").alias(f"bins_{c}")) for c in ("a", "b")]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "n_b", "bins_a", "bins_b").mapInArrow(run, PAIRS)


def near_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) with a Jaccard similarity of at least ``NEAR``; ``sets`` (id, members), sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sides = [batch.column(c).flatten().to_numpy() for c in ("members_a", "members_b")]
            ends = [np.cumsum(batch.column(c).value_lengths().to_numpy()) for c in ("members_a", "members_b")]
            good, x0, y0 = [], 0, 0
            for x1, y1 in zip(ends[0].tolist(), ends[1].tolist()):
                both = np.concatenate([sides[0][x0:x1], sides[1][y0:y1]])
                both.sort(kind="stable")
                good.append(bool(near_by_size(int((both[1:] == both[:-1]).sum()), len(both))))
                x0, y0 = x1, y1
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(good) for c in ("a", "b")], names=["a", "b"])
        give_back()

    sides = [sets.select(F.col("id").alias(c), F.col("members").alias(f"members_{c}")) for c in ("a", "b")]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "members_a", "members_b").mapInArrow(run, PAIRS)


def with_members(rows: DataFrame, keep: list[str], size: int) -> DataFrame:
    """``rows`` with members, the text's set as sorted hashes."""

    def factory():
        sets = ShingleSets(size)
        return lambda texts: [[s.view(np.int64) for s in sets(utf8(texts))]]

    return with_columns(rows, ["text"], [T.StructField("members", T.ArrayType(T.LongType()))], factory, keep)


def near_copies(rows: DataFrame, row: str, id_col: str = "doc_id", size: int = STAGE_SHINGLE) -> DataFrame:
    """(component, first): the groups of texts whose shingle sets are near; first is the row number of a group's first.

    ``rows`` has row (numbers from 1), ``id_col`` and text.  Fingerprints link
    sets first.  Every pair at ``NEAR`` shares an element of both prefixes, so
    comparing those of different groups misses no link.  Large keys are linked
    by stars before their pairs across components are compared.  The first row
    has the least id, null last.
    """
    named = rows.select(row, F.col(id_col).alias("id"), "text")
    sets = materialize(with_sets(named, [row, "id"], hot_shingles(named, row, size), size), "sets")
    by_set = sets.groupBy("set_id")
    order = F.struct(F.col("id").isNull().alias("null"), "id", "set_id", F.col(row).alias("row"))
    heads = by_set.agg(F.min(row).alias("head"), F.min(order).alias("best"), F.first("set_size").alias("n"), F.first("fp").alias("fp"), F.first("bins").alias("bins"), F.first("bits").alias("bits"))
    heads = materialize(heads, "set-heads")
    prefixes = by_set.agg(F.min(row).alias("id"), F.first("set_size").alias("n"), F.first("prefix").alias("prefix"))
    posts = materialize(shared_posts(prefixes.select("n", "id", F.posexplode("prefix").alias("at", "key"))), "posts")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = materialize(possible_pairs(pairs, heads), "candidates")
        wanted = pairs.select(F.col("a").alias(row)).union(pairs.select("b")).distinct()
        texts = rows.select(row, "text").join(wanted, row, "left_semi").withColumnRenamed(row, "id")
        return materialize(near_pairs(pairs, with_members(texts, ["id"], size)), "near-pairs")

    def across(posts: DataFrame, found: DataFrame, guided: bool) -> DataFrame:
        comps = joined(found, "near").withColumnRenamed("node", "head")
        sides = heads.join(comps, "head", "left").select(F.col("head").alias("id"), F.coalesce("component", "head").alias("comp"), "bits")
        return found.union(verified(candidate_pairs(posts.join(sides, "id"), guided)))

    found = across(posts, verified(linked_sets(heads)), guided=True)
    left = posts.where(F.col("held") > GROUP)
    if left.limit(1).count():
        found = across(left, found, guided=False)
    members = joined(found, "near").withColumnRenamed("node", "head")
    named = heads.select("head", "best").join(members, "head", "left")
    return named.groupBy(F.coalesce("component", "head").alias("component")).agg(F.min("best").alias("best")).select("component", F.col("best.row").alias("first"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the least doc_id of each group of texts at 5-word Jaccard ``NEAR`` or more; null ids come last.

    Rows are told apart by a number of their own, so rows that share a doc_id
    or have none are documents like others.
    """
    row = hidden(docs, "_row")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id() + 1), "numbered")
    done = tables(spark)
    kept = materialize(near_copies(rows, row).select(F.col("first").alias(row)), "kept")
    done("kept")
    dropped = materialize(rows.select(row).join(kept, row, "left_anti"), "dropped")
    few = dropped.count() <= MOST_DROPPED
    out = rows.join(F.broadcast(dropped), row, "left_anti") if few else rows.join(kept, row, "left_semi")
    return out.select(*[f"`{c}`" for c in docs.columns])

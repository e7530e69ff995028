"""Windows that occur again in a table of documents: the frame of two operators.

A document is a string of units (bytes or words), and a window ``W``
consecutive units.  Of the ``W - q + 1`` q-grams of a window the one with the
least hash is its anchor, which depends on the window's content only: equal
windows have equal anchors at equal places, and neighbouring windows mostly
share theirs, so a fraction of the positions stands for all of them exactly.

1. ``_anchors``: every document's anchors, packed by hash bucket of the key.
   What a batch of documents already shows to be shared is settled there and
   sends one row a key to the bucket, however often the batch holds it.
2. ``_shared``: buckets keep the anchors that other documents hold too, and
   pack them by document bucket.
3. ``_contexts``: document buckets meet their documents and send, for each
   shared anchor, the units of its windows, packed by key bucket.  Equal
   contexts of a document bucket are packed as one row with their number,
   and its members stay with the document bucket.
4. ``_resolve``: in key buckets the operator's method tells by exact content
   which windows recur; each row gets back its runs of such windows and where
   they begin first.  What the method does not find is not removed.
5. ``_removed``: document buckets meet their documents again, over the same
   exchange; the operator locates the runs' occurrences in them, and those
   after the first are removed.

All that is shuffled are packed anchors, contexts of shared anchors, runs and
the documents once.  Buckets follow the size of the table, so that one fits in
a task's memory; no stage collects a whole group of copies.  Documents without
an id get numbers below all ids, from a hash of their text, and so spread over
the buckets; they compare as one id all the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, slices
from .token_files import estimated_bytes

#: Units hashed at once, Arrow bytes of documents that settle anchors together, Parquet bytes a bucket stands for,
#: and the fewest buckets a partition.
CHUNK_UNITS = 1 << 20
BATCH_BYTES = 8 << 20
BUCKET_BYTES = 4 << 20
BUCKETS_A_PARTITION = 2
#: Numbers of documents without an id begin here and end before the second.
NULL_ID, LEAST_ID = -(1 << 63), -(1 << 63) + (1 << 48)
#: Bytes of contexts that the method gets at once, whole anchors at a time.
METHOD_BYTES = 1 << 18

_C1, _C2, _C3 = (np.uint64(c) for c in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= _C2
    h ^= h >> np.uint64(29)
    h *= _C1
    h ^= h >> np.uint64(32)
    return h


class Bytes:
    """UTF-8 bytes as units."""

    def __init__(self, window: int, q: int):
        assert 16 <= q <= 24
        self.window, self.q = window, q

    def split(self, raw: bytes):
        return raw

    def part(self, units, start: int, end: int) -> bytes:
        return units[start:end]

    def anchor_of(self, context: bytes, back: int) -> bytes:
        return context[back : back + self.q]

    def codes(self, docs: list) -> np.ndarray:
        return np.frombuffer(b"".join(docs) + bytes(8), np.uint8)

    def hashes(self, codes: np.ndarray, n: int) -> np.ndarray:
        """Of the q-gram at each of the first ``n`` places, from three overlapping loads."""
        loads = np.ndarray((len(codes) - 7,), "<u8", codes, strides=(1,)).astype(np.uint64)
        h = loads[:n] * _C1
        h ^= h >> np.uint64(31)
        h += loads[8 : n + 8] * _C2
        h ^= h >> np.uint64(29)
        h += loads[self.q - 8 : n + self.q - 8] * _C3
        return mixed(h)


class Words:
    """Words between ASCII white space as units."""

    MEMO = 500_000

    def __init__(self, window: int, q: int):
        self.window, self.q, self.known = window, q, {}

    def __getstate__(self):
        return self.window, self.q

    def __setstate__(self, state):
        self.__init__(*state)

    def split(self, raw: bytes):
        return raw.split()

    def part(self, units, start: int, end: int) -> bytes:
        return b" ".join(units[start:end])

    def anchor_of(self, context: bytes, back: int) -> bytes:
        return b" ".join(context.split(b" ")[back : back + self.q])

    def codes(self, docs: list) -> np.ndarray:
        import xxhash

        known, digest = self.known, xxhash.xxh3_64_intdigest
        if len(known) > self.MEMO:
            known.clear()
        for word in set().union(*docs).difference(known):
            known[word] = digest(word)
        total = sum(map(len, docs))
        return np.fromiter((known[w] for d in docs for w in d), np.uint64, total)

    def hashes(self, codes: np.ndarray, n: int) -> np.ndarray:
        h = np.zeros(n, np.uint64)
        for k in range(self.q):
            h = h * _C3 + codes[k : n + k]
        return mixed(h)


@dataclass
class Anchors:
    """Anchors of a list of documents: its document, key, first window, place in it and number of windows."""

    doc: np.ndarray
    key: np.ndarray
    first: np.ndarray
    back: np.ndarray
    n: np.ndarray


def anchors(units, docs: list) -> Anchors:
    """Of consecutive documents, all at once; windows never cross documents."""
    window, q = units.window, units.q
    lengths = np.array([len(d) for d in docs], np.int64)
    total = int(lengths.sum())
    empty = np.empty(0, np.int64)
    if not (lengths >= window).any():
        return Anchors(empty, empty.astype(np.uint64), empty, empty, empty)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    h = units.hashes(units.codes(docs), total - q + 1)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, span = window - q + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    inside = np.zeros(total + 1, np.int8)
    fits = lengths >= window
    np.add.at(inside, starts[fits], 1)
    np.add.at(inside, ends[fits] - window + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[: len(low)]))
    place = (low[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.diff(place, prepend=-1))
    place, first = place[new], at[new]
    n = np.diff(np.append(new, len(at)))
    doc = np.searchsorted(ends, first, side="right")
    return Anchors(doc, h[place] & np.uint64((1 << 8 * KEY_BYTES) - 1), first - starts[doc], place - first, n)


#: Columns of an occurrence: anchor key, document, first window, the anchor's place after it, windows.
OCC = np.dtype([("key", "<u8"), ("doc", "<i8"), ("first", "<i4"), ("back", "u1"), ("n", "u1")])
#: Of a context: rep numbers its document bucket's contexts, many counts those equal to it there.
CTX = np.dtype([("doc", "<i8"), ("first", "<i4"), ("back", "u1"), ("n", "u1"), ("rep", "<u4"), ("many", "<u4")])
#: Of a context's member; ``nth`` numbers the different texts that rows with one doc_id have.
MEM = np.dtype([("doc", "<i8"), ("nth", "<u4"), ("first", "<i4"), ("rep", "<u4")])
#: Of a run of a context's windows that recur, from offset off on, and the document and place of the first occurrence.
RUN = np.dtype([("rep", "<u4"), ("off", "u1"), ("n", "u1"), ("least", "<i8"), ("place", "<i4")])
RANGE = np.dtype([("doc", "<i8"), ("nth", "<u4"), ("start", "<i4"), ("end", "<i4")])
#: Columns packed as differences.
STEPS = ("doc", "first", "rep", "least", "place")


def by_id(doc: np.ndarray) -> np.ndarray:
    """Documents' numbers as they compare: those without an id are alike."""
    return np.where(doc < LEAST_ID, NULL_ID, doc)


#: Bytes of a key that are kept.  Keys only choose what is compared, so a chance collision costs a comparison.
KEY_BYTES = 6


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def unsqueezed(blob: bytes) -> bytes:
    return pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)


def pack(rows: np.ndarray) -> bytes:
    """Column after column, documents as differences, compressed: rows come in document order."""
    parts = []
    for c in rows.dtype.names:
        values = np.ascontiguousarray(rows[c])
        if c in STEPS and len(values):
            values = np.concatenate([values[:1], values[1:] - values[:-1]])
        parts.append(values.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes() if c == "key" else values.tobytes())
    return squeezed(b"".join(parts))


def unpack(blob: bytes, dtype: np.dtype) -> np.ndarray:
    data = unsqueezed(blob)
    size = dtype.itemsize - (8 - KEY_BYTES) * ("key" in dtype.names)
    n, at = len(data) // size, 0
    out = np.empty(n, dtype)
    for c in dtype.names:
        if c == "key":
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :KEY_BYTES] = np.frombuffer(data, np.uint8, n * KEY_BYTES, at).reshape(n, KEY_BYTES)
            out[c], at = wide.view("<u8").ravel(), at + n * KEY_BYTES
        else:
            out[c] = np.frombuffer(data, dtype[c], n, at)
            at += n * dtype[c].itemsize
    for c in dtype.names:
        if c in STEPS:
            out[c] = np.cumsum(out[c], dtype=dtype[c])
    return out


def unpack_all(blobs, dtype: np.dtype) -> np.ndarray:
    parts = [unpack(b, dtype) for b in blobs]
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def split_by(rows: np.ndarray, group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(group, kind="stable")
    group, rows = group[order], rows[order]
    cuts = np.flatnonzero(np.diff(group)) + 1
    for part, g in zip(np.split(rows, cuts), group[np.concatenate([[0], cuts])] if len(group) else ()):
        yield int(g), part


def doc_bucket(doc: np.ndarray, n: int) -> np.ndarray:
    """As ``doc_bucket_column`` does."""
    folded = doc ^ (doc.view(np.uint64) >> np.uint64(17)).view(np.int64)
    return np.mod(folded, n)


def doc_bucket_column(doc, n: int):
    return F.pmod(doc.bitwiseXOR(F.shiftrightunsigned(doc, 17)), F.lit(n)).cast("int")


def runs_of(sorted_keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1]) if len(sorted_keys) else np.empty(0, np.int64)


def shared_here(rows: np.ndarray, across: bool, stands: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(which rows share their key with another here, and one row of each such key).

    ``across``: only keys of two documents count as shared.  A row that
    ``stands`` for a key makes it shared by itself.
    """
    order = np.lexsort((rows["doc"], rows["key"]))
    keys, docs = rows["key"][order], rows["doc"][order]
    starts = runs_of(keys)
    sizes = np.diff(np.append(starts, len(order)))
    many = docs[starts] != docs[starts + sizes - 1] if across and len(starts) else sizes > 1
    if stands is not None and len(starts):
        many = many | np.logical_or.reduceat(stands[order], starts)
    out = np.empty(len(rows), bool)
    out[order] = np.repeat(many, sizes)
    return out, order[starts[many]]


SCHEMA = "bucket int, kind int, blob binary"


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows)) or [[], [], []]
    return pa.table({"bucket": pa.array(columns[0], pa.int32()), "kind": pa.array(columns[1], pa.int32()), "blob": pa.array(columns[2], pa.binary())})


#: Kinds of packed rows on the way to key buckets: the only one of its batch, one that stands for a shared key, and settled ones.
ALONE, STANDS, SETTLED = 0, 1, 2


def _anchors(docs: DataFrame, units, n_buckets: int, across: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_BYTES):
            found, held, size = [], [], 0

            def flush(held):
                a = anchors(units, [h[1] for h in held])
                rows = np.empty(len(a.key), OCC)
                ids = np.array([h[0] for h in held], np.int64)
                for c, v in zip(OCC.names, (a.key, ids[a.doc], a.first, a.back, a.n)):
                    rows[c] = v
                found.append(rows)

            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                held.append((doc, units.split(raw or b"")))
                size += len(held[-1][1])
                if size >= CHUNK_UNITS:
                    flush(held)
                    held, size = [], 0
            if held:
                flush(held)
            rows = np.concatenate(found) if found else np.empty(0, OCC)
            shared, heads = shared_here(rows, across)
            out = [(b, ALONE, pack(p)) for b, p in split_by(rows[~shared], (rows["key"][~shared] % np.uint64(n_buckets)).astype(np.int64))]
            settled, firsts = rows[shared], rows[np.sort(heads)]
            out += [(b, STANDS, pack(p)) for b, p in split_by(firsts, (firsts["key"] % np.uint64(n_buckets)).astype(np.int64))]
            # Settled rows need no bucket in particular; they are dealt by document.
            out += [(b, SETTLED, pack(p)) for b, p in split_by(settled, doc_bucket(settled["doc"], n_buckets))]
            yield from _batch(out).to_batches()
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def _shared(packed: DataFrame, n_docs: int, across: bool) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        kinds, blobs = np.array(group.column("kind")), group.column("blob").to_pylist()
        parts = [unpack_all((b for b, k in zip(blobs, kinds) if k == kind), OCC) for kind in (ALONE, STANDS, SETTLED)]
        rows = np.concatenate(parts[:2])
        stands = np.repeat([False, True], [len(parts[0]), len(parts[1])])
        shared, _ = shared_here(rows, across, stands)
        # Those that stand for a settled key are among the settled rows themselves.
        kept = np.concatenate([rows[shared & ~stands], parts[2]])
        kept = kept[np.lexsort((kept["first"], kept["doc"]))]
        return _batch([(b, 0, pack(p)) for b, p in split_by(kept, doc_bucket(kept["doc"], n_docs))])

    return packed.groupBy("bucket").applyInArrow(run, SCHEMA)


def _docs_of(group: pa.Table) -> dict[int, list[bytes]]:
    """The different texts of each document number, in order; both visits of a bucket number them alike."""
    out: dict[int, set[bytes]] = {}
    for doc, raw in zip(group.column("doc_id").to_pylist(), group.column("text").cast(pa.binary()).to_pylist()):
        out.setdefault(doc, set()).add(raw or b"")
    return {doc: sorted(held) for doc, held in out.items()}


CONTEXTS = "bucket int, kind int, blob binary, texts binary"


def pack_texts(texts: list[bytes]) -> bytes:
    lengths = np.array([len(t) for t in texts], "<i4").tobytes()
    return squeezed(len(texts).to_bytes(8, "little") + lengths + b"".join(texts))


def unpack_texts(blob: bytes) -> list[bytes]:
    data = unsqueezed(blob)
    n = int.from_bytes(data[:8], "little")
    at = 8 + 4 * n
    ends = (np.cumsum(np.frombuffer(data, "<i4", n, 8)) + at).tolist()
    return [data[a:b] for a, b in zip([at, *ends], ends)]


#: Kinds of packed rows on the way back: runs, and members, which pass through the key buckets unread.
RUNS, MEMBERS = 0, 1


def _contexts(docs: DataFrame, shared: DataFrame, units, n_buckets: int) -> DataFrame:
    tail = units.window - 1

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = unpack_all(right.column("blob").to_pylist(), OCC)
        # By earliness; a place that repeated rows of a document give twice counts once.
        rows = rows[np.lexsort((rows["key"], rows["first"], rows["doc"], by_id(rows["doc"])))]
        same = np.ones(max(len(rows) - 1, 0), bool)
        for c in OCC.names:
            same &= rows[c][1:] == rows[c][:-1]
        rows = rows[np.concatenate([[True], ~same])] if len(rows) else rows
        texts = _docs_of(left) if len(rows) else {}
        numbers: dict[tuple[int, bytes], int] = {}
        sent, groups, contexts, many, members = [], [], [], [], []
        here, parts = None, []
        for key, doc, first, back, n in rows.tolist():
            if here != doc:
                here, parts = doc, [units.split(t) for t in texts[doc]]
            for nth, part in enumerate(parts):
                # Of several texts with one doc_id an anchor is one's; the others' contexts there do no harm.
                end = first + n + tail
                if end > len(part):
                    continue
                context = units.part(part, first, end)
                rep = numbers.setdefault((key, context), len(sent))
                if rep == len(sent):
                    sent.append((doc, first, back, n, rep, 0))
                    groups.append(key % n_buckets)
                    contexts.append(context)
                    many.append(0)
                many[rep] += 1
                members.append((doc, nth, first, rep))
        out = []
        if sent:
            chosen, group = np.array(sent, CTX), np.array(groups)
            chosen["many"] = many
            order = np.argsort(group, kind="stable")
            cuts = np.flatnonzero(np.diff(group[order])) + 1
            for part in np.split(order, cuts):
                out.append((int(group[part[0]]), RUNS, pack(chosen[part]), pack_texts([contexts[k] for k in part])))
            held = np.array(members, MEM)
            out.append((int(doc_bucket(held["doc"][:1], n_buckets)[0]), MEMBERS, pack(held), None))
        columns = list(zip(*out)) or [[], [], [], []]
        del sent, contexts, numbers, texts, members
        give_back()
        return pa.table(
            {
                "bucket": pa.array(columns[0], pa.int32()),
                "kind": pa.array(columns[1], pa.int32()),
                "blob": pa.array(columns[2], pa.binary()),
                "texts": pa.array(columns[3], pa.binary()),
            }
        )

    return docs.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(run, CONTEXTS)


#: (contexts, their groups' numbers, windows of each, how many equal contexts each stands for) -> one number a window, equal
#: for equal windows of a group, negative where a window does not recur.
Identify = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _resolve(contexts: DataFrame, units, n_docs: int, by_place: bool, identify: Identify) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        kinds, blobs = np.array(group.column("kind")), group.column("blob").to_pylist()
        out = [(int(b), MEMBERS, blob) for b, k, blob in zip(group.column("bucket").to_pylist(), kinds, blobs) if k == MEMBERS]
        rows = unpack_all((b for b, k in zip(blobs, kinds) if k == RUNS), CTX)
        texts = [t for blob, k in zip(group.column("texts").to_pylist(), kinds) if k == RUNS for t in unpack_texts(blob)]
        found, holder = recurring(rows, texts, units, by_place, identify)
        order = np.lexsort((found["off"], found["rep"]))
        found, holder = found[order], holder[order]
        out += [(b, RUNS, pack(p)) for b, p in split_by(found, doc_bucket(holder, n_docs))]
        del rows, texts
        give_back()
        return _batch(out)

    return contexts.groupBy("bucket").applyInArrow(run, SCHEMA)


def recurring(rows: np.ndarray, texts: list[bytes], units, by_place: bool, identify: Identify) -> tuple[np.ndarray, np.ndarray]:
    """The runs of windows of ``rows`` that the method finds to recur, and the documents they are for.

    Rows with an equal context and anchor form a class and are one context to
    the method, which stands for all of them.
    """
    nothing = np.empty(0, RUN), np.empty(0, np.int64)
    if not len(rows):
        return nothing
    order = np.lexsort((rows["first"], by_id(rows["doc"])))
    numbers: dict[tuple[int, bytes], int] = {}
    backs = rows["back"].tolist()
    of_row = np.empty(len(rows), np.int64)
    least: list[int] = []
    for i in order.tolist():  # earliest first
        c = numbers.setdefault((backs[i], texts[i]), len(least))
        if c == len(least):
            least.append(i)
        of_row[i] = c
    del numbers
    weight = np.bincount(of_row, rows["many"], len(least)).astype(np.int64)
    anchors_seen: dict[bytes, int] = {}
    anchor = np.array([anchors_seen.setdefault(units.anchor_of(texts[i], backs[i]), len(anchors_seen)) for i in least])
    by_key = np.argsort(anchor, kind="stable")
    starts = runs_of(anchor[by_key])
    sizes = np.diff(np.append(starts, len(by_key)))
    # A class of one row that is alone on its anchor can't recur.
    several = np.repeat(sizes > 1, sizes) | (weight[by_key] > 1)
    chosen = by_key[several]
    if not len(chosen):
        return nothing
    groups = np.repeat(np.arange(len(starts)), sizes)[several]
    heads = rows[np.array(least)[chosen]]
    n = heads["n"].astype(np.int64)
    # Whole anchors at a time, as windows are equal only within one.
    lengths = np.cumsum([len(texts[least[c]]) for c in chosen.tolist()])
    begins = runs_of(groups)
    part = (lengths[begins] - 1) // METHOD_BYTES
    cuts = begins[np.flatnonzero(np.diff(part, prepend=-1))].tolist()
    ids, base = [], 0
    for a, b in zip(cuts, [*cuts[1:], len(chosen)]):
        some = identify([texts[least[c]] for c in chosen[a:b].tolist()], groups[a:b], n[a:b], weight[chosen[a:b]])
        ids.append(np.where(some >= 0, some + base, -1))
        base += int(some.max(initial=0)) + 1
    ids = np.concatenate(ids)
    cls = np.repeat(np.arange(len(chosen)), n)
    offset = np.arange(len(cls)) - np.repeat(np.cumsum(n) - n, n)
    at = np.flatnonzero(ids >= 0)
    if not len(at):
        return nothing
    ids, cls, offset = ids[at], cls[at], offset[at]
    doc, place = heads["doc"][cls], heads["first"][cls] + offset
    order = np.lexsort((place, by_id(doc), ids))
    runs = runs_of(ids[order])
    first = np.empty(len(order), np.int64)
    first[order] = np.repeat(order[runs], np.diff(np.append(runs, len(order))))
    least_doc, least_place = doc[first], place[first]
    new = (np.diff(cls, prepend=-1) != 0) | (np.diff(offset, prepend=-2) != 1) | (np.diff(least_doc, prepend=least_doc[:1]) != 0)
    if by_place:
        new |= np.diff(least_place, prepend=least_place[:1]) != 1
    begins = np.flatnonzero(new)
    spans = np.empty(len(begins), RUN)
    spans["off"], spans["n"] = offset[begins], np.diff(np.append(begins, len(cls)))
    spans["least"], spans["place"] = least_doc[begins], least_place[begins] if by_place else 0
    # To each row of a run's class.
    rank = np.full(len(least), -1)
    rank[chosen] = np.arange(len(chosen))
    mine = np.flatnonzero(rank[of_row] >= 0)
    at_class = rank[of_row[mine]]
    low, high = np.searchsorted(cls[begins], at_class), np.searchsorted(cls[begins], at_class, side="right")
    row = np.repeat(mine, high - low)
    which = np.arange(len(row)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
    out = spans[which]
    out["rep"] = rows["rep"][row]
    # A context that its bucket holds once, and first of all, loses nothing there.
    doc = rows["doc"][row]
    keep = (rows["many"][row] > 1) | (by_id(doc) != by_id(out["least"]))
    if by_place:
        keep |= rows["first"][row] + out["off"] != out["place"]
    return out[keep], doc[keep]


def later(doc, place, least, least_place, by_place: bool):
    """Whether windows at ``place`` of ``doc`` come after those at ``least_place`` of ``least``."""
    doc, least = by_id(doc), by_id(least)
    return (doc > least) | (by_place & (doc == least) & (place > least_place))


#: A run of windows at a place of a document that come after their first occurrences.
LATE = np.dtype([("doc", "<i8"), ("nth", "<u4"), ("start", "<i8"), ("n", "<i8"), ("least", "<i8"), ("place", "<i8")])


def late_runs(members: np.ndarray, runs: np.ndarray, by_place: bool) -> np.ndarray:
    """The members' places of each run that come after its first occurrence; runs that go on in both are one."""
    members = members[np.argsort(members["rep"], kind="stable")]
    low, high = np.searchsorted(members["rep"], runs["rep"]), np.searchsorted(members["rep"], runs["rep"], side="right")
    run = np.repeat(np.arange(len(runs)), high - low)
    which = np.arange(len(run)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
    out = np.empty(len(run), LATE)
    for c in ("doc", "nth"):
        out[c] = members[c][which]
    for c in ("n", "least", "place"):
        out[c] = runs[c][run]
    out["start"] = members["first"][which].astype(np.int64) + runs["off"][run]
    out = out[later(out["doc"], out["start"], out["least"], out["place"], by_place)]
    out = out[np.lexsort((out["start"], out["nth"], out["doc"]))]
    if not len(out):
        return out
    goes_on = out["start"][1:] == out["start"][:-1] + out["n"][:-1]
    for c in ("doc", "nth", "least"):
        goes_on &= out[c][1:] == out[c][:-1]
    if by_place:
        goes_on &= out["place"][1:] == out["place"][:-1] + out["n"][:-1]
    begins = np.concatenate([[0], np.flatnonzero(~goes_on) + 1])
    whole = out[begins]
    whole["n"] = np.add.reduceat(out["n"], begins)
    return whole


def by_members(members: np.ndarray, runs: np.ndarray, texts: dict, units, by_place: bool) -> np.ndarray:
    """The ranges to remove where a run's occurrences are those of its context's members."""
    late = late_runs(members, runs, by_place)
    out = np.empty(len(late), RANGE)
    out["doc"], out["nth"], out["start"], out["end"] = late["doc"], late["nth"], late["start"], late["start"] + late["n"] + units.window - 1
    return out


#: (members, runs, texts of the bucket, units, by_place) -> the ranges to remove.
Locate = Callable[[np.ndarray, np.ndarray, dict, object, bool], np.ndarray]


def union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges covered, sorted; touching ranges are one."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]])) if len(starts) else np.empty(0, np.int64)
    return starts[new], reach[np.append(new[1:], len(starts)) - 1] if len(starts) else reach


def _removed(docs: DataFrame, back: DataFrame, units, by_place: bool, locate: Locate, schema: str, finish: Callable) -> DataFrame:
    """``finish``(raw text, removed starts, ends) gives the values of ``schema`` after doc_id."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(f"doc_id long, {schema}"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds, blobs = right.column("kind").to_pylist(), right.column("blob").to_pylist()
        runs = unpack_all((b for b, k in zip(blobs, kinds) if k == RUNS), RUN)
        texts = _docs_of(left)
        found = np.empty(0, RANGE)
        if len(runs):
            members = unpack_all((b for b, k in zip(blobs, kinds) if k == MEMBERS), MEM)
            found = locate(members, runs, texts, units, by_place)
            del members
        found = found[np.lexsort((found["nth"], found["doc"]))]
        cuts = np.flatnonzero((np.diff(found["doc"]) != 0) | (np.diff(found["nth"].astype(np.int64)) != 0)) + 1 if len(found) else []
        spans = {(int(p["doc"][0]), int(p["nth"][0])): p for p in np.split(found, cuts)} if len(found) else {}
        rows, none = [], np.empty(0, np.int64)
        nths = {doc: {raw: k for k, raw in enumerate(held)} for doc, held in texts.items()}
        for doc, raw in zip(left.column("doc_id").to_pylist(), left.column("text").cast(pa.binary()).to_pylist()):
            raw = raw or b""
            p = spans.get((doc, nths[doc][raw]))
            a, b = union(p["start"].astype(np.int64), p["end"].astype(np.int64)) if p is not None else (none, none)
            rows.append((None if doc < LEAST_ID else doc, *finish(raw, a, b)))
        columns = list(zip(*rows)) or [[] for _ in target]
        out = pa.table([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)
        del texts, nths, rows, spans, columns
        give_back()
        return out

    return docs.groupBy("bucket").cogroup(back.groupBy("bucket")).applyInArrow(run, f"doc_id long, {schema}")


def find(
    docs: DataFrame, units, identify: Identify, by_place: bool, schema: str, finish: Callable, locate: Locate = by_members, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row for each row of ``docs``: doc_id and what ``finish`` makes of its text and removed ranges.

    ``by_place``: a window is later also after its own document's earlier
    ones, else only after those of smaller doc_ids.  ``locate`` finds the
    recurring windows' occurrences in a bucket's documents.
    """
    spark = docs.sparkSession
    unnamed = F.lit(NULL_ID) + F.pmod(F.xxhash64(F.col(text_col)), F.lit(1 << 48))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), unnamed).alias("doc_id"), F.col(text_col).alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(BUCKETS_A_PARTITION * partitions, estimated_bytes(rows) // BUCKET_BYTES) | 1
    bucketed = rows.select("doc_id", "text", doc_bucket_column(F.col("doc_id"), n).alias("bucket"))
    shared = _shared(_anchors(rows, units, n, not by_place), n, not by_place)
    contexts = _contexts(bucketed, shared, units, n)
    back = _resolve(contexts, units, n, by_place, identify)
    return _removed(bucketed, back, units, by_place, locate, schema, finish)

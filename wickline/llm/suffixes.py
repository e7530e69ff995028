"""Duplicate byte strings, by bucket-pointer refinement of suffixes.

Suffixes are put into buckets by their first q-gram.  A bucket of strings
equal in their first L bytes is refined by sorting on the buckets of the
suffixes L (or fewer) bytes on, which doubles what the buckets are equal in;
the refined buckets are used in the next round.  At the window's length,
suffixes in one bucket begin with the same window.  Suffixes already alone in
their bucket are final and left out of later rounds.

The suffixes that can share a window are found, and dealt out by anchor, by
``repeats``.  Equal contexts are packed as one that stands for all of them;
every removal rests on the bucket that refinement gives a window.

Defined cases: null reads as empty; texts shorter than the window lose
nothing; a null doc_id comes before all others; rows that share a doc_id, or
have none, are separate texts, none of them smaller than another; repeated
rows lose the same; an empty table gives no rows; columns besides doc_id and
text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import repeats
from .common import table

WINDOW = 50
ANCHOR = 16


def ranks(values: np.ndarray) -> np.ndarray:
    """Bucket numbers: equal for equal values, in their order."""
    order = np.argsort(values)
    ordered = values[order]
    out = np.empty(len(values), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]) if len(values) else 0
    return out


def refine(text: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """A bucket number for each suffix start ``at``; equal exactly if ``window`` bytes are equal.

    ``text`` must reach ``window + 8`` bytes beyond every start.
    """
    loads = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    steps, length = [], 8
    while length < window:
        steps.append(min(length, window - length))
        length += steps[-1]
    # Which suffixes each round needs: the starts, and those its buckets point to.
    needed = np.zeros(len(loads), bool)
    needed[at] = True
    rounds = [needed]
    for step in reversed(steps):
        wider = rounds[-1].copy()
        wider[step:] |= rounds[-1][:-step]
        rounds.append(wider)
    places = np.flatnonzero(rounds.pop())
    buckets = np.zeros(len(loads), np.int64)
    buckets[places] = ranks(loads[places])
    for step in steps:
        places = np.flatnonzero(rounds.pop())
        mine = buckets[places]
        open_ = np.bincount(mine)[mine] > 1  # suffixes alone in their bucket need no more
        refined = np.empty(len(places), np.int64)
        refined[open_] = ranks(mine[open_] << 32 | buckets[places[open_] + step])
        base = int(refined[open_].max()) + 1 if open_.any() else 0
        refined[~open_] = base + np.arange(int((~open_).sum()))
        buckets[places] = refined
    return buckets[at]


def identify(contexts: list[bytes], groups: np.ndarray, n: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Bucket numbers of the contexts' windows, negative for windows alone in theirs; a context's suffixes count ``weights`` times."""
    lengths = np.array([len(c) for c in contexts], np.int64)
    starts = np.cumsum(lengths) - lengths
    text = np.frombuffer(b"".join(contexts) + bytes(WINDOW + 16), np.uint8)
    at = np.repeat(starts, n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    found = refine(text, at, WINDOW)
    return np.where(np.bincount(found, np.repeat(weights, n))[found] > 1, found, -1)


def _digest(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple:
    kept, done = [], 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        kept.append(raw[done:a])
        done = b
    kept.append(raw[done:])
    return len(raw), int((ends - starts).sum()), len(starts), hashlib.sha256(b"".join(kept)).hexdigest()


def _spans(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple:
    kept, done = [], 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        kept.append(raw[done:a])
        done = b
    kept.append(raw[done:])
    return (*_digest(raw, starts, ends), np.stack([starts, ends], 1).ravel().tolist(), b"".join(kept))


DIGEST = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def duplicate_bytes(docs: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id with counts, and if asked spans (flat starts and ends, in bytes) and kept, the bytes left."""
    schema, finish = (f"{DIGEST}, spans array<int>, kept binary", _spans) if texts else (DIGEST, _digest)
    return repeats.find(docs, repeats.Bytes(WINDOW, ANCHOR), identify, False, schema, finish)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_bytes(table(spark, sf_dir, "documents"), texts=False)

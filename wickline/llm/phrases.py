"""Repeated phrases, removed after their first occurrence, by Aho-Corasick automata.

``repeats`` deals the candidate passages out by anchor and confirms by their
words which windows of a passage recur.  Each document bucket gets the runs
of such windows that its documents hold, as places in them, with where each
occurs first in the table; a run as long as it goes on is a phrase.  Phrases
that come after their first occurrence somewhere in the bucket are compiled into
automata over word numbers, sharded by bucket and below a bound of words, and
all documents of the bucket are streamed through them to locate every
occurrence; those after the first one are removed.

Defined cases: null has no words; texts of fewer words than the window lose
nothing; a null doc_id comes before all others; rows that share a doc_id and
a text are one document, other rows that share a doc_id, or have none, follow
each other by place of the window; very long texts are streamed whole; an
empty table gives no rows; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import repeats
from .common import table
from .repeats import RANGE

WINDOW = 20
ANCHOR = 8


#: Words of phrases that one automaton holds.
SHARD_WORDS = 400_000


def confirm(contexts: list[bytes], groups: np.ndarray, n: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A number for each window of the contexts that recurs, by its words, and -1 for the others.

    The windows of one context differ from each other, as each has the anchor
    at a place of its own.
    """
    out = np.full(int(n.sum()), -1, np.int64)
    ends = np.cumsum(n)
    begins = repeats.runs_of(groups)
    given = 0
    for a, b in zip(begins.tolist(), np.append(begins[1:], len(groups)).tolist()):
        if b - a == 1:
            if weights[a] > 1:
                out[ends[a] - n[a] : ends[a]] = np.arange(given, given + n[a])
                given += int(n[a])
            continue
        counts: dict[tuple, int] = {}
        passages = [c.split(b" ") for c in contexts[a:b]]
        windows = [[tuple(p[i : i + WINDOW]) for i in range(len(p) - WINDOW + 1)] for p in passages]
        for part, weight in zip(windows, weights[a:b].tolist()):
            for w in part:
                counts[w] = counts.get(w, 0) + weight
        numbers = {w: given + k for k, w in enumerate(w for w, c in counts.items() if c > 1)}
        given += len(numbers)
        out[ends[a] - n[a] : ends[b - 1]] = [numbers.get(w, -1) for part in windows for w in part]
    return out


def automata(phrases: list[tuple[int, ...]]) -> Iterator:
    """Automata of the phrases, each below ``SHARD_WORDS`` words or of one phrase; values are the phrases' numbers."""
    held, words = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), 0
    for k, phrase in enumerate(phrases):
        if words and words + len(phrase) > SHARD_WORDS:
            held.make_automaton()
            yield held
            held, words = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), 0
        held.add_word(phrase, k)
        words += len(phrase)
    if words:
        held.make_automaton()
        yield held


def locate(members: np.ndarray, runs: np.ndarray, texts: dict[int, list[bytes]], units, by_place: bool) -> np.ndarray:
    """The ranges of the bucket's documents that hold a phrase after its first occurrence.

    A phrase is a passage of a document as long as its windows recur in a row,
    and their first occurrences too.
    """
    late = repeats.late_runs(members, runs, by_place)
    numbers: dict[bytes, int] = {}
    number = numbers.setdefault
    known: dict[tuple[int, ...], int] = {}
    chosen: list[int] = []
    here, words = None, []
    for i, (doc, nth, start, n) in enumerate(zip(*[late[c].tolist() for c in ("doc", "nth", "start", "n")])):
        if here != (doc, nth):
            here, words = (doc, nth), texts[doc][nth].split()
        phrase = tuple([number(w, len(numbers) + 1) for w in words[start : start + n + WINDOW - 1]])
        if known.setdefault(phrase, len(chosen)) == len(chosen):
            chosen.append(i)
    least, place = late["least"][chosen], late["place"][chosen]
    lengths = np.array([len(p) for p in known], np.int64)
    get = numbers.get
    streams = [(doc, nth, tuple([get(w, 0) for w in raw.split()])) for doc, held in texts.items() for nth, raw in enumerate(held)]
    out = [np.empty(0, RANGE)]
    for automaton in automata(list(known)):
        for doc, nth, words in streams:
            matches = list(automaton.iter(words)) if len(words) >= WINDOW else []
            if matches:
                last, which = np.array(matches, np.int64).T
                start = last + 1 - lengths[which]
                after = repeats.later(np.full(len(which), doc), start, least[which], place[which], by_place)
                rows = np.empty(int(after.sum()), RANGE)
                rows["doc"], rows["nth"], rows["start"], rows["end"] = doc, nth, start[after], last[after] + 1
                out.append(rows)
    return np.concatenate(out)


def _parts(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    words, kept, done = raw.split(), [], 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        kept += words[done:a]
        done = b
    return words, kept + words[done:]


def _digest(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple:
    words, kept = _parts(raw, starts, ends)
    return len(words), int((ends - starts).sum()), hashlib.sha256(b" ".join(kept)).hexdigest()


def _spans(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple:
    _, kept = _parts(raw, starts, ends)
    return (*_digest(raw, starts, ends), np.stack([starts, ends], 1).ravel().tolist(), b" ".join(kept).decode())


DIGEST = "n_words long, n_removed long, kept_sha256 string"


def repeated_phrases(docs: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id with counts, and if asked spans (flat starts and ends, in words) and kept, the words left."""
    schema, finish = (f"{DIGEST}, spans array<int>, kept string", _spans) if texts else (DIGEST, _digest)
    return repeats.find(docs, repeats.Words(WINDOW, ANCHOR), confirm, True, schema, finish, locate)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_phrases(table(spark, sf_dir, "documents"), texts=False)


#: DuckDB: the same contract by joining windows to their first occurrence.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS pat FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY pat ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM r),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.pos) AS kept, count(*) AS n FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.pos = c.pos GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

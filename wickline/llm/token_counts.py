"""Exact token counts of every prefix, by dynamic programming over the merges of a byte-pair vocabulary.

A sequence of tokens is what byte-pair encoding makes of their string exactly
if each neighbouring pair of them is: such a pair stays apart when no merge
across its border comes before those that made its two sides.  So the last
token of a prefix of ``i`` bytes is the one token that ends there and stays
apart from the last token of the prefix before it, and

    tokens(i) = tokens(i - length of the last token) + 1.

The recurrence runs once over a word, where a prefix's own last token is one
with a word end.  The table of a text holds the count of its every prefix,
stored as one signed byte a character: the step from the count before.
Counts, truncation to a budget and budget checks read the table; nothing is
encoded again.  Words are cut as the tokenizer's own file says, and the words
between blanks are worked out once a worker.

Defined cases: null reads as empty and has 0 tokens and an empty table; white
space has no tokens; special strings inside a text count as the library
counts them; repeated rows and doc_ids are counted each; a very long text
takes time and memory in proportion to its length; columns named as the new
ones are replaced.
"""

from __future__ import annotations

import json
import unicodedata
from itertools import accumulate
from operator import sub

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import table, with_columns

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Pieces, words and pairs of tokens that a worker keeps.
MEMO_PIECES, MEMO_WORDS, MEMO_PAIRS = 1_500_000, 300_000, 1_000_000

FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("prefix_steps", T.BinaryType())]

#: What the library's patterns mean by white space; Python's \s has a few more.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class Prefixes:
    """Token counts of all prefixes, for a vocabulary file of lower-cased byte-level words with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, cut = file["model"], file["pre_tokenizer"]["pretokenizers"]
        steps = [n["type"] for n in file["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cut] != ["Split", "ByteLevel"]:
            raise ValueError(f"{path}: not a vocabulary of lower-cased byte-level words")
        self.end = model["end_of_word_suffix"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {pair: k for k, pair in enumerate(pairs)}
        # A merged token's parts and rank; letters have none.
        self.parts = {a + b: (a, b, k) for k, (a, b) in reversed(list(enumerate(pairs)))}
        self.letters = byte_letters()
        self.pair: dict[int, bool] = {}
        made = dict.fromkeys([*self.letters, *[c + self.end for c in self.letters]], True)
        for a, b in pairs:  # parts come before what they make
            made[a + b] = made.get(a, False) and made.get(b, False) and self._apart(a, b, self.rank[a, b])
        # Tokens that the merges make of their own string: inside a word, and at its end without the mark of it.
        own = [t for t, itself in made.items() if itself]
        self.names = own
        self.inside, self.ending = ahocorasick.Automaton(), ahocorasick.Automaton()
        for number, token in enumerate(own):
            if token.endswith(self.end):
                core = token[: -len(self.end)]
                self.ending.add_word(core, (len(core), number))
            else:
                self.inside.add_word(token, (len(token), number))
        self.inside.make_automaton()
        self.ending.make_automaton()
        self.known: dict[str, list[int]] = {}
        self.words = regex.compile(cut[0]["pattern"]["Regex"].replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]"))
        special = [t["content"] for t in file["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def apart(self, a: int, b: int) -> bool:
        """Whether the tokens of these numbers stay what they are next to each other."""
        if len(self.pair) > MEMO_PAIRS:
            self.pair.clear()
        known = self.pair[a << 32 | b] = self._apart(self.names[a], self.names[b], len(self.rank))
        return known

    def _apart(self, a: str, b: str, limit: int) -> bool:
        """Whether no merge of rank below ``limit`` joins what is at the border of ``a`` and ``b``.

        Merges are undone from the last one back.  Of equal merges the left
        one comes first, so one that would take the left part of ``b`` away
        still wins against the equal one that made ``b``.
        """
        none = ("", "", -1)
        while True:
            if self.rank.get((a, b), limit) < limit:
                return False
            left, right = self.parts.get(a, none), self.parts.get(b, none)
            if left[2] < 0 and right[2] < 0:
                return True
            if left[2] > right[2]:
                a, limit = left[1], min(limit, left[2])
            else:
                b, limit = right[0], min(limit, right[2] + 1)

    def _word(self, word: str) -> list[int]:
        """Tokens of each prefix of one word, by characters."""
        known = self.known.get(word)
        if known is not None:
            return known
        if word.isascii() and word.isprintable():
            s, ends = word, None
        else:
            raw = [c.encode() for c in word]
            s, ends = "".join([self.letters[b] for r in raw for b in r]), list(accumulate(map(len, raw)))
        n, pair = len(s), self.pair
        last, count, whole = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        # The automata give the tokens that end at each place, places in order.
        for end, (length, token) in self.inside.iter(s):
            if not count[end + 1]:
                at = end + 1 - length
                if at:
                    apart = pair.get(last[at] << 32 | token)
                    if apart is None:
                        apart = self.apart(last[at], token)
                    if not apart:
                        continue
                last[end + 1] = token
                count[end + 1] = count[at] + 1
        for end, (length, token) in self.ending.iter(s):
            if not whole[end + 1]:
                at = end + 1 - length
                if at:
                    apart = pair.get(last[at] << 32 | token)
                    if apart is None:
                        apart = self.apart(last[at], token)
                    if not apart:
                        continue
                whole[end + 1] = count[at] + 1
        out = whole[1:] if ends is None else [whole[i] for i in ends]
        if len(word) <= 32:  # long words seldom come again
            if len(self.known) >= MEMO_WORDS:
                self.known.clear()
            self.known[word] = out
        return out

    def _text(self, text: str) -> list[int]:
        """Tokens of each prefix of a normalised text."""
        out, done, at = [], 0, 0
        for found in self.words.finditer(text):
            word = found[0]
            out += [done] * (found.start() - at)
            counts = self._word(word)
            if word[0] == "'" and len(word) > 1 and word[1].isalpha():
                # A contraction: until it is whole its letters are a word of their own.
                counts = [self._word("'")[0], *[self._word("'")[0] + c for c in self._word(word[1:-1])], counts[-1]]
            out += [done + c for c in counts]
            done, at = out[-1], found.end()
        return out + [done] * (len(text) - at)

    def _plain(self, text: str) -> list[int]:
        """Tokens of each prefix of a text without special strings."""
        if text.isascii():
            return self._text(text.lower())
        if not unicodedata.is_normalized("NFC", text):
            return self._composed(text)
        lower = [c.lower() for c in text]
        joined = "".join(lower)
        counts = self._word(joined) if joined.isalpha() else self._text(joined)
        return counts if len(joined) == len(text) else [counts[k - 1] for k in accumulate(map(len, lower))]

    def _composed(self, text: str) -> list[int]:
        """As ``_plain``, for texts with characters that compose: a prefix may end before the mark that joins them.

        Prefixes are worked out from the last place before which nothing
        composes with what follows and where a word is sure to begin.
        """
        out, base, start = [], 0, 0
        for k in range(1, len(text) + 1):
            prefix = unicodedata.normalize("NFC", text[start:k])
            counts = self._text("".join(c.lower() for c in prefix))
            out.append(base + (counts[-1] if counts else 0))
            if regex.fullmatch(r"[A-Za-z]", text[k - 1]) is None and text[k : k + 1].isascii() and text[k : k + 1].isalpha():
                if text[k - 1] != "'" and not text[k - 1].isalpha() and not unicodedata.combining(text[k - 1]):
                    base, start = out[-1], k
        return out

    def __call__(self, piece: str) -> bytes:
        """The steps of a piece's prefixes, as signed bytes."""
        if not piece:
            return b""
        if piece.isascii():
            if piece.isalpha():
                return _steps(self._word(piece.lower()))
            if piece[:-1].isalpha() and not piece[-1].isalnum() and piece[-1].isprintable():  # a word and one mark
                word, mark = self._word(piece[:-1].lower()), self._word(piece[-1])
                return _steps(word) + bytes(mark)
        counts, at, done = [], 0, 0
        for found in self.special.finditer(piece) if self.special else ():
            # Until a special string is whole it is text like any other.
            before = self._plain(piece[at : found.end() - 1])
            counts += [done + c for c in before]
            plain = found.start() - at
            done += (before[plain - 1] if plain else 0) + 1
            counts.append(done)
            at = found.end()
        if at < len(piece):
            counts += [done + c for c in self._plain(piece[at:])]
        return _steps(counts)


def _steps(counts: list[int]) -> bytes:
    """The step from each count to the next, from 0 on, as signed bytes."""
    steps = list(map(sub, counts, [0, *counts]))
    if max(steps) > 127 or min(steps) < -128:
        raise ValueError("a step of a prefix count beyond a signed byte")
    return bytes([x & 255 for x in steps])


class PieceMemo:
    """piece -> its prefixes' steps, emptied when it holds ``limit`` pieces."""

    def __init__(self, path: str, limit: int = MEMO_PIECES):
        self.prefixes, self.limit = Prefixes(path), limit
        self.known: dict[str, bytes] = {}

    def steps(self, pieces: list[str]) -> bytes:
        """Of a text, from its pieces: blanks between them step by 0."""
        known = self.known
        fresh = [p for p in set(pieces) if p not in known]
        if len(known) + len(fresh) > self.limit:
            known.clear()
            fresh = set(pieces)
        for piece in fresh:
            known[piece] = self.prefixes(piece)
        return b"\0".join(map(known.__getitem__, pieces))


def _memo(path: str) -> PieceMemo:
    return tokens.per_worker(("prefixes", path), lambda: PieceMemo(path))


class PrefixTable:
    """Answers questions about one text from its stored prefix counts."""

    def __init__(self, text: str | None, steps: bytes):
        self.text = text or ""
        self.counts = np.concatenate([[0], np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)])

    @property
    def n_tokens(self) -> int:
        return int(self.counts[-1])

    def tokens_at(self, chars: int) -> int:
        """Tokens of the first ``chars`` characters."""
        return int(self.counts[min(chars, len(self.text))])

    def truncate(self, budget: int) -> str:
        """The longest prefix of at most ``budget`` tokens."""
        return self.text[: int(np.flatnonzero(self.counts <= budget)[-1])] if budget >= 0 else ""

    def fits(self, budget: int) -> bool:
        return self.n_tokens <= budget


def count_tokens(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the table prefix_steps and its last count, n_tokens.

    Row-wise: no shuffle, so no key can be hot; a very long text costs time in
    proportion to its length.
    """

    def factory():
        memo = _memo(path)

        def make(texts: pa.Array) -> list:
            steps = [memo.steps(tokens.blank_free_pieces(t or "")) for t in texts.to_pylist()]
            return [[int(np.frombuffer(s, np.int8).sum(dtype=np.int64)) for s in steps], steps]

        return make

    return with_columns(docs, [text_col], FIELDS, factory)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = count_tokens(docs, tokens.public_path(VOCABULARY))
    return found.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > LIMIT).alias("over_limit"),
    )

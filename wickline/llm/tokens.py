"""Memoised encoding with the ``tokenizers`` library.

A text is cut where its tokenizer's own pre-tokenizer always cuts, and the
library encodes every distinct piece once per worker.  The joined results
equal the library's for the whole text (tested against it).  A memo that holds
``MEMO_PIECES`` pieces is emptied (``IdMemo``: but for those that came again),
so memory stays bounded.
"""

from __future__ import annotations

import json
import os
import re
from codecs import charmap_decode
from collections.abc import Iterable, Iterator

import numpy as np

MEMO_PIECES = 1_000_000
#: Characters of text handled at once, so that the pieces fit in memory.
CHUNK_CHARS = 2 << 20

#: GPT-2 style pre-tokenizers: a space before a non-space starts a new piece.
_BEFORE_SPACE = re.compile(r" (?=\S)")
#: White space to ``re`` but spaces and line feeds.
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
#: Marks that such pre-tokenizers cut off the letter or digit before them.
_MARKS = ".,;:!?*%$&#"
#: Letters and digits below it are those of every version of Unicode in use.
_SETTLED = "\u0530"
#: The characters that stand for bytes in byte-level vocabularies: those of space and of letters; others as they are.
_BYTE_CHARS = "".join(chr(288) if b == 32 else chr(323) if b == 173 else chr(b + 162) if 128 <= b <= 160 else chr(b) for b in range(256))


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def chunks(texts: Iterable[str | None], size: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Consecutive texts, null as empty, in lists of about ``size`` characters."""
    held: list[str] = []
    chars = 0
    for text in texts:
        held.append(text or "")
        chars += len(held[-1])
        if chars >= size:
            yield held
            held, chars = [], 0
    if held:
        yield held


def space_led_pieces(text: str, lines: bool = False) -> list[str]:
    """Pieces of ``text``; those without a mark stand for a space and the piece.

    Marked are the first, as it has no space before it, and, if the tokenizer
    cuts at both sides of a lone line feed (``lines``) and no white space of
    the text touches other white space, line feeds and what follows them.
    """
    if not lines or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[-1:] == " " or any(c in text for c in _OTHER_SPACE):
        pieces = _BEFORE_SPACE.split(text)
    else:
        pieces = text.replace("\n", " \0\n \0").split(" ")
    pieces[0] = "\0" + pieces[0]
    return pieces


def blank_free_pieces(text: str) -> list[str]:
    """Pieces between spaces and line feeds, for tokenizers that drop white space."""
    return text.replace("\n", " ").split(" ")


class Memo:
    """piece -> value, for values made by the library in batches."""

    def __init__(self, tokenizer, value, limit: int = MEMO_PIECES):
        self.tokenizer, self.value, self.limit = tokenizer, value, limit
        self.known: dict[str, object] = {}

    def learn(self, piece_lists: list[list[str]]) -> None:
        """After this, ``known`` has every piece of the lists."""
        fresh = set().union(*piece_lists).difference(self.known)
        if len(self.known) + len(fresh) > self.limit:
            self.known.clear()
            fresh = set().union(*piece_lists)
        self._encode(list(fresh))

    def _encode(self, todo: list[str]) -> None:
        known, value = self.known, self.value
        for k in range(0, len(todo), 20_000):
            part = todo[k : k + 20_000]
            for piece, found in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False)):
                known[piece] = value(found)


def _cuts_at_words(tokenizer) -> bool:
    """Whether ``tokenizer`` hands a space and the letters after it to its model as one piece, byte by byte, and as they are."""
    found = json.loads(tokenizer.to_str())
    before = found["pre_tokenizer"] or {}
    known = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    plain = {k: before.get(k) for k in known} == known and found["normalizer"] is None and found["model"].get("dropout") is None
    return plain and not any(t["content"].strip().isalpha() or set(t["content"]) & set(_MARKS) for t in found["added_tokens"])


class IdMemo(Memo):
    """piece -> ids as little-endian bytes, for pieces of ``space_led_pieces`` and byte-level tokenizers.

    Pieces led by a space are encoded many in one text, where the library cuts
    between them as in any text, and told apart by the bytes of their tokens.
    Marks at a piece's end are encoded apart, once, so that a word is encoded
    once whatever follows it; letters alone are one piece to the library, and
    go to its model at once, as do those after a line feed.  A full memo keeps the pieces that came again
    since it was last full, if they are less than half of it.
    """

    JOINED = 50

    def __init__(self, tokenizer, kind: np.dtype, limit: int = MEMO_PIECES):
        super().__init__(tokenizer, None, limit)
        self.kind = kind
        self.again: set[str] = set()
        self.marks: dict[str, bytes] = {}
        self.model, self.whole_words = tokenizer.model, _cuts_at_words(tokenizer)
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.cells = [self._bytes([n]) for n in range(max(vocabulary.values()) + 1)]
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        for token, number in vocabulary.items():
            self.width[number] = len(token.encode()) if token in added else len(token)

    def learn(self, piece_lists: list[list[str]]) -> None:
        pieces = set().union(*piece_lists)
        fresh = pieces.difference(self.known)
        pieces -= fresh
        if len(self.known) + len(fresh) > self.limit:
            kept = self.again | pieces
            if 2 * (len(kept) + len(fresh)) > self.limit:
                kept = pieces if len(pieces) + len(fresh) <= self.limit else set()
                fresh = set().union(*piece_lists) - kept
            self.known = {p: self.known[p] for p in kept}
            self.again = set()
        self.again |= pieces
        self._encode(fresh)

    def _bytes(self, ids) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _alone(self, pieces: list[str], into: dict[str, bytes]) -> None:
        for k in range(0, len(pieces), 20_000):
            part = pieces[k : k + 20_000]
            texts = [p[1:] if p[:1] == "\0" else " " + p for p in part]
            for piece, found in zip(part, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                into[piece] = self._bytes(found.ids)

    def _encode(self, todo: set[str]) -> None:
        known, ended, stems = self.known, [], set()
        if not self.whole_words:
            self._learn(todo, known)
            return
        words, plain = [], []
        for piece in todo:
            if piece.isalpha():
                (words if piece.isascii() or max(piece) < _SETTLED else plain).append(piece)
                continue
            stem = piece.rstrip(_MARKS)
            if stem is piece or not stem or not stem[-1].isalnum() or stem[-1] >= _SETTLED or piece[0] == "\0":
                plain.append(piece)
            else:
                ended.append((piece, stem))
                stems.add(stem)
        self._words(words, known)
        self._learn(plain, known)
        apart: dict[str, bytes] = {}
        self._learn(stems.difference(known), apart)
        if len(self.marks) > 10_000:
            self.marks = {}
        marks = self.marks
        for piece, stem in ended:
            end = piece[len(stem) :]
            if end not in marks:
                marks[end] = self._bytes(self.tokenizer.encode(end, add_special_tokens=False).ids)
            known[piece] = (known.get(stem) or apart[stem]) + marks[end]

    def _learn(self, pieces: Iterable[str], into: dict[str, bytes]) -> None:
        words, rest, first = [], [], []
        for piece in pieces:
            letters = piece if piece[:1] != "\0" else piece[1:]
            word = self.whole_words and letters.isalpha() and (letters.isascii() or max(letters) < _SETTLED)
            (words if word else first if piece[:1] == "\0" else rest).append(piece)
        self._words(words, into)
        self._led(rest, into)
        self._alone(first, into)

    def _words(self, words: list[str], into: dict[str, bytes]) -> None:
        """Learn pieces of letters, marked or led by a space."""
        cells, tokenize = self.cells, self.model.tokenize
        joined = charmap_decode((" " + "\n ".join(words)).encode(), "strict", _BYTE_CHARS)[0]
        for word, chars in zip(words, joined.replace("\u0120\0", "").split("\n")):
            into[word] = b"".join([cells[t.id] for t in tokenize(chars)])

    def _led(self, led: list[str], into: dict[str, bytes]) -> None:
        """Learn pieces that a space leads."""
        for k in range(0, len(led), 200 * self.JOINED):
            groups = [led[i : i + self.JOINED] for i in range(k, min(k + 200 * self.JOINED, len(led)), self.JOINED)]
            texts = [" " + " ".join(g) for g in groups]
            for group, text, found in zip(groups, texts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(found.ids, self.kind)
                reached = np.cumsum(self.width[ids])
                ends = np.cumsum([len(p.encode()) + 1 for p in group])
                cuts = np.searchsorted(reached, ends)
                if cuts[-1] >= len(ids) or (reached[cuts] != ends).any():
                    self._alone(group, into)  # a token that isn't its bytes
                    continue
                data, size, at = ids.tobytes(), self.kind.itemsize, 0
                for piece, cut in zip(group, ((cuts + 1) * size).tolist()):
                    into[piece] = data[at:cut]
                    at = cut


_WORKER: dict = {}


def per_worker(key: tuple, make):
    """``make()``'s result, kept for as long as this Python worker lives."""
    if key not in _WORKER:
        _WORKER[key] = make()
    return _WORKER[key]

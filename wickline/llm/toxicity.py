"""Toxicity by a weighted finite-state pattern grammar over clauses.

A clause is read as a string of symbols: I an insult, T a target, H a threat,
N a negation, R reported speech, x any other word.  Small transducers know one
thing each: reported speech and negation make the insults and threats in their
scope harmless; a target before or after an insult or a threat makes it a
directed one; insults that share a clause pile up; the last one weighs each
kind.  They are composed into one transducer, whose states are tuples of
theirs and whose arcs add their weights.  Looking ahead is nondeterminism: an
insult may guess that a target or another insult follows, and a path whose
guess fails does not end in a final state.  A clause's reading is its best
path, found by dynamic programming over the active states.

A document's score is a logistic function of what its matched clauses weigh,
by kind.  A word alone is no match: a clause that holds nothing but one insult
counts only from the document's second such clause on, so a single isolated
insult, whatever its weight, scores like a text without one.

The insult lexicon (whole words, and stems that begin a longer word) and its
weights, and the logistic weights of the kinds, are learned from a sample of
labelled rows, bounded in rows and bytes; languages need no list of their own.
The function words below are fixed.

Defined cases: null or empty texts match nothing and score what a text
without a match scores; without labelled rows of both kinds every score is 0;
rows that share a doc_id are scored each and learned from once; very long
texts are scored whole, and learned from as long as the sample has room for
them; the stage leaves a column named score as it is.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, hidden, lighten, table, with_columns
from .labels import sample

#: Labelled rows that the lexicon and the weights are learned from, at most.
SAMPLE = 6000
#: Bytes of their texts, at most: all that reaches the driver.
SAMPLE_BYTES = 48 << 20
THRESHOLD = 0.7
MAX_LEXICON = 400
STEM_MIN, STEM_MAX = 3, 10
#: Least toxic documents of the sample with an entry, as a number and a share, and least ratio of its rates.
SUPPORT, SUPPORT_SHARE, RATIO = 4, 0.005, 8.0

# Function words of the four languages.
TARGETS = "you your yours yourself they them he she du dich dir dein deine ihr euch sie tu te toi ton ta vous votre ils tú te ti tu usted ustedes vosotros"
THREATS = "kill hurt destroy beat burn shoot töte töten schlage vernichte tuer tue frapper détruire matar mato golpear destruir"
NEGATIONS = "not no never nor isn aren don doesn nicht kein keine nie niemals ne pas jamais nunca jamás"
REPORTED = "said says say told called calls quoted wrote claimed sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió"

_ENDS = ".!?;\n"
_CLEAN = bytes(
    10 if chr(c) in _ENDS else c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


SYMBOLS = "ITHNRxiropd"

#: (state, symbol) -> [(next state, symbol, weight)]
Arcs = dict


class Transducer:
    """A weighted finite-state transducer that starts in ``start``, may end in ``finals`` and adds weights along a path."""

    def __init__(self, start, finals: set, arcs: Arcs):
        self.start, self.finals, self.arcs = start, finals, arcs

    def then(self, other: Transducer) -> Transducer:
        """The composition: ``other`` reads what this one writes.  States are pairs, weights add."""
        start, arcs, todo = (self.start, other.start), {}, [(self.start, other.start)]
        seen = {start}
        while todo:
            here = todo.pop()
            for symbol in SYMBOLS:
                out = []
                for mine, middle, weight in self.arcs.get((here[0], symbol), ()):
                    for theirs, made, more in other.arcs.get((here[1], middle), ()):
                        out.append(((mine, theirs), made, weight + more))
                        if (mine, theirs) not in seen:
                            seen.add((mine, theirs))
                            todo.append((mine, theirs))
                if out:
                    arcs[here, symbol] = out
        return Transducer(start, {s for s in seen if s[0] in self.finals and s[1] in other.finals}, arcs)

    def numbered(self) -> Transducer:
        """With numbers for states, and without those from which no final state is reached."""
        before: dict = {}
        for (state, _), arcs in self.arcs.items():
            for after, _, _ in arcs:
                before.setdefault(after, set()).add(state)
        alive, todo = set(self.finals), list(self.finals)
        while todo:
            for state in before.get(todo.pop(), ()):
                if state not in alive:
                    alive.add(state)
                    todo.append(state)
        number = {s: k for k, s in enumerate(sorted(alive, key=str))}
        arcs = {
            (number[s], x): [(number[a], y, w) for a, y, w in out if a in alive] for (s, x), out in self.arcs.items() if s in alive
        }
        return Transducer(number[self.start], {number[s] for s in self.finals}, arcs)

    def best(self, symbols: str, factors: list[float]) -> str:
        """What the path of greatest weight writes; a symbol's arc weights are times its factor."""
        # state -> (weight, path as nested pairs)
        active: dict = {self.start: (0.0, None)}
        for symbol, factor in zip(symbols, factors):
            reached: dict = {}
            for state, (total, path) in active.items():
                for after, made, weight in self.arcs.get((state, symbol), ()):
                    worth = total + weight * factor
                    if after not in reached or worth > reached[after][0]:
                        reached[after] = (worth, (path, made))
            active = reached
        path = max((active[s] for s in active if s in self.finals), key=lambda x: x[0])[1]
        out = []
        while path:
            path, made = path
            out.append(made)
        return "".join(reversed(out))


def scope(trigger: str, rewrites: dict[str, str], reach: int | None) -> Transducer:
    """Rewrites symbols among the ``reach`` after a trigger (None: all to the clause's end)."""
    depth, arcs = reach or 1, {}
    for state in range(depth + 1):
        for s in SYMBOLS:
            after = depth if s == trigger else state if reach is None else max(0, state - 1)
            arcs[state, s] = [(after, rewrites.get(s, s) if state else s, 0.0)]
    return Transducer(0, set(range(depth + 1)), arcs)


def ahead(trigger: str, rewrites: dict[str, str], reach: int) -> Transducer:
    """Rewrites symbols that a trigger follows within ``reach``: a state counts what is left to a guess."""
    arcs: dict = {}
    for state in range(reach + 1):
        for s in SYMBOLS:
            if s == trigger:
                arcs[state, s] = [(0, s, 0.0)]
                continue
            left = state - 1
            arcs[state, s] = [] if state == 1 else [(max(0, left), s, 0.0)]
            if s in rewrites and state != 1:
                arcs[state, s].append((left if state else reach, rewrites[s], 0.0))
    return Transducer(0, {0}, arcs)


def piles(one: str, many: str, also: str) -> Transducer:
    """Rewrites ``one`` to ``many`` where the clause holds another of ``one`` or ``also``."""
    arcs: dict = {}
    for state in ("none", "lone", "waits", "piled"):
        for s in SYMBOLS:
            arcs[state, s] = [(state, s, 0.0)]
        if state == "none":
            arcs[state, one] = [("lone", one, 0.0), ("waits", many, 0.0)]
            arcs[state, also] = [("piled", also, 0.0)]
        elif state == "lone":
            arcs[state, one], arcs[state, also] = [], []
        else:
            arcs[state, one] = [("piled", many, 0.0)]
            arcs[state, also] = [("piled", also, 0.0)]
    return Transducer("none", {"none", "lone", "piled"}, arcs)


def weighs(weights: dict[str, float]) -> Transducer:
    return Transducer(0, {0}, {(0, s): [(0, s, weights.get(s, 0.0))] for s in SYMBOLS})


#: i a negated insult, r a reported one, o a directed one, p one of a pile, d a directed threat.
REPORT = scope("R", {"I": "r", "H": "x"}, None)
NEGATION = scope("N", {"I": "i", "H": "x"}, 3)
TARGET_BEFORE = scope("T", {"I": "o", "H": "d"}, 4)
TARGET_AFTER = ahead("T", {"I": "o", "H": "d"}, 4)
PILE = piles("I", "p", "o")
WEIGHTS = weighs({"I": 1.0, "p": 2.0, "o": 3.0, "d": 3.0})


def composed(*parts: Transducer) -> Transducer:
    """One transducer of all ``parts``, each reading what the one before writes."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.then(part)
    return whole.numbered()


GRAMMAR = composed(REPORT, NEGATION, TARGET_BEFORE, TARGET_AFTER, PILE, WEIGHTS)
#: Sums by kind: directed insults, piled ones, lone ones beyond the heaviest, directed threats; and matched clauses and all clauses.
KINDS = 6


def rewrite(symbols: str) -> str:
    return GRAMMAR.best(symbols, [1.0] * len(symbols))


def normal(text: str | None) -> str:
    """Lower case, clause ends as line feeds, other marks as spaces; bytes as characters."""
    return " " + (text or "").lower().encode().translate(_CLEAN).decode("latin-1") + " "


def _latin(word: str) -> str:
    return word.encode().decode("latin-1")


_CLASS = {_latin(w): s for s, ws in (("H", THREATS), ("N", NEGATIONS), ("R", REPORTED), ("T", TARGETS)) for w in ws.split()}


class Grammar:
    """A lexicon compiled to an automaton, with the function-word classes and the transducer that reads clauses."""

    def __init__(self, lexicon: dict[str, float], reader: Transducer = GRAMMAR):
        """``lexicon``: "=word" is a whole word, "stem+" begins a longer one; with weights."""
        self.lexicon, self.reader = lexicon, reader
        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.items():
            key = "[" + entry[1:] if entry[0] == "=" else "[" + entry[:-1]
            had = self.automaton.get(key, (0.0, 0.0, ""))
            self.automaton.add_word(key, (weight, had[1], entry) if entry[0] == "=" else (had[0], weight, entry))
        for word, symbol in _CLASS.items():
            if symbol == "H":
                self.automaton.add_word("[" + word, self.automaton.get("[" + word, (0.0, 0.0, "")))
        self.automaton.make_automaton()

    def features(self, text: str | None) -> list[float]:
        """The sums by kind of the clauses' best readings, and the numbers of matched and of all clauses."""
        clean = normal(text)
        directed = piled = threats = matched = 0.0
        alone: list[float] = []
        clauses: dict[int, dict[int, float]] = {}
        marked = clean.replace("\n", " \n ").replace(" ", " [") if len(self.automaton) else ""
        for last, (whole, stem, entry) in self.automaton.iter(marked) if marked else ():
            after = marked[last + 1]
            weight = whole if after == " " else stem
            threat = not weight and not entry
            if weight or threat and after == " ":
                start = marked.rfind("\n", 0, last) + 1
                at = marked.rfind("[", 0, last + 1)
                words = clauses.setdefault(start, {})
                words[at] = max(weight, words.get(at, 0.0))
        for start, found in clauses.items():
            end = marked.find("\n", start)
            end = len(marked) if end < 0 else end
            symbols, weights = [], []
            for token in re.finditer(r"\[([^ \n]+)", marked[start:end]):
                weight = found.get(start + token.start(), 0.0)
                symbols.append("I" if weight else _CLASS.get(token[1], "x"))
                weights.append(weight or 1.0)
            match = False
            for symbol, weight in zip(self.reader.best("".join(symbols), weights), weights):
                if symbol == "o":
                    directed += weight
                elif symbol == "p":
                    piled += weight
                elif symbol == "d":
                    threats += 1.0
                elif symbol == "I":
                    alone.append(weight)
                match |= symbol in "opd"
            matched += match
        matched += max(0, len(alone) - 1)
        beyond = sum(alone) - max(alone, default=0.0)
        return [directed, piled, beyond, threats, matched, float(clean.count("\n") + 1)]


def design(rows: Iterable[list[float]]) -> np.ndarray:
    """What the logistic function sees: logarithms of the sums and of the share of clauses that match."""
    x = np.array(list(rows), float).reshape(-1, KINDS)
    share = np.minimum(100.0 * x[:, 4:5] / np.maximum(x[:, 5:6], 1.0), 50.0)
    return np.hstack([np.ones((len(x), 1)), np.log1p(x[:, :5]), np.log1p(share)])


def logistic(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = logistic(x, beta)
        step = np.linalg.solve(x.T * (p * (1 - p) + 1e-9) @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _entries(word: str) -> list[str]:
    return ["=" + word, *[word[:k] + "+" for k in range(STEM_MIN, min(STEM_MAX, len(word) - 1) + 1)]]


def learn_lexicon(texts: list[str | None], toxic: np.ndarray) -> dict[str, float]:
    """Entries far more frequent in toxic texts, with the logarithm of their rates' ratio.

    A text's count of an entry stops at 3, so that one long text can't make an
    entry.  An entry that only extends or only widens a better one is left out.
    """
    words = [Counter(w for w in normal(t).split() if len(w) >= STEM_MIN) for t in texts]
    support: Counter = Counter()
    for k in np.flatnonzero(toxic):
        support.update({e for w in words[k] for e in _entries(w)})
    least = max(SUPPORT, SUPPORT_SHARE * toxic.sum())
    rates = {e: [0.0, 0.0] for e, n in support.items() if n >= least}
    del support
    tokens = [0.0, 0.0]
    for counted, label in zip(words, toxic.astype(int).tolist()):
        here: Counter = Counter()
        for w, n in counted.items():
            for e in _entries(w):
                if e in rates:
                    here[e] += n
        for e, n in here.items():
            rates[e][label] += min(n, 3)
        tokens[label] += sum(counted.values())
    scored = []
    for e, (clean, bad) in rates.items():
        ratio = ((bad + 0.5) / (tokens[1] + 1)) / ((clean + 0.5) / (tokens[0] + 1))
        if ratio >= RATIO:
            scored.append((bad * math.log(ratio), len(e), e, math.log(ratio)))
    chosen: dict[str, float] = {}
    for _, _, e, weight in sorted(scored, key=lambda s: (-s[0], -s[1], s[2])):
        core = e.strip("=+")
        if len(chosen) == MAX_LEXICON:
            break
        if not any(core.startswith(o.strip("=+")) or o.strip("=+").startswith(core) for o in chosen):
            chosen[e] = weight
    return chosen


class Model:
    """A grammar with its logistic weights; small, and sent with the tasks."""

    def __init__(self, lexicon: dict[str, float], beta: list[float] | None, reader: Transducer = GRAMMAR):
        self.lexicon, self.beta, self.reader, self._grammar = lexicon, beta, reader, None

    def __getstate__(self):
        return self.lexicon, self.beta, self.reader

    def __setstate__(self, state):
        (self.lexicon, self.beta, self.reader), self._grammar = state, None

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.beta is None or not texts:
            return np.zeros(len(texts))
        self._grammar = self._grammar or Grammar(self.lexicon, self.reader)
        return logistic(design([self._grammar.features(t) for t in texts]), np.array(self.beta))


def fit(texts: list[str | None], labels: list[int], reader: Transducer = GRAMMAR) -> Model:
    toxic = np.array(labels, int) == 1
    if not toxic.any() or toxic.all():
        return Model({}, None)
    lexicon = learn_lexicon(texts, toxic)
    grammar = Grammar(lexicon, reader)
    beta = fit_logistic(design([grammar.features(t) for t in texts]), toxic.astype(float))
    return Model(lexicon, beta.tolist(), reader)


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1


def train(docs: DataFrame, labels: DataFrame, n: int = SAMPLE) -> Model:
    """A model from at most ``n`` labelled rows that are not held out, of ``SAMPLE_BYTES`` of text."""
    found = sample(docs.select("doc_id", "text"), labels, "toxic", n, ~held_out(), "text", SAMPLE_BYTES)
    rows = found.orderBy("doc_id").select("text", "label").collect()
    lighten(docs.sparkSession)
    model = fit([r.text for r in rows], [r.label for r in rows])
    del rows
    give_back()
    return model


def with_score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``docs`` with the score as column ``name``, row by row and without a shuffle."""

    def factory():
        return lambda texts: [model.scores(texts.to_pylist())]

    return with_columns(docs, [text_col], [T.StructField(name, T.DoubleType())], factory, keep)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_score(docs, train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    held = F.coalesce(held_out(), F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that are not predicted toxic; the model is learned from ``docs`` and its labels."""
    score = hidden(docs, "_score")
    scored = with_score(docs, train(docs, table(spark, sf_dir, "labels")), name=score)
    return scored.where(F.col(score) < THRESHOLD).select(*[f"`{c}`" for c in docs.columns])

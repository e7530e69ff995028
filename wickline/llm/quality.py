"""Quality rules: an ordered decision list learned by sequential covering.

Statistics of every whole text are computed once.  From a bounded labelled
sample, rules for low quality are grown one after another: conjunctions of
thresholds, each condition the one with the largest information gain, until
no good row is covered; each is pruned on rows held back, and kept if it is
precise there.  The rows a rule covers leave before the next one is grown.
The list becomes an ordered Spark conditional expression.

Defined cases: null or wordless texts have zero counts and fail the base
rule; ratios with a zero denominator are 0; without labelled rows of both
kinds no rule is learned and the base rule alone decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, table, with_columns
from .labels import sample

#: Labelled rows that the rules are learned from, at most.
SAMPLE = 20_000
MAX_RULES, MAX_CONDITIONS, CUTS = 12, 4, 40
#: A rule's least precision on the rows held back, and the least bad rows it must cover.
PRECISION, SUPPORT = 0.9, 5

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\r\x0b\x0c"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
MARKS = b".,;:!?"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATISTICS = ["n_distinct", "n_lines", "n_upper", "n_lower", "n_digits", "n_marks", "n_shouts"]
FEATURES = {
    "mean_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "upper_share": ("n_upper", "n_lower"),
    "digits_per_word": ("n_digits", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "shouts_per_word": ("n_shouts", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}
FIELDS = [T.StructField(c, T.LongType()) for c in COUNTS + STATISTICS]


def repeat_words(words: list[bytes], hashes: np.ndarray, width: int = 5) -> int:
    """Words in windows of ``width`` words that the text has twice or more, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    mixed = np.zeros(n, np.uint64)
    for k in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    seen: dict[tuple, int] = {}
    suspects = np.sort(order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]).tolist()
    windows = [tuple(words[i : i + width]) for i in suspects]
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = np.zeros(len(words) + 1, np.int64)
    for i, w in zip(suspects, windows):
        if seen[w] > 1:
            covered[i] += 1
            covered[i + width] -= 1
    return int((np.cumsum(covered) > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """COUNTS and STATISTICS of one text."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    seen: set[bytes] = set()
    duplicates = lines = 0
    for line in raw.split(b"\n"):
        if line.translate(None, BLANKS):
            lines += 1
            duplicates += line in seen
            seen.add(line)

    def count(chars: bytes) -> int:
        return len(raw) - len(raw.translate(None, chars))

    return (
        n,
        len(text or "") - count(BLANKS),
        count(SYMBOLS),
        duplicates,
        repeat_words(words, hashes),
        len(np.unique(hashes)),
        lines,
        count(UPPER),
        count(LOWER),
        count(DIGITS),
        count(MARKS),
        count(b"!"),
    )


def with_statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with COUNTS and STATISTICS, row by row and without a shuffle."""

    def factory():
        return lambda texts: list(map(list, zip(*[statistics(t) for t in texts.to_pylist()]))) or [[] for _ in FIELDS]

    return with_columns(docs, [text_col], FIELDS, factory, keep)


def feature(name: str) -> Column:
    above, below = FEATURES[name]
    return F.when(F.col(below) == 0, F.lit(0.0)).otherwise(F.col(above).cast("double") / F.col(below))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.cut if self.above else x[self.feature] <= self.cut

    def column(self) -> Column:
        return feature(self.feature) > self.cut if self.above else feature(self.feature) <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        out &= c.covers(x)
    return out


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray, alive: np.ndarray) -> Condition | None:
    """The condition with the largest gain of information about the bad rows still covered."""
    p0, n0 = (bad & alive).sum(), (~bad & alive).sum()
    before = np.log2(p0 / (p0 + n0))
    best, best_gain = None, 1e-9
    for name, values in x.items():
        v, b = values[alive], bad[alive]
        order = np.argsort(v, kind="stable")
        v, b = v[order], b[order].astype(np.int64)
        ends = np.flatnonzero(np.diff(v))  # a cut lies after each of these
        if len(ends) > CUTS:
            # Cuts next to changes of the label matter; the rest are spread evenly.
            ends = np.unique(np.concatenate([ends[np.linspace(0, len(ends) - 1, CUTS).astype(int)], ends[b[ends] != b[ends + 1]]]))
        if not len(ends):
            continue
        below_p = np.cumsum(b)[ends]
        below_n = ends + 1 - below_p
        for above, p, n in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - before), 0)
            k = int(np.argmax(gain))
            if gain[k] > best_gain:
                cut = float((v[ends[k]] + v[ends[k] + 1]) / 2)
                best, best_gain = Condition(name, above, cut), gain[k]
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, held: np.ndarray) -> list[Rule]:
    """Rules for bad rows, grown on the rows not ``held`` and pruned on the others."""
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < MAX_RULES:
        alive = left & ~held
        if (bad & alive).sum() < SUPPORT or not (~bad & alive).any():
            break
        conditions: list[Condition] = []
        while len(conditions) < MAX_CONDITIONS and (~bad & alive).any():
            found = _best_condition(x, bad, alive)
            if found is None:
                break
            conditions.append(found)
            alive &= found.covers(x)
        options = [tuple(conditions[:k]) for k in range(1, len(conditions) + 1)]

        def worth(rule: Rule) -> float:
            hit = covers(rule, x) & left & held
            p, n = (hit & bad).sum(), (hit & ~bad).sum()
            return (p - 3 * n) / (p + n) * np.log1p(p) if p + n else -1.0

        best = max(options, key=lambda r: (worth(r), -len(r)), default=None)
        if best is None:
            break
        hit = covers(best, x) & left
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        ph, nh = (hit & bad & held).sum(), (hit & ~bad & held).sum()
        if p < SUPPORT or p < PRECISION * (p + n) or ph < PRECISION * (ph + nh):
            break
        rules.append(best)
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional expression: false at the first rule that covers, else true."""
    out: Column | None = None
    for rule in rules:
        test = F.lit(True)
        for c in rule:
            test = test & c.column()
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def learn_rules(stats: DataFrame, labels: DataFrame, n: int = SAMPLE) -> list[Rule]:
    """Rules from at most ``n`` labelled rows of ``stats`` that pass the base rule."""
    columns = [feature(c).alias(c) for c in FEATURES]
    held = (F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(3)) == 0).alias("held")
    rows = sample(stats, labels, "quality", n).where(~base_failed()).select("label", held, *columns).collect()
    if not rows:
        return []
    x = {c: np.array([r[c] for r in rows]) for c in FEATURES}
    return learn(x, np.array([r.label == 0 for r in rows]), np.array([r.held for r in rows]))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = materialize(with_statistics(docs, keep=["doc_id"]), "statistics")
    rules = learn_rules(stats, table(spark, sf_dir, "labels"))
    failed = base_failed()
    return stats.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))

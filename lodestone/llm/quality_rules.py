"""Learned decision lists over text statistics, run as Spark conditional expressions."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents_of, slices
from .sampling import labelled_sample

WINDOW = 8
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 20, 30

#: Labelled rows of either label whose statistics are learned from.
PER_CLASS = 10_000
#: A rule must be right for this share of the labelled rows it meets, on the rows it grew on and on those kept back.
PRECISION = 0.99
MOST_RULES, MOST_TERMS, CUTS = 12, 4, 40
LEAST_COVER = 5

#: What rules may test, from the counted columns.
RATIOS = {
    "n_words": "n_words",
    "word_length": "word_chars / n_words",
    "symbol_rate": "n_symbols / n_words",
    "duplicate_lines": "n_dup_lines / n_lines",
    "repeated_words": "n_repeat_words / n_words",
    "commonest_word": "n_commonest / n_words",
    "short_words": "n_short / n_words",
    "capitals": "n_upper / word_chars",
    "exclamations": "n_exclaim / n_words",
}
_COUNTS = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_commonest n_short n_upper n_exclaim".split()
)
_SPACES = " \t\n\x0b\f\r"


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words covered by windows of a power of two of words that occur twice or more; windows are compared exactly:
    pairs of ranks are ranked again until a rank stands for a whole window."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    ranks, width = ids, 1
    while width < window:
        pairs = ranks[:-width] * (int(ranks.max()) + 1) + ranks[width:]
        ranks = np.unique(pairs, return_inverse=True)[1]
        width *= 2
    twice = np.bincount(ranks)[ranks] > 1
    cover = np.zeros(len(ids) + 1, dtype=np.int64)
    cover[:n] += twice
    cover[window:] -= twice
    return int((np.cumsum(cover[:-1]) > 0).sum())


def counts(text: str) -> tuple[int, ...]:
    """The columns of _COUNTS. Words end at the six white-space characters of ASCII only."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return (0, 0, sum(map(text.count, SYMBOLS)), *(0 for _ in _COUNTS[3:]))
    rank: dict[bytes, int] = {}
    ids = np.fromiter((rank.setdefault(w, len(rank)) for w in words), dtype=np.int64, count=len(words))
    tally = np.bincount(ids)
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    data = np.frombuffer(raw, dtype=np.uint8)
    return (
        len(words), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(ids), len(lines), int(tally.max()), int(tally[[len(w) < 4 for w in rank]].sum()),
        int(np.count_nonzero((data >= 65) & (data <= 90))), text.count("!"),
    )


def _count(batches):
    for batch in slices(batches):
        rows = np.array([counts(text) for text in batch.column("text").to_pylist()], dtype=np.int64).reshape(-1, len(_COUNTS))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in rows.T)], ["doc_id", *_COUNTS])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every whole text, with the ratios that rules test (null where they divide by zero)."""
    counted = documents_of(docs).mapInArrow(_count, "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS))
    return counted.select("*", *[F.expr(f"try_divide({e.replace(' / ', ', ')})" if "/" in e else f"cast({e} as double)").alias(f"r_{name}") for name, e in RATIOS.items()])


@dataclass(frozen=True)
class Term:
    ratio: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = F.col(f"r_{self.ratio}")
        return value > self.cut if self.above else value <= self.cut

    def meets(self, x: np.ndarray) -> np.ndarray:
        value = x[:, list(RATIOS).index(self.ratio)]
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.ratio} {'>' if self.above else '<='} {self.cut:g}"


Rule = tuple[Term, ...]


def _meets(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([t.meets(x) for t in rule]) if rule else np.ones(len(x), dtype=bool)


def _precision(bad: np.ndarray, w: np.ndarray, met: np.ndarray) -> float:
    return float(w[met & bad].sum() / max(w[met].sum(), 1e-9))


def grow(x: np.ndarray, bad: np.ndarray, w: np.ndarray) -> Rule:
    """Terms added one at a time, each the one of most information gain, until the rule meets bad rows alone."""
    rule: Rule = ()
    met = np.ones(len(x), dtype=bool)
    while len(rule) < MOST_TERMS and _precision(bad, w, met) < 1:
        before = np.log2(max(_precision(bad, w, met), 1e-9))
        best = (1e-9, None, None)
        for k, name in enumerate(RATIOS):
            values = np.unique(x[met, k])
            middles = (values[1:] + values[:-1]) / 2
            for cut in middles[np.unique(np.linspace(0, len(middles) - 1, CUTS).astype(int))] if len(middles) else ():
                for above in (True, False):
                    term = Term(name, above, float(cut))
                    now = met & term.meets(x)
                    hit = w[now & bad].sum()
                    if (now & bad).sum() < LEAST_COVER:
                        continue
                    gain = hit * (np.log2(_precision(bad, w, now)) - before)
                    if gain > best[0]:
                        best = (gain, term, now)
        if best[1] is None:
            break
        rule, met = (*rule, best[1]), best[2]
    return rule


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray, w: np.ndarray) -> Rule:
    """The shortest start of the rule that is worth most on rows it has not grown on."""

    def worth(n: int) -> float:
        met = _meets(rule[:n], x)
        hit, miss = w[met & bad].sum(), w[met & ~bad].sum()
        return -1.0 if not met.any() or hit < PRECISION * (hit + miss) else hit - miss

    return rule[: max(range(1, len(rule) + 1), key=worth)] if rule else rule


def learn(x: np.ndarray, bad: np.ndarray, w: np.ndarray) -> list[Rule]:
    """Sequential covering: grow a rule on two thirds of the rows, prune it on the rest, drop what it meets, go on.

    Stops at a rule under PRECISION on either part, so that good texts are kept when in doubt.
    """
    rules: list[Rule] = []
    back = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), dtype=bool)
    while len(rules) < MOST_RULES and (left & bad & ~back).sum() >= LEAST_COVER:
        on, off = left & ~back, left & back
        rule = prune(grow(x[on], bad[on], w[on]), x[off], bad[off], w[off])
        met = left & _meets(rule, x)
        if not rule or (met & bad).sum() < LEAST_COVER or min(_precision(bad, w, met & back), _precision(bad, w, met & ~back)) < PRECISION:
            break
        rules.append(rule)
        left &= ~met
    return rules


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> list[Rule]:
    """Rules for texts of label 0, from at most ``per_class`` labelled rows of either label; the driver sees their
    statistics alone."""
    sample = labelled_sample(labels, per_class)
    known = documents_of(docs).join(F.broadcast(sample), "doc_id", "left_semi")
    columns = [f"r_{name}" for name in RATIOS]
    # Ids may repeat in the documents: one text for each, so no more rows than sampled ids.
    one = statistics(known).join(sample, "doc_id").groupBy("doc_id").agg(F.min(F.struct(*columns, "label", "weight")).alias("row"))
    found = one.orderBy(F.xxhash64("doc_id"), "doc_id").select("row.*").toPandas()
    x = found[columns].to_numpy(np.float64)
    return learn(np.nan_to_num(x, nan=0.0), (found["label"] == 0).to_numpy(), found["weight"].to_numpy(np.float64))


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one conditional expression: the number of the first rule that a row meets, 0 for none."""
    out = F.lit(0)
    for number, rule in reversed(list(enumerate(rules, 1))):
        met = F.lit(True)
        for term in rule:
            met &= F.coalesce(term.column(), F.lit(False))
        out = F.when(met, number).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Counts of every row's whole text, base_failed, kept and rule, the first learned rule that it meets (0: none).

    base_failed: under LEAST_WORDS words, or over MOST_REPEATED percent of them in repeated windows. kept is false if
    base_failed or if a rule is met. Null and empty texts have zero counts and fail the base. Null ids stay null,
    repeated rows each give a row, further columns are ignored, an empty table gives no rows; without labels no rule
    is learned and the base decides.
    """
    rules = train(docs, labels) if rules is None else rules
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = statistics(docs).select("*", failed.alias("base_failed"), verdict(rules).cast("int").alias("rule"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule",
    )

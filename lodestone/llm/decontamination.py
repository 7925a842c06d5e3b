"""Benchmark decontamination by template windows: numbers, names and units are typed placeholders."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bitmap
from .common import documents_of, fresh, materialize, slices

#: Template tokens of a window, and how many of them are literals at least (in items of fewer tokens three quarters).
WINDOW, LITERALS = 8, 5
#: Where placeholders leave fewer, the window grows along these sizes until it has enough. Items that such windows do not
#: cover are looked up nearly whole, at the largest of the sizes that they hold, with WHOLE literals at least.
SIZES = (5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 28, 32, 40, 48, 56, 64)
WHOLE = 2
#: How a window is looked up: by its template, by its own words, or by its template as (nearly) a whole item.
TEMPLATE, OWN, ALL = range(3)
#: Share of an item's tokens that windows must cover, and of its slots that must be filled consistently.
COVERAGE, CONSISTENT = 0.6, 0.8

#: Item windows that are broadcast at most, of some 1 KB; more meet the documents' windows in a shuffle.
SMALL = 100_000

LITERAL, NUMBER, NAME, UNIT = range(4)
NUMERIC = re.compile(r"[+-]?[0-9][0-9.,:/]*%?(?:st|nd|rd|th)?|[+-]?[.,][0-9]+%?")
# Number words and units.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"
    " nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
UNITS = frozenset(
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces oz pound"
    " pounds lb lbs ton tons tonnes ml l liter liters litre litres gallon gallons second seconds s sec minute minutes min hour"
    " hours h hr hrs day days week weeks month months year years cent cents dollar dollars euro euros usd eur gbp percent"
    " degree degrees mph kmh hz khz mhz ghz volt volts watt watts kw kwh joule joules byte bytes kb mb gb tb".split()
)
_EDGE = "\"'`.,;:!?()[]{}<>«»„“”‘’…-–—_*~|/\\"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def canonical(word: str) -> tuple[int, str]:
    """The kind of a word and what stands for it: its lower-case form without marks around it."""
    plain = word.strip(_EDGE) or word
    low = plain.lower()
    if NUMERIC.fullmatch(plain) or low in NUMBER_WORDS:
        return NUMBER, low
    if low in UNITS:
        return UNIT, low
    if plain[0].isupper() and len(plain) > 1 and plain[1:].islower():
        return NAME, low
    return LITERAL, low


class _Tokens(dict):
    """62 bits of hash and 2 of kind for every word, as itself."""

    LIMIT = 1 << 18

    def __missing__(self, word: str) -> int:
        kind, form = canonical(word)
        if len(self) >= self.LIMIT:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(f"{kind}{form}") >> 2 << 2 | kind
        return found


_TOKENS = _Tokens()
#: The template's token of each kind; literals stand for themselves.
_PLACEHOLDERS = np.array([0, *(xxhash.xxh64_intdigest(f"{kind}") >> 2 << 2 | kind for kind in (NUMBER, NAME, UNIT))], dtype=np.uint64)
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base, and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            out = np.full(1 << n.bit_length(), base, dtype=np.uint64)
            out[0] = 1
            _POWERS[k] = np.cumprod(out, dtype=np.uint64)
    return _POWERS


class _Rolling:
    """Hashes of the windows of any size of one text, from running sums."""

    def __init__(self, words: list[str]):
        n = len(words)
        own = np.fromiter(map(_TOKENS.__getitem__, words), dtype=np.uint64, count=n)
        kind = own & np.uint64(3)
        power, self.back = _powers(n + 1)
        self.sums = np.zeros((2, n + 1), dtype=np.uint64)
        for k, tokens in enumerate((np.where(kind == LITERAL, own, _PLACEHOLDERS[kind]), own)):
            np.cumsum(tokens * power[:n], dtype=np.uint64, out=self.sums[k, 1:])
        self.literal = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(kind == LITERAL, out=self.literal[1:])
        self.n = n

    def literals(self, size: int) -> np.ndarray:
        return self.literal[size:] - self.literal[: self.n + 1 - size]

    def hashes(self, size: int, how: int) -> np.ndarray:
        sums = self.sums[int(how == OWN)]
        out = (sums[size:] - sums[: self.n + 1 - size]) * self.back[: self.n + 1 - size]
        out = (out ^ (out >> np.uint64(31))) * _BASE + np.uint64(size * 4 + how)
        return out ^ (out >> np.uint64(29))


def _least(size: int) -> int:
    return LITERALS if size >= WINDOW else -(-3 * size // 4)


def windows_of_item(words: list[str]) -> list[tuple[int, int, int, int]]:
    """(start, size, how, hash) of the windows by which an item is looked up: of each start the shortest with enough
    literals, at least WINDOW long (a shorter item is one window); those of WINDOW with too few also by their own words; and
    the nearly whole item if the templates cover less than COVERAGE of it."""
    n = len(words)
    if not n:
        return []
    rolling, size = _Rolling(words), min(WINDOW, n)
    found: list[tuple[int, int, int]] = []
    covered = np.zeros(n, dtype=bool)
    for start in range(n - size + 1):
        if rolling.literals(size)[start] < _least(size):
            found.append((start, size, OWN))
        fit = [k for k in (size, *SIZES) if size <= k <= n - start and rolling.literals(k)[start] >= _least(k)]
        if fit:
            found.append((start, fit[0], TEMPLATE))
            covered[start : start + fit[0]] = True
    nearly = max((k for k in SIZES if k <= n), default=0)
    if nearly and covered.sum() < COVERAGE * n:
        found += [(start, nearly, ALL) for start in {0, n - nearly} if rolling.literals(nearly)[start] >= WHOLE]
    return [(start, k, how, int(rolling.hashes(k, how)[start].view(np.int64))) for start, k, how in found]


def windows_of(words: list[str], kinds: list[tuple[int, int]], filled: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(start, size, how, hash) of a text's windows of the given sizes and kinds that are in the bitmap."""
    rolling, out = _Rolling(words), []
    for size, how in kinds:
        if len(words) < size:
            continue
        literals = rolling.literals(size)
        fit = literals >= _least(size) if how == TEMPLATE else literals < _least(size) if how == OWN else literals >= WHOLE
        hashes = rolling.hashes(size, how)
        at = np.flatnonzero(fit)
        at = at[bitmap.has(filled, hashes[at])]
        out += zip(at.tolist(), [size] * len(at), [how] * len(at), hashes[at].view(np.int64).tolist(), strict=True)
    return out


_SLOT = pa.struct([("at", pa.int32()), ("kind", pa.int32()), ("value", pa.string())])
_HIT = pa.struct([("n", pa.int32()), ("start", pa.int32()), ("size", pa.int32()), ("how", pa.int32()), ("h", pa.int64()), ("slots", pa.list_(_SLOT))])
_HIT_FIELDS = ("n", "start", "size", "how", "h", "slots")
_HITS = T.ArrayType(
    T.StructType().add("n", T.IntegerType()).add("start", T.IntegerType()).add("size", T.IntegerType()).add("how", T.IntegerType()).add("h", T.LongType()).add(
        "slots", T.ArrayType(T.StructType().add("at", T.IntegerType()).add("kind", T.IntegerType()).add("value", T.StringType()))
    )
)


def _slots(words: list[str], start: int, size: int) -> list[dict]:
    out = []
    for j, word in enumerate(words[start : start + size]):
        kind, value = canonical(word)
        if kind:
            out.append({"at": j, "kind": kind, "value": value})
    return out


def _hits(batches, name: str, kinds, filled, keep_text: bool):
    """The rows with their windows in a further column: an item's own, or those of a document that are in the bitmap."""
    for batch in slices(batches):
        found = []
        for text in batch.column("text").to_pylist():
            words = (text or "").split()
            at = windows_of_item(words) if kinds is None else windows_of(words, kinds, filled.value) if words else []
            found.append([
                {"n": len(words), "start": start, "size": size, "how": how, "h": h, "slots": _slots(words, start, size)} for start, size, how, h in at
            ])
        columns = [c for c in batch.schema.names if keep_text or c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(found, pa.list_(_HIT))], [*columns, name])


def _with_hits(rows: DataFrame, name: str, kinds=None, filled=None, keep_text: bool = False) -> DataFrame:
    fields = [f for f in rows.schema.fields if keep_text or f.name != "text"]
    return rows.mapInArrow(lambda b: _hits(b, name, kinds, filled, keep_text), T.StructType([*fields, T.StructField(name, _HITS)]))


def _exploded(rows: DataFrame, name: str, *keys) -> DataFrame:
    return rows.select(*keys, F.explode(name).alias("hit")).select("id", *[f"hit.{c}" for c in _HIT_FIELDS])


def item_windows(benchmark: DataFrame) -> DataFrame:
    """The windows of every benchmark item, as ``windows_of_item`` chooses them."""
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return materialize(_exploded(_with_hits(items, "hits"), "hits", "id"), "benchmark")


def _prepared(docs: DataFrame, items: DataFrame):
    """The sizes and kinds of windows to look for (at most 3 x (WINDOW + SIZES)), and the items' bitmap, broadcast at its
    fixed size."""
    kinds = sorted((row["size"], row["how"]) for row in items.select("size", "how").distinct().collect())
    return kinds, docs.sparkSession.sparkContext.broadcast(bitmap.collect(items))


def matches(windows: DataFrame, items: DataFrame) -> DataFrame:
    """Hash join of document and item windows, judged for each (doc_id, item_id).

    Windows of one document and item on one diagonal fill the item's slots. Slots of one kind and value in the item are
    consistent with each other where the document has one value for them too, be it another one: of those that differ,
    the largest part counts. All groups are bounded by the length of an item and how often it recurs in the document.
    """
    left = windows.select(F.col("id").alias("doc_id"), "h", "size", "how", F.col("start").alias("at"), F.col("slots").alias("theirs"))
    right = items.select(F.col("id").alias("item_id"), "h", "size", "how", "start", "n", "slots")
    pair = F.zip_with(
        "slots", "theirs",
        lambda a, b: F.struct((F.col("start") + a.at).alias("at"), a.kind.alias("kind"), a.value.alias("a"), b.value.alias("b")),
    )
    if items.count() <= SMALL:
        right = F.broadcast(right)  # so windows that very many documents hold stay where they are
    met = left.join(right, ["h", "size", "how"]).withColumn("pairs", pair)
    by_diagonal = met.groupBy("doc_id", "item_id", "n", (F.col("at") - F.col("start")).alias("diagonal")).agg(
        F.collect_set(F.struct("start", "size")).alias("starts"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
        F.min("at").alias("first"),
    )
    same = F.filter("pairs", lambda p: p.a == p.b)
    alike = lambda p, q: (q.kind == p.kind) & (q.a == p.a)
    counted = F.transform(
        "pairs", lambda p: F.struct(p.kind.alias("kind"), p.a.alias("a"), p.b.alias("b"), F.size(F.filter("pairs", lambda q: alike(p, q) & (q.b == p.b))).alias("n"))
    )
    more = lambda p, q: (q.n > p.n) | ((q.n == p.n) & (q.b < p.b))
    by_diagonal = by_diagonal.withColumn("counted", counted)
    fits = F.filter("counted", lambda p: ~F.exists("counted", lambda q: alike(p, q) & (q.b != p.b) & more(p, q)))
    by_diagonal = by_diagonal.select(
        "doc_id", "item_id", "n", "starts", "first", F.size("pairs").alias("n_slots"), F.size(fits).alias("fit"), F.size(same).alias("same")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_set("starts")), lambda s: F.sequence(s.start, s.start + s.size - 1)))))
    return by_diagonal.groupBy("doc_id", "item_id", "n").agg(
        covered.alias("covered"), F.sum("n_slots").alias("n_slots"), F.sum("fit").alias("n_consistent"), F.sum("same").alias("n_same"),
        F.min("first").alias("first_word"),
    )


def _leaks(found: DataFrame) -> DataFrame:
    share = F.col("covered") / F.col("n")
    fit = F.col("n_consistent") >= CONSISTENT * F.col("n_slots")
    return found.where((share >= COVERAGE) & fit).select(
        "doc_id", "item_id", share.alias("coverage"), "n_slots", "n_consistent",
        (F.col("n_same") == F.col("n_slots")).alias("verbatim"), F.col("first_word").cast("long").alias("first_word"),
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` and item that it holds: doc_id, item_id, coverage, slots, verbatim.

    Every window of every item is looked up. Only windows in the items' bitmap leave the scan of the documents, whole
    texts included; the join on window hashes, the coverage (COVERAGE) and the slots (CONSISTENT) decide. verbatim:
    every slot holds the item's own value.

    Rows are judged one by one: repeated rows, rows of one doc_id and of none give rows of their own. Null, empty and
    short texts hold nothing; null and wordless items match nothing; items of one item_id are one item. Further
    columns are ignored; an empty table on either side gives no rows.
    """
    items = item_windows(benchmark)
    kinds, filled = _prepared(docs, items)
    texts = documents_of(docs).withColumn("id", F.monotonically_increasing_id())
    hits = _with_hits(texts, "hits", kinds, filled).where(F.size("hits") > 0)
    hits = materialize(hits, "leak-candidates")
    leaks = _leaks(matches(_exploded(hits, "hits", "id"), items)).withColumnRenamed("doc_id", "id")
    return hits.select("id", "doc_id").join(leaks, "id").drop("id")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns of the others, null ids and texts included.

    Each text is read once and written with its windows that are in the items' bitmap; rows without any go straight
    through, and only the others meet the join. Rows are judged one by one, so rows of one doc_id do not share a
    verdict. Further columns pass through, whatever their names; an empty table gives no rows.
    """
    items = item_windows(benchmark)
    kinds, filled = _prepared(docs, items)
    row, name = fresh(docs, "__row", "__hits")
    held = _with_hits(docs, name, kinds, filled, keep_text=True).withColumn(row, F.monotonically_increasing_id())
    held = materialize(held, "leak-candidates")
    leaks = _leaks(matches(_exploded(held.where(F.size(name) > 0), name, F.col(row).alias("id")), items))
    leaks = leaks.select(F.col("doc_id").alias(row)).distinct()
    near = held.where(F.size(name) > 0).join(leaks, row, "left_anti")
    return held.where(F.size(name) == 0).unionByName(near).select(docs.columns)

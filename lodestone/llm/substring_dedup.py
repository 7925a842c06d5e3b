"""Substring dedup: Rabin-Karp hashes of the windows of words, counted in Spark; repeated windows merge to intervals."""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bitmap
from .common import documents_of, slices, utf8_buffer
from .repeats import SLICE, Shape, merged, mixed, repeated_anchors, runs, text_hash
from .suffix_dedup import NULL_ID, with_spans

WINDOW = 20
#: Words of an anchor: a window whose anchor the corpus holds once occurs once itself, so its hash is not sent.
GRAM = 10
#: Windows among which a task looks for equal ones before it sends them.
GATHER = 1 << 20
_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes of words whose hashes a task remembers.
REMEMBERED = 64 << 20
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << n.bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            _POWERS[k] = np.cumprod(out, dtype=np.uint64)
    return _POWERS


class _Hashes(dict):
    """XXH64 of words met lately. A polynomial over a word's bytes would let long words of one letter pattern collide."""

    def __init__(self):
        super().__init__()
        self.size = 0

    def __missing__(self, word: bytes) -> int:
        self.size += len(word) + 100
        if self.size > REMEMBERED:
            self.clear()
            self.size = 0
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_HASHES = _Hashes()


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of a text buffer, and the offsets of rows in the words."""
    whole, ends = data.tobytes(), offsets.tolist()
    words = [whole[a:b].split() for a, b in zip(ends, ends[1:], strict=False)]  # of bytes: at the six white spaces of ASCII
    counts = np.array([0, *map(len, words)], dtype=np.int64)
    hashes = np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(words)), dtype=np.uint64, count=int(counts.sum()))
    return hashes, np.cumsum(counts)


def _words(data: np.ndarray, offsets: np.ndarray):
    t, off = word_hashes(data, offsets)
    rows = np.arange(len(offsets) - 1)
    yield t, off, rows, np.zeros(len(rows), dtype=np.int64), t


def rabin_karp(t: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The rolling hash of every window of word hashes."""
    n = len(t) - window + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    power, inverse = _powers(len(t) + 1)
    sums = np.zeros(len(t) + 1, dtype=np.uint64)
    np.cumsum(t * power[: len(t)], dtype=np.uint64, out=sums[1:])
    return mixed((sums[window:] - sums[:n]) * inverse[:n])


SHAPE = Shape(WINDOW, GRAM, _words)

_SENT = "h long, h2 long, doc_id long, key long, start int, stop int"
_NAMES = [part.split()[0] for part in _SENT.split(", ")]


def _places(batches, repeated):
    """Arrays of h, h2, doc_id, key and start of the windows that may recur, by slices of the texts. The two hashes are
    those of the words' hashes and of a mixture of them, so windows of equal h and h2 are equal."""
    for batch in slices(batches, size=SLICE):
        data, offsets = utf8_buffer(batch.column("text"))
        t, off = word_hashes(data, offsets)
        starts, counts, _, anchors = runs(t, off, WINDOW, GRAM)
        kept = bitmap.has(repeated.value, anchors)
        starts, counts = starts[kept], counts[kept]
        at = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        row = np.searchsorted(off, at, "right") - 1
        ids = np.asarray(batch.column("doc_id").to_numpy(zero_copy_only=False), dtype=np.int64)
        ends = zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
        keys = np.array([text_hash(data[a:b].tobytes()) for a, b in ends], dtype=np.int64)
        yield rabin_karp(t)[at].view(np.int64), rabin_karp(mixed(t + _BASE))[at].view(np.int64), ids[row], keys[row], at - off[row]


def _firsts(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Of windows that these slices hold more than once the first one, to be counted in Spark (stop: null). The others
    are repeated whatever Spark finds: their intervals, spread over the keys."""
    h, h2, doc, key, start = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((start, key, doc, h2, h))
    h, h2, doc, key, start = (x[order] for x in (h, h2, doc, key, start))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else np.empty(0, dtype=np.int64)
    again = np.flatnonzero((doc != doc[first]) | (key != key[first]) | (start != start[first]))
    again = again[np.lexsort((start[again], key[again], doc[again]))]
    d, k, s = doc[again], key[again], start[again]
    cut = np.ones(len(again), dtype=bool)
    cut[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (s[1:] > s[:-1] + 1)
    begin = np.flatnonzero(cut)
    stop = s[np.append(begin[1:], len(s)) - 1] + 1 if len(s) else s
    # As they stand in the texts: neighbours in a partition then share their document, which compresses well.
    new = np.sort(order[new])
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    new = back[new]
    columns = [np.concatenate(x) for x in (
        (h[new], k[begin] ^ s[begin]), (h2[new], d[begin]), (doc[new], d[begin]), (key[new], k[begin]), (start[new], s[begin]),
    )]
    stops = pa.array(np.concatenate([np.zeros(len(new), dtype=np.int64), stop]), pa.int32(), mask=np.arange(len(new) + len(stop)) < len(new))
    return pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns[:4]), pa.array(columns[4], pa.int32()), stops], _NAMES)


def _sent(batches, repeated):
    held, size = [], 0
    for found in _places(batches, repeated):
        held.append(found)
        size += len(found[0])
        if size >= GATHER:
            yield _firsts(held)
            held, size = [], 0
    if size:
        yield _firsts(held)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, key and intervals [start, stop) of words that earlier windows cover; they may overlap.

    Window hashes are grouped in Spark and counted in the order of their places: all but the first are repeated. A task
    sends an equal window once for each GATHER windows that it reads, so a very common passage is no hot group.
    """
    texts = documents_of(docs).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "text")
    repeated, _ = repeated_anchors(texts, SHAPE)
    sent = texts.mapInArrow(lambda b: _sent(b, repeated), _SENT)
    number = F.rank().over(Window.partitionBy("h", "h2").orderBy("doc_id", "key", "start"))
    found = sent.withColumn("number", number).where("stop is not null or number > 1")
    stop = F.coalesce(F.col("stop"), F.col("start") + 1) + (WINDOW - 1)
    return found.select("doc_id", "key", "start", stop.alias("stop"))


def _cut(batches):
    for batch in slices(batches):
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words, spans = text.encode().split(), merged(spans)
            kept, at = [], 0
            for start, stop in spans:
                kept += words[at:start]
                at = stop
            kept += words[at:]
            out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        columns = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.string()], strict=True))],
            ["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row, without each word that lies in a window of WINDOW words
    which also starts earlier: in a document of a smaller doc_id, or before it in the same document.

    Windows are judged on the input. Words are compared as they are and end at ASCII white space. Null and empty texts
    have no words. A null doc_id counts as larger than all others; different texts of one doc_id count as documents
    of their own, in the order of their hashes. Repeated rows (same id, same text) are one document and each
    give a row. Further columns are ignored; an empty table gives no rows.
    """
    found = with_spans(docs, repeated_spans(docs))
    return found.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")

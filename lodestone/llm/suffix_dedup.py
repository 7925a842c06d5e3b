"""Suffix-array dedup: byte strings that an earlier document holds, by bounded interval expansion on a Burrows-Wheeler
transform."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, slices
from .repeats import Block, Shape, intervals, merged

LEAST = 50
#: Longer grams are shared by chance less often, so fewer texts reach the arrays; shorter ones make fewer runs.
GRAM = 20
#: Byte positions that are hashed at once; longer texts come in pieces that overlap by a window.
PIECE = 1 << 20
NULL_ID = (1 << 63) - 1

_TABLE = np.random.default_rng(50).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _bytes(data: np.ndarray, offsets: np.ndarray):
    longest = int(np.diff(offsets).max(initial=0))
    if longest <= PIECE:
        rows = np.arange(len(offsets) - 1)
        yield _TABLE[data], offsets, rows, np.zeros(len(rows), dtype=np.int64), data
        return
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for at in range(a, max(b - LEAST + 1, a + 1), PIECE):
            part = data[at : min(b, at + PIECE + LEAST - 1)]
            yield _TABLE[part], np.array([0, len(part)]), np.array([row]), np.array([at - a]), part


def _content(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, window: int) -> list[bytes]:
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(starts.tolist(), (starts + counts + window - 1).tolist(), strict=True)]


SHAPE = Shape(LEAST, GRAM, _bytes, _content)


def _bits(n: int) -> int:
    """Bits of the places of n symbols."""
    return max(1, (n - 1).bit_length())


def _ranked(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Rank of each key (below 2^bits) among the distinct ones, the order of places by key, and the number of ranks.

    Where key and place fit into one word, plain values are sorted: much faster than an indirect sort."""
    place_bits = _bits(len(key))
    if bits + place_bits <= 64:
        packed = key.astype(np.uint64) << np.uint64(place_bits) | np.arange(len(key), dtype=np.uint64)
        packed.sort()
        order = (packed & np.uint64((1 << place_bits) - 1)).astype(np.int64)
        found = packed >> np.uint64(place_bits)
    else:
        order = np.argsort(key, kind="stable")
        found = key[order]
    ranks = np.zeros(len(key), dtype=np.int64)
    np.cumsum(found[1:] != found[:-1], out=ranks[1:])
    rank = np.empty(len(key), dtype=np.int64)
    rank[order] = ranks
    return rank, order, int(ranks[-1]) + 1 if len(ranks) else 0


def suffix_array(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of the texts end to end, each closed by an end mark of its own (marks sort first, in order of
    the texts); the symbols (0: an end mark, else byte + 1); and where each text starts."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.cumsum(lengths + 1) - lengths - 1
    symbols = np.zeros(int((lengths + 1).sum()), dtype=np.int64)
    inside = np.ones(len(symbols), dtype=bool)
    inside[starts + lengths] = False
    symbols[inside] = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.int64) + 1
    # Ranks by a few symbols (9 bits each), then by twice as many until the longest text is ranked whole; what lies
    # behind an end mark counts for nothing, and suffixes that are equal up to their marks stay in order.
    left = np.repeat(starts + lengths, lengths + 1) - np.arange(len(symbols))  # symbols before the mark
    place_bits = _bits(len(symbols))
    width = max(1, min(7, (64 - place_bits) // 9))
    padded = np.append(symbols, np.zeros(width, dtype=np.int64))
    key = np.zeros(len(symbols), dtype=np.int64)
    for j in range(width):
        key = key << 9 | np.where(left >= j, padded[j : j + len(symbols)], 0)
    rank, order, distinct = _ranked(key, 9 * width)
    longest = int(lengths.max(initial=0)) + 1
    while width < longest and distinct < len(rank):
        ahead = np.zeros(len(rank), dtype=np.int64)
        reach = left >= width
        ahead[reach] = rank[np.flatnonzero(reach) + width] + 1
        rank, order, distinct = _ranked(rank << place_bits + 1 | ahead, 2 * place_bits + 1)
        width *= 2
    return order, symbols, starts


def interval_bounds(array: np.ndarray, symbols: np.ndarray, least: int) -> np.ndarray:
    """For each rank of the suffix array, whether its suffix shares fewer than ``least`` symbols with the one before:
    whether an interval of common prefixes of ``least`` symbols starts there.

    Breadth-first backward extension on the Burrows-Wheeler transform: round l finds the bounds at which exactly l
    symbols are shared. The suffixes at ranks i - 1 and i that start with the same symbol are the backward extensions
    of two suffixes q' < q, the neighbouring places of that symbol in the transform; they share one symbol more than
    the least shared by any neighbours between q' and q. So rank i gets its bound in the round after the first bound
    in (q', q] was found; at ``least`` the expansion stops, and what has no bound by then shares at least that many.
    """
    transform = symbols[array - 1].astype(np.uint16)
    back = np.argsort(transform, kind="stable")  # rank -> place of its first symbol in the transform
    first = transform[back]
    bound = np.ones(len(array), dtype=bool)
    bound[1:] = (first[1:] != first[:-1]) | (first[1:] == 0)  # end marks all differ
    open_ = np.flatnonzero(~bound)
    q, before = back[open_], back[open_ - 1]
    for _ in range(1, least):
        found = np.cumsum(bound, dtype=np.int32 if len(bound) < 1 << 31 else np.int64)
        met = found[q] != found[before]
        if not met.any():
            break
        bound[open_[met]] = True
        open_, q, before = open_[~met], q[~met], before[~met]
    return bound


def first_owners(texts: list[bytes], owner: np.ndarray, least: int = LEAST) -> list[np.ndarray]:
    """For each text and each of its strings of ``least`` bytes: the least owner of a text that holds this string."""
    array, symbols, starts = suffix_array(texts)
    bounds = np.flatnonzero(interval_bounds(array, symbols, least))
    owner_at = np.repeat(owner, np.diff(np.append(starts, len(symbols))))
    low = np.minimum.reduceat(owner_at[array], bounds)
    out = np.empty(len(array), dtype=np.int64)
    out[array] = np.repeat(low, np.diff(np.append(bounds, len(array))))
    return [out[s : s + max(0, len(t) - least + 1)] for s, t in zip(starts.tolist(), texts, strict=True)]


def _judge(block: Block) -> np.ndarray:
    """Equal runs are collapsed to one text, owned by the least of their documents. A text that is then alone with its
    anchor shares no window with another one; for all others the intervals decide."""
    number: dict[bytes, int] = {}
    text = np.fromiter((number.setdefault(c, len(number)) for c in block.content), dtype=np.int64, count=len(block.n))
    owner = np.full(len(number), NULL_ID, dtype=np.int64)
    np.minimum.at(owner, text, block.doc_id)
    anchor = np.empty(len(number), dtype=np.int64)
    anchor[text] = block.h
    _, which, count = np.unique(anchor, return_inverse=True, return_counts=True)
    contested = np.flatnonzero(count[which] > 1)
    least = owner[text][block.run_of]
    if len(contested):
        texts = list(number)
        owners = first_owners([texts[k] for k in contested], owner[contested])
        at = dict(zip(contested.tolist(), owners, strict=True))
        parts = [at.get(k) for k in text.tolist()]
        ends = np.cumsum(block.n)
        for k, part in enumerate(parts):
            if part is not None:
                least[ends[k] - block.n[k] : ends[k]] = part
    return np.repeat(block.doc_id, block.n) > least


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, key and byte intervals [start, stop) that earlier documents cover; they may overlap."""
    texts = documents_of(docs).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "text")
    return intervals(texts, SHAPE, _judge)


def _cut(batches):
    for batch in slices(batches):
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            raw, spans = text.encode(), merged(spans)
            kept, at = hashlib.sha256(), 0
            for start, stop in spans:
                kept.update(raw[at:start])
                at = stop
            kept.update(raw[at:])
            out.append((len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
        columns = list(zip(*out, strict=True)) or [()] * 4
        types = [pa.int64()] * 3 + [pa.string()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, text and the list of intervals of every row; rows of one id and text have the same."""
    lists = spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    lists = lists.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "spans")
    texts = documents_of(docs).withColumns({"__id": F.coalesce("doc_id", F.lit(NULL_ID)), "__key": F.xxhash64("text")})
    return texts.join(lists, ["__id", "__key"], "left").select("doc_id", "text", "spans")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row, without each byte that lies in a string of
    LEAST bytes which also starts in a document of a smaller doc_id.

    Strings are judged on the input; they may overlap, and runs of removed bytes are maximal. Null and empty texts have
    no bytes. A null doc_id counts as larger than all others, and rows of one doc_id remove nothing from each other.
    Repeated rows each give a row. Further columns are ignored; an empty table gives no rows.
    """
    found = with_spans(docs, repeated_spans(docs))
    return found.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

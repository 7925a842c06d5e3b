"""Finding repeated fixed-length windows of a corpus, of bytes or of words: what suffix and substring dedup share.

Every window has one anchor: its gram (a shorter window in it) of least hash, the first of equals. Equal windows have
equal anchors, so windows whose anchor occurs once cannot repeat and are never moved: ``repeated_anchors`` counts anchors
in Spark. Suffix dedup then sends runs of neighbouring windows with the same anchor as one row, to the partition of
their anchor, and compares them there (``intervals``); substring dedup sends the hashes of the windows.

The anchors' counts reach the second pass as bitmaps of one size at every input (``bitmap.BITS``, a parameter of
``repeated_anchors``). They prune while repeated anchors are few against its 2^27 bits: up to some 10^8 distinct ones,
which is about 100 GB of text like that of the tests; beyond, more windows travel and the results stay the same. An
anchor met in very many contexts is no hot key: its runs are cut in two, by the units before and after it that their
windows contain as well, and keyed by these too. Within a task, equal runs are sent once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmap
from .common import materialize, release, slices, utf8_buffer

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Bits of an anchor's hash that are counted: enough for the bitmaps, and fewer bytes to shuffle.
COUNTED = 40
#: Occurrences from which an anchor's runs are cut by their context, and the bits of the bitmap of such anchors.
HOT, HOT_BITS = 1000, 24
#: Anchors that a task gathers before it counts them, and runs that it remembers to send equal ones once.
GATHER, REMEMBER = 1 << 21, 200_000
#: Bytes of text that are hashed at once, and rows and bytes compared at once.
SLICE, BLOCK_ROWS, BLOCK_BYTES = 1 << 20, 20_000, 1 << 20

Units = Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]


@dataclass(frozen=True)
class Shape:
    """Windows of ``window`` units with grams of ``gram`` units.

    ``units`` turns a text buffer and its row offsets into pieces: the units' hashes, the offsets of rows in them, the
    rows' numbers, the rows' first units, and the bytes or hashes from which ``content`` makes a run's content.
    """

    window: int
    gram: int
    units: Units
    content: Callable[[np.ndarray, np.ndarray, np.ndarray, int], list[bytes]] | None = None


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def grams(t: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of every k neighbouring units: the hashes of doubling lengths, put together."""
    out, done, part, width, at = None, 0, t, 1, 0
    n = len(t) - k + 1
    while True:
        if k & width:
            tail = part[at : at + n]
            out = tail if out is None else out * np.uint64(pow(_BASE, width, 1 << 64)) + tail
            done += width
            at += width
        if done == k:
            return mixed(out)
        part = part[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + part[width:]
        width *= 2


def runs(t: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: first window, number of windows, place of the anchor, its hash."""
    n = len(t) - window + 1
    if n < 1:
        return tuple(np.empty(0, dtype=d) for d in (np.int64, np.int64, np.int64, np.uint64))
    g = grams(t, gram)
    low = (g >> np.uint64(32) << np.uint64(32)) | np.arange(len(g), dtype=np.uint64)
    span, width = window - gram + 1, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[span - width : span - width + n])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # Windows across a row's end are none.
    change = np.zeros(n + 1, dtype=np.int64)
    ends = offsets[1:-1]
    np.add.at(change, np.clip(ends - window + 1, 0, n), 1)
    np.add.at(change, np.clip(ends, 0, n), -1)
    place[np.cumsum(change[:n]) > 0] = -1
    starts = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    counts = np.diff(np.append(starts, n))
    kept = place[starts] >= 0
    starts, counts = starts[kept], counts[kept]
    anchors = place[starts]
    return starts, counts, anchors, g[anchors]


def _text_slices(batches):
    for batch in slices(batches, size=SLICE):
        yield batch, *utf8_buffer(batch.column("text"))


def _counted(batches, shape: Shape):
    """Anchors of a task with their counts (2: two or more; HOT: as many), each once in a flush, in order."""
    held, size = [], 0

    def flush():
        anchors, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(counts.astype(np.int64))], ["h", "n"])

    for _, data, offsets in _text_slices(batches):
        for t, off, *_ in shape.units(data, offsets):
            held.append(runs(t, off, shape.window, shape.gram)[3] & np.uint64((1 << COUNTED) - 1))
            size += len(held[-1])
        if size >= GATHER:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def _context(t: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    h = np.full(len(start), length, dtype=np.uint64)
    for j in range(length):
        h = h * np.uint64(_BASE) + t[start + j]
    return h


def _split(t: np.ndarray, shape: Shape, found: tuple[np.ndarray, ...], hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of hot anchors cut in two: windows with ``half`` units before the anchor, and those with the others after it."""
    starts, counts, anchors, keys = found
    if not hot.any():
        return starts, counts, keys
    span = shape.window - shape.gram + 1
    half = span // 2
    s, c, a, k = (x[hot] for x in found)
    cut = np.clip(a - half + 1 - s, 0, c)  # windows that start no later than ``half`` units before the anchor
    left, right = cut > 0, cut < c
    left_key = mixed(_context(t, a[left] - half, half) ^ k[left])
    right_key = mixed(_context(t, a[right] + shape.gram, span - half) + k[right])
    return (
        np.concatenate([starts[~hot], s[left], (s + cut)[right]]), np.concatenate([counts[~hot], cut[left], (c - cut)[right]]),
        np.concatenate([keys[~hot], left_key, right_key]),
    )


_SENT = "h long, doc_id long, key long, start long, n int, content binary"
_SENT_NAMES = [part.split()[0] for part in _SENT.split(", ")]
_SENT_TYPES = [pa.int64()] * 4 + [pa.int32(), pa.binary()]
_FOUND = "doc_id long, key long, start long, stop long"
_FOUND_NAMES = ["doc_id", "key", "start", "stop"]


def text_hash(text: bytes) -> int:
    """As Spark's xxhash64, a signed long."""
    h = xxhash.xxh64_intdigest(text, 42)
    return h - (1 << 64) if h >> 63 else h


def _send(batches, shape: Shape, repeated, hot):
    """Runs that may be repeated. A run equal to an earlier one of this task comes without content: all its windows
    are repeated. Such rows are spread by their document."""
    seen: dict[bytes, tuple] = {}
    for batch, data, offsets in _text_slices(batches):
        ids = batch.column("doc_id").to_pylist()
        keys = [text_hash(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        out: list[tuple] = []
        for t, off, rows, firsts, source in shape.units(data, offsets):
            found = runs(t, off, shape.window, shape.gram)
            kept = bitmap.has(repeated.value, found[3])
            found = tuple(x[kept] for x in found)
            starts, counts, anchors = _split(t, shape, found, bitmap.has(hot.value, found[3]))
            piece = np.searchsorted(off, starts, "right") - 1
            content = shape.content(source, starts, counts, shape.window)
            begin = starts - off[piece] + firsts[piece]
            for h, row, start, n, held in zip(anchors.view(np.int64).tolist(), rows[piece].tolist(), begin.tolist(), counts.tolist(), content, strict=True):
                me = (ids[row], keys[row], start)
                first = seen.get(held)
                if first is not None and first[0] < me[0]:
                    out.append((keys[row], *me, n, None))
                else:
                    seen[held] = me
                    out.append((h, *me, n, held))
            if len(seen) > REMEMBER:
                seen.clear()
        columns = list(zip(*_joined(out), strict=True)) or [()] * len(_SENT_NAMES)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SENT_TYPES, strict=True)], _SENT_NAMES)


def _joined(rows: list[tuple]) -> list[tuple]:
    """Neighbouring runs without content as one."""
    plain = sorted((r for r in rows if r[5] is None), key=lambda r: r[1:4])
    out = [r for r in rows if r[5] is not None]
    for r in plain:
        if out and out[-1][5] is None and out[-1][1:3] == r[1:3] and out[-1][3] + out[-1][4] == r[3]:
            out[-1] = (*out[-1][:4], out[-1][4] + r[4], None)
        else:
            out.append(r)
    return out


@dataclass
class Block:
    """Runs of some anchors, all of each: one row a run. Windows are numbered through, by runs."""

    h: np.ndarray
    doc_id: np.ndarray
    key: np.ndarray
    start: np.ndarray
    n: np.ndarray
    content: list[bytes]

    @property
    def run_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)

    @property
    def offset(self) -> np.ndarray:
        return np.arange(self.n.sum()) - np.repeat(np.cumsum(self.n) - self.n, self.n)


def _blocks(batches) -> Iterator[tuple[pa.Table | None, pa.Table]]:
    """Rows in the order of anchors, cut where an anchor ends."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        h = batch.column("h").to_numpy()
        if held and (rows >= BLOCK_ROWS or size >= BLOCK_BYTES):
            last = held[-1].column("h")[-1].as_py()
            cut = int(np.searchsorted(h, last, "right"))
            held.append(batch.slice(0, cut))
            if cut < len(batch):
                yield pa.Table.from_batches(held)
                held, rows, size, batch = [], 0, 0, batch.slice(cut)
            else:
                continue
        held.append(batch)
        rows += len(batch)
        size += batch.column("content").nbytes
    if held:
        yield pa.Table.from_batches(held)


def _compared(batches, shape: Shape, judge: Callable[[Block], np.ndarray]):
    def cut(batches):
        for batch in batches:
            yield from (batch.slice(k, 5000) for k in range(0, len(batch), 5000))

    for rows in _blocks(cut(batches)):
        columns = {c: rows.column(c).to_numpy() for c in ("h", "doc_id", "key", "start", "n")}
        whole = np.asarray(rows.column("content").is_null())
        out = [(columns["doc_id"][whole], columns["key"][whole], columns["start"][whole], (columns["start"] + columns["n"])[whole])]
        if not whole.all():
            content = rows.column("content").filter(pa.array(~whole)).to_pylist()
            block = Block(*(columns[c][~whole] for c in ("h", "doc_id", "key", "start", "n")), content)
            repeated = judge(block)
            run, at = block.run_of[repeated], (np.repeat(block.start, block.n) + block.offset)[repeated]
            if len(run):
                new = np.concatenate([[True], (run[1:] != run[:-1]) | (at[1:] != at[:-1] + 1)])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(run)) - 1
                out.append((block.doc_id[run[first]], block.key[run[first]], at[first], at[last] + 1))
        merged = [np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True)]
        merged[3] = merged[3] + shape.window - 1  # from windows to the units they cover
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged], _FOUND_NAMES)


def repeated_anchors(texts: DataFrame, shape: Shape, bits: int = bitmap.BITS):
    """Broadcast bitmaps of the anchors of ``texts(doc_id, text)`` that occur twice or more, and of those that occur
    HOT times or more; 2^``bits`` and 2^HOT_BITS bits, whatever the input."""
    spark = texts.sparkSession
    counted = texts.mapInArrow(lambda b: _counted(b, shape), "h long, n long")
    # Dealt out as they come, in order: a task has each anchor once, so there is nothing to sum before.
    counted = counted.repartition("h").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    counted = counted.select("h", (F.col("n") >= HOT).alias("hot")).persist()
    repeated = spark.sparkContext.broadcast(bitmap.collect(counted, bits=bits))
    hot = spark.sparkContext.broadcast(bitmap.collect(counted.where("hot"), bits=HOT_BITS))
    counted.unpersist()
    del counted
    release(spark)
    return repeated, hot


def intervals(texts: DataFrame, shape: Shape, judge: Callable[[Block], np.ndarray]) -> DataFrame:
    """Units of ``texts(doc_id, text)``, no nulls, covered by repeated windows: doc_id, key (hash of the text), and
    the intervals [start, stop), which may touch and overlap. ``judge`` says which windows of a block are repeated.

    The intervals are written to the shared folder, and each pass lets go of its shuffle before the next one starts."""
    repeated, hot = repeated_anchors(texts, shape)
    sent = texts.mapInArrow(lambda b: _send(b, shape, repeated, hot), _SENT)
    sent = sent.repartition("h").sortWithinPartitions("h")
    found = materialize(sent.mapInArrow(lambda b: _compared(b, shape, judge), _FOUND), "repeats")
    del sent
    release(texts.sparkSession)
    return found


def merged(starts: list[dict] | None) -> list[tuple[int, int]]:
    """Overlapping and touching intervals as maximal ones, in order."""
    out: list[tuple[int, int]] = []
    for span in sorted((s["start"], s["stop"]) for s in starts or ()):
        if out and span[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], span[1]))
        else:
            out.append(span)
    return out

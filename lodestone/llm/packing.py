"""Hierarchical multi-length packing of a tokenised corpus into training sequences."""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import documents_of, slices
from .encoding import encode_array

CLOSING_ID = 1
#: Context sizes, longest first. Every document tail goes to the shortest that holds it.
TIERS = (2048, 1024, 512, 256)
#: Tails that a task holds before it packs them: at most POOL x TIERS[0] ids of memory.
POOL = 4096
#: Tokens of one training step: a step group of tier T has STEP_TOKENS / T sequences.
STEP_TOKENS = 8 * TIERS[0]
#: Full step groups of a tier among which a task balances the cost at once.
DEALT = 16
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,"
    " tier int, step_group long"
)
_TYPES = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
_NAMES = [part.split()[0] for part in SCHEMA.split(",")]


@dataclass
class Piece:
    """A run of one document's ids."""

    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc_id, self.start, self.ids[:n], self.doc_tokens),
            Piece(self.doc_id, self.start + n, self.ids[n:], self.doc_tokens),
        )


@dataclass
class Packer:
    """Packs what one task reads; ``first`` is the task's first sequence id and the prefix of its step groups."""

    tiers: tuple[int, ...]
    first: int
    done: int = 0
    steps: int = 0
    #: Closed sequences by their length, as the rows of their pieces: the ids themselves are let go.
    full: dict[int, list[list[tuple]]] = field(default_factory=dict)
    tails: list[Piece] = field(default_factory=list)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        whole = self.tiers[0]
        for start in range(0, len(ids) - whole + 1, whole):
            self._close([Piece(doc_id, start, ids[start : start + whole], len(ids))])
        if rest := len(ids) % whole:
            self.tails.append(Piece(doc_id, len(ids) - rest, ids[len(ids) - rest :], len(ids)))

    def _close(self, pieces: list[Piece]) -> None:
        rows = [(p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.doc_tokens) for p in pieces]
        self.full.setdefault(sum(row[2] for row in rows), []).append(rows)

    def pack(self) -> None:
        """Every tail gets a window of its tier, longest first; shorter tails fill the gap, the last one by a cut.

        Windows are therefore exactly full. Only the very last window of a pool may lack filling; its ids are split
        into sequences of powers of two, which need no padding either.
        """
        pool = sorted(self.tails, key=lambda p: len(p.ids))
        lengths = [len(p.ids) for p in pool]
        self.tails = []
        while pool:
            window, used = [pool.pop()], lengths.pop()
            size = min(t for t in self.tiers if t >= used)
            while used < size and pool:
                k = bisect.bisect_right(lengths, size - used) - 1
                if k >= 0:
                    window.append(pool.pop(k))
                    used += lengths.pop(k)
                    continue
                head, tail = pool.pop(0).cut(size - used)
                lengths.pop(0)
                window.append(head)
                used = size
                k = bisect.bisect_left(lengths, len(tail.ids))
                pool.insert(k, tail)
                lengths.insert(k, len(tail.ids))
            if used == size:
                self._close(window)
            else:
                self._split(window, used)

    def _split(self, window: list[Piece], used: int) -> None:
        for size in (1 << k for k in range(used.bit_length() - 1, -1, -1) if used >> k & 1):
            part: list[Piece] = []
            while size:
                piece = window.pop(0)
                if len(piece.ids) > size:
                    piece, rest = piece.cut(size)
                    window.insert(0, rest)
                part.append(piece)
                size -= len(piece.ids)
            self._close(part)

    def flush(self, last: bool = False) -> pa.RecordBatch:
        """Rows of whole step groups; other closed sequences wait for the next flush. In each tier, sequences are dealt to
        groups by falling attention cost (the sum of squared piece lengths), back and forth, so that the groups cost
        alike. At the ``last`` flush what is left of a tier is one smaller group."""
        rows: list[tuple] = []
        for tier, sequences in sorted(self.full.items(), reverse=True):
            size = max(1, STEP_TOKENS // tier)
            groups = len(sequences) // size
            if groups < DEALT and not last:
                continue
            dealt, self.full[tier] = sequences[: groups * size], sequences[groups * size :]
            for rank, pieces in enumerate(sorted(dealt, key=lambda pieces: -sum(p[2] ** 2 for p in pieces))):
                turn, at = divmod(rank, groups)
                self._number(rows, tier, self.steps + (groups - 1 - at if turn % 2 else at), pieces)
            self.steps += groups
            if last and self.full[tier]:
                for pieces in self.full.pop(tier):
                    self._number(rows, tier, self.steps, pieces)
                self.steps += 1
        columns = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)

    def _number(self, rows: list[tuple], tier: int, group: int, pieces: list[tuple]) -> None:
        offset = 0
        for p in pieces:
            rows.append((*p, self.first + self.done, offset, tier, self.first + group))
            offset += p[2]
        self.done += 1


def _pack(batches, tiers: tuple[int, ...]):
    packer = Packer(tiers, TaskContext.get().partitionId() << 40)
    for batch in slices(batches):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            packer.add(doc_id, encode_array(text, CLOSING_ID))
        if len(packer.tails) >= POOL:
            packer.pack()
        yield packer.flush()
    packer.pack()
    yield packer.flush(last=True)


def pack(docs: DataFrame, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Pack whole documents into sequences; one row for each piece of a document in a sequence.

    A document's ids are those of its whole text and a closing id. Full windows of the longest tier are cut off its
    front; the tail goes to the shortest tier that holds it. Each task packs what it reads: there is no shuffle, and
    a task holds at most POOL tails. Step groups are of one tier and of STEP_TOKENS tokens, but for a task's last one of
    a tier, and a task balances DEALT or more of them at a time by their attention cost. sequence_id and step_group are unique over tasks, whose input splits fix them.

    Null and empty texts are packed as their closing id. Repeated rows and rows that share a doc_id are packed each
    for itself; a null doc_id stays null. Further columns are ignored. An empty table gives no rows.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers), reverse=True):
        raise ValueError("tiers are powers of two, longest first")
    return documents_of(docs).mapInArrow(lambda batches: _pack(batches, tiers), SCHEMA)

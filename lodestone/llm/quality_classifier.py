"""Quality by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, slices
from .sampling import held_out, labelled_sample

#: Labelled rows of either label that are learned from and broadcast: at most twice this, of RANK numbers each.
PER_CLASS = 2048
#: Latent dimensions, and neighbours that vote.
RANK, NEIGHBOURS = 64, 25
#: A neighbour votes by this power of its cosine: vectors of texts are all alike to a point.
SHARPNESS = 16
THRESHOLD = 0.7

SHAPES, WORDS, REPEATS = 512, 1024, 24
SIZE = SHAPES + WORDS + REPEATS
#: Weight of the words themselves against their shapes and their repetition.
WORD_WEIGHT = 0.3


class _Terms(dict):
    """The terms of a word, hashed: its shape (character classes, length, final mark) and its lower-case form."""

    LIMIT = 1 << 17

    def __missing__(self, word: str) -> int:
        kinds, last = [], ""
        for c in word[:32]:
            kind = "U" if c.isupper() else "l" if c.isalpha() else "9" if c.isdigit() else c if c.isascii() else "?"
            if kind != last:
                kinds.append(kind)
                last = kind
        shape = f"{''.join(kinds)}{min(len(word), 20) // 4}"
        found = zlib.crc32(shape.encode()) % SHAPES * WORDS + zlib.crc32(word.lower().encode()) % WORDS
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = found
        return found


_TERMS = _Terms()
_SHARES = np.array([0.003, 0.01, 0.03, 0.1, 0.3])


def vector(text: str) -> np.ndarray:
    """Square roots of shares: of word shapes, of how often words recur, and of words; zero without a word."""
    counted = Counter(text.split())
    out = np.zeros(SIZE, dtype=np.float32)
    if not counted:
        return out
    counts = np.fromiter(counted.values(), dtype=np.float64, count=len(counted))
    terms = np.fromiter(map(_TERMS.__getitem__, counted), dtype=np.int64, count=len(counted))
    shares = counts / counts.sum()
    # How often a word comes (once, twice, up to four times, more) against its share of the text.
    often = np.minimum(np.log2(counts).astype(np.int64), 3) * 6 + np.searchsorted(_SHARES, shares)
    out[:SHAPES] = np.bincount(terms // WORDS, shares, SHAPES)
    out[SHAPES : SHAPES + WORDS] = np.bincount(terms % WORDS, shares * WORD_WEIGHT**2, WORDS)
    out[SHAPES + WORDS :] = np.bincount(often, shares, REPEATS)
    return np.sqrt(out)


def _vectors(batches):
    for batch in slices(batches):
        rows = [vector(text).tobytes() for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary())], ["doc_id", "vector"])


@dataclass
class Model:
    #: SIZE x RANK: term space to latent space.
    axes: np.ndarray
    #: RANK x rows: unit vectors of the labelled rows, then their labels and weights.
    points: np.ndarray
    labels: np.ndarray
    weights: np.ndarray

    @property
    def prior(self) -> float:
        return float(self.weights @ self.labels / self.weights.sum()) if len(self.labels) else 0.5

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled rows of each row, weighted by similarity; where nothing is
        similar, the labels' own share."""
        out = np.full(len(rows), self.prior)
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(rows) if k else 0, 256):
            latent = rows[at : at + 256] @ self.axes
            norm = np.linalg.norm(latent, axis=1, keepdims=True)
            cosine = np.divide(latent, norm, out=np.zeros_like(latent), where=norm > 1e-6) @ self.points
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            vote = np.clip(np.take_along_axis(cosine, near, axis=1), 0, 1).astype(np.float64) ** SHARPNESS * self.weights[near]
            total = vote.sum(axis=1)
            share = np.divide((vote * self.labels[near]).sum(axis=1), total, out=out[at : at + 256].copy(), where=total > 1e-12)
            out[at : at + 256] = share
        return np.clip(out, 0, 1)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """The latent space (leading right singular vectors of the labelled rows' term vectors) and the rows in it.

    What comes to the driver is at most 2 x ``per_class`` vectors of SIZE numbers, however large the corpus; the
    labelled ids that pick those rows are broadcast, under the same bound. Without labelled rows the model has none
    and scores 0.5.
    """
    sample = labelled_sample(labels, per_class)
    texts = documents_of(docs).join(F.broadcast(sample), "doc_id", "left_semi")
    rows = texts.mapInArrow(_vectors, "doc_id long, vector binary").join(sample, "doc_id")
    # Ids may repeat in the documents: one text for each, so no more rows than sampled ids.
    one = rows.groupBy("doc_id").agg(F.min(F.struct("vector", "label", "weight")).alias("row"))
    found = one.select("doc_id", "row.*").orderBy("doc_id").toPandas()
    x = np.frombuffer(b"".join(found["vector"]), dtype=np.float32).reshape(-1, SIZE)
    _, axes = np.linalg.eigh((x.T @ x).astype(np.float64))
    axes = np.ascontiguousarray(axes[:, ::-1][:, :RANK], dtype=np.float32)
    latent = x @ axes
    norm = np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-6)
    return Model(axes, np.ascontiguousarray((latent / norm).T), found["label"].to_numpy(np.float64), found["weight"].to_numpy(np.float64))


def _scores(batches, model):
    for batch in slices(batches):
        rows = np.stack([vector(text) for text in batch.column("text").to_pylist()])
        scores = pa.array(model.value.score(rows), pa.float64())
        keep = [k for k, name in enumerate(batch.schema.names) if name != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in keep), scores], [*(batch.schema.names[k] for k in keep), "score"]
        )


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score and predicted (1: score of THRESHOLD or more) of every row's whole text.

    Every row is compared with every labelled vector, in blocks. Labels, lang, source and doc_id are no inputs.
    Null, empty and wordless texts resemble nothing and get the labels' own share of 1. A null doc_id stays null and
    is not held out; repeated rows each give a row; further columns are ignored; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))
    scored = documents_of(docs).mapInArrow(lambda b: _scores(b, model), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _accepted(batches, model):
    for batch in slices(batches):
        rows = np.stack([vector(text or "") for text in batch.column("text").to_pylist()])
        yield batch.filter(pa.array(model.value.score(rows) >= THRESHOLD))


def accepted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of ``docs`` that ``classify`` predicts as 1, with all their columns; no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))
    return docs.mapInArrow(lambda b: _accepted(b, model), docs.schema)

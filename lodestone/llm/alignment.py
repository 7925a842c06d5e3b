"""Alignment of two tokenizers over a corpus: which tokens of one cover the bytes of which tokens of the other.

Both tokenizers split a text, led by a space, into intervals of its bytes. Neither lets a token run from a character
that is no white space into a following space, so a text is cut there and each different word of a task is encoded and
aligned once, by DuckDB inside the task: an ASOF join finds for each token of A the token of B that holds its first byte,
a range join the tokens of B that begin inside it, and sums over windows number the groups between common ends.
Documents then sum what their words have. Counts of id pairs are added up in the task and merged by Spark.
"""

from __future__ import annotations

import functools
import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, join_hot, materialize, slices
from .encoding import VOCABULARY, _encoder

PIECES = "piece_bpe_32k.model"
#: Words that a task remembers, and their characters: beyond either, it forgets them all and goes on.
WORDS, CHARACTERS = 600_000, 16 << 20
#: Tokens that one round of joins aligns; a longer word is cut where tokens of both end.
ROUND = 1 << 17
#: Different id pairs whose counts a task holds before it hands them on, and pairs in one row of them.
HELD, IN_ROW = 1 << 20, 1 << 14
#: Id pairs that more than one in so many rows hold are broadcast: fewer than this many, 24 bytes each.
SHARE = 1 << 17
SHIFT = 32

SCHEMA = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string,"
    " pairs array<long>, times array<long>"
)
_TYPES = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(pa.int64())] * 2
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: Both tokenizers begin a new token at a space after such a character.
_CUT = re.compile(r"(?<=\S) ")

_TABLES = """
CREATE TABLE words (word INT, n_a INT, n_b INT, n_groups INT, n_links INT);
CREATE TABLE links (word INT, pair BIGINT, times INT);
CREATE TABLE counted (pair BIGINT, docs BIGINT);
"""
_OVERLAPS = f"""
CREATE OR REPLACE TEMP TABLE met AS
SELECT a.word, (a.id::BIGINT << {SHIFT}) + b.id AS pair FROM a ASOF JOIN b ON a.s >= b.s
UNION ALL
SELECT a.word, (a.id::BIGINT << {SHIFT}) + b.id FROM a JOIN b ON b.s > a.s AND b.s < a.e
"""
#: Groups are numbered by the common ends before a token; the numbers of both sides agree, and run through each word.
_GROUPS = """
CREATE OR REPLACE TEMP TABLE ends AS SELECT e FROM a JOIN b USING (e);
CREATE OR REPLACE TEMP TABLE numbered AS
SELECT word, 0 AS side, id, s, (coalesce(sum(cut) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS g
FROM (SELECT a.*, (ends.e IS NOT NULL)::INT AS cut FROM a LEFT JOIN ends USING (e))
UNION ALL
SELECT word, 1, id, s, (coalesce(sum(cut) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT
FROM (SELECT b.*, (ends.e IS NOT NULL)::INT AS cut FROM b LEFT JOIN ends USING (e));
"""
_REMEMBER = """
INSERT INTO words
SELECT word, n_a, n_b, n_groups, n_links
FROM (
  SELECT word, count(*) FILTER (side = 0) AS n_a, count(*) FILTER (side = 1) AS n_b, max(g) - min(g) + 1 AS n_groups
  FROM numbered GROUP BY word) JOIN (SELECT word, count(*) AS n_links FROM met GROUP BY word) USING (word);
INSERT INTO links SELECT word, pair, count(*) FROM met GROUP BY word, pair;
"""
_TOTALS = """
SELECT doc, sum(k * n_a)::BIGINT, sum(k * n_b)::BIGINT, sum(k * n_groups)::BIGINT, sum(k * n_links)::BIGINT
FROM used JOIN words USING (word) GROUP BY doc
"""
_PAIRS = """
CREATE OR REPLACE TEMP TABLE linked AS
SELECT doc, pair, sum(k * times)::BIGINT AS times FROM used JOIN links USING (word) GROUP BY doc, pair
"""


@functools.cache
def _tokenizers(vocabulary: str, pieces: str):
    """Both encoders, and the bytes of their tokens by id."""
    import public_tokenizers
    import sentencepiece

    a, b = _encoder(vocabulary), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces))
    names = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    if any(re.search("[^▁]▁", name) for name in names):
        raise ValueError(f"{pieces} has pieces that run into a space; its texts cannot be cut at spaces")
    of_b = [bytes([int(x[3:5], 16)]) if b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
    of_a = [b""] * a.n_vocab
    for token in a.token_byte_values():
        of_a[a.encode_single_token(token)] = token
    return a, b, of_a, of_b


class Aligner:
    """Aligns words and remembers them, in DuckDB's memory and in ``ids``: the groups of each word, null where the bytes
    of the two tokenizers differ."""

    def __init__(self, vocabulary: str, pieces: str, memory: str):
        import duckdb

        self.a, self.b, self.of_a, self.of_b = _tokenizers(vocabulary, pieces)
        self.length = [np.array([len(t) for t in tokens], dtype=np.int64) for tokens in (self.of_a, self.of_b)]
        self.lone = self.b.piece_to_id("▁")
        self.sql = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": memory, "temp_directory": ""})
        self.sql.execute(_TABLES)
        self.known: dict[str, int] = {}
        self.ids: list[str | None] = []
        self.characters = 0

    def forget(self) -> None:
        if len(self.ids) > WORDS or self.characters > CHARACTERS:
            self.sql.execute("TRUNCATE words; TRUNCATE links")
            self.known, self.ids, self.characters = {}, [], 0

    def learn(self, words: list[str]) -> None:
        """Encode and align ``words``, none of them known yet."""
        first = len(self.ids)
        self.known.update(zip(words, range(first, first + len(words)), strict=True))
        self.characters += sum(map(len, words))
        self.ids += [""] * len(words)
        lists_a = [self.a.encode_ordinary(" " + word) for word in words]
        lists_b = [ids or [self.lone] for ids in self.b.encode(words, num_threads=1)]
        if not self._same(words, lists_a, lists_b):
            for k, word in enumerate(words):
                if not self._same([word], [lists_a[k]], [lists_b[k]]):
                    self.ids[first + k], lists_a[k], lists_b[k] = None, [], []
        parts: list[tuple[int, list[int], list[int]]] = []
        size = 0
        for word, (whole_a, whole_b) in enumerate(zip(lists_a, lists_b, strict=True), first):
            for a, b in self._parts(whole_a, whole_b):
                if size and size + len(a) + len(b) > ROUND:
                    self._align(parts)
                    parts, size = [], 0
                parts.append((word, a, b))
                size += len(a) + len(b)
        if size:
            self._align(parts)

    def _same(self, words: list[str], lists_a: list[list[int]], lists_b: list[list[int]]) -> bool:
        """Whether the tokens of both join to the words' bytes."""
        whole = "".join([" " + word for word in words]).encode()
        return all(
            b"".join(map(of.__getitem__, chain.from_iterable(lists))) == whole for of, lists in ((self.of_a, lists_a), (self.of_b, lists_b))
        )

    def _parts(self, a: list[int], b: list[int]):
        """A word's ids, cut at common ends where they are too many for one round."""
        if len(a) + len(b) <= ROUND:
            yield a, b
            return
        ends_a, ends_b = np.cumsum(self.length[0][a]), np.cumsum(self.length[1][b])
        _, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        i = j = 0
        for x, y in zip((at_a + 1).tolist(), (at_b + 1).tolist(), strict=True):
            if x - i + y - j >= ROUND // 2 or x == len(a):
                yield a[i:x], b[j:y]
                i, j = x, y

    def _align(self, parts: list[tuple[int, list[int], list[int]]]) -> None:
        for name, k in (("a", 0), ("b", 1)):
            ids = np.fromiter(chain.from_iterable([p[k + 1] for p in parts]), dtype=np.int32)
            ends = np.cumsum(self.length[k][ids])
            words = np.repeat(np.array([p[0] for p in parts], dtype=np.int32), [len(p[k + 1]) for p in parts])
            self.sql.register("given", pa.table({"word": words, "id": ids, "s": ends - self.length[k][ids], "e": ends}))
            self.sql.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
        for step in (_OVERLAPS, _GROUPS, _REMEMBER):
            self.sql.execute(step)
        self._write_groups()

    def _write_groups(self) -> None:
        """The numbered ids of a round as text, word by word."""
        found = self.sql.sql("SELECT word, side, id, g FROM numbered ORDER BY g, side, s").to_arrow_table()
        word, side, ids, g = (found[c].to_numpy() for c in ("word", "side", "id", "g"))
        begins = np.flatnonzero(np.diff(word, prepend=-1))
        opens = np.diff(2 * g + side, prepend=-1) != 0
        mark = np.where(opens, np.where(side == 0, 1, 2), 0)
        mark[begins] = 3
        lead = [",", ";", "|", ""]
        tokens = [lead[m] + str(i) for m, i in zip(mark.tolist(), ids.tolist(), strict=True)]
        for w, start, stop in zip(word[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(tokens)], strict=True):
            text = "".join(tokens[start:stop])
            self.ids[w] = f"{self.ids[w]};{text}" if self.ids[w] else text

    def documents(self, texts: list[str]) -> tuple[list[str], np.ndarray, pa.Array, pa.Array]:
        """Of each text: its groups as text (none where it is empty or the tokenizers' bytes differ), its totals (n_a, n_b,
        n_groups, n_links), its id pairs and how often it holds each."""
        self.forget()
        split = [_CUT.split(text) if text else [] for text in texts]
        self.learn([word for word in set().union(*split) if word not in self.known])
        sizes = np.array([len(words) for words in split])
        numbers = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=sizes.sum())
        del split
        place = np.repeat(np.arange(len(texts)), sizes)
        lost = np.zeros(len(texts), dtype=bool)
        if None in self.ids:
            bad = np.array([ids is None for ids in self.ids])
            lost[place[bad[numbers]]] = True
        groups = []
        for k, stop in enumerate(np.cumsum(sizes).tolist()):
            groups.append("" if lost[k] else ";".join(map(self.ids.__getitem__, numbers[stop - sizes[k] : stop].tolist())))
        held, times = np.unique((place << 32 | numbers)[~lost[place]], return_counts=True)
        used = {"doc": (held >> 32).astype(np.int32), "word": held.astype(np.int32), "k": times.astype(np.int32)}
        self.sql.register("given", pa.table(used))
        self.sql.execute("CREATE OR REPLACE TEMP TABLE used AS SELECT * FROM given")
        totals = np.zeros((len(texts), 4), dtype=np.int64)
        for doc, *found in self.sql.execute(_TOTALS).fetchall():
            totals[doc] = found
        self.sql.execute(_PAIRS)
        self.sql.execute("INSERT INTO counted SELECT pair, count(*) FROM linked GROUP BY pair")
        linked = self.sql.sql("SELECT doc, pair, times FROM linked ORDER BY doc, pair").to_arrow_table().combine_chunks()
        ends = np.searchsorted(linked["doc"].to_numpy(), np.arange(len(texts) + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), linked[c].combine_chunks()) for c in ("pair", "times")]
        return groups, totals, *lists

    def _held(self) -> int:
        return self.sql.execute("SELECT count(*) FROM counted").fetchall()[0][0]

    def counts(self, last: bool):
        """Rows of what documents so far hold each pair, once there are many of them or at the end."""
        if not last and self._held() < 2 * HELD:
            return
        self.sql.execute("CREATE OR REPLACE TABLE counted AS SELECT pair, sum(docs)::BIGINT AS docs FROM counted GROUP BY pair")
        if not last and self._held() < HELD:
            return
        for batch in self.sql.sql("SELECT pair, docs FROM counted ORDER BY pair").to_arrow_table().to_batches(IN_ROW):
            lists = [pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), batch.column(c)) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, t) for t in _TYPES[:-2]] + lists, _NAMES)
        self.sql.execute("TRUNCATE counted")


def _aligned(batches, vocabulary: str, pieces: str, memory: str, texts: bool):
    aligner = Aligner(vocabulary, pieces, memory)
    row = TaskContext.get().partitionId() << 40
    for batch in slices(batches, size=1 << 20):
        groups, totals, pairs, times = aligner.documents(batch.column("text").to_pylist())
        columns = [
            pa.array(range(row, row + len(batch)), pa.int64()), batch.column("doc_id"), *(pa.array(totals[:, k]) for k in range(4)),
            pa.array(groups, pa.string()) if texts else pa.nulls(len(batch), pa.string()),
            pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], pa.string()), pairs, times,
        ]
        row += len(batch)
        yield pa.RecordBatch.from_arrays(columns, _NAMES)
        yield from aligner.counts(last=False)
    yield from aligner.counts(last=True)


class Alignment:
    """The alignment of ``docs`` under both tokenizers, written once to the shared folder.

    A row of ``docs`` is a document, also where rows repeat or share a doc_id; a null doc_id stays null and further columns
    are ignored. A text that is null or empty, or whose tokens of either side do not join to its own bytes, has no tokens.
    ``texts`` keeps the groups themselves, some ten times the text. A task holds the words it has met, up to ``WORDS`` of
    them, the counts of up to 2 x ``HELD`` pairs, and a MB of texts at a time; ``memory`` bounds its DuckDB.
    """

    def __init__(self, docs: DataFrame, vocabulary: str = VOCABULARY, pieces: str = PIECES, texts: bool = False, memory: str = "400MB"):
        made = documents_of(docs).mapInArrow(lambda batches: _aligned(batches, vocabulary, pieces, memory, texts), SCHEMA)
        self.written = materialize(made, "aligned")
        self.documents = self.written.where(F.col("row").isNotNull())

    def groups(self) -> DataFrame:
        """doc_id and groups, as text: the ids of A and of B between common ends, `a1,a2|b1;a3|b2,b3`; only with ``texts``."""
        return self.documents.select("doc_id", "groups")

    def pair_counts(self) -> DataFrame:
        """a, b, docs: how many documents hold ids a and b linked, that is, with bytes in common; best: no b has more with a."""
        parts = self.written.where(F.col("row").isNull()).select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
        counts = parts.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("docs"))
        counts = materialize(counts.withColumn("a", F.shiftright("pair", SHIFT).cast("int")), "pair-counts")
        most = counts.groupBy("a").agg(F.max("docs").alias("most"))  # as many rows as A has ids at most
        counts = counts.join(F.broadcast(most), "a")
        return counts.select("a", F.col("pair").bitwiseAND((1 << SHIFT) - 1).cast("int").alias("b"), "docs", (F.col("docs") == F.col("most")).alias("best"))

    def scores(self) -> DataFrame:
        """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

        The pairs of all documents meet the counts of the corpus: those of the most frequent pairs, of which there are
        fewer than ``SHARE``, are broadcast, and only rows of rarer pairs are shuffled.
        """
        facts = materialize(self.pair_counts().select((F.shiftleft(F.col("a").cast("long"), SHIFT) + F.col("b")).alias("pair"), "docs", "best"), "pair-facts")
        rows = self.documents.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
        met = join_hot(rows, facts.select("pair", "best", "docs", F.col("docs").alias("held")), "pair", "held", SHARE)
        sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
        found = self.documents.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row", "left")
        zero = F.lit(0).cast("long")
        return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


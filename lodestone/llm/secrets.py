"""Secret scan with corpus-wide ownership: who else holds a candidate tells examples from live credentials."""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents_of, fresh, join_hot, materialize, slices

# The base kinds in their listed order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
LEAST_ASSIGN = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

# Shapes of further credentials, looked for only where their cheap mark occurs. A match starts at the edge
# of a run of its characters and gives nothing back, so the time is linear in the text.
SHAPES = (
    ("github", "gh", re.compile(r"(?<![A-Za-z0-9])gh[opsur]_[A-Za-z0-9]{36,}")),
    ("google", "AIza", re.compile(r"AIza[0-9A-Za-z_-]{35}")),
    ("jwt", "eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}")),
    ("pem", "-----BEGIN", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?")),
    ("slack", "xox", re.compile(r"xox[abeoprs]-[A-Za-z0-9-]{10,}")),
    ("stripe", "_live_", re.compile(r"(?<![A-Za-z0-9])[rs]k_live_[0-9A-Za-z]{16,}")),
    ("url", "://", re.compile(r"://[^\s:/@]{1,64}:([^\s:/@]{6,64})@")),
)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}")

#: Bits of entropy a character from which a run of letters and digits can be a credential.
LEAST_ENTROPY = 3.0
#: A candidate that more owners than this hold is a copied example; so is one in more repositories of one owner.
MOST_OWNERS, MOST_REPOSITORIES = 2, 50

_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("digest", pa.string()), ("base", pa.bool_())])
_SCAN = (
    "doc_id long, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string,"
    " found array<struct<kind string, start long, end long, digest string, base boolean>>"
)


def entropy(value: str) -> float:
    """Bits a character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, place of the kind, end, secret value) of every base match, in order."""
    found = [
        (m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN
    ]  # a match whose value is too short still takes its text
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def further_spans(text: str, taken: list[tuple[int, int]]) -> list[tuple[str, int, int, str]]:
    """Candidates of other shapes that overlap no span in ``taken`` and none found before: (kind, start, end, value)."""
    found = []
    starts: list[int] = []  # of disjoint stretches, in order, and their ends
    ends: list[int] = []
    for start, end in sorted(taken):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)

    def add(kind: str, start: int, end: int, value: str) -> None:
        k = bisect.bisect_right(ends, start)
        if k == len(starts) or end <= starts[k]:
            starts.insert(k, start)
            ends.insert(k, end)
            found.append((kind, start, end, value))

    for kind, mark, pattern in SHAPES:
        if mark in text:
            for m in pattern.finditer(text):
                add(kind, m.start(), m.end(), m[1] if pattern.groups else m[0])
    for m in OPAQUE.finditer(text):
        kinds = (re.search(p, m[0]) for p in ("[0-9]", "[A-Za-z]"))
        if all(kinds) and entropy(m[0]) >= LEAST_ENTROPY:
            add("opaque", m.start(), m.end(), m[0])
    return found


def _scan(batches):
    for batch in slices(batches):
        rows = []
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            count = Counter(k for _, k, _, _ in base)
            listed = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in base)
            spans = [(KINDS[k], a, b, v, True) for a, k, b, v in base]
            spans += [(*s, False) for s in further_spans(text, [(a, b) for a, _, b, _ in base])]
            found = [
                {"kind": k, "start": a, "end": b, "base": own, "digest": hashlib.sha256(v.encode()).hexdigest()}
                for k, a, b, v, own in spans
            ]
            rows.append((count[0], count[1], count[2], hashlib.sha256(listed.encode()).hexdigest(), found))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        types = [pa.int64()] * 3 + [pa.string(), pa.list_(_SPAN)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("owner"), batch.column("repository")]
            + [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)],
            ["doc_id", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "found"],
        )


def ownership(candidates: DataFrame) -> DataFrame:
    """digest, n_repositories, n_owners of candidates(digest, owner, repository).

    Three grouped steps, each with map-side sums: a value that very many documents hold is no hot task.
    """
    once = candidates.groupBy("digest", "owner", "repository").agg(F.count("*").alias("spans"))
    by_owner = once.groupBy("digest", "owner").agg(F.count("*").alias("repositories"), F.sum("spans").alias("spans"))
    return by_owner.groupBy("digest").agg(
        F.sum("repositories").alias("n_repositories"), F.count("*").alias("n_owners"),
        F.max("repositories").alias("most_repositories"), F.sum("spans").alias("n_spans"),
    )


def _scanned(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """What every row holds, written once: the scan is not run again for each use."""
    extra = [owner] if repository == "doc_id" else [owner, repository]
    texts = documents_of(docs, *extra).select(
        "doc_id", "text", F.col(owner).alias("owner"), F.col(repository).cast("string").alias("repository")
    )
    return materialize(texts.mapInArrow(_scan, _SCAN).withColumn("row", F.monotonically_increasing_id()), "secrets")


def _spans(scanned: DataFrame) -> DataFrame:
    owner, repository = (F.coalesce(c, F.lit("")).alias(c) for c in ("owner", "repository"))
    found = scanned.where(F.size("found") > 0).select("row", owner, repository, F.explode("found").alias("span"))
    return found.select("row", "owner", "repository", "span.*")


def _verdicts(spans: DataFrame) -> DataFrame:
    live = (F.col("n_owners") <= MOST_OWNERS) & (F.col("most_repositories") <= MOST_REPOSITORIES)
    return materialize(ownership(spans).select("digest", live.alias("live"), "n_spans"), "secrets-verdicts")


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Secrets of every whole text. One row for each input row; base spans always stay, and candidates of further
    shapes are added where the corpus shows them to be owner-specific.

    A candidate's value is hashed and counted over the whole corpus: the distinct owners (column ``owner``) and
    repositories (column ``repository``; in ``documents``, where each row stands for one, its doc_id) that hold it. At
    most MOST_OWNERS owners and MOST_REPOSITORIES repositories of one owner: live-looking. More: a widely copied
    example. n_live and n_example count a row's candidates of either sort, base ones included. Digests, never values,
    leave the scan.

    Null and empty texts have no spans; null owners count as one owner; a null doc_id stays null; repeated rows each
    give a row (and are one repository). Offsets are code points, ends exclusive. Further columns are ignored. An
    empty table gives no rows.
    """
    scanned = _scanned(docs, owner, repository)
    spans = _spans(scanned)
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)], F.lit(len(KINDS)))
    judged = join_hot(spans, _verdicts(spans), "digest", "n_spans").groupBy("row").agg(
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example"),
        F.sort_array(
            F.collect_list(F.when(F.col("base") | F.col("live"), F.struct("start", rank.alias("rank"), "kind", "end")))
        ).alias("listed"),
    )
    one = F.transform("listed", lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string")))
    judged = judged.select("row", "n_live", "n_example", F.array_join(one, ",").alias("spans"))
    return scanned.join(judged, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"),
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_live", "n_example")],
    )


def _masked(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    """Overlapping spans are one."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:]


_CUT = T.ArrayType(
    T.StructType().add("start", T.LongType()).add("stop", T.LongType()).add("base", T.BooleanType()).add("digest", T.StringType())
)
_CUT_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_()), ("digest", pa.string())]))


def _found(batches, name: str):
    """The rows with what they hold: base spans, which need no verdict, and candidates of further shapes."""
    for batch in slices(batches):
        found = []
        for text in batch.column("text").to_pylist():
            base = base_spans(text or "")
            spans = [(a, b, v, True) for a, _, b, v in base]
            spans += [(a, b, v, False) for _, a, b, v in further_spans(text or "", [(a, b) for a, _, b, _ in base])]
            found.append([{"start": a, "stop": b, "base": own, "digest": hashlib.sha256(v.encode()).hexdigest()} for a, b, v, own in spans])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _CUT_ARROW)], [*batch.schema.names, name])


def _mask(batches, name: str, mask: str):
    for batch in slices(batches):
        texts = [
            _masked(text, [(s["start"], s["stop"]) for s in spans], mask) if spans else text
            for text, spans in zip(batch.column("text").to_pylist(), batch.column(name).to_pylist(), strict=True)
        ]
        k = batch.schema.get_field_index("text")
        yield batch.set_column(k, pa.field("text", pa.string()), pa.array(texts, pa.string())).drop_columns([name])


def redact(docs: DataFrame, owner: str = "source", repository: str = "doc_id", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span that ``scan`` lists replaced by ``mask``: the same rows, columns and order of columns.

    Every text is scanned once and written with its spans. Only rows with candidates of further shapes are shuffled
    then, to meet the verdicts on them; all others are masked where they are read. Null and empty texts, null ids,
    repeated rows and further columns, whatever their names, pass through unchanged; an empty table gives no rows.
    """
    row, name, kept = fresh(docs, "__row", "__spans", "__kept")
    wider = T.StructType([*docs.schema.fields, T.StructField(name, _CUT)])
    held = docs.mapInArrow(lambda b: _found(b, name), wider).withColumn(row, F.monotonically_increasing_id())
    held = materialize(held, "secrets-held")
    waits = F.exists(name, lambda s: ~s.base)
    found = held.where(F.size(name) > 0).select(
        F.col(row).alias("row"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"), F.explode(name).alias("span"),
    )
    found = found.select("row", "owner", "repository", "span.*")
    live = join_hot(found, _verdicts(found), "digest", "n_spans").where("live and not base")
    live = live.groupBy(F.col("row").alias(row)).agg(F.collect_set("digest").alias(kept))
    plain = held.where(~waits).drop(row)
    open_ = held.where(waits).join(live, row, "left").withColumn(kept, F.coalesce(kept, F.array().cast("array<string>")))
    cut = F.filter(name, lambda s: s.base | F.array_contains(kept, s.digest))
    spans = plain.unionByName(open_.withColumn(name, cut).drop(row, kept))
    return spans.mapInArrow(lambda b: _mask(b, name, mask), docs.schema).select(docs.columns)

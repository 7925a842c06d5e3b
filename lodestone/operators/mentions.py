"""Links between prose and code: which passages mention which entities, by an unambiguous written form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename
from ..functions.vocabulary import GENERIC_NAMES

MOST_PER_PASSAGE, MOST_SHARE, LEAST_CEILING = 8, 0.2, 3
LEAST_FORM = 4


def forms(nodes: DataFrame) -> DataFrame:
    """The forms by which each internal entity can be mentioned, those of exactly one entity alone.

    A file node has its path, its last two segments and its name; others their bare label. ``fenced_only``: too plain a
    word to count outside back-ticks. ``head``: the first word of the form, by which passages are met.
    """
    base = basename("path")
    is_file = F.col("path").isNotNull() & (F.col("label") == base)
    bare = F.regexp_replace(F.regexp_replace("label", r"\(\)$", ""), r"^\.", "")
    one = lambda text, kind: F.struct(text.alias("text"), F.lit(kind).alias("kind"))
    parts = F.split("path", "/")
    tail = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, -2, 2), "/"))
    all_ = F.when(is_file, F.array(one(F.col("path"), "path"), one(tail, "path"), one(base, "file"))).otherwise(F.array(one(bare, "identifier")))
    said = nodes.where("kind <> 'external'").select("corpus", "id", F.explode(all_).alias("f")).select("corpus", "id", "f.*")
    said = said.where(F.length("text") >= LEAST_FORM).withColumn("key", F.lower("text"))
    by = said.groupBy("corpus", "key").agg(
        F.min("id").alias("id"), F.max("id").alias("last"), F.min_by(F.struct("text", "kind"), F.struct("id", "kind")).alias("f")
    )
    by = by.where("id = last").select("corpus", "key", "id", "f.text", "f.kind")
    plain = (F.col("kind") == "identifier") & F.col("key").isin(GENERIC_NAMES)
    distinct = F.col("text").rlike("[a-z][A-Z]") | F.col("text").rlike("[_.]") | (F.length("text") >= 9)
    by = by.where(~plain).withColumn("fenced_only", (F.col("kind") == "identifier") & ~distinct)
    return by.withColumn("head", F.regexp_extract("key", r"\w+", 0)).where("head <> ''")


def candidates(found: DataFrame, passages: DataFrame) -> DataFrame:
    """Passages in which a form occurs as a whole word: an equi-join on the form's first word, then the exact test.

    at is the first occurrence of the form anywhere in the passage, start that of the form as a word, from 0.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\w+"), 0))
    # A form may start inside a run of word characters only after a dot, which the word test rules out anyway. Only the
    # words meet the forms; the text of a passage comes to its hits afterwards.
    met = passages.select("corpus", "pid", F.explode(words).alias("head"))
    met = met.join(found.select("corpus", "head", "key", "id", "kind", "fenced_only"), ["corpus", "head"])
    met = met.join(passages.select("corpus", "pid", F.col("text").alias("body")), ["corpus", "pid"])
    met = met.withColumn("at", F.position(F.col("key"), F.lower("body")) - 1).where("at >= 0")
    quoted = F.concat(F.lit(r"(?i)(?<![\w.])\Q"), F.col("key"), F.lit(r"\E(?!\w)"))
    start = F.regexp_instr("body", quoted) - 1
    met = met.withColumn("start", start).where("start >= 0").withColumn("stop", F.col("start") + F.length("key"))
    before, rest = F.substring(F.col("body"), F.col("start"), F.lit(1)), F.substring(F.col("body"), F.col("stop") + 1, F.lit(3))
    fenced = (F.col("start") > 0) & (before == "`") & rest.rlike(r"^(\(\))?`")
    met = met.withColumn("fenced", fenced).where(~F.col("fenced_only") | F.col("fenced"))
    confidence = F.when(F.col("fenced") | (F.col("kind") == "path"), "high").when(F.col("kind") == "file", "medium").otherwise("low")
    matched = F.substring(F.col("body"), F.col("start") + 1, F.length("key"))
    return met.select("corpus", "pid", "id", "key", "kind", "at", "start", "stop", confidence.alias("confidence"), matched.alias("matched"))


def longest_first(found: DataFrame, most: int = MOST_PER_PASSAGE) -> DataFrame:
    """Each passage's candidates taken longest first, none that begins inside one already taken, at most ``most``.

    A fold over the candidates of one passage, in Spark's own array functions.
    """
    rest = [c for c in found.columns if c not in ("corpus", "pid")]
    row = F.struct((-F.length("key")).alias("order"), *rest)
    by = found.groupBy("corpus", "pid").agg(F.sort_array(F.collect_list(row)).alias("all"))
    element = by.schema["all"].dataType.simpleString()

    def take(done, x):
        free = (F.size(done) < most) & ~F.exists(done, lambda y: (x.at >= y.start) & (x.at < y.stop))
        return F.when(free, F.concat(done, F.array(x))).otherwise(done)

    kept = F.aggregate("all", F.array().cast(element), take)
    return by.select("corpus", "pid", F.explode(kept).alias("hit")).select("corpus", "pid", *[f"hit.{c}" for c in rest])


def under_ceiling(hits: DataFrame, passages: DataFrame, share: float = MOST_SHARE) -> DataFrame:
    """Without the forms that too many passages mention: a name that is everywhere says nothing."""
    n = passages.groupBy("corpus").agg(F.count("*").alias("n"))
    df = hits.groupBy("corpus", "key").agg(F.count("*").alias("df"))
    most = F.greatest(F.lit(LEAST_CEILING), F.floor(F.col("n") * share))
    rare = df.join(F.broadcast(n), "corpus").where(F.col("df") <= most).select("corpus", "key")
    return hits.join(rare, ["corpus", "key"], "left_semi")


def mentions(nodes: DataFrame, passages: DataFrame, most: int = MOST_PER_PASSAGE, share: float = MOST_SHARE) -> DataFrame:
    """(corpus, pid, id, key, kind, confidence, matched) for nodes and passages(corpus, pid, text) of one corpus name."""
    hits = longest_first(candidates(forms(nodes), passages), most)
    return under_ceiling(hits, passages, share).select("corpus", "pid", "id", "key", "kind", "confidence", "matched")


def _pair():
    return F.to_json(F.struct("code", "docs"))


def linked(nodes: DataFrame, passages: DataFrame, pairs: DataFrame, most: int = MOST_PER_PASSAGE, share: float = MOST_SHARE) -> DataFrame:
    """Mentions between corpora held side by side: (code, docs, pid, id, key, kind, confidence, matched) for each of
    ``pairs`` (code, docs) of corpus names.

    The entities of one corpus meet the passages of the other. Whether a form is one entity's alone, and whether too many
    passages have it, is judged within the pair: what another corpus holds does not matter. Repeated pairs count once; a pair
    of which one side holds nothing has no mention (``unlinkable`` tells which).
    """
    pairs = pairs.select("code", "docs").distinct().withColumn("corpus_pair", _pair())
    own = nodes.join(F.broadcast(pairs.select(F.col("code").alias("corpus"), "corpus_pair")), "corpus").drop("corpus").withColumnRenamed("corpus_pair", "corpus")
    said = passages.join(F.broadcast(pairs.select(F.col("docs").alias("corpus"), "corpus_pair")), "corpus").drop("corpus").withColumnRenamed("corpus_pair", "corpus")
    found = mentions(own, said, most, share).withColumnRenamed("corpus", "corpus_pair")
    return found.join(F.broadcast(pairs), "corpus_pair").select("code", "docs", "pid", "id", "key", "kind", "confidence", "matched")


def unlinkable(nodes: DataFrame, passages: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (code, docs) that cannot be linked, and why: a side without entities of its own, or without passages."""
    code = nodes.where("kind <> 'external'").select(F.col("corpus").alias("code")).distinct().withColumn("has_code", F.lit(True))
    docs = passages.select(F.col("corpus").alias("docs")).distinct().withColumn("has_docs", F.lit(True))
    out = pairs.select("code", "docs").distinct().join(code, "code", "left").join(docs, "docs", "left")
    why = F.when(F.col("has_code").isNull(), "no entities").when(F.col("has_docs").isNull(), "no passages")
    return out.select("code", "docs", why.alias("why")).where("why is not null")


#: From the surest to the least sure.
CONFIDENCES = ("high", "medium", "low")


def _unsure(confidence="confidence"):
    return F.array_position(F.array(*map(F.lit, CONFIDENCES)), F.col(confidence))


def by_node(found: DataFrame) -> DataFrame:
    """For each entity the number of passages that mention it, the surest confidence of a mention, and the first passage."""
    return found.groupBy("corpus", "id").agg(F.count("*").alias("passages"), F.min_by("confidence", _unsure()).alias("confidence"), F.min("pid").alias("first_pid"))


def ranked_for_panel(found: DataFrame, n: int = 8) -> DataFrame:
    """The first mentions of each entity, the surest first."""
    w = Window.partitionBy("corpus", "id").orderBy(_unsure(), "pid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)

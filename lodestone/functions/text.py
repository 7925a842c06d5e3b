"""Scalar functions over paths, labels and prose, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import STOP_WORDS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sanitise(c) -> Column:
    """An id part: lower case, other runs than letters and digits one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def slug(c) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.substring(plain, 1, 60)


def strip_ext(c) -> Column:
    return F.regexp_replace(_col(c), r"\.[^./]+$", "")


def extension(c) -> Column:
    return F.regexp_extract(_col(c), r"\.[^./]*$", 0)


def basename(c) -> Column:
    return F.substring_index(_col(c), "/", -1)


def ancestors(c) -> Column:
    """The folders above a path, outermost first."""
    parts = F.split(_col(c), "/")
    n = F.size(parts)
    above = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.when(n > 1, above).otherwise(F.array().cast("array<string>"))


def line_of(c) -> Column:
    """The number in a location such as L12; null for others."""
    return F.nullif(F.regexp_extract(_col(c), r"^L(\d+)$", 1), F.lit("")).cast("int")


def tokens(c) -> Column:
    """Search terms of a text: words and dotted or dashed identifiers, each of the latter followed by its parts."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    words = F.regexp_extract_all(F.lower(_col(c)), F.lit("[a-z0-9][a-z0-9_.-]*"), 0)
    words = F.transform(words, lambda w: F.regexp_replace(w, "^[._-]+|[._-]+$", ""))

    def kept(w: Column) -> Column:
        return (F.length(w) > 1) & ~F.array_contains(stop, w)

    def parts(w: Column) -> Column:
        split = F.filter(F.split(w, "[._-]+"), kept)
        return F.when(w.rlike("[._-]"), F.concat(F.array(w), split)).otherwise(F.array(w))

    return F.flatten(F.transform(F.filter(words, kept), parts))


def match_score(text, term) -> Column:
    """How well ``term`` (lower case) is found in a text: equal, at the start, at a word's start, anywhere; shorter
    texts first. Null where it is not found. The first occurrence counts."""
    text, term = _col(text), term if isinstance(term, Column) else F.lit(term)
    at = F.position(term, F.lower(text))
    before, here = F.substring(text, at - 1, F.lit(1)), F.substring(text, at, F.lit(1))
    boundary = (at > 1) & (
        before.rlike(r"^[/._ :-]$") | (before.rlike("^[a-z0-9]$") & here.rlike("^[A-Z]$"))
    )
    tier = F.when(F.lower(text) == term, 1000).when(at == 1, 700).when(boundary, 500).otherwise(200)
    return F.when((at > 0) & (F.length(term) > 0), tier + F.greatest(F.lit(0), 60 - F.length(text)))


def context(line, at, length: Column, width: int = 120, lead: int = 30) -> Column:
    """What stands before, in and after a match that starts at ``at`` (from 0): whole lines if short, else cut."""
    line, at = _col(line), _col(at)
    n = F.length(line)
    whole = n <= width
    start = F.when(whole, F.lit(0)).otherwise(F.greatest(F.lit(0), at - lead))
    end = F.when(whole, n).otherwise(F.least(n, at + length + width - lead))
    before = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(line, start + 1, at - start))
    after = F.concat(F.substring(line, at + length + 1, end - at - length), F.when(end < n, "…").otherwise(""))
    return F.struct(before.alias("before"), F.substring(line, at + 1, length).alias("match"), after.alias("after"))


def human_bytes(c) -> Column:
    n = _col(c)
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1048576, F.concat(F.round(n / 1024, 0).cast("long").cast("string"), F.lit(" KB")))
        .otherwise(F.format_string("%.1f MB", n / 1048576.0))
    )


def hue_rgb(c, saturation: float = 0.68, lightness: float = 0.62) -> Column:
    """A hue in degrees as a packed 24-bit colour."""
    h = _col(c).cast("double") % 360
    chroma = (1 - abs(2 * lightness - 1)) * saturation
    second = chroma * (1 - F.abs((h / 60) % 2 - 1))
    base = lightness - chroma / 2
    full, none = F.lit(chroma), F.lit(0.0)

    def channel(order: tuple[int, ...]) -> Column:
        values = [(full, second, none)[k] for k in order]
        out = values[5]
        for k in range(4, -1, -1):
            out = F.when(h < 60 * (k + 1), values[k]).otherwise(out)
        return F.round((out + base) * 255).cast("int")

    red, green, blue = channel((0, 1, 2, 2, 1, 0)), channel((1, 0, 0, 1, 2, 2)), channel((2, 2, 1, 0, 0, 1))
    return red * 65536 + green * 256 + blue


def escape_html(c) -> Column:
    out = _col(c)
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def relation_words(c) -> Column:
    return F.replace(_col(c), F.lit("_"), F.lit(" "))


def age(then, now) -> Column:
    """How long ago, in the largest whole unit."""
    s = F.unix_timestamp(_col(now)) - F.unix_timestamp(_col(then))
    return (
        F.when(s < 60, "just now")
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m ago")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit("d ago")))
    )

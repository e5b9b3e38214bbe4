"""Text and vector expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def char_ngrams(text: Column, n: int) -> Column:
    """Character n-grams after removal of white space; a shorter text is its own only gram."""
    bare = F.regexp_replace(text, r"(?U)\s", "")
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.length(bare) - n + 1, F.lit(1))), lambda i: F.substring(bare, i, F.lit(n)))
    return F.when(F.length(bare) <= n, F.array(bare)).otherwise(many)


def bucket(gram: Column, dim: int = 512) -> Column:
    return (F.conv(F.substring(F.md5(gram.cast("binary")), 30, 3), 16, 10).cast("int") % dim).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 if the lengths differ or a vector is zero."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / norm)


def verbatim(part: Column) -> Column:
    """A pattern that matches just this text, whatever signs it holds."""
    return F.concat(F.lit("\\Q"), F.replace(part, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def geometric_mean(values: list[Column], floor: float = 1e-3) -> Column:
    total = F.lit(0.0)
    for v in values:
        total = total + F.log(F.greatest(v, F.lit(floor)))
    return F.exp(total / len(values))


def entropy(counts: Column) -> Column:
    """Normalised: 0 without counts, one half for a single one, else the entropy over its maximum."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x.cast("double"))
    h = -F.aggregate(counts, F.lit(0.0), lambda a, x: a + F.when(x > 0, x / total * F.log2(x / total)).otherwise(F.lit(0.0)))
    return F.when(F.size(counts) == 0, F.lit(0.0)).when(F.size(counts) == 1, F.lit(0.5)).otherwise(h / F.log2(F.size(counts).cast("double")))


def segments(text: Column) -> Column:
    """Words as runs of letters and digits; each ideograph is a word of its own. Null has none."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"(\p{IsHan})", " $1 ")
    return F.regexp_extract_all(spaced, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def equative(text: Column, before: list[str], after: list[str], idle: list[str], most: int = 3) -> Column:
    """Marker and vehicle of a comparison, as ``marker vehicle`` or ``vehicle marker``; null if there is none.

    Markers that follow their vehicle are tried first, in order, then those that precede it, longest
    first; of each the first occurrence counts. The vehicle is up to two words directly before, or up to
    ``most`` words after, where idle words are skipped at the front and end it later. Markers, idle words: lower case.
    """
    low = F.lower(text)
    word = r"\p{L}+"
    none = "(?:" + "|".join(idle) + r")(?:[^\p{L}]+|$)" if idle else "(?:(?!))"
    tries = []
    for m in before:
        lead = F.substring_index(low, m, 1)
        v = F.regexp_extract(lead, rf"({word}(?: {word})?) ?$", 1)
        tries.append(F.when(low.contains(m) & (v != ""), F.concat(v, F.lit(" "), F.lit(m))))
    for m in sorted(after, key=len, reverse=True):
        rest = F.substring(low, F.instr(low, F.lit(m)) + F.lit(len(m)), F.length(low))
        v = F.regexp_extract(rest, rf"^[^\p{{L}}]*(?:{none})*({word}(?: (?!{none}){word}){{0,{most - 1}}})", 1)
        tries.append(F.when(low.contains(m) & (v != ""), F.concat(F.lit(m), F.lit(" "), v)))
    return F.coalesce(*tries)

"""Vectors as arrays of doubles, and boxes of four coordinates."""

from __future__ import annotations

import functools
import hashlib
import math
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The inner product; vectors of different lengths are an error."""
    same = F.when(F.size(a) == F.size(b), b).otherwise(F.when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("vectors of different lengths"))))
    return _product(a, same)


def _product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(_product(a, a))


def l2_normalized(a: Column) -> Column:
    """A unit vector; the zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def valid_vector(a: Column) -> Column:
    """Not empty, and all components finite."""
    return F.coalesce((F.size(a) > 0) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def encoded(a: Column) -> Column:
    """A vector literal with up to twelve significant digits."""
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: F.format_string("%.12g", x.cast("double"))), ","), F.lit("]"))


@functools.lru_cache(1 << 18)
def _hashed(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")


def hashing_embedding(tokens: Column, dimension: int = 64) -> Column:
    """Bag of words hashed by BLAKE2b to dimensions, 1 + ln(count) each, unit length; Arrow, because no builtin hashes so."""

    @F.pandas_udf("array<double>")
    def embed(batch):
        import pandas as pd

        def one(words):
            v = [0.0] * dimension
            for word, n in Counter(words if words is not None else []).items():
                v[_hashed(word) % dimension] += 1 + math.log(n)
            size = math.sqrt(sum(x * x for x in v))
            return [x / size for x in v] if size else v

        return pd.Series([one(w) for w in batch])

    return embed(tokens)


def union_box(box: Column) -> list[Column]:
    """Aggregates x0, y0, x1, y1 of the smallest box around all."""
    return [F.min(box[0]).alias("x0"), F.min(box[1]).alias("y0"), F.max(box[2]).alias("x1"), F.max(box[3]).alias("y1")]


def normalized_box(box: Column, width: Column, height: Column) -> Column:
    """Coordinates as shares of the page, clamped to 0..1 and rounded to six digits."""
    size = F.array(*(F.greatest(x.cast("double"), F.lit(1.0)) for x in (width, height, width, height)))
    return F.zip_with(box, size, lambda x, s: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / s)), 6))


def boxes_close(a: Column, b: Column, tolerance: float) -> Column:
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tolerance), lambda ok: ok)


def column_of(box: Column, width: Column) -> Column:
    """full, left or right: a block is full if it takes 68 % of the page or crosses its middle by 8 % on both sides."""
    middle, slack = width / 2, width * F.lit(0.08)
    wide = (box[2] - box[0] >= width * F.lit(0.68)) | ((box[0] < middle - slack) & (box[2] > middle + slack))
    return F.when(wide, "full").when(box[2] <= middle + slack, "left").when(box[0] >= middle - slack, "right").otherwise("full")


def heading(text: Column, size: Column, bold: Column, body_size: Column) -> Column:
    """Whether a block of up to 180 characters is numbered like a heading, or bold and 1.17 times the body size."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.length(flat).between(1, 180) & (flat.rlike(r"(?i)^(?:\d+(?:\.\d+)*|[IVX]+)\s*[.、:]?\s*\S+") | (bold & (size >= body_size * F.lit(1.17))))

"""Vectors as arrays, native columns with double arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return let(v, lambda x: F.sqrt(dot(x, x)))


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""

    def scaled(x):
        return let(F.sqrt(dot(x, x)), lambda size: F.transform(x, lambda e: F.when(size == 0, e.cast("double")).otherwise(e.cast("double") / size)))

    return let(v, scaled)


def cosine(a: Column, b: Column) -> Column:
    def of(p):
        return let(F.sqrt(dot(p.a, p.a)) * F.sqrt(dot(p.b, p.b)), lambda size: F.when(size == 0, F.lit(0.0)).otherwise(dot(p.a, p.b) / size))

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def hash_embedding(text: Column) -> Column:
    """A deterministic offline embedding: the 32 bytes of SHA-256, each /255 - 0.5, at length 1."""

    def raw(digest):
        return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substr(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / 255 - 0.5)

    return unit(let(F.sha2(text, 256), raw))


def blend(a: Column, b: Column, weight: float) -> Column:
    """``weight`` parts of ``a`` and the rest of ``b``, at length 1: a chunk in the context of its document."""
    return unit(F.zip_with(a, b, lambda x, y: x * weight + y * (1 - weight)))

"""Vectors as array<double> columns, and noise that depends on nothing but its key."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(u: Column, v: Column, k: int = 0) -> Column:
    """u . v; of vectors of a known, moderate length k as plain sums, which are compiled."""
    if 0 < k <= 64:
        return reduce(lambda s, i: s + u[i] * v[i], range(1, k), u[0] * v[0])
    return F.aggregate(F.zip_with(u, v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def squared_norm(u: Column) -> Column:
    return F.aggregate(F.transform(u, lambda x: x * x), F.lit(0.0), lambda s, x: s + x)


def outer(u: Column) -> Column:
    """u u' as an array of columns, one after another."""
    return F.flatten(F.transform(u, lambda a: F.transform(u, lambda b: a * b)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def uniform(ident: Column, *key: object) -> Column:
    """In (0, 1), from 48 bits of an md5 of the key and the id: the same on every engine and in every partitioning."""
    text = F.concat(F.lit(":".join(map(str, key)) + ":"), ident.cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def normal(ident: Column, *key: object) -> Column:
    """Standard normal, by Box and Muller's transform of two uniforms."""
    return F.sqrt(-2 * F.log(uniform(ident, *key, "a"))) * F.cos(2 * math.pi * uniform(ident, *key, "b"))


def uniform_sql(ident: str, *key: object) -> str:
    """`uniform` in DuckDB's SQL."""
    prefix = ":".join(map(str, key)) + ":"
    return f"((('0x' || substr(md5('{prefix}' || {ident}), 1, 12))::BIGINT::DOUBLE + 0.5) / {float(1 << 48)})"


def normal_sql(ident: str, *key: object) -> str:
    return f"(sqrt(-2 * ln({uniform_sql(ident, *key, 'a')})) * cos({2 * math.pi!r} * {uniform_sql(ident, *key, 'b')}))"

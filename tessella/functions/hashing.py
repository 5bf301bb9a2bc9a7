"""Stable ids, splits and set measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(*parts: Column) -> Column:
    """The first 24 hex digits of the SHA-256 of the parts, joined by the unit separator."""
    return F.left(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), F.lit(24))


def salted_hash(salt: str, value: Column, digits: int = 64) -> Column:
    return F.left(F.sha2(F.concat(F.lit(salt + "|"), value.cast("string")), 256), F.lit(digits))


def stable_split(key: Column, fraction: float, seed: str) -> Column:
    """dev where the first 64 bits of SHA-256(seed, key) fall below ``fraction``; compared as hex, so no rounding."""
    bound = f"{int(fraction * 2**64):016x}"
    return F.when(F.left(F.sha2(F.concat(F.lit(seed + "\x1f"), key.cast("string")), 256), F.lit(16)) < bound, "dev").otherwise("train")


def stable_index(key: Column, size: int) -> Column:
    """A place in [0, size) from SHA-256."""
    return (F.conv(F.left(F.sha2(key.cast("string"), 256), F.lit(15)), 16, 10).cast("bigint") % size).cast("int")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Shared over all; ``empty`` where both sets are."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, empty).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def cosine(a: str, b: str) -> Column:
    """Cosine of two array columns in double precision."""
    dot = "aggregate(zip_with({0}, {1}, (x, y) -> cast(x as double) * cast(y as double)), cast(0 as double), (s, v) -> s + v)"
    return F.expr(f"{dot.format(a, b)} / (sqrt({dot.format(a, a)}) * sqrt({dot.format(b, b)}))")


def confidence(value: Column, status: Column) -> Column:
    """1 when verified, 0.6 when missing, 0 when not a number."""
    return F.when(status == "verified", 1.0).when(value.isNull(), 0.6).otherwise(F.coalesce(value.cast("string").try_cast("double"), F.lit(0.0)))

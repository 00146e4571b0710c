"""Hashes for grouping: independent 64-bit halves, with the bounds of lists and their nulls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash64(salt: int, *columns: Column) -> Column:
    """A 64-bit hash. The salt comes first and so seeds the rest: two salts give two independent hashes.

    Hashing the salt last would only scramble the hash of the rest, and add nothing to it.
    """
    return F.xxhash64(F.lit(salt), *columns)


def list_hash(salt: int, c: Column) -> Column:
    """As hash64 of an array of plain values: its length and the places of its nulls count; null is not empty."""
    return hash64(salt, F.size(c), F.transform(c, lambda s: hash64(salt, s.isNull(), s)), c.isNull())


def both(make, *args) -> list[Column]:
    """The two halves of 128 bits, named h1 and h2; ``make`` is hash64 or list_hash."""
    return [make(salt, *args).alias(f"h{salt}") for salt in (1, 2)]

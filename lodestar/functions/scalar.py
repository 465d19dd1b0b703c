"""Small scalar functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log2_up(n: Column) -> Column:
    """The smallest k with 2^k >= n; 0 for n <= 1."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1))).cast("long")


def granularity(n: Column) -> Column:
    """Block size for n elements: the square root, rounded up, or 100 for up to 100 of them."""
    return F.when(n > 100, F.ceil(F.sqrt(n.cast("double")))).otherwise(100).cast("long")


def bit_test(words: Column, place: Column) -> Column:
    """Whether bit place is set in an array of 64-bit words."""
    word = F.element_at(words, (F.shiftright(place, 6) + 1).cast("int"))
    return F.getbit(word, (place % 64).cast("int")) == 1


def bit_words(places: Column, n_words: int) -> Column:
    """An array of 64-bit words with the given places set."""
    words = F.array(*[F.lit(i).cast("long") for i in range(n_words)])
    one = F.lit(1).cast("long")

    def word(w: Column) -> Column:
        own = F.filter(places, lambda p: F.shiftright(p, 6) == w)
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, p: a.bitwiseOR(F.call_function("shiftleft", one, (p % 64).cast("int"))))

    return F.transform(words, word)


def pair_hash(a: Column, b: Column) -> Column:
    """A 64-bit hash of an ordered pair."""
    return F.xxhash64(a, b)


def hash32(x: Column) -> Column:
    """A 32-bit hash, as a long from 0."""
    return F.hash(x).cast("long").bitwiseAND(0xFFFFFFFF)


def hash64(x: Column, seed: int = 0) -> Column:
    """A 64-bit hash of the family that seed picks."""
    return F.xxhash64(F.lit(seed), x)


def hash_combine(a: Column, b: Column) -> Column:
    """One 64-bit hash of two; their order counts."""
    return F.xxhash64(a, b)


def array_hash(xs: Column, seed: int = 0) -> Column:
    """A 64-bit hash of an array's elements in their order."""
    return F.aggregate(xs, F.lit(seed).cast("long"), lambda a, x: F.xxhash64(a, x))

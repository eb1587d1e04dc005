"""A filter of fixed size: which rows can have a partner at all, told without moving them."""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 14


def places(key: Column) -> tuple[Column, Column]:
    spot = F.pmod(F.xxhash64(key), F.lit(WORDS * 64))
    return (spot / 64).cast("int"), (spot % 64).cast("int")


def bit_of(key: bytes) -> int:
    """The bit of a string, as ``places`` finds it."""
    return xxhash.xxh64_intdigest(key, 42) % (WORDS * 64)


def bit_field(keys: DataFrame, name: str) -> list[int]:
    """The bits that the column ``name`` of ``keys`` sets, in words of 64."""
    word, bit = places(F.col(name))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    rows = keys.select(word.alias("word"), one.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    field = [0] * WORDS
    for r in rows:
        field[r.word] = r.bits
    return field


def maybe_among(keys: DataFrame, name: str, key: Column) -> Column:
    """True if ``key`` is among the column ``name`` of ``keys``; false if it is not, but for chance.

    The keys set bits of a field of a million bits, which is all that reaches the driver and the tasks. With far
    more keys than that every row passes: the filter saves work and decides nothing.
    """
    field = bit_field(keys, name)
    word, bit = places(key)
    stored = F.lit(field) if any(field) else F.array_repeat(F.lit(0).cast("bigint"), WORDS)
    return F.getbit(F.element_at(stored.cast("array<bigint>"), word + 1), bit) == 1

"""Seeded draws: a hash of the seed and the row's keys, so results do not depend on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from treespark.functions.arrays import let

SEED = 42
RANGE = 2**32


def draw_key(*keys, seed: int = SEED) -> Column:
    """Hex digest of seed and keys; sorting by it is a seeded shuffle. String keys are literals' text or columns."""
    parts = [k if isinstance(k, Column) else F.lit(k) for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def draw(*keys, seed: int = SEED) -> Column:
    """A uniform integer in [0, 2^32)."""
    return F.conv(F.substring(draw_key(*keys, seed=seed), 1, 8), 16, 10).cast("bigint")


def uniform(*keys, seed: int = SEED) -> Column:
    """A uniform double in [0, 1)."""
    return draw(*keys, seed=seed) / F.lit(float(RANGE))


def happens(probability: float, *keys, seed: int = SEED) -> Column:
    """A Bernoulli draw, compared as integers."""
    return draw(*keys, seed=seed) < F.lit(math.ceil(probability * RANGE)).cast("bigint")


def drawn_ranks(total: Column, count: int, *keys, seed: int = SEED) -> Column:
    """``count`` distinct ranks from 0 to ``total`` - 1, or all of them if fewer: every set is as likely.

    Floyd's draws: one hash a rank drawn, whatever ``total`` is, so nothing that is not drawn needs a key.
    """
    total = total.cast("bigint")
    none = F.array().cast("array<bigint>")
    last = F.when(total > 0, F.sequence(F.greatest(total - count, F.lit(0).cast("bigint")), total - 1)).otherwise(none)

    def step(drawn: Column, j: Column) -> Column:
        add = lambda r: F.concat(drawn, F.array(F.when(F.array_contains(drawn, r), j).otherwise(r)))
        return let(draw(*keys, j, seed=seed) % (j + 1), add)

    return F.aggregate(last, none, step)

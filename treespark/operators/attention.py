"""Attention range by tree distance: which positions may attend to which."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treespark.functions.arrays import computed, item, let, posexploded, upto
from treespark.functions.numbering import MEMBERS, cell_batches, reach_batches
from treespark.functions.trees import within_distance
from treespark.operators.trees import by_batches

# What is added to an attention score.
OPEN, CLOSED = 0.0, -1.0e6


@dataclass(frozen=True)
class RangeSettings:
    """``neighbours``: offsets of the words whose reach a word shares."""

    max_distance: int = 3
    neighbours: tuple[int, ...] = (-1,)


def reach_rows(df: DataFrame, max_distance: int = 3, short: int = MEMBERS) -> DataFrame:
    """(sent_id, id, other): words within the tree distance of each other.

    Sentences are walked from all words of an Arrow batch at once, about ``short`` pairs at a time, or those of one word; the rows
    are the same whatever it is.
    """
    return by_batches(df, (), partial(reach_batches, distance=max_distance, most=short), "id int, other int")


def open_positions(head: Column, settings: RangeSettings = RangeSettings()) -> Column:
    """Per row position 0..n (first special position, then the words) the ascending open columns.

    The row of the last special position is closed, so it is left out.
    """

    def word_row(n: Column, reach: Column, i: Column) -> Column:
        near = [item(reach, i + offset) for offset in (0, *settings.neighbours)]
        present = [F.coalesce(x, F.array().cast("array<int>")) for x in near]
        return F.sort_array(F.array_distinct(F.concat(F.array(F.lit(0), n + 1), *present)))

    return let(
        within_distance(head, settings.max_distance),
        lambda reach: F.concat(
            F.array(F.sequence(F.lit(0), F.size(reach) + 1)),
            F.transform(upto(F.size(reach)), lambda i: word_row(F.size(reach), reach, i)),
        ),
    )


def attention_pairs(df: DataFrame, settings: RangeSettings = RangeSettings(), short: int = MEMBERS) -> DataFrame:
    """(sent_id, i, j): the open cells of every sentence's mask, made as in ``reach_rows``."""
    cells = partial(cell_batches, offsets=(0, *settings.neighbours), distance=settings.max_distance, most=short)
    first = df.select("sent_id", F.lit(0).alias("i"), F.explode(F.sequence(F.lit(0), F.size("head") + 1)).alias("j"))
    return by_batches(df, (), cells, "i int, j int").unionByName(first)


def dense_mask(df: DataFrame, settings: RangeSettings = RangeSettings()) -> DataFrame:
    """Add ``dep_att_mask``: the full (n + 2) x (n + 2) mask. Meant for single batches; pairs are the compact form."""

    def row(js: Column, last: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), last), lambda j: F.when(F.array_contains(js, j), OPEN).otherwise(CLOSED)
        )

    def mask(rows: Column) -> Column:
        body = F.transform(rows, lambda js: row(js, F.size(rows)))
        return F.concat(body, F.array(F.array_repeat(F.lit(CLOSED), F.size(rows) + 1)))

    return computed(df, dep_att_mask=let(open_positions(F.col("head"), settings), mask))


def mask_rows(df: DataFrame) -> DataFrame:
    """(sent_id, i, j, value) of the dense mask."""
    rows = df.select("sent_id", posexploded(F.col("dep_att_mask")).alias("i", "vs"))
    return rows.select("sent_id", "i", posexploded(F.col("vs")).alias("j", "value"))

"""Contrastive examples: negative trees and phrase sets, sentence by sentence inside the row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treespark.functions import swaps
from treespark.functions.arrays import computed, item, let, smallest
from treespark.functions.draws import SEED, draw, draw_key, drawn_ranks
from treespark.functions.trees import Tree, with_tree
from treespark.operators.trees import SubtreeLimits, eligible

# (sentence id, array of subtree structs) -> the chosen ones
Sampler = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class TreeSettings:
    """Parameters of the contrastive trees and of their loss."""

    max_negatives: int = 10
    limits: SubtreeLimits = SubtreeLimits()
    max_size_difference: int = 1
    max_negatives_in_loss: int = 3
    include_root: bool = False
    temperature: float = 0.1
    last_layer_only: bool = True
    seed: int = SEED


@dataclass(frozen=True)
class PhraseSettings:
    """Parameters of the phrase sets and of their loss."""

    min_size: int = 2
    max_height: int = 2
    max_negatives: int = 10
    max_sets_per_sentence: int = 1_000_000
    temperature: float = 0.1
    last_layer_only: bool = True
    seed: int = SEED


def all_subtrees(sent_id: Column, subtrees: Column) -> Column:
    """Sampler that keeps every eligible subtree."""
    return subtrees


def random_subtrees(max_number: int, seed: int = SEED) -> Sampler:
    """Sampler that keeps up to ``max_number`` eligible subtrees of each sentence."""

    def sample(sent_id: Column, subtrees: Column) -> Column:
        return smallest(subtrees, lambda s: draw_key("subtree", sent_id, s["root"], seed=seed), max_number)

    return sample


_COMBINED = "array<struct<k int, size int, ids array<int>, left int>>"
_SETS = """array<struct<root_id int, positive map<int, int>, negatives array<map<int, int>>, found bigint, total bigint,
plans array<struct<targets array<int>, values array<int>>>>>"""


def combinations(head: Column, subtrees: Column, most: int = 3) -> Column:
    """For each subtree its root, and the ascending combinations of one to three of its targets (members below the root)
    and of its values (neighbours), but of no more than ``most``: how many they are (k), the size of all they govern, ids,
    and how many items follow the last one (left), in the order of these."""
    made = F.arrow_udf(_combinations, f"array<struct<root int, targets {_COMBINED}, values {_COMBINED}>>")
    return made(head, F.transform(subtrees, lambda s: s["root"]), F.lit(most))


def _combinations(head: pa.Array, roots: pa.Array, most: pa.Array) -> pa.Array:
    return swaps.combinations(head, roots, most[0].as_py())


def _sets(sent_id: pa.Array, head: pa.Array, roots: pa.Array, reach: pa.Array, most: pa.Array, seed: pa.Array) -> pa.Array:
    return swaps.tree_sets(sent_id, head, roots, reach[0].as_py(), most[0].as_py(), seed[0].as_py())


def tree_sets(
    df: DataFrame, settings: TreeSettings = TreeSettings(), sampler: Sampler = all_subtrees
) -> DataFrame:
    """Add ``tree_sets``: root_id, positive map and negative maps of each subtree with more than one negative.

    A plan replaces 1-3 non-root members, with all they govern, by as many neighbours with all they govern, of about
    the same size. Plans are counted slice by slice (found: with repeats, total: without), and only those drawn are built,
    from their ranks: sentences of a batch together, see ``swaps``.
    """
    chosen = sampler(F.col("sent_id"), eligible(F.col("head"), settings.limits))
    rows = df.withColumn("_roots", F.transform(chosen, lambda s: s["root"]))
    numbers = [F.lit(x) for x in (settings.max_size_difference, settings.max_negatives, settings.seed)]
    return rows.withColumn("tree_sets", F.arrow_udf(_sets, _SETS)(F.col("sent_id").cast("string"), F.col("head"), F.col("_roots"), *numbers)).drop("_roots")


def first_pieces(spans: Column) -> Column:
    """First piece of every word, by word id: ``spans`` are (b, e) pairs with a special pair at both ends."""
    return F.transform(F.slice(spans, 2, F.size(spans) - 2), lambda s: s["b"])


def phrase_set_structs(
    sent_id: Column, head: Column, spans: Column, settings: PhraseSettings = PhraseSettings()
) -> Column:
    """Phrase sets of one sentence, see ``phrase_sets``."""
    chance = lambda kind, s, below: draw(kind, sent_id, s["root"], seed=settings.seed) % below

    def build(firsts: Column, tree: Tree, s: Column) -> Column:
        first = lambda x: item(firsts, x)
        ranks = drawn_ranks(
            tree.words() - s["size"], settings.max_negatives, "outside", sent_id, s["root"], seed=settings.seed)

        def with_places(places: Column) -> Column:
            """``places`` are those of the positive and of the query among the members without it."""
            shifted = F.when(places["query"] < places["positive"], places["query"]).otherwise(places["query"] + 1)
            return F.struct(
                s["root"].alias("root"),
                first(F.get(s["members"], shifted.cast("int"))).alias("query"),
                first(F.get(s["members"], places["positive"].cast("int"))).alias("positive"),
                F.transform(ranks, lambda r: first(tree.outside(s["root"], r))).alias("negatives"),
            )

        places = F.struct(
            chance("positive", s, s["size"]).alias("positive"), chance("query", s, s["size"] - 1).alias("query"))
        return let(places, with_places)

    def build_all(firsts: Column, tree: Tree) -> Column:
        fits = lambda size, height: (
            (height <= settings.max_height) & (size >= max(settings.min_size, 2)) & (size < F.size(firsts))
        )
        order = lambda s: draw_key("phrase", sent_id, s["root"], seed=settings.seed)
        chosen = smallest(tree.subtrees(fits), order, settings.max_sets_per_sentence)
        return F.transform(chosen, lambda s: build(firsts, tree, s))

    return with_tree(head, lambda tree: let(first_pieces(spans), lambda firsts: build_all(firsts, tree)))


def phrase_sets(df: DataFrame, spans: str, settings: PhraseSettings = PhraseSettings()) -> DataFrame:
    """Add ``phrase_sets``: per flat subtree one query, one positive and outside negatives, as piece positions."""
    return computed(
        df, phrase_sets=phrase_set_structs(F.col("sent_id"), F.col("head"), F.col(spans), settings)
    )

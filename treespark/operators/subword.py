"""Word pieces: spans, budgets, special tokens, and dependency trees expanded over the pieces.

Spans are ``array<struct<b,e>>``, inclusive, with one pair for the special token at either end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from treespark.functions.arrays import computed, exploded, item, let, running_sum, upto
from treespark.functions.trees import off_tree

SUBWORD_LABEL = "subword"


def spans_of_counts(counts: Column) -> Column:
    """Spans of words with the given piece counts."""
    pair = lambda b, e: F.struct(b.cast("int").alias("b"), e.cast("int").alias("e"))

    def spans(ends: Column) -> Column:
        inner = F.transform(F.slice(ends, 2, F.size(ends)), lambda end, i: pair(F.get(ends, i) + 1, end))
        return F.concat(
            F.array(pair(F.lit(0), F.lit(0))), inner, F.array(pair(F.element_at(ends, -1) + 1, F.element_at(ends, -1) + 1))
        )

    return let(running_sum(counts), spans)


def fitting_words(counts: Column, max_length: int | None) -> Column:
    """How many leading words fit into ``max_length`` pieces, two of which are special."""
    if max_length is None:
        return F.size(counts)
    budget = max_length - 2
    # Every word has a piece at least, so no more than ``budget`` words can matter.
    head = F.slice(counts, 1, F.least(F.size(counts), F.lit(budget)))
    return F.size(F.filter(running_sum(head), lambda s: s <= budget)) - 1


def tokenize(
    df: DataFrame,
    pieces: str,
    max_length: int | None = None,
    tokens: str = "tokens",
    cls: int = 1,
    sep: int = 2,
    unk: int = 3,
) -> DataFrame:
    """Add input_ids, token_spans, attention_mask and token_type_ids; cut ``tokens`` to the words that fit.

    ``pieces`` holds one array of piece ids per word; a word without pieces counts as one unknown piece.
    """
    full = F.transform(pieces, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(F.lit(unk))))
    kept = let(
        full,
        lambda ps: F.slice(ps, 1, fitting_words(F.transform(ps, lambda p: F.size(p)), max_length)),
    )
    cut = computed(df, _kept=kept)
    ids = F.concat(F.array(F.lit(cls)), F.flatten("_kept"), F.array(F.lit(sep)))
    with_ids = computed(
        cut,
        input_ids=ids.cast("array<int>"),
        token_spans=spans_of_counts(F.transform("_kept", lambda p: F.size(p))),
        **{tokens: F.slice(tokens, 1, F.size("_kept"))},
    )
    return computed(
        with_ids,
        attention_mask=F.array_repeat(F.lit(1), F.size("input_ids")),
        token_type_ids=F.array_repeat(F.lit(0), F.size("input_ids")),
    ).drop("_kept")


def encode_pair(first: Column, second: Column, cls: int = 1, sep: int = 2) -> Column:
    """Struct of input_ids, token_type_ids and attention_mask of ``[CLS] a [SEP] b [SEP]``."""
    end = F.array(F.lit(sep))
    ids = F.concat(F.array(F.lit(cls)), first, end, second, end)
    types = F.concat(F.array_repeat(F.lit(0), F.size(first) + 2), F.array_repeat(F.lit(1), F.size(second) + 1))
    return F.struct(
        ids.alias("input_ids"),
        types.alias("token_type_ids"),
        F.array_repeat(F.lit(1), F.size(first) + F.size(second) + 3).alias("attention_mask"),
    )


def flat_spans(spans: Column) -> Column:
    """Begin and end positions in one flat array, the form of the stored tables."""
    return F.flatten(F.transform(spans, lambda s: F.array(s["b"], s["e"])))


def paired_spans(flat: Column) -> Column:
    """The pair view of a flat span array."""
    return F.transform(
        upto((F.size(flat) / 2).cast("int")),
        lambda i: F.struct(item(flat, 2 * i - 1).alias("b"), item(flat, 2 * i).alias("e")),
    )


def window_spans(piece_counts: DataFrame, max_length: int | None = None) -> DataFrame:
    """Long form of the spans: adds b and e to (sent_id, id, pieces) rows by a running sum per sentence.

    For lines without a length bound, where a row-sized array is not wanted.
    """
    so_far = Window.partitionBy("sent_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    counted = piece_counts.withColumn("pieces", F.greatest("pieces", F.lit(1))).withColumn(
        "e", F.sum("pieces").over(so_far)
    )
    placed = counted.withColumn("b", F.col("e") - F.col("pieces") + 1)
    return placed if max_length is None else placed.where(F.col("e") <= max_length - 2)


def id_map(spans: Column) -> Column:
    """New id of every old id from 0 on: the id shifted by the pieces added before it."""
    extra = F.transform(F.slice(spans, 1, F.size(spans) - 1), lambda s: s["e"] - s["b"])
    return let(running_sum(extra), lambda shift: F.transform(F.slice(spans, 1, F.size(spans) - 1), lambda _, i: i + F.get(shift, i)))


def mismatched(spans: Column, head: Column) -> Column:
    """True where words and tree sizes differ: such a sentence cannot be expanded."""
    return F.size(spans) != F.size(head) + 2


def expand_subwords(df: DataFrame, spans: str = "token_spans", observation: Observation | None = None) -> DataFrame:
    """Expand each tree over its pieces.

    A word's first piece carries its arc (ids shifted), its further pieces hang on the first with the label
    ``subword``. Adds dependency_token_spans and keeps orig_head and orig_deprel. Sentences whose word count
    differs from the tree size are left out. Their number and that of all sentences are found in ``observation`` as
    ``discarded`` and ``total`` once the first job over the result has run; ``expansion_counts`` gives them by split.
    """

    def arcs(new_id: Column, words: Column) -> Column:
        def word(s: Column, i: Column) -> Column:
            own = item(new_id, i + 2)
            first = F.struct(
                item(new_id, F.get("head", i) + 1).alias("head"), F.get("deprel", i).alias("deprel")
            )
            further = F.struct(own.alias("head"), F.lit(SUBWORD_LABEL).alias("deprel"))
            return F.concat(F.array(first), F.array_repeat(further, s["e"] - s["b"]))

        return F.flatten(F.transform(words, word))

    if observation is not None:
        lost = F.count_if(mismatched(F.col(spans), F.col("head")))
        df = df.observe(observation, lost.alias("discarded"), F.count(F.lit(1)).alias("total"))
    fitting = df.where(~mismatched(F.col(spans), F.col("head")))
    inner = F.slice(spans, 2, F.size(spans) - 2)
    expanded = computed(fitting, _arcs=let(id_map(F.col(spans)), lambda m: let(inner, lambda words: arcs(m, words))))
    last = F.element_at(spans, -1)["e"]
    every_piece = F.transform(
        F.sequence(F.lit(0), last), lambda p: F.struct(p.alias("b"), p.alias("e"))
    )
    return computed(
        expanded.withColumnsRenamed({"head": "orig_head", "deprel": "orig_deprel"}),
        head=F.transform("_arcs", lambda a: a["head"]),
        deprel=F.transform("_arcs", lambda a: a["deprel"]),
        dependency_token_spans=every_piece,
    ).drop("_arcs")


def expansion_counts(df: DataFrame, spans: str = "token_spans") -> DataFrame:
    """(split, discarded, total) of the expansion."""
    return df.groupBy("split").agg(
        F.count_if(mismatched(F.col(spans), F.col("head"))).alias("discarded"), F.count("*").alias("total")
    )


def length_conflicts(df: DataFrame) -> DataFrame:
    """Expanded sentences whose tree and input ids disagree in length."""
    return df.where(F.size("input_ids") - 2 != F.size("head")).select("sent_id", "input_ids", "head")


def expansion_fault(head: str = "head", input_ids: str = "input_ids") -> Column:
    """What is wrong with an expanded sentence: ``cycle`` (words that never meet the root), ``length`` (tree and input
    ids disagree) or null. A cycle comes first."""
    cyclic = F.size(off_tree(F.col(head))) > 0
    return F.when(cyclic, "cycle").when(F.size(input_ids) - 2 != F.size(head), "length")


def sound(df: DataFrame) -> DataFrame:
    """``df`` as it is; the job that reads it fails at the first sentence with an ``expansion_fault``."""
    fault = expansion_fault()
    message = F.concat(F.lit("sentence "), F.col("sent_id").cast("string"), F.lit(": "), fault)
    return df.withColumn("head", F.when(fault.isNull(), F.col("head")).otherwise(F.raise_error(message)))


def trim_special(values: Column) -> Column:
    """Drop the first and the last position."""
    return F.slice(values, 2, F.size(values) - 2)


def trim_spans(spans: Column) -> Column:
    """Spans of the words only, counted from the first word's first piece."""
    return F.transform(trim_special(spans), lambda s: F.struct((s["b"] - 1).alias("b"), (s["e"] - 1).alias("e")))


def span_pieces(df: DataFrame, spans: str, *keep: str) -> DataFrame:
    """(sent_id, word, pos): the positions inside every span, span 0 being the first special token."""
    words = df.select("sent_id", *keep, F.posexplode(F.slice(spans, 1, F.size(spans))).alias("word", "s"))
    return words.select("sent_id", *keep, "word", exploded(F.sequence("s.b", "s.e")).alias("pos"))

"""Sinks: plain text, CoNLL-U, vocabulary list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treespark.functions.arrays import let
from treespark.operators.vocabulary import check_vocabulary


def write_text(df: DataFrame, path: str, column: str = "text") -> None:
    """One text per line."""
    df.select(column).write.mode("overwrite").text(path)


def conllu_block(
    tokens: Column, xpos: Column, head: Column, deprel: Column, comments: dict[str, Column] | None = None
) -> Column:
    """The lines of one sentence; unused fields are ``_``."""
    empty = F.lit("_")

    def lines(xs: Column, hs: Column, ds: Column) -> Column:
        def line(form: Column, i: Column) -> Column:
            at = lambda values: F.coalesce(F.get(values, i).cast("string"), empty)
            return F.concat_ws(
                "\t", (i + 1).cast("string"), form, empty, empty, at(xs), empty, at(hs), at(ds), empty, empty
            )

        return F.array_join(F.transform(tokens, line), "\n")

    body = let(xpos, lambda xs: let(head, lambda hs: let(deprel, lambda ds: lines(xs, hs, ds))))
    top = [F.concat(F.lit(f"# {k} = "), v.cast("string")) for k, v in (comments or {}).items()]
    return F.concat_ws("\n", *top, body)


def write_conllu(df: DataFrame, path: str, comments: dict[str, Column] | None = None) -> None:
    """Sentences as blocks with a blank line after each."""
    block = conllu_block(F.col("tokens"), F.col("xpos"), F.col("head"), F.col("deprel"), comments)
    df.select(F.concat(block, F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def write_vocab(vocab: DataFrame, path: str) -> None:
    """One piece per line in id order, in one file (a vocabulary is bounded by its size setting).

    Ids must run from 0 without gaps.
    """
    report = check_vocabulary(vocab).first()
    if not report["contiguous"]:
        raise ValueError(f"vocabulary ids are not 0..n-1: {report['pieces']} pieces, largest id {report['max_id']}")
    vocab.repartition(1).sortWithinPartitions("id").select("piece").write.mode("overwrite").text(path)

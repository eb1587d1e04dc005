"""Subword vocabulary: word counts, merge learning, encoding of distinct words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treespark.functions.arrays import exploded, let, upto
from treespark.functions.joins import looked_up
from treespark.functions.numbering import starts_of
from treespark.functions.text import WHITESPACE, marked_tokens, normalised, pre_tokens
from treespark.operators.merges import joined, learnt_merges, replay
from treespark.session import cut_lineage

# Special pieces, first in the vocabulary, in id order.
SPECIALS = ("[PAD]", "[CLS]", "[SEP]", "[UNK]", "[MASK]")
CASED_SPECIALS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")
# The vocabulary size grows by 6,000 over 450,000 word types, from 8,000 at 15,000 types.
BASE_SIZE, BASE_TYPES, GROWTH = 8_000, 15_000, 6_000 / 450_000
# Fixed value: mark of a piece inside a word.
PREFIX = "##"
#: A vocabulary of more characters is joined, not sent to every task.
SENT_CHARACTERS = 1 << 22


@dataclass(frozen=True)
class VocabularySettings:
    """``model`` is wordpiece or bpe; ``vocab_size`` None means the size rule.

    ``single_marks`` makes every punctuation mark a word of its own. ``round_pairs`` and ``round_symbols`` bound what
    one round of learning takes to the driver; the result does not depend on them.
    """

    model: str = "wordpiece"
    vocab_size: int | None = None
    min_frequency: int = 0
    alphabet_limit: int | None = None
    lowercase: bool = True
    decompose: bool = True
    special_tokens: tuple[str, ...] = SPECIALS
    single_marks: bool = False
    round_pairs: int = 1 << 16
    round_symbols: int = 1 << 20

    def __post_init__(self):
        if self.model not in ("wordpiece", "bpe"):
            raise ValueError(f"unknown model {self.model}; valid: wordpiece, bpe")


CASED = VocabularySettings(
    vocab_size=10_000, min_frequency=2, alphabet_limit=500, lowercase=False, decompose=False,
    special_tokens=CASED_SPECIALS, single_marks=True,
)
# Settings of the cased tokenizer that a vocabulary is learnt anew for.
PRETRAINED_CASED = VocabularySettings(
    vocab_size=10_000, lowercase=False, decompose=False, special_tokens=CASED_SPECIALS, single_marks=True
)


def size_rule(types: Column) -> Column:
    """Vocabulary size for a number of word types."""
    return F.lit(BASE_SIZE) + F.greatest(
        F.lit(0), ((types - BASE_TYPES) * F.lit(GROWTH)).cast("int")
    )


def word_types(texts: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """(types): number of distinct space-separated words."""
    words = texts.select(F.explode(F.split(column, " ")).alias("word"))
    count = F.approx_count_distinct("word") if approximate else F.countDistinct("word")
    return words.agg(count.alias("types"))


def word_frequencies(
    texts: DataFrame, column: str, lowercase: bool = True, decompose: bool = True, single_marks: bool = False
) -> DataFrame:
    """(word, freq) after normalising and pre-tokenising.

    White-space chunks are counted first, so normalising and the word pattern run on distinct chunks. Neither
    reaches across white space, so the counts are the same. ASCII chunks are decomposed as they are; only the others
    pass through Python.
    """
    chunks = texts.select(F.explode(F.split(column, f"[{WHITESPACE}]+")).alias("chunk"))
    counted = chunks.where("chunk <> ''").groupBy("chunk").count()

    def words_of(rows: DataFrame, python: bool) -> DataFrame:
        chunk = normalised(F.col("chunk"), python, lowercase)
        return rows.select(F.explode(marked_tokens(chunk) if single_marks else pre_tokens(chunk)).alias("word"), "count")

    if decompose:
        counted = cut_lineage(counted)
        beyond = F.col("chunk").rlike(r"[^\x00-\x7F]")
        words = words_of(counted.where(~beyond), False).unionByName(words_of(counted.where(beyond), True))
    else:
        words = words_of(counted, False)
    return words.groupBy("word").agg(F.sum("count").alias("freq"))


def symbols(word: Column, prefix: str) -> Column:
    """Characters of a word, those after the first marked with the prefix."""
    return F.transform(
        F.filter(F.split(word, ""), lambda c: c != ""),
        lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.lit(prefix), c)),
    )


def _alphabet(words: DataFrame, limit: int | None) -> list[str]:
    """The characters used, most frequent first when limited, in code-point order."""
    chars = words.select(F.explode(F.split("word", "")).alias("c"), "freq").where("c <> ''")
    counts = chars.groupBy("c").agg(F.sum("freq").alias("n"))
    if limit is not None:
        counts = counts.orderBy(F.desc("n"), "c").limit(limit)
    return sorted(r["c"] for r in counts.select("c").collect())


def learn(words: DataFrame, settings: VocabularySettings = VocabularySettings()) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Vocabulary (piece, id) and merges, in order, from a (word, freq) table.

    Merges are those of one-by-one learning: always the most frequent pair, of equal ones the smaller by code points.
    Distinct merges may make the same piece, which then has one id. The vocabulary, bounded by its size, and a round's
    table of fragments, bounded by the settings, are all that reaches the driver; see ``merges``.
    """
    prefix = PREFIX if settings.model == "wordpiece" else ""
    words = cut_lineage(words.select("word", "freq"))
    size = settings.vocab_size
    if size is None:
        size = words.agg(size_rule(F.count("*")).alias("n")).first()["n"]
    alphabet = _alphabet(words, settings.alphabet_limit)
    cut = symbols(F.col("word"), prefix)
    if settings.alphabet_limit is not None:
        known = F.array(*[F.lit(c) for c in alphabet])
        cut = F.filter(cut, lambda s: F.array_contains(known, F.substring(s, -1, 1)))
    table = words.select(cut.alias("symbols"), "freq").where(F.size("symbols") > 0)
    # At most two symbols per character of the script, so the list is short whatever the corpus.
    first = sorted(r["s"] for r in table.select(F.explode("symbols").alias("s")).distinct().collect())
    pieces = dict.fromkeys([*settings.special_tokens, *alphabet, *first])
    learnt = [pair for pair, _ in learnt_merges(
        table, prefix, set(pieces), size - len(pieces), max(1, settings.min_frequency), settings.round_pairs, settings.round_symbols)]
    pieces |= dict.fromkeys(joined(a, b, prefix) for a, b in learnt)
    vocab = words.sparkSession.createDataFrame([(p, i) for i, p in enumerate(pieces)], "piece string, id int")
    return vocab, learnt


def check_vocabulary(vocab: DataFrame) -> DataFrame:
    """(pieces, max_id, contiguous): ids must run from 0 without gaps or repeats."""
    return vocab.agg(
        F.count("*").alias("pieces"),
        F.max("id").alias("max_id"),
        (
            (F.min("id") == 0) & (F.max("id") + 1 == F.count("*")) & (F.countDistinct("id") == F.count("*"))
        ).alias("contiguous"),
    )


def fits(vocab: DataFrame) -> bool:
    """Whether a vocabulary is small enough to be sent to every task."""
    size = vocab.agg(F.sum(F.length("piece") + 1).alias("n")).first()["n"]
    return (size or 0) <= SENT_CHARACTERS


def piece_trie(pieces: list[tuple[str, int]]) -> tuple[dict, dict]:
    """Tries of the pieces that start a word and of those inside it: characters lead on, the empty string to the id."""
    starting, inside = {}, {}
    for piece, number in pieces:
        follows = piece[len(PREFIX):] if piece.startswith(PREFIX) else ""
        for trie, text in ((starting, piece), (inside, follows)):
            if text:
                for c in text:
                    trie = trie.setdefault(c, {})
                trie.setdefault("", number)
    return starting, inside


def longest_matches(word: str, starting: dict, inside: dict) -> list[int] | None:
    """Ids of the longest pieces from left to right; None where no piece goes on. At most a longest piece is read again."""
    ids, at, trie = [], 0, starting
    while at < len(word):
        here, till, node = at, at, trie
        while here < len(word) and (node := node.get(word[here])) is not None:
            here += 1
            if "" in node:
                till, found = here, node[""]
        if till == at:
            return None
        ids.append(found)
        at, trie = till, inside
    return ids


def encode_distinct(words: DataFrame, vocab: DataFrame, unk: int = 3, max_word: int | None = None) -> DataFrame:
    """(word, ids): greedy longest match of every distinct word, walking a trie of the pieces.

    The vocabulary's size is checked before it is sent; one that does not fit is joined (``encode_by_joins``), with the same
    ids. A word with an uncovered character, of more than ``max_word`` characters, empty or null, is unknown as a whole.
    Of equal pieces the smallest id counts.
    """
    if not fits(vocab):
        return encode_by_joins(words, vocab, unk, max_word)
    pieces = sorted((r["piece"], r["id"]) for r in vocab.select("piece", "id").where("piece IS NOT NULL").collect())

    def match(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        starting, inside = piece_trie(pieces)
        for batch in batches:
            yield pd.Series([
                (longest_matches(w, starting, inside) if w and (max_word is None or len(w) <= max_word) else None) or [unk]
                for w in batch
            ], dtype=object)

    distinct = words.select("word").distinct()
    return distinct.select("word", F.pandas_udf(match, "array<int>")("word").alias("ids"))


def encode_by_joins(words: DataFrame, vocab: DataFrame, unk: int = 3, max_word: int | None = None) -> DataFrame:
    """``encode_distinct`` for a vocabulary of any size, by an equi join.

    Every substring up to the longest piece is looked up; the walk from left to right then happens inside the row.
    """
    vocab = vocab.groupBy("piece").agg(F.min("id").alias("id"))
    distinct = words.select("word").distinct()
    longest = vocab.agg(F.max(F.length("piece")).alias("n")).scalar()
    short = distinct if max_word is None else distinct.where(F.length("word") <= max_word)
    starts = short.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("start"))
    room = F.least(F.length("word") - F.col("start") + 1, longest)
    parts = starts.where("word <> ''").select("word", "start", F.explode(F.sequence(F.lit(1), room)).alias("len"))
    text = F.expr("substring(word, start, len)")
    parts = parts.withColumn("piece", F.when(F.col("start") == 1, text).otherwise(F.concat(F.lit(PREFIX), text)))
    hits = parts.join(vocab.select("piece", "id"), "piece").groupBy("word", "start").agg(
        F.max_by(F.struct("len", "id"), "len").alias("hit")
    )
    per_word = hits.groupBy("word").agg(
        F.map_from_entries(F.collect_list(F.struct("start", "hit"))).alias("hits")
    )

    def walk(hits: Column) -> Column:
        start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("ids"))

        def step(state: Column, i: Column) -> Column:
            hit = hits[i]
            return F.when(
                (state["at"] == i) & hit.isNotNull(),
                F.struct((i + hit["len"]).alias("at"), F.concat(state["ids"], F.array(hit["id"])).alias("ids")),
            ).otherwise(state)

        def finish(state: Column) -> Column:
            return F.when(state["at"] > F.length("word"), state["ids"]).otherwise(F.array(F.lit(unk)))

        return let(F.aggregate(upto(F.length("word")), start, step), finish)

    found = per_word.select("word", walk(F.col("hits")).alias("ids"))
    return distinct.join(found, "word", "left").select(
        "word", F.coalesce("ids", F.array(F.lit(unk))).alias("ids")
    )


def encode_distinct_bpe(
    words: DataFrame, vocab: DataFrame, merges: list[tuple[str, str]], unk: int = 3
) -> DataFrame:
    """(word, ids) by replaying merges in the order learnt, on distinct words in Arrow batches.

    ``merges`` is bounded by the vocabulary size; pieces get their ids by a join.
    """
    ranks = {pair: i for i, pair in enumerate(merges)}

    def segment(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda word: replay(list(word), ranks, ""))

    distinct = words.select("word").distinct()
    cut_words = distinct.select("word", F.pandas_udf(segment, "array<string>")("word").alias("pieces"))
    return join_piece_ids(cut_words, vocab, ["word"], unk)


def join_piece_ids(df: DataFrame, vocab: DataFrame, keys: list[str], unk: int = 3) -> DataFrame:
    """(keys, ids): pieces of each row as vocabulary ids, ``unk`` where the vocabulary lacks one."""
    rows = df.select(*keys, F.posexplode_outer("pieces").alias("pos", "piece"))
    ids = with_ids(rows, vocab.select("piece", "id"), [*keys, "pos"]).groupBy(*keys).agg(
        F.sort_array(
            F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("id", F.lit(unk)).alias("id"))))
        ).alias("r")
    )
    return ids.select(*keys, F.transform("r", lambda x: x["id"]).alias("ids"))


def with_ids(rows: DataFrame, table: DataFrame, spread: list[str]) -> DataFrame:
    """``rows`` with the columns of ``table`` by piece: broadcast if it fits, else joined with frequent pieces apart."""
    if fits(table):
        return rows.join(F.broadcast(table), "piece", "left")
    return looked_up(rows, table, "piece", spread)


def piece_ids(df: DataFrame, vocab: DataFrame, unk: int = 3, spread: tuple[str, ...] = ("sent_id", "pos")) -> DataFrame:
    """Long form of the lookup: adds ``token_id`` to rows with a ``piece``; the columns ``spread`` tell the rows of one apart."""
    known = vocab.select("piece", F.col("id").alias("token_id"))
    return with_ids(df, known, list(spread)).withColumn("token_id", F.coalesce("token_id", F.lit(unk)))


def piece_id_lists(pieces: Column, vocab: DataFrame, unk: int = 3) -> Column:
    """``piece_ids`` of a list of pieces, in the row. For a vocabulary that ``fits``, as it is sent to every task, of distinct pieces."""
    known = vocab.where("piece IS NOT NULL").select("piece", F.col("id").cast("int").alias("id")).toArrow().combine_chunks()
    names, ids = (known.column(i).combine_chunks() for i in (0, 1))

    def looked(pieces: pa.Array) -> pa.Array:
        flat = pieces.flatten()
        found = ids.take(pc.index_in(flat, value_set=names.cast(flat.type))).fill_null(unk)
        lengths = pieces.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(starts_of(lengths), pa.int32()), found, mask=pieces.is_null())

    return F.arrow_udf(looked, "array<int>")(pieces)


def encode_words(
    df: DataFrame, encoded: DataFrame, tokens: str = "tokens", lowercase: bool = True, decompose: bool = True
) -> DataFrame:
    """Add ``pieces``: one array of piece ids per word, by joining distinct words of every sentence.

    ``encoded`` maps pre-tokenised words to ids (``encode_distinct``); a token may hold several of them. Tokens are
    counted first, and the frequent ones are joined apart from the rest.
    """
    words = df.select("sent_id", exploded(F.array_distinct(tokens)).alias("token"))
    counts = cut_lineage(words.groupBy("token").agg(F.count("*").alias("n")))
    parts = counts.select(
        "token", F.posexplode_outer(pre_tokens(normalised(F.col("token"), decompose, lowercase))).alias("i", "word")
    )
    ids = parts.join(encoded, "word", "left").groupBy("token").agg(
        F.sort_array(F.collect_list(F.struct("i", "ids"))).alias("r")
    )
    none = F.array().cast("array<int>")
    by_token = cut_lineage(ids.where("token IS NOT NULL").select(
        "token", F.flatten(F.transform("r", lambda x: F.coalesce(x["ids"], none))).alias("ids")))
    per_sentence = looked_up(words.where("token IS NOT NULL"), by_token, "token", ["sent_id"], counts).groupBy("sent_id").agg(
        F.map_from_entries(F.collect_list(F.struct("token", "ids"))).alias("_ids")
    )
    joined = df.join(per_sentence.hint("merge"), "sent_id", "left")
    return joined.withColumn(
        "pieces", let(F.col("_ids"), lambda m: F.transform(tokens, lambda t: F.coalesce(m[t], none)))
    ).drop("_ids")

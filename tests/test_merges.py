"""Learning of merges in rounds against one-by-one learning that counts everything anew."""

import random
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from treespark.operators import vocabulary
from treespark.operators.merges import Learner, joined, merged, replay
from treespark.plans import catalogue


def plain_learn(words, size, prefix, least, specials, limit=None):
    """(pieces, merges) from {word: freq}: count all pairs, merge the best one, start again."""
    chars = Counter()
    for word, n in words.items():
        for c in word:
            chars[c] += n
    alphabet = sorted(sorted(chars, key=lambda c: (-chars[c], c))[:limit])
    rows = [([prefix * (k > 0) + c for k, c in enumerate(w) if c in alphabet], n) for w, n in words.items()]
    pieces = dict.fromkeys([*specials, *alphabet, *sorted({s for r, _ in rows for s in r})])
    merges = []
    while len(pieces) < size:
        counts = Counter()
        for row, n in rows:
            for pair in zip(row, row[1:]):
                counts[pair] += n
        best = min(counts, key=lambda p: (-counts[p], p), default=None)
        if best is None or counts[best] < least:
            break
        merges.append(best)
        pieces[joined(*best, prefix)] = None
        rows = [(merged(row, best, joined(*best, prefix)), n) for row, n in rows]
    return list(pieces), merges


def random_words(seed, count=60):
    rng = random.Random(seed)
    return {"".join(rng.choices("aabbcdeé", k=rng.choice([1, 2, 4, 9, 15]))): rng.choice([1, 1, 2, 3, 7]) for _ in range(count)}


def table(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, freq bigint")


@pytest.mark.parametrize("model, pairs, symbols", [
    ("wordpiece", 1 << 16, 1 << 20), ("bpe", 7, 1 << 20), ("wordpiece", 12, 90), ("bpe", 1, 1)])
def test_rounds_give_the_merges_of_one_by_one_learning(spark, model, pairs, symbols):
    words = random_words(pairs + symbols)
    size = 18 if symbols == 1 else 45
    settings = vocabulary.VocabularySettings(model=model, vocab_size=size, round_pairs=pairs, round_symbols=symbols)
    vocab, merges = vocabulary.learn(table(spark, words), settings)
    want, want_merges = plain_learn(words, size, "##" if model == "wordpiece" else "", 1, vocabulary.SPECIALS)
    assert merges == want_merges
    assert [r.piece for r in vocab.orderBy("id").collect()] == want


@pytest.mark.parametrize("least, limit", [(2, 5), (4, None), (10**6, None)])
def test_limits(spark, least, limit):
    words = random_words(least)
    settings = replace(vocabulary.CASED, vocab_size=40, min_frequency=least, alphabet_limit=limit, round_pairs=9)
    vocab, merges = vocabulary.learn(table(spark, words), settings)
    want, want_merges = plain_learn(words, 40, "##", least, vocabulary.CASED_SPECIALS, limit)
    assert merges == want_merges and [r.piece for r in vocab.orderBy("id").collect()] == want


def test_runs_of_one_symbol():
    learner = Learner([(list("aaaaa"), 2), (list("aaab"), 1)], "")
    assert learner.best() == (10, ("a", "a"))
    learner.merge(("a", "a"))
    assert learner.rows == [["aa", "aa", "a"], ["aa", "a", "b"]] and learner.best() == (3, ("aa", "a"))
    assert replay(list("aaaaa"), {("a", "a"): 0, ("aa", "a"): 1}, "") == ["aa", "aaa"]


def test_words_without_pairs(spark):
    for words in ({}, {"a": 3, "b": 1}):
        vocab, merges = vocabulary.learn(table(spark, words), vocabulary.VocabularySettings())
        assert merges == [] and vocab.count() == 5 + (2 if words else 0)


@pytest.mark.parametrize("name, settings", [
    ("k2_wordpiece_vocabulary", vocabulary.VocabularySettings()), ("k3_cased_vocabulary", vocabulary.CASED)])
def test_query_learns_the_whole_size(spark, name, settings):
    """The query at full size; its first merges against counting everything anew."""
    sf = "/root/testdata/sf0.001"
    got = [r.piece for r in catalogue.QUERIES[name](spark, sf).orderBy("id").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = vocabulary.word_frequencies(docs, "text", settings.lowercase, settings.decompose, settings.single_marks)
    counts = {r.word: r.freq for r in words.collect()}
    start = len(plain_learn(counts, 0, "##", 1, settings.special_tokens, settings.alphabet_limit)[0])
    want, _ = plain_learn(counts, start + 40, "##", max(1, settings.min_frequency), settings.special_tokens, settings.alphabet_limit)
    assert got[: start + 40] == want
    assert len(set(got)) == len(got) >= 8000


def test_marks_are_words_of_their_own(spark):
    df = spark.createDataFrame([("it's a_b--c $5+ «x».",)], "text string")
    got = {r.word: r.freq for r in vocabulary.word_frequencies(df, "text", False, False, True).collect()}
    assert got == dict(Counter(["it", "'", "s", "a", "_", "b", "-", "-", "c", "$", "5", "+", "«", "x", "»", "."]))
    frequencies = vocabulary.word_frequencies(df, "text")
    assert frequencies.agg(F.sum("freq")).first()[0] == 12

"""Toxicity: a support vector machine over a subsequence string kernel, with Nyström landmarks.

The kernel of two words counts the three-letter subsequences they share, each weighted by ``DECAY`` to the power of the
letters it spans, and is divided by what words of these lengths have at most: a gap or an inserted letter costs some
weight and no more. Nyström landmarks make the kernel a finite map; a linear machine over it is one weight per
three-letter subsequence, so that scoring a word is a sum of look-ups.

Words stand in for sentences: a document scores as its two worst words. Labels stand on documents, so words are labelled
through them: words of clean documents are clean but for telling ones, and in a toxic document its worst words are toxic,
found by turns of fitting and choosing. Insults made of several clean words, or with a gap across a space that is
not spelt letter by letter, are not found.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN, DECAY = 7, 0.7
#: Codes of letters: 0 is the mark at the ends, 1 to 26 are a to z, the others share what is left by a hash.
ALPHABET = 48
WINDOW = 48
#: Bounds of the fit: labelled documents per class, characters of such a document, words per class, landmarks per class.
SAMPLE, SAMPLE_CHARS, WORDS, LANDMARKS = 2000, 20_000, 10_000, 96
TURNS, RIDGE, STEP = 3, 1e-3, 20_000
#: Smoothed log odds from which a word is telling: about four times as frequent in toxic documents as in clean ones. Such a
#: word may be positive, and is no negative, though it stands in some clean documents.
TELLING = 1.4
CACHED = 500_000
#: Rows scored together, and the part of the highest score.
TOGETHER, FIRST = 500, 0.7
#: Letters that digits and signs stand for.
LOOKS = str.maketrans("013457@$!|", "oieastasii")
SPELT = re.compile(r"(?<!\S)(?:[^\W\d_][^\S\n]){2,}[^\W\d_](?!\S)")
SCHEMA = "doc_id bigint, score double, predicted int"
MODEL = "table binary, bias double, slope double, offset double"


def letters_of(word: str) -> str:
    """The letters of a word, with look-alikes read as letters; empty for a word without letters."""
    if word.isalpha():
        return word
    if not any(c.isalpha() for c in word):
        return ""
    core = word.strip("!|.,;:?")
    return "".join(c for c in core.translate(LOOKS) if c.isalpha())


def words_of(text: str) -> list[str]:
    """Lower-cased words; letters spelt one by one are a word."""
    low = text.lower()
    words = low.split()
    words += [m[0].replace(" ", "").replace("\t", "") for m in SPELT.finditer(low)]
    return words


def coded(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, letter codes) of words of equal length, with a mark at both ends. Long words come in windows."""
    by_length: dict[int, tuple[list[int], list[str]]] = {}
    for k, word in enumerate(words):
        starts = [0] if len(word) <= WINDOW else range(0, len(word) - WINDOW // 2, WINDOW // 2)
        for start in starts:
            part = word[start : start + WINDOW]
            places, parts = by_length.setdefault(len(part), ([], []))
            places.append(k)
            parts.append(part)
    for length, (places, parts) in by_length.items():
        if not length:
            continue
        points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).reshape(-1, length).astype(np.int32)
        plain = (points >= 97) & (points <= 122)
        codes = np.zeros((len(parts), length + 2), np.int32)
        codes[:, 1:-1] = np.where(plain, points - 96, 27 + mixed(points) % (ALPHABET - 27))
        yield np.array(places), codes


def mixed(points: np.ndarray) -> np.ndarray:
    """Code points spread by a multiplication, so that neighbours and shifted alphabets differ."""
    return ((points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int32)


def triples(length: int) -> Iterator[tuple[int, int, float]]:
    for k in range(2, min(SPAN, length - 1) + 1):
        for j in range(1, k):
            yield j, k, DECAY ** (k + 1)


def length_norm(length: int) -> float:
    return float(np.sqrt(sum((length - k) * w * w for _, k, w in triples(length)))) or 1.0


def code_of(codes: np.ndarray, j: int, k: int) -> np.ndarray:
    n = codes.shape[1] - k
    return (codes[:, :n] * ALPHABET + codes[:, j : j + n]) * ALPHABET + codes[:, k : k + n]


def table_scores(words: list[str], table: np.ndarray) -> np.ndarray:
    """The kernel map of every word times ``table``; the largest over the windows of a long word, 0 without letters."""
    out = np.full(len(words), -np.inf)
    for places, codes in coded(words):
        total = np.zeros(len(codes))
        for j, k, weight in triples(codes.shape[1]):
            total += weight * table[code_of(codes, j, k)].sum(axis=1)
        np.maximum.at(out, places, total / length_norm(codes.shape[1]))
    return np.where(np.isfinite(out), out, 0.0)


def table_sums(words: list[str], rows: np.ndarray) -> np.ndarray:
    """As ``table_scores`` for a table with several columns; of a long word, the first window counts."""
    out = np.zeros((len(words), rows.shape[1]))
    for places, codes in coded([w[:WINDOW] for w in words]):
        for start in range(0, len(codes), 500):
            part = codes[start : start + 500]
            total = np.zeros((len(part), rows.shape[1]), np.float32)
            for j, k, weight in triples(codes.shape[1]):
                total += np.float32(weight) * rows[code_of(part, j, k)].sum(axis=1)
            out[places[start : start + 500]] = total / length_norm(codes.shape[1])
    return out


def kernel_map(words: list[str]) -> np.ndarray:
    """Rows of three-letter subsequence weights; of a long word, those of its first window count."""
    out = np.zeros((len(words), ALPHABET**3), np.float32)
    for places, codes in coded([w[:WINDOW] for w in words]):
        for j, k, weight in triples(codes.shape[1]):
            found = code_of(codes, j, k)
            np.add.at(out, (places[:, None], found), np.float32(weight / length_norm(codes.shape[1])))
    return out


@dataclass
class Model:
    """One weight per three-letter subsequence, and the line from scores to probabilities."""

    table: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, worst: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * worst + self.offset, -30, 30))))


def squared_hinge(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by Newton steps; the last column of ``z`` is 1."""
    w = np.zeros(z.shape[1])
    hold = ridge * np.eye(z.shape[1])
    hold[-1, -1] = 1e-8
    active = np.ones(len(z), bool)
    for _ in range(30):
        za, wa = z[active], weight[active]
        w = np.linalg.solve(hold + (za * wa[:, None]).T @ za, (za * wa[:, None]).T @ y[active])
        now = y * (z @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


def fit(texts: list[str], toxic: list[int]) -> Model | None:
    """The machine from labelled documents; nothing if a class is missing."""
    number: dict[str, int] = {}
    bags, times = [], []
    for text in texts:
        counts = Counter(letters_of(w) for w in words_of(text))
        counts.pop("", None)
        bags.append(np.array([number.setdefault(w, len(number)) for w in counts], np.int32))
        times.append(np.array(list(counts.values()), np.int32))
    kinds = list(number)
    full = [k for k, bag in enumerate(bags) if len(bag)]
    bad, good = [bags[k] for k in full if toxic[k]], [bags[k] for k in full if not toxic[k]]
    if not bad or not good:
        return None
    in_bad, in_good = (np.bincount(np.concatenate(x), minlength=len(kinds)) for x in (bad, good))
    odds = np.log((in_bad + 0.1) / (len(bad) + 1)) - np.log((in_good + 0.1) / (len(good) + 1))
    by_word = np.array(sorted(range(len(kinds)), key=kinds.__getitem__))
    clean = by_word[np.argsort(-in_good[by_word], kind="stable")]
    clean = clean[(in_good[clean] > 0) & (odds[clean] <= TELLING)]
    telling = by_word[np.argsort(-in_bad[by_word], kind="stable")]
    telling = telling[(in_bad[telling] > 0) & (odds[telling] > TELLING)]
    common = clean[:WORDS]
    marks = [kinds[i] for i in [*telling[:LANDMARKS], *common[:: max(1, len(common) // LANDMARKS)][:LANDMARKS]]]
    maps = kernel_map(marks)
    values, vectors = np.linalg.eigh((maps @ maps.T).astype(np.float64))
    sure = values > 1e-6 * values[-1]
    rows = maps.T @ (vectors[:, sure] / np.sqrt(values[sure])).astype(np.float32)  # subsequence -> feature
    worst = lambda bag, score: bag[np.lexsort((bag, -score[bag]))[:3]]
    found = np.unique(np.concatenate([worst(bag, odds) for bag in bad]))
    chosen = found[(odds[found] > 0) & (in_bad[found] > 1)]
    positive, negative = chosen if len(chosen) else found, common
    for turn in range(TURNS):
        z = np.hstack([table_sums([kinds[i] for i in [*positive, *negative]], rows), np.ones((len(positive) + len(negative), 1))])
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        share = np.concatenate([in_bad[positive] / in_bad[positive].sum(), np.full(len(negative), 1 / len(negative))])
        w = squared_hinge(z, y, share, RIDGE)
        table, bias = rows.astype(np.float64) @ w[:-1], float(w[-1])
        score = np.concatenate([
            table_scores(kinds[i : i + STEP], table) for i in range(0, len(kinds), STEP)]) + bias
        if turn + 1 < TURNS:  # the words that the machine finds worst, and the clean ones that it finds bad
            found = np.unique(np.concatenate([worst(bag, score) for bag in bad]))
            chosen = found[(score[found] > 0) & (odds[found] > TELLING)]
            positive = chosen if len(chosen) else positive
            hard = clean[np.argsort(-score[clean], kind="stable")[:WORDS]]
            negative = np.union1d(common, hard)
    worsts = np.array([worst_of(list(zip(score[bags[k]].tolist(), times[k].tolist()))) for k in full])
    return Model(table.astype(np.float32), bias, *line_of(worsts, np.array([toxic[k] for k in full], float)))


def worst_of(scores: list[tuple[float, int]]) -> float:
    """The highest score, and for a part the second highest, as one odd word says less than two.

    ``scores`` has (score, places): a word that stands twice is first and second.
    """
    if not scores:
        return -1.0
    first, places = max(scores)
    second = first if places > 1 else max((s for s, _ in scores if s < first), default=-1.0)
    return FIRST * first + (1 - FIRST) * second


def line_of(worst: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """A steep line whose zero stands where it errs least, with both classes weighted alike, midway between neighbours."""
    order = np.argsort(worst)
    s, y = worst[order], labels[order]
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    errors = np.concatenate([[0], np.cumsum(weight * (y == 1))]) + np.concatenate([np.cumsum((weight * (y == 0))[::-1])[::-1], [0]])
    errors[1:-1][s[1:] == s[:-1]] = np.inf
    best = np.flatnonzero(errors == errors.min())
    cut = int(best[len(best) // 2])
    zero = s[0] - 1 if cut == 0 else s[-1] + 1 if cut == len(s) else (s[cut - 1] + s[cut]) / 2
    return 6.0, float(-6.0 * zero)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def fitted(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The machine fitted on at most ``SAMPLE`` documents of each label, drawn by a hash of the id; held-out ids never."""
    named = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    drawn = [
        named.where(F.col("toxic") == y).dropDuplicates().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for y in (0, 1)]
    picked = drawn[0].unionByName(drawn[1]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).where(
        F.length("text") <= SAMPLE_CHARS)
    found = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    once = found.groupBy("text").agg(F.max("toxic").alias("toxic"))  # at most 2 * SAMPLE rows
    rows = once.repartition(1).mapInArrow(fit_batches, MODEL).collect()
    return Model(np.frombuffer(rows[0].table, np.float32), *rows[0][1:]) if rows else None


def fit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sample is fitted in one task, and only the weights reach the driver."""
    rows = sorted((text, toxic) for batch in batches for text, toxic in zip(*[c.to_pylist() for c in batch.columns]))
    model = fit([r[0] for r in rows], [r[1] for r in rows])
    if model is not None:
        values = [model.table.tobytes(), model.bias, model.slope, model.offset]
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["table", "bias", "slope", "offset"])


def probabilities(texts: list, model: Model | None, known: dict[str, float]) -> list[float]:
    """The score of each text; ``known`` keeps the scores of words between calls."""
    bags = [Counter(words_of(text or "")) for text in texts]
    if model is None:
        return [0.0] * len(bags)
    if len(known) > CACHED:
        known.clear()
    new = list({w for bag in bags for w in bag if w not in known})
    known.update(zip(new, (table_scores([letters_of(w) for w in new], model.table) + model.bias).tolist()))
    return [model.probability(worst_of([(known[w], n) for w, n in bag.items()])) if bag else 0.0 for bag in bags]


def score_batches(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    known: dict[str, float] = {}
    for batch in batches:
        out: list[float] = []
        for start in range(0, batch.num_rows, TOGETHER):
            out += probabilities(batch.column("text")[start : start + TOGETHER].to_pylist(), model, known)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(out, pa.float64()), pa.array([int(x >= 0.5) for x in out], pa.int32())],
            names=["doc_id", "score", "predicted"])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``; only the text decides the score.

    Whole texts are scored. A text without words, or null, scores 0; so does everything if the labels lack a
    class. Labels that are null or neither 0 nor 1 are not learnt from; a document with both counts as toxic.
    Repeated rows score alike. A null id is never held out of scoring; its ``held_out`` is false.
    """
    model = fitted(docs, labels)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    scored = rows.mapInArrow(partial(score_batches, model=model), SCHEMA)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that are predicted toxic, all columns as they were.

    The score is computed beside the row in one pass, so that nothing is joined or moved.
    """
    return docs.mapInArrow(partial(clean_batches, model=fitted(docs, labels)), docs.schema)


def clean_batches(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    known: dict[str, float] = {}
    for batch in batches:
        for start in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(start, TOGETHER)
            yield part.filter(pa.array([p < 0.5 for p in probabilities(part.column("text").to_pylist(), model, known)], pa.bool_()))

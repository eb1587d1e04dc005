"""Ranked lexical search over whole documents: exact, with sums from short lists and skips over long ones.

Documents are indexed in blocks: per block, the postings of the terms that queries hold, and every document's length.
The statistics of the weights are summed over all blocks before any is searched. In a block, a query's short lists are
read term by term into accumulators. Their sums then stand as one list, with the largest sum as its bound, beside the
long lists, which are read document by document, a window at a time: lists whose bounds together stay under the k-th
score bring no candidates, and are only looked up for candidates that can still reach it. Bounds and scores are
integers, so the result is exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treespark.llm.common import UPPER, pieces_of, stored

#: Documents and postings of an index block, at most.
DOCS, POSTINGS = 4096, 1 << 20
#: A list is short if it holds at most this share of its block's documents; documents of a window; terms of a pass of queries.
SHORT, WINDOW, TERMS = 1 / 16, 1024, 1 << 18
#: The formula's fixed values: scale of weights, share of the length in the norm, scale and slope of the term frequency.
SCALE, B, TOP, SLOPE = 1000, 25, 1_000_000_000, 12
#: Every byte that is no term character becomes a space, A-Z become a-z.
TERM_BYTES = bytes(
    (b + 32 if chr(b) in UPPER else b) if b > 127 or chr(b).isalnum() else 32 for b in range(256))
INDEX = (
    "docs bigint, words bigint, held bigint, ids binary, lengths binary, terms array<int>, counts array<int>, places binary, tfs binary")


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, with repeats, about a megabyte of text at a time."""
    for piece in pieces_of(raw.translate(TERM_BYTES)):
        yield piece.split()


def index_batches(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Blocks of the index: per block its documents, their lengths, and the postings of the vocabulary's terms by term."""
    ids: list[int] = []
    lengths: list[int] = []
    held: list[tuple[int, int, int]] = []
    seen = [0, 0]
    known = vocabulary.keys()

    def block() -> pa.RecordBatch:
        term, place, tf = np.array(held, np.int64).reshape(-1, 3).T
        order = np.lexsort((place, term))
        distinct, counts = np.unique(term, return_counts=True)
        values = [
            [seen[0]], [seen[1]], [len(ids)], [np.array(ids, "<i8").tobytes()], [np.array(lengths, "<i8").tobytes()], [distinct.tolist()],
            [counts.tolist()], [place[order].astype("<i4").tobytes()], [tf[order].astype("<i8").tobytes()]]
        longs, ints = [pa.int64()] * 3, [pa.list_(pa.int32())] * 2
        kinds = [*longs, pa.binary(), pa.binary(), *ints, pa.binary(), pa.binary()]
        names = [f.split()[0] for f in INDEX.split(", ")]
        for rows in (ids, lengths, held):
            rows.clear()
        seen[:] = [0, 0]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=names)

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())):
            counts: Counter[bytes] = Counter()
            for words in terms_of(text.as_py() or b""):
                counts.update(words)
            n = counts.total()
            if not n:
                continue
            seen[0] += 1
            seen[1] += n
            # A document without an id counts in the statistics of all its terms; a length of zero keeps it from being ranked.
            held += [(vocabulary[t], len(ids), counts[t]) for t in known & counts.keys()]
            ids.append(-1 if doc_id is None else doc_id)
            lengths.append(0 if doc_id is None else n)
            if len(ids) >= DOCS or len(held) >= POSTINGS:
                yield block()
    if ids:
        yield block()


class Best:
    """The k best (score, id) so far, equal scores by smaller id, and the score that a newcomer has to reach."""

    def __init__(self, k: int) -> None:
        self.k, self.floor = k, 1
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        keep = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[keep], ids[keep]
        if len(keep) == self.k:
            self.floor = max(self.floor, int(self.scores[-1]))


class Block:
    """The lists of an index block: documents and what a term adds there, before its weight."""

    def __init__(self, row: dict, documents: int, words: int) -> None:
        self.ids = np.frombuffer(row["ids"], "<i8")
        lengths = np.frombuffer(row["lengths"], "<i8")
        places, tfs = np.frombuffer(row["places"], "<i4"), np.frombuffer(row["tfs"], "<i8")
        large = B * int(lengths.max(initial=0)) * documents >= 2**63
        norms = (100 - B) + (lengths.astype(object) if large else lengths) * (B * documents) // words
        gains = TOP * tfs // (SCALE * tfs + SLOPE * norms.astype(np.int64)[places])
        ranked = lengths[places] > 0
        ends = np.cumsum([0, *row["counts"]])
        self.lists = {
            t: (places[a:b][ranked[a:b]], gains[a:b][ranked[a:b]]) for t, a, b in zip(row["terms"], ends, ends[1:])}

    def search(self, weights: list[tuple[int, int]], best: Best) -> None:
        """Add the block's best documents for a query of (term, weight) to ``best``."""
        lists = [(docs, gains * w) for t, w in weights if w and t in self.lists for docs, gains in [self.lists[t]] if len(docs)]
        short = [x for x in lists if len(x[0]) <= SHORT * len(self.ids)]
        readers = [x for x in lists if len(x[0]) > SHORT * len(self.ids)]
        if short:
            sums = np.zeros(len(self.ids), np.int64)
            for docs, scores in short:
                sums[docs] += scores
            docs = np.flatnonzero(sums)
            scores = sums[docs]
            readers.append((docs, scores))
            if len(docs) >= best.k:  # so many documents have at least these sums
                best.floor = max(best.floor, int(np.partition(scores, len(docs) - best.k)[len(docs) - best.k]))
        readers = [(docs, scores, int(scores.max())) for docs, scores in readers if len(docs)]
        readers.sort(key=lambda r: r[2])
        bounds = np.cumsum([0, *[r[2] for r in readers]])
        for low in range(0, len(self.ids), WINDOW):
            passive = int(np.searchsorted(bounds, best.floor, "left")) - 1  # that many lists together stay under the floor
            if passive >= len(readers):
                return
            sums = np.zeros(min(WINDOW, len(self.ids) - low), np.int64)
            for docs, scores, _ in readers[passive:]:
                a, b = np.searchsorted(docs, (low, low + WINDOW))
                sums[docs[a:b] - low] += scores[a:b]
            places = np.flatnonzero(sums)
            found = sums[places]
            for k in reversed(range(passive)):
                able = found + bounds[k + 1] >= best.floor
                places, found = places[able], found[able]
                if not len(places):
                    break
                docs, scores, _ = readers[k]
                at = np.minimum(np.searchsorted(docs, places + low), len(docs) - 1)
                found = found + np.where(docs[at] == places + low, scores[at], 0)
            able = found >= best.floor
            if able.any():
                best.add(found[able], self.ids[places[able] + low])


def search_batches(
    batches: Iterator[pa.RecordBatch], queries: list[tuple[int, list[tuple[int, int]]]], documents: int, words: int, k: int
) -> Iterator[pa.RecordBatch]:
    """(query, doc_id, score): the k best documents of the task's blocks for each query."""
    best = {number: Best(k) for number, _ in queries}
    for batch in batches:
        for at in range(batch.num_rows):
            block = Block(batch.slice(at, 1).to_pylist()[0], documents, words)
            for number, weights in queries:
                block.search(weights, best[number])
    rows = [(number, b.ids, b.scores) for number, b in best.items() if len(b.ids)]
    numbers = np.concatenate([np.zeros(0, np.int64), *[np.full(len(ids), number) for number, ids, _ in rows]])
    columns = [numbers, *[np.concatenate([np.zeros(0, np.int64), *[r[i] for r in rows]]) for i in (1, 2)]]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "doc_id", "score"])


def weight(documents: int, holding: int) -> int:
    return math.floor(SCALE * math.log((2 * documents + 2) / (2 * holding + 1)))


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each item, scores above zero only.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. Equal scores stand by
    ascending doc_id. Null and empty texts hold no terms; such documents do not count, such items have no rows.
    Documents without an id count in the statistics and are never ranked. Rows that repeat an id are a document each.
    Items without an id are left out, rows that repeat an item and its text are one, and each text of an item has a
    ranking of its own. Empty tables give no rows.

    Items are searched in passes of about ``TERMS`` term occurrences, whose vocabulary goes to the tasks. Only
    a pass's numbers of documents per term reach the driver. A task returns k documents an item, merged in two steps.
    """
    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("text")).where("item_id is not null")
    numbered = stored(asked.distinct().withColumn("query", F.monotonically_increasing_id()).withColumn(
        "size", F.octet_length(F.coalesce("text", F.lit(""))) + 1))
    size = numbered.agg(F.sum("size")).first()[0] or 0
    passes = max(1, math.ceil(size / 4 / TERMS))  # a term and what follows it take two bytes at least, four or more in most texts
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    results = [found for p in range(passes) for found in [pass_over(rows, numbered.where(F.pmod(F.xxhash64("query"), F.lit(passes)) == p), k)] if found]
    near = results[0] if results else numbered.select("query", F.col("query").alias("doc_id"), F.col("query").alias("score")).where("false")
    for more in results[1:]:
        near = near.unionByName(more)
    near = near.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    order = (F.desc("score"), F.asc("doc_id"))
    for keys in (["query", "part"], ["query"]):
        near = near.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return near.join(numbered.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def pass_over(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame | None:
    """(query, doc_id, score) of the queries of one pass, k of each task; nothing if there is nothing to find."""
    queries = [
        (r.query, Counter(w for words in terms_of((r.text or "").encode()) for w in words)) for r in asked.select("query", "text").collect()]
    vocabulary = {t: n for n, t in enumerate(sorted({t for _, counts in queries for t in counts}))}
    if not vocabulary:
        return None
    index = stored(rows.mapInArrow(partial(index_batches, vocabulary=vocabulary), INDEX))
    sums = index.agg(F.sum("docs").alias("documents"), F.sum("words").alias("words")).first()
    if not sums.words:
        return None
    holding = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("n"))
    weights = {r.terms: weight(sums.documents, r.n) for r in holding.collect()}
    asked_for = [
        (number, [(vocabulary[t], n * weights[vocabulary[t]]) for t, n in sorted(counts.items()) if vocabulary[t] in weights])
        for number, counts in queries]
    work = partial(search_batches, queries=asked_for, documents=sums.documents, words=sums.words, k=k)
    return index.mapInArrow(work, "query bigint, doc_id bigint, score bigint")

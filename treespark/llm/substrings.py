"""Substring dedup over sliding runs of sentences.

Every run of ``RUN`` consecutive sentences, or of as many more as have ``LEAST_WORDS`` words, is hashed and all runs of the
corpus are joined by hash. The first place of a run,
by document and position, stays; sentences that any later place covers are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treespark.llm.bits import maybe_among
from treespark.llm.common import attach, keyed, stored

RUN, LEAST_WORDS = 3, 12
#: A sentence of more words is cut after some of them, chosen by their hash: one in CUT words from the third on, about
#: every fifth in all, and after MOST words if none is chosen.
LONG, CUT, MOST = 12, 3, 15
END = re.compile(rb"[.!?][.!?]*(?=[\x20\x09-\x0D])[\x20\x09-\x0D]*|[\n\r][\x20\x09-\x0D]*")
IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Stands for a null id, before all others.
NO_ID = -(2**63)
RUNS = "doc_id bigint, key bigint, runs array<struct<at:int,till:int,hi:bigint,lo:bigint>>"
CHANGED = (
    "doc_id bigint, key bigint, n_sentences bigint, n_removed bigint, spans string, first_doc_ids array<bigint>, text string")


def sentences(raw: bytes) -> list[tuple[int, int, bytes, int]]:
    """(start, end, words joined by a space, number of words) of each sentence, white space behind it included.

    Cuts of long sentences depend on the words alone; where no word is chosen among ``MOST``, on where the cut before is.
    """
    low = raw.lower()
    spaces = IS_SPACE[np.frombuffer(raw, np.uint8)]
    begins = np.flatnonzero(~spaces & np.concatenate([[True], spaces[:-1]])[: len(spaces)]).tolist() + [len(raw)]
    out: list[tuple[int, int, bytes, int]] = []
    start = seen = 0
    for end in [m.end() for m in END.finditer(raw)] + [len(raw)]:
        words = low[start:end].split()
        n = len(words)
        if n > LONG:
            cut_long(start, end, words, begins[seen + 1 : seen + n], out)
        elif n:
            out.append((start, end, b" ".join(words), n))
        start, seen = end, seen + n
    return out


def cut_long(start: int, end: int, words: list[bytes], begins: list[int], out: list[tuple[int, int, bytes, int]]) -> None:
    """Add the parts of a long sentence to ``out``; ``begins`` are those of its words but the first."""
    digest = xxhash.xxh32_intdigest
    first = 0
    for k, chosen in enumerate([digest(w) % CUT == 0 for w in words], 1):
        if k - first > 2 and chosen or k - first >= MOST:
            border = begins[k - 1] if k < len(words) else end
            out.append((start, border, b" ".join(words[first:k]), k - first))
            start, first = border, k
    if first < len(words):
        out.append((start, end, b" ".join(words[first:]), len(words) - first))


def reaches(sizes: list[int]) -> list[tuple[int, int]]:
    """(start, end) of the least runs of ``RUN`` sentences and ``LEAST_WORDS`` words from each start and to each end.

    Together they cover all of any stretch that has as many. A text of fewer sentences is one run.
    """
    run, n = min(RUN, len(sizes)), len(sizes)
    found: set[tuple[int, int]] = set()
    till = held = 0
    for start in range(n):
        while till < n and (till - start < run or held < LEAST_WORDS):
            held += sizes[till]
            till += 1
        if till - start < run or held < LEAST_WORDS:
            break
        found.add((start, till))
        held -= sizes[start]
    start = held = 0
    for till in range(1, n + 1):
        held += sizes[till - 1]
        while till - start > run and held - sizes[start] >= LEAST_WORDS:
            held -= sizes[start]
            start += 1
        if till - start >= run and held >= LEAST_WORDS:
            found.add((start, till))
    return sorted(found)


def runs_of(raw: bytes) -> tuple[list[tuple[int, int]], bytes]:
    """(first, end) of the runs of a text, and their 128-bit hashes one after another."""
    hashes, sizes = [], []
    for _, _, words, n in sentences(raw):
        hashes.append(xxhash.xxh3_128_digest(words))
        sizes.append(n)
    spans = reaches(sizes)
    joined, digest = b"".join(hashes), xxhash.xxh3_128_digest
    return spans, b"".join([digest(joined[16 * start : 16 * till]) for start, till in spans])


def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["at", "till", "hi", "lo"]
    for batch in batches:
        found = [runs_of(text.as_py() or b"") for text in batch.column("text").cast(pa.binary())]
        offsets = np.cumsum([0, *[len(spans) for spans, _ in found]])
        span = np.array(list(chain.from_iterable(spans for spans, _ in found)), np.int32).reshape(-1, 2)
        half = np.frombuffer(b"".join(hashes for _, hashes in found), ">i8").astype(np.int64).reshape(-1, 2)
        fields = pa.StructArray.from_arrays([pa.array(c) for c in (span[:, 0], span[:, 1], half[:, 0], half[:, 1])], names)
        runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), fields)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), runs], names=["doc_id", "key", "runs"])


def change_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in CHANGED.split(", ")]
    types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.string()]
    for batch in batches:
        rows = []
        columns = [batch.column(n) for n in ("doc_id", "key", "text", "places", "firsts")]
        for i in range(batch.num_rows):
            doc_id, key, text, places, firsts = [c[i].as_py() for c in columns]
            raw = text.encode()
            n, n_gone, spans, kept, at = 0, 0, [], [], 0
            gone = {k for p in places for k in range(p["at"], p["till"])}
            for start, end, _, _ in sentences(raw):
                if n in gone:
                    n_gone += 1
                    kept.append(raw[at:start])
                    at = end
                    if spans and spans[-1][1] == start:
                        spans[-1][1] = end
                    else:
                        spans.append([start, end])
                n += 1
            kept.append(raw[at:])
            points = lambda b: len(raw[:b].decode())
            told = ",".join(f"{points(s)}:{points(e)}" for s, e in spans)
            rows.append((doc_id, key, n, n_gone, told, sorted(x for x in firsts if x is not None), b"".join(kept).decode()))
        columns = zip(*rows) if rows else [[] for _ in types]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, key, places, firsts): per document the stretches of runs that an earlier place has too, and whose those are."""
    arrays = stored(keyed(docs).mapInArrow(run_batches, RUNS))
    runs = arrays.select("doc_id", "key", F.explode("runs").alias("r")).select("doc_id", "key", "r.*")
    # Only hashes, counts and least ids move for all runs. A null id stands for the least there is.
    runs = runs.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    groups = stored(runs.groupBy("hi", "lo").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).where("n > 1").select(
        F.struct("hi", "lo").alias("run"), "low", "n"))
    # A run has at most LEAST_WORDS sentences, so its place and length move as one small number.
    width = LEAST_WORDS + 1
    place = F.col("at").cast("bigint") * width + F.col("till") - F.col("at")
    told = runs.select("doc_id", "key", place.alias("place"), F.struct("hi", "lo").alias("run"))
    at = F.expr(f"cast(place div {width} as int)")
    till = F.expr(f"cast(place div {width} + place % {width} as int)")
    # A place in a later document goes whatever its run is, so only the others keep it.
    placed = stored(attach(told, groups, "run", "n", F.col("key"), "inner").select(
        "doc_id", "key", at.alias("at"), till.alias("till"), "low", F.when(F.col("doc_id") == F.col("low"), F.col("run")).alias("run")))
    # Places in later documents go. In the document with the least id the first place is left alone.
    later = placed.where("doc_id > low").select("doc_id", "key", "at", "till", "low")
    place = F.struct("key", "at")
    firsts = stored(placed.where("doc_id = low").groupBy("run").agg(F.min(place).alias("first"), F.count("*").alias("own")).where("own > 1"))
    own = attach(placed.where("doc_id = low"), firsts, "run", "own", F.col("key"), "inner").where(place != F.col("first"))
    gone = later.unionByName(own.select("doc_id", "key", "at", "till", "low"))
    return gone.groupBy("doc_id", "key").agg(
        F.collect_set(F.struct("at", "till")).alias("places"), F.collect_set(F.nullif("low", F.lit(NO_ID))).alias("firsts"))


def changes(docs: DataFrame) -> DataFrame:
    """``substring_dedup`` with the key of each document before it was changed."""
    gone = stored(repeated_runs(docs))
    few = keyed(docs).where(F.col("text").isNotNull() & maybe_among(gone, "key", F.col("key")))
    told = few.withColumn("_id", F.coalesce("doc_id", F.lit(NO_ID))).join(
        gone.withColumnRenamed("doc_id", "_id").hint("merge"), ["_id", "key"])
    return told.select("doc_id", "key", "text", "places", "firsts").mapInArrow(change_batches, CHANGED)


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` that loses sentences: what goes, whose sentences it repeats, and the text that stays.

    Sentences end at . ! or ? before white space, or at a line end; long ones are cut by their words. They are equal if
    their words are, A-Z lowered. A run has ``RUN`` sentences and ``LEAST_WORDS`` words at least; a text of fewer than
    ``RUN`` sentences is one run. ``spans`` are start:end of removed stretches in code points, ``first_doc_ids`` the
    documents in which their runs stand first: by id, then that hash, then position, so a repeat within a text
    goes too. A document is told by its id and a hash of id and text; rows that repeat both are one document, changed alike. A null id
    comes first. Null and empty texts have no sentences. An empty table gives no rows.
    """
    return changes(docs).drop("key")


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of every row of ``docs`` with the repeated sentences left out.

    Rows that share an id but not the text are told apart, rows that repeat both change alike, a null id is an id like others.
    """
    changed = changes(docs).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), "key", F.lit(True).alias("_new"), F.col("text").alias("_text")).dropDuplicates(["_id", "key"])
    joined = keyed(docs).withColumn("_id", F.coalesce("doc_id", F.lit(NO_ID))).join(changed, ["_id", "key"], "left")
    return joined.select("doc_id", F.when(F.col("_new"), F.col("_text")).otherwise(F.col("text")).alias("text"))

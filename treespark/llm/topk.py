"""Exact top-k search by inner product, with aggregation of sorted lists that needs no random access.

Vectors are packed into blocks of rows and queries into smaller ones, and every pair of blocks is one row of a join. In a
pair, each component is a list of the block's vectors sorted by what they add to the score. The lists are read in
step, some entries of all at a time: what a vector has shown so far plus the least that the rest can add is its lower
bound, plus the last entries read its upper one. A query stops reading when few vectors can still reach the k-th lower
bound; their scores are then resolved. Whatever is read, the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treespark.llm.common import stored

VECTORS, QUERIES, SCALE = 4096, 512, 1024
#: Slots that blocks of vectors are dealt to, each block its own up to so many, and then so many blocks a slot.
SLOTS, DEALT = 64, 8
#: Parts of the lists after which bounds are compared, and how many times k vectors may be left to resolve.
DEPTHS, LEFT = (0.25, 0.5, 0.75, 0.875, 1.0), 8
BLOCK = "dim int, ids binary, parts binary"


def whole_components(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Blocks of at most ``rows`` vectors of one length: ids and components floor(1024 x), as bytes."""
    held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

    def block(dim: int) -> pa.RecordBatch:
        ids, vectors = held.pop(dim)
        scaled = np.floor(SCALE * np.array(vectors, np.float64).reshape(len(ids), dim))
        largest = np.abs(scaled).max(initial=0)
        if largest * largest * max(1, dim) >= 2**63:
            raise OverflowError("scores of components this large do not fit 64 bits")
        parts = scaled.astype("<i8")
        return pa.RecordBatch.from_arrays(
            [pa.array([dim], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([parts.tobytes()], pa.binary())],
            names=["dim", "ids", "parts"])

    for batch in batches:
        for vec_id, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
            if vec_id is None or not vector.is_valid or vector.values.null_count:
                continue
            values = vector.values.to_numpy(zero_copy_only=False)
            if not np.isfinite(values).all():
                continue
            ids, vectors = held.setdefault(len(values), ([], []))
            ids.append(vec_id)
            vectors.append(values)
            if len(ids) == rows:
                yield block(len(values))
    for dim in list(held):
        yield block(dim)


def best_of_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query, vector, score): per query the k best of the block, of equal scores the smaller ids."""
    n, dim = x.shape
    own = query_ids[:, None] == ids[None, :]
    widest = float((np.abs(q).astype(np.float64) @ np.abs(x).max(axis=0, initial=0).astype(np.float64)).max(initial=0))
    kind = np.float32 if 4 * widest < 2**24 else np.float64 if 4 * widest < 2**53 else np.int64
    order = np.argsort(x, axis=0, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n)[:, None], axis=0)
    ascending = np.take_along_axis(x, order, axis=0).astype(kind)
    values, queries = x.astype(kind), q.astype(kind)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    least, most = ascending[0], ascending[-1]
    active = np.arange(len(q))
    lower = np.repeat((up @ least + down @ most)[:, None], n, axis=1)
    read = 0
    for depth in DEPTHS:
        until = n if depth == 1 else int(n * depth)
        if until <= read:
            continue
        from_top, from_bottom = place >= n - until, place < until
        lower += up[active] @ ((values - least) * (from_top & (place < n - read))).T
        lower += down[active] @ ((values - most) * (from_bottom & (place >= read))).T
        read = until
        upper = lower + (up[active] * (ascending[n - until] - least)) @ (~from_top).T.astype(kind)
        upper += (down[active] * (ascending[until - 1] - most)) @ (~from_bottom).T.astype(kind)
        low = np.where(own[active], lower.min(initial=0) - 1, lower)
        reached = np.partition(low, n - k, axis=1)[:, n - k] if n > k else low.min(axis=1)
        qualified = (upper >= reached[:, None]) & ~own[active]
        done = (qualified.sum(axis=1) <= LEFT * k) | (until == n)
        for row in np.flatnonzero(done):
            at = active[row]
            left = np.flatnonzero(qualified[row])
            scores = x[left] @ q[at]
            for i in np.lexsort((ids[left], -scores))[:k]:
                yield int(query_ids[at]), int(ids[left[i]]), int(scores[i])
        active, lower = active[~done], lower[~done]
        if not len(active):
            return


def best_batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            dim = batch.column("dim")[row].as_py()
            side = lambda name: (
                np.frombuffer(batch.column(f"{name}ids")[row].as_py(), "<i8"),
                np.frombuffer(batch.column(f"{name}parts")[row].as_py(), "<i8"))
            (ids, parts), (query_ids, query_parts) = side(""), side("q_")
            found = list(best_of_block(ids, parts.reshape(len(ids), dim), query_ids, query_parts.reshape(len(query_ids), dim), k))
            columns = zip(*found) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of each query among all vectors but its own id's.

    Components are floor(1024 x) and scores their integer inner products; of equal scores the smaller id is
    first. Vectors that are null, or hold null or non-finite components, take no part, nor do null ids. Vectors of
    different lengths are never compared. Rows that repeat an id and vector are a candidate each, and one query. A
    query with fewer candidates gets all of them, one without any has no row; empty tables give no rows. Components so
    large that a score could leave 64 bits (about a million times a million) raise an error.

    Query blocks go to every slot of up to ``DEALT`` blocks of vectors or so, by a merge: copied for the slots they are
    larger than any estimate of them, so they are never broadcast. Vectors move once. A block has a bounded size,
    whatever ids or vectors repeat.
    """
    columns = [F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")]
    blocks = stored(vectors.select(*columns).mapInArrow(partial(whole_components, rows=VECTORS), BLOCK))
    asked = queries.select(*columns).dropDuplicates()
    few = stored(asked.mapInArrow(partial(whole_components, rows=QUERIES), BLOCK))
    number = blocks.count()
    slots = max(1, min(number, SLOTS), number // DEALT)
    placed = blocks.withColumn("slot", F.pmod(F.xxhash64("ids"), F.lit(slots)))
    sent = few.select(
        F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("parts").alias("q_parts"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slots - 1).cast("bigint"))).alias("q_slot"))
    pairs = placed.hint("merge").join(sent, (F.col("slot") == F.col("q_slot")) & (F.col("dim") == F.col("q_dim")))
    near = pairs.select("dim", "ids", "parts", "q_ids", "q_parts").mapInArrow(
        partial(best_batches, k=k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

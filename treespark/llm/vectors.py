"""Near-dedup of embeddings: random-hyperplane signs in several tables, exact cosines, connected components.

The sign of a vector's product with a random hyperplane agrees between two vectors with a chance of 1 - angle / pi. A
table packs some signs into a bucket; their number follows the number of vectors, and the number of tables makes a pair
at the threshold meet in some table with a chance of ``RECALL`` at every size. Buckets only propose pairs: every
link is a cosine in double precision.

Equal vectors are one class, so copies are never paired. A bucket is compared in matrix products. Larger buckets are
dealt into parts, and every two parts meet in a cell of their own, so that no task holds a whole hot bucket. Links are
counted in the first table where their pair meets, and a cell tells sums and a tree of links, never pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treespark.llm.common import attach, components, stored

THRESHOLD, RECALL, SEED = 0.95, 0.999, 42
#: Vectors of a part of a bucket, about; vectors of a bucket up to which shifted rows are compared; rows of a matrix product.
PART, SMALL, ROWS = 2048, 12, 128
#: Low bits of a bucket that hold the number of its table.
TABLE_BITS = 12


def plan(vectors: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Signs of a table and number of tables for so many distinct vectors."""
    bits = max(8, math.ceil(math.log2(max(2, vectors))) + 1)
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - meet))


def usable_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row its id, and of vectors that can link: length, a 128-bit key of the values, and the vector scaled to length one."""
    for batch in batches:
        lists = batch.column("embedding")
        values = lists.flatten()
        ends = np.cumsum([0, *[n or 0 for n in pc.list_value_length(lists).to_pylist()]])
        flat = values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
        found: list[tuple] = []
        for a, b in zip(ends, ends[1:]):
            x = flat[a:b]
            largest = float(np.abs(x).max(initial=0))
            if not largest or not math.isfinite(largest):  # a null component is not a number here
                found.append((None, None, None))
                continue
            unit = x / largest
            unit /= math.sqrt(unit @ unit)
            found.append((len(x), hashlib.md5(x.tobytes()).digest(), unit.astype("<f8").tobytes()))
        cells = zip(*found) if found else [()] * 3
        kinds = (pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), *[pa.array(c, k) for c, k in zip(cells, kinds)]], names=["vec_id", "dim", "class", "unit"])


def signed_batches(batches: Iterator[pa.RecordBatch], bits: int, tables: int) -> Iterator[pa.RecordBatch]:
    """(v, signs, buckets): the packed signs of all tables, and a bucket per table."""
    width = -(-bits // 8)
    planes: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        signs = np.zeros((len(dims), tables * width), np.uint8)
        buckets = np.zeros((len(dims), tables), np.int64)
        units = batch.column("unit").to_pylist()
        for dim in np.unique(dims).tolist():
            own = np.flatnonzero(dims == dim)
            if dim not in planes:
                planes[dim] = np.random.default_rng([SEED, dim]).standard_normal((dim, tables * bits))
            x = np.frombuffer(b"".join(units[i] for i in own), "<f8").reshape(len(own), dim)
            above = np.pad(((x @ planes[dim]) > 0).reshape(len(own), tables, bits), ((0, 0), (0, 0), (0, width * 8 - bits)))
            packed = np.packbits(above, axis=2, bitorder="little")
            signs[own] = packed.reshape(len(own), -1)
            value = np.zeros((len(own), tables), np.int64)
            for k in range(width):
                value |= packed[:, :, k].astype(np.int64) << (8 * k)
            buckets[own] = (value << TABLE_BITS) + np.arange(tables)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(dims) + 1) * tables, pa.int32()), pa.array(buckets.ravel(), pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("v"), pa.array([s.tobytes() for s in signs], pa.binary()), flat], names=["v", "signs", "buckets"])


def near_pairs(x: np.ndarray, group: np.ndarray, side: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group at the threshold or above; rows of a group of two sides pair across the sides only."""
    starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    ends = np.append(starts[1:], len(group))
    crossed = np.array([side[a:b].any() for a, b in zip(starts, ends)])
    small = np.repeat((ends - starts <= SMALL) & ~crossed, ends - starts)
    for shift in range(1, SMALL):
        a = np.flatnonzero((group[:-shift] == group[shift:]) & small[:-shift]) if shift < len(group) else np.zeros(0, int)
        near = np.einsum("ij,ij->i", x[a], x[a + shift]) >= threshold
        yield a[near], a[near] + shift
    for k in np.flatnonzero((ends - starts > SMALL) | crossed):
        rows = np.arange(starts[k], ends[k])
        left, right = (rows[side[rows] == 0], rows[side[rows] == 1]) if crossed[k] else (rows, rows)
        for at in range(0, len(left), ROWS):
            some = left[at : at + ROWS]
            i, j = np.nonzero(x[some] @ x[right].T >= threshold)
            a, b = some[i], right[j]
            yield (a, b) if crossed[k] else (a[a < b], b[a < b])


def joined_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links (a, b): of rows that are linked, the smallest."""
    while len(a):
        before = labels.copy()
        low = np.minimum(labels[a], labels[b])
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        labels = labels[labels]
        if (labels == before).all():
            break
    return labels


def compared(keys: np.ndarray, side, v, n, x, signs, tables: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, root, links) as numbers of vectors: those linked by the groups, whom they are tied to and whom they meet here first."""
    group = np.cumsum(np.append(0, (keys[1:] != keys[:-1]).any(axis=1)))
    table = keys[:, 0] & ((1 << TABLE_BITS) - 1)
    links, labels = np.zeros(len(v), np.int64), np.arange(len(v))
    parts = signs.reshape(len(v), tables, -1)
    for a, b in near_pairs(x, group, side, threshold):
        first = (parts[a] == parts[b]).all(axis=2).argmax(axis=1) == table[a]
        np.add.at(links, a[first], n[b[first]])
        np.add.at(links, b[first], n[a[first]])
        labels = joined_labels(labels, a, b)
    told = np.flatnonzero((links > 0) | (labels != np.arange(len(v))))
    return v[told], v[labels[told]], links[told]


KEYS = ("bucket", "i", "j", "dim")


def compared_batches(batches: Iterator[pa.RecordBatch], tables: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Compares the groups of rows that stand together; the last group of a batch waits for the next."""
    held: list[pa.RecordBatch] = []

    def told(rows: pa.Table) -> pa.RecordBatch:
        numbers = {c: rows.column(c).to_numpy() for c in (*KEYS, "side", "v", "n")}
        out: list[tuple] = []
        for dim in np.unique(numbers["dim"]).tolist():
            own = np.flatnonzero(numbers["dim"] == dim)
            one = rows.take(pa.array(own))
            x = np.frombuffer(b"".join(one.column("unit").to_pylist()), "<f8").reshape(len(own), dim)
            signs = np.frombuffer(b"".join(one.column("signs").to_pylist()), np.uint8).reshape(len(own), -1)
            keys = np.stack([numbers[c][own] for c in KEYS], axis=1)
            out.append(compared(keys, numbers["side"][own], numbers["v"][own], numbers["n"][own], x, signs, tables, threshold))
        columns = [np.concatenate([np.zeros(0, np.int64), *[o[k] for o in out]]) for k in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["v", "root", "links"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in KEYS], axis=1)
        last = np.flatnonzero((keys != keys[-1]).any(axis=1))
        cut = int(last[-1]) + 1 if len(last) else 0
        if held and (cut or any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in KEYS)):
            yield told(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        elif cut:
            yield told(pa.Table.from_batches([batch.slice(0, cut)]))
        held.append(batch.slice(cut))
    if held:
        yield told(pa.Table.from_batches(held))


def cells(size: Column) -> Column:
    """The cells (i, j) of a bucket that hold the row's part: its own part, and its part with each other one."""
    parts = F.ceil(size / PART).cast("int")
    part = F.pmod(F.xxhash64("v", "bucket"), parts.cast("bigint")).cast("int")
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda other: F.struct(
        F.least(part, other).alias("i"), F.greatest(part, other).alias("j"), (part > other).cast("int").alias("side")))


def near_dedup(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``.

    Rows are linked at a cosine of ``threshold`` or more, in double precision; ``n_links`` counts the other rows linked
    directly, ``component_id`` is the smallest id that links reach, and the row that has it is kept. Vectors that are null,
    empty, zero, or hold null or non-finite components link with nothing, and vectors of different lengths never link.
    Rows that repeat an id are vectors of their own. A row without an id links like any other, names no component and is
    never kept; its component is null if all reached have none. An empty table gives no rows.

    Vectors move to the buckets in which they are not alone. A pair at the threshold is missed with a chance of
    1 - ``RECALL``, a closer one with less.
    """
    rows = stored(vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(
            usable_batches, "vec_id bigint, dim int, class binary, unit binary"))
    classes = stored(rows.where("class is not null").groupBy("class", "dim").agg(
        F.min("unit").alias("unit"), F.count("*").alias("n"), F.min("vec_id").alias("low")).withColumn("v", F.monotonically_increasing_id()))
    bits, tables = plan(classes.count(), threshold)
    if bits + TABLE_BITS > 62 or tables >= 1 << TABLE_BITS:
        raise ValueError(f"{bits} signs in {tables} tables do not fit a bucket")
    signed = stored(classes.select("v", "dim", "unit").mapInArrow(
        partial(signed_batches, bits=bits, tables=tables), "v bigint, signs binary, buckets array<bigint>"))
    keyed = signed.select("v", F.explode("buckets").alias("bucket"))
    buckets = stored(keyed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    members = attach(keyed, buckets, "bucket", "size", F.col("v"), "inner")
    dealt = members.select("bucket", "v", F.explode(cells(F.col("size"))).alias("cell")).select("bucket", "cell.*", F.col("v").alias("_v"))
    whole = classes.select("v", "dim", "n", "unit").join(signed.select(F.col("v").alias("_s"), "signs").hint("merge"), F.col("v") == F.col("_s"))
    filled = dealt.join(whole.hint("merge"), F.col("_v") == F.col("v")).select(
        "bucket", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.col("dim").cast("bigint").alias("dim"), "side", "v", "n",
        "unit", "signs")
    met = stored(filled.repartition("bucket", "i", "j", "dim").sortWithinPartitions(*KEYS).mapInArrow(
        partial(compared_batches, tables=tables, threshold=threshold), "v bigint, root bigint, links bigint"))
    reach = components(met.where("v <> root").select(F.col("v").alias("a"), F.col("root").alias("b")).distinct())
    counts = met.groupBy(F.col("v").alias("_c")).agg(F.sum("links").alias("links"))
    placed = stored(classes.select("v", "class", "n", "low").join(counts.hint("merge"), F.col("v") == F.col("_c"), "left").join(
        reach.withColumnRenamed("v", "_r").hint("merge"), F.col("v") == F.col("_r"), "left").select(
            "class", "n", "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "v").alias("component")))
    names = stored(placed.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("size")))
    named = stored(attach(placed, names, "component", "size", F.col("class")).select("class", "n", "n_links", "component_id"))
    return attach(rows.select("vec_id", "class"), named, "class", "n", F.col("vec_id")).select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

"""SimHash near-dedup with covering locality-sensitive hashing.

Every bit position gets a non-zero vector of three bits; table v of 1..7 masks out the positions whose vector
has an odd product with v. Any two positions are orthogonal to a common v, so fingerprints that differ in two
bits or fewer agree on the bits that table keeps: every pair within the radius collides in some table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treespark.llm.common import attach, components, pieces_of, stored

BITS, RADIUS = 64, 2
#: Fingerprints of a bucket up to which its pairs are compared; larger buckets are linked over midpoints.
PAIRED = 32
#: Words of a shingle of near copies; tables of least shingle hashes, and hashes of each: at a similarity of 0.8 a pair
#: meets in one with a chance of 1 - (1 - 0.8**4)**16 = 0.9998.
WIDE, TABLES, LEAST = 5, 16, 4
#: Documents of a large bucket that are compared with each other, about.
DEALT = 8
#: Turns of dealing before the links left in large buckets are sought by differences; holders of one in a part of that.
TURNS, LEFT = 3, 256
#: Hashes up to which bits are counted one by one.
FEW = 4096
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def masks(radius: int = RADIUS) -> list[int]:
    """The kept bits of each covering table, as signed 64-bit numbers."""
    width = radius + 1
    vectors = [1 + i % (2**width - 1) for i in range(BITS)]
    kept = [sum(1 << i for i, m in enumerate(vectors) if bin(m & v).count("1") % 2 == 0) for v in range(1, 2**width)]
    return [k - 2**BITS if k >= 2 ** (BITS - 1) else k for k in kept]


def hashes_of(raw: bytes, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of every run of ``shingle`` words of a lower-cased text, some thousands at a time."""
    tail: list[bytes] = []
    any_run = False
    for piece in pieces_of(raw):
        words = tail + piece.split()
        runs = len(words) - shingle + 1
        if runs > 0:
            any_run = True
            shifted = zip(*[words[k : k + runs] for k in range(shingle)])
            digest = xxhash.xxh64_intdigest
            yield np.fromiter((digest(b" ".join(run), seed) for run in shifted), np.uint64, runs)
        tail = words[max(0, runs) :]
    if not any_run and tail:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(tail), seed)], np.uint64)


def word_hashes(raw: bytes) -> np.ndarray:
    """XXH64 of the distinct words of a text."""
    words: set[bytes] = set()
    for piece in pieces_of(raw):
        words.update(piece.split())
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def stirred(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Other hashes of the same things, one set per seed."""
    z = hashes + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**BITS)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit."""
    parts = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    if len(parts) < FEW:
        return np.unpackbits(parts, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.concatenate([np.bincount(parts[:, k], minlength=256) @ BYTE_BITS for k in range(8)])


def fingerprint(groups: Iterable[np.ndarray]) -> int:
    """The 64-bit fingerprint, as a signed number: a bit is set if it is set in over half of the hashes."""
    total, counts = 0, np.zeros(BITS, np.int64)
    for hashes in groups:
        total += len(hashes)
        counts += bit_counts(hashes)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<i8")[0])


def fingerprint_batches(batches: Iterator[pa.RecordBatch], shingle: int, seeds: tuple[int, ...], distinct_words: bool):
    for batch in batches:
        prints = []
        for text in batch.column("text").cast(pa.binary()):
            raw = (text.as_py() or b"").lower()
            if distinct_words:
                hashes = word_hashes(raw)
                prints.append([fingerprint([stirred(hashes, seed)]) for seed in seeds])
            else:
                prints.append([fingerprint(hashes_of(raw, shingle, seed)) for seed in seeds])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(prints, pa.list_(pa.int64()))], names=["doc_id", "prints"])


def fingerprints(docs: DataFrame, shingle: int = 3, seeds: tuple[int, ...] = (42,), distinct_words: bool = False) -> DataFrame:
    """(doc_id, prints): one fingerprint per seed, over runs of words or over the set of words.

    Whole texts are read, a megabyte at a time. A null or empty text has the fingerprint zero.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    work = partial(fingerprint_batches, shingle=shingle, seeds=seeds, distinct_words=distinct_words)
    return rows.mapInArrow(work, "doc_id bigint, prints array<bigint>")


def shingles(raw: bytes) -> np.ndarray:
    """Hashes of the distinct runs of ``WIDE`` words of a lower-cased text; a shorter text is one run."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes_of(raw, WIDE, 0)]))


FACTORS = stirred(np.arange(TABLES * LEAST, dtype=np.uint64), 1) | np.uint64(1)


def least_keys(found: np.ndarray) -> list[int]:
    """One key per table: the least of the shingle hashes, as ``LEAST`` permutations order them."""
    if not len(found):
        return []
    lows = np.array([(found * c).min() for c in FACTORS], "<u8").reshape(TABLES, LEAST)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(lows)]
    return [k - 2**64 if k >= 2**63 else k for k in keys]


def near_batches(batches: Iterator[pa.RecordBatch], seeds: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints, keys = [], []
        for text in batch.column("text").cast(pa.binary()):
            raw = (text.as_py() or b"").lower()
            words = word_hashes(raw)
            prints.append([fingerprint([stirred(words, seed)]) for seed in seeds])
            keys.append(least_keys(shingles(raw)))
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(prints, longs), pa.array(keys, longs)], names=["doc_id", "prints", "keys"])


def shingle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles((text.as_py() or b"").lower()).view(np.int64) for text in batch.column("text").cast(pa.binary())]
        offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
        values = pa.array(np.concatenate([np.zeros(0, np.int64), *found]), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "grams"])


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (k, fp, v) of equal k that connect the same as all pairs at two or
    fewer differing bits do.

    Buckets of up to ``PAIRED`` fingerprints compare their pairs. In larger ones each fingerprint names itself and
    its 64 neighbours at one bit: two fingerprints are within two bits exactly if they name a common point, and
    no point is named by more than 65. Members of a point are linked to its smallest, so links stay linear.
    """
    tables = F.array(*[F.xxhash64("k", F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(masks())])
    keyed = prints.select("k", "fp", "v", F.explode(tables).alias("bucket"))
    buckets = stored(keyed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    members = stored(attach(keyed, buckets, "bucket", "size", F.col("fp"), "inner"))
    close = lambda x, y: (x["k"] == y["k"]) & (F.bit_count(x["fp"].bitwiseXOR(y["fp"])) <= RADIUS)
    grouped = members.where(F.col("size") <= PAIRED).groupBy("bucket").agg(
        F.sort_array(F.collect_set(F.struct("k", "fp", "v"))).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x, i: F.transform(
        F.filter(F.slice("m", i + 2, F.size("m")), lambda y: close(x, y)), lambda y: F.struct(x["v"].alias("a"), y["v"].alias("b")))))
    small = grouped.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    points = F.transform(
        F.sequence(F.lit(-1), F.lit(BITS - 1)),
        lambda k: F.when(k < 0, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), k))))
    large = members.where(F.col("size") > PAIRED).select("k", "fp", "v").distinct().select("k", "v", F.explode(points).alias("point"))
    stars = large.groupBy("k", "point").agg(F.sort_array(F.collect_set("v")).alias("m")).select(
        F.col("m")[0].alias("a"), F.explode(F.slice("m", 2, BITS)).alias("b"))
    return small.unionByName(stars).distinct()


def ties(narrow: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): every document with the smallest one of the same fingerprint, for each seed."""
    keyed = narrow.withColumn("class", F.xxhash64("k", "fp"))
    named = stored(classes.select(F.xxhash64("k", "fp").alias("class"), "v", "n"))
    tied = attach(keyed, named, "class", "n", F.col("doc_id"))
    return tied.where("v <> doc_id").select(F.col("doc_id").alias("a"), F.col("v").alias("b"))


def near_dedup(docs: DataFrame, shingle: int = 3, seeds: tuple[int, ...] = (42,), distinct_words: bool = False) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    Documents are linked when their fingerprints of some seed differ in two bits or fewer; a component is what
    links reach, named by its smallest id. Equal fingerprints are one vertex, so copies are never paired.
    ``fingerprint`` is that of the first seed. A text without words has the fingerprint zero and is linked
    like any other. Rows that repeat an id are one document of several fingerprints. A row with a null id has a
    fingerprint, and the component of the other documents with that fingerprint, else null. An empty table gives
    no rows.
    """
    narrow = stored(fingerprints(docs, shingle, seeds, distinct_words).select(
        "doc_id", F.col("prints")[0].alias("first"), F.posexplode("prints").alias("k", "fp")))
    classes = stored(narrow.groupBy("k", "fp").agg(F.min("doc_id").alias("v"), F.count("*").alias("n")))
    known = classes.where("v is not null")
    edges = links(known.select("k", "fp", "v"))
    named = classes.select(F.xxhash64("k", "fp").alias("class"), "k", "fp", "v", "n")
    if len(seeds) > 1:  # a document ties its classes together
        edges = edges.unionByName(ties(narrow, classes))
    else:  # an id on several rows may have several fingerprints
        several = narrow.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
        rows = narrow.join(several.select("doc_id"), "doc_id").select("doc_id", "fp").distinct()
        edges = edges.unionByName(rows.join(known.select("fp", "v"), "fp").where("v <> doc_id").select(
            F.col("doc_id").alias("a"), F.col("v").alias("b")))
    reach = components(edges.distinct())
    placed = stored(named.where("k = 0").join(reach, "v", "left").select(
        F.col("fp").alias("first"), F.coalesce("component", "v").alias("component_id"), "n"))
    firsts = narrow.where("k = 0").select("doc_id", "first")
    return attach(firsts, placed, "first", "n", F.col("doc_id")).select(
        "doc_id", F.lpad(F.lower(F.hex("first")), 16, "0").alias("fingerprint"), "component_id")


def grams_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, grams), stored: the distinct five-word shingles of every row of ``docs`` whose id is a ``_id`` of ``ids``."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).join(
        ids.distinct().hint("merge"), F.col("doc_id") == F.col("_id"), "left_semi")
    return stored(texts.mapInArrow(shingle_batches, "doc_id bigint, grams array<bigint>"))


def alike(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose texts share at least 0.8 of their five-word shingles, counted over the whole texts.

    Two texts without words are alike. Of an id with several texts, one has to be alike.
    """
    once = stored(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    grams = grams_of(docs, once.select(F.col("a").alias("_id")).unionByName(once.select(F.col("b").alias("_id"))))
    side = lambda n: grams.select(F.col("doc_id").alias(n), F.col("grams").alias(f"g{n}"), F.size("grams").alias(f"n{n}")).hint("merge")
    both = once.join(side("a"), "a").join(side("b"), "b").where("5 * least(na, nb) >= 4 * greatest(na, nb)")
    shared = F.size(F.array_intersect("ga", "gb"))
    return stored(both.where(5 * shared >= 4 * (F.col("na") + F.col("nb") - shared)).select("a", "b").distinct())


def pairs_apart(placed: DataFrame, part: str) -> DataFrame:
    """(a, b): every pair of documents of one ``part`` that are in different components ``c``; for parts of bounded size."""
    apart = placed.groupBy(part).agg(F.sort_array(F.collect_set(F.struct("c", "doc_id"))).alias("m")).where(
        F.col("m")[0]["c"] < F.element_at("m", -1)["c"])
    pairs = F.flatten(F.transform("m", lambda x, i: F.transform(
        F.filter(F.slice("m", i + 2, F.size("m")), lambda y: x["c"] < y["c"]),
        lambda y: F.struct(x["doc_id"].alias("a"), y["doc_id"].alias("b")))))
    return apart.select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def named(members: DataFrame, reach: DataFrame) -> DataFrame:
    """``members`` with the component ``c`` of each."""
    known = reach.select(F.col("v").alias("_v"), "component").hint("merge")
    return members.join(known, F.col("doc_id") == F.col("_v"), "left").select("key", "size", F.coalesce("component", "doc_id").alias("c"), "doc_id")


def left_groups(members: DataFrame, reach: DataFrame) -> DataFrame:
    """(main, doc_id, c, n), stored: the members of buckets of over ``PAIRED`` documents that are still in several components.

    ``main`` is the largest component of the bucket, so buckets around one text are one group; ``n`` counts the group.
    """
    placed = stored(named(members.where(F.col("size") > PAIRED), reach))
    counts = placed.groupBy("key", "c").agg(F.count("*").alias("n"))
    mixed = stored(counts.groupBy("key").agg(
        F.max(F.struct("n", "c"))["c"].alias("main"), F.sum("n").alias("total"), F.count("*").alias("several")).where("several > 1").select(
            "key", "main", "total"))
    rows = stored(attach(placed, mixed, "key", "total", F.col("doc_id"), "inner").select("main", "doc_id", "c").distinct())
    return stored(attach(rows, stored(rows.groupBy("main").agg(F.count("*").alias("n"))), "main", "n", F.col("doc_id"), "inner"))


def dealt_pairs(groups: DataFrame, turn: int) -> DataFrame:
    """(a, b): pairs of a group that are in different components, dealt into parts of about ``DEALT``, other parts in every turn."""
    part = F.pmod(F.xxhash64("doc_id", "main", F.lit(turn)), F.ceil(F.col("n") / DEALT))
    return pairs_apart(groups.select(F.xxhash64("main", part).alias("part"), "c", "doc_id"), "part")


def left_links(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b): the links that a group's documents in different components have, of all their pairs.

    A group's texts are told by their differences: the shingles that a text has and one text of the main component, the
    pivot, has not, or the other way round. For d differences of a text of n shingles let w be 9 d - n. A text is alike with the
    pivot exactly if w is at most the pivot's shingles, and two texts with k differences in common are alike exactly if
    18 k >= w + w'. The smallest w is minus the pivot's shingles, so of two alike texts in different components, of which one at
    least is not alike with the pivot, k is 1 or more. The rarest of the k has k - 1 commoner ones after it in both
    texts: only texts that share a difference with so many behind it are paired, and counted by ``alike``. What edits of
    their own add is in no other text and pairs nothing, so that versions of a text far from each other are not compared.
    """
    grams = grams_of(docs, groups.select(F.col("doc_id").alias("_id")).unionByName(groups.select(F.col("main").alias("_id"))))
    mains = groups.groupBy("main").agg(F.max("n").alias("n"))
    pivots = stored(mains.join(grams.withColumnRenamed("doc_id", "main").hint("merge"), "main").groupBy("main", "n").agg(F.min("grams").alias("pivot")))
    texts = groups.select("main", "doc_id", "c").join(grams.hint("merge"), "doc_id")
    differences = F.concat(F.array_except("grams", "pivot"), F.array_except("pivot", "grams"))
    told = attach(texts, pivots, "main", "n", F.col("doc_id"), "inner").select(
        "main", "doc_id", "c", F.xxhash64("grams").alias("text"), F.size("grams").alias("own"), F.size("pivot").alias("of_pivot"), differences.alias("d"))
    w = 9 * F.size("d") - F.col("own")
    sides = stored(told.select("main", "doc_id", "c", "text", w.alias("w"), (w <= F.col("of_pivot")).alias("by_pivot"), "d"))
    outside = ~F.col("by_pivot") & (F.col("c") != F.col("main"))
    single = sides.select("main", "doc_id", "c", "text", "w", outside.alias("out"), F.explode("d").alias("gram")).select(
        F.xxhash64("main", "gram").alias("difference"), "main", "doc_id", "c", "text", "w", "out")
    counts = stored(single.groupBy("difference").agg(
        F.count("*").alias("held"), F.min(F.when(F.col("out"), F.col("w"))).alias("w_out"), F.min("w").alias("w_any")).where("held > 1 and w_out is not null"))
    shared = attach(single, counts, "difference", "held", F.col("doc_id"), "inner")
    rows = stored(shared.groupBy("main", "doc_id", "c", "text", "w", "out").agg(
        F.sort_array(F.collect_list(F.struct("held", "difference", "w_out", "w_any")), asc=False).alias("m")))

    def reaching(of: DataFrame, least: str) -> DataFrame:
        behind = F.filter(F.transform("m", lambda x, i: F.struct((i + 1).alias("k"), *[x[c].alias(c) for c in ("held", "difference", least)])),
                          lambda x: 18 * x["k"] >= F.col("w") + x[least])
        return of.select("doc_id", "c", "w", F.explode(behind).alias("x")).select(
            F.col("x.difference").alias("difference"), F.ceil(F.col("x.held") / LEFT).cast("int").alias("parts"), "doc_id", "c", "w", F.col("x.k").alias("k"))

    ones = reaching(rows.where("out"), "w_any").select(
        "difference", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.col("doc_id").alias("a"), F.col("c").alias("ca"), F.col("w").alias("wa"), F.col("k").alias("ka"))
    others = reaching(rows, "w_out").select(
        "difference", F.pmod(F.xxhash64("doc_id"), F.col("parts").cast("bigint")).cast("int").alias("part"),
        F.col("doc_id").alias("b"), F.col("c").alias("cb"), F.col("w").alias("wb"), F.col("k").alias("kb"))
    met = ones.join(others.hint("merge"), ["difference", "part"]).where("ca <> cb and 18 * least(ka, kb) >= wa + wb").select("a", "b")
    near = sides.where(F.col("by_pivot") & (F.col("c") != F.col("main"))).select(F.col("main").alias("a"), F.col("doc_id").alias("b"))
    return near.unionByName(alike(docs, met))


def tree_of(reach: DataFrame) -> DataFrame:
    """(a, b): links that make the components of ``reach``."""
    return reach.where("v <> component").select(F.col("v").alias("a"), F.col("component").alias("b"))


def near_links(docs: DataFrame, seeds: tuple[int, ...]) -> DataFrame:
    """(a, b): links between ids of near copies, each of them counted out by ``alike``; they connect all that meet.

    Candidates meet in a fingerprint of the set of words, at two bits in some seed, or in a table of least shingle
    hashes. First each document is compared with one of its bucket, chosen anew per bucket; then all pairs of buckets of up to
    ``PAIRED`` that are still in different components. Larger buckets are dealt into small parts for some turns, and of what they then
    hold in different components ``left_links`` finds every link: no pair that meets in a table is left out unless it is in one
    component already or has been told not to be alike.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).where("doc_id is not null")
    seen = stored(rows.mapInArrow(partial(near_batches, seeds=seeds), "doc_id bigint, prints array<bigint>, keys array<bigint>"))
    narrow = seen.select("doc_id", F.posexplode("prints").alias("k", "fp"))
    classes = stored(narrow.groupBy("k", "fp").agg(F.min("doc_id").alias("v"), F.count("*").alias("n")))
    close = links(classes.select("k", "fp", "v")).unionByName(ties(narrow, classes))
    keyed = seen.select("doc_id", F.explode("keys").alias("key"))
    buckets = stored(keyed.groupBy("key").agg(
        F.min(F.struct(F.xxhash64("doc_id", "key").alias("h"), "doc_id")).alias("low"), F.count("*").alias("size")).where("size > 1").select(
            "key", F.col("low.doc_id").alias("leader"), "size"))
    members = stored(attach(keyed, buckets, "key", "size", F.col("doc_id"), "inner"))
    found = alike(docs, close.unionByName(members.select(F.col("leader").alias("a"), F.col("doc_id").alias("b"))))
    reach = components(found)
    small = named(members.where(F.col("size") <= PAIRED), reach)
    found = tree_of(reach).unionByName(alike(docs, pairs_apart(small, "key")))
    for turn in range(TURNS + 1):
        reach = components(found)
        groups = left_groups(members, reach)
        if groups.isEmpty():
            break
        more = alike(docs, dealt_pairs(groups, turn)) if turn < TURNS else left_links(docs, groups)
        found = tree_of(reach).unionByName(more)
    return found


def without_near_copies(docs: DataFrame, seeds: tuple[int, ...]) -> DataFrame:
    """``docs`` with one row of each group of near copies, all columns as they were: that with the smallest id.

    Near copies share at least 0.8 of their distinct five-word shingles; a group is what links of near copies reach.
    Fingerprints and least hashes only propose links. Rows without an id stay. An id that stands on several rows is one
    document, whose rows stay or go together.
    """
    reach = components(near_links(docs, seeds))
    gone = stored(reach.where("component <> v").select(F.col("v").alias("_gone")).distinct())
    return docs.join(gone.hint("merge"), docs["doc_id"] == gone["_gone"], "left_anti")

"""A Merkle manifest of a dataset: one root over all rows, and a proof for every row.

Rows are leaves; every ``FANOUT`` neighbours of a group become a node, level by level, and the groups' roots likewise
become the root. A digest is written as 64 hex characters, one block of the hash, so the state before each child of
a parent can be kept: ``Parent`` copies the state before every slot when it is built. A replaced child resumes the
state of its slot and reads the replacement and the siblings to its right only; nothing to its left is hashed again.

Levels are built by Spark, a run of ``FANOUT`` children at a time. A run of leaves then meets the runs above it, from the
root down, and its leaves are folded together: they share the kept states of all parents above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treespark.functions.prefix import ranked
from treespark.llm.common import ascii_lower, stored

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<slot:int,run:array<string>>>"


class Parent:
    """A node over the hex digests of its children, with the state of the hash before each of them."""

    def __init__(self, children: list[str]) -> None:
        self.children = [c.encode() for c in children]
        self.states = []
        state = hashlib.sha256()
        for child in self.children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest()

    def fold(self, slot: int, child: str) -> str:
        """The digest with another child at ``slot``: its state, the child, what stands to the right."""
        state = self.states[slot].copy()
        state.update(child.encode())
        for right in self.children[slot + 1 :]:
            state.update(right)
        return state.hexdigest()


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 of the values, each with its length in bytes; a null is a dash, so no two lists are written alike."""
    texts = [v.cast("string") for v in values]
    fields = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*fields), 256)


def grown(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The levels above ``nodes`` (tree, pos, digest), each as runs (tree, pos, children), and the roots (tree, digest).

    A run of one child at place 0 is a tree that has its root already; it is passed on as it is. All others
    are hashed, the last run of a level too when it holds one child.
    """
    levels = []
    last = nodes.agg(F.max("pos")).first()[0]
    while last:
        last //= FANOUT
        member = F.struct(F.col("pos").alias("p"), F.col("digest").alias("d"))
        runs = stored(nodes.groupBy("tree", F.expr(f"pos div {FANOUT}").alias("up")).agg(
            F.sort_array(F.collect_list(member)).alias("m")).select("tree", F.col("up").alias("pos"), F.col("m.d").alias("children")))
        levels.append(runs)
        nodes = runs.select("tree", "pos", F.when(finished(), F.col("children")[0]).otherwise(
            F.sha2(F.concat_ws("", "children"), 256)).alias("digest"))
    return levels, nodes.select("tree", "digest")


def finished() -> Column:
    """A run that is a root already."""
    return (F.col("pos") == 0) & (F.size("children") == 1)


def descended(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, pos, path, …) of every node of the lowest level, from those of the trees' roots.

    A path is the slots and runs from the node's own run up to the root. Each level joins runs with their own paths
    one to one and deals the result to the children, so no key is hot.
    """
    for runs in reversed(levels):
        kept = [c for c in above.columns if c not in ("tree", "pos", "path")]
        named = above.select(F.col("tree").alias("_tree"), F.col("pos").alias("_pos"), "path", *kept)
        met = runs.join(named, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("pos") == F.col("_pos")))
        own = F.array(F.struct(F.col("slot").cast("int").alias("slot"), F.col("children").alias("run")))
        dealt = met.select("tree", "pos", "path", "children", *kept, F.posexplode("children").alias("slot", "child"))
        above = stored(dealt.select(
            "tree", (F.col("pos") * FANOUT + F.col("slot")).alias("at"),
            F.when(finished(), F.col("path")).otherwise(F.concat(own, "path")).alias("path"), *kept).withColumnRenamed("at", "pos"))
    return above


def folded_rows(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Per run of leaves: the root folded from each leaf, or from what replaces it, and the hash of its proof."""
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            leaves = [m["leaf"] for m in row["members"]]
            single = row["pos"] == 0 and len(leaves) == 1
            own = None if single else Parent(leaves)
            steps = [(s["slot"], Parent(s["run"])) for s in row["path"]]
            higher = b"".join(c for slot, p in steps for i, c in enumerate(p.children) if i != slot)
            for slot, member in enumerate(row["members"]):
                value = member["replaced"] or member["leaf"]
                beside = b""
                if own:
                    value = own.fold(slot, value)
                    beside = b"".join(own.children[:slot] + own.children[slot + 1 :])
                for at, parent in steps:
                    value = parent.fold(at, value)
                proof = hashlib.sha256(beside + higher).hexdigest()
                out.append((member["id"], member["leaf"], row["subroot"], row["root"], proof, value, value == row["root"]))
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
        cells = zip(*out) if out else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names=columns)


def manifest(docs: DataFrame, tampered: Column | None = None, replacement: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per row of ``docs``.

    A leaf hashes the ``COLUMNS``, each with its length, a null as ``-``. Rows of a source stand by doc_id, null first;
    rows that repeat an id stand by their digest, and are a leaf each. Sources stand bytewise, null first. Where
    ``tampered`` is true, the leaf is computed again with the columns of ``replacement`` and folded in its place;
    elsewhere, and where the condition is null, the leaf itself is. ``verified`` tells whether the folded root is the root.
    The proof of a single leaf without any sibling is the hash of nothing. An empty table gives no rows; other columns
    play no part. Long texts are hashed where they are read; only digests move.
    """
    changed = F.lit(False) if tampered is None else tampered
    values = {c: F.col(c) for c in COLUMNS}
    replaced = F.when(changed, leaf_digest(list((values | (replacement or {})).values())))
    leaves = stored(docs.select(
        F.col("source").alias("tree"), F.col("doc_id").cast("bigint").alias("id"), leaf_digest(list(values.values())).alias("leaf"),
        replaced.alias("replaced")))
    placed = ranked(leaves, ["tree"], ["id", "leaf"], "rank").withColumn("pos", F.col("rank") - 1)
    member = F.struct("pos", "id", "leaf", "replaced")
    first = stored(placed.groupBy("tree", F.expr(f"pos div {FANOUT}").alias("up")).agg(
        F.sort_array(F.collect_list(member)).alias("members")).withColumnRenamed("up", "pos"))
    single = (F.col("pos") == 0) & (F.size("members") == 1)
    parents = stored(first.select("tree", "pos", F.when(single, F.col("members")[0]["leaf"]).otherwise(
        F.sha2(F.concat_ws("", "members.leaf"), 256)).alias("digest")))
    levels, roots = grown(parents)
    subroots = stored(ranked(stored(roots), [], ["tree"], "rank").select("tree", (F.col("rank") - 1).alias("place"), "digest"))
    tops, root = grown(subroots.select(F.lit("").alias("tree"), F.col("place").alias("pos"), "digest"))
    top = root.select("tree", F.lit(0).cast("bigint").alias("pos"), F.array().cast(STEP).alias("path"), F.col("digest").alias("root"))
    sources = descended(tops, top).select(F.col("pos").alias("_place"), "path", "root")
    above = subroots.join(sources, F.col("place") == F.col("_place")).select(
        "tree", F.lit(0).cast("bigint").alias("pos"), "path", "root", F.col("digest").alias("subroot"))
    paths = descended(levels, above).select(F.col("tree").alias("_tree"), F.col("pos").alias("_pos"), "path", "root", "subroot")
    runs = first.join(paths, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("pos") == F.col("_pos"))).select(
        "pos", "members", "path", "root", "subroot")
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    kinds = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return runs.mapInArrow(partial(folded_rows, columns=columns), kinds)


def lowered_text_manifest(docs: DataFrame) -> DataFrame:
    """``manifest`` with the text lower-cased (A-Z only) in the rows whose id's CRC-32, in decimals, five divides."""
    own = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.when(F.col("text").isNotNull(), ascii_lower(F.col("text")))
    return manifest(docs, own, {"text": lowered})

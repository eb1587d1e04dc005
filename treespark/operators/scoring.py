"""Scores over stored outputs: attachment, accuracy, correlation, entropies, similarities, contrastive losses."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from treespark.functions import vectors
from treespark.functions.arrays import computed, exploded, item, let
from treespark.functions.lookup import Vectors
from treespark.functions.numbering import runs, slices, starts_of
from treespark.operators.batching import IGNORED
from treespark.operators.contrast import PhraseSettings, TreeSettings
from treespark.session import cut_lineage

# --- parses -----------------------------------------------------------------------------------------


def attachment_scores(df: DataFrame, *keys: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """UAS, LAS, UEM and LEM of sentences with head/deprel beside pred_head/pred_deprel.

    Each sentence is judged inside its row; one fold adds them up. Words whose gold label is ignored do not
    count. Scores over nothing are 0.
    """
    counted = lambda i: ~F.get("deprel", i).isin(*ignore) if ignore else F.lit(True)
    right = lambda h, i: h == F.get("pred_head", i)
    labelled = lambda h, i: right(h, i) & (F.get("deprel", i) == F.get("pred_deprel", i))

    def total(test) -> Column:
        return F.aggregate(
            F.transform("head", lambda h, i: (test(h, i) & counted(i)).cast("int")), F.lit(0), lambda s, x: s + x
        )

    judged = computed(
        df,
        _words=total(lambda h, i: F.lit(True)),
        _heads=total(right),
        _both=total(labelled),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    words, sentences = F.sum("_words"), F.count("*")
    return judged.groupBy(*keys).agg(
        words.alias("words"),
        sentences.alias("sentences"),
        ratio(F.sum("_heads"), words).alias("uas"),
        ratio(F.sum("_both"), words).alias("las"),
        ratio(F.count_if(F.col("_heads") == F.col("_words")), sentences).alias("uem"),
        ratio(F.count_if(F.col("_both") == F.col("_words")), sentences).alias("lem"),
    )


def best_class(scores: DataFrame, keys: list[str], cls: str, score: str) -> DataFrame:
    """The class with the highest score per key; the smaller class wins a tie."""
    return scores.groupBy(*keys).agg(F.max_by(cls, F.struct(F.col(score), -F.col(cls))).alias(cls))


def choose_heads(arc_scores: DataFrame) -> DataFrame:
    """(sent_id, id, head): best-scoring head per word, never the word itself. Rows: sent_id, id, head, score."""
    return best_class(arc_scores.where("head <> id"), ["sent_id", "id"], "head", "score")


def greedy_heads(scores: Column) -> Column:
    """Best head of every word inside the row; the smaller head wins a tie.

    ``scores`` holds per word the scores of heads 0..n. The word itself cannot be chosen. The result need not
    be a tree (``trees.off_tree_report`` tells).
    """

    def best(row: Column, i: Column) -> Column:
        others = F.transform(row, lambda s, h: F.when(h != i + 1, s))
        return let(others, lambda xs: (F.array_position(xs, F.array_max(xs)) - 1).cast("int"))

    return F.transform(scores, best)


# --- classification ---------------------------------------------------------------------------------


def accuracy(df: DataFrame, gold: str, pred: str, *keys: str) -> DataFrame:
    """Share of equal labels; rows without a gold label do not count."""
    hit = (F.col(gold) == F.col(pred)).cast("int")
    return df.where(F.col(gold).isNotNull()).groupBy(*keys).agg(
        F.avg(hit).alias("accuracy"), F.count("*").alias("n")
    )


def matthews(df: DataFrame, gold: str, pred: str, *keys: str) -> DataFrame:
    """Matthews correlation of two 0/1 columns, 0 when a margin is empty."""
    cell = lambda g, p: F.count_if((F.col(gold) == g) & (F.col(pred) == p)).cast("double")
    table = df.groupBy(*keys).agg(
        cell(1, 1).alias("tp"), cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn")
    )
    margins = F.expr("(tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)")
    return table.withColumn(
        "mcc", F.when(margins == 0, 0.0).otherwise(F.expr("tp * tn - fp * fn") / F.sqrt(margins))
    )


def cross_entropy(df: DataFrame, label: str, nll: str, *keys: str) -> DataFrame:
    """Mean negative log likelihood over labelled rows, and its exponential (perplexity)."""
    labelled = df.where(F.col(label) != IGNORED)
    return labelled.groupBy(*keys).agg(
        F.avg(nll).alias("loss"), F.exp(F.avg(nll)).alias("perplexity"), F.count("*").alias("n")
    )


def binary_cross_entropy(df: DataFrame, logit: str, target: str, *keys: str) -> DataFrame:
    """Mean binary cross entropy of logits, in the form that cannot overflow."""
    x, y = F.col(logit), F.col(target)
    each = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    return df.groupBy(*keys).agg(F.avg(each).alias("loss"), F.count("*").alias("n"))


def replaced_tokens(df: DataFrame, tokens: str = "input_ids", pred: str = "pred_ids", labels: str = "labels") -> DataFrame:
    """Add ``replaced`` flags and ``replaced_ids``: a labelled position whose prediction differs from the input."""
    flags = F.transform(
        tokens, lambda x, i: (F.get(labels, i) != IGNORED) & (F.get(pred, i) != x)
    )
    flagged = computed(df, replaced=flags)
    return computed(
        flagged,
        replaced_ids=F.transform(tokens, lambda x, i: F.when(F.get("replaced", i), F.get(pred, i)).otherwise(x)),
    )


# --- groups -----------------------------------------------------------------------------------------


def softmax(df: DataFrame, group: list[str], score: str, name: str = "probability") -> DataFrame:
    """Add the softmax of ``score`` within each group (groups are bounded: a sentence's words, a set's trees).

    Masked rows are to be removed before.
    """
    within = Window.partitionBy(*group)
    top = df.withColumn("_e", F.exp(F.col(score) - F.max(score).over(within)))
    return top.withColumn(name, F.col("_e") / F.sum("_e").over(within)).drop("_e")


def top_negatives(df: DataFrame, group: list[str], similarity: str, number: str, k: int = 3) -> DataFrame:
    """The k most similar negatives of each set; Spark cuts to k per task before the exchange."""
    best = Window.partitionBy(*group).orderBy(F.desc(similarity), number)
    # What differs within a set stands together at the end of the row: so the exchange packs rows a fifth smaller.
    rows = df.select(*[c for c in df.columns if c not in (similarity, number)], similarity, number)
    return rows.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select(*df.columns, "place")


def info_nce(positive: Column, negatives: Column, temperature: float = 0.1) -> Column:
    """-log softmax of the positive among itself and the negatives, over the temperature."""
    scores = F.transform(F.concat(F.array(positive), negatives), lambda x: x / F.lit(temperature))

    def loss(xs: Column) -> Column:
        top = F.array_max(xs)
        total = F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.exp(x - top))
        return top + F.ln(total) - F.element_at(xs, 1)

    return let(scores, loss)


def layer_choice(df: DataFrame, value: str, last_layer_only: bool, *keys: str) -> DataFrame:
    """Mean loss of the last layer, or over all layers."""
    if last_layer_only:
        df = df.where(F.col("layer") == df.agg(F.max("layer")).scalar())
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


# --- vectors ----------------------------------------------------------------------------------------


def pool_spans(vecs: Column, spans: Column) -> Column:
    """Mean vector of every span; positions outside the sentence do not count, an empty span gives zeros."""

    def pooled(vs: Column, s: Column) -> Column:
        end = F.least(s["e"], F.size(vs) - 1)
        begin = F.greatest(s["b"], F.lit(0))
        inside = F.slice(vs, begin + 1, F.greatest(end - begin + 1, F.lit(0)))
        zeros = F.transform(F.get(vs, F.lit(0)), lambda x: F.lit(0.0))
        return let(inside, lambda xs: F.when(F.size(xs) == 0, zeros).otherwise(vectors.mean(xs)))

    return let(vecs, lambda vs: F.transform(spans, lambda s: pooled(vs, s)))


def _lengths(lists: pa.ListArray) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


#: Spans whose mean vectors are sent back at once, about, or those of one sentence.
POOLED = 1 << 13


def _pooled_span_batches(batches: Iterator[pa.RecordBatch], table: Vectors) -> Iterator[pa.RecordBatch]:
    """The batch with mean vectors in place of keys and spans; sentences without any vector are left out."""
    for batch in batches:
        for begin, end in slices(_lengths(batch.column("_spans")) + 1, POOLED):
            part = batch.slice(begin, end - begin)
            lengths, places = table.listed(part.column("_keys"))
            part, any_ = part.filter(pa.array(lengths > 0)), lengths > 0
            spans, lengths = part.column("_spans"), lengths[any_]
            own, flat = _lengths(spans), spans.flatten()
            b, e = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            first, size = (np.repeat(x, own) for x in (starts_of(lengths)[:-1], lengths))
            b, e = np.maximum(b, 0), np.minimum(e, size - 1)
            counts = np.maximum(e - b + 1, 0)
            pooled = table.lists(table.means(places[runs(first + b, counts)], counts))
            kept = [c for c in part.schema.names if c not in ("_keys", "_spans")]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in kept], pa.ListArray.from_arrays(pa.array(starts_of(own), pa.int32()), pooled)],
                names=[*kept, "_pooled"])


def pool_spans_by_key(df: DataFrame, keys: str, spans: str, table: Vectors, name: str) -> DataFrame:
    """``df`` with ``pool_spans`` as ``name`` in place of ``keys`` and ``spans``: ``keys`` holds the key in the stored ``table`` of
    every position's vector. A sentence of which the table has no vector is left out."""
    kept = [c for c in df.columns if c not in (keys, spans)]
    rows = df.select(*kept, F.col(keys).alias("_keys"), F.col(spans).alias("_spans"))
    schema = StructType([rows.schema[c] for c in kept]).add("_pooled", ArrayType(ArrayType(DoubleType())))
    return rows.mapInArrow(partial(_pooled_span_batches, table=table), schema).withColumnRenamed("_pooled", name)


def _codes(values: pa.Array) -> np.ndarray:
    """Equal numbers for equal values, null being one of them."""
    if pa.types.is_integer(values.type) and not values.null_count:
        return values.to_numpy(zero_copy_only=False).astype(np.int64)
    return values.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _pooled_row_batches(batches: Iterator[pa.RecordBatch], keys: list[str], table: Vectors) -> Iterator[pa.RecordBatch]:
    """A row per group of the span rows of the sentences, with the mean of the vectors at their positions."""
    for batch in batches:
        for begin, end in slices(_lengths(batch.column("_rows")) + 1, 4 * POOLED):
            part = batch.slice(begin, end - begin)
            spans, placed = part.column("_rows"), part.column("_placed")
            at, flat = placed.flatten(), spans.flatten()
            place = table.places(at.field(1).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            there = (place >= 0) & at.is_valid().to_numpy(zero_copy_only=False)
            for i in (0, 1):
                there &= at.field(i).is_valid().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(part.num_rows), _lengths(placed))[there]
            pos, place = at.field(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[there], place[there]
            want = np.flatnonzero(flat.field(0).is_valid().to_numpy(zero_copy_only=False))
            asked = flat.field(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[want]
            row = np.repeat(np.arange(part.num_rows), _lengths(spans))[want]
            low = min(pos.min(initial=0), asked.min(initial=0))
            width = int(max(pos.max(initial=0), asked.max(initial=0))) - low + 1
            have = of * width + pos - low
            order = np.argsort(have, kind="stable")
            have, place = have[order], place[order]
            first = np.searchsorted(have, row * width + asked - low)
            counts = np.searchsorted(have, row * width + asked - low, side="right") - first
            hit = np.flatnonzero(counts)
            if not len(hit):
                continue
            groups = [flat.field(1 + i).take(pa.array(want)) for i in range(len(keys))]
            codes = [row, *map(_codes, groups)]
            order = hit[np.lexsort([c[hit] for c in reversed(codes)])]
            opens = np.ones(len(order), bool)
            opens[1:] = np.any([c[order][1:] != c[order][:-1] for c in codes], axis=0)
            heads = np.flatnonzero(opens)
            total = np.add.reduceat(counts[order], heads)
            vecs = table.means(place[runs(first[order], counts[order])], total)
            one = pa.array(order[heads])
            yield pa.RecordBatch.from_arrays(
                [part.column("sent_id").take(pa.array(row[order[heads]])), *[g.take(one) for g in groups], table.lists(vecs)],
                names=["sent_id", *keys, "vec"])


def _pool_rows_by_key(span_rows: DataFrame, keyed: DataFrame, keys: list[str], table: Vectors) -> DataFrame:
    """``pool_rows`` inside the sentences. Both sides come together by sentence, which moves nothing where they are dealt by it."""
    rest = [k for k in keys if k != "sent_id"]
    spans = span_rows.groupBy("sent_id").agg(F.collect_list(F.struct("pos", *rest)).alias("_rows"))
    placed = keyed.groupBy("sent_id").agg(F.collect_list(F.struct("pos", table.key)).alias("_placed"))
    kinds = StructType([span_rows.schema[k] for k in ("sent_id", *rest)]).add("vec", ArrayType(DoubleType()))
    pooled = spans.hint("merge").join(placed, "sent_id").mapInArrow(partial(_pooled_row_batches, keys=rest, table=table), kinds)
    return pooled.select(*keys, "vec")


def pool_rows(span_rows: DataFrame, vecs: DataFrame, *keys: str, table: Vectors | None = None) -> DataFrame:
    """Long form of the pooling: (keys, pos) rows joined to (sent_id, pos, vec) rows, averaged per key.

    A group holds one word's pieces. Rows made from arrays are far more than any estimate counts, so they are merged.
    With a stored ``table``, ``vecs`` has the key of every position's vector in its place, and ``keys`` name the sentence.
    """
    if table is not None:
        return _pool_rows_by_key(span_rows, vecs, list(keys), table)
    hits = span_rows.hint("merge").join(vecs, ["sent_id", "pos"])
    grouped = hits.groupBy(*keys).agg(F.collect_list("vec").alias("vs"))
    return grouped.select(*keys, vectors.mean(F.col("vs")).alias("vec"))


def gather(wanted: DataFrame, keyed: DataFrame, vecs: DataFrame, key: str = "vec_id") -> DataFrame:
    """(sent_id, pos, .., vec) of the wanted positions. ``keyed`` has the key of every position's vector in ``vecs``.

    Positions meet by their keys first, so vectors move for what is wanted only.
    """
    found = wanted.hint("merge").join(keyed.select("sent_id", "pos", key), ["sent_id", "pos"])
    return found.join(vecs, key).drop(key)


def missing_positions(wanted: DataFrame, vecs: DataFrame) -> DataFrame:
    """The wanted (sent_id, pos) rows the vector table does not have."""
    return wanted.join(vecs.hint("merge"), ["sent_id", "pos"], "left_anti")


#: Sentences whose vectors and trees are gathered at once.
GATHERED = 256


def _segment_cosines(x: np.ndarray, ids: np.ndarray, lengths: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Per segment of ``ids`` the cosine of its root's vector with its attention-pooled vectors; 0 for an empty one."""
    out = np.zeros(len(lengths))
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    segment = np.repeat(np.arange(len(full)), lengths[full])
    starts = np.cumsum(lengths[full]) - lengths[full]
    members, own = x[ids], x[roots[full]]
    dots = np.einsum("ij,ij->i", members, own[segment])
    weights = np.exp(dots - np.maximum.reduceat(dots, starts)[segment])
    weights /= np.add.reduceat(weights, starts)[segment]
    pooled = np.add.reduceat(members * weights[:, None], starts, axis=0)
    length = np.sqrt(np.einsum("ij,ij->i", pooled, pooled) * np.einsum("ij,ij->i", own, own))
    out[full] = np.einsum("ij,ij->i", pooled, own) / np.maximum(length, 1e-8)
    return out


#: Sentences of up to so many positions, and trees of up to so many members, are scored over the products of all positions.
SHORT, SMALL = 64, 32


def _products(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inner products of the vectors of every sentence, row by row in one flat array, and where a sentence's begin; longer
    sentences have none. Sentences of one length are multiplied together."""
    first, cells = starts_of(sizes)[:-1], np.where(sizes <= SHORT, sizes * sizes, 0)
    begins, out = starts_of(cells)[:-1], np.empty(cells.sum())
    for n in np.unique(sizes[(sizes > 0) & (sizes <= SHORT)]).tolist():
        alike = np.flatnonzero(sizes == n)
        own = x[first[alike][:, None] + np.arange(n)]
        out[begins[alike][:, None] + np.arange(n * n)] = (own @ own.transpose(0, 2, 1)).reshape(len(alike), n * n)
    return out, begins


def _cosines(x: np.ndarray, sizes: np.ndarray, row: np.ndarray, root: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per tree, in a row and with a root in it, the cosine of ``_segment_cosines`` of its members' ids."""
    first = starts_of(sizes)[:-1]
    of = np.repeat(np.arange(len(lengths)), lengths)
    # A sentence that lacks the vector of a position is scored by places in the flat array, as any long one.
    beyond = np.bincount(of, weights=ids >= sizes[row[of]], minlength=len(lengths)) > 0
    small = (sizes[row] <= SHORT) & (lengths <= SMALL) & (root < sizes[row]) & ~beyond
    out = np.zeros(len(lengths))
    large = ~small
    if large.any():
        at = large[of]
        out[large] = _segment_cosines(x, (ids + first[row[of]])[at], lengths[large], (root + first[row])[large])
    full = np.flatnonzero(small & (lengths > 0))
    if not len(full):
        return out
    products, begins = _products(x, sizes)
    counts, n = lengths[full], sizes[row[full]]
    id_, tree = ids[(small & (lengths > 0))[of]], np.repeat(np.arange(len(full)), counts)
    starts = starts_of(counts)[:-1]
    base = begins[row[full]]
    dots = products[(base + root[full] * n)[tree] + id_]
    weights = np.exp(dots - np.maximum.reduceat(dots, starts)[tree])
    weights /= np.add.reduceat(weights, starts)[tree]
    # The square of the pooled vector's length: over all pairs of members.
    more = counts[tree]
    other = runs(starts[tree], more)
    squares = products[np.repeat((base[tree] + id_ * n[tree]), more) + id_[other]] * weights[other]
    within = np.add.reduceat(squares, starts_of(more)[:-1]) * weights
    squared = np.maximum(np.add.reduceat(within, starts), 0.0) * products[base + root[full] * (n + 1)]
    out[full] = np.add.reduceat(weights * dots, starts) / np.maximum(np.sqrt(squared), 1e-8)
    return out


_SCORED = "array<struct<root_id int, positive double, negatives array<double>>>"


def _scored(x: np.ndarray, sizes: np.ndarray, roots: pa.ListArray, trees: pa.ListArray) -> pa.ListArray:
    """Per sentence the root and the cosines of every tree set; ``x`` has the vectors of the sentences one after the other. Trees are
    flat arrays with lengths, so no tree is visited on its own."""
    sets = _lengths(trees)
    row = np.repeat(np.arange(len(trees)), sets)
    of_set, roots = trees.flatten(), roots.flatten()
    counts = _lengths(of_set)
    tree_set = np.repeat(np.arange(len(row)), counts)
    ids = of_set.flatten()
    cosines = _cosines(
        x, sizes, row[tree_set], roots.to_numpy()[tree_set].astype(np.int64), ids.flatten().to_numpy().astype(np.int64), _lengths(ids))
    heads = np.cumsum(counts) - counts
    negatives = pa.ListArray.from_arrays(pa.array(starts_of(counts - 1), pa.int32()), pa.array(np.delete(cosines, heads)))
    scored = pa.StructArray.from_arrays([roots, pa.array(cosines[heads]), negatives], names=["root_id", "positive", "negatives"])
    return pa.ListArray.from_arrays(pa.array(starts_of(sets), pa.int32()), scored)


def _similar_by_key(table: Vectors):
    def similar(keys: pa.Array, roots: pa.Array, trees: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, len(keys), GATHERED):
            sizes, places = table.listed(keys.slice(at, GATHERED))
            parts.append(_scored(table.rows(places), sizes, roots.slice(at, GATHERED), trees.slice(at, GATHERED)))
        return pa.concat_arrays(parts)

    return similar


def _similar_vectors(flat: pa.Array, dims: pa.Array, roots: pa.Array, trees: pa.Array) -> pa.Array:
    parts, rows = [], []
    for dim in np.unique(dims.to_numpy()).tolist():
        alike = np.flatnonzero(dims.to_numpy() == dim)
        for at in range(0, len(alike), GATHERED):
            rows.append(alike[at : at + GATHERED])
            own, some, of = (x.take(pa.array(rows[-1])) for x in (flat, roots, trees))
            parts.append(_scored(own.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), _lengths(own) // dim, some, of))
    return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(rows))))


def tree_similarities(df: DataFrame, vecs: str, include_root: bool = False, table: Vectors | None = None) -> DataFrame:
    """(sent_id, …, root_id, positive, negatives): cosines of the trees of every tree set.

    ``vecs`` holds one vector per position, position 0 being the first special token; vectors of a row have one
    length. With a stored ``table`` it holds their keys. Other columns are kept, so a row may stand for one layer of a sentence.
    """
    keep = [c for c in df.columns if c not in ("tree_sets", vecs)]

    def ids(tree: Column, root: Column) -> Column:
        return F.map_keys(tree) if include_root else F.array_remove(F.map_keys(tree), root)

    def trees(s: Column) -> Column:
        return F.transform(F.concat(F.array(s["positive"]), s["negatives"]), lambda t: ids(t, s["root_id"]))

    vectors_of = {"_keys": F.col(vecs)} if table else {
        "_flat": F.flatten(F.transform(vecs, lambda v: v.cast("array<double>"))), "_dim": F.size(F.get(vecs, F.lit(0)))}
    # Filtered by what was computed: a filter on the sets themselves is pushed below joins, where the sets are made once more for it.
    prepared = computed(
        df.select(*keep, "tree_sets", vecs),
        **vectors_of,
        _roots=F.transform("tree_sets", lambda s: s["root_id"]),
        _trees=F.transform("tree_sets", trees),
    ).where(F.size("_trees") > 0)
    # A column of the row, so that rows stay where they are known to be: what groups them by sentence next moves nothing.
    scored = F.arrow_udf(_similar_by_key(table) if table else _similar_vectors, _SCORED)(*[F.col(c) for c in (*vectors_of, "_roots", "_trees")])
    return prepared.select(*keep, scored.alias("_scored")).select(*keep, exploded(F.col("_scored")).alias("x")).select(*keep, "x.*")


def tree_losses(similarities: DataFrame, k: int = 3, temperature: float = 0.1) -> DataFrame:
    """Add ``loss``: the contrastive loss of every set against its k most similar negatives."""
    closest = F.slice(F.sort_array("negatives", asc=False), 1, k)
    return similarities.withColumn("loss", info_nce(F.col("positive"), closest, temperature))


def tree_loss(df: DataFrame, vecs: str, settings: TreeSettings, *keys: str, table: Vectors | None = None) -> DataFrame:
    """(keys, loss): the mean tree loss of the layers that the settings choose. Rows are layers of sentences with
    ``tree_sets``; the settings also give the root's part, the negatives that count and the temperature."""
    losses = tree_losses(
        tree_similarities(df, vecs, settings.include_root, table), settings.max_negatives_in_loss, settings.temperature)
    # Stored, as the choice reads them twice; the vectors are not.
    losses = cut_lineage(losses.select(*dict.fromkeys([*keys, "layer"]), "loss"))
    return layer_choice(losses, "loss", settings.last_layer_only, *keys)


# --- distributions ----------------------------------------------------------------------------------


def divergence(a: Column, b: Column, mask: Column | None = None, floor: float = 1e-6) -> Column:
    """Jensen-Shannon divergence of two distributions over the unmasked positions, divided by their number.

    Values are held above ``floor``; the result is not negative.
    """
    keep = F.transform(a, lambda _: F.lit(1)) if mask is None else mask
    held = lambda v: F.transform(v, lambda x: F.greatest(x.cast("double"), F.lit(floor)))
    term = lambda x, m: x * (F.ln(x) - F.ln(m))
    each = F.zip_with(held(a), held(b), lambda x, y: term(x, (x + y) / 2) + term(y, (x + y) / 2))
    masked = F.zip_with(each, keep, lambda t, k: F.when(k == 1, t).otherwise(0.0))
    length = F.greatest(F.aggregate(keep, F.lit(0), lambda s, k: s + F.when(k == 1, 1).otherwise(0)), F.lit(1))
    return F.aggregate(masked, F.lit(0.0), lambda s, t: s + t) * 0.5 / length


#: Cells of pairs of distributions that are compared at once, about, or those of one pair.
COMPARED = 1 << 18


def _divergences(attention: pa.Array, pairs: pa.Array, floor: float, mask: pa.Array | None = None) -> pa.Array:
    """``divergence`` of pairs of positions, of all sentences of a batch in flat arrays; null where a position has none."""
    positions = attention.flatten()
    sizes, first = _lengths(attention), starts_of(_lengths(attention))
    widths, begins = _lengths(positions), starts_of(_lengths(positions))
    there = positions.is_valid().to_numpy(zero_copy_only=False)
    x = np.maximum(positions.flatten().fill_null(floor).to_numpy(zero_copy_only=False).astype(np.float64), floor)
    logs = np.log(x)
    groups = pairs.flatten()
    row = np.repeat(np.repeat(np.arange(len(pairs)), _lengths(pairs)), _lengths(groups))
    ends, known = [], np.ones(len(row), bool)
    for side in (0, 1):
        at = groups.flatten().field(side).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        known &= (at >= 0) & (at < sizes[row])
        ends.append(np.where(known, first[row] + at, 0))
    if len(there):
        known &= there[ends[0]] & there[ends[1]]
    out = np.zeros(len(row))
    pair = np.flatnonzero(known)
    a, b = (end[pair] for end in ends)
    cells, counted = np.minimum(widths[a], widths[b]), widths[a]
    if mask is None:
        known[pair] &= cells == counted
    else:
        masks = starts_of(_lengths(mask))
        one = np.concatenate([mask.flatten().fill_null(0).to_numpy(zero_copy_only=False) == 1, [False]])
        ones, of = starts_of(one), row[pair]
        counted = (ones[masks[1:]] - ones[masks[:-1]])[of]
        inside = ones[masks[of] + np.minimum(cells, (masks[1:] - masks[:-1])[of])] - ones[masks[of]]
        known[pair] &= inside == counted
    for begin, end in slices(cells, COMPARED):
        some = cells[begin:end]
        left, right = runs(begins[a[begin:end]], some), runs(begins[b[begin:end]], some)
        middle = np.log((x[left] + x[right]) / 2)
        terms = x[left] * (logs[left] - middle) + x[right] * (logs[right] - middle)
        if mask is not None:
            own = row[pair[begin:end]]
            place, within = runs(masks[own], some), np.repeat(masks[own + 1], some)
            terms = np.where((place < within) & one[np.minimum(place, len(one) - 1)], terms, 0.0)
        full = np.flatnonzero(some)
        if len(full):
            out[pair[begin:end][full]] = np.add.reduceat(terms, starts_of(some)[full])
    out[pair] *= 0.5 / np.maximum(counted, 1)
    found = pa.ListArray.from_arrays(pa.array(starts_of(_lengths(groups)), pa.int32()), pa.array(out, mask=~known))
    return pa.ListArray.from_arrays(pa.array(starts_of(_lengths(pairs)), pa.int32()), found)


def divergences(attention: Column, pairs: Column, mask: Column | None = None, floor: float = 1e-6) -> Column:
    """The ``divergence`` of every pair: ``attention`` holds a distribution per position, ``pairs`` lists of structs of two positions
    from 0 on, and the result a number in place of each pair."""

    def compared(attention: pa.Array, pairs: pa.Array) -> pa.Array:
        return _divergences(attention, pairs, floor)

    def masked(attention: pa.Array, pairs: pa.Array, mask: pa.Array) -> pa.Array:
        return _divergences(attention, pairs, floor, mask)

    made = F.arrow_udf(compared if mask is None else masked, "array<array<double>>")
    return made(attention.cast("array<array<double>>"), pairs, *([] if mask is None else [mask]))


def mean_heads(attention: DataFrame, *keys: str) -> DataFrame:
    """(keys, weights): mean distribution over attention heads. Rows: keys, head_no, weights."""
    return attention.groupBy(*keys).agg(F.collect_list("weights").alias("ws")).select(
        *keys, vectors.mean(F.col("ws")).alias("weights")
    )


def phrase_losses(
    df: DataFrame, attention: str, mask: str | None = None, temperature: float = 0.1, sign: float = 1.0
) -> DataFrame:
    """(sent_id, …, root, loss): the contrastive loss of every phrase set over the divergences of its positions.

    ``attention`` holds one distribution per position. With ``sign`` = 1 the divergence itself is the score,
    with -1 its negative, a similarity.
    """
    keep = [c for c in df.columns if c not in ("phrase_sets", attention)]

    def pairs(s: Column) -> Column:
        pair = lambda p: F.struct(s["query"].cast("int").alias("a"), p.cast("int").alias("b"))
        return F.concat(F.array(pair(s["positive"])), F.transform(s["negatives"], pair))

    def loss(s: Column, found: Column) -> Column:
        score = lambda d: d * F.lit(sign)
        rest = F.transform(F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0))), score)
        return F.struct(s["root"].alias("root"), info_nce(score(F.get(found, F.lit(0))), rest, temperature).alias("loss"))

    paired = computed(df, _pairs=F.transform("phrase_sets", pairs))
    found = divergences(F.col(attention), F.col("_pairs"), F.col(mask) if mask else None)
    compared = paired.select(*keep, "phrase_sets", found.alias("_found"))
    scored = computed(compared, _scored=F.transform("phrase_sets", lambda s, i: let(F.get("_found", i), lambda d: loss(s, d))))
    return scored.select(*keep, exploded(F.col("_scored")).alias("x")).select(*keep, "x.*")


def phrase_loss(df: DataFrame, attention: str, settings: PhraseSettings, *keys: str, mask: str | None = None, sign: float = 1.0) -> DataFrame:
    """(keys, loss): the mean phrase loss of the layers that the settings choose. Rows are layers of sentences."""
    losses = cut_lineage(phrase_losses(df, attention, mask, settings.temperature, sign).select(*dict.fromkeys([*keys, "layer"]), "loss"))
    return layer_choice(losses, "loss", settings.last_layer_only, *keys)

"""Check queries: closure, subtrees, contrastive sets, attention range, expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from treespark.functions.arrays import computed, exploded, posexploded
from treespark.functions.draws import draw_key
from treespark.operators import attention, contrast, scoring, subword, tokens, trees
from treespark.plans import derived
from treespark.plans.oracle import draw, key, ranks, sql
from treespark.plans.registry import query
from treespark.session import dealt


def joined(ids):
    """An id array as text."""
    return F.array_join(F.col(ids).cast("array<string>") if isinstance(ids, str) else ids.cast("array<string>"), ",")


# --- closure and subtrees -----------------------------------------------------------------------------


@query("c6_closure", sql("SELECT sent_id, id, anc, CAST(dist AS BIGINT) AS dist FROM closure", "closure"))
def _(spark, sf):
    return trees.closure(derived.sentences(spark, sf))


LONG = {
    "whole": """SELECT doc_id * (SELECT max(length(text)) + 1 FROM documents) + ln AS sent_id, w, len(w) // 2 + 1 AS r
FROM (SELECT doc_id, ln, list_filter(string_split(line, ' '), lambda x: x <> '') AS w FROM lines) WHERE len(w) > 0""",
    "arcs": """SELECT sent_id, id, CASE WHEN id = r THEN 0 WHEN id < r THEN least(r, id + 1 + length(form) % 3) ELSE greatest(r, id - 1 - length(form) % 3) END AS head
FROM (SELECT sent_id, r, unnest(range(1, len(w) + 1)) AS id, unnest(w) AS form FROM whole)""",
    "paths": """SELECT sent_id, id, id AS anc, 0 AS dist FROM arcs
UNION ALL SELECT p.sent_id, p.id, a.head, p.dist + 1 FROM paths p JOIN arcs a ON a.sent_id = p.sent_id AND a.id = p.anc WHERE a.head <> 0""",
}


@query("c6_long_closure", sql("SELECT sent_id, id, count(*) AS ancestors, CAST(sum(dist * anc) AS BIGINT) AS mass FROM paths GROUP BY sent_id, id", "lines", **LONG))
def _(spark, sf):
    """Lines as one sentence each, however long: the closure by joins of rows, summed up by word."""
    paths = trees.closure_by_joins(derived.long_arcs(spark, sf))
    return paths.groupBy("sent_id", "id").agg(F.count("*").alias("ancestors"), F.sum(F.col("dist") * F.col("anc")).alias("mass"))


@query(
    "c7_adjacent_words",
    sql("SELECT t.sent_id, t.id, o.id AS other FROM tb t JOIN tb o ON o.sent_id = t.sent_id AND (o.id = t.id - 1 OR o.id = t.id + 1)", "tb"),
)
def _(spark, sf):
    rows = trees.edges(derived.sentences(spark, sf).withColumn("n", F.size("head")), "n")
    beside = rows.select("sent_id", "n", "id", F.explode(F.array(F.col("id") - 1, F.col("id") + 1)).alias("other"))
    return beside.where("other between 1 and n").select("sent_id", "id", "other")


OUTSIDE = sql(
    """SELECT s.sent_id, s.root, t.id FROM sub s JOIN tb t ON t.sent_id = s.sent_id
WHERE s.height <= 2 AND s.size >= 2 AND NOT list_contains(s.members, t.id)""",
    "sub", "tb",
)


@query("c8_outside_words", OUTSIDE)
@query("f4_difference", OUTSIDE)
def _(spark, sf):
    rows = trees.subtree_rows(derived.sentences(spark, sf).withColumn("n", F.size("head")), "n")
    flat = rows.where("height <= 2 and size >= 2")
    outside = F.array_except(F.sequence(F.lit(1), F.col("n")), F.col("members"))
    return flat.select("sent_id", "root", exploded(outside).alias("id"))


@query("d8_sizes_and_heights", sql("SELECT sent_id, root, size, CAST(height AS BIGINT) AS height FROM sub", "sub"))
def _(spark, sf):
    return trees.subtree_rows(derived.sentences(spark, sf)).select("sent_id", "root", "size", "height")


@query(
    "h2_off_tree",
    sql("SELECT sent_id, id FROM tb WHERE n % 6 = 0", "tb"),
)
def _(spark, sf):
    """The root word is hung on the word after it, which hangs on the root word: no word leads to 0 any more."""
    root = F.array_position("head", 0).cast("int")
    bent = F.transform("head", lambda h: F.when((h == 0) & (F.size("head") % 6 == 0), root + 1).otherwise(h))
    report = trees.off_tree_report(computed(derived.sentences(spark, sf), head=bent))
    return report.select("sent_id", exploded(F.col("off_tree")).alias("id"))


@query("h3_subtrees", sql("SELECT sent_id, root, array_to_string(members, ',') AS members FROM sub", "sub"))
def _(spark, sf):
    return trees.subtree_rows(derived.sentences(spark, sf)).select("sent_id", "root", joined("members").alias("members"))


@query("h4_neighbours", sql("SELECT sent_id, root, id FROM nb", "nb"))
def _(spark, sf):
    return trees.subtree_rows(derived.sentences(spark, sf)).select("sent_id", "root", exploded(F.col("neighbours")).alias("id"))


@query("h5_eligible_sizes", sql(
    """SELECT t.split, e.size, count(*) AS subtrees, CAST(sum(len(e.vals)) AS BIGINT) AS neighbours, CAST(max(e.height) AS BIGINT) AS height
FROM elig e JOIN (SELECT DISTINCT sent_id, split FROM tb) t ON t.sent_id = e.sent_id GROUP BY t.split, e.size""", "elig", "tb"))
def _(spark, sf):
    rows = trees.eligible_subtrees(derived.sentences(spark, sf), trees.SubtreeLimits(), "split")
    return rows.groupBy("split", "size").agg(
        F.count("*").alias("subtrees"), F.sum(F.size("neighbours")).alias("neighbours"), F.max("height").alias("height")
    )


@query("h5_eligible_subtrees", sql(
    "SELECT sent_id, root, size, array_to_string(vals, ',') AS neighbours FROM elig", "elig"))
def _(spark, sf):
    rows = trees.eligible_subtrees(derived.sentences(spark, sf))
    return rows.select("sent_id", "root", "size", joined("neighbours").alias("neighbours"))


SAMPLED = sql(
    f"""SELECT sent_id, root FROM (SELECT sent_id, root, row_number() OVER (PARTITION BY sent_id
ORDER BY {key("'subtree'", 'sent_id', 'root')}) AS r FROM elig) WHERE r <= 2""",
    "elig",
)


@query("h6_sampled_subtrees", SAMPLED)
@query("g5_sample_per_group", SAMPLED)
@query("m3_sampler", SAMPLED)
def _(spark, sf):
    sample = contrast.random_subtrees(2)
    df = derived.sentences(spark, sf)

    chosen = df.select("sent_id", sample(F.col("sent_id"), trees.eligible(F.col("head"))).alias("chosen"))
    return chosen.select("sent_id", exploded(F.col("chosen")).alias("s")).select("sent_id", "s.root")


# --- contrastive trees --------------------------------------------------------------------------------


def _combinations(source: str) -> str:
    return f"""SELECT sent_id, root, 1 AS k, [id] AS ids, n - rk AS rest, mem AS gone FROM {source}
UNION ALL SELECT a.sent_id, a.root, 2, [a.id, b.id], a.n - b.rk, list_distinct(list_concat(a.mem, b.mem))
FROM {source} a JOIN {source} b ON b.sent_id = a.sent_id AND b.root = a.root AND a.rk < b.rk
UNION ALL SELECT a.sent_id, a.root, 3, [a.id, b.id, c.id], a.n - c.rk, list_distinct(list_concat(list_concat(a.mem, b.mem), c.mem))
FROM {source} a JOIN {source} b ON b.sent_id = a.sent_id AND b.root = a.root AND a.rk < b.rk
JOIN {source} c ON c.sent_id = a.sent_id AND c.root = a.root AND b.rk < c.rk"""


def _ranked(ids: str) -> str:
    return f"""SELECT x.sent_id, x.root, x.id, s.members AS mem,
row_number() OVER (PARTITION BY x.sent_id, x.root ORDER BY x.id) AS rk, count(*) OVER (PARTITION BY x.sent_id, x.root) AS n
FROM (SELECT sent_id, root, unnest({ids}) AS id FROM elig) x JOIN sub s ON s.sent_id = x.sent_id AND s.root = x.id"""


def _longer(rest: str) -> str:
    return f"CASE k WHEN 1 THEN {rest} + {rest} * ({rest} - 1) // 2 WHEN 2 THEN {rest} ELSE 0 END"


NEGATIVE_CTES = {
    "targets": _ranked("list_filter(members, lambda m: m <> root)"),
    "vals": _ranked("vals"),
    "tc": _combinations("targets"),
    "vc": _combinations("vals"),
    "plans": f"""SELECT sent_id, root, k, t.ids AS targets, v.ids AS vals, t.gone, v.gone AS added,
1 + {_longer('v.rest')} + {_longer('t.rest')} AS repeats, count(*) OVER (PARTITION BY sent_id, root) AS total,
row_number() OVER (PARTITION BY sent_id, root ORDER BY k, len(t.gone), t.ids, len(v.gone), v.ids) - 1 AS rank
FROM tc t JOIN vc v USING (sent_id, root, k) WHERE abs(len(v.gone) - len(t.gone)) <= 1""",
    "found": "SELECT sent_id, root, CAST(sum(repeats) AS BIGINT) AS found, max(total) AS total FROM plans GROUP BY sent_id, root HAVING sum(repeats) > 1",
    "drawn": f"SELECT sent_id, root, unnest({ranks('total', 10, chr(39) + 'negative' + chr(39), 'sent_id', 'root')}) AS rank FROM found",
    "negatives": """SELECT b.sent_id, b.root, b.rank, b.targets, b.vals,
list_sort(list_concat(list_filter(e.members, lambda m: NOT list_contains(b.gone, m)), b.added)) AS ids
FROM plans b JOIN drawn d USING (sent_id, root, rank) JOIN elig e ON e.sent_id = b.sent_id AND e.root = b.root""",
    "hung": """SELECT n.sent_id, n.root, n.rank, n.id, CASE WHEN n.id = n.root THEN 0
WHEN n.at > 0 AND NOT list_has_any(u.up, list_slice(n.vals, n.at + 1, len(n.vals))) THEN r.head ELSE o.head END AS head
FROM (SELECT *, coalesce(list_position(vals, id), 0) AS at FROM (SELECT sent_id, root, rank, targets, vals, unnest(ids) AS id FROM negatives)) n
JOIN tb o ON o.sent_id = n.sent_id AND o.id = n.id JOIN ups u ON u.sent_id = n.sent_id AND u.id = n.id
LEFT JOIN tb r ON r.sent_id = n.sent_id AND n.at > 0 AND r.id = n.targets[n.at]""",
}
NEEDS = ("elig", "sub", "ups", "tb")


@query(
    "c9_combinations",
    sql(
        """SELECT t.sent_id, t.root, t.n AS target_choices, v.n AS value_choices, t.sizes AS target_sizes, v.sizes AS value_sizes, v.longest FROM
(SELECT sent_id, root, count(*) AS n, CAST(sum(len(gone)) AS BIGINT) AS sizes FROM tc GROUP BY sent_id, root) t
JOIN (SELECT sent_id, root, count(*) AS n, CAST(sum(len(gone)) AS BIGINT) AS sizes, array_to_string(max(ids), ',') AS longest FROM vc GROUP BY sent_id, root) v USING (sent_id, root)""",
        *NEEDS, **NEGATIVE_CTES,
    ),
)
def _(spark, sf):
    total = lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + x["size"])
    df = derived.sentences(spark, sf)
    chosen = df.select("sent_id", "head", trees.eligible(F.col("head")).alias("chosen"))
    choices = chosen.select("sent_id", contrast.combinations(F.col("head"), F.col("chosen")).alias("choices"))
    rows = choices.select("sent_id", exploded(F.col("choices")).alias("c")).select("sent_id", "c.*")
    return rows.select(
        "sent_id", "root", F.size("targets").alias("target_choices"), F.size("values").alias("value_choices"),
        total("targets").alias("target_sizes"), total("values").alias("value_sizes"),
        joined(F.array_max(F.transform("values", lambda v: v["ids"]))).alias("longest"))


@query("b15_several_negatives", sql("SELECT sent_id, root, found, total FROM found", *NEEDS, **NEGATIVE_CTES))
def _(spark, sf):
    df = contrast.tree_sets(derived.sentences(spark, sf))
    return df.select("sent_id", exploded(F.col("tree_sets")).alias("s")).select("sent_id", F.col("s.root_id").alias("root"), "s.found", "s.total")


@query(
    "h7_negative_trees",
    sql(
        """SELECT n.sent_id, n.root, array_to_string(n.targets, ',') AS targets, array_to_string(n.vals, ',') AS replacements,
array_to_string(n.ids, ',') AS ids, h.heads FROM negatives n JOIN (SELECT sent_id, root, rank, string_agg(head, ',' ORDER BY id) AS heads
FROM hung GROUP BY sent_id, root, rank) h USING (sent_id, root, rank)""",
        *NEEDS, **NEGATIVE_CTES,
    ),
)
def _(spark, sf):
    df = contrast.tree_sets(derived.sentences(spark, sf))
    sets = df.select("sent_id", exploded(F.col("tree_sets")).alias("s")).select("sent_id", "s.*")
    rows = sets.select("sent_id", "root_id", exploded(F.arrays_zip("negatives", "plans")).alias("x"))
    return rows.select(
        "sent_id", F.col("root_id").alias("root"),
        joined(F.col("x.plans.targets")).alias("targets"), joined(F.col("x.plans.values")).alias("replacements"),
        joined(F.map_keys("x.negatives")).alias("ids"),
        joined(F.transform(F.map_values("x.negatives"), lambda h: F.coalesce(h, F.lit(0)))).alias("heads"),
    )


@query(
    "h8_tree_sets",
    sql(
        """SELECT h.sent_id, h.root, f.found, count(DISTINCT h.rank) AS negatives, CAST(sum(h.id * (1 + h.head)) AS BIGINT) AS mass,
array_to_string(any_value(e.members), ',') AS ids, any_value(e.heads) AS heads
FROM hung h JOIN found f USING (sent_id, root) JOIN (SELECT e.sent_id, e.root, e.members, string_agg(CASE WHEN t.id = e.root THEN 0 ELSE t.head END, ',' ORDER BY t.id) AS heads
FROM (SELECT sent_id, root, members, unnest(members) AS id FROM elig) e JOIN tb t ON t.sent_id = e.sent_id AND t.id = e.id GROUP BY e.sent_id, e.root, e.members) e
ON e.sent_id = h.sent_id AND e.root = h.root GROUP BY h.sent_id, h.root, f.found""",
        *NEEDS, **NEGATIVE_CTES,
    ),
)
def _(spark, sf):
    """Every set with its positive tree whole, and the sum of id x (head + 1) over its negatives."""
    df = contrast.tree_sets(derived.sentences(spark, sf))
    sets = df.select("sent_id", exploded(F.col("tree_sets")).alias("s")).select("sent_id", "s.*")
    whole = lambda m: F.transform(F.map_values(m), lambda h: F.coalesce(h, F.lit(0)))
    mass = lambda m: F.aggregate(
        F.zip_with(F.map_keys(m), whole(m), lambda i, h: i * (h + 1)), F.lit(0), lambda a, b: a + b)
    return sets.select(
        "sent_id", F.col("root_id").alias("root"), "found", F.size("negatives").alias("negatives"),
        F.aggregate(F.transform("negatives", mass), F.lit(0).cast("bigint"), lambda a, b: a + b).alias("mass"),
        joined(F.map_keys("positive")).alias("ids"), joined(whole(F.col("positive"))).alias("heads"))


# --- phrase sets --------------------------------------------------------------------------------------

PHRASE_CTES = {
    "flat": "SELECT s.*, t.n FROM sub s JOIN (SELECT DISTINCT sent_id, n FROM tb) t USING (sent_id) WHERE height <= 2 AND size >= 2 AND size < n",
    "two": f"""SELECT sent_id, root, size, members, {draw("'positive'", 'sent_id', 'root')} % size AS p, {draw("'query'", 'sent_id', 'root')} % (size - 1) AS q FROM flat""",
    "pos": "SELECT sent_id, root, members[p + 1] AS id FROM two",
    "qry": "SELECT sent_id, root, members[CASE WHEN q < p THEN q ELSE q + 1 END + 1] AS id FROM two",
    "shut": f"""SELECT f.sent_id, f.root, f.size, p.place AS begin, {ranks('(f.n - f.size)', 10, chr(39) + 'outside' + chr(39), 'f.sent_id', 'f.root')} AS ranks
FROM flat f JOIN places p ON p.sent_id = f.sent_id AND p.id = f.root""",
    "neg": """SELECT s.sent_id, s.root, s.place, p.id FROM (SELECT sent_id, root, size, begin, unnest(ranks) AS r, unnest(range(1, len(ranks) + 1)) AS place FROM shut) s
JOIN places p ON p.sent_id = s.sent_id AND p.place = CASE WHEN s.r < s.begin THEN s.r ELSE s.r + s.size END""",
    "phrases": """SELECT p.sent_id, p.root, wq.b AS query, wpos.b AS positive, string_agg(wn.b, ',' ORDER BY n.place) AS negatives
FROM pos p JOIN qry q ON q.sent_id = p.sent_id AND q.root = p.root JOIN neg n ON n.sent_id = p.sent_id AND n.root = p.root
JOIN wp wq ON wq.sent_id = p.sent_id AND wq.id = q.id JOIN wp wpos ON wpos.sent_id = p.sent_id AND wpos.id = p.id
JOIN wp wn ON wn.sent_id = p.sent_id AND wn.id = n.id GROUP BY p.sent_id, p.root, wq.b, wpos.b""",
}


@query("h9_phrase_sets", sql("SELECT * FROM phrases", "sub", "tb", "wp", "places", **PHRASE_CTES))
def _(spark, sf):
    df = contrast.phrase_sets(derived.encoded(spark, sf), "token_spans")
    rows = df.select("sent_id", exploded(F.col("phrase_sets")).alias("s")).select("sent_id", "s.*")
    return rows.withColumn("negatives", joined("negatives"))


@query(
    "b16_with_phrase_sets",
    sql("SELECT t.split, count(DISTINCT f.sent_id) AS sentences, count(*) AS sets FROM flat f JOIN (SELECT DISTINCT sent_id, split FROM tb) t USING (sent_id) GROUP BY t.split", "sub", "tb", flat=PHRASE_CTES["flat"]),
)
def _(spark, sf):
    df = contrast.phrase_sets(derived.encoded(spark, sf), "token_spans").where(F.size("phrase_sets") > 0)
    return df.groupBy("split").agg(F.count("*").alias("sentences"), F.sum(F.size("phrase_sets")).alias("sets"))


@query("h10_first_pieces", sql("SELECT sent_id, id, b AS first_piece FROM wp", "wp"))
def _(spark, sf):
    firsts = contrast.first_pieces(F.col("token_spans"))
    rows = derived.encoded(spark, sf).select("sent_id", posexploded(firsts).alias("i", "first_piece"))
    return rows.select("sent_id", (F.col("i") + 1).alias("id"), "first_piece")


# --- attention range ----------------------------------------------------------------------------------

REACH = {
    "adj": "SELECT sent_id, id AS a, head AS b FROM tb WHERE head > 0 UNION ALL SELECT sent_id, head, id FROM tb WHERE head > 0",
    "d2": "SELECT x.sent_id, x.a, y.b FROM adj x JOIN adj y ON y.sent_id = x.sent_id AND y.a = x.b",
    "d3": "SELECT x.sent_id, x.a, y.b FROM d2 x JOIN adj y ON y.sent_id = x.sent_id AND y.a = x.b",
    "reach": """SELECT sent_id, a AS id, b AS other FROM adj UNION SELECT sent_id, a, b FROM d2 UNION SELECT sent_id, a, b FROM d3
UNION SELECT sent_id, a, a FROM adj""",
    "cells": """SELECT sent_id, id AS i, other AS j FROM reach UNION SELECT r.sent_id, r.id + 1, r.other FROM reach r JOIN tb t
ON t.sent_id = r.sent_id AND t.id = r.id + 1
UNION SELECT sent_id, id, 0 FROM tb UNION SELECT sent_id, id, n + 1 FROM tb
UNION SELECT sent_id, 0, unnest(range(0, n + 2)) FROM (SELECT DISTINCT sent_id, n FROM tb)""",
}


@query("h11_within_distance", sql("SELECT sent_id, id, other FROM reach", "tb", **REACH))
def _(spark, sf):
    return attention.reach_rows(derived.sentences(spark, sf), 3)


CELLS = sql("SELECT sent_id, i, j FROM cells", "tb", **REACH)


@query("h12_attention_pairs", CELLS)
@query("f5_union_of_reach", CELLS)
def _(spark, sf):
    return attention.attention_pairs(derived.sentences(spark, sf))


@query(
    "h12_dense_mask",
    sql(
        """SELECT t.sent_id, (t.n + 2) * (t.n + 2) AS cells, c.opened, ((t.n + 2) * (t.n + 2) - c.opened) * -1e6::DOUBLE AS total
FROM (SELECT DISTINCT sent_id, n FROM tb) t JOIN (SELECT sent_id, count(*) AS opened FROM cells GROUP BY sent_id) c USING (sent_id)""",
        "tb", **REACH,
    ),
)
def _(spark, sf):
    df = attention.dense_mask(derived.sentences(spark, sf))
    flat = computed(df, v=F.flatten("dep_att_mask"))
    return flat.select(
        "sent_id", F.size("v").alias("cells"), F.size(F.filter("v", lambda x: x == 0)).alias("opened"),
        F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("total"),
    )


# --- expansion ----------------------------------------------------------------------------------------

EXPANDED = """SELECT p.sent_id, p.pos AS id, CASE WHEN p.k = 1 THEN CASE WHEN w.head = 0 THEN 0 ELSE h.b END ELSE w.b END AS head,
CASE WHEN p.k = 1 THEN w.deprel ELSE 'subword' END AS deprel
FROM pc p JOIN wp w ON w.sent_id = p.sent_id AND w.id = p.id LEFT JOIN wp h ON h.sent_id = w.sent_id AND h.id = w.head"""


@query("h1_expanded_trees", sql(EXPANDED, "pc", "wp"))
def _(spark, sf):
    df = subword.expand_subwords(derived.encoded(spark, sf))
    return tokens.token_rows(df, ["head", "deprel"])


@query("h1_expanded_spans", sql("SELECT sent_id, CAST(max(pos) AS BIGINT) + 2 AS spans, CAST(sum(pos) + max(pos) + 1 AS BIGINT) AS total FROM pc GROUP BY sent_id", "pc"))
def _(spark, sf):
    df = subword.expand_subwords(derived.encoded(spark, sf))
    total = F.aggregate("dependency_token_spans", F.lit(0), lambda s, x: s + x["b"])
    return df.select("sent_id", F.size("dependency_token_spans").alias("spans"), total.alias("total"))


@query("e1_spans", sql("SELECT sent_id, id, b, e FROM wp", "wp"))
def _(spark, sf):
    inner = subword.trim_special(F.col("token_spans"))
    rows = derived.encoded(spark, sf).select("sent_id", posexploded(inner).alias("i", "s"))
    return rows.select("sent_id", (F.col("i") + 1).alias("id"), "s.b", "s.e")


@query("e1_window_spans", sql("SELECT sent_id, id, np AS pieces, b, e FROM wp", "wp"))
def _(spark, sf):
    df = derived.sentences(spark, sf)
    rows = tokens.token_rows(computed(df, pieces=derived.piece_counts(F.col("tokens"))), ["pieces"])
    return subword.window_spans(rows)


@query("e2_piece_budget", sql("SELECT sent_id, count(*) AS words, CAST(sum(np) AS BIGINT) AS pieces FROM wp WHERE e <= 18 GROUP BY sent_id", "wp"))
def _(spark, sf):
    df = derived.sentences(spark, sf)
    rows = tokens.token_rows(computed(df, pieces=derived.piece_counts(F.col("tokens"))), ["pieces"])
    return subword.window_spans(rows, 20).groupBy("sent_id").agg(F.count("*").alias("words"), F.sum("pieces").alias("pieces"))


@query("e3_id_map", sql("SELECT sent_id, id AS old_id, b AS new_id FROM wp UNION ALL SELECT DISTINCT sent_id, 0, 0 FROM tb", "wp", "tb"))
def _(spark, sf):
    df = derived.encoded(spark, sf)
    return df.select("sent_id", F.posexplode(subword.id_map(F.col("token_spans"))).alias("old_id", "new_id"))


@query("h17_trimmed_spans", sql("SELECT sent_id, id, b - 1 AS b, e - 1 AS e FROM wp", "wp"))
def _(spark, sf):
    inner = subword.trim_spans(F.col("token_spans"))
    rows = derived.encoded(spark, sf).select("sent_id", posexploded(inner).alias("i", "s"))
    return rows.select("sent_id", (F.col("i") + 1).alias("id"), "s.b", "s.e")


#: Arcs that one part of the sentences grows to, about, or one sentence.
ARCS_SORTED = 1 << 20
ARCS = f"SELECT c.sent_id, c.id, h.id AS head, {key('c.sent_id', 'c.id', 'h.id')} AS score FROM tb c JOIN (SELECT sent_id, id FROM tb UNION ALL SELECT DISTINCT sent_id, 0 FROM tb) h ON h.sent_id = c.sent_id AND h.id <> c.id"


@query("h19_chosen_heads", sql(f"SELECT sent_id, id, arg_max(head, score) AS head FROM ({ARCS}) GROUP BY sent_id, id", "tb"))
def _(spark, sf):
    score = lambda i: lambda h: draw_key(F.col("sent_id"), i + 1, h)
    scores = F.transform("head", lambda _, i: F.transform(F.sequence(F.lit(0), F.size("head")), score(i)))
    df = computed(derived.sentences(spark, sf), head=scoring.greedy_heads(scores))
    return trees.edges(df)


@query("h19_heads_of_arcs", sql(f"SELECT sent_id, id, arg_max(head, score) AS head FROM ({ARCS}) GROUP BY sent_id, id", "tb"))
def _(spark, sf):
    """The same choice over rows of scored arcs, those of a word with itself included."""
    sizes = derived.sentences(spark, sf).select("sent_id", F.size("head").alias("n"))
    # Dealt before sentences grow to squares: the choice then moves no arcs and sorts some at a time.
    words = dealt(sizes, "sent_id", F.col("n").cast("bigint") * (F.col("n") + 1), ARCS_SORTED).select(
        "sent_id", "n", F.explode(F.sequence(F.lit(1), "n")).alias("id"))
    arcs = words.select("sent_id", "id", exploded(F.sequence(F.lit(0), "n")).alias("head"))
    return scoring.choose_heads(arcs.withColumn("score", draw_key(F.col("sent_id"), F.col("id"), F.col("head"))))

"""Exact, near and substring dedup against plain versions."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from treespark.llm import common, exact_dedup, simhash, substrings

UPPER = str.maketrans(common.UPPER, common.UPPER.lower())


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plain_exact(rows, pick):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(UPPER), []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = pick(known) if known else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("keep,pick", [("smallest", min), ("largest", max)])
@pytest.mark.parametrize("digest", [F.md5, lambda c: F.substring(F.md5(c), 1, 1)])
def test_exact_dedup(docs, keep, pick, digest):
    rows = [(1, "Same text"), (2, "same TEXT"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 50_000), (None, "same text"),
            (None, "alone"), (8, "twice"), (8, "twice"), *[(100 + i, f"t{i % 7}") for i in range(60)]]
    got = rows_of(exact_dedup.exact_dedup(docs(*rows), keep=keep, digest=digest))
    assert got == plain_exact(rows, pick)


def test_exact_dedup_of_nothing(docs, spark):
    assert exact_dedup.exact_dedup(docs((1, "a")).where("false")).count() == 0


def test_without_copies_keeps_columns_and_one_row(docs):
    made = docs((1, "a"), (2, "A"), (2, "A"), (3, "b"), (4, None), (5, ""))
    kept = exact_dedup.without_copies(made, keep="largest")
    assert kept.columns == made.columns
    assert rows_of(kept.select("doc_id", "text")) == [(2, "A"), (3, "b"), (5, "")]


def plain_print(text, k=3):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    names = list(range(len(prints)))

    def top(i):
        while names[i] != i:
            i = names[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                names[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(prints))]


def test_simhash_against_all_pairs(docs):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    base = [rng.choices(words, k=300) for _ in range(12)]
    texts = []
    for _ in range(150):
        copy = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    texts += ["", "a", "A b", "a\tB", " ", "  "]
    rows = list(enumerate(texts)) + [(len(texts), None)]
    got = {r.doc_id: r for r in simhash.near_dedup(docs(*rows)).collect()}
    prints = [plain_print(t) for _, t in rows]
    assert [int(got[i].fingerprint, 16) for i, _ in rows] == prints
    assert [got[i].component_id for i, _ in rows] == plain_components(prints)


def test_links_of_large_buckets(spark):
    """A dense cloud of fingerprints, far more than are paired: midpoints link what pairs would."""
    rng = np.random.default_rng(5)
    center = int(rng.integers(0, 2**63))
    prints = {center}
    while len(prints) < 400:
        p = center
        for b in rng.choice(64, rng.integers(1, 7), replace=False):
            p ^= 1 << int(b)
        prints.add(p)
    prints = sorted(prints)
    signed = [(p - 2**64 if p >= 2**63 else p, i) for i, p in enumerate(prints)]
    df = spark.createDataFrame(signed, "fp long, v long").withColumn("k", F.lit(0))
    reach = {r.v: r.component for r in common.components(simhash.links(df)).collect()}
    assert [reach.get(i, i) for i in range(len(prints))] == plain_components(prints)


def test_every_near_pair_meets_in_a_table():
    masks = simhash.masks()
    for i in range(64):
        for j in range(64):
            flip = (1 << i) | (1 << j)
            assert any(m & flip == 0 for m in masks)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(7, 500)]
    got = {r.v: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[60] == 0 and got[500] == 0 and got[150] == 100 and len(got) == 61 + 80 + 1


def test_near_dedup_edges(docs):
    made = docs((None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (9, "a b c d"))
    got = rows_of(simhash.near_dedup(made).select("doc_id", "component_id"))
    assert got == [(3, 3), (3, 3), (9, 3), (None, 3)]
    assert simhash.near_dedup(made.where("false")).count() == 0


def test_without_near_copies(docs):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(400)]
    text = [rng.choices(words, k=250) for _ in range(3)]
    near = list(text[0])
    near[17], near[99] = "other", "another"
    made = docs((5, " ".join(text[0])), (6, " ".join(near)), (7, " ".join(text[1])), (8, " ".join(text[2])), (9, None))
    kept = simhash.without_near_copies(made, seeds=tuple(range(42, 50)))
    assert kept.columns == made.columns
    assert sorted(r.doc_id for r in kept.collect()) == [5, 7, 8, 9]


def jaccard(x, y, k=5):
    a, b = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (x.lower().split(), y.lower().split()))
    return len(a & b) / len(a | b)


def test_near_copies_are_those_of_brute_force(docs):
    """Edited copies on both sides of 0.8, and texts of the same words in another order, which are no copies."""
    rng = random.Random(12)
    words = [f"word{i}" for i in range(3000)]
    rows = []
    for k in range(90):
        text = rng.choices(words, k=rng.choice([30, 100, 300, 1000]))
        copy = list(text)
        for at in rng.sample(range(len(copy)), max(1, int(len(copy) * rng.uniform(0.005, 0.035)))):
            copy[at] = rng.choice(words)
        if k % 9 == 0:
            copy = [w for i in range(0, len(text), 10) for w in reversed(text[i : i + 10])]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(copy))]
    base = rng.choices(words, k=200)  # a group larger than the buckets that are paired
    for i in range(80):
        copy = list(base)
        copy[2 * i] = "other"
        rows.append((1000 + i, " ".join(copy)))
    same = {2 * k + 1: jaccard(rows[2 * k][1], rows[2 * k + 1][1]) for k in range(90)}
    assert sum(0.8 <= x < 0.85 for x in same.values()) > 8 and sum(0.7 < x < 0.8 for x in same.values()) > 8
    kept = {r.doc_id for r in simhash.without_near_copies(docs(*rows), seeds=tuple(range(42, 50))).collect()}
    assert {i for i, x in same.items() if i not in kept} == {i for i, x in same.items() if x >= 0.8}
    assert {i for i in kept if i >= 1000} == {1000} and all(2 * k in kept for k in range(90))


def test_large_group_of_mixed_copies(docs):
    """400 versions of a text, about a fifth of the pairs near copies, against brute force."""
    rng = random.Random(21)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        copy = list(base)
        for at in rng.sample(range(300), rng.choice([3, 4, 5])):
            copy[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    grams = [{tuple(w[k : k + 5]) for k in range(296)} for w in (t.split() for _, t in rows)]
    group = list(range(400))
    for i in range(400):
        todo = [i] if group[i] == i else []
        while todo:
            a = todo.pop()
            near = [b for b in range(i + 1, 400) if group[b] == b and 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b])]
            for b in near:
                group[b] = i
            todo += near
    kept = {r.doc_id for r in simhash.without_near_copies(docs(*rows), seeds=tuple(range(42, 50))).collect()}
    assert kept == set(group) and 1 < len(kept) < 15


def groups_by_brute_force(texts):
    """The smallest id that links of near copies reach, for (id, text) pairs; an id of several texts is one document."""
    grams = [(i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set()) for i, t in texts]
    top = {i: i for i, _ in grams}

    def reach(i):
        while top[i] != i:
            i = top[i]
        return i

    for n, (i, x) in enumerate(grams):
        for j, y in grams[:n]:
            if 5 * len(x & y) >= 4 * len(x | y):
                a, b = sorted((reach(i), reach(j)))
                top[b] = a
    return {i: reach(i) for i in top}


def versions(rng, base, n, most):
    """Versions of a text: words replaced by new ones, by common ones, or left out."""
    out = []
    for _ in range(n):
        copy = list(base)
        for at in rng.sample(range(len(base)), rng.randint(0, most)):
            copy[at] = rng.choice([f"x{rng.randrange(10**7)}", f"x{rng.randrange(10**7)}", "common", ""])
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("main", [0, 7, 151, 300])
def test_left_links_are_those_of_all_pairs(docs, spark, main):
    """Two texts' versions in one group around any of its texts, none of which is in a component yet."""
    rng = random.Random(31)
    base = [f"w{i}" for i in range(120)]
    other = base[:100] + [f"v{i}" for i in range(20)]
    rows = list(enumerate(versions(rng, base, 150, 9) + versions(rng, other, 150, 9)))
    rows += [(300, "alone"), (301, ""), (302, None), (303, "w1 w2"), (304, " ".join(base)), (304, "w1 w2"), (304, "")]
    groups = spark.createDataFrame([(main, i, i, 305) for i in range(305)], "main long, doc_id long, c long, n long")
    got = {r.v: r.component for r in common.components(simhash.left_links(docs(*rows), groups)).collect()}
    want = groups_by_brute_force(rows)
    assert {i: got.get(i, i) for i in want} == want and 20 < len(set(want.values())) < 280


def test_versions_far_from_each_other_are_not_paired(docs, monkeypatch):
    """Versions that meet in large buckets, half of them near no other: pairs counted out stay linear in the group."""
    rng = random.Random(32)
    base = [f"w{i}" for i in range(150)]
    rows = list(enumerate(" ".join(f"x{rng.randrange(10**7)}" if i in at else w for i, w in enumerate(base)) for at in (
        set(rng.sample(range(150), rng.randint(0, 7))) for _ in range(700))))
    counted = []

    def counting(docs, pairs, count=simhash.alike):
        counted.append(pairs.where("a <> b").select(F.least("a", "b"), F.greatest("a", "b")).distinct().count())
        return count(docs, pairs)

    monkeypatch.setattr(simhash, "alike", counting)
    kept = {r.doc_id for r in simhash.without_near_copies(docs(*rows), seeds=tuple(range(42, 50))).collect()}
    assert kept == set(groups_by_brute_force(rows).values()) and 250 < len(kept) < 500
    assert sum(counted) < 60 * len(rows) and counted[-1] < len(rows)


def plain_substrings(rows):
    """What substring_dedup returns, by a dictionary of all runs."""
    rows = sorted(set(rows), key=lambda r: r[0])
    places, first = {}, {}
    for i, t in rows:
        raw = (t or "").encode()
        parts = list(substrings.sentences(raw))
        run, n = min(substrings.RUN, len(parts)), len(parts)
        enough = lambda a, b: b - a >= run and sum(p[3] for p in parts[a:b]) >= substrings.LEAST_WORDS
        spans = [(a, b) for a in range(n) for b in range(a + 1, n + 1) if enough(a, b)]
        from_start = {a: min(b for x, b in spans if x == a) for a, _ in spans}
        to_end = {b: max(a for a, x in spans if x == b) for _, b in spans}
        for at, till in sorted(set(from_start.items()) | {(a, b) for b, a in to_end.items()}):
            key = tuple(p[2] for p in parts[at:till])
            if key in first:
                places.setdefault((i, t), []).append(range(at, till))
            else:
                first[key] = (i, at)
    out = {}
    for (i, t), spans in places.items():
        raw = t.encode()
        gone = {k for s in spans for k in s}
        kept, at = b"", 0
        for k, (s, e, _, _) in enumerate(substrings.sentences(raw)):
            if k in gone:
                kept += raw[at:s]
                at = e
        out[i] = (len(gone), (kept + raw[at:]).decode())
    return out


def test_substring_dedup(docs):
    rng = random.Random(4)
    words = [f"{a}{b}é" for a in "abcdefgh" for b in "xyzuvw"]
    sentence = lambda n: " ".join(rng.choices(words, k=n)).capitalize() + ". "
    passage = "".join(sentence(9) for _ in range(6))
    unmarked = " ".join(rng.choices(words, k=120))
    rows = []
    for i in range(40):
        text = "".join(sentence(rng.randint(4, 12)) for _ in range(8))
        if i % 5 == 0:
            text += "\n" + passage + "\n" + sentence(5)
        if i % 7 == 0:
            text = text + sentence(3)[:-2] + " " + unmarked + " " + sentence(6)
        rows.append((i, text))
    # Short sentences: a run needs more than three of them.
    rows += [(60 + i, "".join(sentence(2) for _ in range(9)) + "Go. On. " + passage[: passage.index(". ") + 2] + "No. " * 14) for i in range(3)]
    rows += [(50, None), (51, ""), (52, "One two."), (53, "One two."), (54, "a b c d e f g h i j k l m."), (55, "A b c d e f g h i j k l m.")]
    got = {r.doc_id: (r.n_removed, r.text) for r in substrings.substring_dedup(docs(*rows)).collect()}
    assert got == plain_substrings(rows)
    assert {5, 10, 15, 7, 14, 55} <= set(got) and not {1, 2, 3, 52, 53} & set(got)
    assert all(passage not in text for _, text in got.values())
    assert substrings.substring_dedup(docs(*rows).where("false")).count() == 0


def test_deduplicated_keeps_every_row(docs):
    run = "One two three four five. Six seven eight nine ten. Eleven twelve thirteen. "
    rows = [(1, run), (2, run + "Own end."), (2, "Another text under the same id."), (2, run + "Own end."), (None, run + "Null id."), (4, None), (4, "")]
    got = sorted(((r.doc_id, r.text) for r in substrings.deduplicated(docs(*rows)).collect()), key=str)
    # The null id comes first, so its run stays.
    want = [(1, ""), (2, "Own end."), (2, "Another text under the same id."), (2, "Own end."), (None, run + "Null id."), (4, None), (4, "")]
    assert got == sorted(want, key=str)


def test_repeats_within_a_text_and_spans(docs):
    run = "One two three four five. Six seven eight nine ten. Éleven twelve thirteen. "
    row = substrings.substring_dedup(docs((1, run + "Between. " + run + "End here."))).collect()[0]
    assert row.n_removed == 3 and row.text == run + "Between. " + "End here."
    start, end = map(int, row.spans.split(":"))
    assert (run + "Between. " + run)[start:end] == run and row.first_doc_ids == [1]


def test_short_sentences_are_in_runs(docs):
    """Lists and menus of one to three words a line, with a last line that only a run to the end covers."""
    rng = random.Random(14)
    words = [f"w{i}" for i in range(500)]
    line = lambda n: " ".join(rng.choices(words, k=n))
    menu = "\n".join([*(line(rng.randint(1, 3)) for _ in range(60)), line(10), "end", "of", "menu"]) + "\n"
    shouts = "".join(line(1) + " " + line(1) + "!! " for _ in range(40))
    rows = [(i, line(9) + ".\n" + (menu if i % 2 else shouts) + line(20) + ".") for i in range(6)]
    got = {r.doc_id: r.text for r in substrings.substring_dedup(docs(*rows)).collect()}
    assert set(got) == {2, 3, 4, 5} and all(menu not in t and shouts not in t for t in got.values())
    assert [got[i] for i in (2, 3, 4, 5)] == [t.replace(menu, "").replace(shouts, "") for _, t in rows[2:]]
    assert substrings.reaches([10, 1, 1, 1]) == [(0, 3), (0, 4)] and substrings.reaches([1, 2]) == []


def test_passages_of_51_words_at_any_offset(docs):
    """Unpunctuated, in one or two long sentences, or starting inside a sentence."""
    rng = random.Random(15)
    words = [f"w{i}" for i in range(4000)]
    rows, planted = [], []
    for k in range(400):
        passage = rng.choices(words, k=51)
        if k % 3:
            passage[rng.randrange(10, 40)] += "."
        planted.append(set(passage))
        for side in range(2):
            before, after = (rng.choices(words, k=rng.randint(0, 60)) for _ in range(2))
            rows.append((2 * k + side, " ".join(before + passage + after)))
    got = {r.doc_id: r for r in substrings.substring_dedup(docs(*rows)).collect()}
    assert set(got) == {2 * k + 1 for k in range(400)}
    cut = [len(planted[k] - set(got[2 * k + 1].text.split())) / len(planted[k]) for k in range(400)]
    assert sum(cut) / len(cut) > 0.7


def test_attach_spreads_a_hot_key(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") < 1000, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    groups = common.stored(left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")))
    got = common.attach(left, groups, "k", "n", F.col("id"))
    assert got.count() == 3000 and got.where("k = 'hot' and top = 999 and n = 1000").count() == 1000
    assert got.where("k <> 'hot' and top = id").count() == 2000
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would merge the small partitions
    try:
        parts = [r["count"] for r in got.where("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(parts) > 4 and max(parts) < 250

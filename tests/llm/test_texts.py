"""Licenses, personal data, pieces and toxicity against plain versions."""

import hashlib
import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from treespark.llm import licenses, pieces, pii, toxicity

ALLOWED = frozenset(licenses.ALLOWED)


def plain_scan(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [
        (i, label) for phrase, label in licenses.BASE.items() for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_license_base_finds(docs):
    rng = random.Random(1)
    parts = ["under", "the", "MIT", "License", "apache", "license,", "version", "2", "cc", "BY-nc", "by", "nc", "é", "x1", "2.0", "—"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "-", "\n", ". ", ""]) for _ in range(60)) for _ in range(300)]
    texts += ["", "cc by nc cc by nc", "Under-the-MIT license", " \n ", "under the mit license " * 3000]
    rows = [*enumerate(texts), (900, None), (900, None)]
    got = sorted(licenses.license_scan(docs(*rows)).collect(), key=lambda r: r.doc_id)
    assert [tuple(r)[1:6] for r in got] == [plain_scan(t) for _, t in rows]
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_license_expressions():
    value = lambda x: licenses.evaluate(licenses.postfix(x.split()), ALLOWED)[0]
    assert value("mit") and not value("gpl-3.0-only")
    assert value("mit or gpl-3.0-only") and not value("mit and gpl-3.0-only")
    assert value("mit or gpl-3.0-only and gpl-2.0-only") and not value("( mit or isc ) and gpl-2.0-only")
    assert value("apache-2.0 with llvm-exception") and not value("gpl-2.0-only with classpath-exception-2.0")
    for wrong in ("", "or", "mit or", "( mit", "mit )", "mit isc", "mit and or isc", "( )"):
        assert licenses.postfix(wrong.split()) is None
    text = b"# SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND BSD-3-Clause */\nSPDX-License-Identifier none"
    row = licenses.scan(text, ALLOWED)
    assert row[7] == "( mit or gpl-2.0-only ) and bsd-3-clause" and row[8] is True
    assert set(row[5].split(",")) == {"mit", "gpl-2.0-only", "bsd-3-clause"}
    assert licenses.scan(b"SPDX-License-Identifier: $$", ALLOWED)[8] is None


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def right(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain_base(text):
    spans = [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text) if right(k, m[0])]
    return ",".join(spans)


def test_base_spans_against_the_patterns():
    rng = random.Random(2)
    parts = list("0123456789.@+-() aé日%_") + ["4111 1111 1111 1111", "x@y.zz", "10.0.0.1", "+49 (30) 123456", "256.1.1.1", "\n", "a.b@c", "@@"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 40)))
        row = pii.scan(text.encode())
        assert row[5] == plain_base(text), text
        assert row[6] == hashlib.sha256(row[5].encode()).hexdigest()
        assert list(row[1:5]) == [row[5].count(k + ":") for k in pii.KINDS]
    for long in ("a" * 200_000 + "@", "1" * 200_000, "+1" + " " * 200_000, "1 " * 100_000):
        assert pii.scan(long.encode())[5] == ""
    assert pii.scan(b"1." * 100_000)[2] == 25_000


def plain_terms(rows, support, threshold):
    """Disclosing (kind, term), by counting."""
    from collections import Counter

    near, everywhere, per_kind, total = Counter(), Counter(), Counter(), 0
    for _, text in rows:
        row = pii.scan((text or "").encode())
        words = [w.lower() for w in re.findall("[A-Za-z\x80-\U0010ffff]+", text or "")]
        everywhere.update(words)
        total += len(words)
        for x in row[7]:
            near[x["kind"], x["term"]] += 1
            per_kind[x["kind"]] += 1
    import math

    return {
        (k, t) for (k, t), n in near.items() if n >= support and
        math.log2(n * total / (everywhere[t] * per_kind[k])) / math.log2(total / per_kind[k]) >= threshold}


def test_disclosing_terms(docs):
    rng = random.Random(6)
    common = [f"word{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    rows = []
    for i in range(200):
        words = rng.choices(common, k=60)
        if i % 4 == 0:
            words[30:30] = ["mailbox", f"u{i}@example.com", rng.choice(common)]
        if i % 5 == 0:
            words[10:10] = ["rufnummer" if i % 10 else "worda", "+49 30 1234567"]
        rows.append((i, " ".join(words)))
    rows += [(300, None), (301, ""), (302, rows[0][1]), (302, rows[0][1])]
    made = docs(*rows)
    terms = pii.disclosing(made, pii.scanned(made))
    got = {(r.kind, r.term) for r in terms.collect()}
    assert got == plain_terms(rows, pii.SUPPORT, pii.GENERALISE) and {(0, "mailbox"), (3, "rufnummer")} <= got
    found = {r.doc_id: r for r in pii.find_pii(made).collect()}
    at = rows[4][1].index("mailbox")
    assert f"email-drop:{at}:{at + 7}" in found[4].spans and found[300].spans == "" and len(found) == 203
    assert all(found[i].spans.startswith(plain_base(t or "")) for i, t in rows)
    text = {r.doc_id: r.text for r in pii.sanitised(made.where("doc_id < 300")).collect()}[4]
    assert "mailbox" not in text and "@" not in text and "[EMAIL]" in text
    assert pii.find_pii(made.where("false")).count() == 0
    twice = docs((7, "a@b.de here"), (7, "ip 1.2.3.4"), (7, "ip 1.2.3.4"), (None, "c@d.de"), (8, None))
    told = [(7, "[EMAIL] here"), (7, "ip [IP]"), (7, "ip [IP]"), (8, None), (None, "[EMAIL]")]
    for made in (twice, twice.withColumn("doc_id", F.col("doc_id").cast("int"))):
        assert sorted(((r.doc_id, r.text) for r in pii.sanitised(made).collect()), key=str) == sorted(told, key=str)


def test_rare_terms_disclose_at_every_size(docs):
    """A name that stands twice, both times beside a mention; not a word that stands there once in many places."""
    rng = random.Random(16)
    common = [f"word{c}{d}" for c in "abcdefgh" for d in "abcdefgh"]
    for size in (100, 800):
        rows = [(i, " ".join(rng.choices(common, k=50))) for i in range(size)]
        for i in range(0, size, 20):
            rows[i] = (i, rows[i][1] + f" name{chr(97 + i // 40 % 26)}{chr(97 + i // 1040)} u{i}@example.com")
        made = docs(*rows)
        got = {r.term for r in pii.disclosing(made, pii.scanned(made)).collect() if r.kind == 0}
        pairs = size // 40
        assert {f"name{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(pairs)} <= got
        assert not got & set(common)


def test_every_place_of_a_disclosing_term_goes(docs):
    """Far from the mention, in a text without one, in another case; not inside a mention."""
    filler = "one two three four five six seven eight nine ten "
    rows = [(i, filler * 3 + f"mailbox user{i}@mailbox.org") for i in range(12)]
    rows += [(20, "Über MAILBOX " + filler + "x@example.com"), (21, filler + "mailbox"), (22, filler), (23, None)]
    rows += [(100 + i, filler * 4) for i in range(60)]
    found = {r.doc_id: r.spans for r in pii.find_pii(docs(*rows)).collect()}
    assert "email-term:5:12" in found[20] and found[21] == f"email-term:{len(filler)}:{len(filler) + 7}"
    assert found[22] == "" and found[23] == "" and all(found[i].count("-term") == 1 for i in range(12))


def library(model_type=None):
    with open(pieces.MODEL, "rb") as file:
        model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
    if model_type:
        model.trainer_spec.model_type = model_type
    return model, sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def texts_to_encode():
    rng = random.Random(9)
    letters = list("abcdefghijklmnopqrstuvwxyz   \n\t.,éèüßñ日本😀́▁01")
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 200))) for _ in range(400)]
    return texts + ["", " ", "  two  spaces ", "▁", "the quick brown fox " * 50, "a" * 3000, "=" * 500, "ＡＢ\x00\x7f"]


def test_pieces_are_those_of_the_library(docs):
    texts = texts_to_encode()
    rows = [*enumerate(texts), (999, None), (999, None)]
    encoded = pieces.encode(docs(*rows))
    got = sorted(encoded.collect(), key=lambda r: r.doc_id)
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in got)
    _, lib = library()
    for (_, text), r in zip(rows, got):
        if "▁" not in (text or ""):
            assert lib.encode(text or "") == r.ids, text
    back = {r.doc_id: r.text for r in pieces.decode_rows(encoded).collect()}
    assert all(back[i] == (t or "") for i, t in rows)


def test_highest_score_for_unigram_models(tmp_path):
    """The same pieces as a unigram model: no segmentation scores higher, and the library finds none better."""
    model, lib = library(sentencepiece_model_pb2.TrainerSpec.UNIGRAM)
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    voc = pieces.load(str(path))
    score = lambda ids: sum(model.pieces[i].score if model.pieces[i].type == 1 else 0 for i in ids)
    words = sorted({w for t in texts_to_encode() for w in t.split() if w.isascii() and len(w) < 30})
    encoded = pieces.encode_words(voc, ["▁" + w for w in words])
    for w in words:
        assert score(encoded["▁" + w]) >= score(lib.encode(w)) - 1e-3 and lib.decode(list(encoded["▁" + w])) == w


def test_toxicity_learns_and_tolerates(docs, spark):
    rng = random.Random(7)
    plain = ["".join(rng.choices(["ba", "do", "fi", "ku", "lem", "no", "pra", "ti"], k=rng.randint(2, 4))) for _ in range(300)]
    insults = ["grumbold", "zwackel", "vexnarr"]
    rows, labels = [], []
    for i in range(500):
        words = rng.choices(plain, k=40)
        bad = i % 4 == 0
        for _ in range(3 if bad else 0):
            words[rng.randrange(40)] = rng.choice(insults)
        rows.append((i, " ".join(words) + "."))
        labels.append((i, 1, int(bad)))
    rows += [(600, None), (601, ""), (602, "g.r.u.m.b.o.l.d du grummbold " + " ".join(plain[:30])), (603, "v e x n a r r zwackkel " + " ".join(plain[:30])), (604, " ".join(plain[:200]))]
    labels += [(None, 1, 1), (0, 1, None), (700, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs(*rows), table).collect()}
    assert len(got) == 505 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i in range(500) if got[i].held_out]
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) >= 0.98 * len(held)
    assert [got[i].predicted for i in (600, 601, 602, 603, 604)] == [0, 0, 1, 1, 0]
    kept = toxicity.without_toxic(docs(*rows), table)
    assert kept.columns == docs((1, "a")).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    none = toxicity.toxicity(docs(*rows), table.where("toxic = 0"))
    assert none.where("score > 0").count() == 0


def test_toxicity_learns_from_noisy_labels():
    """Every insult stands in a document labelled clean as well, and is still learnt."""
    rng = random.Random(21)
    plain = ["".join(rng.choices(["ba", "do", "fi", "ku", "lem", "no", "pra", "ti"], k=rng.randint(2, 4))) for _ in range(300)]
    insults = ["grumbold", "zwackel", "vexnarr"]
    texts, toxic = [], []
    for i in range(400):
        words = rng.choices(plain, k=40)
        if i % 4 == 0:
            words[5:7] = rng.choices(insults, k=2)
        elif i in (1, 2, 3):
            words[5] = insults[i - 1]
        texts.append(" ".join(words))
        toxic.append(int(i % 4 == 0))
    model = toxicity.fit(texts, toxic)
    score = dict(zip(insults, toxicity.table_scores(insults, model.table) + model.bias))
    assert all(x > 0.5 for x in score.values()), score
    new = [" ".join(rng.choices(plain, k=30) + [a, b]) for a in insults for b in insults] + [" ".join(rng.choices(plain, k=30)) for _ in range(9)]
    assert [x >= 0.5 for x in toxicity.probabilities(new, model, {})] == [True] * 9 + [False] * 9


def naive_kernel(a, b):
    """Shared three-letter subsequences of two words of ASCII letters with their marks, weighted by the letters they span."""
    def weights(word):
        marked, out = "#" + word + "#", Counter()
        for i, j, k in itertools.combinations(range(len(marked)), 3):
            if k - i <= toxicity.SPAN:
                out[marked[i] + marked[j] + marked[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    def most(word):
        n = len(word) + 2
        return sum(toxicity.DECAY ** (2 * (k - i + 1)) for i, _, k in itertools.combinations(range(n), 3) if k - i <= toxicity.SPAN) ** 0.5

    left, right = weights(a), weights(b)
    return sum(w * right[s] for s, w in left.items()) / (most(a) * most(b))


def test_kernel_against_plain_subsequences():
    words = ["a", "idiot", "idixot", "i", "stupid", "stuupidd", "clean", "abababab", "internationalisation"]
    maps = toxicity.kernel_map(words).astype(float)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert maps[i] @ maps[j] == pytest.approx(naive_kernel(a, b), rel=1e-4, abs=1e-6)


def test_letters_of_other_scripts_differ():
    word = "слово"
    shifted = "".join(chr(ord(c) + 5) for c in word)
    maps = toxicity.kernel_map([word, shifted, word]).astype(float)
    assert maps[0] @ maps[1] < 0.5 * (maps[0] @ maps[2])

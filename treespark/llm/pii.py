"""Personal data: patterns find addresses and numbers; terms that reveal them are found by how they co-occur.

A protected entity is a kind of personal data. For every term near a mention the whole corpus tells how much it
discloses: the pointwise mutual information of term and kind, as a part of the information content of the kind. The
part is 1 for a term that stands nowhere else. Terms beyond a threshold are generalised to their kind, those beyond a
higher one are removed.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treespark.llm.bits import bit_field, bit_of, maybe_among
from treespark.llm.common import ascii_lower, attach, keyed, stored

KINDS = ("email", "ip", "card", "phone")
#: Words on each side of a mention; least mentions of a term near a kind; parts of information that count as disclosure.
NEAR, SUPPORT, GENERALISE, REMOVE = 3, 1, 0.6, 0.9
#: A term discloses nothing if as many of its places would be near a mention by chance with a greater probability.
CHANCE = 0.001
LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(rb"[0-9][0-9.]*")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
#: Words of which a task remembers whether they may be terms.
CACHED = 500_000
PLACES = "key bigint, term string, places array<struct<start:bigint,stop:bigint>>"
NO_LETTER = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
IS_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
SCHEMA = (
    "doc_id bigint, key bigint, n_words bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, "
    "base_sha256 string, near array<struct<kind:int,term:string,start:bigint,stop:bigint>>")


def emails(raw: bytes) -> Iterator[tuple[int, int]]:
    """By their @: the name reaches left as far as it may, so that long runs are read once."""
    free = at = 0
    while (at := raw.find(b"@", at)) >= 0:
        start = at
        while start > free and raw[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(raw, at + 1)
        if start < at and domain:
            yield start, domain.end()
            free = at = domain.end()
        else:
            at += 1
            free = at


def addresses(raw: bytes) -> Iterator[tuple[int, int]]:
    """Four numbers in a row between single dots; more of them start the next find."""
    for run in DOTTED.finditer(raw):
        if run[0].count(b".") < 3:
            continue
        at, row = run.start(), []
        for part in run[0].split(b"."):
            if part:
                row.append((at, at + len(part), part))
            else:
                row = []
            at += len(part) + 1
            if len(row) == 4:
                if all(int(p.lstrip(b"0")[:4] or b"0") <= 255 for _, _, p in row):
                    yield row[0][0], row[-1][1]
                row = []


def luhn(digits: bytes) -> bool:
    values = [b - 48 for b in reversed(digits)]
    return sum(values[::2] + [v * 2 - 9 * (v > 4) for v in values[1::2]]) % 10 == 0


def cards(raw: bytes) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(raw):
        if m.end() - m.start() < 38:
            digits = m[0].replace(b" ", b"").replace(b"-", b"")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(raw: bytes) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(raw):
        if 8 <= sum(48 <= b <= 57 for b in m[0]) <= 15:
            yield m.span()


def letters(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of letters, in bytes."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = IS_LETTER[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def scan(raw: bytes) -> tuple:
    """Word count, counts per kind, base spans, their digest and the words near them; places in code points."""
    starts, ends = letters(raw)
    found = [list(find(raw)) for find in (emails, addresses, cards, phones)]
    if not any(found):
        return len(starts), 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest(), []
    lead = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    base = ",".join(f"{kind}:{lead[s]}:{lead[e]}" for kind, spans in zip(KINDS, found) for s, e in spans)
    covered = sorted(span for spans in found for span in spans)
    begin = [s for s, _ in covered]
    reach = np.maximum.accumulate([e for _, e in covered]).tolist()
    near = []
    for kind, spans in enumerate(found):
        words: set[int] = set()
        for s, e in spans:
            left = int(np.searchsorted(ends, s, "right"))
            right = int(np.searchsorted(starts, e, "left"))
            words.update(range(max(0, left - NEAR), left))
            words.update(range(right, min(len(starts), right + NEAR)))
        for w in sorted(words):
            s, e = int(starts[w]), int(ends[w])
            before = bisect_left(begin, e)
            if before and reach[before - 1] > s:
                continue
            near.append({"kind": kind, "term": raw[s:e].lower().decode("utf-8", "replace"), "start": int(lead[s]), "stop": int(lead[e])})
    return len(starts), *[len(spans) for spans in found], base, hashlib.sha256(base.encode()).hexdigest(), near


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    struct = pa.struct([("kind", pa.int32()), ("term", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.list_(struct)]
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    for batch in batches:
        rows = [scan(text.as_py() or b"") for text in batch.column("text").cast(pa.binary())]
        columns = zip(*rows) if rows else [[] for _ in types]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("key"), *[pa.array(c, t) for c, t in zip(columns, types)]], names=names)


def scanned(docs: DataFrame) -> DataFrame:
    return stored(keyed(docs).mapInArrow(scan_batches, SCHEMA))


def disclosing(docs: DataFrame, scans: DataFrame, support: int = SUPPORT, threshold: float = GENERALISE) -> DataFrame:
    """(pair, kind, term, n_near, n_all, disclosure): terms that disclose a kind, with counts over the whole corpus.

    All terms near a kind are counted in the corpus, ``support`` is a floor for who wants one; a filter of fixed size
    keeps other words out of the exchange, and counts are summed before it. A term counts if so many of its places are
    hardly near a mention by chance: the Chernoff bound of the binomial tail is ``CHANCE`` at most. It depends on shares
    and the term's own places, not on the size of the corpus.
    """
    near = scans.select(F.explode("near").alias("x")).select("x.kind", "x.term")
    together = stored(near.groupBy("kind", "term").agg(F.count("*").alias("n_near")))
    words = scans.agg(F.sum("n_words")).first()[0] or 0
    of_kind = {r.kind: r.n for r in together.groupBy("kind").agg(F.sum("n_near").alias("n")).collect()}  # four rows
    usual = together.where(F.col("n_near") >= support)
    tokens = docs.select(F.explode(F.split(ascii_lower(F.col("text")), NO_LETTER)).alias("word")).where("word <> ''")
    counts = tokens.where(maybe_among(usual, "term", F.col("word"))).groupBy("word").agg(F.count("*").alias("n_all"))
    per_kind = F.coalesce(*[F.when(F.col("kind") == k, F.lit(float(n))) for k, n in of_kind.items()], F.lit(1.0))
    total = F.lit(float(max(words, 1)))
    mutual = F.log2(F.col("n_near") * total / (F.col("n_all") * per_kind))
    content = F.log2(total / per_kind)
    share, usual_share = F.least(F.lit(1.0), F.col("n_near") / F.col("n_all")), F.least(F.lit(1.0), per_kind / total)
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - usual_share))).otherwise(0.0)
    surprise = F.when(share > usual_share, F.col("n_all") * (share * F.log(share / usual_share) + rest)).otherwise(0.0)
    told = usual.join(counts, F.col("term") == F.col("word")).withColumn(
        "disclosure", F.when(content > 0, mutual / content).otherwise(0.0))
    return stored(told.where((F.col("disclosure") >= threshold) & (surprise >= -math.log(CHANCE))).select(
        F.xxhash64("kind", "term").alias("pair"), "kind", "term", "n_near", "n_all", "disclosure"))


def place_batches(batches: Iterator[pa.RecordBatch], field: list[int]) -> Iterator[pa.RecordBatch]:
    """The places, outside mentions, of words that may be among the terms whose bits are set in ``field``."""
    bits = np.unpackbits(np.array(field, np.int64).view(np.uint8), bitorder="little").tobytes()
    known: dict[bytes, int] = {}
    place = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    for batch in batches:
        keys, terms, places = [], [], []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").cast(pa.binary())):
            raw = text.as_py()
            low = raw.lower()
            starts, ends = letters(raw)
            told: dict[bytes, list[tuple[int, int]]] = {}
            for s, e in zip(starts.tolist(), ends.tolist()):
                word = low[s:e]
                hit = known.get(word)
                if hit is None:
                    if len(known) > CACHED:
                        known.clear()
                    hit = known[word] = bits[bit_of(word)]
                if hit:
                    told.setdefault(word, []).append((s, e))
            if not told:
                continue
            covered = sorted(span for find in (emails, addresses, cards, phones) for span in find(raw))
            begin = [s for s, _ in covered]
            reach = np.maximum.accumulate([e for _, e in covered]).tolist()
            lead = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
            for word, spans in told.items():
                free = [(s, e) for s, e in spans if not (before := bisect_left(begin, e)) or reach[before - 1] <= s]
                if free:
                    keys.append(key)
                    terms.append(word.decode("utf-8", "replace"))
                    places.append([{"start": int(lead[s]), "stop": int(lead[e])} for s, e in free])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(terms, pa.string()), pa.array(places, pa.list_(place))], names=["key", "term", "places"])


def found_spans(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``find_pii`` with the key of each document, a hash of id and text."""
    scans = scanned(docs)
    terms = disclosing(docs, scans, support, generalise)
    by_term = stored(terms.groupBy("term").agg(
        F.max("n_all").alias("n_all"), F.collect_list(F.struct("kind", "disclosure")).alias("kinds")))
    rows = keyed(docs).select("key", "text").where("text is not null")
    places = rows.mapInArrow(partial(place_batches, field=bit_field(by_term, "term")), PLACES)
    found = attach(places, by_term, "term", "n_all", F.col("key"), "inner")
    hits = found.select("key", "kinds", F.explode("places").alias("p")).select("key", "p.start", "p.stop", F.explode("kinds").alias("k")).select(
        "key", "start", "stop", "k.kind", "k.disclosure")
    grouped = hits.groupBy("key").agg(F.sort_array(F.collect_set(F.struct(
        "kind", (F.col("disclosure") >= remove).alias("gone"), "start", "stop"))).alias("t"))
    name = lambda x: F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1)
    added = F.transform(F.array_sort("t", lambda a, b: F.when(a["kind"] < b["kind"], -1).when(a["kind"] > b["kind"], 1).when(
        a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)), lambda x: F.concat_ws(
            ":", F.concat(name(x), F.when(x["gone"], "-drop").otherwise("-term")), x["start"].cast("string"), x["stop"].cast("string")))
    placed = stored(grouped.select(F.col("key").alias("hit"), F.array_join(added, ",").alias("terms")))
    out = scans.join(placed, F.col("key") == F.col("hit"), "left")
    both = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.col("terms"))
    return out.select("doc_id", "key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", both.alias("spans"))


def find_pii(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """One row per row of ``docs``: counts and digest of the base spans, and all spans with those of disclosing terms.

    Base spans are e-mail addresses, IP addresses, card and phone numbers, leftmost and non-overlapping per kind.
    Spans are kind:start:end in code points, end exclusive, base kinds first; a term that discloses a kind is
    ``email-term:…``, or ``email-drop:…`` if it is to be removed, at each of its places in the whole corpus but inside
    mentions.
    A null text counts as empty. Repeated rows give a row each, with the same spans. Places where a word is cut
    by a mention are no words near it. An empty table gives no rows. Other columns are not read.
    """
    return found_spans(docs, support, generalise, remove).drop("key")


def cleaned(text: str | None, spans: str) -> str | None:
    """``text`` with base spans and disclosing terms as the name of their kind, and terms to be removed left out."""
    if not text or not spans:
        return text
    marks = sorted((int(s), int(e), kind) for kind, s, e in (x.split(":") for x in spans.split(",")))
    out, at = [], 0
    for start, end, kind in marks:
        if start < at:
            at = max(at, end)
            continue
        out.append(text[at:start])
        out.append("" if kind.endswith("-drop") else f"[{kind.removesuffix('-term').upper()}]")
        at = end
    return "".join(out) + text[at:]


def sanitised(docs: DataFrame, **settings: float) -> DataFrame:
    """(doc_id, spans, text) of every row of ``docs``, the text cleaned.

    Rows are told by id and text, so those that share an id have their own spans; a null id is an id like others.
    """
    spans = found_spans(docs, **settings).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "spans").dropDuplicates(["_id", "_key"])
    joined = keyed(docs).join(spans, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "text", "spans")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cleaned(t.as_py(), s.as_py()) for t, s in zip(batch.column("text"), batch.column("spans"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("spans"), pa.array(texts, pa.string())], names=["doc_id", "spans", "text"])

    return joined.mapInArrow(clean, "doc_id bigint, spans string, text string")

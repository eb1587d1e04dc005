"""SentencePiece encoding and decoding, by a Viterbi search in numpy over batches of words.

A text is cut where no piece can span: first before white space marks, then between letters that no piece has side by side.
Each distinct segment is searched once. Segments of equal length advance together: hashes of all their substrings probe
the sorted hashes of the pieces, and at each position the best end of a piece is taken over all lengths at once.

For a unigram model the maximum is that of the total score. For a byte-pair model the scores are ranks of merges, whose sum
means nothing: there the one piece is taken that the merges would leave behind the piece before it, which two look-ups
per undone merge tell. Both give the ids that the SentencePiece library gives. Letters outside the vocabulary become
byte pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from sentencepiece import sentencepiece_model_pb2
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, LITERAL = "▁", "\udc81"  # a white space mark of the text itself is told apart by a lone surrogate
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
UNKNOWN_PENALTY = 10.0
WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Words that are kept between batches, rows encoded together, letters up to which a word is not cut further; size of
#: the fields that tell most look-ups apart, in bits.
CACHED, TOGETHER, SHORT = 500_000, 1500, 12
FIELD_BITS, SEEN_BITS = 22, 20
SCHEMA = "doc_id bigint, n_pieces bigint, ids array<int>, round_trip boolean"


@dataclass
class Merges:
    """What byte-pair merging does, by index of the piece: when a piece is made, of which two, and which two merge when.

    Single letters are there from the start, at time 0; the last index stands for a letter outside the vocabulary.
    """

    time: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pairs: np.ndarray
    pair_times: np.ndarray
    pair_field: np.ndarray
    times: dict[str, int]


@dataclass
class Vocabulary:
    """The pieces that can be found in a text, by their hashes, and the bytes of all pieces."""

    keys: np.ndarray
    second: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    lengths: np.ndarray
    beside: frozenset[str]
    byte_ids: tuple[int, ...]
    unknown_score: float
    raw: tuple[bytes, ...]
    field: np.ndarray
    name: str
    merges: Merges | None


def points_of(words: list[str]) -> np.ndarray:
    """Code points of words of equal length, one row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def spot(keys: np.ndarray) -> np.ndarray:
    """A place in a field of bits, by the high bits of a product."""
    return (keys.astype(np.uint64, copy=False) * BASES[0]) >> np.uint64(64 - FIELD_BITS)


def field_of(keys: np.ndarray) -> np.ndarray:
    """True where one of the keys may be: most look-ups of other keys end here."""
    field = np.zeros(1 << FIELD_BITS, bool)
    field[spot(keys)] = True
    return field


def found_at(keys: np.ndarray, field: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``wanted``, places in the sorted ``keys``) of those that are among the keys."""
    rows = np.flatnonzero(field[spot(wanted)])
    at = np.minimum(np.searchsorted(keys, wanted[rows]), len(keys) - 1)
    same = keys[at] == wanted[rows]
    return rows[same], at[same]


def prefix_hashes(points: np.ndarray, base: np.uint64) -> np.ndarray:
    out = np.zeros((points.shape[0], points.shape[1] + 1), np.uint64)
    for i in range(points.shape[1]):
        out[:, i + 1] = out[:, i] * base + points[:, i] + np.uint64(1)
    return out


def merged(word: str, times: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """The pieces that merging leaves of a word, earliest merge first and leftmost of equal ones, and the last merge."""
    parts, last = list(word), None
    while len(parts) > 1:
        when, at = min((times.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if when == 1 << 30:
            break
        last = parts[at], parts[at + 1]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts, last


def merges_of(index: dict[str, int], scores: dict[str, float]) -> Merges:
    by_score = sorted((p for p in index if len(p) > 1), key=lambda p: (-scores[p], index[p]))
    times = {p: k + 1 for k, p in enumerate(by_score)}
    size = len(index)
    time, left, right = np.zeros(size + 1, np.int64), np.arange(size + 1), np.arange(size + 1)
    pairs = []
    for p, when in times.items():
        parts, last = merged(p, times)
        time[index[p]] = when if len(parts) == 1 else 1 << 40
        if len(parts) == 1:
            left[index[p]], right[index[p]] = index[last[0]], index[last[1]]
        for i in range(1, len(p)):
            if p[:i] in index and p[i:] in index:
                pairs.append((index[p[:i]] << 32 | index[p[i:]], when))
    pairs.sort()
    keys, when = (np.array(x, np.int64) for x in zip(*pairs))
    return Merges(time, left, right, keys, when, field_of(keys), times)


def lasting(voc: Vocabulary, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether merging two pieces' letters leaves these two pieces; pairs seen lately are remembered."""
    keys = first << 32 | second
    if voc.name not in SEEN:
        SEEN[voc.name] = np.full(1 << SEEN_BITS, -1, np.int64), np.zeros(1 << SEEN_BITS, bool)
    seen, told = SEEN[voc.name]
    slot = spot(keys) >> np.uint64(FIELD_BITS - SEEN_BITS)
    out = told[slot]
    new = np.flatnonzero(seen[slot] != keys)
    if len(new):
        out[new] = undone(voc.merges, first[new], second[new])
        seen[slot[new]], told[slot[new]] = keys[new], out[new]
    return out


def undone(m: Merges, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """``lasting`` for pairs that were not seen.

    Merges are undone from the latest on. The pieces then beside the border must not merge earlier than the merge
    undone; of equal merges the left one comes first.
    """
    out = np.ones(len(first), bool)
    rows, limit = np.arange(len(first)), np.full(len(first), 1 << 50)
    while len(rows):
        known, at = found_at(m.pairs, m.pair_field, first << 32 | second)
        broken = np.zeros(len(rows), bool)
        broken[known] = m.pair_times[at] < limit[known]
        out[rows[broken]] = False
        t1, t2 = m.time[first], m.time[second]
        go = ~broken & ((t1 > 0) | (t2 > 0))
        undo = t1 > t2
        limit = np.where(undo, t1, t2 + 1)[go]
        first, second = np.where(undo, m.right[first], first)[go], np.where(undo, second, m.left[second])[go]
        rows = rows[go]
    return out


def load(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a SentencePiece model file."""
    return vocabulary(content_of(path))


def content_of(path: str) -> bytes:
    """The model file, read on the driver; tasks get it with their code."""
    with open(path, "rb") as file:
        return file.read()


@lru_cache(maxsize=4)
def vocabulary(content: bytes) -> Vocabulary:
    model, name = sentencepiece_model_pb2.ModelProto.FromString(content), hashlib.sha256(content).hexdigest()
    kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
    if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("the model normalises texts, so they could not be restored")
    raw, by_text, byte_ids = [], {}, [-1] * 256
    for i, piece in enumerate(model.pieces):
        if piece.type == kinds.BYTE:
            byte_ids[int(piece.piece[3:-1], 16)] = i
            raw.append(bytes([int(piece.piece[3:-1], 16)]))
        elif piece.type in (kinds.NORMAL, kinds.USER_DEFINED):
            by_text[piece.piece] = (i, piece.score)
            raw.append(piece.piece.replace(SPACE, " ").encode())
        else:
            raw.append(b"")
    if any(i < 0 for i in byte_ids):
        raise ValueError("the model has no byte pieces, so texts could not be restored")
    parts = []
    for length in sorted({len(p) for p in by_text}):
        names = [p for p in by_text if len(p) == length]
        hashes = [prefix_hashes(points_of(names), base)[:, -1] for base in BASES]
        parts.append((*hashes, [by_text[p][0] for p in names], [by_text[p][1] for p in names], [length] * len(names)))
    keys, second, ids, scores, lengths = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys)
    if (np.diff(keys[order]) == 0).any():
        raise ValueError("two pieces have the same hash")
    ids, scores = ids[order].astype(np.int32), scores[order].astype(np.float64)
    merges = None
    if model.trainer_spec.model_type == model.trainer_spec.BPE:
        number = {int(i): k for k, i in enumerate(ids)}
        merges = merges_of({p: number[i] for p, (i, _) in by_text.items()}, {p: score for p, (_, score) in by_text.items()})
    return Vocabulary(
        keys[order], second[order], ids, scores, lengths[order].astype(np.int64),
        frozenset(p[i : i + 2] for p in by_text for i in range(len(p) - 1)), tuple(byte_ids),
        float(min(s for _, s in by_text.values())) - UNKNOWN_PENALTY, tuple(raw), field_of(keys), name, merges)


def probe(voc: Vocabulary, points: np.ndarray, longest: int) -> np.ndarray:
    """The index of the piece that ends at a position with a length, at [word, end, length - 1]; -1 if none."""
    n, size = points.shape
    prefixes = [prefix_hashes(points, base) for base in BASES]
    index = np.full((n, size + 1, longest), -1, np.int32)
    powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    for length in range(1, min(longest, size) + 1):
        powers = [p * b for p, b in zip(powers, BASES)]
        first, second = ((h[:, length:] - h[:, : size + 1 - length] * p).ravel() for h, p in zip(prefixes, powers))
        rows, at = found_at(voc.keys, voc.field, first)
        same = (voc.second[at] == second[rows]) & (voc.lengths[at] == length)
        word, start = np.divmod(rows[same], size + 1 - length)
        index[word, start + length, length - 1] = at[same]
    return index


def best_scores(voc: Vocabulary, index: np.ndarray) -> np.ndarray:
    """Length of the best last piece, at [word, end]. Of equal totals the longer piece is taken."""
    n, size, longest = index.shape[0], index.shape[1] - 1, index.shape[2]
    scores = np.where(index >= 0, voc.scores[index], -np.inf)
    scores[:, 1:, 0] = np.where(index[:, 1:, 0] >= 0, scores[:, 1:, 0], voc.unknown_score)
    best = np.full((n, size + longest), -np.inf)  # position p stands at p + longest - 1
    best[:, longest - 1] = 0.0
    back = np.zeros((n, size + 1), np.int32)
    for end in range(1, size + 1):
        total = best[:, end - 1 : end + longest - 1] + scores[:, end, ::-1]  # from the longest piece to the shortest
        pick = np.argmax(total, axis=1)
        best[:, end + longest - 1] = total[np.arange(n), pick]
        back[:, end] = longest - pick
    return back


def best_merges(voc: Vocabulary, index: np.ndarray) -> np.ndarray:
    """Length of the last piece that merging leaves, at [word, end]; the longest that lasts beside the piece before it.

    Zero where none lasts, which merge orders that turn back could cause; such words are merged one by one.
    """
    m = voc.merges
    n, size, longest = index.shape[0], index.shape[1] - 1, index.shape[2]
    last = np.full((n, size + 1), -1, np.int64)
    back = np.zeros((n, size + 1), np.int32)
    for end in range(1, size + 1):
        open_ = np.ones(n, bool)
        for length in range(min(longest, end), 0, -1):
            found = index[:, end, length - 1].astype(np.int64)
            if length == 1:
                found = np.where(found >= 0, found, len(m.time) - 1)
            start = end - length
            rows = np.flatnonzero(open_ & (found >= 0) & ((start == 0) | (last[:, start] >= 0)))
            if not len(rows):
                continue
            piece = found[rows]
            fits = m.time[piece] < 1 << 40
            if start:
                fits &= lasting(voc, last[rows, start], piece)
            rows, piece = rows[fits], piece[fits]
            last[rows, end], back[rows, end] = piece, length
            open_[rows] = False
    return back


def viterbi(voc: Vocabulary, words: list[str]) -> list[tuple[int, ...]]:
    """Piece ids of words of equal length."""
    size = len(words[0])
    index = probe(voc, points_of(words), min(int(voc.lengths.max()), size))
    back = best_merges(voc, index) if voc.merges else best_scores(voc, index)
    rows, end = np.arange(len(words)), np.full(len(words), size)
    taken, ids = np.zeros((len(words), size), np.int32), np.full((len(words), size), -1, np.int32)
    count = np.zeros(len(words), np.int64)
    odd = np.zeros(len(words), bool)  # a letter outside the vocabulary, or no way through
    live = rows
    while len(live):
        length = back[live, end[live]]
        at = np.where(length > 0, index[live, end[live], length - 1], -1)
        odd[live] |= at < 0
        ids[live, count[live]] = np.where(at >= 0, voc.ids[at], -1)
        taken[live, count[live]] = length
        count[live] += 1
        end[live] -= length
        live = live[(end[live] > 0) & (length > 0)]
    out = [tuple(found[n - 1 :: -1]) if n else () for found, n in zip(ids.tolist(), count.tolist())]
    for row in np.flatnonzero(odd):
        out[row] = with_bytes(voc, words[row], out[row], taken[row, : count[row]][::-1].tolist())
    return out


def with_bytes(voc: Vocabulary, word: str, ids: tuple[int, ...], lengths: list[int]) -> tuple[int, ...]:
    """``ids`` with the bytes of letters outside the vocabulary in place of -1."""
    if sum(lengths) < len(word):
        return one_by_one(voc, word)
    out: list[int] = []
    at = 0
    for i, length in zip(ids, lengths):
        out.extend([i] if i >= 0 else [voc.byte_ids[b] for b in word[at].replace(LITERAL, SPACE).encode()])
        at += length
    return tuple(out)


def one_by_one(voc: Vocabulary, word: str) -> tuple[int, ...]:
    found: list[int] = []
    for part in merged(word, voc.merges.times)[0]:
        at = int(probe(voc, points_of([part]), len(part))[0, len(part), len(part) - 1])
        found.extend([int(voc.ids[at])] if at >= 0 else [voc.byte_ids[b] for b in part.replace(LITERAL, SPACE).encode()])
    return tuple(found)


def segments(voc: Vocabulary, word: str) -> list[str]:
    """``word`` cut between letters that no piece has side by side; the search in each part is the search in the whole."""
    out, start = [], 0
    for i in range(1, len(word)):
        if word[i - 1 : i + 1] not in voc.beside:
            out.append(word[start:i])
            start = i
    out.append(word[start:])
    return out


def encode_words(voc: Vocabulary, words: list[str]) -> dict[str, tuple[int, ...]]:
    """Piece ids of distinct words."""
    parts = {w: segments(voc, w) if len(w) > SHORT else [w] for w in words}
    by_length: dict[int, list[str]] = {}
    for segment in dict.fromkeys(chain.from_iterable(parts.values())):
        by_length.setdefault(len(segment), []).append(segment)
    found: dict[str, tuple[int, ...]] = {}
    for length, same in by_length.items():
        step = max(1, 400_000 // (length * length + 1))
        for i in range(0, len(same), step):
            found.update(zip(same[i : i + step], viterbi(voc, same[i : i + step])))
    return {w: found[p[0]] if len(p) == 1 else tuple(chain.from_iterable(found[s] for s in p)) for w, p in parts.items()}


def words_of(text: str) -> list[str]:
    """A white space mark before the text and for every space; nothing for an empty text."""
    if not text:
        return []
    if SPACE in text:
        text = text.replace(SPACE, LITERAL)
    return WORD.findall(SPACE + text.replace(" ", SPACE))


def decode(raw: tuple[bytes, ...], ids: list[int]) -> str:
    """The text of piece ids, without the space that encoding puts before it."""
    return b"".join(map(raw.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


class Known:
    """Words whose ids are known: their ids stand one after another, found by the word's number.

    Each word is decoded once, when it comes in. A text is its words, and decoding joins the bytes of pieces, so a text comes back
    whole if its words do and no letter lies outside them.
    """

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.good = np.zeros(0, np.int64)

    def add(self, encoded: dict[str, tuple[int, ...]], raw: tuple[bytes, ...]) -> None:
        back = (b"".join(map(raw.__getitem__, ids)).decode("utf-8", "replace") for ids in encoded.values())
        good = [len(w) if b == w.replace(SPACE, " ").replace(LITERAL, SPACE) else 0 for w, b in zip(encoded, back)]
        self.good = np.concatenate([self.good, np.array(good, np.int64)])
        sizes = np.fromiter(map(len, encoded.values()), np.int64, len(encoded))
        begin = len(self.flat) + np.cumsum(sizes) - sizes
        self.number.update(zip(encoded, range(len(self.number), len(self.number) + len(encoded))))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(encoded.values()), np.int32)])
        self.begin, self.size = np.concatenate([self.begin, begin]), np.concatenate([self.size, sizes])

    def ids(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offsets, ids) of texts of known words, as in a list column, and how many of a text's letters come back."""
        numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(words)), np.int64)
        size = self.size[numbers]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(ends[-1]) + np.repeat(self.begin[numbers] - ends[:-1], size)
        borders = np.concatenate([[0], np.cumsum(list(map(len, words)))]).astype(np.int64)
        good = np.concatenate([[0], np.cumsum(self.good[numbers])])[borders]
        return ends[borders], self.flat[at], np.diff(good)


#: Words, and pairs of pieces, by vocabulary; a worker process keeps them from task to task.
KNOWN: dict[str, Known] = {}
SEEN: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def encode_batches(batches: Iterator[pa.RecordBatch], content: bytes) -> Iterator[pa.RecordBatch]:
    voc = vocabulary(content)
    for batch in batches:
        for start in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(start, TOGETHER)
            texts = [t or "" for t in part.column("text").to_pylist()]
            words = [words_of(t) for t in texts]
            known = KNOWN.setdefault(voc.name, Known())
            if len(known.number) > CACHED:
                known = KNOWN[voc.name] = Known()
            known.add(encode_words(voc, [w for w in set(chain.from_iterable(words)) if w not in known.number]), voc.raw)
            offsets, flat, good = known.ids(words)
            right = [n == (len(t) + 1 if t else 0) and LITERAL not in t for n, t in zip(good.tolist(), texts)]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), lists, pa.array(right, pa.bool_())],
                names=["doc_id", "n_pieces", "ids", "round_trip"])


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_pieces, ids, round_trip), one row per row of ``docs``: piece ids of whole texts.

    ``round_trip`` tells whether decoding gives the text back, which it does for every text. A null text counts
    as empty and has no pieces. Repeated rows give a row each. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(partial(encode_batches, content=content_of(model)), SCHEMA)


def decode_rows(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null or empty ids are an empty text."""
    content = content_of(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = vocabulary(content).raw
        for batch in batches:
            texts = [decode(raw, ids.as_py() or []) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id bigint, text string")

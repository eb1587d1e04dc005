"""License scans: Aho-Corasick finds notice phrases and identifier tags, a shunting-yard parser evaluates their expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases that stand for a label whatever surrounds them.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further notice phrases, in words; with the labels of BASE they are never merged.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache-2",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "boost software license": "bsl-1",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
#: How sure a find is: a tag with an expression that can be read, a base phrase, another notice.
SURE_TAG, SURE_BASE, SURE_NOTICE = 0.95, 0.9, 0.6
#: Licenses whose use is granted, for the evaluation of expressions.
ALLOWED = (
    "mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "bsl-1.0", "cc0-1.0", "cc-by-4.0", "unlicense", "zlib")
TAG = "spdx-license-identifier"
#: Every byte that is no digit, letter or part of a character beyond ASCII becomes a space; A-Z is lowered.
TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
TOKEN = re.compile(r"[()]|[a-z0-9.+\-]+(?::[a-z0-9.+\-]+)?")
RANK = {"or": 1, "and": 2, "with": 3}
SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
    "score double, expressions string, allowed boolean")


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Phrases between spaces, with (label, is it a base phrase, words)."""
    found = ahocorasick.Automaton()
    for phrase in BASE.keys() | NOTICES.keys():
        base = phrase in BASE
        found.add_word(f" {phrase} ", (BASE.get(phrase) or NOTICES[phrase], base, len(phrase.split()), len(phrase) + 2))
    tag = " ".join(TAG.split("-"))
    found.add_word(f" {tag} ", (None, False, 3, len(tag) + 2))
    found.make_automaton()
    return found


def postfix(tokens: list[str]) -> list[str] | None:
    """The expression in postfix order, by a stack of operators; None if it is none."""
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in tokens:
        if token == "(":
            if not operand_next:
                return None
            stack.append(token)
        elif token == ")":
            if operand_next:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif token in RANK:
            if operand_next:
                return None
            while stack and RANK.get(stack[-1], 0) >= RANK[token]:
                out.append(stack.pop())
            stack.append(token)
            operand_next = True
        else:
            if not operand_next:
                return None
            out.append(token)
            operand_next = False
    if operand_next or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(order: list[str], allowed: frozenset[str]) -> tuple[bool, list[str]]:
    """Whether the expression can be met by allowed licenses, and the licenses it names.

    ``or`` needs one side and ``and`` both; ``with`` adds an exception to a license, whose own grant decides.
    """
    values: list[tuple[bool, str]] = []
    named: list[str] = []
    for token in order:
        if token not in RANK:
            values.append((token in allowed, token))
            named.append(token)
            continue
        (right, exception), (left, license_) = values.pop(), values.pop()
        if token == "with":
            named.remove(exception)
            values.append((left, license_))
        else:
            values.append(((left or right) if token == "or" else (left and right), license_))
    return values[0][0], named


def expression_at(line: str) -> tuple[str, list[str]] | None:
    """The longest expression at the start of what follows a tag on its line, and its postfix order."""
    tokens: list[str] = []
    at = 0
    line = line.lstrip(" \t:=\"'")
    while at < len(line):
        if line[at] in " \t":
            at += 1
            continue
        match = TOKEN.match(line, at)
        if not match:
            break
        tokens.append(match[0])
        at = match.end()
    while tokens:
        order = postfix(tokens)
        if order:
            return " ".join(tokens), order
        tokens.pop()
    return None


def tags_of(raw: bytes) -> list[tuple[str, list[str]]]:
    """The expressions behind the identifier tags of a text."""
    found = []
    low = raw.lower()
    mark, at = TAG.encode(), 0
    while (at := low.find(mark, at)) >= 0:
        at += len(mark)
        end = low.find(b"\n", at)
        line = low[at : end if end >= 0 else len(low)]
        if line.lstrip(b" \t")[:1] in (b":", b"="):
            if (expression := expression_at(line.decode("utf-8", "replace").rstrip("\r"))) is not None:
                found.append(expression)
    return found


def scan(raw: bytes, allowed: frozenset[str]) -> tuple:
    """The row of a text but for its id."""
    joined = b" ".join(raw.translate(TO_WORDS).split())
    n_words = joined.count(b" ") + 1 if joined else 0
    text = f" {joined.decode('utf-8', 'replace')} "
    n_base, first, last, has_tag = 0, None, None, False
    base_labels: set[str] = set()
    labels: set[str] = set()
    miss = 1.0
    counted, at_word = 1, 0
    for end, (label, base, n, length) in automaton().iter(text):
        if label is None:
            has_tag = True
            continue
        labels.add(label)
        miss *= 1 - (SURE_BASE if base else SURE_NOTICE)
        if base:
            at_word += text.count(" ", counted, end + 1)
            counted = end + 1
            start = at_word - n
            n_base += 1
            base_labels.add(label)
            first = start if first is None else min(first, start)
            last = start if last is None else max(last, start)
    expressions, granted = [], None
    if has_tag:
        for expression, order in tags_of(raw):
            good, named = evaluate(order, allowed)
            granted = good if granted is None else granted and good
            expressions.append(expression)
            labels.update(named)
            miss *= 1 - SURE_TAG
    return (
        n_words, n_base, first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), 1 - miss, "; ".join(expressions), granted)


def scan_batches(batches: Iterator[pa.RecordBatch], allowed: frozenset[str]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string(), pa.bool_()]
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    for batch in batches:
        rows = [scan(text.as_py() or b"", allowed) for text in batch.column("text").cast(pa.binary())]
        columns = zip(*rows) if rows else [[] for _ in types]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types)]], names=names)


def license_scan(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """One row per row of ``docs``: words, base phrases, labels, score, and the expressions of identifier tags.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lowered; a phrase stands where its words
    follow each other. ``n_base`` counts all places of base phrases, ``first_word`` and ``last_word`` are their
    smallest and largest start. ``labels`` adds further notice phrases and the licenses named by tags. ``allowed``
    is true if every expression can be met by allowed licenses, null without one; a tag whose expression cannot be
    read is no find. ``score`` is 1 less the product of the doubts of all finds.
    A null text counts as empty: no words, no finds, score 0. Repeated rows give a row each. Texts are scanned
    whole, a row at a time, in no exchange. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(partial(scan_batches, allowed=frozenset(allowed)), SCHEMA)

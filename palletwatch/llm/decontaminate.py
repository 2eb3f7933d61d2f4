"""Removal of test items from training texts, by a generalised suffix automaton.

The automaton holds every run of words of the normalised items. Training words are
streamed through it; at each word its state knows the longest run that ends there
and occurs in an item. A span is taken out where that run reaches the length limit,
or covers the set share of an item.

Normalised words are runs of ASCII letters (lower-cased), digits and characters
beyond ASCII.

Items are dealt into blocks of bounded size, each with an automaton of its own. One block is all that the driver and a task hold
at a time. A single block, the usual case, takes one pass over the documents without a shuffle. Of several, each takes a pass
of its own that writes the hits it has to the shared folder; these are then merged by document, so that no plan grows with the items.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palletwatch.llm.blocks import Words
from palletwatch.llm.rows import with_columns
from palletwatch.session import fresh_dir, shared_dir

SPAN_WORDS = 10  # length limit
COVERAGE = 1.0  # coverage limit, as a share of an item's words
BLOCK_BYTES = 1 << 20  # of item texts in one automaton

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Maps UTF-8 bytes to those of normalised words and spaces.
NORMAL = bytes(
    b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def normal_words(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


class Automaton:
    """A suffix automaton over the words of several items, with the runs to look for marked."""

    def __init__(self, items: Iterable[tuple[int, bytes | None]], span: int = SPAN_WORDS, coverage: float = COVERAGE) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.marks: dict[int, dict[int, set[int]]] = {}
        coded = []
        for item, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in normal_words(text)]
            if words:
                coded.append((item, words))
                last = 0
                for word in words:
                    last = self._extend(last, word)
        self.shortest = span
        for item, words in coded:
            size = max(1, min(span, math.ceil(coverage * len(words))))
            self.shortest = min(self.shortest, size)
            state = length = 0
            for word in words:
                state, length = self.step(state, length, word)
                if length >= size:
                    found = state
                    while self.length[self.link[found]] >= size:
                        found = self.link[found]
                    self.marks.setdefault(found, {}).setdefault(size, set()).add(item)
        self._found: dict[tuple[int, int], tuple[int, frozenset[int]]] = {}
        self._filter(coded)

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:  # the run is known from another item
            known = self.next[last][word]
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            known = self.next[at][word]
            self.link[new] = known if self.length[known] == self.length[at] + 1 else self._split(at, word, known)
        return new

    def _state(self, length: int, after: dict[int, int], link: int) -> int:
        self.next.append(after)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, at: int, word: int, known: int) -> int:
        """Parts the shorter runs of a state from its longer ones."""
        short = self._state(self.length[at] + 1, dict(self.next[known]), self.link[known])
        self.link[known] = short
        while at >= 0 and self.next[at].get(word) == known:
            self.next[at][word] = short
            at = self.link[at]
        return short

    def step(self, state: int, length: int, word: int | None) -> tuple[int, int]:
        """The longest run that ends with ``word``: its state and length."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        after = self.next[state].get(word)
        return (after, length + 1) if after is not None else (0, 0)

    def found(self, state: int, length: int) -> tuple[int, frozenset[int]]:
        """The longest marked run that ends here, in words (0: none), and the items of all of them."""
        key = (state, length)
        if key not in self._found:
            longest, items = 0, set()
            while state > 0:
                for size, whose in self.marks.get(state, {}).items():
                    if size <= length:
                        longest = max(longest, size)
                        items |= whose
                state = self.link[state]
            self._found[key] = longest, frozenset(items)
        return self._found[key]

    def _filter(self, coded: list[tuple[int, list[int]]]) -> None:
        """Hashes of the items' words and word pairs: a run of words must be made of these."""
        by_code = list(self.vocabulary)
        words = Words.of([b" ".join([by_code[w] for w in item]) for _, item in coded])
        self.word_hashes = np.unique(words.hashes)
        self.pair_hashes = np.unique(words.window_hashes(2, words.windows(2)))

    def search(self, words: Words) -> tuple[np.ndarray, np.ndarray, dict[int, set[int]]]:
        """Start and length of each marked run, and the items found in each text."""
        none = np.empty(0, np.int64)
        if not len(words.starts) or not self.vocabulary:
            return none, none, {}
        if self.shortest == 1:
            known = np.isin(words.hashes, self.word_hashes)
            joined = known[:-1] & known[1:] & (words.text[1:] == words.text[:-1])
            begin = np.flatnonzero(known & ~np.concatenate([[False], joined]))
            end = np.flatnonzero(known & ~np.concatenate([joined, [False]])) + 1
        else:
            at = words.windows(2)
            pair = np.zeros(len(words.starts) + 1, np.int8)
            pair[at + 1] = np.isin(words.window_hashes(2, at), self.pair_hashes)  # at a pair's second word
            edge = np.diff(np.concatenate([[0], pair[1:]]))
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
            if len(end) < len(begin):
                end = np.append(end, len(words.starts))
            long = end - begin >= self.shortest
            begin, end = begin[long], end[long]
        starts, sizes, items = [], [], {}
        code, text = self.vocabulary.get, words.text
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            state = length = 0
            for place, word in enumerate(words.slice(a, b - a).split(b" "), a):
                state, length = self.step(state, length, code(word))
                if length >= self.shortest:
                    size, whose = self.found(state, length)
                    if size:
                        starts.append(place - size + 1)
                        sizes.append(size)
                        items.setdefault(int(text[place]), set()).update(whose)
        return np.array(starts, np.int64), np.array(sizes, np.int64), items


def in_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[int, DataFrame]:
    """How many blocks of about ``block_bytes`` there are, and the distinct items with their ``block``."""
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("binary").alias("text"))
    items = items.filter("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    return n, dealt.checkpoint() if n > 1 else dealt


def _block(items: DataFrame, i: int) -> list[tuple[int | None, bytes]]:
    return [(row["item_id"], bytes(row["text"])) for row in items.filter(F.col("block") == i).collect()]


def _cut(text: bytes, hits: np.ndarray, words: int) -> bytes:
    """A text without the stretches from the first to the last word of neighbouring hit words."""
    if not len(hits):
        return text
    gone = np.zeros(words + 2, np.int8)
    gone[np.asarray(hits) + 1] = 1
    found = [word.span() for word in re.finditer(rb"[^ ]+", text.translate(NORMAL))]
    parts, at = [], 0
    for a, b in np.flatnonzero(np.diff(gone)).reshape(-1, 2).tolist():
        parts.append(text[at : found[a][0]])
        at = found[b - 1][1]
    return b"".join([*parts, text[at:]])


def decontaminated(
    docs: DataFrame,
    items: DataFrame,
    span: int = SPAN_WORDS,
    coverage: float = COVERAGE,
    block_bytes: int = BLOCK_BYTES,
    clean: bool = False,
) -> DataFrame:
    """``docs`` with ``n_words``, ``hits`` (places of words in spans to remove) and ``items`` found.

    An item's marked runs have ``min(span, ceil(coverage * its words))`` words, one at
    least. Every word in an occurrence of a marked run is hit. ``items`` has the distinct ids of items
    with an occurrence, in ascending order. Null texts and items without words match
    nothing; a null item id is not listed among the items found. Items that repeat count once, documents that repeat each.
    Columns of ``docs`` with the names of the added ones give way to them. With ``clean`` there is also ``cleaned``, the text
    without its hit stretches: from the first to the last letter of neighbouring hit words; what stands around
    them stays. Items beyond one block are searched for while the DataFrame is built.
    """
    shared_dir(docs.sparkSession)
    docs = docs.drop("n_words", "hits", "items", *["cleaned"] * clean)
    n, dealt = in_blocks(items, block_bytes)
    if n == 1:
        return _searched(docs, _block(dealt, 0), span, coverage, clean)
    # Rows of one id and text have the same hits; the hash of the text stands for it.
    own = next(name for name in (f"hash{'_' * i}" for i in range(len(docs.columns) + 1)) if name not in docs.columns)
    docs = docs.withColumn(own, F.xxhash64("text"))
    plain = docs.select("doc_id", "text", F.col(own).alias("text_hash"))
    folder = fresh_dir(docs.sparkSession, "decontamination")
    for i in range(n):
        found = _searched(plain, _block(dealt, i), span, coverage, False).filter("size(hits) > 0")
        found.select("doc_id", "text_hash", "hits", "items", F.lit(i).alias("block")).write.mode("append").parquet(folder)
    found = docs.sparkSession.read.parquet(folder).dropDuplicates(["doc_id", "text_hash", "block"])
    merged = found.groupBy(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).agg(*(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name) for name in ("hits", "items")
    ))
    joined = docs.join(merged, docs["doc_id"].eqNullSafe(merged["hit_id"]) & (docs[own] == merged["hit_hash"]), "left")
    none = {"hits": F.array().cast("array<int>"), "items": F.array().cast("array<long>")}
    count = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words")
    whole = joined.select(*(docs[c] for c in docs.columns if c != own), count, *(F.coalesce(merged[c], none[c]).alias(c) for c in none))
    return whole.withColumn("cleaned", F.pandas_udf(_cut_rows, "string")("text", "hits", "n_words")) if clean else whole


def _searched(docs: DataFrame, items: list[tuple[int | None, bytes]], span: int, coverage: float, clean: bool) -> DataFrame:
    """``docs`` with the added columns, as far as these items go. No shuffle."""

    def work():
        automaton = Automaton(items, span, coverage)

        def columns(texts):
            words = Words.of(texts, lower=NORMAL)
            starts, sizes, found = automaton.search(words)
            steps = np.zeros(len(words.starts) + 1, np.int64)
            np.add.at(steps, starts, 1)
            np.add.at(steps, starts + sizes, -1)
            places = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
            text = words.text[places]
            offsets = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
            within = (places - words.first[text]).astype(np.int32)
            whose = [sorted(i for i in found.get(n, ()) if i is not None) for n in range(len(texts))]
            made = [words.counts, pa.ListArray.from_arrays(pa.array(offsets), pa.array(within)), whose]
            if clean:
                made.append([
                    _cut(t, within[a:b], n).decode() if t is not None else None
                    for t, a, b, n in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist(), words.counts.tolist(), strict=True)
                ])
            return made

        return columns

    return with_columns(docs, "n_words long, hits array<int>, items array<long>" + ", cleaned string" * clean, work)


def _cut_rows(text: pd.Series, hits: pd.Series, words: pd.Series) -> pd.Series:
    return pd.Series(
        [_cut(t.encode(), h, n).decode() if t is not None else None for t, h, n in zip(text, hits, words, strict=True)], dtype=object
    )

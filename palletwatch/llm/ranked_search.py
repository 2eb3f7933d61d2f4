"""Ranked lexical search with block maxima: each item's best documents among all.

Documents are indexed in shards, bounded slices of a task's rows. A shard's posting lists hold blocks of ``BLOCK``
postings, packed, each with the greatest impact in it. For an item, lists are put in order of their bound (weight times the
greatest impact in the shard). Lists whose bounds together stay below the score that a document must reach are not essential:
no document is a candidate for being in these alone. Candidates come from the essential lists, a range of documents at a time; the others are
consulted from the greatest bound down, where the maximum of the block that would hold a candidate rejects it before the block is
unpacked. Shards of a group are searched one after the other with the same heaps, and the heaps of all groups are merged.

All scores are whole numbers, so that they do not depend on the order in which they are added.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palletwatch.llm.blocks import Words, pieces
from palletwatch.llm.decontaminate import NORMAL
from palletwatch.llm.rows import with_columns
from palletwatch.session import shared_dir

BEST = 20
BLOCK = 128  # postings
SHARD_BYTES = 8 << 20  # of texts in a shard
GROUP_BYTES = 64 << 20  # of texts whose shards are searched by one task
QUERY_BYTES = 1 << 20  # of items that are searched for together
RANGE = 2048  # documents taken at a time
VOCABULARY = 1 << 20  # terms up to which tasks are told which terms are looked for; with more, all are indexed
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
INDEX = "shard long, term long, df long, peak long, last array<int>, high array<int>, blocks array<binary>, ids array<long>, lengths array<long>"

_WIDTHS = (np.uint8, np.uint16, np.uint32)


def pack(gaps: np.ndarray, times: np.ndarray) -> bytes:
    """A block of postings: steps between documents and occurrences, in as few bytes each as the largest needs."""
    values = np.concatenate([gaps, times])
    most = int(values.max())
    width = 0 if most < 1 << 8 else 1 if most < 1 << 16 else 2
    return bytes([width]) + values.astype(_WIDTHS[width]).tobytes()


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    values = np.frombuffer(block, _WIDTHS[block[0]], offset=1).astype(np.int64)
    return values[: len(values) // 2], values[len(values) // 2 :]


def impacts(times: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What a posting adds for a weight of one; ``lengths`` are the documents' m."""
    return 1_000_000_000 * times // (1000 * times + 12 * lengths)


class Postings:
    """One term's list in a shard; blocks are unpacked when they are first asked for."""

    def __init__(self, peak: int, last: Sequence[int], high: Sequence[int], blocks: Sequence[bytes], lengths: np.ndarray) -> None:
        self.peak, self.blocks, self.lengths = peak, blocks, lengths
        self.last, self.high = np.asarray(last, np.int64), np.asarray(high, np.int64)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block and their impacts."""
        if i not in self.open:
            gaps, times = unpack(self.blocks[i])
            documents = np.cumsum(gaps) + (self.last[i - 1] if i else -1)
            self.open[i] = documents, impacts(times, self.lengths[documents])
        return self.open[i]

    def within(self, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What the blocks that reach into a range of documents hold of it."""
        first = int(np.searchsorted(self.last, low))
        for i in range(first, min(int(np.searchsorted(self.last, high - 1)) + 1, len(self.blocks))):
            documents, impact = self.block(i)
            a, b = np.searchsorted(documents, (low, high))
            yield documents[a:b], impact[a:b]

    def bounds(self, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block that would hold each document, and the greatest impact in it; zero past the last."""
        at = np.searchsorted(self.last, documents)
        return at, np.where(at < len(self.high), self.high[np.minimum(at, len(self.high) - 1)], 0)

    def of(self, documents: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The impact of each document, of which the block is known; zero if it is not in the list."""
        out = np.zeros(len(documents), np.int64)
        for i in np.unique(at[at < len(self.blocks)]).tolist():
            mine = np.flatnonzero(at == i)
            have, impact = self.block(i)
            place = np.minimum(np.searchsorted(have, documents[mine]), len(have) - 1)
            out[mine] = np.where(have[place] == documents[mine], impact[place], 0)
        return out


class Heap:
    """The best documents of one item so far: by score, then by id, those without an id last."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.scores, self.ids, self.known = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def least(self) -> int:
        """The score that a document needs to be among the best, or to be as good as the last of them."""
        return int(self.scores[-1]) if len(self.scores) == self.most else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        scores, ids, known = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.known, known)))
        order = np.lexsort((ids, ~known, -scores))[: self.most]
        self.scores, self.ids, self.known = scores[order], ids[order], known[order]


def search(
    lists: Sequence[Postings], weights: Sequence[int], ids: np.ndarray, known: np.ndarray, heap: Heap, step: int = RANGE
) -> None:
    """Adds a shard's documents to an item's heap, as far as they can be among its best."""
    bounds = np.array([w * p.peak for w, p in zip(weights, lists, strict=True)], np.int64)
    order = np.argsort(bounds, kind="stable")
    lists, weights = [lists[i] for i in order], [weights[i] for i in order]
    below = np.concatenate([[0], np.cumsum(bounds[order])])  # bounds of the lists before each
    for low in range(0, len(ids), step):
        needed = heap.least
        essential = int(np.searchsorted(below[1:], needed))  # the first list with which the score can be reached
        if essential == len(lists):
            return
        high = min(low + step, len(ids))
        score = np.zeros(high - low, np.int64)
        for weight, postings in zip(weights[essential:], lists[essential:], strict=True):
            for documents, impact in postings.within(low, high):
                score[documents - low] += weight * impact
        found = np.flatnonzero(score)
        score = score[found]
        found = found + low
        for i in range(essential - 1, -1, -1):
            fit = score + below[i + 1] >= needed
            found, score = found[fit], score[fit]
            at, most = lists[i].bounds(found)
            fit = score + weights[i] * most + below[i] >= needed
            found, score, at = found[fit], score[fit], at[fit]
            if not len(found):
                break
            score = score + weights[i] * lists[i].of(found, at)
        fit = score >= needed
        if fit.any():
            heap.add(score[fit], ids[found[fit]], known[found[fit]])


def shard_rows(texts: Sequence[bytes | None], lengths_of, vocabulary: np.ndarray | None) -> Iterator[tuple]:
    """``term, df, peak, last, high, blocks`` of each list, documents numbered as they come; ``lengths_of`` gives their m from their terms."""
    words = Words.of(texts, lower=NORMAL)
    lengths = lengths_of(words.counts)
    hashes, of = words.hashes, words.text
    if vocabulary is not None:
        place = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
        used = np.flatnonzero(vocabulary[place] == hashes) if len(vocabulary) else np.empty(0, np.int64)
        terms, number, of = vocabulary, place[used], of[used]
    else:
        terms, number = np.unique(hashes, return_inverse=True)
    posting, times = np.unique(number * np.int64(len(texts)) + of, return_counts=True)
    number, documents = np.divmod(posting, len(texts))
    impact = impacts(times, lengths[documents])
    new = np.flatnonzero(np.diff(number, prepend=-1))
    size = np.diff(np.append(new, len(number)))
    gaps = np.diff(documents, prepend=0)
    gaps[new] = documents[new] + 1
    for a, n in zip(new.tolist(), size.tolist(), strict=True):
        cuts = range(a, a + n, BLOCK)
        high = np.maximum.reduceat(impact[a : a + n], np.arange(0, n, BLOCK))
        last = documents[np.minimum(np.arange(a + BLOCK - 1, a + n + BLOCK - 1, BLOCK), a + n - 1)]
        blocks = [pack(gaps[c : min(c + BLOCK, a + n)], times[c : min(c + BLOCK, a + n)]) for c in cuts]
        yield int(terms[number[a]].astype(np.int64)), n, int(high.max()), last.tolist(), high.tolist(), blocks


def index(docs: DataFrame, documents: int, total: int, vocabulary: np.ndarray | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Posting lists (``term`` to ``blocks``) of shards, and a row with the ids and lengths (m) of each shard's documents.

    ``documents`` and ``total`` are the number of documents with a term and of all their terms. With a ``vocabulary``, the sorted hashes
    of terms, only their lists are made. No shuffle: a shard is a slice of the rows that a task reads, in order of the id.
    """

    def m(counts: np.ndarray) -> np.ndarray:
        return 75 + (25 * counts.astype(np.int64) * documents) // max(total, 1)

    schema = pa.schema([
        ("shard", pa.int64()), ("term", pa.int64()), ("df", pa.int64()), ("peak", pa.int64()), ("last", pa.list_(pa.int32())),
        ("high", pa.list_(pa.int32())), ("blocks", pa.list_(pa.binary())), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi, texts in pieces(batch["text"], shard_bytes):
                ids = batch["doc_id"].slice(lo, hi - lo).to_pylist()
                order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
                texts, lengths = [texts[i] for i in order], []

                def lengths_of(counts, lengths=lengths):
                    lengths.append(m(counts))
                    return lengths[0]

                rows = list(shard_rows(texts, lengths_of, vocabulary))
                parts = [*zip(*rows, strict=True)] if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard] * (len(rows) + 1), pa.int64()),
                    *(pa.array([*part, None], field.type) for part, field in zip(parts, list(schema)[1:7], strict=True)),
                    pa.array([None] * len(rows) + [[ids[i] for i in order]], schema.field("ids").type),
                    pa.array([None] * len(rows) + [lengths[0].tolist()], schema.field("lengths").type),
                ], schema=schema)
                shard += 1

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, INDEX)


def item_terms(items: DataFrame) -> DataFrame:
    """``item``, ``item_id``, ``bytes`` of the text, ``term`` (a hash) and ``times``: a row for each distinct row of ``items`` and term in it."""
    items = items.select("item_id", "text").distinct().withColumn("item", F.xxhash64("item_id", "text"))

    def columns(texts):
        words = Words.of(texts, lower=NORMAL)
        found = [np.unique(words.hashes[a:b], return_counts=True) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        return [[t.view(np.int64) for t, _ in found], [n for _, n in found]]

    found = with_columns(items.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0))), "terms array<long>, times array<long>", lambda: columns, drop=("text",))
    return found.select("item", "item_id", "bytes", F.explode(F.arrays_zip("terms", "times")).alias("t")).select(
        "item", "item_id", "bytes", F.col("t.terms").alias("term"), F.col("t.times").alias("times")
    )


def _searched(most: int, step: int):
    """The best documents of each item of a block among the shards of a group, from their lists and the items' weights."""

    def run(lists: pa.Table, asked: pa.Table) -> pa.Table:
        items: dict[int, list[tuple[int, int]]] = {}
        for item, term, weight in zip(*(asked[name].to_pylist() for name in ("item", "term", "weight")), strict=True):
            items.setdefault(item, []).append((term, weight))
        heaps = {item: Heap(most) for item in items}
        lists = lists.sort_by("shard")
        shards = lists["shard"].to_numpy()
        begin = np.flatnonzero(np.diff(shards, prepend=-1)) if len(shards) else np.empty(0, np.int64)
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(shards)], strict=False):
            rows = lists.slice(a, b - a).select(["term", "peak", "last", "high", "blocks", "ids", "lengths"]).to_pylist()
            table = next(row for row in rows if row["term"] is None)
            lengths = np.array(table["lengths"], np.int64)
            known = np.array([i is not None for i in table["ids"]], bool)
            ids = np.array([i or 0 for i in table["ids"]], np.int64)
            have = {row["term"]: Postings(row["peak"], row["last"], row["high"], row["blocks"], lengths) for row in rows if row["term"] is not None}
            for item, wanted in items.items():
                here = [(have[term], weight) for term, weight in wanted if term in have]
                if here:
                    search([p for p, _ in here], [w for _, w in here], ids, known, heaps[item], step)
        found = [(item, int(i) if k else None, int(s)) for item, heap in heaps.items() for s, i, k in zip(heap.scores, heap.ids, heap.known, strict=True)]
        parts = [*zip(*found, strict=True)] if found else [[]] * 3
        return pa.table([pa.array(part, pa.int64()) for part in parts], ["item", "doc_id", "score"])

    return run


def ranked(
    docs: DataFrame, items: DataFrame, most: int = BEST, query_bytes: int = QUERY_BYTES, shard_bytes: int = SHARD_BYTES,
    group_bytes: int = GROUP_BYTES, vocabulary: int = VOCABULARY, step: int = RANGE,
) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` (long): each item's ``most`` best documents with a score above 0.

    Terms are runs of ASCII letters (in lower case), digits and characters beyond ASCII. N documents have a term, L terms in all; a
    document of n terms has m = 75 + 25 n N div L, a term found in df documents the weight w = floor(1000 ln((2 N + 2) / (2 df + 1))), and
    the score is the sum over the item's terms, repeats included, of w times (10**9 tf div (1000 tf + 12 m)).
    Equal scores rank by document id, none last. Rows of ``items`` that repeat are one item; one id with two texts is
    two items. Every row of ``docs`` is a document; a null or empty text has no terms and is found by nothing. Other columns are
    left out. Terms are told apart by 64-bit hashes. The index is checkpointed.
    """
    shared_dir(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    terms = F.coalesce(F.regexp_count("text", F.lit(TERM)), F.lit(0)).cast("long")
    documents, total, size = docs.agg(
        F.sum((terms > 0).cast("long")), F.sum(terms), F.sum(F.octet_length("text"))
    ).first()
    documents, total, size = documents or 0, total or 0, size or 0
    asked = item_terms(items).checkpoint()
    wanted = asked.select("term").distinct()
    chosen = None
    if wanted.count() <= vocabulary:
        chosen = np.sort(wanted.toArrow()["term"].to_numpy().astype(np.int64).view(np.uint64))
    lists = index(docs, documents, total, chosen, shard_bytes).checkpoint()

    df = lists.filter("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.ln((2 * F.lit(float(documents)) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = asked.join(df, "term").select("item", "item_id", "term", (weight * F.col("times")).alias("weight"))

    groups = max(1, math.ceil(size / group_bytes))
    blocks = max(1, math.ceil((asked.select("item", "bytes").distinct().agg(F.sum("bytes")).first()[0] or 0) / query_bytes))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block")
    # Every group of shards gets the items, a block at a time, and of its lists those that the block asks for.
    requests = weighted.select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), block, "item", "term", "weight"
    )
    placed = lists.withColumn("group", F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int"))
    needed = weighted.select(block, F.col("term").alias("asked")).distinct()
    sent = placed.filter("term is not null").join(needed, F.col("term") == F.col("asked")).drop("asked").unionByName(
        placed.filter("term is null").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    )
    found = sent.groupBy("group", "block").cogroup(requests.groupBy("group", "block")).applyInArrow(
        lambda _, left, right: _searched(most, step)(left, right), "item long, doc_id long, score long"
    )
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranks = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)
    return ranks.join(asked.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")

"""Stupid-backoff scores of documents from the n-gram counts of all other documents.

The n-grams of every order are hashed to 64 bits and the count table is partitioned
by hash range. Exploded n-grams are not sent one by one: documents are dealt into chunks,
and a chunk sends each partition the sorted distinct hashes it holds, with its
own counts. The partition adds the counts up and joins them to each chunk's list, so
that a very frequent n-gram arrives once per chunk. The chunk takes the counts back to the
places of its n-grams, takes off what the document itself adds, and sums the scores of each document. Without
its own counts a document has n-grams that were never seen, and these are what the backoff is for.

Words and pairs are counted first, then one order at a time. A document of which another one shares an n-gram shares both runs of n-1 words
inside it, too; one with a run that no other document has is not sent.

Two n-grams of equal hash would share a count; among n distinct n-grams some n**2 / 2**65 pairs
do so.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palletwatch.llm.blocks import Words, binary
from palletwatch.llm.chunks import in_chunks

CHUNK_BYTES = 8 << 20  # of texts; the larger, the more of a chunk's n-grams are alike and are sent once
ORDER = 3
ALPHA = 0.4
PAIRS = 2  # orders up to this one are counted together
PARTITION_BYTES = 4 << 20  # of texts, for each partition of the count table


def _pack(numbers: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes: the high bytes of small numbers cost nothing."""
    planes = numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _order(hashes: np.ndarray) -> np.ndarray:
    """The places in order of their hashes, equal ones in order of place."""
    low = np.uint64((1 << max(1, (len(hashes) - 1).bit_length())) - 1)
    # plain numbers are sorted several times faster than places by numbers: high bits of the hash before the place
    order = (np.sort((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)) & low).astype(np.int64)
    ranked = hashes[order]
    if (ranked[1:] < ranked[:-1]).any() or ((ranked[1:] != ranked[:-1]) & ((ranked[1:] & ~low) == (ranked[:-1] & ~low))).any():
        return np.argsort(hashes, kind="stable")
    return order


def _counted(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes and their counts; for each place which hash it has, and how often its own text has that.

    Places are in order of their texts within each order of n-grams, which have no hash in common.
    """
    order = _order(hashes)
    ranked, texts = hashes[order], text[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])[: len(hashes)]
    first = np.flatnonzero(new)
    run = np.cumsum(new | np.concatenate([[True], texts[1:] != texts[:-1]])[: len(hashes)]) - 1
    which, own = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
    which[order] = np.cumsum(new) - 1
    own[order] = np.bincount(run)[run] if len(run) else run
    return ranked[first], np.diff(np.append(first, len(hashes))), which, own


def _grams(words: Words, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The first words of the n-grams of each order; what ``_counted`` gives for all of them, by place cut into the orders."""
    at = [words.windows(n) for n in range(1, order + 1)]
    hashes = [words.window_hashes(n, places) for n, places in enumerate(at, 1)]
    distinct, counts, which, own = _counted(np.concatenate(hashes), np.concatenate([words.text[places] for places in at]))
    cuts = np.cumsum([len(h) for h in hashes])[:-1]
    return at, distinct, counts, np.split(which, cuts), np.split(own, cuts)


def _asked(words: Words, n: int, at: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of n-grams, and which of these another text may have, by places and counts of the order below."""
    places = words.windows(n)
    left = np.searchsorted(at, places)
    return places, (others[left] > 0) & (others[np.minimum(left + 1, len(at) - 1)] > 0) if len(at) else np.zeros(0, bool)


def _others(words: Words, order: int, answers: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each order the first words of n-grams and their counts in all other texts, from the answers to a chunk."""
    count: dict[int, list[np.ndarray]] = {}
    for row in sorted(answers.select(["level", "part", "counts"]).to_pylist(), key=lambda row: (row["level"], row["part"])):
        count.setdefault(row["level"], [np.empty(0, np.uint64)]).append(_unpack(row["counts"]))
    whole = {level: np.concatenate(found).astype(np.int64) for level, found in count.items()}
    nothing = np.empty(0, np.int64)
    at, _, _, which, own = _grams(words, min(order, PAIRS))
    others = [whole.get(PAIRS, nothing)[w] - o for w, o in zip(which, own, strict=True)]
    for n in range(PAIRS + 1, order + 1):
        places, asked = _asked(words, n, at[-1], others[-1])
        _, _, which, own = _counted(words.window_hashes(n, places[asked]), words.text[places[asked]])
        found = np.zeros(len(places), np.int64)
        found[asked] = whole.get(n, nothing)[which] - own
        at.append(places)
        others.append(found)
    return at, others


def _edges(distinct: np.ndarray, partitions: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash partitions that have some of the sorted hashes, and where each begins."""
    part = ((distinct >> np.uint64(32)) * np.uint64(partitions)) >> np.uint64(32)
    return np.unique(part.astype(np.int64), return_index=True)


def scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """``doc_id``, ``n_words`` and ``log_score``, the sum over words of the log of their score.

    Counts c are over every other row of ``docs``, rows that repeat included; the document's own words never count for it.
    A word's score given the words before it is c(n-gram) / c(its first n-1 words) for the
    longest n-gram, up to ``order``, that other documents have; each order given
    up multiplies it by ``alpha``. The lowest order is c(word) / all words of other documents, and below it, for a word that no other
    has, 1 / all words of other documents (1 if there are none). Words near the start
    of a document have shorter n-grams, at no loss. A null or empty text has no words and a score of 0. Rows that share an id, or have
    none, are documents each. Other columns are left out; an empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    size, total = docs.agg(
        F.sum(F.octet_length("text")), F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long"))
    ).first()
    size, total = size or 0, total or 0
    chunks = in_chunks(docs, size, CHUNK_BYTES, spread=True)
    partitions = max(1, math.ceil(size / PARTITION_BYTES))

    def ordered(table: pa.Table) -> tuple[pa.Table, Words]:
        table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))
        return table, Words.of(binary(table["text"].combine_chunks()))

    def sent(chunk: int, level: int, distinct: np.ndarray, counts: np.ndarray) -> pa.Table:
        part, begin = _edges(distinct, partitions)
        gaps, own = np.split(distinct, begin[1:]), np.split(counts, begin[1:])
        n = len(part)
        return pa.table({
            "part": pa.array(part, pa.int64()),
            "chunk": pa.array([chunk] * n, pa.int64()),
            "level": pa.array([level] * n, pa.int32()),
            "hashes": pa.array([_pack(np.diff(g, prepend=np.uint64(0))) for g in gaps[:n]], pa.binary()),
            "counts": pa.array([_pack(c) for c in own[:n]], pa.binary()),
        })

    def send(table: pa.Table) -> pa.Table:
        _, words = ordered(table)
        _, distinct, counts, _, _ = _grams(words, min(order, PAIRS))
        return sent(table["_chunk"][0].as_py(), PAIRS, distinct, counts)

    def sender(n: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def send_more(left: pa.Table, right: pa.Table) -> pa.Table:
            _, words = ordered(left)
            at, others = _others(words, n - 1, right)
            places, asked = _asked(words, n, at[-1], others[-1])
            distinct, counts, _, _ = _counted(words.window_hashes(n, places[asked]), words.text[places[asked]])
            return sent(left["_chunk"][0].as_py(), n, distinct, counts)

        return send_more

    def join(table: pa.Table) -> pa.Table:
        rows = table.select(["chunk", "hashes", "counts"]).to_pylist()
        hashes = [np.cumsum(_unpack(row["hashes"]), dtype=np.uint64) for row in rows]
        counts = np.concatenate([_unpack(row["counts"]) for row in rows])
        _, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        whole = np.zeros(inverse.max() + 1, np.uint64)
        np.add.at(whole, inverse, counts)
        answers = np.split(whole[inverse], np.cumsum([len(h) for h in hashes])[:-1])
        return pa.table({
            "chunk": pa.array([row["chunk"] for row in rows], pa.int64()),
            "level": table["level"],
            "part": table["part"],
            "counts": pa.array([_pack(a) for a in answers], pa.binary()),
        })

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        table, words = ordered(left)
        at, others = _others(words, order, right)
        rest = np.maximum(total - words.counts, 1)[words.text]  # words of other documents
        score = np.log(np.where(others[0] > 0, others[0], alpha) / rest)
        for n in range(2, order + 1):
            place = at[n - 1]
            left = place if n == 2 else np.searchsorted(at[n - 2], place)
            known = others[n - 1] > 0
            ratio = np.where(known, others[n - 1], 1) / np.where(known, others[n - 2][left], 1)
            end = place + n - 1
            score[end] = np.where(known, np.log(ratio), score[end] + math.log(alpha))
        sums = np.add.reduceat(np.append(score, 0.0), words.first[:-1]) * (words.counts > 0)
        return pa.table({
            "doc_id": table["doc_id"], "n_words": pa.array(words.counts), "log_score": pa.array(sums, pa.float64()),
        })

    grams = "part long, chunk long, level int, hashes binary, counts binary"
    counted = "chunk long, level int, part long, counts binary"
    answers = chunks.groupBy("_chunk").applyInArrow(send, grams).groupBy("part").applyInArrow(join, counted)
    for n in range(PAIRS + 1, order + 1):
        more = chunks.groupBy("_chunk").cogroup(answers.groupBy("chunk")).applyInArrow(sender(n), grams)
        answers = answers.unionByName(more.groupBy("part").applyInArrow(join, counted))
    return (
        chunks.groupBy("_chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInArrow(add, "doc_id long, n_words long, log_score double")
    )

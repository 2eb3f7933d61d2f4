"""Removal of repeated word windows, by super-k-mers sent to the bucket of their minimiser.

A window is ``size`` consecutive words of one document. Its minimiser is the least
of its runs of ``inner`` words, by hash. Consecutive windows with one minimiser
travel as one packed string (their words, once) to the minimiser's bucket, where
windows are sorted and counted exactly. Equal windows have equal minimisers, so
all copies of a window meet in one bucket.

Three steps keep every task bounded:

1. Documents are dealt into chunks by id. A chunk sends each distinct super-k-mer
   once, however often it holds it, with the smallest document id it occurs in.
2. A bucket answers each chunk with one bit per window sent: does an earlier
   document of another chunk hold it?
3. The chunk adds what repeats within itself and drops the covered words.

Runs of ``inner`` words that are very frequent, and would fill one bucket with many
different strings, come last in the minimiser order; only a window made of
nothing else still uses them, and such windows repeat and travel once per chunk.

Rows without an id count as one last document id; rows that share an id are
ordered by text. A null or empty text has no words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palletwatch.llm.blocks import Words, binary, classes, covered, pieces
from palletwatch.llm.chunks import CHUNK_BYTES, in_chunks
from palletwatch.session import shared_dir

WINDOW = 20
INNER = 5
BUCKET_BYTES = 2 << 20  # of texts, for each bucket
LONGEST = 256  # windows of one packed string
HEAVY = 4096  # a run of words is frequent if it is the minimiser of one in so many strings

LAST = np.iinfo(np.int64).max


@dataclass
class Runs:
    """Super-k-mers of some texts: place of the first word, number of windows, minimiser."""

    start: np.ndarray
    windows: np.ndarray
    key: np.ndarray


def super_kmers(words: Words, size: int, inner: int, heavy: np.ndarray) -> Runs:
    at = words.windows(size)
    if not len(at):
        return Runs(*(np.empty(0, kind) for kind in (np.int64, np.int64, np.uint64)))
    places = len(words.starts) - inner + 1
    keys = words.window_hashes(inner, np.arange(places)) >> np.uint64(1)
    if len(heavy):
        keys[np.isin(keys, heavy)] |= np.uint64(1 << 63)
    left, done = size - inner + 1, 1
    while done < left:  # least of `left` neighbours, doubling the reach
        step = min(done, left - done)
        keys = np.minimum(keys[: len(keys) - step], keys[step:])
        done += step
    keys = keys[at]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (at[1:] != at[:-1] + 1)])
    start = np.flatnonzero(new)
    length = np.diff(np.concatenate([start, [len(at)]]))
    if length.max() > LONGEST:
        parts = -(-length // LONGEST)
        part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(start, parts) + part * LONGEST
        length = np.minimum(np.repeat(length, parts) - part * LONGEST, LONGEST)
    return Runs(at[start], length, keys[start])


@dataclass
class Sent:
    """The distinct super-k-mers of a chunk, in the order they are sent."""

    words: Words
    runs: Runs
    number: np.ndarray  # of each run, its distinct string
    first: np.ndarray  # of each distinct string, its first run
    bucket: np.ndarray  # of each distinct string, ascending


def sent(words: Words, size: int, inner: int, heavy: np.ndarray, buckets: int) -> Sent:
    runs = super_kmers(words, size, inner, heavy)
    numbers: dict[bytes, int] = {}
    begin, end = words.starts[runs.start], words.ends[runs.start + runs.windows + size - 2]
    number = np.array(
        [numbers.setdefault(words.buffer[a:b], len(numbers)) for a, b in zip(begin.tolist(), end.tolist(), strict=True)],
        np.int64,
    )
    first = np.unique(number, return_index=True)[1]
    bucket = ((runs.key[first] & np.uint64((1 << 63) - 1)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return Sent(words, runs, place[number], first[order], bucket[order])


def _chunk(table: pa.Table) -> tuple[pa.Table, Words]:
    """The rows of a chunk in order of document id and text."""
    order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")])
    table = table.take(order)
    return table, Words.of(binary(table["text"].combine_chunks()))


def _ids(table: pa.Table) -> np.ndarray:
    return pc.fill_null(table["doc_id"], int(LAST)).to_numpy()


def _frequent(docs: DataFrame, size: int, inner: int) -> tuple[int, np.ndarray]:
    """Bytes of all texts, and the frequent minimisers: at most ``HEAVY`` of them by their definition.

    A slice reports minimisers whose share in it is a quarter of that; one that is
    frequent overall is so in some slices. The list decides only which bucket a
    window goes to, never whether it is found.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in pieces(batch["text"], CHUNK_BYTES):
                words = Words.of(texts)
                found = super_kmers(words, size, inner, np.empty(0, np.uint64)).key
                keys, n = np.unique(found, return_counts=True)
                many = n >= max(4, len(found) / HEAVY * 4)
                total = [sum(len(t) for t in texts if t), len(found)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([[-2, -1], keys[many].astype(np.int64)])),
                        pa.array(np.concatenate([total, n[many]]).astype(np.int64)),
                    ],
                    ["key", "n"],
                )

    shared_dir(docs.sparkSession)
    totals = docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    totals = totals.checkpoint()
    whole = {row["key"]: row["n"] for row in totals.filter("key < 0").collect()}
    found = totals.filter((F.col("key") >= 0) & (F.col("n") * HEAVY >= whole.get(-1, 0)))
    return whole.get(-2, 0), np.array([row["key"] for row in found.collect()], np.uint64)  # at most HEAVY rows


def removed_words(docs: DataFrame, size: int = WINDOW, inner: int = INNER) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept`` (the words that stay, joined by one space).

    A word goes if it lies in a window that also starts earlier, in a smaller document id or
    further ahead in the same one. Windows are judged on the input, not on what is
    left. ``text`` stays as given. Columns of ``docs`` with the names of the added ones give way
    to them, and one called ``_chunk`` is left out; an empty table gives an empty result.
    """
    if not 0 < inner <= size:
        raise ValueError("inner runs must fit into a window")
    docs = docs.drop("n_words", "n_removed", "kept", "_chunk")
    given = docs.columns
    total, heavy = _frequent(docs, size, inner)
    chunks = in_chunks(docs, total)
    buckets = max(1, math.ceil(total / BUCKET_BYTES))

    def send(table: pa.Table) -> pa.Table:
        chunk = table["_chunk"][0].as_py()
        table, words = _chunk(table)
        out = sent(words, size, inner, heavy, buckets)
        ids = _ids(table)[words.text[out.runs.start[out.first]]] if len(out.first) else np.empty(0, np.int64)
        begin = words.starts[out.runs.start[out.first]].tolist()
        end = words.ends[out.runs.start[out.first] + out.runs.windows[out.first] + size - 2].tolist()
        used, at = np.unique(out.bucket, return_index=True)
        rows = []
        pack = zstandard.ZstdCompressor(level=3).compress
        for bucket, lo, hi in zip(used.tolist(), at.tolist(), [*at[1:].tolist(), len(out.bucket)], strict=True):
            strings = b"\n".join([words.buffer[a:b] for a, b in zip(begin[lo:hi], end[lo:hi], strict=True)])
            rows.append((bucket, chunk, pack(strings), pack(ids[lo:hi].tobytes())))
        names = ("bucket", "chunk", "strings", "ids")
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})

    def judge(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        lines, ids, chunk, count = [], [], [], []
        for row in table.select(["chunk", "strings", "ids"]).to_pylist():
            mine = unpack(row["strings"]).split(b"\n")
            lines += mine
            ids.append(np.frombuffer(unpack(row["ids"]), np.int64))
            chunk.append(row["chunk"])
            count.append(len(mine))
        words, ids = Words.spaced(lines), np.concatenate(ids)
        del lines
        at = words.windows(size)
        line = words.text[at]
        source = np.repeat(np.arange(len(count)), count)[line]
        number, doc = classes(words, size, at), ids[line]
        earliest = np.full(number.max() + 1, LAST)
        np.minimum.at(earliest, number, doc)
        pair = number * len(count) + source  # a window in a chunk
        order = np.lexsort((doc, pair))
        new = np.concatenate([[True], pair[order][1:] != pair[order][:-1]])
        own = np.empty(len(pair), np.int64)
        own[order] = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        later = earliest[number] < own
        rows, pack = [], zstandard.ZstdCompressor(level=3).compress
        for i, bits in enumerate(np.split(later, np.searchsorted(source, np.arange(1, len(count))))):
            if bits.any():
                rows.append((chunk[i], table["bucket"][0].as_py(), pack(np.packbits(bits).tobytes())))
        names = ("chunk", "bucket", "later")
        kinds = (pa.int64(), pa.int64(), pa.binary())
        return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        table, words = _chunk(left)
        out = sent(words, size, inner, heavy, buckets)
        windows = out.runs.windows[out.first]
        offset = np.concatenate([[0], np.cumsum(windows)])  # of each distinct string among the bits
        later = np.zeros(offset[-1], bool)
        unpack = zstandard.ZstdDecompressor().decompress
        for row in right.to_pylist():
            lo, hi = offset[np.searchsorted(out.bucket, [row["bucket"], row["bucket"] + 1])]
            later[lo:hi] = np.unpackbits(np.frombuffer(unpack(row["later"]), np.uint8), count=hi - lo).astype(bool)
        at = words.windows(size)
        number = classes(words, size, at)
        again = np.ones(len(at), bool)
        again[np.unique(number, return_index=True)[1]] = False  # the first here, in order of the chunk
        if len(at):
            runs = out.runs
            within = np.arange(len(at)) - np.repeat(np.cumsum(runs.windows) - runs.windows, runs.windows)
            again |= later[np.repeat(offset[out.number], runs.windows) + within]
        gone = covered(len(words.starts), at[again], size)
        lost = np.add.reduceat(np.concatenate([gone, [0]]).astype(np.int64), words.first[:-1]) * (words.counts > 0)
        kept = []
        for i, (lo, hi, n) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), lost.tolist(), strict=True)):
            if lo == hi:
                kept.append(b"")
            elif not n:
                kept.append(words.slice(lo, hi - lo))
            else:
                edges = np.flatnonzero(np.diff(np.concatenate([[1], gone[lo:hi], [1]]).astype(np.int8))) + lo
                kept.append(b" ".join([words.slice(a, b - a) for a, b in edges.reshape(-1, 2).tolist()]))
        added = [pa.array(words.counts), pa.array(lost.astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.table([*(table[name] for name in given), *added], [*given, "n_words", "n_removed", "kept"])

    schema = T.StructType(docs.schema.fields + T.StructType.fromDDL("n_words long, n_removed long, kept string").fields)
    parts = chunks.groupBy("_chunk").applyInArrow(send, "bucket long, chunk long, strings binary, ids binary")
    answers = parts.groupBy("bucket").applyInArrow(judge, "chunk long, bucket long, later binary")
    return (
        chunks.groupBy("_chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInArrow(finish, schema)
    )

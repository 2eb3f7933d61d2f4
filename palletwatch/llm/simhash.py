"""SimHash near-duplicates, with candidates pruned along a ring of fingerprint segments.

A 64-bit fingerprint is a ring of eight segments. If two fingerprints differ in at
most ``t`` bits, some segment starts a chain whose first ``l`` segments differ in at
most ``l * t / 8`` bits, for every ``l``. Up to three bits this leaves the first two
segments equal and at most one bit in the first five, so of segments three to five two are
equal: a fingerprint is filed under 24 keys of four segments (eight starts, three
choices). Within a key, pairs must keep every budget along the chain before the
full distance is worked out.

Equal fingerprints are one node. Within a key only a spanning forest of the links is
given out, never all pairs; components are then found by alternating star steps over
Spark joins, each written to the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palletwatch.llm.blocks import Words
from palletwatch.llm.rows import with_columns
from palletwatch.session import shared_dir

SHINGLE = 3
MAX_BITS = 3
SEGMENTS = 8
SEED = 42
SMALL = 64  # groups up to this size are compared side by side
SPLIT = 4096  # groups beyond this size are divided again by one more segment


def fingerprints(texts: Sequence[bytes | None], shingle: int = SHINGLE) -> np.ndarray:
    """A signed 64-bit fingerprint for each text; zero where there is no word."""
    words = Words.of([text.lower() if text else text for text in texts])  # bytes: A-Z only
    many = np.maximum(words.counts - shingle + 1, np.minimum(words.counts, 1))  # shingles of each text
    length = np.minimum(words.counts, shingle)
    offset = np.concatenate([[0], np.cumsum(many)])
    first = np.repeat(words.first[:-1] - offset[:-1], many) + np.arange(offset[-1])
    begin, end = words.starts[first], words.ends[first + np.repeat(length, many) - 1]
    digest, buffer = xxhash.xxh64_intdigest, words.buffer
    hashes = np.fromiter(
        (digest(buffer[a:b], SEED) for a, b in zip(begin.tolist(), end.tolist(), strict=True)), np.uint64, len(first)
    )
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(many)
    if len(full):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, offset[full], axis=0, dtype=np.int32)
        major = (2 * counts > many[full][:, None]).astype(np.uint8)
        out[full] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
    return out.view(np.int64)


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE, drop: Sequence[str] = ()) -> DataFrame:
    """``docs`` with a long column ``fingerprint``."""
    return with_columns(docs, "fingerprint long", lambda: lambda texts: [fingerprints(texts, shingle)], drop=drop)


def _linked(a: np.ndarray, b: np.ndarray, start: np.ndarray, most: int) -> np.ndarray:
    """Pairs that keep the budget of each prefix of the chain from ``start``, the last being all 64 bits."""
    other = a ^ b
    turn = (start * 8).astype(np.uint64)
    ring = (other >> turn) | (other << ((np.uint64(64) - turn) % np.uint64(64)))
    fine = np.ones(len(other), bool)
    for length in range(2, SEGMENTS + 1):
        part = ring if length == SEGMENTS else ring & np.uint64((1 << (8 * length)) - 1)
        fine &= np.bitwise_count(part) <= length * most // SEGMENTS
    return fine


def _forest(points: np.ndarray, start: int, most: int) -> Iterator[tuple[np.ndarray, np.uint64]]:
    """Links that span the components among the fingerprints of one large key: (members, their centre)."""
    if len(points) <= SPLIT:
        yield from _grow(points, start, most)
        return
    varying = int(np.bitwise_or.reduce(points ^ points[0]))
    bits = [1 << i for i in range(64) if varying >> i & 1]
    for part in range(most + 1):  # of so many shares of the varying bits, linked pairs agree in one
        value = points & np.uint64(sum(bits[part :: most + 1]))
        order = np.argsort(value, kind="stable")
        for group in np.split(points[order], np.flatnonzero(np.diff(value[order])) + 1):
            if len(group) > 1:
                yield from _forest(group, start, most)


def _grow(points: np.ndarray, start: int, most: int) -> Iterator[tuple[np.ndarray, np.uint64]]:
    """Breadth first: what is found is not compared again."""
    left = points
    edge: list[np.uint64] = []
    while len(left):
        if not edge:
            edge, left = [left[0]], left[1:]
        centre = edge.pop()
        near = _linked(left, np.full(len(left), centre), np.full(len(left), start), most)
        if near.any():
            found = left[near]
            yield found, centre
            edge += list(found)
            left = left[~near]


def _links(most: int):
    """Rows (key, fingerprint) in order of the key to links, a batch and the open group at a time."""

    def some(keys: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        begin = np.flatnonzero(new)
        size = np.diff(np.concatenate([begin, [len(keys)]]))
        group = np.repeat(np.arange(len(begin)), size)
        start = (keys >> 32) // 3
        low, high = [], []
        plain = (size > 1) & (size <= SMALL)
        rows = np.flatnonzero(plain[group])
        if len(rows):
            p, g, s = points[rows], group[rows], start[rows].astype(np.uint64)
            label = np.arange(len(rows))
            pairs = []
            for step in range(1, int(size[plain].max())):
                a = np.flatnonzero(g[:-step] == g[step:])
                a = a[_linked(p[a], p[a + step], s[a], most)]
                pairs.append((a, a + step))
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            while len(a):
                before = label.copy()
                least = np.minimum(label[a], label[b])
                np.minimum.at(label, a, least)
                np.minimum.at(label, b, least)
                if np.array_equal(before, label):
                    break
            apart = np.flatnonzero(label != np.arange(len(rows)))
            low.append(p[label[apart]])
            high.append(p[apart])
        for i in np.flatnonzero(size > SMALL):
            for found, centre in _forest(points[begin[i] : begin[i] + size[i]], int(start[begin[i]]), most):
                low.append(np.full(len(found), centre, np.uint64))
                high.append(found)
        none = np.empty(0, np.uint64)
        return np.concatenate([none, *low]), np.concatenate([none, *high])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, points = [], []  # the open group, in parts

        def linked(keys, points):
            a, b = some(np.concatenate(keys), np.concatenate(points).view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            k, p = batch["key"].to_numpy(), batch["fingerprint"].to_numpy()
            last = np.searchsorted(k, k[-1])  # the last group may go on
            if last or keys and keys[0][0] != k[0]:
                yield linked([*keys, k[:last]], [*points, p[:last]])
                keys, points = [], []
            keys.append(k[last:])
            points.append(p[last:])
        if keys:
            yield linked(keys, points)

    return run


def links(points: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """Links ``a``, ``b`` whose components are those of all fingerprints at most ``most`` bits apart."""
    if not 0 <= most <= 3:
        raise ValueError("the keys hold for distances of up to three bits")

    def segment(i: int):
        return F.shiftrightunsigned("fingerprint", 8 * (i % SEGMENTS)).bitwiseAND(F.lit(255))

    keys = [
        sum((segment(start + s) * F.lit(1 << (8 * place)) for place, s in enumerate((0, 1, *pair))), F.lit((start * 3 + i) << 32))
        for start in range(SEGMENTS)
        for i, pair in enumerate(((2, 3), (2, 4), (3, 4)))
    ]
    filed = points.select(F.explode(F.array(*keys)).alias("key"), "fingerprint")
    return filed.repartition("key").sortWithinPartitions("key").mapInArrow(_links(most), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node that can be reached, for all nodes of the links ``a``, ``b``.

    Alternating star steps: each node points its larger neighbours, then itself and its
    smaller ones, to the least of them, until nothing changes. Only minima and joins;
    no list of neighbours is ever built. Each round is checkpointed.
    """
    shared_dir(edges.sparkSession)

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
            .unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        )
        edges = small.checkpoint()
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def grouped(docs: DataFrame, shingle: int = SHINGLE, most: int = MAX_BITS) -> tuple[DataFrame, DataFrame]:
    """Each row's ``doc_id``, ``text_hash`` and ``fingerprint`` (longs); each fingerprint's ``root`` and ``component_id``."""
    shared_dir(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("text_hash"))
    marked = with_fingerprints(plain, shingle, drop=("text",)).checkpoint()
    points = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    roots = components(links(points, most))
    placed = points.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked, placed.join(named, "root").select("fingerprint", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most: int = MAX_BITS) -> DataFrame:
    """Each row's ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``.

    The component is that of its fingerprint under links of at most ``most`` differing
    bits; its id is the smallest document id in it, null if none has one. Texts without a word (null,
    empty) have fingerprint zero and are linked like any other. Rows that share an
    id are each given out. Other columns are left out.
    """
    marked, found = grouped(docs, shingle, most)
    return marked.join(found, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def representatives(docs: DataFrame, shingle: int = SHINGLE, most: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps one: that of the smallest document id.

    Of several rows of a component with that id, one of those whose text has the least hash stays. A component in which no row has an id
    keeps one row, too. An id that is the smallest of several components keeps a row in each.
    """
    marked, found = grouped(docs, shingle, most)
    stays = (
        marked.join(found, "fingerprint").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("doc_id", "root").agg(F.min("text_hash").alias("text_hash"))
    )
    own, place = (next(name for name in (f"{base}{'_' * i}" for i in range(len(docs.columns) + 1)) if name not in docs.columns) for base in ("hash", "place"))
    marks = stays.select(F.col("doc_id").alias("stays_id"), F.col("text_hash").alias("stays_hash"))
    hashed = docs.withColumn(own, F.xxhash64("text"))
    named = hashed.join(marks, (hashed["doc_id"] == marks["stays_id"]) & (hashed[own] == marks["stays_hash"]), "left_semi")
    nameless = hashed.filter("doc_id is null").join(marks.filter("stays_id is null"), F.col(own) == F.col("stays_hash"), "left_semi")
    some = F.xxhash64(*(name for name, kind in docs.dtypes if "map<" not in kind))
    first = F.row_number().over(Window.partitionBy("doc_id", own).orderBy(some))
    return named.unionByName(nameless).withColumn(place, first).filter(F.col(place) == 1).select(*docs.columns)

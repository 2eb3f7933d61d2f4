"""MinHash near-duplicates with tensored tables: keys are pairs of entries from two small collections.

Two collections of ``SIDE`` entries are made, each entry of ``DEPTH`` minhashes. Every pair of an entry of the first and one of the second is
the key of a table, so that ``SIDE`` squared tables cost ``2 * SIDE * DEPTH`` minhashes instead of ``2 * DEPTH`` for each
table. Sets of similarity s share a table with the chance (1 - (1 - s**DEPTH)**SIDE)**2: 0.99998 at 0.8, 0.00025 at 0.1.

Equal sets are one node. An entry that no other node has can be in no shared table; only what is shared goes on to the tables.
Nodes that meet in a table are brought together by their entry of the first collection, with their whole sets, and links are confirmed on
these. A group gives out links that span its components, never all pairs; one of more than ``GROUP_BYTES`` of sets is cut into
blocks, and each two blocks are compared by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palletwatch.llm.blocks import Words, mix
from palletwatch.llm.rows import with_columns
from palletwatch.llm.simhash import components
from palletwatch.session import shared_dir

SHINGLE = 2
PERCENT = 80  # of the union that the intersection must have
SIDE = 16  # entries of a collection
DEPTH = 3  # minhashes of an entry
GROUP_BYTES = 4 << 20  # of sets that are compared in one place
BROADCAST_IDS = 1 << 20  # documents up to which their ids are sent to all tasks, instead of all texts to their ids
SEED = 0x5DEECE66D


def shingle_sets(texts: Sequence[bytes | None], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles; a text of fewer words has one of all its words."""
    words = Words.of([text.lower() if text else text for text in texts])  # bytes: A-Z only
    at = words.windows(shingle)
    hashes = words.window_hashes(shingle, at)
    cuts = np.searchsorted(words.text[at], np.arange(len(texts) + 1))
    out = [np.unique(hashes[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    for size in range(1, shingle):
        short = np.flatnonzero(words.counts == size)
        for i, value in zip(short.tolist(), words.window_hashes(size, words.first[short]).tolist(), strict=True):
            out[i] = np.array([value], np.uint64)
    return out


def factors(seed: int = SEED) -> np.ndarray:
    """An odd multiplier for each minhash."""
    return mix(np.arange(1, 2 * SIDE * DEPTH + 1, dtype=np.uint64) * np.uint64(seed)) | np.uint64(1)


def entries(sets: Sequence[np.ndarray]) -> np.ndarray:
    """A row for each set that is not empty: the entries of the first collection, then those of the second."""
    sizes = np.array([len(s) for s in sets], np.int64)
    begin = np.cumsum(sizes) - sizes
    if not len(sizes):
        return np.empty((0, 2 * SIDE), np.int64)
    flat = np.concatenate(sets)
    out = np.empty((len(sizes), 2 * SIDE), np.uint64)
    for entry in range(2 * SIDE):
        value = np.full(len(sizes), entry + 1, np.uint64)
        for factor in factors()[entry * DEPTH : (entry + 1) * DEPTH]:
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(flat * factor, begin))
        out[:, entry] = value
    return out.view(np.int64)


def _digest(values: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None


def with_entries(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``node`` (a digest of the set, null if empty) and ``entries``."""

    def columns(texts):
        sets = shingle_sets(texts, shingle)
        sizes = np.array([len(s) for s in sets], np.int64)
        found = entries([s for s in sets if len(s)])
        offsets = np.concatenate([[0], np.cumsum((sizes > 0) * 2 * SIDE)])
        return [sizes, [_digest(s) for s in sets], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found.ravel()))]

    added = "n_shingles long, node binary, entries array<long>"
    return with_columns(docs.select("doc_id", "text"), added, lambda: columns, drop=("text",))


def with_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``node`` and ``set`` (its hashes, eight bytes each), a row for each row of ``docs``."""

    def columns(texts):
        sets = shingle_sets(texts, shingle)
        return [[_digest(s) for s in sets], [s.tobytes() for s in sets]]

    return with_columns(docs.select("text"), "node binary, set binary", lambda: columns, drop=("text",))


def meetings(nodes: DataFrame) -> DataFrame:
    """``place`` and ``node``: the entries of the first collection under which a node meets others in some table.

    Counts are combined before they are shuffled, and what remains is joined, so that a very frequent entry or table is
    left to the adaptive split of skewed joins.
    """

    def shared(rows: DataFrame) -> DataFrame:
        often = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        return rows.join(often.select("key"), "key")

    side = F.lit(SIDE)
    first = shared(nodes.select("node", F.explode("entries").alias("key")))
    own = nodes.select("node", F.slice("entries", 1, side).alias("a"), F.slice("entries", side + 1, side).alias("b"))
    kept = first.groupBy("node").agg(F.collect_list("key").alias("keys")).join(own, "node").select(
        "node", F.array_intersect("a", "keys").alias("a"), F.array_intersect("b", "keys").alias("b")
    )
    tables = kept.select("node", F.explode("a").alias("place"), "b").select(
        "node", "place", F.explode("b").alias("b")
    ).select("node", "place", F.xxhash64("place", "b").alias("key"))
    return shared(tables).select("place", "node").distinct()


def different(met: DataFrame) -> DataFrame:
    """``met`` without places that hold the very nodes of another one: small groups of copies meet again and again.

    Two places are taken for the same if number, least, greatest, sum and exclusive or of their nodes' hashes agree.
    """
    own, other = F.xxhash64("node"), F.xxhash64("node", F.lit(1))
    places = met.groupBy("place").agg(
        F.count("*").alias("n"), F.min(own).alias("low"), F.max(own).alias("high"), F.sum(other.cast("decimal(20,0)")).alias("sum"),
        F.bit_xor(other).alias("xor"),
    )
    first = places.groupBy("n", "low", "high", "sum", "xor").agg(F.min("place").alias("place"))
    return met.join(first.select("place"), "place")


def similar(own: np.ndarray, sizes: np.ndarray, common: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether sets of these sizes, with so many hashes in common with one of size ``own``, are linked."""
    return 100 * common >= percent * (own + sizes - common)


def spanning_links(sets: Sequence[np.ndarray], percent: int = PERCENT) -> Iterator[tuple[int, int]]:
    """Links whose components are those of all links among the sets, breadth first: what is found is not compared again."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        if similar(sizes[0], sizes[1], len(np.intersect1d(*sets, assume_unique=True)), percent):
            yield 0, 1
        return
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(codes, np.cumsum(sizes)[:-1])
    member = np.zeros(len(values), np.int64)
    left, edge, flat = np.arange(1, len(sets)), [0], None
    while len(left):
        if not edge:
            edge, left, flat = [int(left[0])], left[1:], None
            continue
        if flat is None:
            flat, begin = np.concatenate([parts[i] for i in left]), np.cumsum(sizes[left]) - sizes[left]
        centre = edge.pop()
        member[parts[centre]] = 1
        near = similar(sizes[centre], sizes[left], np.add.reduceat(member[flat], begin), percent)
        member[parts[centre]] = 0
        if near.any():
            found = left[near].tolist()
            yield from ((centre, i) for i in found)
            edge += found
            left, flat = left[~near], None


def _confirmed(percent: int):
    """Rows (place, low, high, node, set), in order of the first three, to links; a batch and the open group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, nodes, sets = None, [], []
        out: list[tuple[bytes, bytes]] = []

        def close() -> None:
            if len(sets) > 1:
                out.extend((nodes[i], nodes[j]) for i, j in spanning_links(sets, percent))

        for batch in batches:
            keys = list(zip(*(batch[name].to_pylist() for name in ("place", "low", "high")), strict=True))
            for i, key in enumerate(keys):
                if key != open_key:
                    close()
                    open_key, nodes, sets = key, [], []
                nodes.append(batch["node"][i].as_py())
                sets.append(np.frombuffer(batch["set"][i].as_buffer(), np.uint64).copy())
            yield pa.RecordBatch.from_arrays([pa.array([x[side] for x in out], pa.binary()) for side in (0, 1)], ["a", "b"])
            out = []
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[side] for x in out], pa.binary()) for side in (0, 1)], ["a", "b"])

    return run


def links(docs: DataFrame, nodes: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``a``, ``b``: links among the nodes that meet in a table, confirmed on their whole sets, that span all their components."""
    met = different(meetings(nodes).checkpoint()).checkpoint()
    needed = met.select("node").distinct().join(nodes, "node").select("least").distinct().checkpoint()
    few = F.broadcast(needed) if needed.count() <= BROADCAST_IDS else needed
    whole = (
        with_sets(docs.join(few, F.col("doc_id").eqNullSafe(F.col("least")), "left_semi"), shingle)
        .groupBy("node").agg(F.first("set").alias("set"))
    )
    large = (
        met.join(nodes.select("node", "n_shingles"), "node").groupBy("place")
        .agg(F.ceil(F.sum("n_shingles") * 8 / group_bytes).cast("int").alias("blocks")).filter("blocks > 1")
    )
    dealt = met.join(large, "place", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    both = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least(own, other).alias("low"), F.greatest(own, other).alias("high")))
    groups = dealt.select("place", "node", F.explode(both).alias("pair")).select("place", "pair.low", "pair.high", "node")
    key = ("place", "low", "high")
    filled = groups.join(whole, "node").select(*key, "node", "set").repartition(*key).sortWithinPartitions(*key)
    return filled.mapInArrow(_confirmed(percent), "a binary, b binary")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, group_bytes: int = GROUP_BYTES
) -> DataFrame:
    """Each row's ``doc_id``, ``n_shingles`` (of its set), ``component_id`` and ``kept``.

    Words are runs of anything but white space in ASCII, A-Z in lower case. Documents are linked if their sets have at least
    ``percent`` in 100 of the union in common. The component's id is the smallest document id in it. A text without a word (null,
    empty) has an empty set and is linked with nothing, so that its component is its own id. ``kept`` is true where ``doc_id`` is
    the component's; a row without an id is never kept, and a component of such rows alone has the id null. Rows that share
    an id are each given out; other columns are left out. Shingles are told apart by 64-bit hashes, sets by 128-bit
    digests. Entries and meetings are checkpointed.
    """
    shared_dir(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    marked = with_entries(docs, shingle).checkpoint()
    nodes = marked.filter("node is not null").groupBy("node").agg(
        F.first("entries").alias("entries"), F.first("n_shingles").alias("n_shingles"), F.min("doc_id").alias("least")
    ).checkpoint()
    roots = components(links(docs, nodes, shingle, percent, group_bytes)).withColumnRenamed("node", "reached")
    placed = nodes.select("node", "least").join(roots, F.col("node") == F.col("reached"), "left").select(
        "node", "least", F.coalesce("root", "node").alias("root")
    )
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    found = placed.join(named, "root").select(F.col("node").alias("own"), "component_id")
    return marked.join(found, F.col("node") == F.col("own"), "left").select(
        "doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))

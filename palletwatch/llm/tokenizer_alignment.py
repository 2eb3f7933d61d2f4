"""Alignment of two tokenizers over whole texts, by pointer jumping over their tokens.

Both tokenizers cut one sequence of bytes. Every token points to the token of the other side that overlaps
it and reaches farthest to the right; a token that ends where that one ends is its group's last. Doubling the
pointers (each to where its target points) takes every token to the last one of its group, which labels it.

A text is cut where white space begins with a space; neither tokenizer has a token across such a place. Each distinct
chunk is encoded and aligned once in a task, new ones together, and its groups and links are joined back by position. This one pass over the
texts writes each row's links to the shared folder; how often an id pair is linked is counted from there, and the counts are then looked up for each
row's links. One id's bytes end with the other's in every linked pair, so there are never more of them than ``most_pairs``, however many texts there are.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from palletwatch.llm.rows import with_columns
from palletwatch.llm.sentencepiece_ids import MARK, splits_at_marks
from palletwatch.session import fresh_dir

TABLE_ENTRIES = 300_000  # distinct chunks a task keeps; a full table is begun anew
SLICE_LINKS = 1 << 20  # links looked up at a time, or those of one row
FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
ADDED = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

#: Fixed value: how byte-level vocabularies of this kind cut texts before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A space, white space, what follows up to the next white space, and so on while that does not begin with a space.
CHUNK = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")


def byte_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level_tokens(definition: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; none for special tokens."""
    letters = byte_letters()
    whole = json.loads(definition)
    special = {token["content"] for token in whole["added_tokens"]}
    vocabulary = whole["model"]["vocab"]
    out = [b""] * (max([*vocabulary.values(), *(token["id"] for token in whole["added_tokens"])]) + 1)
    for entry, number in vocabulary.items():
        if entry not in special:
            out[number] = bytes(letters[c] for c in entry)
    return out


def in_merge_order(definition: str, tokens: Sequence[bytes]) -> bool:
    """Whether ids are in the order of the merges behind those of single bytes, so that they serve as ranks."""
    whole = json.loads(definition)
    cut, model = whole["pre_tokenizer"], whole["model"]
    plain = (
        whole["normalizer"] is None and cut == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": cut.get("trim_offsets"), "use_regex": True}
        and not any(model.get(name) for name in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    )
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    vocabulary = model["vocab"]
    return plain and sorted(tokens[:256]) == [bytes([b]) for b in range(256)] and all(
        vocabulary["".join(merge)] == 256 + i for i, merge in enumerate(merges)
    )


def piece_tokens(processor: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes of each piece; none for control and unknown pieces."""
    out = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if processor.is_byte(i):
            out.append(bytes([int(piece[3:5], 16)]))
        elif processor.is_control(i) or processor.is_unknown(i):
            out.append(b"")
        else:
            out.append(piece.replace(MARK, " ").encode())
    return out


def most_pairs(a: Sequence[bytes], b: Sequence[bytes]) -> int:
    """How many pairs of ids have bytes of which one ends with the other: no other pair can end together."""

    def ids(tokens: Sequence[bytes]) -> dict[bytes, int]:
        found: dict[bytes, int] = {}
        for token in filter(None, tokens):
            found[token] = found.get(token, 0) + 1
        return found

    in_a, in_b = ids(a), ids(b)
    shorter = sum(n * in_b.get(token[i:], 0) for token, n in in_a.items() for i in range(len(token)))
    longer = sum(n * in_a.get(token[i:], 0) for token, n in in_b.items() for i in range(1, len(token)))
    return shorter + longer


def last_tokens(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """For each token of A, then of B, the token of A that ends its group.

    The ends are places in one sequence of bytes that the tokens of both sides cover without gaps.
    """
    over_a = np.searchsorted(b_ends, a_ends)  # the token of B that holds the last byte
    over_b = np.searchsorted(a_ends, b_ends)
    pointer = np.concatenate([
        np.where(b_ends[over_a] > a_ends, len(a_ends) + over_a, np.arange(len(a_ends))), over_b,
    ]).astype(np.int64)
    while True:
        further = pointer[pointer]
        if np.array_equal(further, pointer):
            return pointer
        pointer = further



class AlignmentTable:
    """The figures, groups and linked id pairs of each distinct chunk seen."""

    def __init__(self, a_definition: str, b_model: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(a_definition)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.a_bytes, self.b_bytes = byte_level_tokens(a_definition), piece_tokens(self.b)
        self.a_length = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_length = np.array([len(t) for t in self.b_bytes], np.int64)
        self.by_chunk = splits_at_marks(b_model)
        ranks = {token: i for i, token in enumerate(self.a_bytes) if token}
        self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if in_merge_order(a_definition, self.a_bytes) else None
        self.marked = [f"{i}{mark}" for i in range(max(len(self.a_bytes), len(self.b_bytes))) for mark in (",", "|", ";", "")]
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.whole = np.empty(0, bool)  # whether both sides give the chunk's bytes
        self.counts = np.empty((0, 3), np.int64)  # tokens of A and of B, groups
        self.groups: list[str] = []
        self.pairs = np.empty(0, np.int64)  # links, as A id times the pieces of B plus B id
        self.ends = np.zeros(1, np.int64)

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        return CHUNK.findall(" " + text) if self.by_chunk else [" " + text]

    def _alone(self, chunk: str) -> tuple[list[int], list[int]]:
        """Both sides of one chunk; nothing if either does not give its bytes."""
        a = self.a.encode(chunk, add_special_tokens=False).ids
        # the library gives nothing for an empty text, but the marker at the end of a longer one
        b = [self.b.piece_to_id(MARK)] if chunk == " " and self.by_chunk else self.b.encode(chunk[1:])
        data = chunk.encode()
        same = b"".join([self.a_bytes[t] for t in a]) == data == b"".join([self.b_bytes[t] for t in b])
        return (a, b) if same else ([], [])

    def _together(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Both sides of chunks that may stand in one text, and how many ids each has; None if a side does not give the bytes."""
        text = "".join(chunks)
        a = np.array(self.ranks.encode_ordinary(text), np.int64)
        each = self.b.encode([chunk[1:] for chunk in chunks], out_type=int, num_threads=1)
        n_b = np.fromiter(map(len, each), np.int64, len(chunks))
        b = np.fromiter(chain.from_iterable(each), np.int64, int(n_b.sum()))
        data = text.encode()
        if not b"".join(map(self.a_bytes.__getitem__, a.tolist())) == data == b"".join(map(self.b_bytes.__getitem__, b.tolist())):
            return None
        size = np.add.reduceat(self.b_length[b], np.cumsum(n_b) - n_b)  # of each chunk, whose bytes are B's
        return a, np.diff(np.searchsorted(np.cumsum(self.a_length[a]), np.cumsum(size)) + 1, prepend=0), b, n_b

    def add(self, chunks: Sequence[str]) -> None:
        """Encodes and aligns the chunks that are new, each once."""
        new = list({chunk: None for chunk in chunks if chunk not in self.place})
        if not new:
            return
        # one that ends with white space, or holds B's own marker, may not stand before others
        plain = [chunk for chunk in new if not chunk[-1].isspace() and MARK not in chunk] if self.by_chunk and self.ranks else []
        found = self._together(plain) if plain else None
        if found is None:
            plain, found = [], (np.empty(0, np.int64),) * 4
        done = set(plain)
        others = [chunk for chunk in new if chunk not in done]
        apart = [self._alone(chunk) for chunk in others]
        new = plain + others
        sides = []
        for side in (0, 1):
            n = np.concatenate([found[2 * side + 1], np.fromiter((len(x[side]) for x in apart), np.int64, len(apart))])
            ids = np.concatenate([found[2 * side], np.fromiter((t for x in apart for t in x[side]), np.int64)])
            sides.append((ids, n))
        self._align(new, *sides[0], *sides[1])

    def _align(self, new: list[str], a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> None:
        last = last_tokens(np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b]))
        of_a, of_b = last[: len(a)], last[len(a) :]
        ends_group = np.flatnonzero(of_a == np.arange(len(a)))  # the last token of A in each group
        b_to = np.searchsorted(of_b, ends_group, side="right")
        n_groups = np.diff(np.searchsorted(ends_group, np.concatenate([[0], np.cumsum(n_a)])))
        # ids in order of their groups, those of A first, each with the mark behind it: , | ; or none at the end of a chunk
        after_a, after_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        after_a[ends_group], after_b[b_to - 1] = 1, 2
        after_b[(np.cumsum(n_b) - 1)[n_b > 0]] = 3
        order = np.argsort(np.concatenate([2 * of_a, 2 * of_b + 1]), kind="stable")
        parts = list(map(self.marked.__getitem__, np.concatenate([4 * a + after_a, 4 * b + after_b])[order].tolist()))
        stop = np.cumsum(n_a + n_b)
        self.groups += ["".join(parts[lo:hi]) for lo, hi in zip((stop - n_a - n_b).tolist(), stop.tolist(), strict=True)]
        self.pairs = np.concatenate([self.pairs, a[ends_group] * len(self.b_bytes) + b[b_to - 1]])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(n_groups)])
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.whole = np.concatenate([self.whole, n_a > 0])
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, n_groups], 1)])

    def found(self, texts: Sequence[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """The table's places of each text's chunks, and whether both sides give the text's bytes."""
        cut = [self.cut(text) for text in texts]
        self.add([chunk for chunks in cut for chunk in chunks])
        places = [np.fromiter(map(self.place.__getitem__, chunks), np.int64, len(chunks)) for chunks in cut]
        return places, np.array([bool(len(p)) and bool(self.whole[p].all()) for p in places], bool)

    def links(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The linked id pairs of the chunks at these places, one after the other, and how many each has."""
        sizes = self.ends[places + 1] - self.ends[places]
        at = np.repeat(self.ends[places] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return self.pairs[at], sizes


def encoded(docs: DataFrame, a_definition: str, b_model: bytes, links: str, drop: Sequence[str] = ()) -> DataFrame:
    """``docs`` with the tokens of each side, the groups, their digest, and a column ``links`` of linked id pairs. No shuffle."""
    most = TABLE_ENTRIES

    def work():
        table = AlignmentTable(a_definition, b_model)

        def columns(texts):
            if len(table.place) > most:
                table.clear()
            places, whole = table.found([(t or b"").decode() for t in texts])
            used = [p if good else p[:0] for p, good in zip(places, whole, strict=True)]
            digests = [
                hashlib.sha256(";".join([table.groups[i] for i in p.tolist()]).encode()).hexdigest() if len(p) else "" for p in used
            ]
            flat, stop = np.concatenate([np.empty(0, np.int64), *used]), np.cumsum([0, *map(len, used)])
            sums = np.cumsum(np.pad(table.counts[flat], ((1, 0), (0, 0))), axis=0)
            pairs, sizes = table.links(flat)
            offsets = np.concatenate([[0], np.cumsum(sizes)])[stop].astype(np.int32)
            return [*np.diff(sums[stop], axis=0).T, digests, pa.ListArray.from_arrays(pa.array(offsets), pa.array(pairs))]

        return columns

    return with_columns(docs, f"n_a long, n_b long, n_groups long, groups_sha256 string, `{links}` array<long>", work, drop=drop)


def link_counts(found: DataFrame, links: str, pieces_of_b: int) -> DataFrame:
    """``a``, ``b`` and ``count``: the id pairs in a column of ``encoded``, and how often each is there."""
    a, b = F.floor(F.col("pair") / pieces_of_b), F.col("pair") % pieces_of_b
    return found.select(F.explode(links).alias("pair")).groupBy("pair").count().select(a.alias("a"), b.alias("b"), "count")


def aligned(docs: DataFrame, a_path: str, b_path: str, drop: Sequence[str] = ()) -> DataFrame:
    """``docs`` with the columns of ``ADDED``: tokens of each side, groups, links, and the digest of the groups.

    A (byte-level, a definition file of ``tokenizers``) encodes a space and the text, B (a ``sentencepiece`` model that adds that
    space itself) the text, both without special tokens. Groups are cut at the places where tokens of both end; a link is a pair of tokens
    that end there. ``count_sum`` adds up, over the links, how often their id pair is linked in all of ``docs``;
    ``n_best`` counts links whose pair is the most frequent of its B id. Null and empty texts, and those whose bytes either
    side does not give back, have zeros and an empty digest, and no part in the counts. Rows that repeat count
    each; columns of ``docs`` with the added names give way. The texts are read and written links counted while the DataFrame is built;
    the folder stays, since the result reads from it. No shuffle but that of the counts, of which at most ``most_pairs`` rows
    reach the driver and go on to all tasks.
    """
    with open(a_path, encoding="utf-8") as file:
        a_definition = file.read()
    with open(b_path, "rb") as file:
        b_model = file.read()
    spark = docs.sparkSession
    added = T.StructType.fromDDL(ADDED)
    docs = docs.drop(*added.names)
    links = next(name for name in (f"links{'_' * i}" for i in range(len(docs.columns) + 1)) if name not in map(str.lower, docs.columns))
    found = encoded(docs, a_definition, b_model, links, drop)
    folder = fresh_dir(spark, "alignment")
    found.write.parquet(folder)
    found = spark.read.schema(found.schema).parquet(folder)
    pieces_of_b = sentencepiece.SentencePieceProcessor(model_proto=b_model).get_piece_size()
    counted = link_counts(found, links, pieces_of_b).toArrow()
    pairs, counts = counted["a"].to_numpy() * pieces_of_b + counted["b"].to_numpy(), counted["count"].to_numpy()
    order = np.argsort(pairs)
    pairs, counts = pairs[order], counts[order]
    highest = np.zeros(pieces_of_b, np.int64)
    np.maximum.at(highest, pairs % pieces_of_b, counts)
    best = counts == highest[pairs % pieces_of_b]
    stay = [name for name in docs.columns if name not in drop]
    names, most = [*stay, *added.names], SLICE_LINKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, flat = batch[links].offsets.to_numpy(), batch[links].values.to_numpy()
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, side="right")) - 1)
                rows, at = batch.slice(lo, hi - lo), np.searchsorted(pairs, flat[ends[lo] : ends[hi]])
                stop = ends[lo : hi + 1] - ends[lo]
                sums = [np.diff(np.concatenate([[0], np.cumsum(worth[at], dtype=np.int64)])[stop]) for worth in (best, counts)]
                made = {"n_links": np.diff(stop).astype(np.int64), "n_best": sums[0], "count_sum": sums[1]}
                yield pa.RecordBatch.from_arrays([pa.array(made[name]) if name in made else rows[name] for name in names], names)
                lo = hi

    return found.mapInArrow(run, T.StructType([*(found.schema[name] for name in stay), *added]))

"""SentencePiece ids by a table of distinct chunks.

In a model whose pieces hold the whitespace marker at their start only, no piece
crosses from one marked word into the next, so a text is segmented word by word.
Documents are read in slices of bounded size. A slice becomes the places of its words in a table of its
own distinct marked words (the markers and the characters up to the next one), and sends these words to
buckets by hash. A bucket sees all slices and segments each of its distinct words once; ids go back to the
slices, which join them to their texts by position. A very frequent word so reaches its bucket once per slice.
Texts themselves are not shuffled; the slices' shuffle files serve both ends.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from sentencepiece import sentencepiece_model_pb2

from palletwatch.llm.blocks import pieces
from palletwatch.llm.rows import with_columns

MARK = "▁"
SLICE_BYTES = 8 << 20  # of texts that share a table of distinct words
BUCKET_BYTES = 32 << 20  # of texts, for each bucket of words

APART = b"\xff"  # between words in UTF-8, where this byte never occurs


def splits_at_marks(model: bytes) -> bool:
    """Whether texts may be cut before each run of markers without changing any id."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    rules = proto.normalizer_spec
    plain = (
        not rules.precompiled_charsmap and rules.add_dummy_prefix and rules.escape_whitespaces
        and not rules.remove_extra_whitespaces and not proto.trainer_spec.treat_whitespace_as_suffix
    )
    return plain and not any(MARK in piece.piece.lstrip(MARK) for piece in proto.pieces)


def chunks(text: str) -> list[str]:
    """The marked words of a text, each without its first marker; the others as spaces."""
    words = text.replace(MARK, " ").split(" ") if text else []
    if "" not in words:
        return words
    found, ahead = [], 0
    for word in words:
        if word:
            found.append(" " * ahead + word)
            ahead = 0
        else:
            ahead += 1
    if ahead:  # markers at the end, with no word behind them
        found.append(" " * (ahead - 1))
    return found


def dealt(texts: Sequence[bytes | None], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, bytes]]]:
    """How many words each text has, the number of each word in order of first occurrence, the bucket of each number, and the words of each bucket."""
    number: dict[str, int] = {}
    found = [[number.setdefault(word, len(number)) for word in chunks((text or b"").decode())] for text in texts]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter((n for one in found for n in one), np.int64, counts.sum())
    words = [word.encode() for word in number]
    bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
    order = np.argsort(bucket, kind="stable")
    used, begin = np.unique(bucket[order], return_index=True)
    parts = np.split(order, begin)[1:]  # the first is empty
    return counts, flat, bucket, [(b, APART.join([words[i] for i in part.tolist()])) for b, part in zip(used.tolist(), parts, strict=True)]


def segmented(processor: sentencepiece.SentencePieceProcessor, words: list[str]) -> list[list[int]]:
    """Ids of marked words."""
    ids = processor.encode(words, out_type=int, num_threads=1)
    for i, word in enumerate(words):
        if not word:  # a marker by itself
            ids[i] = [processor.piece_to_id(MARK)]
    return ids


def joined(
    processor: sentencepiece.SentencePieceProcessor,
    counts: np.ndarray,
    flat: np.ndarray,
    bucket: np.ndarray,
    lengths: np.ndarray,
    ids: np.ndarray,
) -> tuple[pa.ListArray, list[bytes]]:
    """Ids and decoded text of each text: what ``dealt`` gave for them, and the ids of the words of all buckets one after the other."""
    ends = np.cumsum(lengths).tolist()
    plain = ids.tolist()
    words = processor.decode([plain[end - n : end] for end, n in zip(ends, lengths.tolist(), strict=True)], num_threads=1)
    place = np.empty(len(bucket), np.int64)
    place[np.argsort(bucket, kind="stable")] = np.arange(len(bucket))
    places = place[flat]
    begin, sizes = (np.cumsum(lengths) - lengths)[places], lengths[places]
    total = np.concatenate([[0], np.cumsum(sizes)])
    whole = ids[np.repeat(begin - total[:-1], sizes) + np.arange(total[-1])]
    stop = np.concatenate([[0], np.cumsum(counts)])
    spaced = pa.array([word.encode() + b" " for word in words], pa.large_binary())
    at = np.concatenate([[0], np.cumsum(pc.binary_length(spaced).to_numpy()[places])])[stop].tolist()
    buffer = memoryview(spaced.take(pa.array(places)).buffers()[2] or b"")
    texts = [bytes(buffer[lo : hi - 1]) if hi > lo else b"" for lo, hi in zip(at[:-1], at[1:], strict=True)]
    return pa.ListArray.from_arrays(pa.array(total[stop], pa.int32()), pa.array(whole, pa.int32())), texts


def _pack(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2**32 as compressed byte planes: the high bytes of small numbers cost nothing."""
    return zstandard.ZstdCompressor(level=3).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[list[pa.RecordBatch], list[bytes | None]]]:
    """Consecutive rows with about ``SLICE_BYTES`` of text, one row at least, and their texts."""
    rows, texts, size = [], [], 0
    for batch in batches:
        for lo, hi, more in pieces(batch[text], SLICE_BYTES // 4):
            n = sum(len(t) for t in more if t)
            if rows and size + n > SLICE_BYTES:
                yield rows, texts
                rows, texts, size = [], [], 0
            rows.append(batch.slice(lo, hi - lo))
            texts += more
            size += n
    if rows:
        yield rows, texts


def _digest(texts: Sequence[bytes | None]) -> str:
    state = xxhash.xxh3_64()
    for text in texts:
        state.update(f"{-1 if text is None else len(text)} ".encode() + (text or b""))
    return state.hexdigest()


def _whole_texts(docs: DataFrame, model: bytes, text: str, drop: Sequence[str]) -> DataFrame:
    def work():
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)

        def columns(texts):
            ids = processor.encode([(t or b"").decode() for t in texts], out_type=int, num_threads=1)
            return ids, [processor.decode(one) for one in ids]

        return columns

    return with_columns(docs, "ids array<int>, decoded string", work, text, drop)


def encode(docs: DataFrame, model_path: str, text: str = "text", drop: Sequence[str] = ()) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``decoded`` (what the ids decode to), without the columns in ``drop``.

    The model is read where the job is started and sent along; it is under a few
    MB. Ids are those of the library for the whole text, without begin or end ids.
    A null or empty text has no ids and decodes to an empty one. Rows that repeat are rows each, an empty table gives an empty one, and
    columns of ``docs`` called ``ids`` or ``decoded`` give way. The bytes of the texts are counted while the DataFrame is
    built. A model whose pieces cross markers, or that rewrites texts, is applied to whole texts instead.

    A part of ``docs`` that is computed again, after an executor was lost, must give the same rows in the same order, as
    tables read from files do; write or checkpoint others first. A slice is named by a hash of its texts, so that rows that
    came in another order end the job with an error, never with wrong ids.
    """
    with open(model_path, "rb") as file:
        model = file.read()
    if not splits_at_marks(model):
        return _whole_texts(docs, model, text, drop)
    docs = docs.drop("ids", "decoded")
    stay = [name for name in docs.columns if name not in drop]
    taken = {name.lower() for name in docs.columns}
    names = ("slice", "at", "places", "buckets", "words")
    slice_id, at, places, bucket_of, words = (next(n for i in range(len(taken) + 1) if (n := name + "_" * i) not in taken) for name in names)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET_BYTES))

    kept = [docs.schema[name] for name in stay]
    own = T.StructType.fromDDL(f"{slice_id} string, {at} int")
    table = T.StructType.fromDDL(f"{places} binary, {bucket_of} binary, {words} array<struct<bucket:long,words:binary>>")
    cut = T.StructType([*kept, *own, *table])  # the table of a slice is in its first row
    kinds = [to_arrow_type(field.dataType) for field in [*own, *table]]

    def cut_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        compress = zstandard.ZstdCompressor(level=3).compress
        for rows, texts in _slices(batches, text):
            counts, flat, bucket, sent = dealt(texts, buckets)
            name = f"{part}-{number}-{_digest(texts)}"
            sent = [{"bucket": b, "words": compress(some)} for b, some in sent]
            first = [[_pack(np.concatenate([counts, flat]))], [_pack(bucket)], [sent]]
            start = 0
            for batch in rows:
                made = [[name] * len(batch), range(start, start + len(batch)), *([*one, *[None] * (len(batch) - len(one))] for one in first)]
                added = [pa.array(column, kind) for column, kind in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch[column] for column in stay), *added], cut.names)
                start += len(batch)
                first = [[]] * 3
            number += 1
        pa.default_memory_pool().release_unused()

    def send(table: pa.Table) -> pa.Table:
        [sent] = pc.drop_null(table[words]).to_pylist()
        made = {name: pa.array([one[name] for one in sent], kind) for name, kind in (("bucket", pa.int64()), ("words", pa.binary()))}
        return pa.table({"slice": pa.array([table[slice_id][0].as_py()] * len(sent), pa.string()), **made})

    def segment(table: pa.Table) -> pa.Table:
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        unpack = zstandard.ZstdDecompressor().decompress
        number: dict[bytes, int] = {}
        asked = [
            np.array([number.setdefault(word, len(number)) for word in unpack(some).split(APART)], np.int64)
            for some in table["words"].to_pylist()
        ]
        ids = segmented(processor, [word.decode() for word in number])
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        begin, flat = np.cumsum(lengths) - lengths, np.fromiter((i for one in ids for i in one), np.int64)
        answers = []
        for of in asked:
            n = lengths[of]
            answers.append((_pack(n), _pack(flat[np.repeat(begin[of] - (np.cumsum(n) - n), n) + np.arange(n.sum())])))
        made = [pa.array(column, pa.binary()) for column in zip(*answers, strict=True)]
        return pa.table([table["slice"], table["bucket"], *made], ["slice", "bucket", "lengths", "ids"])

    def join_back(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.take(pc.sort_indices(left[at]))
        answers = sorted(right.to_pylist(), key=lambda row: row["bucket"])
        lengths, ids = (np.concatenate([np.empty(0, np.int64), *(_unpack(row[name]) for row in answers)]) for name in ("lengths", "ids"))
        bucket = _unpack(left[bucket_of][0].as_py()) if len(left) else []
        if not len(left) or len(lengths) != len(bucket):
            raise RuntimeError("documents came in another order when they were computed again: write or checkpoint them first")
        counts, flat = np.split(_unpack(left[places][0].as_py()), [len(left)])
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        coded, texts = joined(processor, counts, flat, bucket, lengths, ids)
        return pa.table([*(left[name] for name in stay), coded, pa.array(texts, pa.binary()).cast(pa.string())], [*stay, "ids", "decoded"])

    slices = docs.mapInArrow(cut_slices, cut)
    sent = slices.groupBy(slice_id).applyInArrow(send, "slice string, bucket long, words binary")
    answers = sent.groupBy("bucket").applyInArrow(segment, "slice string, bucket long, lengths binary, ids binary")
    result = T.StructType([*kept, *T.StructType.fromDDL("ids array<int>, decoded string")])
    return slices.groupBy(slice_id).cogroup(answers.groupBy("slice")).applyInArrow(join_back, result)

"""Quality rules: counts with fixed limits, and divergence from what a language looks like.

Each document gives two histograms: its characters by class, and its words by a list of common words of
several languages, the last bin being all other words. A document whose Jensen-Shannon
distance to the reference of its language is too large is not kept; one too short for a
distance to say anything is not judged by it. References are fixed histograms, so that a verdict depends on the document alone:
neither copies, nor junk sources, nor the size of the table move it, and no document is shuffled.

A language tag counts up to its first - or _, in lower case. A text without a tag is compared with every reference, and the nearest
counts. One in a language without a reference is compared so by its characters; its words are not judged, since the list has none of that language.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palletwatch.llm.blocks import Words, classes, covered
from palletwatch.llm.quality_references import REFERENCES
from palletwatch.llm.rows import with_columns

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30  # percent of words
JUDGED_CHARS = 400  # characters a document must have for their distance to count
MAX_CHAR_DISTANCE = 0.31
# Limits of the word distance from so many words on: the fewer words, the further their shares are from any reference.
WORD_LIMITS = ((200, 0.25), (100, 0.30), (50, 0.36), (20, 0.40))

# Character classes: ASCII small and capital letters, digits, white space,
# marks of a sentence, other ASCII, all beyond ASCII.
SENTENCE = ".,;:!?'\"()-"
CLASSES = 7
SYMBOLS = "#*$%&|<>"

# Common words of at most eight bytes, by language.
COMMON = {
    "en": "the of and to in a is that for it on with as was be by are or an from at this not have".split(),
    "fr": "le la les un une de du des et en à dans par pour que qui est il elle au sur ne pas avec".split(),
    "de": "der die das den dem des ein eine und in zu von mit auf für ist im nicht sich als auch es".split(),
    "es": "el la los las un una de del y en a que por para con no se su es al lo como más".split(),
}
WORDS = tuple(dict.fromkeys(word for words in COMMON.values() for word in words))

_CLASS = np.full(256, 5, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, *range(9, 14)]] = 3
_CLASS[[ord(c) for c in SENTENCE]] = 4
_CLASS[192:], _CLASS[128:192] = 6, CLASSES  # a character's first byte counts, the others go to a bin of their own
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _codes(words: Sequence[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(word, "little") for word in words], np.uint64)


_ORDER = np.argsort(_codes([w.encode() for w in WORDS]))
_SORTED = _codes([w.encode() for w in WORDS])[_ORDER]


def _common_words(words: Words) -> np.ndarray:
    """The place in WORDS of each word, lower-cased in ASCII; the last bin for others. Words of up to eight bytes are compared as numbers."""
    data = words.buffer.lower() + bytes(8)
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    length = words.ends - words.starts
    mask = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
    code = eight[words.starts] & mask[np.minimum(length, 8)]
    place = np.minimum(np.searchsorted(_SORTED, code), len(WORDS) - 1)
    return np.where((_SORTED[place] == code) & (length <= 8), _ORDER[place], len(WORDS))


def measured(texts: Sequence[bytes | None]) -> list:
    """The counts and histograms of each text, as ``FIELDS`` lists them."""
    words = Words.of(texts)
    n = len(texts)
    raw = np.frombuffer(b"".join([t for t in texts if t]), np.uint8)
    text = np.repeat(np.arange(n), [len(t or b"") for t in texts])
    kinds = np.bincount(text * (CLASSES + 1) + _CLASS[raw], minlength=n * (CLASSES + 1)).reshape(n, -1)[:, :CLASSES]
    common = np.bincount(
        words.text * (len(WORDS) + 1) + _common_words(words) if words.buffer else np.empty(0, np.int64),
        minlength=n * (len(WORDS) + 1),
    ).reshape(n, -1)
    lines = [[line for line in (t or b"").split(b"\n") if line.strip()] for t in texts]
    at = words.windows(WINDOW)
    key = classes(words, WINDOW, at) * n + words.text[at]
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    again = covered(len(words.starts), at[times[inverse] > 1], WINDOW) if len(at) else np.zeros(len(words.starts), bool)

    def arrays(counts: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(
            pa.array(np.arange(n + 1) * counts.shape[1], pa.int32()), pa.array(counts.ravel().astype(np.int32))
        )

    return [
        words.counts, kinds.sum(1) - kinds[:, 3], np.bincount(text[_SYMBOL[raw]], minlength=n),
        [len(found) - len(set(found)) for found in lines], np.bincount(words.text[again], minlength=n),
        arrays(kinds), arrays(common),
    ]


FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "char_counts array<int>, word_counts array<int>"
)


def distance(counts: Column, total: Column, shares: Column) -> Column:
    """The Jensen-Shannon distance of counts of that total to a reference's shares, 0 to 1: the root of the divergence in bits."""

    def toward(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))

    parts = F.zip_with(counts, shares, lambda n, q: toward(n / total, q) + toward(q, n / total))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v) / 2, F.lit(0.0)))


def judged(
    docs: DataFrame, references: Mapping[str, tuple[Sequence[int], Sequence[int]]] = REFERENCES,
    word_limits: Sequence[tuple[int, float]] = WORD_LIMITS,
) -> DataFrame:
    """``docs`` without its text, with the counts, ``base_failed``, the two distances and ``kept``.

    Words are runs of anything but white space in ASCII. ``n_repeat_words`` are the words in 8-word windows found twice
    or more in the text. ``base_failed``: fewer than 20 words, or over 30 in 100 repeated. A null text has no words
    and fails. ``references`` has fixed counts by language (lower case, no region), of characters and of words;
    ``word_limits`` has numbers of words and the largest word distance from there on. Distances are null where they are not
    judged. Columns of ``docs`` with the added names give way; an empty table gives an empty one. Rows that repeat are judged
    alike, each for itself. One pass, no shuffle.
    """
    counted = with_columns(docs, FIELDS, lambda: measured, drop=("text",)).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    )
    chars, words = F.col("word_chars") + F.col("char_counts")[3], F.col("n_words")
    tag = F.lower(F.regexp_extract(F.trim(F.coalesce(F.col("lang").cast("string"), F.lit(""))), "^[^-_]*", 0))

    def nearest(column: str, total: Column, which: int, unknown: Column) -> Column:
        """The distance to the tag's reference, else the least of all where ``unknown`` holds."""
        far = {
            lang: distance(F.col(column), total, F.lit([n / sum(counts[which]) for n in counts[which]]))
            for lang, counts in references.items()
        }
        least = F.least(*far.values()) if len(far) > 1 else next(iter(far.values()), F.lit(None).cast("double"))
        return reduce(lambda rest, one: F.when(tag == one[0], one[1]).otherwise(rest), far.items(), F.when(unknown, least))

    # a column each, so that nothing is worked out twice
    found = counted.withColumn("char_distance", F.when(chars >= JUDGED_CHARS, nearest("char_counts", chars, 0, F.lit(True))))
    found = found.withColumn("word_distance", F.when(words >= min(word_limits)[0], nearest("word_counts", words, 1, tag == "")))
    limit = reduce(lambda rest, one: F.when(words >= one[0], F.lit(one[1])).otherwise(rest), sorted(word_limits), F.lit(1.0))
    strange = (F.coalesce("char_distance", F.lit(0.0)) > MAX_CHAR_DISTANCE) | (
        F.coalesce("word_distance", F.lit(0.0)) > limit
    )
    return found.withColumn("kept", ~F.col("base_failed") & ~strange).drop("char_counts", "word_counts")

"""Toxicity scores from character n-gram vectors averaged into a linear softmax.

Every character n-gram of a lower-cased word, word ends included, has a vector, found by hashing into
a fixed number of rows. A text is the mean of its n-grams' vectors, and a linear
softmax over that mean gives the class. Vectors and softmax are trained together, in
numpy, on a bounded sample of labelled texts. A misspelt word that was never seen shares
most n-grams with its right form.

Since the classifier is linear in the mean, a trained model is one number per row,
the difference of its two class scores; scoring adds these up over all n-grams of a text.

How much a mean says depends on how many n-grams it is over: a few words are no strong evidence, and in a long text a few telling
words hardly move it. A curve is therefore fitted over the margin, the number of n-grams and what single words add, from texts of the training
rows that the vectors were not trained on (in turn, a part of them is left out).
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palletwatch.llm.blocks import mix
from palletwatch.llm.rows import with_columns

SIZES = (3, 4, 5, 6)  # characters of an n-gram
ROWS = 1 << 18
DIM = 8
SAMPLE = 2000  # labelled texts of class 1 that training uses at most
CLEAN = 6000  # and of class 0
EPOCHS = 8
MIN_TEXTS = 5  # training texts a row must occur in to have a vector
BATCH = 64
RATE = 0.05
GAIN = 200.0  # the mean is multiplied by this, since few of a text's n-grams tell
DECAY = 1e-3
PADDING = 300  # n-grams without a vector that every mean also counts, so that a few words are no strong evidence
THRESHOLD = 0.3
PARTS = 3  # of the training texts, each left out once for the curve
FEW = 20  # texts of either class that a curve needs at least
TELLING = 3  # words of a text that add most
SLICE_CHARS = 1 << 19

_LETTER = np.ones(128, bool)
_LETTER[[i for i in range(128) if not chr(i).isalnum()]] = False


def _letters(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of the lower-cased texts, which of them are inside a word, and where each text begins."""
    data = np.frombuffer((" " + "  ".join(t.lower() for t in texts) + " " * max(SIZES)).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = (data >= 128) | _LETTER[np.minimum(data, 127)]
    return data, inside, np.concatenate([[0], np.cumsum([len(t.lower()) + 2 for t in texts])]).astype(np.int64)


def ngrams(texts: Sequence[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Row numbers and validity of the n-gram at each character, for each size; where each text begins.

    Anything in ASCII that is no letter or digit parts words and stands for a word's
    end; an n-gram may begin or end with one, but have none inside.
    """
    data, inside, begin = _letters(texts)
    codes = np.where(inside, data, np.uint32(32)).astype(np.uint64)
    n = int(begin[-1])
    out, factor = [], 1
    hashes = np.zeros(n, np.uint64)
    whole = np.ones(n, bool)  # no end of a word inside
    for size in range(1, max(SIZES) + 1):
        if size > 2:
            whole = whole & inside[size - 2 : size - 2 + n]
        hashes = hashes + codes[size - 1 : size - 1 + n] * np.uint64(factor)
        factor = factor * 0x100000001B3 % (1 << 64)
        if size in SIZES:
            out.append(((mix(hashes + np.uint64(size)) % np.uint64(ROWS)).astype(np.int32), whole))
    return out, begin


@dataclass
class Curve:
    """A logistic regression over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the constant first

    @classmethod
    def fit(cls, features: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> Curve:
        mean, scale = features.mean(0), features.std(0) + 1e-9
        x = np.column_stack([np.ones(len(features)), (features - mean) / scale])
        weights, less = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
        less[0, 0] = 0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + less + 1e-9 * np.eye(len(weights)), x.T @ (p - labels) + less @ weights)
            weights = weights - step
            if np.abs(step).max() < 1e-8:
                break
        return cls(mean, scale, weights)

    def margin(self, features: np.ndarray) -> np.ndarray:
        return self.weights[0] + (features - self.mean) / self.scale @ self.weights[1:]


@dataclass
class Model:
    """What a row adds to the class difference, the difference without any, and the curve over both, if there is one."""

    rows: np.ndarray
    bias: float
    curve: Curve | None = None

    def features(self, texts: Sequence[str]) -> np.ndarray:
        """For each text the margin of its mean, the number of n-grams and their product, the sum over its root, and what single words add."""
        out, at = np.empty((len(texts), 6)), 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE_CHARS):
                size += len(texts[end])
                end += 1
            grams, begin = ngrams(texts[at:end])
            sums = np.zeros(begin[-1])
            counts = np.zeros(begin[-1], np.int8)
            for rows, valid in grams:
                sums += np.where(valid, self.rows[rows], np.float32(0))
                counts += valid
            total = np.add.reduceat(sums, begin[:-1])
            count = np.add.reduceat(counts, begin[:-1], dtype=np.int64) + PADDING
            number, added, most = self._words(texts[at:end], sums, counts)
            length = np.log(count)
            out[at:end] = np.stack([
                total / count, length, total / count * length, total / np.sqrt(count), added / np.sqrt(number + 10), most,
            ], 1)
            at = end
        return out

    @staticmethod
    def _words(texts: Sequence[str], sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words with n-grams in each text, what those that add something add, and what the ``TELLING`` words add."""
        _, inside, begin = _letters(texts)
        starts = np.diff(inside.astype(np.int8), prepend=0) == 1
        word = np.cumsum(starts)[1 : len(sums) + 1]  # an n-gram may begin at the end of the word before
        worth, has = np.bincount(word, sums), np.bincount(word, counts) > 0
        first = np.append(np.flatnonzero(starts), len(inside))[: len(worth) - 1]
        text = np.concatenate([[0], np.searchsorted(begin, first, side="right") - 1])[: len(worth)]
        worth, text = worth[has], text[has]
        number = np.bincount(text, minlength=len(texts))
        added = np.bincount(text, np.maximum(worth, 0), len(texts))
        order = np.lexsort((-worth, text))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(number) - number, number)
        telling = order[rank < TELLING]
        return number, added, np.bincount(text[telling], worth[telling], len(texts))

    def score(self, texts: Sequence[bytes | None]) -> np.ndarray:
        """The probability of class 1 for each text; without an n-gram it is the same for all."""
        if not len(texts):
            return np.empty(0)
        features = self.features([(t or b"").decode() for t in texts])
        margin = self.curve.margin(features) if self.curve else features[:, 0]
        return 1 / (1 + np.exp(-np.clip(margin + self.bias, -60, 60)))


def _counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a text's n-grams, each once, and how often they occur."""
    grams, _ = ngrams([text])
    rows, counts = np.unique(np.concatenate([rows[valid] for rows, valid in grams]), return_counts=True)
    return rows.astype(np.int32), counts.astype(np.int32)


@dataclass
class Counts:
    """The n-grams of texts, one text after the other: rows and how often they occur; where each text begins; all its n-grams."""

    rows: np.ndarray
    counts: np.ndarray
    begin: np.ndarray
    total: np.ndarray

    @classmethod
    def of(cls, texts: Sequence[str]) -> Counts:
        """Rows that fewer than ``MIN_TEXTS`` texts have are left out, but count in ``total``.

        Every text is counted twice, first for the sizes, so that the driver holds no more than what stays, in two arrays that
        it can give back. Numbers are as narrow as the largest allows.
        """
        total, most, often = np.zeros(len(texts), np.int64), 0, np.zeros(ROWS, np.int64)
        for i, text in enumerate(texts):
            rows, counts = _counted(text)
            often[rows] += 1
            total[i] = counts.sum(dtype=np.int64)
            most = max(most, int(counts.max(initial=0)))
        kept = often >= MIN_TEXTS
        size = int(often[kept].sum())
        out = cls(np.empty(size, np.int32), np.empty(size, np.min_scalar_type(most)), np.zeros(len(texts) + 1, np.int64), total)
        for i, text in enumerate(texts):
            rows, counts = _counted(text)
            stay = kept[rows]
            span = slice(out.begin[i], out.begin[i] + np.count_nonzero(stay))
            out.rows[span], out.counts[span] = rows[stay], counts[stay]
            out.begin[i + 1] = span.stop
        return out


def train(texts: Sequence[str], labels: Sequence[int], seed: int = 7) -> Model:
    """Vectors and softmax by stochastic gradients (Adagrad) over shuffled batches; no curve."""
    return _train(Counts.of(texts), np.arange(len(texts)), np.asarray(labels, np.int64), seed)


def _train(grams: Counts, chosen: np.ndarray, labels: np.ndarray, seed: int) -> Model:
    """A model of the chosen texts, whose labels these are.

    With two classes the gradients need only one number per n-gram of a text: a vector's is the sum, over the texts that have
    it, of weight times error, along the difference of the softmax' columns, and that of the softmax is the same sum over the vectors.
    """
    share = np.bincount(labels, minlength=2) / max(len(labels), 1)
    if not len(labels) or not share.all():  # nothing to tell apart
        return Model(np.zeros(ROWS, np.float32), 0.0 if not len(labels) else 4.0 * (1 if share[1] else -1))
    often = np.zeros(ROWS, np.int64)
    for i in chosen:
        often[grams.rows[grams.begin[i] : grams.begin[i + 1]]] += 1
    often = often >= MIN_TEXTS
    rng = np.random.default_rng(seed)
    vectors = np.zeros((DIM, ROWS), np.float32)
    vectors[:, often] = rng.uniform(-1 / DIM, 1 / DIM, (int(often.sum()), DIM)).astype(np.float32).T * 0.1
    softmax = np.stack([-np.ones(DIM), np.ones(DIM)], 1).astype(np.float32) * rng.uniform(0.5, 1.0, (DIM, 1)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    square_v, square_s, square_b = np.full(ROWS, 1e-4, np.float32), np.full_like(softmax, 1e-4), np.full_like(bias, 1e-4)
    sides = np.array([-1, 1], np.float32)  # of the two classes' errors
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for batch in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // BATCH)):
            spans = [slice(grams.begin[i], grams.begin[i + 1]) for i in chosen[batch]]
            sizes = [span.stop - span.start for span in spans]
            rows = np.concatenate([grams.rows[span] for span in spans])
            weights = np.concatenate([grams.counts[span] for span in spans]).astype(np.float32)
            weights *= np.repeat((GAIN / (grams.total[chosen[batch]] + PADDING)).astype(np.float32), sizes)
            text = np.repeat(np.arange(len(batch)), sizes)
            apart = softmax[:, 1] - softmax[:, 0]
            margin = np.bincount(text, weights * (apart @ vectors).take(rows), len(batch)) + (bias[1] - bias[0])
            error = ((1 / (1 + np.exp(-np.clip(margin, -60, 60))) - labels[batch]) / len(batch)).astype(np.float32)
            touched = np.zeros(ROWS, bool)
            touched[rows] = True
            used = np.flatnonzero(touched & often)
            pull = np.bincount(rows, weights * np.repeat(error, sizes), ROWS)[used].astype(np.float32)
            own = vectors.take(used, 1)
            grad_s, grad_b = np.outer(own @ pull, sides), error.sum() * sides
            grad_v = np.outer(apart, pull)
            grad_v += DECAY * own
            square_v[used] += np.einsum("ij,ij->j", grad_v, grad_v) / DIM
            grad_v *= rate / np.sqrt(square_v[used])
            vectors[:, used] = own - grad_v
            square_s += grad_s**2
            softmax -= rate * grad_s / np.sqrt(square_s)
            square_b += grad_b**2
            bias -= rate * grad_b / np.sqrt(square_b)
    return Model((softmax[:, 1] - softmax[:, 0]) @ vectors * GAIN, float(bias[1] - bias[0]))


def train_with_curve(texts: Sequence[str], labels: Sequence[int], seed: int = 7) -> Model:
    """A model of all texts, and a curve from models that had not seen the texts it is fitted on.

    Equal texts are left out together. Fewer than ``FEW`` texts of a class give no curve.
    """
    grams, y = Counts.of(texts), np.asarray(labels, np.int64)
    model = _train(grams, np.arange(len(y)), y, seed)
    part = np.array([zlib.crc32(text.encode("utf-8", "surrogatepass")) % PARTS for text in texts], np.int64)
    if min(np.bincount(y, minlength=2)) < FEW:
        return model
    features = np.empty((len(texts), 6))
    for k in range(PARTS):
        rest, left = np.flatnonzero(part != k), np.flatnonzero(part == k)
        if len(left):
            features[left] = _train(grams, rest, y[rest], seed).features([texts[i] for i in left])
    return Model(model.rows, 0.0, Curve.fit(features, y))


def fitted(docs: DataFrame, known: DataFrame, sample: int = SAMPLE, clean: int = CLEAN) -> Model:
    """A model from ``known`` (``doc_id``, ``label`` 0 or 1), whose texts are looked up in ``docs``.

    At most ``sample`` labelled ids of class 1 and ``clean`` of class 0 are used, those least by the hash of their
    id; only their texts reach the driver, where vectors and curve are trained. The bias is then moved by as much as the odds of the classes among
    all labelled ids differ from those in the sample. An id with both labels counts as class 1, other labels are passed over.
    """
    known = known.filter("label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    place = F.xxhash64("doc_id")
    chosen = known.filter("label = 1").orderBy(place).limit(sample).unionByName(known.filter("label = 0").orderBy(place).limit(clean))
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    rows = sorted(((r["doc_id"], r["text"] or "", r["label"]) for r in found.collect()))
    model = train_with_curve([text for _, text, _ in rows], [label for _, _, label in rows])
    used = sum(label for _, _, label in rows)
    ones, zeros = known.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    if 0 < used < len(rows):
        model.bias += float(np.log(ones / zeros * (len(rows) - used) / used))
    return model


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD, drop: Sequence[str] = ()) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if the score reaches the threshold).

    A null or empty text has no n-grams and gets the model's score for none. Columns of ``docs`` with these names
    give way. No shuffle.
    """

    def work():
        def columns(texts):
            score = model.score(texts)
            return score, (score >= threshold).astype(np.int32)

        return columns

    return with_columns(docs, "score double, predicted int", work, drop=drop)

"""Toxicity by class-conditional Kneser-Ney models.

Two byte-level models of words, one of toxic and one of ordinary text, give a text's two log-likelihoods from each word's
bytes and up to six bytes before them. Both discount their own counts and back off to one shared interpolated
Kneser-Ney model of both classes, so that an expression that is rare in either weighs little; a backoff that both share cancels in
the difference, so only ratios are kept. As most words of a toxic text are ordinary ones, the toxic text's model
takes each word from the toxic counts with the small probability ``MIX``, else from the ordinary ones. The score is a logistic function of
the difference of the two log-likelihoods, normalised by length, fitted on documents that the counts have not seen.

Contexts end at a word's start. Letting them reach into the word before, and class-conditional counts of word pairs, were tried and
found fewer toxic documents (README).

The counts come from a bounded sample of labelled documents (``max_toxic`` and
``max_ordinary`` rows, least hash first), of which every byte sequence is kept: the sample bounds the broadcast model. Scoring
covers every text whole, and needs no shuffle.

Defined results: null and empty texts score as a text of no words (the fitted prior);
several labels of one document count as toxic if one of them is; without labels of
both classes every score is 0. Rows that repeat an id are scored each; a null id is kept and teaches nothing; ties of the
sample's hash are broken by the id. Empty tables give no rows. Other columns are not read. A text is scored in one piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelstack.llm.shared import cut
from reelstack.llm.tokens import LOWER, per_row, slices, words

ORDER = 7
DISCOUNT = 0.75
#: Pseudo-count with which a class backs off to the counts of both classes together.
STRENGTH = 10.0
#: Share of a toxic text's words that are drawn from the toxic model; the others are ordinary.
MIX = 0.005
MAX_TOXIC = 4000
MAX_ORDINARY = 8000
THRESHOLD = 0.7
#: Texts are scored in passes of this size: a word's likelihood is worked out once a pass.
SCORE_BYTES = 1 << 21
_END = np.uint64(0x20)
_LOW = np.uint64((1 << 56) - 1)


def word_events(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, gram) of each byte of the words and of their ends: the byte, A-Z lower-cased, with the six before it, zeros before the word."""
    size = end - start + 1
    word = np.repeat(np.arange(len(start)), size)
    first = np.cumsum(size) - size
    pos = np.arange(len(word)) - np.repeat(first, size)
    at = np.minimum(np.repeat(start, size) + pos, max(len(buf) - 1, 0))
    byte = np.where(pos == np.repeat(size - 1, size), _END, LOWER[buf[at]].astype(np.uint64))
    gram = byte.copy()
    for k in range(1, ORDER):
        shifted = np.zeros(len(byte), np.uint64)
        shifted[k:] = byte[:-k]
        gram |= np.where(pos >= k, shifted, np.uint64(0)) << np.uint64(8 * k)
    return word, gram


def _distinct(w) -> tuple[np.ndarray, np.ndarray]:
    """One index of each distinct word, and each word's place among them."""
    _, index, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    return index, inverse


@dataclass
class KneserNeyPair:
    """Log-likelihood ratios: of seen grams, and of any other byte after a seen context."""

    grams: np.ndarray
    gram_ratio: np.ndarray
    contexts: np.ndarray
    context_ratio: np.ndarray
    weights: np.ndarray

    @staticmethod
    def fit(grams: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, discount: float = DISCOUNT, strength: float = STRENGTH) -> KneserNeyPair:
        """From counts of sorted distinct grams in either class."""
        toxic, ordinary = toxic.astype(float), ordinary.astype(float)
        contexts, inverse = np.unique(grams >> np.uint64(8), return_inverse=True)

        def smoothed(count: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            total = np.bincount(inverse, count, len(contexts)) + strength
            backoff = (strength + discount * np.bincount(inverse, count > 0, len(contexts))) / total
            return np.maximum(count - discount, 0) / total[inverse] + backoff[inverse] * shared, np.log(backoff)

        pooled, _ = smoothed(toxic + ordinary, _shared(grams, discount))
        (p_toxic, rest_toxic), (p_ordinary, rest_ordinary) = smoothed(toxic, pooled), smoothed(ordinary, pooled)
        return KneserNeyPair(grams, np.log(p_toxic / p_ordinary), contexts, rest_toxic - rest_ordinary, np.zeros(3))

    def ratios(self, gram: np.ndarray) -> np.ndarray:
        out = np.zeros(len(gram))
        if not len(self.grams):
            return out
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        seen = self.grams[at] == gram
        out[seen] = self.gram_ratio[at[seen]]
        context = gram[~seen] >> np.uint64(8)
        at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        out[~seen] = np.where(self.contexts[at] == context, self.context_ratio[at], 0.0)
        return out

    def evidence(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihood difference, words) of each text."""
        w = words(LOWER[buf], off)
        if not len(w.hash):
            return np.zeros(len(off) - 1), w.count
        index, inverse = _distinct(w)
        word, gram = word_events(buf, w.start[index], w.end[index])
        ratio = np.bincount(word, self.ratios(gram), len(index))
        each = np.log1p(MIX * np.expm1(np.minimum(ratio, 30.0)))
        return per_row(each[inverse], w.first), w.count

    def score(self, difference: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_features(difference, n) @ self.weights, -30, 30)))


def _shared(grams: np.ndarray, discount: float) -> np.ndarray:
    """Interpolated Kneser-Ney probability of each gram's last byte after the context that is one byte shorter, from distinct continuations."""
    levels = [grams]
    for order in range(ORDER - 1, 0, -1):
        levels.append(np.unique(levels[-1] & np.uint64((1 << 8 * order) - 1)))
    prob = np.full(1, 1 / 257.0)
    lower = np.zeros(1, np.uint64)
    for order in range(1, ORDER):
        upper, here = levels[ORDER - 1 - order], levels[ORDER - order]
        mask = np.uint64((1 << 8 * order) - 1)
        count = np.bincount(np.searchsorted(here, upper & mask), minlength=len(here)).astype(float)
        context, inverse = np.unique(here >> np.uint64(8), return_inverse=True)
        total = np.bincount(inverse, count)
        kinds = np.bincount(inverse)
        below = prob[np.searchsorted(lower, here & np.uint64((1 << 8 * (order - 1)) - 1))] if order > 1 else prob[0]
        prob = np.maximum(count - discount, 0) / total[inverse] + discount * kinds[inverse] / total[inverse] * below
        lower = here
    return prob[np.searchsorted(lower, grams & np.uint64((1 << 8 * (ORDER - 1)) - 1))]


def _features(difference: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per-word difference, the same weighed by the square root of the length, and 1."""
    mean = difference / np.maximum(n, 1)
    return np.stack([mean, mean * np.sqrt(n), np.ones(len(n))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Ridge-regularised logistic regression by Newton's method."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z, b = x / scale, np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + ridge * b
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(b)), gradient)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b / scale


def learnable(labels: DataFrame, docs: DataFrame, id_col: str, label_col: str, keep) -> DataFrame:
    """(id, label): labelled ids of ``docs`` for which ``keep`` holds; the greatest label if there are several."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("id").isNotNull() & keep(F.col("id")))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    return known.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi")


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    keep=lambda i: F.lit(True),
    max_toxic: int = MAX_TOXIC,
    max_ordinary: int = MAX_ORDINARY,
) -> KneserNeyPair:
    """Fit the pair of models and the score's logistic function."""
    known = cut(learnable(labels, docs, id_col, label_col, keep))
    sizes = {r["label"]: r["n"] for r in known.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    drawn = [known.where(cond).orderBy(F.xxhash64("id"), "id").limit(most) for cond, most in (("label > 0", max_toxic), ("label <= 0", max_ordinary))]
    # a quarter of the sample is for the logistic function only
    sample = drawn[0].union(drawn[1]).select("id", (F.col("label") > 0).cast("int").alias("label"), (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(4)) == 0).alias("tune"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id")
    # one text of each id, so that rows that repeat an id cannot exceed the bounds
    texts = cut(rows.groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"), F.max("tune").alias("tune")).select("text", "label", "tune"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy()
            for at, n, buf, off in slices(batch.column(0), SCORE_BYTES):
                w = words(LOWER[buf], off)
                if not len(w.hash):
                    continue
                index, inverse = _distinct(w)
                toxic = label[at : at + n][w.row] > 0
                each = [np.bincount(inverse, t, len(index)) for t in (toxic, ~toxic)]
                word, gram = word_events(buf, w.start[index], w.end[index])
                kinds, place = np.unique(gram, return_inverse=True)
                counts = [np.bincount(place, c[word], len(kinds)).astype(np.int64) for c in each]
                yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), *map(pa.array, counts)], names=["gram", "toxic", "ordinary"])

    grams = texts.where("not tune").mapInArrow(count, "gram long, toxic long, ordinary long")
    grams = grams.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    table = grams.toArrow()
    gram = table.column("gram").to_numpy().view(np.uint64)
    by = np.argsort(gram)
    if not sizes.get(0) or not sizes.get(1) or not len(gram):
        return KneserNeyPair(*(np.zeros(0, t) for t in (np.uint64, float, np.uint64, float)), np.array([0.0, 0.0, -30.0]))
    model = KneserNeyPair.fit(gram[by], table.column("toxic").to_numpy()[by], table.column("ordinary").to_numpy()[by])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, buf, off in slices(batch.column(0), SCORE_BYTES):
                d, size = model.evidence(buf, off)
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(size, pa.int64()), batch.column(1).slice(at, n)], names=["d", "n", "label"])

    tune = texts.where("tune").mapInArrow(weigh, "d double, n long, label int").toArrow()
    d, n, y = (tune.column(k).to_numpy() for k in ("d", "n", "label"))
    # the sample's classes count as often as they occur among the labelled documents
    share = [sizes[k] / max(1, (y == k).sum()) for k in (0, 1)]
    model.weights = _logistic(_features(d, n), y.astype(float), np.where(y > 0, share[1], share[0]) * len(y) / (sizes[0] + sizes[1]))
    return model


def toxicity(docs: DataFrame, model: KneserNeyPair, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``difference`` (per word, toxic minus ordinary), ``score`` and ``predicted``."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, buf, off in slices(batch.column(1), SCORE_BYTES):
                d, size = shared.value.evidence(buf, off)
                s = shared.value.score(d, size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.array(size, pa.int64()), pa.array(d / np.maximum(size, 1)), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                    names=["id", "n_words", "difference", "score", "predicted"],
                )

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, n_words long, difference double, score double, predicted int").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: KneserNeyPair, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, unchanged, that score below the threshold; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(*shared.value.evidence(buf, off)) for _, _, buf, off in slices(batch.column(text_col), SCORE_BYTES)]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) < threshold))

    return docs.mapInArrow(run, docs.schema)

"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Features are n-grams of one to three characters (code points; A-Z lower-cased, white space as one blank), inside
words and over their edges, hashed into ``buckets``. Document frequencies are counted over all
learnable documents. The weights are learned by follow-the-regularised-leader
(FTRL-proximal, McMahan et al. 2013) with elastic-net penalties from a bounded
sample of labelled documents: ``max_per_lang`` of each language in expectation, ``max_docs`` in all; the probabilities are then
calibrated by one temperature on a part of the sample kept back.

The model is ``buckets`` times the number of languages; the sample reaches the driver as sparse rows. Every text is scored whole
in the tasks that read it, without a shuffle.

Defined results: null texts, empty ones and such without a letter are ``und`` with score 1;
documents with a null language teach nothing; without any labelled document every
language is ``und`` with score 0. Of languages of equal probability the first by name is given. Rows that repeat an id are
judged each, a null id is kept and teaches where ``keep`` holds for it. Empty tables give no rows; other columns are not read. A long text is
counted in one piece, in memory of some 60 times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelstack.llm.shared import cut
from reelstack.llm.tokens import PASS_BYTES, mix64, slices

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
MAX_PER_LANG = 600
MAX_DOCS = 20_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
UNKNOWN = "und"
_BLANK = 32
_ASCII_LETTER = np.zeros(128, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def characters(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, row) of the texts of a slice."""
    try:
        text = buf.tobytes().decode("utf-8")
    except UnicodeDecodeError:
        # broken bytes become replacement characters, text by text: how many a text has is known only then
        each = [buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:], strict=True)]
        points = np.frombuffer("".join(each).encode("utf-32-le"), np.uint32)
        return points, np.repeat(np.arange(len(each)), [len(t) for t in each])
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    # a character begins at each byte that continues none
    starts = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    return points, np.repeat(np.arange(len(off) - 1), np.diff(starts[off]))


@dataclass
class Grams:
    """Counts of the distinct buckets of each text, by row and bucket; ``first`` has each row's first entry (n + 1 values)."""

    bucket: np.ndarray
    count: np.ndarray
    row: np.ndarray
    first: np.ndarray


def grams(points: np.ndarray, row: np.ndarray, n: int, buckets: int = BUCKETS) -> Grams:
    """Counts of hashed character n-grams of ``n`` texts."""
    text = points.astype(np.uint64)
    capital = (points >= 65) & (points <= 90)
    text[capital] += np.uint64(32)
    text[(points >= 9) & (points <= 13)] = _BLANK
    cells, gram = [], text.copy()
    for k in range(max(ORDERS)):
        if k:
            gram = gram[:-1] * np.uint64(1 << 21) + text[k:]
        if k + 1 in ORDERS and len(gram):
            inside = row[: len(gram)] == row[k:] if k else np.ones(len(gram), bool)
            bucket = (mix64(gram[inside] + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)
            cells.append(row[: len(gram)][inside] * buckets + bucket)
    count = np.bincount(np.concatenate(cells), minlength=n * buckets) if cells else np.zeros(n * buckets, np.int64)
    at = np.flatnonzero(count)
    rows = at // buckets
    return Grams(at % buckets, count[at], rows, np.searchsorted(rows, np.arange(n + 1)))


def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices whose count matrix stays small: at most 32 texts."""
    for at, n, buf, off in slices(column, PASS_BYTES):
        for lo in range(0, n, 32):
            hi = min(n, lo + 32)
            yield at + lo, hi - lo, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]


def has_letter(points: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    known = np.zeros(n, bool)
    plain = points < 128
    known[row[plain][_ASCII_LETTER[points[plain]]]] = True
    open_rows = ~known[row] & ~plain
    for i in np.unique(row[open_rows]):
        known[i] = any(chr(c).isalpha() for c in np.unique(points[open_rows & (row == i)]))
    return known


def weighed(g: Grams, idf: np.ndarray) -> np.ndarray:
    """TF-IDF values of the entries, with damped term frequencies, each text's of unit length."""
    x = np.log1p(g.count.astype(np.float64)) * idf[g.bucket]
    norm = np.sqrt(np.bincount(g.row, x * x, len(g.first) - 1))
    return (x / np.maximum(norm[g.row], 1e-9)).astype(np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, buckets: int, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """Weights (buckets, classes) after passes of one sparse example (buckets, values) at a time, per-coordinate rates and elastic-net shrinkage."""
    z = np.zeros((buckets, classes), np.float32)
    n = np.zeros_like(z)
    order = np.random.default_rng(11)

    def weights(at) -> np.ndarray:
        small = np.abs(z[at]) <= l1
        return np.where(small, 0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            used, v = rows[i]
            w = weights(used)
            p = softmax(v @ w)
            p[y[i]] -= 1
            g = v[:, None] * p
            sigma = (np.sqrt(n[used] + g * g) - np.sqrt(n[used])) / alpha
            z[used] += g - sigma * w
            n[used] += g * g
    return weights(slice(None)).astype(np.float32)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, -1 for none; probability) of each text."""
        n = len(off) - 1
        best, score = np.full(n, -1), np.ones(n)
        if not self.languages:
            return best, np.zeros(n)
        points, row = characters(buf, off)
        known = has_letter(points, row, n)
        if known.any():
            g = grams(points, row, n, len(self.idf))
            x = weighed(g, self.idf)
            z = np.stack([x[a:b] @ self.weights[g.bucket[a:b]] for a, b in zip(g.first[:-1], g.first[1:], strict=True)])
            p = softmax(z / self.temperature)
            best[known] = p.argmax(axis=1)[known]
            score[known] = p.max(axis=1)[known]
        return best, score


def train(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    keep=lambda i: F.lit(True),
    max_per_lang: int = MAX_PER_LANG,
    max_docs: int = MAX_DOCS,
    buckets: int = BUCKETS,
) -> LanguageModel:
    """Fit on the documents with a language for which ``keep`` holds."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.where(keep(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    size = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not size:
        return LanguageModel([], np.zeros(buckets, np.float32), np.zeros((buckets, 0), np.float32), 1.0)
    languages = sorted(size)

    def document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(buckets, np.int64), 0
        for batch in batches:
            for _, rows, buf, off in pieces(batch.column(0)):
                total += np.bincount(grams(*characters(buf, off), rows, buckets).bucket, minlength=buckets)
                n += rows
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, held)), pa.array(np.append(n, total[held]))], names=["bucket", "n"])

    found = known.select("text").mapInArrow(document_frequency, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(buckets + 1)
    n[found.column("bucket").to_numpy() + 1] = found.column("n").to_numpy()
    idf = np.log((n[0] + 1) / (n[1:] + 1)) + 1

    each = min(max_per_lang, max(2, max_docs // len(languages)))
    share = F.create_map(*[F.lit(v) for l in languages for v in (l, min(1.0, each / size[l]))])
    part = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) / float(1 << 20)
    sample = cut(known.where(part < share[F.col("lang")]).orderBy(F.xxhash64("id", F.lit(3)), "id").limit(each * len(languages)))
    place = {l: i for i, l in enumerate(languages)}

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows, buf, off in pieces(batch.column(0)):
                g = grams(*characters(buf, off), rows, buckets)
                x = weighed(g, idf)
                cuts = list(zip(g.first[:-1], g.first[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g.bucket[a:b].astype(np.int32).tobytes() for a, b in cuts], pa.binary()), pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()), batch.column(1).slice(at, rows)],
                    names=["bucket", "x", "lang"],
                )

    rows = sample.select("text", "lang").mapInArrow(sparse, "bucket binary, x binary, lang string").toArrow().to_pylist()
    x = [(np.frombuffer(r["bucket"], np.int32), np.frombuffer(r["x"], np.float32)) for r in rows]
    y = np.array([place[r["lang"]] for r in rows], int)
    tune = np.arange(len(y)) % 5 == 4
    w = ftrl([v for v, t in zip(x, tune, strict=True) if not t], y[~tune], len(languages), buckets)
    z = np.array([v @ w[at] for (at, v), t in zip(x, tune, strict=True) if t])
    grid = np.geomspace(0.02, 5, 80)
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(z)), y[tune]], 1e-12)).mean() for t in grid] if tune.any() else [0.0] * 80
    return LanguageModel(languages, idf.astype(np.float32), w, float(grid[int(np.argmin(loss))]) if tune.any() else 1.0)


def detect_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``lang_pred`` and ``score``, the calibrated probability."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*shared.value.languages, UNKNOWN])
        for batch in batches:
            for at, rows, buf, off in pieces(batch.column(1)):
                best, score = shared.value.predict(buf, off)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), names.take(pa.array(best % len(names))), pa.array(score.astype(float))], names=["id", "lang_pred", "score"])

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)

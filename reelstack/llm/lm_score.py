"""Language-model scores by a log-bilinear model trained with noise-contrastive estimation.

Every token belongs to one of ``vocab`` frequent words, to the end of the text, or to one of ``rare`` classes of
other words (by their last bytes); these sizes and the vectors' ``dim`` are parameters (``Shape``). The log-bilinear model predicts the class from the two tokens before: the context vector
is the sum of two position-dependent word vectors, and the score of a class is its product with the
class's own vector plus a bias. Given a rare class, a word has its smoothed share of
the class's tokens, so the model is a normalised distribution over all words with one unseen word a class.

* Word counts cover all training documents: distinct words are pre-aggregated per task and summed by a shuffle.
* Training is numpy SGD on the noise-contrastive objective: a warm start on a bounded sample (``warm_docs``), then one pass
  of all training documents in blocks of some ``BLOCK_TOKENS`` tokens (``MOST_BLOCKS`` at most), dealt by a hash of id and text and ordered by it, so that the
  result does not hang on how files are split. The blocks' parameters (a table of fixed size) are averaged by a
  grouped aggregation, weighted by tokens.
* Scoring normalises by batched matrix products over the distinct contexts a task meets. The counts of the ``head`` most frequent
  words (16 bytes each) are broadcast; those of all others are counted per text and joined by word. How many are broadcast changes
  no result.

Defined results: a null text is an empty one, whose only token is its end; rows that repeat an id are
scored each, a null id is kept (and learned from where ``keep`` holds); without training documents the counts are 0 and all tokens
unknown; an empty table gives no rows. Words of equal counts enter the vocabulary by their hash. Other columns are not read. A text is
worked on in one piece, in memory of some 60 times its bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelstack.llm.shared import cut
from reelstack.llm.tokens import LOWER, mix64, slices, words

HEAD = 1 << 18
WARM_DOCS = 1500
NOISE = 64
#: Weight of all noise samples against one data token.
NOISE_RATIO = 10.0
BATCH = 8192
SMOOTH = 0.1
PASS = 1 << 21
#: Tokens of a training block, of which each yields a table of parameters.
BLOCK_TOKENS = 1 << 21
#: Training blocks at most: beyond, a block has more tokens (read as a stream), not the corpus more tables of parameters.
MOST_BLOCKS = 4096
END_HASH = np.uint64(0x656E64)


@dataclass(frozen=True)
class Shape:
    """Sizes of the model: words of their own, classes of other words, and the vectors. A task keeps a normaliser (4 bytes) for each pair of classes."""

    vocab: int = 1024
    rare: int = 256
    dim: int = 24

    @property
    def end(self) -> int:
        return self.vocab + self.rare

    @property
    def begin(self) -> int:
        return self.end + 1

    @property
    def classes(self) -> int:
        return self.end + 1


def rare_class(buf: np.ndarray, start: np.ndarray, end: np.ndarray, classes: int) -> np.ndarray:
    """Class of a word outside the vocabulary: a hash of its last three bytes."""
    key = np.zeros(len(start), np.uint64)
    for k in range(1, 4):
        at = end - k
        key = key * np.uint64(257) + np.where(at >= start, buf[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (mix64(key) % np.uint64(classes)).astype(np.int64)


def _find(listed: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place in a sorted array, or -1."""
    if not len(listed):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(listed, h), len(listed) - 1)
    return np.where(listed[at] == h, at, -1)


@dataclass
class Tokens:
    """Tokens of a slice, ends included: class, word hash, count of head words (-1 outside the head), and row bounds."""

    kind: np.ndarray
    hash: np.ndarray
    count: np.ndarray
    row: np.ndarray
    c1: np.ndarray
    c2: np.ndarray


@dataclass
class Lexicon:
    """Counts that every task needs: the head's words, the vocabulary's, and the classes' totals."""

    head: np.ndarray
    head_count: np.ndarray
    vocab: np.ndarray
    end_count: int
    total: int
    distinct: int
    class_tokens: np.ndarray
    class_words: np.ndarray
    shape: Shape
    vocab_count: np.ndarray

    def tokens(self, buf: np.ndarray, off: np.ndarray) -> Tokens:
        low = LOWER[buf]
        w = words(low, off)
        _, index, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        h = w.hash[index]
        place = _find(self.head, h)
        count = np.where(place >= 0, self.head_count[place], -1) if len(self.head) else np.full(len(h), -1)
        kind = _find(self.vocab, h)
        kind = np.where(kind >= 0, kind, self.shape.vocab + rare_class(low, w.start[index], w.end[index], self.shape.rare))
        n = len(off) - 1
        ends = w.first[1:] + np.arange(n)  # each row's end follows its words
        size = len(w.hash) + n
        is_end = np.zeros(size, bool)
        is_end[ends] = True
        put = lambda values, last: _spread(values, last, is_end)
        row = np.repeat(np.arange(n), w.count + 1)
        k = put(kind[inverse], self.shape.end)
        begin = np.zeros(size, bool)
        begin[w.first[:-1] + np.arange(n)] = True
        c1 = np.full(size, self.shape.begin)
        c1[1:] = np.where(begin[1:], self.shape.begin, k[:-1])
        c2 = np.full(size, self.shape.begin)
        c2[1:] = np.where(begin[1:], self.shape.begin, c1[:-1])
        return Tokens(k, put(w.hash, END_HASH), put(count[inverse], self.end_count), row, c1, c2)


def _spread(values: np.ndarray, last, is_end: np.ndarray) -> np.ndarray:
    out = np.full(len(is_end), last, values.dtype)
    out[~is_end] = values
    return out


@dataclass
class LogBilinear:
    """Position-dependent context vectors (two tables), class vectors and biases."""

    near: np.ndarray
    far: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    shape: Shape
    norm: np.ndarray | None = field(default=None, repr=False)

    @staticmethod
    def start(noise: np.ndarray, shape: Shape) -> LogBilinear:
        rng = np.random.default_rng(17)
        draw = lambda n: rng.normal(0, 0.1, (n, shape.dim)).astype(np.float32)
        return LogBilinear(draw(shape.classes + 1), draw(shape.classes + 1), draw(shape.classes), np.log(noise).astype(np.float32), shape)

    def train(self, t: Tokens, noise: np.ndarray, state: list[np.ndarray], rng: np.random.Generator, rate: float) -> None:
        """One pass over tokens by minibatches; noise samples are shared within a minibatch."""
        cumulative = np.cumsum(noise)
        log_noise = np.log(NOISE_RATIO * noise)
        for lo in range(0, len(t.kind), BATCH):
            w, a, b = t.kind[lo : lo + BATCH], t.c1[lo : lo + BATCH], t.c2[lo : lo + BATCH]
            m = np.minimum(np.searchsorted(cumulative, rng.random(NOISE) * cumulative[-1]), self.shape.classes - 1)
            q = self.near[a] + self.far[b]
            own = 1 - _sigmoid(np.einsum("ij,ij->i", q, self.out[w]) + self.bias[w] - log_noise[w])
            others = _sigmoid(q @ self.out[m].T + self.bias[m] - log_noise[m]) * (NOISE_RATIO / NOISE)
            dq = own[:, None] * self.out[w] - others @ self.out[m]
            for table, at, grad, s in ((self.near, a, dq, state[0]), (self.far, b, dq, state[1])):
                _step(table, at, grad, s, rate)
            pushed = np.concatenate([own[:, None] * q, -(others.T @ q)])
            both = np.concatenate([w, m])
            _step(self.out, both, pushed, state[2], rate)
            _step(self.bias[:, None], both, np.concatenate([own, -others.sum(axis=0)])[:, None], state[3], rate)

    def log10(self, t: Tokens) -> np.ndarray:
        """Normalised log10 probability of each token's class; normalisers are kept per context."""
        side = self.shape.classes + 1
        if self.norm is None:
            self.norm = np.full(side * side, np.nan, np.float32)
        key = t.c1 * side + t.c2
        todo = np.unique(key[np.isnan(self.norm[key])])
        for lo in range(0, len(todo), 2048):
            k = todo[lo : lo + 2048]
            z = (self.near[k // side] + self.far[k % side]) @ self.out.T + self.bias
            top = z.max(axis=1)
            self.norm[k] = top + np.log(np.exp(z - top[:, None]).sum(axis=1))
        out = np.empty(len(key))
        for lo in range(0, len(key), 1 << 16):
            s = slice(lo, lo + (1 << 16))
            q = self.near[t.c1[s]] + self.far[t.c2[s]]
            out[s] = np.einsum("ij,ij->i", q, self.out[t.kind[s]]) + self.bias[t.kind[s]] - self.norm[key[s]]
        return out / np.log(10)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return (1 / (1 + np.exp(-np.clip(x, -30, 30)))).astype(np.float32)


def _step(table: np.ndarray, at: np.ndarray, grad: np.ndarray, state: np.ndarray, rate: float) -> None:
    """Adagrad on the rows of ``table``, gradients of equal rows being averaged over the square root of their number."""
    n = len(table)
    times = np.bincount(at, minlength=n)
    total = np.stack([np.bincount(at, grad[:, j], minlength=n) for j in range(grad.shape[1])], axis=1)
    total /= np.sqrt(np.maximum(times, 1))[:, None]
    state += total * total
    table += (rate * total / np.sqrt(state + 1e-8)).astype(np.float32)


def _fresh_state(shape: Shape) -> list[np.ndarray]:
    return [np.full(size, 1e-2) for size in ((shape.classes + 1, shape.dim), (shape.classes + 1, shape.dim), (shape.classes, shape.dim), (shape.classes, 1))]


def word_counts(texts: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """(word, class, n) of the tokens of a table (text), ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows, buf, off in slices(batch.column(0), PASS):
                low = LOWER[buf]
                w = words(low, off)
                h, index, n = np.unique(w.hash, return_index=True, return_counts=True)
                kind = rare_class(low, w.start[index], w.end[index], shape.rare)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(h, END_HASH).view(np.int64)), pa.array(np.append(kind, -1).astype(np.int32)), pa.array(np.append(n, rows))], names=["word", "class", "n"]
                )

    return texts.mapInArrow(run, "word long, class int, n long").groupBy("word").agg(F.first("class").alias("class"), F.sum("n").alias("n"))


def lexicon(counts: DataFrame, head: int = HEAD, shape: Shape = Shape()) -> Lexicon:
    """What tasks need of the counts: at most ``head`` rows, the vocabulary, and sums by class.

    The head is all words from a count on that at most ``head`` words reach, read off a histogram of
    counts in steps of a twentieth: no sort, and no task that gathers candidates of all others.
    """
    step = F.floor(F.log("n") / math.log(1.05)).cast("int").alias("step")
    steps = sorted(((r["step"], r["words"]) for r in counts.groupBy(step).agg(F.count("*").alias("words")).collect()), reverse=True)
    least, held = None, 0
    for at, size in steps:
        held += size
        if held > head:
            break
        least = at
    top = counts.where((step >= least if least is not None else F.lit(False)) & (F.col("class") >= 0)).select("word", "n").toArrow()
    word, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    frequent = counts.where("class >= 0").orderBy(F.desc("n"), "word").limit(shape.vocab).toArrow()
    vocab, own = frequent.column("word").to_numpy().view(np.uint64), frequent.column("n").to_numpy()
    by_class = counts.where("class >= 0").groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    ends = counts.where("class < 0").agg(F.sum("n").alias("n")).first()["n"] or 0
    tokens, distinct = np.zeros(shape.rare, np.int64), np.zeros(shape.rare, np.int64)
    for r in by_class:
        tokens[r["class"]], distinct[r["class"]] = r["n"], r["v"]
    total, all_words = int(tokens.sum() + ends), int(distinct.sum() + (ends > 0))
    # words of the vocabulary are classes of their own
    kinds = frequent.column("class").to_numpy()
    np.subtract.at(tokens, kinds, own)
    np.subtract.at(distinct, kinds, 1)
    place = np.argsort(vocab)
    # tasks know the vocabulary's counts, however small the head is
    word, first = np.unique(np.concatenate([word, vocab]), return_index=True)
    n = np.concatenate([n, own])[first]
    return Lexicon(word, n, vocab[place], int(ends), total, all_words, tokens, distinct, shape, own[place])


def _noise(lex: Lexicon) -> np.ndarray:
    """Class frequencies, smoothed: the noise distribution."""
    count = np.zeros(lex.shape.classes)
    count[: len(lex.vocab)] = lex.vocab_count
    count[lex.shape.vocab : lex.shape.end] = lex.class_tokens
    count[lex.shape.end] = lex.end_count
    count += 0.5
    return count / count.sum()



def train(texts: DataFrame, sample: DataFrame, lex: Lexicon, warm_epochs: int = 4, block_tokens: int = BLOCK_TOKENS, most_blocks: int = MOST_BLOCKS) -> LogBilinear:
    """Fit on all ``texts`` (id, text): one pass in blocks, averaged, from a start on the bounded ``sample``.

    Blocks have about ``block_tokens`` tokens while ``most_blocks`` suffice for that, and grow with the texts beyond.
    """
    shape, noise = lex.shape, _noise(lex)
    model, state, rng = LogBilinear.start(noise, shape), _fresh_state(shape), np.random.default_rng(23)
    column = sample.toArrow().column("text")
    for epoch in range(warm_epochs):
        for _, _, buf, off in slices(column, PASS):
            model.train(lex.tokens(buf, off), noise, state, rng, 0.1)
    shared = texts.sparkSession.sparkContext.broadcast((lex, model, noise, state))
    width = shape.dim + 1
    sizes = [shape.classes + 1, shape.classes + 1, shape.classes]
    blocks = min(lex.total // block_tokens + 1, most_blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, start, noise, at = shared.value
        pad = np.zeros((shape.classes + 1, 1), np.float32)
        block, own, n = None, None, 0

        def fitted() -> pa.RecordBatch:
            table = np.concatenate([np.hstack([own.near, pad]), np.hstack([own.far, pad]), np.hstack([own.out, own.bias[:, None]])])
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(table))), pa.array(np.full(len(table), n)), *[pa.array(table[:, j].astype(float)) for j in range(width)]], names=["r", "n", *[f"v{j}" for j in range(width)]])

        for batch in batches:
            here = batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(here, prepend=-1))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(here)), strict=True):
                if here[lo] != block:
                    if n:
                        yield fitted()
                    block, n, rng = here[lo], 0, np.random.default_rng(29)
                    own, steps = LogBilinear(start.near.copy(), start.far.copy(), start.out.copy(), start.bias.copy(), shape), [s.copy() for s in at]
                for _, _, buf, off in slices(batch.column(0).slice(lo, hi - lo), PASS):
                    t = lex.tokens(buf, off)
                    own.train(t, noise, steps, rng, 0.05)
                    n += len(t.kind)
        if n:
            yield fitted()

    key = F.xxhash64("id", "text")
    dealt = texts.select("text", F.pmod(key, F.lit(blocks)).alias("block"), key.alias("key")).repartition(blocks, "block").sortWithinPartitions("block", "key")
    fitted = dealt.select("text", "block").mapInArrow(run, "r long, n long, " + ", ".join(f"v{j} double" for j in range(width)))
    means = fitted.groupBy("r").agg(*[(F.sum(F.col(f"v{j}") * F.col("n")) / F.sum("n")).alias(f"v{j}") for j in range(width)]).toArrow()
    if means.num_rows == 0:
        return model
    by = np.argsort(means.column("r").to_numpy())
    table = np.stack([means.column(f"v{j}").to_numpy()[by] for j in range(width)], axis=1).astype(np.float32)
    cuts = np.cumsum([0, *sizes])
    near, far, out = (table[cuts[i] : cuts[i + 1]] for i in range(3))
    return LogBilinear(*(np.ascontiguousarray(x[:, : shape.dim]) for x in (near, far, out)), np.ascontiguousarray(out[:, shape.dim]), shape)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep=lambda i: F.lit(True), head: int = HEAD, warm_docs: int = WARM_DOCS, shape: Shape = Shape()) -> DataFrame:
    """One row per row of ``docs``: id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    Learns from the rows for whose id ``keep`` holds.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    training = slim.where(keep(F.col("id"))).select("id", "text")
    counts = cut(word_counts(training.select("text"), shape))
    lex = lexicon(counts, head, shape)
    ids = cut(training.select("id").orderBy(F.xxhash64("id", F.lit(9)), "id").limit(warm_docs))
    sample = training.join(F.broadcast(ids), "id", "left_semi").orderBy(F.xxhash64("id", F.lit(9)), "id", "text").limit(warm_docs).select("text")
    model = train(training, sample, lex)
    shared = spark.sparkContext.broadcast((lex, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, model = shared.value
        base_norm = np.log10(lex.total + SMOOTH * (lex.distinct + 1))
        rare_norm = np.log10(lex.class_tokens + SMOOTH * (lex.class_words + 1))
        for batch in batches:
            for at, n, buf, off in slices(batch.column(1), PASS):
                t = lex.tokens(buf, off)
                inside = t.count >= 0
                rare = (t.kind >= shape.vocab) & (t.kind < shape.end)
                own = np.where(inside, np.log10(np.maximum(t.count, 0) + SMOOTH), 0.0)
                base = own - base_norm
                score = model.log10(t) + np.where(rare, own - rare_norm[np.clip(t.kind - shape.vocab, 0, shape.rare - 1)], 0.0)
                add = lambda v: np.bincount(t.row, v, minlength=n)
                tail = np.flatnonzero(~inside)
                # a word that a text repeats is one entry with its number
                order = tail[np.lexsort((t.hash[tail], t.row[tail]))]
                fresh = np.ones(len(order), bool)
                fresh[1:] = (t.hash[order][1:] != t.hash[order][:-1]) | (t.row[order][1:] != t.row[order][:-1])
                each = np.flatnonzero(fresh)
                times = np.diff(np.append(each, len(order)))
                bounds = np.concatenate([[0], np.cumsum(np.bincount(t.row[order[each]], minlength=n))]).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(t.hash[order[each]].view(np.int64)), pa.array(times, pa.int64())], ["word", "times"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, n),
                        pa.array(np.bincount(t.row, minlength=n)),
                        pa.array(add((inside & (t.count > 0)).astype(float)).astype(np.int64)),
                        pa.array(add(base)),
                        pa.array(add(score)),
                        pa.ListArray.from_arrays(bounds, pairs),
                    ],
                    names=["id", "n_tokens", "n_known", "base", "score", "tail"],
                )

    kind = slim.schema["id"].dataType.simpleString()
    rows = slim.mapInArrow(run, f"id {kind}, n_tokens long, n_known long, base double, score double, tail array<struct<word:long,times:long>>")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    tail = rows.select("row", F.explode("tail").alias("x")).select("row", "x.word", "x.times").join(counts.select("word", "n"), "word", "left")
    sums = tail.groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("known"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("logs"))
    out = rows.select("row", "id", "n_tokens", "n_known", "base", "score").join(sums, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )

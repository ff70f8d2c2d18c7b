"""Quality rules on repetition inside a text, by suffix arrays.

Every batch of texts gets one suffix array over its words (prefix doubling on
ranks, refined only where suffixes still tie). A suffix never ties with one of
another text, so one sort serves thousands of texts. The longest common prefix
of neighbouring suffixes gives, for each position, the longest substring that
starts there and occurs again in the same text; the union of those spans is the
union of all maximal repeats.

Rows are independent: no shuffle, and a text of any length is taken whole. A text that is longer than a pass is one of
its own, in memory of some 8 bytes a word for each doubling that its longest repeat takes (20 doublings for a million
words), and 40 times its bytes for its words.

Defined results: a null text is an empty one (zero words, fails the base rule);
repeated rows each get their own row, null ids are kept; an empty table gives no rows; other columns are never read. Ties do not
occur: of equal repeats all are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelstack.llm.tokens import per_row, segment_hash, slices, words

SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A maximal repeat counts towards the verdict from this many words on.
SPAN_WORDS = 8
MAX_COVERED = 0.4
MAX_LONGEST = 0.25

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_words long, longest_repeat long, repeat_spans array<struct<first:long,last:long>>, "
    "base_failed boolean, kept boolean"
)


def longest_repeats(word: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each word position, the length of the longest run of words starting there that starts elsewhere in the row too."""
    n = len(word)
    if not n:
        return np.zeros(0, np.int64)
    order = np.lexsort((word, row))
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (word[order][1:] != word[order][:-1]) | (row[order][1:] != row[order][:-1])
    suffix = order
    slot = np.arange(n)
    head = np.maximum.accumulate(np.where(fresh, slot, 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    levels, step = [rank], 1
    last = np.searchsorted(row, row, side="right")

    def tied(starts: np.ndarray) -> np.ndarray:
        alone = starts.copy()
        alone[:-1] &= starts[1:]
        return ~alone

    active = order[tied(fresh)]
    while len(active):
        beyond = active + step
        inside = beyond < last[active]
        second = np.zeros(len(active), np.int64)
        second[inside] = rank[beyond[inside]] + 1
        key = rank[active] * (n + 2) + second
        by = np.argsort(key, kind="stable")
        moved, key = active[by], key[by]
        old = rank[moved]
        opens = np.ones(len(moved), dtype=bool)
        opens[1:] = old[1:] != old[:-1]
        index = np.arange(len(moved))
        place = old + index - np.maximum.accumulate(np.where(opens, index, 0))
        suffix[place] = moved
        fresh = np.ones(len(moved), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        group = np.maximum.accumulate(np.where(fresh, index, 0))
        rank = rank.copy()
        rank[moved] = place[group]
        levels.append(rank)
        active = moved[tied(fresh)]
        step *= 2
    common = np.zeros(n + 1, np.int64)  # common[k]: of the suffixes in slots k - 1 and k
    near = np.flatnonzero(levels[0][suffix[1:]] == levels[0][suffix[:-1]])
    a, b = suffix[near].copy(), suffix[near + 1].copy()
    size = np.zeros(len(near), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ok = (a < n) & (b < n)
        same = np.zeros(len(near), dtype=bool)
        same[ok] = levels[k][a[ok]] == levels[k][b[ok]]
        size += same * (1 << k)
        a += same * (1 << k)
        b += same * (1 << k)
    common[near + 1] = size
    longest = np.empty(n, np.int64)
    longest[suffix] = np.maximum(common[:-1], common[1:])
    return longest


def covered(at: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Mask of positions inside any of the spans ``[at, at + length)``."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + length, -1)
    return np.cumsum(delta[:-1]) > 0


def _lines_repeated(buf: np.ndarray, off: np.ndarray, word_start: np.ndarray) -> np.ndarray:
    """Per text: lines that hold a word and equal an earlier line of the text."""
    breaks = np.flatnonzero(buf == 10) + 1
    full = off[:-1][off[:-1] < off[1:]]
    start = np.unique(np.concatenate([full, breaks[breaks < len(buf)]]))
    if not len(start):
        return np.zeros(len(off) - 1, np.int64)
    h = segment_hash(buf, start, buf != 10)
    size = np.diff(np.append(start, len(buf)))
    stop = np.append(start[1:], len(buf))
    size = size - (buf[stop - 1] == 10)
    has_word = np.searchsorted(word_start, start) < np.searchsorted(word_start, stop)
    row = np.searchsorted(off, start, side="right") - 1
    start, h, size, row = start[has_word], h[has_word], size[has_word], row[has_word]
    order = np.lexsort((start, size, h, row))
    again = np.zeros(len(order), dtype=bool)
    h, size, row = h[order], size[order], row[order]
    again[1:] = (h[1:] == h[:-1]) & (size[1:] == size[:-1]) & (row[1:] == row[:-1])
    return np.bincount(row[again], minlength=len(off) - 1)


def measure(buf: np.ndarray, off: np.ndarray, span_words: int = SPAN_WORDS) -> dict[str, np.ndarray]:
    """The rules' measurements of each text in a slice."""
    w = words(buf, off)
    n = len(w.hash)
    longest = longest_repeats(w.hash, w.row)
    at = np.flatnonzero(longest >= 3)
    triple = covered(at, np.full(len(at), 3), n)
    at = np.flatnonzero(longest >= span_words)
    span = covered(at, longest[at], n)
    top = np.zeros(len(off) - 1, np.int64)
    np.maximum.at(top, w.row, longest)
    edge = span.copy()
    edge[1:] &= ~span[:-1] | (w.row[1:] != w.row[:-1])
    close = span.copy()
    close[:-1] &= ~span[1:] | (w.row[1:] != w.row[:-1])
    opened, closed = np.flatnonzero(edge), np.flatnonzero(close)
    solid = np.zeros(len(buf) + 1, np.int64)
    np.add.at(solid, w.start, 1)
    np.add.at(solid, w.end, -1)
    inside = np.cumsum(solid[:-1]) > 0
    return {
        "n_words": w.count,
        "word_chars": per_row(inside & ((buf & 0xC0) != 0x80), off),
        "n_symbols": per_row(_IS_SYMBOL[buf], off),
        "n_dup_lines": _lines_repeated(buf, off, w.start),
        "n_repeat_words": per_row(triple, w.first),
        "covered_words": per_row(span, w.first),
        "longest_repeat": top,
        "spans_of": np.bincount(w.row[opened], minlength=len(off) - 1),
        "span_first": opened - w.first[w.row[opened]],
        "span_last": closed - w.first[w.row[closed]],
    }


def verdicts(m: dict[str, np.ndarray], min_words: int, max_repeat_percent: int, max_covered: float, max_longest: float, span_words: int = SPAN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) of measured texts; a longest repeat of less than ``span_words`` words speaks against none."""
    failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_repeat_percent * m["n_words"])
    fine = (m["covered_words"] <= max_covered * m["n_words"]) & ((m["longest_repeat"] < span_words) | (m["longest_repeat"] <= max_longest * m["n_words"]))
    return failed, fine & ~failed


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    span_words: int = SPAN_WORDS,
    max_covered: float = MAX_COVERED,
    max_longest: float = MAX_LONGEST,
) -> DataFrame:
    """One row per row of ``docs``: its id, the measurements, the union of its repeats as word spans, ``base_failed`` and ``kept``.

    A text is kept if it passes the base rule, at most ``max_covered`` of its words lie in repeats of
    ``span_words`` words or more, and its longest repeat takes at most ``max_longest`` of its words.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, rows, buf, off in slices(batch.column(1)):
                m = measure(buf, off, span_words)
                failed, kept = verdicts(m, min_words, max_repeat_percent, max_covered, max_longest, span_words)
                bounds = np.concatenate([[0], np.cumsum(m["spans_of"])]).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(m["span_first"], pa.int64()), pa.array(m["span_last"], pa.int64())], ["first", "last"])
                cols = [pa.array(m[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")]
                cols += [pa.ListArray.from_arrays(bounds, pairs), pa.array(failed), pa.array(kept)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, rows), *cols], names=names)

    names = ["id", *(x.split()[0] for x in FIELDS.replace("array<struct<first:long,last:long>>", "array").split(", "))]
    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, {FIELDS}").withColumnRenamed("id", id_col)


def keep_quality(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The rows of ``docs``, unchanged, whose text ``quality_rules`` keeps; no shuffle."""
    limit = {"min_words": MIN_WORDS, "max_repeat_percent": MAX_REPEAT_PERCENT, "max_covered": MAX_COVERED, "max_longest": MAX_LONGEST} | limits
    span_words = limit.pop("span_words", SPAN_WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [verdicts(measure(buf, off, span_words), **limit, span_words=span_words)[1] for _, _, buf, off in slices(batch.column(text_col))]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)

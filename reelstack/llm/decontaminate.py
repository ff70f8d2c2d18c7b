"""Benchmark decontamination by template windows and slot consistency.

Texts become templates: numbers, names and units are replaced by typed
placeholders, the rest is lower-cased. Windows of five template words are hashed.
A document that shares enough of an item's windows holds its template; it holds
the item, as it stands or re-parameterised, if every slot value of the item was
replaced by one and the same value wherever it occurs, be it over all windows or
at one place of the document. With ``edited`` it also holds the item where that share
of the item's words is equal, whatever the slots say (a copy with one name changed).

Names are told by their capitals, so each text is canonicalised in three ways: names inside sentences as slots;
no names at all, so that copies in capitals or small letters match; and capitalised words that open a
sentence as names too. A document holds an item if it does in any of the three.

Candidates come from each item's rarest windows only: a document that covers
the needed share of an item's ``n`` windows holds one of its
``n - ceil(share * n) + 1`` rarest (windows being ranked by how many items have
them), so a template phrase that all items share joins nothing. Windows of documents
are filtered by the benchmark's windows before they are shuffled, and
candidates are checked on the whole texts. Texts are known by their digest, so equal texts are checked once.

Items whose templates are equal where names are slots, and whose slots repeat alike, are a class (variants of one
question). A document is paired with classes: whether it holds the template consistently is the same for all members, and which
of them it holds with their own values shows from one hash of its slot values. Only what a class leaves open (contradicting slots, a
slot that is missing, letters of one case) is checked for the members whose rarest windows the document has.

Defined results: null and empty texts hold nothing; an item of three or four template words is one window of its
own length, one of fewer is found in no document; rows that repeat an
id are each judged by their own text; null ids, and ids that are no numbers, are judged like others; an item of null id is
found, but listed with none; an empty benchmark clears all, an empty table of documents gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelstack.llm.shared import cut, free_name, small
from reelstack.llm.tokens import LOWER, mix64, segment_hash, slices, windows

WIDTH = 5
#: Items of fewer template words are found in no document.
LEAST_WORDS = 3
SHARE = 0.6
#: Distinct benchmark windows that may be broadcast as a filter (8 bytes each); beyond, all windows are joined by shuffle.
FILTER_WINDOWS = 1_000_000
#: Digests (32 characters, and what a text holds) that may be broadcast.
BROADCAST_DIGESTS = 200_000
#: Templates of items that a task keeps while it checks pairs.
KEPT_ITEMS = 2_000

# Words that stand for a number, and units of measure.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million billion".split()
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams pound pounds ounce ounces ml l liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent mph kph".split()

#: The ways in which names are slots: those inside sentences, or all.
SLOT_WAYS = (0, 2)

NUM, NAME, UNIT = (np.uint64(x) for x in (0x6E756D, 0x6E616D65, 0x756E6974))

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;\n\r\"()|")] = True


def _folded(buf: np.ndarray) -> np.ndarray:
    """Lower-case A-Z and the accented capitals of Latin-1 (two bytes in UTF-8: C3 80 to C3 9E)."""
    out = LOWER[buf]
    out[1:] += np.where((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97), 32, 0).astype(np.uint8)
    return out


def _word_hashes(listed: list[str]) -> np.ndarray:
    raw = [w.encode() for w in listed]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    start = np.cumsum([0, *map(len, raw[:-1])])
    return np.sort(mix64(segment_hash(buf, start) + np.array([len(w) for w in raw], np.uint64)))


_NUMBER_HASHES, _UNIT_HASHES = _word_hashes(NUMBER_WORDS), _word_hashes(UNITS)


def _among(h: np.ndarray, listed: np.ndarray) -> np.ndarray:
    if not len(listed):
        return np.zeros(len(h), bool)
    return listed[np.minimum(np.searchsorted(listed, h), len(listed) - 1)] == h


def templates(buf: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, template word, slot value) of every template word, in each of the three ways; the slot value is 0 outside slots.

    A word is a run of letters or one number (digits with inner dots and commas). A number is digits or
    a number word; a unit is a listed word after a number; a name is a capitalised word: one that does not
    open a sentence or line, none, or any. Neighbouring names are one slot.
    """
    n = len(buf)
    digit, letter = _DIGIT[buf], _LETTER[buf]
    joint = np.zeros(n, bool)
    if n > 2:
        joint[1:-1] = ((buf[1:-1] == 46) | (buf[1:-1] == 44)) & digit[:-2] & digit[2:]
    number = digit | joint
    solid = letter | number
    begins, ends = solid.copy(), solid.copy()
    if n:
        begins[1:] &= ~solid[:-1] | (number[1:] != number[:-1])
        ends[:-1] &= ~solid[1:] | (number[1:] != number[:-1])
        full = off[:-1] < off[1:]
        begins[off[:-1][full]] = solid[off[:-1][full]]
        ends[off[1:][full] - 1] = solid[off[1:][full] - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    if not len(start):
        return [(row, np.zeros(0, np.uint64), np.zeros(0, np.uint64))] * 3
    h = mix64(segment_hash(_folded(buf), start, solid) + (end - start).astype(np.uint64))
    follows = np.zeros(len(start), bool)
    follows[1:] = row[1:] == row[:-1]
    halts = np.concatenate([[0], np.cumsum(_STOP[buf])])
    opens = ~follows
    opens[1:] |= halts[start[1:]] > halts[end[:-1]]
    is_num = number[start] | _among(h, _NUMBER_HASHES)
    is_unit = np.zeros(len(start), bool)
    is_unit[1:] = is_num[:-1] & follows[1:] & _among(h[1:], _UNIT_HASHES)
    second = buf[np.minimum(start + 1, n - 1)]
    accented = (buf[start] == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    after = np.where(accented, start + 2, start + 1)
    lower_next = (after < end) & ~_UPPER[buf[np.minimum(after, n - 1)]]
    capital = (_UPPER[buf[start]] | accented) & lower_next & ~is_num
    return [_template(row, h, follows, is_num, is_unit, names) for names in (capital & ~opens, np.zeros(len(start), bool), capital)]


def _template(row: np.ndarray, h: np.ndarray, follows: np.ndarray, is_num: np.ndarray, is_unit: np.ndarray, is_name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    word = np.where(is_num, NUM, np.where(is_unit, UNIT, np.where(is_name, NAME, h)))
    slot = np.where(is_num | is_unit | is_name, h, np.uint64(0))
    extra = np.zeros(len(h), bool)
    extra[1:] = is_name[1:] & is_name[:-1] & follows[1:]
    if extra.any():
        head = np.maximum.accumulate(np.where(~extra, np.arange(len(h)), 0))
        joined = slot.copy()
        np.add.at(joined, head[extra], slot[extra] * np.uint64(3))
        row, word, slot = row[~extra], word[~extra], joined[~extra]
    return row, word, slot


def _salted(h: np.ndarray, way: int, width: int) -> np.ndarray:
    return mix64(h + np.uint64((way * 64 + width) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def _windows_of(table: DataFrame, widths: list[int], wanted: np.ndarray | None = None) -> DataFrame:
    """(id, window) of a table (id string, text): each row's distinct windows of the widths, of those ``wanted`` if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, buf, off in slices(batch.column(1)):
                found = []
                for way, (row, word, _) in enumerate(templates(buf, off)):
                    for width in widths:
                        h, first = windows(word, row, width)
                        h, r = _salted(h, way, width), row[first]
                        if wanted is not None:
                            hit = _among(h, wanted)
                            h, r = h[hit], r[hit]
                        found.append((r, h))
                row, h = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n).take(pa.array(row[new])), pa.array(h[new].view(np.int64))], names=["id", "window"])

    return table.mapInArrow(run, "id string, window long")


def _item_windows(items: DataFrame, width: int) -> DataFrame:
    """(id, way, width, window) of the items' distinct windows; an item of fewer template words is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, text in enumerate(batch.column(1)):
                for _, _, buf, off in slices(pa.array([text.as_py()], pa.string())):
                    for way, (row, word, _) in enumerate(templates(buf, off)):
                        own = min(width, len(word))
                        if own >= LEAST_WORDS:
                            out.extend((i, way, own, x) for x in np.unique(_salted(windows(word, row, own)[0], way, own)).view(np.int64))
            col = lambda k, t: pa.array([x[k] for x in out], t)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(col(0, pa.int64())), col(1, pa.int32()), col(2, pa.int32()), col(3, pa.int64())], names=["id", "way", "width", "window"])

    return items.mapInArrow(run, "id string, way int, width int, window long")


def _aligned(doc: tuple[np.ndarray, np.ndarray], item: tuple[np.ndarray, np.ndarray], width: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of the item's distinct windows in the document, word positions of the item, theirs in the document).

    Each item window is taken where most of the item's windows line up.
    """
    zero = lambda x: np.zeros(len(x), np.int64)
    hd, pd = windows(doc[0], zero(doc[0]), width)
    hi, pi = windows(item[0], zero(item[0]), width)
    none = np.zeros(0, np.int64)
    if not len(hi):
        return 0.0, none, none
    share = np.isin(np.unique(hi), hd).mean()
    order = np.argsort(hd, kind="stable")
    hd, pd = hd[order], pd[order]
    lo, hi_ = np.searchsorted(hd, hi, "left"), np.searchsorted(hd, hi, "right")
    size = hi_ - lo
    if not size.sum():
        return 0.0, none, none
    ip = np.repeat(pi, size)
    dp = pd[np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
    shift, inverse, weight = np.unique(dp - ip, return_inverse=True, return_counts=True)
    best = np.lexsort((dp, -weight[inverse], ip))
    ip, dp = ip[best], dp[best]
    once = np.ones(len(ip), bool)
    once[1:] = ip[1:] != ip[:-1]
    steps = np.arange(width)
    return float(share), (ip[once][:, None] + steps).ravel(), (dp[once][:, None] + steps).ravel()


def _slot_pairs(doc: tuple[np.ndarray, np.ndarray], item: tuple[np.ndarray, np.ndarray], at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Distinct (slot value of the item, of the document) at positions that were put together, as two rows."""
    used = item[1][at] != 0
    return np.unique(np.stack([item[1][at][used], doc[1][to][used]]), axis=1)


def compare(doc: tuple[np.ndarray, np.ndarray], item: tuple[np.ndarray, np.ndarray], width: int) -> tuple[float, bool, bool]:
    """(share of the item's distinct windows in the document, slots consistent, slots changed) of two (template words, slot values)."""
    share, at, to = _aligned(doc, item, width)
    pairs = _slot_pairs(doc, item, at, to)
    return share, len(np.unique(pairs[0])) == pairs.shape[1], bool((pairs[0] != pairs[1]).any())


def copies(doc: tuple[np.ndarray, np.ndarray], item: tuple[np.ndarray, np.ndarray], width: int, share: float) -> Iterator[tuple[float, bool, bool, float]]:
    """What ``compare`` tells, for each place of the document that may hold a copy, with the copy's share of equal words.

    A place is a shift of positions; windows whose shift is off by no more than the words that a copy may lack belong to it,
    each item window being taken at the shift nearest to the place's. Words are equal if their slot values are, too.
    """
    zero = lambda x: np.zeros(len(x), np.int64)
    hd, pd = windows(doc[0], zero(doc[0]), width)
    hi, pi = windows(item[0], zero(item[0]), width)
    if not len(hi) or not len(hd):
        return
    order = np.argsort(hd, kind="stable")
    hd, pd = hd[order], pd[order]
    lo, up = np.searchsorted(hd, hi, "left"), np.searchsorted(hd, hi, "right")
    size = up - lo
    ip, which = np.repeat(pi, size), np.repeat(hi, size)
    dp = pd[np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
    order = np.argsort(dp - ip, kind="stable")
    ip, dp, which = ip[order], dp[order], which[order]
    shift, distinct, n = dp - ip, len(np.unique(hi)), len(item[0])
    slack = int((1 - share) * n) + width
    steps = np.arange(width)
    for place in np.unique(shift):
        first, last = np.searchsorted(shift, [place - slack, place + slack + 1])
        if last - first < share * distinct - 1e-9:
            continue
        held = len(np.unique(which[first:last])) / distinct
        if held < share - 1e-9:
            continue
        i, d = ip[first:last], dp[first:last]
        near = np.lexsort((d, np.abs(d - i - place), i))
        i, d = i[near], d[near]
        once = np.ones(len(i), bool)
        once[1:] = i[1:] != i[:-1]
        at, to = (i[once][:, None] + steps).ravel(), (d[once][:, None] + steps).ravel()
        used, equal = item[1][at] != 0, item[1][at] == doc[1][to]
        pairs = np.unique(np.stack([item[1][at][used], doc[1][to][used]]), axis=1)
        yield held, len(np.unique(pairs[0])) == pairs.shape[1], bool((pairs[0] != pairs[1]).any()), len(np.unique(at[equal])) / n


def verdict(doc: tuple[np.ndarray, np.ndarray], item: tuple[np.ndarray, np.ndarray], width: int, share: float, edited: bool) -> tuple[float, bool, bool]:
    """(share, whether the document holds the item, slots changed): consistent over all, or at one place; if ``edited``, also where enough words are equal."""
    got, consistent, changed = compare(doc, item, width)
    if got < share or consistent:
        return got, got >= share, changed
    best = (got, False, changed)
    for held, same, other, equal in copies(doc, item, width, share):
        if same or edited and equal >= share - 1e-9:
            # the copy that is nearest to the item speaks for the document
            best = max(best, (held, True, other), key=lambda x: (x[1], x[0], not x[2]))
    return best


def best_verdict(doc: list, item: list, width: int, share: float, edited: bool) -> tuple[float, bool, bool]:
    """The verdict of the first way by which the document holds the item: names as slots, openers too, none.

    Without names as slots a copy must be whole, unless ``edited``: a changed name is no slot there that could contradict.
    """
    got = (0.0, False, False)
    for way in (0, 2, 1):
        d, i = doc[way], item[way]
        if len(i[1]) >= LEAST_WORDS:
            got = verdict(d[1:], i[1:], min(width, len(i[1])), share if edited or way != 1 else 1.0, edited)
            if got[1]:
                return got
    return got


def _signature(values: np.ndarray) -> int:
    """Slot values in order as one number."""
    return int.from_bytes(hashlib.md5(values.tobytes()).digest()[:8], "little", signed=True)


def _class_key(forms: list) -> str:
    """Digest of what items of a class have in common: their template words where names are slots, and which slots are equal."""
    key = hashlib.md5()
    for way in SLOT_WAYS:
        _, word, slot = forms[way]
        _, first, inverse = np.unique(slot, return_index=True, return_inverse=True)
        key.update(len(word).to_bytes(8, "little") + word.tobytes() + first[inverse].tobytes())
    return key.hexdigest()


def class_verdict(doc: list, member: list, width: int, share: float) -> tuple[float, int, int] | None:
    """(share, way, signature of the document's slot values) if the document holds all items of the member's class, else None.

    It does if, by the first way of which it has the share, its slots are consistent and none of the item's is missing. What
    ``best_verdict`` says is then the same for all members, but for whether slots are changed: they are where a member's signature is
    another. None leaves it open what holds for single members.
    """
    for way in SLOT_WAYS:
        d, i = doc[way][1:], member[way][1:]
        if len(i[0]) < LEAST_WORDS:
            continue
        got, at, to = _aligned(d, i, min(width, len(i[0])))
        if got < share:
            continue
        pairs = _slot_pairs(d, i, at, to)
        slots = np.flatnonzero(i[1])
        if len(np.unique(pairs[0])) < pairs.shape[1] or not np.isin(slots, at).all():
            return None
        value = np.zeros(len(i[1]), np.uint64)
        value[at] = d[1][to]
        return got, way, _signature(value[slots])
    return None


def _item_classes(items: DataFrame) -> DataFrame:
    """(id, class, sig0, sig2): each item's class, and its slot values in the two ways."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sigs = [], {way: [] for way in SLOT_WAYS}
            for text in batch.column(1):
                for _, _, buf, off in slices(pa.array([text.as_py()], pa.string())):
                    forms = templates(buf, off)
                    keys.append(_class_key(forms))
                    for way in SLOT_WAYS:
                        slot = forms[way][2]
                        sigs[way].append(_signature(slot[slot != 0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string()), *[pa.array(sigs[way], pa.int64()) for way in SLOT_WAYS]], names=["id", "class", "sig0", "sig2"])

    return items.select("id", "text").mapInArrow(run, "id string, class string, sig0 long, sig2 long")


def _checked_classes(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, share: float, edited: bool) -> DataFrame:
    """(id, class, share, changed, way, sig) of pairs (id, class) that hold, and of those left open, whose share is null.

    A class of one item is judged at once: its rows have ``changed`` and no way. ``classes``: class, members, text (a member's).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        last, doc = None, []
        for batch in batches:
            rows, out = [], []
            ids, group, members = (batch.column(k).to_pylist() for k in (0, 1, 2))
            made = lambda column, i: next(templates(buf, off) for _, _, buf, off in slices(column.slice(i, 1)))
            for i in range(batch.num_rows):
                if group[i] not in known:
                    if len(known) >= KEPT_ITEMS:
                        known.clear()
                    known[group[i]] = made(batch.column(4), i)
                # the pairs of one text follow each other
                if ids[i] != last:
                    last, doc = ids[i], made(batch.column(3), i)
                if members[i] == 1:
                    got, holds, changed = best_verdict(doc, known[group[i]], width, share, edited)
                    if not holds:
                        continue
                    out.append((got, changed, None, None))
                else:
                    held = class_verdict(doc, known[group[i]], width, share)
                    out.append((held[0], None, *held[1:]) if held else (None,) * 4)
                rows.append(i)
            at = pa.array(rows, pa.int64())
            kinds = (pa.float64(), pa.bool_(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), *[pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]],
                names=["id", "class", "share", "changed", "way", "sig"],
            )

    joined = pairs.join(classes.select("class", "members", F.col("text").alias("it")), "class").join(docs.select("id", F.col("text").alias("dt")), "id")
    return joined.select("id", "class", "members", "dt", "it").mapInArrow(run, "id string, class string, share double, changed boolean, way int, sig long")


def _checked(pairs: DataFrame, docs: DataFrame, items: DataFrame, width: int, share: float, edited: bool) -> DataFrame:
    """(id, item, share, changed) of the candidate pairs that hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        last, doc = None, []
        for batch in batches:
            out: list[tuple[int, float, bool]] = []
            ids, item, left, right = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)
            made = lambda column, i: next(templates(buf, off) for _, _, buf, off in slices(column.slice(i, 1)))
            for i in range(batch.num_rows):
                if item[i] not in known:
                    if len(known) >= KEPT_ITEMS:
                        known.clear()
                    known[item[i]] = made(right, i)
                # the pairs of one text follow each other
                if ids[i] != last:
                    last, doc = ids[i], made(left, i)
                got, holds, changed = best_verdict(doc, known[item[i]], width, share, edited)
                if holds:
                    out.append((i, got, changed))
            rows = pa.array([x[0] for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.bool_())],
                names=["id", "item", "share", "changed"],
            )

    joined = pairs.join(items.select(F.col("id").alias("item"), F.col("text").alias("it")), "item").join(docs.select("id", F.col("text").alias("dt")), "id")
    return joined.select("id", "item", "dt", "it").mapInArrow(run, "id string, item string, share double, changed boolean")


def _digested(table: DataFrame, text_col: str) -> DataFrame:
    """(id, text): the distinct texts that are not empty, the id being their digest."""
    text = F.col(text_col).cast("string")
    return table.select(F.md5(text.cast("binary")).alias("id"), text.alias("text")).where("text <> ''")


def _class_hits(docs: DataFrame, benchmark: DataFrame, text_col: str, item_text_col: str, width: int = WIDTH, share: float = SHARE, edited: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits by class, hits by item, the items' classes).

    By class: id, class, share, changed, way, sig as ``_checked_classes`` has them, one row for a document and all items of a class.
    By item: id, item, share, changed, for what their class left open. Classes: id of the item, class, sig0, sig2.
    """
    items = cut(_digested(benchmark, item_text_col).dropDuplicates(["id"]))
    slim = _digested(docs, text_col)
    class_of = cut(_item_classes(items))
    held = cut(_item_windows(items, width))
    common = held.groupBy("window").agg(F.countDistinct("id").alias("items"))
    by_item = Window.partitionBy("id", "way")
    ranked = held.join(common, "window").withColumns(
        {"n": F.count("*").over(by_item), "place": F.row_number().over(by_item.orderBy("items", "window"))}
    )
    rare = ranked.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1).select("id", "width", "window")
    rare = cut(rare.join(class_of.select("id", "class"), "id").select(F.col("id").alias("item"), "class", "width", "window"))
    # five widths at most
    widths = sorted(r["width"] for r in rare.select("width").distinct().collect()) or [width]
    probes = rare.select("window").distinct()
    wanted = None
    if probes.count() <= FILTER_WINDOWS:
        wanted = np.sort(np.array([r[0] for r in probes.collect()], np.int64).view(np.uint64))
    found = _windows_of(slim, widths, wanted)
    found = cut(found if wanted is not None else found.join(probes, "window", "left_semi"))
    pairs = cut(found.join(rare.select("class", "window").distinct(), "window").select("id", "class").distinct())
    ids = cut(pairs.select("id").distinct())
    texts = slim.join(small(ids, ids.count(), BROADCAST_DIGESTS), "id", "left_semi").dropDuplicates(["id"])
    first = class_of.join(items, "id").groupBy("class").agg(F.count("*").alias("members"), F.min_by("text", "id").alias("text"))
    judged = cut(_checked_classes(pairs, texts, first, width, share, edited))
    left = judged.where("share is null").select("id", "class")
    single = left.join(found, "id").join(rare.select("item", "class", "window"), ["class", "window"]).select("id", "item").distinct()
    some = left.select("id").distinct()
    open_texts = slim.join(small(some, some.count(), BROADCAST_DIGESTS), "id", "left_semi").dropDuplicates(["id"])
    return judged.where("share is not null"), _checked(single, open_texts, items, width, share, edited), class_of


def text_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", **settings) -> DataFrame:
    """(id, item, share, changed): digests of documents' texts and of the items' texts that they hold."""
    by_class, by_item, class_of = _class_hits(docs, benchmark, text_col, item_text_col, **settings)
    own = F.when(F.col("way") == 0, F.col("sig0")).otherwise(F.col("sig2"))
    of_class = by_class.join(class_of.withColumnRenamed("id", "item"), "class").select("id", "item", "share", F.coalesce("changed", own != F.col("sig")).alias("changed"))
    return of_class.unionByName(by_item).groupBy("id", "item").agg(F.max("share").alias("share"), F.max("changed").alias("changed"))


def _named_hits(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, **settings) -> DataFrame:
    """(id, items, share, changed): digests of documents' texts with the ids of items that they hold, a row for each class or item."""
    by_class, by_item, class_of = _class_hits(docs, benchmark, text_col, item_text_col, **settings)
    names = benchmark.select(F.md5(F.col(item_text_col).cast("string").cast("binary")).alias("item"), F.col(item_col).alias("_item")).distinct()
    per_item = names.groupBy("item").agg(F.collect_set("_item").alias("items"))
    ends = [f(f"sig{way}").alias(f"{name}{way}") for way in SLOT_WAYS for name, f in (("least", F.min), ("most", F.max))]
    per_class = names.join(class_of.withColumnRenamed("id", "item"), "item").groupBy("class").agg(F.collect_set("_item").alias("items"), *ends)
    # one of the class's items has other slot values than the document
    other = [(F.col(f"least{way}") != F.col("sig")) | (F.col(f"most{way}") != F.col("sig")) for way in SLOT_WAYS]
    changed = F.coalesce("changed", F.when(F.col("way") == SLOT_WAYS[0], other[0]).otherwise(other[1]))
    return by_class.join(per_class, "class").select("id", "items", "share", changed.alias("changed")).unionByName(by_item.join(per_item, "item").select("id", "items", "share", "changed"))


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", **settings
) -> DataFrame:
    """(id, item, share, changed): each document that holds an item; ``changed`` if slots have other values than the item's.

    ``edited``: a copy of whose words ``share`` equal the item's counts also if its slots contradict each other.
    """
    names = benchmark.select(F.md5(F.col(item_text_col).cast("string").cast("binary")).alias("item"), F.col(item_col).alias("_item")).distinct()
    hits = text_hits(docs, benchmark, text_col, item_text_col, **settings)
    found = cut(hits.join(names, "item").select("id", F.col("_item").alias("item"), "share", "changed"))
    rows = docs.select(F.col(id_col).alias("_doc"), F.md5(F.col(text_col).cast("string").cast("binary")).alias("id"))
    return rows.join(small(found, found.count(), BROADCAST_DIGESTS), "id").select(F.col("_doc").alias(id_col), F.col("item").alias(item_col), "share", "changed").distinct()


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", **settings
) -> DataFrame:
    """One row per row of ``docs``: id, ``contaminated``, ``items`` (sorted ids of the items it holds), ``max_share``, ``reparameterised``."""
    found = _named_hits(docs, benchmark, text_col, item_col, item_text_col, **settings)
    all_items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    per = cut(found.groupBy("id").agg(all_items.alias("items"), F.max("share").alias("max_share"), F.max("changed").alias("reparameterised")))
    rows = docs.select(F.col(id_col).alias("_doc"), F.md5(F.col(text_col).cast("string").cast("binary")).alias("id"))
    out = rows.join(small(per, per.count(), BROADCAST_DIGESTS), "id", "left")
    none = F.array().cast(per.schema["items"].dataType)
    return out.select(
        F.col("_doc").alias(id_col),
        F.col("max_share").isNotNull().alias("contaminated"),
        F.coalesce("items", none).alias("items"),
        F.coalesce("max_share", F.lit(0.0)).alias("max_share"),
        F.coalesce("reparameterised", F.lit(False)).alias("reparameterised"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs``, unchanged, that hold no benchmark item."""
    key = free_name("digest", docs.columns)
    by_class, by_item, _ = _class_hits(docs, benchmark, text_col, item_text_col, **settings)
    bad = cut(by_class.select("id").unionByName(by_item.select("id")).distinct().withColumnRenamed("id", key))
    return docs.withColumn(key, F.md5(F.col(text_col).cast("string").cast("binary"))).join(small(bad, bad.count(), BROADCAST_DIGESTS), key, "left_anti").select(docs.columns)

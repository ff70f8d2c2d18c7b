"""Decontamination against a plain-Python version that compares every text with every item."""

import math
import random
import re

from reelstack.llm import decontaminate as dc
from reelstack.llm import queries
from reelstack.llm.decontaminate import LEAST_WORDS, NUMBER_WORDS, SHARE, UNITS, WIDTH

LETTERS = re.compile(r"[A-Za-z\u0080-\U0010ffff]+|[0-9]+(?:[.,][0-9]+)*")
STOPS = set(".!?:;\n\r\"()|")


def small_letters(word):
    return "".join(c.lower() if "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" else c for c in word)


def plain_template(text, names):
    """[(template word, slot value or None)]; ``names``: ``inside`` sentences, ``none``, or ``any``."""
    out, before, named_before = [], None, False
    for m in LETTERS.finditer(text):
        word, low = m[0], small_letters(m[0])
        number = word[0].isdigit() and word[0].isascii() or low in NUMBER_WORDS
        unit = before is not None and before[1] and low in UNITS
        opens = before is None or bool(STOPS & set(text[before[0] : m.start()]))
        capital = ("A" <= word[0] <= "Z" or "À" <= word[0] <= "Þ") and len(word) > 1 and not "A" <= word[1] <= "Z" and not number
        name = capital and (names == "any" or names == "inside" and not opens)
        if name and named_before:
            head, value = out[-1]
            out[-1] = (head, (*value[:1], *sorted((*value[1:], low))))
        else:
            kind = "#" if number else "~" if unit else "@" if name else None
            out.append((kind or low, (low,) if kind else None))
        before, named_before = (m.end(), number), name
    return out


def placed(template, width):
    return [(tuple(w for w, _ in template[i : i + width]), i) for i in range(len(template) - width + 1)]


def slot_pairs(doc, item, chosen, width):
    """Slot values of the item beside those of the document, for item windows put at places of the document."""
    return {(item[i + k][1], doc[d + k][1]) for i, d in chosen.items() for k in range(width) if item[i + k][1] is not None}


def one_to_one(pairs):
    return len({a for a, _ in pairs}) == len(pairs)


def plain_verdict(doc, item, width, share, edited):
    """(share, held, changed) in one way."""
    where = {}
    for window, at in placed(doc, width):
        where.setdefault(window, []).append(at)
    mine = placed(item, width)
    distinct = {w for w, _ in mine}
    got = len(distinct & where.keys()) / len(distinct)
    if got < share or got == 0:
        return got, False, False
    meets = [(i, d, w) for w, i in mine for d in where.get(w, ())]
    weight = {}
    for i, d, _ in meets:
        weight[d - i] = weight.get(d - i, 0) + 1
    chosen = {}
    for i, d, _ in sorted(meets, key=lambda x: (x[0], -weight[x[1] - x[0]], x[1])):
        chosen.setdefault(i, d)
    pairs = slot_pairs(doc, item, chosen, width)
    changed = any(a != b for a, b in pairs)
    if one_to_one(pairs):
        return got, True, changed
    best = (got, False, changed)
    slack = int((1 - share) * len(item)) + width
    for place in weight:
        near = [x for x in meets if abs(x[1] - x[0] - place) <= slack]
        held = len({w for _, _, w in near}) / len(distinct)
        if held < share - 1e-9:
            continue
        chosen = {}
        for i, d, _ in sorted(near, key=lambda x: (x[0], abs(x[1] - x[0] - place), x[1])):
            chosen.setdefault(i, d)
        pairs = slot_pairs(doc, item, chosen, width)
        equal = {i + k for i, d in chosen.items() for k in range(width) if item[i + k][1] == doc[d + k][1]}
        if one_to_one(pairs) or edited and len(equal) / len(item) >= share - 1e-9:
            best = max(best, (held, True, any(a != b for a, b in pairs)), key=lambda x: (x[1], x[0], not x[2]))
    return best


def plain_hits(texts, items, edited, share=SHARE):
    """[[(item, share, changed)]] of the texts; items are (id, text)."""
    ways = ("inside", "any", "none")
    ready = [(ident, [plain_template(text or "", way) for way in ways]) for ident, text in items]
    out, known = [], {}
    for text in texts:
        if text not in known:
            doc = [plain_template(text or "", way) for way in ways]
            sets = [{width: {w for w, _ in placed(d, width)} for width in range(LEAST_WORDS, WIDTH + 1)} for d in doc]
            found = []
            for ident, forms in ready:
                for way, d, held, form in zip(ways, doc, sets, forms, strict=True):
                    if len(form) < LEAST_WORDS:
                        continue
                    width, need = min(WIDTH, len(form)), share if edited or way != "none" else 1.0
                    own = {w for w, _ in placed(form, width)}
                    if len(own & held[width]) < need * len(own) - 1e-9:
                        continue
                    got, holds, changed = plain_verdict(d, form, width, need, edited)
                    if holds:
                        found.append((ident, got, changed))
                        break
            known[text] = found
        out.append(known[text])
    return out


def plain_decontaminate(texts, items, edited):
    """[(items held, greatest share, changed)] of the texts."""
    return [(sorted({x[0] for x in found}), max((x[1] for x in found), default=0.0), any(x[2] for x in found)) for found in plain_hits(texts, items, edited)]


NAMES = ["Anna", "Maria", "Hugo", "Émile", "Peter Paul", "Olga"]
FORMS = [
    "{a} sold {x} kg of dark bread to {b} and then {a} gave {y} euros back to an old friend.",
    "If {a} walks {x} miles in {y} hours, how far does {b} walk with {a} in {x} days?",
    "What is the sum of {x} and {y} when {x} is doubled",
    "the {x} boats",
]
FILLER = "some plain words that stand around the thing and mean little here but fill up lines".split()


def made_sets(seed):
    """Items of few templates, and texts that hold them whole, with other values, mixed values, missing words, twice, or not at all."""
    rng = random.Random(seed)

    def instance(form):
        a, b = rng.sample(NAMES, 2)
        return form.format(a=a, b=b, x=rng.choice(["12", "3.5", "seven", "1,200"]), y=rng.choice(["9", "40", "two"]))

    items = [(i, instance(rng.choice(FORMS))) for i in range(24)]
    texts = []
    for _ in range(80):
        parts = []
        for _ in range(rng.randint(0, 3)):
            held = rng.choice(items)[1] if rng.random() < 0.6 else instance(rng.choice(FORMS))
            words = held.split()
            change = rng.random()
            if change < 0.2:
                del words[rng.randrange(len(words))]
            elif change < 0.4:
                words[rng.randrange(len(words))] = rng.choice(["Olga", "77", "other"])
            elif change < 0.5:
                words = words[: len(words) * 2 // 3]
            held = " ".join(words)
            parts.append(held.upper() if rng.random() < 0.1 else held.lower() if rng.random() < 0.1 else held)
            parts.append(" ".join(rng.choice(FILLER) for _ in range(rng.randint(0, 12))) + rng.choice([".", "", "\n"]))
        texts.append(" ".join(parts))
    return texts + ["", None, texts[0]], [*items, (99, ""), (98, None), (97, items[0][1])]


def rounded(rows):
    return [(list(items), round(share, 9), changed) for items, share, changed in rows]


def test_made_sets(spark):
    for seed in (1, 2):
        texts, items = made_sets(seed)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        bench = spark.createDataFrame(items, "item_id long, text string")
        for edited in (False, True):
            got = {r["doc_id"]: r for r in dc.decontaminate(docs, bench, edited=edited).collect()}
            rows = [(got[i]["items"], got[i]["max_share"], got[i]["reparameterised"]) for i in range(len(texts))]
            want = rounded(plain_decontaminate(texts, items, edited))
            assert rounded(rows) == want
            held = [bool(x[0]) for x in want]
            assert any(held) and not all(held)
            assert [got[i]["contaminated"] for i in range(len(texts))] == held


def test_hits_by_item(spark):
    texts, items = made_sets(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], round(r["share"], 9), r["changed"]) for r in dc.benchmark_hits(docs, bench, edited=True).collect())
    want = sorted((i, item, round(share, 9), changed) for i, found in enumerate(plain_hits(texts, items, True)) for item, share, changed in found)
    assert got == want
    assert {x[3] for x in want} == {True, False}


def test_items_of_one_template_are_paired_once(spark):
    """A document of a template that many items share is one row, however many they are."""
    form = "When {a} counts {x} red boats and {b} counts {y} more, {a} writes the sum of both into the old book."
    rng = random.Random(4)

    def instance(k):
        a, b = rng.sample(["Anna", "Maria", "Hugo", "Olga", "Peter", "Ines"], 2)
        return form.format(a=a, b=b, x=100 + k, y=5000 + 7 * k)

    items = [(k, instance(k)) for k in range(60)]
    texts = [f"plain words before it. {items[k][1] if k % 4 == 0 else instance(900 + k)} and after {k}" for k in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    by_class, by_item, _ = dc._class_hits(docs, bench, "text", "text", edited=True)
    assert (by_class.count(), by_item.count()) == (50, 0)
    got = sorted((r["doc_id"], r["item_id"], r["changed"]) for r in dc.benchmark_hits(docs, bench, edited=True).collect())
    assert got == sorted((i, item, changed) for i, found in enumerate(plain_hits(texts, items, True)) for item, _, changed in found)
    assert len(got) == 3000 and sum(not x[2] for x in got) == 13


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    result = queries.QUERIES["op8_decontaminate"](spark, sf).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = dict(zip([d for d, _ in docs], rounded(plain_decontaminate([t for _, t in docs], items, True)), strict=True))
    assert len(result) == len(docs) == len(want)
    # the share is rounded by the query, if at all, to six places
    assert {r["doc_id"]: list(r["items"]) for r in result} == {d: x[0] for d, x in want.items()}
    assert any(x[0] for x in want.values()) and math.isfinite(sum(x[1] for x in want.values()))

"""Training-data operators against brute force and on odd inputs."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reelstack.llm import langid, toxicity
from reelstack.llm.decontaminate import decontaminate, drop_contaminated
from reelstack.llm.html_extract import extract_text, main_text
from reelstack.llm.lm_score import score_texts
from reelstack.llm.mixing import mix_sources, mixed_documents, shuffled_shards
from reelstack.llm.near_dup import drop_near_duplicates, near_duplicates
from reelstack.llm.preference import digest, format_preferences, swapped_reply_pairs
from reelstack.llm.quality_bayes import classify_quality
from reelstack.llm.quality_rules import keep_quality, quality_rules
from reelstack.llm.shared import components

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size string, row string, key string, score string"


def words(text):
    return re.findall(WORD, text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None, None, "x", None, "k", "y") for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(60)] + ["été", "A,", "b#"]
    rows = [(0, None, None, None), (1, "", "en", "a"), (2, " \n\t", "en", None), (3, "one", "en", "a"), (3, "one", "en", "a"), (None, "one two", None, "b")]
    for i in range(4, 90):
        body = [rng.choice(pool) for _ in range(rng.randint(1, 120))]
        if i % 4 == 0:
            body += body[-30:]
        if i % 5 == 0 and rows[-1][1]:
            body = rows[-1][1].split()
            body[rng.randrange(len(body))] = "edit"
        rows.append((i, "".join(w + rng.choice([" ", " ", "\n", "  "]) for w in body), rng.choice(["en", "fr"]), rng.choice(["a", "b", None])))
    return rows


def test_quality_rules_match_brute_force(spark, texts):
    got = {(r["doc_id"], r["n_words"]): r for r in quality_rules(frame(spark, texts)).collect()}
    for i, text, _, _ in texts:
        w = words(text)
        n, seen, dup = len(w), set(), 0
        at = {}
        for k in range(n - 2):
            at.setdefault(tuple(w[k : k + 3]), []).append(k)
        twice = {p for v in at.values() if len(v) > 1 for k in v for p in (k, k + 1, k + 2)}
        for line in (text or "").split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        run = [max((next((m for m in range(n) if max(a, b) + m >= n or w[a + m] != w[b + m]), n) for b in range(n) if b != a), default=0) for a in range(n)]
        cover = {p for a in range(n) if run[a] >= 8 for p in range(a, a + run[a])}
        r = got[i, n]
        assert (r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(twice))
        assert (r["covered_words"], sum(s["last"] - s["first"] + 1 for s in r["repeat_spans"])) == (len(cover), len(cover))
        assert r["base_failed"] == (n < 50 or 100 * len(twice) > 50 * n)
        assert not (r["kept"] and r["base_failed"])
    kept = keep_quality(frame(spark, texts))
    assert kept.columns == frame(spark, texts).columns
    assert kept.count() == sum(r["kept"] for r in got.values())


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_match_brute_force(spark, texts, width):
    docs = {i: t for i, t, _, _ in texts if i is not None}
    sets = {}
    for i, t in docs.items():
        w = words(lower(t))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    label = {i: i for i in docs}
    for a in docs:
        for b in docs:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((label[a], label[b]))
                label = {k: lo if v == hi else v for k, v in label.items()}
    got = near_duplicates(frame(spark, texts), width=width).collect()
    assert len(got) == len(texts)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), label[r["doc_id"]], label[r["doc_id"]] == r["doc_id"])
    left = drop_near_duplicates(frame(spark, texts), width=width)
    assert left.columns == frame(spark, texts).columns and left.count() == sum(r["kept"] for r in got)


def test_hub_with_unlike_members(spark):
    """Copies at every distance from a text: members near each other but not near the hub are still found."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(60):
        body = list(base)
        for k in rng.sample(range(200), rng.choice([3, 8, 14, 18, 22])):
            body[k] = f"e{rng.randrange(4)}"
        rows.append((i, " ".join(body), "en", "a"))
    sets = {i: {(a, b) for a, b in zip(words(t), words(t)[1:])} for i, t, _, _ in rows}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((label[a], label[b]))
                label = {k: lo if v == hi else v for k, v in label.items()}
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(frame(spark, rows), width=2).collect()}
    assert got == label and len(set(label.values())) > 1


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 60), (7, 7)], "a long, b long")
    assert {r["component"] for r in components(spark, edges).where("node <= 40").collect()} == {0}
    assert components(spark, edges.where("a > 100")).count() == 0


def test_mix_reaches_its_targets(spark, texts):
    docs = frame(spark, texts)
    rows = mix_sources(docs).collect()
    assert len(rows) == len(texts) and sorted(map(str, rows)) == sorted(map(str, mix_sources(docs).collect()))
    size, keys = Counter(), sorted({s for *_, s in texts if s is not None}) + [None]
    for _, t, _, s in texts:
        size[s] += len(words(t))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(keys)}
    capped = set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in capped)
        total = sum(weight[s] for s in keys if s not in capped)
        target = {s: 3.0 * size[s] if s in capped else rest * weight[s] / total for s in keys}
        over = {s for s in keys if target[s] > 3 * size[s] + 1e-9}
        if not over:
            break
        capped |= over
    taken = Counter()
    for r in rows:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["taken"] <= 3 * r["size"] and len(r["shards"]) == r["copies"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 160 for s in keys)
    shards = shuffled_shards(docs, mix_sources(docs))
    assert shards.count() == sum(r["copies"] for r in rows if r["doc_id"] not in (None, 3)) + sum(2 * r["copies"] for r in rows if r["doc_id"] == 3)
    assert set(docs.columns) <= set(mixed_documents(docs).columns) and mixed_documents(docs).count() == len(texts)


def test_templates_and_slots(spark):
    item = "Yesterday the baker Anna sold 12 kg of dark bread to Peter and then Anna gave 5 euros back to her old friend."
    plain = "filler words stand here before it all. "
    rows = [
        (1, plain + item, "en", "a"),
        (2, plain + item.replace("Anna", "Maria").replace("12", "40").replace("Peter", "Hugo"), "en", "a"),
        (3, plain + item.replace("Anna sold", "Maria sold"), "en", "a"),
        (4, plain * 3, "en", "a"),
        (5, None, "en", "a"),
        (6, item.upper(), "en", "a"),
    ]
    bench = spark.createDataFrame([(7, item), (8, "too short"), (9, None), (10, "")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate(frame(spark, rows), bench).collect()}
    assert {i: r["items"] for i, r in got.items()} == {1: [7], 2: [7], 3: [], 4: [], 5: [], 6: []} | ({6: [7]} if got[6]["items"] else {})
    assert got[2]["reparameterised"] and not got[1]["reparameterised"]
    assert not decontaminate(frame(spark, rows), bench.where("item_id > 99")).where("contaminated").count()
    assert drop_contaminated(frame(spark, rows), bench).columns == frame(spark, rows).columns


def test_base_scores_match_brute_force(spark, texts):
    rows = [r for r in texts if r[0] is not None and r[0] != 3]
    keep = lambda i: zlib.crc32(str(i).encode()) % 10 != 0
    count = Counter(t for i, text, *_ in rows if keep(i) for t in [*words(lower(text)), None])
    total, norm = sum(count.values()), math.log10(sum(count.values()) + 0.1 * (len(count) + 1))
    for head in (1 << 18, 20):
        got = {r["doc_id"]: r for r in score_texts(frame(spark, rows), keep=lambda i: F.crc32(i.cast("string")) % 10 != 0, head=head).collect()}
        for i, text, *_ in rows:
            t = [*words(lower(text)), None]
            r = got[i]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(count[x] > 0 for x in t), total)
            assert r["base_score"] == pytest.approx(sum(math.log10(count[x] + 0.1) - norm for x in t))
            assert r["score"] < 0


def test_toxic_words_are_learned(spark):
    rng = random.Random(2)
    calm = ["the", "river", "stone", "green", "walks", "slowly", "and", "under"]
    rows = [(i, " ".join(rng.choice(calm if rng.random() > 0.08 or i % 3 else ["vile", "scum"]) for _ in range(60)), "en", "a") for i in range(600)] + [(600, None, "en", "a"), (601, "", "en", "a")]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)] + [(0, 0), (None, 1), (999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, keep=lambda i: i % 2 == 0)
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, model).collect()}
    right = sum(got[i]["predicted"] == (i % 3 == 0) for i in range(1, 600, 2))
    assert right >= 290 and got[600]["score"] == got[601]["score"] and got[600]["predicted"] == 0
    assert toxicity.drop_toxic(docs, model).count() == sum(1 - r["predicted"] for r in got.values())
    none = toxicity.train(docs, labels.where("doc_id < 0"))
    assert toxicity.toxicity(docs, none).where("score > 0.01").count() == 0


def test_languages_and_undetermined(spark):
    rng = random.Random(3)
    vocab = {"aa": ["kalo", "mira", "tenu", "sila"], "bb": ["wrzt", "grod", "plesk", "zmor"]}
    rows = [(i, " ".join(rng.choice(vocab[k]) for _ in range(12)), k, "s") for i in range(200) for k in [("aa", "bb")[i % 2]]]
    rows += [(900, None, "aa", "s"), (901, "", "aa", "s"), (902, "12 -- 3", "bb", "s"), (903, "Ω", None, "s")]
    docs = frame(spark, rows)
    got = {r["doc_id"]: r for r in langid.detect_language(docs, langid.train(docs, keep=lambda i: i < 150)).collect()}
    assert all(got[i]["lang_pred"] == ("aa", "bb")[i % 2] for i in range(200))
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[903]["lang_pred"] in vocab
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.detect_language(docs, langid.train(docs.where("doc_id < 0"))).where("lang_pred <> 'und'").count() == 0


def test_quality_classifier_uses_sites(spark):
    rng = random.Random(5)
    rows = [(i, ("good calm words in a row " * 5 if i % 2 else "### $$$ %%% " * 8) + str(rng.random()), "en", "ab"[i % 7 > 3]) for i in range(300)] + [(301, None, None, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in classify_quality(frame(spark, rows), labels, keep=lambda i: i < 200).collect()}
    assert all(got[i]["kept"] == bool(i % 2) for i in range(300)) and 0 < got[301]["site_prior"] < 1
    assert classify_quality(frame(spark, rows), labels.where("doc_id < 0")).count() == len(rows)


def test_pages_give_their_article(spark):
    page = '<html><body><header>Top</header><nav><a href="/">Home</a></nav><div class="cookie-notice">ok</div><article><h1>T &amp; t</h1><p>One<b> two</b><br>three<p>Four<script>var a="</p>"</script></p><div class="ad">buy</div><section id="comments"><p>nice</p></section></article><footer>f</footer>'
    assert main_text(page) == "T & t\n\nOne two three\n\nFour"
    assert main_text(None) == main_text("") == "" and main_text("a < b &lt; c") == "a < b < c"
    rows = [(i, f"http://h.org/{i}", f"<body><div class='x1'><p>Same line everywhere</p></div><div class='x2'><p>Story {i} is new</p></div></body>") for i in range(20)]
    rows += [(50, None, None), (51, "odd", ""), (52, "http://h.org/52", "<p>alone</p><div")]
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story 3 is new" and (got[50], got[51], got[52]) == ("", "", "alone")


def test_preferences_share_their_prompt(spark):
    turns = [(1, 0, "user", "hi <|x"), (1, 1, "assistant", "a"), (1, 2, "user", "more"), (0, 0, "user", "hi <|x"), (0, 1, "assistant", "b"), (5, 0, "user", "no reply"), (6, 0, None, None), (6, 1, "assistant", "c"), (6, 2, "assistant", "d"), (None, 0, "user", "q")]
    conv = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r["pair_id"]: r for r in digest(format_preferences(swapped_reply_pairs(conv))).collect()}
    assert set(got) == {0, 1, 6}
    r = got[1]
    assert r["prompt"] == "<|user|>\nhi <\\|x<|end|>\n" and r["chosen_text"] == "<|assistant|>\na<|end|>\n" and r["rejected_text"] == "<|assistant|>\nb<|end|>\n"
    first, last = map(int, r["chosen_loss"].split("-"))
    assert r["chosen_text"][first:last] == "a<|end|>\n" and r["usable"] and r["n_common"] == 1
    same = format_preferences(swapped_reply_pairs(conv).select("pair_id", "chosen", F.col("chosen").alias("rejected")))
    assert same.where("usable").count() == 0


def test_empty_tables(spark):
    docs, empty = frame(spark, []), spark.createDataFrame([], "doc_id long, toxic int, quality int")
    bench = spark.createDataFrame([], "item_id long, text string")
    results = [quality_rules(docs), near_duplicates(docs), mix_sources(docs), decontaminate(docs, bench), score_texts(docs), toxicity.toxicity(docs, toxicity.train(docs, empty)), langid.detect_language(docs, langid.train(docs)), classify_quality(docs, empty)]
    results += [extract_text(spark.createDataFrame([], "page_id long, url string, html string")), format_preferences(swapped_reply_pairs(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))]
    assert [r.count() for r in results] == [0] * len(results)


def test_broken_bytes_and_repeated_ids(spark):
    raw = spark.createDataFrame([(1, b"abc\x80\x80 def\xff g and more of it"), (2, b"<html><body><p>caf\xe9 \xff text</p></body></html>")], "doc_id long, raw binary")
    docs = raw.select("doc_id", F.expr("cast(raw as string)").alias("text"), F.lit("en").alias("lang"))
    assert [r["lang_pred"] for r in langid.detect_language(docs, langid.train(docs)).collect()] == ["en", "en"]
    pages = docs.where("doc_id = 2").select(F.col("doc_id").alias("page_id"), F.lit("http://a/b").alias("url"), F.col("text").alias("html"))
    assert [r["text"] for r in extract_text(pages).collect()] == ["caf\ufffd \ufffd text"]
    many = [(1, f"word{i} common words of one id") for i in range(3000)] + [(2, "other ordinary text"), (3, "vile toxic text"), (None, "nameless")]
    rows = spark.createDataFrame(many, "doc_id long, text string").withColumns({"source": F.lit("s"), "lang": F.lit("en")})
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(rows, labels, max_toxic=5, max_ordinary=5)
    assert toxicity.toxicity(rows, model).count() == len(many)
    assert classify_quality(rows, labels, max_labelled=5).count() == len(many)
    assert score_texts(rows, warm_docs=5).count() == len(many)


def test_pairs_of_text_ids(spark):
    turns = [(c, i, r, f"{c} {i}") for c in ("2", "3", "x") for i, r in enumerate(["user", "assistant", "user", "assistant"])]
    pairs = {r["pair_id"]: r["rejected"][-1]["text"] for r in swapped_reply_pairs(spark.createDataFrame(turns, "conv_id string, turn int, role string, text string")).collect()}
    assert pairs == {"2": "3 3", "3": "2 3", "x": "x 1"}


def test_names_of_two_subjects_are_content():
    page = '<html><body><nav>menu</nav><article><h1>T</h1><div class="social-history"><p>Keep.</p></div><section id="legal-analysis"><p>And this.</p></section><div class="share-buttons">no</div></article></body></html>'
    assert main_text(page) == "T\n\nKeep.\n\nAnd this."

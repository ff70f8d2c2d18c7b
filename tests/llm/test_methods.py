"""Training-data operators: their methods against brute force, and odd rows for all of them."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelstack.llm import decontaminate as dc
from reelstack.llm import html_extract as hx
from reelstack.llm import langid, lm_score, mixing, near_dup, preference, quality_bayes, quality_rules, toxicity
from reelstack.llm.tokens import LOWER, mix64

# ---- toxicity


def grams_of(text):
    out = Counter()
    for word in text.encode().lower().split():
        padded = b"\0" * 6 + word + b" "
        out.update(padded[i - 6 : i + 1] for i in range(6, len(padded)))
    return out


def packed(gram):
    return int.from_bytes(gram, "big")


def test_kneser_ney_ratios_match_brute_force():
    toxic, plain = grams_of("vile scum vile creeps"), grams_of("the river runs the vine creeps and the stone")
    both = toxic + plain
    levels = [set(both)]
    for _ in range(6):
        levels.append({g[1:] for g in levels[-1]})
    # levels[k] holds the distinct grams without their first k bytes; continuation counts come from the next longer level

    def shared(gram):
        if not gram:
            return 1 / 257
        context = [g for g in levels[7 - len(gram)] if g[:-1] == gram[:-1]]
        count = {g: sum(h[1:] == g for h in levels[6 - len(gram)]) for g in context}
        total = sum(count.values())
        return max(count[gram] - 0.75, 0) / total + 0.75 * len(context) / total * shared(gram[1:])

    def smoothed(count, gram, below):
        same = [count[g] for g in both if g[:-1] == gram[:-1]]
        total = sum(same) + toxicity.STRENGTH
        return max(count[gram] - 0.75, 0) / total + (toxicity.STRENGTH + 0.75 * sum(c > 0 for c in same)) / total * below

    def ratio(gram):
        pooled = smoothed(both, gram, shared(gram[1:]))
        return math.log(smoothed(toxic, gram, pooled) / smoothed(plain, gram, pooled))

    grams = sorted(both, key=packed)
    keys = np.array([packed(g) for g in grams], np.uint64)
    model = toxicity.KneserNeyPair.fit(keys, np.array([toxic[g] for g in grams]), np.array([plain[g] for g in grams]))
    assert model.ratios(keys) == pytest.approx([ratio(g) for g in grams])
    text = np.frombuffer(b"Vile stone", np.uint8)
    difference, n = model.evidence(text, np.array([0, len(text)]))
    want = sum(math.log(1 + toxicity.MIX * (math.exp(sum(ratio(g) for g in grams_of(w).elements())) - 1)) for w in ("vile", "stone"))
    assert difference[0] == pytest.approx(want) and n[0] == 2


# ---- language model


def test_lm_is_a_distribution_and_splits_do_not_matter(spark):
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "omega"] + [f"x{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shape = lm_score.Shape(vocab=12, rare=5, dim=6)
    keep = lambda i: i % 10 != 0
    score = lambda d, head: {r["doc_id"]: (round(r["score"], 6), round(r["base_score"], 6)) for r in lm_score.score_texts(d, keep=keep, head=head, shape=shape).collect()}
    one = score(docs.coalesce(1), 1 << 18)
    assert one == score(docs.repartition(5), 7) and all(s < 0 for s, _ in one.values())
    counts = lm_score.word_counts(docs.select("text"), shape)
    lex = lm_score.lexicon(counts, 5, shape)
    known = {r["word"]: r["class"] for r in counts.collect()}
    assert lex.total == sum(len(t.split()) + 1 for _, t in rows) and len(lex.vocab) == 12
    model = lm_score.train(docs.select(F.col("doc_id").alias("id"), "text"), docs.limit(20).select("text"), lex)
    # over all classes after any context the probabilities add up to 1, and so do the words of a class with one unseen word
    for a, b in ((0, 3), (shape.begin, shape.begin), (14, shape.begin)):
        k = np.arange(shape.classes)
        t = lm_score.Tokens(k, k, k, k * 0, np.full(len(k), a), np.full(len(k), b))
        assert (10 ** model.log10(t)).sum() == pytest.approx(1, abs=1e-4)
    tail = [r for r in counts.where("class >= 0").collect() if np.uint64(r["word"] & 0xFFFFFFFFFFFFFFFF) not in lex.vocab]
    for c in range(shape.rare):
        own = [r["n"] for r in tail if known[r["word"]] == c]
        assert (sum(own), len(own)) == (lex.class_tokens[c], lex.class_words[c])
        total = lex.class_tokens[c] + 0.1 * (lex.class_words[c] + 1)
        assert sum(n + 0.1 for n in own) / total + 0.1 / total == pytest.approx(1)


# ---- quality


def test_longest_repeat_counts_short_ones(spark):
    text = " ".join(f"w{i}" for i in range(60)) + " w3 w4 w5 w6 w7 w8"
    row = quality_rules.quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["longest_repeat"], row["covered_words"], row["kept"]) == (6, 0, True)


def test_site_posteriors_match_brute_force(spark):
    rng = random.Random(8)
    rows = [(h, p, int(rng.random() < (0.9 if h == "a" else 0.3))) for h, p, n in (("a", "x", 40), ("a", "y", 3), ("b", "x", 25), ("b", None, 4), (None, "x", 5)) for _ in range(n)]
    got, share = quality_bayes.site_posteriors(spark.createDataFrame(rows, "host string, path string, label int"))

    def strength(groups, centres):
        n, k = sum(g[0] for g in groups), len(groups)
        spread = sum(g[0] * (g[1] / g[0] - c) ** 2 for g, c in zip(groups, centres, strict=True))
        within = sum(c * (1 - c) for c in centres) / k
        return min(max(within / max((spread - k * within) / max(n - k, 1), 1e-9) - 1, 1.0), 10_000.0)

    path = {}
    for h, p, y in rows:
        n, g = path.get((h, p), (0, 0))
        path[h, p] = (n + 1, g + y)
    host = {}
    for (h, _), (n, g) in path.items():
        host[h] = (host.get(h, (0, 0))[0] + n, host.get(h, (0, 0))[1] + g)
    total = [sum(x) for x in zip(*host.values(), strict=True)]
    base = (total[1] + 1) / (total[0] + 2)
    s = strength(list(host.values()), [base] * len(host))
    top = {h: (g + s * base) / (n + s) for h, (n, g) in host.items()}
    s = strength(list(path.values()), [top[h] for h, _ in path])
    assert share == pytest.approx(base)
    assert {(r["host"], r["path"]): r["posterior"] for r in got.collect()} == pytest.approx({k: (g + s * top[k[0]]) / (n + s) for k, (n, g) in path.items()})


# ---- near duplicates


def near_copies(n=50, seed=9):
    rng = random.Random(seed)
    base, rows = [f"b{i}" for i in range(120)], []
    for i in range(n):
        body = list(base)
        for k in rng.sample(range(120), rng.choice([2, 6, 10, 13, 15])):
            body[k] = f"e{rng.randrange(3)}"
        rows.append((i, " ".join(body)))
    return rows


def classes(rows, width):
    sets = {i: {tuple(t.split()[k : k + width]) for k in range(len(t.split()) - width + 1)} for i, t in rows}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((label[a], label[b]))
                label = {k: lo if v == hi else v for k, v in label.items()}
    return label


@pytest.mark.parametrize("part", [2, 256])
def test_groups_dealt_to_parts_lose_no_link(spark, monkeypatch, part):
    monkeypatch.setattr(near_dup, "PART", part)
    rows = near_copies()
    # excerpts of a longer text: like each other, not like it
    rng, long = random.Random(2), [f"p{i}" for i in range(300)]
    rows += [(100, " ".join(long))] + [(101 + i, " ".join(long[s : s + 180])) for i, s in enumerate([0, 4, 8, 60, 64, 110, 118])]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    want = classes(rows, 2)
    assert got == want and 1 < len(set(want.values())) < len(rows) and rng


def test_ids_that_are_no_numbers(spark):
    rows = [(f"k{i:03d}", t) for i, t in near_copies(12)] + [(None, "one two three"), ("zz", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    number = {f"k{i:03d}": i for i in range(12)}
    want = classes(near_copies(12), 2)
    got = near_dup.near_duplicates(docs, width=2).collect()
    assert {number[r["doc_id"]]: number[r["component_id"]] for r in got if r["doc_id"] in number} == want and len(got) == 14
    assert near_dup.drop_near_duplicates(docs, width=2).count() == sum(r["kept"] for r in got)


# ---- pages


def page(i, body):
    return f"<html><body><div class='top'><p>Site of all</p><p>Part {i % 2}</p></div><div class='mid'>{body}</div></body></html>"


def test_style_tree_importances_match_brute_force(spark):
    pages = [("h", page(i, f"<p>Story {i}</p><p>More of {i}</p>" + "<p>x</p>" * (i % 3))) for i in range(12)] + [("g", page(1, "<p>Else</p>")), ("g", None), ("g", "")]
    tree = hx.style_tree(spark.createDataFrame(pages, "host string, html string"), strength=0.0)
    got = {r["node"]: r for r in tree.where("host = 'h'").collect()}
    values = {}
    for _, html in pages[:12]:
        here = {(n, kind, v) for n, style, features in hx.parse(html)[1] for kind, v in [(0, 0), (1, style), *((2, f) for f in features)]}
        for n, kind, v in here:
            values.setdefault(n, {}).setdefault(kind, Counter())[v] += 1
    assert {hx._signed(n) for n in values} == set(got)
    for n, kinds in values.items():
        m = kinds[0][0]
        entropy = lambda c, m=m: -sum(x / sum(c.values()) * math.log(x / sum(c.values())) for x in c.values()) / math.log(m)
        content = 1 - sum(x * math.log(x) for x in kinds[2].values()) / (sum(kinds[2].values()) * math.log(m))
        own = content if set(kinds[1]) == {0} else hx.PRESENTATION * min(1, entropy(kinds[1])) + (1 - hx.PRESENTATION) * content
        assert got[hx._signed(n)]["importance"] == pytest.approx(own) and got[hx._signed(n)]["pages"] == m


def test_the_tree_decides_what_stays(spark):
    rows = [(i, f"http://h.org/{i}", page(i, f"<article><p>Story {i} is told</p><div class='x7'><p>Seen everywhere</p></div></article>")) for i in range(60)]
    rows += [(900, "http://new.org/", page(0, "<p>First of its host</p>")), (900, "http://new.org/", page(0, "<p>First of its host</p>")), (None, None, "<p>no host</p>")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = hx.extract_text(pages).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and text[3] == "Story 3 is told"
    # the same host's pages, and the tree of all hosts behind a host of one page
    assert text[900] == "First of its host" and text[None] == "no host"
    assert hx.main_text(rows[3][2], {}) == "Story 3 is told\n\nSeen everywhere"
    whole = spark.createDataFrame([(i, "http://same.org/", page(0, "<p>The one page</p>")) for i in range(50)], "page_id long, url string, html string")
    assert {r["text"] for r in hx.extract_text(whole).collect()} == {"Site of all\n\nPart 0\n\nThe one page"}
    joined = hx.extract_text(pages, broadcast_nodes=0).collect()
    assert sorted(map(str, joined)) == sorted(map(str, got))


def test_teasers_do_not_hide_the_body():
    body = "<p>" + "long body text " * 40 + "</p>"
    assert "long body" in hx.main_text(f"<div>{body}</div><article>teaser</article>")
    assert hx.main_text(f"<div><p>aside</p></div><article>{body}</article>").startswith("long body")


def test_deep_pages_cost_their_length():
    for open_tags in ("<div class=c>", "<p><b>", "<ul><li>", "<b><i>"):
        assert hx.main_text(open_tags * 100_000 + "deep") == "deep"


# ---- mixing


def test_tree_keeps_quotas_exact(spark):
    quota = {"sa": 700, "sb": 55, "sc": 1, "n": 0, "sd": 244}
    rows = spark.createDataFrame(list(quota.items()), "key string, m long")
    leaves = [tuple(r) for r in mixing.split_tree(rows, 3, 5).collect()]
    assert sorted(leaves) == sorted(tuple(r) for r in mixing.split_tree(rows.repartition(3), 3, 5).collect())
    for key, m in quota.items():
        assert sum(n for k, _, n in leaves if k == key) == m
    by_shard = Counter()
    for _, shard, n in leaves:
        by_shard[shard] += n
    assert set(by_shard.values()) == {1000 // 8} and len(by_shard) == 8
    # a hypergeometric draw: the largest source's share of each shard is near its share of all
    assert all(60 <= n <= 110 for k, _, n in leaves if k == "sa")


def test_mixture_is_what_the_leaves_were_dealt(spark):
    rng = random.Random(4)
    rows = [(None if i % 40 == 7 else i, " ".join("w" for _ in range(rng.randint(0, 9))), rng.choice("abc") if i % 9 else None, "mine") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    mixed = mixing.mixed_documents(docs, blocks=16, depth=2)
    assert mixed.columns[:4] == docs.columns and {"mix_size", "taken", "shards"} <= set(mixed.columns)
    got = mixed.collect()
    assert len(got) == 400 and {r["size"] for r in got} == {"mine"}
    taken, target = Counter(), {}
    for r in got:
        assert r["taken"] == r["mix_size"] * len(r["shards"]) and len(r["shards"]) == r["copies"] <= 3
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 40 for s in target)
    rows_out = mixing.mixture(docs, blocks=16, depth=2).collect()
    assert Counter((r["doc_id"], r["text"], r["source"], r["shard"]) for r in rows_out) == Counter((r["doc_id"], r["text"], r["source"], s) for r in got for s in r["shards"])
    # (docs of one source and block go to the same shards, in runs that no other block has)
    assert mixing.mixture(docs.where("doc_id < 0")).count() == 0


def test_water_level_matches_brute_force(spark):
    rng = random.Random(7)
    size = {f"s{i:02d}": rng.choice([0, 1, 5, 50, 1000]) for i in range(25)}
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(size.items()), "source string, source_size long")).collect()}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    capped = set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in capped)
        total = sum(weight[s] for s in size if s not in capped)
        over = {s for s in size if s not in capped and rest * weight[s] / total > 3 * size[s]}
        if not over:
            break
        capped |= over
    assert got == pytest.approx({s: 3.0 * size[s] if s in capped else rest * weight[s] / total for s in size})


# ---- decontamination

ITEM = "Yesterday the baker Anna sold 12 kg of dark bread to Peter and then Anna gave 5 euros back to her old friend."
PLAIN = "filler words stand here before it all. "


def held(spark, texts, items=((7, ITEM),), kind="long", **settings):
    docs = spark.createDataFrame([(str(i) if kind == "string" else i, t) for i, t in texts], f"doc_id {kind}, text string")
    bench = spark.createDataFrame(list(items), "item_id long, text string")
    return sorted((str(r["doc_id"]), r["contaminated"], r["items"]) for r in dc.decontaminate(docs, bench, **settings).collect())


def test_names_at_openings_and_in_any_case(spark):
    opening = "Anna has 12 apples in the old bag. Anna gives 3 of them away. Anna then has 9 apples left in it."
    texts = [(1, ITEM.lower() + PLAIN), (2, PLAIN + ITEM.upper()), (3, PLAIN + opening.replace("Anna", "Maria").replace("12", "40")), (4, PLAIN * 4)]
    assert held(spark, texts, ((7, ITEM), (8, opening))) == [("1", True, [7]), ("2", True, [7]), ("3", True, [8]), ("4", False, [])]


def test_short_items_and_any_ids(spark):
    texts = [(None, PLAIN + ITEM), (5, "they said blue whales sing loudly"), (6, PLAIN), (None, None), (5, PLAIN + ITEM)]
    items = ((7, ITEM), (8, "Blue whales sing"), (9, "yes"), (None, "stand here before it all"), (10, ITEM))
    # the item without an id is found, but cannot be named
    assert held(spark, texts, items) == [("5", True, [7, 10]), ("5", True, [8]), ("6", True, []), ("None", False, []), ("None", True, [7, 10])]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("digest", F.lit("own"))
    bench = spark.createDataFrame(list(items), "item_id long, text string")
    left = dc.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(None, None, "own")]
    assert held(spark, [("a", PLAIN + ITEM)], kind="string") == [("a", True, [7])]


# ---- languages


def test_character_grams_match_brute_force():
    texts = ["Été  Ünï", "", "語語a\tB"]
    raw = [t.encode() for t in texts]
    buf, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    got = langid.grams(*langid.characters(buf, off), 3, 1 << 12)
    want = Counter()
    for i, text in enumerate(texts):
        plain = "".join(c.lower() if "A" <= c <= "Z" else " " if c in "\t\n\v\f\r" else c for c in text)
        for k in (1, 2, 3):
            for at in range(len(plain) - k + 1):
                code = 0
                for c in plain[at : at + k]:
                    code = (code << 21) + ord(c) & 0xFFFFFFFFFFFFFFFF
                h = mix64(np.array([(code + (k - 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]
                want[i, int(h % np.uint64(1 << 12))] += 1
    assert {(r, b): c for r, b, c in zip(got.row.tolist(), got.bucket.tolist(), got.count.tolist(), strict=True)} == dict(want)
    assert list(langid.has_letter(*langid.characters(buf, off), 3)) == [True, False, True]


def test_ftrl_matches_dense_updates():
    rng = np.random.default_rng(1)
    x = [(np.array(sorted(rng.choice(12, 4, replace=False)), np.int32), rng.random(4).astype(np.float32)) for _ in range(15)]
    y = rng.integers(0, 3, 15)
    w = langid.ftrl(x, y, 3, 12, epochs=2)
    z, n, order = np.zeros((12, 3)), np.zeros((12, 3)), np.random.default_rng(11)
    weights = lambda: np.where(np.abs(z) <= langid.L1, 0, -(z - np.sign(z) * langid.L1) / ((langid.BETA + np.sqrt(n)) / langid.ALPHA + langid.L2))
    for _ in range(2):
        for i in order.permutation(15):
            v = np.zeros(12)
            v[x[i][0]] = x[i][1]
            now = weights()
            p = np.exp(v @ now) / np.exp(v @ now).sum()
            p[y[i]] -= 1
            g = v[:, None] * p
            z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / langid.ALPHA * now
            n += g * g
    assert w == pytest.approx(weights(), abs=1e-4)


# ---- odd rows


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(150_000))
    same = "one and the same text stands here twice over"
    rows = [(None, "null id here", "en", "a"), (1, None, None, None), (2, "", "en", "a"), (3, long, "en", "a"), (4, same, "de", "b"), (4, same, "de", "b"), (5, "x" * 300_000, "de", "b"), (6, " \n\t ", "fr", None)]
    docs = spark.createDataFrame([(*r, "own", 0.5, "h", 7) for r in rows], "doc_id long, text string, lang string, source string, digest string, score double, host string, n long")
    return docs.cache()


def test_odd_rows_have_results(spark, odd):
    labels = spark.createDataFrame([(3, 1, 1), (4, 0, 0), (4, 0, 1), (None, 1, 1), (5, None, None), (77, 1, 1)], "doc_id long, toxic int, quality int")
    bench = spark.createDataFrame([(1, "one and the same text"), (None, None), (2, "")], "item_id long, text string")
    n = odd.count()
    outputs = {
        "toxicity": toxicity.toxicity(odd, toxicity.train(odd, labels)),
        "lm": lm_score.score_texts(odd, keep=lambda i: F.coalesce(i % 2 == 0, F.lit(False)), shape=lm_score.Shape(64, 16, 4)),
        "rules": quality_rules.quality_rules(odd),
        "quality": quality_bayes.classify_quality(odd, labels),
        "near": near_dup.near_duplicates(odd),
        "mix": mixing.mix_sources(odd),
        "leaks": dc.decontaminate(odd, bench),
        "language": langid.detect_language(odd, langid.train(odd)),
    }
    for name, out in outputs.items():
        rows = out.collect()
        assert len(rows) == n, name
        twins = [str(r) for r in rows if r["doc_id"] == 4]
        assert len(twins) == 2 and twins[0] == twins[1], name
    leaks = {r["doc_id"]: r["contaminated"] for r in outputs["leaks"].collect()}
    assert leaks == {None: False, 1: False, 2: False, 3: False, 4: True, 5: False, 6: False}
    near = {r["doc_id"]: (r["component_id"], r["kept"]) for r in outputs["near"].collect()}
    assert near[None] == (None, True) and near[2] == (2, True) and near[4] == (4, True)
    for left in (toxicity.drop_toxic(odd, toxicity.train(odd, labels)), quality_rules.keep_quality(odd), near_dup.drop_near_duplicates(odd), dc.drop_contaminated(odd, bench)):
        assert left.columns == odd.columns and left.count() <= n
    assert set(odd.columns) <= set(mixing.mixture(odd).columns)


def test_odd_conversations(spark):
    turns = [(1, 0, "user", "x" * 200_000, 5), (1, 1, "assistant", None, 5), (1, 1, "assistant", None, 5), (0, 0, None, None, 5), (0, 1, "assistant", "b", 5), (None, 1, "assistant", "c", 5), (3, None, "assistant", "d", 5), (3, 2, "assistant", "e", 5)]
    conv = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, pair_id long")
    got = {r["pair_id"]: r for r in preference.digest(preference.format_preferences(preference.swapped_reply_pairs(conv))).collect()}
    assert set(got) == {0, 1, 3} and got[3]["chosen_text"].endswith("e<|end|>\n") and got[1]["n_common"] == 2
    empty = spark.createDataFrame([(1, None, None), (2, [], [])], "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    assert preference.format_preferences(empty).where("usable").count() == 0


def test_lower_table_keeps_other_bytes():
    assert LOWER[65] == 97 and LOWER[0xC3] == 0xC3

"""Line dedup, the Merkle manifest and the filter audit against plain Python, on odd rows and small limits."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from reelstack.llm import filter_audit, merkle
from reelstack.llm.filter_audit import audit_filters, fail_counts
from reelstack.llm.line_dedup import dedup_lines
from reelstack.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, line string, at int, tree string, mask int, key string, version string, part string"
SPACES = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, n, "a", "b", 1, "c", 2, "d", "e", "f") for i, t, lang, s, n in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    lines = ["a line that many have", "  A line THAT many have\t", "short", "", "Zeile, die Ünnötig oft steht", "zeile, die ünnötig oft steht", "123456789", "1234567890", "\x85not a space of ours\x85"]
    out = [(None, None, None, None, None), (None, "a line that many have", None, "x", 5), (None, "a line that many have", "en", "x", 5), (3, "", "en", None, 0), (4, None, "en", "", None)]
    out += [(7, "twin row\nof one id", "de", "x", 3), (7, "twin row\nof one id", "de", "x", 3), (7, "another text of one id\ntwin row of it", "de", "y", 4), (8, "no newline 1234567890", "é", "x", 9)]
    for i in range(20, 120):
        text = "\n".join(rng.choice(lines) if rng.random() < 0.7 else f"line {rng.randrange(40)} of no renown" for _ in range(rng.randrange(9)))
        out.append((i, text, rng.choice(["en", "de", None]), rng.choice(["x", "y", None]), rng.choice([None, 1, len(text)])))
    return out + [(200 + i, "the very same text " * 30, "en", "x", 7) for i in range(25)]


def want_lines(rows, min_chars=10, min_docs=2):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACES))

    holders = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add((i is None, i or 0))
    out = []
    for i, t, *_ in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or min(holders[key(x)]) == (i is None, i or 0)]
        out.append((i, len(every), len(every) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("min_docs", [2, 5])
def test_lines_match_plain_python(spark, rows, min_docs):
    got = dedup_lines(frame(spark, rows), min_docs=min_docs).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert Counter(map(tuple, got)) == want_lines(rows, min_docs=min_docs)


def test_lines_of_long_text_and_empty_table(spark):
    long = "\n".join(f"line number {i % 5000} of a long text" for i in range(60_000))
    got = {r["doc_id"]: r for r in dedup_lines(frame(spark, [(1, "line number 7 of a long text", None, None, None), (2, long, None, None, None)])).collect()}
    assert (got[2]["n_lines"], got[2]["n_dropped"], got[1]["n_dropped"]) == (60_000, 12, 0)
    assert dedup_lines(frame(spark, [])).collect() == []


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves, fanout):
    """Root, and each leaf's (place, siblings) by level, by recursion over whole levels."""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for k, n in enumerate(at):
            run = runs[n // fanout]
            proofs[k].append((n % fanout, run[: n % fanout] + run[n % fanout + 1 :]))
        at, level = [n // fanout for n in at], [H(*r) for r in runs]
    return level[0], proofs


def want_manifest(rows, fanout=2):
    leaf = lambda i, t, lang, s, n: H(*map(enc, (i, s, lang, n, t)))
    trees = defaultdict(list)
    for i, t, lang, s, n in rows:
        bad = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None
        trees[lang].append((i, leaf(i, t, lang, s, n), leaf(i, t, lang, s, n + 1) if bad else leaf(i, t, lang, s, n)))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for x in order:
        trees[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    subs = {x: tree([r[1] for r in trees[x]], fanout) for x in order}
    root, above = tree([subs[x][0] for x in order], fanout)
    out = []
    for x, up in zip(order, above, strict=True):
        for (i, h, claimed), proof in zip(trees[x], subs[x][1], strict=True):
            whole = proof + up
            folded = merkle.fold(claimed, whole)
            out.append((i, h, subs[x][0], root, H(*[s for _, level in whole for s in level]), folded, folded == root))
    return Counter(out)


@pytest.mark.parametrize(("fanout", "most"), [(2, 1), (2, 4), (2, 4096), (3, 3), (3, 10), (5, 1)])
def test_manifest_matches_whole_trees(spark, rows, fanout, most):
    docs = frame(spark, rows)
    leaf = merkle.digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    bad = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    changed = merkle.digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text"))
    leaves = docs.select(F.col("lang").alias("tree"), F.col("doc_id").alias("id"), leaf.alias("leaf"), F.when(bad, changed).otherwise(leaf).alias("claimed"))
    assert Counter(map(tuple, merkle.manifest(leaves, fanout, most).collect())) == want_manifest(rows, fanout)


def test_manifest_of_documents(spark, rows):
    bad = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    got = merkle.document_manifest(frame(spark, rows), bad).collect()
    assert Counter(map(tuple, got)) == want_manifest(rows)
    assert any(not r["verified"] for r in got)
    one = merkle.document_manifest(frame(spark, rows[8:9])).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof_sha256"] == H("")
    assert merkle.document_manifest(frame(spark, [])).collect() == []


def masks(rows):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, _, s, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > least[t])
        yield i, s or "", sum(1 << k for k, f in enumerate(fails) if f)


def want_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, x in labels if x == 1 and i is not None}
    out = {}
    for part in {s or "" for _, _, _, s, _ in rows}:
        mine = [(i, m) for i, s, m in masks(rows) if s == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = list(mine)
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                gone, stay = [x for x in left if x[1] & bit], [x for x in left if not x[1] & bit]
                failing = sum(1 for _, m in mine if m & bit)
                lost = lambda ids: sum(i in ids for i, _ in gone)  # noqa: B023, E731
                out[part, order, step] = (len(stay), len(gone), failing - len(gone), sum(m == bit for _, m in mine), lost(good), lost(bad))
                shapley[f] += len(gone)
                left = stay
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                out[part, order, step] += (shapley[f],)
    return out


LABELS = [(7, 1, 0), (8, 0, 1), (8, 1, None), (30, 1, 1), (30, 1, 1), (None, 1, 1), (205, 1, 0), (206, None, 1), (9999, 1, 1)]


@pytest.mark.parametrize("limits", [{}, {"heavy_bytes": 60, "range_bytes": 500}])
def test_audit_matches_plain_python(spark, rows, limits, monkeypatch):
    monkeypatch.setattr(filter_audit, "TRIE_BYTES", 3000 if limits else filter_audit.TRIE_BYTES)
    more = rows + [(300, "A# " * 60, "en", "x", 1), (301, "Ab$ " + " ".join(f"w{i}" for i in range(70)), "en", "z", 1)]
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    counts = fail_counts(frame(spark, more), labels, **limits)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in filter_audit.audit(counts).collect()}
    assert got == want_audit(more, LABELS)


def test_audit_of_empty_tables_and_text_ids(spark, rows):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters(frame(spark, []), labels).collect() == []
    named = frame(spark, rows).withColumn("doc_id", F.when(F.col("doc_id").isNotNull(), F.format_string("%05d", "doc_id")))
    got = {tuple(r)[:3]: tuple(r)[3:] for r in audit_filters(named, labels.withColumn("doc_id", F.col("doc_id").cast("string"))).collect()}
    assert got == want_audit(rows, [])


def test_trie_holds_prefixes_of_each_other():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(400)]
    trie, want = filter_audit.Trie(), {}
    for i, t in enumerate(texts):
        trie.terminal(t, 0, i).add(i, Counter({("", 0, 0): 1}), Counter({("", 0, 0): 1}))
        want.setdefault(t, i)
    found = dict(trie.terminals())
    assert {t: x.least for t, x in found.items()} == want
    assert {t: sum(x.kinds.values()) for t, x in found.items()} == Counter(texts)


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_merkle_manifest", "op13_filter_audit"])
def test_queries_equal_their_sql_on_odd_rows(spark, rows, name, tmp_path):
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    ours = QUERIES[name](spark, str(tmp_path))
    theirs = con.execute(f"select {', '.join(ours.columns)} from ({ORACLE_SQL[name]})").fetchall()
    assert Counter(map(tuple, ours.collect())) == Counter(theirs)

"""The rows of the mixture: copies taken, none left out, sources at their targets."""

from collections import Counter, defaultdict

import corpus_pipeline
from reelstack.llm.mixing import dealt_copies, mixed_documents

SF = "/root/testdata/sf0.001"


def taken(docs):
    return Counter({(r["doc_id"], r["text"]): r["copies"] for r in docs.collect() if r["copies"]})


def test_one_row_per_copy(spark):
    rows = [(i, "word " * (i % 9 + 1), ("a", "b", "c")[0 if i < 80 else 1 + i % 2]) for i in range(100)] + [(None, "x y", "a"), (5, "twice", "b")]
    mixed = mixed_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    out = dealt_copies(mixed)
    got = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == taken(mixed)
    assert {r["copies"] for r in mixed.collect()} > {r["copies"] for r in got} > {1}
    assert all(r["shards"][r["copy"]] == r["shard"] for r in got)


def test_pipeline_returns_the_mixture(spark):
    out = corpus_pipeline.run(spark, SF)
    got, words, target = out.collect(), defaultdict(int), {}
    assert got and {"shard", "copy"} <= set(out.columns)
    assert Counter(Counter((r["doc_id"]) for r in got).values()).keys() > {1}
    for r in got:
        assert r["copies"] > 0
        words[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    most = max(r["size"] for r in got)
    assert all(abs(words[s] - target[s]) <= most for s in target)

"""The pipeline as a whole on odd rows, on empty tables, and with further columns of clashing names."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, id string, size long, score double, label int, digest string, component string"


def stored(spark, path, rows, labels, items):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_pipeline_on_odd_rows(spark, tmp_path):
    rng = random.Random(4)
    more = (True, "x", 5, 0.5, 1, "d", "c")
    prose = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu").capitalize() if rng.random() < 0.1 else f"word{rng.randrange(900)}" for _ in range(n))
    plain, item = prose(120), "the baker sold twelve loaves of dark bread to his old friend before noon on market day"
    rows = [(0, None, None, None, None), (None, prose(90), None, None, 3), (1, "", "en", "a", 0), (2, " \n\t", "en", "a", 3), (3, "one", "en", "a", 3), (4, "same " * 400, "en", "a", None)]
    rows += [(10, plain, "en", "a", 1), (11, plain, "en", "a", 1), (11, plain, "en", "a", 1), (12, plain + " and more", "en", "b", 1), (20, f"{prose(60)} {item} {prose(60)}", "en", "b", 1)]
    rows += [(30 + i, prose(80), "en", rng.choice(["a", "b", None]), 1) for i in range(20)] + [(60, prose(30_000), "en", "a", 1)]
    labels = [(30, 1, 0), (31, 1, 1), (None, 1, 1), (32, None, None)]
    sf = stored(spark, tmp_path, [r + more for r in rows], labels, [(1, item), (2, None), (None, "x"), (3, "")])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    left = [r["doc_id"] for r in docs.collect()]
    assert set(left) >= {30, 32, 10, 60, None} and not set(left) & {0, 1, 2, 3, 4, 11, 12, 20}
    taken = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert taken and taken <= set(left)


def test_pipeline_on_empty_tables(spark, tmp_path):
    sf = stored(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0

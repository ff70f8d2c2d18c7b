"""The corpus pipeline against its stages' operators, applied one by one."""

from pyspark.sql import functions as F

import corpus_pipeline
from reelstack.llm import toxicity
from reelstack.llm.decontaminate import decontaminate
from reelstack.llm.mixing import mix_sources
from reelstack.llm.near_dup import near_duplicates
from reelstack.llm.quality_rules import quality_rules

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_their_operators_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    kept = {
        "quality_rules": lambda d: quality_rules(d).where("kept"),
        "toxicity": lambda d: toxicity.toxicity(d, toxicity.train(d, labels)).where("predicted = 0"),
        "near_dedup": lambda d: near_duplicates(d).where("kept"),
        "decontamination": lambda d: decontaminate(d, bench).where("not contaminated"),
        # the mixture has a row for each copy taken, none for documents that are left out
        "mixing": lambda d: mix_sources(d).select("doc_id", F.explode("shards")),
    }
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        ids = sorted(r["doc_id"] for r in out.select("doc_id").collect())
        assert ids == sorted(r["doc_id"] for r in kept[name](docs).select("doc_id").collect()) and ids
        assert name == "mixing" or out.columns == columns
        docs = out
    assert {"taken", "target", "shards"} <= set(docs.columns)

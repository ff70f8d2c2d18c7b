"""Registered queries against their SQL twins on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from reelstack import registry

SF = "/root/testdata/sf0.001"
NAMES = ["eligibility", "effective_tags", "bm25_topk", "dense_topk", "vector_coverage", "transcript_selection", "uncovered_ranges", "scene_mapping", "keyframe_plan", "ocr_merge", "rekey_rules", "latest_run", "status_counts", "evidence_rollup", "upsert_tags", "soft_delete", "run_summary", "subtitle_cues", "dq_report", "scene_tiling", "structured_score", "hybrid_search", "replay_diff", "bm25_fields_coverage", "embedding_health", "slot_scores", "stray_tokens", "value_spans", "revised_rules", "index_readiness", "strict_records"]


def plain(value):
    if value is None or value != value:
        return None
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    ours = registry.QUERIES[name](spark, SF)
    cols = sorted(ours.columns)
    rows = sorted(tuple(map(str, map(plain, r))) for r in ours.select(*[f"`{c}`" for c in cols]).collect())
    theirs = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({registry.ORACLE_SQL[name]})").fetchall()
    assert rows == sorted(tuple(map(str, map(plain, r))) for r in theirs)


def test_every_twin_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0

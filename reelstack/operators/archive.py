"""The archive's records: readiness, inputs of extraction, bulk updates, rule revisions, gold sets and their faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that a finished search must carry.
SNAPSHOT = ("normalized_query", "explicit_filters", "normalized_filters", "fingerprint", "version", "degraded_reasons", "applied_excludes", "config", "config_version")


def optional_filter(rows: DataFrame, **wanted) -> DataFrame:
    """Rows that have the values given; a parameter that is null restricts nothing."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column) == F.lit(value))
    return rows


def visible_history(rows: DataFrame, owner) -> DataFrame:
    """Finished searches of an owner that are originals (no replay), roots (no later page) and not hidden."""
    return rows.where((F.col("owner") == owner) & (F.col("status") == "finished") & F.col("original_id").isNull() & (F.col("page") == 1) & F.col("hidden_at").isNull())


def media_of(scene: DataFrame, wanted: DataFrame) -> DataFrame:
    """Media key and range of wanted scenes of clips that are not deleted, in their active run."""
    live = scene.where("deleted_at is null and run_id = active_run_id")
    return wanted.join(live, "scene_id").select("scene_id", F.concat(F.lit("clips/"), "clip_id", F.lit("/"), "run_id").alias("media_key"), "start_ms", "end_ms")


def index_readiness(scene: DataFrame, observed: DataFrame, embedded: DataFrame, key: str = "clip_id") -> DataFrame:
    """Per clip: scenes, scenes whose caption has tokens, scenes with dialogue, scenes with a readable observation, scenes with a vector.

    ``scene``: key, scene_id, caption_tokens, dialogue; ``observed`` and ``embedded``: scene_id.
    """
    flag = lambda df, name: df.select("scene_id").distinct().withColumn(name, F.lit(True))
    rows = scene.join(flag(observed, "seen"), "scene_id", "left").join(flag(embedded, "embedded"), "scene_id", "left")
    return rows.groupBy(key).agg(
        F.count("*").alias("scenes"), F.count_if(F.size("caption_tokens") > 0).alias("caption_scenes"), F.count_if(F.trim("dialogue") != "").alias("dialogue_scenes"),
        F.count_if("seen").alias("ocr_scenes"), F.count_if("embedded").alias("embedded_scenes"),
    )


def first_frames(frames: DataFrame, scene: str = "scene_id") -> DataFrame:
    """The frame of least id of each scene, with its time."""
    return frames.groupBy(scene).agg(F.min_by("ts_ms", "keyframe_id").alias("ts_ms"), F.min("keyframe_id").alias("keyframe_id"))


def entity_inputs(groups: DataFrame, links: DataFrame, tags: DataFrame) -> DataFrame:
    """(scene_id, label, kind, ref, text): what entity extraction reads of each scene.

    Representatives of merged screen texts (scene_id, ref, text) become ``ocr_n``, linked selected segments that really overlap (scene_id, ref, text, overlap_ms)
    ``tr_n``, caption tags (scene_id, ref, text) ``tag_n``; numbers run by scene in the order of the references.
    """
    parts = [("ocr", groups), ("tr", links.where("overlap_ms > 0")), ("tag", tags)]
    rows = None
    for kind, part in parts:
        one = part.select("scene_id", F.lit(kind).alias("kind"), "ref", "text")
        rows = one if rows is None else rows.unionByName(one)
    n = F.row_number().over(Window.partitionBy("scene_id", "kind").orderBy("ref"))
    return rows.select("scene_id", F.concat_ws("_", "kind", n).alias("label"), "kind", "ref", "text")


def updated(rows: DataFrame, keys: DataFrame, key: str, when: Column, **values) -> DataFrame:
    """Rows with columns set where ``when`` holds and the key is among ``keys``; all others as they were."""
    hit = rows.join(keys.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    changed = F.coalesce(F.col("_hit") & when, F.lit(False))
    return hit.withColumns({c: F.when(changed, v).otherwise(F.col(c)) for c, v in values.items()}).drop("_hit").select(rows.columns)


def revised_rules(active: DataFrame, candidates: DataFrame) -> DataFrame:
    """Active rules (rule_id, report_id, request_key, replaces, scene_id) after candidates: each request of a report is taken once, first come first, and retires what it replaces.

    A request that is known already adds nothing; a candidate without a request key is bound by no request.
    """
    turn = F.row_number().over(Window.partitionBy("report_id", "request_key").orderBy("rule_id"))
    once = candidates.withColumn("_n", F.when(F.col("request_key").isNull(), 1).otherwise(turn)).where("_n = 1").drop("_n")
    new = once.join(active.select("report_id", "request_key").where("request_key is not null").distinct(), ["report_id", "request_key"], "left_anti").select(candidates.columns)
    retired = new.where("replaces is not null").select(F.col("replaces").alias("rule_id")).distinct()
    return active.join(retired, "rule_id", "left_anti").select(active.columns).unionByName(new.select(active.columns))


def snapshot_faults(searches: DataFrame, columns: tuple[str, ...] = SNAPSHOT) -> DataFrame:
    """(search_id, missing): finished searches that lack part of their snapshot."""
    lacking = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
    return searches.where("status not in ('running', 'failed')").select("search_id", F.array_join(lacking, ",").alias("missing")).where("missing <> ''")


def frame_floor_faults(scenes: DataFrame, chosen: DataFrame, least: int) -> DataFrame:
    """(scene_id, expected, chosen): scenes with fewer chosen frames than ``least``, or than they have (first_frame, last_frame)."""
    n = chosen.groupBy("scene_id").agg(F.countDistinct("frame_no").alias("chosen"))
    expected = F.least(F.lit(least), F.greatest(F.lit(0), F.col("last_frame") - F.col("first_frame") + 1)).cast("long")
    rows = scenes.withColumn("expected", expected).join(n, "scene_id", "left").na.fill(0, ["chosen"])
    return rows.where("chosen < expected").select("scene_id", "expected", "chosen")


def embedding_split_faults(scenes: DataFrame, embedded: DataFrame, skipped: DataFrame) -> DataFrame:
    """(fault, n) where embedded and skipped scenes do not part the scenes between them."""
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("fault"), "n")
    ids = [df.select("scene_id").distinct() for df in (scenes, embedded, skipped)]
    both = ids[1].join(ids[2], "scene_id", "left_semi")
    neither = ids[0].join(ids[1].union(ids[2]), "scene_id", "left_anti")
    foreign = ids[1].union(ids[2]).join(ids[0], "scene_id", "left_anti")
    return one("in_both", both).unionByName(one("in_neither", neither)).unionByName(one("unknown_scene", foreign))


def count_faults(stored: DataFrame, counted: DataFrame, key: str, total: str, columns: list[str]) -> DataFrame:
    """(key, fault): stored counts that exceed the number of scenes or differ from what is counted."""
    pairs = stored.join(counted.select(key, *[F.col(c).alias(f"_{c}") for c in [total, *columns]]), key)
    faults = [F.when(F.col(c) > F.col(total), F.lit(f"{c}_exceeds")) for c in columns] + [F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(f"{c}_differs")) for c in columns]
    return pairs.select(key, F.explode(F.array_compact(F.array(*faults))).alias("fault"))


def gold_faults(gold: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(gold_id, fault) of gold labels (gold_id, text, kind, value, start, window_start, window_end): blank text, unknown kind, a span that is not the value, a date window other than its span's."""
    from reelstack.functions.text import period_end, period_start

    there = F.substring(F.col("text"), F.col("start") + 1, F.length("value")) == F.col("value")
    window = (period_start("value") == F.col("window_start")) & (period_end("value") == F.col("window_end"))
    faults = F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim("text") == "", F.lit(True)), F.lit("blank_text")),
            F.when(~F.coalesce(F.col("kind").isin(vocabulary), F.lit(False)), F.lit("unknown_kind")),
            F.when(F.col("start").isNotNull() & ~F.coalesce(there, F.lit(False)), F.lit("span_not_in_text")),
            F.when((F.col("kind") == "date") & ~F.coalesce(window, F.lit(False)), F.lit("window_differs")),
        )
    )
    return gold.select("gold_id", F.explode(faults).alias("fault"))


def gold_sets(docs: DataFrame, relevant: DataFrame, hard: Column, size: int, seed: int = 0) -> DataFrame:
    """(kind, doc_id, relevant): three corpora of documents (id, text) with their relevant ones: curated (the relevant documents), hard (one category, by ``hard``) and broad (a seeded random sample of ``size``).

    Documents of blank text are in none, nor relevant.
    """
    rows = docs.where(F.trim("text") != "").withColumn("hard", hard)
    right = relevant.select("doc_id").distinct().withColumn("relevant", F.lit(True))
    marked = rows.join(right, "doc_id", "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))
    drawn = marked.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "doc_id").cast("binary")), "doc_id").limit(size)
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), "doc_id", "relevant")
    return named(marked.where("relevant"), "curated").unionByName(named(marked.where("hard"), "hard")).unionByName(named(drawn, "broad"))


def candidate_quality(candidates: DataFrame, *group: str) -> DataFrame:
    """Per group: candidates (value, type, start, text_id, claimed_id, unverified), distinct ones, shares with a span, with a type, with the right source, on unverified text."""
    share = lambda hit, of=None: F.round(F.count_if(hit) / F.nullif(F.count("*") if of is None else F.count_if(of), F.lit(0)), 6)
    claimed = F.col("claimed_id").isNotNull()
    return candidates.groupBy(*group).agg(
        F.count("*").alias("candidates"),
        F.countDistinct(F.struct("value", "type")).alias("unique_values"),
        share(F.col("start").isNotNull()).alias("grounded"),
        share(F.col("type").isNotNull()).alias("typed"),
        share(claimed & F.col("claimed_id").eqNullSafe(F.col("text_id")), claimed).alias("source_correct"),
        share(F.col("unverified")).alias("on_unverified"),
    )


def typed_spans(spans: DataFrame, labels: dict[str, str], floor: float) -> DataFrame:
    """Spans (text, start, end, label, confidence) as candidates: ``type`` by the label map (others are dropped), ``value`` cut from the text, none below the floor or blank."""
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    made = spans.withColumns({"type": names[F.col("label")], "value": F.trim(F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")))})
    return made.where(F.col("type").isNotNull() & (F.col("confidence") >= floor) & (F.col("value") != ""))


def parsed_records(rows: DataFrame, json_col: str, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of JSON texts under a strict schema: text that is no object of the schema's types, or lacks a required field, is rejected with its reason."""
    read = rows.withColumn("_r", F.from_json(json_col, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"_r.{c}").isNull(), F.lit(c)) for c in required])), ",")
    reason = F.when(F.col("_r").isNull() | F.col("_r._bad").isNotNull(), "malformed").when(missing != "", F.concat(F.lit("missing:"), missing))
    judged = read.withColumn("reason", reason)
    others = [c for c in rows.columns if c != json_col]
    return judged.where("reason is null").select(*others, "_r.*").drop("_bad"), judged.where("reason is not null").select(*others, "reason")


def graded_metrics(per_query: DataFrame, level: str, *metrics: str) -> DataFrame:
    """Means of per-query metrics by level, and pooled over all levels (level null)."""
    mean = [F.round(F.avg(m), 6).alias(m) for m in metrics]
    return per_query.groupingSets([[F.col(level)], []], F.col(level)).agg(F.count("*").alias("n"), *mean)


def verdict_counts(rows: DataFrame, verdict: str, *dimensions: str) -> DataFrame:
    """(dimension, value, verdict, n): verdicts by each dimension apart, in one pass."""
    long = rows.select(verdict, F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])).alias("x"))
    return long.groupBy("x.dimension", "x.value", verdict).agg(F.count("*").alias("n"))


def range_faults(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): rows that break each named rule; a rule that is null for a row is not broken."""
    counts = rows.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("n")) for name in rules])).alias("x")).select("x.*")


def link_faults(links: DataFrame, segments: DataFrame) -> DataFrame:
    """(fault, n) of links (scene_id, segment_id, overlap_ms) against judged segments (segment_id, selected, start, end): to segments that were not selected, or longer than the segment."""
    both = links.join(segments.select("segment_id", "selected", (F.col("end") - F.col("start")).alias("size")), "segment_id", "left")
    return range_faults(both, {"not_selected": F.coalesce("selected", F.lit(False)), "too_long": F.coalesce(F.col("overlap_ms") <= F.col("size"), F.lit(False))}).withColumnRenamed("rule", "fault")

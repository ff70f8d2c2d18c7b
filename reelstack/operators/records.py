"""Records around a search or a run: stage states, pages, windows, validity, embedding rank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATE = "map<string, struct<status:string, attempts:int, error:string, started:string, finished:string>>"


def stage_states(runs: DataFrame, key: str, json_col: str) -> DataFrame:
    """One row per run and stage of a JSON object of stage states, with its seconds; a run without states, or whose text is no object, has one row of null stage."""
    parsed = runs.select(key, F.from_json(json_col, STATE).alias("states"))
    rows = parsed.select(key, F.explode_outer("states").alias("stage", "state")).select(key, "stage", "state.*")
    took = F.unix_timestamp(F.try_to_timestamp("finished")) - F.unix_timestamp(F.try_to_timestamp("started"))
    return rows.withColumn("seconds", F.when(took >= 0, took))


def availability(states: DataFrame, key: str, expected: list[str], channels: dict[str, str] | None = None) -> DataFrame:
    """Per run: failed stages, missing stages, missing channels (``channels``: stage to channel), seconds, the first failure's reason, and its ``availability``.

    ``available`` if all is done, ``partial`` if anything is, else ``unavailable``; ``legacy`` for runs that recorded no stages.
    """
    failed = F.col("status") == "failed"
    of = F.create_map(*[F.lit(x) for pair in (channels or {"": ""}).items() for x in pair])
    done = F.array_compact(F.collect_set(F.when(F.col("status") == "done", F.col("stage"))))
    per = states.groupBy(key).agg(
        F.array_join(F.array_sort(F.array_compact(F.collect_set(F.when(failed, F.col("stage"))))), ",").alias("failed"),
        F.array_join(F.array_except(F.array(*map(F.lit, expected)), F.array_compact(F.collect_set("stage"))), ",").alias("missing"),
        F.array_join(F.array_sort(F.array_except(F.map_values(of), F.transform(done, lambda x: of[x]))), ",").alias("missing_channels"),
        F.count_if(F.col("status") == "done").alias("done"),
        F.count("stage").alias("_stages"),
        F.sum("seconds").alias("seconds"),
        F.min(F.when(failed, F.struct("stage", "error"))).alias("_first"),
    )
    state = F.when(F.col("_stages") == 0, "legacy").when((F.col("failed") == "") & (F.col("missing") == ""), "available").when(F.col("done") > 0, "partial").otherwise("unavailable")
    return per.withColumns({"availability": state, "reason": F.col("_first.error")}).drop("_stages", "_first")


def offset_page(rows: DataFrame, order: list, offset: int, size: int) -> DataFrame:
    """Rows of a page with the count of all rows."""
    total = rows.agg(F.count("*").alias("total")).withColumn("one", F.lit(1))
    return rows.orderBy(*order).offset(offset).limit(size).withColumn("one", F.lit(1)).join(F.broadcast(total), "one").drop("one")


def overridden(resolved: DataFrame, explicit: DataFrame, keys: list[str]) -> DataFrame:
    """Resolved windows without those that an explicit filter of the same field replaces, and the explicit ones."""
    return resolved.join(explicit.select(keys).distinct(), keys, "left_anti").unionByName(explicit)


def inside_ranges(points: DataFrame, ranges: DataFrame, key: str, at: str, width: int) -> DataFrame:
    """Points (key, at) with the ranges (key, start, end) that hold them, ``start <= at < end``; joined by key and time slot."""
    slotted = ranges.withColumn("_slot", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    return points.withColumn("_slot", F.floor(F.col(at) / width)).join(slotted, [key, "_slot"]).where((F.col(at) >= F.col("start")) & (F.col(at) < F.col("end"))).drop("_slot")


def activated(active: DataFrame, ready: DataFrame) -> DataFrame:
    """(clip_id, run_id, transcript_source, changed): each clip's newest ready run, with its transcript source, if it is newer than the active one, else the active one."""
    newest = ready.groupBy("clip_id").agg(F.max("run_id").alias("ready_run"), F.max_by("transcript_source", "run_id").alias("ready_source"))
    both = active.join(newest, "clip_id", "left")
    newer = F.coalesce(F.col("ready_run") > F.col("run_id"), F.lit(False))
    pick = lambda new, old: F.when(newer, F.col(new)).otherwise(F.col(old)).alias(old)
    return both.select("clip_id", pick("ready_run", "run_id"), pick("ready_source", "transcript_source"), newer.alias("changed"))


def rank_faults(results: DataFrame, key: str, rank: str) -> DataFrame:
    """Keys whose ranks do not run from 1 without a gap."""
    placed = results.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(rank)))
    return placed.where(F.col("_n") != F.col(rank)).select(key).distinct()


def selection_faults(judged: DataFrame) -> DataFrame:
    """Segments decided twice, selected with a conflict, or dropped without one."""
    twice = judged.groupBy("segment_id").count().where("count > 1").select("segment_id")
    return twice.union(judged.where("selected = (conflicts <> '')").select("segment_id")).distinct()


def unfounded_exclusions(judged: DataFrame, tiers: list[str]) -> DataFrame:
    """Segments (clip_id, segment_id) that were dropped although no selected segment of a higher tier overlaps them, checked on the intervals themselves."""
    from reelstack.operators.intervals import overlaps

    place = F.array_position(F.array(*map(F.lit, tiers)), F.col("source"))
    ranked = judged.withColumn("tier", place)
    upper = ranked.where("selected").select("clip_id", F.col("tier").alias("r_tier"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    dropped = ranked.where("not selected").select("clip_id", "segment_id", "tier", "start", "end")
    founded = overlaps(dropped, upper).where("r_tier < tier").select("clip_id", "segment_id")
    return dropped.select("clip_id", "segment_id").join(founded.distinct(), ["clip_id", "segment_id"], "left_anti")


def pending_rules(rules: DataFrame) -> DataFrame:
    """Per report: rules that are neither active nor rejected, and the newest of them."""
    return rules.where("not active and not rejected").groupBy("report_id").agg(F.count("*").alias("pending"), F.max("rule_id").alias("newest"))


def typed_path(text, path: str, pattern: str, kind: str):
    """A value of a JSON text at a path, cast to ``kind``; null unless the text there looks like the pattern."""
    raw = F.get_json_object(text, path)
    return F.when(raw.rlike(pattern), raw.try_cast(kind))


def effective_rank(vectors: DataFrame, vector: str) -> DataFrame:
    """Exponential of the entropy of the normalised singular values, from Gram matrices summed over partitions.

    A partition yields the upper triangle of one matrix of the vectors' dimension squared, whatever its rows.
    """

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            x = np.array(batch["v"].tolist(), float)
            if len(x):
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pd.DataFrame({"i": i, "j": j, "s": total[i, j]})

    sums = vectors.select(F.col(vector).alias("v")).mapInPandas(gram, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    # one matrix of fixed size for one task
    whole = sums.groupBy(F.lit(1).alias("one")).agg(F.collect_list(F.struct("i", "j", "s")).alias("cells"))

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cells in batch["cells"]:
                d = max(c["j"] for c in cells) + 1
                g = np.zeros((d, d))
                for c in cells:
                    g[c["i"], c["j"]] = g[c["j"], c["i"]] = c["s"]
                p = np.sqrt(np.clip(np.linalg.eigvalsh(g), 0, None))
                p = p[p > 0] / p.sum()
                yield pd.DataFrame({"dimension": [d], "effective_rank": [round(float(np.exp(-(p * np.log(p)).sum())), 4)]})

    return whole.mapInPandas(rank, "dimension int, effective_rank double")

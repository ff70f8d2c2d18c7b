"""Table-shaped preparation steps around models: speech, captions, entities, grounding, validation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words by which a model says that there is nothing to say.
ABSENT = ("none", "n/a", "na", "null", "unknown", "not visible", "no text", "-")


def speech_segments(raw: DataFrame) -> DataFrame:
    """Recognised segments in ms (start_s, end_s, logprob, text): blank and degenerate ones dropped, confidence ``exp(logprob)`` in [0, 1]."""
    ms = lambda c: F.rint(F.col(c) * 1000).cast("long")
    rows = raw.withColumns({"start": ms("start_s"), "end": ms("end_s"), "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp("logprob"))), "text": F.trim("text")})
    return rows.where("text <> '' and start < end").drop("start_s", "end_s", "logprob")


def scene_text(caption: Column, dialogue: Column) -> Column:
    """Text of a scene to embed: caption, then dialogue, on a line each; null if both are blank."""
    return F.nullif(F.concat_ws("\n", F.nullif(F.trim(caption), F.lit("")), F.nullif(F.trim(dialogue), F.lit(""))), F.lit(""))


def linked_text(links: DataFrame, key: str = "scene_id") -> DataFrame:
    """Transcript of each scene: its linked segments (start, segment_id, text) in order, one blank between."""
    one = F.array_sort(F.collect_list(F.struct("start", "segment_id", "text")))
    return links.groupBy(key).agg(F.array_join(F.transform(one, lambda x: x["text"]), " ").alias("transcript"))


def folded_candidates(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates of one key folded: greatest confidence, distinct evidence, the first one's display value."""
    return candidates.groupBy(*keys).agg(
        F.max("confidence").alias("confidence"),
        F.array_join(F.array_sort(F.collect_set("evidence")), ",").alias("evidence"),
        F.min_by("value", F.col("position")).alias("value"),
        F.count("*").alias("n"),
    )


def within_budget(items: Column, budget: int, gap: int = 1) -> Column:
    """Items (structs with ``text``) taken in order while they fit the character budget; one that does not fit is skipped, later ones may fit.

    Each choice depends on the room left: a fold.
    """
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        size = F.length(x["text"]) + F.when(F.size(acc["kept"]) > 0, gap).otherwise(0)
        fits = acc["used"] + size <= budget
        return F.when(fits, F.struct((acc["used"] + size).alias("used"), F.concat(acc["kept"], F.array(x["text"])).alias("kept"))).otherwise(acc)

    return F.aggregate(items, start, step, lambda acc: acc["kept"])


def absent(value: Column) -> Column:
    """Whether a value only says that there is none."""
    return F.coalesce(F.lower(F.trim(value)).isin(*ABSENT) | (F.trim(value) == ""), F.lit(True))


def empty_shape(value: Column) -> Column:
    """Whether a value is an empty list, object or string as a model writes it: no word for nothing, but nothing."""
    return F.coalesce(F.trim(value).isin("[]", "{}", '""', '[""]', "[null]"), F.lit(False))


def validated(outputs: DataFrame, types: list[str], most: int) -> DataFrame:
    """Scenes with ``accepted`` and ``reason``: a scene is rejected whole for a type outside the vocabulary, evidence that is not among its labels, or too many values.

    ``outputs``: scene_id, values array<struct<type,evidence>>, labels array<string>.
    """
    unknown = F.exists("values", lambda v: ~v["type"].isin(types))
    loose = F.exists("values", lambda v: ~F.array_contains(F.col("labels"), v["evidence"]))
    reason = F.when(F.size("values") > most, "too_many").when(unknown, "unknown_type").when(loose, "missing_evidence")
    return outputs.select("scene_id", reason.isNull().alias("accepted"), reason.alias("reason"))


def best_per_slot(frames: DataFrame, *slot: str) -> DataFrame:
    """Best frame of each slot: not blank first, sharpest, earliest."""
    w = Window.partitionBy(*slot).orderBy("blank", F.desc("sharpness"), "ts_ms")
    return frames.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _by_scene(rows: DataFrame, columns: list[str], pick: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """``pick`` of each scene's rows, in batches of scenes: a scene is one row with an array, so a task makes no frame of its own for each of many small scenes."""
    names = [f.split()[0] for f in schema.split(", ")]
    scenes = rows.groupBy("scene_id").agg(F.collect_list(F.struct("scene_id", *columns)).alias("rows")).select("rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [r for scene in b.column(0).to_pylist() for r in pick(scene)]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], pa.int64()) for n in names], names=names)

    return scenes.mapInArrow(run, schema)


def without_reuse(frames: DataFrame) -> DataFrame:
    """One frame per slot of a scene, none twice: slots in order take their best free candidate.

    ``frames``: scene_id, slot, frame_no, sharpness. Sequential within a scene, whose frames are one bounded group.
    """

    def pick(scene: list[dict]) -> list[dict]:
        taken: dict[int, dict] = {}
        slots = set()
        for r in sorted(scene, key=lambda r: (r["slot"], -r["sharpness"], r["frame_no"])):
            if r["slot"] not in slots and r["frame_no"] not in taken:
                slots.add(r["slot"])
                taken[r["frame_no"]] = r
        return list(taken.values())

    return _by_scene(frames, ["slot", "frame_no", "sharpness"], pick, "scene_id long, slot long, frame_no long")


def _farthest(near: np.ndarray, allowed: np.ndarray) -> int:
    """The allowed place that is farthest from all that is kept; the earliest on a tie."""
    return int(np.argmax(np.where(allowed, near, -np.inf)))


def differing(distance: np.ndarray, blank: np.ndarray, least: float, most: int, fewest: int) -> np.ndarray:
    """Places, in order, of the frames to keep, from the distances between all frames of a scene in time order.

    The seed is the middle frame, or the nearest one that is not blank. Going through the others in time, a frame that is not blank is kept if it is ``least`` away from every
    kept one. More than ``most`` are thinned to the seed and those that lie farthest apart; less than ``fewest`` are filled up with the rest, blank
    ones last, farthest first. A blank frame differs from all others, so its distance never speaks for it. Where a distance is missing, nothing is judged and all are kept.
    """
    n = len(blank)
    if n <= fewest or np.isnan(distance).any():
        return np.arange(n)
    usable = np.flatnonzero(~blank)
    seed = n // 2 if blank[n // 2] and not len(usable) else int(usable[np.argmin(np.abs(usable - n // 2))])
    kept, near = [seed], distance[seed].copy()
    for k in usable:
        if k != seed and near[k] >= least:
            kept.append(int(k))
            near = np.minimum(near, distance[k])
    if len(kept) > most:
        left = np.zeros(n, bool)
        left[kept[1:]] = True
        kept, near = [seed], distance[seed].copy()
        while len(kept) < most:
            far = _farthest(near, left)
            kept.append(far)
            left[far], near = False, np.minimum(near, distance[far])
    left = np.ones(n, bool)
    left[kept] = False
    near = distance[kept].min(0)
    while len(kept) < fewest and left.any():
        far = _farthest(near, left & ~blank if (left & ~blank).any() else left)
        kept.append(far)
        left[far], near = False, np.minimum(near, distance[far])
    return np.sort(np.array(kept))


def diverse(frames: DataFrame, least: float = 27.0, most: int = 5, fewest: int = 2) -> DataFrame:
    """Frames (scene_id, frame_no) of each scene that differ enough, by ``differing``.

    ``frames``: scene_id, frame_no, ts_ms, blank, descriptor (array<double>, null where it was not measured); distances are mean absolute differences. A scene's chosen frames, a
    handful by design, are one group.
    """

    def pick(scene: list[dict]) -> list[dict]:
        scene = sorted(scene, key=lambda r: (r["ts_ms"], r["frame_no"]))
        sizes = {len(r["descriptor"] or ()) for r in scene}
        distance = np.full((len(scene), len(scene)), np.nan)
        if len(sizes) == 1 and 0 not in sizes:
            x = np.array([r["descriptor"] for r in scene], float)
            distance = np.stack([np.abs(x - row).mean(1) for row in x])
        return [scene[k] for k in differing(distance, np.array([r["blank"] for r in scene], bool), least, most, fewest)]

    return _by_scene(frames, ["frame_no", "ts_ms", "blank", "descriptor"], pick, "scene_id long, frame_no long")

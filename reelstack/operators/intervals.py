"""Half-open intervals in milliseconds: overlaps, priorities, unions, gaps, tiling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelstack.operators.tables import cut

#: Widths of time slots in ms: an interval belongs to the first that is no shorter than it.
WIDTHS = tuple(1000 * 8**k for k in range(12))


def width_class(start: Column, end: Column) -> Column:
    """The place in ``WIDTHS`` of the narrowest slots of which an interval touches two at most."""
    return sum((F.when(end - start > w, 1).otherwise(0) for w in WIDTHS[:-1]), F.lit(0))


def _width(place: Column) -> Column:
    return F.get(F.array(*[F.lit(w).cast("long") for w in WIDTHS]), place)


def _in_slots(rows: DataFrame, start: str, end: str, places: Column) -> DataFrame:
    """Each row in the slots that it touches at each of the widths ``places``."""
    at = rows.withColumn("_place", F.explode(places))
    lo = F.floor(F.col(start) / _width(F.col("_place")))
    return at.withColumn("_slot", F.explode(F.sequence(lo, F.greatest(lo, F.floor((F.col(end) - 1) / _width(F.col("_place")))))))


def overlaps(left: DataFrame, right: DataFrame, key: str = "clip_id") -> DataFrame:
    """Pairs of rows of one key whose intervals (``start``, ``end`` against ``r_start``, ``r_end``) overlap, with ``overlap_ms``.

    Slots are as wide as the longer interval of a pair wants: equi-joins on key, width and slot of rows at their own width with rows of the other side that are
    no longer than it. So an interval of a day makes two rows among ones of a second, and these make two more for each width that occurs among longer ones of the
    other side. A pair is kept in the first slot that both touch only, so no distinct is needed. Intervals without a length overlap nothing.
    """
    a = cut(left.where(F.col("start") < F.col("end")).withColumn("_own", width_class(F.col("start"), F.col("end"))))
    b = cut(right.where(F.col("r_start") < F.col("r_end")).withColumn("_r_own", width_class(F.col("r_start"), F.col("r_end"))))
    wider = lambda rows, own: F.array(*map(F.lit, sorted(r[0] for r in rows.select(own).distinct().collect()))).cast("array<int>")  # noqa: E731  as many as WIDTHS
    of_a, of_b = wider(a, "_own"), wider(b, "_r_own")
    own = lambda rows, start, end, place: _in_slots(rows, start, end, F.array(place))
    short = _in_slots(a, "start", "end", F.filter(of_b, lambda p: p >= F.col("_own")))
    long = own(b, "r_start", "r_end", "_r_own")
    other_short = _in_slots(b, "r_start", "r_end", F.filter(of_a, lambda p: p > F.col("_r_own")))
    other_long = own(a, "start", "end", "_own")
    on = [key, "_place", "_slot"]
    columns = [*left.columns, *[c for c in right.columns if c != key], "_place", "_slot"]
    both = short.join(long, on).select(columns).unionByName(other_long.join(other_short, on).select(columns))
    lo, hi = F.greatest("start", "r_start"), F.least("end", "r_end")
    met = both.where((lo < hi) & (F.col("_slot") == F.floor(lo / _width(F.col("_place")))))
    return met.withColumn("overlap_ms", hi - lo).drop("_place", "_slot")


def select_by_priority(segments: DataFrame, tiers: list[str], key: str = "clip_id") -> DataFrame:
    """Segments (key, segment_id, source, start, end) with ``selected`` and ``conflicts``, the adopted segments of higher tiers that they overlap.

    A tier's segment is dropped whole if it overlaps an adopted one of any higher tier; dropped segments block nothing.
    """
    adopted, judged = None, None
    for tier in tiers:
        own = segments.where(F.col("source") == tier)
        if adopted is None:
            marked = own.withColumn("conflicts", F.lit(""))
        else:
            higher = adopted.select(key, F.col("segment_id").alias("r_id"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
            hit = overlaps(own, higher, key).groupBy(key, "segment_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("r_id").cast("string"))), ",").alias("conflicts"))
            marked = own.join(hit, [key, "segment_id"], "left").withColumn("conflicts", F.coalesce("conflicts", F.lit("")))
        marked = marked.withColumn("selected", F.col("conflicts") == "")
        judged = marked if judged is None else judged.unionByName(marked)
        kept = marked.where("selected").select(segments.columns)
        adopted = kept if adopted is None else adopted.unionByName(kept)
    return judged


def merged_ranges(ranges: DataFrame, key: str = "clip_id") -> DataFrame:
    """Unions of overlapping or touching intervals of each key: gaps and islands by a running maximum."""
    w = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = ranges.where("start < end").withColumn("opens", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    return flagged.withColumn("island", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def gaps(ranges: DataFrame, bounds: DataFrame, least: int = 1, key: str = "clip_id") -> DataFrame:
    """Parts of ``bounds`` (key, lo, hi) that no interval covers, of at least ``least`` ms."""
    islands = bounds.join(merged_ranges(ranges, key), key, "left")
    w = Window.partitionBy(key).orderBy("start")
    before = islands.select(key, F.coalesce(F.lag("end").over(w), "lo").alias("start"), F.coalesce("start", "hi").alias("end"))
    after = islands.groupBy(key).agg(F.max("end").alias("start"), F.max("hi").alias("end")).where("start is not null")
    return before.unionByName(after).where(F.col("end") - F.col("start") >= least)


def stitched(starts: DataFrame, durations: DataFrame, key: str = "clip_id", ident: str | None = None) -> DataFrame:
    """Scenes from start times: each ends where the next begins, the last at the duration, numbered from 0.

    Of starts that are equal, all but the last one's scene are empty; they are numbered by ``ident``, which is kept, or are interchangeable without one.
    """
    w = Window.partitionBy(key).orderBy("start", *([ident] if ident else []))
    rows = starts.join(durations, key)
    return rows.select(key, *([ident] if ident else []), (F.row_number().over(w) - 1).alias("scene_no"), "start", F.coalesce(F.lead("start").over(w), "duration").alias("end"))


def successors(points: DataFrame, least: int, key: str = "clip_id") -> DataFrame:
    """(key, at, next): the first point that lies at least ``least`` after each one; null if none does.

    One descending pass over points and probes ``least`` after them: the last point seen is the nearest one behind.
    """
    probes = points.select(key, (F.col("at") + least).alias("_pos"), "at", F.lit(1).alias("_probe"))
    marks = points.select(key, F.col("at").alias("_pos"), F.lit(None).cast("long").alias("at"), F.lit(0).alias("_probe"))
    w = Window.partitionBy(key).orderBy(F.desc("_pos"), "_probe").rowsBetween(Window.unboundedPreceding, 0)
    seen = probes.unionByName(marks).withColumn("next", F.min(F.when(F.col("_probe") == 0, F.col("_pos"))).over(w))
    return seen.where("_probe = 1").select(key, "at", "next")


def thinned_starts(boundaries: DataFrame, durations: DataFrame, least: int, key: str = "clip_id") -> DataFrame:
    """(key, at): scene starts from raw boundaries (key, at) inside (0, duration): 0, then none nearer than ``least`` to the last kept one, no tail shorter than ``least``.

    Each choice depends on the one before, but what follows a start depends on it alone: the kept starts are those reached from 0 by following successors.
    They are found by pointer doubling: in each round all pointers become twice as long, and the starts reached so far reach as many more. Keys without a duration give nothing.
    """
    inside = boundaries.where("at is not null").join(durations, key).where("at > 0 and at < duration").select(key, F.col("at").cast("long").alias("at"))
    points = cut(inside.unionByName(durations.where("duration is not null").select(key, F.lit(0).cast("long").alias("at"))).distinct())
    jump = cut(successors(points, least, key).where("next is not null"))
    kept = cut(durations.where("duration is not null").select(key, F.lit(0).cast("long").alias("at")).distinct())
    n = jump.count()
    while n:
        # as many starts again: what the starts so far reach with pointers of this length is not among them yet
        kept = cut(kept.unionByName(kept.join(jump, [key, "at"]).select(key, F.col("next").alias("at"))))
        onward = jump.select(F.col(key), F.col("at").alias("next"), F.col("next").alias("_next"))
        jump = cut(jump.join(onward, [key, "next"]).select(key, "at", F.col("_next").alias("next")))
        n = jump.count()
    last = kept.groupBy(key).agg(F.max("at").alias("_last"), F.count("*").alias("_n")).join(durations, key)
    short = last.where((F.col("_n") > 1) & (F.col("duration") - F.col("_last") < least)).select(key, F.col("_last").alias("at"))
    return kept.join(short, [key, "at"], "left_anti")


def to_frame(ms: Column, fps: float) -> Column:
    """Frame whose own time is nearest to a time, halves to even."""
    return F.rint(ms * fps / 1000).cast("long")


def frame_ms(frame: Column, fps: float) -> Column:
    """A frame's own time in ms, halves to even."""
    return F.rint(frame * 1000 / fps).cast("long")


def frame_range(start: Column, end: Column, fps: float) -> tuple[Column, Column]:
    """First and last frame whose own time lies in ``[start, end)``; nulls if none does.

    The frame nearest to a bound may lie up to half a frame on its other side: then its neighbour is the one.
    """
    near_start, near_end = F.greatest(to_frame(start, fps), F.lit(0)), to_frame(end, fps)
    first = near_start + F.when(frame_ms(near_start, fps) < start, 1).otherwise(0)
    last = near_end - F.when(frame_ms(near_end, fps) >= end, 1).otherwise(0)
    some = last >= first
    return F.when(some, first), F.when(some, last)


def slot_centres(start: Column, end: Column, n: int) -> Column:
    """Centres of ``n`` equal parts of an interval, in whole ms."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + F.floor((end - start) * (2 * i + 1) / (2 * n)))


def slot_candidates(centre: Column, lo: Column, hi: Column, step: int, count: int) -> Column:
    """Times around a centre, alternating after and before it, clamped and distinct."""
    move = lambda i: F.ceil(i / 2) * F.when(i % 2 == 1, 1).otherwise(-1) * step
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.least(F.greatest(centre + move(i), lo), hi - 1)))


def tiling_faults(scenes: DataFrame, durations: DataFrame, key: str = "clip_id") -> DataFrame:
    """(key, fault) where scenes (scene_no, start, end) do not tile their clip."""
    w = Window.partitionBy(key).orderBy("start", "scene_no")
    before = scenes.withColumns({"prev_end": F.lag("end").over(w), "first": F.row_number().over(w) == 1})
    row = F.when(F.col("start") >= F.col("end"), "empty").when(F.col("first") & (F.col("start") != 0), "late_start").when(F.col("start") > F.col("prev_end"), "gap").when(F.col("start") < F.col("prev_end"), "overlap")
    inner = before.select(key, row.alias("fault")).where("fault is not null")
    tail = scenes.groupBy(key).agg(F.max("end").alias("end"), (F.count("*") - F.countDistinct("scene_no")).alias("twice")).join(durations, key)
    outer = tail.select(key, F.explode(F.array_compact(F.array(F.when(F.col("end") != F.col("duration"), F.lit("wrong_end")), F.when(F.col("twice") > 0, F.lit("repeated_number"))))).alias("fault"))
    return inner.unionByName(outer).groupBy(key, "fault").agg(F.count("*").alias("n"))

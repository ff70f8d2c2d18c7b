"""Fusion of channels, soft ordering, date guard, exclusions and paging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelstack.operators.tables import cut, small

RRF_K = 60.0
LAMBDA = 1.0


def fuse(channels: dict[str, DataFrame], weights: dict[str, float], structured: DataFrame | None = None, k: float = RRF_K, lam: float = LAMBDA, id_col: str = "scene_id") -> DataFrame:
    """(query_id, id, a rank per channel, structured, base_score) of every scene in any channel or that its tags admit.

    ``structured`` (query_id, id, structured, admits) scores all of them; a score that admits nothing adds no scene.

    Reciprocal ranks are summed over channels and divided by what first place in every configured channel would give, so
    a channel without rows lowers no one else's scale; an absent rank adds nothing.
    """
    on = {c: df for c, df in channels.items() if weights[c] > 0}
    ceiling = sum(w / (k + 1) for w in weights.values() if w > 0)
    long = None
    for c, df in on.items():
        part = df.select("query_id", id_col, F.lit(c).alias("channel"), F.col("rank"))
        long = part if long is None else long.unionByName(part)
    marked = long.select("query_id", id_col, "channel", "rank", F.lit(0.0).alias("structured"), F.lit(True).alias("admits"))
    if structured is not None:
        marked = marked.unionByName(structured.select("query_id", id_col, F.lit(None).cast("string").alias("channel"), F.lit(None).cast("int").alias("rank"), F.col("structured").cast("double"), "admits"))
    ranks = {c: F.min(F.when(F.col("channel") == c, F.col("rank"))) for c in on}
    # one aggregation brings the channels side by side
    wide = marked.groupBy("query_id", id_col).agg(*[r.alias(f"{c}_rank") for c, r in ranks.items()], F.max("structured").alias("structured"), F.bool_or("admits").alias("admits")).where("admits").drop("admits")
    total = sum((F.coalesce(weights[c] / (k + F.col(f"{c}_rank")), F.lit(0.0)) for c in on), F.lit(0.0))
    return wide.withColumn("base_score", F.round(total / ceiling + lam * F.col("structured"), 9))


def recency(day: Column, first: Column, last: Column) -> Column:
    """Where a day lies between the first and last day of its query's candidates; 0 without a day or a span."""
    return F.coalesce(F.when(last > first, F.datediff(day, first) / F.datediff(last, first)), F.lit(0.0))


def with_span(candidates: DataFrame, day: Column, by: str = "query_id") -> DataFrame:
    """Add ``first_day`` and ``last_day`` of a query's candidates: one pre-aggregated row a query, joined back. The candidates are read twice."""
    span = candidates.groupBy(by).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    return candidates.join(span, by)


def soft_score(signals: dict[str, tuple[Column, Column, float]]) -> Column:
    """Weighted mean of the active signals, each given as (value, active, weight); weights are divided by the largest active one first. 0 if none is active."""
    weight = {s: F.when(active, F.lit(float(w))).otherwise(0.0) for s, (_, active, w) in signals.items()}
    scale = F.greatest(*weight.values()) if len(weight) > 1 else next(iter(weight.values()))
    part = {s: w / scale for s, w in weight.items()}
    top = sum((part[s] * v for s, (v, _, _) in signals.items()), F.lit(0.0))
    return F.when(scale > 0, top / sum(part.values(), F.lit(0.0))).otherwise(0.0)


def final_order(epsilon: float = 0.0, id_col: str = "scene_id") -> list[Column]:
    """Base score bucket, then soft score, then id."""
    base = F.floor(F.col("base_score") / epsilon) if epsilon > 0 else F.col("base_score")
    return [base.desc(), F.desc("soft_score"), F.col(id_col)]


def final_key(epsilon: float = 0.0, id_col: str = "scene_id") -> Column:
    """The final order as one ascending value."""
    base = F.floor(F.col("base_score") / epsilon) if epsilon > 0 else F.col("base_score")
    return F.struct((-base).alias("base"), (-F.col("soft_score")).alias("soft"), F.col(id_col).alias("id"))


def head(rows: DataFrame, k: int, order: list[Column], by: str = "query_id", name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each query, numbered. Spark limits each partition's groups to ``k`` before it shuffles, so a task gets at most ``k`` rows a query from each of the others."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(name) <= k)


def deep_enough(rows: DataFrame, treat: Callable[[DataFrame], DataFrame], need: int, order: list[Column], depth: int = 200) -> DataFrame:
    """Treated rows among which are the first ``need`` that ``treat`` leaves of each query.

    ``treat`` takes rows and returns some of them; a column ``out``, if it adds one, marks those that do not count. It is applied to the first ``depth``
    rows of each query; only queries that had more and are left with less than ``need`` are treated in full.
    """
    found = cut(treat(head(rows, depth, order).drop("rank")))
    counted = found.where(~F.col("out")) if "out" in found.columns else found
    left = counted.groupBy("query_id").agg(F.count("*").alias("left"))
    held = rows.groupBy("query_id").agg(F.count("*").alias("held")).where(F.col("held") > depth)
    short = cut(held.join(left, "query_id", "left").where(F.coalesce("left", F.lit(0)) < need).select("query_id"))
    n = short.count()
    if not n:
        return found
    short = small(short, n)
    return found.join(short, "query_id", "left_anti").unionByName(treat(rows.join(short, "query_id", "left_semi")))


def marked(rows: DataFrame, excluded: DataFrame, id_col: str = "scene_id") -> DataFrame:
    """Add ``out``: whether (query_id, id) is excluded."""
    out = excluded.select("query_id", id_col).distinct().withColumn("out", F.lit(True))
    return rows.join(out, ["query_id", id_col], "left").withColumn("out", F.coalesce("out", F.lit(False)))


def page(rows: DataFrame, excluded: DataFrame | None, number: int = 1, size: int = 10, id_col: str = "scene_id", order: Column | None = None) -> DataFrame:
    """(query_id, id, rank, state, has_more): the rows of one page over rows that are not excluded, and the exclusions met while filling it.

    ``order`` is ascending and ends on an id (``final_key``); without it, rows have a ``rank``. ``excluded`` holds (query_id, id); without it, ``rows`` are ``marked``. Ranks count all rows. Of the
    rows that are not excluded only as many as the pages so far and one more are brought together; of the excluded ones, those before the page's last row.
    """
    lo, hi = (number - 1) * size, number * size
    every = rows if excluded is None else marked(rows, excluded, id_col)
    keyed = every.select("query_id", id_col, "out", (F.struct("rank", id_col) if order is None else order).alias("_key"))
    valid = cut(head(keyed.where(~F.col("out")), hi + 1, [F.col("_key")], name="valid"))
    last = valid.where(F.col("valid") == hi).select("query_id", F.col("_key").alias("_last"))
    met = keyed.where("out").join(last, "query_id", "left").where(F.col("_last").isNull() | (F.col("_key") < F.col("_last"))).drop("_last")
    few = valid.unionByName(met.withColumn("valid", F.lit(0)))
    whole = Window.partitionBy("query_id")
    turn = whole.orderBy("_key")
    count = F.sum((~F.col("out")).cast("int")).over(turn.rowsBetween(Window.unboundedPreceding, 0))
    placed = few.withColumns({"rank": F.row_number().over(turn), "count": count, "has_more": F.max("valid").over(whole) > hi})
    shown = ~F.col("out") & (F.col("count") > lo) & (F.col("count") <= hi)
    passed = F.col("out") & (F.col("count") >= lo) & (F.col("count") < hi)
    return placed.where(shown | passed).select("query_id", id_col, "rank", F.when(F.col("out"), "excluded").otherwise("shown").alias("state"), "has_more")


def date_guard(candidates: DataFrame, windows: DataFrame, tags: DataFrame, id_col: str = "scene_id") -> DataFrame:
    """(query_id, id, field, judgement) per stated window field: ``match`` if any trusted date lies in a window, else ``conflict`` if there is one at all, else ``unknown``.

    ``windows``: (query_id, field, start, end_exclusive, stated); ``tags``: (id, field, value, trusted). Scenes with a conflict are to be left out.
    """
    stated = windows.where("stated").select("query_id", "field", F.date_format("start", "yyyy-MM-dd").alias("lo"), F.date_format("end_exclusive", "yyyy-MM-dd").alias("hi"))
    dated = tags.where("trusted and value is not null").select(id_col, "field", "value").distinct()
    judged = candidates.select("query_id", id_col).join(stated, "query_id").join(dated, [id_col, "field"], "left")
    inside = (F.col("value") >= F.col("lo")) & (F.col("value") < F.col("hi"))
    per = judged.groupBy("query_id", id_col, "field").agg(F.bool_or(F.coalesce(inside, F.lit(False))).alias("hit"), F.bool_or(F.col("value").isNotNull()).alias("dated"))
    return per.select("query_id", id_col, "field", F.when(F.col("hit"), "match").when(F.col("dated"), "conflict").otherwise("unknown").alias("judgement"))


def without_conflicts(ranked: DataFrame, judged: DataFrame, id_col: str = "scene_id") -> DataFrame:
    """Ranked rows without those for which a stated window's field conflicts."""
    return ranked.join(judged.where("judgement = 'conflict'").select("query_id", id_col).distinct(), ["query_id", id_col], "left_anti")


def active_exclusions(searches: DataFrame, rules: DataFrame, id_col: str = "scene_id") -> DataFrame:
    """(query_id, id) that exclusion rules leave out of searches: fingerprint, normalised query, version and canonical filters must all agree, nulls being equal."""
    keys = ("fingerprint", "normalized_query", "version", "filters")
    rule = rules.where("active").select(*[F.col(k).alias(f"_{k}") for k in keys], id_col)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return searches.join(rule, same).select("query_id", id_col).distinct()


def ranked_diff(control: DataFrame, treatment: DataFrame, excluded: DataFrame | None = None, guarded: DataFrame | None = None, id_col: str = "scene_id") -> DataFrame:
    """(query_id, id, change, cause) of two ranked lists: entered, dropped or moved rows; a drop is caused by an exclusion, the guard or the score."""
    keys = ["query_id", id_col]
    both = control.select(*keys, F.col("rank").alias("before")).join(treatment.select(*keys, F.col("rank").alias("after")), keys, "full_outer")
    for name, df in (("excluded", excluded), ("guarded", guarded)):
        both = both.withColumn(name, F.lit(False)) if df is None else both.join(df.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left")
    change = F.when(F.col("before").isNull(), "entered").when(F.col("after").isNull(), "dropped").when(F.col("before") != F.col("after"), "moved").otherwise("same")
    cause = F.when(F.col("excluded"), "exclusion").when(F.col("guarded"), "guard").otherwise("score")
    return both.select(*keys, "before", "after", change.alias("change"), F.when(change == "dropped", cause).alias("cause"))


def shortage_reasons(returned: Column, candidates: Column, excluded: Column, guarded: Column, size: int = 10) -> Column:
    """Why fewer than a page's rows came back, joined by commas; empty for a full page."""
    reasons = F.array_compact(
        F.array(
            F.when(candidates < size, "few_candidates"),
            F.when(excluded > 0, "excluded"),
            F.when(guarded > 0, "date_conflict"),
        )
    )
    return F.when(returned >= size, "").otherwise(F.array_join(reasons, ","))


def explanation(terms: Column, fields: dict[str, Column], tags: Column, added: Column) -> dict[str, Column]:
    """Why a scene came up: the query's terms that each field holds, the matched keywords with their origin, the first field or else the tags that speak for it, and, if none does, the text that stands in.

    ``fields``: texts by name, in the order in which they speak; ``tags``: the scene's tag values; ``added``: terms that an expansion put behind the query's own. A keyword reads
    ``word:query`` or ``word:expansion``; one that is both is the query's.
    """
    from reelstack.functions.text import blank_to_null, tokens

    none = F.array().cast("array<string>")
    words = {n: F.coalesce(tokens(c), none) for n, c in fields.items()} | {"tags": F.coalesce(tags, none)}
    held = {n: F.array_intersect(terms, w) for n, w in words.items()}
    everywhere = F.flatten(F.array(*words.values()))
    extra = F.array_except(F.array_intersect(added, everywhere), terms)
    marked = lambda found, origin: F.transform(F.array_sort(found), lambda x: F.concat(x, F.lit(f":{origin}")))
    keywords = F.concat(marked(F.array_intersect(terms, everywhere), "query"), marked(extra, "expansion"))
    evidence = F.coalesce(*[F.when(F.size(h) > 0, n) for n, h in held.items()], F.lit("none"))
    stand_in = F.when(evidence == "none", F.coalesce(*[F.when(blank_to_null(c).isNotNull(), c) for c in fields.values()]))
    joined = {f"in_{n}": F.array_join(F.array_sort(h), " ") for n, h in held.items()}
    return joined | {"keywords": F.array_join(keywords, " "), "evidence": evidence, "stand_in": stand_in}

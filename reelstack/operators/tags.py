"""Effective tags from conflicting evidence, and scores from tag conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelstack.functions.text import normalised
from reelstack.operators.dictionary import spelt
from reelstack.operators.tables import cut, small

#: Sources whose observations may count as verified.
VERIFIABLE = ("user_input", "original_metadata", "closed_caption", "ocr")


def inherited(judgements: DataFrame, scene: DataFrame) -> DataFrame:
    """Judgements by scene: scene-scoped ones for their scene, clip-scoped ones (``scene_id`` null) for every scene of the clip.

    Two equi-joins and a union, so that neither needs a residual condition over a whole clip.
    """
    keys = scene.select("scene_id", "clip_id")
    rest = [c for c in judgements.columns if c not in ("scene_id", "clip_id")]
    own = judgements.where("scene_id is not null").join(keys, ["scene_id", "clip_id"]).select("scene_id", "clip_id", *rest, F.lit(True).alias("scene_scoped"))
    wide = judgements.where("scene_id is null").drop("scene_id").join(keys, "clip_id").select("scene_id", "clip_id", *rest, F.lit(False).alias("scene_scoped"))
    return own.unionByName(wide)


def effective_tags(judgements: DataFrame) -> DataFrame:
    """(scene_id, tag, verification, scope, source) of the tags that hold, in one aggregation.

    ``judgements``: scene_id, tag, scene_scoped, source, status, created_at, evidence_id. The latest reviewer
    verdict of the scene counts, else that of the clip; a withdrawn verdict is none, any but an approval removes the tag.
    Without a verdict the strongest other evidence holds: verified before unverified, then scene before
    clip, then the latest.
    """
    reviewer = F.col("source") == "reviewer"
    verdict = F.struct("created_at", "evidence_id", "status")
    latest = lambda scoped: F.max(F.when(reviewer & (F.col("scene_scoped") == scoped), verdict))
    verified = F.col("source").isin(*VERIFIABLE) & (F.col("status") == "verified")
    general = F.max(F.when(~reviewer, F.struct(verified.alias("verified"), "scene_scoped", "created_at", "evidence_id", "source")))
    per = judgements.groupBy("scene_id", "tag").agg(latest(True).alias("s"), latest(False).alias("c"), general.alias("g"))
    standing = lambda v: F.when(F.col(f"{v}.status") != "withdrawn", F.col(f"{v}.status"))
    decided = F.coalesce(standing("s"), standing("c"))
    per = per.withColumns({"decided": decided, "by_scene": standing("s").isNotNull()})
    held = per.where((F.col("decided") == "verified") | (F.col("decided").isNull() & F.col("g").isNotNull()))
    by_review = F.col("decided").isNotNull()
    return held.select(
        "scene_id",
        "tag",
        F.when(by_review, "reviewer_verified").when(F.col("g.verified"), "verified").otherwise("unverified").alias("verification"),
        F.when(F.when(by_review, F.col("by_scene")).otherwise(F.col("g.scene_scoped")), "scene").otherwise("clip").alias("scope"),
        F.when(by_review, "reviewer").otherwise(F.col("g.source")).alias("source"),
    )


def condition_matches(conditions: DataFrame, tags: DataFrame) -> DataFrame:
    """(query_id, axis, condition_id, scene_id) of tag conditions that a scene's effective tags meet.

    ``conditions``: query_id, axis, condition_id, tag_type, kind (``exact``, ``caseless`` or ``range``), value, upper, of match values;
    ``tags``: scene_id, tag_type, value. Conditions are held against the distinct values, whose match values are made once: exact and caseless ones by equi-joins, ranges
    within a type. The tags are then joined once, by value.
    """
    tags = cut(tags.where("value is not null"))
    known = cut(normalised(tags.select("tag_type", "value").distinct(), "value", match="match"))
    asked = conditions.select("query_id", "axis", "condition_id", "tag_type", "kind", F.col("value").alias("wanted"), "upper")
    keys = ["query_id", "axis", "condition_id", "tag_type", "value"]
    of = lambda kind: asked.where(F.col("kind") == kind)
    exact = of("exact").join(known.withColumnRenamed("match", "wanted"), ["tag_type", "wanted"]).select(keys)
    folded = of("caseless").withColumn("folded", F.lower("wanted")).join(known.withColumn("folded", F.lower("match")), ["tag_type", "folded"]).select(keys)
    ranged = of("range").join(known, "tag_type").where("match between wanted and upper").select(keys)
    met = small(exact.unionByName(folded).unionByName(ranged).distinct())
    return tags.join(met, ["tag_type", "value"]).select("query_id", "axis", "condition_id", "scene_id").distinct()


#: Axes that score but admit no scene of their own.
DATE_AXES = ("broadcast_date", "filmed_date")


def query_conditions(resolved: DataFrame) -> DataFrame:
    """(query_id, axis, tag_type, kind, value, upper, condition_id) of resolved queries, each once by type and match value.

    ``resolved``: query_id, axis, tag_type, value, upper (null but for date windows), and ``caseless``, whether a condition ignores case; without that column all do. Values that are empty ask for
    nothing; equal names of two types are two conditions, and so are names that differ in case, unless it is ignored.
    """
    ranged = F.col("upper").isNotNull()
    loose = F.coalesce("caseless", F.lit(False)) if "caseless" in resolved.columns else F.lit(True)
    kind = F.when(ranged, "range").when(loose, "caseless").otherwise("exact")
    made = spelt(resolved.withColumn("kind", kind), "value", match="_match")
    value = F.when(ranged, F.col("value")).when(F.col("kind") == "caseless", F.lower("_match")).otherwise(F.col("_match"))
    clean = made.withColumn("value", value).where("value <> ''").select("query_id", "axis", "tag_type", "kind", "value", "upper")
    once = clean.dropDuplicates(["query_id", "axis", "tag_type", "kind", "value", "upper"])
    return cut(once.withColumn("condition_id", F.concat_ws("|", "tag_type", "kind", "value", "upper")))


def structured_scores(conditions: DataFrame, matches: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(query_id, scene_id, structured, admits): matched share of each requested axis, weighted over the requested axes only; whether an axis other than a date's matched."""
    weight = F.create_map(*[F.lit(x) for a, w in weights.items() for x in (a, float(w))])
    requested = conditions.groupBy("query_id", "axis").agg(F.countDistinct("condition_id").alias("requested")).withColumn("weight", F.coalesce(weight[F.col("axis")], F.lit(0.0)))
    total = requested.groupBy("query_id").agg(F.sum("weight").alias("total"))
    matched = matches.groupBy("query_id", "scene_id", "axis").agg(F.countDistinct("condition_id").alias("matched"))
    part = matched.join(requested, ["query_id", "axis"]).join(total, "query_id")
    share = F.col("matched") / F.col("requested") * F.col("weight") / F.col("total")
    return part.groupBy("query_id", "scene_id").agg(F.round(F.sum(share), 9).alias("structured"), F.bool_or(~F.col("axis").isin(*DATE_AXES)).alias("admits"))


def noun_runs(words: Column, noun) -> Column:
    """array<array<string>>: the maximal runs of words for which ``noun`` holds, in order."""
    none = F.array().cast("array<array<string>>")
    start = F.struct(none.alias("runs"), F.lit(False).alias("open"))

    def step(acc: Column, w: Column) -> Column:
        size = F.size(acc["runs"])
        longer = F.concat(F.slice(acc["runs"], F.lit(1), F.greatest(size - 1, F.lit(0))), F.array(F.concat(F.try_element_at(acc["runs"], F.lit(-1)), F.array(w))))
        opened = F.concat(acc["runs"], F.array(F.array(w)))
        return F.when(noun(w), F.struct(F.when(acc["open"], longer).otherwise(opened).alias("runs"), F.lit(True).alias("open"))).otherwise(F.struct(acc["runs"].alias("runs"), F.lit(False).alias("open")))

    return F.aggregate(words, start, step, lambda acc: acc["runs"])


def run_joins(runs: Column, longest: int = 3) -> Column:
    """Distinct joins of one to ``longest`` neighbouring words of each run, run by run, shorter ones first."""
    from reelstack.functions.text import ngram_join

    return F.array_distinct(F.flatten(F.transform(runs, lambda run: F.concat(*[ngram_join(run, n) for n in range(1, longest + 1)]))))


def keyword_conditions(query_runs: Column, expansion: Column, stop: list[str], cap: int = 12) -> Column:
    """Keyword conditions of a query: joins of one to three words inside its noun runs, without stop words, then expansions, up to the cap."""
    kept = lambda c: F.filter(c, lambda w: ~w.isin(stop))
    own = kept(run_joins(query_runs))
    return F.slice(F.concat(own, F.array_except(kept(expansion), own)), 1, cap)


def admitted_phrases(phrases: DataFrame, values: DataFrame, id_col: str = "scene_id") -> DataFrame:
    """(query_id, id, n): how many of a query's phrases a scene's tag values admit, each noun run of the phrase being covered whole.

    ``phrases``: query_id, phrase_no, runs array<array<string>>; ``values``: id, value. Scenes meet a phrase by the joins of its
    runs' words, so only scenes that hold one of them are looked at.
    """
    each = phrases.where("size(runs) > 0").withColumn("value", F.explode(run_joins(F.col("runs"))))
    met = each.join(values, "value").groupBy("query_id", "phrase_no", id_col).agg(F.collect_set("value").alias("held"), F.first("runs").alias("runs"))
    whole = met.where(F.forall("runs", lambda run: covered_by(run, F.col("held"))))
    return whole.groupBy("query_id", id_col).agg(F.count("*").alias("n"))


def keyword_bonus(matched: Column, requested: Column, weight: float = 0.2) -> Column:
    return F.when(requested > 0, weight * matched / requested).otherwise(0.0)


def covered_by(run: Column, values: Column, longest: int = 3) -> Column:
    """Whether a run of nouns splits into joins of one to ``longest`` nouns that are all among ``values``."""
    reach = F.aggregate(
        F.sequence(F.lit(1), F.size(run)),
        F.array(F.lit(True)),
        lambda done, i: F.concat(
            done,
            F.array(F.exists(F.sequence(F.lit(1), F.least(F.lit(longest), i)), lambda n: F.element_at(done, (i - n + 1).cast("int")) & F.array_contains(values, F.array_join(F.slice(run, i - n + 1, n), "")))),
        ),
    )
    return F.when(F.size(run) == 0, True).otherwise(F.element_at(reach, -1))

"""Figure-ready tables: what a plot would draw, without the drawing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import checkpointed
from .tables import first_match, first_of_group


def panel_flags(targets: DataFrame, panel: DataFrame) -> DataFrame:
    """Targets (compound, target) with a panel's rows (target, organ, panel_score): `in_core_panel` where there is a score; a target on several rows multiplies."""
    return targets.join(panel, "target", "left").withColumn("in_core_panel", F.col("panel_score").isNotNull())


def gene_scores(edges: DataFrame, how: str = "max") -> DataFrame:
    """One score by condition and target for a pathway map: the largest or mean weight, or the number of compounds."""
    value = {"max": F.max("weight"), "mean": F.avg("weight"), "count": F.countDistinct("compound").cast("double")}[how]
    return edges.filter("weight is not null").groupBy("condition", "target").agg(value.alias("score"))


def dominant_effects(relations: DataFrame, precedence: Sequence[str]) -> DataFrame:
    """One effect for each pair (source, sink) of several: the first in the given order; unknown ones come last."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in precedence]), F.col("effect")), F.lit(0))
    return relations.groupBy("source", "sink").agg(F.min_by("effect", F.struct(F.when(rank > 0, rank).otherwise(len(precedence) + 1), F.col("effect"))).alias("effect"))


def signed_twins(relations: DataFrame) -> DataFrame:
    """Genes whose signed neighbourhoods are the same: gene and the least gene of its group."""
    near = relations.select(F.col("source").alias("gene"), F.concat_ws("|", F.lit("out"), "sink", "effect").alias("n")).unionByName(relations.select(F.col("sink").alias("gene"), F.concat_ws("|", F.lit("in"), "source", "effect").alias("n")))
    signature = near.distinct().groupBy("gene").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("n")), ";"), 256).alias("signature"))
    return signature.withColumn("representative", F.min("gene").over(Window.partitionBy("signature"))).select("gene", "representative")


def primary_class(associations: DataFrame) -> DataFrame:
    """The class of each target with the most diseases, then the highest score, then the first name."""
    n = associations.groupBy("target", "class").agg(F.countDistinct("disease").alias("n"), F.max("score").alias("best"))
    return first_of_group(n, ["target"], [F.desc("n"), F.desc_nulls_last("best"), F.col("class")]).select("target", "class", "n")


def pooled_associations(tables: Sequence[DataFrame]) -> DataFrame:
    """Associations of several sources (disease, target, score, source): the best score, the sources joined."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    return rows.groupBy("disease", "target").agg(F.max("score").alias("score"), F.array_join(F.sort_array(F.collect_set("source")), "; ").alias("sources"))


def gene_term_matrix(terms: DataFrame, top: int) -> DataFrame:
    """Gene by term membership of the genes in most terms, largest first."""
    wide = terms.groupBy("gene").agg(F.countDistinct("term").alias("n_terms")).orderBy(F.desc("n_terms"), "gene").limit(top)
    return terms.select("gene", "term").distinct().join(F.broadcast(wide), "gene").select("gene", "n_terms", "term")


def disease_flow(z: DataFrame) -> DataFrame:
    """Condition-to-disease widths max(-z, 0.05), and whether the z is its condition's best."""
    best = F.min("z").over(Window.partitionBy("condition"))
    return z.filter("z is not null").withColumn("weight", F.greatest(-F.col("z"), F.lit(0.05))).withColumn("best", F.col("z") == best)


def fraction_removed(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Percolation curves over the share of removed nodes."""
    most = F.max("n_removed").over(Window.partitionBy(*keys))
    return curve.withColumn("fraction_removed", F.try_divide(F.col("n_removed"), most))


def radar(df: DataFrame, id_col: str, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Axis values clamped to 0..1 between given limits: id, axis, value."""
    scaled = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(c) - lo) / (hi - lo))).alias(c) for c, (lo, hi) in limits.items()]
    return df.select(id_col, *scaled).unpivot(id_col, list(limits), "axis", "value")


def identity_chain(compounds: DataFrame, registry: DataFrame) -> DataFrame:
    """Matches of structure keys with a registry (key, external_id): the whole key, else its first 14 characters; first match by id, with the kind of match.

    compounds: compound, key.
    """
    whole = first_match(compounds, registry.select("key", F.col("external_id").alias("by_key")), "key", [F.col("by_key")])
    short = registry.select(F.substring("key", 1, 14).alias("skeleton"), F.col("external_id").alias("by_skeleton"))
    both = first_match(whole.withColumn("skeleton", F.substring("key", 1, 14)), short, "skeleton", [F.col("by_skeleton")])
    kind = F.when(F.col("by_key").isNotNull(), "exact").when(F.col("by_skeleton").isNotNull(), "skeleton").otherwise("none")
    return both.select("compound", "key", F.coalesce("by_key", "by_skeleton").alias("external_id"), kind.alias("match_type"))


def best_molecule(candidates: DataFrame) -> DataFrame:
    """Of several records of a compound, one that is its own parent, then one with a name, then the least number in its id."""
    number = F.regexp_extract("molecule", r"(\d+)", 1).try_cast("bigint")
    return first_of_group(candidates, ["compound"], [F.desc(F.col("molecule").eqNullSafe(F.col("parent"))), F.desc(F.col("name").isNotNull()), F.asc_nulls_last(number), F.col("molecule")])


def connected_picks(ranked: DataFrame, links: DataFrame, top: int) -> DataFrame:
    """The first `top` nodes (node, place) that have a partner among the picks: those without are replaced by the next until nothing changes. `top` is a figure's size."""
    pairs = links.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(links.select(F.col("v").alias("node"), F.col("u").alias("other")))
    pairs, left = checkpointed(pairs.distinct()), checkpointed(ranked)
    out, before = ranked.limit(0), None
    while True:  # each round takes nodes out, so it ends
        picks = left.orderBy("place").limit(top)
        fine = picks.join(pairs.join(picks.select(F.col("node").alias("other")), "other", "left_semi").select("node").distinct(), "node", "left_semi")
        good = {r.node for r in fine.select("node").collect()}
        chosen = {r.node for r in picks.select("node").collect()}
        out = fine
        if good == chosen or before == chosen:
            break
        before = chosen
        left = left.filter(~F.col("node").isin(sorted(chosen - good)))
    return out

"""Rule-based screening: pass flags, filters, polygons, alerts, and outlier audits."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DESCRIPTORS = ("mw", "logp", "hbd", "hba", "tpsa", "rotb", "atoms", "rings", "amr", "arom")


def violations(limit_mw: float = 500, limit_logp: float = 5, limit_hbd: int = 5, limit_hba: int = 10) -> Column:
    """Number of exceeded limits; null as soon as one descriptor is."""
    over = [F.col(c) > v for c, v in (("mw", limit_mw), ("logp", limit_logp), ("hbd", limit_hbd), ("hba", limit_hba))]
    return sum((o.cast("int") for o in over[1:]), over[0].cast("int"))


def rule_flags(df: DataFrame, routes: Sequence[str] = ("oral", "injectable", "ophthalmic", "topical")) -> DataFrame:
    """Add rule violations, pass flags, solubility and administration routes to descriptor columns; unknown inputs give null flags."""
    c = F.col
    out = df.withColumn("ro5_violations", violations()).withColumns({
        "ro5_pass": F.col("ro5_violations") <= 0,
        "veber_pass": (c("tpsa") <= 140) & (c("rotb") <= 10),
        "ghose_pass": c("mw").between(160, 480) & c("logp").between(-0.4, 5.6) & c("atoms").between(20, 70) & c("amr").between(40, 130),
        "egan_pass": (c("logp") <= 5.88) & (c("tpsa") <= 131.6),
        "oprea_pass": c("hbd").between(0, 2) & c("hba").between(2, 9) & c("rotb").between(2, 8) & c("rings").between(1, 4),
        "logs": F.lit(0.16) - 0.63 * c("logp") - 0.0062 * c("mw") + 0.066 * c("rotb") - 0.74 * c("arom"),
    })
    by_route = {
        "oral": F.col("ro5_violations") <= 0,
        "injectable": c("logp").between(1, 3),
        "ophthalmic": (c("tpsa") <= 250) & (c("logp") <= 4),
        "topical": (c("mw") <= 500) & c("logp").between(1, 4),
    }
    return out.withColumns({f"route_{r}": by_route[r] for r in routes})


def long_rules(df: DataFrame, id_col: str, rules: Sequence[str]) -> DataFrame:
    """One row per id and rule with its three-valued pass flag."""
    return df.unpivot(id_col, [F.col(f"{r}_pass").alias(r) for r in rules], "rule", "pass")


def hard_cutoff(df: DataFrame, long: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id failed no rule; unknown flags do not count as failures."""
    return df.join(long.filter(~F.col("pass")).select(id_col).distinct(), id_col, "left_anti")


def in_polygon(points: DataFrame, vertices: DataFrame, x: str, y: str) -> Column | DataFrame:
    """Add `inside` by even-odd ray casting against a polygon of a few vertices (columns seq, vx, vy), held on the driver.

    A null coordinate gives null.
    """
    corners = [(r.vx, r.vy) for r in vertices.orderBy("seq").collect()]
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        if y1 == y2:
            continue
        meets = ((F.lit(y1) > F.col(y)) != (F.lit(y2) > F.col(y))) & (F.col(x) < (x2 - x1) * (F.col(y) - y1) / (y2 - y1) + x1)
        crossings = crossings + meets.cast("int")
    return points.withColumn("inside", crossings % 2 == 1)


def ring_count(text: Column) -> Column:
    """Ring closures in a line notation: bracket atoms dropped, two-digit labels (%dd) and single digits paired."""
    bare = F.regexp_replace(text, r"\[[^\]]*\]", "")
    double = F.regexp_count(bare, F.lit(r"%\d\d"))
    single = F.regexp_count(F.regexp_replace(bare, r"%\d\d", ""), F.lit(r"\d"))
    return F.floor((double + single) / 2).cast("int")


def alerts(df: DataFrame, id_col: str, text: str, patterns: DataFrame) -> DataFrame:
    """Every id against every pattern (columns alert_set, alert_name, pattern; a short list): matched, null for a null text."""
    found = df.select(id_col, text).crossJoin(F.broadcast(patterns))
    return found.select(id_col, "alert_set", "alert_name", "pattern", F.expr(f"`{text}` rlike pattern").alias("matched"))


def mad_scores(degrees: DataFrame, degree: str = "degree", threshold: float = 2.5) -> DataFrame:
    """Add the robust score (degree - median) / (1.4826 * MAD), null if the MAD is 0, and `flagged` for scores over the threshold."""
    median = degrees.agg(F.median(degree).alias("med"))
    spread = degrees.crossJoin(F.broadcast(median)).withColumn("dev", F.abs(F.col(degree) - F.col("med")))
    scale = spread.agg(F.median("dev").alias("mad"))
    scored = spread.crossJoin(F.broadcast(scale)).withColumn("mad_score", F.when(F.col("mad") > 0, (F.col(degree) - F.col("med")) / (1.4826 * F.col("mad"))))
    return scored.withColumn("flagged", F.coalesce(F.col("mad_score") > threshold, F.lit(False))).drop("med", "mad", "dev")


def audit(pairs: DataFrame, compound: str, target: str, threshold: float = 2.5) -> DataFrame:
    """Homogeneity audit of both sides of a pair table: kind, id, degree, score, flag."""
    sides = []
    for kind, own, other in (("compound", compound, target), ("target", target, compound)):
        degree = pairs.filter(F.col(own).isNotNull()).groupBy(F.col(own).cast("string").alias("id")).agg(F.countDistinct(other).alias("degree"))
        sides.append(mad_scores(degree, threshold=threshold).select(F.lit(kind).alias("kind"), "id", "degree", "mad_score", "flagged"))
    return sides[0].unionByName(sides[1])


def penalised(degree: Column, others: Column) -> Column:
    """degree * ln(others / degree): common neighbours count less the more of the other side they touch."""
    return degree * F.ln(others / degree)


def reweighted(audited: DataFrame) -> DataFrame:
    """Flagged rows get the penalised degree (by the other side's size); other rows keep theirs."""
    sizes = audited.groupBy("kind").agg(F.count("*").alias("n"))
    other = sizes.select(F.when(F.col("kind") == "compound", "target").otherwise("compound").alias("kind"), F.col("n").alias("n_other"))
    value = F.when(F.col("flagged") & (F.col("degree") > 0), penalised(F.col("degree"), F.col("n_other"))).otherwise(F.col("degree").cast("double"))
    return audited.join(F.broadcast(other), "kind").select("kind", "id", F.col("degree").cast("double").alias("raw_score"), value.alias("adjusted_score"), "flagged")


def report_flagged(reweighted_rows: DataFrame) -> DataFrame:
    return reweighted_rows.filter("flagged").orderBy("adjusted_score", "kind", "id")


def combinations(long: DataFrame, id_col: str, none: str = "(none)") -> DataFrame:
    """Counts of the sets of passed rules, named by the sorted rules joined with a bar."""
    passed = F.array_join(F.sort_array(F.collect_set(F.when(F.col("pass"), F.col("rule")))), "|")
    return long.groupBy(id_col).agg(passed.alias("combination")).groupBy(F.when(F.col("combination") == "", none).otherwise(F.col("combination")).alias("combination")).agg(F.count("*").alias("n"))


def classified(df: DataFrame, text: str, classes: Mapping[str, str], other: str = "Other", out: str = "class") -> DataFrame:
    """The first class, in order, whose case-insensitive pattern is found in the text; `other` for none, null or blank."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(list(classes.items())):
        found = F.when(F.col(text).rlike(f"(?i){pattern}"), name).otherwise(found)
    return df.withColumn(out, F.coalesce(F.when(F.trim(F.col(text)) != "", found), F.lit(other)))


def isfinite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)


def alert_report(alert_rows: DataFrame, id_col: str, sets: Sequence[str], panel: DataFrame, imported: DataFrame) -> DataFrame:
    """Per id: matches by alert set with their names, distinct organ systems (panel: id, organ), imported k=v pairs (property, value)."""
    by_set = []
    for s in sets:
        hit = (F.col("alert_set") == s) & F.coalesce(F.col("matched"), F.lit(False))
        by_set += [F.count_if(hit).alias(f"n_{s}"), F.array_join(F.sort_array(F.collect_set(F.when(hit, F.col("alert_name")))), ", ").alias(f"{s}_names")]
    a = alert_rows.groupBy(id_col).agg(*by_set)
    p = panel.groupBy(id_col).agg(F.countDistinct("organ").alias("n_organs"))
    i = imported.groupBy(id_col).agg(F.count("*").alias("n_imported"), F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "property", "value"))), "; ").alias("imported"))
    out = a.join(p, id_col, "full_outer").join(i, id_col, "full_outer")
    return out.fillna(0, [c for c in out.columns if c.startswith("n_")]).fillna("", [f"{s}_names" for s in sets] + ["imported"])

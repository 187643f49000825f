"""Presence calling: replicate means, per-condition thresholds, and conditions from lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replicate_columns(columns: list[str], id_col: str) -> dict[str, tuple[int, str]]:
    """Replicate number and condition by column name, from headers of the form R<n>-<condition>; any other header is an error."""
    import re

    out = {}
    for c in columns:
        if c == id_col:
            continue
        m = re.fullmatch(r"R(\d+)-(.+)", c)
        if not m:
            raise ValueError(f"column {c!r} is not named R<replicate>-<condition>")
        out[c] = (int(m[1]), m[2])
    return out


def melted(wide: DataFrame, id_col: str) -> DataFrame:
    """Wide abundances with R<n>-<condition> headers as rows of compound, condition, replicate, value."""
    names = replicate_columns(wide.columns, id_col)
    long = wide.unpivot([F.col(id_col).alias("compound")], [F.col(f"`{c}`").cast("double").alias(c) for c in names], "header", "value")
    return long.select("compound", F.regexp_extract("header", r"^R\d+-(.+)$", 1).alias("condition"), F.regexp_extract("header", r"^R(\d+)-", 1).cast("int").alias("replicate"), "value")


def binarized(long: DataFrame, q: float = 0.25, min_replicates: int | None = None) -> DataFrame:
    """Presence (0/1) by compound and condition, from rows of compound, condition, replicate, value.

    The mean over replicates is compared with its condition's q-quantile, zeros
    included; a condition that holds only 0 and 1 is present from 0.5 on. With
    `min_replicates`, that many positive replicates decide instead.
    """
    means = long.groupBy("compound", "condition").agg(F.avg("value").alias("mean"), F.count_if(F.col("value") > 0).alias("positive"))
    if min_replicates is not None:
        present: Column = F.col("positive") >= min_replicates
        return means.select("compound", "condition", "mean", present.cast("int").alias("present"))
    flags = long.groupBy("condition").agg(F.bool_and(F.col("value").isin(0.0, 1.0)).alias("binary"))
    cuts = means.groupBy("condition").agg(F.percentile("mean", F.lit(q)).alias("cut")).join(flags, "condition")
    present = F.when(F.col("binary"), F.col("mean") >= 0.5).otherwise((F.col("mean") > 0) & (F.col("mean") >= F.col("cut")))
    return means.join(F.broadcast(cuts), "condition").select("compound", "condition", "mean", F.coalesce(present, F.lit(False)).cast("int").alias("present"))


def as_condition(presence: DataFrame, condition: str, ids: DataFrame) -> DataFrame:
    """Add a condition in which exactly the listed ids (column compound) are present; ids known elsewhere are 0 there."""
    known = presence.select("compound").distinct()
    listed = ids.select("compound").distinct().withColumn("hit", F.lit(1))
    new = known.join(listed, "compound", "full_outer").select("compound", F.lit(condition).alias("condition"), F.lit(None).cast("double").alias("mean"), F.coalesce("hit", F.lit(0)).alias("present"))
    return presence.select("compound", "condition", "mean", "present").filter(F.col("condition") != condition).unionByName(new)

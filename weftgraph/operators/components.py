"""Connected components of an undirected graph as an iterated DataFrame join."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and cut the lineage there.

    The folder is the session's spark.checkpoint.dir; without one, only a
    local[...] master, whose executors live in the driver, gets one of its own.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="weftgraph-"))
    return df.checkpoint(eager=True)


def shuffled(df: DataFrame) -> DataFrame:
    """Rows whose join is a shuffle: a broadcast, by an estimate of their size, would pass through the driver and stay in its memory."""
    return df.hint("merge")


#: Distinct edges up to which one task finds all components; more are settled in rounds of joins. Both ways give the same rows.
ONE_TASK_EDGES = 1_000_000


def settled(pdf: pd.DataFrame) -> pd.DataFrame:
    """Components of edges u, v: roots hook on to the least root beside them, and paths are halved, until nothing changes."""
    nodes, at = np.unique(np.concatenate([pdf["u"].to_numpy(), pdf["v"].to_numpy()]), return_inverse=True)
    a, b = np.split(at, 2)
    root = np.arange(len(nodes))
    while True:
        least, new = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            return pd.DataFrame({"node": nodes, "component": nodes[root]})
        root = new


def forests(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fewer edges u, v (u > v) with the same components: each node of a task's edges and the least node it hangs together with there."""
    held, size = [], 0

    def less() -> pd.DataFrame:
        found = settled(pd.concat(held)).rename(columns={"node": "u", "component": "v"})
        return found[found["u"] != found["v"]]

    for part in parts:
        held.append(part)
        size += len(part)
        if size > ONE_TASK_EDGES:
            held = [less()]
            size = len(held[0]) // 2
    if held:
        yield less()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", most: int = 60) -> DataFrame:
    """Columns node and component (the smallest node of its component) for every node with an edge.

    Few edges are settled in one task, as rounds of tiny jobs would cost far more.
    Many alternate two steps until the edges stay the same: each node hands its
    larger neighbours, then its smaller ones, to the smallest node it knows. The
    number of edges never grows, and the rounds grow with the logarithm of the
    longest path. Before that each task leaves a forest of its edges. Minima are aggregated before they are shuffled, and written
    before they are joined: both sides of each join are then plain shuffles, which
    adaptive execution splits where a node has very many neighbours. More than
    `most` rounds are an error. Null ends and self-loops are ignored.
    """
    now = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u <> v")
    now = checkpointed(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    kind, n = dict(now.dtypes)["u"], now.count()
    if n > ONE_TASK_EDGES:
        now = checkpointed(now.mapInPandas(forests, f"u {kind}, v {kind}").distinct())
        n = now.count()
    if n <= ONE_TASK_EDGES:
        return checkpointed(now.withColumn("task", F.lit(0)).groupBy("task").applyInPandas(lambda pdf: settled(pdf), f"node {kind}, component {kind}").coalesce(1))
    before = None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.filter("v > u").join(shuffled(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(shuffled(down), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        now = checkpointed(small.distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components are not settled after {most} rounds")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

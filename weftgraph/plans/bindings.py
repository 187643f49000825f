"""The domain on the test tables: suppliers as compounds, parts as targets, return flags as conditions, brands and types as gene sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import network, presence
from ..operators.components import shuffled

#: Quantity from which a line is a predicted target, and the least probability of an edge.
TARGET_QUANTITY, EDGE_SCORE = 45, 0.95


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def abundance(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("compound"), F.col("l_returnflag").alias("condition"), F.col("l_linenumber").alias("replicate")).agg(F.sum("l_quantity").alias("value"))


def present(spark: SparkSession, d: str) -> DataFrame:
    return presence.binarized(abundance(spark, d))


def targets(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").filter(F.col("l_quantity") >= TARGET_QUANTITY)
    return li.select(F.col("l_suppkey").alias("compound"), F.col("l_partkey").alias("target"), (1 - F.col("l_discount")).alias("probability"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return network.built(present(spark, d), targets(spark, d), EDGE_SCORE)


def brands(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("target"), F.col("p_brand").alias("name"))


def diseases(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_type").alias("disease"), F.col("p_partkey").alias("target"), (F.col("p_retailprice") / 2500).alias("score"))


def descriptors(spark: SparkSession, d: str) -> DataFrame:
    """Invented descriptors of parts; every 17th molecular weight is unknown."""
    k, size, price = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
    return table(spark, d, "part").select(
        k.alias("compound"), F.when(k % 17 != 0, price / 3).alias("mw"), (size / 8.0 - 1).alias("logp"), (size % 8).alias("hbd"), (k % 13).cast("int").alias("hba"), (price % 200).alias("tpsa"),
        (size % 14).alias("rotb"), (size + 10).alias("atoms"), (k % 6).cast("int").alias("rings"), (price % 150).alias("amr"), ((k % 10) / 10.0).alias("arom"),
    )


def interactions(spark: SparkSession, d: str, least: int | None = 46) -> DataFrame:
    """Parts that are on one order in quantities of `least` and more, or in any if it is None: u < v, score (number of such orders)."""
    li = table(spark, d, "lineitem")
    li = (li if least is None else li.filter(F.col("l_quantity") >= least)).select("l_orderkey", "l_partkey").distinct()
    a, b = li.select("l_orderkey", F.col("l_partkey").alias("u")), li.select("l_orderkey", F.col("l_partkey").alias("v"))
    return a.join(shuffled(b), "l_orderkey").filter("u < v").groupBy("u", "v").agg(F.count("*").alias("score"))


def transitions(spark: SparkSession, d: str) -> DataFrame:
    """Directed edges between the users whose events follow one another within an event type and an hour."""
    e = table(spark, d, "events").filter("value > 0")
    w = Window.partitionBy("event_type", F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("u"), F.lead("user_id").over(w).alias("v"), "event_type").filter("v is not null and u <> v")


def zscores(spark: SparkSession, d: str) -> DataFrame:
    """An invented score by condition and compound, null now and then."""
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("condition"), F.col("l_suppkey").alias("compound")).agg(((F.avg("l_quantity") - 25.5) * 2).alias("z")).withColumn("z", F.when(F.col("compound") % 19 != 0, F.col("z")))


SQL = """
WITH abundance AS (SELECT l_suppkey AS compound, l_returnflag AS condition, l_linenumber AS replicate, sum(l_quantity) AS value FROM lineitem GROUP BY ALL),
means AS (SELECT compound, condition, avg(value) AS mean, count(*) FILTER (WHERE value > 0) AS positive FROM abundance GROUP BY ALL),
cuts AS (SELECT condition, quantile_cont(mean, 0.25) AS cut FROM means GROUP BY condition),
presence AS (SELECT compound, condition, mean, CAST(mean > 0 AND mean >= cut AS INT) AS present FROM means JOIN cuts USING (condition)),
targets AS (SELECT l_suppkey AS compound, l_partkey AS target, 1 - l_discount AS probability FROM lineitem WHERE l_quantity >= 45),
best AS (SELECT compound, target, max(probability) AS weight FROM targets WHERE probability >= 0.95 GROUP BY ALL),
edges AS (SELECT condition, compound, target, weight FROM presence JOIN best USING (compound) WHERE present = 1),
descriptors AS (SELECT p_partkey AS compound, CASE WHEN p_partkey % 17 <> 0 THEN p_retailprice / 3 END AS mw, p_size / 8.0::DOUBLE - 1 AS logp, p_size % 8 AS hbd, p_partkey % 13 AS hba, p_retailprice % 200 AS tpsa,
  p_size % 14 AS rotb, p_size + 10 AS atoms, p_partkey % 6 AS rings, p_retailprice % 150 AS amr, (p_partkey % 10) / 10.0::DOUBLE AS arom FROM part),
interactions AS (SELECT a.p AS u, b.p AS v, count(*) AS score FROM (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_quantity >= 46) a JOIN (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_quantity >= 46) b ON a.o = b.o AND a.p < b.p GROUP BY ALL),
transitions AS (SELECT * FROM (SELECT user_id AS u, lead(user_id) OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS v, event_type FROM events WHERE value > 0) WHERE v IS NOT NULL AND u <> v),
zscores AS (SELECT condition, compound, CASE WHEN compound % 19 <> 0 THEN z END AS z FROM (SELECT l_returnflag AS condition, l_suppkey AS compound, (avg(l_quantity) - 25.5) * 2 AS z FROM lineitem GROUP BY ALL))
"""

"""Queries of imports, joins, keys, sets and tests over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import network, ranking, stats, tables, views
from . import bindings as b
from .registry import _enrich, _jac, _ps, _pvalues, _relations, _relations_of, query, rounded


@query("SELECT coalesce(x.r, y.r) AS row_order, c_custkey, s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) x FULL JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier) y ON x.r = y.r")
def positional_join(spark, d):
    return tables.positional(b.table(spark, d, "customer").select("c_custkey"), "c_custkey", b.table(spark, d, "supplier").select("s_suppkey"), "s_suppkey")


@query("SELECT x.n_nationkey, y.n_regionkey FROM nation x JOIN nation y ON lower(trim('  ' || lower(x.n_name))) = lower(trim(y.n_name))")
def name_join(spark, d):
    n = b.table(spark, d, "nation")
    return tables.matched_by_name(n.select("n_nationkey", F.concat(F.lit("  "), F.lower("n_name")).alias("name")), "name", n.select("n_name", "n_regionkey"), "n_name").select("n_nationkey", "n_regionkey")


_new = ", new AS (SELECT c_custkey, c_name AS name, nullif(trim(CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE c_mktsegment || (c_custkey % 500) END), '') AS smiles FROM customer) "


def _new_compounds(spark, d):
    text = F.when(F.col("c_custkey") % 7 == 0, " ").otherwise(F.concat("c_mktsegment", F.col("c_custkey") % 500))
    return b.table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), text.alias("smiles"))


@query(_new + ", kept AS (SELECT * FROM new WHERE smiles IS NOT NULL AND smiles NOT IN (SELECT 'BUILDING' || (s_suppkey % 500) FROM supplier) QUALIFY row_number() OVER (PARTITION BY smiles ORDER BY c_custkey) = 1) SELECT c_custkey, name, smiles, 'C' || lpad(CAST(17 + row_number() OVER (ORDER BY c_custkey) AS VARCHAR), CAST(greatest(4, length(CAST(17 + row_number() OVER (ORDER BY c_custkey) AS VARCHAR))) AS INT), '0') AS id FROM kept")
def compounds_prepared(spark, d):
    known = b.table(spark, d, "supplier").select(F.concat(F.lit("BUILDING"), F.col("s_suppkey") % 500).alias("smiles"))
    return tables.prepared(_new_compounds(spark, d), known, "c_custkey", 17)


_outside = ", outside AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey + 1 AS VARCHAR) END AS id, replace(c_name, 'Customer', 'Supplier') AS smiles, c_acctbal AS value FROM customer) SELECT coalesce({}.s_suppkey, {}.s_suppkey) AS compound, c_custkey, smiles, value FROM outside LEFT JOIN supplier i ON id = CAST(i.s_suppkey AS VARCHAR) LEFT JOIN supplier s ON smiles = s.s_name WHERE coalesce(i.s_suppkey, s.s_suppkey) IS NOT NULL"


def _outside_rows(spark, d):
    c = b.table(spark, d, "customer")
    rows = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, (F.col("c_custkey") + 1).cast("string")).alias("compound"), F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("smiles"), F.col("c_acctbal").alias("value"))
    return rows, b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("compound"), F.col("s_name").alias("smiles"))


@query(_outside.format("i", "s"))
def descriptor_import(spark, d):
    return tables.matched_import(*_outside_rows(spark, d))


@query(_outside.format("s", "i"))
def toxicity_import(spark, d):
    return tables.matched_import(*_outside_rows(spark, d), order=("smiles", "compound"))


@query("SELECT DISTINCT 'D1' AS disease_id, 'disease' AS disease_name, CAST(p_partkey AS VARCHAR) AS target, p_brand AS gene_symbol, round(p_retailprice, 6) AS association_score, 'curated' AS source FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 11 <> 0")
def gene_list(spark, d):
    k = F.col("p_partkey")
    p = b.table(spark, d, "part").select(F.when(k % 9 == 0, "NA").when(k % 11 == 0, " ").otherwise(k.cast("string")).alias("UniProt_ID"), F.col("p_brand").alias("gene.symbol"), F.col("p_retailprice").alias("Relevance Score"))
    return rounded(tables.gene_list(p.union(p), "D1", "disease", "curated"), "association_score")


@query("SELECT l_suppkey AS compound, CAST(l_partkey AS VARCHAR) AS target, l_returnflag AS target_name, l_linestatus AS kind, l_quantity AS value FROM lineitem WHERE l_linenumber <> 3 AND l_returnflag <> 'R'")
def bioactivities(spark, d):
    li = b.table(spark, d, "lineitem")
    rows = li.select(F.col("l_suppkey").alias("compound"), F.when(F.col("l_linenumber") == 3, " ").otherwise(F.col("l_partkey").cast("string")).alias("target"), F.col("l_returnflag").alias("target_name"), F.col("l_linestatus").alias("kind"), F.col("l_quantity").alias("value"))
    return tables.bioactivities(rows, ["r"])


@query("SELECT s_suppkey AS compound, CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_nationkey AS VARCHAR) WHEN s_acctbal > 0 THEN 'new' END AS class, CASE WHEN s_suppkey % 4 <> 0 THEN 'old' WHEN s_acctbal > 0 THEN 'api' END AS source FROM supplier")
def class_labels(spark, d):
    s = b.table(spark, d, "supplier")
    old = s.select(F.col("s_suppkey").alias("compound"), F.col("s_nationkey").cast("string").alias("class"), F.lit("old").alias("source"))
    labels = s.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("compound"), F.lit("new").alias("class"), F.lit("api").alias("source"))
    return tables.classes_upserted(old, s.filter("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("compound")), labels)


@query("SELECT target, gene_symbol, round(score, 6) AS score FROM (SELECT l_partkey AS target, CAST(l_suppkey AS VARCHAR) AS gene_symbol, CASE WHEN l_linenumber <> 2 THEN l_extendedprice END AS score FROM lineitem) QUALIFY row_number() OVER (PARTITION BY target ORDER BY score DESC NULLS LAST, gene_symbol) = 1")
def best_symbols(spark, d):
    li = b.table(spark, d, "lineitem")
    rows = li.select(F.col("l_partkey").alias("target"), F.col("l_suppkey").cast("string").alias("gene_symbol"), F.when(F.col("l_linenumber") != 2, F.col("l_extendedprice")).alias("score"))
    return rounded(tables.best_symbols(rows), "score")


@query(", m AS (SELECT l_suppkey AS compound, 'M' || l_partkey AS molecule, l_partkey AS number, CASE WHEN l_linenumber = 1 THEN 'M' || l_partkey ELSE 'M1' END AS parent, CASE WHEN l_returnflag = 'A' THEN 'x' END AS name FROM lineitem) SELECT compound, molecule FROM m QUALIFY row_number() OVER (PARTITION BY compound ORDER BY molecule = parent DESC, name IS NOT NULL DESC, number, molecule) = 1")
def best_molecule(spark, d):
    li = b.table(spark, d, "lineitem")
    molecule = F.concat(F.lit("M"), "l_partkey")
    rows = li.select(F.col("l_suppkey").alias("compound"), molecule.alias("molecule"), F.when(F.col("l_linenumber") == 1, molecule).otherwise("M1").alias("parent"), F.when(F.col("l_returnflag") == "A", "x").alias("name"))
    return views.best_molecule(rows).select("compound", "molecule")


@query("SELECT 'both' AS kind, target FROM (SELECT target FROM edges WHERE condition = 'A' INTERSECT SELECT target FROM edges WHERE condition = 'R') UNION ALL SELECT 'only', target FROM (SELECT target FROM edges WHERE condition = 'A' EXCEPT SELECT target FROM edges WHERE condition = 'N')")
def target_sets(spark, d):
    of = lambda c: b.edges(spark, d).filter(F.col("condition") == c).select("target")
    return of("A").intersect(of("R")).select(F.lit("both").alias("kind"), "target").unionByName(of("A").subtract(of("N")).select(F.lit("only").alias("kind"), "target"))


@query(", u AS (SELECT p_partkey AS g, p_type LIKE 'S%' AS in_b, p_partkey IN (SELECT target FROM edges WHERE condition = 'A') AS in_a FROM part), c AS (SELECT count(*) FILTER (WHERE in_a AND in_b) AS k, count(*) FILTER (WHERE in_a) AS n, count(*) FILTER (WHERE in_b) AS m, count(*) AS size FROM u) SELECT k, n, m, size, round((SELECT sum(exp(lgamma(m + 1) - lgamma(j + 1) - lgamma(m - j + 1) + lgamma(size - m + 1) - lgamma(n - j + 1) - lgamma(size - m - n + j + 1) - lgamma(size + 1) + lgamma(n + 1) + lgamma(size - n + 1))) FROM range(k, least(n, m) + 1) t(j) WHERE n - j <= size - m), 6) AS pvalue, round(k * size / (n * m), 6) AS fold FROM c")
def disease_overlap(spark, d):
    p = b.table(spark, d, "part").select(F.col("p_partkey").alias("gene"), "p_type")
    hit = b.edges(spark, d).filter("condition = 'A'").select(F.col("target").alias("gene"))
    return rounded(stats.overlap_test(hit, p.filter("p_type like 'S%'"), p), "pvalue", "fold")


@query(_jac + "SELECT condition, a, b, round(2 * shared / (n_a + n_b), 6) AS dice, round(shared / sqrt(n_a * n_b), 6) AS cosine FROM jac")
def set_similarity(spark, d):
    pairs = network.pair_jaccard(b.edges(spark, d), ["condition"], "compound", "target")
    out = stats.set_similarity(stats.set_similarity(pairs, "dice").withColumnRenamed("similarity", "dice"), "cosine").withColumnRenamed("similarity", "cosine")
    return rounded(out, "dice", "cosine").select("condition", "a", "b", "dice", "cosine")


_last = _ps + ", harmonic AS (SELECT sum(1.0::DOUBLE / i) AS h FROM range(1, (SELECT count(p) FROM p) + 1) t(i)), l AS (SELECT o_orderkey, p, m, count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS last_ FROM r) "


@query(_last + "SELECT o_orderkey, round(q, 6) AS q FROM p LEFT JOIN (SELECT o_orderkey, least(1, min((m - last_ + 1) * p) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM l) USING (o_orderkey)")
def adjust_hochberg(spark, d):
    return rounded(stats.adjusted(_pvalues(spark, d), "p", "q", "hochberg"), "q").select("o_orderkey", "q")


@query(_last + "SELECT o_orderkey, round(q, 6) AS q FROM p LEFT JOIN (SELECT o_orderkey, least(1, min(h * m * p / last_) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM l, harmonic) USING (o_orderkey)")
def adjust_by(spark, d):
    return rounded(stats.adjusted(_pvalues(spark, d), "p", "q", "BY"), "q").select("o_orderkey", "q")


@query("SELECT compound, n, round(mean, 6) AS null_mean, round(sd, 6) AS null_sd, round(CASE WHEN sd > 0 THEN (25 - mean) / sd END, 6) AS z_score, round((1 + low) / (n + 1), 6) AS p_empirical FROM (SELECT l_suppkey AS compound, count(*) AS n, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS sd, count(*) FILTER (WHERE l_quantity <= 25) AS low FROM lineitem GROUP BY 1)")
def empirical_scores(spark, d):
    draws = b.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("compound")).agg(F.collect_list(F.col("l_quantity").cast("double")).alias("draws"), F.count("*").alias("n")).withColumn("observed", F.lit(25.0))
    return rounded(stats.empirical(draws, "observed", "draws"), "null_mean", "null_sd", "z_score", "p_empirical").select("compound", "n", "null_mean", "null_sd", "z_score", "p_empirical")


@query(_relations + ", near AS (SELECT CAST(source AS VARCHAR) AS gene, 'out|' || sink || '|' || effect AS n FROM rel UNION SELECT CAST(sink AS VARCHAR), 'in|' || source || '|' || effect FROM rel), sig AS (SELECT gene, string_agg(n, ';' ORDER BY n) AS s FROM near GROUP BY gene) SELECT gene, min(gene) OVER (PARTITION BY s) AS representative FROM sig")
def signed_twins(spark, d):
    return views.signed_twins(_relations_of(spark, d))


@query(None)
def network_synergy(spark, d):
    """Pairs of the ten most proximal compounds of each condition; distances on the interactions' largest component."""
    from ..operators import paths

    z = b.zscores(spark, d).withColumn("p", F.when(F.col("compound") % 3 != 0, F.lit(0.01)))
    best = tables.first_of_group(z.filter("z is not null"), ["condition"], [F.col("z"), F.col("compound")], 10)
    net = b.interactions(spark, d)
    inside = b.edges(spark, d).join(best.select("condition", "compound"), ["condition", "compound"]).join(paths.largest_component(net).withColumnRenamed("node", "target"), "target", "left_semi")
    members = inside.select(F.col("target").alias("draw"), F.col("target").alias("node")).distinct()
    far = paths.multi_source_hops(net, members, members).withColumnRenamed("draw", "source")
    out = ranking.pair_synergy(z, inside, far)
    return rounded(out, "d_aa", "d_bb", "d_ab", "separation", "jaccard", "z_a", "z_b", "synergy")


@query(_enrich + "SELECT term, max(round(p_adjusted, 5)) AS worst, count(*) AS n FROM adj GROUP BY term")
def enrichment_spread(spark, d):
    from .registry import _enriched

    return rounded(_enriched(spark, d), "p_adjusted", digits=5).groupBy("term").agg(F.max("p_adjusted").alias("worst"), F.count("*").alias("n"))

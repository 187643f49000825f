"""Bipartite networks by condition, layers, motifs, comparisons and figure tables. The condition is a column, never a loop."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import checkpointed
from .screen import isfinite, penalised

#: Items of a block; two blocks meet in one cell, whose pairs are made at once.
BLOCK_ITEMS = 1024
#: Rows of a join on the shared element up to which pairs come from it, as the number of rows a member row makes, and in any case.
JOIN_SHARE, JOIN_ROWS = 50, 2_000_000


def built(presence: DataFrame, targets: DataFrame, min_score: float | None = None) -> DataFrame:
    """Edges condition, compound, target, weight: present compounds with their targets, the largest weight of each pair.

    `targets`: compound, target, probability. With `min_score`, lower and null probabilities are dropped.
    """
    kept = targets if min_score is None else targets.filter(F.col("probability") >= min_score)
    best = kept.groupBy("compound", "target").agg(F.max("probability").alias("weight"))
    return presence.filter("present = 1").select("condition", "compound").join(best, "compound").select("condition", "compound", "target", "weight")


def vertices(presence: DataFrame, edges: DataFrame) -> DataFrame:
    """condition, node, node_type: present compounds, isolated ones too, and the targets they hit."""
    own = presence.filter("present = 1").select("condition", F.col("compound").cast("string").alias("node"), F.lit("compound").alias("node_type"))
    return own.unionByName(edges.select("condition", F.col("target").cast("string").alias("node"), F.lit("target").alias("node_type"))).distinct()


def hub_penalty(presence: DataFrame, edges: DataFrame) -> DataFrame:
    """Per condition and target: its degree and degree * ln(compounds / degree), over the condition's present compounds."""
    n = presence.filter("present = 1").groupBy("condition").agg(F.count("*").alias("n_compounds_total"))
    degree = edges.groupBy("condition", "target").agg(F.countDistinct("compound").alias("degree_raw"))
    return degree.join(F.broadcast(n), "condition").withColumn("score_adjusted", penalised(F.col("degree_raw"), F.col("n_compounds_total")))


def degrees(edges: DataFrame) -> DataFrame:
    """condition, node_type, node, degree, and the degree over the size of the other side (of nodes with an edge)."""
    sides = [edges.groupBy("condition", F.col(own).cast("string").alias("node")).agg(F.countDistinct(other).alias("degree")).withColumn("node_type", F.lit(own)) for own, other in (("compound", "target"), ("target", "compound"))]
    both = sides[0].unionByName(sides[1])
    sizes = both.groupBy("condition", "node_type").agg(F.count("*").alias("n_other"))
    other = sizes.withColumn("node_type", F.when(F.col("node_type") == "compound", "target").otherwise("compound"))
    return both.join(F.broadcast(other), ["condition", "node_type"]).withColumn("degree_norm", F.col("degree") / F.col("n_other"))


def largest_betweenness(own: Column, other: Column) -> Column:
    """The largest betweenness a node can have in a bipartite graph of these side sizes; null if that is 0."""
    n, m = own, other
    s, t = F.floor((n - 1) / m), (n - 1) % m
    top = 0.5 * (m * m * (s + 1) * (s + 1) + m * (s + 1) * (2 * t - s - 1) - t * (2 * s - t + 3))
    return F.nullif(top, F.lit(0.0))


def layered(edges: DataFrame, memberships: dict[str, DataFrame]) -> DataFrame:
    """A layered digraph: compound to target, target to each named set (columns target, name), and the derived compound to set.

    Columns condition, source, sink, source_layer, sink_layer, edge_kind.
    """
    def edge(df: DataFrame, a: str, b: str, la: str, lb: str, kind: str) -> DataFrame:
        return df.select("condition", F.col(a).cast("string").alias("source"), F.col(b).cast("string").alias("sink"), F.lit(la).alias("source_layer"), F.lit(lb).alias("sink_layer"), F.lit(kind).alias("edge_kind"))

    out = edge(edges, "compound", "target", "compound", "target", "compound_target")
    for layer, sets in memberships.items():
        hits = edges.join(sets.select("target", "name").distinct(), "target")
        out = out.unionByName(edge(hits, "target", "name", "target", layer, f"target_{layer}")).unionByName(edge(hits, "compound", "name", "compound", layer, f"compound_{layer}"))
    return out.distinct()


def motifs(edges: DataFrame, keys: Sequence[str] = ("condition",), source: str = "source", sink: str = "sink") -> DataFrame:
    """Paths a to b to c (a is not c) that close: feed-forward with a to c, feedback with c to a. A cycle gives its three rotations."""
    k = list(keys)
    e = edges.select(*k, F.col(source).alias("a"), F.col(sink).alias("b")).distinct()
    paths = e.join(e.select(*k, F.col("a").alias("b"), F.col("b").alias("c")), [*k, "b"]).filter("a <> c")
    forward = paths.join(e.select(*k, "a", F.col("b").alias("c")), [*k, "a", "c"], "left_semi").withColumn("motif_type", F.lit("feed_forward"))
    back = paths.join(e.select(*k, F.col("a").alias("c"), F.col("b").alias("a")), [*k, "a", "c"], "left_semi").withColumn("motif_type", F.lit("feedback"))
    return forward.unionByName(back).select(*k, "motif_type", F.col("a").alias("node_a"), F.col("b").alias("node_b"), F.col("c").alias("node_c"))


def distinct_cycles(motif_rows: DataFrame, keys: Sequence[str] = ("condition",)) -> DataFrame:
    """Number of motifs by type, the rotations of a feedback cycle counted once: the one that starts with its least node."""
    once = motif_rows.filter("motif_type = 'feed_forward' or node_a = least(node_a, node_b, node_c)")
    return once.groupBy(*keys, "motif_type").agg(F.count("*").alias("n"))


def in_cells(rows: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """Rows dealt to blocks by a hash of the item, and copied to the cells (__i <= __j) of their block with every block of their group; __left and __right tell in which place.

    All pairs of a group's items meet in just one cell each. A cell's size does
    not depend on the table's, and the number of cells grows with its square, as
    the pairs do. Null keys and items make no pairs.
    """
    k = list(keys)
    known = rows.dropna(subset=[*k, item])
    most = (known.groupBy(*k) if k else known.groupBy()).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    blocks = max(1, -(-most // BLOCK_ITEMS))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = known.withColumn("__b", F.pmod(F.xxhash64(item), F.lit(blocks)).cast("int")).withColumn("__o", other)
    dealt = dealt.withColumns({"__i": F.least("__b", "__o"), "__j": F.greatest("__b", "__o"), "__left": F.col("__b") <= F.col("__o"), "__right": F.col("__b") >= F.col("__o")}).drop("__b", "__o")
    # A given number of partitions stays: small rows make many pairs.
    parts = min(blocks * (blocks + 1) // 2 * 3, 4096) if blocks > 1 else max(1, rows.sparkSession.sparkContext.defaultParallelism)
    return dealt.repartition(parts, *k, "__i", "__j")


def all_pairs(rows: DataFrame, keys: Sequence[str], item: str, columns: Sequence[str]) -> DataFrame:
    """All pairs a < b of the items of each group, with both values of each column (c_a, c_b)."""
    k = list(keys)
    cells = in_cells(rows.select(*k, item, *columns), k, item)
    on = [*k, "__i", "__j"]
    side = lambda x, flag: cells.filter(flag).select(*on, F.col(item).alias(f"__{x}"), *[F.col(c).alias(f"__{c}_{x}") for c in columns])
    pairs = side("x", "__left").join(side("y", "__right").hint("shuffle_hash"), on).filter("__i < __j and __x <> __y or __x < __y")
    less = F.col("__x") < F.col("__y")
    return pairs.select(*k, F.least("__x", "__y").alias("a"), F.greatest("__x", "__y").alias("b"), *[F.when(less, F.col(f"__{c}_{p}")).otherwise(F.col(f"__{c}_{q}")).alias(f"{c}_{n}") for c in columns for n, p, q in (("a", "x", "y"), ("b", "y", "x"))])


def incidence(sets: list[pa.Array]) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """Rows and numbered elements of several lists of sets, and how many elements there are."""
    flat = pa.chunked_array([s.flatten() for s in sets]).combine_chunks().dictionary_encode()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    codes, out, at = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), [], 0
    for s in sets:
        size = pc.fill_null(pc.list_value_length(s), 0).to_numpy(zero_copy_only=False)
        out.append((np.repeat(np.arange(len(s)), size), codes[at : at + int(size.sum())]))
        at += int(size.sum())
    return out, len(flat.dictionary)


def shared_counts(left: pa.Array, right: pa.Array) -> np.ndarray:
    """How many elements each set of one list shares with each of another: a matrix product, or the pairs on each element, whichever is less work."""
    (((x, e), (y, f)), many), shape = incidence([left, right]), (len(left), len(right))
    joined = int((np.bincount(e, minlength=many) * np.bincount(f, minlength=many)).sum())
    if shape[0] * shape[1] * many < 200 * joined and many <= 8 * BLOCK_ITEMS:
        a, b = np.zeros((shape[0], many), np.float32), np.zeros((shape[1], many), np.float32)
        a[x, e], b[y, f] = 1, 1
        return (a @ b.T).astype(np.int32)
    total, order = np.zeros(shape[0] * shape[1], np.int32), np.argsort(f, kind="stable")
    y, start, size = y[order], np.searchsorted(f[order], np.arange(many)), np.bincount(f, minlength=many)
    # So many member rows at once that they make about a million pairs.
    for part in np.split(np.arange(len(e)), np.flatnonzero(np.diff(np.cumsum(size[e]) // 1_000_000)) + 1):
        n = size[e[part]]
        at = np.repeat(start[e[part]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        np.add.at(total, np.repeat(x[part], n) * shape[1] + y[at], 1)
    return total.reshape(shape)


def grid_overlaps(sets: DataFrame, keys: Sequence[str], n_sets: int, least: float = 0.0) -> DataFrame:
    """Pairs a < b of items that share an element of set 0, with size and shared elements of every set; with `least`, only of that Jaccard of set 0.

    sets: keys, item, and for each set s its elements e{s} (null: none) and its size n{s}. Returns keys, a, b, shared{s}, n_a{s}, n_b{s}.
    """
    k, types = list(keys), dict(sets.dtypes)
    cells = in_cells(sets, k, "item")
    numbers = [f"{c}{s}" for s in range(n_sets) for c in ("shared", "n_x", "n_y")]
    schema = ", ".join([*(f"{c} {types[c]}" for c in k), f"x {types['item']}", f"y {types['item']}", *(f"{c} bigint" for c in numbers)])

    def run(t: pa.Table) -> pa.Table:
        same = t.column("__i")[0].as_py() == t.column("__j")[0].as_py()
        left, right = t.filter(t.column("__left")), t.filter(t.column("__right"))
        part = lambda u, c: pa.concat_arrays(u.column(c).chunks)
        if not (left.num_rows and right.num_rows):
            return pa.table({c: t.column(c).slice(0, 0) for c in k} | {c: t.column("item").slice(0, 0) for c in "xy"} | {c: pa.array([], pa.int64()) for c in numbers})
        shared = [shared_counts(part(left, f"e{s}"), part(right, f"e{s}")) for s in range(n_sets)]
        hit = np.triu(shared[0], 1) > 0 if same else shared[0] > 0
        sizes = [[u.column(f"n{s}").to_numpy() for u in (left, right)] for s in range(n_sets)]
        if least:
            hit &= shared[0] / (sizes[0][0][:, None] + sizes[0][1][None, :] - shared[0]) >= least
        x, y = np.nonzero(hit)
        out = {c: pa.repeat(t.column(c)[0], len(x)) for c in k}
        out |= {"x": part(left, "item").take(pa.array(x)), "y": part(right, "item").take(pa.array(y))}
        for s in range(n_sets):
            out |= {f"shared{s}": pa.array(shared[s][x, y].astype(np.int64)), f"n_x{s}": pa.array(sizes[s][0][x]), f"n_y{s}": pa.array(sizes[s][1][y])}
        return pa.table(out)

    pairs = cells.groupBy(*k, "__i", "__j").applyInArrow(run, schema)
    less = F.col("x") < F.col("y")
    turned = [F.when(less, F.col(f"n_{p}{s}")).otherwise(F.col(f"n_{q}{s}")).alias(f"n_{n}{s}") for s in range(n_sets) for n, p, q in (("a", "x", "y"), ("b", "y", "x"))]
    return pairs.select(*k, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *[f"shared{s}" for s in range(n_sets)], *turned)


def collected(members: DataFrame, keys: Sequence[str], s: int = 0) -> DataFrame:
    """keys, item, its known elements e{s}, and its size n{s}, which counts a null element too."""
    return members.groupBy(*keys, "item").agg(F.collect_list("element").alias(f"e{s}"), F.count("*").alias(f"n{s}"))


def few_joined(members: DataFrame, keys: Sequence[str]) -> bool:
    """Whether a join of members on the shared element is small beside them."""
    degree = members.groupBy(*keys, "element").agg(F.count("*").cast("double").alias("n"))
    made = degree.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("rows"), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0.0)).alias("joined")).first()
    return made.joined <= max(JOIN_ROWS, JOIN_SHARE * made.rows)


def distinct_members(members: DataFrame, keys: Sequence[str], item: str, element: str) -> DataFrame:
    return checkpointed(members.select(*keys, F.col(item).alias("item"), F.col(element).alias("element")).distinct())


def pair_jaccard(members: DataFrame, keys: Sequence[str], item: str, element: str, least: float = 0.0) -> DataFrame:
    """Unordered pairs of items (a < b) that share an element: shared, sizes and Jaccard by group; with `least`, only pairs of that Jaccard.

    Where few items share an element, pairs come from an equi-join on it. Where
    many do, that join would be many times larger than the pairs: items are then
    compared block by block, and no pair is shuffled. Both ways give the same rows.
    """
    k = list(keys)
    m = distinct_members(members, k, item, element)
    if few_joined(m, k):
        sizes = m.groupBy(*k, "item").agg(F.count("*").alias("n"))
        left, right = m.select(*k, "element", F.col("item").alias("a")), m.select(*k, "element", F.col("item").alias("b"))
        shared = left.join(right, [*k, "element"]).filter("a < b").groupBy(*k, "a", "b").agg(F.count("*").alias("shared"))
        out = shared.join(sizes.select(*k, F.col("item").alias("a"), F.col("n").alias("n_a")), [*k, "a"]).join(sizes.select(*k, F.col("item").alias("b"), F.col("n").alias("n_b")), [*k, "b"])
    else:
        found = grid_overlaps(collected(m, k), k, 1, least)
        out = found.select(*k, "a", "b", F.col("shared0").alias("shared"), F.col("n_a0").alias("n_a"), F.col("n_b0").alias("n_b"))
    out = out.select(*k, "a", "b", "shared", "n_a", "n_b", (F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("jaccard"))
    return out.filter(F.col("jaccard") >= least) if least else out


def compared(z: DataFrame, hits: DataFrame, genes: DataFrame, aggregate: str = "mean") -> DataFrame:
    """Per condition: mean, median, sd and best of the finite z, compounds, and the share of disease genes hit; ascending by `aggregate`.

    z: condition, compound, z. hits: condition, target. genes: target.
    """
    s = z.filter(isfinite(F.col("z"))).groupBy("condition").agg(F.avg("z").alias("mean_z"), F.median("z").alias("median_z"), F.stddev_samp("z").alias("sd_z"), F.min("z").alias("best_z"), F.countDistinct("compound").alias("n_compounds"))
    wanted = genes.select("target").distinct()
    total = wanted.agg(F.count("*").alias("n_genes"))
    got = hits.join(wanted, "target", "left_semi").groupBy("condition").agg(F.countDistinct("target").alias("n_hit"))
    out = s.join(got, "condition", "left").crossJoin(F.broadcast(total)).withColumn("n_hit", F.coalesce("n_hit", F.lit(0)))
    return out.withColumn("coverage", F.try_divide(F.col("n_hit"), F.col("n_genes"))).orderBy(F.col(f"{aggregate}_z").asc_nulls_last(), "condition")


def upset(members: DataFrame, condition: str, element: str, conditions: Sequence[str]) -> DataFrame:
    """Sizes of exact intersections: a 0/1 string over the given conditions, and the number of elements with it."""
    bits = F.concat(*[F.max((F.col(condition) == c).cast("int")).cast("string") for c in conditions])
    return members.groupBy(element).agg(bits.alias("combination")).groupBy("combination").agg(F.count("*").alias("n"))


def venn(members: DataFrame, condition: str, element: str, a: str, b: str) -> DataFrame:
    """Sizes of two sets, their overlap and their union, in one pass."""
    flags = members.groupBy(element).agg(F.bool_or(F.col(condition) == a).alias("a"), F.bool_or(F.col(condition) == b).alias("b"))
    return flags.agg(F.count_if("a").alias("n_a"), F.count_if("b").alias("n_b"), F.count_if(F.col("a") & F.col("b")).alias("n_both"), F.count_if(F.col("a") | F.col("b")).alias("n_union"))


def heatmap(edges: DataFrame, top: int) -> DataFrame:
    """Largest weight by compound and target for the top targets by breadth, then weight; absent cells are 0."""
    rank = edges.groupBy("target").agg(F.countDistinct("compound").alias("breadth"), F.max("weight").alias("w")).orderBy(F.desc("breadth"), F.desc_nulls_last("w"), "target").limit(top).select("target")
    cells = edges.join(F.broadcast(rank), "target").groupBy("compound", "target").agg(F.max("weight").alias("weight"))
    grid = edges.select("compound").distinct().crossJoin(F.broadcast(rank))
    return grid.join(cells, ["compound", "target"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def sharing_cut(edges: DataFrame, most: int) -> DataFrame:
    """The least k of 2 or more such that at most `most` targets are shared by k compounds or more, else the largest degree; one row."""
    degree = edges.groupBy("target").agg(F.countDistinct("compound").alias("k"))
    counts = degree.groupBy("k").agg(F.count("*").alias("n"))
    tail = counts.withColumn("at_least", F.sum("n").over(Window.orderBy(F.desc("k"))))
    # k may lie between degrees: the first degree whose tail is small enough, or one over the last that is too large.
    large = tail.agg(F.max(F.when(F.col("at_least") > most, F.col("k"))).alias("too_many"), F.max("k").alias("largest"))
    return large.select(F.least(F.greatest(F.lit(2), F.coalesce(F.col("too_many") + 1, F.lit(2))), F.greatest("largest", F.lit(2))).alias("k"))


def condition_flow(members: DataFrame, group: str, least: int, other: str = "other") -> DataFrame:
    """Compounds by condition and group; groups of fewer than `least` compounds in all are pooled."""
    size = members.groupBy(group).agg(F.countDistinct("compound").alias("size"))
    named = members.join(size, group).withColumn("flow", F.when(F.col("size") < least, other).otherwise(F.col(group)))
    return named.groupBy("condition", "flow").agg(F.countDistinct("compound").alias("n"))


def chord(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """Target pairs with the largest score of either direction, both ends in the network (scores: u, v, score)."""
    own = edges.select(F.col("target")).distinct()
    pairs = scores.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "score").filter("a <> b").groupBy("a", "b").agg(F.max("score").alias("score"))
    return pairs.join(own.withColumnRenamed("target", "a"), "a", "left_semi").join(own.withColumnRenamed("target", "b"), "b", "left_semi")


def term_overlap(terms: DataFrame, least: float) -> DataFrame:
    """Pairs of terms (columns term, gene) with a Jaccard of at least `least`."""
    return pair_jaccard(terms, [], "term", "gene", least)


def synergy_class(separated: Column, proximal: Column) -> Column:
    """P1 to P6 from topological separation and the number of proximal compounds of a pair; null if either is."""
    cells = {(False, 2): "P1", (True, 2): "P2", (False, 1): "P3", (True, 1): "P4", (False, 0): "P5", (True, 0): "P6"}
    out = F.lit(None).cast("string")
    for (s, p), name in cells.items():
        out = F.when((separated == s) & (proximal == p), name).otherwise(out)
    return out


def proximal(z: Column, p: Column, alpha: float = 0.05) -> Column:
    """Negative z, and p under alpha where there is a p."""
    return F.when(z.isNull(), None).when(p.isNull(), z < 0).otherwise((z < 0) & (p < alpha))

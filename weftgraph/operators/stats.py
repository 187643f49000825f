"""Multiple testing, over-representation, permutation tests, rank aggregation and Pareto fronts."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import checkpointed


def harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m: a sum for few terms, else its asymptotic series, which is exact to double precision there."""
    x = m.cast("double")
    few = F.aggregate(F.sequence(F.lit(1), F.least(m, F.lit(64)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / i)
    return F.when(m <= 64, few).otherwise(F.ln(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x))


def adjusted(df: DataFrame, p: str, out: str = "p_adjusted", method: str = "BH", family: Sequence[str] = ()) -> DataFrame:
    """Adjusted p-values over each family (all rows by default); null p stay null and do not count.

    Equal p get equal results, so a family is first reduced to its distinct p
    with their numbers. These are written in ranges of p; sums and extremes over
    ranges carry over from one range to the next, so no task sees more than a range.
    """
    keys = list(family)
    known = df.filter(F.col(p).isNotNull())
    # Ranges come from a sample of the rows and so hold only for what is written.
    ranged = known.groupBy(*keys, p).agg(F.count("*").alias("__n")).repartitionByRange(*keys, p).withColumn("__range", F.spark_partition_id())
    steps = checkpointed(ranged)
    value, m = F.col(p), F.col("__m")
    # Running values within a range go in one direction only: a frame that ends with the range would be summed anew for each row.
    here = Window.partitionBy(*keys, "__range")
    up, down = (here.orderBy(o).rowsBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc(p), F.desc(p)))
    ranges = Window.partitionBy(*keys)
    before, after = ranges.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1), ranges.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)

    def met(rows: DataFrame, few: DataFrame, on: Sequence[str]) -> DataFrame:
        """Null keys of a family meet null keys."""
        cond = F.lit(True)
        for c in on:
            cond = cond & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
        return rows.alias("l").join((few if keys else F.broadcast(few)).alias("r"), cond).select("l.*", *[f"r.{c}" for c in few.columns if c not in on])

    sizes = steps.groupBy(*keys, "__range").agg(F.sum("__n").alias("__size"))
    sizes = sizes.select(*keys, "__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"), F.sum("__size").over(ranges).alias("__m"))
    steps = met(steps, sizes, [*keys, "__range"]).withColumn("__last", F.col("__before") + F.sum("__n").over(up))
    first = F.col("__last") - F.col("__n") + 1
    if method == "BH":
        q, way, order, rest = m * value / F.col("__last"), F.min, down, after
    elif method == "BY":
        q, way, order, rest = harmonic(m) * m * value / F.col("__last"), F.min, down, after
    elif method == "hochberg":
        q, way, order, rest = (m - F.col("__last") + 1) * value, F.min, down, after
    elif method == "holm":
        q, way, order, rest = (m - first + 1) * value, F.max, up, before
    elif method == "bonferroni":
        q, way, order, rest = m * value, None, None, None
    else:
        raise ValueError(f"unknown method {method!r}")
    steps = steps.withColumn(out, q)
    if way:
        carried = steps.groupBy(*keys, "__range").agg(way(out).alias("__q")).select(*keys, "__range", way("__q").over(rest).alias("__carried"))
        both = F.least if way is F.min else F.greatest
        steps = met(steps, carried, [*keys, "__range"]).withColumn(out, both(way(out).over(order), "__carried"))
    done = steps.select(*keys, p, F.least(F.lit(1.0), out).alias(out), F.lit(0).alias("__salt"))
    # Rows without p meet nothing; dealt by a salt, they do not land in one task.
    salt = F.when(F.col(p).isNull(), F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if "map" not in kind and "variant" not in kind]), F.lit(64)).cast("int")).otherwise(F.lit(0))
    left, right = df.withColumn("__salt", salt).alias("l"), done.alias("r")
    cond = F.col("l.__salt") == F.col("r.__salt")
    for c in [*keys, p]:
        cond = cond & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return left.join(right, cond, "left").select(*[f"l.{c}" for c in df.columns], f"r.{out}")


def hypergeometric_tail(df: DataFrame, k: str, n: str, K: str, N: str, out: str = "pvalue") -> DataFrame:
    """P(X >= k) of drawing n from N with K marked; 1 for k = 0, null if N is less than n or K.

    Each tail's terms follow from one another by a ratio, so only its first term
    needs factorials, which come from Stirling's series beyond a small table.
    """
    kk, nn, KK, NN = (F.col(c).cast("double") for c in (k, n, K, N))

    def lnf(x: Column) -> Column:
        y = x + 1
        # ln(Gamma(y)), shifted by seven so that the series is exact to double precision.
        z = y + 7
        series = (z - 0.5) * F.ln(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5))) - 1 / (1680 * F.pow(z, F.lit(7)))
        product = y * (y + 1) * (y + 2) * (y + 3) * (y + 4) * (y + 5) * (y + 6)
        return series - F.ln(product)

    def lnc(a: Column, b: Column) -> Column:
        return lnf(a) - lnf(b) - lnf(a - b)

    low = F.greatest(kk, nn + KK - NN, F.lit(0.0))
    top = F.least(nn, KK)
    first = F.exp(lnc(KK, low) + lnc(NN - KK, nn - low) - lnc(NN, nn))
    steps = F.sequence(low.cast("int"), F.greatest(top - 1, low).cast("int"))
    start = F.struct(first.alias("t"), first.alias("s"))

    def add(a: Column, j: Column) -> Column:
        t = F.when(j < top, a["t"] * (KK - j) * (nn - j) / ((j + 1) * (NN - KK - nn + j + 1))).otherwise(F.lit(0.0))
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    tail = F.aggregate(steps, start, add, lambda a: F.least(a["s"], F.lit(1.0)))
    value = F.when(NN < F.greatest(nn, KK), None).when(kk <= 0, 1.0).when(kk > top, 0.0).otherwise(tail)
    return df.withColumn(out, value)


def over_represented(hits: DataFrame, terms: DataFrame, universe: DataFrame, keys: Sequence[str] = ("condition",), method: str = "BH") -> DataFrame:
    """Terms over-represented among each group's genes: counts, ratios, p, adjusted p over all rows, and the genes, joined by '/'.

    hits: keys, gene. terms: term, gene. universe: gene; genes outside it do not count.
    """
    k = list(keys)
    base = universe.select("gene").distinct()
    own = hits.select(*k, "gene").distinct().join(base, "gene", "left_semi")
    marked = terms.select("term", "gene").distinct().join(base, "gene", "left_semi")
    size = base.agg(F.count("*").alias("n_universe"))
    drawn, marks = own.groupBy(*k).agg(F.count("*").alias("n_drawn")), marked.groupBy("term").agg(F.count("*").alias("n_marked"))
    found = own.join(marked, "gene").groupBy(*k, "term").agg(F.count("*").alias("n_hit"), F.array_join(F.sort_array(F.collect_list(F.col("gene").cast("string"))), "/").alias("genes"))
    rows = found.join(drawn, k).join(marks, "term").crossJoin(F.broadcast(size))  # one row
    tested = hypergeometric_tail(rows, "n_hit", "n_drawn", "n_marked", "n_universe")
    tested = tested.withColumn("gene_ratio", F.concat_ws("/", "n_hit", "n_drawn")).withColumn("background_ratio", F.concat_ws("/", "n_marked", "n_universe")).withColumn("fold", (F.col("n_hit") / F.col("n_drawn")) / (F.col("n_marked") / F.col("n_universe")))
    return adjusted(tested, "pvalue", method=method)


def empirical(df: DataFrame, observed: str, draws: str, tail: str = "left") -> DataFrame:
    """z and empirical p of an observation against an array of null draws: p = (1 + extreme draws) / (1 + draws); z is null without spread."""
    d, x = F.col(draws), F.col(observed)
    n = F.size(d)
    mean = F.aggregate(d, F.lit(0.0), lambda s, v: s + v) / n
    sd = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / (n - 1))
    extreme = F.size(F.filter(d, lambda v: v <= x if tail == "left" else v >= x))
    return df.withColumns({"null_mean": mean, "null_sd": F.when(n > 1, sd), "z_score": F.when((n > 1) & (sd > 0), (x - mean) / sd), "p_empirical": (1 + extreme) / (n + 1)})


def permutation_test(df: DataFrame, group: str, item: str, value: str, n_perm: int = 10_000, seed: int = 1, parts: int = 32) -> DataFrame:
    """Per group: the mean over its items of their mean value, against `n_perm` draws of as many items from all, two-sided.

    Draws are dealt to `parts` tasks a group, each of which holds the items'
    values; a draw follows from seed, group and number alone.
    """
    known = df.filter(F.col(value).isNotNull())
    per_item = known.groupBy(item).agg(F.avg(value).alias("v"))
    own = known.select(group, item).distinct().join(per_item, item)
    observed = own.groupBy(group).agg(F.avg("v").alias("observed"), F.count("*").alias("size"))
    dealt = observed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(per_item, F.lit(True))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item)
        first = pdf.iloc[0]
        v, k = pdf["v"].to_numpy(), int(first["size"])
        key = zlib.crc32(str(first[group]).encode())
        means = np.array([np.random.default_rng([seed, key, n]).choice(v, k, replace=False).mean() for n in range(int(first["part"]), n_perm, parts)])
        return pd.DataFrame({group: [first[group]], "lo": [int((means <= first["observed"] + 1e-12).sum())], "hi": [int((means >= first["observed"] - 1e-12).sum())]})

    counts = dealt.groupBy(group, "part").applyInPandas(run, f"{group} {dict(df.dtypes)[group]}, lo bigint, hi bigint").groupBy(group).agg(F.sum("lo").alias("lo"), F.sum("hi").alias("hi"))
    p = F.least(F.lit(1.0), 2 * F.least("lo", "hi").cast("double") / (n_perm + 1) + 2 / (n_perm + 1))
    return adjusted(observed.join(counts, group).select(group, "observed", "size", p.alias("p_empirical")), "p_empirical")


def average_ranks(df: DataFrame, column: str, out: str, keys: Sequence[str] = (), descending: bool = True) -> DataFrame:
    """Ranks with ties averaged; nulls get the number of rows of their group."""
    c = F.col(column)
    order = Window.partitionBy(*keys).orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last())
    ties = F.count("*").over(Window.partitionBy(*keys, column))
    size = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn(out, F.when(c.isNull(), size.cast("double")).otherwise(F.rank().over(order) + (ties - 1) / 2.0))


def robust_rank(df: DataFrame, ranks: Sequence[str], out: str = "rra_score") -> DataFrame:
    """Robust rank aggregation (Kolde 2012) of normalised ranks in (0, 1]: the least binomial tail over the sorted ranks, times their number."""
    m = len(ranks)
    r = F.sort_array(F.array(*[F.col(c) for c in ranks]))
    from math import comb

    tails = []
    for k in range(1, m + 1):
        x = F.element_at(r, k)
        tails.append(sum((comb(m, j) * F.pow(x, F.lit(j)) * F.pow(1 - x, F.lit(m - j)) for j in range(k + 1, m + 1)), comb(m, k) * F.pow(x, F.lit(k)) * F.pow(1 - x, F.lit(m - k))))
    return df.withColumn(out, F.least(F.lit(1.0), m * (F.least(*tails) if m > 1 else tails[0])))


def competition_rank(df: DataFrame, score: str, tie: str, out: str = "rank", keys: Sequence[str] = (), digits: int = 12) -> DataFrame:
    """Least-tie ranks by score, then `tie`, both compared by their first significant digits."""
    def key(c: str) -> Column:
        scale = F.when(F.col(c) == 0, 0).otherwise(digits - 1 - F.floor(F.log10(F.abs(F.col(c)))))
        return F.round(F.col(c) * F.pow(F.lit(10.0), scale)) / F.pow(F.lit(10.0), scale)

    return df.withColumn(out, F.rank().over(Window.partitionBy(*keys).orderBy(key(score).asc_nulls_last(), key(tie).asc_nulls_last())))


def peeled(points: np.ndarray, most: int | None = None) -> np.ndarray:
    """The front of each distinct point; 0 beyond `most`.

    Points are taken in falling order, so none is dominated by a later one. A
    point's front is the first without a point that dominates it, and is found by
    bisection: a front with such a point comes after others that have one, too.
    """
    ranks = np.stack([np.unique(c, return_inverse=True)[1] for c in points.T], axis=1) if len(points) else points
    front, members, filled = np.zeros(len(points), np.int32), [], []
    for x in np.lexsort(-ranks.T[::-1])[: len(points)].tolist():
        p, low, high = ranks[x], 0, len(members)
        while low < high:
            mid = (low + high) // 2
            if (members[mid][: filled[mid]] >= p).all(axis=1).any():
                low = mid + 1
            else:
                high = mid
        if most is not None and low >= most:
            continue
        if low == len(members):
            members.append(np.empty((4, len(p)), ranks.dtype))
            filled.append(0)
        elif filled[low] == len(members[low]):
            members[low] = np.concatenate([members[low], np.empty_like(members[low])])
        members[low][filled[low]] = p
        filled[low] += 1
        front[x] = low + 1
    return front


def pareto_fronts(df: DataFrame, id_col: str, criteria: Sequence[str], most: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Fronts 1, 2, ... of non-dominated rows, within each group of `keys`; larger is better and null the worst.

    With `most`, rows of later fronts have a null front.

    Rows of equal criteria are one point. A group's distinct points are ordered in
    one task; with `most`, parts of a group first drop what is beyond it among
    themselves, as no point has a lower front in the whole group than in a part.
    """
    cs = [f"__c{i}" for i in range(len(criteria))]
    filled = df.withColumns({k: F.coalesce(F.col(c), F.lit(float("-inf"))) for k, c in zip(cs, criteria, strict=True)})
    k = list(keys)
    points = filled.select(*k, *cs).distinct()
    types = dict(points.dtypes)

    def run(t: pa.Table) -> pa.Table:
        front = peeled(np.stack([t.column(c).to_numpy() for c in cs], axis=1), most)
        t = t.select([*k, *cs]).append_column("pareto_front", pa.array(front, pa.int32()))
        return t.filter(pa.array(front > 0))

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in [*k, *cs]), "pareto_front int"])
    if most is not None:
        points = points.withColumn("__part", F.pmod(F.xxhash64(*cs), F.lit(64))).groupBy(*k, "__part").applyInArrow(run, schema).drop("pareto_front")
    done = (points if k else points.withColumn("__part", F.lit(0))).groupBy(*(k or ["__part"])).applyInArrow(run, schema)
    cond = F.lit(True)
    for c in [*k, *cs]:
        cond = cond & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return filled.alias("l").join(done.alias("r"), cond, "left").select(*[f"l.{c}" for c in df.columns], "r.pareto_front")


#: Distinct points of a block; each block is compared with every other.
BLOCK_POINTS = 2048


def nearest_sums(own: np.ndarray, other: np.ndarray, times: np.ndarray, k: int, same: bool) -> np.ndarray:
    """The k least distances from each point to the rows at other points (infinite: fewer); `same` leaves out one row at the point itself."""
    square = (own[:, :1] - other[:, 0]) ** 2
    for c in range(1, own.shape[1]):
        square += (own[:, c : c + 1] - other[:, c]) ** 2
    width = min(k + 1, len(other))
    near = np.argpartition(square, width - 1, axis=1)[:, :width]
    d, n = np.take_along_axis(square, near, 1), np.minimum(times[near], k + 1)
    if same:
        n = n - (near == np.arange(len(own))[:, None])
    order = np.argsort(d, axis=1, kind="stable")
    d, n = np.sqrt(np.take_along_axis(d, order, 1)), np.take_along_axis(n, order, 1)
    last = np.cumsum(n, axis=1)
    out = np.full((len(own), k), np.inf)
    for i in range(k):
        at = (last <= i).sum(axis=1)
        ok = at < width
        out[ok, i] = d[np.flatnonzero(ok), at[ok]]
    return out


def isolation(df: DataFrame, id_col: str, columns: Sequence[str], k: int = 3) -> DataFrame:
    """Mean distance to the k nearest rows after scaling each column to 0..1.

    Rows at one place are one point with their number. Blocks of points are
    compared with one another, and only the k least distances of each comparison
    go on; no pair is shuffled. Rows of one id are not neighbours of one another.
    """
    cs = [f"__c{i}" for i in range(len(columns))]
    ranges = df.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns])
    scaled = df.filter(F.col(id_col).isNotNull()).crossJoin(F.broadcast(ranges)).select(F.col(id_col).alias("__id"), *[F.coalesce((F.col(c) - F.col(f"lo_{c}")) / F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0)), F.lit(0.0)).cast("double").alias(n) for n, c in zip(cs, columns, strict=True)])
    scaled = checkpointed(scaled)
    rows, ids = scaled.agg(F.count("*"), F.count_distinct("__id")).first()
    if rows != ids:
        a, b = scaled.alias("a"), scaled.alias("b")
        square = sum(((F.col(f"a.{c}") - F.col(f"b.{c}")) * (F.col(f"a.{c}") - F.col(f"b.{c}")) for c in cs[1:]), (F.col(f"a.{cs[0]}") - F.col(f"b.{cs[0]}")) * (F.col(f"a.{cs[0]}") - F.col(f"b.{cs[0]}")))
        pairs = a.join(b, F.col("a.__id") != F.col("b.__id")).select(F.col("a.__id").alias(id_col), F.sqrt(square).alias("d"))
        near = pairs.withColumn("place", F.row_number().over(Window.partitionBy(id_col).orderBy("d"))).filter(F.col("place") <= k)
        return near.groupBy(id_col).agg(F.avg("d").alias("isolation"))
    points = checkpointed(scaled.groupBy(*cs).agg(F.count("*").alias("__n")))
    blocks = max(1, -(-points.count() // BLOCK_POINTS))
    dealt = points.withColumn("__b", F.pmod(F.xxhash64(*cs), F.lit(blocks)).cast("int"))
    with_ = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    # A row as a point of its own block's comparisons, and as a neighbour in those of every block.
    cells = dealt.select("*", F.col("__b").alias("__i"), with_.alias("__j"), F.lit(True).alias("__own")).unionByName(dealt.select("*", with_.alias("__i"), F.col("__b").alias("__j"), F.lit(False).alias("__own")))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in cs])
        own, other = t.filter(t.column("__own")), t.filter(pc.invert(t.column("__own")))
        if not (own.num_rows and other.num_rows):
            return own.slice(0, 0).select(cs).append_column("d", pa.array([], pa.list_(pa.float64())))
        x, y = (np.stack([u.column(c).to_numpy() for c in cs], axis=1) for u in (own, other))
        d = nearest_sums(x, y, other.column("__n").to_numpy(), k, t.column("__i")[0].as_py() == t.column("__j")[0].as_py())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, d.size + 1, k), pa.int32()), pa.array(d.reshape(-1)))
        return own.select(cs).append_column("d", lists)

    parts = min(blocks * blocks, 4096)
    near = cells.repartition(parts, "__i", "__j").groupBy("__i", "__j").applyInArrow(run, ", ".join([*(f"{c} double" for c in cs), "d array<double>"]))
    best = F.filter(F.slice(F.sort_array(F.flatten(F.collect_list("d"))), 1, k), lambda v: v < float("inf"))
    means = near.groupBy(*cs).agg(best.alias("__d")).filter(F.size("__d") > 0)
    mean = F.aggregate("__d", F.lit(0.0), lambda s, v: s + v) / F.size("__d")
    return scaled.join(means, cs).select(F.col("__id").alias(id_col), mean.alias("isolation"))


def overlap_test(a: DataFrame, b: DataFrame, universe: DataFrame) -> DataFrame:
    """Whether two gene sets (column gene) of a universe overlap by more than chance: k, n, m, size, fold and the hypergeometric tail; one row."""
    base = universe.select("gene").distinct()
    flags = base.join(a.select("gene").distinct().withColumn("in_a", F.lit(1)), "gene", "left").join(b.select("gene").distinct().withColumn("in_b", F.lit(1)), "gene", "left")
    counts = flags.agg(F.count(F.col("in_a") * F.col("in_b")).alias("k"), F.count("in_a").alias("n"), F.count("in_b").alias("m"), F.count("*").alias("size"))
    return hypergeometric_tail(counts, "k", "n", "m", "size").withColumn("fold", F.try_divide(F.col("k") * F.col("size"), F.col("n") * F.col("m")))


def set_similarity(pairs: DataFrame, method: str = "tanimoto") -> DataFrame:
    """Similarity of pairs from the sizes of both sets and of what they share (n_a, n_b, shared)."""
    k, a, b = F.col("shared"), F.col("n_a"), F.col("n_b")
    value = {"tanimoto": k / (a + b - k), "dice": 2 * k / (a + b), "cosine": k / F.sqrt(a * b)}[method]
    return pairs.withColumn("similarity", value)

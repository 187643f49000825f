"""Approximate nearest neighbours by shifted space-filling curves.

A vector is projected to DIMS dimensions by several random rotations, each with
a random shift, and gets one Hilbert key in each ordering. Cut points taken
from a bounded sample of vectors divide each ordering into cells of about equal
numbers. Every vector is put into its cell, every query into its own and both
neighbouring ones; range partitioning on (ordering, zone of cells) brings them
together. There, vectors are rounded to two bytes a component at a scale of
their own and carry the length of what rounding lost, so that each distance has
a lower and an upper bound. Kept are all vectors whose lower bound is not above
the k-th upper bound, first in a cell, then over all orderings: none of the k
nearest that a query sees is lost. What is left is ranked by exact distances.

Equal vectors are one candidate that carries the smallest ids needed, so a
vector that many rows share costs no more than another. Rows without a usable
vector (null, no or all-zero components, null or non-finite components, null id)
neither ask nor answer. Ties go to the smaller id; repeated ids are further
rows; with fewer candidates than asked for, all found are returned; an empty
table gives an empty result; other columns are ignored. The fit (centre, scale
and cut points) uses at most SAMPLE vectors; all vectors are indexed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import persisted, table

DIMS, BITS = 8, 3
ORDERINGS = 112
#: Cells of an ordering: as many as give about CELL_ROWS sampled vectors each, MOST_CELLS at most. What a query sees, a share of
#: 3 / cells of the vectors in each ordering, does not shrink as the table grows, and so the recall does not.
CELL_ROWS, MOST_CELLS = 20, 512
ZONE = 16  # cells in a zone, the unit of a group
#: Rows of a zone's block; zones that hold more vectors are split and their queries copied to each block.
BLOCK_ROWS = 16_384
SAMPLE = 20_000
#: Distances that are held at once for the queries of a cell.
AT_ONCE = 1 << 22
#: Largest share by which arithmetic in doubles may change a squared distance, of the squared lengths.
SLACK = 1e-12


def hilbert_keys(axes: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert indices of integer points (rows), by the public transpose algorithm of Skilling (2004)."""
    x = axes.T.astype(np.uint32)
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        low = np.uint32(q - 1)
        for i in range(dims):
            on = (x[i] & np.uint32(q)) != 0
            swap = np.where(on, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap if i else np.uint32(0)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), top
    while q > 1:
        turn ^= np.where(x[dims - 1] & np.uint32(q), np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> np.uint32(b) & np.uint32(1))
    return key


class Index:
    """Rotations, shifts and cut points of all orderings, fitted to a bounded sample."""

    def __init__(self, sample: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        # Without the outermost hundredths: a few vectors far off would put all others into one cell.
        self.centre = np.clip(sample, *np.quantile(sample, (0.01, 0.99), axis=0)).mean(axis=0)
        self.turns = []
        self.cuts = []
        cells = int(np.clip(len(sample) // CELL_ROWS, 1, MOST_CELLS))
        for _ in range(ORDERINGS):
            turn = np.linalg.qr(rng.normal(size=(width, min(DIMS, width))))[0]
            along = (sample - self.centre) @ turn
            spread = np.clip(along, *np.quantile(along, (0.01, 0.99), axis=0)).std(axis=0)
            self.turns.append((turn / np.where(spread > 0, spread, 1), rng.uniform(-0.5, 0.5, turn.shape[1])))
            keys = np.sort(self.keys(sample, len(self.turns) - 1))
            self.cuts.append(keys[np.arange(1, cells) * len(keys) // cells])

    def keys(self, vectors: np.ndarray, ordering: int) -> np.ndarray:
        turn, shift = self.turns[ordering]
        unit = (((vectors - self.centre) @ turn + shift) / 4 + 0.5).clip(0, 1 - 1e-9)
        return hilbert_keys((unit * (1 << BITS)).astype(np.uint32), BITS)

    def cells(self, vectors: np.ndarray, ordering: int) -> np.ndarray:
        return np.searchsorted(self.cuts[ordering], self.keys(vectors, ordering), side="right")

    def rounded(self, vectors: np.ndarray) -> list[bytes]:
        """Each vector's scale, the length of its rounding error, and its components from the centre in steps of the scale."""
        x = vectors - self.centre
        scale = np.maximum(np.abs(x).max(axis=1) / 32767, 1e-300)
        steps = np.rint(x / scale[:, None]).astype(np.int16)
        error = np.sqrt(((x - steps * scale[:, None]) ** 2).sum(axis=1))
        return [a.tobytes() + b.tobytes() for a, b in zip(np.stack([scale, error], axis=1), steps, strict=True)]


def unrounded(low) -> tuple[np.ndarray, np.ndarray]:
    """Vectors from the centre and the lengths of their rounding errors."""
    raw = np.frombuffer(b"".join(low), np.uint8).reshape(len(low), -1)
    head = raw[:, :16].copy().view(np.float64)
    return raw[:, 16:].copy().view(np.int16) * head[:, :1], head[:, 1]


def bounds(q: np.ndarray, q_error: np.ndarray, c: np.ndarray, c_error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances between rounded vectors; what is no number bounds nothing."""
    lengths = (q**2).sum(1)[:, None] + (c**2).sum(1)
    square, error = lengths - 2 * q @ c.T, q_error[:, None] + c_error
    low = np.sqrt(np.maximum(square - SLACK * lengths, 0)) - error
    high = np.sqrt(np.maximum(square, 0) + SLACK * lengths) + error
    return np.nan_to_num(low, nan=0.0), np.nan_to_num(high, nan=np.inf, posinf=np.inf)


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and vector (array of double) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    good = F.col(vec_id).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return df.filter(F.coalesce(good, F.lit(False))).select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("vector"))


def collapsed(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with their k + 1 smallest ids: as many as any query can need, its own row left out."""
    keyed = rows.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(7), "vector"))
    # Ranks are cut map-side first, so that a vector shared by many rows sends few of them.
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    few = keyed.withColumn("place", place).filter(F.col("place") <= k + 1)
    return few.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("vector").alias("vector")).select(F.element_at("ids", 1).alias("rep"), "ids", "vector")


def nearest(df: DataFrame, queries, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows of each query row other than itself: query_id, rank, vec_id, score (Euclidean distance).

    `queries`: a condition on `vec_id` that marks the rows to search for.
    """
    spark = df.sparkSession
    rows = usable(df, vec_id, vector)
    width = rows.select(F.size("vector").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    if width is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    rows = rows.filter(F.size("vector") == width.n)  # vectors of another length have no distance to these
    base = persisted(collapsed(rows, k))
    total = base.count()
    asked = rows.filter(queries)
    sample = base.filter(F.pmod(F.xxhash64("rep", F.lit("fit")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 0.8 * SAMPLE / total)) + 1).select("vector").limit(SAMPLE).collect()
    held = spark.sparkContext.broadcast(Index(np.array([r.vector for r in sample]) if sample else np.ones((1, width.n))))
    per_zone = total * ZONE // max(1, len(held.value.cuts[0]) + 1)
    blocks = max(1, -(-per_zone // BLOCK_ROWS))

    def placed(it, is_query: bool):
        index: Index = held.value
        for pdf in it:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                x = np.stack(part["vector"].to_numpy())
                ids, low = part["id"].to_numpy(), index.rounded(x)
                out = {"ordering": [], "cell": [], "block": [], "row": []}
                for o in range(ORDERINGS):
                    cell, here = index.cells(x, o), np.arange(len(x))
                    if is_query:
                        spread = np.concatenate([cell - 1, cell, cell + 1])
                        here = np.tile(here, 3)
                        ok = (spread >= 0) & (spread <= len(index.cuts[o]))
                        cell, here = spread[ok], here[ok]
                        block = np.repeat(np.arange(blocks), len(cell))
                        cell, here = np.tile(cell, blocks), np.tile(here, blocks)
                    else:
                        block = ids[here] % blocks
                    for key, value in zip(out, (np.full(len(cell), o), cell, block, here), strict=True):
                        out[key].append(value)
                got = {key: np.concatenate(v) for key, v in out.items()}
                if len(got["row"]):
                    yield pd.DataFrame({"ordering": got["ordering"], "zone": got["cell"] // ZONE, "block": got["block"], "cell": got["cell"], "query": is_query, "id": ids[got["row"]], "low": [low[r] for r in got["row"]]})

    shape = "ordering int, zone int, block int, cell int, query boolean, id bigint, low binary"
    indexed = base.select(F.col("rep").alias("id"), "vector").mapInPandas(lambda it: placed(it, False), shape)
    sought = asked.select(F.col("vec_id").alias("id"), "vector").mapInPandas(lambda it: placed(it, True), shape)

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[np.ndarray] = []
        for _, part in pdf.groupby("cell"):
            q, c = part[part["query"]], part[~part["query"]]
            if not len(q) or not len(c):
                continue
            (left, left_error), (right, right_error) = unrounded(q["low"]), unrounded(c["low"])
            qi, ci, step = q["id"].to_numpy(), c["id"].to_numpy(), max(1, AT_ONCE // len(c))
            for at in range(0, len(q), step):
                ask = qi[at : at + step]
                low, high = bounds(left[at : at + step], left_error[at : at + step], right, right_error)
                # A query's own vector may have no other row to give.
                others = np.where(ask[:, None] == ci, np.inf, high)
                limit = np.partition(others, k - 1, axis=1)[:, k - 1] if len(c) >= k else np.full(len(ask), np.inf)
                a, b = np.nonzero(low <= limit[:, None])
                found.append(pd.DataFrame({"query_id": ask[a], "rep": ci[b], "low": low[a, b], "high": high[a, b]}))
        if not found:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "rep": np.zeros(0, np.int64), "low": np.zeros(0), "high": np.zeros(0)})
        return pd.concat(found).groupby(["query_id", "rep"], as_index=False).min()

    width_ = int(spark.conf.get("spark.sql.shuffle.partitions"))
    zones = indexed.unionByName(sought).repartitionByRange(max(width_, min(ORDERINGS, 4 * width_)), "ordering", "zone", "block")
    pairs = zones.groupBy("ordering", "zone", "block").applyInPandas(compared, "query_id bigint, rep bigint, low double, high double").groupBy("query_id", "rep").agg(F.min("low").alias("low"), F.min("high").alias("high"))
    whole = Window.partitionBy("query_id").orderBy(F.when(F.col("rep") != F.col("query_id"), F.col("high")).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    limit = F.nth_value(F.when(F.col("rep") != F.col("query_id"), F.col("high")), k).over(whole)
    best = pairs.withColumn("limit", limit).filter(F.col("limit").isNull() | (F.col("low") <= F.col("limit"))).select("query_id", "rep")
    exact = best.join(base, "rep").join(asked.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("q")).distinct(), "query_id")
    square = F.aggregate(F.zip_with("q", "vector", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    each = exact.select("query_id", F.explode("ids").alias("vec_id"), F.sqrt(square).alias("score")).filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_hilbert_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)

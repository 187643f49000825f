"""Near-duplicate components by a chosen-path set similarity join over MinHash.

1. One scan turns each document into its set of word shingles (64-bit hashes), a
   128-bit digest of the set and a MinHash signature. Documents of equal sets
   are one class from here on, so exact copies cost nothing further.
2. Trees of chosen paths: at a node, a hash of the path selects one or two
   signature places; a class goes on to the child named by its minwise token at
   each. Two classes of similarity 0.8 stay together along at least one path of a
   tree of LEVELS levels with probability 0.64, so TREES trees miss a link in
   about 1e-5 of cases (as all trees share the signature's PLACES places, up to
   2e-5).
3. A node of more than LARGE classes is branched on, in TREES_AGAIN trees of
   LEVELS_AGAIN further levels, until its parts are small. Before that, all its
   classes are compared with one of them, its anchor; a node whose classes are of
   one component by then has nothing left to find and is dropped. So a large
   group of near copies costs rows in proportion to its size at each round,
   never to its square. What is left after ROUNDS is compared in pairs of blocks.
4. Small nodes are compared exhaustively by signature, which leaves in them only
   classes that may be linked. Nodes that share such classes hang together; all
   similarities of classes that do are computed from full sets, in pairs of blocks
   where they are more than LARGE, as long as a class is then copied to no more
   blocks than it has nodes (COPIES). Of still larger groups, nodes are compared,
   some trees at a time (BATCHES);
   later trees look only at pairs that are not of one component by then and have
   not met in a node before, so that the many nodes of one group of near copies
   cost little more than one of them.

The signature test lets pass what is estimated at five standard deviations
below the threshold, so it does not lose links; every link is confirmed on full
sets. Nulls, empty texts and texts without words have the empty set and are
linked with nothing: they are kept, each its own component, and so are rows with
a null id. Joins are shuffles: none sends a side through the driver. Repeated rows come out as often as they went in; rows of one id but
different texts are labelled each by its own text. An empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components, shuffled
from .common import map_rows, persisted, shuffle_width, table

PLACES = 64  # of a signature
TREES, LEVELS = 14, 3
TREES_AGAIN, LEVELS_AGAIN, ROUNDS = 2, 2, 8
SECOND_PLACE = 0.25  # share of nodes that branch on a second place: 1.25 * 0.8 = 1
#: Classes of a node that are compared exhaustively, in one group; larger nodes are branched on.
LARGE = 2048
#: Nodes that a class is in, on average; no class of a group that hangs together is copied to more blocks.
COPIES = int(TREES * (1 + SECOND_PLACE) ** LEVELS)
#: Trees after which components are made, up to the last one.
BATCHES = (2, TREES)
#: Rows of a group with signatures, and with full sets; shingles in a node that are held at once.
SIGNATURES_AT_ONCE, SETS_AT_ONCE, SHINGLES_AT_ONCE = 20_000, 2_000, 8_000_000
SIGMAS = 5.0
#: Words whose hashes a task keeps.
CACHE_ENTRIES = 400_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_PRIME = np.uint64(0x100000001B3)


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 32, PLACES, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, PLACES, dtype=np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(texts: list[str | None], k: int, known: dict[bytes, int] | None = None) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle. `known` keeps words' hashes between calls of one task."""
    known = {} if known is None else known
    if len(known) > CACHE_ENTRIES:
        known.clear()
    split = [t.encode().lower().split() if t else [] for t in texts]
    missing = set().union(*split) - known.keys() if split else set()
    known.update((w, xxhash.xxh3_64_intdigest(w)) for w in missing)
    look, out = known.__getitem__, []
    for words in split:
        h = np.fromiter(map(look, words), np.uint64, len(words))
        n = min(k, len(h))
        if n:
            s = h[: len(h) - n + 1].copy()
            for i in range(1, n):
                s = s * _PRIME + h[i : len(h) - n + 1 + i]
            h = np.unique(mixed(s + np.uint64(n)))
        out.append(h)
    return out


def signature(s: np.ndarray) -> np.ndarray:
    a, b = _permutations()
    x, out = (s >> np.uint64(32)).astype(np.uint32), np.full(PLACES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        out = np.minimum(out, ((x[at : at + 2048] ^ b[:, None]) * a[:, None]).min(axis=1))
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers that stand for a set."""
    low, high = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), ">i8").tolist()
    return low, high


def shingled(df: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """Id, set size, set digest and signature of every row."""

    def kernel(rows: dict[str, list], known: dict[bytes, int]) -> dict[str, list]:
        sets = shingles(rows["text"], k, known)
        digests = list(map(digest, sets))
        return {
            "doc_id": rows["doc_id"], "n_shingles": [len(s) for s in sets], "k1": [a for a, _ in digests], "k2": [b for _, b in digests],
            "sig": [signature(s).tobytes() if len(s) else None for s in sets],
        }

    source = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return map_rows(source, kernel, "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, sig binary", setup=dict)


def branched(rows: DataFrame, trees: int, levels: int, seed: int) -> DataFrame:
    """Paths of `levels` further levels from each row's node, in `trees` trees: node, rep, tree. Rows: node, rep, sig, tree (null for roots)."""

    def kernel(part: dict[str, list]) -> dict[str, list]:
        sig = np.frombuffer(b"".join(part["sig"]), np.uint32).reshape(-1, PLACES)
        start = np.array(part["node"], np.int64).view(np.uint64)
        nodes, who, kind = [], [], []
        given = part["tree"][0] is not None
        for tree in range(trees):
            path, at = mixed(start ^ np.uint64((seed * 1000 + tree + 1) * 0x9E3779B1)), np.arange(len(sig))
            for _ in range(levels):
                draw = mixed(path + np.uint64(1))
                places = draw % np.uint64(PLACES)
                second = (draw >> np.uint64(40)).astype(np.float64) < SECOND_PLACE * (1 << 24)
                other = (places + np.uint64(1) + (draw >> np.uint64(8)) % np.uint64(PLACES - 1)) % np.uint64(PLACES)
                step = lambda p, a, c: mixed(p ^ mixed((c << np.uint64(32)) | sig[a, c.astype(np.int64)].astype(np.uint64)))  # noqa: B023, E731
                path, at = np.concatenate([step(path, at, places), step(path[second], at[second], other[second])]), np.concatenate([at, at[second]])
            nodes.append(path)
            who.append(at)
            kind.append(np.array(part["tree"])[at] if given else np.full(len(at), tree))
        rep = np.array(part["rep"], np.int64)
        return {"node": np.concatenate(nodes).view(np.int64), "rep": rep[np.concatenate(who)], "tree": np.concatenate(kind)}

    return map_rows(rows.select("node", "rep", "sig", "tree"), kernel, "node bigint, rep bigint, tree smallint")


def passes(n: np.ndarray, m: np.ndarray, agree: np.ndarray, percent: int) -> np.ndarray:
    """Whether set sizes and agreeing signature places (of eight bits each) allow a link."""
    j = percent / 100
    p = j + (1 - j) / 256
    least = PLACES * p - SIGMAS * np.sqrt(PLACES * p * (1 - p))
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (agree >= least)


def agreeing(pdf: pd.DataFrame, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Nodes of equal size among the rows (node, n, low; sorted by node): their rows, agreeing places of all pairs, and which pairs may be links."""
    low = np.frombuffer(b"".join(pdf["low"]), np.uint8).reshape(-1, PLACES)
    n, node = pdf["n"].to_numpy(), pdf["node"].to_numpy()
    begin = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(pdf) else np.zeros(0, int)
    size = np.diff(np.r_[begin, len(pdf)])
    for m in np.unique(size):
        if m < 2:
            continue
        starts = begin[size == m]
        step = max(1, (1 << 22) // int(m * m * PLACES))
        for at in range(0, len(starts), step):
            rows = starts[at : at + step, None] + np.arange(m)
            if m <= 64:
                agree = (low[rows][:, :, None] == low[rows][:, None]).sum(axis=3, dtype=np.uint8)
            else:
                agree = np.stack([np.stack([(low[r] == low[x]).sum(axis=1, dtype=np.uint8) for x in r]) for r in rows])
            ok = passes(n[rows][:, :, None], n[rows][:, None], agree, percent)
            ok[:, np.arange(m), np.arange(m)] = False
            yield rows, agree, ok


def met_before(seen: list[np.ndarray]) -> np.ndarray:
    """Which pairs have a node of their lists in common."""
    return shared_counts(seen) > 0


def open_members(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Of the members of nodes (node, rep, tree, comp, n, low, seen), those that may have a link that is not known: node, rep, tree."""
    pdf = pdf.sort_values(["node", "rep"], ignore_index=True)
    comp, seen = pdf["comp"].to_numpy(), pdf["seen"].tolist()
    keep = np.zeros(len(pdf), bool)
    for rows, _, ok in agreeing(pdf, percent):
        ok &= comp[rows][:, :, None] != comp[rows][:, None]
        for g in np.flatnonzero(ok.any(axis=(1, 2))).tolist():
            lists = [seen[r] for r in rows[g]]
            if any(x is not None and len(x) for x in lists):
                ok[g] &= ~met_before([np.asarray(x if x is not None else (), np.int64) for x in lists])
        keep[rows[ok.any(axis=2)]] = True
    return pdf.loc[keep, ["node", "rep", "tree"]]


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets have in common: frequent elements by products of matrices, rare ones by the pairs that hold them."""
    m, n = len(sets), [len(x) for x in sets]
    _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, often = np.repeat(np.arange(m), n), count > max(8, m // 16)
    shared = np.zeros((m, m), np.float32)
    column = np.cumsum(often) - 1
    here = often[inverse]
    at, who = column[inverse[here]], owner[here]
    order = np.argsort(at, kind="stable")
    at, who = at[order], who[order]
    for low in range(0, int(often.sum()), 4096):
        lo, hi = np.searchsorted(at, (low, low + 4096))
        block = np.zeros((m, 4096), np.float32)
        block[who[lo:hi], at[lo:hi] - low] = 1
        shared += block @ block.T
    few = ~here & (count[inverse] > 1)
    at, who = inverse[few], owner[few]
    order = np.lexsort((who, at))
    who, times = who[order], count[at[order]]
    for c in np.unique(times).tolist():
        groups = who[times == c].reshape(-1, c)
        step = max(1, (1 << 21) // (c * c))
        for lo in range(0, len(groups), step):
            g = groups[lo : lo + step]
            np.add.at(shared.reshape(-1), (g[:, :, None] * m + g[:, None]).reshape(-1), np.float32(1))
    shared[np.arange(m), np.arange(m)] = n
    return shared


def are_linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def forest(similar: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric boolean matrix, as index pairs."""
    left, out = np.ones(len(similar), bool), []
    for root in range(len(similar)):
        queue, left[root] = [root] if left[root] else [], False
        while queue:
            i = queue.pop()
            new = np.flatnonzero(similar[i] & left).tolist()
            left[new] = False
            out += [(i, j) for j in new]
            queue += new
    return out


def node_links(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Spanning forests of the links within nodes, from rows of node, rep, shingles."""
    out = []
    for _, part in pdf.groupby("node", sort=True):
        rep, sets = part["rep"].to_numpy(), [np.frombuffer(x, np.uint64) for x in part["shingles"]]
        if len(sets) == 2:
            pairs = [(0, 1)] if are_linked(*sets, percent) else []
        else:
            n, shared = np.array([len(x) for x in sets]), shared_counts(sets).astype(np.int64)
            pairs = forest(100 * shared >= percent * (n[:, None] + n - shared))
        out += [(rep[a], rep[b]) for a, b in pairs]
    found = np.array(out, np.int64).reshape(-1, 2)
    return pd.DataFrame({"u": found[:, 0], "v": found[:, 1]})


def in_blocks(rows: DataFrame, blocks: Column) -> DataFrame:
    """Deal the rows of each node to `blocks` blocks, and copy them so that every two blocks meet in a node of their own."""
    mine = F.pmod(F.xxhash64("rep", F.lit("block")), F.col("b")).cast("int")
    out = rows.withColumn("b", blocks.cast("int")).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    pair = F.when(F.col("b") > 1, F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other"))).otherwise(F.col("node"))
    return out.withColumn("node", pair).drop("b", "mine", "other")


def grouped(rows: DataFrame, keys: list[str], per_group: int, count: int):
    """Groups of whole keys, about `per_group` rows each, for a kernel that splits them again."""
    buckets = max(shuffle_width(rows.sparkSession), -(-count // per_group))
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets))).groupBy("bucket")


def with_size(nodes: DataFrame) -> DataFrame:
    """Nodes of at least two members, with their size; of nodes of the same members, one (their order-free digests agree)."""
    sizes = nodes.groupBy("node").agg(F.count("*").alias("size"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("members")).filter("size > 1")
    one = sizes.groupBy("size", "members").agg(F.min("node").alias("node"))
    return nodes.join(shuffled(one.select("node", "size")), "node")


def confirmed(pairs: DataFrame, data: DataFrame, test: Callable[[dict, dict], bool]) -> DataFrame:
    """The pairs (anchor, rep) whose rows of `data` (rep and what `test` looks at) pass.

    An anchor meets its partners in chunks, about as many in all as a thousandth
    of the pairs, so that no group grows with an anchor's partners.
    """
    pairs = persisted(pairs)
    count = pairs.count()
    dealt = pairs.withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit("chunk")), F.lit(count // 1000 + 1)))
    others = dealt.join(shuffled(data), "rep")
    anchors = dealt.select("anchor", "chunk").distinct().join(shuffled(data.withColumnRenamed("rep", "anchor")), "anchor").withColumn("rep", F.col("anchor"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.to_dict("records")
        middle = {(r["anchor"], r["chunk"]): r for r in rows if r["rep"] == r["anchor"]}
        found = [(r["anchor"], r["rep"]) for r in rows if r["rep"] != r["anchor"] and test(middle[r["anchor"], r["chunk"]], r)]
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    return grouped(others.unionByName(anchors), ["anchor", "chunk"], SETS_AT_ONCE, 2 * count).applyInPandas(run, "u bigint, v bigint")


def by_component(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (node, rep, tree) with their component so far, without the nodes that hold one alone."""
    known = found.select(F.col("node").alias("rep"), "component")
    marked = persisted(rows.select("node", "rep", "tree").join(shuffled(known), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component"))
    several = marked.groupBy("node").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least < most").select("node")
    return marked.join(shuffled(several), "node", "left_semi")


def linked(docs: DataFrame, classes: DataFrame, k: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """The components of the links between classes: node (representative) and component."""
    low = low_bytes(classes)

    def sets_of(reps: DataFrame) -> DataFrame:
        wanted = classes.join(shuffled(reps.distinct()), "rep", "left_semi").select("rep", "doc", "k1", "k2")
        texts = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text")).filter("text is not null")

        def sets(part: dict[str, list], known: dict[bytes, int]) -> dict[str, list]:
            found = [(r, s.tobytes()) for r, a, b, s in zip(part["rep"], part["k1"], part["k2"], shingles(part["text"], k, known), strict=True) if digest(s) == (a, b)]
            return {"rep": [r for r, _ in found], "shingles": [s for _, s in found]}

        # An id may stand for several texts, and a row may be repeated.
        return persisted(map_rows(texts.join(shuffled(wanted), "doc"), sets, "rep bigint, shingles binary", setup=dict).dropDuplicates(["rep"]))

    def similar(a: dict, b: dict) -> bool:
        agree = (np.frombuffer(a["low"], np.uint8) == np.frombuffer(b["low"], np.uint8)).sum()
        return bool(passes(a["n"], b["n"], agree, percent))

    def equal_enough(a: dict, b: dict) -> bool:
        return are_linked(np.frombuffer(a["shingles"], np.uint64), np.frombuffer(b["shingles"], np.uint64), percent)

    nodes = persisted(branched(classes.select("rep", "sig", F.lit(0).cast("bigint").alias("node"), F.lit(None).cast("smallint").alias("tree")), TREES, LEVELS, 1))
    kept = persisted(with_size(nodes))
    small, large = kept.filter(F.col("size") <= LARGE), kept.filter(F.col("size") > LARGE)
    links = docs.sparkSession.createDataFrame([], "u bigint, v bigint")
    for round_ in range(ROUNDS):
        if large.isEmpty():
            break
        anchors = large.groupBy("node").agg(F.min_by("rep", F.xxhash64("rep")).alias("anchor"))
        pairs = large.join(shuffled(anchors), "node").filter("rep <> anchor").select("anchor", "rep").distinct()
        near = persisted(confirmed(pairs, low, similar)).select(F.col("u").alias("anchor"), F.col("v").alias("rep"))
        links = links.unionByName(persisted(confirmed(near, sets_of(near.select("rep").unionByName(near.select(F.col("anchor").alias("rep")))), equal_enough)))
        left = by_component(large, connected_components(links))
        nodes = persisted(branched(left.join(shuffled(classes.select("rep", "sig")), "rep"), TREES_AGAIN, LEVELS_AGAIN, 2 + round_))
        kept = persisted(with_size(nodes))
        small, large = small.unionByName(kept.filter(F.col("size") <= LARGE)), kept.filter(F.col("size") > LARGE)
    else:
        small = small.unionByName(in_blocks(large, F.ceil(F.col("size") * 2 / LARGE)))

    def still_open(rows: DataFrame, found: DataFrame, seen: DataFrame) -> DataFrame:
        signed = by_component(rows, found).join(shuffled(low), "rep").join(shuffled(seen), "rep", "left")
        groups = grouped(signed, ["node"], SIGNATURES_AT_ONCE, rows.count())
        return persisted(groups.applyInPandas(lambda pdf: open_members(pdf, percent), "node bigint, rep bigint, tree smallint"))

    def compared(pool: DataFrame, found: DataFrame) -> DataFrame:
        """Components with the links within the nodes (node, rep) of `pool`, by full sets."""
        many = F.when(F.count("*") > LARGE, F.ceil(F.count("*") * 2 / LARGE)).otherwise(1)
        heavy = pool.join(shuffled(classes.select("rep", "n")), "rep").groupBy("node").agg(F.greatest(F.ceil(F.sum("n") / SHINGLES_AT_ONCE), many).alias("blocks"))
        full = in_blocks(pool.select("node", "rep").join(shuffled(heavy), "node"), F.col("blocks")).select("node", "rep").join(shuffled(sets), "rep")
        new = persisted(grouped(full, ["node"], SETS_AT_ONCE, pool.count()).applyInPandas(lambda pdf: node_links(pdf, percent), "u bigint, v bigint"))
        return connected_components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(new))

    found = connected_components(links)
    seen = classes.select("rep", F.array().cast("array<bigint>").alias("seen")).limit(0)
    alive = still_open(small, found, seen)
    sets = sets_of(alive.select("rep"))
    # What hangs together by open members is compared once, if its blocks cost no more rows than its nodes do.
    least = alive.groupBy("node").agg(F.min("rep").alias("u"))
    hanging = persisted(connected_components(alive.join(shuffled(least), "node").select("u", F.col("rep").alias("v"))).select(F.col("node").alias("rep"), F.col("component").alias("node")))
    size = hanging.groupBy("node").agg(F.count("*").alias("size"))
    vast = F.col("size") > COPIES * LARGE // 2
    found = compared(persisted(hanging.join(shuffled(size.filter(~vast)), "node").select("node", "rep")), found)
    rest = alive.join(shuffled(hanging.join(shuffled(size.filter(vast)), "node").select("rep")), "rep", "left_semi")
    if size.filter(vast).isEmpty():
        return found
    rest, met = persisted(rest), None
    for first, last in zip((0, *BATCHES), BATCHES, strict=False):
        pool = rest.filter((F.col("tree") >= first) & (F.col("tree") < last))
        if met is not None:
            pool = still_open(pool, found, met.groupBy("rep").agg(F.collect_set("node").alias("seen")))
        if pool.isEmpty():
            continue
        met = pool.select("rep", "node") if met is None else met.unionByName(pool.select("rep", "node"))
        found = compared(pool, found)
    return found


def low_bytes(classes: DataFrame) -> DataFrame:
    """rep, set size, and the signature's places cut to one byte each."""

    def kernel(part: dict[str, list]) -> dict[str, list]:
        return {"rep": part["rep"], "n": part["n"], "low": [np.frombuffer(s, np.uint32).astype(np.uint8).tobytes() for s in part["sig"]]}

    return map_rows(classes.select("rep", "n", "sig"), kernel, "rep bigint, n bigint, low binary")


def components(df: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `df`: doc_id, n_shingles, component_id and kept."""
    rows = persisted(shingled(df, k, doc_id, text))
    keyed = rows.filter("n_shingles > 0 and doc_id is not null")
    classes = persisted(keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")))
    classes = classes.withColumn("rep", F.monotonically_increasing_id())
    found = linked(df, classes, k, percent, doc_id, text)
    named = classes.select(F.col("rep").alias("node"), "doc", "k1", "k2").join(shuffled(found), "node")
    least = persisted(named.groupBy("component").agg(F.min("doc").alias("least")))
    joined = named.join(shuffled(least), "component").select("k1", "k2", "least")
    labels = classes.select("k1", "k2", "doc").join(shuffled(joined), ["k1", "k2"], "left").select("k1", "k2", F.coalesce("least", "doc").alias("component"))
    out = keyed.select("doc_id", "n_shingles", "k1", "k2").join(shuffled(labels), ["k1", "k2"])
    alone = rows.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    out = out.select("doc_id", "n_shingles", "component").unionByName(alone)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def op7_near_dup(spark, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"), k=4)

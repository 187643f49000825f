"""Operators on small fixtures with values worked out by hand, or against brute force."""

import math
import random
from functools import cache

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import components, figures, kernels, network, paths, presence, ranking, screen, stats, tables, views
from weftgraph.operators.components import connected_components
from weftgraph.plans import registry
from weftgraph.plans.project import Project
from weftgraph.sources import readers, writers
from weftgraph.streaming import upserts


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_replicate_headers():
    assert presence.replicate_columns(["Name", "R1-A", "R2-A"], "Name") == {"R1-A": (1, "A"), "R2-A": (2, "A")}
    with pytest.raises(ValueError):
        presence.replicate_columns(["Name", "x"], "Name")


def test_presence_from_wide(spark):
    wide = spark.createDataFrame([("a", 0.0, 0.0, 5.0), ("b", 4.0, 6.0, None), ("c", 1.0, 1.0, 1.0)], "Name string, `R1-X` double, `R2-X` double, `R1-Y` double")
    got = {(r.compound, r.condition): r.present for r in presence.binarized(presence.melted(wide, "Name"), q=0.5).collect()}
    assert got["a", "X"] == 0 and got["b", "X"] == 1 and got["c", "X"] == 1 and got["a", "Y"] == 1 and got["b", "Y"] == 0


def test_binary_columns_use_one_half(spark):
    long = spark.createDataFrame([("a", "X", 1, 1.0), ("a", "X", 2, 0.0), ("b", "X", 1, 0.0)], "compound string, condition string, replicate int, value double")
    assert rows(presence.binarized(long).select("compound", "present")) == [("a", 1), ("b", 0)]


def test_betweenness_bounds(spark):
    df = spark.createDataFrame([(3, 5), (5, 3)], "n long, m long").withColumn("b", network.largest_betweenness(F.col("n"), F.col("m")))
    assert rows(df) == [(3, 5, 19.0), (5, 3, 16.0)]


def test_complete_bipartite_centrality(spark):
    edges = spark.createDataFrame([("g", f"a{i}", f"b{j}") for i in range(4) for j in range(6)], "condition string, u string, v string")
    got = kernels.centrality(edges, ["condition"]).toPandas().set_index("node")
    assert got.loc["a0", "degree"] == 6 and got.loc["b0", "degree"] == 4
    assert np.isclose(got.loc["a0", "betweenness"], 15 / 4) and np.isclose(got.loc["b0", "betweenness"], 6 / 6)
    assert (got["component"] == "a0").all()
    assert np.isclose(got["hub_score"].max(), 1)


def test_betweenness_by_brute_force():
    rng = random.Random(2)
    for _ in range(10):
        n = rng.randint(3, 9)
        near = [set() for _ in range(n)]
        for i in range(n):
            for j in range(i):
                if rng.random() < 0.4:
                    near[i].add(j)
                    near[j].add(i)
        near = [sorted(x) for x in near]

        def ways(s, t, near=near):
            level, found = [[s]], []
            while level and not found:
                level = [[*p, y] for p in level for y in near[p[-1]] if y not in p]
                found = [p for p in level if p[-1] == t]
            return found

        want = np.zeros(n)
        for s in range(n):
            for t in range(s):
                if ps := ways(s, t):
                    for p in ps:
                        for x in p[1:-1]:
                            want[x] += 1 / len(ps)
        assert np.allclose(kernels.betweenness(near), want)


def test_dealt_betweenness_equals_whole(spark):
    rng = random.Random(3)
    pairs = [("g", f"n{rng.randint(0, 25):02}", f"n{rng.randint(0, 25):02}") for _ in range(50)] + [("h", "a", "b"), ("h", "b", "c")]
    edges = spark.createDataFrame(pairs, "condition string, u string, v string")
    got = {(r.condition, r.node): r.betweenness for r in kernels.dealt_betweenness(edges, ["condition"], 5).collect()}
    for g in "gh":
        u, v = (np.array([p[i] for p in pairs if p[0] == g]) for i in (1, 2))
        names, near = kernels.adjacency(u, v)
        want = kernels.betweenness(near)
        assert all(math.isclose(got[g, n], w, abs_tol=1e-9) for n, w in zip(names, want, strict=True))


def test_pair_synergy_of_two_triangles(spark):
    net = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)], "u long, v long")
    sets = spark.createDataFrame([("A", 10, t) for t in (1, 2, 3)] + [("A", 20, t) for t in (4, 5, 6)] + [("A", 30, 5)], "condition string, compound long, target long")
    z = spark.createDataFrame([("A", 10, -2.0, 0.01), ("A", 20, -1.0, 0.5), ("A", 30, 1.0, None)], "condition string, compound long, z double, p double")
    members = sets.select(F.col("target").alias("draw"), F.col("target").alias("node")).distinct()
    far = paths.multi_source_hops(net, members, members).withColumnRenamed("draw", "source")
    got = {(r.compound_a, r.compound_b): r for r in ranking.pair_synergy(z, sets, far).collect()}
    r = got[10, 20]
    assert math.isclose(r.d_ab, 10 / 6) and math.isclose(r.separation, 2 / 3) and r["class"] == "P4" and r.class_sign == "P2" and math.isclose(r.synergy, 1.0)
    assert got[10, 30].singleton and got[10, 30]["class"] is None and got[10, 30].synergy is None


def test_proximity_uses_the_largest_component_and_replaces_where_bins_are_short(spark):
    star = [(1, i) for i in range(2, 40)] + [(40 + i, 41 + i) for i in range(5)] + [(39, 40), (100, 101)]
    sets = spark.createDataFrame([("near", 2), ("near", 100), ("far", 44)], "name string, node long")
    aim = spark.createDataFrame([(1,), (101,)], "node long")
    d = paths.proximity_draws(spark.createDataFrame(star, "u long, v long"), sets, aim, n_random=20, bin_size=10)
    seen = {r.name: (r.d, r.n_nodes) for r in d.filter("draw = 0").collect()}
    assert seen == {"near": (1.0, 1), "far": (6.0, 1)}
    got = {r.name: r for r in paths.proximity(None, None, None, null=d).collect()}
    assert got["near"].d_observed == 1 and 0 < got["near"].p_empirical <= 1 and got["far"].p_empirical == 1.0
    pool = [np.arange(3)]
    assert len(paths.drawn_like(np.zeros(7, int), pool, np.random.default_rng(1))) == 7


def test_route_layers(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 1), (3, 4)], "u long, v long")
    assert dict(rows(paths.route_layers(e))) == {1: 0, 2: 1, 3: 2, 4: 3}


def test_ids_over_many_partitions(spark):
    df = spark.range(200_000).select(((F.col("id") * 7919) % 200_003).alias("k"), F.repeat(F.lit("x"), 200).alias("wide")).repartition(16)
    got = tables.numbered(df, "k", "n").select("k", "n").toPandas().sort_values("k")
    assert (got["n"].to_numpy() == np.arange(1, len(got) + 1)).all()
    assert tables.assigned_ids(spark.range(0), "id", 3).count() == 0


def test_swap_survives_a_crash_between_its_moves(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.swapped(spark.range(3), path)
    (tmp_path / "t").rename(tmp_path / "t.old")
    writers.restored(spark, path)
    assert spark.read.parquet(path).count() == 3
    writers.swapped(spark.range(1), path)
    assert spark.read.parquet(path).count() == 1 and not (tmp_path / "t.old").exists()


def test_preparing_compounds(spark):
    new = spark.createDataFrame([(1, "a", "CC"), (2, "b", " CC "), (3, "c", " "), (4, "d", "N")], "k int, name string, smiles string")
    known = spark.createDataFrame([("N",)], "smiles string")
    assert rows(tables.prepared(new, known, "k", 9).select("name", "id")) == [("a", "C0010")]
    with pytest.raises(ValueError):
        tables.prepared(new, known, "k", 9, missing="abort")
    with pytest.raises(ValueError):
        tables.single_row(new)
    assert tables.single_row(new.limit(1)).count() == 1
    with pytest.raises(ValueError):
        tables.gene_list(new, "d", "d", "s")


def test_candidates_with_unknown_rules_and_fronts(spark):
    df = spark.createDataFrame([(True, None, False), (None, None, None)], "a boolean, b boolean, c boolean")
    assert [r.p for r in df.select(ranking.pass_fraction([F.col(c) for c in "abc"]).alias("p")).collect()] == [0.5, None]
    two = spark.createDataFrame([(g, i, float(i)) for g in "xy" for i in range(2)], "condition string, i int, v double")
    assert {(r.condition, r.i): r.pareto_front for r in ranking.ranked(two, "i", {"v": 1}).collect()} == {("x", 0): 2, ("x", 1): 1, ("y", 0): 2, ("y", 1): 1}
    with pytest.raises(ValueError):
        ranking.ranked(two.filter("i = 0"), "i", {"v": 1})


def test_interaction_files(spark, tmp_path):
    (tmp_path / "l.txt").write_text("protein1 protein2 combined_score\na b 900\nb a 900\na c 100\n")
    assert rows(readers.links(spark, str(tmp_path / "l.txt"), 400)) == [("a", "b", 900)]
    (tmp_path / "a.tsv").write_text("item_id_a\titem_id_b\tis_directional\ta_is_acting\tscore\na\tb\tt\t1\t900\nb\tc\tf\tt\t900\n")
    assert rows(readers.actions(spark, str(tmp_path / "a.tsv"), 400)) == [("a", "b")]
    with pytest.raises(ValueError):
        readers.actions(spark, str(tmp_path / "a.tsv"), 950)
    (tmp_path / "n.txt").write_text("#x\np1\tA\tS\n")
    (tmp_path / "o.txt").write_text("protein alias source\np2 B S one\n")
    assert rows(readers.aliases(spark, str(tmp_path / "n.txt"))) == [("p1", "A", "S")] and rows(readers.aliases(spark, str(tmp_path / "o.txt"))) == [("p2", "B", "S one")]


def test_newest_row_by_key(spark, tmp_path):
    schema = "k string, at int, x int"
    src, out = tmp_path / "in", str(tmp_path / "out")
    for n, part in enumerate(([("a", 1, 1), ("b", 1, 2)], [("a", 0, 9), ("b", 2, 3)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(src))
        q = upserts.latest_by_key(spark.readStream.schema(schema).json(str(src)), out, ["k"], "at", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert rows(spark.read.parquet(out).select("k", "at", "x")) == [("a", 1, 1), ("b", 2, 3)]


def test_small_views(spark):
    ranked = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "node string, place int")
    links = spark.createDataFrame([("a", "c"), ("b", "z")], "u string, v string")
    assert rows(views.connected_picks(ranked, links, 3).select("node")) == [("a",), ("c",)]
    assert kernels.average_linkage(np.array([[0, 9, 1], [9, 0, 8], [1, 8, 0]])) == [0, 2, 1]
    curve = spark.createDataFrame([("x", 0), ("x", 4)], "condition string, n_removed int")
    assert rows(views.fraction_removed(curve, ["condition"]).select("fraction_removed")) == [(0.0,), (1.0,)]


def test_separation_of_two_triangles(spark):
    pairs = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)]
    net = paths.both_ways(spark.createDataFrame(pairs, "u long, v long"))
    sets = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), ("b", 5), ("b", 6)], "name string, node long")
    r = paths.separation(paths.hops(net, sets.select(F.col("node").alias("source"))), sets).first()
    assert math.isclose(r.d_ab, 10 / 6) and math.isclose(r.separation, 2 / 3)


def test_separation_of_unconnected_sets_is_null(spark):
    net = paths.both_ways(spark.createDataFrame([(1, 2), (3, 4)], "u long, v long"))
    sets = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 4)], "name string, node long")
    r = paths.separation(paths.hops(net, sets.select(F.col("node").alias("source"))), sets).first()
    assert r.d_ab is None and r.separation is None


def test_separation_by_sets_equals_that_by_members(spark, monkeypatch):
    """Shared members, single ones, a member off the network and a part without a way; and no row for each pair of members."""
    rng = random.Random(8)
    net = spark.createDataFrame([(i, rng.randrange(i)) for i in range(1, 40)] + [(3, 30), (5, 22)] + [(50, 51)], "u long, v long")
    sets = spark.createDataFrame([(n, rng.randrange(40)) for n in "abcde" for _ in range(5)] + [("one", 7), ("off", 99), ("off", 3), ("far", 50), ("far", 51), ("a", 50)], "name string, node long")
    members = sets.select(F.col("node").alias("draw"), "node").distinct()
    want = rows(paths.separation(paths.multi_source_hops(net, members, members).withColumnRenamed("draw", "source"), sets))
    assert rows(paths.set_separation(net, sets)) == want and len(want) == 28
    monkeypatch.setattr(paths, "BROADCAST_EDGES", 3)
    assert rows(paths.set_separation(net, sets)) == want


def test_network_separation_has_no_farthest_hop(spark, monkeypatch):
    """Two pairs of a chain of 12 steps, 9 and 2 apart, and a member off the largest component."""
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(50, 51)], "u long, v long")
    sets = spark.createDataFrame([("A", 1, 0), ("A", 1, 9), ("A", 2, 10), ("A", 2, 12), ("A", 2, 50)], "condition string, compound long, target long")
    monkeypatch.setattr(registry.b, "interactions", lambda *_: chain)
    monkeypatch.setattr(registry.b, "edges", lambda *_: sets)
    r = registry.network_separation(spark, "").first()
    one, two = (0, 9), (10, 12)
    between = (sum(min(abs(x - y) for y in two) for x in one) + sum(min(abs(x - y) for x in one) for y in two)) / 4
    assert (r.d_aa, r.d_bb, r.d_ab, r.separation) == (9, 2, between, between - 11 / 2)


def test_bow_tie_parts(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (0, 1), (3, 4), (8, 9)], "u long, v long")
    assert dict(rows(paths.bow_tie(e))) == {0: "in", 1: "core", 2: "core", 3: "core", 4: "out", 8: "other", 9: "other"}


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_components_by_union_find(spark, monkeypatch, most):
    monkeypatch.setattr(components, "ONE_TASK_EDGES", most)
    rng = random.Random(4)
    pairs = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in pairs:
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    want = {x: find(x) for p in pairs if p[0] != p[1] for x in p}
    assert dict(rows(connected_components(spark.createDataFrame(pairs, "u long, v long")))) == want
    named = spark.createDataFrame([("b", "é"), ("é", "z"), ("x", None), ("y", "y")], "u string, v string")
    assert dict(rows(connected_components(named))) == {"b": "b", "é": "b", "z": "b"}


def test_equal_p_values_share_a_result(spark):
    df = spark.createDataFrame([(i, 1 / 101) for i in range(30)] + [(30, None)], "i int, p double")
    got = stats.adjusted(df, "p").collect()
    assert all(r.p_adjusted is None if r.p is None else math.isclose(r.p_adjusted, 1 / 101) for r in got)


def test_benjamini_hochberg_values(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.5,), (0.2,)], "p double")
    assert sorted(round(r.p_adjusted, 6) for r in stats.adjusted(df, "p").collect()) == [0.05, 0.066667, 0.066667, 0.25, 0.5]


def test_adjusted_values_carry_over_ranges(spark):
    """Each method against its definition, over families with ties and nulls; no frame runs from a row to the end, which sums anew for each row."""
    rng = random.Random(3)
    cells = [(f, i, None if i % 9 == 0 else rng.randrange(1, 400) / 1000) for f in ("x", None) for i in range(300)]
    df = spark.createDataFrame(cells, "f string, i int, p double")
    for method in ("BH", "BY", "hochberg", "holm", "bonferroni"):
        found = stats.adjusted(df, "p", method=method, family=["f"])
        assert "currentrow$(), unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
        want = {}
        for f in ("x", None):
            ps = sorted(p for g, _, p in cells if g == f and p is not None)
            m = len(ps)
            h = sum(1 / k for k in range(1, m + 1))
            at = {p: (ps.index(p) + 1, m - ps[::-1].index(p)) for p in ps}
            value = {p: {"BH": m * p / b, "BY": h * m * p / b, "hochberg": (m - b + 1) * p, "holm": (m - a + 1) * p, "bonferroni": m * p}[method] for p, (a, b) in at.items()}
            for p in value:
                near = [value[o] for o in value if (o <= p if method == "holm" else o >= p)] if method != "bonferroni" else [value[p]]
                want[f, p] = min(1, max(near) if method == "holm" else min(near))
        got = found.collect()
        assert len(got) == len(cells)
        assert all(r.p_adjusted is None if r.p is None else math.isclose(r.p_adjusted, want[r.f, r.p], rel_tol=1e-12) for r in got)


def test_hypergeometric_tail_is_exact(spark):
    cases = [(8, 25, 40, 300), (0, 5, 5, 20), (1, 1, 1, 1), (5, 5, 5, 20), (3, 10, 900, 1000), (9, 8, 10, 20)]
    got = stats.hypergeometric_tail(spark.createDataFrame(cases, "k int, n int, m int, size int"), "k", "n", "m", "size").collect()
    for r in got:
        want = sum(math.comb(r.m, j) * math.comb(r["size"] - r.m, r.n - j) for j in range(r.k, min(r.n, r.m) + 1) if r.n - j <= r["size"] - r.m) / math.comb(r["size"], r.n)
        assert math.isclose(r.pvalue, want, rel_tol=1e-10, abs_tol=1e-15), r


def test_pareto_fronts(spark):
    df = spark.createDataFrame([(1, 3.0, 1.0), (2, 3.0, 2.0), (3, 1.0, 3.0), (4, 1.0, 1.0), (5, None, None)], "i int, a double, b double")
    assert {r.i: r.pareto_front for r in stats.pareto_fronts(df, "i", ["a", "b"]).collect()} == {1: 2, 2: 1, 3: 1, 4: 3, 5: 4}


def test_pareto_first_gives_the_first_front_only(spark, monkeypatch):
    s = spark.createDataFrame([(1, 3.0, 1), (2, 3.0, 2), (3, 1.0, 3), (4, 1.0, 1), (5, None, 9), (6, 0.0, None)], "s_suppkey long, s_acctbal double, s_nationkey int")
    monkeypatch.setattr(registry.b, "table", lambda *_: s)
    assert rows(registry.pareto_first(spark, "")) == [(2, 1), (3, 1), (5, 1), (6, 1)]


def test_fronts_equal_repeated_peeling(spark):
    rng = random.Random(6)
    cells = [(g, i, *(rng.choice([None, float("-inf"), 0.0, 1.0, 2.0, 3.0, 4.0]) for _ in range(3))) for g in ("x", None) for i in range(60)]
    df = spark.createDataFrame(cells, "g string, i int, a double, b double, c double")
    want = {}
    for g in ("x", None):
        left, front = {i: [float("-inf") if v is None else v for v in vs] for h, i, *vs in cells if h == g}, 0
        while left:
            front += 1
            best = [i for i, p in left.items() if not any(q != p and all(x >= y for x, y in zip(q, p)) for q in left.values())]
            want |= {(g, i): front for i in best}
            left = {i: p for i, p in left.items() if i not in best}
    assert max(want.values()) > 3
    found = stats.pareto_fronts(df, "i", ["a", "b", "c"], keys=["g"])
    assert {(r.g, r.i): r.pareto_front for r in found.collect()} == want
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    for most in (1, 2):
        got = stats.pareto_fronts(df, "i", ["a", "b", "c"], most=most, keys=["g"])
        assert {(r.g, r.i): r.pareto_front for r in got.collect()} == {x: f if f <= most else None for x, f in want.items()}


def test_isolation_by_brute_force(spark, monkeypatch):
    """Blocks of few points, many rows at one place, and fewer rows than neighbours."""
    monkeypatch.setattr(stats, "BLOCK_POINTS", 4)
    rng = random.Random(7)
    places = [(rng.randrange(6), rng.randrange(4)) for _ in range(40)] + [(5, 3)] * 6
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate([(0, 0), (5, 3), *places])], "i int, a double, b double")
    at = [(0, 0), (1, 1), *((a / 5, b / 3) for a, b in places)]
    want = [np.mean(sorted(math.dist(p, q) for j, q in enumerate(at) if j != i)[:3]) for i, p in enumerate(at)]
    found = stats.isolation(df, "i", ["a", "b"])
    assert np.allclose([r.isolation for r in found.orderBy("i").collect()], want)
    assert rows(stats.isolation(df.filter("i < 2"), "i", ["a", "b"])) == [(0, math.sqrt(2)), (1, math.sqrt(2))]
    assert rows(stats.isolation(df.filter("i < 1"), "i", ["a", "b"])) == []


def test_overlaps_by_blocks_equal_those_by_joins(spark, monkeypatch):
    """Blocks of three items, elements that most items hold, names, nulls and groups; and nothing is joined on the element."""
    rng = random.Random(4)
    cells = [(g, f"é{i}", rng.choice([None, *"abcdefgh"])) for g in ("x", "y") for i in range(20) for _ in range(6)] + [("x", None, "a"), (None, "n", "a"), ("x", "alone", None)]
    members = spark.createDataFrame(cells, "g string, i string, e string")
    want = rows(network.pair_jaccard(members, ["g"], "i", "e"))
    monkeypatch.setattr(network, "JOIN_ROWS", 0)
    monkeypatch.setattr(network, "JOIN_SHARE", 0)
    monkeypatch.setattr(network, "BLOCK_ITEMS", 3)
    found = network.pair_jaccard(members, ["g"], "i", "e")
    assert rows(found) == want and len(want) > 300
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(network.pair_jaccard(members, ["g"], "i", "e", 0.5)) == [r for r in want if r[-1] >= 0.5]


def test_degeneracy_by_blocks_equals_that_by_joins(spark, monkeypatch):
    rng = random.Random(5)
    edges = spark.createDataFrame([(c, i, rng.randrange(30)) for c in "AN" for i in range(15) for _ in range(5)], "condition string, compound int, target int")
    sets = spark.createDataFrame([(t, "abcd"[t % 4]) for t in range(28)], "target int, name string")
    want = rows(ranking.degeneracy(edges, sets))
    monkeypatch.setattr(network, "JOIN_ROWS", 0)
    monkeypatch.setattr(network, "JOIN_SHARE", 0)
    monkeypatch.setattr(network, "BLOCK_ITEMS", 4)
    found = ranking.degeneracy(edges, sets)
    assert rows(found) == want and len(want) > 100
    assert found._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") <= 1  # both sets of a compound


def test_all_pairs_meet_once(spark, monkeypatch):
    monkeypatch.setattr(network, "BLOCK_ITEMS", 3)
    z = spark.createDataFrame([(c, i, None if i == 3 else float(i)) for c in "AN" for i in range(11)] + [("A", None, 1.0), (None, 1, 1.0)], "condition string, compound int, z double")
    want = sorted([(c, i, j, None if i == 3 else float(i), None if j == 3 else float(j)) for c in "AN" for i in range(11) for j in range(i + 1, 11)], key=str)
    assert rows(network.all_pairs(z, ["condition"], "compound", ["z"])) == want


def test_remainder_partners_equal_counted_pairs(spark):
    z = spark.createDataFrame([("A", i) for i in (-4, -1, 0, 2, 3, 5, 7, 9)] + [("N", 3), (None, 3), ("A", None)], "condition string, compound long")
    pairs = network.all_pairs(z, ["condition"], "compound", []).selectExpr("condition", "a compound_a", "b compound_b", "if((a + b) % 3 = 0, 'P2', 'P1') class")
    assert rows(figures.remainder_partners(z, 3)) == rows(figures.partner_counts(pairs))


def test_average_ranks_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, None), (4, None)], "i int, x double")
    assert {r.i: r.k for r in stats.average_ranks(df, "x", "k").collect()} == {1: 1.5, 2: 1.5, 3: 4.0, 4: 4.0}


def test_competition_rank_breaks_ties(spark):
    df = spark.createDataFrame([(1, 0.1, 0.5), (2, 1.0, 0.9), (3, 1.0, 0.3), (4, 1.0, 0.6), (5, 1.0, 0.6)], "i int, s double, t double")
    assert [r["rank"] for r in stats.competition_rank(df, "s", "t").orderBy("i").collect()] == [1, 5, 2, 3, 3]


def test_blocks_stay_apart():
    block = [(i, j) for i in range(3) for j in range(3, 6)]
    near = [[] for _ in range(12)]
    for a, b in [*block, *((x + 6, y + 6) for x, y in block), (0, 6)]:
        near[a].append(b)
        near[b].append(a)
    for found in (kernels.leiden(near), kernels.bipartite_modules(near)):
        assert len(set(found[:6])) == 1 and len(set(found[6:])) == 1 and found[0] != found[6]
    # Each block has 9 of 19 edges; the bridge joins two nodes of degree 4.
    q = kernels.barber(near, np.array([0] * 6 + [1] * 6))
    assert math.isclose(q, 18 / 19 - (10 * 9 + 9 * 10) / 19**2)


def test_modules_of_random_networks_are_connected():
    rng = random.Random(6)
    for _ in range(10):
        n = 30
        near = [set() for _ in range(n)]
        for _ in range(45):
            a, b = rng.randrange(n), rng.randrange(n)
            if a != b:
                near[a].add(b)
                near[b].add(a)
        near = [sorted(x) for x in near]
        found = kernels.leiden(near)
        for c in set(found.tolist()):
            part = np.flatnonzero(found == c)
            new = {int(i): j for j, i in enumerate(part)}
            assert len(set(kernels.components_of([[new[y] for y in near[i] if y in new] for i in part]).tolist())) == 1
        assert kernels.modularity(near, found) >= kernels.modularity(near, kernels.components_of(near)) - 1e-12


def test_hop_clusters_leave_noise():
    near = [[1, 2], [0, 2], [0, 1, 3], [2, 4], [3]]
    assert kernels.hop_clusters(near, 3).tolist() == [0, 0, 0, 0, -1]


def test_module_table(spark):
    block = [(f"c{i}", f"t{j}") for i in range(3) for j in range(3)]
    edges = spark.createDataFrame([("g", *e) for e in [*block, *((a + "x", b + "x") for a, b in block), ("z", "y")]], "condition string, u string, v string")
    got = kernels.module_robustness(edges, ["condition"], method="hops").orderBy("module_id").collect()
    assert [r.n_nodes for r in got] == [6, 6, 2] and all(r.r_index_random_sd is not None for r in got)
    for method in ("modularity", "bipartite"):  # a complete block alone has several best partitions; none goes over its bounds
        got = kernels.module_members(edges, ["condition"], method=method).toPandas()
        assert len(got) == 14 and got.groupby("module_id")["component"].nunique().max() == 1
    with pytest.raises(Exception, match="not bipartite"):
        kernels.bipartite_modules([[1, 2], [0, 2], [0, 1]])


def test_modules_of_more_edges_than_a_plain_kernel_takes(spark):
    """a complete network of 2,001,000 edges, beside a small one of null key."""
    n = 2001
    a, b = (spark.range(n).select(F.col("id").alias(x)) for x in ("u", "v"))
    edges = a.crossJoin(b).filter("u < v").select(F.lit(1).alias("g"), "u", "v").unionByName(spark.createDataFrame([(None, 1, 2), (None, 2, 1), (None, 3, 3)], "g int, u bigint, v bigint"))
    got = kernels.module_robustness(edges, ["g"], n_random=2).collect()
    assert n * (n - 1) // 2 > kernels.MOST_EDGES and sum(r.n_nodes for r in got if r.g == 1) == n
    assert sorted(r.n_nodes for r in got if r.g is None) == [1, 2]
    for r in got:  # whatever is removed, the rest of a complete network hangs together
        if r.g == 1:
            assert all(math.isclose(x, (r.n_nodes - 1) / (2 * r.n_nodes)) for x in (r.r_index, r.r_index_random))


def test_packed_networks_as_bits_and_as_arrays(spark):
    rng = random.Random(12)
    for n, m in ((40, 300), (900, 700)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        rows = kernels.packed(spark.createDataFrame([(1, str(a), str(b)) for a, b in pairs], "g int, u string, v string").repartition(3), ["g"]).collect()
        names, near = kernels.linked([r.names for r in rows], [r.n for r in rows], [bytes(r.pairs) for r in rows])
        wanted, lists = kernels.adjacency(*(np.array([str(x) for x in side]) for side in zip(*pairs, strict=True)))
        assert len(rows) > 1 and isinstance(near, kernels.Bits) == (n == 40)
        assert names == wanted and [a.tolist() for a in near] == lists
        part = np.arange(0, len(names), 3)
        assert [part[a].tolist() for a in kernels.within(near, part)] == [[y for y in lists[i] if y % 3 == 0] for i in part.tolist()]
        assert (kernels.leiden(near) == kernels.leiden(lists)).all()
        for order in ("targeted", "random"):
            assert (kernels.attack_curve(near, 5, order) == kernels.attack_curve(lists, 5, order)).all()


def test_attack_on_a_star():
    star = [[1, 2, 3, 4], [0], [0], [0], [0]]
    assert kernels.attack_curve(star, 1, "targeted").tolist() == [1.0, 0.2, 0.2, 0.2, 0.2, 0.0]


def test_combined_similarity():
    s = np.array([[1.0, 0.2], [0.4, 0.6]])
    assert kernels.combined(s) == round((1 + 0.6 + 1 + 0.6) / 4, 3)
    assert kernels.combined(s, "max") == 1.0 and kernels.combined(s, "avg") == 0.55
    assert kernels.combined(np.full((2, 2), np.nan)) is None


def test_upsert_clears_touched_slots(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int")
    none = spark.createDataFrame([], "k string, x int")
    assert rows(tables.upserted(old, none, ["k"], touched=spark.createDataFrame([("a",)], "k string"))) == [("b", 2)]
    with pytest.raises(ValueError):
        tables.upserted(old, spark.createDataFrame([("a",)], "k string"), ["k"])


def test_percent_scale_is_by_column(spark):
    df = spark.createDataFrame([("96.5%",), ("0.5",), (None,), ("n/a",)], "t string")
    got = [r.x for r in tables.percentages(df, "t", "x").collect()]
    assert np.isclose(got[0], 0.965) and np.isclose(got[1], 0.005) and got[2] is None and got[3] is None


def test_classifier_prefers_the_first_match(spark):
    df = spark.createDataFrame([(1, "heart and lung"), (2, " "), (3, None), (4, "x")], "i int, t string")
    assert dict(rows(screen.classified(df, "t", {"A": "lung", "B": "HEART"}).select("i", "class"))) == {1: "A", 2: "Other", 3: "Other", 4: "Other"}


def test_synergy_class_table(spark):
    cells = [(s, p) for s in (True, False, None) for p in (0, 1, 2, None)]
    df = spark.createDataFrame(cells, "s boolean, p int").withColumn("c", network.synergy_class(F.col("s"), F.col("p")))
    got = {(r.s, r.p): r.c for r in df.collect()}
    assert got[False, 2] == "P1" and got[True, 2] == "P2" and got[True, 0] == "P6" and got[None, 1] is None and got[True, None] is None


def test_motif_rotations(spark):
    e = spark.createDataFrame([("g", 1, 2), ("g", 2, 3), ("g", 3, 1)], "condition string, source long, sink long")
    m = network.motifs(e)
    assert m.count() == 3 and network.distinct_cycles(m).first().n == 1


def test_capped_selection(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, "c", "z")], "r int, s string, t string")
    assert [r.r for r in paths.capped(df, "s", "t", "r", 3, 1, 1)] == [1, 4]


def test_prediction_files(spark, tmp_path):
    (tmp_path / "Targets12.csv").write_text('Target Name,UniProt_ID,Probability\n"x, y",P1,96.5%\nz,,10%\n')
    (tmp_path / "Targets7.csv").write_text("Target Name,UniProt_ID,Probability\nq,P2,50\n")
    got = rows(readers.predictions(spark, str(tmp_path)).select("compound", "target", F.round("probability", 4)))
    assert got == [("12", "P1", 0.965), ("7", "P2", 0.5)]
    (tmp_path / "Targets8.csv").write_text("Target Name,UniProt_ID,Probability\n")
    log = readers.prediction_log(spark, str(tmp_path), spark.createDataFrame([("7",)], "compound string"))
    assert {r.path: r.ok for r in log.collect()} == {"Targets12.csv": False, "Targets7.csv": True, "Targets8.csv": False}


def test_pathway_xml(spark, tmp_path):
    (tmp_path / "p.xml").write_text('<pathway name="p1" title="T"><entry id="1" name="g:1 g:2" type="gene"/><entry id="2" name="g:3" type="gene"/><entry id="3" name="undefined" type="group"><component id="1"/><component id="2"/></entry><relation entry1="2" entry2="3" type="PPrel"><subtype name="activation" value="--&gt;"/><subtype name="binding" value="---"/></relation></pathway>')
    got = rows(readers.pathway_relations(spark, str(tmp_path)).select("source", "sink", "subtype"))
    assert got == [("g:3", f"g:{i}", s) for i in (1, 2, 3) for s in ("activation", "binding")]


def test_swap_may_replace_what_is_read(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.swapped(spark.range(3), path)
    writers.swapped(spark.read.parquet(path).filter("id > 0"), path)
    assert rows(spark.read.parquet(path)) == [(1,), (2,)]


def test_project_round_trip(spark, tmp_path):
    p = Project(spark, str(tmp_path)).upsert("t", spark.createDataFrame([("a", 1)], "k string, x int"), ["k"])
    p = p.upsert("t", spark.createDataFrame([("a", 2), ("b", 3)], "k string, x int"), ["k"])
    p.save()
    again = Project.load(spark, str(tmp_path), ["t"])
    assert rows(again.table("t")) == [("a", 2), ("b", 3)] and len(again.log) == 2
    with pytest.raises(KeyError):
        again.table("none")


def test_report_escapes(spark):
    page = writers.report(spark, "a<b", {"t": spark.createDataFrame([("a<b", 1.23456)], "condition string, x double"), "u": None})
    assert "a&lt;b" in page and "1.235" in page and "not computed" in page


def test_hub_betweenness_equals_plain_searches():
    rng = random.Random(8)
    for _ in range(40):
        pairs = {(f"c{rng.randrange(7)}", f"t{rng.randrange(12)}") for _ in range(rng.randint(1, 30))}
        _, near = kernels.adjacency(*(np.array(x) for x in zip(*sorted(pairs), strict=True)))
        for own in kernels.members_of(kernels.components_of(near)):
            new = {x: i for i, x in enumerate(own.tolist())}
            inner = [[new[y] for y in near[x]] for x in new]
            assert np.allclose(kernels.hub_betweenness(inner), kernels.betweenness(inner))
    ring = [[1, 2], [0, 2], [0, 1]]
    path = [[j for j in (i - 1, i + 1) if 0 <= j < 80] for i in range(80)]  # too long for matrices
    assert kernels.hub_side(ring) is None and kernels.hub_betweenness(ring) is None and kernels.hub_betweenness(path) is None


def test_betweenness_of_dealt_components(spark):
    rng = random.Random(9)
    pairs = [("g", f"c{k}_{rng.randrange(15)}", f"t{k}_{rng.randrange(60)}") for k in range(4) for _ in range(120)]
    pairs += [("g", f"p{i:02}", f"p{i + 1:02}") for i in range(60)] + [("g", f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(90)]
    edges = spark.createDataFrame(pairs, "condition string, u string, v string")
    got = {r.node: r.betweenness for r in kernels.dealt_betweenness(edges, ["condition"], 3).collect()}
    names, near = kernels.adjacency(np.array([p[1] for p in pairs]), np.array([p[2] for p in pairs]))
    assert len(got) == len(names) and np.allclose([got[n] for n in names], kernels.betweenness(near))


def test_group_draws_do_not_repeat_and_are_even():
    pool = [np.arange(0, 4), np.arange(10, 16), np.arange(20, 22)]
    group, bins = np.repeat([0, 1, 2], [6, 5, 3]), np.array([0, 0, 0, 1, 1, 1, 0, 0, 1, 1, 1, 2, 2, 2])
    rng, seen = np.random.default_rng(4), np.zeros((14, 22))
    for _ in range(4000):
        found = paths.drawn_in_groups(group, bins, pool, rng)
        seen[np.arange(14), found] += 1
        for g, b in {(0, 0), (0, 1), (1, 0), (1, 1)}:
            own = found[(group == g) & (bins == b)]
            assert len(set(own.tolist())) == len(own) and set(own.tolist()) <= set(pool[b].tolist())
    for row, b in zip(seen, bins, strict=True):
        assert np.allclose(row[pool[b]] / 4000, 1 / len(pool[b]), atol=0.05)
    assert len(paths.drawn_in_groups(group[:0], bins[:0], pool, rng)) == 0


def test_separation_and_proximity_take_all_lines_and_conditions(spark, monkeypatch):
    """Every order's lines make edges, whatever their quantity; sets are compared in every condition, and to every class of diseases."""
    d = "/root/testdata/sf0.001"
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_partkey").distinct().collect()
    orders = {}
    for r in li:
        orders.setdefault(r.l_orderkey, set()).add(r.l_partkey)
    near = {}
    for parts in orders.values():
        for x in parts:
            near.setdefault(x, set()).update(parts - {x})
    edges = {(x, y) for x, ys in near.items() for y in ys if x < y}
    assert {(r.u, r.v) for r in registry.b.interactions(spark, d, None).collect()} == edges

    @cache
    def away(starts):
        depth, front = dict.fromkeys(starts, 0), list(starts)
        for x in front:
            for y in near[x]:
                if y not in depth:
                    depth[y] = depth[x] + 1
                    front.append(y)
        return depth

    sets = {}
    for r in registry.b.edges(spark, d).collect():
        sets.setdefault((r.condition, r.compound), set()).add(r.target)
    inside = frozenset(away((min(near),)))
    assert inside == set(near)  # one component
    sets = {k: frozenset(s & inside) for k, s in sets.items() if s & inside}
    got = {(r.condition, r.a, r.b): r for r in registry.network_separation(spark, d).collect()}
    assert set(got) == {(c, x, y) for c, x in sets for o, y in sets if c == o and x < y} and len({k[0] for k in got}) == 3
    for (c, x, y), r in got.items():
        one, two = sets[c, x], sets[c, y]
        to_one, to_two = away(one), away(two)
        d_ab = (sum(to_two[n] for n in one) + sum(to_one[n] for n in two)) / (len(one) + len(two))
        within = [sum(min(away((n,))[m] for m in s if m != n) for n in s) / len(s) if len(s) > 1 else 0.0 for s in (one, two)]
        assert math.isclose(r.d_ab, d_ab, abs_tol=1e-6) and math.isclose(r.separation, d_ab - sum(within) / 2, abs_tol=1e-6) and (r.n_a, r.n_b) == (len(one), len(two))
    goals = {}
    for r in registry.b.diseases(spark, d).collect():
        goals.setdefault(r.disease.split(" ")[0], set()).add(r.target)
    near_goal = {k: away(frozenset(s & inside)) for k, s in goals.items()}
    draws = paths.proximity_draws
    monkeypatch.setattr(paths, "proximity_draws", lambda *given: draws(*given[:3], n_random=3))
    found = {(r.condition, r.disease, r.name): r.d_observed for r in registry.network_proximity(spark, d).collect()}
    assert set(found) == {(c, k, x) for c, x in sets for k in goals}
    assert all(math.isclose(v, sum(near_goal[k][n] for n in sets[c, x]) / len(sets[c, x]), abs_tol=1e-6) for (c, k, x), v in found.items())


def test_separation_past_the_driver(spark, monkeypatch):
    """Neither the network nor its members are collected; more than 64 sets, in groups that overlap, make each pair of a group once."""
    rng = random.Random(5)
    net = spark.createDataFrame([(i, rng.randrange(i)) for i in range(1, 300)], "u long, v long")
    sets = spark.createDataFrame([(n, rng.randrange(300)) for n in range(70) for _ in range(3)], "name long, node long")
    groups = spark.createDataFrame([(n, g) for n in range(70) for g in "xy" if g == "x" or n % 3 == 0], "name long, group string")
    members = sets.select(F.col("node").alias("draw"), "node").distinct()
    plain = rows(paths.separation(paths.multi_source_hops(net, members, members).withColumnRenamed("draw", "source"), sets))

    def collected(*_):
        raise AssertionError("rows reach the driver")

    monkeypatch.setattr(type(net), "toPandas", collected)
    found = paths.set_separation(net, sets, groups)
    assert rows(found) == sorted([("x", *r) for r in plain] + [("y", *r) for r in plain if r[0] % 3 == 0 == r[1] % 3], key=str)


def test_interactions_send_no_lines_through_the_driver(spark):
    assert "Broadcast" not in registry.b.interactions(spark, "/root/testdata/sf0.001", None)._jdf.queryExecution().executedPlan().toString()


def test_searches_by_source_sort_no_level(monkeypatch):
    """A level's ends are marked, and no edge of the last level is looked at: on a complete bipartite network each pair of a side passes the other."""
    near = [list(range(4, 10))] * 4 + [list(range(4))] * 6
    want = [15 / 4] * 4 + [6 / 6] * 6
    looks = []
    repeat = np.repeat
    monkeypatch.setattr(kernels.np, "unique", lambda *_: pytest.fail("a level is sorted"))
    monkeypatch.setattr(kernels.np, "repeat", lambda *given: looks.append(1) or repeat(*given))
    assert np.allclose(kernels.betweenness(near, np.array([0])) + kernels.betweenness(near, np.arange(1, 10)), want)
    assert len(looks) == 2 * 2 * 10  # two levels of each source


def test_a_task_leaves_a_forest_of_its_edges():
    rng = random.Random(6)
    pairs = pd.DataFrame([(rng.randrange(40), rng.randrange(40)) for _ in range(400)] + [(90, 91), (91, 92)], columns=["u", "v"])
    less = pd.concat(components.forests(iter([pairs.iloc[:200], pairs.iloc[200:]])))
    assert len(less) <= 41 and dict(components.settled(less).to_numpy().tolist()) == dict(components.settled(pairs).to_numpy().tolist())

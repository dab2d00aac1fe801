"""Exact neighbours over cells and density clusters against versions that compare all pairs."""

from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from vialattice.operators import density, match, neighbours

INDEX = "lane long, camera string, e array<double>"


def grouped(n, groups, spread, seed, d=8):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((groups, d))
    e = centre[np.arange(n) % groups] + spread * rng.standard_normal((n, d))
    return e / np.linalg.norm(e, axis=1, keepdims=True)


@pytest.mark.parametrize("other_camera", [True, False])
def test_neighbours_are_exact_and_few_pairs_are_compared(spark, other_camera):
    e = grouped(600, 30, 0.05, 1)
    e[100:110] = e[7]  # copies
    camera = [f"c{k // 20}" for k in range(600)]
    df = spark.createDataFrame([(k, camera[k], e[k].tolist()) for k in range(600)], INDEX)
    p = neighbours.Params(cell=8, block=100)
    got = {(r["query"], r["place"]): r["ref"] for r in match.nearest(df, df, 3, other_camera, p).collect()}
    _, pairs = neighbours.k_nearest(df, df, 3, other_camera, p)
    assert pairs < 600 * 600 / 3
    sims = np.round(e @ e.T, 9)
    for q in range(600):
        out = [k for k in range(600) if (camera[k] != camera[q] if other_camera else k != q)]
        want = sorted(out, key=lambda k: (-sims[q, k], k))[:3]
        assert [got[q, place] for place in (1, 2, 3)] == want


def test_few_neighbours_and_none(spark):
    df = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "a", [0.0, 1.0]), (2, "b", [0.6, 0.8])], INDEX)
    got = sorted((r["query"], r["ref"], r["place"]) for r in match.nearest(df, df, 5).collect())
    assert got == [(0, 2, 1), (1, 2, 1), (2, 0, 2), (2, 1, 1)]
    assert match.nearest(df, df.limit(0), 5).count() == 0 and match.nearest(df.limit(0), df, 5).count() == 0


def plain(e, samples, size):
    """All pairs, Kruskal's tree, and a recursion over the hierarchy."""
    n = len(e)
    d = density.distances(e, e)
    core = np.sort(d + np.diag(np.full(n, -1.0)), axis=1)[:, samples]
    w = np.maximum(np.maximum(d, core[:, None]), core)
    parts, top = {k: [k] for k in range(n)}, {k: ("lane", k) for k in range(n)}
    of = list(range(n))
    for x, i, j in sorted((w[i, j], i, j) for i in range(n) for j in range(i + 1, n)):
        a, b = of[i], of[j]
        if a != b:
            for k in parts[b]:
                of[k] = a
            parts[a] = parts[a] + parts.pop(b)
            top[a] = ("merge", x, top[a], top.pop(b), list(parts[a]))
    (root,) = top.values()
    lanes = lambda t: [t[1]] if t[0] == "lane" else t[4]

    def cluster(t, birth):
        """(stability, lanes, clusters within)"""
        total, whole = 0.0, lanes(t)
        while True:
            dense = 1 / max(t[1], density.LEAST)
            sides = [s for s in t[2:4] if len(lanes(s)) >= size]
            if len(sides) == 2:
                return total + len(lanes(t)) * (dense - birth), whole, [cluster(s, dense) for s in sides]
            total += (len(lanes(t)) - sum(len(lanes(s)) for s in sides)) * (dense - birth)
            if not sides:
                return total, whole, []
            t = sides[0]

    def best(c, is_root):
        worth, chosen = 0.0, []
        for inner in c[2]:
            v, some = best(inner, False)
            worth, chosen = worth + v, chosen + some
        return (c[0], [c[1]]) if c[0] >= worth and not is_root else (max(c[0], worth), chosen)

    out = np.full(n, -1)
    for some in best(cluster(root, 0.0), True)[1]:
        out[some] = min(some)
    return out


@pytest.mark.parametrize("n, groups, spread, p", [
    (500, 12, 0.08, density.Params(block=60, cells=neighbours.Params(cell=32, block=100))),
    (90, 4, 0.3, density.Params(samples=1, size=2, known=2, block=7, cells=neighbours.Params(cell=10))),
    (60, 5, 0.15, density.Params(samples=4, size=6, known=5)),
])
def test_clusters_equal_single_linkage_over_all_pairs(spark, n, groups, spread, p):
    e = grouped(n, groups, spread, n)
    e[5:9] = e[4]  # copies: distances of 0, and ties
    df = spark.createDataFrame([(k, e[k].tolist()) for k in range(n)], "lane long, e array<double>").repartition(5)
    got = {r["lane"]: r["cluster"] for r in density.clusters(df, p).collect()}
    want = plain(e, p.samples, p.size)
    assert [got[k] for k in range(n)] == want.tolist()
    assert len(set(want)) > 2


def test_tree_has_the_least_weight(spark):
    e = grouped(120, 6, 0.2, 3)
    p = density.Params(known=3, cells=neighbours.Params(cell=12))
    df = spark.createDataFrame([(k, "", e[k].tolist()) for k in range(120)], INDEX)
    got = sorted((r["w"], r["lo"], r["hi"]) for r in density.spanning_tree(df, p).collect())
    d = density.distances(e, e)
    core = np.sort(d + np.diag(np.full(120, -1.0)), axis=1)[:, p.samples]
    w = np.maximum(np.maximum(d, core[:, None]), core)
    of, want = list(range(120)), []
    for x, i, j in sorted((w[i, j], i, j) for i in range(120) for j in range(i + 1, 120)):
        if of[i] != of[j]:
            want.append((x, i, j))
            of = [of[i] if k == of[j] else k for k in of]
    assert got == want


def test_too_few_lanes_are_noise(spark):
    df = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(5)] + [(9, None)], "lane long, e array<double>")
    assert sorted(map(tuple, density.clusters(df).collect())) == [(k, -1) for k in range(5)]
    assert density.clusters(df.limit(0)).count() == 0


@pytest.mark.parametrize("other_camera", [True, False])
def test_many_visits_meet_in_blocks(spark, other_camera):
    """Rows spread evenly visit most cells: blocks meet, and no row goes to more tasks than the grid is wide."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 24))
    x[::9] = x[0]  # equal ones
    x /= np.sqrt((x * x).sum(1))[:, None]
    df = spark.createDataFrame([(k, f"c{k // 20}", x[k].tolist()) for k in range(400)], "lane long, camera string, e array<double>")
    p = neighbours.Params(cell=4, block=50, visits=8, grid=3)
    sims = np.round(x @ x.T, 9)
    own = np.arange(400) // 20 if other_camera else np.arange(400)
    sims[own[:, None] == own] = -np.inf
    want = np.argsort(-sims, axis=1, kind="stable")[:, :3]
    got = {(r["query"], r["place"]): r["ref"] for r in match.nearest(df, df, 3, other_camera, p).collect()}
    assert got == {(i, place + 1): want[i, place] for i in range(400) for place in range(3)}
    found, _ = neighbours.k_nearest(df, df, 3, other_camera, p)
    assert found.count() <= 400 * 3 * 3


@pytest.mark.parametrize("visits", [2, 1000])
def test_cores_by_blocks_and_by_cells(spark, visits):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 20))
    x[::11] = x[0]
    df = spark.createDataFrame([(k, "c", x[k].tolist()) for k in range(300)], "lane long, camera string, e array<double>")
    p = density.Params(cells=neighbours.Params(cell=4, block=70, visits=visits, grid=3))
    near, core, _, _ = density.reachability(df, p)
    d = density.distances(x, x)
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :8]
    assert {r["lane"]: r["core"] for r in core.collect()} == {k: d[k, order[k, 1]] for k in range(300)}
    assert sorted((r["query"], r["ref"]) for r in near.select("query", "ref").collect()) == sorted((i, int(j)) for i in range(300) for j in order[i])


def kruskal(x, samples):
    """The edges of the tree by all pairs, in order."""
    n = len(x)
    d = density.distances(x, x)
    core = np.sort(d + np.diag(np.full(n, -1.0)), axis=1)[:, samples]
    w = np.maximum(np.maximum(d, core[:, None]), core)
    of, out = np.arange(n), []
    i, j = np.triu_indices(n, 1)
    for k in np.lexsort((j, i, w[i, j])):
        a, b = of[i[k]], of[j[k]]
        if a != b:
            out.append((w[i[k], j[k]], int(i[k]), int(j[k])))
            of[of == b] = a
    return out


@pytest.mark.parametrize("visits", [2, 1000])
def test_tree_of_families_larger_than_what_is_known(spark, visits):
    """Lanes whose known neighbours are all of their own component are compared, by blocks or by cells."""
    e = np.vstack([grouped(160, 8, 0.02, 4), grouped(40, 40, 0.1, 5)])
    e[20:30] = e[12]  # copies
    df = spark.createDataFrame([(k, "", e[k].tolist()) for k in range(200)], INDEX)
    p = density.Params(known=3, cells=neighbours.Params(cell=10, block=60, visits=visits, grid=3))
    got = sorted((r["w"], r["lo"], r["hi"]) for r in density.spanning_tree(df, p).collect())
    assert got == kruskal(e, p.samples)


def test_the_largest_component_is_not_compared(spark, monkeypatch):
    """Few lanes are compared, however many the largest component has."""
    e = np.vstack([grouped(200, 1, 0.1, 6), grouped(50, 1, 0.1, 7)])  # far from each other, so the last round has these two
    df = spark.createDataFrame([(k, "", e[k].tolist()) for k in range(250)], INDEX)
    p = density.Params(known=3, cells=neighbours.Params(cell=10, block=60))
    asked, search = [], density._searched

    def counted(some, *rest):
        asked.append(some.count())
        return search(some, *rest)

    monkeypatch.setattr(density, "_searched", counted)
    got = sorted((r["w"], r["lo"], r["hi"]) for r in density.spanning_tree(df, p).collect())
    assert got == kruskal(e, p.samples)
    assert sum(asked) < 250, asked


def test_distances_to_pivots_take_bounded_memory(spark):
    """A task's slices are the shorter the more pivots there are, which grow with the table; no row is lost."""
    t = pd.DataFrame({"lane": np.arange(10_000)})
    for pivots in (1, 400, 2403, 4096, 10 * neighbours.HELD):
        got = list(neighbours.slices(iter([t, t[:0], t[:7]]), pivots))
        assert all(len(x) * pivots <= max(neighbours.HELD, pivots) for x in got)
        assert np.concatenate([x.lane for x in got]).tolist() == [*range(10_000), *range(7)]


def test_cores_by_short_slices(spark):
    """1,500 pivots: a batch of 1,500 rows goes in three slices."""
    e = grouped(1500, 300, 0.05, 4)
    df = spark.createDataFrame([(k, "", e[k].tolist()) for k in range(1500)], INDEX).coalesce(1)
    _, core, _, _ = density.reachability(df, density.Params(cells=neighbours.Params(cell=1, visits=1500)))
    d = np.sort(density.distances(e, e), axis=1)
    assert {r["lane"]: r["core"] for r in core.collect()} == dict(enumerate(d[:, 2]))


def _shuffled(spark):
    """Bytes of the session's shuffle files."""
    root = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    return sum(f.stat().st_size for f in root.rglob("shuffle_*.data"))


def test_shuffles_of_a_search_go_with_it(spark):
    """Disk holds one search's blocks at a time; garbage of the driver isn't waited for."""
    e = grouped(3000, 60, 0.5, 4, d=64)
    df = spark.createDataFrame([(k, "", e[k].tolist()) for k in range(3000)], INDEX)
    before = _shuffled(spark)
    density.reachability(df, density.Params(cells=neighbours.Params(cell=20, block=200, visits=2)))
    assert _shuffled(spark) - before < 3000 * 64 * 8

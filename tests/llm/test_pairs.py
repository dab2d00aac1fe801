"""Near-duplicate vectors and texts, and components, against brute force."""

import re

import numpy as np
import pytest

from vialattice.llm import embeddings, graph, minhash


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def smallest(nodes, links):
    parent = {n: n for n in nodes}
    for a, b in links:
        x, y = find(parent, a), find(parent, b)
        parent[max(x, y)] = min(x, y)
    return {n: find(parent, n) for n in nodes}


def test_components_of_a_long_chain(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (103, 101)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100, 103: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_hubs_dealt_over_salts(spark, monkeypatch):
    monkeypatch.setattr(graph, "LEAST", 20)
    monkeypatch.setattr(graph, "SHARE", 5)
    monkeypatch.setattr(graph, "SALTS", 7)
    links = [(500, k) for k in range(300, 700)] + [(900, k) for k in range(800, 1000)] + [(1, 2), (2, 650), (1500, 1501)]
    nodes = {x for p in links for x in p}
    want = smallest(nodes, [p for p in links if p[0] != p[1]])
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert got == want


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((12, 64))
    rows = [(k, [float(x) for x in np.float32(centre[k % 12] + 0.05 * rng.standard_normal(64))], k % 2) for k in range(150)]
    rows += [(200 + k, rows[3][1], 1) for k in range(30)]  # copies
    rows += [(300, None, 0), (301, [0.0] * 64, 0), (302, [float("nan")] + [1.0] * 63, 0), (303, [None] + [1.0] * 63, 0), (304, rows[0][1], None), (305, [], 0), (306, rows[0][1][:32], 0), (None, rows[0][1], 0)]
    return rows


def test_vectors(spark, vectors):
    df = spark.createDataFrame([(*r, "x") for r in vectors], "vec_id long, embedding array<float>, label int, Label2 string")
    got = embeddings.near_duplicates(df, embeddings.Params(at_once=32)).collect()
    assert len(got) == len(vectors)
    good = [(i, np.array(v, np.float64), lab) for i, v, lab in vectors if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(a[0], b[0]) for k, a in enumerate(good) for b in good[:k] if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.98]
    assert len(links) > 500
    component = smallest([r[0] for r in vectors if r[0] is not None], links)
    for r in got:
        if r["vec_id"] is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, True)
            continue
        n = sum(r["vec_id"] in p for p in links)
        assert (r["n_links"], r["component_id"], r["kept"]) == (n, component[r["vec_id"]], component[r["vec_id"]] == r["vec_id"])


def test_filters_meet_at_the_threshold():
    rng = np.random.default_rng(0)
    p = embeddings.Params()
    a = embeddings.unit(rng.standard_normal((3000, 64)))
    n = rng.standard_normal((3000, 64))
    n = embeddings.unit(n - (n * a).sum(1, keepdims=True) * a)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * n
    lists = []
    for x in (a, b):
        row, filters = embeddings.decode(x, p)
        lists.append([set(filters[row == k]) for k in range(0, 3000, 10)])
    assert all(x & y for x, y in zip(*lists, strict=True))


def test_recall_at_the_threshold(spark):
    """10,000 vectors, most of their neighbours just above or below the threshold, copies and ties among them."""
    rng = np.random.default_rng(11)
    centre = embeddings.unit(rng.standard_normal((700, 64)))
    near = embeddings.unit(rng.standard_normal((9300, 64)))
    of = np.where(np.arange(9300) < 2000, 0, rng.integers(0, 700, 9300))  # one large cluster
    near = embeddings.unit(near - (near * centre[of]).sum(1, keepdims=True) * centre[of])
    cosine = rng.uniform(0.975, 0.999, (9300, 1))
    near = cosine * centre[of] + np.sqrt(1 - cosine**2) * near
    x = np.vstack([centre, near]).astype(np.float32)
    x[-500:] = x[3000:3500]
    label = np.r_[np.arange(700) % 3, of % 3]
    rows = [(k, v.tolist(), int(lab)) for k, (v, lab) in enumerate(zip(x, label, strict=True))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(8)
    y = embeddings.unit(x)
    want = np.zeros(len(x), np.int64)
    for at in range(0, len(x), 1000):
        want[at : at + 1000] = ((y[at : at + 1000] @ y.T >= 0.98) & (label[at : at + 1000, None] == label)).sum(1) - 1
    assert want.sum() > 20_000
    for p in (embeddings.Params(), embeddings.Params(directions=1)):
        got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(df, p).collect()}
        found = np.array([got[k] for k in range(len(x))])
        assert (found <= want).all() and found.sum() >= 0.9999 * want.sum(), (p, found.sum(), want.sum())


def test_directions_grow_with_the_vectors():
    p = embeddings.Params()
    assert [p.at_size(n).directions for n in (0, 65_536, 8 * 65_536, 10**12)] == [64, 64, 128, 1024]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < 5 else frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(2)
    word = lambda: "w" + "abcdefghij"[rng.integers(10)] + str(rng.integers(60))
    base = [[word() for _ in range(120)] for _ in range(6)]
    rows = []
    for k in range(160):
        words = list(base[k % 6])
        for _ in range(int(rng.integers(0, 9))):
            words[int(rng.integers(len(words)))] = word()
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, rows[0][1]) for k in range(40)]
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one two"), (2004, "ONE two"), (2005, "É one two three"), (2006, "é one two three"), (2007, "word " * 30_000), (2008, "word " * 20_000), (None, rows[0][1])]
    return rows


@pytest.mark.parametrize("turns", [0, 3])
def test_texts(spark, texts, turns):
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, Component int")
    got = minhash.near_duplicates(df, minhash.Params(turns=turns, at_once=64)).collect()
    assert len(got) == len(texts)
    sets = {i: shingles(t) for i, t in texts if i is not None}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    component = smallest(ids, links)
    assert len(set(component.values())) < 130
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), component[r["doc_id"]], component[r["doc_id"]] == r["doc_id"])


def test_overlaps_of_long_sets():
    rng = np.random.default_rng(3)
    codes = [np.unique(rng.integers(0, 150_000, n).astype(np.uint64)) for n in rng.integers(1, 90_000, 40)]
    a, b = np.triu_indices(40, 1)
    want = [len(np.intersect1d(codes[x], codes[y])) for x, y in zip(a, b, strict=True)]
    assert minhash._overlaps(codes, a, b).tolist() == want and minhash._overlaps(codes, a[:50], b[:50]).tolist() == want[:50]


def test_repeated_ids_share_their_links(spark):
    rng = np.random.default_rng(8)
    a, b, c = ([f"{x}{rng.integers(10**6)}" for _ in range(100)] for x in "abc")
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, " ".join(c)), (4, " ".join(c)), (5, near(c)), (1, ""), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as Text", "2 as DOC_ID")
    got = sorted((r["doc_id"], r["component_id"], r["n_shingles"]) for r in minhash.near_duplicates(df).collect())
    assert got == [(1, 1, 0), (1, 1, 96), (1, 1, 96), (2, 1, 96), (3, 1, 96), (4, 4, 96), (4, 4, 96), (5, 4, 96), (6, 6, 0)]


def test_empty_tables(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0

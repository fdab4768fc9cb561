"""Distributed average linkage and components against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairn.operators import cells
from cairn.operators import clustering as cl
from cairn.operators import vectors as vx


def brute_average_linkage(x, t):
    """Textbook average-linkage agglomeration on cosine distance: repeatedly
    merge the closest pair of clusters while their distance is < t."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1.0 - x @ x.T
    clusters = [[i] for i in range(len(x))]
    while True:
        best, pair = None, None
        for i in range(len(clusters)):
            for j in range(i + 1, len(clusters)):
                v = d[np.ix_(clusters[i], clusters[j])].mean()
                if best is None or v < best:
                    best, pair = v, (i, j)
        if best is None or best >= t:
            break
        i, j = pair
        clusters[i] = clusters[i] + clusters[j]
        del clusters[j]
    return sorted(sorted(c) for c in clusters)


def as_partition(rows):
    groups = {}
    for i, c in rows:
        groups.setdefault(c, []).append(i)
    return sorted(sorted(g) for g in groups.values())


@pytest.mark.parametrize("seed,t", [(1, 0.7), (3, 0.6)])
def test_average_linkage_matches_brute_force(spark, seed, t):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, 8))
    x = np.vstack([c + 0.6 * rng.normal(size=(8, 8)) for c in centers]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vec array<float>")
    want = brute_average_linkage(x.astype(np.float64), t)
    got = as_partition(cl.average_linkage(df, t).select("id", "cluster").collect())
    assert got == want
    # the same clusters however small the groups are
    for bound in (12,):
        got = as_partition(cl.average_linkage(df, t, group_rows=bound).select("id", "cluster").collect())
        assert got == want


def test_linkage_of_a_long_chain_takes_as_many_rounds_as_it_needs(spark):
    # gaps grow along an arc, so merges wait for each other from one end to the other; groups of one cluster
    # leave a single merge a round
    gaps = 0.002 * 1.02 ** np.arange(10)
    at = np.concatenate([[0.0], np.cumsum(gaps)])
    x = np.stack([np.cos(at), np.sin(at)], axis=1)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    got = as_partition(cl.average_linkage(df, 0.001, group_rows=1).collect())
    assert got == brute_average_linkage(x, 0.001)


def chain_rounds(n):
    """Rounds that reciprocal neighbours take on points whose gaps shrink to one end, one merge a round."""
    ids, s = np.arange(n), None
    at = np.cumsum(0.9999 ** np.arange(n)) * 0.001
    s = np.stack([np.cos(at), np.sin(at)], axis=1)
    root, size, _, _ = cl.merge_group(ids, np.ones(n), s, np.full(n, np.inf), np.full(n, cl._LAST), 0.5)
    return root, size


def test_a_group_merges_through_hundreds_of_rounds():
    root, size = chain_rounds(600)
    want = brute_average_linkage(np.stack([np.cos(a := np.cumsum(0.9999 ** np.arange(60)) * 0.001), np.sin(a)], axis=1), 0.5)
    assert len(want) == len(set(chain_rounds(60)[0])) == 1 and len(set(root)) == 1 and size.max() == 600


def test_a_group_leaves_what_an_outer_neighbour_may_forestall():
    s = np.array([[1.0, 0.0], [0.995, 0.1], [0.0, 1.0]])
    s /= np.linalg.norm(s, axis=1, keepdims=True)
    ids, n, far = np.array([10, 20, 30]), np.ones(3), np.full(3, cl._LAST)
    root, _, _, wants = cl.merge_group(ids, n, s, np.array([np.inf, 0.001, np.inf]), np.array([5, 7, 9]), 0.5)
    assert root.tolist() == [0, 1, 2] and wants.tolist() == [False, True, False]
    root, size, _, _ = cl.merge_group(ids, n, s, np.full(3, 0.4), far, 0.5)
    assert root.tolist() == [0, 0, 2] and size[0] == 2


def test_copies_missing_and_zero_vectors(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(5, 12)] + [(1, [1.0, 0.001, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0, 0.0]),
                                                           (20, [0.0, 1.0, 0.0]), (21, [0.0, 1.0, 0.0]), (-7, [0.0, 0.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = as_partition(cl.average_linkage(df, 0.3).collect())
    assert got == sorted([[1, *range(5, 12)], [2], [3], [4], [20, 21], [-7]])
    assert cl.average_linkage(df.limit(0), 0.3).count() == 0
    assert as_partition(cl.average_linkage(df, 0.0).collect()) == sorted([[r[0]] for r in rows])


def clustered(n, dim=16, centres=40, spread=0.05, seed=5):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    x = c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))
    x[: n // 3] = x[0]                                        # a third are copies
    x[: n // 3] += spread * rng.normal(size=(n // 3, dim)) * (np.arange(n // 3) % 2)[:, None]
    return x


def test_pruned_pairs_lose_none_and_score_few(spark):
    x = clustered(1500)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    got = {(r.a, r.b) for r in vx.similar_pairs(df, 0.02, block_rows=100).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = u @ u.T
    assert got == {(i, j) for i, j in zip(*np.nonzero(1.0 - sims < 0.02)) if i < j}
    # what is scored: homes with themselves and with their visitors
    import math
    rows, layout = cells.lay_out(df, 1500, 100)
    visits = cells.visit_counts(rows, layout, cells.inner_visits(layout, math.acos(0.98)))
    cell, salt = (np.array(c) for c in zip(*[(r.cell, r.salt) for r in rows.select("cell", "salt").collect()]))
    homes = np.bincount(layout.group_of(cell, salt), minlength=layout.groups)
    assert homes.sum() == 1500 and homes.max() < 200
    scored = (homes * (homes - 1) // 2 + homes * visits).sum()
    assert scored < 0.35 * 1500 * 1499 / 2


def test_nearest_visits_few_groups(spark):
    x = clustered(1200, seed=8)
    led = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x[:1000])], "id long, vec array<double>")
    asked = spark.createDataFrame([(i, [float(v) for v in r], i * 7919) for i, r in enumerate(x[1000:])],
                                  "id long, vec array<double>, salt long")
    got = {r.qid: r.ord for r in vx.nearest(asked, led, 1000, 60).collect()}
    sims = x[1000:] @ x[:1000].T
    assert all(np.isclose(sims[q, o], sims[q].max(), rtol=0, atol=1e-12) for q, o in got.items()) and len(got) == 200


def test_similar_pairs_small_blocks_equal_one_block(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(90, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vec array<float>")
    many = {(r.a, r.b) for r in vx.similar_pairs(df, 0.8, block_rows=7).collect()}
    one = {(r.a, r.b) for r in vx.similar_pairs(df, 0.8, block_rows=10_000).collect()}
    xn = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = xn @ xn.T
    brute = {(i, j) for i in range(90) for j in range(i + 1, 90) if 1.0 - s[i, j] < 0.8}
    assert many == one == brute


def test_components_chain(spark):
    nodes = spark.range(10).select(F.col("id"))
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 6)] + [(8, 9)], "a long, b long")
    got = dict(cl.connected_components(nodes, edges).collect())
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 7, 8: 8, 9: 8}


def test_nearest_prior_blocks_match_brute_force(spark):
    rng = np.random.default_rng(11)
    led = rng.normal(size=(23, 5))
    led /= np.linalg.norm(led, axis=1, keepdims=True)
    led[7] = led[3]                                   # tie: the earlier ledger entry must win
    qs = rng.normal(size=(41, 5))
    qs /= np.linalg.norm(qs, axis=1, keepdims=True)
    qs[0] = led[3]
    ledger = spark.createDataFrame([(i, f"t{i}", [float(v) for v in r]) for i, r in enumerate(led)] +
                                   [(99, "bad", [1.0, 0.0])], "ord long, title string, vec array<float>")
    queries = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(qs)], "qid long, vec array<float>")
    sims = qs.astype(np.float32).astype(np.float64) @ led.astype(np.float32).astype(np.float64).T
    for block in (4, 1000):
        got = {r.qid: (r.nearest_ord, r.duplicate) for r in vx.nearest_prior(queries, ledger, 5, block_rows=block).collect()}
        want = {i: (int(np.argmax(sims[i])), bool(sims[i].max() >= 0.75)) for i in range(41)}
        assert got == want and got[0] == (3, True)


def test_vectors_without_structure_go_to_few_groups(spark, monkeypatch):
    monkeypatch.setattr(cells, "COPIES", 2)
    x = np.random.default_rng(3).normal(size=(900, 16))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    rows, layout = cells.lay_out(df, 900, 30)
    everywhere = cells.visit_counts(rows, layout, cells.inner_visits(layout, 1.5))
    wide, size, counts = cells.widened(rows, 900, layout, 30, lambda g: cells.inner_visits(g, 1.5))
    assert everywhere.sum() > 10 * 900 and counts.sum() <= 2 * 900 and size > 30 and wide.groups < layout.groups
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = u @ u.T
    got = {(r.a, r.b) for r in vx.similar_pairs(df, 0.7, block_rows=30).collect()}
    assert got == {(i, j) for i, j in zip(*np.nonzero(sims > 0.3)) if i < j}
    asked = df.filter("id % 3 = 0").withColumn("salt", F.col("id") * 7919)
    near = {r.qid: r.ord for r in vx.nearest(asked, df.filter("id % 3 > 0"), 600, 20).collect()}
    led = np.array([i for i in range(900) if i % 3])
    assert near == {i: int(led[(x[led] @ x[i]).argmax()]) for i in range(0, 900, 3)}
    few = as_partition(cl.average_linkage(df, 0.5, group_rows=900).collect())
    assert as_partition(cl.average_linkage(df, 0.5, group_rows=100).collect()) == few and len(few) < 900


def test_copies_leave_a_task_in_bounded_frames():
    f = pd.DataFrame({"id": range(1000), "vec": [np.ones(2)] * 1000})
    at = np.repeat(np.arange(1000), 40)
    out = list(cells._copied(f, at, grp=at * 2, home=True))
    assert max(map(len, out)) <= cells.SLICE and sum(map(len, out)) == len(at)
    both = pd.concat(out)
    assert (both["grp"].to_numpy() == both["id"].to_numpy() * 2).all() and both["home"].all()


def test_clusters_with_none_near_are_done():
    # two that merge, one near something elsewhere, one near nothing
    s = np.array([[1.0, 0, 0], [1.0, 0.01, 0], [0, 1.0, 0], [0, 0, 1.0]])
    s /= np.linalg.norm(s, axis=1, keepdims=True)
    root, *_, more = cl.group_merges(np.array([1, 2, 3, 4]), np.ones(4), s, np.array([np.inf, np.inf, 0.2, np.inf]),
                                     np.array([9, 9, 9, 9]), 0.5)
    assert list(root) == [0, 0, 2, 3] and list(more) == [False, False, True, False]


def test_components_read_their_edges_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            made.add(len(f))
            yield f

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long").mapInPandas(count, "a long, b long")
    got = {r.comp for r in cl.connected_components(spark.range(41), edges).collect()}
    assert got == {0} and made.value == 40


def nearest_of_all(x, t, ids):
    best, own = cl._Best(ids), np.arange(len(ids))
    for i, j, d in cl._near_places(x, x.astype(np.float32), x, x.astype(np.float32), t, (own, own), False):
        best.add(i, d, ids[j])
    return best


def test_packed_rows_come_back():
    x = np.random.default_rng(1).normal(size=(40, 30)) * (np.random.default_rng(2).random((40, 30)) < 0.3)
    x[:3] = np.array([[0.0], [1.5], [np.pi]])
    x[3, :] = 0.0
    x[3, 29] = -2.0
    packed = cells.packed(x)
    assert (cells.stacked(packed) == x).all() and min(map(len, packed)) < 40 and max(map(len, packed)) == 240
    assert (cells.stacked(cells.packed(x[1:3])) == x[1:3]).all()


@pytest.mark.parametrize("edges", [0, 1 << 20])
def test_a_task_that_knows_the_nearest_ones_merges_like_a_group_with_products(monkeypatch, edges):
    monkeypatch.setattr(cl, "EDGES", edges)
    for dim, t, k, seed in ((16, 0.5, 700, 1), (64, 0.65, 900, 2), (6, 1.2, 120, 3)):
        rng = np.random.default_rng(seed)
        c = rng.normal(size=(20, dim))
        x = cells.directions(c[rng.integers(0, 20, k)] + 0.7 * rng.normal(size=(k, dim)))
        ids = np.sort(rng.choice(10**6, k, False))
        want = cl.group_merges(ids, np.ones(k), x, np.full(k, np.inf), np.full(k, cl._LAST), t)[0]
        near = nearest_of_all(x, t, ids)
        some = np.flatnonzero(near.d < t)
        got = np.arange(k)
        got[some] = some[cl.finish(ids[some], np.ones(len(some)), x[some].copy(), near.d[some], near.other[some], t)]
        assert (got == want).all()


def test_only_clusters_whose_nearest_changed_search_again(spark, monkeypatch):
    asked = []
    search = cl._nearest_of

    def counted(some, n_asked, among, n_among, *rest):
        asked.append((n_asked, n_among))
        return search(some, n_asked, among, n_among, *rest)

    monkeypatch.setattr(cl, "_nearest_of", counted)
    monkeypatch.setattr(cl, "FINISH", 1)
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(30, 12))
    x = centres[rng.integers(0, 30, 240)] + 0.5 * rng.normal(size=(240, 12))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    got = as_partition(cl.average_linkage(df, 0.2, group_rows=60).collect())
    assert got == brute_average_linkage(x, 0.2)
    assert len(asked) > 1 and all(a < n for a, n in asked)


def test_a_ring_of_equal_distances_does_not_stop(spark):
    ring = [(1, 0.1, 5), (5, 0.1, 9), (9, 0.1, 1), (20, 0.3, 1)]
    near = spark.createDataFrame(ring, "id long, d double, other long")
    assert [tuple(r) for r in cl._mutual(near).collect()] == [(1, 5)]
    x = cells.directions(np.array([[1.0, 0.1, 0.1], [0.1, 1.0, 0.1], [0.1, 0.1, 1.0]]))
    root = cl.finish(np.array([1, 5, 9]), np.ones(3), x, np.full(3, 0.79), np.array([5, 9, 1]), 0.9)
    assert list(root) == [0, 0, 0]

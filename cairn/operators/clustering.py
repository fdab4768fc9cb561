"""Threshold clustering (H3) and connected components as iterative DataFrame jobs.

* ``connected_components``: min-label propagation with pointer jumping over an
  edge list; each round is two joins and a min-aggregation, and the labels are
  checkpointed every round so lineage stays flat.
* ``average_linkage``: exact average-linkage agglomerative clustering on cosine
  distance, merging while distance < threshold. Average linkage is reducible: a merge brings
  no third cluster nearer than the nearer of the two was. So any pair of reciprocal nearest
  neighbours may be merged at once, and distances to clusters elsewhere can only be bounded from below
  by what they were. For unit vectors the average pairwise cosine distance between clusters A and B
  is ``1 - (sum_A . sum_B) / (|A| |B|)``, so a cluster is its size and mean vector, and no edge list or
  member x member matrix is kept. All clusters meet once; after that a cluster is compared again only if it or its nearest
  one was merged.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cells
from .util import materialize
from .vectors import common_width, valid_vectors


def _cut(df: DataFrame, name: str) -> DataFrame:
    """Lineage cut for iterative jobs: a parquet table in the shared checkpoint
    folder. (``Dataset.checkpoint`` keeps the source plan's constraints, which
    then compound round after round.)"""
    return materialize(df, name)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) nodes + (a, b) undirected edges -> (id, component) with component =
    smallest id in the component. Runs until no label changes."""
    edges = _cut(edges.select("a", "b"), "cc-edges")     # each round reads them; they may be dear to make
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = _cut(nodes.select("id", F.col("id").alias("comp")), "cc")
    # labels only ever decrease, so the label sum is unchanged iff no label changed
    total = labels.agg(F.sum(F.col("comp").cast("decimal(38,0)"))).first()[0]
    while True:
        msgs = both.join(labels.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id"), "comp")
        prop = labels.unionByName(msgs).groupBy("id").agg(F.min("comp").alias("comp"))
        # pointer jumping: adopt the label of your label
        parent = prop.select(F.col("id").alias("comp"), F.col("comp").alias("pcomp"))
        jumped = prop.join(parent, "comp", "left").select(
            "id", F.least("comp", F.coalesce("pcomp", "comp")).alias("comp"))
        labels = _cut(jumped, "cc")
        new_total = labels.agg(F.sum(F.col("comp").cast("decimal(38,0)"))).first()[0]
        if new_total == total:
            break
        total = new_total
    return labels


GROUP_ROWS = 8192      # clusters of one task; their products are 540 MB
BLOCK_ROWS = 2048      # clusters of a group that others visit, before it is made larger
BLOCK_BYTES = 1 << 27  # of the vectors of such a group at most
FINISH = 8             # times the clusters of a group: what one task merges that knows the nearest of each,
FINISH_BYTES = 1 << 28  # if their vectors are no larger than this
EDGES = 1 << 20        # pairs nearer than the threshold that a task keeps
BLOCKS = 64            # tasks of a search for some clusters' nearest ones, or more
_PASS = 1 << 20        # cells of a product that is looked through for the nearest, while a core's cache holds them
_CHUNK = 1 << 23       # cells of a product that is looked through at once
_INF, _LAST = float("inf"), (1 << 63) - 1


def _nearest_in(gram: np.ndarray, n: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance and place of the nearest of ``cols`` (the first among ties) to each of ``rows``, itself left out."""
    dist, place = np.full(len(rows), _INF), np.full(len(rows), -1)
    if not len(cols):
        return dist, place
    every = len(cols) == len(gram)
    step = max(1, _CHUNK // len(cols))
    for at in range(0, len(rows), step):
        some = rows[at:at + step]
        sims = (gram[some] if every else gram[np.ix_(some, cols)]) / n[cols]
        sims[np.arange(len(some)), np.searchsorted(cols, some)] = -_INF
        j = sims.argmax(axis=1)
        dist[at:at + step], place[at:at + step] = 1.0 - sims[np.arange(len(j)), j] / n[some], cols[j]
    return dist, place


def merge_group(ids: np.ndarray, n: np.ndarray, s: np.ndarray, out_d: np.ndarray, out_id: np.ndarray, t: float):
    """``group_merges`` without the last of its results."""
    return group_merges(ids, n, s, out_d, out_id, t)[:4]


def group_merges(ids: np.ndarray, n: np.ndarray, s: np.ndarray, out_d: np.ndarray, out_id: np.ndarray, t: float):
    """All merges inside a group that nothing outside can forestall. ``ids`` rise; ``out_d`` and ``out_id`` are the
    distance and id of each cluster's nearest one elsewhere. A pair is merged if each is the other's nearest in the
    group, nearer than t and nearer than what lies outside; the pair's bound is the lesser of both.
    Returns (root, n, s, wants, open): the place of the cluster that each went into, sizes and sums at
    the roots, which clusters are unmerged and have their nearest one elsewhere, and which have any nearer than t: the
    others never will, as merges bring nothing nearer."""
    k = len(ids)
    n, s, out_d, out_id = n.astype(np.float64), s.copy(), out_d.copy(), out_id.copy()
    # products of sums: those of a merged cluster are the sums of its parts' products
    gram = s @ s.T
    alive, root = np.ones(k, bool), np.arange(k)
    dist, place = _nearest_in(gram, n, np.arange(k), np.arange(k))
    first_d = dist.copy()
    first_id = np.where(place >= 0, ids[place], _LAST)
    while True:
        rows = np.flatnonzero(alive & (dist < t))
        a = rows[(place[place[rows]] == rows) & (rows < place[rows]) & alive[place[rows]]]
        b = place[a]
        safe = np.ones(len(a), bool)
        for x, y in ((a, b), (b, a)):
            safe &= (dist[x] < out_d[x]) | ((dist[x] == out_d[x]) & (ids[y] < out_id[x]))
        a, b = a[safe], b[safe]
        if not len(a):
            break
        s[a] += s[b]
        n[a] += n[b]
        gram[a] += gram[b]
        gram[:, a] += gram[:, b]
        # among equal distances the id of what lies outside no longer decides
        out_d[a], out_id[a] = np.minimum(out_d[a], out_d[b]), -_LAST
        alive[b] = False
        root[b] = a
        touched = np.zeros(k, bool)
        touched[a] = touched[b] = True
        living = np.flatnonzero(alive)
        again = living[touched[living] | touched[np.maximum(place[living], 0)]]
        dist[again], place[again] = _nearest_in(gram, n, again, living)
    while (root[root] != root).any():
        root = root[root]
    merged = np.bincount(root, minlength=k) > 1
    nearer = (out_d < first_d) | ((out_d == first_d) & (out_id < first_id))
    return root, n, s, alive & ~merged & (out_d < t) & nearer, alive & (np.minimum(dist, out_d) < t)


def average_linkage(vecs: DataFrame, threshold: float, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(id, vec) -> (id, cluster), cluster = smallest member id; merges while the average cosine distance
    is < ``threshold``. Exact, for any number of vectors and rounds.

    Identical vectors are one weighted cluster from the start. Clusters meet in pivot cells of their means, where the
    angles allow anything nearer than the threshold, and each keeps its nearest one. A round merges all pairs that are each
    other's nearest. A merge brings nothing nearer, so only the merged clusters and those whose nearest one went into
    another look for a new one, and clusters with none nearer than the threshold are done. At least the nearest pair of
    all merges in a round; as soon as all that are left fit into one task, they are merged there.
    Vectors that are missing or not of the commonest width stay alone; a zero vector is at distance 1 from all."""
    vecs = materialize(vecs.select("id", "vec"), "linkage-vectors")
    dim = common_width(vecs)
    # by their hash first: whole vectors are dear to sort
    good = valid_vectors(vecs, dim).filter(F.col("vec").isNotNull()).withColumn("hash", F.xxhash64("vec"))
    # the threshold of identical vectors is 0: they are merged before all others, or never
    members = good.groupBy("hash", "vec").agg(F.min("id").alias("cid"), F.count("*").alias("n")) if threshold > 0 else \
        good.select("vec", F.col("id").alias("cid"), F.lit(1).cast("long").alias("n"))

    def unit_rows(frames):
        for f in frames:
            if len(f):
                yield pd.DataFrame({"id": f["cid"], "n": f["n"], "vec": cells.packed(cells.directions(cells.stacked(f["vec"])))})

    clusters = materialize(members.mapInPandas(unit_rows, "id long, n long, vec binary"), "linkage-clusters")
    labels = (good.join(members.select("hash", "vec", "cid"), ["hash", "vec"]).select("id", "cid") if threshold > 0
              else good.select("id", F.col("id").alias("cid")))
    moves = None                       # (id, cluster) of every cluster of the start
    count = clusters.count()
    if count > group_rows:
        near = materialize(_all_nearest(clusters, count, threshold, min(BLOCK_ROWS, group_rows)), "linkage-near")
        count = near.count()
        last = max(group_rows, min(FINISH * group_rows, FINISH_BYTES // (8 * dim)))
        while count > last:
            pairs = materialize(_mutual(near), "linkage-pairs")
            gone = pairs.select(F.col("b").alias("id"), F.col("a").alias("cid"))
            moves = materialize(_led(moves, gone), "linkage-moves")
            clusters, kept = _joined(clusters, near, pairs)
            sizes = clusters.groupBy().agg(F.count("*").alias("n"), F.count_if("again").alias("m")).first()
            found = _nearest_of(clusters.filter("again"), sizes.m, clusters, sizes.n, dim, threshold)
            near = materialize(kept.unionByName(found), "linkage-near")
            count = near.count()
        clusters = clusters.join(near, "id")
    if count:
        gone = _merged_together(clusters, threshold).filter("id <> cid")
        moves = materialize(_led(moves, gone), "linkage-moves")
    if moves is not None:
        to = moves.select(F.col("id").alias("cid"), F.col("cid").alias("to"))
        labels = labels.join(to, "cid", "left").select("id", F.coalesce("to", "cid").alias("cid"))
    # a merged cluster keeps the smaller id, so its id is its smallest member's
    return materialize(vecs.select("id").join(labels, "id", "left").select("id", F.coalesce("cid", "id").alias("cluster")),
                       "clusters")


def _led(moves: DataFrame | None, new: DataFrame) -> DataFrame:
    """(id, cid) of all moves so far, each led on by the new ones."""
    if moves is None:
        return new
    on = new.select(F.col("id").alias("cid"), F.col("cid").alias("to"))
    return moves.join(on, "cid", "left").select("id", F.coalesce("to", "cid").alias("cid")).unionByName(new)


def _edges(x: np.ndarray, single: np.ndarray, t: float) -> tuple | None:
    """(places, larger places, distances) of the pairs nearer than t, or None if they are more than ``EDGES``."""
    low = 1.0 - t - (x.shape[1] + 8) * 2.0 ** -24
    out, count, step, take = [], 0, max(1, _CHUNK // max(1, len(x))), max(1, _CHUNK // x.shape[1])
    for at in range(0, len(x), step):
        i, j = np.nonzero(single[at:at + step] @ single[at:].T > low)
        i, j = i[j > i] + at, j[j > i] + at
        count += len(i)
        if count > EDGES:
            return None
        for k in range(0, len(i), take):
            d = 1.0 - (x[i[k:k + take]] * x[j[k:k + take]]).sum(axis=1)
            out.append((i[k:k + take][d < t], j[k:k + take][d < t], d[d < t]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _led_edges(edges: tuple, touched: np.ndarray, into: np.ndarray, x: np.ndarray, t: float) -> tuple:
    """The edges after merges: those of the ``touched`` lead to where these went ``into`` and are measured again."""
    i, j, d = edges
    moved = touched[i] | touched[j]
    a, b = into[i[moved]], into[j[moved]]
    key = np.unique(np.minimum(a, b)[a != b] * len(x) + np.maximum(a, b)[a != b])
    a, b = key // len(x), key % len(x)
    far, take = np.empty(len(a)), max(1, _CHUNK // x.shape[1])
    for k in range(0, len(a), take):
        far[k:k + take] = 1.0 - (x[a[k:k + take]] * x[b[k:k + take]]).sum(axis=1)
    near = far < t
    return tuple(np.concatenate(c) for c in zip((i[~moved], j[~moved], d[~moved]), (a[near], b[near], far[near])))


def finish(ids: np.ndarray, n: np.ndarray, x: np.ndarray, d: np.ndarray, other: np.ndarray, t: float) -> np.ndarray:
    """The place of the cluster that each goes into in the end, from sizes, means, and distance and id of the nearest one.
    ``ids`` rise and hold all that are near another; ``x`` is written to, if it may be. The rounds of ``average_linkage`` in memory, without products kept; once
    a group's clusters are left, the pairs nearer than t are listed if they are few: a merge can only have pairs of its parts."""
    root, cur = np.arange(len(ids)), np.arange(len(ids))
    n, x, d, single = n.astype(np.float64), np.require(x, requirements="W"), d.copy(), x.astype(np.float32)
    place = np.where(d < t, np.searchsorted(ids, other), cur)
    gone, edges = np.zeros(len(ids), bool), _edges(x, single, t) if len(ids) <= GROUP_ROWS else None
    while (d < t).any():
        rows = np.arange(len(cur))
        a = np.flatnonzero((place[place] == rows) & (rows < place) & (d < t))
        if not len(a):             # equal distances lead round in a ring
            a = np.flatnonzero(d < t)
            a = a[np.lexsort((np.maximum(a, place[a]), np.minimum(a, place[a]), d[a]))[:1]]
            a, b = np.minimum(a, place[a]), np.maximum(a, place[a])
        else:
            b = place[a]
        x[a] = (x[a] * n[a, None] + x[b] * n[b, None]) / (n[a] + n[b])[:, None]
        n[a] += n[b]
        root[cur[b]] = cur[a]
        touched = np.zeros(len(cur), bool)
        touched[a] = touched[b] = gone[b] = True
        again = ~gone & (d < t) & (touched | touched[place])
        # what has gone is similar to nothing until it is left out
        x[b], d[b], single[a], single[b], place[b] = 0.0, _INF, x[a], 0.0, b
        if edges is not None:
            into = rows.copy()
            into[b] = a
            edges = _led_edges(edges, touched, into, x, t)
        here = ~gone & (d < t)
        if t >= 1.0 or here.sum() < 0.75 * len(here):
            to = np.cumsum(here) - 1
            place = np.where(here[place], to[place], -1)[here]
            cur, n, x, d, single, again, gone = (v[here] for v in (cur, n, x, d, single, again, gone))
            if edges is not None:
                i, j, far = edges
                both = here[i] & here[j]
                edges = to[i[both]], to[j[both]], far[both]
            elif len(cur) <= GROUP_ROWS:
                edges = _edges(x, single, t)
        asked = np.flatnonzero(again)
        if edges is None:
            best = _Best(asked)
            for i, j, found in _near_places(x[asked], single[asked], x, single, t, (np.arange(len(asked)), asked), False):
                best.add(i, found, j)
            d[asked], place[asked] = best.d, np.where(best.d < _INF, best.other, asked)
        else:
            best = _Best(np.arange(len(cur)))
            for i, j in ((0, 1), (1, 0)):
                some = again[edges[i]]
                best.add(edges[i][some], edges[2][some], edges[j][some])
            d[asked], place[asked] = best.d[asked], np.where(best.d < _INF, best.other, best.ids)[asked]
    while (root[root] != root).any():
        root = root[root]
    return root


def _merged_together(clusters: DataFrame, t: float) -> DataFrame:
    """(id, cid): the cluster that each of ``clusters(id, n, vec)``, all in one group, goes into in the end. With (d, other)
    beside them the nearest of each is known."""
    known = "d" in clusters.columns

    def merged(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id")
        ids, n, x, k = f["id"].to_numpy(), f["n"].to_numpy(), cells.stacked(f["vec"]), len(f)
        if known:
            root = finish(ids, n, x, f["d"].to_numpy(), f["other"].to_numpy(), t)
        else:
            root = group_merges(ids, n, x * n[:, None], np.full(k, _INF), np.full(k, _LAST), t)[0]
        return pd.DataFrame({"id": ids, "cid": ids[root]})

    one = clusters.select("id", "n", "vec", *(["d", "other"] if known else []), F.lit(0).alias("grp"))
    return one.groupBy("grp").applyInPandas(merged, "id long, cid long")


def _mutual(near: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of ``near(id, d, other)`` that are each other's nearest. Where equal distances lead round
    in a ring so that there are none, the nearest pair."""
    p, q = near.alias("p"), near.alias("q")
    both = (p.join(q, (F.col("p.other") == F.col("q.id")) & (F.col("q.other") == F.col("p.id")) & (F.col("p.id") < F.col("q.id")))
            .select(F.col("p.id").alias("a"), F.col("q.id").alias("b")))
    if not both.isEmpty():
        return both
    least = near.select("d", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    return least.orderBy("d", "a", "b").limit(1).select("a", "b")


def _joined(clusters: DataFrame, near: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, n, vec, again) of the ``clusters`` that are ``near`` another after the merges of ``pairs``, and the rows of
    ``near`` that still hold. ``again``: merged, or its nearest one was."""
    to = pairs.select(F.col("a").alias("id"), F.col("a").alias("to")).unionByName(
        pairs.select(F.col("b").alias("id"), F.col("a").alias("to")))
    role = materialize(near.join(to, "id", "left")
                       .join(to.select(F.col("id").alias("other"), F.lit(True).alias("lost")), "other", "left")
                       .select("id", "d", "other", "to", F.coalesce("lost", F.lit(False)).alias("lost")), "linkage-role")
    here = clusters.select("id", "n", "vec").join(role.select("id", "to", "lost"), "id")
    a = here.filter("to = id").select("to", "n", "vec")
    b = here.filter("to <> id").select("to", F.col("n").alias("m"), F.col("vec").alias("other"))

    def means(frames):
        for f in frames:
            if len(f):
                n, m = f["n"].to_numpy()[:, None], f["m"].to_numpy()[:, None]
                x = (cells.stacked(f["vec"]) * n + cells.stacked(f["other"]) * m) / (n + m)
                yield pd.DataFrame({"id": f["to"], "n": f["n"] + f["m"], "vec": cells.packed(x), "again": True})

    joint = a.join(b, "to").select("to", "n", "vec", "m", "other").mapInPandas(means, "id long, n long, vec binary, again boolean")
    rest = here.filter("to IS NULL").select("id", "n", "vec", F.col("lost").alias("again"))
    return (materialize(rest.unionByName(joint), "linkage-clusters"),
            role.filter("to IS NULL AND NOT lost").select("id", "d", "other"))


def _near_places(xa: np.ndarray, fa: np.ndarray, xb: np.ndarray, fb: np.ndarray, t: float, same: tuple, both: bool,
                 known: np.ndarray | None = None):
    """Yields (rows of xa, rows of xb, distances): each row of xa with its nearest of xb, if that is nearer than t, with
    ``both`` also each row of xb with its nearest of xa, and beside them what single precision (fa, fb) does not tell from
    these; the distances are of doubles. ``same`` are the places that hold one and the same cluster; rows of xa that are
    farther than the distances already ``known`` may be left out."""
    # what a product of float32 rows no longer than 1 is off by at most
    slack = (xa.shape[1] + 8) * 2.0 ** -24
    low = 1.0 - t - slack
    # not so few rows at once that the product itself gets slow
    step, take = max(1, max(_PASS, min(_CHUNK, 128 * len(xb))) // len(xb)), max(1, _CHUNK // xa.shape[1])
    seen = np.full(len(xb), low, np.float32)
    for at in range(0, len(xa), step):
        sims = fa[at:at + step] @ fb.T
        here = (same[0] >= at) & (same[0] < at + step)
        sims[same[0][here] - at, same[1][here]] = -_INF
        most = sims.max(axis=1)
        hot = np.flatnonzero(most > low)
        if not len(hot):
            continue
        if len(hot) < len(sims):
            sims, most = sims[hot], most[hot]
        floor = np.maximum(most - 2 * slack, low)
        rows = np.arange(len(hot)) if known is None else np.flatnonzero(most >= 1.0 - known[hot + at] - 2 * slack)
        r, c = np.nonzero((sims if len(rows) == len(sims) else sims[rows]) >= floor[rows, None])
        r = rows[r]
        if both:
            most = sims.max(axis=0)
            cols = np.flatnonzero(most >= seen - 2 * slack)
            seen = np.maximum(seen, most)
            r2, c2 = np.nonzero((sims if len(cols) == len(xb) else sims[:, cols]) >= np.maximum(most[cols] - 2 * slack, low))
            r, c = np.concatenate([r, r2]), np.concatenate([c, cols[c2]])
        r = hot[r] + at
        for k in range(0, len(r), take):
            i, j = r[k:k + take], c[k:k + take]
            d = 1.0 - (xa[i] * xb[j]).sum(axis=1)
            yield i[d < t], j[d < t], d[d < t]


class _Best:
    """The nearest one found for each of some clusters, the smallest id among ties."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.d, self.other = ids, np.full(len(ids), _INF), np.full(len(ids), _LAST)

    def add(self, place: np.ndarray, d: np.ndarray, other: np.ndarray):
        order = np.lexsort((other, d, place))
        place, d, other = place[order], d[order], other[order]
        first = np.ones(len(place), bool)
        first[1:] = place[1:] != place[:-1]
        place, d, other = place[first], d[first], other[first]
        less = (d < self.d[place]) | ((d == self.d[place]) & (other < self.other[place]))
        self.d[place[less]], self.other[place[less]] = d[less], other[less]

    def frame(self) -> pd.DataFrame:
        any_ = self.d < _INF
        return pd.DataFrame({"id": self.ids[any_], "d": self.d[any_], "other": self.other[any_]})


def _search(t: float, both: bool):
    """For the rows of ``cells.dealt``: yields (id, d, other), the nearest of its chunk for each home, with ``both`` also
    the nearest of the homes for each visitor."""
    def work(frames):
        place, held, homes = None, [], None

        def placed():
            f = pd.concat(held)
            x = cells.stacked(f["vec"])
            held.clear()
            return _Best(f["id"].to_numpy()), x, x.astype(np.float32)

        def ended():
            if place is not None and place[1] < 0 and held:
                best, x, single = placed()
                own = np.arange(len(x))
                for i, j, d in _near_places(x, single, x, single, t, (own, own), False):
                    best.add(i, d, best.ids[j])
                yield best.frame()
            elif homes is not None:
                yield homes[0].frame()

        for f in frames:
            if not len(f):
                continue
            grp, part, is_home = f["grp"].to_numpy(), f["part"].to_numpy(), f["home"].to_numpy()
            cut = np.flatnonzero((grp[1:] != grp[:-1]) | (part[1:] != part[:-1])) + 1
            for a, b in zip([0, *cut], [*cut, len(f)]):
                if (grp[a], part[a]) != place:
                    yield from ended()
                    place, homes = (grp[a], part[a]), None
                    held.clear()
                some = f.iloc[a:b]
                if is_home[a:b].any():
                    held.append(some[is_home[a:b]][["id", "vec"]])
                if not is_home[a:b].all() and (held or homes):
                    homes = homes or placed()
                    best, x, single = homes
                    some = some[~is_home[a:b]]
                    ids, y = some["id"].to_numpy(), cells.stacked(some["vec"])
                    _, *same = np.intersect1d(best.ids, ids, return_indices=True)
                    met = _Best(ids)
                    for i, j, d in _near_places(x, single, y, y.astype(np.float32), t, same, both, best.d):
                        best.add(i, d, ids[j])
                        if both:
                            met.add(j, d, best.ids[i])
                    if both:
                        yield met.frame()
        yield from ended()

    return work


_NEAR = "id long, d double, other long"


def _nearest(found: DataFrame) -> DataFrame:
    return found.groupBy("id").agg(F.min(F.struct("d", "other")).alias("o")).select("id", "o.d", "o.other")


def _all_nearest(clusters: DataFrame, count: int, t: float, block_rows: int) -> DataFrame:
    """(id, d, other) of ``clusters(id, n, vec)`` that have any nearer than t."""
    rows, layout = cells.lay_out(clusters.select("id", "vec"), count, block_rows)
    # means of like directions: an average distance under t needs an angle whose cosine is over 1 - t
    reach = math.acos(1.0 - t) if 0.0 < t < 1.0 else math.pi * (t > 0)
    layout, block_rows, counts = cells.widened(rows, count, layout, block_rows,
                                               lambda groups: cells.inner_visits(groups, reach), BLOCK_BYTES)
    dealt = cells.dealt(rows, rows, layout, cells.inner_visits(layout, reach), counts, 2 * block_rows, alone=True)
    return _nearest(dealt.mapInPandas(_search(t, True), _NEAR))


def _nearest_of(asked: DataFrame, n_asked: int, among: DataFrame, n_among: int, dim: int, t: float) -> DataFrame:
    """(id, d, other) of those ``asked`` that have any nearer than t ``among`` the clusters, which are dealt by hash: each
    group of the asked meets each part of all, some ``BLOCKS`` tasks in all."""
    area = max(1, n_asked) * n_among // BLOCKS
    rows = min(max(1, BLOCK_BYTES // (8 * dim)), max(1024, math.isqrt(area)))
    groups, parts = math.ceil(max(1, n_asked) / rows), math.ceil(n_among / max(1024, area // rows))
    salt = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30))
    homes = asked.select("id", "vec", F.lit(True).alias("home"), (salt % groups).cast("long").alias("grp"),
                         F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")).alias("part"))
    visitors = among.select("id", "vec", F.lit(False).alias("home"),
                            F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")).alias("grp"),
                            (salt % parts).cast("long").alias("part"))
    return _nearest(cells.gathered(homes.unionByName(visitors)).mapInPandas(_search(t, False), _NEAR))

"""Hard negatives by anchor spanning-tree bounds.

Anchors of one label that lie near each other form a block, and each block its minimum spanning tree. If a candidate c
has the score s with a parent, its score with a child at edge distance e lies in s -+ e |c|; where the
parent's score is itself only bounded, the bounds add up along the way. So a block of candidates walks down the
tree: at the root it is scored, and at every other anchor only those are rescored whose
bounds overlap what the anchor still looks for. What it looks for is, first, a score that could be one of
its best positives, then, for each positive, a score in the window that could be among its first negatives.

Anchors (``every``-th ids) are a stated query set, met with all rows in blocks: rows are dealt to groups of
bounded size by hash, anchors to groups of blocks, and each pair of groups is one task's work. Each sends
on the first few of an anchor (or of an anchor and positive) only, and a window takes the first of those.

Integer products are exact: in double precision while no sum can reach 2^53, in 64-bit integers while none can reach
2^63, in unbounded integers beyond (a score out of the range of long is returned at its end).

Defined results: rows with a NULL id, label or vector, or with a NULL or non-finite component take no part; of rows
that share an id one takes part, the smallest by label and vector; a vector shorter than another counts as
ending in zeros; ties go to the smaller id; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship_package

EVERY, POSITIVES, NEGATIVES = 50, 5, 3
LOW, HIGH, BASE = 50, 95, 100          # LOW * positive <= BASE * negative <= HIGH * positive
ROW_GROUP = 1 << 16                    # rows of a group, about
ANCHOR_GROUP = 1 << 13                 # anchors of a group, about
BLOCK = 512                            # anchors of a tree, about
SLICE = 2048                           # rows that walk down a tree together
SIGNS = 16
_LONG = (1 << 63) - 1
_ANCHOR = "anchor_id long, label long, q array<long>, tree long, place int, parent int, edge double"


def usable(rows: DataFrame, id_col: str = "vec_id", label: str = "label", vec: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, label, q): one row of each id that takes part, components as whole numbers."""
    whole = F.transform(vec, lambda x: F.floor(x.cast("double") * scale))
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return (rows.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & F.col(vec).isNotNull() & finite)
            .select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("q"))
            .groupBy("id").agg(F.min(F.struct("label", "q")).alias("v")).select("id", "v.label", "v.q"))


def matrix(vectors) -> np.ndarray:
    """Rows padded with zeros to the widest."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), max(width, 1)), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _size(m: np.ndarray) -> int:
    """The largest magnitude (a long's smallest value has none of its own)."""
    return max(abs(int(m.max())), abs(int(m.min()))) if m.size else 0


def exact_type(a: np.ndarray, b: np.ndarray):
    """A number type in which products of rows of ``a`` and ``b`` are exact."""
    most = _size(a) * _size(b) * min(a.shape[1], b.shape[1])
    return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object


def spanning_tree(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge): rows in the order a minimum spanning tree takes them in (Prim), the place of
    each one's parent in that order (-1 at the root) and the distance from it."""
    x = m.astype(np.float64)
    n = len(x)
    norm2 = np.einsum("ij,ij->i", x, x)
    order, parent, edge = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n)
    near, via = np.full(n, np.inf), np.full(n, -1)
    left = np.ones(n, bool)
    now = 0
    for place in range(n):
        order[place], parent[place] = now, via[now]
        if place:
            step = x[now] - x[order[via[now]]]
            edge[place] = math.sqrt(step @ step)
        left[now] = False
        far = np.maximum(norm2 + norm2[now] - 2 * (x @ x[now]), 0)
        closer = left & (far < near)
        near[closer], via[closer] = far[closer], place
        now = int(np.argmin(np.where(left, near, np.inf)))
    return order, parent, edge


def walk(anchors: np.ndarray, parent, edge, rows: np.ndarray, norms: np.ndarray, wanted, take) -> int:
    """Lead the candidates ``rows`` down the tree. ``wanted(i, lo, hi)`` says which of them anchor i must see
    exactly, ``take(i, which, scores)`` receives those. Returns how many were scored."""
    lo, hi = np.empty((len(anchors), len(rows))), np.empty((len(anchors), len(rows)))
    scored = 0
    kind = exact_type(anchors, rows)
    a, x = anchors.astype(kind), rows.astype(kind)
    for i in range(len(anchors)):
        if parent[i] < 0:
            which = np.arange(len(rows))
        else:
            # a little wider than the bound, for the rounding of norms and distances
            reach = edge[i] * (1 + 1e-9) * norms + 1 + 1e-9 * np.abs(hi[parent[i]])
            lo[i], hi[i] = lo[parent[i]] - reach, hi[parent[i]] + reach
            which = np.flatnonzero(wanted(i, lo[i], hi[i]))
        if len(which):
            s = x[which] @ a[i]
            lo[i][which] = hi[i][which] = s.astype(np.float64)
            scored += len(which)
            take(i, which, s)
    return scored


class Best:
    """The first ``k`` of an anchor's candidates by score (descending) and id."""

    def __init__(self, k: int):
        self.k, self.rows, self.floor = k, [], -math.inf

    def add(self, scores, ids) -> None:
        if len(scores) > 4 * self.k and scores.dtype != object:      # ties of the k-th stay
            cut = scores >= np.partition(scores, -self.k)[-self.k]
            scores, ids = scores[cut], ids[cut]
        found = self.rows + [(-int(s), int(i)) for s, i in zip(scores, ids)]
        self.rows = sorted(found)[:self.k]
        if len(self.rows) == self.k:
            self.floor = -self.rows[-1][0]


def _trees(group: pd.DataFrame):
    """Anchors of one task by tree, in the order of the tree."""
    for _, tree in group.groupby("tree", sort=True):
        tree = tree.sort_values("place")
        yield tree, matrix(tree["q"].to_list()), tree["parent"].to_numpy(), tree["edge"].to_numpy()


def _cut(a: np.ndarray, x: np.ndarray):
    """Both with the columns that they share: beyond them one of the two is zero."""
    w = min(a.shape[1], x.shape[1])
    return a[:, :w], x[:, :w]


def _clipped(scores) -> list[int]:
    return [max(-_LONG - 1, min(_LONG, int(s))) for s in scores]


def first_positives(rows: pd.DataFrame, group: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    by_label = {label: (r["id"].to_numpy(np.int64), matrix(r["q"].to_list())) for label, r in rows.groupby("label")}
    for tree, anchors, parent, edge in _trees(group):
        own = tree["anchor_id"].to_numpy(np.int64)
        best = [Best(k) for _ in own]
        ids, all_x = by_label.get(tree["label"].iloc[0], (None, None))
        for at in range(0, 0 if ids is None else len(ids), SLICE):
            some, x = ids[at:at + SLICE], all_x[at:at + SLICE]
            norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
            a, x = _cut(anchors, x)

            def take(i, which, s, some=some):
                keep = (s >= best[i].floor) & (some[which] != own[i])
                best[i].add(s[keep], some[which][keep])

            walk(a, parent, edge, x, norms, lambda i, lo, hi: hi >= best[i].floor, take)
        out += [(a, i, s) for a, b in zip(own, best) for s, i in b.rows]
    return pd.DataFrame({"anchor_id": [a for a, _, _ in out], "positive_id": [i for _, i, _ in out],
                         "score": _clipped(-s for _, _, s in out)}).astype("int64")


def first_negatives(rows: pd.DataFrame, group: pd.DataFrame, k: int, low: int, high: int, base: int) -> pd.DataFrame:
    out = []
    ids, labels = rows["id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
    all_x = matrix(rows["q"].to_list())
    all_norms = np.sqrt((all_x.astype(np.float64) ** 2).sum(axis=1))
    for tree, anchors, parent, edge in _trees(group):
        own, label = tree["anchor_id"].to_numpy(np.int64), tree["label"].iloc[0]
        # smallest and largest score of each positive's window; an empty one looks for nothing
        windows = [[(p["positive_id"], p["score"], -(-low * p["score"] // base), high * p["score"] // base)
                    for p in (x.asDict() if hasattr(x, "asDict") else x for x in ps)] for ps in tree["positives"]]
        best = [[Best(k) for _ in w] for w in windows]
        for at in range(0, len(ids), SLICE):
            other = labels[at:at + SLICE] != label
            some, x, norms = ids[at:at + SLICE][other], all_x[at:at + SLICE][other], all_norms[at:at + SLICE][other]
            if not len(some):
                continue
            a, x = _cut(anchors, x)

            def wanted(i, lo, hi):
                least = min((max(w[2], b.floor) for w, b in zip(windows[i], best[i])), default=math.inf)
                most = max((w[3] for w in windows[i]), default=-math.inf)
                return (hi >= least) & (lo <= most)

            def take(i, which, s, some=some):
                for w, b in zip(windows[i], best[i]):
                    keep = (s >= max(w[2], b.floor)) & (s <= w[3])
                    if keep.any():
                        b.add(s[keep], some[which][keep])

            walk(a, parent, edge, x, norms, wanted, take)
        out += [(a, w[0], w[1], i, -s) for a, ws, bs in zip(own, windows, best) for w, b in zip(ws, bs) for s, i in b.rows]
    cols = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    return pd.DataFrame({c: _clipped(r[j] for r in out) for j, c in enumerate(cols)}).astype("int64")


def anchor_trees(anchors: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """Anchors of one label, in the order of the signs of fixed random projections, go to blocks of about
    ``block``; each block gets its spanning tree. ``anchors(id, label, q)``, ``n`` of them."""
    @F.pandas_udf("int")
    def signs(q: pd.Series) -> pd.Series:
        out = []
        for v in q:
            v = np.asarray(v, np.float64)
            plane = np.random.default_rng(7).standard_normal((len(v), SIGNS))
            out.append(int(((v @ plane) > 0) @ (1 << np.arange(SIGNS))))
        return pd.Series(out, index=q.index, dtype="int32")

    blocks = max(1, math.ceil(n / block))
    placed = materialize(anchors.withColumn("code", signs("q")).repartitionByRange(blocks, "label", "code", "id")
                         .withColumn("tree", F.spark_partition_id().cast("long")).drop("code"), "anchor-blocks")

    def tree(group: pd.DataFrame) -> pd.DataFrame:
        m = matrix(group["q"].to_list())
        order, parent, edge = spanning_tree(m)
        g = group.iloc[order]
        # a block that the range split left larger stays one tree; label and block together name it
        return pd.DataFrame({"anchor_id": g["id"].to_numpy(), "label": g["label"].to_numpy(), "q": g["q"].to_list(),
                             "tree": g["tree"].to_numpy(), "place": np.arange(len(g), dtype=np.int32),
                             "parent": parent.astype(np.int32), "edge": edge})

    return materialize(placed.groupBy("label", "tree").applyInPandas(tree, _ANCHOR)
                       .withColumn("tree", F.xxhash64("label", "tree")), "anchor-trees")


def _met(rows: DataFrame, trees: DataFrame, n_rows: int, n_anchors: int, run, schema: str, row_group: int,
         anchor_group: int) -> DataFrame:
    """Every group of rows with every group of trees, one task's work each."""
    threads = trees.sparkSession.sparkContext.defaultParallelism
    g = max(math.ceil(n_rows / row_group), min(math.ceil(n_rows / SLICE), 2 * threads), 1)
    h = max(math.ceil(n_anchors / anchor_group), 1)
    left = rows.select("id", "label", "q", F.pmod(F.xxhash64("id"), F.lit(g)).alias("g"),
                       F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("h"))
    right = trees.select("*", F.pmod(F.xxhash64("tree", F.lit(1)), F.lit(h)).cast("int").alias("h"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(g - 1).cast("long"))).alias("g"))

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return run(a, b)

    return left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInPandas(work, schema)


def mine(rows: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
         high: int = HIGH, base: int = BASE, block: int = BLOCK, row_group: int = ROW_GROUP,
         anchor_group: int = ANCHOR_GROUP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for ``rows(id, label, q)``,
    ids distinct (see ``usable``)."""
    ship_package(rows.sparkSession)
    rows = materialize(rows, "negative-rows")
    anchors = rows.filter(F.col("id") % every == 0)
    n_rows, n_anchors = rows.count(), anchors.count()
    trees = anchor_trees(anchors, n_anchors, block)
    near = _met(rows, trees, n_rows, n_anchors, lambda a, b: first_positives(a, b, positives),
                "anchor_id long, positive_id long, score long", row_group, anchor_group)
    first = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "positive_id")
    near = (near.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= positives).drop("r")
            .groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "score")).alias("positives")))
    # an anchor without positives looks for nothing, but may be another's parent
    none = F.array().cast("array<struct<positive_id:bigint,score:bigint>>")
    looking = materialize(trees.join(near, "anchor_id", "left").withColumn("positives", F.coalesce("positives", none)),
                          "anchor-windows")
    found = _met(rows, looking, n_rows, n_anchors, lambda a, b: first_negatives(a, b, negatives, low, high, base),
                 "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long",
                 row_group, anchor_group)
    first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    return (found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


# ---- registered query ------------------------------------------------------------------

def op12_spanning_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(usable(rows.withColumn("label", moved)))


OP12_SQL = f"""
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.id % {EVERY} = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score,
             CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
      FROM p JOIN s USING (anchor_id)
      WHERE NOT s.same AND {LOW} * positive_score <= {BASE} * s.score AND {BASE} * s.score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""

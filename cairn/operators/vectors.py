"""Vector jobs: validity screen (B11), embedding (H1), incremental embedding cache
(H2, E12), exact similarity self-join (D6) and nearest prior idea (D5).

Similarity joins are exact. Vectors are dealt to pivot cells, cells to groups of
bounded size, and groups meet only where the angles allow a result (``cells``); a group and the
visitors that stream past it are scored with numpy matrix products, and only results leave the task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import cells
from .util import materialize

BLOCK_ROWS = 2048
DUPLICATE_AT = 0.75


def valid_vectors(df: DataFrame, dim: int | Column, vec: str = "vec") -> DataFrame:
    """A vector of the wrong width is treated as missing, never an error."""
    d = dim if isinstance(dim, Column) else F.lit(dim)
    return df.withColumn(vec, F.when(F.size(vec) == d, F.col(vec)))


def unit(vec: Column) -> Column:
    """L2-normalise an array<float> in double precision (JVM-side)."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vec, lambda x: x.cast("double") / norm)


def hashing_encoder(df: DataFrame, text_col: str = "text", dim: int = 256, out: str = "vec", bucket=None) -> DataFrame:
    """H1 default encoder: lower-cased word tokens -> hashed term counts -> L2
    normalised float vector (tokens and their buckets in the JVM, the counts in an
    Arrow batch), a pure function of the text, so vectors can be cached by text hash. ``bucket`` maps a token to its place (default: xxhash64 modulo ``dim``).
    Any other encoder with the same (DataFrame, text_col) -> vec contract can be plugged in."""
    @F.pandas_udf("array<float>")
    def counted(buckets: pd.Series) -> pd.Series:
        rows = []
        for x in buckets:
            v = np.bincount(np.asarray(x if x is not None else [], dtype=np.int64), minlength=dim).astype(np.float64)
            rows.append((v / max(np.sqrt(v @ v), 1e-300)).astype(np.float32))
        return pd.Series(rows, index=buckets.index)

    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    place = bucket or (lambda w: F.pmod(F.xxhash64(w), F.lit(dim)))
    return df.withColumn(out, counted(F.transform(tokens, lambda w: place(w).cast("int"))))


def embedding_cache(corpus: DataFrame, cache: DataFrame, model: str, encode=hashing_encoder,
                    dim: int = 256) -> DataFrame:
    """H2: vectors for every corpus row, encoding only cache misses.

    A cached vector is reused iff its (id, text_hash) matches the current text and
    its width equals the encoder's; everything else is re-encoded. Cache rows of
    ids no longer in the corpus are pruned (they never reach the output).
    ``corpus(id, title, text)``, ``cache(id, text_hash, vec)``;
    output ``(id, text_hash, vec, reused)``.
    """
    keyed = corpus.select("id", "title", "text",
                          tx.cache_key(model, tx.embed_text(F.col("title"), F.col("text"))).alias("text_hash"))
    good = (valid_vectors(cache, dim).filter(F.col("vec").isNotNull())
            .groupBy("id", "text_hash").agg(F.min("vec").alias("vec")))   # one of several, always the same
    found = keyed.join(good, ["id", "text_hash"], "left")
    hit = found.filter(F.col("vec").isNotNull()).select("id", "text_hash", "vec", F.lit(True).alias("reused"))
    miss = found.filter(F.col("vec").isNull()).drop("vec")
    miss = encode(miss.withColumn("_etext", tx.embed_text(F.col("title"), F.col("text"))), "_etext", dim, "vec")
    fresh = miss.select("id", "text_hash", "vec", F.lit(False).alias("reused"))
    return hit.unionByName(fresh)


def common_width(vecs: DataFrame) -> int:
    """The commonest width (ties to the larger); 0 without vectors."""
    widths = vecs.groupBy(F.size("vec").alias("w")).agg(F.count("*").alias("n")).filter("w > 0")
    top = widths.orderBy(F.col("n").desc(), F.col("w").desc()).first()
    return top.w if top else 0


def similar_pairs(vecs: DataFrame, max_distance: float, block_rows: int = BLOCK_ROWS,
                  dim: int | None = None) -> DataFrame:
    """All pairs (a < b) with cosine distance < ``max_distance``, exact.
    Output ``(a, b, sim)`` with sim = cosine similarity (double). Vectors that are not
    ``dim`` wide (default: the commonest width) count as missing, a zero vector is similar to nothing.
    Vectors meet in pivot cells (see ``cells``), and only with cells that can hold a partner."""
    dim = common_width(vecs) if dim is None else dim
    vecs = valid_vectors(vecs.select("id", "vec"), dim).filter(F.col("vec").isNotNull())
    min_sim = 1.0 - max_distance
    reach = math.acos(min(1.0, max(-1.0, min_sim)))
    rows, layout = cells.lay_out(vecs, vecs.count(), block_rows)
    layout, block_rows, counts = cells.widened(rows, int(layout.size.sum()), layout, block_rows,
                                               lambda groups: cells.inner_visits(groups, reach))

    def score(homes: pd.DataFrame, visitors: pd.DataFrame | None):
        ia, xa = homes["id"].to_numpy(), cells.directions(cells.stacked(homes["vec"]))
        ib, xb = (ia, xa) if visitors is None else (visitors["id"].to_numpy(), cells.directions(cells.stacked(visitors["vec"])))
        za, zb = ~xa.any(axis=1), ~xb.any(axis=1)
        step = max(1, cells.PRODUCT // len(ib))
        for at in range(0, len(ia), step):
            sims = xa[at:at + step] @ xb.T
            r, c = np.nonzero(sims > min_sim)
            s = sims[r, c]
            r += at
            keep = ~(za[r] | zb[c])
            if visitors is None:
                keep &= ia[r] < ib[c]
            a, b, s = ia[r[keep]], ib[c[keep]], s[keep]
            if len(a):
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "sim": s})

    return cells.meet(rows, rows, layout, cells.inner_visits(layout, reach), counts, 2 * block_rows, score,
                      "a long, b long, sim double", alone=True)


def nearest_prior(queries: DataFrame, ledger: DataFrame, dim: int, threshold: float = DUPLICATE_AT,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For every query vector, the most similar ledger entry by dot product. Ties -> the earliest ledger
    entry (smallest ``ord``); ledger rows of another width are skipped; an empty ledger gives (0.0, '').
    ``duplicate`` iff sim >= threshold (inclusive). queries(qid, vec); ledger(ord, title, vec). Exact: a query first
    meets the ledger rows of its nearest cell, then only the cells whose bound reaches what it has found."""
    led = ledger.filter(F.size("vec") == dim)
    q = valid_vectors(queries.select(F.col("qid").alias("id"), "vec"), dim)
    asked = (q.filter(F.col("vec").isNotNull())
             .withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(1 << 30))))
    found = nearest(asked, led.select(F.col("ord").alias("id"), "vec"), led.count(), block_rows)
    titled = found.join(led.groupBy("ord").agg(F.min("title").alias("title")), "ord")
    out = q.select(F.col("id").alias("qid")).join(titled, "qid", "left")
    sim = F.coalesce(F.col("sim"), F.lit(0.0))
    return out.select("qid", F.col("ord").alias("nearest_ord"), F.coalesce("title", F.lit("")).alias("title"),
                      sim.alias("sim"), (sim >= threshold).alias("duplicate"))


def nearest(asked: DataFrame, stored: DataFrame, n_stored: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(qid, ord, sim): the stored row of largest dot product, then of smallest id, for each of
    ``asked(id, vec, salt)``; ``stored(id, vec)``."""
    schema = "qid long, ord long, sim double"
    if not n_stored:
        return asked.sparkSession.createDataFrame([], schema)
    rows, layout = cells.lay_out(stored, n_stored, block_rows)

    def best(homes: pd.DataFrame, visitors: pd.DataFrame | None):
        homes = homes.sort_values("id", kind="stable")   # max sim, earliest among ties
        ids, x = homes["id"].to_numpy(), cells.stacked(homes["vec"])
        step = max(1, cells.PRODUCT // len(ids))
        for at in range(0, len(visitors), step):
            some = visitors.iloc[at:at + step]
            sims = cells.stacked(some["vec"]) @ x.T
            j = sims.argmax(axis=1)
            yield pd.DataFrame({"qid": some["id"].to_numpy(), "ord": ids[j], "sim": sims[np.arange(len(j)), j]})

    def first(f: pd.DataFrame) -> np.ndarray:
        """The group of the nearest cell that has rows (one of them, if it has several)."""
        angle = np.where(layout.size > 0, layout.angles(cells.stacked(f["vec"])), np.inf)
        out = np.zeros((len(f), layout.groups), bool)
        out[np.arange(len(f)), layout.group_of(angle.argmin(axis=1), f["salt"].to_numpy())] = True
        return out

    def rest(groups: cells.Layout):
        """The other groups of the cells that may hold a better or an earlier one."""
        def choose(f: pd.DataFrame) -> np.ndarray:
            x = cells.stacked(f["vec"])
            limit = groups.bound(groups.angles(x)) * np.linalg.norm(x, axis=1)[:, None]
            allowed = groups.spread(limit >= f["sim"].to_numpy()[:, None])
            return allowed & ~first(f) if groups is layout else allowed      # larger groups hold more than the first
        return choose

    def met(visitors, groups, rows_of_group, choose, counts):
        return cells.meet(rows, visitors, groups, choose, counts, 4 * rows_of_group, best, schema)

    order = F.max_by(F.struct("ord", "sim"), F.struct(F.col("sim"), -F.col("ord")))
    nearby = met(asked, layout, block_rows, first, cells.visit_counts(asked, layout, first))
    one = materialize(nearby.groupBy("qid").agg(order.alias("t")).select("qid", "t.ord", "t.sim"), "nearest-first")
    if layout.groups == 1:
        return one
    again = materialize(asked.join(one.select(F.col("qid").alias("id"), "sim"), "id"), "nearest-asked")
    wide, wide_rows, counts = cells.widened(again, again.count(), layout, block_rows, rest)
    both = one.unionByName(met(again, wide, wide_rows, rest(wide), counts))
    return both.groupBy("qid").agg(order.alias("t")).select("qid", "t.ord", "t.sim")

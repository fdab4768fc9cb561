"""Registered queries for vectors and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.stopwords import spark_stop_words
from ..operators import clustering as cl
from ..operators import evidence as ev
from ..operators import vectors as vx
from ..sources.tables import table
from . import fixtures as fx
from .oracle import EVIDENCE_CTE, SIGNAL, q, with_
from .registry import register

PAIR_DISTANCE = 0.65  # the fixture vectors are random: 0.45 yields no pairs at all


def _vecs(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


PAIRS_SQL = f"""
v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (
  SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS sim
  FROM v a JOIN v b ON a.id < b.id
  WHERE 1.0 - list_cosine_similarity(a.e, b.e) < {PAIR_DISTANCE})"""


@register(sql=with_(PAIRS_SQL) + " SELECT a, b, round(sim, 6) AS sim FROM pairs")
def q_similar_pairs(spark, sf):
    p = vx.similar_pairs(_vecs(spark, sf), PAIR_DISTANCE)
    return p.select("a", "b", F.round("sim", 6).alias("sim"))


@register(sql="WITH RECURSIVE " + PAIRS_SQL.strip() + """,
e AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(id, comp) AS (
  SELECT id, id FROM v
  UNION
  SELECT e.b, r.comp FROM reach r JOIN e ON r.id = e.a)
SELECT id, min(comp) AS component FROM reach GROUP BY id""")
def q_components(spark, sf):
    v = _vecs(spark, sf)
    edges = vx.similar_pairs(v, PAIR_DISTANCE)
    return cl.connected_components(v.select("id"), edges).select("id", F.col("comp").alias("component"))


@register
def q_clustering(spark, sf):
    """H3: average-linkage clusters (size >= 2) of the fixture vectors; checked
    against a brute-force linkage in tests (no SQL form)."""
    lab = cl.average_linkage(_vecs(spark, sf), PAIR_DISTANCE)
    keys = ev.theme_keys(lab.select(F.col("cluster").alias("theme"), "id"))
    return (lab.join(keys.withColumnRenamed("theme", "cluster"), "cluster")
            .filter(F.col("size") >= 2).select("id", "cluster", "theme_key", "size"))


@register(sql="""
WITH l AS (SELECT vec_id AS ord, 'idea ' || CAST(vec_id AS VARCHAR) AS title, CAST(embedding AS DOUBLE[]) AS e
           FROM embeddings WHERE vec_id % 2 = 0 AND len(embedding) = 64),
qv AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 2 = 1),
s AS (SELECT qv.qid, l.ord, l.title, list_dot_product(qv.e, l.e) AS sim,
             row_number() OVER (PARTITION BY qv.qid ORDER BY list_dot_product(qv.e, l.e) DESC, l.ord) AS rn
      FROM qv CROSS JOIN l)
SELECT qid, ord AS nearest_ord, title, round(sim, 6) AS sim, sim >= 0.75 AS duplicate FROM s WHERE rn = 1""")
def q_nearest_prior(spark, sf):
    v = _vecs(spark, sf)
    ledger = v.filter(F.col("id") % 2 == 0).select(
        F.col("id").alias("ord"), F.concat(F.lit("idea "), F.col("id").cast("string")).alias("title"), "vec")
    queries = v.filter(F.col("id") % 2 == 1).select(F.col("id").alias("qid"), "vec")
    out = vx.nearest_prior(queries, ledger, dim=64)
    return out.select("qid", "nearest_ord", "title", F.round("sim", 6).alias("sim"), "duplicate")


CACHE_MODEL = "cairn-hashing-64"


def cache_fixture(spark, sf):
    """Cached vectors: ids = 0,1 mod 4 are current, 2 mod 4 were computed for an
    older text, 3 mod 4 are truncated (wrong width)."""
    raw = fx.raw_signal(spark, sf).select("id", "title", "text")
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    cur = tx.cache_key(CACHE_MODEL, tx.embed_text(F.col("title"), F.col("text")))
    j = emb.join(raw, "id")
    k = F.col("id") % 4
    return j.select("id",
                    F.when(k == 2, F.sha1(F.concat(F.lit("stale"), F.col("id").cast("string")))).otherwise(cur).alias("text_hash"),
                    F.when(k == 3, F.slice("vec", 1, 63)).otherwise(F.col("vec")).alias("vec"))


@register(sql=f"""
WITH corpus AS (
  SELECT doc_id AS id, sha1({q(CACHE_MODEL)} || chr(10) || 'doc ' || CAST(doc_id AS VARCHAR) || chr(10) || left(text, 1200)) AS text_hash
  FROM documents),
cache AS (
  SELECT e.vec_id AS id,
         CASE WHEN e.vec_id % 4 = 2 THEN sha1('stale' || CAST(e.vec_id AS VARCHAR)) ELSE c.text_hash END AS text_hash,
         CASE WHEN e.vec_id % 4 = 3 THEN len(e.embedding) - 1 ELSE len(e.embedding) END AS width
  FROM embeddings e JOIN corpus c ON c.id = e.vec_id)
SELECT c.id, c.text_hash, h.id IS NOT NULL AS reused, 64 AS width
FROM corpus c LEFT JOIN (SELECT DISTINCT id, text_hash FROM cache WHERE width = 64) h
  ON h.id = c.id AND h.text_hash = c.text_hash""")
def q_embedding_cache(spark, sf):
    corpus = fx.raw_signal(spark, sf).select("id", "title", "text")
    out = vx.embedding_cache(corpus, cache_fixture(spark, sf), CACHE_MODEL, dim=64)
    return out.select("id", "text_hash", "reused", F.size("vec").alias("width"))


_STOPS = "[" + ", ".join(q(w) for w in spark_stop_words()) + "]"


@register(sql=with_(SIGNAL, EVIDENCE_CTE) + f""",
mt AS (SELECT theme, id, 'doc ' || CAST(id AS VARCHAR) || chr(10) || left(text, 1200) AS t FROM mrows),
toks AS (
  SELECT theme, id, list_filter(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
                                lambda w: NOT list_contains({_STOPS}, w)) AS tk
  FROM mt),
uni AS (SELECT theme, unnest(tk) AS term FROM toks),
bi AS (SELECT theme, unnest(list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1])) AS term
       FROM toks WHERE len(tk) >= 2),
ends AS (SELECT theme, id, tk[len(tk)] AS last, lead(tk[1]) OVER (PARTITION BY theme ORDER BY id) AS nxt
         FROM toks WHERE len(tk) > 0),
cross_b AS (SELECT theme, last || ' ' || nxt AS term FROM ends WHERE nxt IS NOT NULL),
tf AS (SELECT theme, term, count(*) AS tf FROM (SELECT * FROM uni UNION ALL SELECT * FROM bi UNION ALL SELECT * FROM cross_b)
       GROUP BY 1, 2),
vocab AS (SELECT term, sum(tf) AS ctf, count(*) AS df FROM tf GROUP BY 1 ORDER BY ctf DESC, term LIMIT 4000),
nd AS (SELECT count(DISTINCT theme) AS n FROM mt),
tscored AS (
  SELECT tf.theme, tf.term, tf.tf * (ln((1.0 + nd.n) / (1.0 + vocab.df)) + 1.0) AS score
  FROM tf JOIN vocab USING (term), nd),
ttop AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY score DESC, term) AS r FROM tscored)
SELECT d.theme, coalesce(l.label, '(unlabelled)') AS label
FROM (SELECT DISTINCT theme FROM mt) d
LEFT JOIN (SELECT theme, string_agg(term, ', ' ORDER BY r) AS label FROM ttop WHERE r <= 5 GROUP BY 1) l USING (theme)""")
def q_theme_labels(spark, sf):
    sig = fx.signal(spark, sf)
    mem = fx.members(spark, sf, sig)
    mt = mem.join(sig.select("id", "title", "text"), "id").select(
        "theme", "id", tx.embed_text(F.col("title"), F.col("text")).alias("text"))
    return ev.tfidf_labels(mt)

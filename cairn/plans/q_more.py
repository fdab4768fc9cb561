"""Registered queries for the remaining set / routing / fold operators:
G2, G3, E11, E12, D8, D9, D10, K3, K4, C13, A13 and the end-to-end theme
rebuild H4."""

from __future__ import annotations

import uuid

from pyspark.sql import Observation, Window
from pyspark.sql import functions as F

from .. import NOW
from ..functions import text as tx
from ..operators import candidates as cd
from ..operators import clustering as cl
from ..operators import evidence as ev
from ..operators import feedback as fb
from ..operators import review as rv
from ..operators import vectors as vx
from ..operators.util import bounded_broadcast, materialize, write_table
from ..sources.tables import table
from . import fixtures as fx
from .oracle import EVIDENCE_CTE, REVIEW_LOG, SIGNAL, q, with_
from .q_candidates import DOC_CANDS, _truthy, case, doc_candidates, idc, lit, shape_sql
from .q_review import LEECH, LIMIT, NOW_R
from .q_vectors import CACHE_MODEL, cache_fixture
from .registry import register


@register(sql="""
SELECT sha1(text) AS text_hash, min(doc_id) AS keep_id, count(*) AS copies FROM documents GROUP BY 1""")
def q_exact_dedup(spark, sf):
    """Exact copies collapse to their first id (a map-side partial aggregate,
    so even a text copied a million times shuffles one row per partition)."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return d.groupBy(F.sha1("text").alias("text_hash")).agg(F.min("doc_id").alias("keep_id"),
                                                            F.count("*").alias("copies"))


_ARRIVALS = """
deliveries AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS message_id, conv_id * 10 + turn AS arrival, text
  FROM conversations WHERE role = 'user'
  UNION ALL
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), conv_id * 10 + turn + 1000, text
  FROM conversations WHERE role = 'user' AND conv_id % 3 = 0)"""


@register(sql=with_(_ARRIVALS) + """
SELECT message_id, min(arrival) AS arrival, count(*) AS deliveries FROM deliveries GROUP BY 1""")
def q_replay_dedup(spark, sf):
    """A message fetched again after a failed acknowledgement is applied once
    (first delivery wins; at-least-once fetch + de-dup = effectively once)."""
    c = table(spark, sf, "conversations").filter(F.col("role") == "user").select("conv_id", "turn", "text")
    mid = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    first = c.select(mid.alias("message_id"), (F.col("conv_id") * 10 + F.col("turn")).alias("arrival"))
    again = c.filter(F.col("conv_id") % 3 == 0).select(
        mid.alias("message_id"), (F.col("conv_id") * 10 + F.col("turn") + 1000).alias("arrival"))
    return first.unionByName(again).groupBy("message_id").agg(F.min("arrival").alias("arrival"),
                                                             F.count("*").alias("deliveries"))


@register(sql="""
WITH s AS (SELECT o_custkey AS subscriber_id, o_orderkey AS idea_id, CAST(epoch(o_orderdate) AS BIGINT) AS sent_utc
           FROM orders)
SELECT subscriber_id, idea_id, sent_utc FROM (
  SELECT *, max(sent_utc) OVER (PARTITION BY subscriber_id) AS last FROM s) WHERE sent_utc = last""")
def q_last_batch(spark, sf):
    """The ideas that went out together in each subscriber's newest digest."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    s = o.select(F.col("o_custkey").alias("subscriber_id"), F.col("o_orderkey").alias("idea_id"),
                 F.unix_timestamp("o_orderdate").alias("sent_utc"))
    w = Window.partitionBy("subscriber_id")
    return s.withColumn("last", F.max("sent_utc").over(w)).filter(F.col("sent_utc") == F.col("last")).drop("last")


@register(sql=f"""
WITH corpus AS (
  SELECT doc_id AS id, sha1({q(CACHE_MODEL)} || chr(10) || 'doc ' || CAST(doc_id AS VARCHAR) || chr(10) || left(text, 1200)) AS text_hash
  FROM documents),
cache AS (
  SELECT e.vec_id AS id,
         CASE WHEN e.vec_id % 4 = 2 THEN sha1('stale' || CAST(e.vec_id AS VARCHAR)) ELSE c.text_hash END AS text_hash,
         CASE WHEN e.vec_id % 4 = 3 THEN len(e.embedding) - 1 ELSE len(e.embedding) END AS width
  FROM embeddings e JOIN corpus c ON c.id = e.vec_id),
r AS (SELECT c.id, h.id IS NOT NULL AS reused FROM corpus c
      LEFT JOIN (SELECT DISTINCT id, text_hash FROM cache WHERE width = 64) h ON h.id = c.id AND h.text_hash = c.text_hash)
SELECT count(*) FILTER (WHERE reused) AS reused, count(*) FILTER (WHERE NOT reused) AS encoded FROM r""")
def q_cache_accounting(spark, sf):
    """Vectors reused from the cache vs newly encoded, observed by the job that writes the new cache."""
    corpus = fx.raw_signal(spark, sf).select("id", "title", "text")
    out = vx.embedding_cache(corpus, cache_fixture(spark, sf), CACHE_MODEL, dim=64)
    seen = Observation("cache")
    write_table(out.observe(seen, F.count_if("reused").alias("reused"), F.count_if(~F.col("reused")).alias("encoded")), "cache")
    return spark.createDataFrame([(seen.get["reused"], seen.get["encoded"])], "reused long, encoded long")


def _sent_ideas(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return o.filter(F.col("o_orderstatus") == "F").select(
        F.col("o_custkey").alias("subscriber_id"), F.col("o_orderkey").alias("idea_id"),
        F.unix_timestamp("o_orderdate").alias("sent_utc"),
        F.concat(F.lit("h"), (F.col("o_orderkey") % 17).cast("string")).alias("reply_id"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"))


SENT_SQL = """
sent AS (
  SELECT o_custkey AS subscriber_id, o_orderkey AS idea_id, CAST(epoch(o_orderdate) AS BIGINT) AS sent_utc,
         'h' || CAST(o_orderkey % 17 AS VARCHAR) AS reply_id, 'order ' || CAST(o_orderkey AS VARCHAR) AS title
  FROM orders WHERE o_orderstatus = 'F')"""


@register(sql=with_(SENT_SQL) + """
SELECT subscriber_id, reply_id, arg_max(idea_id, (sent_utc, idea_id)) AS idea_id FROM (
  SELECT *, row_number() OVER (PARTITION BY subscriber_id ORDER BY sent_utc DESC, idea_id DESC) AS rn FROM sent)
WHERE rn <= 12 GROUP BY 1, 2""")
def q_recent_handles(spark, sf):
    """Handle -> idea among each subscriber's twelve most recent sends."""
    return fb.recent_handles(_sent_ideas(spark, sf))


@register(sql=with_(SENT_SQL) + """,
firsts AS (SELECT subscriber_id, min(idea_id) AS first_idea FROM sent GROUP BY 1),
msgs AS (
  SELECT CAST(c.conv_id AS VARCHAR) || '-' || CAST(c.turn AS VARCHAR) AS message_id, c.conv_id + 1 AS subscriber_id,
         CASE c.turn % 3 WHEN 0 THEN 'Re: order ' || CAST(f.first_idea AS VARCHAR) WHEN 1 THEN 'Re: ideas — x'
              ELSE 'Re: something else' END AS subject
  FROM conversations c LEFT JOIN firsts f ON f.subscriber_id = c.conv_id + 1 WHERE c.role = 'user'),
m AS (SELECT message_id, subscriber_id, regexp_replace(regexp_replace(coalesce(subject, ''),
        '(?i)^\\s*((re|fwd?|aw|sv|antw)\\s*:\\s*)+', ''), '^\\s+|\\s+$', '', 'g') AS s FROM msgs),
bt AS (SELECT subscriber_id, title AS s, arg_max(idea_id, (sent_utc, idea_id)) AS title_idea FROM sent GROUP BY 1, 2),
newest AS (SELECT subscriber_id, max(sent_utc) AS last_sent FROM sent GROUP BY 1),
batch AS (SELECT s.subscriber_id, count(*) AS n_batch, min(s.idea_id) AS batch_idea
          FROM sent s JOIN newest n ON n.subscriber_id = s.subscriber_id AND s.sent_utc = n.last_sent GROUP BY 1)
SELECT m.message_id,
       coalesce(CASE WHEN m.s <> '' AND NOT starts_with(lower(m.s), 'ideas —') AND NOT starts_with(lower(m.s), 'ideas -')
                     THEN bt.title_idea END,
                CASE WHEN b.n_batch = 1 THEN b.batch_idea END) AS idea_id
FROM m LEFT JOIN bt ON bt.subscriber_id = m.subscriber_id AND bt.s = m.s
LEFT JOIN batch b ON b.subscriber_id = m.subscriber_id""")
def q_verdict_routing(spark, sf):
    """Route a verdict that names no idea: exact title of a sent idea, else
    the only idea of the newest digest, else nowhere."""
    sent = _sent_ideas(spark, sf)
    firsts = sent.groupBy("subscriber_id").agg(F.min("idea_id").alias("first_idea"))
    c = table(spark, sf, "conversations").filter(F.col("role") == "user").select("conv_id", "turn")
    c = c.withColumn("subscriber_id", F.col("conv_id") + 1).join(firsts, "subscriber_id", "left")
    subject = (F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Re: order "), F.col("first_idea").cast("string")))
               .when(F.col("turn") % 3 == 1, F.lit("Re: ideas — x")).otherwise(F.lit("Re: something else")))
    msgs = c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("message_id"),
                    "subscriber_id", subject.alias("subject"))
    return fb.route_bare_verdict(msgs, sent.select("subscriber_id", "idea_id", "title", "sent_utc"))


DECK_CARDS = [(d, f"c{i}") for d in ("d0", "d1") for i in range(9)]   # c9 was retired from both decks
_DECK_SQL = ", ".join(f"({q(d)}, {q(c)})" for d, c in DECK_CARDS)


@register(sql=with_(REVIEW_LOG) + f""",
due AS (SELECT *, md5('cairn' || '|' || CAST(learner_id AS VARCHAR) || '|' || deck || '|' || card_id) AS rnd
        FROM rev WHERE due_utc <= {NOW_R} AND fails < {LEECH}),
wk AS (SELECT *, CASE WHEN fails > 0 THEN row_number() OVER (PARTITION BY learner_id, deck, fails > 0
                                                             ORDER BY fails DESC, due_utc, rnd) END AS weak_rank FROM due),
t AS (SELECT *, CASE WHEN weak_rank <= {max(1, LIMIT // 3)} THEN 0 ELSE 1 END AS tier FROM wk),
t2 AS (SELECT *, sum(1 - tier) OVER (PARTITION BY learner_id, deck) AS n_weak,
              row_number() OVER (PARTITION BY learner_id, deck, tier ORDER BY due_utc, last_utc NULLS FIRST, rnd) AS rest_rank
       FROM t),
picked AS (SELECT * FROM t2 WHERE tier = 0 OR rest_rank <= {LIMIT} - n_weak),
cards AS (SELECT * FROM (VALUES {_DECK_SQL}) v(deck, card_id))
SELECT p.learner_id, p.deck, p.card_id FROM picked p JOIN cards c USING (deck, card_id)""")
def q_today_cards(spark, sf):
    """Due cards joined to the deck's card table (broadcast: a deck is a
    small, fixed dimension); review rows whose card left the deck drop out."""
    due = rv.due_cards(fx.review_state(spark, sf), NOW_R, LIMIT, leech_at=LEECH)
    cards = spark.createDataFrame(DECK_CARDS, "deck string, card_id string")
    return due.join(bounded_broadcast(cards), ["deck", "card_id"]).select("learner_id", "deck", "card_id")


JUDGE_FULL = case([(idc(4, 0), lit('{"verdict": "ship", "reason": "clear", "prior_art_note": "two tools", '
                                   '"closest_existing": "toolx", "revised_first_weekend": "smaller", "feasibility": "weekend"}')),
                   (idc(4, 1), lit('{"verdict": "reframe", "reason": "inflated", "reframe": "narrower", '
                                   '"prior_art_note": "", "feasibility": "month"}')),
                   (idc(4, 2), lit('{"verdict": "kill", "reason": "exists"}'))],
                  lit('{"reason": ""}'))


@register(sql=with_(DOC_CANDS) + f""",
j AS (SELECT id, CAST(body AS JSON) AS b, CAST({JUDGE_FULL.sql} AS JSON) AS r FROM dcands)
SELECT id AS candidate_id,
  CASE WHEN coalesce(json_extract_string(r, '$.prior_art_note'), '') <> '' THEN json_extract_string(r, '$.prior_art_note')
       ELSE json_extract_string(b, '$.prior_art') END AS prior_art,
  CASE WHEN coalesce(json_extract_string(r, '$.closest_existing'), '') <> '' THEN json_extract_string(r, '$.closest_existing')
       ELSE json_extract_string(b, '$.closest_existing') END AS closest_existing,
  CASE WHEN coalesce(json_extract_string(r, '$.revised_first_weekend'), '') <> '' THEN json_extract_string(r, '$.revised_first_weekend')
       ELSE json_extract_string(b, '$.first_weekend') END AS first_weekend,
  coalesce(json_extract_string(r, '$.feasibility'), '') AS feasibility,
  array_to_string(list_filter([
      CASE WHEN coalesce(json_extract_string(r, '$.reason'), '') <> '' THEN json_extract_string(r, '$.reason') END,
      CASE WHEN coalesce(json_extract_string(r, '$.reframe'), '') <> '' THEN 'Sharper version: ' || json_extract_string(r, '$.reframe') END,
      CASE WHEN coalesce(json_extract_string(r, '$.prior_art_note'), '') <> '' THEN 'Prior art: ' || json_extract_string(r, '$.prior_art_note') END,
      CASE WHEN coalesce(json_extract_string(r, '$.feasibility'), '') <> '' THEN 'Scope reads as: ' || json_extract_string(r, '$.feasibility') END],
    lambda x: x IS NOT NULL), chr(10) || chr(10)) AS critique
FROM j""")
def q_judgement_fold(spark, sf):
    """K3 + K4: fold a judgement into the candidate record and render the critique."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "lang")
    from .q_candidates import BODY_DOC
    x = d.select("id", F.parse_json(BODY_DOC.col).alias("b"), F.parse_json(JUDGE_FULL.col).alias("r"))
    a = cd.apply_judgement(F.col("b"), F.col("r"))
    return x.select(F.col("id").alias("candidate_id"), a["prior_art"].alias("prior_art"),
                    a["closest_existing"].alias("closest_existing"), a["first_weekend"].alias("first_weekend"),
                    a["feasibility"].alias("feasibility"), cd.critique(F.col("r")).alias("critique"))


PLAINLY = case([(idc(3, 0), lit('{"in_plain_terms": "plain again", "glossary": [{"term": "a", "means": "x"}, '
                                '{"term": "b", "means": "y"}, {"term": "c", "means": "z"}]}'))],
               lit('{"glossary": [{"term": "a", "means": "x"}]}'))


@register(sql=with_(DOC_CANDS) + f""",
j AS (SELECT id, body, json_merge_patch(CAST(body AS JSON), CAST({PLAINLY.sql} AS JSON)) AS merged FROM dcands),
n AS (SELECT id, NOT ({_truthy("json_extract(CAST(body AS JSON), '$.in_plain_terms')")}
                      AND {_truthy("json_extract(CAST(body AS JSON), '$.glossary')")}) AS needs, merged FROM j)
SELECT id AS candidate_id, needs, {shape_sql('merged')} IS NULL AS ok_after,
       coalesce({shape_sql('merged')}, 'well formed') AS reason_after
FROM n WHERE needs""")
def q_needs_backfill(spark, sf):
    """Queued ideas missing the plain-language pass, merged with the backfill
    response (only its plain-language fields) and re-checked by the same shape gate."""
    c = doc_candidates(spark, sf)
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    p = d.select("id", F.parse_json(PLAINLY.col).alias("added"))
    x = c.join(p, "id").filter(cd.needs_backfill(F.col("body")))
    s = cd.shape_check(F.col("body"), F.col("added"))
    return x.select(F.col("id").alias("candidate_id"), F.lit(True).alias("needs"), s["ok"].alias("ok_after"),
                    s["reason"].alias("reason_after"))


_DELIM = "(?i)</?\\s*(evidence|instructions?|system|assistant|human)\\s*>"


def _flat_sql(x, limit):
    return f"left(regexp_replace(regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), {q(_DELIM)}, '', 'g'), {limit})"


@register(sql=f"""
SELECT conv_id, turn,
       '- `' || role || '` — ' || {_flat_sql("split_part(text, chr(10), 1)", 120)}
       || CASE WHEN text <> '' AND text <> role THEN ' · ' || {_flat_sql('text', 200)} ELSE '' END AS line
FROM conversations""")
def q_observation_log(spark, sf):
    """One sanitised observation line per verdict (here: per conversation turn,
    role as the verdict): whitespace flattened, prompt delimiters stripped, title
    cut to 120 and note to 200 characters."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    title = tx.flatten(F.substring_index("text", "\n", 1), 120)
    note = F.when((F.col("text") != "") & (F.col("text") != F.col("role")),
                  F.concat(F.lit(" · "), tx.flatten(F.col("text"), 200))).otherwise(F.lit(""))
    return c.select("conv_id", "turn", F.concat(F.lit("- `"), F.col("role"), F.lit("` — "), title, note).alias("line"))


REBUILD_DISTANCE = 0.2
REBUILD_MODEL = "hashing-1024"


@register
def q_theme_rebuild(spark, sf):
    """H4 end to end: gated corpus -> hashing embeddings through the vector cache -> exact similarity edges ->
    average-linkage clusters -> themes (size >= 2) with evidence, domain, weight,
    key and TF-IDF label. No SQL form (the encoder and the linkage are not SQL);
    each stage is oracle- or brute-force-checked on its own."""
    sig = fx.signal(spark, sf)
    corpus = sig.select("id", "title", "text")
    empty = spark.createDataFrame([], "id long, text_hash string, vec array<float>")
    # an earlier build left the vectors of every second signal; the others are encoded now
    cache = vx.embedding_cache(corpus.filter("id % 2 = 0"), empty, REBUILD_MODEL, dim=1024)
    cache = materialize(cache.drop("reused"), "vector_cache")
    v = materialize(vx.embedding_cache(corpus, cache, REBUILD_MODEL, dim=1024).select("id", "vec"), "signal_vec")
    lab = cl.average_linkage(v, REBUILD_DISTANCE)
    mem = lab.select(F.col("cluster").cast("string").alias("theme"), "id")
    th = materialize(ev.build_themes(mem, sig, NOW), "themes")   # read twice below
    mt = mem.join(sig.select("id", "title", "text"), "id").select(
        "theme", "id", tx.embed_text(F.col("title"), F.col("text")).alias("text"))
    labels = ev.tfidf_labels(mt)   # over all clusters, single ones too: they count in N and df
    return th.join(labels, "theme", "left").select("theme_key", "size", F.round("evidence", 6).alias("evidence"),
                                                   "domain", F.round("weight", 6).alias("weight"), "label")

def _snapshot_of(spark, sf):
    """The second of two published builds: first over every second member, then over all."""
    from ..operators import snapshots
    from ..session import checkpoint_dir
    sig = fx.signal(spark, sf)
    base = f"{checkpoint_dir(spark).rstrip('/')}/themes-{uuid.uuid4().hex}"
    for mem in (fx.members(spark, sf, sig).filter("id % 2 = 0"), fx.members(spark, sf, sig)):
        mem = materialize(mem, "members")
        snapshots.publish(spark, base, {"themes": ev.build_themes(mem, sig, NOW), "members": mem})
    return snapshots.current(spark, base)


@register(sql=with_(SIGNAL, EVIDENCE_CTE) + """
SELECT k.theme_key, m.id FROM mrows m JOIN tkeys k USING (theme) WHERE k.size >= 2""")
def q_theme_members(spark, sf):
    """H4: the members published with the themes, read from the newest snapshot."""
    from ..operators import snapshots
    folder = _snapshot_of(spark, sf)
    themes = snapshots.table_of(spark, folder, "themes").select("theme", "theme_key")
    return snapshots.table_of(spark, folder, "members").join(themes, "theme").select("theme_key", "id")


EMBED_DIM = 32


def _md5_bucket(dim):
    return lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dim


@register(sql=f"""
WITH t AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM documents),
b AS (SELECT id, CAST('0x' || left(md5(w), 8) AS BIGINT) % {EMBED_DIM} AS b, count(*) AS n FROM t GROUP BY 1, 2),
s AS (SELECT id, sqrt(sum(n * n)) AS norm FROM b GROUP BY 1)
SELECT d.doc_id AS id, i.i AS place,
       round(CAST(CAST(coalesce(b.n / s.norm, 0) AS FLOAT) AS DOUBLE), 5) AS value
FROM documents d CROSS JOIN range({EMBED_DIM}) i(i) LEFT JOIN b ON b.id = d.doc_id AND b.b = i.i LEFT JOIN s ON s.id = d.doc_id""")
def q_embedding_values(spark, sf):
    """H1: every component of every document's vector (buckets by md5, which SQL has too)."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    v = vx.hashing_encoder(d, "text", EMBED_DIM, bucket=_md5_bucket(EMBED_DIM))
    return v.select("id", F.posexplode("vec").alias("place", "value")).select(
        "id", F.col("place").cast("long").alias("place"), F.round(F.col("value").cast("double"), 5).alias("value"))

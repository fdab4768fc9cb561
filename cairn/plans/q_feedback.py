"""Registered queries for reply parsing and feedback folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import replies as rp
from . import fixtures as fx
from .oracle import REPLIES, q, with_
from .q_text import STRIPPED_SQL
from .registry import register

# Fixture vocabularies drawn from corpus tokens (the real card ids and verdict
# words never occur in the invented prose).
CARDS = ["the", "tion", "thon"]
GRADE_VOCAB = {"is": "good", "on": "again", "of": "hard"}
IDEAS = ["and", "that"]
VERDICT_VOCAB = {"was": "more", "for": "boring", "with": "exists"}


def _parsed(spark, sf):
    return rp.parse_replies(fx.replies(spark, sf), CARDS, IDEAS, GRADE_VOCAB, VERDICT_VOCAB)


def _inlist(xs):
    return "(" + ", ".join(q(x) for x in xs) + ")"


def _case_map(col, m):
    return "CASE " + " ".join(f"WHEN {col} = {q(k)} THEN {q(v)}" for k, v in m.items()) + " END"


def _own(t):
    from ..functions.text import OUR_TEXT
    return "(" + " + ".join(f"CAST(strpos(lower({t}), {q(p)}) > 0 AS INTEGER)" for p in OUR_TEXT) + ") >= 2"


REPLY_CTE = STRIPPED_SQL + f""",
msgs AS (SELECT message_id, text, {_own('text')} AS own FROM stripped),
rl AS (SELECT message_id, string_split(lower(text), chr(10)) AS l FROM msgs WHERE NOT own AND text <> ''),
lines0 AS (SELECT message_id, unnest(l) AS line, generate_subscripts(l, 1) AS ln FROM rl),
lines AS (SELECT message_id, ln, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM lines0
          WHERE regexp_replace(line, '^\\s+|\\s+$', '', 'g') <> ''),
tl AS (SELECT message_id, ln, string_split_regex(line, '[^a-z0-9-]+') AS tk FROM lines),
toks AS (SELECT message_id, ln, unnest(tk) AS tok, generate_subscripts(tk, 1) AS p FROM tl),
ct AS (SELECT message_id, ln, p, tok AS term, lead(p) OVER (PARTITION BY message_id, ln ORDER BY p) AS np
       FROM toks WHERE tok IN {_inlist(CARDS)}),
gb AS (SELECT c.message_id, c.ln, c.p, c.term, arg_min(t.tok, t.p) AS word
       FROM ct c JOIN toks t ON t.message_id = c.message_id AND t.ln = c.ln AND t.p > c.p
                             AND (c.np IS NULL OR t.p < c.np) AND t.tok IN {_inlist(GRADE_VOCAB)}
       GROUP BY 1, 2, 3, 4),
glines AS (SELECT DISTINCT message_id, ln FROM gb),
it AS (SELECT t.message_id, t.ln, t.p, t.tok AS term, lead(t.p) OVER (PARTITION BY t.message_id, t.ln ORDER BY t.p) AS np
       FROM toks t WHERE t.tok IN {_inlist(IDEAS)}
         AND NOT EXISTS (SELECT 1 FROM glines g WHERE g.message_id = t.message_id AND g.ln = t.ln)),
vb AS (SELECT c.message_id, c.ln, c.p, c.term, arg_min(t.tok, t.p) AS word
       FROM it c JOIN toks t ON t.message_id = c.message_id AND t.ln = c.ln AND t.p > c.p
                             AND (c.np IS NULL OR t.p < c.np) AND t.tok IN {_inlist(VERDICT_VOCAB)}
       GROUP BY 1, 2, 3, 4),
vlines AS (SELECT DISTINCT message_id, ln FROM vb),
binds AS (
  SELECT message_id, 'grade' AS kind, ln, p, term, {_case_map('word', GRADE_VOCAB)} AS value FROM gb
  UNION ALL
  SELECT message_id, 'verdict' AS kind, ln, p, term, {_case_map('word', VERDICT_VOCAB)} AS value FROM vb),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY message_id, kind, term ORDER BY ln, p) AS r
           FROM binds) WHERE r = 1),
plain AS (
  SELECT l.message_id, string_agg(l.line, chr(10) ORDER BY l.ln) AS plain FROM lines l
  WHERE NOT EXISTS (SELECT 1 FROM glines g WHERE g.message_id = l.message_id AND g.ln = l.ln)
    AND NOT EXISTS (SELECT 1 FROM vlines v WHERE v.message_id = l.message_id AND v.ln = l.ln)
  GROUP BY 1)"""


def _has(col, word):
    return f"regexp_matches({col}, {q('(^|[^a-z0-9-])' + word + '([^a-z0-9-]|$)')})"


@register(sql=with_(REPLIES, REPLY_CTE) + " SELECT message_id, kind, term, value FROM firsts")
def q_reply_bind(spark, sf):
    return _parsed(spark, sf)[0]


_bare = "CASE " + " ".join(f"WHEN {_has('p.plain', w)} THEN {q(VERDICT_VOCAB[w])}"
                           for w in rp.longest_first(VERDICT_VOCAB)) + " END"
_ctrl = "CASE " + " ".join(f"WHEN {_has('lower(m.text)', w)} THEN {q(a)}" for w, a in rp.CONTROL) + " END"


@register(sql=with_(REPLIES, REPLY_CTE) + f"""
SELECT m.message_id, m.own AS unparsed, CASE WHEN NOT m.own THEN {_bare} END AS bare_verdict,
       CASE WHEN NOT m.own AND m.text <> '' THEN {_ctrl} END AS control,
       CASE WHEN NOT m.own THEN CAST(nullif(regexp_extract(m.text, '(?i)\\b(\\d{{1,3}})\\s*(?:m|min|mins|minutes)\\b', 1), '') AS INTEGER) END AS minutes,
       CASE WHEN m.own THEN '(quote-stripping failed; reply not parsed)' ELSE left(m.text, 500) END AS note
FROM msgs m LEFT JOIN plain p USING (message_id)""")
def q_reply_parse(spark, sf):
    return _parsed(spark, sf)[1]


# ---- verdict folds over the events-as-replies log ----
from .. import NOW  # noqa: E402
from ..operators import feedback as fb  # noqa: E402
from ..sources.tables import table  # noqa: E402
from .oracle import SIGNAL, VERDICT_LOG  # noqa: E402


@register(sql=with_(VERDICT_LOG) + """
SELECT idea_id, arg_min(verdict, (ts, message_id)) AS verdict, min(ts) AS ts,
       arg_min(message_id, (ts, message_id)) AS message_id
FROM vlog GROUP BY idea_id""")
def q_first_verdict(spark, sf):
    return fb.first_verdict(fx.verdict_log(spark, sf))


_steps = "CASE verdict " + " ".join(f"WHEN {q(k)} THEN CAST({v} AS DOUBLE)" for k, v in fb.WEIGHT_STEP.items()) + " END"


@register(sql=with_(SIGNAL, VERDICT_LOG) + f""",
fv AS (SELECT idea_id, arg_min(verdict, (ts, message_id)) AS verdict, min(ts) AS ts,
              arg_min(message_id, (ts, message_id)) AS seq FROM vlog GROUP BY idea_id),
isig AS (SELECT id % 7 AS idea_id, id FROM used UNION ALL SELECT 7 + id % 11 AS idea_id, id FROM used),
steps AS (SELECT s.id, fv.ts, fv.seq, {_steps} AS factor FROM fv JOIN isig s USING (idea_id)),
folded AS (
  SELECT id, list_reduce(list(factor ORDER BY ts, seq), lambda w, f: greatest(CAST(0.1 AS DOUBLE), least(CAST(4.0 AS DOUBLE), w * f)), CAST(1.0 AS DOUBLE)) AS weight,
         count(*) AS n_steps
  FROM steps WHERE factor IS NOT NULL GROUP BY id)
SELECT id, round(weight, 6) AS weight, CAST(n_steps AS INTEGER) AS n_steps FROM folded""")
def q_weight_fold(spark, sf):
    sig = fx.signal(spark, sf)
    fv = fb.first_verdict(fx.verdict_log(spark, sf)).select("idea_id", "verdict", "ts", F.col("message_id").alias("seq"))
    out = fb.weight_fold(fv, fx.idea_signal(sig))
    return out.select("id", F.round("weight", 6).alias("weight"), "n_steps")


@register(sql="""
WITH c AS (
  SELECT user_id AS subscriber_id, CASE event_type WHEN 'signup' THEN 'resume' WHEN 'error' THEN 'pause' END AS action,
         CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id AS seq FROM events)
SELECT subscriber_id, arg_max(action, (ts, seq)) AS action, arg_max(action, (ts, seq)) = 'pause' AS paused
FROM c WHERE action IS NOT NULL GROUP BY 1""")
def q_pause_state(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    c = ev.select(F.col("user_id").alias("subscriber_id"),
                  F.when(F.col("event_type") == "signup", "resume").when(F.col("event_type") == "error", "pause").alias("action"),
                  F.unix_timestamp("ts").alias("ts"), F.col("event_id").alias("seq")).filter(F.col("action").isNotNull())
    st = fb.latest_control(c)
    return st.select("subscriber_id", "action", (F.col("action") == "pause").alias("paused"))


@register(sql="""
WITH latest AS (SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1)
SELECT c.c_custkey AS key, coalesce(l.value, -1.0) AS value
FROM customer c LEFT JOIN latest l ON l.user_id = c.c_custkey""")
def q_latest_value(spark, sf):
    """Latest value per key (append log + max_by), defaults for keys never set."""
    ev = table(spark, sf, "events").select("user_id", "value", "ts", "event_id")
    latest = ev.groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    keys = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    return keys.join(latest.withColumnRenamed("user_id", "key"), "key", "left").select(
        "key", F.coalesce("value", F.lit(-1.0)).alias("value"))


def _sent(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    return o.select(F.col("o_custkey").alias("subscriber_id"), F.col("o_orderkey").alias("idea_id"),
                    F.unix_timestamp("o_orderdate").alias("sent_utc"), F.col("o_orderpriority").alias("domain"),
                    (F.col("o_orderstatus") == "F").alias("answered"))


@register(sql=f"""
WITH sent AS (
  SELECT o_custkey AS subscriber_id, o_orderkey AS idea_id, CAST(epoch(o_orderdate) AS BIGINT) AS sent_utc,
         o_orderpriority AS domain, o_orderstatus = 'F' AS answered FROM orders),
lr AS (SELECT subscriber_id, max(sent_utc + 2 * 86400) AS last_reply_utc FROM sent WHERE answered GROUP BY 1),
fired AS (SELECT DISTINCT subscriber_id, CASE WHEN subscriber_id % 10 = 0 THEN {NOW} - 3 * 86400
                                             ELSE {NOW} - 30 * 86400 END AS fired_utc
          FROM sent WHERE subscriber_id % 5 = 0),
base AS (
  SELECT f.subscriber_id, coalesce(lr.last_reply_utc, 0) AS last, fi.fired_utc,
         CASE WHEN coalesce(lr.last_reply_utc, 0) <> 0 THEN lr.last_reply_utc ELSE coalesce(f.first_sent, {NOW}) END AS since
  FROM (SELECT subscriber_id, min(sent_utc) AS first_sent FROM sent GROUP BY 1) f
  LEFT JOIN lr USING (subscriber_id) LEFT JOIN fired fi USING (subscriber_id)),
op AS (SELECT s.* FROM sent s JOIN base b USING (subscriber_id) WHERE NOT s.answered AND s.sent_utc >= b.since),
n AS (SELECT subscriber_id, count(*) AS n FROM op GROUP BY 1),
pd AS (SELECT subscriber_id, domain, count(*) AS n FROM op WHERE domain IS NOT NULL GROUP BY 1, 2),
top AS (SELECT subscriber_id, string_agg(domain || ' x' || CAST(n AS VARCHAR), ', ' ORDER BY r) AS breakdown
        FROM (SELECT *, row_number() OVER (PARTITION BY subscriber_id ORDER BY n DESC, domain) AS r FROM pd)
        WHERE r <= 3 GROUP BY 1)
SELECT b.subscriber_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_unanswered,
       CAST(floor(({NOW} - b.since) / 86400.0) AS BIGINT) AS quiet_days,
       coalesce(n.n, 0) >= 4 AND ({NOW} - b.since) / 86400.0 >= 14
         AND NOT (coalesce(b.fired_utc, 0) > b.last AND ({NOW} - coalesce(b.fired_utc, 0)) < 14 * 86400) AS fires,
       coalesce(t.breakdown, '') AS breakdown
FROM base b LEFT JOIN n USING (subscriber_id) LEFT JOIN top t USING (subscriber_id)""")
def q_silence_canary(spark, sf):
    sent = _sent(spark, sf)
    lr = (sent.filter("answered").groupBy("subscriber_id")
          .agg(F.max(F.col("sent_utc") + 2 * 86400).alias("last_reply_utc")))
    fired = (sent.select("subscriber_id").distinct().filter(F.col("subscriber_id") % 5 == 0)
             .select("subscriber_id", F.when(F.col("subscriber_id") % 10 == 0, F.lit(NOW - 3 * 86400))
                     .otherwise(F.lit(NOW - 30 * 86400)).cast("long").alias("fired_utc")))
    return fb.silence_canary(sent, lr, fired, NOW)


_SUB = "CAST(split_part(t.message_id, '-', 1) AS BIGINT) % 150"
SCOPED_CTE = REPLY_CTE.replace(
    f"FROM toks t WHERE t.tok IN {_inlist(IDEAS)}",
    f"FROM toks t WHERE {_SUB} % 5 <> 0 AND (t.tok = 'that' OR (t.tok = 'and' AND {_SUB} % 2 = 0))")


@register(sql=with_(REPLIES, SCOPED_CTE) + f""",
mm AS (SELECT message_id, conv_id % 150 AS subscriber_id FROM replies),
hd AS (SELECT s.subscriber_id, h.term AS reply_id, s.subscriber_id * 10 + h.i AS idea_id
       FROM (SELECT DISTINCT subscriber_id FROM mm) s, (VALUES ('and', 1), ('that', 2)) h(term, i)),
bare AS (
  SELECT m.message_id, CASE WHEN NOT m.own THEN {_bare} END AS v FROM msgs m LEFT JOIN plain p USING (message_id))
SELECT f.message_id, h.idea_id, f.value AS verdict, false AS bare
FROM firsts f JOIN mm USING (message_id) JOIN hd h ON h.subscriber_id = mm.subscriber_id AND h.reply_id = f.term
WHERE f.kind = 'verdict'
UNION ALL
SELECT message_id, CASE WHEN CAST(split_part(message_id, '-', 2) AS INTEGER) % 2 = 0 THEN 7 END, v, true
FROM bare WHERE v IS NOT NULL""")
def q_reply_apply(spark, sf):
    """J4 verdict log: named verdicts resolved through each subscriber's handles,
    bare verdicts routed (here: even turns route to idea 7, odd ones are ambiguous). A handle that is another
    subscriber's binds nothing."""
    return _applied(spark, sf)[1].select("message_id", "idea_id", "verdict", "bare")


def _reply_messages(r):
    return r.select("message_id", (F.col("conv_id") % 150).alias("subscriber_id"),
                    (F.col("conv_id") * 3600 + F.col("turn")).alias("ts"))


def _own_handles(r):
    """Handles of each subscriber: every fifth has none, odd ones have one of the two."""
    return r.select("subscriber_id").distinct().filter("subscriber_id % 5 <> 0").select(
        "subscriber_id", F.explode(F.when(F.col("subscriber_id") % 2 == 0, F.array(F.lit(" And"), F.lit("that")))
                                   .otherwise(F.array(F.lit("that"), F.lit("")))).alias("reply_id"))


def _applied(spark, sf):
    r = fx.replies(spark, sf).withColumn("subscriber_id", F.col("conv_id") % 150)
    msgs = _reply_messages(r).drop("ts")
    handles = _own_handles(r).select(
        "subscriber_id", F.lower(F.trim("reply_id")).alias("reply_id"),
        (F.col("subscriber_id") * 10 + F.when(F.lower(F.trim("reply_id")) == "and", 1).otherwise(2)).alias("idea_id")).filter("reply_id <> ''")
    b, s = rp.parse_replies(r, CARDS, handles.select("subscriber_id", "reply_id"), GRADE_VOCAB, VERDICT_VOCAB)
    routed = r.select("message_id", F.when(F.col("turn") % 2 == 0, F.lit(7).cast("long")).alias("idea_id"))
    return rp.apply_replies(b, s, msgs, handles, routed)


@register(sql=with_(REPLIES, SCOPED_CTE) + """
SELECT f.message_id, f.term AS card_id, f.value AS grade FROM firsts f JOIN msgs m USING (message_id)
WHERE f.kind = 'grade' AND f.value <> 'skip' AND NOT m.own""")
def q_reply_grades(spark, sf):
    """J4 review log: the grades of all replies that were not refused."""
    return _applied(spark, sf)[0]


@register(sql=with_(REPLIES, SCOPED_CTE) + f"""
SELECT CAST(split_part(m.message_id, '-', 1) AS BIGINT) % 150 AS subscriber_id, {_ctrl} AS action, m.message_id
FROM msgs m WHERE NOT m.own AND m.text <> '' AND {_ctrl} IS NOT NULL""")
def q_reply_controls(spark, sf):
    """J4 control log: pause and resume words per subscriber."""
    return _applied(spark, sf)[2]


@register(sql="""
SELECT conv_id % 150 AS subscriber_id, max(conv_id * 3600 + turn) AS last_reply_utc, count(*) AS n_replies
FROM conversations WHERE role = 'user' GROUP BY 1""")
def q_reply_liveness(spark, sf):
    """J4 liveness: every reply, refused or not, resets its subscriber's silence."""
    return rp.liveness(_reply_messages(fx.replies(spark, sf)))


@register(sql=with_(REPLIES, SCOPED_CTE) + f"""
SELECT message_id, kind, term, value FROM firsts
UNION ALL
SELECT m.message_id, 'bare', NULL, {_bare} FROM msgs m JOIN plain p USING (message_id)
WHERE NOT m.own AND {_bare} IS NOT NULL""")
def q_reply_scoped(spark, sf):
    """Replies bound to their own subscriber's handles (every fifth subscriber has none, odd
    ones have only one of the two); another's handle leaves its line plain, so the line still
    gives its bare verdict."""
    r = fx.replies(spark, sf).withColumn("subscriber_id", F.col("conv_id") % 150)
    b, s = rp.parse_replies(r, CARDS, _own_handles(r), GRADE_VOCAB, VERDICT_VOCAB)
    bare = s.filter(F.col("bare_verdict").isNotNull()).select(
        "message_id", F.lit("bare").alias("kind"), F.lit(None).cast("string").alias("term"), F.col("bare_verdict").alias("value"))
    return b.unionByName(bare)

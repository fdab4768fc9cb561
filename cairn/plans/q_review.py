"""Registered queries for review / prep (E6, F4-F8, I1, D4) and digest assembly
(F9, F10, I8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import digest as dg
from ..operators import review as rv
from ..operators.util import materialize
from ..sources.tables import table
from . import fixtures as fx
from .oracle import REVIEW_LOG, q, with_
from .registry import register

NOW_R = fx.REVIEW_NOW
LEECH = 4   # the fixture has at most six failures per card
LIMIT = 6


@register(sql=with_(REVIEW_LOG) + """
SELECT learner_id, deck, card_id, count(*) AS reps, count(*) FILTER (WHERE rating = 1) AS fails,
       max(review_utc) AS last_utc
FROM rlog GROUP BY 1, 2, 3""")
def q_review_counts(spark, sf):
    lg = fx.review_log(spark, sf)
    return lg.groupBy("learner_id", "deck", "card_id").agg(
        F.count("*").alias("reps"), F.count_if(F.col("rating") == 1).alias("fails"),
        F.max("review_utc").alias("last_utc"))


@register(sql=with_(REVIEW_LOG) + f""",
due AS (SELECT *, md5('cairn' || '|' || CAST(learner_id AS VARCHAR) || '|' || deck || '|' || card_id) AS rnd
        FROM rev WHERE due_utc <= {NOW_R} AND fails < {LEECH}),
wk AS (SELECT *, CASE WHEN fails > 0 THEN row_number() OVER (PARTITION BY learner_id, deck, fails > 0
                                                             ORDER BY fails DESC, due_utc, rnd) END AS weak_rank FROM due),
t AS (SELECT *, CASE WHEN weak_rank <= {max(1, LIMIT // 3)} THEN 0 ELSE 1 END AS tier FROM wk),
t2 AS (SELECT *, sum(1 - tier) OVER (PARTITION BY learner_id, deck) AS n_weak,
              row_number() OVER (PARTITION BY learner_id, deck, tier ORDER BY due_utc, last_utc NULLS FIRST, rnd) AS rest_rank
       FROM t)
SELECT learner_id, deck, card_id, fails, due_utc,
       CAST(CASE WHEN tier = 0 THEN weak_rank ELSE n_weak + rest_rank END AS BIGINT) AS slot
FROM t2 WHERE tier = 0 OR rest_rank <= {LIMIT} - n_weak""")
def q_due_cards(spark, sf):
    out = rv.due_cards(fx.review_state(spark, sf), NOW_R, LIMIT, leech_at=LEECH)
    return out.select("learner_id", "deck", "card_id", "fails", "due_utc", F.col("slot").cast("long").alias("slot"))


@register(sql=with_(REVIEW_LOG) + f" SELECT learner_id, deck, card_id, fails FROM rev WHERE fails >= {LEECH}")
def q_leeches(spark, sf):
    return rv.leeches(fx.review_state(spark, sf), LEECH).select("learner_id", "deck", "card_id", "fails")


@register(sql=with_(REVIEW_LOG) + f"""
SELECT learner_id, deck, count(*) AS total, count(*) FILTER (WHERE due_utc <= {NOW_R}) AS due,
       CAST(coalesce(sum(reps), 0) AS BIGINT) AS reps, CAST(coalesce(sum(lapses), 0) AS BIGINT) AS lapses,
       CAST(coalesce(sum(fails), 0) AS BIGINT) AS fails
FROM rev GROUP BY 1, 2""")
def q_review_stats(spark, sf):
    st = rv.review_stats(fx.review_state(spark, sf), NOW_R)
    return st.select("learner_id", "deck", "total", "due", *[F.col(c).cast("long").alias(c) for c in ("reps", "lapses", "fails")])


# 52 bits of the key's hash as u, then the race of the draw
_RACE = """-ln((CAST(('0x' || substr(md5('cairn|' || CAST(learner_id AS VARCHAR) || '|' || deck || '|' || card_id), 1, 13))::BIGINT
           AS DOUBLE) + 1.0) / (CAST(4503599627370496 AS DOUBLE) + 1.0)) / (1.0 + fails)"""
_DRAW3 = f"""
drawn AS (SELECT learner_id, deck, card_id, fails, CAST(row_number() OVER (
            PARTITION BY learner_id ORDER BY {_RACE}, deck, card_id) AS INTEGER) AS draw FROM rev)"""


@register(sql=with_(REVIEW_LOG, _DRAW3) + " SELECT * FROM drawn WHERE draw <= 3")
def q_weighted_draw(spark, sf):
    """three weakness-weighted picks per learner (the distribution is checked in
    tests)."""
    return rv.weighted_draw(fx.review_state(spark, sf), 3).select("learner_id", "deck", "card_id", "fails", "draw")


def card_problems(spark, sf):
    """Problems per card: part names, card = 'c' + partkey % 10."""
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    return p.select(F.concat(F.lit("c"), (F.col("p_partkey") % 10).cast("string")).alias("card_id"),
                    F.col("p_name").alias("problem")).distinct()


@register(sql=with_(REVIEW_LOG, _DRAW3) + """,
cp AS (SELECT DISTINCT 'c' || CAST(p_partkey % 10 AS VARCHAR) AS card_id, p_name AS problem FROM part),
x AS (SELECT DISTINCT d.learner_id, d.card_id, cp.problem,
             CAST('0x' || substr(md5('given|' || CAST(d.learner_id AS VARCHAR) || '|' || cp.problem), 1, 4) AS BIGINT) % 3 <> 0 AS fresh
      FROM drawn d JOIN cp USING (card_id) WHERE d.draw <= 3),
y AS (SELECT *, bool_or(fresh) OVER (PARTITION BY learner_id, card_id) AS any_fresh FROM x)
SELECT learner_id, card_id, problem FROM (
  SELECT *, row_number() OVER (PARTITION BY learner_id, card_id ORDER BY
      md5('cairn|' || CAST(learner_id AS VARCHAR) || '|' || card_id || '|' || problem), problem) AS r
  FROM y WHERE fresh OR NOT any_fresh) WHERE r = 1""")
def q_problem_rotation(spark, sf):
    """F7 over the weighted picks: each learner gets one problem of each picked card,
    preferring problems not given before. The given log: about a third of each
    picked card's problems (chosen by hash) were handed out earlier."""
    picks = rv.weighted_draw(fx.review_state(spark, sf), 3)
    cp = card_problems(spark, sf)
    given = (picks.select("learner_id", "card_id").join(cp, "card_id")
             .filter(F.conv(F.substring(rv.stable_rand("given", "learner_id", "problem"), 1, 4), 16, 10)
                     .cast("int") % 3 == 0)
             .select("learner_id", "card_id", "problem"))
    return rv.problem_rotation(picks, cp, given)

def _replay_sql(mode: str) -> str:
    """The review state of every card as a recursion over its reviews."""
    retention, cap = rv.MODES[mode][:2]
    w = [f"CAST({x!r} AS DOUBLE)" for x in rv.FSRS_W]
    learn, again = rv.LEARNING_STEPS, rv.RELEARNING_STEPS[0]
    factor = f"CAST({rv.FACTOR!r} AS DOUBLE)"

    def clamp(d):
        return f"least(greatest({d}, 1.0), 10.0)"

    def days(s):
        return (f"86400 * CAST(least(greatest(round_even({s} / {factor} * CAST({retention ** (1 / rv.DECAY) - 1!r} AS DOUBLE), 0), 1), "
                f"{cap}) AS BIGINT)")

    first = f"list_value({', '.join(w[:4])})[g]"
    return f"""
g AS (SELECT learner_id, deck, card_id, rating AS g, review_utc AS t,
             row_number() OVER (PARTITION BY learner_id, deck, card_id ORDER BY review_utc, seq) AS k
      FROM rlog WHERE rating BETWEEN 1 AND 4),
f AS (
  SELECT learner_id, deck, card_id, k, t, CASE WHEN g = 4 THEN 'Review' ELSE 'Learning' END AS state, {first} AS s,
         {clamp(f"{w[4]} - (g - 3) * {w[5]}")} AS d, CASE WHEN g = 3 THEN 1 ELSE 0 END AS step,
         t + CASE WHEN g = 4 THEN {days(first)} WHEN g = 3 THEN {learn[1]} ELSE {learn[0]} END AS due,
         CAST(1 AS BIGINT) AS reps, CAST(0 AS BIGINT) AS lapses, CAST(g = 1 AS BIGINT) AS fails
  FROM g WHERE k = 1
  UNION ALL
  SELECT learner_id, deck, card_id, k2, t2,
         CASE WHEN passed THEN 'Review' WHEN state = 'Learning' THEN 'Learning' ELSE 'Relearning' END, s2, d2, step2,
         t2 + CASE WHEN passed THEN {days('s2')} WHEN state = 'Learning' THEN [{learn[0]}, {learn[1]}][step2 + 1] ELSE {again} END,
         reps + 1, lapses + CAST(g = 1 AND state <> 'Learning' AS BIGINT), fails + CAST(g = 1 AS BIGINT)
  FROM (SELECT *, CASE WHEN passed THEN step WHEN g = 1 THEN 0 WHEN state = 'Learning' AND g > 2 THEN step + 1 ELSE step END AS step2,
               CASE WHEN g = 1 THEN {w[11]} * pow(d2, -{w[12]}) * (pow(s + 1, {w[13]}) - 1) * exp({w[14]} * (1 - r))
                    ELSE s * (exp({w[8]}) * (11 - d2) * pow(s, -{w[9]}) * (exp({w[10]} * (1 - r)) - 1)
                              * CASE g WHEN 2 THEN {w[15]} WHEN 4 THEN {w[16]} ELSE 1 END + 1) END AS s2
        FROM (SELECT f.*, g.g, g.t AS t2, g.k AS k2,
                     pow(1 + {factor} * greatest((g.t - f.t) / CAST(86400 AS DOUBLE), 0) / f.s, CAST({rv.DECAY} AS DOUBLE)) AS r,
                     {clamp(f"{w[7]} * {w[4]} + (1 - {w[7]}) * (f.d - {w[6]} * (g.g - 3))")} AS d2,
                     CASE f.state WHEN 'Learning' THEN g.g = 4 OR (g.g = 3 AND f.step = 1) WHEN 'Review' THEN g.g > 1 ELSE g.g > 2 END AS passed
              FROM f JOIN g ON g.learner_id = f.learner_id AND g.deck = f.deck AND g.card_id = f.card_id AND g.k = f.k + 1))),
states AS (SELECT * FROM f QUALIFY k = max(k) OVER (PARTITION BY learner_id, deck, card_id))"""


@register(sql="WITH RECURSIVE " + REVIEW_LOG.strip() + "," + _replay_sql("recruiting") + """
SELECT learner_id, deck, card_id, state, round(s, 6) AS stability, round(d, 6) AS difficulty, due AS due_utc, reps, lapses,
       fails, t AS last_utc
FROM states""")
def q_review_replay(spark, sf):
    """The review state of every card, folded from its grades."""
    out = rv.review_replay(fx.review_log(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("stability", "difficulty")})


def _interval_sql() -> str:
    parts = [f"SELECT '{m}' AS mode, * FROM (WITH RECURSIVE " + REVIEW_LOG.strip() + "," + _replay_sql(m)
             + " SELECT learner_id, deck, card_id, state, due - t AS wait_s FROM states)" for m in rv.MODES]
    return " UNION ALL ".join(parts)


@register(sql=_interval_sql())
def q_interval_contract(spark, sf):
    """How long each card waits in each mode: never beyond the mode's longest interval, and within a day after a
    lapse."""
    log = materialize(fx.review_log(spark, sf), "review-log")
    parts = [rv.review_replay(log, m).select(F.lit(m).alias("mode"), "learner_id", "deck", "card_id", "state",
                                             (F.col("due_utc") - F.col("last_utc")).alias("wait_s")) for m in rv.MODES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_MODES = ", ".join(f"({q(m)}, {v[2]})" for m, v in rv.MODES.items())
_MODE_OF = "CASE user_id % 3 WHEN 0 THEN 'sharp' WHEN 1 THEN 'ramping' ELSE 'recruiting' END"


@register(sql=f"""
WITH l AS (SELECT DISTINCT user_id AS learner_id, {_MODE_OF} AS mode FROM events),
m AS (SELECT * FROM (VALUES {_MODES}) v(mode, daily_cap))
SELECT l.learner_id, l.mode, m.daily_cap, greatest(1, CAST(round_even(m.daily_cap * 0.6, 0) AS INTEGER)) AS dsa,
       greatest(1, m.daily_cap - greatest(1, CAST(round_even(m.daily_cap * 0.6, 0) AS INTEGER))) AS design
FROM l LEFT JOIN m USING (mode)""")
def q_budget_split(spark, sf):
    return _learner_modes(spark, sf)

def _learner_modes(spark, sf):
    learners = table(spark, sf, "events").select("user_id").distinct().select(
        F.col("user_id").alias("learner_id"),
        F.when(F.col("user_id") % 3 == 0, "sharp").when(F.col("user_id") % 3 == 1, "ramping")
        .otherwise("recruiting").alias("mode"))
    modes = spark.createDataFrame([(m, v[2]) for m, v in rv.MODES.items()], "mode string, daily_cap int")
    return rv.budget_split(learners, modes)


@register(sql=with_(REVIEW_LOG) + f""",
l AS (SELECT DISTINCT user_id AS learner_id, {_MODE_OF} AS mode FROM events),
b AS (SELECT l.learner_id, greatest(1, CAST(round_even(m.daily_cap * 0.6, 0) AS INTEGER)) AS dsa
      FROM l JOIN (VALUES {_MODES}) m(mode, daily_cap) USING (mode)),
due AS (SELECT rev.*, b.dsa, md5('cairn' || '|' || CAST(learner_id AS VARCHAR) || '|' || deck || '|' || card_id) AS rnd
        FROM rev JOIN b USING (learner_id) WHERE due_utc <= {NOW_R} AND fails < {LEECH}),
wk AS (SELECT *, CASE WHEN fails > 0 THEN row_number() OVER (PARTITION BY learner_id, deck, fails > 0
                                                             ORDER BY fails DESC, due_utc, rnd) END AS weak_rank FROM due),
t AS (SELECT *, CASE WHEN weak_rank <= greatest(1, dsa // 3) THEN 0 ELSE 1 END AS tier FROM wk),
t2 AS (SELECT *, sum(1 - tier) OVER (PARTITION BY learner_id, deck) AS n_weak,
              row_number() OVER (PARTITION BY learner_id, deck, tier ORDER BY due_utc, last_utc NULLS FIRST, rnd) AS rest_rank
       FROM t)
SELECT learner_id, deck, card_id, dsa AS budget,
       CAST(CASE WHEN tier = 0 THEN weak_rank ELSE n_weak + rest_rank END AS BIGINT) AS slot
FROM t2 WHERE tier = 0 OR rest_rank <= dsa - n_weak""")
def q_today_plan(spark, sf):
    """F8 into F4: each learner's due cards up to the budget of the learner's own mode."""
    budget = _learner_modes(spark, sf).select("learner_id", F.col("dsa").alias("budget"))
    review = fx.review_state(spark, sf).join(budget, "learner_id")
    out = rv.due_cards(review, NOW_R, F.col("budget"), leech_at=LEECH)
    return out.select("learner_id", "deck", "card_id", "budget", F.col("slot").cast("long").alias("slot"))


@register(sql=with_(REVIEW_LOG) + """,
cp AS (SELECT DISTINCT 'c' || CAST(p_partkey % 10 AS VARCHAR) AS card_id, p_name AS problem FROM part WHERE p_partkey % 10 NOT IN (3, 4)),
race AS (
  SELECT *, row_number() OVER (PARTITION BY learner_id, deck ORDER BY """ + _RACE + """, deck, card_id) AS draw
  FROM rev WHERE card_id IN (SELECT card_id FROM cp)),
picks AS (SELECT learner_id, deck, card_id, draw FROM race WHERE draw <= 2),
given AS (SELECT DISTINCT learner_id, card_id, problem FROM rlog JOIN cp USING (card_id)
          WHERE learner_id % 2 = 0 AND length(problem) % 2 = 0),
x AS (SELECT p.*, cp.problem, g.problem IS NULL AS fresh,
             md5('cairn|' || CAST(p.learner_id AS VARCHAR) || '|' || p.card_id || '|' || cp.problem) AS rnd
      FROM picks p JOIN cp USING (card_id)
      LEFT JOIN given g ON g.learner_id = p.learner_id AND g.card_id = p.card_id AND g.problem = cp.problem),
y AS (SELECT *, bool_or(fresh) OVER (PARTITION BY learner_id, card_id) AS any_fresh FROM x)
SELECT learner_id, deck, card_id, CAST(draw AS INTEGER) AS draw, problem FROM (
  SELECT *, row_number() OVER (PARTITION BY learner_id, card_id ORDER BY rnd, problem) AS r FROM y WHERE fresh OR NOT any_fresh)
WHERE r = 1""")
def q_practice_picks(spark, sf):
    """two cards a deck, drawn by weakness among the cards that have problems (two of
    ten have none), and a problem of each that the learner was not given, if there is one."""
    cp = card_problems(spark, sf).filter(~F.col("card_id").isin("c3", "c4"))
    seen = fx.review_log(spark, sf).select("learner_id", "card_id").distinct().filter("learner_id % 2 = 0")
    given = seen.join(cp.filter(F.length("problem") % 2 == 0), "card_id")
    return rv.practice_picks(fx.review_state(spark, sf), cp, given, 2)


@register(sql="""
WITH cards AS (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'AUTOMOBILE')
SELECT 'missing' AS kind, c_custkey AS key FROM cards c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)
UNION ALL
SELECT DISTINCT 'orphan' AS kind, o_custkey AS key FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM cards c WHERE c.c_custkey = o.o_custkey)""")
def q_orphans(spark, sf):
    """D4 both directions: deck cards (customers; the AUTOMOBILE segment was retired
    from the deck) with no review row (orders), and review rows whose card is gone."""
    cust = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    cards = cust.filter(F.col("c_mktsegment") != "AUTOMOBILE").select(
        F.lit("c").alias("deck"), F.col("c_custkey").alias("card_id"))
    rev = table(spark, sf, "orders").select(F.lit("c").alias("deck"), F.col("o_custkey").alias("card_id"))
    missing = rv.register_missing(cards, rev).select(F.lit("missing").alias("kind"), F.col("card_id").alias("key"))
    orph = rv.orphans(rev, cards).select(F.lit("orphan").alias("kind"), F.col("card_id").alias("key")).distinct()
    return missing.unionByName(orph)


# ---- digest ----

def _paused(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    c = ev.filter(F.col("event_type").isin("signup", "error")).select(
        F.col("user_id").alias("subscriber_id"),
        F.when(F.col("event_type") == "error", "pause").otherwise("resume").alias("action"),
        F.struct(F.unix_timestamp("ts"), F.col("event_id")).alias("o"))
    last = c.groupBy("subscriber_id").agg(F.max_by("action", "o").alias("action"))
    return last.select("subscriber_id", (F.col("action") == "pause").alias("paused"))


def _queue(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return o.select(F.col("o_custkey").alias("subscriber_id"), F.col("o_orderkey").alias("idea_id"),
                    (F.col("o_orderstatus") == "O").alias("unsent"))


PAUSED_SQL = """
paused AS (
  SELECT user_id AS subscriber_id, arg_max(CASE WHEN event_type = 'error' THEN 'pause' ELSE 'resume' END,
                                           (CAST(floor(epoch(ts)) AS BIGINT), event_id)) = 'pause' AS paused
  FROM events WHERE event_type IN ('signup', 'error') GROUP BY 1),
head AS (
  SELECT * FROM (
    SELECT o_custkey AS subscriber_id, o_orderkey AS idea_id,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position
    FROM orders o WHERE o_orderstatus = 'O'
      AND NOT EXISTS (SELECT 1 FROM paused p WHERE p.subscriber_id = o.o_custkey AND p.paused))
  WHERE position <= 3)"""


@register(sql="WITH " + PAUSED_SQL + " SELECT subscriber_id, idea_id, position FROM head")
def q_queue_head(spark, sf):
    h = dg.queue_head(_queue(spark, sf), _paused(spark, sf))
    return h.select("subscriber_id", "idea_id", F.col("position").cast("long").alias("position"))


TAKEN = [f"c{i}" for i in range(10)] + ["almond", "antique", "aquamarine"]


@register(sql="WITH " + PAUSED_SQL + f""",
slugs AS (
  SELECT h.subscriber_id, h.position, h.idea_id,
         coalesce(nullif(left(regexp_replace(regexp_replace(lower(p.p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60), ''), 'idea') AS slug
  FROM head h
  JOIN (SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS l_partkey FROM lineitem GROUP BY 1) l
    ON l.l_orderkey = h.idea_id
  JOIN part p ON p.p_partkey = l.l_partkey),
b AS (
  SELECT *, list_filter(string_split(slug, '-'), lambda x: x <> '') AS parts FROM slugs),
b2 AS (
  SELECT *, CASE WHEN len(parts) = 0 THEN '' WHEN length(parts[1]) >= 3 THEN parts[1]
                 ELSE array_to_string(parts[1:2], '-') END AS base FROM b),
arr AS (SELECT subscriber_id, list({{'idea_id': idea_id, 'slug': slug, 'base': base}} ORDER BY position) AS its
        FROM b2 GROUP BY 1),
h1 AS (
  SELECT subscriber_id, its, {q("x")} AS dummy,
         CASE WHEN its[1].base = '' THEN '' WHEN NOT list_contains({TAKEN!r}, its[1].base) THEN its[1].base
              ELSE coalesce(its[1].base || CAST(list_filter(range(2, 100), lambda n: NOT list_contains({TAKEN!r}, its[1].base || CAST(n AS VARCHAR)))[1] AS VARCHAR), its[1].slug) END AS x1
  FROM arr),
h2 AS (
  SELECT *, CASE WHEN len(its) < 2 THEN NULL WHEN its[2].base = '' THEN ''
                 WHEN NOT list_contains(list_append({TAKEN!r}, x1), its[2].base) THEN its[2].base
                 ELSE coalesce(its[2].base || CAST(list_filter(range(2, 100), lambda n: NOT list_contains(list_append({TAKEN!r}, x1), its[2].base || CAST(n AS VARCHAR)))[1] AS VARCHAR), its[2].slug) END AS x2
  FROM h1),
h3 AS (
  SELECT *, CASE WHEN len(its) < 3 THEN NULL WHEN its[3].base = '' THEN ''
                 WHEN NOT list_contains(list_concat({TAKEN!r}, [x1, x2]), its[3].base) THEN its[3].base
                 ELSE coalesce(its[3].base || CAST(list_filter(range(2, 100), lambda n: NOT list_contains(list_concat({TAKEN!r}, [x1, x2]), its[3].base || CAST(n AS VARCHAR)))[1] AS VARCHAR), its[3].slug) END AS x3
  FROM h2)
SELECT subscriber_id AS batch_id, its[1].idea_id AS idea_id, x1 AS handle FROM h3
UNION ALL SELECT subscriber_id, its[2].idea_id, x2 FROM h3 WHERE len(its) >= 2
UNION ALL SELECT subscriber_id, its[3].idea_id, x3 FROM h3 WHERE len(its) >= 3""")
def q_reply_handles(spark, sf):
    h = dg.queue_head(_queue(spark, sf), _paused(spark, sf))
    li = (table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").groupBy("l_orderkey")
          .agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("l_partkey")))
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    items = (h.join(li, h.idea_id == li.l_orderkey).join(p, F.col("l_partkey") == F.col("p_partkey"))
             .select(F.col("subscriber_id").alias("batch_id"), "position", "idea_id",
                     tx.slugify(F.col("p_name")).alias("slug")))
    return dg.reply_handles(items, TAKEN)


@register(sql="""
WITH c AS (SELECT DISTINCT user_id AS subscriber_id,
                  strftime(timezone('America/New_York', ts AT TIME ZONE 'UTC'), '%Y-%m-%d') AS local_date FROM events),
s AS (SELECT DISTINCT user_id AS subscriber_id,
                  strftime(timezone('America/New_York', ts AT TIME ZONE 'UTC'), '%Y-%m-%d') AS local_date
      FROM events WHERE event_type = 'purchase')
SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.subscriber_id = c.subscriber_id AND s.local_date = c.local_date)""")
def q_once_per_day(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "ts", "event_type")
    local = F.date_format(F.from_utc_timestamp(F.col("ts"), "America/New_York"), "yyyy-MM-dd")
    cands = ev.select(F.col("user_id").alias("subscriber_id"), local.alias("local_date"))
    sent = ev.filter(F.col("event_type") == "purchase").select(F.col("user_id").alias("subscriber_id"),
                                                              local.alias("local_date"))
    return dg.once_per_day(cands, sent)

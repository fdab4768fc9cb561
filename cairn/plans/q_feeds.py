"""Registered queries for the landed feeds, scans, sinks and the harvest stream (A1-A3, A7-A10, I1, I4, I5,
I7).

Each query lands rows of the driver tables as a fetcher or model run would (JSON pages, deck and
ledger files, parquet items) in the shared checkpoint folder and reads them back through the
operator. Pages and files hold a bounded number of rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lexicons import FIXTURE_DOMAINS, FIXTURE_PAIN
from ..operators import feedback as fb
from ..operators.util import materialize
from ..session import checkpoint_dir
from ..sources import feeds
from ..sources.tables import table
from ..streaming import canary, folds, ordered
from ..streaming import harvest as sh
from . import fixtures as fx
from .oracle import REVIEW_LOG, SIGNAL, VERDICT_LOG, with_
from .registry import register

SINCE_1996 = 820454400


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/landed/{name}-{uuid.uuid4().hex}"


def _landed(df: DataFrame, name: str) -> str:
    path = _folder(df.sparkSession, name)
    df.write.json(path)
    return path


def _text(prefix: str, col: str):
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def _unless(mod: int, col: str, value):
    """``value``, missing for every ``mod``-th row."""
    return F.when(F.col(col) % mod != 0, value)


@register(sql="""
WITH e AS (
  SELECT *, event_id // 50 AS page, row_number() OVER (PARTITION BY event_id // 50 ORDER BY event_id) - 1 AS pos,
         CAST(json_extract(props, '$.k') AS BIGINT) AS k
  FROM events)
SELECT 'hn' AS source, CAST(event_id AS VARCHAR) AS external_id,
       'https://news.ycombinator.com/item?id=' || CAST(event_id AS VARCHAR) AS url, event_type AS title,
       event_type || chr(10) || 'k & v' AS text,
       CASE WHEN event_id % 11 = 0 THEN '' ELSE 'u' || CAST(user_id AS VARCHAR) END AS author,
       CASE WHEN event_id % 19 = 0 THEN 0 ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS created_utc,
       CASE WHEN event_id % 23 = 0 THEN 0 ELSE k END AS engagement, 'probe ' || CAST(page % 3 AS VARCHAR) AS query,
       CAST(page % 3 AS INTEGER) AS probe_ord, CAST(page AS INTEGER) AS page, CAST(pos AS INTEGER) AS pos
FROM e WHERE event_id % 13 <> 0 AND event_id % 17 <> 0""")
def q_search_feed(spark, sf):
    """A1: every event is a hit, 50 to a page; some have no id, author, time or count."""
    return feeds.search_hits(spark, _landed(_search_pages(spark, sf), "search"))


def _search_pages(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "props")
    k = F.get_json_object("props", "$.k").cast("long")
    hit = F.struct(
        "event_id",
        F.when(F.col("event_id") % 17 == 0, "").otherwise(
            _unless(13, "event_id", F.col("event_id").cast("string"))).alias("objectID"),
        F.col("event_type").alias("story_title"),
        F.concat(F.lit("<p>"), "event_type", F.lit("</p><i>k &amp; v</i>")).alias("comment_text"),
        _unless(11, "event_id", _text("u", "user_id")).alias("author"),
        _unless(19, "event_id", F.unix_timestamp("ts")).alias("created_at_i"),
        _unless(23, "event_id", k).alias("num_comments"))
    return (e.groupBy(F.floor(F.col("event_id") / 50).cast("int").alias("page"))
            .agg(F.array_sort(F.collect_list(hit)).alias("hits"))
            .select("page", "hits", (F.col("page") % 3).alias("probe_ord"),
                    F.concat(F.lit("probe "), (F.col("page") % 3).cast("string")).alias("query")))


@register(sql=f"""
WITH o AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos,
         CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE CAST(epoch(o_orderdate) AS BIGINT) - 7200 END AS created_utc FROM orders)
SELECT 'lobsters' AS source, 'o' || CAST(o_orderkey AS VARCHAR) AS external_id,
       CASE WHEN o_orderkey % 3 <> 0 THEN 'o/' || CAST(o_orderkey AS VARCHAR)
            WHEN c_custkey % 4 <> 0 THEN 'c/' || CAST(c_custkey AS VARCHAR) ELSE '' END AS url,
       c_name AS title, o_orderpriority AS text, o_orderstatus AS author, created_utc,
       CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE o_orderkey % 50 END AS engagement,
       CASE WHEN c_custkey % 3 = 0 THEN 'tag:all' ELSE 'tag:t' || CAST(c_nationkey % 5 AS VARCHAR) END AS query,
       CAST(CASE WHEN c_custkey % 3 = 0 THEN 9 ELSE c_nationkey % 5 END AS INTEGER) AS tag_ord, CAST(pos AS INTEGER) AS pos
FROM o JOIN customer ON c_custkey = o_custkey
WHERE (c_custkey % 5 = 0 OR c_custkey % 7 <> 0) AND (created_utc = 0 OR created_utc >= {SINCE_1996})""")
def q_threaded_feed(spark, sf):
    """A2: customers as stories, listed under a nation tag and again under ``all``; their orders
    as comments, some without url, score or a readable time."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    story = F.struct("c_custkey", _text("s", "c_custkey").alias("short_id"),
                     _unless(5, "c_custkey", F.col("c_custkey") % 7).alias("comment_count"))
    page = F.floor(F.col("c_custkey") / 100).cast("int").alias("page")
    tag = (F.col("c_nationkey") % 5).cast("int")
    tagged = c.filter(F.col("c_custkey") % 3 != 0).groupBy(tag.alias("tag_ord"), page).agg(
        F.array_sort(F.collect_list(story)).alias("stories")).withColumn("tag", _text("t", "tag_ord"))
    everything = c.groupBy(page).agg(F.array_sort(F.collect_list(story)).alias("stories")).select(
        F.lit(9).alias("tag_ord"), "page", "stories", F.lit("all").alias("tag"))
    when = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+02:00'")
    comment = F.struct(
        "o_orderkey", _text("o", "o_orderkey").alias("short_id"),
        F.concat(F.lit("<p>"), "o_orderpriority", F.lit("</p>")).alias("comment"),
        F.col("o_orderstatus").alias("commenting_user"),
        F.coalesce(_unless(10, "o_orderkey", when), F.lit("yesterday")).alias("created_at"),
        _unless(6, "o_orderkey", F.col("o_orderkey") % 50).alias("score"),
        _unless(3, "o_orderkey", _text("o/", "o_orderkey")).alias("url"))
    threads = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(comment)).alias("comments"))
    details = c.join(threads, F.col("c_custkey") == F.col("o_custkey")).select(
        _text("s", "c_custkey").alias("short_id"), F.col("c_name").alias("title"),
        _unless(4, "c_custkey", _text("c/", "c_custkey")).alias("url"), "comments")
    return feeds.threaded_feed(spark, _landed(tagged.unionByName(everything), "listings"),
                               _landed(details, "details"), SINCE_1996, multi_line=False)


@register(sql=f"""
WITH p AS (
  SELECT *, row_number() OVER (PARTITION BY p_brand, p_partkey // 200 ORDER BY p_partkey) - 1 AS pos,
         {SINCE_1996} + CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE (p_partkey % 50 - 10) * 86400 END AS created_utc
  FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, pos, p_partkey) AS rank FROM p
      WHERE (p_partkey % 5 = 0 OR p_partkey % 7 <> 0) AND p_size >= 15 AND created_utc >= {SINCE_1996})
SELECT CAST(p_partkey AS VARCHAR) AS external_id, p_brand || ': ' || p_name AS title, p_type AS text, created_utc,
       CAST(p_size AS BIGINT) AS engagement, 'repo:' || p_brand AS query, CAST(pos AS INTEGER) AS pos
FROM r WHERE rank <= 40""")
def q_issue_feed(spark, sf):
    """A3: parts as the issues of their brand, 200 part keys to a page; some are closed, old or
    have no readable time."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    when = F.date_format(F.timestamp_seconds(F.lit(SINCE_1996) + (F.col("p_partkey") % 50 - 10) * 86400),
                         "yyyy-MM-dd'T'HH:mm:ss'Z'")
    issue = F.struct(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"),
        F.concat(F.lit("<p>"), "p_type", F.lit("</p>")).alias("body"),
        _unless(5, "p_partkey", F.when(F.col("p_partkey") % 7 == 0, "closed").otherwise("open")).alias("state"),
        F.coalesce(_unless(9, "p_partkey", when), F.lit("soon")).alias("created_at"),
        F.struct(F.col("p_size").alias("total_count")).alias("reactions"))
    pages = p.groupBy(F.col("p_brand").alias("repo"), F.floor(F.col("p_partkey") / 200).alias("page")).agg(
        F.array_sort(F.collect_list(issue)).alias("items"))
    return feeds.issue_feed(spark, _landed(pages, "issues"), SINCE_1996).select(
        "external_id", "title", "text", "created_utc", "engagement", "query", "pos")


@register(sql="""
SELECT 'd' || CAST(o_custkey AS VARCHAR) AS deck, 'c' || CAST(o_orderkey AS VARCHAR) AS card_id, o_orderpriority AS name,
       CAST(CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 2 END AS INTEGER) AS n_problems
FROM orders""")
def q_deck_scan(spark, sf):
    """One deck per customer, its orders as cards; every second card has no problems."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    key = _text("p", "o_orderkey")
    card = F.struct(_text("c", "o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"),
                    _unless(2, "o_orderkey", F.array(F.concat(key, F.lit("-1")), F.concat(key, F.lit("-2")))).alias("problems"))
    files = o.groupBy(_text("d", "o_custkey").alias("deck")).agg(F.collect_list(card).alias("cards"))
    cards = feeds.decks(spark, _landed(files, "decks"), multi_line=False)
    return cards.select("deck", "card_id", "name",
                        F.when(F.col("problems").isNull(), 0).otherwise(F.size("problems")).alias("n_problems"))


LEDGER = T.StructType([T.StructField("idea_id", T.LongType()), T.StructField("title", T.StringType()),
                       T.StructField("domain", T.StringType())])


@register(sql="""
SELECT p_partkey AS idea_id, p_name AS title, p_brand AS domain FROM part WHERE p_partkey % 13 <> 0""")
def q_ledger_scan(spark, sf):
    """Parts as ledger entries; every 13th was cut off while it was written and is skipped."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("idea_id"), F.col("p_name").alias("title"),
                                        F.col("p_brand").alias("domain"))
    entry = F.to_json(F.struct("idea_id", "title", "domain"))
    path = _folder(spark, "ledger")
    p.select(F.when(F.col("idea_id") % 13 == 0, F.left(entry, F.lit(12))).otherwise(entry).alias("value")).write.text(path)
    return materialize(feeds.idea_ledger(spark, path, LEDGER, multi_line=False, glob="part-*"), "ledger")


@register(sql="""
SELECT o_orderkey AS candidate_id, o_orderpriority AS domain, 'grounding+,' || o_orderstatus || '-' AS trail
FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def q_reject_sink(spark, sf):
    """The rejects of two runs are appended to one table, partitioned by domain."""
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("candidate_id"), F.col("o_orderpriority").alias("domain"),
        F.concat(F.lit("grounding+,"), "o_orderstatus", F.lit("-")).alias("trail"), "o_orderstatus")
    path = _folder(spark, "rejects")
    for run in ("F", "O"):
        feeds.write_rejects(o.filter(F.col("o_orderstatus") == run).drop("o_orderstatus"), path)
    return spark.read.parquet(path).select("candidate_id", "domain", "trail")


@register(sql="""
SELECT o_orderkey AS idea_id, o_orderpriority AS title, 'run-' || o_orderstatus AS batch_id FROM orders
WHERE o_orderstatus IN ('F', 'O')""")
def q_ledger_sink(spark, sf):
    """A10: two batches of ideas, the first written again after a failed acknowledgement."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("idea_id"), F.col("o_orderpriority").alias("title"),
                                          "o_orderstatus")
    path = _folder(spark, "ideas")
    for run in ("F", "O", "F"):
        feeds.write_ideas_batch(o.filter(F.col("o_orderstatus") == run).drop("o_orderstatus"), path, f"run-{run}")
    return spark.read.parquet(path).select("idea_id", "title", "batch_id")


@register(sql=with_(SIGNAL) + " SELECT source, external_id, domain, created_utc FROM gated")
def q_incremental_harvest(spark, sf):
    """Documents land in two lots, the second with the first one's even ids again; the
    stream runs after each, and every kept document is stored once, undated and old ones too."""
    raw = fx.raw_signal(spark, sf).select(
        "source", "external_id", "url", "title", "text", "author", "created_utc",
        F.lit(0).cast("long").alias("engagement"), F.lit("").alias("query"))
    ident = F.col("external_id").cast("long")
    landed, store, done = (_folder(spark, n) for n in ("items", "store", "harvest-progress"))
    gate = {"domains": FIXTURE_DOMAINS, "pain_markers": FIXTURE_PAIN}
    for lot in (raw.filter(ident % 3 == 0), raw.filter((ident % 3 != 0) | (ident % 2 == 0))):
        lot.write.mode("append").parquet(landed)
        sh.incremental_harvest(spark, landed, store, done, gate)
    return spark.read.parquet(store).select("source", "external_id", "domain", "created_utc")


DAY = 86400
JITTER = 2 * DAY       # how much later than its time an event may arrive; the streams wait three days


def _arriving(events: DataFrame, ts: str, key: str, lots: int) -> DataFrame:
    """``events`` with ``lot``, the part of the time in which each arrives: in a lot and at its ends they come
    out of order."""
    arrival = F.col(ts) + F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(JITTER))
    span = events.agg(F.min(ts).alias("a"), F.max(ts).alias("b")).first()
    first, length = (span.a or 0), max(1, (span.b or 0) - (span.a or 0) + JITTER)
    return events.withColumn("lot", F.least(F.floor((arrival - first) * lots / length), F.lit(lots - 1)).cast("int"))


def _streamed(spark, arriving: DataFrame, lots: list[int], stream, mode: str = "update") -> DataFrame:
    """What ``stream`` writes if the lots land one after the other and it runs after each."""
    landed, out, done = (_folder(spark, n) for n in ("events", "folds", "fold-progress"))
    arriving = materialize(arriving, "arriving")
    events = arriving.drop("lot")
    for lot in lots:
        arriving.filter(F.col("lot") == lot).drop("lot").write.mode("append").parquet(landed)
        ordered.run_available(stream(spark.readStream.schema(events.schema).parquet(landed)), out, done, mode)
    return spark.read.parquet(out)


@register(sql=with_(VERDICT_LOG) + """
SELECT idea_id, arg_min(verdict, (ts, message_id)) AS verdict, min(ts) AS ts,
       arg_min(message_id, (ts, message_id)) AS message_id
FROM vlog GROUP BY idea_id""")
def q_stream_first_verdict(spark, sf):
    """I4 as a stream on state: three lots that each span the whole time; a late verdict that is
    earlier still becomes the first one."""
    log = fx.verdict_log(spark, sf).withColumn("lot", (F.col("message_id") % 3).cast("int"))
    return ordered.newest(_streamed(spark, log, [2, 0, 1], folds.stream_first_verdict), ["idea_id"])


@register(sql="""
WITH steps AS (
  SELECT user_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id AS seq,
         CAST(CASE event_type WHEN 'signup' THEN 1.8 WHEN 'purchase' THEN 1.3 WHEN 'click' THEN 0.85 WHEN 'view' THEN 0.95
                              WHEN 'error' THEN 0.6 END AS DOUBLE) AS factor
  FROM events)
SELECT id, round(list_reduce(list(factor ORDER BY ts, seq), lambda w, f: greatest(CAST(0.1 AS DOUBLE), least(CAST(4.0 AS DOUBLE), w * f)),
                             CAST(1.0 AS DOUBLE)), 6) AS weight, CAST(count(*) AS INTEGER) AS n_steps
FROM steps WHERE factor IS NOT NULL GROUP BY id""")
def q_stream_weight_fold(spark, sf):
    """I5 as a stream on state: each event is a step of its user's weight, which meets both clamps; steps
    arrive up to two days late and are folded at their own place."""
    steps = _steps(spark, sf)
    out = _streamed(spark, _arriving(steps, "ts", "seq", 3), [0, 1, 2], folds.stream_weight_fold)
    return ordered.newest(out, ["id"]).select("id", F.round("weight", 6).alias("weight"), F.col("n_steps").cast("int").alias("n_steps"))


def _steps(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    steps = F.create_map(*[F.lit(x) for e, v in fx.VERDICT_OF_EVENT.items() for x in (e, fb.WEIGHT_STEP[v])])
    return ev.select(F.col("user_id").alias("id"), F.unix_timestamp("ts").alias("ts"), F.col("event_id").alias("seq"),
                     steps[F.col("event_type")].alias("factor")).filter(F.col("factor").isNotNull())


@register(sql=with_(REVIEW_LOG) + " SELECT learner_id, deck, card_id, reps, fails, last_utc FROM rev")
def q_stream_review(spark, sf):
    """I1 as a stream on state: every grade counts, those that arrive late too (the states equal the
    batch replay's, in the tests)."""
    log = _arriving(fx.review_log(spark, sf), "review_utc", "seq", 3)
    out = ordered.newest(_streamed(spark, log, [0, 1, 2], folds.stream_review_replay), ["learner_id", "deck", "card_id"])
    return out.select("learner_id", "deck", "card_id", "reps", "fails", "last_utc")


QUIET = 60 * DAY       # the clock runs on after the last event

CANARY_SQL = f"""
WITH sends AS (
  SELECT o_custkey AS s, CAST(epoch(o_orderdate) AS BIGINT) AS ts, o_orderpriority AS domain FROM orders),
replies AS (
  SELECT DISTINCT o_custkey AS s, CAST(epoch(o_orderdate) AS BIGINT) + {2 * DAY} AS ts FROM orders WHERE o_orderstatus = 'F'),
clock AS (SELECT max(ts) + {QUIET} AS w FROM (SELECT ts FROM sends UNION ALL SELECT ts FROM replies)),
begins AS (SELECT s, min(ts) AS since FROM sends GROUP BY s UNION SELECT s, ts FROM replies),
stretch AS (SELECT s, since, coalesce(lead(since) OVER (PARTITION BY s ORDER BY since), (SELECT w FROM clock)) AS stop FROM begins),
inside AS (SELECT g.s, g.since, g.stop, x.ts, x.domain FROM stretch g JOIN sends x ON x.s = g.s AND x.ts >= g.since AND x.ts < g.stop),
due AS (SELECT s, since, stop, greatest(since + {14 * DAY}, list_sort(list(ts))[4]) AS first_at FROM inside GROUP BY 1, 2, 3 HAVING count(*) >= 4),
alerts AS (SELECT s, since, unnest(range(first_at, stop, {14 * DAY})) AS now_utc FROM due),
counted AS (SELECT a.s, a.since, a.now_utc, i.domain, count(*) AS n FROM alerts a JOIN inside i
            ON i.s = a.s AND i.since = a.since AND i.ts <= a.now_utc GROUP BY 1, 2, 3, 4),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s, now_utc ORDER BY n DESC, domain) AS r FROM counted)
SELECT s AS subscriber_id, now_utc, CAST(sum(n) AS BIGINT) AS n_unanswered, (now_utc - since) // {DAY} AS quiet_days,
       string_agg(domain || ' x' || CAST(n AS VARCHAR), ', ' ORDER BY r) FILTER (WHERE r <= 3) AS breakdown
FROM ranked GROUP BY s, since, now_utc"""


@register(sql=CANARY_SQL)
def q_stream_canary(spark, sf):
    """Digests are orders, and a finished order is answered two days later by a reply with a verdict; events
    arrive up to two days late, in four lots, and the clock runs on for 60 days. One row for each alert."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    sent = F.unix_timestamp("o_orderdate")

    def kind(name, place, ts, idea, domain):
        return F.struct(F.lit(name).alias("kind"), ts.alias("ts"), (F.col("o_orderkey") * 3 + place).alias("seq"),
                        idea.cast("long").alias("idea_id"), domain.cast("string").alias("domain"))

    back = sent + 2 * DAY
    events = o.select(F.col("o_custkey").alias("subscriber_id"), F.explode(F.when(F.col("o_orderstatus") == "F", F.array(
        kind("send", 0, sent, F.col("o_orderkey"), F.col("o_orderpriority")),
        kind("verdict", 1, back, F.col("o_orderkey"), F.lit(None)), kind("reply", 2, back, F.lit(None), F.lit(None)))).otherwise(
        F.array(kind("send", 0, sent, F.col("o_orderkey"), F.col("o_orderpriority"))))).alias("e")).select("subscriber_id", "e.*")
    arriving = _arriving(events, "ts", "seq", 4)
    end = (events.agg(F.max("ts")).first()[0] or 0) + QUIET + 3 * DAY       # the streams wait three days
    clock = spark.createDataFrame([(-1, "clock", end, -k, None, None, 4 + k) for k in range(2)],
                                  "subscriber_id long, kind string, ts long, seq long, idea_id long, domain string, lot int")
    rows = _streamed(spark, arriving.unionByName(clock), [0, 1, 2, 3, 4, 5], canary.stream_silence_canary, "append")
    return rows.select("subscriber_id", "now_utc", "n_unanswered", "quiet_days", "breakdown")


@register(sql="""
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS message_id, conv_id, turn, length(text) AS n_chars
FROM conversations WHERE role = 'user'""")
def q_stream_replay_dedup(spark, sf):
    """G2 as a stream: every third conversation's messages are delivered again 1,000 seconds later; state that
    expires with the watermark lets each through once."""
    c = table(spark, sf, "conversations").filter(F.col("role") == "user").select("conv_id", "turn", "text")
    mid = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    at = F.col("conv_id") * 10 + F.col("turn")
    times = F.explode(F.when(F.col("conv_id") % 3 == 0, F.array(at, at + 1000)).otherwise(F.array(at)))
    log = c.select(mid.alias("message_id"), "conv_id", "turn", F.length("text").alias("n_chars"), times.alias("fetched_utc"))
    span = log.agg(F.min("fetched_utc").alias("a"), F.max("fetched_utc").alias("b")).first()
    width = max(1, ((span.b or 0) - (span.a or 0)) // 3 + 1)
    lots = log.withColumn("lot", F.floor((F.col("fetched_utc") - (span.a or 0)) / width).cast("int"))
    out = _streamed(spark, lots, [0, 1, 2], lambda s: sh.once(s, ["message_id"], "fetched_utc", "20 minutes"), "append")
    return out.select("message_id", "conv_id", "turn", F.col("n_chars").cast("long").alias("n_chars"))

@register(sql="""
WITH e AS (SELECT *, event_id // 50 AS page FROM events)
SELECT 'hn' AS source, count(DISTINCT page) FILTER (WHERE page % 7 = 3) AS n_broken,
       count(*) FILTER (WHERE page % 7 <> 3 AND event_id % 13 <> 0 AND event_id % 17 <> 0) AS n_hits
FROM e""")
def q_feed_quarantine(spark, sf):
    """A4: every seventh page was cut off on its way; it is counted by source in the quarantine, and the hits of all
    others come out."""
    whole = spark.read.text(_landed(_search_pages(spark, sf), "search"))
    cut = F.get_json_object("value", "$.page").cast("long") % 7 == 3
    landed, broken = _folder(spark, "search-cut"), _folder(spark, "quarantine")
    whole.select(F.when(cut, F.left("value", F.length("value") / 2)).otherwise(F.col("value")).alias("value")).write.text(landed)
    hits = feeds.search_hits(spark, landed, broken).groupBy("source").agg(F.count("*").alias("n_hits"))
    lost = feeds.quarantined(spark, broken).select("source", F.col("n_pages").alias("n_broken"))
    return lost.join(hits, "source").select("source", "n_broken", "n_hits")

"""Registered queries for the scalar text / date / hash / json functions (B-ops)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import NOW
from ..functions import text as tx
from ..operators.digest import unique_slugs
from ..operators.feedback import mail_run, own_message_filter
from ..sources.tables import table
from . import fixtures as fx
from .oracle import REPLIES, with_
from .registry import register

ENTITIES_SQL = "replace(replace(replace(replace({t}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
TRIM_SQL = "regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"


def _ents(t):
    return ENTITIES_SQL.format(t=t)


_b1 = "replace(replace(html, '<p>', chr(10) || chr(10)), '</p>', chr(10))"
_b1 = f"regexp_replace({_b1}, '<[^>]+>', '', 'g')"
_b1 = _ents(_b1)
_b1 = f"regexp_replace({_b1}, '(?i)</?\\s*(evidence|instructions?|system|assistant|human)\\s*>', '', 'g')"
_b1 = f"regexp_replace({_b1}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
_b1 = TRIM_SQL.format(t=_b1)


@register(sql=f"SELECT page_id, {_b1} AS text FROM pages")
def q_html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.clean_html(F.col("html")).alias("text"))


_b3 = "regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g')"
_b3 = f"regexp_replace({_b3}, '(?i)<br\\s*/?>|</p>', chr(10), 'g')"
_b3 = f"regexp_replace({_b3}, '<[^>]+>', ' ', 'g')"


@register(sql=f"SELECT page_id, {_ents(_b3)} AS text FROM pages")
def q_reply_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.reply_html_to_text(F.col("html")).alias("text"))


SINCE = NOW - 45 * 86400


def _ts_variants(ts, eid):
    return (F.when(eid % 5 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .when(eid % 5 == 1, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
            .when(eid % 5 == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
            .when(eid % 5 == 3, F.concat(F.lit("garbage-"), eid.cast("string")))
            .otherwise(F.lit("")))


@register(sql=f"""
WITH raw AS (
  SELECT event_id, CASE event_id % 5
      WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
      WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00'
      WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
      WHEN 3 THEN 'garbage-' || CAST(event_id AS VARCHAR) ELSE '' END AS raw FROM events),
p AS (
  SELECT event_id, raw, CAST(CASE WHEN regexp_matches(raw, '(Z|[+-]\\d\\d:\\d\\d)$')
                                  THEN epoch(try_cast(raw AS TIMESTAMPTZ))
                                  ELSE epoch(try_cast(raw AS TIMESTAMP)) END AS BIGINT) AS e FROM raw)
SELECT event_id, raw, coalesce(e, 0) AS feed_ts, coalesce(e, {SINCE}) AS issue_ts,
       strftime(to_timestamp(coalesce(e, {SINCE})) AT TIME ZONE 'UTC', '%Y-%m-%d') AS issue_date
FROM p""")
def q_parse_timestamps(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "ts")
    raw = ev.select("event_id", _ts_variants(F.col("ts"), F.col("event_id")).alias("raw"))
    e = tx.parse_epoch(F.col("raw"))
    issue = F.coalesce(e, F.lit(SINCE).cast("long"))
    return raw.select("event_id", "raw", F.coalesce(e, F.lit(0).cast("long")).alias("feed_ts"),
                      issue.alias("issue_ts"), tx.epoch_date(issue).alias("issue_date"))


ENCODER = "cairn-hashing-256"


@register(sql=f"""
SELECT doc_id, sha1('{ENCODER}' || chr(10) || 'doc ' || CAST(doc_id AS VARCHAR) || chr(10) || left(text, 1200)) AS text_hash,
       'sha:' || left(sha1('d' || CAST(doc_id AS VARCHAR) || text), 24) AS message_key
FROM documents""")
def q_content_hash(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    title = F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
    return d.select("doc_id", tx.cache_key(ENCODER, tx.embed_text(title, F.col("text"))).alias("text_hash"),
                    tx.message_key(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.col("text")).alias("message_key"))


@register(sql="""
SELECT p_partkey, coalesce(nullif(left(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'),
                                                      '^-+|-+$', '', 'g'), 60), ''), 'idea') AS slug
FROM part""")
def q_slugs(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.slugify(F.col("p_name")).alias("slug"))


def _pos(pat):
    return (f"CASE WHEN regexp_matches(body, '(?m){pat}') "
            f"THEN length(regexp_extract(body, '(?ms)\\A(.*?)(?:{pat})', 1)) + 1 END")


_MARKERS_SQL = [r"^\s*>", r"(?i:^\s*On [^\n]+ wrote:\s*$)", r"(?i:^\s*-{2,}\s*Original Message\s*-{2,})",
                r"^\s*_{10,}\s*$", r"^\s*From:\s[^\n]+$", r"(?i:^\s*Sent from my \w+)"]
STRIPPED_SQL = f"""
stripped AS (
  SELECT message_id, subject, {TRIM_SQL.format(t=f'''CASE WHEN strpos(body, '--- reply above this line ---') > 0
              THEN left(body, strpos(body, '--- reply above this line ---') - 1)
              WHEN least({', '.join(_pos(m) for m in _MARKERS_SQL)}) IS NOT NULL
              THEN left(body, least({', '.join(_pos(m) for m in _MARKERS_SQL)}) - 1)
              ELSE body END''')} AS text
  FROM replies)"""


@register(sql=with_(REPLIES, STRIPPED_SQL) + " SELECT message_id, text FROM stripped")
def q_quote_strip(spark, sf):
    r = fx.replies(spark, sf)
    return r.select("message_id", tx.strip_quoted(F.col("body")).alias("text"))


_own = " + ".join(f"CAST(strpos(lower(text), '{p}') > 0 AS INTEGER)" for p in tx.OUR_TEXT)


@register(sql=with_(REPLIES, STRIPPED_SQL) + f"""
SELECT message_id, ({_own}) >= 2 AS own_text,
       CAST(nullif(regexp_extract(text, '(?i)\\b(\\d{{1,3}})\\s*(?:m|min|mins|minutes)\\b', 1), '') AS INTEGER) AS minutes,
       left(text, 500) AS note
FROM stripped""")
def q_reply_signals(spark, sf):
    r = fx.replies(spark, sf).select("message_id", tx.strip_quoted(F.col("body")).alias("text"))
    return r.select("message_id", tx.looks_like_own_text(F.col("text")).alias("own_text"),
                    tx.minutes(F.col("text")).alias("minutes"), F.left("text", F.lit(500)).alias("note"))


_norm = "lower(" + TRIM_SQL.format(t="regexp_replace(coalesce(subject, ''), '(?i)^\\s*((re|fwd?|aw|sv|antw)\\s*:\\s*)+', '')") + ")"


@register(sql=with_(REPLIES) + f""",
sent AS (SELECT DISTINCT lower({TRIM_SQL.format(t='text')}) AS title
         FROM conversations WHERE role = 'user' AND conv_id % 2 = 0),
norm AS (SELECT message_id, {_norm} AS s FROM replies)
SELECT n.message_id, n.s AS subject_norm,
       n.s <> '' AND (t.title IS NOT NULL OR starts_with(n.s, 'prep —') OR starts_with(n.s, 'prep -')
                      OR starts_with(n.s, 'ideas —') OR starts_with(n.s, 'ideas -')) AS is_ours
FROM norm n LEFT JOIN sent t ON n.s = t.title""")
def q_own_messages(spark, sf):
    """C12 with B13: replies whose normalised subject is one we sent."""
    return own_message_filter(fx.replies(spark, sf), _sent_titles(spark, sf))


def _sent_titles(spark, sf):
    conv = table(spark, sf, "conversations").filter((F.col("role") == "user") & (F.col("conv_id") % 2 == 0))
    return conv.select(F.lower(tx.full_trim(F.col("text"))).alias("title"))


@register(sql=with_(REPLIES) + f""",
sent AS (SELECT DISTINCT lower({TRIM_SQL.format(t='text')}) AS title
         FROM conversations WHERE role = 'user' AND conv_id % 2 = 0),
norm AS (SELECT message_id, conv_id, turn, {_norm} AS s FROM replies),
ours AS (SELECT n.* FROM norm n LEFT JOIN sent t ON n.s = t.title
         WHERE n.s <> '' AND (t.title IS NOT NULL OR starts_with(n.s, 'prep —') OR starts_with(n.s, 'prep -')
                              OR starts_with(n.s, 'ideas —') OR starts_with(n.s, 'ideas -')))
SELECT mailbox, message_id, CAST(place AS INTEGER) AS place FROM (
  SELECT conv_id % 5 AS mailbox, message_id, row_number() OVER (PARTITION BY conv_id % 5 ORDER BY conv_id * 3600 + turn DESC, message_id DESC) AS place
  FROM ours) WHERE place <= 20""")
def q_mail_run(spark, sf):
    """The newest twenty of the messages that are ours, for each of five mailboxes."""
    r = fx.replies(spark, sf).select((F.col("conv_id") % 5).alias("mailbox"), "message_id", "subject",
                                     (F.col("conv_id") * 3600 + F.col("turn")).alias("received_utc"))
    return mail_run(r, _sent_titles(spark, sf))


@register(sql=f"""
WITH b AS (
  SELECT p_partkey AS idea_id, {NOW} + p_partkey // 2 AS created_utc, p_size,
         coalesce(nullif(left(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60), ''), 'idea') AS base
  FROM part),
x AS (SELECT *, base NOT IN (SELECT base FROM b WHERE p_size < 3)
             AND row_number() OVER (PARTITION BY base ORDER BY created_utc, idea_id) = 1 AS plain FROM b),
y AS (SELECT *, row_number() OVER (PARTITION BY base, plain, created_utc ORDER BY idea_id) AS k FROM x)
SELECT idea_id, CASE WHEN plain THEN base ELSE base || '-' || CAST(created_utc AS VARCHAR)
                     || CASE WHEN k > 1 THEN '-' || CAST(k AS VARCHAR) ELSE '' END END AS slug FROM y""")
def q_slug_collisions(spark, sf):
    """Parts as ideas titled by their type, which many share; types of the smallest parts are taken."""
    p = table(spark, sf, "part").select("p_partkey", "p_type", "p_size")
    taken = p.filter("p_size < 3").select(tx.slugify(F.col("p_type")).alias("slug"))
    ideas = p.select(F.col("p_partkey").alias("idea_id"), F.col("p_type").alias("title"),
                     (F.lit(NOW) + F.floor(F.col("p_partkey") / 2)).alias("created_utc"))
    return unique_slugs(ideas, taken)


@register(sql="""
WITH r AS (
  SELECT event_id, CASE event_id % 4
      WHEN 0 THEN 'Here you go:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```'
      WHEN 1 THEN 'Sure! ' || props || ' hope this helps'
      WHEN 2 THEN 'list: [' || props || ', {"k": 0}] done'
      ELSE 'no json ' || CAST(event_id AS VARCHAR) END AS resp FROM events),
c AS (
  SELECT event_id, coalesce(nullif(regexp_extract(resp, '(?s)```(?:json)?\\s*([\\[{].*?[\\]}])\\s*```', 1), ''), resp) AS cand
  FROM r),
v AS (
  SELECT event_id, CASE WHEN json_valid(cand) THEN cand
                        WHEN json_valid(regexp_extract(cand, '(?s)(\\[.*\\])', 1)) THEN regexp_extract(cand, '(?s)(\\[.*\\])', 1)
                        WHEN json_valid(regexp_extract(cand, '(?s)(\\{.*\\})', 1)) THEN regexp_extract(cand, '(?s)(\\{.*\\})', 1)
                   END AS j FROM c)
SELECT event_id, lower(json_type(j::JSON)) AS kind,
       CAST(coalesce(json_extract(j::JSON, '$.k'), json_extract(j::JSON, '$[0].k')) AS INTEGER) AS k
FROM v""")
def q_lenient_json(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "props")
    eid, props = F.col("event_id"), F.col("props")
    resp = (F.when(eid % 4 == 0, F.concat(F.lit("Here you go:\n```json\n"), props, F.lit("\n```")))
            .when(eid % 4 == 1, F.concat(F.lit("Sure! "), props, F.lit(" hope this helps")))
            .when(eid % 4 == 2, F.concat(F.lit("list: ["), props, F.lit(', {"k": 0}] done')))
            .otherwise(F.concat(F.lit("no json "), eid.cast("string"))))
    v = ev.select("event_id", tx.lenient_json(resp).alias("v"))
    is_arr = F.try_variant_get(F.col("v"), "$[0]", "variant").isNotNull()
    kind = F.when(F.col("v").isNull(), F.lit(None)).when(is_arr, F.lit("array")).otherwise(F.lit("object"))
    k = F.coalesce(F.try_variant_get(F.col("v"), "$.k", "int"), F.try_variant_get(F.col("v"), "$[0].k", "int"))
    return v.select("event_id", kind.alias("kind"), k.alias("k"))


SEND_DAYS = (0, 2, 4)  # Mon, Wed, Fri
SEND_TZ = "America/New_York"


@register(sql=f"""
SELECT event_id, CAST(isodow(timezone('{SEND_TZ}', ts AT TIME ZONE 'UTC')) - 1 AS INTEGER) AS weekday,
       (isodow(timezone('{SEND_TZ}', ts AT TIME ZONE 'UTC')) - 1) IN {SEND_DAYS} AS send_day,
       strftime(timezone('{SEND_TZ}', ts AT TIME ZONE 'UTC'), '%Y-%m-%d') AS local_date
FROM events""")
def q_send_calendar(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "ts")
    epoch = F.unix_timestamp("ts")
    wd = tx.weekday_in_zone(epoch, SEND_TZ)
    local = F.date_format(F.from_utc_timestamp(F.col("ts"), SEND_TZ), "yyyy-MM-dd")
    return ev.select("event_id", wd.alias("weekday"), wd.isin(*SEND_DAYS).alias("send_day"), local.alias("local_date"))

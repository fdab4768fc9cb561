"""DuckDB oracle SQL: the same fixture views and queries written independently
as plain SQL over the pre-registered driver tables.

RE2 (DuckDB) has ASCII ``\\b``/``\\w`` where the engine uses Unicode classes, so
the oracle folds Latin letters outside ASCII to ``z`` before matching.
"""

from __future__ import annotations

from .. import NOW
from ..functions.lexicon import compile_terms
from ..functions.lexicons import FIXTURE_DOMAINS, FIXTURE_PAIN


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def hits_sql(text: str, terms: list[str]) -> str:
    pat = q(compile_terms(terms, flags="(?i)"))
    return f"len(list_distinct(list_transform(regexp_extract_all({text}, {pat}, 0), lambda x: lower(x))))"


FOLD = "regexp_replace({t}, '[À-ÖØ-öø-ɏ]', 'z', 'g')"

RAW_SIGNAL = f"""
raw_signal AS (
  SELECT doc_id AS id, source, CAST(doc_id AS VARCHAR) AS external_id,
         'u/' || doc_id AS url, 'doc ' || doc_id AS title, text, lang,
         CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'a' || (doc_id % 37) END AS author,
         CAST(CASE WHEN doc_id % 17 = 0 THEN 0 ELSE {NOW} - ((doc_id * 7919) % 900) * 86400 END AS BIGINT) AS created_utc
  FROM documents)"""


def _domain_struct(text: str) -> str:
    parts = [f"{hits_sql(text, terms)} AS \"{d}\"" for d, terms in FIXTURE_DOMAINS.items()]
    return ", ".join(parts)


def _best_domain_sql() -> str:
    # argmax with ties to the earliest declared domain
    names = list(FIXTURE_DOMAINS)
    cands = ", ".join(f"({q(d)}, \"{d}\", {i})" for i, d in enumerate(names))
    return cands


GATED = f"""
pre AS (
  SELECT *, {FOLD.format(t='text')} AS ftext FROM raw_signal
  WHERE length(text) >= 220),
pained AS (
  SELECT *, {hits_sql('ftext', FIXTURE_PAIN)} AS pain FROM pre),
scored AS (
  SELECT *, {_domain_struct("(title || chr(10) || ftext)")} FROM pained WHERE pain >= 2),
ranked AS (
  SELECT s.*, b.domain, b.domain_hits FROM scored s,
  LATERAL (SELECT CASE WHEN hits > 0 THEN d END AS domain, CAST(hits AS INTEGER) AS domain_hits
           FROM (VALUES {_best_domain_sql()}) AS v(d, hits, ord)
           ORDER BY hits DESC, ord LIMIT 1) b),
gated AS (
  SELECT id, source, external_id, url, title, text, lang, author, created_utc,
         CAST(pain AS INTEGER) AS pain, domain, domain_hits
  FROM ranked WHERE domain_hits >= 2)"""

SIGNAL = f"""{RAW_SIGNAL},{GATED},
weights AS (
  SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 0.0 WHEN quality = 1 THEN 1.8 ELSE 0.6 END AS weight
  FROM labels),
signal AS (
  SELECT g.*, w.weight FROM gated g LEFT JOIN weights w USING (id)),
members AS (
  SELECT s.lang || '-' || CAST(e.label AS VARCHAR) AS theme, e.vec_id AS id
  FROM embeddings e JOIN signal s ON e.vec_id = s.id),
used AS (SELECT id FROM signal WHERE id % 2 = 0)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


EVIDENCE_CTE = f"""
mrows AS (
  SELECT m.theme, s.* FROM members m JOIN signal s USING (id)),
voice AS (
  SELECT theme, source, CASE WHEN coalesce(author, '') = '' THEN '<anon>' ELSE author END AS voice,
         max(exp(-greatest(0.0, ({NOW} - created_utc) / 86400.0) / 180.0)) AS w
  FROM mrows WHERE created_utc IS NOT NULL AND created_utc <> 0
  GROUP BY 1, 2, 3),
per_source AS (SELECT theme, source, sum(w) AS v, max(w) AS m FROM voice GROUP BY 1, 2),
evid AS (
  SELECT t.theme, coalesce(e.evidence, 0.0) AS evidence
  FROM (SELECT DISTINCT theme FROM mrows) t
  LEFT JOIN (SELECT theme, sum(v) * (0.5 + 0.5 * sum(m) / max(m)) AS evidence FROM per_source GROUP BY 1) e
  USING (theme)),
tkeys AS (
  SELECT theme, substr(sha1(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)), 1, 16) AS theme_key,
         count(*) AS size
  FROM mrows GROUP BY 1),
dom_counts AS (
  SELECT theme, domain, count(*) AS n, min(id) AS first_id FROM mrows
  WHERE domain IS NOT NULL GROUP BY 1, 2),
plural AS (
  SELECT theme, domain FROM (
    SELECT *, row_number() OVER (PARTITION BY theme ORDER BY n DESC, first_id) AS rn FROM dom_counts)
  WHERE rn = 1),
tweight AS (
  SELECT theme, avg(coalesce(nullif(weight, 0.0), 1.0)) AS weight FROM mrows GROUP BY 1),
themes AS (
  SELECT k.theme, k.theme_key, k.size, e.evidence, p.domain, w.weight
  FROM tkeys k JOIN evid e USING (theme) LEFT JOIN plural p USING (theme) JOIN tweight w USING (theme)
  WHERE k.size >= 2)"""


REPLIES = """
replies AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS message_id, conv_id, turn,
         CASE turn % 4 WHEN 0 THEN 'Re: ideas — ' || text WHEN 1 THEN 'RE: Fwd: prep - 7 due'
              WHEN 2 THEN 'aw:sv: ' || text ELSE text END AS subject,
         text || CASE WHEN turn % 3 = 0 THEN ' solved in ' || CAST(conv_id % 90 + 1 AS VARCHAR) || 'm' ELSE '' END
              || CASE WHEN turn % 7 = 2 THEN chr(10) || 'stop ideas' ELSE '' END
              || CASE conv_id % 6
                   WHEN 0 THEN chr(10) || chr(10) || 'On Mon, 17 Aug 2026 at 07:03, ideas wrote:' || chr(10) || '> earlier digest text'
                   WHEN 1 THEN chr(10) || '--- reply above this line ---' || chr(10) || 'name it first, one per line'
                   WHEN 2 THEN chr(10) || chr(10) || 'Sent from my phone'
                   WHEN 3 THEN chr(10) || chr(10) || '-----Original Message-----' || chr(10) || 'From: ideas <ideas@example.org>' || chr(10)
                   WHEN 4 THEN chr(10) || 'reply above this line. name it first.'
                   ELSE '' END AS body
  FROM conversations WHERE role = 'user')"""

TOP_CTE = """
reuse AS (
  SELECT m.theme, count(u.id) AS n_used FROM members m LEFT JOIN (SELECT DISTINCT id FROM used) u USING (id)
  GROUP BY 1),
elig AS (
  SELECT t.*, coalesce(r.n_used, 0) / greatest(t.size, 1) AS reused, t.evidence * t.weight AS score
  FROM themes t LEFT JOIN reuse r USING (theme)
  WHERE t.domain IS NOT NULL AND coalesce(r.n_used, 0) / greatest(t.size, 1) <= 0.5),
best AS (
  SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, theme_key) AS rn FROM elig),
top AS (SELECT * FROM best WHERE rn = 1)"""

PACKET_CTE = """
themed AS (
  SELECT t.domain, s.id, s.url, s.title, s.text, t.theme_key,
         row_number() OVER (PARTITION BY t.domain ORDER BY s.pain * 2 + s.domain_hits DESC, s.id) AS rank
  FROM top t JOIN members m USING (theme) JOIN signal s USING (id)),
themed14 AS (SELECT * FROM themed WHERE rank <= 14),
ntheme AS (SELECT domain, count(*) AS n_theme, any_value(theme_key) AS tk FROM themed14 GROUP BY 1),
fresh AS (
  SELECT s.*, row_number() OVER (PARTITION BY domain ORDER BY pain * 2 + domain_hits DESC, created_utc DESC, id) AS rank
  FROM signal s WHERE domain IS NOT NULL AND id NOT IN (SELECT id FROM used)),
tier0 AS (
  SELECT th.domain, th.id, th.url, th.title, th.text, 0 AS tier, th.rank, n.tk AS theme_key
  FROM themed14 th JOIN ntheme n USING (domain) WHERE n.n_theme >= 2),
tier1 AS (
  SELECT f.domain, f.id, f.url, f.title, f.text, 1 AS tier, f.rank, n.tk AS theme_key
  FROM fresh f LEFT JOIN ntheme n ON n.domain = f.domain AND n.n_theme >= 2
  WHERE f.rank <= 14 AND NOT EXISTS (SELECT 1 FROM tier0 t WHERE t.domain = f.domain AND t.url = f.url)),
allrows AS (SELECT * FROM tier0 UNION ALL SELECT * FROM tier1),
packet_rows AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY tier, rank) AS pos FROM allrows)
  WHERE pos <= 14),
packets AS (
  SELECT domain, any_value(theme_key) AS theme_key, count(*) AS n_rows, count(*) < 4 AS starved,
         string_agg('--- [' || CAST(pos AS VARCHAR) || '] ' || url || chr(10) || 'thread: ' || title || chr(10) || chr(10)
                    || left(text, 1600), chr(10) || chr(10) ORDER BY pos) AS packet,
         list(url ORDER BY pos) AS urls
  FROM packet_rows GROUP BY domain)"""

VERDICT_LOG = """
vlog AS (
  SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS idea_id,
         CASE event_type WHEN 'signup' THEN 'building' WHEN 'purchase' THEN 'more' WHEN 'click' THEN 'too_easy'
                         WHEN 'view' THEN 'exists' WHEN 'error' THEN 'boring' END AS verdict,
         CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id AS message_id
  FROM events)"""

REVIEW_LOG = """
rlog AS (
  SELECT user_id AS learner_id, 'd' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 2 AS VARCHAR) AS deck,
         'c' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS VARCHAR) AS card_id,
         CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 END AS rating,
         CAST(floor(epoch(ts)) AS BIGINT) AS review_utc, event_id AS seq
  FROM events WHERE event_type <> 'signup'),
rev AS (
  SELECT learner_id, deck, card_id, count(*) AS reps, count(*) FILTER (WHERE rating = 1) AS fails,
         greatest(count(*) FILTER (WHERE rating = 1) - 1, 0) AS lapses, max(review_utc) AS last_utc,
         max(review_utc) + 86400 * (count(*) - 2 * count(*) FILTER (WHERE rating = 1)) AS due_utc
  FROM rlog GROUP BY 1, 2, 3)"""

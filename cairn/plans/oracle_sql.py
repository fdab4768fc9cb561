"""Oracle SQL per registered query (DuckDB dialect, driver tables as views)."""

from __future__ import annotations

from ..functions.lexicons import FIXTURE_DOMAINS
from .oracle import EVIDENCE_CTE, FOLD, RAW_SIGNAL, SIGNAL, hits_sql, q, with_

from .registry import SQL

_dom_cols = ", ".join(f"CAST({hits_sql(FOLD.format(t='text'), t)} AS BIGINT) AS \"{d}\""
                      for d, t in FIXTURE_DOMAINS.items())
SQL["domain_scores"] = with_(RAW_SIGNAL) + f" SELECT id, {_dom_cols} FROM raw_signal"

_both = FOLD.format(t="(title || chr(10) || text)")
_cands = ", ".join(f"({q(d)}, {hits_sql(_both, t)}, {i})" for i, (d, t) in enumerate(FIXTURE_DOMAINS.items()))
SQL["best_domain"] = with_(RAW_SIGNAL) + f"""
SELECT r.id, b.domain, b.domain_hits FROM raw_signal r,
LATERAL (SELECT CASE WHEN h > 0 THEN d END AS domain, CAST(h AS BIGINT) AS domain_hits
         FROM (VALUES {_cands}) v(d, h, o) ORDER BY h DESC, o LIMIT 1) b"""

SQL["harvest_gate"] = with_(SIGNAL) + """
SELECT id, source, domain, CAST(domain_hits AS BIGINT) AS domain_hits, CAST(pain AS BIGINT) AS pain FROM signal"""

SQL["noise_filter"] = with_(RAW_SIGNAL) + """
SELECT id, (strpos(lower(text), 'is the') > 0
         OR strpos(lower(text), 'la de') > 0
         OR strpos(lower(text), 'und die') > 0) AS is_noise
FROM raw_signal"""

SQL["evidence_score"] = with_(SIGNAL, EVIDENCE_CTE) + " SELECT theme, round(evidence, 6) AS evidence FROM evid"
SQL["plurality_domain"] = with_(SIGNAL, EVIDENCE_CTE) + """
SELECT t.theme, p.domain FROM (SELECT DISTINCT theme FROM mrows) t LEFT JOIN plural p USING (theme)"""
SQL["theme_weight"] = with_(SIGNAL, EVIDENCE_CTE) + " SELECT theme, round(weight, 6) AS weight FROM tweight"
SQL["theme_keys"] = with_(SIGNAL, EVIDENCE_CTE) + " SELECT theme, theme_key, size FROM tkeys"

SQL["top_theme"] = with_(SIGNAL, EVIDENCE_CTE) + """,
reuse AS (
  SELECT m.theme, count(u.id) AS n_used FROM members m LEFT JOIN (SELECT DISTINCT id FROM used) u USING (id)
  GROUP BY 1),
elig AS (
  SELECT t.*, coalesce(r.n_used, 0) / greatest(t.size, 1) AS reused, t.evidence * t.weight AS score
  FROM themes t LEFT JOIN reuse r USING (theme)
  WHERE t.domain IS NOT NULL AND coalesce(r.n_used, 0) / greatest(t.size, 1) <= 0.5),
best AS (
  SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, theme_key) AS rn FROM elig)
SELECT domain, theme_key, size, round(evidence, 6) AS evidence, round(weight, 6) AS weight,
       round(reused, 6) AS reused, round(score, 6) AS score
FROM best WHERE rn = 1"""

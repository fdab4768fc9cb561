"""Registered queries for evidence selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lexicons import FIXTURE_DOMAINS
from ..operators import evidence as ev
from ..operators import selection as sel
from ..operators.util import materialize
from . import fixtures as fx
from .oracle import EVIDENCE_CTE, PACKET_CTE, SIGNAL, TOP_CTE, with_
from .registry import register


def packet_inputs(spark, sf):
    sig, mem, th = fx.theme_tables(spark, sf)
    used = fx.used_ids(sig)
    # a few rows a domain, which several plans read: written once, like the themes
    top = materialize(ev.top_theme_per_domain(th, mem, used), "top-themes")
    rows = materialize(sel.gather_evidence(top, mem, sig, used), "packet-rows")
    return sig, mem, used, top, rows


@register(sql=with_(SIGNAL) + """,
fresh AS (
  SELECT s.*, row_number() OVER (PARTITION BY domain ORDER BY pain * 2 + domain_hits DESC, created_utc DESC, id) AS rank
  FROM signal s WHERE domain IS NOT NULL AND id NOT IN (SELECT id FROM used))
SELECT domain, id, rank FROM fresh WHERE rank <= 14""")
def q_unused_evidence(spark, sf):
    sig = fx.signal(spark, sf)
    out = sel.unused_evidence(sig, fx.used_ids(sig))
    return out.select("domain", "id", F.col("rank").cast("long").alias("rank"))


@register(sql=with_(SIGNAL, EVIDENCE_CTE, TOP_CTE, PACKET_CTE) + """
SELECT domain, theme_key, n_rows, starved, packet FROM packets""")
def q_evidence_packet(spark, sf):
    _, _, _, _, rows = packet_inputs(spark, sf)
    return sel.evidence_packet(rows).drop("urls")


ROTATION_CURSOR = 3
_ROT_VALUES = ", ".join(f"('{d}', {i})" for i, d in enumerate(FIXTURE_DOMAINS))


def _slots(spark, packets):
    """Outcome per rotation slot: starved (packet < 4 rows or none), shipped when
    the packet is theme-based, rejected otherwise."""
    rot = spark.createDataFrame([(d, i) for i, d in enumerate(FIXTURE_DOMAINS)], "domain string, ord int")
    p = packets.select("domain", "n_rows", "theme_key")
    outcome = (F.when(F.coalesce(F.col("n_rows"), F.lit(0)) < 4, F.lit("starved"))
               .when(F.col("theme_key").isNotNull(), F.lit("shipped")).otherwise(F.lit("rejected")))
    return rot.join(p, "domain", "left").select(F.lit(1).alias("run_id"), "ord", "domain", outcome.alias("outcome"))


@register(sql=with_(SIGNAL, EVIDENCE_CTE, TOP_CTE, PACKET_CTE) + f""",
rot AS (SELECT * FROM (VALUES {_ROT_VALUES}) v(domain, ord)),
slots AS (
  SELECT r.domain, r.ord, CASE WHEN coalesce(p.n_rows, 0) < 4 THEN 'starved'
                               WHEN p.theme_key IS NOT NULL THEN 'shipped' ELSE 'rejected' END AS outcome,
         ((r.ord - {ROTATION_CURSOR}) % {len(FIXTURE_DOMAINS)} + {len(FIXTURE_DOMAINS)}) % {len(FIXTURE_DOMAINS)} AS step
  FROM rot r LEFT JOIN packets p USING (domain)),
acc AS (
  SELECT *, coalesce(sum(CAST(outcome = 'shipped' AS INTEGER)) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shipped_before,
            coalesce(sum(CAST(outcome <> 'starved' AS INTEGER)) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gens_before
  FROM slots),
vis AS (SELECT *, shipped_before < 3 AND gens_before < 5 AS visited FROM acc)
SELECT domain, outcome, CAST(step AS INTEGER) AS step, visited,
       CAST({ROTATION_CURSOR} + sum(CAST(visited AS INTEGER)) OVER () AS BIGINT) AS next_cursor
FROM vis""")
def q_domain_rotation(spark, sf):
    _, _, _, _, rows = packet_inputs(spark, sf)
    slots = _slots(spark, sel.evidence_packet(rows))
    out = sel.domain_rotation(slots, ROTATION_CURSOR, len(FIXTURE_DOMAINS))
    return out.select("domain", "outcome", F.col("step").cast("int").alias("step"), "visited",
                      F.col("next_cursor").cast("long").alias("next_cursor"))


def candidates_from_signal(sig):
    """Candidate ideas, one per signal: cites itself, its two successors (the first
    one twice) and one fabricated url."""
    u = lambda off: F.concat(F.lit("u/"), (F.col("id") + off).cast("string"))
    refs = F.array(u(0), u(1), u(2), u(1), F.concat(F.lit("x/"), F.col("id").cast("string")))
    return sig.select(F.col("id").alias("candidate_id"), "domain", refs.alias("evidence_refs"))


@register(sql=with_(SIGNAL, EVIDENCE_CTE, TOP_CTE, PACKET_CTE) + """,
cands AS (
  SELECT id AS candidate_id, domain,
         ['u/' || CAST(id AS VARCHAR), 'u/' || CAST(id + 1 AS VARCHAR), 'u/' || CAST(id + 2 AS VARCHAR),
          'u/' || CAST(id + 1 AS VARCHAR), 'x/' || CAST(id AS VARCHAR)] AS refs
  FROM signal),
k AS (
  SELECT c.candidate_id, c.domain, len(c.refs) AS n_cited,
         list_filter(c.refs, lambda u: list_contains(coalesce(p.urls, []::VARCHAR[]), u)) AS kept
  FROM cands c LEFT JOIN packets p USING (domain))
SELECT candidate_id, domain, CAST(n_cited AS INTEGER) AS n_cited, kept, CAST(len(kept) AS INTEGER) AS n_kept,
       len(kept) >= 2 AS grounded
FROM k""")
def q_citation_grounding(spark, sf):
    sig, _, _, _, rows = packet_inputs(spark, sf)
    packets = sel.evidence_packet(rows)
    return sel.citation_grounding(candidates_from_signal(sig), packets)

@register(sql=with_(SIGNAL, EVIDENCE_CTE, TOP_CTE, PACKET_CTE) + """,
cands AS (
  SELECT id AS candidate_id, domain,
         ['u/' || CAST(id AS VARCHAR), 'u/' || CAST(id + 1 AS VARCHAR), 'u/' || CAST(id + 2 AS VARCHAR),
          'u/' || CAST(id + 1 AS VARCHAR), 'x/' || CAST(id AS VARCHAR)] AS refs
  FROM signal),
k AS (
  SELECT c.candidate_id, c.domain, list_filter(c.refs, lambda u: list_contains(coalesce(p.urls, []::VARCHAR[]), u)) AS kept
  FROM cands c LEFT JOIN packets p USING (domain)),
cited AS (SELECT DISTINCT domain, unnest(kept) AS url FROM k WHERE len(kept) >= 2)
SELECT r.domain, r.id, r.url FROM packet_rows r JOIN cited USING (domain, url)""")
def q_consumed_signals(spark, sf):
    """C10 consumption: the packet rows that grounded candidates cited are spent, the others are not."""
    sig, _, _, _, rows = packet_inputs(spark, sf)
    grounded = sel.citation_grounding(candidates_from_signal(sig), sel.evidence_packet(rows))
    return sel.consumed_signals(grounded, rows).select("domain", "id", "url")

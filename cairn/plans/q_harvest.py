"""Registered queries for the harvest side."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import NOW
from ..functions.lexicons import FIXTURE_DOMAINS
from ..operators import harvest as hv
from ..session import checkpoint_dir
from ..sources.tables import table
from . import fixtures as fx
from .oracle import FOLD, RAW_SIGNAL, SIGNAL, hits_sql, q, with_
from .registry import register

# fixture probes: (query, phrase?) in plan order
PROBES = [("de la", True), ("for the", True), ("in the", True), ("und die", False), ("the and", False),
          ("les pour", False)]
SINCE = NOW - 540 * 86400


def _probes(spark):
    return spark.createDataFrame([(i, qq, p) for i, (qq, p) in enumerate(PROBES)], "probe_ord int, query string, phrase boolean")


_PVALUES = ", ".join(f"({i}, {q(qq)}, {str(p).lower()})" for i, (qq, p) in enumerate(PROBES))
PROBE_SQL = with_(RAW_SIGNAL) + f""",
pr AS (SELECT * FROM (VALUES {_PVALUES}) v(probe_ord, query, phrase)),
d AS (SELECT id AS doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> '') AS toks
      FROM raw_signal WHERE created_utc > {SINCE}),
hits AS (
  SELECT d.doc_id, pr.probe_ord, pr.query FROM d, pr
  WHERE (NOT pr.phrase AND list_has_all(d.toks, string_split(pr.query, ' ')))
     OR (pr.phrase AND strpos(' ' || array_to_string(d.toks, ' ') || ' ', ' ' || pr.query || ' ') > 0))"""


@register(sql=PROBE_SQL + " SELECT doc_id, probe_ord, query FROM hits")
def q_probe_match(spark, sf):
    docs = fx.raw_signal(spark, sf).select(F.col("id").alias("doc_id"), "text", "created_utc")
    return hv.probe_match(docs, _probes(spark), SINCE)


@register(sql=PROBE_SQL + """,
batch AS (SELECT r.source, r.external_id, h.probe_ord, h.query FROM hits h JOIN raw_signal r ON r.id = h.doc_id),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, external_id ORDER BY probe_ord) AS rn
                          FROM batch) WHERE rn = 1),
existing AS (SELECT source, external_id FROM raw_signal WHERE CAST(substr(source, 4) AS INTEGER) < 10)
SELECT f.source, f.external_id, f.probe_ord, f.query FROM firsts f
WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.source = f.source AND e.external_id = f.external_id)""")
def q_idempotent_append(spark, sf):
    """Probe hits as one harvest batch (a document surfaced by several probes is
    several rows; the first probe in plan order wins), minus keys already stored
    (the corpus of sources src0-src9)."""
    raw = fx.raw_signal(spark, sf)
    hits = hv.probe_match(raw.select(F.col("id").alias("doc_id"), "text", "created_utc"), _probes(spark), SINCE)
    batch = hits.join(raw.select(F.col("id").alias("doc_id"), "source", "external_id"), "doc_id").select(
        "source", "external_id", "probe_ord", "query")
    existing = raw.filter(F.substring("source", 4, 10).cast("int") < 10).select("source", "external_id")
    return hv.idempotent_append(existing, batch, ["source", "external_id"], [F.col("probe_ord")])


@register(sql="""
SELECT o_orderkey, o_custkey, o_totalprice,
       CASE WHEN year(o_orderdate) < 1995 THEN 'unknown' ELSE o_orderpriority END AS o_orderpriority,
       CASE WHEN year(o_orderdate) < 1995 THEN 1 ELSE 2 END AS schema_version
FROM orders""")
def q_schema_evolution(spark, sf):
    """Rows written before a column existed (pre-1995 orders, without
    o_orderpriority) unioned by name with current rows; the new column gets its
    declared default."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    old = o.filter(F.year("o_orderdate") < 1995).select("o_orderkey", "o_custkey", "o_totalprice",
                                                        F.lit(1).alias("schema_version"))
    new = o.filter(F.year("o_orderdate") >= 1995).select("o_orderkey", "o_custkey", "o_totalprice",
                                                         "o_orderpriority", F.lit(2).alias("schema_version"))
    return hv.evolve(old.unionByName(new, allowMissingColumns=True), {"o_orderpriority": "unknown"}).select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "schema_version")


@register(sql=with_(SIGNAL) + """
SELECT r.source, count(g.id) AS kept, count(*) - count(g.id) AS dropped
FROM raw_signal r LEFT JOIN gated g USING (id) GROUP BY r.source""")
def q_kept_dropped(spark, sf):
    """Per-source kept / dropped counts of the harvest gate."""
    raw = fx.raw_signal(spark, sf)
    kept = fx.signal(spark, sf).select("id", F.lit(True).alias("k"))
    x = raw.join(kept, "id", "left")
    return hv.kept_dropped(x, "source", F.coalesce(F.col("k"), F.lit(False)))


@register(sql=with_(RAW_SIGNAL) + """
SELECT id, source, CASE WHEN CAST(substr(source, 4) AS INTEGER) < 7 THEN 0
                        WHEN CAST(substr(source, 4) AS INTEGER) < 14 THEN 1 ELSE 3 END AS source_ord
FROM raw_signal""")
def q_source_union(spark, sf):
    """A4: three feeds (sources 0-6, 7-13, 14 and on) unioned in plan order; a fourth, third in
    the plan, has no landed folder: its load fails, and all rows of the others come out."""
    raw = fx.raw_signal(spark, sf).select("id", "source")
    n = F.substring("source", 4, 10).cast("int")
    feeds = {"feed_a": lambda: raw.filter(n < 7), "feed_b": lambda: raw.filter((n >= 7) & (n < 14)),
             "lost": lambda: spark.read.parquet(f"{sf}/feed_that_never_landed.parquet"),
             "feed_c": raw.filter(n >= 14)}
    return hv.union_sources(feeds, ["feed_a", "feed_b", "lost", "feed_c"]).select("id", "source", "source_ord")


@register(sql=with_(RAW_SIGNAL) + f"""
SELECT id, ({" + ".join(hits_sql(FOLD.format(t="(title || chr(10) || text)"), t) for t in FIXTURE_DOMAINS.values())}) >= 2 AS technical
FROM raw_signal""")
def q_technical(spark, sf):
    """Is-technical = the sum of all domain scores reaches two."""
    from ..functions import lexicon as lx
    raw = fx.raw_signal(spark, sf)
    both = F.concat_ws("\n", "title", "text")
    s = raw.select("id", F.inline(F.array(F.struct(lx.domain_scores(both, FIXTURE_DOMAINS).alias("s")))))
    return s.select("id", lx.is_technical(F.col("s"), FIXTURE_DOMAINS).alias("technical"))

SOURCES = [f"src{i}" for i in range(18)]      # the declared plan; rows of other sources count together


@register(sql=with_(SIGNAL) + f""",
flags AS (SELECT CASE WHEN r.source IN ({", ".join(q(s) for s in SOURCES)}) THEN r.source ELSE '' END AS source,
                 g.id IS NOT NULL AS kept, r.id % 3 <> 0 AS fresh
          FROM raw_signal r LEFT JOIN gated g ON g.id = r.id),
plan AS (SELECT unnest([{", ".join(q(s) for s in [*SOURCES, ""])}]) AS source)
SELECT p.source, count(f.source) FILTER (WHERE kept) AS kept, count(f.source) FILTER (WHERE NOT kept) AS dropped,
       count(f.source) FILTER (WHERE kept AND fresh) AS new
FROM plan p LEFT JOIN flags f ON f.source = p.source GROUP BY 1""")
def q_append_counts(spark, sf):
    """Kept, dropped and new rows per declared source, observed by the job that appends them (every third id was
    stored before)."""
    raw = fx.raw_signal(spark, sf).select("id", "source", "external_id")
    kept = fx.signal(spark, sf).select("id", F.lit(True).alias("k"))
    stored = raw.filter("id % 3 = 0").select("source", "external_id", F.lit(True).alias("s"))
    rows = (raw.join(kept, "id", "left").join(stored, ["source", "external_id"], "left")
            .select("id", "source", "external_id", F.coalesce("k", F.lit(False)).alias("kept"), F.col("s").isNull().alias("new")))
    path = f"{checkpoint_dir(spark).rstrip('/')}/appended-{uuid.uuid4().hex}"
    counts = hv.append_counted(rows, path, "source", SOURCES)
    return spark.createDataFrame(counts, "source string, kept long, dropped long, new long")

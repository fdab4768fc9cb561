"""Registered queries: (spark, sf_dir) -> DataFrame over the driver tables.

Every computed column is aliased to the same name as in ``oracle_sql``; floats are
rounded to 6 places on both sides; integer outputs are 64-bit.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import NOW
from ..functions import lexicon as lx
from ..functions.lexicons import FIXTURE_DOMAINS
from ..operators import evidence as ev
from ..operators.util import round6
from . import fixtures as fx

from .registry import QUERIES, SQL, register  # noqa: F401


FIXTURE_NOISE = ["is the", "la de", "und die"]


@register
def q_domain_scores(spark, sf):
    raw = fx.raw_signal(spark, sf)
    s = lx.domain_scores(F.col("text"), FIXTURE_DOMAINS)
    return raw.select("id", F.inline(F.array(s))).select(
        "id", *[F.col(d).cast("long").alias(d) for d in FIXTURE_DOMAINS])


@register
def q_best_domain(spark, sf):
    raw = fx.raw_signal(spark, sf)
    both = F.concat_ws("\n", "title", "text")
    scored = raw.select("id", F.inline(F.array(F.struct(lx.domain_scores(both, FIXTURE_DOMAINS).alias("s")))))
    b = lx.best_domain(F.col("s"), FIXTURE_DOMAINS)
    return scored.select("id", b["domain"].alias("domain"), b["hits"].cast("long").alias("domain_hits"))


@register
def q_harvest_gate(spark, sf):
    sig = fx.signal(spark, sf)
    return sig.select("id", "source", "domain", F.col("domain_hits").cast("long").alias("domain_hits"),
                      F.col("pain").cast("long").alias("pain"))


@register
def q_noise_filter(spark, sf):
    raw = fx.raw_signal(spark, sf)
    return raw.select("id", lx.is_noise_title(F.col("text"), FIXTURE_NOISE).alias("is_noise"))


def _rows(spark, sf):
    sig = fx.signal(spark, sf)
    mem = fx.members(spark, sf, sig)
    rows = mem.join(sig.select("id", "source", "author", "created_utc", "domain", "weight"), "id")
    return sig, mem, rows


@register
def q_evidence_score(spark, sf):
    _, _, rows = _rows(spark, sf)
    return ev.evidence_score(rows, NOW).select("theme", round6(F.col("evidence")).alias("evidence"))


@register
def q_plurality_domain(spark, sf):
    _, _, rows = _rows(spark, sf)
    return ev.plurality_domain(rows)


@register
def q_theme_weight(spark, sf):
    _, _, rows = _rows(spark, sf)
    return ev.theme_weight(rows).select("theme", round6(F.col("weight")).alias("weight"))


@register
def q_theme_keys(spark, sf):
    _, mem, _ = _rows(spark, sf)
    return ev.theme_keys(mem)


def themes(spark, sf):
    return fx.theme_tables(spark, sf)


@register
def q_top_theme(spark, sf):
    sig, mem, th = themes(spark, sf)
    top = ev.top_theme_per_domain(th, mem, fx.used_ids(sig))
    return top.select("domain", "theme_key", "size", round6(F.col("evidence")).alias("evidence"),
                      round6(F.col("weight")).alias("weight"), round6(F.col("reused")).alias("reused"),
                      round6(F.col("score")).alias("score"))

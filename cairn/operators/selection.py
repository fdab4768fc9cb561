"""Evidence selection: theme evidence (D1), unused evidence (D3/F2), evidence
gathering with top-up (F3), the evidence packet (B17), domain rotation (F11)
and citation grounding (C10).

Every "ORDER BY ... LIMIT k per key" of the reference is one keyed window with a
total order (ties broken by id), so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EVIDENCE_PER_IDEA = 14
MIN_EVIDENCE = 4
def STRENGTH_COL():
    return F.col("pain") * 2 + F.col("domain_hits")


def theme_evidence(top: DataFrame, members: DataFrame, signal: DataFrame, k: int = EVIDENCE_PER_IDEA) -> DataFrame:
    """The chosen theme's members joined to their signals, strongest first
    (pain*2 + domain_hits desc, id asc), first ``k``."""
    rows = (top.select("domain", "theme", "theme_key").join(members.select("theme", "id"), "theme")
            .join(signal.drop("domain"), "id"))
    w = Window.partitionBy("domain").orderBy(STRENGTH_COL().desc(), F.col("id"))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def unused_evidence(signal: DataFrame, used_ids: DataFrame, k: int = EVIDENCE_PER_IDEA) -> DataFrame:
    """D3 + F2: per domain, signals never cited before (null-safe anti join),
    strongest first, newest first on ties, then id; first ``k``."""
    fresh = signal.filter(F.col("domain").isNotNull()).join(used_ids.select("id"), "id", "left_anti")
    w = Window.partitionBy("domain").orderBy(STRENGTH_COL().desc(), F.col("created_utc").desc(), F.col("id"))
    return fresh.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def gather_evidence(top: DataFrame, members: DataFrame, signal: DataFrame, used_ids: DataFrame,
                    k: int = EVIDENCE_PER_IDEA) -> DataFrame:
    """the best theme's first ``k`` rows; when it has at least two, pad to ``k``
    with unused domain evidence whose url is not already present; otherwise the
    unused domain evidence alone. Output rows carry ``pos`` (1-based packet order)
    and ``theme_key`` (NULL when the packet is not theme-based)."""
    cols = ["domain", "id", "url", "title", "text", "pain", "domain_hits", "created_utc", "source"]
    themed = theme_evidence(top, members, signal, k)
    n_theme = themed.groupBy("domain").agg(F.count("*").alias("n_theme"), F.first("theme_key").alias("tk"))
    themed = (themed.join(n_theme.filter(F.col("n_theme") >= 2), "domain")
              .select(*cols, F.lit(0).alias("tier"), "rank", F.col("tk").alias("theme_key")))
    pad = unused_evidence(signal, used_ids, k).select(*cols, F.lit(1).alias("tier"), "rank")
    pad = (pad.join(themed.select("domain", "url").distinct(), ["domain", "url"], "left_anti")
           .join(n_theme.filter(F.col("n_theme") >= 2).select("domain", F.col("tk").alias("theme_key")),
                 "domain", "left"))
    both = themed.unionByName(pad)
    w = Window.partitionBy("domain").orderBy("tier", "rank")
    return both.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k).drop("tier", "rank")


def evidence_packet(rows: DataFrame, min_rows: int = MIN_EVIDENCE) -> DataFrame:
    """B17 per domain: numbered blocks ``--- [i] url / thread: title / text[:1600]``
    joined by a blank line; packets with fewer than ``min_rows`` rows are starved.
    Packets are bounded (at most ``EVIDENCE_PER_IDEA`` rows), so collecting them
    per domain is safe."""
    block = F.concat(F.lit("--- ["), F.col("pos").cast("string"), F.lit("] "), F.col("url"),
                     F.lit("\nthread: "), F.col("title"), F.lit("\n\n"), F.left("text", F.lit(1600)))
    per = rows.groupBy("domain").agg(
        F.first("theme_key", ignorenulls=True).alias("theme_key"),
        F.count("*").alias("n_rows"),
        F.array_sort(F.collect_list(F.struct("pos", block.alias("block"), "url"))).alias("blocks"))
    return per.select("domain", "theme_key", "n_rows", (F.col("n_rows") < min_rows).alias("starved"),
                      F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n").alias("packet"),
                      F.transform("blocks", lambda b: b["url"]).alias("urls"))


def domain_rotation(slots: DataFrame, cursor: int, n_domains: int, ideas: int = 3,
                    run_key: str = "run_id") -> DataFrame:
    """visit domains from ``cursor`` (mod n); a starved slot advances for free,
    a generated slot (shipped or rejected) counts; stop at ``ideas`` shipped, at
    ``ideas + 2`` generations, or after one lap. ``slots(run_id, ord, domain,
    outcome)`` with outcome in starved / rejected / shipped. Returns each slot's
    visit order and whether it was visited, plus the next cursor per run."""
    step = F.pmod(F.col("ord") - F.lit(cursor), F.lit(n_domains))
    w = Window.partitionBy(run_key).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    shipped_before = F.coalesce(F.sum((F.col("outcome") == "shipped").cast("int")).over(w), F.lit(0))
    gens_before = F.coalesce(F.sum((F.col("outcome") != "starved").cast("int")).over(w), F.lit(0))
    visited = (shipped_before < ideas) & (gens_before < ideas + 2)
    out = slots.select("*", step.alias("step"), visited.alias("visited"))
    # a window, not a join back: the run key can be a constant, and a join on a
    # constant key is planned as a cross product
    return out.withColumn("next_cursor", F.lit(cursor) + F.sum(F.col("visited").cast("int")).over(
        Window.partitionBy(run_key)))


def citation_grounding(candidates: DataFrame, packets: DataFrame, minimum: int = 2) -> DataFrame:
    """Keep cited urls that were supplied in the domain's packet (duplicates
    kept and counted); fewer than ``minimum`` kept -> ungrounded."""
    from .util import bounded_broadcast
    # packets: at most one row per domain (a parameter-sized dimension), size-checked
    j = candidates.join(bounded_broadcast(packets.select("domain", F.col("urls").alias("supplied"))), "domain", "left")
    supplied = F.coalesce(F.col("supplied"), F.array().cast("array<string>"))
    kept = F.filter(F.coalesce("evidence_refs", F.array().cast("array<string>")),
                    lambda u: F.array_contains(supplied, u))
    return j.select("candidate_id", "domain", F.size(F.coalesce("evidence_refs", F.array())).alias("n_cited"),
                    kept.alias("kept"), F.size(kept).alias("n_kept"),
                    (F.size(kept) >= minimum).alias("grounded"))


def consumed_signals(grounded: DataFrame, packet_rows: DataFrame) -> DataFrame:
    """C10 consumption: packet rows whose url a grounded candidate kept."""
    cited = grounded.filter("grounded").select("candidate_id", "domain", F.explode("kept").alias("url")).distinct()
    return packet_rows.select("domain", "id", "url").join(cited, ["domain", "url"], "left_semi")

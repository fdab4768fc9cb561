"""Harvest-side operators: the shared gate (C1), multi-source union (A4), probe
match (A5), idempotent append (A6) and kept/dropped counters (A14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.lexicons import DOMAINS, NOISE_TITLES, PAIN_MARKERS, PHRASE_PROBES, TERM_PROBES

MIN_DOMAIN_HITS = 2
MIN_PAIN = 2
MIN_CHARS = 220


def harvest_gate(df: DataFrame, *, domains: dict[str, list[str]] = DOMAINS,
                 pain_markers: list[str] = PAIN_MARKERS, noise: list[str] = NOISE_TITLES,
                 require_pain: bool = True, min_chars: int = MIN_CHARS,
                 min_pain: int = MIN_PAIN, min_hits: int = MIN_DOMAIN_HITS) -> DataFrame:
    """Keep on-domain, complaint-shaped text and annotate domain / domain_hits / pain.

    Cheapest predicates first: length and noise title are plain filters; the single
    pain regex runs before the per-domain regexes, which therefore only see survivors.
    Domain is scored on ``title \\n text``, pain on ``text`` alone.
    """
    kept = df.filter((F.length("text") >= min_chars) & ~lx.is_noise_title(F.col("title")))
    # Generator output is never pushed below the generator, so each regex score is
    # computed exactly once even though it is used by both a filter and the output.
    kept = kept.select("*", F.inline(F.array(F.struct(lx.pain_score(F.col("text"), pain_markers).alias("pain")))))
    if require_pain:
        kept = kept.filter(F.col("pain") >= min_pain)
    both = F.concat_ws("\n", F.coalesce(F.col("title"), F.lit("")), F.col("text"))
    kept = kept.select("*", F.inline(F.array(F.struct(lx.domain_scores(both, domains).alias("_scores")))))
    best = lx.best_domain(F.col("_scores"), domains)
    kept = (kept.withColumn("domain", best["domain"]).withColumn("domain_hits", best["hits"])
            .drop("_scores"))
    return kept.filter(F.col("domain_hits") >= min_hits)


def annotate_domains(df: DataFrame, text: Column, domains: dict[str, list[str]] = DOMAINS) -> DataFrame:
    """Per-domain score struct plus best domain for every row (no filtering)."""
    scored = df.select("*", F.inline(F.array(F.struct(lx.domain_scores(text, domains).alias("scores")))))
    best = lx.best_domain(F.col("scores"), domains)
    return scored.withColumn("domain", best["domain"]).withColumn("domain_hits", best["hits"])


def union_sources(frames: dict, order: list[str], failed: list[str] | None = None) -> DataFrame:
    """A4: union in declared source order; ``source_ord`` carries the plan order.

    A source is a DataFrame, None (it failed before), or a function that loads one. A load that
    raises an error of Spark's or of the file system is skipped, its name is added to ``failed``,
    and the rest proceed; if nothing is left, ValueError names the sources."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException
    parts, lost = [], []
    for i, name in enumerate(order):
        df = frames.get(name)
        if callable(df):
            try:
                df = df()
            except (PySparkException, Py4JJavaError, OSError):
                df = None
        if df is None:
            lost.append(name)
        else:
            parts.append(df.withColumn("source_ord", F.lit(i)))
    if failed is not None:
        failed.extend(lost)
    if not parts:
        raise ValueError(f"no source could be loaded: {', '.join(lost)}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


TOKEN_SPLIT = r"[^\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda t: t != "")


def probe_table(spark: SparkSession, phrases: list[str] = PHRASE_PROBES, terms: list[str] = TERM_PROBES) -> DataFrame:
    """A5: the probes in plan order, phrases first: (probe_ord, query, phrase)."""
    rows = [(i, p, i < len(phrases)) for i, p in enumerate([*phrases, *terms])]
    return spark.createDataFrame(rows, "probe_ord int, query string, phrase boolean")


def probe_match(docs: DataFrame, probes: DataFrame, since: int) -> DataFrame:
    """A5: which probe surfaces which document (created after ``since``).

    ``probes(probe_ord, query, phrase)``: a term probe matches when every word of
    the query is a token of the text; a phrase probe when its words also appear
    consecutively. Candidates come from an inverted-token equi-join against the
    probe words (a parameter list, broadcast after its size is checked), so hot
    tokens never shuffle the document side; phrase candidates are then verified
    on their own token string. Output: (doc_id, probe_ord, query)."""
    from .util import bounded_broadcast
    recent = docs.filter(F.col("created_utc") > since).select("doc_id", tokens(F.col("text")).alias("toks"))
    words = (probes.select("probe_ord", "query", "phrase",
                           F.array_distinct(F.split(F.lower("query"), " ")).alias("w"))
             .select("probe_ord", "query", "phrase", F.size("w").alias("n_words"), F.explode("w").alias("tok")))
    words = bounded_broadcast(words)
    doc_toks = recent.select("doc_id", F.explode(F.array_distinct("toks")).alias("tok"))
    cand = (doc_toks.join(words, "tok")
            .groupBy("doc_id", "probe_ord", "query", "phrase", "n_words").agg(F.count("*").alias("n"))
            .filter(F.col("n") == F.col("n_words")))
    terms = cand.filter(~F.col("phrase")).select("doc_id", "probe_ord", "query")
    joined = F.concat(F.lit(" "), F.array_join("toks", " "), F.lit(" "))
    phr = (cand.filter(F.col("phrase")).join(recent, "doc_id")
           .filter(F.instr(joined, F.concat(F.lit(" "), F.lower("query"), F.lit(" "))) > 0)
           .select("doc_id", "probe_ord", "query"))
    return terms.unionByName(phr)


def idempotent_append(existing_keys: DataFrame, batch: DataFrame, keys: list[str],
                      order: list[Column]) -> DataFrame:
    """Rows of ``batch`` to insert.

    Within the batch the first row in plan order wins per key; keys already stored
    are ignored (``left_anti``, null-safe). Appending the result is idempotent:
    replaying the same batch yields zero new rows.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    first = batch.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    stored = existing_keys.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return first.join(stored, same, "left_anti")


def append_counted(rows: DataFrame, path: str, source: str, sources: list[str], kept: str = "kept",
                   new: str = "new") -> list[tuple[str, int, int, int]]:
    """A14 in the writing job: appends the rows of ``rows`` that are kept and new (two flags) to the table at ``path`` and
    returns (source, kept, dropped, new) of every one of the declared ``sources``, observed while the rows pass: the
    input is read once. Rows of other sources count as ''."""
    seen = Observation("append")
    which = F.coalesce(F.when(F.col(source).isin(*sources), F.col(source)), F.lit(""))
    counts = []
    for i, name in enumerate([*sources, ""]):
        here = which == name
        counts += [F.count_if(here & F.col(kept)).alias(f"kept{i}"), F.count_if(here & ~F.col(kept)).alias(f"dropped{i}"),
                   F.count_if(here & F.col(kept) & F.col(new)).alias(f"new{i}")]
    rows.observe(seen, *counts).filter(F.col(kept) & F.col(new)).drop(kept, new).write.mode("append").parquet(path)
    got = seen.get
    return [(name, got[f"kept{i}"], got[f"dropped{i}"], got[f"new{i}"]) for i, name in enumerate([*sources, ""])]


def kept_dropped(df: DataFrame, source_col: str, kept: Column) -> DataFrame:
    """Per-source kept / dropped counters in one pass."""
    return df.groupBy(source_col).agg(F.count_if(kept).alias("kept"),
                                      F.count_if(~kept).alias("dropped"))


def evolve(df: DataFrame, defaults: dict) -> DataFrame:
    """Fill columns added after older rows were written with their declared
    defaults (used after ``unionByName(allowMissingColumns=True)``)."""
    for c, v in defaults.items():
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return df

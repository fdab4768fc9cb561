"""Candidate funnel over landed model-output tables: shape check (C9), verdict
allow-list (C11), query builder (C7 / E8 / E9), prior-art merge (E10), the gate
funnel with its reframe pass (K1-K4), first survivor per slice (F12) and the
funnel report (K5).

Candidate bodies and judgements arrive as JSON text and are parsed into VARIANT,
so type checks ("milestones must be a list", "a non-object judgement") are
explicit predicates, never casts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..functions.lexicons import DOMAINS

# ---- FIXED VALUES ----
REQUIRED = ["title", "one_liner", "problem", "why_hard", "first_weekend", "milestones",
            "in_plain_terms", "why_it_is_hard_plainly"]
PASSING_VERDICTS = ["ship", "reframe"]
URL_RE = r"https?://\S+|\b\w+\.(?:com|org|io|net|dev|sh)\b"
WORD_RE = r"[a-z][a-z0-9-]{3,}"
QUERY_STOP = [
    "https", "http", "www", "com", "org", "news", "item", "html", "github",
    "thread", "comment", "post", "article", "blog", "repo", "issue",
    "a", "an", "the", "for", "with", "that", "this", "your", "you", "and", "or",
    "of", "to", "in", "on", "at", "by", "from", "into", "under", "over",
    "build", "building", "builds", "built", "make", "makes", "using", "use",
    "tool", "toolkit", "system", "service", "platform", "framework", "library",
    "based", "new", "own", "when", "where", "which", "what", "how", "why",
    "plus", "without", "across", "every", "each", "per", "via",
]
MAX_QUERIES = 3
PRIOR_ART_KEEP = 12

_FALSY = ["null", '""', "[]", "{}", "0", "0.0", "false"]


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def truthy(x: Column) -> Column:
    """Python truthiness of a JSON value: missing, null, '', [], {}, 0, false -> False."""
    return x.isNotNull() & ~F.to_json(x).isin(*_FALSY)


def is_kind(x: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(x), F.lit(kind)), F.lit(False))


BACKFILL_FIELDS = ["in_plain_terms", "why_it_is_hard_plainly", "glossary", "starting_points"]


def shape_check(body: Column, override: Column | None = None, override_keys: list[str] = BACKFILL_FIELDS) -> Column:
    """C9 -> struct(ok, reason); the first failing rule wins. With ``override`` the
    check runs on ``body`` updated by the override's keys (restricted to
    ``override_keys``), i.e. the merged record of a backfill (C13)."""
    def get(k):
        if override is not None and k in override_keys:
            o = field(override, k)
            return F.when(o.isNotNull(), o).otherwise(field(body, k))
        return field(body, k)

    missing = F.filter(F.array(*[F.when(~truthy(get(k)), F.lit(k)) for k in REQUIRED]),
                       lambda x: x.isNotNull())
    ms, gl = get("milestones"), get("glossary")
    ms_n = F.size(F.try_variant_get(ms, "$", "array<variant>"))
    gl_arr = F.try_variant_get(gl, "$", "array<variant>")
    entry_ok = F.forall(gl_arr, lambda e: is_kind(e, "OBJECT") & truthy(field(e, "term")) & truthy(field(e, "means")))
    reason = (F.when(F.size(missing) > 0, F.concat(F.lit("missing fields: "), F.array_join(missing, ", ")))
              .when(~is_kind(ms, "ARRAY") | (ms_n < 2), F.lit("milestones must be a list of 2+ items"))
              .when(~is_kind(gl, "ARRAY") | (F.size(gl_arr) < 3), F.lit("glossary must define 3+ terms"))
              .when(~entry_ok, F.lit("every glossary entry needs term + means")))
    return F.struct(reason.isNull().alias("ok"), F.coalesce(reason, F.lit("well formed")).alias("reason"))


def judged(result: Column) -> Column:
    """C11 -> struct(ok, verdict, reason): allow-list on lower(trim(verdict)) and
    feasibility != 'unrealistic'; a malformed or non-object result rejects."""
    verdict = F.lower(F.trim(F.coalesce(F.try_variant_get(result, "$.verdict", "string"), F.lit(""))))
    feas = F.try_variant_get(result, "$.feasibility", "string")
    reason = (F.when(~is_kind(result, "OBJECT"), F.lit("non-object"))
              .when(~verdict.isin(*PASSING_VERDICTS),
                    F.concat(F.lit("verdict "), F.when(verdict == "", F.lit("(missing)")).otherwise(verdict)))
              .when(F.coalesce(feas == "unrealistic", F.lit(False)), F.lit("unrealistic scope")))
    return F.struct(reason.isNull().alias("ok"), verdict.alias("verdict"),
                    F.coalesce(reason, verdict).alias("reason"))


def _quoted(text: Column) -> Column:
    """A string as JSON text."""
    j = F.to_json(F.array(text))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def with_fields(record: Column, fields: dict[str, Column]) -> Column:
    """A JSON object (VARIANT) with some fields set; all others stay. ``fields`` gives JSON texts, NULL leaves a
    field as it is."""
    texts = F.transform_values(F.try_variant_get(record, "$", "map<string,variant>"), lambda k, v: F.to_json(v))
    given = F.array(*[F.named_struct(F.lit("key"), F.lit(k), F.lit("value"), v) for k, v in fields.items()])
    added = F.map_from_entries(F.filter(given, lambda e: e["value"].isNotNull()))
    kept = F.map_filter(texts, lambda k, v: ~F.array_contains(F.map_keys(added), k))
    parts = F.transform(F.map_entries(F.map_concat(kept, added)), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["value"]))
    return F.parse_json(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")))


def _given(result: Column, name: str) -> Column:
    """The JSON text of a field that is not empty."""
    x = field(result, name)
    return F.when(truthy(x), F.to_json(x))


def judgement_fields(result: Column) -> dict[str, Column]:
    """K3: what a judgement changes in the record that it judges."""
    return {"prior_art": _given(result, "prior_art_note"), "closest_existing": _given(result, "closest_existing"),
            "first_weekend": _given(result, "revised_first_weekend"),
            "feasibility": F.coalesce(F.to_json(field(result, "feasibility")), F.lit('""'))}


def _said(x: Column, name: str, default: str = "") -> Column:
    return F.coalesce(F.try_variant_get(x, f"$.{name}", "string"), F.lit(default))


def judged_reason(result: Column) -> Column:
    j, why = judged(result), _said(result, "reason")
    said = F.when(j["verdict"] == "", F.lit("(missing)")).otherwise(j["verdict"])
    return (F.when(~F.coalesce(is_kind(result, "OBJECT"), F.lit(False)), F.lit("gate returned a non-object"))
            .when(~j["verdict"].isin(*PASSING_VERDICTS), F.concat(F.lit("verdict '"), said, F.lit("': "), why))
            .when(~j["ok"], F.concat(F.lit("unrealistic scope: "), why))
            .otherwise(F.concat(j["verdict"], F.lit(": "), why)))


def gate_records(cands: DataFrame, packets: DataFrame, nearest, judgements: DataFrame,
                 revisions: DataFrame, rejudgements: DataFrame, dup_at: float = 0.75) -> DataFrame:
    """K1-K3: grounding -> shape -> dedup -> judged (-> revise -> shape -> judged).
    ``cands(candidate_id, domain, body variant)``; ``packets(domain, urls)``;
    ``nearest``: survivors(candidate_id) -> (candidate_id, sim[, title]), the D5 job, called
    only for candidates that passed the cheap stages; judgements / rejudgements
    ``(candidate_id, result variant)``; ``revisions(candidate_id, body variant)``.

    One row per candidate: passed, verdicts (stage, ok, reason of every stage it reached, in order) and record (VARIANT):
    what passed with its judgement folded in -- a revised one is the revision with the citations of the
    original and its note -- or the candidate as it came, with the citations that were supplied."""
    from .util import bounded_broadcast, materialize
    refs = F.coalesce(F.try_variant_get(F.col("body"), "$.evidence_refs", "array<string>"),
                      F.array().cast("array<string>"))
    supplied = F.coalesce(F.col("urls"), F.array().cast("array<string>"))
    kept = F.filter(refs, lambda u: F.array_contains(supplied, u))
    text = tx.idea_text(F.try_variant_get(F.col("body"), "$.title", "string"),
                        F.try_variant_get(F.col("body"), "$.one_liner", "string"),
                        F.try_variant_get(F.col("body"), "$.problem", "string"))
    # read by the vector join and by the funnel, so written once
    s1 = materialize(cands.join(bounded_broadcast(packets.select("domain", "urls")), "domain", "left")
                     .select("candidate_id", "domain", "body", kept.alias("kept"), F.size(refs).alias("n_cited"),
                             shape_check(F.col("body")).alias("shape"), (text != "").alias("has_text")), "gate-stage")
    grounded = F.size("kept") >= 2
    cheap_ok = s1.filter(grounded & F.col("shape.ok") & F.col("has_text")).select("candidate_id")
    near = nearest(cheap_ok)
    title = F.col("title") if "title" in near.columns else F.lit("")
    dd = near.select("candidate_id", F.coalesce("sim", F.lit(0.0)).alias("sim"), F.coalesce(title, F.lit("")).alias("title"))
    j1 = judgements.select("candidate_id", F.col("result").alias("r1"), judged(F.col("result")).alias("j1"))
    rv = revisions.select("candidate_id", F.col("body").alias("rbody"), shape_check(F.col("body")).alias("rshape"))
    j2 = rejudgements.select("candidate_id", F.col("result").alias("r2"), judged(F.col("result")).alias("j2"))
    x = (s1.join(dd, "candidate_id", "left").join(j1, "candidate_id", "left")
         .join(rv, "candidate_id", "left").join(j2, "candidate_id", "left"))

    no = F.lit(False)
    sim, named = F.coalesce("sim", F.lit(0.0)), F.coalesce("title", F.lit(""))
    quoted = F.concat(F.lit("'"), named, F.lit("'"))
    distinct = F.col("has_text") & (sim < dup_at)
    near_reason = (F.when(~F.col("has_text"), F.lit("no comparable text"))
                   .when(sim >= dup_at, F.concat(F.format_string("%.2f", sim), F.lit(" similar to "), quoted))
                   .otherwise(F.concat(F.lit("nearest past idea "), F.format_string("%.2f", sim), F.lit(" ('"),
                                       F.left(named, F.lit(40)), F.lit("')"))))
    odd = F.col("rbody").isNull() | ~is_kind(F.col("rbody"), "OBJECT")
    gone = odd | truthy(field(F.col("rbody"), "withdrawn"))
    note = F.coalesce(F.to_json(field(F.col("rbody"), "revision_note")), F.lit('"revised"'))
    gone_reason = F.concat(F.lit("withdrawn: "), F.when(odd, F.lit("revision returned a non-object")).otherwise(
        _said(F.col("rbody"), "revision_note", "no hard core survived review")))
    j1ok, j2ok = F.coalesce(F.col("j1.ok"), no), F.coalesce(F.col("j2.ok"), no)
    reframe = F.coalesce(F.col("j1.verdict") == "reframe", no)
    again = F.coalesce(F.col("j2.verdict") == "reframe", no)

    # each stage is reached if the ones before it were passed
    to_shape = grounded
    to_near = to_shape & F.col("shape.ok")
    to_judge = to_near & distinct
    to_revise = to_judge & j1ok & reframe
    to_shape2 = to_revise & ~gone
    to_judge2 = to_shape2 & F.coalesce(F.col("rshape.ok"), no)
    stuck = to_judge2 & j2ok & again

    def verdict(reached, stage, ok, reason):
        return F.when(reached, F.struct(F.lit(stage).alias("stage"), ok.alias("ok"), reason.alias("reason")))

    cited = F.concat(F.size("kept").cast("string"), F.lit(" of "), F.col("n_cited").cast("string"), F.lit(" citations supplied"))
    verdicts = F.filter(F.array(
        verdict(F.lit(True), "grounding", grounded, cited),
        verdict(to_shape, "shape", F.col("shape.ok"), F.col("shape.reason")),
        verdict(to_near, "dedup", distinct, near_reason),
        verdict(to_judge, "judged", j1ok, judged_reason(F.col("r1"))),
        verdict(to_revise, "revise", ~gone, F.when(gone, gone_reason).otherwise(_said(F.col("rbody"), "revision_note", "revised"))),
        verdict(to_shape2, "shape", F.coalesce(F.col("rshape.ok"), no), F.col("rshape.reason")),
        verdict(to_judge2, "judged", j2ok, judged_reason(F.col("r2"))),
        verdict(stuck, "revise", no, F.lit("still reframed after revision; not converging"))), lambda v: v.isNotNull())
    own_refs = {"evidence_refs": F.to_json("kept")}
    record = (F.when(to_judge2 & j2ok & ~again, with_fields(F.col("rbody"), {
                  **own_refs, **judgement_fields(F.col("r2")), "revision_note": note}))
              .when(to_judge & j1ok & ~reframe, with_fields(F.col("body"), {**own_refs, **judgement_fields(F.col("r1"))}))
              .otherwise(with_fields(F.col("body"), own_refs)))
    # a generator keeps the array from being built again for each use
    out = x.select("candidate_id", "domain", F.inline(F.array(F.struct(verdicts.alias("verdicts")))), record.alias("record"))
    return out.select("candidate_id", "domain", F.forall("verdicts", lambda v: v["ok"]).alias("passed"), "verdicts", "record")


def gate_funnel(cands: DataFrame, packets: DataFrame, nearest, judgements: DataFrame,
                revisions: DataFrame, rejudgements: DataFrame, dup_at: float = 0.75) -> DataFrame:
    """K1/K2 in short (``gate_records`` has the inputs): passed, failed_stage, trail (ordered stage marks)."""
    g = gate_records(cands, packets, nearest, judgements, revisions, rejudgements, dup_at)
    last = F.element_at("verdicts", -1)
    marks = F.transform("verdicts", lambda v: F.concat(v["stage"], F.when(v["ok"], F.lit("+")).otherwise(F.lit("-"))))
    return g.select("candidate_id", "domain", "passed", F.when(~last["ok"], last["stage"]).alias("failed_stage"),
                    F.array_join(marks, ",").alias("trail"))


def needs_backfill(body: Column) -> Column:
    """An idea lacks its plain-language pass when in_plain_terms or the
    glossary is missing / empty."""
    return ~(truthy(field(body, "in_plain_terms")) & truthy(field(body, "glossary")))


def first_survivor(funnel: DataFrame, rank: str = "candidate_id") -> DataFrame:
    """per slice (domain) the first candidate in rank order that passed every
    gate; NULL when none did (nothing ships rather than the least bad)."""
    return funnel.groupBy("domain").agg(
        F.min(F.when(F.col("passed"), F.col(rank))).alias("shipped_id"),
        F.count("*").alias("n_candidates"))


def funnel_report(funnel: DataFrame) -> DataFrame:
    """K5: rejects kept per (domain, stage) for calibration."""
    return (funnel.filter(~F.col("passed")).groupBy("domain", "failed_stage")
            .agg(F.count("*").alias("n")))


def apply_judgement(body: Column, result: Column) -> Column:
    """K3: prior_art / closest_existing / first_weekend overwritten when the
    judgement gives a non-empty value; feasibility always set."""
    def pick(new_key, old_key):
        new = F.try_variant_get(result, f"$.{new_key}", "string")
        return F.when(F.coalesce(new, F.lit("")) != "", new).otherwise(
            F.try_variant_get(body, f"$.{old_key}", "string"))
    return F.struct(pick("prior_art_note", "prior_art").alias("prior_art"),
                    pick("closest_existing", "closest_existing").alias("closest_existing"),
                    pick("revised_first_weekend", "first_weekend").alias("first_weekend"),
                    F.coalesce(F.try_variant_get(result, "$.feasibility", "string"), F.lit("")).alias("feasibility"))


def critique(result: Column) -> Column:
    """K4: non-empty parts joined by a blank line."""
    def part(key, prefix=""):
        v = F.try_variant_get(result, f"$.{key}", "string")
        return F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(prefix), v))
    parts = F.array(part("reason"), part("reframe", "Sharper version: "),
                    part("prior_art_note", "Prior art: "), part("feasibility", "Scope reads as: "))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n\n")


def query_builder(ideas: DataFrame, domains: dict[str, list[str]] = DOMAINS,
                  stop: list[str] = QUERY_STOP) -> DataFrame:
    """Up to three search queries per idea from lexicon jargon (the idea's
    own domain first) and its six most frequent content words (ties by first
    occurrence). ``ideas(idea_id, domain, text)`` where text is the joined title /
    one_liner / problem / why_hard. Per-row array functions only (no shuffle)."""
    low = F.regexp_replace(F.lower(F.col("text")), URL_RE, " ")
    x = ideas.select("idea_id", "domain", low.alias("low")).withColumn("folded", lx.folded(F.col("low"))).withColumn(
        "jargon", F.filter(lx.matched_terms(F.col("low"), F.col("domain"), domains, F.col("folded")), lambda t: F.length(t) > 2))
    toks = F.regexp_extract_all(F.col("low"), F.lit(WORD_RE), 0)
    x = x.withColumn("toks", F.filter(toks, lambda w: ~w.isin(list(stop)) & ~F.array_contains(F.col("jargon"), w)))
    # sorted by (word, place): a word's run starts at its first place and ends where the next word's starts
    x = x.withColumn("at", F.sort_array(F.transform("toks", lambda w, i: F.struct(w.alias("w"), i.alias("i")))))
    at = F.col("at")
    starts = F.filter(F.transform(at, lambda e, k: F.when((k == 0) | (e["w"] != F.get(at, k - 1)["w"]), k)), lambda k: k.isNotNull())
    x = x.withColumn("starts", starts)
    nexts = F.slice(F.concat("starts", F.array(F.size("at"))), F.lit(2), F.size("starts"))
    ranked = F.sort_array(F.zip_with("starts", nexts, lambda k, e: F.struct(
        (k - e).alias("neg_n"), F.get(at, k)["i"].alias("pos"), F.get(at, k)["w"].alias("w"))))
    x = x.withColumn("common", F.transform(F.slice(ranked, 1, 6), lambda s: s["w"]))
    j, c = F.col("jargon"), F.col("common")
    q1 = F.when(F.size(j) >= 2, F.concat_ws(" ", j[0], j[1]))
    q2 = F.when((F.size(j) >= 1) & (F.size(c) >= 1), F.concat_ws(" ", j[0], c[0]))
    q3 = (F.when(F.size(j) >= 3, F.concat_ws(" ", j[0], j[2]))
          .when(F.size(c) >= 2, F.concat_ws(" ", c[0], c[1])))
    queries = F.slice(F.array_distinct(F.filter(F.array(q1, q2, q3), lambda q: q.isNotNull())), 1, MAX_QUERIES)
    return x.select("idea_id", "jargon", "common", queries.alias("queries"))


def prior_art_rank(results: DataFrame, attempts: DataFrame, keep: int = PRIOR_ART_KEEP) -> DataFrame:
    """Per idea, union the search result lists, keep the first occurrence per
    repo name (query order, then position), sanitise, and keep the ``keep`` most
    starred (stable: ties by first occurrence). ``results(idea_id, query_ord, pos,
    name, stars, description, url, archived, pushed_at)``; ``attempts(idea_id,
    query_ord, ok)`` -> searched_ok = attempted > 0 and failed < attempted."""
    w1 = Window.partitionBy("idea_id", "name").orderBy("query_ord", "pos")
    first = (results.filter(F.col("name").isNotNull() & (F.col("name") != ""))
             .withColumn("_r", F.row_number().over(w1)).filter("_r = 1"))
    w2 = Window.partitionBy("idea_id").orderBy(F.col("stars").desc(), "query_ord", "pos")
    ranked = first.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= keep)
    ok = attempts.groupBy("idea_id").agg(
        ((F.count("*") > 0) & (F.count_if(~F.col("ok")) < F.count("*"))).alias("searched_ok"))
    return ranked.select("idea_id", "rank", tx.flatten(F.col("name"), 80).alias("name"), "stars",
                         tx.flatten(F.coalesce("description", F.lit("")), 200).alias("description"),
                         "url", F.coalesce("archived", F.lit(False)).alias("archived"),
                         F.left(F.coalesce("pushed_at", F.lit("")), F.lit(10)).alias("pushed_at")
                         ).join(ok, "idea_id", "left")


# ---- FIXED VALUES: the two non-list renderings of the prior-art block ----
SEARCH_UNAVAILABLE = ("SEARCH UNAVAILABLE -- the repository search failed. Do NOT "
                      "conclude the field is clear; treat prior art as unknown and say so.")
NO_MATCHES = "(no repositories matched the search terms)"


def prior_art_block(ranked: DataFrame, ideas: DataFrame) -> DataFrame:
    """E10 rendering per idea: the failed-search notice, the no-match line, or one
    line per ranked repo ('- name (N stars, last push D[, ARCHIVED]): description').
    ``ranked`` is ``prior_art_rank`` output; ``ideas(idea_id, searched_ok)``."""
    line = F.concat(F.lit("- "), F.col("name"), F.lit(" ("), F.col("stars").cast("string"), F.lit(" stars, last push "),
                    F.col("pushed_at"), F.when(F.col("archived"), F.lit(", ARCHIVED")).otherwise(F.lit("")),
                    F.lit("): "), F.col("description"))
    lines = ranked.groupBy("idea_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]),
                     "\n").alias("listing"))
    j = ideas.join(lines, "idea_id", "left")
    text = (F.when(~F.coalesce(F.col("searched_ok"), F.lit(False)), F.lit(SEARCH_UNAVAILABLE))
            .when(F.col("listing").isNull(), F.lit(NO_MATCHES)).otherwise(F.col("listing")))
    return j.select("idea_id", text.alias("prior_art"))

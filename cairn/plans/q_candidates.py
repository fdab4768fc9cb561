"""Registered queries for the candidate funnel.

Fixture: one candidate idea per document / embedded signal, with fields blanked
or mistyped by id so that every shape rule fires; one judgement per candidate
(verdict by id, including malformed ones); one revision and re-judgement for
reframed candidates.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lexicons import FIXTURE_DOMAINS
from ..operators import candidates as cd
from ..operators import selection as sel
from ..operators import vectors as vx
from ..operators.util import materialize
from ..sources.tables import table
from .oracle import EVIDENCE_CTE, PACKET_CTE, SIGNAL, TOP_CTE, q, with_
from .q_select import packet_inputs
from .registry import register


class Both:
    """A fixture expression written once, rendered for Spark and for SQL."""

    def __init__(self, make_col, sql: str):
        self._make, self.sql = make_col, sql  # the Spark side is built lazily

    @property
    def col(self):
        return self._make()


def lit(s: str) -> Both:
    return Both(lambda: F.lit(s), q(s))


def cat(*parts: Both) -> Both:
    return Both(lambda: F.concat(*[p.col for p in parts]), "(" + " || ".join(p.sql for p in parts) + ")")


def idc(mod: int, eq: int) -> tuple:
    return (lambda: F.col("id") % mod == eq), f"id % {mod} = {eq}"


def case(branches: list[tuple[tuple, Both]], other: Both) -> Both:
    def make():
        c = F.when(F.lit(False), F.lit(None))
        for (cc, _), v in branches:
            c = c.when(cc(), v.col)
        return c.otherwise(other.col)
    s = "CASE" + "".join(f" WHEN {cs} THEN {v.sql}" for (_, cs), v in branches)
    return Both(make, s + f" ELSE {other.sql} END")


def colb(name: str) -> Both:
    return Both(lambda: F.col(name).cast("string"), f"CAST({name} AS VARCHAR)")


def body_expr(refs: Both) -> Both:
    title = case([(idc(9, 0), lit(""))], cat(lit("idea "), colb("id")))
    one = case([(idc(7, 0), lit(""))], cat(lit("one liner from "), colb("source")))
    problem = cat(lit("problem in "), colb("lang"))
    why = case([(idc(5, 0), lit(""))], cat(lit("why "), colb("id")))
    plainly = case([(idc(13, 0), lit(""))], lit("hard"))
    plain_terms = case([(idc(8, 0), lit(""))], lit("plain"))
    ms = case([(idc(6, 0), lit('"just one"')), (idc(6, 1), lit('["m1"]'))], lit('["m1", "m2"]'))
    g2 = '[{"term": "a", "means": "x"}, {"term": "b", "means": "y"}'
    gl = case([(idc(4, 0), lit(g2 + "]")),
               (idc(4, 1), lit('[{"term": "a", "means": "x"}, {"term": "b", "means": ""}, {"term": "c", "means": "z"}]'))],
              lit(g2 + ', {"term": "c", "means": "z"}]'))
    return cat(lit('{"title": "'), title, lit('", "one_liner": "'), one, lit('", "problem": "'), problem,
               lit('", "why_hard": "'), why, lit('", "first_weekend": "prototype", "milestones": '), ms,
               lit(', "in_plain_terms": "'), plain_terms, lit('", "why_it_is_hard_plainly": "'), plainly,
               lit('", "glossary": '), gl, lit(', "evidence_refs": '), refs, lit("}"))


def judgement_expr() -> Both:
    return case([(idc(6, 0), lit('{"verdict": "ship", "reason": "clear", "feasibility": "weekend"}')),
                 (idc(6, 1), lit('{"verdict": " Reframe ", "reason": "inflated", "reframe": "narrower"}')),
                 (idc(6, 2), lit('{"verdict": "kill", "reason": "exists"}')),
                 (idc(6, 3), lit('{"reason": "no verdict"}')),
                 (idc(6, 4), lit('{"verdict": "SHIP", "reason": "big", "feasibility": "unrealistic"}'))],
                lit("[1, 2]"))


SELF_REF = cat(lit('["u/'), colb("id"), lit('"]'))
BODY_DOC = body_expr(SELF_REF)
JUDGE = judgement_expr()

DOC_CANDS = f"""
dcands AS (
  SELECT doc_id AS id, source, lang, {BODY_DOC.sql} AS body, {JUDGE.sql} AS result
  FROM documents)"""


def doc_candidates(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "lang")
    return d.select("id", F.parse_json(BODY_DOC.col).alias("body"), F.parse_json(JUDGE.col).alias("result"))


def _truthy(x: str) -> str:
    return f"({x} IS NOT NULL AND CAST({x} AS VARCHAR) NOT IN ('null', '\"\"', '[]', '{{}}', '0', '0.0', 'false'))"


def shape_sql(b: str) -> str:
    j = f"CAST({b} AS JSON)"
    miss = ", ".join(f"CASE WHEN NOT {_truthy(f'json_extract({j}, {q("$." + k)})')} THEN {q(k)} END"
                     for k in cd.REQUIRED)
    ms, gl = f"json_extract({j}, '$.milestones')", f"json_extract({j}, '$.glossary')"
    bad_entry = (f"len(list_filter(CAST(json_extract({gl}, '$[*]') AS JSON[]), lambda e: NOT ("
                 f"json_type(e) = 'OBJECT' AND {_truthy("json_extract(e, '$.term')")} AND "
                 f"{_truthy("json_extract(e, '$.means')")}))) > 0")
    missing = f"list_filter([{miss}], lambda x: x IS NOT NULL)"
    return (f"CASE WHEN len({missing}) > 0 THEN 'missing fields: ' || array_to_string({missing}, ', ') "
            f"WHEN coalesce(json_type({ms}), '') <> 'ARRAY' OR json_array_length({ms}) < 2 THEN 'milestones must be a list of 2+ items' "
            f"WHEN coalesce(json_type({gl}), '') <> 'ARRAY' OR json_array_length({gl}) < 3 THEN 'glossary must define 3+ terms' "
            f"WHEN {bad_entry} THEN 'every glossary entry needs term + means' END")


@register(sql=with_(DOC_CANDS) + f""",
s AS (SELECT id, {shape_sql('body')} AS reason FROM dcands)
SELECT id AS candidate_id, reason IS NULL AS ok, coalesce(reason, 'well formed') AS reason FROM s""")
def q_shape_check(spark, sf):
    c = doc_candidates(spark, sf)
    s = cd.shape_check(F.col("body"))
    return c.select(F.col("id").alias("candidate_id"), s["ok"].alias("ok"), s["reason"].alias("reason"))


def judged_sql(r: str) -> str:
    j = f"CAST({r} AS JSON)"
    v = f"lower(trim(coalesce(json_extract_string({j}, '$.verdict'), '')))"
    return (f"CASE WHEN json_type({j}) <> 'OBJECT' THEN 'non-object' "
            f"WHEN {v} NOT IN ('ship', 'reframe') THEN 'verdict ' || CASE WHEN {v} = '' THEN '(missing)' ELSE {v} END "
            f"WHEN coalesce(json_extract_string({j}, '$.feasibility') = 'unrealistic', false) THEN 'unrealistic scope' END")


@register(sql=with_(DOC_CANDS) + f"""
SELECT id AS candidate_id, {judged_sql('result')} IS NULL AS ok,
       CASE WHEN json_type(CAST(result AS JSON)) = 'OBJECT'
            THEN lower(trim(coalesce(json_extract_string(CAST(result AS JSON), '$.verdict'), ''))) ELSE '' END AS verdict,
       coalesce({judged_sql('result')}, lower(trim(coalesce(json_extract_string(CAST(result AS JSON), '$.verdict'), '')))) AS reason
FROM dcands""")
def q_verdict_allowlist(spark, sf):
    c = doc_candidates(spark, sf)
    j = cd.judged(F.col("result"))
    return c.select(F.col("id").alias("candidate_id"), j["ok"].alias("ok"), j["verdict"].alias("verdict"),
                    j["reason"].alias("reason"))


# ---- the gate funnel over embedded signals ----

def _p(i):
    return Both(lambda: F.coalesce(F.element_at(F.col("urls"), i), F.concat(F.lit("x/"), F.col("id").cast("string"))),
                f"coalesce(urls[{i}], 'x/' || CAST(id AS VARCHAR))")


FUNNEL_REFS = cat(lit('["u/'), colb("id"), lit('", "'),
                  case([(idc(3, 0), cat(lit("x/"), colb("id")))], _p(1)), lit('", "'),
                  case([(idc(2, 0), cat(lit("x/"), colb("id")))], _p(2)), lit('"]'))
FUNNEL_BODY = body_expr(FUNNEL_REFS)
REVISION = case([(idc(12, 1), FUNNEL_BODY), (idc(12, 7), lit('{"withdrawn": true}'))], Both(lambda: F.lit(None), "NULL"))
REJUDGE = case([(idc(24, 1), lit('{"verdict": "ship", "reason": "ok now"}')),
                (idc(24, 13), lit('{"verdict": "reframe", "reason": "still"}'))], Both(lambda: F.lit(None), "NULL"))


def funnel_inputs(spark, sf):
    sig, _, _, _, rows = packet_inputs(spark, sf)
    packets = materialize(sel.evidence_packet(rows), "packets")  # a landed table in production
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    base = (sig.select("id", "domain", "source", "lang").join(emb, "id")
            .join(packets.select("domain", "urls"), "domain", "left"))
    cands = base.select(F.col("id").alias("candidate_id"), "domain", F.parse_json(FUNNEL_BODY.col).alias("body"),
                        F.parse_json(JUDGE.col).alias("j1"), F.try_parse_json(REVISION.col).alias("rv"),
                        F.try_parse_json(REJUDGE.col).alias("j2"), "vec")
    # candidates and their judgements are landed model-output tables: written once
    cands = materialize(cands, "candidates")
    ledger = emb.filter(F.col("id") % 2 == 0).select(
        F.col("id").alias("ord"), F.concat(F.lit("idea "), F.col("id").cast("string")).alias("title"), "vec")
    return cands, packets, ledger


def funnel(spark, sf, gate=cd.gate_funnel):
    cands, packets, ledger = funnel_inputs(spark, sf)
    c = cands.select("candidate_id", "domain", "body")

    def nearest(survivors):
        qv = survivors.join(cands.select("candidate_id", "vec"), "candidate_id").select(
            F.col("candidate_id").alias("qid"), "vec")
        return vx.nearest_prior(qv, ledger, dim=64).select(F.col("qid").alias("candidate_id"), "sim", "title")

    return gate(c, packets, nearest,
                          cands.select("candidate_id", F.col("j1").alias("result")),
                          cands.select("candidate_id", F.col("rv").alias("body")).filter(F.col("body").isNotNull()),
                          cands.select("candidate_id", F.col("j2").alias("result")).filter(F.col("result").isNotNull()))


FUNNEL_SQL = with_(SIGNAL, EVIDENCE_CTE, TOP_CTE, PACKET_CTE) + f""",
base AS (
  SELECT s.id, s.domain, s.source, s.lang, p.urls, CAST(e.embedding AS DOUBLE[]) AS vec
  FROM signal s JOIN embeddings e ON e.vec_id = s.id LEFT JOIN packets p ON p.domain = s.domain),
fc AS (
  SELECT id, domain, vec, {FUNNEL_BODY.sql} AS body, {JUDGE.sql} AS j1, {REVISION.sql} AS rv, {REJUDGE.sql} AS j2, urls
  FROM base),
st AS (
  SELECT id, domain, vec, body, j1, rv, j2,
         len(list_filter(CAST(json_extract(CAST(body AS JSON), '$.evidence_refs') AS VARCHAR[]),
                         lambda u: list_contains(coalesce(urls, []::VARCHAR[]), u))) >= 2 AS g_ok,
         {shape_sql('body')} IS NULL AS s_ok,
         regexp_replace(coalesce(json_extract_string(CAST(body AS JSON), '$.title'), '') || chr(10)
                        || coalesce(json_extract_string(CAST(body AS JSON), '$.one_liner'), '') || chr(10)
                        || coalesce(json_extract_string(CAST(body AS JSON), '$.problem'), ''), '^\\s+|\\s+$', '', 'g') <> '' AS has_text
  FROM fc),
led AS (SELECT vec_id AS ord, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 2 = 0),
nn AS (SELECT st.id, max(list_dot_product(st.vec, led.e)) AS sim FROM st CROSS JOIN led GROUP BY st.id),
x AS (
  SELECT st.*, coalesce(nn.sim, 0.0) < 0.75 AS d_ok,
         {judged_sql('j1')} IS NULL AS j1ok,
         lower(trim(coalesce(json_extract_string(CAST(j1 AS JSON), '$.verdict'), ''))) = 'reframe' AS reframe,
         (rv IS NULL OR json_type(CAST(rv AS JSON)) <> 'OBJECT'
          OR {_truthy("json_extract(CAST(rv AS JSON), '$.withdrawn')")}) AS withdrawn,
         {shape_sql('rv')} IS NULL AS rs_ok,
         coalesce({judged_sql('j2')} IS NULL AND j2 IS NOT NULL, false) AS j2ok,
         lower(trim(coalesce(json_extract_string(CAST(j2 AS JSON), '$.verdict'), ''))) = 'reframe' AS reframe2
  FROM st LEFT JOIN nn USING (id)),
f AS (
  SELECT id, domain,
    CASE WHEN NOT g_ok THEN 'grounding' WHEN NOT s_ok THEN 'shape' WHEN NOT has_text OR NOT d_ok THEN 'dedup'
         WHEN NOT j1ok THEN 'judged' WHEN NOT reframe THEN NULL WHEN withdrawn THEN 'revise'
         WHEN NOT rs_ok THEN 'shape' WHEN NOT j2ok THEN 'judged' WHEN reframe2 THEN 'revise' END AS failed_stage,
    CASE WHEN NOT g_ok THEN 'grounding-' WHEN NOT s_ok THEN 'grounding+,shape-'
         WHEN NOT has_text OR NOT d_ok THEN 'grounding+,shape+,dedup-'
         WHEN NOT j1ok THEN 'grounding+,shape+,dedup+,judged-'
         WHEN NOT reframe THEN 'grounding+,shape+,dedup+,judged+'
         WHEN withdrawn THEN 'grounding+,shape+,dedup+,judged+,revise-'
         WHEN NOT rs_ok THEN 'grounding+,shape+,dedup+,judged+,revise+,shape-'
         WHEN NOT j2ok THEN 'grounding+,shape+,dedup+,judged+,revise+,shape+,judged-'
         WHEN reframe2 THEN 'grounding+,shape+,dedup+,judged+,revise+,shape+,judged+,revise-'
         ELSE 'grounding+,shape+,dedup+,judged+,revise+,shape+,judged+' END AS trail
  FROM x)"""


@register(sql=FUNNEL_SQL + """
SELECT id AS candidate_id, domain, failed_stage IS NULL AS passed, failed_stage, trail FROM f""")
def q_gate_funnel(spark, sf):
    return funnel(spark, sf)


def _judged_reason_sql(r: str) -> str:
    j = f"CAST({r} AS JSON)"
    v, why = f"lower(trim(coalesce(json_extract_string({j}, '$.verdict'), '')))", f"coalesce(json_extract_string({j}, '$.reason'), '')"
    return (f"CASE WHEN {r} IS NULL OR json_type({j}) <> 'OBJECT' THEN 'gate returned a non-object' "
            f"WHEN {v} NOT IN ('ship', 'reframe') THEN 'verdict ''' || CASE WHEN {v} = '' THEN '(missing)' ELSE {v} END || ''': ' || {why} "
            f"WHEN coalesce(json_extract_string({j}, '$.feasibility') = 'unrealistic', false) THEN 'unrealistic scope: ' || {why} "
            f"ELSE {v} || ': ' || {why} END")


def _stage_sql(reached: str, stage: str, ok: str, reason: str) -> str:
    return f"CASE WHEN {reached} THEN '{stage}' || CASE WHEN {ok} THEN '+ ' ELSE '- ' END || {reason} END"


_NEAR_SQL = ("CASE WHEN NOT has_text THEN 'no comparable text' WHEN NOT d_ok THEN printf('%.2f', sim) || ' similar to ''' || title || '''' "
             "ELSE 'nearest past idea ' || printf('%.2f', sim) || ' (''' || left(title, 40) || ''')' END")
_NOTE_SQL = "json_extract_string(CAST(rv AS JSON), '$.revision_note')"
_REVISE_SQL = ("CASE WHEN rv IS NULL OR json_type(CAST(rv AS JSON)) <> 'OBJECT' THEN 'withdrawn: revision returned a non-object' "
               f"WHEN withdrawn THEN 'withdrawn: ' || coalesce({_NOTE_SQL}, 'no hard core survived review') "
               f"ELSE coalesce({_NOTE_SQL}, 'revised') END")
_TO_JUDGE = "g_ok AND s_ok AND has_text AND d_ok"
_TO_SHAPE2 = f"{_TO_JUDGE} AND j1ok AND reframe AND NOT withdrawn"
_STAGES = ", ".join([
    _stage_sql("true", "grounding", "g_ok", "len(kept) || ' of ' || n_cited || ' citations supplied'"),
    _stage_sql("g_ok", "shape", "s_ok", f"coalesce({shape_sql('body')}, 'well formed')"),
    _stage_sql("g_ok AND s_ok", "dedup", "has_text AND d_ok", _NEAR_SQL),
    _stage_sql(_TO_JUDGE, "judged", "j1ok", _judged_reason_sql("j1")),
    _stage_sql(f"{_TO_JUDGE} AND j1ok AND reframe", "revise", "NOT withdrawn", _REVISE_SQL),
    _stage_sql(_TO_SHAPE2, "shape", "rs_ok", f"coalesce({shape_sql('rv')}, 'well formed')"),
    _stage_sql(f"{_TO_SHAPE2} AND rs_ok", "judged", "j2ok", _judged_reason_sql("j2")),
    _stage_sql(f"{_TO_SHAPE2} AND rs_ok AND j2ok AND reframe2", "revise", "false", "'still reframed after revision; not converging'")])
_LEFT = "CAST(CASE WHEN passed AND reframe THEN rv ELSE body END AS JSON)"


@register(sql=FUNNEL_SQL + f""",
kp AS (SELECT fc.id, list_filter(CAST(json_extract(CAST(body AS JSON), '$.evidence_refs') AS VARCHAR[]),
                                 lambda u: list_contains(coalesce(urls, []::VARCHAR[]), u)) AS kept,
              json_array_length(json_extract(CAST(body AS JSON), '$.evidence_refs')) AS n_cited FROM fc),
nt AS (SELECT st.id, arg_max('idea ' || CAST(led.ord AS VARCHAR), (list_dot_product(st.vec, led.e), -led.ord)) AS title,
              max(list_dot_product(st.vec, led.e)) AS sim FROM st CROSS JOIN led GROUP BY st.id),
y AS (SELECT x.*, kp.kept, kp.n_cited, nt.title, nt.sim, f.failed_stage IS NULL AS passed
      FROM x JOIN kp USING (id) JOIN nt USING (id) JOIN f USING (id))
SELECT id AS candidate_id, passed,
  array_to_string(list_filter([{_STAGES}], lambda v: v IS NOT NULL), chr(10)) AS verdicts,
  array_to_string(kept, ' ') AS refs,
  CASE WHEN passed THEN coalesce(json_extract_string(CAST(CASE WHEN reframe THEN j2 ELSE j1 END AS JSON), '$.feasibility'), '') END AS feasibility,
  CASE WHEN passed AND reframe THEN coalesce({_NOTE_SQL}, 'revised') END AS revision_note,
  json_extract_string({_LEFT}, '$.problem') AS problem,
  CAST(json_array_length(json_extract({_LEFT}, '$.glossary')) AS BIGINT) AS n_glossary,
  CAST(len(json_keys({_LEFT})) + CASE WHEN passed AND reframe THEN 2 WHEN passed THEN 1 ELSE 0 END AS BIGINT) AS n_fields
FROM y""")
def q_gate_record(spark, sf):
    """K1-K3: every stage's reason, and the record that leaves the gate: revised ones with the original citations
    and their note, all fields that no judgement touches as they were."""
    g = funnel(spark, sf, cd.gate_records)
    said = F.transform("verdicts", lambda v: F.concat(v["stage"], F.when(v["ok"], F.lit("+ ")).otherwise(F.lit("- ")), v["reason"]))
    r = F.col("record")

    def text(name):
        return F.try_variant_get(r, f"$.{name}", "string")

    fields = F.try_variant_get(r, "$", "map<string,variant>")
    glossary = F.try_variant_get(r, "$.glossary", "array<variant>")
    return g.select("candidate_id", "passed", F.array_join(said, "\n").alias("verdicts"),
                    F.array_join(F.try_variant_get(r, "$.evidence_refs", "array<string>"), " ").alias("refs"),
                    text("feasibility").alias("feasibility"), text("revision_note").alias("revision_note"),
                    text("problem").alias("problem"), F.size(glossary).cast("long").alias("n_glossary"),
                    F.size(fields).cast("long").alias("n_fields"))


@register(sql=FUNNEL_SQL + """
SELECT domain, min(CASE WHEN failed_stage IS NULL THEN id END) AS shipped_id, count(*) AS n_candidates
FROM f GROUP BY domain""")
def q_first_survivor(spark, sf):
    return cd.first_survivor(funnel(spark, sf))


@register(sql=FUNNEL_SQL + """
SELECT domain, failed_stage, count(*) AS n FROM f WHERE failed_stage IS NOT NULL GROUP BY 1, 2""")
def q_funnel_report(spark, sf):
    return cd.funnel_report(funnel(spark, sf))


# ---- query builder (C7, E8, E9) ----

def _ideas(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    text = F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit(" "), F.coalesce("text", F.lit("")))
    return d.select(F.col("doc_id").alias("idea_id"), F.col("lang").alias("domain"), text.alias("text"))


def _entry_hit_sql(term: str) -> str:
    from ..functions.lexicon import term_regex
    pat = q("(?i)" + term_regex(term))
    pre = q("(?is)^(.*?)" + term_regex(term))
    return (f"CASE WHEN regexp_matches(ft, {pat}) THEN lower(substr(low, length(regexp_extract(ft, {pre}, 1)) + 1, "
            f"length(regexp_extract(ft, {pat}, 0)))) ELSE '' END")


def _matched_sql() -> str:
    entries: list[str] = []
    for terms in FIXTURE_DOMAINS.values():
        for t in terms:
            if t not in entries:
                entries.append(t)

    def ordered(first):
        order: list[str] = []
        for d in ([first] if first else []) + [d for d in FIXTURE_DOMAINS if d != first]:
            for t in FIXTURE_DOMAINS[d]:
                if t not in order:
                    order.append(t)
        return "list_filter([" + ", ".join(_entry_hit_sql(t) for t in order) + "], lambda x: x <> '')"
    whens = " ".join(f"WHEN domain = {q(d)} THEN {ordered(d)}" for d in FIXTURE_DOMAINS)
    return f"CASE {whens} ELSE {ordered(None)} END"


_STOP_SQL = "[" + ", ".join(q(w) for w in cd.QUERY_STOP) + "]"
QB_SQL = f"""
WITH ideas AS (
  SELECT doc_id AS idea_id, lang AS domain,
         regexp_replace(lower('doc ' || CAST(doc_id AS VARCHAR) || ' ' || coalesce(text, '')),
                        {q(cd.URL_RE)}, ' ', 'g') AS low
  FROM documents),
f AS (SELECT idea_id, domain, low, regexp_replace(low, '[À-ÖØ-öø-ɏ]', 'z', 'g') AS ft FROM ideas),
j AS (SELECT idea_id, low, list_filter({_matched_sql()}, lambda t: length(t) > 2) AS jargon FROM f),
tok AS (
  SELECT idea_id, unnest(regexp_extract_all(low, {q(cd.WORD_RE)})) AS w,
         unnest(generate_series(1, len(regexp_extract_all(low, {q(cd.WORD_RE)})))) AS pos
  FROM j),
cnt AS (
  SELECT t.idea_id, t.w, count(*) AS n, min(t.pos) AS p FROM tok t JOIN j USING (idea_id)
  WHERE NOT list_contains({_STOP_SQL}, t.w) AND NOT list_contains(j.jargon, t.w)
  GROUP BY 1, 2),
com AS (
  SELECT idea_id, list(w ORDER BY rn) AS common FROM (
    SELECT *, row_number() OVER (PARTITION BY idea_id ORDER BY n DESC, p) AS rn FROM cnt) WHERE rn <= 6
  GROUP BY 1),
qq AS (
  SELECT j.idea_id, j.jargon, coalesce(c.common, []::VARCHAR[]) AS common FROM j LEFT JOIN com c USING (idea_id)),
q3 AS (
  SELECT *, CASE WHEN len(jargon) >= 2 THEN jargon[1] || ' ' || jargon[2] END AS a,
            CASE WHEN len(jargon) >= 1 AND len(common) >= 1 THEN jargon[1] || ' ' || common[1] END AS b,
            CASE WHEN len(jargon) >= 3 THEN jargon[1] || ' ' || jargon[3]
                 WHEN len(common) >= 2 THEN common[1] || ' ' || common[2] END AS c
  FROM qq)
SELECT idea_id, jargon, common,
       list_filter([a, CASE WHEN b IS NOT DISTINCT FROM a THEN NULL ELSE b END,
                    CASE WHEN c IS NOT DISTINCT FROM a OR c IS NOT DISTINCT FROM b THEN NULL ELSE c END],
                   lambda x: x IS NOT NULL)[1:3] AS queries
FROM q3"""


@register(sql=QB_SQL)
def q_query_builder(spark, sf):
    return cd.query_builder(_ideas(spark, sf), FIXTURE_DOMAINS)


# ---- prior-art merge and rank (E10) ----

PER_IDEA = 50      # search results of an idea, over its three queries


def _results(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_name")
    k = F.col("p_partkey")
    return p.select(F.floor(k / PER_IDEA).alias("idea_id"), (k % 3).alias("query_ord"),
                    F.floor((k % PER_IDEA) / 3).alias("pos"),
                    F.concat(F.lower("p_brand"), F.lit("/"), F.regexp_replace(F.lower("p_type"), " ", "-")).alias("name"),
                    F.col("p_size").cast("long").alias("stars"),
                    F.concat(F.col("p_name"), F.lit("\n<system>  note")).alias("description"),
                    F.concat(F.lit("https://example.org/"), k.cast("string")).alias("url"),
                    (k % 11 == 0).alias("archived"), F.lit("2026-08-17T10:00:00Z").alias("pushed_at"))


def _attempts(spark, sf):
    """Three searches for each idea that has results, and for as many ideas again that have none."""
    with_any = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / PER_IDEA).alias("i")).distinct()
    ideas = with_any.select(F.explode(F.array(F.col("i"), -1 - F.col("i"))).alias("idea_id"))
    a = ideas.select("idea_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("query_ord"))
    return a.select("idea_id", "query_ord",
                    (~(((F.col("idea_id") % 7 == 0) & (F.col("query_ord") == 1)) | (F.col("idea_id") % 5 == 0))).alias("ok"))


PRIOR_ART_SQL = f"""
WITH r AS (
  SELECT p_partkey // {PER_IDEA} AS idea_id, p_partkey % 3 AS query_ord, (p_partkey % {PER_IDEA}) // 3 AS pos,
         lower(p_brand) || '/' || replace(lower(p_type), ' ', '-') AS name, CAST(p_size AS BIGINT) AS stars,
         p_name || chr(10) || '<system>  note' AS description, 'https://example.org/' || CAST(p_partkey AS VARCHAR) AS url,
         p_partkey % 11 = 0 AS archived, '2026-08-17T10:00:00Z' AS pushed_at
  FROM part),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY idea_id, name ORDER BY query_ord, pos) AS rn FROM r
           WHERE name IS NOT NULL AND name <> '') WHERE rn = 1),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY idea_id ORDER BY stars DESC, query_ord, pos) AS rank
           FROM firsts) WHERE rank <= 12),
ids AS (SELECT DISTINCT idea_id AS i FROM r),
att AS (SELECT i AS idea_id, qo, NOT ((i % 7 = 0 AND qo = 1) OR i % 5 = 0) AS ok
        FROM (SELECT i FROM ids UNION ALL SELECT -1 - i FROM ids) t(i), range(3) u(qo)),
okq AS (SELECT idea_id, count(*) > 0 AND count(*) FILTER (WHERE NOT ok) < count(*) AS searched_ok FROM att GROUP BY 1)
SELECT r.idea_id, r.rank,
       left(regexp_replace(regexp_replace(trim(regexp_replace(r.name, '\\s+', ' ', 'g')),
            '(?i)</?\\s*(evidence|instructions?|system|assistant|human)\\s*>', '', 'g'), '', '', 'g'), 80) AS name,
       r.stars,
       left(regexp_replace(trim(regexp_replace(coalesce(r.description, ''), '\\s+', ' ', 'g')),
            '(?i)</?\\s*(evidence|instructions?|system|assistant|human)\\s*>', '', 'g'), 200) AS description,
       r.url, coalesce(r.archived, false) AS archived, left(coalesce(r.pushed_at, ''), 10) AS pushed_at, o.searched_ok
FROM ranked r LEFT JOIN okq o USING (idea_id)"""


@register(sql=PRIOR_ART_SQL)
def q_prior_art_rank(spark, sf):
    out = cd.prior_art_rank(_results(spark, sf), _attempts(spark, sf))
    return out.select("idea_id", F.col("rank").cast("long").alias("rank"), "name", "stars", "description", "url",
                      "archived", "pushed_at", "searched_ok")




@register(sql=PRIOR_ART_SQL.replace("FROM ranked r LEFT JOIN okq o USING (idea_id)",
    "FROM ranked r LEFT JOIN okq o USING (idea_id)), ideas AS (SELECT idea_id, searched_ok FROM okq") .replace(
    "SELECT r.idea_id, r.rank,", ", rr AS (SELECT r.idea_id, r.rank,", 1) + f""")
SELECT i.idea_id, CASE WHEN NOT coalesce(i.searched_ok, false) THEN {q(cd.SEARCH_UNAVAILABLE)}
                       WHEN l.listing IS NULL THEN {q(cd.NO_MATCHES)} ELSE l.listing END AS prior_art
FROM ideas i LEFT JOIN (
  SELECT idea_id, string_agg('- ' || name || ' (' || CAST(stars AS VARCHAR) || ' stars, last push ' || pushed_at
                             || CASE WHEN archived THEN ', ARCHIVED' ELSE '' END || '): ' || description,
                             chr(10) ORDER BY rank) AS listing
  FROM rr GROUP BY 1) l USING (idea_id)""")
def q_prior_art_block(spark, sf):
    """E10 rendering: the three cases of the prior-art block per idea."""
    ranked = cd.prior_art_rank(_results(spark, sf), _attempts(spark, sf))
    ideas = _attempts(spark, sf).groupBy("idea_id").agg(
        ((F.count("*") > 0) & (F.count_if(~F.col("ok")) < F.count("*"))).alias("searched_ok"))
    return cd.prior_art_block(ranked, ideas)

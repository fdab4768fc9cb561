"""Quality rules: a threshold table compiled into one Spark projection.

Every metric is a column expression over the text of one row (no user functions, no
shuffle), and a table of thresholds decides. Repeats are counted on 64-bit hashes of
the five-word windows of one document.

Defined results: a NULL text has no words and fails the base rule, so does an empty or
white-space text; a text of fewer than five words has no window; rows are independent,
so ties and repeated rows get equal results; an empty table gives an empty table; other
columns are carried along by :func:`filter_documents` whatever their names and ignored by
:func:`measure`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, let

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
# frequent short words of the corpus languages (English, German, French, Spanish)
STOP_WORDS = ("the of and to in a is that for it was on with as be at by this from or an are have not "
              "der die das und zu den von mit ist des auf ein eine für als "
              "le la les et de des un une est dans que qui pour sur du en au "
              "el los las y del que con por se su al").split()


@dataclass(frozen=True)
class Rule:
    """Reject a document when ``metric`` (a ratio) is over ``most``, or under ``least``,
    and it has ``min_words`` words at least."""
    name: str
    metric: str
    least: float | None = None
    most: float | None = None
    min_words: int = 0


# The thresholds follow the usual web-corpus heuristics and are loose: prose passes all of them.
RULES = (
    Rule("word_length", "mean_word_chars", least=2.0, most=15.0),
    Rule("symbols", "symbols_per_word", most=0.25),
    Rule("repeated_lines", "dup_line_ratio", most=0.5, min_words=50),
    Rule("stop_words", "stop_word_ratio", least=0.005, min_words=200),
)


def _n(c: Column) -> Column:
    return c.cast("long")


def _windows(words: Column) -> Column:
    """Hash of every five-word window, in text order."""
    n = F.size(words)

    def of(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - F.lit(WINDOW)),
                           lambda i: F.xxhash64(*[F.get(h, i + F.lit(k)) for k in range(WINDOW)]))

    return F.when(n >= WINDOW, let(F.transform(words, lambda w: F.xxhash64(w)), of)).otherwise(
        F.array().cast("array<bigint>"))


def _covered(win: Column) -> Column:
    """Words that lie in a window found twice or more. Windows without a repeat skip the
    sort. Sorted (hash, start) pairs put equal windows side by side; the starts of repeated
    ones, sorted, cover min(5, gap to the next start) words each and the last one five."""
    def gaps(p: Column) -> Column:
        m = F.size(p)
        pair = F.zip_with(F.slice(p, 1, m - 1), F.slice(p, 2, m - 1),
                          lambda a, b: F.least(b - a, F.lit(WINDOW)))
        return F.when(m > 0, F.aggregate(pair, F.lit(WINDOW), lambda acc, g: acc + g)).otherwise(F.lit(0))

    def repeated(s: Column) -> Column:
        m = F.size(s)
        same = F.zip_with(F.slice(s, 1, m - 1), F.slice(s, 2, m - 1), lambda a, b: a["h"] == b["h"])

        def starts(eq: Column) -> Column:
            marked = F.transform(s, lambda x, i: F.when(
                F.coalesce(F.get(eq, i), F.lit(False)) | F.coalesce(F.get(eq, i - 1), F.lit(False)), x["p"]))
            return F.sort_array(F.filter(marked, lambda x: x.isNotNull()))

        return let(let(same, starts), gaps)

    def count(w: Column) -> Column:
        pairs = F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(
            let(F.sort_array(pairs), repeated))

    return let(win, count)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def _facts(text: Column, stop_words=STOP_WORDS) -> Column:
    """One struct of all counts of a text."""
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(w: Column) -> Column:
        return F.struct(
            _n(F.size(w)).alias("n_words"),
            _n(F.length(F.regexp_replace(t, SPACE + "+", ""))).alias("word_chars"),
            _n(F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", ""))).alias("n_symbols"),
            _n(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).alias("n_dup_lines"),
            _n(_covered(_windows(w))).alias("n_repeat_words"), _n(F.size(lines)).alias("n_lines"),
            _n(F.size(F.filter(w, lambda x: F.lower(x).isin(list(stop_words))))).alias("n_stop_words"))

    return let(words, of)


def _ratio(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))


def _metrics() -> dict[str, Column]:
    return {"mean_word_chars": _ratio("word_chars", "n_words"),
            "symbols_per_word": _ratio("n_symbols", "n_words"),
            "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
            "stop_word_ratio": _ratio("n_stop_words", "n_words")}


def _breaks(rule: Rule) -> Column:
    m = _metrics()[rule.metric]
    bad = F.lit(False)
    if rule.least is not None:
        bad = bad | (m < rule.least)
    if rule.most is not None:
        bad = bad | (m > rule.most)
    return bad & (F.col("n_words") >= rule.min_words)


def measure(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text: str = "text", keep: tuple = (),
            stop_words=STOP_WORDS) -> DataFrame:
    """Counts and decision of every document: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, then n_lines, n_stop_words, failed_rules
    (names of the broken rules) and the columns ``keep`` adds (already aliased)."""
    # a generator: neither a later filter nor a projection can make Spark compute the counts twice
    d = docs.select(F.col(id_col).alias("doc_id"), *keep, F.inline(F.array(_facts(F.col(text), stop_words))))
    extra = [c for c in d.columns if c not in ("doc_id", *COUNTS)]
    base = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") >
                                             F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))
    failed = F.filter(F.array(*[F.when(_breaks(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    d = d.select("*", base.alias("base_failed"), failed.alias("failed_rules"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"),
                    "n_lines", "n_stop_words", "failed_rules", *extra)


def filter_documents(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, all columns unchanged."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    one = docs.select(F.lit(0).alias("__id"), F.col(text).alias("__text"), row)
    return measure(one, rules, "__id", "__text", keep=(F.col("__row"),)).filter("kept").select("__row.*")


# ---- registered query and its SQL --------------------------------------------------

def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return measure(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                "base_failed", "kept")


def verdict_sql(rules=RULES, table: str = "documents", stop_words=STOP_WORDS) -> str:
    """DuckDB SQL with one row per row of ``table``: rid, its counts, base_failed and kept."""
    metric = {"mean_word_chars": "word_chars", "symbols_per_word": "n_symbols", "stop_word_ratio": "n_stop_words"}
    bad = []
    for r in rules:
        m = ("coalesce(n_dup_lines / nullif(n_lines, 0)::DOUBLE, 0)" if r.metric == "dup_line_ratio"
             else f"coalesce({metric[r.metric]} / nullif(n_words, 0)::DOUBLE, 0)")
        side = [f"{m} < {r.least}"] * (r.least is not None) + [f"{m} > {r.most}"] * (r.most is not None)
        bad.append(f"(n_words >= {r.min_words} AND ({' OR '.join(side)}))")
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(stop_words))
    space = r"[\x20\x09-\x0D]"
    return rf"""
WITH src AS (SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS t FROM {table}),
wl AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
       [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM src),
w AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM wl),
g AS (SELECT rid, p, x, lead(x, 1) OVER s AS x1, lead(x, 2) OVER s AS x2, lead(x, 3) OVER s AS x3,
      lead(x, 4) OVER s AS x4 FROM w WINDOW s AS (PARTITION BY rid ORDER BY p)),
rep AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, x, x1, x2, x3, x4) AS n FROM g
        WHERE x4 IS NOT NULL) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT p + k) AS n FROM rep, range(5) r(k) GROUP BY rid),
m AS (SELECT s.rid, s.doc_id, len(wl.w)::BIGINT AS n_words,
      length(regexp_replace(s.t, '{space}', '', 'g'))::BIGINT AS word_chars,
      length(regexp_replace(s.t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
      len(wl.l)::BIGINT AS n_lines, (len(wl.l) - len(list_distinct(wl.l)))::BIGINT AS n_dup_lines,
      coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
      len([x for x in wl.w if lower(x) IN ({stops})])::BIGINT AS n_stop_words
      FROM src s JOIN wl USING (rid) LEFT JOIN cov USING (rid)),
b AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM m)
SELECT *, (NOT base_failed AND NOT ({' OR '.join(bad)})) AS kept FROM b"""


OP9_SQL = ("SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM ("
           + verdict_sql() + ")")

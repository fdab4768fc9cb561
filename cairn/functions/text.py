"""Scalar text / date / hash / json functions as Spark column expressions.

Everything here is a built-in expression (whole-stage codegen) except the HTML
entity decoder, which is an Arrow-batched pandas UDF around ``html.unescape``
(the full HTML5 entity table has no built-in equivalent).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- FIXED VALUES ----
# prompt delimiters that must never survive into evidence text
DELIM_RE = r"(?i)</?\s*(evidence|instructions?|system|assistant|human)\s*>"
# reply-subject prefixes (re:, fw:, fwd:, aw:, sv:, antw:), repeated
SUBJECT_PREFIX_RE = r"(?i)^\s*((re|fwd?|aw|sv|antw)\s*:\s*)+"
# the digest's own cut line and phrases that only ever appear in our own text
SENTINEL = "--- reply above this line ---"
OUR_TEXT = ["reply above this line", "name it first", "one per line",
            "timed problems", "patterns due", "sit down and learn"]
# where mail clients start quoting (each is searched separately; earliest wins)
QUOTE_MARKERS = [
    r"(?m)^\s*>",
    r"(?mi)^\s*On .+ wrote:\s*$",
    r"(?mi)^\s*-{2,}\s*Original Message\s*-{2,}",
    r"(?m)^\s*_{10,}\s*$",
    r"(?m)^\s*From:\s.+$",
    r"(?mi)^\s*Sent from my \w+",
]
FENCE_RE = r"(?s)```(?:json)?\s*([\[{].*?[\]}])\s*```"
MINUTES_RE = r"(?i)\b(\d{1,3})\s*(?:m|min|mins|minutes)\b"


def full_trim(c: Column) -> Column:
    """Strip leading/trailing whitespace of every kind (``trim`` only strips spaces)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


@F.pandas_udf(T.StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    import html
    return s.map(lambda x: html.unescape(x) if isinstance(x, str) and "&" in x else x)


def strip_delims(c: Column) -> Column:
    return F.regexp_replace(c, DELIM_RE, "")


def clean_html(c: Column) -> Column:
    """B1, order matters: <p> -> blank line, </p> -> newline, drop tags, decode
    entities, drop prompt delimiters (after decoding), collapse 3+ newlines, trim."""
    t = F.replace(F.replace(c, F.lit("<p>"), F.lit("\n\n")), F.lit("</p>"), F.lit("\n"))
    t = F.regexp_replace(t, r"<[^>]+>", "")
    t = html_unescape(t)
    t = strip_delims(t)
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return full_trim(t)


def flatten(c: Column, limit: int | None = None) -> Column:
    """B2: whitespace runs -> one space and trimmed, then delimiters removed, then cut."""
    t = strip_delims(full_trim(F.regexp_replace(c, r"(?U)\s+", " ")))
    return F.left(t, F.lit(limit)) if limit else t


def reply_html_to_text(c: Column) -> Column:
    """Drop script/style blocks, <br>/</p> -> newline, other tags -> space, decode."""
    t = F.regexp_replace(c, r"(?is)<(script|style).*?</\1>", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</p>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    return html_unescape(t)


def parse_epoch(c: Column) -> Column:
    """ISO-8601 text (offset, ``Z`` or naive-as-UTC) -> epoch seconds, NULL when
    missing or unparseable (the session time zone is UTC)."""
    return F.unix_timestamp(F.try_to_timestamp(F.nullif(F.trim(c), F.lit(""))))


def epoch_date(c: Column) -> Column:
    """Epoch seconds -> 'yyyy-MM-dd' (UTC)."""
    return F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd")


def embed_text(title: Column, text: Column) -> Column:
    """Exactly what gets embedded for a signal."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.left(F.coalesce(text, F.lit("")), F.lit(1200)))


def cache_key(model: str, text: Column) -> Column:
    """sha1(model \\n text)."""
    return F.sha1(F.concat(F.lit(model + "\n"), text))


def message_key(date: Column, body: Column) -> Column:
    """B7: 'sha:' + first 24 hex of sha1(date + body), for messages without an id."""
    return F.concat(F.lit("sha:"), F.left(F.sha1(F.concat(F.coalesce(date, F.lit("")), body)), F.lit(24)))


def idea_text(title: Column, one_liner: Column, problem: Column) -> Column:
    """Title / one_liner / problem on three lines (missing -> empty line), trimmed."""
    e = F.lit("")
    return full_trim(F.concat(F.coalesce(title, e), F.lit("\n"), F.coalesce(one_liner, e),
                              F.lit("\n"), F.coalesce(problem, e)))


def slugify(title: Column) -> Column:
    """Lower, non [a-z0-9] runs -> '-', strip '-', first 60, default 'idea'."""
    s = F.regexp_replace(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    s = F.left(s, F.lit(60))
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit("idea")).otherwise(s)


def lenient_json(c: Column) -> Column:
    """Fenced ```json block if present, else the raw text; parsed as-is, else
    its outermost [...] then outermost {...}; NULL when nothing parses."""
    fence = F.regexp_extract(c, FENCE_RE, 1)
    cand = F.when(fence != "", fence).otherwise(c)
    arr = F.regexp_extract(cand, r"(?s)(\[.*\])", 1)
    obj = F.regexp_extract(cand, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(cand), F.try_parse_json(F.nullif(arr, F.lit(""))),
                      F.try_parse_json(F.nullif(obj, F.lit(""))))


def normalize_subject(c: Column) -> Column:
    """Strip repeated reply/forward prefixes, trim, lower."""
    return F.lower(full_trim(F.regexp_replace(F.coalesce(c, F.lit("")), SUBJECT_PREFIX_RE, "")))


def strip_quoted(body: Column) -> Column:
    """Cut at the sentinel if present, else at the earliest quote marker."""
    sent = F.instr(body, SENTINEL)
    hits = [F.regexp_instr(body, F.lit(m)) for m in QUOTE_MARKERS]
    firsts = F.array_min(F.filter(F.array(*hits), lambda x: x > 0))
    cut = F.when(sent > 0, sent).when(firsts.isNotNull(), firsts)
    kept = F.when(cut.isNotNull(), F.substring(body, F.lit(1), cut - 1)).otherwise(body)
    return full_trim(kept)


def looks_like_own_text(text: Column) -> Column:
    """Two or more of our own phrases survived quote stripping."""
    low = F.lower(text)
    n = F.aggregate(F.transform(F.array(*[F.lit(p) for p in OUR_TEXT]),
                                lambda p: F.contains(low, p).cast("int")), F.lit(0), lambda a, x: a + x)
    return n >= 2


def minutes(text: Column) -> Column:
    """First '<n> m|min|mins|minutes' as an int, else NULL."""
    m = F.regexp_extract(text, MINUTES_RE, 1)
    return F.when(m != "", m.cast("int"))


def weekday_in_zone(epoch: Column, tz: str) -> Column:
    """Monday=0 weekday of an epoch instant in a named zone (bad zone -> UTC)."""
    import zoneinfo
    try:
        zoneinfo.ZoneInfo(tz)
    except Exception:  # noqa: BLE001 - any unknown/garbled zone name falls back
        tz = "UTC"
    return F.weekday(F.from_utc_timestamp(F.timestamp_seconds(epoch), tz))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two float arrays (cosine for unit vectors)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def clamp_mul(w: Column, f: Column, lo: float = 0.1, hi: float = 4.0) -> Column:
    """max(lo, min(hi, w * f))."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), w * f))

"""Lexicon scoring as column expressions (word-boundary regexes, JVM side).

A term ending in ``*`` is a stem (``shard*`` matches shards / sharding); any other
term must match as a whole word. Matching is case-insensitive and Unicode-aware:
Java's ``\\b`` / ``\\w`` only follow Unicode under ``(?U)``.

Patterns are built once on the driver from the (small, bounded) lexicon and passed
as literals, so each task compiles each regex once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import DOMAINS, NOISE_TITLES, PAIN_MARKERS

_META = set(".^$*+?()[]{}|\\")


def _escape(s: str) -> str:
    return "".join("\\" + ch if ch in _META else ch for ch in s)


def _body(term: str) -> str:
    if term.endswith("*"):
        return _escape(term[:-1]) + r"\w*"
    return _escape(term) + r"\b"


def term_regex(term: str) -> str:
    return r"\b" + _body(term)


def compile_terms(terms: list[str], flags: str = "(?iU)") -> str:
    r"""Alternation in list order (leftmost alternative wins at a position). The
    leading word boundary is shared by every alternative, so it is factored out:
    ``\b(?:a\b|b\w*)`` matches exactly what ``\ba\b|\bb\w*`` matches."""
    return flags + r"\b(?:" + "|".join(_body(t) for t in terms) + ")"


def distinct_hits(text: Column, pattern: str) -> Column:
    """Number of distinct lower-cased strings found by a left-to-right,
    non-overlapping scan. Overlapping phrases therefore count once."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    return F.size(F.array_distinct(F.transform(found, F.lower)))


def domain_scores(text: Column, domains: dict[str, list[str]] = DOMAINS) -> Column:
    """struct<domain: int, ...> of per-domain distinct-term counts."""
    return F.struct(*[distinct_hits(text, compile_terms(terms)).alias(d)
                      for d, terms in domains.items()])


def best_domain(scores: Column, domains: dict[str, list[str]] = DOMAINS) -> Column:
    """struct<domain, hits>: argmax, ties to the earliest declared domain, and
    (NULL, 0) when nothing matched."""
    cands = [F.struct(scores[d].alias("hits"), F.lit(-i).alias("neg_ord"), F.lit(d).alias("domain"))
             for i, d in enumerate(domains)]
    top = F.array_max(F.array(*cands))
    return F.struct(F.when(top["hits"] > 0, top["domain"]).alias("domain"),
                    top["hits"].cast("int").alias("hits"))


def pain_score(text: Column, markers: list[str] = PAIN_MARKERS) -> Column:
    return distinct_hits(text, compile_terms(markers))


def is_technical(scores: Column, domains: dict[str, list[str]] = DOMAINS, min_hits: int = 2) -> Column:
    total = sum((scores[d] for d in domains), F.lit(0))
    return total >= min_hits


def is_noise_title(title: Column, noise: list[str] = NOISE_TITLES) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    return F.exists(F.array(*[F.lit(n) for n in noise]), lambda n: F.contains(low, n))


def folded(text: Column) -> Column:
    """``text`` with every character that a pattern without case takes for an ASCII letter made that letter."""
    return F.lower(F.translate(text, "\u017f\u0131\u0130\u212a", "siik"))


def matched_terms(text: Column, domain: Column | None = None, domains: dict[str, list[str]] = DOMAINS,
                  plain: Column | None = None) -> Column:
    """One hit per lexicon *entry* (a stem's variants collapse), lower-cased first
    match of each entry. The requested domain's entries come first, then the
    declared order; an entry listed in two domains is reported once. ``plain``, the ``folded`` text in a column of
    its own, spares the pattern of an entry whose letters the text does not hold."""
    entries: list[str] = []
    for terms in domains.values():
        for t in terms:
            if t not in entries:
                entries.append(t)
    hit = {t: F.lower(F.regexp_extract(text, "(?iU)" + term_regex(t), 0)) for t in entries}
    if plain is not None:
        hit = {t: F.when(F.contains(plain, F.lit(t.removesuffix("*").lower())), h).otherwise(F.lit("")) if t.isascii() else h
               for t, h in hit.items()}

    def ordered(first: str | None) -> Column:
        order: list[str] = []
        seq = ([first] if first else []) + [d for d in domains if d != first]
        for d in seq:
            for t in domains[d]:
                if t not in order:
                    order.append(t)
        return F.filter(F.array(*[hit[t] for t in order]), lambda x: x != "")

    if domain is None:
        return ordered(None)
    expr = F.when(F.lit(False), F.lit(None))
    for d in domains:
        expr = expr.when(domain == d, ordered(d))
    return expr.otherwise(ordered(None))

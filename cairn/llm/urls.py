"""URL filter by a bit-parallel wildcard automaton.

Rules and globs become one non-deterministic automaton whose states are bits: a glob of m symbols takes
m + 1 neighbouring bits, and all globs are packed one after the other into 64-bit words. A byte c of the URL
moves every state of every glob at once (Shift-And):

    D' = (D << 1) & step[c]  |  D & stay[c]

``step[c]`` has the states that a c leads into, ``stay[c]`` those whose wildcard takes a c and stays.
The shift carries from word to word; the first bit of a glob is never stepped into, so globs don't mix.
A batch of URLs is run column by column, one row of words for each URL.

Globs match the whole canonical URL (host, path and query, see ``canonical``): ``*`` is any run without
``/`` ``?`` ``#``, ``**`` any run, ``?`` one code point that ``*`` takes, ``\\`` makes the next character plain.

A rule (host, path) fits its host and all subdomains where the path starts with the rule's; it is two
globs, `host path **` and `*.host path **`. Of the rules that fit, the longest wins (by host and path together, then
by host; then block before allow). Without one, the method's own globs (``BLOCKED``) decide: a URL that
one fits is blocked, others are allowed.

Defined results: NULL and texts without ``://`` have an empty host and path, no rule, and are blocked;
hosts keep ports and names as written, A-Z in lower case; repeated rows stay, an empty table gives an empty
table, other columns are ignored; a URL may be of any length (time is linear in it).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship_package

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
# pages that hold no prose: advertising hosts, files, accounts, baskets, searches, session links
BLOCKED = ("ad.*/**", "ads.*/**", "adserver.*/**", "*.doubleclick.*/**",
           "**/login", "**/login/**", "**/signin", "**/signin/**", "**/cart", "**/cart/**", "**/checkout/**", "**/wp-admin/**",
           "**/cgi-bin/**", "**/search\\?**", "**/**.exe", "**/**.zip", "**/**.jpg", "**/**.png", "**/**.gif", "**/**.pdf",
           "**\\?**sessionid=**", "**\\?**phpsessid=**")
U64 = np.uint64
_CELLS = 1 << 22          # words or bytes that a block of URLs may take
_LONG = 4096              # longer URLs are run one by one on whole numbers
_BREAKS = b"/?#"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host in lower case, path and query; no scheme, no fragment."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)://[^?#]*(\?[^#]*)", 1), F.lit(""))
    return F.concat(host_of(url), path_of(url), query)


def plain(text: str) -> str:
    """``text`` as a glob that matches just itself."""
    return "".join("\\" + c if c in "*?\\" else c for c in text)


def rule_globs(host: str, path: str) -> list[str]:
    host = plain(host.lower())
    ends = [plain(path) + "**"] if path else ["", "/**", "\\?**"]
    return [f"{front}{host}{end}" for front in ("", "*.") for end in ends]


def symbols(glob: str) -> list[tuple[str, bytes]]:
    """The glob's symbols: ("run", ""), ("any", ""), ("one", "") or ("byte", b)."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**", i):
            out.append(("any", b""))
            i += 2
            continue
        if glob[i] == "\\" and i + 1 < len(glob):
            i += 1
            out += [("byte", bytes([b])) for b in glob[i].encode()]
        elif glob[i] == "*":
            out.append(("run", b""))
        elif glob[i] == "?":
            out.append(("one", b""))
        else:
            out += [("byte", bytes([b])) for b in glob[i].encode()]
        i += 1
    return out


class Automaton:
    """Masks of a list of globs: ``step`` and ``stay`` [256, words], ``first`` and ``final`` [words]."""

    def __init__(self, globs):
        self.starts, self.ends = [], []
        step, stay, at = {}, {}, 0              # state -> accepted bytes
        inside = np.array([c not in _BREAKS for c in range(256)])
        lead = inside & np.array([not 0x80 <= c < 0xC0 for c in range(256)])
        follow = np.array([0x80 <= c < 0xC0 for c in range(256)])
        for glob in globs:
            self.starts.append(at)
            for kind, b in symbols(glob):
                if kind in ("run", "any"):      # a loop on the state that has been reached
                    stay[at] = stay.get(at, False) | (inside if kind == "run" else np.ones(256, bool))
                    continue
                at += 1
                if kind == "one":               # the rest of a code point stays
                    step[at], stay[at] = lead, follow
                else:
                    step[at] = np.arange(256) == b[0]
            self.ends.append(at)
            at += 1
        self.words = max(1, -(-at // 64))
        self.step, self.stay = self._masks(step), self._masks(stay)
        self.first, self.final = self._bits(self.starts), self._bits(self.ends)

    def _masks(self, accepted):
        out = np.zeros((256, self.words), U64)
        for state, bytes_ in accepted.items():
            out[bytes_, state >> 6] |= U64(1) << U64(state & 63)
        return out

    def _bits(self, states):
        out = np.zeros(self.words, U64)
        for s in states:
            out[s >> 6] |= U64(1) << U64(s & 63)
        return out

    def run(self, urls: list[bytes]) -> np.ndarray:
        """[urls, globs] booleans: which globs match which URL."""
        ends = np.array(self.ends, np.int64)
        out = np.zeros((len(urls), len(ends)), bool)
        order = sorted(range(len(urls)), key=lambda i: len(urls[i]))
        at = 0
        while at < len(order):
            if len(urls[order[at]]) > _LONG:
                found = self._one(urls[order[at]])
                out[order[at]] = [found >> e & 1 for e in self.ends]
                at += 1
                continue
            size = 1
            while (at + size < len(order) and size < 1 << 14 and (n := len(urls[order[at + size]])) <= _LONG
                   and (size + 1) * max(n, 2 * self.words) <= _CELLS):
                size += 1
            block = order[at:at + size]
            d = self._block([urls[i] for i in block])
            out[block] = (d[:, ends >> 6] >> (ends & 63).astype(U64) & U64(1)).astype(bool)
            at += size
        return out

    def _block(self, urls: list[bytes]) -> np.ndarray:
        """States after the last byte; URLs rise in length, so those still running are a tail."""
        sizes = np.array([len(u) for u in urls])
        text = np.zeros((len(urls), int(sizes[-1])), np.uint8)
        for i, u in enumerate(urls):
            text[i, :len(u)] = np.frombuffer(u, np.uint8)
        d = np.tile(self.first, (len(urls), 1))
        for t in range(text.shape[1]):
            live = int(np.searchsorted(sizes, t, "right"))
            now, c = d[live:], text[live:, t]
            moved = now << U64(1)
            moved[:, 1:] |= now[:, :-1] >> U64(63)
            d[live:] = moved & self.step[c] | now & self.stay[c]
        return d

    def _one(self, url: bytes) -> int:
        """The same with one whole number of all words."""
        def whole(mask):
            return int.from_bytes(mask.astype("<u8").tobytes(), "little")
        step, stay = ([whole(m) for m in masks] for masks in (self.step, self.stay))
        d = whole(self.first)
        for c in url:
            d = d << 1 & step[c] | d & stay[c]
        return d


def judge(pages: DataFrame, url: str = "url", rules=RULES, blocked=BLOCKED) -> DataFrame:
    """``pages`` with host, path, rule, verdict and glob (the method's own that matched) in place of columns of those names."""
    ship_package(pages.sparkSession)
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block", r[1:]))
    globs, owner = [], []
    for i, (_, host, path) in enumerate(ranked):
        for g in rule_globs(host, path):
            globs.append(g)
            owner.append(i)
    n_rule_globs = len(globs)
    globs += list(blocked)

    @F.pandas_udf("rule int, glob int")
    def match(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = Automaton(globs)

        def first(hits):
            return np.where(hits.any(axis=1), hits.argmax(axis=1), -1) if hits.shape[1] else np.full(len(hits), -1)

        of = np.array(owner + [-1])
        for part in parts:
            hits = automaton.run([u.encode("utf-8", "surrogatepass") for u in part])
            rule, glob = first(hits[:, :n_rule_globs]), first(hits[:, n_rule_globs:])
            yield pd.DataFrame({"rule": np.where(rule < 0, -1, of[rule]), "glob": glob})

    u = F.col(url)
    known = u.isNotNull() & u.contains("://")
    names = F.array(*[F.lit(h.lower() + p) for _, h, p in ranked]) if ranked else F.array(F.lit(""))
    says = F.array(*[F.lit(v) for v, _, _ in ranked]) if ranked else F.array(F.lit(""))
    own = F.array(*[F.lit(g) for g in blocked]) if blocked else F.array(F.lit(""))
    rule, glob = F.col("__match.rule"), F.col("__match.glob")
    return (pages.withColumn("__match", match(F.coalesce(canonical(u), F.lit(""))))
            .withColumns({"host": host_of(u), "path": path_of(u),
                          "rule": F.when(known & (rule >= 0), names[F.greatest(rule, F.lit(0))]),
                          "glob": F.when(known & (glob >= 0), own[F.greatest(glob, F.lit(0))]),
                          "verdict": F.when(~known, "block").when(rule >= 0, says[F.greatest(rule, F.lit(0))])
                          .when(glob >= 0, "block").otherwise("allow")})
            .drop("__match"))


# ---- registered query ------------------------------------------------------------------

def op11_wildcard_urls(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


def _regex(glob: str) -> str:
    """The glob as an expression of DuckDB."""
    out, plain_next, i = "", False, 0
    while i < len(glob):
        c = glob[i]
        if plain_next or c not in "*?\\":
            out, plain_next = out + (c if c.isalnum() else "\\" + c), False
        elif c == "\\":
            plain_next = True
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 1
        else:
            out += "[^/?#]*" if c == "*" else "[^/?#]"
        i += 1
    return out


_FITS = " UNION ALL ".join(f"SELECT '{v}' AS v, '{h}' AS h, '{p}' AS p" for v, h, p in RULES)
OP11_SQL = f"""
WITH parts AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
         coalesce(regexp_extract(url, '://[^?#]*(\\?[^#]*)', 1, 's'), '') AS query,
         coalesce(contains(url, '://'), false) AS known, row_number() OVER () AS k
  FROM pages),
rules AS ({_FITS}),
best AS (
  SELECT k, arg_min(h || p, -length(h || p)) AS rule, arg_min(v, -length(h || p)) AS v
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) AND known
  GROUP BY k)
SELECT page_id, host, path, rule,
       CASE WHEN NOT known THEN 'block' WHEN rule IS NOT NULL THEN v
            WHEN {" OR ".join(f"regexp_full_match(host || path || query, '{_regex(g)}', 's')" for g in BLOCKED)} THEN 'block'
            ELSE 'allow' END AS verdict
FROM parts LEFT JOIN best USING (k)"""

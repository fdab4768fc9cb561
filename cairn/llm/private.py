"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, schemes and identifier
cues. From each, a small local parser grows and checks the span, so nothing is searched where
no anchor stands; runs of digits are the anchors of addresses and cards, a country code with two
digits that of an IBAN without a cue (both by expression: as words of the automaton they would stand everywhere).

Kinds, in the order of the output: email, ip, card, phone (the base rules: leftmost,
not overlapping within a kind, failing matches dropped), then the method's own: url
(scheme://host...), handle (@name that is no email), iban (cue or country code, checked mod
97), account (cue, then an identifier with four digits at least).

Defined results: NULL and empty texts have no span (the SHA-256 is that of the empty text); a
text is read whole; rows are independent, repeated rows give equal results; an empty table gives
an empty table; other columns are ignored. Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

import functools
import hashlib
import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package

KINDS = ("email", "ip", "card", "phone", "url", "handle", "iban", "account")
BASE_KINDS = KINDS[:4]
SCHEMES = ("http://", "https://", "ftp://", "ftps://", "sftp://", "ssh://", "www.")
CUES = {"iban": "iban", "account": "account", "acct": "account", "customer id": "account", "user id": "account",
        "member id": "account", "passport": "account", "ssn": "account", "social security": "account",
        "tax id": "account", "routing number": "account", "license number": "account", "policy number": "account",
        "konto": "account", "kontonummer": "account", "cuenta": "account", "compte": "account"}

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_LOCAL_BACK = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL_TAIL = re.compile(r"[^\s\"'<>`{}|\\^\x00-\x20]+")
_HANDLE = re.compile(r"[A-Za-z0-9_]{2,30}(?![A-Za-z0-9_@])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]){11,30}")
_COUNTRY = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=[ -]?[A-Z0-9])")
_GAP = re.compile(r"(?:[ \t]*(?:number|no|nr|num|is|code)\b\.?)?[ \t]*[:#=]?[ \t]*", re.I)
_IDENT = re.compile(r"[A-Za-z0-9](?:[-./ ]?[A-Za-z0-9]){3,33}")
_UPPER = re.compile("[A-Z]+")
_WORD_CHAR = re.compile(r"\w")


@functools.lru_cache(maxsize=1)
def anchors():
    import ahocorasick
    a = ahocorasick.Automaton()
    for word in ("@", "+", *SCHEMES, *CUES):
        a.add_word(word, word)
    a.make_automaton()
    return a


def _lower(text: str) -> str:
    """A-Z lower-cased only, so offsets stay."""
    return text.lower() if text.isascii() else _UPPER.sub(lambda m: m.group().lower(), text)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str, ats: list) -> list:
    """From each at-sign back over the local part, no further than the last match, and on over
    the domain."""
    out, low = [], 0
    for at in ats:
        start = at
        while start > low and text[start - 1] in _LOCAL_BACK:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            low = m.end()
    return out


def _ips(text: str) -> list:
    def part(p: str) -> bool:
        p = p.lstrip("0")
        return len(p) < 3 or (len(p) == 3 and p <= "255")

    return [m.span() for m in _IP.finditer(text) if all(map(part, m.group().split(".")))]


def _cards(text: str) -> list:
    out = []
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def _phones(text: str, pluses: list) -> list:
    out, low = [], 0
    for at in pluses:
        if at >= low and (m := _PHONE.match(text, at)):
            low = m.end()
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append(m.span())
    return out


def _url(text: str, start: int, after: int):
    m = _URL_TAIL.match(text, after)
    if not m:
        return None
    end = m.end()
    while end > after and text[end - 1] in ".,;:!?)]*'":
        end -= 1
    host = re.split(r"[/?#]", text[after:end], maxsplit=1)[0].rpartition("@")[2].partition(":")[0]
    return (start, end) if "." in host.strip(".") else None


def iban_ok(raw: str) -> bool:
    s = raw.replace(" ", "").replace("-", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _iban(text: str, at: int):
    """The longest prefix at ``at`` that passes the check sum."""
    m = _IBAN.match(text, at)
    if not m:
        return None
    for end in range(m.end(), at + 14, -1):
        if text[end - 1] not in " -" and iban_ok(text[at:end]):
            return (at, end)
    return None


def _account(text: str, at: int):
    m = _IDENT.match(text, at)
    if not m:
        return None
    parts, end = re.split(r"([ ./-])", m.group()), at
    got = ""
    for i in range(0, len(parts), 2):                 # words after the identifier have no digit
        if not any(c.isdigit() for c in parts[i]):
            break
        got += parts[i]
        end += len(parts[i]) + (len(parts[i - 1]) if i else 0)
    return (at, end) if sum(c.isdigit() for c in got) >= 4 else None


def _union(spans: list) -> list:
    """The places that the spans cover, as spans that do not touch each other, in order."""
    out: list = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spans_of(text: str | None) -> dict:
    """Sorted (start, end) lists by kind."""
    text = text or ""
    out = {k: [] for k in KINDS}
    if not text:
        return out
    ats, pluses, urls, cues = [], [], [], []
    for end, word in anchors().iter(_lower(text)):
        start = end + 1 - len(word)
        if word == "@":
            ats.append(start)
        elif word == "+":
            pluses.append(start)
        elif word in CUES:
            cues.append((start, end + 1, word))
        else:
            urls.append((start, end + 1, word))
    out["email"], out["phone"] = _emails(text, ats), _phones(text, pluses)
    out["ip"], out["card"] = _ips(text), _cards(text)
    low = 0
    for start, after, word in sorted(urls):
        if start < low or (start and _WORD_CHAR.match(text, start - 1)):
            continue
        if span := _url(text, start, start if word == "www." else after):
            out["url"].append(span)
            low = span[1]
    taken = _union(out["email"] + out["url"])
    begins = [a for a, _ in taken]
    for at in ats:
        if at and (_WORD_CHAR.match(text, at - 1) or text[at - 1] in ".%+-@/"):
            continue
        m = _HANDLE.match(text, at + 1)
        before = bisect_right(begins, at) - 1
        if m and any(c.isalpha() for c in m.group()) and not (before >= 0 and at < taken[before][1]):
            out["handle"].append((at, m.end()))
    done = {"iban": 0, "account": 0}
    for start, after, word in sorted(cues):
        if start and _WORD_CHAR.match(text, start - 1):
            continue
        kind, at = CUES[word], _GAP.match(text, after).end()
        if at == after:
            continue
        for k, parse in (("iban", _iban), ("account", _account)):
            if (k == kind or k == "iban") and at >= done[k] and (span := parse(text, at)):
                out[k].append(span)
                done[k] = span[1]
                break
    # country codes are anchors of their own, where no cue has led to the number
    known = _union(out["iban"])
    begins, low = [a for a, _ in known], 0
    for m in _COUNTRY.finditer(text):
        at = m.start()
        before = bisect_right(begins, at) - 1
        if at >= low and not (before >= 0 and at < known[before][1]) and (span := _iban(text, at)):
            after = before + 1
            if after == len(known) or span[1] <= known[after][0]:
                out["iban"].append(span)
                low = span[1]
    out["iban"].sort()
    return out


def joined(spans: dict, kinds) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, then the counts of the
    method's own kinds."""
    ship_package(docs.sparkSession)

    def run(frames):
        import pandas as pd
        for frame in frames:
            rows = []
            for x in frame["text"]:
                s = spans_of(x)
                rows.append((*(len(s[k]) for k in BASE_KINDS), hashlib.sha256(joined(s, BASE_KINDS).encode()).hexdigest(),
                             joined(s, KINDS), *(len(s[k]) for k in KINDS[4:])))
            out = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans",
                                              *(f"n_{k}" for k in KINDS[4:])])
            out.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield out

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return d.mapInPandas(run, f"doc_id {dict(d.dtypes)['doc_id']}, " + ", ".join(f"n_{k} long" for k in BASE_KINDS)
                         + ", base_sha256 string, spans string, " + ", ".join(f"n_{k} long" for k in KINDS[4:]))


# ---- registered query (tests compare with the plain regular expressions) ----

def op4_private_spans(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""License scans: ordered signature rules with a keyword prefilter.

A text becomes its words (A-Z lower-cased, ASCII punctuation dropped) joined by single spaces.
Families of hand-written signatures, written out per version and form, give some hundred
regular expressions over that line; a rule runs only when its keyword occurs. Detections are
word intervals: by priority, then length, then place, one is taken unless it lies inside a
taken one of the same or higher priority.

Defined results: NULL and empty texts have no words, no places and score 0; a text is scanned
whole; rows are independent, repeated rows give equal results; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package

#: phrases and labels of the base scan
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
BASE_SCORE = 0.5
TAG, NOTICE, NAME, HINT = 100, 80, 60, 40     # priorities: tag, notice text, named license, hint
SCORES = {TAG: 1.0, NOTICE: 0.95, NAME: 0.8, HINT: 0.6}

#: (label, keyword, versions, names): a named license with its versions
VERSIONED = (
    ("apache", "apache", ("1 0", "1 1", "2 0"), ("apache (?:software )?license(?: version| v)?", "apache")),
    ("mpl", "mozilla", ("1 0", "1 1", "2 0"), ("mozilla public license(?: version| v)?",)),
    ("mpl", "mpl", ("1 0", "1 1", "2 0"), ("mpl(?: version| v)?",)),
    ("epl", "eclipse", ("1 0", "2 0"), ("eclipse public license(?: version| v)?",)),
    ("cddl", "cddl", ("1 0", "1 1"), ("cddl(?: version| v)?",)),
    ("cddl", "common development", ("1 0", "1 1"), ("common development and distribution license(?: version| v)?",)),
    ("eupl", "european union", ("1 0", "1 1", "1 2"), ("european union public licen[cs]e(?: version| v)?",)),
    ("afl", "academic free", ("1 1", "1 2", "2 0", "2 1", "3 0"), ("academic free license(?: version| v)?",)),
    ("osl", "open software license", ("1 0", "1 1", "2 0", "2 1", "3 0"), ("open software license(?: version| v)?",)),
    ("artistic", "artistic", ("1 0", "2 0"), ("artistic license(?: version| v)?",)),
    ("bsl", "boost", ("1 0",), ("boost software license(?: version| v)?",)),
    ("lppl", "latex project", ("1 0", "1 1", "1 2", "1 3"), ("latex project public license(?: version| v)?",)),
    ("gfdl", "free documentation", ("1 1", "1 2", "1 3"), ("gnu free documentation license(?: version| v)?",)),
    ("odbl", "open database", ("1 0",), ("open database license(?: version| v)?",)),
)
#: (label, name of the license between "gnu" and "license", short names)
GNU = (("gpl", "general public", ("gnu gpl", "gpl")),
       ("lgpl", "(?:lesser|library) general public", ("gnu lgpl", "lgpl")),
       ("agpl", "affero general public", ("gnu agpl", "agpl")))
GNU_VERSIONS = {"gpl": ("1", "2", "3"), "lgpl": ("2", "2 1", "3"), "agpl": ("1", "3")}
GNU_FORMS = (("", ""), ("-or-later", " or (?:at your option )?(?:any )?later(?: version)?"), ("-only", " only"))
#: elements of Creative Commons licenses: label part, short form, long form
CC = (("by", "by", "attribution"),
      ("by-sa", "by sa", "attribution share ?alike"),
      ("by-nd", "by nd", "attribution no ?deriv(?:ative)?s?(?: works)?"),
      ("by-nc", "by nc", "attribution non ?commercial"),
      ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
      ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"))
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: SPDX identifiers in word form besides those made from the tables above
SPDX = ("mit", "isc", "zlib", "unlicense", "wtfpl", "0bsd", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "cc0 1 0",
        "ncsa", "postgresql", "python 2 0", "ruby", "x11", "vim", "ofl 1 1", "ms pl", "ms rl", "blueoak 1 0 0")
#: (label, priority, keyword, signature): texts of licenses and other statements
STATEMENTS = (
    ("mit", NOTICE, "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", NAME, "mit license", "(?:the )?mit license"),
    ("mit", NAME, "mit license", "(?:licensed|released|distributed) under (?:the )?(?:terms of the )?mit(?: license)?"),
    ("isc", NOTICE, "permission to use", "permission to use copy modify and or distribute this software for any purpose"),
    ("isc", NAME, "isc license", "isc license"),
    ("bsd", NOTICE, "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-4-clause", NOTICE, "advertising materials", "all advertising materials mentioning features or use of this software"),
    ("bsd-3-clause", NOTICE, "endorse or promote", "(?:neither the names? of|the names? of) .{3,80}? (?:may|be used to) .{0,40}?endorse or promote products"),
    ("bsd-2-clause", NAME, "bsd", "(?:simplified|freebsd|2 clause|two clause) bsd(?: license)?|bsd 2 clause"),
    ("bsd-3-clause", NAME, "bsd", "(?:new|modified|revised|3 clause|three clause) bsd(?: license)?|bsd 3 clause"),
    ("bsd", NAME, "bsd", "bsd license|bsd style license"),
    ("zlib", NOTICE, "provided as is without", "this software is provided as is without any express or implied warranty in no event"),
    ("zlib", NAME, "zlib", "zlib(?: libpng)? license"),
    ("unlicense", NOTICE, "released into the public domain", "free and unencumbered software released into the public domain"),
    ("unlicense", NAME, "unlicense", "the unlicense"),
    ("wtfpl", NAME, "wtfpl", "wtfpl"),
    ("wtfpl", NAME, "what the fuck", "do what the fuck you want to public license"),
    ("apache-2-0", NOTICE, "apache license", "licensed under the apache license version 2 0"),
    ("apache-2-0", NOTICE, "apache org licenses", "apache org licenses license 2 0"),
    ("gpl", NOTICE, "free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", NOTICE, "free software", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", NOTICE, "affero", "under the terms of the gnu affero general public license"),
    ("gpl", NOTICE, "published by the free software foundation", "published by the free software foundation"),
    ("cc0", NAME, "cc0", "(?:creative commons )?cc0(?: 1 0)?(?: universal)?"),
    ("cc0", NAME, "creative commons zero", "creative commons zero"),
    ("cc0", NOTICE, "publicdomain zero", "creativecommons org publicdomain zero 1 0"),
    ("public-domain", NAME, "public domain", "(?:dedicated to|released into|placed in|in) the public domain"),
    ("public-domain", HINT, "public domain", "public domain"),
    ("creative-commons", HINT, "creative commons", "creative commons(?: licen[cs]e)?"),
    ("ofl-1-1", NAME, "sil open font", "sil open font license(?: version)?(?: 1 1)?"),
    ("ms-pl", NAME, "microsoft public", "microsoft public license"),
    ("ms-rl", NAME, "microsoft reciprocal", "microsoft reciprocal license"),
    ("ncsa", NAME, "ncsa", "(?:university of illinois )?ncsa open source license"),
    ("psf", NAME, "python software foundation", "python software foundation license"),
    ("proprietary", NAME, "proprietary", "proprietary and confidential|confidential and proprietary|proprietary license"),
    ("proprietary", NOTICE, "without prior written", "no part of this .{0,40}?may be reproduced .{0,120}?without (?:the )?prior written (?:permission|consent)"),
    ("no-redistribution", NAME, "redistribut", "redistribution (?:is )?(?:strictly )?prohibited|may not be redistributed"),
    ("reserved", NOTICE, "rights reserved", "all rights (?:are )?reserved worldwide"),
    ("reserved", HINT, "rights reserved", "(?:some|all) rights (?:are )?reserved"),
    ("copyright", HINT, "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?"),
    ("copyright", HINT, "copyrighted", "copyrighted (?:work|material)"),
    ("permissive", HINT, "free to use", "free to use(?: copy)?(?: and)?(?: modify)? for (?:any|commercial|non commercial) (?:purpose|use)s?"),
    ("non-commercial", HINT, "commercial use", "(?:for )?non ?commercial use only|not for commercial use"),
    ("open-government", NAME, "open government", "open government licen[cs]e(?: v(?:ersion)? ?[0-9](?: 0)?)?"),
)


@dataclass(frozen=True)
class Signature:
    label: str
    priority: int
    keyword: bytes
    pattern: re.Pattern


def _signature(label: str, priority: int, keyword: str, pattern: str) -> Signature:
    return Signature(label, priority, keyword.encode(), re.compile(rb"(?<= )(?:" + pattern.encode() + rb")(?= )"))


@functools.lru_cache(maxsize=1)
def signatures() -> tuple:
    """The rules in order of priority."""
    out, tags = [], [(s, s) for s in SPDX]
    for label, keyword, versions, names in VERSIONED:
        for name in names:
            for v in versions:
                out.append((f"{label}-{v.replace(' ', '-')}", NAME, keyword, f"{name} {v}"))
        out.append((label, HINT, keyword, names[0]))
        tags += [(f"{label} {v}", f"{label} {v}") for v in versions]
    for label, name, short in GNU:
        for v in GNU_VERSIONS[label]:
            number = f"(?:v|version )?{v}(?: 0)?" if len(v) == 1 else f"(?:v|version )?{v}"
            for suffix, form in GNU_FORMS:
                full = f"{label}-{v.replace(' ', '-')}{suffix}"
                out.append((full, NAME, "public license", f"(?:gnu )?{name} license {number}{form}"))
                out += [(full, NAME, label, f"{s} {number}{form}") for s in short]
                tags.append((f"{label} {v} 0{suffix.replace('-', ' ')}", full))
        out.append((label, HINT, "public license", f"(?:gnu )?{name} license"))
        out.append((label, HINT, label, short[-1]))
    for part, short, long in CC:
        for v in CC_VERSIONS:
            full = f"cc-{part}-{v.replace(' ', '-')}"
            out.append((full, NAME, "cc by", f"cc {short} {v}"))
            out.append((full, NAME, "creative commons", f"creative commons {long}(?: licen[cs]e)? {v}"))
            out.append((full, NOTICE, "creativecommons org", f"creativecommons org licenses {short} {v}"))
            tags.append((f"cc {short} {v}", full))
        out.append((f"cc-{part}", HINT, "cc by", f"cc {short}"))
        out.append((f"cc-{part}", HINT, "creative commons", f"creative commons {long}"))
    out += [(full.replace(" ", "-"), TAG, "spdx license identifier", f"spdx license identifier {words}")
            for words, full in tags]
    out += STATEMENTS
    return tuple(sorted((_signature(*x) for x in dict.fromkeys(out)), key=lambda s: -s.priority))


#: A-Z to a-z, other ASCII but digits and letters to a space, the rest as it is
_LINE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def line_of(text: str | None) -> tuple[bytes, int]:
    """The words of a text between single spaces, and how many they are."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LINE).split()
    return b" " + b" ".join(words) + b" ", len(words)


def places(line: bytes, phrase: bytes) -> list:
    """Number of the first word wherever the phrase's words stand."""
    out, word, last, at = [], 0, 0, line.find(phrase)
    while at >= 0:
        word += line.count(b" ", last, at)       # from the place before on, so a line is counted once
        out.append(word)
        last, at = at, line.find(phrase, at + 1)
    return out


@functools.lru_cache(maxsize=1)
def _by_keyword() -> tuple:
    out: dict = {}
    for s in signatures():
        out.setdefault(s.keyword, []).append(s)
    return tuple(out.items())


class _Furthest:
    """The largest end of the intervals that start at or before a place; both are numbers of words."""

    def __init__(self, starts):
        self.starts = sorted(set(starts))
        self.tree = [-1] * (len(self.starts) + 1)

    def add(self, start: int, end: int) -> None:
        i = bisect_right(self.starts, start)
        while i < len(self.tree):
            self.tree[i] = max(self.tree[i], end)
            i += i & -i

    def up_to(self, start: int) -> int:
        i, out = bisect_right(self.starts, start), -1
        while i:
            out = max(out, self.tree[i])
            i -= i & -i
        return out


def detections(line: bytes) -> list:
    """(start, end, label, priority) of the detections that stand, in words: by priority, then length, place and
    label; one that lies within a detection before it is suppressed. Time is near-linear in what is found."""
    hits = [(m.start(), m.end(), s.label, s.priority)
            for keyword, rules in _by_keyword() if keyword in line for s in rules for m in s.pattern.finditer(line)]
    if not hits:
        return []
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = np.searchsorted(spaces, [h[0] for h in hits]) - 1
    ends = np.searchsorted(spaces, [h[1] for h in hits])
    found = [(int(a), int(e), label, p) for a, e, (_, _, label, p) in zip(starts, ends, hits)]
    found.sort(key=lambda x: (-x[3], x[0] - x[1], x[0], x[2]))
    taken, furthest = [], _Furthest(x[0] for x in found)
    for x in found:
        if furthest.up_to(x[0]) < x[1]:
            taken.append(x)
            furthest.add(x[0], x[1])
    return taken


def scan_text(text: str | None) -> tuple:
    line, n = line_of(text)
    base = [(w, label) for phrase, label in BASE for w in places(line, b" " + phrase.encode() + b" ")]
    more = detections(line)
    at = [w for w, _ in base]
    labels = {label for _, label in base}
    score = max([BASE_SCORE * bool(base), *(SCORES[p] for *_, p in more)])
    return (n, len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)),
            ",".join(sorted(labels | {x[2] for x in more})), score,
            ",".join(f"{label}:{a}:{b}" for a, b, label, _ in sorted(more)))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans
    (label:first word:word after the last, comma-joined)."""
    ship_package(docs.sparkSession)

    def run(frames):
        import pandas as pd
        cols = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for frame in frames:
            out = pd.DataFrame([scan_text(x) for x in frame["text"]], columns=cols)
            out[["first_word", "last_word"]] = out[["first_word", "last_word"]].astype("Int64")
            out.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield out

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return d.mapInPandas(run, f"doc_id {dict(d.dtypes)['doc_id']}, n_words long, n_base long, first_word long, "
                              "last_word long, base_labels string, labels string, score double, spans string")


# ---- registered query (the rules are beyond SQL; tests compare with a brute-force scan) ----

def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Spelling variants, URL rules and hard negatives, each against brute force."""

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from cairn.llm import negatives, urls, variants

from .data import rows, table

# ---- spelling variants ------------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] and len(a) == len(b) or a[i + 1:] == b[i:] or a[i:] == b[i + 1:]


def closed(words, limit, most=variants.GRAM_MAX):
    """The most frequent grams, with all their parts."""
    n = Counter(s[i:i + q] for s in map(variants.framed, words) for q in range(2, most) for i in range(len(s) - q + 1))
    return frozenset(sorted(n, key=lambda g: (-n[g], len(g), g))[:limit])


@settings(max_examples=300, deadline=None)
@given(st.text("ab", min_size=1, max_size=9), st.integers(0, 9), st.sampled_from("abc"), st.sampled_from("rdi"),
       st.integers(0, 60), st.integers(0, 1000))
def test_words_one_edit_apart_share_a_list(word, at, c, how, limit, seed):
    at = min(at, len(word))
    other = {"r": word[:at] + c + word[at + 1:], "d": word[:at] + word[at + 1:], "i": word[:at] + c + word[at:]}[how]
    rng = random.Random(seed)
    rest = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(12)]
    frequent = closed([word, other, *rest], limit)
    if not other or not one_edit(word, other):
        return
    a, b = (set(variants.list_keys(w, frequent)) for w in (word, other))
    if len(word) == len(other):
        assert {k for k, r in a if r == variants.SAME} & {k for k, r in b if r == variants.SAME}
    else:
        long, short = (a, b) if len(word) > len(other) else (b, a)
        assert {k for k, r in long if r == variants.LONGER} & {k for k, r in short if r == variants.SHORTER}


def brute_variants(count, ratio=5):
    near = {w: [o for o in count if one_edit(w, o)] for w in count}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda o: (-count[o], o))
            if count[best] >= ratio * count[w]:
                form[w] = best
    out = set()
    for w in count:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, count[w], len(near[w]), count.get(form.get(w))))
    return out


@pytest.mark.parametrize("frequent, limit", [(0, 10_000), (5, 30), (1000, 0)])
def test_variants_match_all_pairs(spark, frequent, limit):
    rng = random.Random(3)
    count = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))): rng.choice([1, 2, 5, 30, 200, 2000]) for _ in range(500)}
    d = spark.createDataFrame(list(count.items()), "word string, n long")
    got = variants.group_variants(d, frequent=frequent, limit=limit).collect()
    assert len(got) == len(count) and {tuple(r) for r in got} == brute_variants(count)


def test_forms_lead_on_to_the_root_through_long_chains(spark):
    # each has five times the count of the one before and one letter more
    count = {"b" * i: 5 ** i for i in range(1, 14)}
    d = spark.createDataFrame(list(count.items()), "word string, n long")
    got = {r.word: (r.form, r.root) for r in variants.group_variants(d).collect()}
    assert got["b"] == ("bb", "b" * 13) and got["b" * 13] == (None, "b" * 13)


def test_no_side_that_grows_with_the_words_is_broadcast(spark, monkeypatch):
    # small enough for Spark to broadcast every side, had it the choice
    plans = []

    def planned(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name)

    kept = variants.materialize
    monkeypatch.setattr(variants, "materialize", planned)
    words = spark.createDataFrame([("b" * i, 5 ** i) for i in range(1, 8)], "word string, n long")
    out = variants.group_variants(words)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert not any("Broadcast" in p for p in plans) and sum(p.count("SortMergeJoin") for p in plans) >= 6


def brute_words(data, min_count):
    count = Counter()
    for r in data:
        for w in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 6:
                count[w] += 1
    return {w: n for w, n in count.items() if n >= min_count}


def test_words_are_counted_over_whole_texts(spark):
    extra = [(i, "Àéîõü÷ Straßenbahn QUICKLY ünïçödé " * 3 + "x" * 100_000, *[None] * 7) for i in range(40)]
    data = rows() + extra
    got = variants.counted_words(table(spark, data), min_count=2)
    assert got.columns == ["word", "n"]
    assert {r.word: r.n for r in got.collect()} == brute_words(data, 2)
    full = variants.group_variants(variants.counted_words(table(spark, data))).collect()
    assert {tuple(r) for r in full} == brute_variants(brute_words(data, 5))
    assert variants.group_variants(variants.counted_words(table(spark, []))).count() == 0


def test_keys_of_a_very_long_word_take_linear_time():
    t = time.time()
    keys = variants.list_keys("ab" * 100_000, frozenset())
    assert len(keys) <= 3 * 200_006 and time.time() - t < 20


# ---- URL rules --------------------------------------------------------------------------

URLS = ["http://WWW.Example.COM/en/1", "https://blog.example.com/en/", "http://example.com/en", "http://example.com",
        "http://x.net/es/1?a=b#c", "http://x.net?/es/", "http://net/fr/", "http://fishnet/fr/", "http://a.net/de/", "//a.net/es/",
        "com/", "", None, "http://", "http:///com/", "http://com/", "http://x.org/a.com/", "http://x.org/login", "http://ads.x.org/q",
        "http://x.org/a/b.pdf", "http://x.org/a/b.pdf?x=1", "http://x.org/é/SessionID=1?sessionid=7", "http://x.org/?\nsessionid=1",
        "http://user@a.com:80/en/", "http://m.www.example.com/en/x", "http://www.example.com/en", "HTTP://A.COM/" + "é" * 5000,
        "http://x.org/" + "login/" * 2000, "http://x.org/search?q=1", "http://y://z.com/en/", "http://x.net/FR/", "http://.com/"]


def brute_parts(u):
    if u is None or "://" not in u:
        return "", "", ""
    rest = u.split("://", 1)[1]
    host = re.match("(?s)[^/?#]*", rest)[0]
    rest = rest[len(host):].split("#")[0]
    path = rest.split("?")[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path, rest[len(path):]


def to_regex(glob):
    out, i = "", 0
    while i < len(glob):
        if glob[i] == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 1
        else:
            out += {"*": "[^/?#]*", "?": "[^/?#]"}.get(glob[i]) or re.escape(glob[i])
        i += 1
    return re.compile(out, re.S)


def test_rules_match_a_plain_reading(spark):
    schema = "page_id long, url string, host long, __match string, verdict double"
    d = spark.createDataFrame([(i, u, 7, "m", 0.5) for i, u in enumerate(URLS + URLS[:3])], schema)
    got = urls.judge(d).collect()
    assert len(got) == len(URLS) + 3
    for r in got:
        host, path, query = brute_parts(r.url)
        fits = [(len(h + p), v, h + p) for v, h, p in urls.RULES
                if r.url and "://" in r.url and (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits) if fits else (0, None, None)
        own = any(to_regex(g).fullmatch(host + path + query) for g in urls.BLOCKED)
        verdict = want[1] or ("block" if own or r.url is None or "://" not in r.url else "allow")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, want[2], verdict), r.url
        assert (r.glob is not None) == (own and r.url is not None and "://" in r.url)
    assert urls.judge(spark.createDataFrame([], schema)).count() == 0
    plain = urls.judge(d.select("page_id", "url"), rules=(), blocked=()).collect()
    assert {r.verdict for r in plain if r.url and "://" in r.url} == {"allow"} and all(r.rule is None for r in plain)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab/?*\\é", max_size=7), min_size=1, max_size=40), st.lists(st.text("ab/?é\n#", max_size=9), min_size=1, max_size=9))
def test_automaton_matches_regular_expressions(globs, texts):
    automaton = urls.Automaton(globs)
    got = automaton.run([t.encode() for t in texts])
    want = [[bool(to_regex(g).fullmatch(t)) for g in globs] for t in texts]
    assert got.tolist() == want
    alone = [automaton._one(t.encode()) for t in texts]           # the form for long URLs
    assert [[bool(x >> e & 1) for e in automaton.ends] for x in alone] == want


def test_plain_text_matches_itself_only():
    text = "a*b?c\\d"
    got = urls.Automaton([urls.plain(text)]).run([text.encode(), b"aXb?c\\d", b"a*bXc\\d"])
    assert got[:, 0].tolist() == [True, False, False]


def test_a_very_long_url_ends_in_seconds():
    t = time.time()
    assert urls.Automaton(["**/login/**", "x"]).run([b"x.org" + b"/login" * 350_000 + b"/"])[0].tolist() == [True, False]
    assert time.time() - t < 20


# ---- hard negatives ---------------------------------------------------------------------

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                        T.StructField("label", T.IntegerType()), T.StructField("q", T.StringType()), T.StructField("id", T.StringType())])


def brute_negatives(data, every, k, m):
    import math
    best = {}
    for i, v, label, *_ in data:
        if None in (i, v, label) or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(math.floor(256 * x) for x in v)
        best[i] = min(best.get(i, (label, q)), (label, q))
    out = set()
    for a, (label, q) in best.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(q, p)) for i, (_, p) in best.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if best[i][0] == label][:k]:
            found = [i for i in order if best[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out |= {(a, p, r, i, score[p], score[i]) for r, i in enumerate(found[:m], 1)}
    return out


def vectors(n=400, dim=8, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    out = []
    for i in range(n):
        c, label = rng.choice(centres), rng.choice([0, 0, 0, 1, 2, 3])
        out.append((i - 20, [x + rng.gauss(0, rng.choice([0, .02, .3])) for x in c], label, "x", "y"))
    import numpy as np
    out = [(i, [float(np.float32(x)) for x in v], *r) for i, v, *r in out]
    out += out[:9]                                                        # repeated rows
    out += [(5000, out[0][1], 2, "", ""), (5000, out[1][1], 1, "", "")]    # two rows of one id
    out += [(None, out[0][1], 0, "", ""), (6000, None, 0, "", ""), (6005, out[3][1], None, "", ""), (6010, [1.0, None], 1, "", ""),
            (6015, [float("nan")] * dim, 0, "", ""), (6020, [float("inf")] + [0.0] * (dim - 1), 0, "", ""), (6025, [], 0, "", ""),
            (6030, [1.0, 2.0], 0, "", ""), (6035, [0.5] * (dim + 3), 1, "", ""), (6040, [0.0] * dim, 0, "", "")]
    return out


@pytest.mark.parametrize("sizes", [{}, {"block": 7, "row_group": 90, "anchor_group": 20}])
def test_negatives_match_all_scores(spark, sizes):
    data = vectors()
    got = negatives.mine(negatives.usable(spark.createDataFrame(data, VECTORS)), every=5, **sizes)
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute_negatives(data, 5, 5, 3)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_negatives_of_awkward_tables(spark):
    def run(data):
        return {tuple(r) for r in negatives.mine(negatives.usable(spark.createDataFrame(data, VECTORS)), every=2).collect()}
    assert run([]) == set()
    one_label = [(i, [1.0, 2.0], 0, "", "") for i in range(30)]
    assert run(one_label) == set()
    assert run([(i, [1.0, float(i)], i, "", "") for i in range(30)]) == set()       # no positives
    huge = [(i, [float(2.0 ** (20 + i % 4)), 3.0 + i], i % 2, "", "") for i in range(30)]
    assert run(huge) == brute_negatives(huge, 2, 5, 3)                               # beyond doubles' exact range
    tied = [(i, [1.0, 1.0] if i % 3 else [0.9, 0.8], i % 3, "", "") for i in range(60)]
    assert run(tied) == brute_negatives(tied, 2, 5, 3)


def test_tree_is_minimal_and_its_bounds_prune():
    import numpy as np
    rng = np.random.default_rng(0)
    centres = rng.integers(-100, 100, (8, 16))
    anchors = (centres[rng.integers(0, 8, 64)] + rng.integers(-1, 2, (64, 16))).astype(np.int64)
    order, parent, edge = negatives.spanning_tree(anchors)
    assert sorted(order) == list(range(64)) and parent[0] == -1 and all(parent[i] < i for i in range(1, 64))
    d = np.linalg.norm(anchors[:, None] - anchors[None], axis=2)
    reached, total = {0}, 0.0                      # Kruskal's weight by another way
    edges = sorted((d[i, j], i, j) for i in range(64) for j in range(i))
    root = list(range(64))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for w, i, j in edges:
        if find(i) != find(j):
            root[find(i)] = find(j)
            total += w
    assert abs(edge.sum() - total) < 1e-6
    rows_ = (centres[rng.integers(0, 8, 500)] + rng.integers(-1, 2, (500, 16))).astype(np.int64)
    seen = defaultdict(set)
    m = anchors[order]
    scored = negatives.walk(m, parent, edge, rows_, np.linalg.norm(rows_, axis=1),
                            lambda i, lo, hi: hi >= 0.9 * (m[i] @ m[i]), lambda i, which, s: seen[i].update(which.tolist()))
    assert scored < 0.6 * 64 * 500                 # of all products
    for i in range(64):
        assert set(np.flatnonzero(rows_ @ m[i] >= 0.9 * (m[i] @ m[i]))) <= seen[i]

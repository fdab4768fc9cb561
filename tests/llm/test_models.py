"""Attention classifier, deleted interpolation and parity-sketch join."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cairn.llm import lm, parity, quality

from .data import SCHEMA, rows, table, words

# ---- quality -----------------------------------------------------------------------


def test_gradient_matches_finite_differences():
    rng = np.random.default_rng(0)
    x, starts, y = rng.normal(size=(9, quality.N_FEATURES)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])
    p = {k: v + 0.1 for k, v in quality._start(rng).items()}

    def loss():
        s = quality.forward(p, x, starts)[0]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    grad = quality.backward(p, x, starts, y)
    for k, v in p.items():
        at = tuple(rng.integers(0, n) for n in v.shape)
        old, eps = v[at], 1e-6
        v[at] = old + eps
        up = loss()
        v[at] = old - eps
        down = loss()
        v[at] = old
        assert abs((up - down) / (2 * eps) - grad[k][at]) < 1e-6


def test_attention_weighs_passages_of_whole_text():
    clean, junk = words(400, 1), "### $$$ %%% " * 20
    a = quality.passages(clean)
    assert a.shape == (7, quality.N_FEATURES)
    assert quality.passages(clean + " " + junk).shape[0] > a.shape[0]      # the end of a text counts
    assert quality.passages(None).shape == quality.passages("").shape == (1, quality.N_FEATURES)


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    data, labels = [], []
    for i in range(400):
        good = rng.random() < 0.6
        t = words(rng.randint(20, 300), i) if good else " ".join(f"{w}{'#$%'[k % 3] * 3}" for k, w in enumerate(words(rng.randint(20, 200), i).split()))
        data.append((i, t, None, None, None, None, None, None, None))
        labels.append((i, int(good), None))
    d = table(spark, data)
    lab = spark.createDataFrame(labels + [(5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(d, lab.filter("doc_id % 4 <> 2 OR doc_id IS NULL"), max_train=200)
    got = {r.doc_id: r.score for r in quality.score(d, model).collect()}
    held = [i for i in range(400) if i % 4 == 2]
    assert np.mean([(got[i] >= 0.7) == labels[i][1] for i in held]) > 0.95


def test_scores_of_awkward_rows(spark):
    lab = spark.createDataFrame([(0, 1), (15, 0), (7, 0), (3, 1), (4, 1), (11, 0)], "doc_id long, quality int")
    d = table(spark)
    got = quality.score(d, quality.fit(d, lab)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows()) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 0}) == 1
    none = quality.fit(d, lab.filter("false"))
    assert {r.score for r in quality.score(d, none).collect()} == {0.5}
    assert {r.score for r in quality.score(d, quality.fit(d, lab.filter("quality = 1"))).collect()} == {1.0}
    assert quality.score(table(spark, []), none).count() == 0


# ---- language model ----------------------------------------------------------------


def fold(i):
    return zlib.crc32(str(i).encode() if i is not None else b"") % 10


def brute_lm(data, em_rounds):
    """The same model from plain dictionaries."""
    toks = [(i, [b"\n"] + (t or "").encode().lower().split() + [b"\n"]) for i, t in data]

    def count(keep):
        uni, bi = Counter(), Counter()
        for i, t in toks:
            if keep(fold(i)):
                uni.update(t[1:])
                bi.update(zip(t[:-1], t[1:]))
        return uni, bi

    def bucket(c):
        return c.bit_length()

    uni, bi = count(lambda f: f > 1)
    n, v = sum(uni.values()), len(uni)
    events = Counter()
    for i, t in toks:
        if fold(i) == 1:
            events.update((uni[a], bi[a, b], uni[b]) for a, b in zip(t[:-1], t[1:]))
    w = defaultdict(lambda: (0.4, 0.5, 0.1))
    w[0] = (0.0, 0.9, 0.1)
    for _ in range(em_rounds):
        acc = defaultdict(lambda: [0, 0, 0])
        for (c, c2, c1), k in events.items():
            x = w[bucket(c)]
            parts = [x[0] * (c2 / c if c else 0), x[1] * c1 / max(n, 1), x[2] / (v + 1)]
            for j in range(3):
                acc[bucket(c)][j] += k * parts[j] / sum(parts)
        for k, x in acc.items():
            w[k] = tuple(y / sum(x) for y in x)
    uni, bi = count(lambda f: f > 0)
    n, v = sum(uni.values()), len(uni)
    out = []
    for i, t in toks:
        base = sum(math.log10((uni[b] + 0.1) / (n + 0.1 * (v + 1))) for b in t[1:])
        score = 0
        for a, b in zip(t[:-1], t[1:]):
            x = list(w[bucket(uni[a])])
            x[2] = max(x[2], 1e-6)
            s = sum(x)
            score += math.log10((x[0] * bi[a, b] / max(uni[a], 1) + x[1] * uni[b] / max(n, 1) + x[2] / (v + 1)) / s)
        out.append((i, len(t) - 1, sum(uni[b] > 0 for b in t[1:]), n, base, score))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 24, 3000])
def test_model_matches_plain_dictionaries(spark, block_bytes):
    rng = random.Random(4)
    vocab = words(60, 8).split()
    data = [(i, " ".join(rng.choice(vocab[: 5 + i % 55]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    data += [(r[0], r[1]) for r in rows() if r[0] is None or r[0] != 4]
    got = lm.score(table(spark, [(*x, *[None] * 7) for x in data]), block_bytes=block_bytes, em_rounds=4).collect()
    want = brute_lm(data, 4)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    rows_ = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    assert len(rows_) == len(want)
    for a, b in zip(rows_, sorted(want, key=key)):
        assert a[:4] == b[:4]
        assert a[4] == pytest.approx(b[4], rel=1e-9) and a[5] == pytest.approx(b[5], rel=1e-9)
    assert {r.held_out for r in got if r.doc_id is not None and fold(r.doc_id) == 0} == {True}


def test_model_beats_unigrams_on_held_out_text(spark):
    vocab = words(200, 2).split()
    rng = random.Random(6)
    data = []
    for i in range(200):
        at, t = rng.randrange(200), []
        for _ in range(80):
            t.append(vocab[at])
            at = (at * 7 + rng.randrange(3)) % 200
        data.append((i, " ".join(t), *[None] * 7))
    got = [r for r in lm.score(table(spark, data)).collect() if r.held_out]
    assert got and sum(r.score for r in got) > 0.8 * sum(r.base_score for r in got)


def test_model_of_empty_and_untrained_tables(spark):
    assert lm.score(table(spark, [])).count() == 0
    only = [i for i in range(200) if fold(i) == 0][:3]
    got = lm.score(table(spark, [(i, "a b", *[None] * 7) for i in only])).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens) for r in got} == {(3, 0, 0)} and all(np.isfinite(r.score) for r in got)


# ---- parity-sketch join --------------------------------------------------------------


def brute_join(data, n=4, percent=85):
    sets = [frozenset(parity.shingles(t, n).tolist()) for _, t in data]
    group = list(range(len(data)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(data):
        if sets[i] and d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return Counter((d, len(sets[i]), low.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(data))


def edited(text, edits, seed):
    rng, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def joined(spark, data, **kw):
    d = spark.createDataFrame([(i, t, *[None] * 7) for i, t in data], SCHEMA)
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in parity.join(d, **kw).collect())


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_join_matches_all_pairs(spark, n, percent):
    rng = random.Random(n)
    data = [(r[0], r[1]) for r in rows()]
    for g in range(25):                                      # many sizes, similarities around the bound, chains
        base = words(rng.choice([5, 6, 7, 8, 9, 12, 20, 40, 90, 300]), 50 + g)
        text = base
        for k in range(6):
            data.append((1000 + 10 * g + k, text))
            text = edited(text if g % 2 else base, rng.randint(1, max(1, len(base.split()) // 45)), 10 * g + k)
    rng.shuffle(data)
    assert joined(spark, data, words=n, percent=percent) == brute_join(data, n, percent)


def test_join_of_a_large_group_and_a_common_passage(spark):
    base, shared = words(80, 1), words(40, 2)
    data = [(i, edited(base, 1, i)) for i in range(150)] + [(1000 + i, shared + " " + words(45, 300 + i)) for i in range(150)]
    assert joined(spark, data) == brute_join(data)


def test_small_sets_with_empty_parts_are_found(spark):
    data = []
    for g in range(150):
        w = words(10, 900 + g).split()
        data += [(10 * g, " ".join(w)), (10 * g + 1, " ".join([*w, "x"])), (10 * g + 2, " ".join(w[:-1]))]
    assert joined(spark, data) == brute_join(data)


def test_pigeonhole_bound():
    """Sets at the similarity share a key, whatever their size."""
    rng = np.random.default_rng(1)
    for size in [*range(1, 60), 100, 333, 1000, 5000]:
        for _ in range(6):
            s = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            most = len(s) * 15 // 85                            # what may be added
            more = np.unique(np.concatenate([s, rng.integers(0, 1 << 63, most, dtype=np.uint64)]))
            both = 15 * len(s) // 185                           # what may differ on either side
            other = np.unique(np.concatenate([s[both:], rng.integers(0, 1 << 63, both, dtype=np.uint64)]))
            for t in (more, other):
                common = len(np.intersect1d(s, t))
                if 100 * common >= 85 * (len(s) + len(t) - common):
                    assert set(parity.part_keys(s, parity.Bands(85)).tolist()) & set(parity.part_keys(t, parity.Bands(85)).tolist())


def test_sketch_is_a_lower_bound():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.integers(0, 40):], rng.integers(0, 1 << 63, rng.integers(0, 30), dtype=np.uint64)]))
        bits = np.bitwise_count(parity.parity_sketch(a).view(np.uint64) ^ parity.parity_sketch(b).view(np.uint64)).sum()
        assert bits <= len(np.setxor1d(a, b))


def test_components_of_a_long_chain(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long").repartition(5)
    got = {r.node: r.label for r in parity.components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


def test_groups_survive_batch_borders(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rng = random.Random(2)
        data = [(rng.randrange(40), rng.randrange(6)) for _ in range(200)] + [(99, 1)] * 7 + [(98, k) for k in range(11)]
        got = parity.groups_of(spark.createDataFrame(data, "key long, node long")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = defaultdict(set)
    for k, x in data:
        by[k].add(x)
    assert Counter((r.key, r.node) for r in got) == Counter((k, x) for k, s in by.items() if len(s) > 1 for x in s)


def test_near_filter_keeps_one_of_each(spark):
    d = table(spark)
    out = parity.filter_documents(d)
    assert out.columns == d.columns
    ids = Counter(r.doc_id for r in out.collect())
    # of the rows without an id one is a copy of 0, the other has no text
    assert ids[0] == 1 and not {1, 2, 3, 16} & set(ids) and ids[None] == 1 and ids[4] == 1 and 5 not in ids
    assert parity.filter_documents(table(spark, [])).count() == 0


def test_near_filter_judges_rows_not_ids(spark):
    w, v, u = words(60, 1), words(60, 2), words(60, 3)
    data = [(1, w), (1, v), (None, w), (None, w), (None, u), (None, u), (None, edited(u, 1, 1)), (2, edited(v, 1, 1)), (3, ""), (3, ""),
            (None, " "), (4, None)]
    d = spark.createDataFrame([(i, t, *[None] * 7) for i, t in data], SCHEMA)
    got = Counter((r.doc_id, r.text) for r in parity.filter_documents(d).collect())
    of_u = [k for k in got if k[0] is None and k[1] in (u, edited(u, 1, 1))]
    assert len(of_u) == 1 and got.pop(of_u[0]) == 1
    assert got == Counter({(1, w): 1, (1, v): 1, (3, ""): 2, (None, " "): 1, (4, None): 1})


def test_links_are_all_links(spark):
    rng = random.Random(9)
    data = [(r[0], r[1]) for r in rows()]
    for g in range(8):
        base = words([6, 60, 90, 120, 150, 200, 300, 400][g], 70 + g)
        data += [(100 * g + 1000 + k, edited(base, rng.randint(0, len(base.split()) // 50), 10 * g + k)) for k in range(12)]
    d = spark.createDataFrame([(i, t, *[None] * 7) for i, t in data], SCHEMA)
    members, pairs = parity.links(d)
    sets = [frozenset(parity.shingles(t, 4).tolist()) for _, t in data]
    count = Counter()
    want = set()
    for i, a in enumerate(sets):
        linked = [j for j, b in enumerate(sets) if a and b and j != i and 100 * len(a & b) >= 85 * len(a | b)]
        count[(data[i][0], len(a), len(linked))] += 1
        want |= {frozenset((a, sets[j])) for j in linked if sets[j] != a}
    assert Counter((r.doc_id, r.n_shingles, r.n_links) for r in members.collect()) == count
    by_class = {parity.node_of(np.array(sorted(s), np.uint64)): s for s in sets if s}
    found = [frozenset((by_class[r.a], by_class[r.b])) for r in pairs.collect()]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 50


def test_sets_share_one_key_more_than_they_may_leave_out():
    rng = np.random.default_rng(4)
    for size in [*range(1, 40), 60, 200, 1500]:
        for _ in range(5):
            s = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            drop, add = rng.integers(0, size * 8 // 100 + 2), rng.integers(0, size * 8 // 100 + 2)
            t = np.unique(np.concatenate([s[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)]))
            common = len(np.intersect1d(s, t))
            if not len(t) or 100 * common < 85 * (len(s) + len(t) - common):
                continue
            (ka, xa), (kb, xb) = (parity.keyed_parts(x, parity.Bands(85)) for x in (s, t))
            good = False
            for family in set((ka & np.uint64(15)).tolist()) & set((kb & np.uint64(15)).tolist()):
                a, b = (dict(zip(k[k & np.uint64(15) == family].tolist(), x[k & np.uint64(15) == family].tolist()))
                        for k, x in ((ka, xa), (kb, xb)))
                good |= len(set(a) & set(b)) > max(max(a.values()), max(b.values()))
            assert good


# ---- the classifier's forward pass and passages against plain loops ----------------------


def test_forward_matches_a_plain_loop():
    rng = np.random.default_rng(3)
    bags = [rng.normal(size=(k, quality.N_FEATURES)).astype(np.float32) for k in (1, 4, 9)]
    model = quality.train(bags * 4, np.array([0.0, 1.0, 1.0] * 4), epochs=2)
    got = quality.score_bags(model, bags)
    for bag, score in zip(bags, got):
        x = np.clip((bag - model["mean"]) / model["scale"], -6, 6)
        want = plain_score(model, x)
        assert abs(want - score) < 1e-5


def plain_score(p, x):
    def dense(row, weights, j):
        return sum(float(r) * float(w[j]) for r, w in zip(row, weights))

    def sigmoid(t):
        return 1 / (1 + math.exp(-t))

    codes, gates = [], []
    for row in x:
        h = [math.tanh(dense(row, p["E"], j) + float(p["e"][j])) for j in range(quality.CODE)]
        codes.append(h)
        gates.append(sum(math.tanh(dense(h, p["V"], j)) * sigmoid(dense(h, p["U"], j)) * float(p["w"][j]) for j in range(quality.GATE)))
    total = sum(math.exp(g) for g in gates)
    z = [sum(math.exp(g) / total * h[j] for g, h in zip(gates, codes)) for j in range(quality.CODE)]
    return sigmoid(sum(a * float(b) for a, b in zip(z, p["b"])) + float(p["c"][0]))


def test_training_rows_are_bounded(spark):
    data = [(1, words(40, 5), *[None] * 7)] * 300 + [(2, words(60_000, 6), *[None] * 7)] + [(i, words(30, i), *[None] * 7) for i in range(3, 30)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 30)], "doc_id long, quality int")
    seen = []
    train = quality.train

    def counted(bags, y):
        seen.append((len(bags), max(len(b) for b in bags)))
        return train(bags, y)

    quality.train = counted
    try:
        quality.fit(table(spark, data), labels)
    finally:
        quality.train = train
    assert seen == [(29, quality.MAX_PASSAGES)]

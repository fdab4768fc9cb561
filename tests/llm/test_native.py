"""Quality rules, chunk recipes and Pfair mixing."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cairn.llm import pfair, recipes, rules

from .data import rows, table

SPACE = "[\x20\x09-\x0d]"


def brute_rules(text):
    t = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    seen = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    repeat = {i + k for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for k in range(5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeat))


def test_rules_match_a_plain_count(spark):
    got = rules.measure(table(spark)).collect()
    want = Counter((r[0], *brute_rules(r[1])) for r in rows())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and not r.failed_rules)


def test_rules_filter_keeps_columns_and_drops_junk(spark):
    d = table(spark)
    out = rules.filter_documents(d)
    assert out.columns == d.columns
    ids = [r.doc_id for r in out.collect()]
    assert 0 in ids and 3 in ids and not {4, 7, 11, 15} & set(ids) and ids.count(0) == 3   # 4 has no stop word
    assert rules.filter_documents(table(spark, [])).count() == 0


def test_rules_run_without_python(spark):
    plan = rules.measure(table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_windows_that_overlap_count_words_once(spark):
    d = spark.createDataFrame([(1, "a b c d e a b c d e a b c d e f"), (2, "a a a a a a"), (3, "a a a a a")], "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in rules.measure(d).collect()}
    assert got == {1: brute_rules("a b c d e a b c d e a b c d e f")[4], 2: 6, 3: 0}


def brute_groups(data):
    groups = defaultdict(list)
    for r in data:
        groups[re.sub(SPACE, "", r[1] or "")].append(r)
    return groups


@pytest.mark.parametrize("weak", [False, True])
def test_recipes_match_whole_texts(spark, weak):
    # a digest that clashes must be noticed and left for the next one
    digests = ((lambda c: F.unhex(F.hex(F.length(c) % 3)),) if weak else ()) + recipes.DIGESTS
    got = recipes.duplicates(table(spark), digests=digests).collect()
    groups = brute_groups(rows())
    assert len(got) == len(rows())
    kept = Counter(r.text_sha256 for r in got if r.kept)
    for norm, members in groups.items():
        sha = hashlib.sha256(norm.encode()).hexdigest()
        mine = [r for r in got if r.text_sha256 == sha]
        best = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        assert {r.keep_id for r in mine} == {best[0]} and {r.group_size for r in mine} == {len(members)}
        assert kept[sha] == 1


def test_chunks_join_to_the_text_and_resynchronise(spark):
    from .data import words
    text = words(4000, 9).replace(" ", "")
    d = spark.createDataFrame([(text,), ("inserted" + text,)], "t string")
    a, b = (r.c for r in d.select(recipes.chunks(F.col("t")).alias("c")).collect())
    assert "".join(a) == text and "".join(b) == "inserted" + text
    assert len(set(a) & set(b)) > 0.8 * len(a)


def test_recipe_filter_keeps_one_row(spark):
    d = table(spark)
    out = recipes.filter_documents(d)
    assert out.columns == d.columns
    assert Counter(re.sub(SPACE, "", r.text or "") for r in out.collect()) == Counter({k: 1 for k in brute_groups(rows())})
    assert recipes.filter_documents(table(spark, [])).count() == 0
    assert recipes.duplicates(table(spark, [])).count() == 0


def brute_schedule(shares):
    p, done, order = sum(shares), [0] * len(shares), []
    for t in range(p):
        _, i = min((-(-(done[i] + 1) * p // m), i) for i, m in enumerate(shares) if done[i] * p // m <= t)
        done[i] += 1
        order.append(i)
    return order


@pytest.mark.parametrize("shares", [[1], [3, 1], [219, 40, 41, 42, 1], [7, 7, 7], [1, 997, 2]])
def test_period_is_earliest_deadline_first_within_a_block(spark, shares):
    got = spark.range(1).select(pfair.period(F.array(*[F.lit(s) for s in shares])).alias("o")).first().o
    assert list(got) == brute_schedule(shares)
    p, count = sum(shares), [0] * len(shares)
    for t, i in enumerate(got, 1):
        count[i] += 1
        assert all(abs(c - t * m / p) < 1 for c, m in zip(count, shares))
    assert count == shares


def test_mix_keeps_every_row_and_the_shares(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"),
                                 F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 4).cast("string"))).alias("source"))
    got = pfair.mix(d, block=8).collect()
    assert len(got) == 4000 and len({(r.slot, r.place) for r in got}) == 4000
    sizes = {s: c for s, c in Counter(r.source for r in got).items()}
    weight = {s: round(n ** 0.7 / sum(x ** 0.7 for x in sizes.values()) * pfair.SLOTS) for s, n in sizes.items()}
    p = sum(weight.values())
    owner = {r.slot: r.source for r in got}
    first = [r for r in pfair.mix(d, block=8, until="first").collect()]
    stop = max(r.slot for r in first) + 1
    count = Counter()
    for t in range(stop):
        count[owner[t]] += 1                                  # no slot is empty before the first source ends
        assert all(abs(count[s] - (t + 1) * w / p) < 1 for s, w in weight.items())
    assert {(r.doc_id, r.slot) for r in first} == {(r.doc_id, r.slot) for r in got if r.slot < stop}


def test_mix_of_awkward_rows(spark):
    d = table(spark)
    out = pfair.mix(d)
    assert set(out.columns) == set(d.columns) | {"place"}
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((r[0], r[1]) for r in rows())
    assert pfair.mix(table(spark, [])).count() == 0
    given = spark.createDataFrame([("a", 3.0), ("a", 1.0), (None, 2.0), ("unseen", 9.0), ("b", None)], "source string, weight double")
    assert pfair.mix(d, given).count() == len(rows())
    assert pfair.mixed_documents(d).columns == d.columns

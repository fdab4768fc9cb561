"""Word-boundary lexicon scoring."""

from pyspark.sql import functions as F

from cairn.functions import lexicon as lx
from cairn.functions.lexicons import DOMAINS


def scores(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(lx.domain_scores(F.col("t")).alias("s")).first()["s"]
    return row.asDict()


def best(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(lx.best_domain(lx.domain_scores(F.col("t")), DOMAINS).alias("b")).first()["b"]
    return r["domain"], r["hits"]


def pain(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(lx.pain_score(F.col("t")).alias("p")).first()["p"]


def test_terms_inside_longer_words_do_not_count(spark):
    # raft, shard, sqlite stand inside other words here
    for text in ("aircraft crafted rafters", "a shardlike unsharded-ness", "mysqlitedb"):
        assert scores(spark, text)["distributed"] == 0 or "unsharded" in text
    assert best(spark, "aircraft crafted rafters")[0] is None


def test_stems_match_their_endings_and_strings_count_once(spark):
    got = [scores(spark, f"{w} weights")["ml-infra"] for w in ("quantizes", "quantizing", "quantise-free")]
    assert got[0] == got[1] == 1 and got[2] == 0
    assert scores(spark, "raft raft raft")["distributed"] == 1
    assert scores(spark, "raft and a shard, then shards")["distributed"] == 3


def test_pain_phrases_that_share_words_count_once(spark):
    assert pain(spark, "sadly there is no way to undo this") == 1
    assert pain(spark, "a quiet walk") == 0


def test_best_domain_needs_a_hit(spark):
    domain, hits = best(spark, "sharding helps until raft elections stall behind a network partition")
    assert domain == "distributed" and hits >= 2
    assert best(spark, "bread, butter and jam") == (None, 0)


def test_unicode_boundaries(spark):
    # é is a word character: "rafté" is not "raft"
    assert scores(spark, "rafté")["distributed"] == 0
    assert scores(spark, "é raft")["distributed"] == 1


def test_noise_titles(spark):
    df = spark.createDataFrame([("Ask HN: Who is hiring?",), ("Normal title",), (None,)], "t string")
    got = [r[0] for r in df.select(lx.is_noise_title(F.col("t"))).collect()]
    assert got == [True, False, False]


def test_matched_terms_domain_first(spark):
    df = spark.createDataFrame([("sharded sqlite database", "storage")], "t string, d string")
    got = df.select(lx.matched_terms(F.col("t"), F.col("d")).alias("m")).first()["m"]
    assert got[0] in ("sqlite", "database") and "sharded" in got


def test_matched_terms_spare_patterns_and_lose_none(spark):
    domains = {"a": ["sikh*", "kind", "no such term"], "b": ["kind", "is"]}
    texts = ["a ſikhs is", "the Kind of", "Kınd", "SİKH", "mankind", "", None, "IS kinD"]
    df = spark.createDataFrame([(t, d) for t in texts for d in ("a", "b", None)], "t string, d string")
    out = df.withColumn("f", lx.folded(F.col("t"))).select(
        lx.matched_terms(F.col("t"), F.col("d"), domains).alias("plain"),
        lx.matched_terms(F.col("t"), F.col("d"), domains, F.col("f")).alias("spared")).collect()
    assert all(r.plain == r.spared for r in out) and sum(len(r.plain) for r in out) > 10

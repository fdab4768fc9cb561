"""Theme choice and evidence gathering (F1/D2, F3, C10), problem rotation (F7),
theme rebuild (H4) on tiny in-memory inputs."""

import numpy as np
from pyspark.sql import functions as F

from cairn.operators import clustering as cl
from cairn.operators import evidence as ev
from cairn.operators import review as rv
from cairn.operators import selection as sel

NOW = 1_800_000_000


def themes_df(spark, rows):
    return spark.createDataFrame(rows, "theme string, theme_key string, size long, evidence double, domain string, weight double")


def test_spent_theme_skipped_and_half_reuse_inclusive(spark):
    th = themes_df(spark, [("t1", "aaa", 2, 9.0, "storage", 1.0), ("t2", "bbb", 2, 5.0, "storage", 1.0),
                           ("t3", "ccc", 2, 1.0, "storage", 1.0)])
    mem = spark.createDataFrame([("t1", 1), ("t1", 2), ("t2", 3), ("t2", 4), ("t3", 5), ("t3", 6)], "theme string, id long")
    # t1 fully spent (2/2) -> skipped; t2 half spent (1/2 = 0.5) -> still eligible
    used = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    top = ev.top_theme_per_domain(th, mem, used).first()
    assert top.theme_key == "bbb" and top.reused == 0.5


def test_weight_ranks_with_evidence(spark):
    th = themes_df(spark, [("t1", "aaa", 2, 9.0, "storage", 0.1), ("t2", "bbb", 2, 5.0, "storage", 1.0)])
    mem = spark.createDataFrame([("t1", 1), ("t1", 2), ("t2", 3), ("t2", 4)], "theme string, id long")
    top = ev.top_theme_per_domain(th, mem, spark.createDataFrame([], "id long")).first()
    assert top.theme_key == "bbb"


def _signal(spark, n):
    return spark.createDataFrame(
        [(i, f"u/{i}", f"t{i}", "x" * 10, i % 3, 2, NOW - i, "s", "storage") for i in range(n)],
        "id long, url string, title string, text string, pain long, domain_hits long, created_utc long, source string, domain string")


def test_gather_tops_up_theme_rows_without_repeating_urls(spark):
    sig = _signal(spark, 20)
    top = spark.createDataFrame([("storage", "t", "key")], "domain string, theme string, theme_key string")
    mem = spark.createDataFrame([("t", 0), ("t", 1), ("t", 2)], "theme string, id long")
    rows = sel.gather_evidence(top, mem, sig, spark.createDataFrame([(5,)], "id long")).collect()
    ids = [r.id for r in sorted(rows, key=lambda r: r.pos)]
    assert len(ids) == 14 and ids[:3] == [2, 1, 0]      # theme rows first, strongest first
    assert len(set(ids)) == 14 and 5 not in ids            # no repeats, spent row never padded in
    packet = sel.evidence_packet(sel.gather_evidence(top, mem, sig, spark.createDataFrame([], "id long"))).first()
    assert packet.n_rows == 14 and not packet.starved and packet.packet.startswith("--- [1] u/")


def test_single_member_theme_falls_back_to_domain_evidence(spark):
    sig = _signal(spark, 3)
    top = spark.createDataFrame([("storage", "t", "key")], "domain string, theme string, theme_key string")
    mem = spark.createDataFrame([("t", 0)], "theme string, id long")
    p = sel.evidence_packet(sel.gather_evidence(top, mem, sig, spark.createDataFrame([], "id long"))).first()
    assert p.theme_key is None and p.n_rows == 3 and p.starved


def test_citation_grounding_keeps_duplicates(spark):
    cands = spark.createDataFrame([(1, "storage", ["u/1", "u/1", "x/9"]), (2, "storage", ["u/1", "x/8"])],
                                  "candidate_id long, domain string, evidence_refs array<string>")
    packets = spark.createDataFrame([("storage", ["u/1", "u/2"])], "domain string, urls array<string>")
    got = {r.candidate_id: (r.n_kept, r.grounded) for r in sel.citation_grounding(cands, packets).collect()}
    assert got == {1: (2, True), 2: (1, False)}


def test_problem_rotation_prefers_fresh_then_whole_set(spark):
    picks = spark.createDataFrame([(1, "a"), (1, "b")], "learner_id long, card_id string")
    probs = spark.createDataFrame([("a", "p1"), ("a", "p2"), ("b", "q1")], "card_id string, problem string")
    given = spark.createDataFrame([(1, "a", "p1"), (1, "b", "q1")], "learner_id long, card_id string, problem string")
    got = {r.card_id: r.problem for r in rv.problem_rotation(picks, probs, given).collect()}
    assert got == {"a": "p2", "b": "q1"}


def test_rebuild_clusters_near_duplicates(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(4, 16))
    rows, ident = [], 0
    for b in base:
        for _ in range(3):
            rows.append((ident, [float(v) for v in b + 0.01 * rng.normal(size=16)]))
            ident += 1
    vecs = spark.createDataFrame(rows, "id long, vec array<float>")
    lab = cl.average_linkage(vecs, 0.1)
    sizes = sorted(r["count"] for r in lab.groupBy("cluster").count().collect())
    assert sizes == [3, 3, 3, 3]
    keys = ev.theme_keys(lab.select(F.col("cluster").cast("string").alias("theme"), "id"))
    assert keys.filter("size = 3").count() == 4


def test_tfidf_labels_chunking_is_invisible(spark):
    texts = ["raft consensus broke", "", "consensus raft again", "leader election flapped",
             "disk fsync latency", "fsync latency spikes", "latency latency disk"]
    rows = [("a" if i < 4 else "b", i, t) for i, t in enumerate(texts)]
    mt = spark.createDataFrame(rows, "theme string, id long, text string")
    one = {r.theme: r.label for r in ev.tfidf_labels(mt).collect()}
    tiny = {r.theme: r.label for r in ev.tfidf_labels(mt, id_chunk=1).collect()}
    assert one == tiny and "raft" in one["a"] and "fsync latency" in one["b"]


def test_domain_rotation_rules(spark):
    # eight domains; from cursor 2: starved slots are free, stop after 3 shipped or 5 generated
    outcomes = ["shipped", "starved", "starved", "rejected", "shipped", "starved", "shipped", "shipped"]
    slots = spark.createDataFrame([(1, i, f"d{i}", o) for i, o in enumerate(outcomes)],
                                  "run_id int, ord int, domain string, outcome string")
    rows = sorted(sel.domain_rotation(slots, cursor=2, n_domains=8).collect(), key=lambda r: r.step)
    visited = [r.domain for r in rows if r.visited]
    # order from cursor 2: d2 starved, d3 rejected, d4 shipped, d5 starved, d6 shipped, d7 shipped -> stop
    assert visited == ["d2", "d3", "d4", "d5", "d6", "d7"]
    assert {r.next_cursor for r in rows} == {8}

"""Gate records, snapshots, counted appends, quarantine, probes and slugs."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from cairn.functions.lexicons import PHRASE_PROBES, TERM_PROBES
from cairn.operators import candidates as cd
from cairn.operators import digest as dg
from cairn.operators import harvest as hv
from cairn.operators import snapshots
from cairn.operators import vectors as vx
from cairn.sources import feeds

GOOD = {"title": "t", "one_liner": "o", "problem": "p", "why_hard": "w", "first_weekend": "f", "milestones": ["a", "b"],
        "in_plain_terms": "i", "why_it_is_hard_plainly": "h", "extra": {"kept": [1, None]},
        "glossary": [{"term": str(i), "means": "m"} for i in range(3)], "evidence_refs": ["u/1", "u/2", "x/9"]}


def records(spark, body, judgement, revision=None, again=None, sim=0.1):
    def variants(name, value):
        rows = [] if value is None else [(1, json.dumps(value))]
        return spark.createDataFrame(rows, "candidate_id long, j string").select("candidate_id", F.parse_json("j").alias(name))
    cands = variants("body", body).withColumn("domain", F.lit("d"))
    packets = spark.createDataFrame([("d", ["u/1", "u/2"])], "domain string, urls array<string>")
    out = cd.gate_records(cands, packets, lambda s: s.select("candidate_id", F.lit(sim).alias("sim"), F.lit("old one").alias("title")),
                          variants("result", judgement), variants("body", revision), variants("result", again))
    r = out.select("passed", "verdicts", F.to_json("record").alias("record")).first()
    return r.passed, [(v.stage, v.ok, v.reason) for v in r.verdicts], json.loads(r.record)


def test_a_shipped_record_keeps_what_the_judgement_leaves(spark):
    ok, verdicts, record = records(spark, GOOD, {"verdict": "Ship", "reason": "clear", "closest_existing": "tool \"x\"", "feasibility": "month"})
    assert ok and verdicts == [("grounding", True, "2 of 3 citations supplied"), ("shape", True, "well formed"),
                               ("dedup", True, "nearest past idea 0.10 ('old one')"), ("judged", True, "ship: clear")]
    assert record == {**GOOD, "evidence_refs": ["u/1", "u/2"], "closest_existing": "tool \"x\"", "feasibility": "month"}


def test_a_revised_record_has_the_original_citations(spark):
    revision = {**GOOD, "title": "narrower", "evidence_refs": ["made/up"], "revision_note": "cut"}
    ok, verdicts, record = records(spark, GOOD, {"verdict": "reframe", "reason": "wide"}, revision,
                                   {"verdict": "ship", "reason": "now", "prior_art_note": "two"})
    assert ok and [v[:2] for v in verdicts[3:]] == [("judged", True), ("revise", True), ("shape", True), ("judged", True)]
    assert verdicts[4][2] == "cut"
    assert record == {**revision, "evidence_refs": ["u/1", "u/2"], "prior_art": "two", "feasibility": ""}


def test_what_fails_comes_back_as_it_was(spark):
    left = {**GOOD, "evidence_refs": ["u/1", "u/2"]}
    for judgement, revision, again, last in [
            ({"verdict": "kill", "reason": "exists"}, None, None, ("judged", False, "verdict 'kill': exists")),
            ([1], None, None, ("judged", False, "gate returned a non-object")),
            ({"verdict": "ship", "reason": "big", "feasibility": "unrealistic"}, None, None, ("judged", False, "unrealistic scope: big")),
            ({"verdict": "reframe"}, {"withdrawn": True, "revision_note": "no core"}, None, ("revise", False, "withdrawn: no core")),
            ({"verdict": "reframe"}, {**GOOD, "title": ""}, None, ("shape", False, "missing fields: title")),
            ({"verdict": "reframe"}, GOOD, {"verdict": "reframe"}, ("revise", False, "still reframed after revision; not converging"))]:
        ok, verdicts, record = records(spark, GOOD, judgement, revision, again)
        assert not ok and verdicts[-1] == last and record == left
    assert records(spark, GOOD, None, sim=0.8)[1][-1] == ("dedup", False, "0.80 similar to 'old one'")


def test_a_reader_sees_one_version_during_a_rebuild(spark):
    base = tempfile.mkdtemp(prefix="cairn-snap-") + "/themes"
    assert snapshots.current(spark, base) is None
    tables = [{"themes": spark.range(n), "members": spark.range(10 * n)} for n in (3, 5)]
    first = snapshots.publish(spark, base, tables[0])
    # a build that dies after its first table leaves nothing that is read
    tables[1]["themes"].write.parquet(f"{base}/build-dead/themes")
    assert snapshots.current(spark, base) == first
    held = snapshots.current(spark, base)
    second = snapshots.publish(spark, base, tables[1])
    assert snapshots.current(spark, base) == second != held
    assert [snapshots.table_of(spark, held, n).count() for n in ("themes", "members")] == [3, 30]
    assert [snapshots.table_of(spark, second, n).count() for n in ("themes", "members")] == [5, 50]


def test_a_second_build_encodes_nothing(spark):
    corpus = spark.createDataFrame([(i, f"t{i}", f"some words {i}") for i in range(20)], "id long, title string, text string")
    empty = spark.createDataFrame([], "id long, text_hash string, vec array<float>")
    cache = vx.embedding_cache(corpus, empty, "m", dim=16).drop("reused")
    again = vx.embedding_cache(corpus, cache, "m", dim=16)
    assert again.filter("NOT reused").count() == 0
    changed = corpus.withColumn("text", F.when(F.col("id") == 3, "other").otherwise(F.col("text")))
    assert [r.id for r in vx.embedding_cache(changed, cache, "m", dim=16).filter("NOT reused").collect()] == [3]


def test_append_counts_in_the_writing_job(spark):
    path = tempfile.mkdtemp(prefix="cairn-append-") + "/t"
    rows = spark.createDataFrame([(i, f"s{i % 4}" if i % 7 else None, i % 2 == 0, i % 3 > 0) for i in range(60)],
                                 "id long, source string, kept boolean, new boolean")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("append", "append")
    counts = hv.append_counted(rows, path, "source", ["s0", "s1", "s9"])
    assert len(jobs.getJobIdsForGroup("append")) == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    data = [r.asDict() for r in rows.collect()]
    for name, kept, dropped, new in counts:
        mine = [r for r in data if (r["source"] if r["source"] in ("s0", "s1", "s9") else "") == name]
        assert (kept, dropped, new) == (sum(r["kept"] for r in mine), sum(not r["kept"] for r in mine), sum(r["kept"] and r["new"] for r in mine))
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [r["id"] for r in data if r["kept"] and r["new"]]


def test_a_broken_page_is_quarantined_and_the_rest_arrive(spark):
    base = tempfile.mkdtemp(prefix="cairn-quar-")
    page = {"repo": "a/b", "repo_ord": 0, "items": [{"id": 1, "html_url": "u", "title": "t", "body": "b", "state": "open",
                                                     "created_at": "2026-01-01T00:00:00Z", "reactions": {"total_count": 20}}]}
    os.makedirs(f"{base}/issues")
    with open(f"{base}/issues/p.json", "w") as f:
        f.write(json.dumps(page) + "\n\n" + json.dumps(page)[:40] + "\nnot json\n")
    got = feeds.issue_feed(spark, f"{base}/issues", 0, quarantine=f"{base}/broken").collect()
    assert [r.external_id for r in got] == ["1"]
    assert [tuple(r) for r in feeds.quarantined(spark, f"{base}/broken").collect()] == [("github", 2)]


def test_probes_in_plan_order(spark):
    assert len(PHRASE_PROBES) == 26 and len(TERM_PROBES) == 30
    docs = spark.createDataFrame([(1, "Honestly it DOES not scale, a footgun.", 9), (2, "scale does not", 9),
                                  (3, "kafka rebalance hit our consumer lag", 9), (4, "it does not scale", 1)],
                                 "doc_id long, text string, created_utc long")
    got = {(r.doc_id, r.query) for r in hv.probe_match(docs, hv.probe_table(spark), 5).collect()}
    assert got == {(1, "does not scale"), (1, "footgun"), (3, "kafka consumer lag rebalance")}
    order = [r.query for r in hv.probe_table(spark).orderBy("probe_ord").collect()]
    assert order == PHRASE_PROBES + TERM_PROBES


def test_append_keeps_null_keys_apart_from_others_only(spark):
    batch = spark.createDataFrame([(None, "a", 1), (None, "a", 2), ("s", "a", 3)], "source string, external_id string, n int")
    first = hv.idempotent_append(batch.limit(0), batch, ["source", "external_id"], [F.col("n")])
    assert sorted(r.n for r in first.collect()) == [1, 3]
    assert hv.idempotent_append(first, batch, ["source", "external_id"], [F.col("n")]).count() == 0


def test_slugs_that_collide(spark):
    ideas = spark.createDataFrame([(1, "A b", 10), (2, "a-B", 11), (3, "a b!", 11), (4, "c", 5), (5, "", 5)],
                                  "idea_id long, title string, created_utc long")
    taken = spark.createDataFrame([("c",), ("c",)], "slug string")
    got = dict(dg.unique_slugs(ideas, taken).collect())
    assert got == {1: "a-b", 2: "a-b-11", 3: "a-b-11-2", 4: "c-5", 5: "idea"}

"""Landed-feed readers (A1-A3), deck / ledger scans (A7, A8), sinks (A9, A10),
idempotent append (A6) and source union (A4)."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.operators import harvest as hv
from cairn.sources import feeds


def write(d, name, obj):
    with open(os.path.join(d, name), "w") as fh:
        fh.write(json.dumps(obj))


def test_search_hits(spark):
    d = tempfile.mkdtemp()
    write(d, "p0.json", {"query": "no way to", "probe_ord": 0, "page": 0, "nbPages": 1, "hits": [
        {"objectID": "11", "story_title": "T", "comment_text": "<p>a &amp; b</p>", "author": "x",
         "created_at_i": 5, "num_comments": 3},
        {"story_title": "no id"},
        {"objectID": "12", "comment_text": None}]})
    rows = {r.external_id: r for r in feeds.search_hits(spark, d).collect()}
    assert set(rows) == {"11", "12"}
    assert rows["11"].text == "a & b" and rows["11"].engagement == 3
    assert rows["12"].title == "" and rows["12"].author == "" and rows["12"].created_utc == 0
    assert rows["11"].url.endswith("id=11")


def test_threaded_feed(spark):
    lst, det = tempfile.mkdtemp(), tempfile.mkdtemp()
    write(lst, "a.json", {"tag": "databases", "tag_ord": 0, "page": 1,
                          "stories": [{"short_id": "s1", "comment_count": 2}, {"short_id": "s2", "comment_count": 0},
                                      {"short_id": "s3"}]})
    write(lst, "b.json", {"tag": "rust", "tag_ord": 1, "page": 1, "stories": [{"short_id": "s1", "comment_count": 2}]})
    write(det, "s1.json", {"short_id": "s1", "title": "Story", "url": "https://x/s1", "comments": [
        {"short_id": "c1", "comment": "hi", "commenting_user": "u", "created_at": "2026-08-17T10:00:00+02:00", "score": 4},
        {"short_id": "c2", "comment": "old", "created_at": "1999-01-01T00:00:00Z", "url": "https://x/c2"}]})
    write(det, "s2.json", {"short_id": "s2", "title": "Skipped", "comments": [{"short_id": "c9", "comment": "x"}]})
    write(det, "s3.json", {"short_id": "s3", "title": "No count", "comments": [{"short_id": "c3", "comment": "y",
                                                                                "created_at": "garbage"}]})
    rows = {r.external_id: r for r in feeds.threaded_feed(spark, lst, det, since=1_700_000_000).collect()}
    assert set(rows) == {"c1", "c3"}                 # c9: explicit zero count; c2: before the cutoff
    assert rows["c1"].query == "tag:databases" and rows["c1"].url == "https://x/s1"
    assert rows["c3"].created_utc == 0


def test_issue_feed(spark):
    d = tempfile.mkdtemp()
    items = [{"id": i, "html_url": f"https://gh/{i}", "title": f"bug {i}", "body": "<p>x</p>", "state": "open",
              "created_at": "2026-08-01T00:00:00Z", "user": {"login": "u"}, "reactions": {"total_count": 14 + i}}
             for i in range(50)]
    items.append({"id": 99, "title": "bad ts", "state": "open", "created_at": "nope", "reactions": {"total_count": 90}})
    write(d, "r.json", {"repo": "o/r", "repo_ord": 0, "items": items})
    rows = feeds.issue_feed(spark, d, since=1_700_000_000).collect()
    assert len(rows) == 40                               # top 40 by reactions, >= 15 only
    assert rows and all(r.engagement >= 15 for r in rows)
    bad = [r for r in rows if r.external_id == "99"][0]
    assert bad.created_utc == 1_700_000_000 and bad.title == "o/r: bad ts"


def test_decks_and_problems(spark):
    d = tempfile.mkdtemp()
    write(d, "dsa.json", {"deck": "dsa", "note": "n", "cards": [{"id": "two-pointers", "name": "Two pointers",
                                                              "problems": ["p1", "p2"]}]})
    write(d, "sd.json", {"deck": "system_design", "cards": [{"id": "cache", "prompt": "design", "must_cover": ["ttl"]}]})
    cards = feeds.decks(spark, d)
    assert {(r.deck, r.card_id) for r in cards.collect()} == {("dsa", "two-pointers"), ("system_design", "cache")}
    assert feeds.card_problems(cards).count() == 2
    assert feeds.decks(spark, os.path.join(d, "missing")).count() == 0


def test_idea_ledger_skips_corrupt_files(spark):
    d = tempfile.mkdtemp()
    write(d, "a.json", {"title": "one", "one_liner": "x"})
    with open(os.path.join(d, "b.json"), "w") as fh:
        fh.write("{not json")
    with open(os.path.join(d, "c.txt"), "w") as fh:
        fh.write("ignored")
    schema = T.StructType([T.StructField("title", T.StringType()), T.StructField("one_liner", T.StringType())])
    assert [r.title for r in feeds.idea_ledger(spark, d, schema).collect()] == ["one"]


def test_sinks_are_idempotent(spark):
    d = tempfile.mkdtemp()
    ideas = spark.createDataFrame([(1, "a"), (2, "b")], "idea_id long, title string")
    feeds.write_ideas_batch(ideas, d, "b1")
    feeds.write_ideas_batch(ideas, d, "b1")
    assert spark.read.parquet(d).count() == 2
    rej = spark.createDataFrame([(1, "storage", "grounding-")], "candidate_id long, domain string, trail string")
    feeds.write_rejects(rej, os.path.join(d, "rejects"))
    assert spark.read.parquet(os.path.join(d, "rejects")).first().domain == "storage"


def test_idempotent_append_first_in_plan_order(spark):
    existing = spark.createDataFrame([("hn", "1")], "source string, external_id string")
    batch = spark.createDataFrame([("hn", "1", 0), ("hn", "2", 3), ("hn", "2", 1), ("gh", "2", 2)],
                                  "source string, external_id string, probe_ord int")
    new = hv.idempotent_append(existing, batch, ["source", "external_id"], [F.col("probe_ord")])
    assert sorted((r.source, r.external_id, r.probe_ord) for r in new.collect()) == [("gh", "2", 2), ("hn", "2", 1)]
    # replaying the same batch after the append adds nothing
    stored = existing.unionByName(new.select("source", "external_id"))
    assert hv.idempotent_append(stored, batch, ["source", "external_id"], [F.col("probe_ord")]).count() == 0


def test_union_sources_skips_failed_source(spark):
    a = spark.createDataFrame([("x",)], "t string")
    out = hv.union_sources({"hn": a, "github": None, "lobsters": a}, ["hn", "github", "lobsters"])
    assert sorted(r.source_ord for r in out.collect()) == [0, 2]


def test_union_sources_outlives_failed_load(spark, tmp_path):
    kept = spark.createDataFrame([(7, "x")], "id long, title string")
    failed = []
    out = hv.union_sources({"a": lambda: spark.read.parquet(str(tmp_path / "nowhere")), "b": lambda: kept}, ["a", "b"], failed)
    assert [(r.id, r.source_ord) for r in out.collect()] == [(7, 1)]
    assert failed == ["a"]
    with pytest.raises(ValueError, match="a, c"):
        hv.union_sources({"a": None}, ["a", "c"])

"""Handles (F10) and queue head."""

from cairn.operators import digest as dg


def test_reply_handles(spark):
    items = spark.createDataFrame(
        [(1, 1, 10, "crashgov-explorer"), (1, 2, 11, "crashgov-two"), (1, 3, 12, "go-fast-thing"), (1, 4, 13, "")],
        "batch_id long, position int, idea_id long, slug string")
    got = {r.idea_id: r.handle for r in dg.reply_handles(items, ["trie", "crashgov2"]).collect()}
    assert got == {10: "crashgov", 11: "crashgov3", 12: "go-fast", 13: ""}


def test_queue_head_oldest_first_and_paused(spark):
    q = spark.createDataFrame([(1, i, True) for i in (5, 3, 9, 7)] + [(2, 1, True)],
                              "subscriber_id long, idea_id long, unsent boolean")
    paused = spark.createDataFrame([(2, True)], "subscriber_id long, paused boolean")
    got = [(r.subscriber_id, r.idea_id) for r in dg.queue_head(q, paused, 3).orderBy("position").collect()]
    assert got == [(1, 3), (1, 5), (1, 7)]

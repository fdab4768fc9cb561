"""Reply text functions and parsing."""

from pyspark.sql import functions as F

from cairn.functions import text as tx
from cairn.operators import replies as rp


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("o")).first()["o"]


def test_strip_quoted_sentinel_and_markers(spark):
    assert one(spark, tx.strip_quoted, "good\n--- reply above this line ---\nname it first") == "good"
    assert one(spark, tx.strip_quoted, "fine\n\nOn Mon, 17 Aug 2026, x wrote:\n> old") == "fine"
    assert one(spark, tx.strip_quoted, "ok\n\nSent from my iPhone") == "ok"
    assert one(spark, tx.strip_quoted, "plain text") == "plain text"


def test_subject_normalisation(spark):
    assert one(spark, tx.normalize_subject, "Re: Fwd: AW: ideas — a, b") == "ideas — a, b"


def test_minutes(spark):
    assert one(spark, tx.minutes, "solved 24m later") == 24
    assert one(spark, tx.minutes, "no time here") is None


def parse(spark, body, cards=("two-pointers", "dijkstra", "intervals", "dp-intervals"), ideas=("monoblame",)):
    df = spark.createDataFrame([("m1", body)], "message_id string, body string")
    b, s = rp.parse_replies(df, list(cards), list(ideas))
    return {(r.kind, r.term): r.value for r in b.collect()}, s.first()


def test_each_term_binds_its_own_grade(spark):
    got, _ = parse(spark, "two-pointers good, dijkstra again")
    assert got == {("grade", "two-pointers"): "good", ("grade", "dijkstra"): "again"}


def test_longest_id_wins(spark):
    got, _ = parse(spark, "dp-intervals hard")
    assert got == {("grade", "dp-intervals"): "hard"}


def test_verdict_and_bare_verdict(spark):
    got, s = parse(spark, "monoblame boring")
    assert got == {("verdict", "monoblame"): "boring"} and s.bare_verdict is None
    _, s = parse(spark, "meh, too easy really")
    assert s.bare_verdict == "too_easy"


def test_first_grade_per_card_and_control(spark):
    got, s = parse(spark, "dijkstra good\ndijkstra again\npause")
    assert got[("grade", "dijkstra")] == "good" and s.control == "pause"


def test_own_text_is_refused(spark):
    _, s = parse(spark, "reply above this line. name it first. good")
    assert s.unparsed and s.bare_verdict is None


def test_handles_bind_only_for_their_subscriber(spark):
    replies = spark.createDataFrame([("m1", 1, "glass-fern boring"), ("m2", 2, "glass-fern boring"), ("m3", 3, "a.b meh\naxb meh")],
                                    "message_id string, subscriber_id long, body string")
    handles = spark.createDataFrame([(1, " Glass-Fern"), (1, None), (2, "other"), (3, "a.b")],
                                    "subscriber_id long, reply_id string")
    binds, summary = rp.parse_replies(replies, [], handles)
    assert sorted(tuple(r) for r in binds.collect()) == [
        ("m1", "verdict", "glass-fern", "boring"), ("m3", "verdict", "a.b", "boring")]
    bare = {r.message_id: r.bare_verdict for r in summary.collect()}
    assert bare == {"m1": None, "m2": "boring", "m3": "boring"}


def test_every_reply_counts_as_life(spark):
    messages = spark.createDataFrame([("m1", 1, 5), ("m2", 1, 9), ("m3", 2, None), ("m4", None, 4)],
                                     "message_id string, subscriber_id long, ts long")
    assert sorted(tuple(r) for r in rp.liveness(messages).collect()) == [(1, 9, 2), (2, 0, 1)]

"""The shared harvest gate (C1) with the production lexicons: both axes are
required, short quips and hiring threads never enter."""

from cairn.operators.harvest import harvest_gate

ON_TOPIC = ("We run a raft cluster for our metadata store and the leader election kept flapping under "
            "load. It was painful: every failover corrupted the replication log and we had to build a "
            "workaround by hand. There is no way to see which replica is behind without digging through "
            "the consensus internals, and it broke again last week during a network partition.")
PAINLESS = ("Our storage layer uses postgres with a write-ahead log, mvcc, vacuum tuned nightly, a "
            "connection pool in front, columnar parquet exports for analytics, and an iceberg catalog "
            "for the lake. Compaction runs on a schedule and backups are verified every morning. "
            "Everything has been smooth and we are happy with the setup so far overall.")
OFF_TOPIC = ("The bakery down the street was a nightmare this morning. The line was painful, the coffee "
             "machine broke, and we had to wait forty minutes for a croissant that was frankly stale. "
             "There is no way to order ahead and the staff seemed frustrated with everyone in the queue "
             "which made the whole experience worse than it needed to be for all of us.")


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "title string, text string")
    return {r.title: (r.domain, r.domain_hits, r.pain) for r in harvest_gate(df, **kw).collect()}


def test_gate_requires_both_axes(spark):
    got = run(spark, [("on", ON_TOPIC), ("painless", PAINLESS), ("off", OFF_TOPIC), ("quip", "raft broke, painful")])
    assert set(got) == {"on"}
    domain, hits, pain = got["on"]
    assert domain == "distributed" and hits >= 2 and pain >= 2


def test_require_pain_off_admits_painless_domain_text(spark):
    got = run(spark, [("painless", PAINLESS)], require_pain=False)
    assert got["painless"][0] == "storage"


def test_hiring_threads_are_noise(spark):
    got = run(spark, [("Ask HN: Who is hiring? (August)", ON_TOPIC), ("A normal thread", ON_TOPIC)])
    assert set(got) == {"A normal thread"}

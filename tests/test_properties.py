"""Property tests: evidence is invariant to row order and
partitioning, even with a hot voice; idempotent append is invariant to splitting
a batch; the review fold does not depend on how the log is partitioned."""

import random

from pyspark.sql import functions as F

from cairn.operators import harvest as hv
from cairn.operators import review as rv
from cairn.operators.evidence import evidence_score

NOW = 1_800_000_000


def test_evidence_invariant_to_order_and_partitioning(spark):
    rnd = random.Random(9)
    rows = [("hot", "src0", "flooder", NOW - rnd.randint(0, 50) * 86400) for _ in range(3000)]   # one voice floods
    rows += [(f"t{rnd.randint(0, 9)}", f"src{rnd.randint(0, 4)}", rnd.choice(["a", "b", "", None, "c"]),
              rnd.choice([0, None, NOW - rnd.randint(0, 900) * 86400])) for _ in range(2000)]
    schema = "theme string, source string, author string, created_utc long"
    base = {r.theme: r.evidence for r in evidence_score(spark.createDataFrame(rows, schema), NOW).collect()}
    assert abs(base["hot"] - 1.0) < 0.2        # a flood is one voice
    for parts in (1, 3, 17):
        shuffled = rows[:]
        rnd.shuffle(shuffled)
        df = spark.createDataFrame(shuffled, schema).repartition(parts)
        got = {r.theme: r.evidence for r in evidence_score(df, NOW).collect()}
        assert got.keys() == base.keys()
        assert all(abs(got[k] - base[k]) < 1e-9 for k in got)


def test_idempotent_append_split_batch(spark):
    rnd = random.Random(4)
    batch = [("s", str(rnd.randint(0, 40)), rnd.randint(0, 5)) for _ in range(120)]
    schema = "source string, external_id string, probe_ord int"
    keys = ["source", "external_id"]
    order = [F.col("probe_ord")]
    empty = spark.createDataFrame([], "source string, external_id string")
    whole = {tuple(r) for r in hv.idempotent_append(empty, spark.createDataFrame(batch, schema), keys, order)
             .select("source", "external_id", "probe_ord").collect()}
    # split the batch: apply the first half, store it, then the second half
    first = hv.idempotent_append(empty, spark.createDataFrame(batch[:60], schema), keys, order)
    stored = first.select(*keys)
    second = hv.idempotent_append(stored, spark.createDataFrame(batch[60:], schema), keys, order)
    got_keys = {(r.source, r.external_id) for r in first.unionByName(second).collect()}
    assert got_keys == {(s, e) for s, e, _ in whole}
    # replaying the whole batch afterwards adds nothing
    again = hv.idempotent_append(first.unionByName(second).select(*keys), spark.createDataFrame(batch, schema), keys, order)
    assert again.count() == 0


def test_review_replay_invariant_to_partitioning(spark):
    rnd = random.Random(2)
    rows = [(rnd.randint(0, 3), "d0", f"c{rnd.randint(0, 4)}", rnd.randint(1, 4), 1_700_000_000 + i * 3600, i)
            for i in range(400)]
    schema = "learner_id long, deck string, card_id string, rating int, review_utc long, seq long"
    df = spark.createDataFrame(rows, schema)
    a = {(r.learner_id, r.card_id): (r.due_utc, r.reps, r.lapses) for r in rv.review_replay(df).collect()}
    b = {(r.learner_id, r.card_id): (r.due_utc, r.reps, r.lapses)
         for r in rv.review_replay(df.repartition(13).sortWithinPartitions(F.rand(3))).collect()}
    assert a == b and sum(v[1] for v in a.values()) == 400

"""Streaming forms agree with the batch folds (I1, I4, I5) and the incremental
harvest is idempotent (I7, I10)."""

import math
import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from cairn.operators import feedback as fb
from cairn.operators import review as rv
from cairn.streaming import folds
from cairn.streaming.harvest import ITEM, incremental_harvest
from cairn.streaming.ordered import newest, rocks_db, run_available, stream_ordered


def run_stream(spark, df_stream, key_cols):
    out = []
    ckpt = tempfile.mkdtemp(prefix="cairn-stream-")
    with rocks_db(spark):
        q = (df_stream.writeStream.outputMode("update").option("checkpointLocation", ckpt)
             .foreachBatch(lambda b, i: out.extend(r.asDict() for r in b.collect()))
             .trigger(availableNow=True).start())
        q.awaitTermination()
    last = {}
    for r in out:
        last[tuple(r[k] for k in key_cols)] = r
    return last


def land(spark, pdfs, schema):
    d = tempfile.mkdtemp(prefix="cairn-land-")
    for i, pdf in enumerate(pdfs):
        spark.createDataFrame(pdf, schema).coalesce(1).write.parquet(os.path.join(d, f"part{i}"))
    return d


def test_weight_fold_stream_equals_batch(spark):
    rows = [(i % 5, 100 + i, i, [1.8, 0.6, 1.3, 0.85, 0.95][i % 5] if i % 3 else 1.8) for i in range(40)]
    pdf = pd.DataFrame(rows, columns=["id", "ts", "seq", "factor"])
    schema = "id long, ts long, seq long, factor double"
    d = land(spark, [pdf.iloc[:20], pdf.iloc[20:]], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(d, "*"))
    got = run_stream(spark, folds.stream_weight_fold(stream), ["id"])
    steps = spark.createDataFrame(pdf, schema)
    verdicts = steps.select(F.col("seq").alias("idea_id"), "ts", "seq",
                            F.element_at(F.create_map(*[x for k, v in fb.WEIGHT_STEP.items() for x in (F.lit(v), F.lit(k))]),
                                         F.col("factor")).alias("verdict"))
    isig = steps.select(F.col("seq").alias("idea_id"), "id")
    batch = {r.id: r.weight for r in fb.weight_fold(verdicts, isig).collect()}
    got = {k[0]: v["weight"] for k, v in got.items()}
    assert got.keys() == batch.keys()
    assert all(math.isclose(got[k], batch[k], rel_tol=1e-12) for k in got)


def test_first_verdict_stream_equals_batch(spark):
    rows = [(i % 4, ["more", "boring", "exists"][i % 3], 1000 - i, i) for i in range(24)]
    pdf = pd.DataFrame(rows, columns=["idea_id", "verdict", "ts", "message_id"])
    schema = "idea_id long, verdict string, ts long, message_id long"
    d = land(spark, [pdf.iloc[:12], pdf.iloc[12:]], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(d, "*"))
    got = run_stream(spark, folds.stream_first_verdict(stream), ["idea_id"])
    batch = {r.idea_id: (r.verdict, r.message_id) for r in fb.first_verdict(spark.createDataFrame(pdf, schema)).collect()}
    assert {k[0]: (v["verdict"], v["message_id"]) for k, v in got.items()} == batch


def test_review_replay_stream_equals_batch(spark):
    rows = [(1, "d0", f"c{i % 3}", [3, 3, 1, 4, 2][i % 5], 1_700_000_000 + i * 3 * 86400, i) for i in range(30)]
    pdf = pd.DataFrame(rows, columns=["learner_id", "deck", "card_id", "rating", "review_utc", "seq"])
    schema = "learner_id long, deck string, card_id string, rating int, review_utc long, seq long"
    d = land(spark, [pdf.iloc[:15], pdf.iloc[15:]], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(d, "*"))
    got = run_stream(spark, folds.stream_review_replay(stream), ["learner_id", "deck", "card_id"])
    batch = {(r.learner_id, r.deck, r.card_id): (r.due_utc, r.reps, r.lapses, r.state)
             for r in rv.review_replay(spark.createDataFrame(pdf, schema)).collect()}
    assert {k: (v["due_utc"], v["reps"], v["lapses"], v["state"]) for k, v in got.items()} == batch


def test_incremental_harvest_is_idempotent(spark):
    text = ("the raft cluster failed and the consensus layer broke; it was painful and we had to "
            "build a workaround because the leader election kept flapping under load for days ") * 2
    rows = [("hn", str(i), f"u/{i}", f"t{i}", text, "a", 1_700_000_000, 1, "q") for i in range(6)]
    pdf = pd.DataFrame(rows, columns=[f.name for f in ITEM.fields])
    landed = land(spark, [pdf, pdf.iloc[:3]], ITEM)   # second file replays three keys
    store = tempfile.mkdtemp(prefix="cairn-store-")
    ckpt = tempfile.mkdtemp(prefix="cairn-ckpt-")
    incremental_harvest(spark, os.path.join(landed, "*"), store, ckpt)
    n1 = spark.read.parquet(store).count()
    incremental_harvest(spark, os.path.join(landed, "*"), store, ckpt)   # restart: nothing new
    assert n1 == 6 and spark.read.parquet(store).count() == 6


def brute_alerts(events, clock, day):
    """E7 tried at every moment of one subscriber's events."""
    out, fired = [], None
    first = min((t for k, _, _, t in events if k == "send"), default=None)
    for now in range(min(t for *_, t in events), clock):
        last = max((t for k, _, _, t in events if k == "reply" and t <= now), default=None)
        since = last if last is not None else first
        if since is None or now < since + 14 * day:
            continue
        done = {i for k, i, _, t in events if k == "verdict" and t <= now}
        n = sum(k == "send" and since <= t <= now and i not in done for k, i, _, t in events)
        if n < 4 or (fired is not None and (last is None or fired > last) and now - fired < 14 * day):
            continue
        fired = now
        out.append((now, n, (now - since) // day))
    return out


def test_canary_equals_the_rule_on_shuffled_events(spark):
    import random

    from cairn.streaming.canary import SilenceFold
    rnd, rows = random.Random(4), []
    for sub in range(12):
        t = rnd.randrange(50)
        for i in range(rnd.randrange(3, 25)):
            rows.append((sub, "send", 100 * sub + i, rnd.choice(["a", "b", None]), t))
            if rnd.random() < 0.15:
                rows.append((sub, "reply", None, None, t + rnd.randrange(1, 40)))
            if rnd.random() < 0.2:
                rows.append((sub, "verdict", 100 * sub + i, None, t + rnd.randrange(1, 40)))
            t += rnd.randrange(0, 60)
    clock = max(r[-1] for r in rows) + 500
    want = {(sub, *a) for sub in range(12) for a in brute_alerts([r[1:] for r in rows if r[0] == sub], clock, 10)}
    rows = [(*r, n) for n, r in enumerate(rows)]
    rows.sort(key=lambda r: r[4] + rnd.randrange(0, 100))             # late by less than the delay
    third = len(rows) // 3
    tick = [(-1, "clock", None, None, clock + 150, -1)]
    base, out = tempfile.mkdtemp(prefix="cairn-canary-"), tempfile.mkdtemp(prefix="cairn-alerts-") + "/a"
    schema = "subscriber_id long, kind string, idea_id long, domain string, ts long, seq long"
    for lot in (rows[:third], rows[third:2 * third], rows[2 * third:], tick, tick):
        spark.createDataFrame(lot, schema).coalesce(2).write.mode("append").parquet(f"{base}/in")
        stream = stream_ordered(spark.readStream.schema(schema).parquet(f"{base}/in"), ["subscriber_id"], SilenceFold(day=10),
                                "150 seconds")
        run_available(stream, out, f"{base}/ckpt", "append")
    got = [(r.subscriber_id, r.now_utc, r.n_unanswered, r.quiet_days) for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_folds_do_not_depend_on_how_events_arrive(spark):
    import random
    rnd = random.Random(7)
    steps = [(k, 1000 + rnd.randrange(400), n, rnd.choice([1.8, 0.6, 1.3])) for n in range(300) for k in (n % 3,)]
    steps += [(5, 1000, -1, 1.3)]
    schema = "id long, ts long, seq long, factor double"
    base, out = tempfile.mkdtemp(prefix="cairn-fold-"), tempfile.mkdtemp(prefix="cairn-fold-") + "/o"
    late = sorted(steps, key=lambda r: r[1] + rnd.randrange(0, 100))
    for lot in (late[:100], late[100:200], late[200:]):
        spark.createDataFrame(lot, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = folds.stream_weight_fold(spark.readStream.schema(schema).parquet(f"{base}/in"), "150 seconds")
        run_available(stream, out, f"{base}/ckpt")
    got = {r.id: (round(r.weight, 9), r.n_steps) for r in newest(spark.read.parquet(out), ["id"]).collect()}
    batch = {r.id: (round(r.weight, 9), r.n_steps) for r in fb.fold_steps(spark.createDataFrame(steps, schema)).collect()}
    assert got == batch and len(got) == 4


def test_harvest_does_not_read_its_store(spark, monkeypatch):
    from cairn.streaming import harvest
    store, ckpt = tempfile.mkdtemp(prefix="cairn-store-") + "/s", tempfile.mkdtemp(prefix="cairn-ckpt-") + "/c"
    landed = land(spark, [_items(range(5), 1_700_000_000)], ITEM)
    incremental_harvest(spark, os.path.join(landed, "*"), store, ckpt)

    def no_read(*_):
        raise AssertionError("the store was read")
    monkeypatch.setattr(harvest, "_stored", no_read)
    spark.createDataFrame(_items([3, 4, 5, 6], 1_700_000_000), ITEM).write.parquet(os.path.join(landed, "later"))
    incremental_harvest(spark, os.path.join(landed, "*"), store, ckpt)
    assert sorted(int(r.external_id) for r in spark.read.parquet(store).collect()) == list(range(7))


def test_a_new_stream_over_a_filled_store_repeats_nothing(spark):
    store = tempfile.mkdtemp(prefix="cairn-store-") + "/s"
    landed = land(spark, [_items(range(5), 1_700_000_000)], ITEM)
    incremental_harvest(spark, os.path.join(landed, "*"), store, tempfile.mkdtemp(prefix="cairn-ckpt-") + "/a")
    spark.createDataFrame(_items(range(3, 8), 1_700_000_000), ITEM).write.parquet(os.path.join(landed, "later"))
    other = tempfile.mkdtemp(prefix="cairn-ckpt-") + "/b"
    for _ in range(2):         # batch numbers start again with the new checkpoint; its rows go beside the old ones
        incremental_harvest(spark, os.path.join(landed, "*"), store, other)
        assert sorted(int(r.external_id) for r in spark.read.parquet(store).collect()) == list(range(8))


def test_weight_fold_partitioning_is_invisible(spark):
    import random
    rnd = random.Random(5)
    factors = list(fb.WEIGHT_STEP.items())
    rows = [(rnd.randint(0, 3), rnd.randint(0, 50), i) for i in range(300)]      # (signal, ts, seq)
    verd = [(i, factors[rnd.randrange(len(factors))][0], ts, i) for i, (_, ts, _) in enumerate(rows)]
    v = spark.createDataFrame(verd, "idea_id long, verdict string, ts long, seq long")
    isig = spark.createDataFrame([(i, s) for i, (s, _, _) in enumerate(rows)], "idea_id long, id long")
    expect = {}
    for sig in range(4):
        w = 1.0
        for (s, ts, seq), (_, verdict, _, _) in sorted(zip(rows, verd), key=lambda p: (p[0][1], p[0][2])):
            if s == sig:
                w = max(0.1, min(4.0, w * fb.WEIGHT_STEP[verdict]))
        expect[sig] = w
    for parts in (1, 7, 64):
        got = {r.id: r.weight for r in fb.weight_fold(v, isig, partitions=parts).collect()}
        assert got.keys() == expect.keys()
        assert all(math.isclose(got[k], expect[k], rel_tol=1e-12) for k in got)


GATED = ("the raft cluster failed and the consensus layer broke; it was painful and we had to "
         "build a workaround because the leader election kept flapping under load for days ") * 2


def _items(ids, created):
    return pd.DataFrame([("hn", str(i), f"u/{i}", f"t{i}", GATED, "a", created, 1, "q") for i in ids],
                        columns=[f.name for f in ITEM.fields])


def test_replayed_batch_keeps_its_rows(spark):
    from cairn.streaming.harvest import commit_batch
    store = tempfile.mkdtemp(prefix="cairn-store-") + "/s"
    batch = spark.createDataFrame(_items(range(6), 1_700_000_000), ITEM)
    commit = commit_batch(store)
    for batch_id in (0, 0, 1, 0):
        commit(batch, batch_id)
        assert spark.read.parquet(store).count() == 6


def test_old_and_undated_rows_are_stored(spark):
    store, ckpt = tempfile.mkdtemp(prefix="cairn-store-"), tempfile.mkdtemp(prefix="cairn-ckpt-")
    landed = land(spark, [_items(range(4), 1_700_000_000)], ITEM)
    incremental_harvest(spark, os.path.join(landed, "*"), store, ckpt)
    spark.createDataFrame(pd.concat([_items([4, 5], 0), _items([6, 7], 1_700_000_000 - 60 * 86400), _items([0], 5)]),
                          ITEM).write.parquet(os.path.join(landed, "later"))
    incremental_harvest(spark, os.path.join(landed, "*"), store, ckpt)
    assert sorted(int(r.external_id) for r in spark.read.parquet(store).collect()) == list(range(8))


def test_unreadable_store_is_not_taken_for_empty(spark):
    import pytest

    from cairn.streaming.harvest import commit_batch
    store = tempfile.mkdtemp(prefix="cairn-store-")
    with open(os.path.join(store, "part-0.parquet"), "w") as f:
        f.write("no parquet")
    with pytest.raises(Exception):
        commit_batch(store)(spark.createDataFrame(_items([1], 1), ITEM), 0)
    assert not os.path.exists(os.path.join(store, "batch=0"))


def test_late_events_are_folded_at_their_place(spark):
    everything = spark.createDataFrame([(k, 1000 + 7 * i % 60, i) for i in range(60) for k in (1, 2, None)],
                                       "id long, ts long, seq long")
    base = tempfile.mkdtemp(prefix="cairn-refold-")
    write = folds.refold_touched(f"{base}/log", f"{base}/out", ["id"],
                                 lambda d: d.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("ts", "seq"))).alias("order"),
                                                               F.count("*").alias("n")))
    for batch_id, lot in enumerate((2, 0, 1)):
        batch = everything.filter(F.col("seq") % 3 == lot)
        write(batch, batch_id)
        write(batch, batch_id)            # a replay changes nothing
    write(everything.filter("seq < 0"), 3)       # an empty batch neither
    got = {r.id: (r.n, [tuple(x) for x in r.order]) for r in folds.folded(spark.read.parquet(f"{base}/out"), ["id"]).collect()}
    want = sorted((1000 + 7 * i % 60, i) for i in range(60))
    assert got == {k: (60, want) for k in (1, 2, None)}


def test_refolded_reviews_equal_the_batch_replay(spark):
    rows = [(1, "d", "c", (i * 5) % 4 + 1, 86400 * i, i) for i in range(12)]
    log = spark.createDataFrame(rows, "learner_id long, deck string, card_id string, rating int, review_utc long, seq long")
    base, keys = tempfile.mkdtemp(prefix="cairn-refold-"), ["learner_id", "deck", "card_id"]
    write = folds.refold_touched(f"{base}/log", f"{base}/out", keys, rv.review_replay)
    write(log.filter("seq % 2 = 1"), 0)
    write(log.filter("seq % 2 = 0"), 1)
    got = folds.folded(spark.read.parquet(f"{base}/out"), keys)
    assert got.first().asDict() == rv.review_replay(log).first().asDict()


def test_keys_share_the_calls_of_their_bucket(spark, monkeypatch):
    """Keys with a NULL and beyond a double's reach stay exact, though several share a call and a row of state."""
    from cairn.streaming import ordered
    monkeypatch.setattr(ordered, "BUCKETS", 3)
    big = 1 << 60
    keys = [None, *range(big, big + 20)]
    steps = [(k, "a" if n % 2 else None, 1000 + 37 * n % 100, 100 * i + n, [1.8, 0.6, 1.3][(n + i) % 3])
             for i, k in enumerate(keys) for n in range(9)]
    schema = "id long, kind string, ts long, seq long, factor double"
    base = tempfile.mkdtemp(prefix="cairn-fold-")
    for lot in (steps[::2], steps[1::2]):
        spark.createDataFrame(lot, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = stream_ordered(spark.readStream.schema(schema).parquet(f"{base}/in"), ["id", "kind"], folds.WeightFold(), "1 day")
        assert [c for c, _ in stream.dtypes] == ["id", "kind", "weight", "n_steps"] and dict(stream.dtypes)["id"] == "bigint"
        run_available(stream, f"{base}/out", f"{base}/ckpt")
    got = {(r.id, r.kind): (round(r.weight, 9), r.n_steps)
           for r in newest(spark.read.parquet(f"{base}/out"), ["id", "kind"]).collect()}
    want = {}
    for k, kind, _, _, f in sorted(steps, key=lambda x: x[2:4]):
        w, n = want.get((k, kind), (1.0, 0))
        want[k, kind] = (max(0.1, min(4.0, w * f)), n + 1)
    assert got == {k: (round(w, 9), n) for k, (w, n) in want.items()} and len(got) == 42


def test_a_call_serves_all_keys_of_a_bucket():
    from types import SimpleNamespace

    from cairn.streaming import ordered
    calls = []

    class Fold(folds.WeightFold):
        def start(self):
            calls.append(1)
            return super().start()

    kept = SimpleNamespace(exists=False, hasTimedOut=False, getCurrentWatermarkMs=lambda: 0, update=lambda v: calls.append(v),
                           setTimeoutTimestamp=lambda t: calls.append(t))
    frame = pd.DataFrame({"id": [str(i % 500) for i in range(1000)], "ts_s": [50] * 1000, "seq": range(1000),
                          "body": ['{"factor":1.3}'] * 1000})
    shown = list(ordered._Bucket(Fold(), ["id"], ["id", "weight", "n_steps"])((0,), [frame], kept))
    assert len(shown) == 1 and len(shown[0]) == 500 and set(shown[0]["n_steps"]) == {2}
    assert calls[-1] == 50_999 and len(calls) == 502

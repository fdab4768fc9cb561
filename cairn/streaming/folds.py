"""Structured Streaming forms of the order-dependent folds (I1, I4, I5), all on streaming state.

The first verdict (I4) is a minimum, so its state is one row a key and any order will do. The weight (I5) and
the review state (I1) depend on the order: they are folds of ``ordered``, which holds events back until the
watermark has passed them.

Where events may be later than any watermark allows, ``refold_touched`` keeps them in a log and folds the keys
of each micro-batch again with the batch operator, at the price of reading the log.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.feedback import WEIGHT_MAX, WEIGHT_MIN
from ..operators.review import MODES, replay_card
from .ordered import Fold, newest, stream_ordered

DELAY = "3 days"

FIRST_OUT = "idea_id long, verdict string, ts long, message_id long"
FIRST_STATE = "verdict string, ts long, message_id long"


def stream_first_verdict(verdicts: DataFrame) -> DataFrame:
    """I4 stream: the earliest (ts, message_id) verdict per idea; a replayed or
    later reply never changes it, a late one that is earlier does."""

    def first(key, batches, state):
        cur = state.get if state.exists else None
        pdf = pd.concat(list(batches)).sort_values(["ts", "message_id"])
        head = pdf.iloc[0]
        cand = (str(head["verdict"]), int(head["ts"]), int(head["message_id"]))
        if cur is None or (cand[1], cand[2]) < (cur[1], cur[2]):
            cur = cand
            state.update(cur)
        yield pd.DataFrame({"idea_id": [key[0]], "verdict": [cur[0]], "ts": [cur[1]], "message_id": [cur[2]]})

    return verdicts.groupBy("idea_id").applyInPandasWithState(first, FIRST_OUT, FIRST_STATE, "update",
                                                              GroupStateTimeout.NoTimeout)


class WeightFold(Fold):
    """Each step multiplies the weight, which stays within its bounds after every one."""

    columns = ["factor"]
    out = "weight double, n_steps long"

    def start(self):
        return {"weight": 1.0, "n_steps": 0}

    def step(self, state, ts, event):
        state["weight"] = max(WEIGHT_MIN, min(WEIGHT_MAX, state["weight"] * float(event[0])))
        state["n_steps"] += 1

    def row(self, state):
        return dict(state)


def stream_weight_fold(steps: DataFrame, delay: str = DELAY) -> DataFrame:
    """I5 stream: ``steps(id, ts, seq, factor)`` -> the clamped weight of each signal."""
    return stream_ordered(steps, ["id"], WeightFold(), delay)


class ReviewFold(Fold):
    """A card's grades lead its review state on."""

    columns = ["rating"]
    out = ("state string, stability double, difficulty double, due_utc long, reps long, lapses long, fails long, "
           "last_utc long")

    def __init__(self, mode: str):
        self.retention, self.longest = MODES[mode][0], MODES[mode][1]

    def start(self):
        return {}

    def step(self, state, ts, event):
        state.update(replay_card([int(event[0])], [ts], self.retention, self.longest, init=dict(state) or None))

    def row(self, state):
        return {k: v for k, v in state.items() if k != "step"} if state else None


def stream_review_replay(log: DataFrame, mode: str = "recruiting", delay: str = DELAY) -> DataFrame:
    """I1 stream: the review state of each (learner, deck, card); grades out of 1 to 4 are skipped."""
    graded = log.filter("rating BETWEEN 1 AND 4")
    return stream_ordered(graded, ["learner_id", "deck", "card_id"], ReviewFold(mode), delay, ts="review_utc")


def refold_touched(log: str, out: str, keys: list[str], fold: Callable[[DataFrame], DataFrame]):
    """foreachBatch sink that folds late events in order. Each micro-batch is added to ``log``, and
    ``fold`` (a batch operator) runs over the whole history of the keys it touches; the rows go to
    ``out``, where ``folded`` reads the newest of each key. Both folders have one directory per
    batch, written with overwrite, and a batch reads no later ones, so a replay gives the same
    rows. Reads the log once a batch: its size, not the state's, sets the price of exactness."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{log.rstrip('/')}/batch={batch_id}")
        events = spark.read.schema(T.StructType(batch.schema.fields + [T.StructField("batch", T.LongType())])).parquet(log)
        touched = events.filter(F.col("batch") == batch_id).select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        history = events.filter(F.col("batch") <= batch_id).drop("batch").join(touched, same, "left_semi")
        fold(history).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch_id}")

    return write


folded = newest

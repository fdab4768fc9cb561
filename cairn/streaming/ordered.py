"""Order-dependent folds on streaming state.

Events of a key may arrive in any order within the watermark's delay. They wait in the state; an event-time
timeout comes when the watermark has passed the first of them, and all that are older than the watermark
are folded in (ts, seq) order into the key's value and leave it. What is older than the watermark when it
arrives is late and dropped by Spark. So each batch reads what it brings, the values and what still waits, whatever
the length of the history, and the result does not depend on the batches.

Keys are dealt by hash to ``BUCKETS`` groups, and Spark calls Python once for a group, not for a key, with the state of
its keys in one row: a call, its timeout and its state's way to Python cost far more than a key's fold.

A fold that ``shows`` its value gives a row for every key of a batch: the folded value led on by what
waits, which is the batch operator's result over all that has arrived. One that does not gives
rows as events are folded and as time passes (``due``), in event time.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
BUCKETS = 512          # groups of keys; a group's keys share one call and one row of state
OUT_ROWS = 10_000      # of a frame that a call gives


class Fold:
    """What a key keeps (a dict that JSON can hold) and how events change it."""

    columns: list[str] = []       # of an event beside ts and seq
    out = ""                      # the output's columns beside the keys
    shows = True

    def start(self) -> dict:
        raise NotImplementedError

    def step(self, state: dict, ts: int, event: list) -> None:
        raise NotImplementedError

    def row(self, state: dict) -> dict | None:
        """The shown value."""
        return None

    def due(self, state: dict) -> int | None:
        """When the passing of time alone changes something."""
        return None

    def idle(self, state: dict, until: int) -> list[dict]:
        """What happens before ``until`` (exclusive) if nothing arrives."""
        return []


class _Bucket:
    """What a group of keys keeps: by key the folded value (JSON, or None), the events that wait in (ts, seq) order and
    when time alone changes something."""

    def __init__(self, fold: Fold, keys: list[str], out: list[str]):
        self.fold, self.keys, self.out = fold, keys, out

    def _value(self, body: str | None) -> dict:
        return self.fold.start() if body is None else json.loads(body)

    def _step(self, value: dict, ts: int, body: str) -> None:
        self.fold.step(value, ts, list(json.loads(body).values()))

    def _arrive(self, held: dict, frames) -> dict:
        fresh: dict = {}
        for f in frames:
            names = zip(*[f[k].tolist() for k in self.keys])
            for name, t, s, b in zip(names, f["ts_s"].tolist(), f["seq"].tolist(), f["body"].tolist()):
                fresh.setdefault(name, []).append((int(t), int(s), b))
        for name, events in fresh.items():
            entry = held.setdefault(name, [None, [], None])
            entry[1] = sorted(entry[1] + events, key=lambda x: x[:2])
        return fresh

    def _shown(self, entry: list) -> dict | None:
        value = self._value(entry[0])
        for ts, _, body in entry[1]:
            self._step(value, ts, body)
        return self.fold.row(value)

    def _pass(self, entry: list, passed: int) -> list[dict]:
        """Fold in what is older than ``passed`` and let time pass up to it."""
        value, out, waiting = self._value(entry[0]), [], entry[1]
        n = 0
        while n < len(waiting) and waiting[n][0] < passed:
            out += self.fold.idle(value, waiting[n][0])
            self._step(value, waiting[n][0], waiting[n][2])
            n += 1
        out += self.fold.idle(value, passed)
        entry[:] = [json.dumps(value), waiting[n:], self.fold.due(value)]
        return out

    def __call__(self, key, frames, state) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else {}
        clock = state.getCurrentWatermarkMs()
        passed, rows = clock // 1000, []
        if not state.hasTimedOut:
            for name in self._arrive(held, frames):
                if self.fold.shows and (shown := self._shown(held[name])) is not None:
                    rows.append((name, shown))
        wake = None
        for name, entry in held.items():
            first = _earliest(entry)
            if first is not None and first < passed:
                rows += [(name, r) for r in self._pass(entry, passed)]
                first = _earliest(entry)
            if first is not None and (wake is None or first < wake):
                wake = first
        state.update((pickle.dumps(held, pickle.HIGHEST_PROTOCOL),))
        if wake is not None:
            # Spark wakes a group when the watermark is beyond its time
            state.setTimeoutTimestamp(max((wake + 1) * 1000 - 1, clock + 1))
        for at in range(0, len(rows), OUT_ROWS):
            yield pd.DataFrame([{**dict(zip(self.keys, name)), **r} for name, r in rows[at:at + OUT_ROWS]], columns=self.out)


def _earliest(entry: list) -> int | None:
    """When the key has to be looked at: at its first waiting event, or when time alone changes something."""
    _, waiting, due = entry
    if not waiting:
        return due
    return waiting[0][0] if due is None else min(waiting[0][0], due)


def stream_ordered(events: DataFrame, keys: list[str], fold: Fold, delay: str, ts: str = "ts") -> DataFrame:
    """``fold`` over ``events(keys, ts in seconds, seq, the fold's columns)``, each key on its own; ``delay`` is how
    much older than the newest an event may arrive. The session should keep its state in RocksDB (``rocks_db``)."""
    kinds = dict(events.dtypes)
    # keys travel as text, which pandas keeps exact beside NULLs
    schema = ", ".join(f"{k} string" for k in keys) + ", " + fold.out
    out = [c.split()[0] for c in schema.split(", ")]
    body = F.to_json(F.struct(*fold.columns), {"ignoreNullFields": "false"})
    timed = (events.select(F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("bucket"), *[F.col(k).cast("string").alias(k) for k in keys],
                           F.col(ts).alias("ts_s"), "seq", body.alias("body"), F.timestamp_seconds(ts).alias("event_time"))
             .withWatermark("event_time", delay))
    folded = timed.groupBy("bucket").applyInPandasWithState(
        _Bucket(fold, keys, out), schema, "held binary", "update" if fold.shows else "append", GroupStateTimeout.EventTimeTimeout)
    return folded.select(*[F.col(k).cast(kinds[k]).alias(k) for k in keys], *out[len(keys):])


class rocks_db:
    """While this is open, streams that start keep their state in RocksDB; the setting is put back after."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.was = self.spark.conf.get(_PROVIDER, None)
        self.spark.conf.set(_PROVIDER, ROCKS_DB)

    def __exit__(self, *_):
        if self.was is None:
            self.spark.conf.unset(_PROVIDER)
        else:
            self.spark.conf.set(_PROVIDER, self.was)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "update") -> None:
    """Run ``stream`` over all that has landed and stop; each batch writes a directory of its own under ``out`` with
    overwrite, so one that is run again gives the same rows once."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch_id}")

    with rocks_db(stream.sparkSession):
        (stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start().awaitTermination())


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last shown row of each key in what ``run_available`` wrote."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__row")).select(*keys, "__row.*")

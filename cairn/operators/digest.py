"""Digest assembly: queue head (F9), short unique reply handles (F10) and the
once-per-local-day guard (I8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

IDEAS_PER_DIGEST = 3


def queue_head(queue: DataFrame, paused: DataFrame | None = None, k: int = IDEAS_PER_DIGEST) -> DataFrame:
    """per subscriber the ``k`` oldest unsent ideas (by id); paused
    subscribers get none. ``queue(subscriber_id, idea_id, unsent)``."""
    q = queue.filter(F.col("unsent"))
    if paused is not None:
        q = q.join(paused.filter(F.col("paused")).select("subscriber_id"), "subscriber_id", "left_anti")
    w = Window.partitionBy("subscriber_id").orderBy("idea_id")
    return q.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def handle_base(slug: Column) -> Column:
    """First slug token when it has 3+ characters, else the first two joined by '-'."""
    parts = F.filter(F.split(F.coalesce(slug, F.lit("")), "-"), lambda p: p != "")
    return (F.when(F.size(parts) == 0, F.lit(""))
            .when(F.length(parts[0]) >= 3, parts[0])
            .otherwise(F.array_join(F.slice(parts, 1, 2), "-")))


def reply_handles(batch_items: DataFrame, taken: list[str]) -> DataFrame:
    """F10 per batch: each idea (in order) gets its base handle, or base + the
    smallest n in 2..99 not yet taken (card ids and handles handed out earlier in
    the batch are taken), else the full slug. A batch is a digest (at most a few
    ideas), so the in-order fold runs over a bounded per-batch array.
    ``batch_items(batch_id, position, idea_id, slug)``."""
    items = batch_items.select("batch_id", F.struct("position", "idea_id", "slug",
                                                    handle_base(F.col("slug")).alias("base")).alias("it"))
    per = items.groupBy("batch_id").agg(F.array_sort(F.collect_list("it")).alias("its"))
    init = F.struct(F.array(*[F.lit(t) for t in taken]).cast("array<string>").alias("taken"),
                    F.array().cast("array<struct<idea_id:bigint,handle:string>>").alias("out"))

    def step(acc, it):
        base = it["base"]
        free = F.filter(F.sequence(F.lit(2), F.lit(99)),
                        lambda n: ~F.array_contains(acc["taken"], F.concat(base, n.cast("string"))))
        handle = (F.when(base == "", F.lit(""))
                  .when(~F.array_contains(acc["taken"], base), base)
                  .when(F.size(free) > 0, F.concat(base, free[0].cast("string")))
                  .otherwise(it["slug"]))
        return F.struct(F.array_append(acc["taken"], handle).alias("taken"),
                        F.array_append(acc["out"], F.struct(it["idea_id"].cast("bigint").alias("idea_id"),
                                                            handle.alias("handle"))).alias("out"))

    folded = per.select("batch_id", F.aggregate("its", init, step)["out"].alias("out"))
    return folded.select("batch_id", F.inline("out"))


def once_per_day(candidates: DataFrame, sent_log: DataFrame, force: bool = False) -> DataFrame:
    """I8: keep (subscriber, local_date) pairs for which no digest was sent yet."""
    c = candidates.select("subscriber_id", "local_date").distinct()
    if force:
        return c
    return c.join(sent_log.select("subscriber_id", "local_date"), ["subscriber_id", "local_date"], "left_anti")


def unique_slugs(ideas: DataFrame, taken: DataFrame) -> DataFrame:
    """B10 with collisions: ``ideas(idea_id, title, created_utc)`` -> (idea_id, slug). A slug that is in ``taken(slug)``, or
    that an earlier idea of the batch has, gets the idea's time as a suffix; where two of one second would still share one,
    the later ids get a number too."""
    x = ideas.select("idea_id", "created_utc", tx.slugify(F.col("title")).alias("base"))
    held = taken.select(F.col("slug").alias("base")).distinct().withColumn("held", F.lit(True))
    x = x.join(held, "base", "left")
    batch = Window.partitionBy("base").orderBy("created_utc", "idea_id")
    x = x.withColumn("plain", F.col("held").isNull() & (F.row_number().over(batch) == 1))
    second = Window.partitionBy("base", "plain", "created_utc").orderBy("idea_id")
    k = F.row_number().over(second)
    dated = F.concat("base", F.lit("-"), F.col("created_utc").cast("string"),
                     F.when(F.col("k") > 1, F.concat(F.lit("-"), F.col("k").cast("string"))).otherwise(F.lit("")))
    return x.withColumn("k", k).select("idea_id", F.when(F.col("plain"), F.col("base")).otherwise(dated).alias("slug"))

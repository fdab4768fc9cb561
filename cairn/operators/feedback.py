"""Feedback folds: own-message filter (C12), verdict routing (D7-D9), first verdict
wins (I4), weight fold (I5), pause/resume (I6) and the silence canary (E7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# ---- FIXED VALUES: multiplicative step per verdict, and the clamp range ----
WEIGHT_STEP = {"building": 1.8, "more": 1.3, "too_hard": 1.0, "exists": 0.95,
               "too_easy": 0.85, "boring": 0.6}
WEIGHT_MIN, WEIGHT_MAX = 0.1, 4.0
OUR_PREFIXES = ["prep —", "prep -", "ideas —", "ideas -"]


def own_message_filter(messages: DataFrame, sent_titles: DataFrame) -> DataFrame:
    """A reply is ours when its normalised subject is a title we sent or starts
    with one of the digest prefixes. ``sent_titles(title)`` is lower-cased/trimmed."""
    norm = messages.select("message_id", tx.normalize_subject(F.col("subject")).alias("subject_norm"))
    sent = sent_titles.select(F.col("title").alias("subject_norm")).distinct().withColumn("_sent", F.lit(True))
    prefixed = F.lit(False)
    for p in OUR_PREFIXES:
        prefixed = prefixed | F.startswith(F.col("subject_norm"), F.lit(p))
    return (norm.join(sent, "subject_norm", "left")
            .select("message_id", "subject_norm",
                    ((F.col("subject_norm") != "") & (F.coalesce("_sent", F.lit(False)) | prefixed)).alias("is_ours")))


MAX_PER_RUN = 20


def mail_run(messages: DataFrame, sent_titles: DataFrame, most: int = MAX_PER_RUN) -> DataFrame:
    """What one run over each mailbox takes in: of its messages that are ours the newest ``most`` (ties: the larger
    id); the rest wait for the next run. ``messages(mailbox, message_id, received_utc, subject)``."""
    ours = own_message_filter(messages, sent_titles).filter("is_ours").select("message_id")
    newest = Window.partitionBy("mailbox").orderBy(F.col("received_utc").desc(), F.col("message_id").desc())
    return (messages.join(ours, "message_id").withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= most)
            .select("mailbox", "message_id", "place"))


def first_verdict(verdicts: DataFrame) -> DataFrame:
    """I4: only the first verdict per idea applies (order: ts, then message_id)."""
    return verdicts.groupBy("idea_id").agg(
        F.min_by(F.struct("verdict", "ts", "message_id"), F.struct("ts", "message_id")).alias("first"),
    ).select("idea_id", "first.verdict", "first.ts", "first.message_id")


def _compose(acc, x):
    """Clamped-multiply steps compose: doing (F1, L1, H1) then (F2, L2, H2), each
    meaning w -> min(H, max(L, F * w)), is (F1*F2, min(max(F2*L1, L2), H2),
    max(min(F2*H1, H2), L2))."""
    return F.struct((acc["f"] * x["f"]).alias("f"),
                    F.least(F.greatest(x["f"] * acc["lo"], x["lo"]), x["hi"]).alias("lo"),
                    F.greatest(F.least(x["f"] * acc["hi"], x["hi"]), x["lo"]).alias("hi"),
                    (acc["n"] + x["n"]).alias("n"))


def weight_fold(verdicts: DataFrame, idea_signal: DataFrame, steps: dict[str, float] = WEIGHT_STEP,
                partitions: int | None = None) -> DataFrame:
    """Each verdict multiplies the weight of every signal its idea cited by the
    verdict's step, clamping to [0.1, 4.0] after *each* step, in (ts, seq) order;
    start weight 1.0.

    The fold is order-dependent but associative: a run of clamped multiplications
    is itself one clamped multiplication (see ``_compose``). Steps are therefore
    range-partitioned on (signal, ts, seq) -- which also splits a hot signal over
    many tasks -- and folded in chunks (``fold_steps``). No group ever holds a signal's
    whole history."""
    step = F.create_map(*[x for k, v in steps.items() for x in (F.lit(k), F.lit(v))])
    per_signal = (verdicts.join(idea_signal, "idea_id")
                  .select("id", "ts", "seq", step[F.col("verdict")].alias("factor"))
                  .filter(F.col("factor").isNotNull()))
    return fold_steps(per_signal, partitions)


CHUNK = 1024      # consecutive steps that are composed in one array


def fold_steps(steps: DataFrame, partitions: int | None = None) -> DataFrame:
    """The fold of I5 over ``steps(id, ts, seq, factor)``: (id, weight, n_steps). A segmented scan in expressions:
    rows sorted by (id, ts, seq) are cut into chunks, an id's part of a chunk becomes one clamped multiplication, and
    these (a thousandth of the steps) are composed in order."""
    n_parts = partitions or int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = steps.repartitionByRange(n_parts, "id", "ts", "seq").sortWithinPartitions("id", "ts", "seq")
    # the counter runs through a partition in its order, with the partition's number above it
    chunked = ordered.select("id", "ts", "seq", "factor",
                             F.floor(F.monotonically_increasing_id() / F.lit(CHUNK)).alias("chunk"))
    one = F.struct(F.lit(1.0).alias("f"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"),
                   F.lit(0).cast("long").alias("n"))

    def composed(ops):
        return F.aggregate(ops, one, _compose)

    parts = (chunked.groupBy("id", "chunk").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "factor"))).alias("s"))
             .select("id", F.col("s")[0]["ts"].alias("ts"), F.col("s")[0]["seq"].alias("seq"),
                     composed(F.transform("s", lambda x: F.struct(
                         x["factor"].cast("double").alias("f"), F.lit(WEIGHT_MIN).alias("lo"), F.lit(WEIGHT_MAX).alias("hi"),
                         F.lit(1).cast("long").alias("n")))).alias("op")))
    folded = (parts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "op"))).alias("p"))
              .select("id", composed(F.transform("p", lambda x: x["op"])).alias("total")))
    return folded.select("id", F.least(F.col("total.hi"), F.greatest(F.col("total.lo"), F.col("total.f"))).alias("weight"),
                         F.col("total.n").cast("int").alias("n_steps"))


def latest_control(controls: DataFrame, key: str = "subscriber_id") -> DataFrame:
    """Last control word wins (pause / resume)."""
    return controls.groupBy(key).agg(F.max_by("action", F.struct("ts", "seq")).alias("action"))


def recent_handles(sent: DataFrame, k: int = 12) -> DataFrame:
    """Handle -> idea among the most recent ``k`` sent ideas per subscriber;
    on a handle collision the newest send wins. Handles are trimmed and lower-cased;
    ideas without one take no place."""
    sent = (sent.withColumn("reply_id", F.lower(F.trim(F.col("reply_id").cast("string"))))
            .filter(F.coalesce(F.col("reply_id"), F.lit("")) != ""))
    w = Window.partitionBy("subscriber_id").orderBy(F.col("sent_utc").desc(), F.col("idea_id").desc())
    recent = sent.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    return recent.groupBy("subscriber_id", "reply_id").agg(
        F.max_by("idea_id", F.struct("sent_utc", "idea_id")).alias("idea_id"))


SILENCE_DAYS = 14
SILENCE_IDEAS = 4


def silence_canary(sent: DataFrame, last_reply: DataFrame, fired: DataFrame, now: int,
                   silence_days: int = SILENCE_DAYS, silence_ideas: int = SILENCE_IDEAS) -> DataFrame:
    """E7 per subscriber. since = last reply, else first send, else now; n = ideas
    sent since then without a verdict; fires iff n >= 4, quiet >= 14 days and it
    has not already fired in this silent stretch (re-arms after another 14 days).
    ``sent(subscriber_id, idea_id, sent_utc, domain, answered)``,
    ``last_reply(subscriber_id, last_reply_utc)``, ``fired(subscriber_id, fired_utc)``.
    Top three unanswered domains by count (ties by name) are reported."""
    first = sent.groupBy("subscriber_id").agg(F.min("sent_utc").alias("first_sent"))
    last_reply = last_reply.groupBy("subscriber_id").agg(F.max("last_reply_utc").alias("last_reply_utc"))
    fired = fired.groupBy("subscriber_id").agg(F.max("fired_utc").alias("fired_utc"))
    base = (first.join(last_reply, "subscriber_id", "left").join(fired, "subscriber_id", "left")
            .withColumn("last", F.coalesce("last_reply_utc", F.lit(0)))
            .withColumn("since", F.when(F.col("last") != 0, F.col("last"))
                        .otherwise(F.coalesce("first_sent", F.lit(now)))))
    open_ = (sent.join(base.select("subscriber_id", "since"), "subscriber_id")
             .filter(~F.col("answered") & (F.col("sent_utc") >= F.col("since"))))
    n = open_.groupBy("subscriber_id").agg(F.count("*").alias("n_unanswered"))
    # ideas without a domain take their place among the three and are not shown
    per_dom = (open_.groupBy("subscriber_id", F.nullif("domain", F.lit("")).alias("domain"))
               .agg(F.count("*").alias("n")))
    w = Window.partitionBy("subscriber_id").orderBy(F.col("n").desc(), F.col("domain"))
    top = (per_dom.withColumn("r", F.row_number().over(w)).filter((F.col("r") <= 3) & F.col("domain").isNotNull())
           .groupBy("subscriber_id").agg(F.array_join(F.transform(
               F.array_sort(F.collect_list(F.struct("r", "domain", "n"))),
               lambda x: F.concat(x["domain"], F.lit(" x"), x["n"].cast("string"))), ", ").alias("breakdown")))
    quiet = (F.lit(now) - F.col("since")) / 86400.0
    fired_utc = F.coalesce(F.col("fired_utc"), F.lit(0))
    already = (fired_utc > F.col("last")) & ((F.lit(now) - fired_utc) < silence_days * 86400)
    x = base.join(n, "subscriber_id", "left").join(top, "subscriber_id", "left")
    cnt = F.coalesce(F.col("n_unanswered"), F.lit(0))
    return x.select("subscriber_id", cnt.cast("long").alias("n_unanswered"),
                    F.floor(quiet).cast("long").alias("quiet_days"),
                    ((cnt >= silence_ideas) & (quiet >= silence_days) & ~already).alias("fires"),
                    F.coalesce("breakdown", F.lit("")).alias("breakdown"))


def route_bare_verdict(messages: DataFrame, ideas: DataFrame) -> DataFrame:
    """A verdict naming no idea goes to the sent idea whose title equals the
    normalised subject (newest send wins), else to the sole idea of the newest
    batch, else nowhere. ``messages(message_id, subscriber_id, subject)``,
    ``ideas(subscriber_id, idea_id, title, sent_utc)``."""
    stripped = tx.full_trim(F.regexp_replace(F.coalesce("subject", F.lit("")), tx.SUBJECT_PREFIX_RE, ""))
    m = messages.select("message_id", "subscriber_id", stripped.alias("s"))
    usable = (F.col("s") != "") & ~F.lower("s").startswith("ideas —") & ~F.lower("s").startswith("ideas -")
    by_title = ideas.groupBy("subscriber_id", F.col("title").alias("s")).agg(
        F.max_by("idea_id", F.struct("sent_utc", "idea_id")).alias("title_idea"))
    newest = ideas.groupBy("subscriber_id").agg(F.max("sent_utc").alias("last_sent"))
    batch = (ideas.join(newest, "subscriber_id").filter(F.col("sent_utc") == F.col("last_sent"))
             .groupBy("subscriber_id").agg(F.count("*").alias("n_batch"), F.min("idea_id").alias("batch_idea")))
    j = (m.join(by_title, ["subscriber_id", "s"], "left").join(batch, "subscriber_id", "left"))
    return j.select("message_id", F.coalesce(F.when(usable, F.col("title_idea")),
                                             F.when(F.col("n_batch") == 1, F.col("batch_idea"))).alias("idea_id"))

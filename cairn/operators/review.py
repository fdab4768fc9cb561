"""Review / prep operators: review-state replay (I1-I3), due selection with weak
slots (F4), leeches (F5), weakness-weighted draw (F6), problem rotation (F7),
budget split (F8), review stats (E6), card registration / orphans (D4) and the
review -> card lookup (D10). Everything is keyed by learner, so at scale each
operator is a keyed window or aggregation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import materialize

LEECH_AT = 8


# ---- review-state replay (I1-I3) ----
# Published FSRS-4.5 default parameters (open spaced-repetition literature).
FSRS_W = [0.4872, 1.4003, 3.7145, 13.8206, 5.1618, 1.2298, 0.8975, 0.031, 1.6474,
          0.1367, 1.0461, 2.1072, 0.0793, 0.3246, 1.587, 0.2272, 2.8755]
DECAY = -0.5
FACTOR = 19 / 81
LEARNING_STEPS = [60, 600]      # seconds
RELEARNING_STEPS = [600]
NEW, LEARNING, REVIEW, RELEARNING = "New", "Learning", "Review", "Relearning"

# ---- FIXED VALUES: (retention, max_interval_days, daily_cap, problems, timed_design) per intensity mode ----
MODES = {"sharp": (0.90, 180, 3, 0, False), "ramping": (0.91, 60, 6, 1, False),
         "recruiting": (0.93, 21, 10, 3, True)}


def _interval_days(s: float, retention: float, max_ivl: int) -> int:
    ivl = s / FACTOR * (retention ** (1 / DECAY) - 1)
    return int(min(max(round(ivl), 1), max_ivl))


def replay_card(ratings: list[int], times: list[int], retention: float, max_ivl: int, w=FSRS_W,
                init: dict | None = None) -> dict:
    """Fold one card's grades (1 Again, 2 Hard, 3 Good, 4 Easy) in time order,
    optionally continuing from a previous fold's result (``init``, as returned
    here plus ``step``). Returns the final state plus reps / lapses / fails.
    Deterministic (no fuzz)."""
    def clamp_d(d):
        return min(max(d, 1.0), 10.0)

    def d0(g):
        return clamp_d(w[4] - (g - 3) * w[5])

    state, s, d, step, due, last = NEW, 0.0, 0.0, 0, None, None
    reps = lapses = fails = 0
    if init:
        state, s, d, step, due, last = (init["state"], init["stability"], init["difficulty"], init.get("step", 0),
                                        init["due_utc"], init["last_utc"])
        reps, lapses, fails = init["reps"], init["lapses"], init["fails"]
    for g, t in zip(ratings, times):
        before = state
        reps += 1
        fails += g == 1
        lapses += (g == 1) and before in (REVIEW, RELEARNING)
        if before == NEW:
            s, d = w[g - 1], d0(g)
        else:
            elapsed = max(0.0, (t - (last or t)) / 86400.0)
            r = (1 + FACTOR * elapsed / s) ** DECAY
            d = clamp_d(w[7] * w[4] + (1 - w[7]) * (d - w[6] * (g - 3)))
            if g == 1:
                s = w[11] * d ** (-w[12]) * ((s + 1) ** w[13] - 1) * math.exp(w[14] * (1 - r))
            else:
                hard = w[15] if g == 2 else 1.0
                easy = w[16] if g == 4 else 1.0
                s = s * (math.exp(w[8]) * (11 - d) * s ** (-w[9]) * (math.exp(w[10] * (1 - r)) - 1) * hard * easy + 1)
        if before in (NEW, LEARNING):
            if g == 4 or (g == 3 and step + 1 >= len(LEARNING_STEPS)):
                state, due = REVIEW, t + 86400 * _interval_days(s, retention, max_ivl)
            else:
                step = 0 if g == 1 else (step if g == 2 else step + 1)
                state, due = LEARNING, t + LEARNING_STEPS[step]
        elif before == REVIEW:
            if g == 1:
                state, step, due = RELEARNING, 0, t + RELEARNING_STEPS[0]
            else:
                due = t + 86400 * _interval_days(s, retention, max_ivl)
        else:  # relearning
            if g == 1:
                step, due = 0, t + RELEARNING_STEPS[0]
            elif g == 2:
                due = t + RELEARNING_STEPS[step]
            else:
                state, due = REVIEW, t + 86400 * _interval_days(s, retention, max_ivl)
        last = t
    return {"state": state, "stability": s, "difficulty": d, "due_utc": due, "reps": reps,
            "lapses": int(lapses), "fails": int(fails), "last_utc": last, "step": step}


REPLAY_COLUMNS = ["state", "stability", "difficulty", "due_utc", "reps", "lapses", "fails", "last_utc"]
CHUNK = 4096      # reviews of a card that are folded at once


def _bound(value: Column, body) -> Column:
    """``body`` of a variable that holds ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _interval(s: Column, retention: float, max_ivl: int) -> Column:
    days = F.rint(s / F.lit(FACTOR) * F.lit(retention ** (1 / DECAY) - 1))
    return F.least(F.greatest(days, F.lit(1.0)), F.lit(float(max_ivl))).cast("long") * 86400


def _replay_step(a: Column, x: Column, retention: float, max_ivl: int, w=FSRS_W) -> Column:
    """``replay_card`` for one grade: the state ``a`` led on by ``x(review_utc, rating)``."""
    g, t = x["rating"], x["review_utc"]
    new = a["state"] == NEW

    def clamp_d(d):
        return F.least(F.greatest(d, F.lit(1.0)), F.lit(10.0))

    elapsed = F.greatest((t - F.coalesce(a["last_utc"], t)) / F.lit(86400.0), F.lit(0.0))
    known = F.when(new, F.struct(F.lit(1.0).alias("r"), clamp_d(F.lit(w[4]) - (g - 3) * F.lit(w[5])).alias("d"))).otherwise(F.struct(
        F.pow(F.lit(1.0) + F.lit(FACTOR) * elapsed / a["stability"], F.lit(DECAY)).alias("r"),
        clamp_d(F.lit(w[7] * w[4]) + F.lit(1 - w[7]) * (a["difficulty"] - F.lit(w[6]) * (g - 3))).alias("d")))

    def grown(k):
        s, r, d = a["stability"], k["r"], k["d"]
        lapse = (F.lit(w[11]) * F.pow(d, F.lit(-w[12])) * (F.pow(s + 1, F.lit(w[13])) - 1) * F.exp(F.lit(w[14]) * (F.lit(1.0) - r)))
        easier = F.when(g == 2, F.lit(w[15])).otherwise(F.lit(1.0)) * F.when(g == 4, F.lit(w[16])).otherwise(F.lit(1.0))
        growth = F.lit(math.exp(w[8])) * (F.lit(11.0) - d) * F.pow(s, F.lit(-w[9])) * (F.exp(F.lit(w[10]) * (F.lit(1.0) - r)) - 1) * easier
        first = F.get(F.array(*[F.lit(v) for v in w[:4]]), g.cast("int") - 1)
        s2 = F.when(new, first).when(g == 1, lapse).otherwise(s * (growth + 1))
        return F.struct(s2.alias("s"), d.alias("d"))

    def moved(k):
        early = a["state"].isin(NEW, LEARNING)
        passed = F.when(early, (g == 4) | ((g == 3) & (a["step"] + 1 >= len(LEARNING_STEPS)))).when(
            a["state"] == REVIEW, g > 1).otherwise(g > 2)
        state = F.when(passed, F.lit(REVIEW)).when(early, F.lit(LEARNING)).otherwise(F.lit(RELEARNING))
        step = (F.when(passed, a["step"]).when(g == 1, F.lit(0)).when(early & (g > 2), a["step"] + 1).otherwise(a["step"]))
        wait = F.when(early, F.get(F.array(*[F.lit(v) for v in LEARNING_STEPS]), step)).otherwise(
            F.get(F.array(*[F.lit(v) for v in RELEARNING_STEPS]), step))
        due = t + F.when(passed, _interval(k["s"], retention, max_ivl)).otherwise(wait.cast("long"))
        return F.struct(
            state.alias("state"), k["s"].alias("stability"), k["d"].alias("difficulty"), step.cast("int").alias("step"),
            due.alias("due_utc"), (a["reps"] + 1).alias("reps"),
            (a["lapses"] + ((g == 1) & a["state"].isin(REVIEW, RELEARNING)).cast("long")).alias("lapses"),
            (a["fails"] + (g == 1).cast("long")).alias("fails"), t.alias("last_utc"))

    return _bound(known, lambda k: _bound(grown(k), moved))


def review_replay(log: DataFrame, mode: str = "recruiting", chunk: int = CHUNK) -> DataFrame:
    """Fold every (learner, deck, card)'s grades in (review_utc, seq) order into its review state, in expressions.
    A card's reviews are folded ``chunk`` at a time, so an array is bounded however often a card was seen; almost
    always one pass does it all."""
    retention, max_ivl = MODES[mode][0], MODES[mode][1]
    keys = ["learner_id", "deck", "card_id"]
    graded = log.filter(F.col("rating").between(1, 4)).select(*keys, "rating", F.col("review_utc").cast("long").alias("review_utc"), "seq")
    most = graded.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    start = F.struct(F.lit(NEW).alias("state"), F.lit(0.0).alias("stability"), F.lit(0.0).alias("difficulty"),
                     F.lit(0).alias("step"), F.lit(None).cast("long").alias("due_utc"), *[
                         F.lit(0).cast("long").alias(c) for c in ("reps", "lapses", "fails")],
                     F.lit(None).cast("long").alias("last_utc"))

    def folded(rows, began):
        seen = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("review_utc", "seq", "rating"))).alias("seen"))
        seen = seen.withColumn("began", start) if began is None else (
            seen.join(began, keys, "right").withColumn("seen", F.coalesce("seen", F.array().cast("array<struct<review_utc:bigint,seq:bigint,rating:int>>"))))
        return seen.select(*keys, F.aggregate("seen", F.col("began"), lambda a, x: _replay_step(a, x, retention, max_ivl)).alias("began"))

    if most <= chunk:
        states = folded(graded, None)
    else:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("review_utc", "seq"))
        parts = materialize(graded.withColumn("part", F.floor((place - 1) / chunk).cast("int")), "replay-parts")
        states = None
        for part in range(math.ceil(most / chunk)):
            states = materialize(folded(parts.filter(F.col("part") == part), states), "replay-states")
    return states.select(*keys, *[F.col(f"began.{c}").alias(c) for c in REPLAY_COLUMNS])


# ---- selection over a review-state table ----

def stable_rand(seed: str, *cols: str) -> Column:
    """Reproducible stand-in for RANDOM(): md5 of a seed and the row's key."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in cols]))


def due_cards(review: DataFrame, now: int, limit: int | Column, leech_at: int = LEECH_AT, seed: str = "cairn") -> DataFrame:
    """F4 per (learner, deck), ``limit`` being one number or a column of ``review``
    (each learner's own budget): the weakest ``max(1, limit // 3)`` due cards (fails >
    0, by fails desc, due, random), then the rest of the due cards by (due,
    last_utc NULLS FIRST, random) without repeats, up to ``limit``. Leeches
    (fails >= leech_at) are excluded. Output rows carry ``slot`` (1-based)."""
    key = ["learner_id", "deck"]
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    slots = F.greatest(F.lit(1), F.floor(limit / 3))
    rnd = stable_rand(seed, "learner_id", "deck", "card_id")
    due = review.filter((F.col("due_utc") <= now) & (F.col("fails") < leech_at)).withColumn("rnd", rnd)
    # every window is partitioned by (learner, deck) alone, so one exchange serves all
    # of them: failed cards sort first, so their row number is their weak rank
    w1 = Window.partitionBy(*key).orderBy((F.col("fails") > 0).desc(), F.col("fails").desc(), "due_utc", "rnd")
    x = due.withColumn("rn1", F.row_number().over(w1))
    x = x.withColumn("tier", F.when((F.col("fails") > 0) & (F.col("rn1") <= slots), F.lit(0)).otherwise(F.lit(1)))
    x = x.withColumn("n_weak", F.sum(1 - F.col("tier")).over(Window.partitionBy(*key)))
    w2 = Window.partitionBy(*key).orderBy("tier", "due_utc", F.col("last_utc").asc_nulls_first(), "rnd")
    x = x.withColumn("rest_rank", F.row_number().over(w2) - F.col("n_weak"))
    keep = (F.col("tier") == 0) | (F.col("rest_rank") <= limit - F.col("n_weak"))
    x = x.filter(keep).withColumn(
        "slot", F.when(F.col("tier") == 0, F.col("rn1")).otherwise(F.col("n_weak") + F.col("rest_rank")))
    return x.drop("rnd", "rn1", "rest_rank", "n_weak", "tier")


def leeches(review: DataFrame, leech_at: int = LEECH_AT) -> DataFrame:
    """cards failed so often that rescheduling is not the answer."""
    return review.filter(F.col("fails") >= leech_at)


def review_stats(review: DataFrame, now: int) -> DataFrame:
    """E6 per (learner, deck): total, due, reps, lapses, fails (NULL -> 0)."""
    return review.groupBy("learner_id", "deck").agg(
        F.count("*").alias("total"), F.count_if(F.col("due_utc") <= now).alias("due"),
        F.coalesce(F.sum("reps"), F.lit(0)).alias("reps"), F.coalesce(F.sum("lapses"), F.lit(0)).alias("lapses"),
        F.coalesce(F.sum("fails"), F.lit(0)).alias("fails"))


def weighted_draw(review: DataFrame, k: int, seed: str = "cairn", key: str | list[str] = "learner_id") -> DataFrame:
    """F6 (the intent): weighted sampling without replacement, more failures ->
    likelier first. Exponential race: sort by -ln(u) / (1 + fails) with u a
    reproducible uniform from a hash; first ``k`` per learner, or per ``key``
    (learner and deck for a draw in each deck)."""
    key = [key] if isinstance(key, str) else key
    h = F.conv(F.substring(stable_rand(seed, *dict.fromkeys([*key, "deck", "card_id"])), 1, 13), 16, 10).cast("double")
    u = (h + F.lit(1.0)) / F.lit(float(16 ** 13) + 1.0)
    race = -F.log(u) / (F.lit(1.0) + F.col("fails"))
    w = Window.partitionBy(*key).orderBy(race, "deck", "card_id")
    return review.withColumn("draw", F.row_number().over(w)).filter(F.col("draw") <= k)


def problem_rotation(picks: DataFrame, card_problems: DataFrame, problem_log: DataFrame,
                     seed: str = "cairn") -> DataFrame:
    """one problem per picked card; prefer problems never given to this learner,
    else the whole set; uniform (hash) pick. Returns the new problem_log rows."""
    cand = picks.select("learner_id", "card_id").join(card_problems, "card_id")
    given = problem_log.select("learner_id", "card_id", "problem").distinct().withColumn("given", F.lit(True))
    x = cand.join(given, ["learner_id", "card_id", "problem"], "left").withColumn(
        "fresh", F.col("given").isNull())
    key = Window.partitionBy("learner_id", "card_id")
    x = x.withColumn("any_fresh", F.max(F.col("fresh").cast("int")).over(key))
    x = x.filter((F.col("any_fresh") == 0) | F.col("fresh")).withColumn(
        "rnd", stable_rand(seed, "learner_id", "card_id", "problem"))
    w = key.orderBy("rnd", "problem")
    return x.withColumn("r", F.row_number().over(w)).filter("r = 1").select("learner_id", "card_id", "problem")


def practice_picks(review: DataFrame, card_problems: DataFrame, problem_log: DataFrame, k: int,
                   seed: str = "cairn") -> DataFrame:
    """F6 and F7 together: in each deck a learner draws among the cards that have problems, so a
    draw never comes up short while such cards are left, and gets one problem of each.
    Returns (learner_id, deck, card_id, draw, problem)."""
    able = review.join(card_problems.select("card_id").distinct(), "card_id", "left_semi")
    picks = weighted_draw(able, k, seed, ["learner_id", "deck"]).select("learner_id", "deck", "card_id", "draw")
    return picks.join(problem_rotation(picks, card_problems, problem_log, seed), ["learner_id", "card_id"]).select(
        "learner_id", "deck", "card_id", "draw", "problem")


def budget_split(learners: DataFrame, modes: DataFrame) -> DataFrame:
    """F8: per learner's mode, dsa = max(1, round_half_even(cap * 0.6)) and
    design = max(1, cap - dsa). ``modes(mode, daily_cap, ...)`` is a small
    dimension joined per learner."""
    cap = F.col("daily_cap")
    dsa = F.greatest(F.lit(1), F.bround(cap * 0.6, 0).cast("int"))
    return (learners.join(F.broadcast(modes), "mode", "left")
            .select("learner_id", "mode", cap.alias("daily_cap"), dsa.alias("dsa"),
                    F.greatest(F.lit(1), cap - dsa).alias("design")))


def register_missing(cards: DataFrame, review: DataFrame) -> DataFrame:
    """Deck cards without a review row (to be registered as new)."""
    return cards.join(review.select("deck", "card_id").distinct(), ["deck", "card_id"], "left_anti")


def orphans(review: DataFrame, cards: DataFrame) -> DataFrame:
    """Review rows whose card no longer exists in any deck."""
    return review.join(cards.select("deck", "card_id").distinct(), ["deck", "card_id"], "left_anti")

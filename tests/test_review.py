"""Review replay interval contract (I2/I3) and weighted draw."""

from cairn.operators import review as rv

DAY = 86400


def run(ratings, mode="recruiting", gap_days=None):
    ret, cap = rv.MODES[mode][0], rv.MODES[mode][1]
    t, times = 1_700_000_000, []
    st = None
    for g in ratings:
        times.append(t)
        st = rv.replay_card([g], [t], ret, cap, init=st)
        t = st["due_utc"] if gap_days is None else t + gap_days * DAY
    return st, times


def test_again_from_new_is_not_a_lapse():
    st, _ = run([1] * 5)
    assert st["fails"] == 5 and st["lapses"] == 0 and st["reps"] == 5


def test_interval_capped_by_mode():
    for mode in rv.MODES:
        st, times = run([3] * 12, mode)
        cap = rv.MODES[mode][1]
        assert st["due_utc"] - times[-1] <= (cap + 1) * DAY


def test_sharp_mode_exceeds_three_weeks():
    st, times = run([3] * 12, "sharp")
    assert st["due_utc"] - times[-1] > 21 * DAY


def test_lapse_relearns_within_a_day():
    st, times = run([3, 3, 3, 3, 1])
    assert st["lapses"] == 1 and st["due_utc"] - times[-1] < DAY


def test_higher_retention_means_shorter_total():
    lo, _ = run([3] * 8, "sharp")
    hi = rv.replay_card([3] * 8, [1_700_000_000 + i for i in range(8)], 0.97, 180)
    lo2 = rv.replay_card([3] * 8, [1_700_000_000 + i for i in range(8)], 0.90, 180)
    assert hi["due_utc"] <= lo2["due_utc"]


def test_weighted_draw_prefers_failures(spark):
    rows = [(learner, "d", f"c{i}", 6 if i == 0 else 0) for learner in range(300) for i in range(10)]
    df = spark.createDataFrame(rows, "learner_id long, deck string, card_id string, fails long")
    top = rv.weighted_draw(df, 1).filter("card_id = 'c0'").count()
    # weight 7 against nine cards of weight 1: P(first) = 7/16 ~ 131 of 300; uniform ~ 30
    assert 95 < top < 170

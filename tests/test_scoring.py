"""Evidence score (E1): independent voices, recency, source diversity."""

import math

from cairn.operators.evidence import evidence_score

NOW = 1_800_000_000
DAY = 86400


def score(spark, rows):
    df = spark.createDataFrame([("t", *r) for r in rows], "theme string, source string, author string, created_utc long")
    return evidence_score(df, NOW).first()["evidence"]


def test_flood_is_one_voice(spark):
    assert math.isclose(score(spark, [("hn", "a", NOW)] * 12), 1.0)


def test_anonymous_rows_of_a_source_are_one_voice(spark):
    assert math.isclose(score(spark, [("hn", "", NOW), ("hn", None, NOW)]), 1.0)


def test_missing_timestamp_scores_zero(spark):
    assert score(spark, [("hn", "a", 0), ("hn", "b", None)]) == 0.0


def test_stale_second_source_adds_little(spark):
    one = score(spark, [("hn", "a", NOW), ("hn", "b", NOW)])
    two = score(spark, [("hn", "a", NOW), ("hn", "b", NOW), ("gh", "c", NOW - 900 * DAY)])
    assert 1 < two / one < 1.10


def test_fresh_second_source_corroborates(spark):
    one = score(spark, [("hn", "a", NOW), ("hn", "b", NOW)])
    two = score(spark, [("hn", "a", NOW), ("gh", "b", NOW)])
    assert two / one > 1.3


def test_score_is_voices_times_diversity_of_a_table(spark):
    """Against a pandas group-by of the same rows: freshest weight per voice, summed, times
    0.5 + 0.5 * (sum of the sources' best) / (best of all)."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(3)
    for _ in range(5):
        t = pd.DataFrame({"source": rng.choice(list("pqr"), 12), "author": rng.choice(["m", "n", "", "o"], 12),
                          "created": NOW - rng.integers(0, 400, 12) * DAY})
        t["w"] = np.exp(-(NOW - t.created) / DAY / 180.0)
        voices = t.groupby(["source", "author"]).w.max()
        best = voices.groupby("source").max()
        want = voices.sum() * (0.5 + 0.5 * best.sum() / best.max())
        rows = [(s, a, int(c)) for s, a, c in zip(t.source, t.author, t.created)]
        assert math.isclose(score(spark, rows), want, rel_tol=1e-9)

"""Small documents with every awkward case, shared by the tests of this folder."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()),
                       # names that operators use themselves
                       T.StructField("kept", T.StringType()), T.StructField("slot", T.LongType()),
                       T.StructField("node", T.StringType()), T.StructField("__row", T.StringType())])


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))


def rows():
    base = words(120, 1)
    near = base.split()
    near[60] = "changed"
    long = words(30_000, 2)
    texts = [base, base, base.replace(" ", "\n"), " ".join(near), long, long + " end", "", None, " \t\n ", "one",
             "two words", "The QUICK brown fox. " * 40, "é" * 50 + " ünï çödé " + words(30, 3), words(4, 4), words(5, 5),
             "###  $$$ %%% " * 30, base + "  "]
    out = [(i, t, None, ["a", "b", None][i % 3], None, "x", 5, "y", "z") for i, t in enumerate(texts)]
    out += [out[0], out[0]]                                      # repeated rows
    out += [(None, base, "en", "a", 3, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return out


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)

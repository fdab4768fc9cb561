"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages (64 words each, the whole text). A passage is described by
numbers (character classes, word lengths, repetition inside the document, hashed words) and
encoded by a small layer; gated attention weighs the encoded passages, with weights learned from
the documents' labels alone, and a logistic layer scores the weighted mean.

Fitting takes at most ``MAX_TRAIN`` labelled documents (those with the smallest hash of the
id; of rows that share an id one, by the hash of the text) and at most ``MAX_PASSAGES`` passages of each, evenly
spread over it; their features, not their texts, come to the driver, 35 MB a thousand documents at most. Scoring is one narrow
pass over all whole texts. Labels, language, source and id are never inputs of a score.

Defined results: NULL and empty texts are one passage without words; an id with several labels
takes the larger one; NULL labels and ids don't train; without labels of both classes all scores
are the share of label 1 (0.5 without any label); repeated rows get equal scores; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, ship_package
from .rules import STOP_WORDS

PASSAGE_WORDS = 64
MAX_TRAIN = 4000
MAX_PASSAGES = 256     # of a training document: 16,000 words
THRESHOLD = 0.7
HASHED = 16
CODE, GATE = 16, 8
EPOCHS, BATCH, RATE, DECAY, SEED = 30, 128, 0.01, 1e-4, 7
N_CLASS = 9     # lower, upper, digit, symbol, sentence end, other ASCII, space, line end, non-ASCII
N_FEATURES = N_CLASS + 8 + HASHED


def _classes() -> np.ndarray:
    lut = np.full(256, 5, np.uint8)
    for group, k in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2),
                     (b"#*$%&|<>", 3), (b".,;:!?", 4), (b" \t\x0b\x0c\r", 6), (b"\n", 7)):
        lut[np.frombuffer(group, np.uint8)] = k
    lut[128:] = 8
    return lut


_LUT = _classes()


@functools.lru_cache(maxsize=1)
def _stops() -> np.ndarray:
    import xxhash
    return np.unique(np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in STOP_WORDS], np.uint64))


def passages(text: str | None) -> np.ndarray:
    """Features of a text's passages, one row each; at least one row."""
    import xxhash
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    n = len(words)
    if not n:
        return np.zeros((1, N_FEATURES), np.float32)
    count = -(-n // PASSAGE_WORDS)
    owner = np.arange(n) // PASSAGE_WORDS
    size = np.bincount(owner, minlength=count).astype(np.float64)

    cls = _LUT[np.frombuffer(raw, np.uint8)]
    space = (cls == 6) | (cls == 7)
    begin = ~space
    begin[1:] &= space[:-1]
    at = np.maximum(np.cumsum(begin) - 1, 0) // PASSAGE_WORDS
    chars = np.bincount(at * N_CLASS + cls, minlength=count * N_CLASS).reshape(count, N_CLASS)

    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    length = np.fromiter(map(len, words), np.int64, n)

    def share(flag: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=flag, minlength=count) / size

    same = np.zeros(n, bool)
    same[1:] = h[1:] == h[:-1]
    first = np.zeros(n, bool)
    first[np.unique(h + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)[1]] = True
    again = np.zeros(n, bool)
    if n >= 5:
        w = h[:-4].copy()
        for k in range(1, 5):
            w = w * np.uint64(0x100000001B3) + h[k:n - 4 + k]
        _, inverse, times = np.unique(w, return_inverse=True, return_counts=True)
        hit = times[inverse] > 1
        for k in range(5):
            again[k:n - 4 + k] |= hit
    style = np.stack([share(length) / 8, share(length > 15), share(same), share(first), share(again),
                      share(np.isin(h, _stops())), np.log1p(size) / 4, np.full(count, np.log1p(count) / 4)], axis=1)
    bag = np.bincount(owner * HASHED + (h % np.uint64(HASHED)).astype(np.int64), minlength=count * HASHED)
    parts = [chars / chars.sum(axis=1, keepdims=True), style, bag.reshape(count, HASHED) / size[:, None]]
    return np.concatenate(parts, axis=1).astype(np.float32)


def _start(rng) -> dict:
    def layer(*shape):
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    return {"E": layer(N_FEATURES, CODE), "e": np.zeros(CODE), "V": layer(CODE, GATE), "U": layer(CODE, GATE),
            "w": layer(GATE), "b": layer(CODE), "c": np.zeros(1)}


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(p: dict, x: np.ndarray, starts: np.ndarray):
    """Scores of the bags that begin at ``starts`` in the passages ``x``, and what backward needs."""
    h = np.tanh(x @ p["E"] + p["e"])
    v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    logit = (v * u) @ p["w"]
    lengths = np.diff(np.append(starts, len(x)))
    bag = np.repeat(np.arange(len(starts)), lengths)
    weight = np.exp(logit - np.maximum.reduceat(logit, starts)[bag])
    alpha = weight / np.add.reduceat(weight, starts)[bag]
    z = np.add.reduceat(alpha[:, None] * h, starts, axis=0)
    return _sigmoid(z @ p["b"] + p["c"][0]), (h, v, u, alpha, z, bag)


def backward(p: dict, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict:
    """Gradient of the mean log loss."""
    score, (h, v, u, alpha, z, bag) = forward(p, x, starts)
    g = (score - y) / len(y)
    dz = g[:, None] * p["b"]
    d_alpha = (dz[bag] * h).sum(axis=1)
    d_logit = alpha * (d_alpha - np.add.reduceat(alpha * d_alpha, starts)[bag])
    d_vu = d_logit[:, None] * p["w"]
    d_v, d_u = d_vu * u * (1 - v * v), d_vu * v * u * (1 - u)
    dh = alpha[:, None] * dz[bag] + d_v @ p["V"].T + d_u @ p["U"].T
    dx = dh * (1 - h * h)
    return {"E": x.T @ dx, "e": dx.sum(axis=0), "V": h.T @ d_v, "U": h.T @ d_u, "w": (v * u).T @ d_logit,
            "b": z.T @ g, "c": np.array([g.sum()])}


def train(bags: list, labels: np.ndarray, seed: int = SEED, epochs: int = EPOCHS) -> dict:
    """Adam over shuffled batches of bags; returns the model with its input scaling."""
    every = np.concatenate(bags).astype(np.float64)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    prior = float(labels.mean()) if len(labels) else 0.5
    if len(set(labels.tolist())) < 2:
        return {"prior": prior}
    rng = np.random.default_rng(seed)
    p = _start(rng)
    p["c"][0] = np.log(prior / (1 - prior))
    first, second, step = {k: 0 * v for k, v in p.items()}, {k: 0 * v for k, v in p.items()}, 0
    scaled = [np.clip((b - mean) / scale, -6, 6) for b in bags]
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            x = np.concatenate([scaled[i] for i in pick])
            starts = np.concatenate([[0], np.cumsum([len(scaled[i]) for i in pick])[:-1]]).astype(np.int64)
            grad, step = backward(p, x, starts, labels[pick]), step + 1
            rate = RATE * (1 - epoch / epochs) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for k in p:
                d = grad[k] + DECAY * p[k]
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                p[k] = p[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-8)
    return {**p, "mean": mean, "scale": scale, "prior": prior}


def score_bags(model: dict, bags: list) -> np.ndarray:
    if "E" not in model:
        return np.full(len(bags), model["prior"])
    x = np.clip((np.concatenate(bags) - model["mean"]) / model["scale"], -6, 6)
    starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]]).astype(np.int64)
    return forward(model, x, starts)[0]


def spread(bag: np.ndarray, most: int = MAX_PASSAGES) -> np.ndarray:
    """At most ``most`` rows of a bag, evenly spread over it."""
    return bag if len(bag) <= most else bag[np.arange(most) * len(bag) // most]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality",
        max_train: int = MAX_TRAIN) -> dict:
    """Model from ``labels(id, label)``; at most ``max_train`` ids are taken."""
    ship_package(docs.sparkSession)
    known = (labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("__id")).agg(F.max(label).cast("double").alias("__y"))
             .orderBy(F.xxhash64("__id"), "__id").limit(max_train))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(known), "__id")
    one = Window.partitionBy("__id").orderBy(F.xxhash64("__text"), "__text")
    rows = rows.withColumn("__first", F.row_number().over(one)).filter("__first = 1").drop("__first")

    def run(frames):
        import pandas as pd
        for frame in frames:
            yield pd.DataFrame({"id": frame["__id"].astype("string"), "y": frame["__y"],
                                "bag": [spread(passages(t)).tobytes() for t in frame["__text"]]})

    got = sorted((r.id, r.bag, r.y) for r in rows.mapInPandas(run, "id string, y double, bag binary").collect())
    if not got:
        return {"prior": 0.5}
    bags = [np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for _, b, _ in got]
    return train(bags, np.array([y for *_, y in got]))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, n_passages) of every document."""
    ship_package(docs.sparkSession)

    def run(frames):
        import pandas as pd
        for frame in frames:
            for at in range(0, len(frame), 512):
                part = frame.iloc[at:at + 512]
                bags = [passages(t) for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "score": score_bags(model, bags),
                                    "n_passages": [len(b) for b in bags]})

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return d.mapInPandas(run, f"doc_id {dict(d.dtypes)['doc_id']}, score double, n_passages long")


# ---- registered query (tests hold out a fold) --------------------------------------

def op1_attention_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.filter(crc_mod(F.col("doc_id"), 4) != 2))
    return score(docs, model).select(
        "doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "n_passages")

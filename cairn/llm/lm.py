"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of bigrams, unigrams and a uniform distribution;
the mixture weights depend on how often the context was seen (a bucket for each power of two) and
are learned by expectation-maximisation on held-out counts: events of a tenth of the training
documents, under counts that leave these documents out. Scoring then uses the counts of all
training documents.

Counts of a corpus don't fit a task, so no task holds them. Texts are dealt to blocks; a block sends
each distinct unigram and bigram of its text once, with its count, to the shard that owns the
hash range, and the shard answers with the corpus counts of just these, in the same order. A
block then scores its texts from its answers. A hot word is one entry per block, so no key is
hot. What travels are sorted hashes as compressed differences (about five bytes a bigram).

Defined results: NULL and empty texts are one token, the end; rows that repeat train as often as
they occur and get equal scores; a NULL id counts as the empty text when folds are drawn; without
training documents all counts are 0; an empty table gives an empty table; other columns
are ignored. Words are told apart by 64-bit hashes, bigrams by 56 bits.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, materialize, release, ship_package, total_bytes

FOLDS = 10              # fold 0 is held out; fold 1 is also the held-out part of the weights' EM
BLOCK_BYTES = 1 << 23
MAX_SHARDS = 1 << 18    # rows a block sends at most; a shard's share is a sum of hashes, never cut
SMOOTH = 0.1
BUCKETS = 42            # context counts 0, 1, 2-3, 4-7, ...
EM_ROUNDS = 10
TEST, DEV, TRAIN = 0, 1, 2
U64 = np.uint64
_GOLD, _M1, _M2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
BOUND = U64(0x5BF03635F0A1D3C7)     # stands before the first word and as the end token


def _mix(x):
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


def stream(texts) -> tuple[np.ndarray, np.ndarray]:
    """The texts' tokens as one array, BOUND first and after each text, and the number of tokens of
    each text (its words and the end)."""
    import xxhash
    parts, sizes = [np.array([BOUND])], []
    for t in texts:
        w = (t or "").encode("utf-8", "surrogatepass").lower().split()
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, w), U64, len(w)))
        parts.append(np.array([BOUND]))
        sizes.append(len(w) + 1)
    return np.concatenate(parts), np.array(sizes, np.int64)


def bigrams(tokens: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(tokens[:-1] * _GOLD + tokens[1:]) >> U64(8)


def _pack(x: np.ndarray) -> bytes:
    """Bytes of like weight side by side, compressed: leading zeros vanish."""
    import zstandard
    x = np.ascontiguousarray(x.astype("<u8"))
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    import zstandard
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 31), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=U64(0)))


def _unpack_keys(raw: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(_unpack(raw), dtype=U64)


def _cuts(keys: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """Where each shard's range begins among sorted keys."""
    edge = [(k << bits) // shards for k in range(shards)]
    return np.append(np.searchsorted(keys, np.array(edge, U64)), len(keys))


def _requests(shards: int):
    def run(key, frame):
        import pandas as pd
        block, kind = key
        tokens, _ = stream(frame["text"])
        u, un = np.unique(tokens[1:], return_counts=True)
        b, bn = np.unique(bigrams(tokens), return_counts=True)
        cu, cb = _cuts(u, 64, shards), _cuts(b, 56, shards)
        rows = []
        for s in range(shards):
            x, y = slice(cu[s], cu[s + 1]), slice(cb[s], cb[s + 1])
            if x.stop > x.start or y.stop > y.start:
                rows.append((s, block, kind, _pack_keys(u[x]), _pack(un[x]), _pack_keys(b[y]), _pack(bn[y])))
        return pd.DataFrame(rows, columns=["shard", "block", "kind", "u", "un", "b", "bn"])

    return run


def _answers(key, frame):
    """Corpus counts of every requested key, block by block, and the shard's part of N and V."""
    import pandas as pd
    out = {"block": frame["block"].to_numpy(), "shard": frame["shard"].to_numpy()}
    kind = frame["kind"].to_numpy()
    stats = {}
    for name in "ub":
        keys = [_unpack_keys(x) for x in frame[name]]
        counts = [_unpack(x).astype(np.int64) for x in frame[name + "n"]]
        ends = np.cumsum([0] + [len(k) for k in keys])
        every, where = np.unique(np.concatenate(keys), return_inverse=True)
        size = len(every)
        n = np.concatenate(counts)
        which = np.repeat(kind, np.diff(ends))
        dev = np.bincount(where, weights=np.where(which == DEV, n, 0), minlength=size).astype(np.int64)
        total = np.bincount(where, weights=np.where(which != TEST, n, 0), minlength=size).astype(np.int64)
        rest = total - dev
        out[name + "c"] = [_pack(total[where[a:b]]) for a, b in zip(ends[:-1], ends[1:])]
        out[name + "r"] = [_pack(rest[where[a:b]]) if k == DEV else None
                           for k, a, b in zip(kind, ends[:-1], ends[1:])]
        if name == "u":
            stats = {"n": int(total.sum()), "v": int((total > 0).sum()), "n_rest": int(rest.sum()),
                     "v_rest": int((rest > 0).sum())}
    return pd.DataFrame({**out, **{k: [v] + [0] * (len(frame) - 1) for k, v in stats.items()}})


ANSWER = ("block long, shard int, uc binary, ur binary, bc binary, br binary, n long, v long, n_rest long, "
          "v_rest long")


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2(count))."""
    return np.minimum(np.frexp(count.astype(np.float64))[1], BUCKETS - 1)


def _counts(texts, answer, suffix: str):
    """Per token of the texts: counts of the bigram, the context and the word; tokens per text."""
    tokens, sizes = stream(texts)
    answer = answer.sort_values("shard")
    u, ui = np.unique(tokens, return_inverse=True)
    b, bi = np.unique(bigrams(tokens), return_inverse=True)
    cu = np.concatenate([_unpack(x) for x in answer["u" + suffix]]).astype(np.int64)
    cb = np.concatenate([_unpack(x) for x in answer["b" + suffix]]).astype(np.int64)
    if len(cu) != len(u) or len(cb) != len(b):
        raise ValueError("a block's answers are not those of its texts")
    word = cu[ui]
    return cb[bi], word[:-1], word[1:], sizes


def _events(left, answer):
    """Held-out events of a block: (bucket, bigram, context and word count) and how often."""
    import pandas as pd
    cols = ["bucket", "c2", "c", "c1", "n"]
    if not len(left):
        return pd.DataFrame({k: pd.Series(dtype="int64") for k in cols})
    c2, c, c1, _ = _counts(left["text"], answer, "r")
    with np.errstate(over="ignore"):
        tag = _mix(_mix(_mix(c2.astype(U64)) + c.astype(U64)) + c1.astype(U64))
    _, at, n = np.unique(tag, return_index=True, return_counts=True)
    return pd.DataFrame({"bucket": bucket(c[at]), "c2": c2[at], "c": c[at], "c1": c1[at], "n": n})[cols]


def learn_weights(events: DataFrame, n_rest: int, v_rest: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) of each bucket by EM; each round is one
    aggregation to a row per bucket. Buckets without events, and bucket 0 for the bigram, fall
    back on the lower orders."""
    w = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    w[0] = [0.0, 0.9, 0.1]
    base = events.select("bucket", "n", F.coalesce(F.col("c2") / F.nullif(F.col("c"), F.lit(0)), F.lit(0.0)).alias("p2"),
                         (F.col("c1") / F.lit(float(max(n_rest, 1)))).alias("p1"))
    p0 = 1.0 / (v_rest + 1)
    for _ in range(rounds):
        l2, l1, l0 = (F.get(F.array(*[F.lit(float(x)) for x in w[:, k]]), F.col("bucket")) for k in range(3))
        parts = base.select("bucket", "n", (l2 * F.col("p2")).alias("a2"), (l1 * F.col("p1")).alias("a1"),
                            (l0 * F.lit(p0)).alias("a0"))
        total = F.col("a2") + F.col("a1") + F.col("a0")
        got = parts.groupBy("bucket").agg(*[F.sum(F.col("n") * F.col(k) / total).alias(k) for k in ("a2", "a1", "a0")],
                                          F.sum("n").alias("n")).collect()
        for r in got:
            w[r.bucket] = np.array([r.a2, r.a1, r.a0]) / r.n
    # a share of uniform keeps every text possible
    w = np.maximum(w, [0, 0, 1e-6])
    w[0, 0] = 0
    return w / w.sum(axis=1, keepdims=True)


def _scores(weights: np.ndarray, n: int, v: int, kind: str):
    def run(left, answer):
        import pandas as pd
        if not len(left):
            return pd.DataFrame({k: pd.Series(dtype=t) for k, t in (
                ("doc_id", "object"), ("n_tokens", "int64"), ("n_known", "int64"), ("base_score", "float64"),
                ("score", "float64"))})
        c2, c, c1, sizes = _counts(left["text"], answer, "c")
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        base = np.log10((c1 + SMOOTH) / (n + SMOOTH * (v + 1)))
        w = weights[bucket(c)]
        p = w[:, 0] * c2 / np.maximum(c, 1) + w[:, 1] * c1 / max(n, 1) + w[:, 2] / (v + 1)
        return pd.DataFrame({"doc_id": left["doc_id"].to_numpy(), "n_tokens": sizes,
                             "n_known": np.add.reduceat(c1 > 0, at, dtype=np.int64),
                             "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(np.log10(p), at)})

    return run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES,
          em_rounds: int = EM_ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.
    ``score`` is the model's log10 probability, ``base_score`` that of smoothed unigrams."""
    spark = docs.sparkSession
    ship_package(spark)
    t = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    fold = crc_mod(F.col("doc_id"), FOLDS)
    kind = F.when(fold == 0, TEST).when(fold == 1, DEV).otherwise(TRAIN)
    blocks = max(1, math.ceil(total_bytes(t, "text") / block_bytes))
    # folds of a tenth get a tenth of the blocks
    few = max(1, blocks // FOLDS)
    slot = F.pmod(F.xxhash64("doc_id", "text"), F.when(F.col("kind") == TRAIN, F.lit(blocks)).otherwise(F.lit(few)))
    t = t.withColumn("kind", kind).withColumn("block", (slot * 3 + F.col("kind")).cast("long"))
    shards = min(MAX_SHARDS, blocks)
    asked = t.groupBy("block", "kind").applyInPandas(
        _requests(shards), "shard int, block long, kind int, u binary, un binary, b binary, bn binary")
    answers = materialize(asked.groupBy("shard").applyInPandas(_answers, ANSWER), "lm-answers")
    release(spark)
    n, v, n_rest, v_rest = (int(x or 0) for x in answers.agg(*[F.sum(c) for c in ("n", "v", "n_rest", "v_rest")]).first())

    own = answers.select("block", "shard", "uc", "bc")
    rest = answers.filter("ur IS NOT NULL").select("block", "shard", "ur", "br")
    events = (t.filter(F.col("kind") == DEV).select("block", "text").groupBy("block")
              .cogroup(rest.groupBy("block")).applyInPandas(_events, "bucket int, c2 long, c long, c1 long, n long"))
    events = materialize(events.groupBy("bucket", "c2", "c", "c1").agg(F.sum("n").alias("n")), "lm-events")
    weights = learn_weights(events, n_rest, v_rest, em_rounds)
    release(spark)
    run, schema = _scores(weights, n, v, dict(t.dtypes)["doc_id"])
    scored = (t.select("block", "doc_id", "text").groupBy("block").cogroup(own.groupBy("block"))
              .applyInPandas(run, schema))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "n_tokens", "n_known",
                         F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


# ---- registered query (tests compare with a brute-force model) ---------------------

def op5_deleted_interpolation(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))

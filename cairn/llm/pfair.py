"""Mixing sources to target weights by Pfair scheduling.

The documents of a source form blocks. With m of the P slots of a period, the j-th block
of a source (from 0) is released at slot floor(j P / m) and due by ceil((j + 1) P / m);
taking, slot by slot, the released block with the earliest deadline keeps every source less
than one block away from its share of any prefix. Shares are whole slots of a period, so the
schedule repeats: one period (a parameter's size) is scheduled once, and any block's slot
follows from its number alone. DataFrame functions only.

Ranks inside a source come from counts of md5 buckets plus a rank inside a bucket, so a source
with a third of all rows is spread over all buckets.

Defined results: NULL source is a source of its own; documents are taken in order of the md5
of their id (NULL id: of the empty text), ties by the hash of the whole row; text is not looked
at, so empty and long texts are alike; repeated rows are separate documents; an empty table
gives an empty table; a source without a target weight, or with none above 0, keeps the least
share of one slot a period; all columns are carried along, ``slot`` and ``place`` are added
(a column of that name in the input is replaced). With ``until="first"`` the mix ends where the
first source runs out, which is where the target can no longer be met; with "all" every row is
returned, later slots of exhausted sources staying empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

BLOCK = 16          # documents in a block
SLOTS = 1000        # wanted slots of a period: shares are rounded to whole slots
EXPONENT = 0.7      # default target: weight = rows ** EXPONENT
BUCKET_DIGITS = 2   # hex digits of the md5 that deal a source's rows to buckets
MAX_SOURCES = 4096  # the schedule of a period is broadcast: SLOTS + MAX_SOURCES rows at most
NONE = "\u0000none"


def period(shares: Column) -> Column:
    """Source index for each slot of one period, from the sources' slot counts: earliest
    deadline first among the released blocks, ties to the lower index."""
    total = F.aggregate(shares, F.lit(0), lambda a, x: a + x)

    def run(p: Column) -> Column:
        start = F.struct(F.transform(shares, lambda _: F.lit(0)).alias("done"),
                         F.array().cast("array<int>").alias("order"))

        def step(s: Column, t: Column) -> Column:
            due = F.transform(shares, lambda m, i: F.when(
                F.floor(F.get(s["done"], i) * p / m) <= t,
                F.struct(F.ceil((F.get(s["done"], i) + 1) * p / m).alias("deadline"), i.alias("i"))))
            return let(F.array_min(due), lambda b: F.struct(
                F.transform(s["done"], lambda d, i: F.when(i == b["i"], d + 1).otherwise(d)).alias("done"),
                F.concat(s["order"], F.array(b["i"])).alias("order")))

        return F.aggregate(F.sequence(F.lit(0), p - 1), start, step, lambda s: s["order"])

    return let(total, run)


def plan(sizes: DataFrame, block: int = BLOCK, slots: int = SLOTS) -> DataFrame:
    """(source, nth, slot, share, period, stop) of one period, for ``sizes(source, n, weight)``.
    ``stop`` is the first slot that would need a block of an exhausted source."""
    every = Window.partitionBy()
    w = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))
    sized = sizes.select("source", "n", F.greatest(F.lit(1), F.round(
        w / F.greatest(F.sum(w).over(every), F.lit(1e-300)) * slots)).cast("int").alias("share"))
    if sized.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    one = sized.agg(F.sort_array(F.collect_list(F.struct("source", "share", "n"))).alias("s"))
    turns = (one.select("s", F.posexplode(period(F.transform("s", lambda x: x["share"]))).alias("slot", "i"))
             .select(F.get("s", F.col("i")).alias("x"), F.col("slot").cast("long").alias("slot"),
                     F.aggregate("s", F.lit(0), lambda a, x: a + x["share"]).cast("long").alias("period"))
             .select("x.*", "slot", "period",
                     (F.row_number().over(Window.partitionBy("x.source").orderBy("slot")) - 1).alias("nth")))
    blocks = F.ceil(F.col("n") / block)
    missing = F.when(F.col("nth") == blocks % F.col("share"),
                     F.floor(blocks / F.col("share")) * F.col("period") + F.col("slot"))
    return turns.select("source", "nth", "slot", "share", "period", F.min(missing).over(every).alias("stop"))


def mix(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source: str = "source",
        block: int = BLOCK, slots: int = SLOTS, exponent: float = EXPONENT, until: str = "all") -> DataFrame:
    """``docs`` plus ``slot`` and ``place`` (position in the slot's block): in that order, any
    prefix holds each source within one block of its share. ``weights(source, weight)`` are the
    targets; without it they are rows ** exponent."""
    if until not in ("all", "first"):
        raise ValueError(until)
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*cols).alias("__row"), F.coalesce(F.col(source).cast("string"), F.lit(NONE)).alias("__s"),
                       key.alias("__k")).withColumn("__b", F.substring("__k", 1, BUCKET_DIGITS))
    per_bucket = rows.groupBy("__s", "__b").agg(F.count("*").alias("n"))
    before = per_bucket.select("__s", "__b", (F.sum("n").over(Window.partitionBy("__s").orderBy("__b"))
                                             - F.col("n")).alias("__before"))
    sizes = per_bucket.groupBy(F.col("__s").alias("source")).agg(F.sum("n").alias("n"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow("n", F.lit(float(exponent))))
    else:
        given = weights.select(F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("source"),
                               F.col("weight").cast("double").alias("weight"))
        sizes = sizes.join(given.groupBy("source").agg(F.sum("weight").alias("weight")), "source", "left")
    turns = plan(sizes, block, slots)
    in_bucket = Window.partitionBy("__s", "__b").orderBy("__k", F.xxhash64("__row"))
    ranked = (rows.withColumn("__r", F.row_number().over(in_bucket) - 1)
              .join(before, ["__s", "__b"])
              .withColumn("__at", F.col("__before") + F.col("__r")))
    shares = turns.filter("nth = 0").select(F.col("source").alias("__s"), "share", "period")
    numbered = (ranked.join(F.broadcast(shares), "__s")
                .withColumn("__j", F.floor(F.col("__at") / block)))
    placed = (numbered.withColumn("__nth", (F.col("__j") % F.col("share")).cast("int"))
              .join(F.broadcast(turns.select(F.col("source").alias("__s"), F.col("nth").alias("__nth"),
                                             F.col("slot").alias("__t"), "stop")), ["__s", "__nth"])
              .withColumn("__slot", F.floor(F.col("__j") / F.col("share")) * F.col("period") + F.col("__t")))
    if until == "first":
        placed = placed.filter(F.col("__slot") < F.col("stop"))
    own = [F.col(f"__row.`{c}`") for c in docs.columns if c not in ("slot", "place")]
    return placed.select(*own, F.col("__slot").cast("long").alias("slot"),
                         (F.col("__at") % block).cast("int").alias("place"))


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """Every row of ``docs`` in mixing order inside range-sorted files, with its columns."""
    m = mix(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        F.col("doc_id"), F.col("source")), **kw)
    return m.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select("row.*")


def placed_documents(docs: DataFrame, *cols: str) -> DataFrame:
    """``cols`` of ``docs``, which is read from files that hold ``mixed_documents``, and ``place``: a row's place in the
    mix from 0, by the order of the files and of the rows in them. Only the files' sizes are summed up."""
    at = docs.select(*[F.col(f"`{c}`") for c in cols], F.col("_metadata.file_path").alias("__file"),
                     F.col("_metadata.row_index").alias("__row"))
    sizes = at.groupBy("__file").agg(F.count("*").alias("n"))
    before = F.broadcast(sizes.select("__file", (F.sum("n").over(Window.orderBy("__file")) - F.col("n")).alias("__before")))
    return at.join(before, "__file").select(*[F.col(f"`{c}`") for c in cols], (F.col("__before") + F.col("__row")).alias("place"))


# ---- registered query and its SQL --------------------------------------------------

def op3_pfair_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix(docs).select("doc_id", "source", "slot", "place")


OP3_SQL = f"""
WITH RECURSIVE n AS (SELECT coalesce(source, chr(0) || 'none') AS s, count(*) AS n FROM documents GROUP BY 1),
w AS (SELECT s, n, greatest(1, round(pow(n, {EXPONENT}) / sum(pow(n, {EXPONENT})) OVER () * {SLOTS}))::INT AS m FROM n),
l AS (SELECT list(s ORDER BY s) AS ss, list(m ORDER BY s) AS ms, sum(m)::INT AS p FROM w),
e AS (SELECT 0 AS t, [0 for x in ms] AS a, NULL::INT AS i, ss, ms, p FROM l
      UNION ALL
      SELECT t + 1, [a[k] + CASE WHEN k = b.i THEN 1 ELSE 0 END for k in range(1, len(ms) + 1)], b.i::INT, ss, ms, p
      FROM (SELECT *, list_min([{{'d': ceil((a[k] + 1) * p / ms[k]), 'i': k}} for k in range(1, len(ms) + 1)
                                if floor(a[k] * p / ms[k]) <= t]) AS b FROM e WHERE t < p)),
turns AS (SELECT ss[i] AS s, ms[i] AS m, p, t - 1 AS slot, row_number() OVER (PARTITION BY i ORDER BY t) - 1 AS nth
          FROM e WHERE i IS NOT NULL),
r AS (SELECT doc_id, source, coalesce(source, chr(0) || 'none') AS s, row_number() OVER (PARTITION BY source
      ORDER BY md5(coalesce(doc_id::VARCHAR, ''))) - 1 AS pos FROM documents),
j AS (SELECT r.*, pos // {BLOCK} AS j, w.m FROM r JOIN w USING (s))
SELECT doc_id, source, ((j // j.m) * p + slot)::BIGINT AS slot, (pos % {BLOCK})::INT AS place
FROM j JOIN turns ON turns.s = j.s AND turns.nth = j.j % j.m"""

"""Exact de-duplication by content-defined chunk recipes.

A normalised text (white space deleted) is cut where its own characters say so, so equal
stretches of different documents give equal chunks. Chunks move once, to prove that no two
different chunks share an identifier; from then on a document is the ordered list of its
chunk identifiers (about a twentieth of its size) and texts are equal when the lists are.
DataFrame functions only.

Defined results: NULL text counts as empty; all texts without a visible character are one
group with an empty recipe; of equal texts the one with the most code points stays, then the
smallest doc_id (a NULL doc_id comes last), then the first row of that id, so exactly one row
of a group stays also when rows repeat; an empty table gives an empty table; other columns
are ignored by :func:`duplicates` and kept by :func:`filter_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, materialize

MIN_CHUNK, MAX_CHUNK = 256, 1024
# a cut follows the first character pair of these two classes beyond MIN_CHUNK
CUT = r"[a-h0-4][i-r5-9]"
# identifiers, weakest first; the next one is taken when a clash of two contents is found
DIGESTS = (lambda c: F.unhex(F.md5(c)), lambda c: F.unhex(F.sha2(c, 256)), lambda c: F.unhex(F.sha2(c, 512)))


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def chunks(norm: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """Content-defined chunks of a text; joined they give the text again."""
    pattern = rf"(?s).{{{least - 2},{most - 2}}}?{CUT}|.{{1,{most}}}"
    return F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))


def _proven(texts: DataFrame, least: int, most: int, digests) -> int:
    """Index of the first digest that gives different chunks different identifiers."""
    pieces = texts.select(F.explode(chunks(normalised(F.col("text")), least, most)).alias("chunk"))
    for k, digest in enumerate(digests):
        seen = pieces.select(digest(F.col("chunk")).alias("id"), "chunk").distinct()
        if seen.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            return k
    raise RuntimeError("different chunks share an identifier under every digest")


def recipes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = MIN_CHUNK,
            most: int = MAX_CHUNK, digests=DIGESTS) -> DataFrame:
    """(doc_id, row, n_code_points, text_sha256, recipe): one row per row of ``docs``,
    written once to the shared folder; ``row`` tells repeated rows apart."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    digest = digests[_proven(texts, least, most, digests)]
    norm = texts.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_code_points"),
                        normalised(F.col("text")).alias("norm"))
    out = norm.select("doc_id", F.monotonically_increasing_id().alias("row"), "n_code_points",
                      F.sha2("norm", 256).alias("text_sha256"),
                      F.transform(chunks(F.col("norm"), least, most), digest).alias("recipe"))
    return materialize(out, "recipes")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """One row per row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks. A group is
    counted before it is shuffled, so one that holds a third of all rows is a few rows by then;
    the join back carries ids and identifiers only and may be split by key and side."""
    r = recipes(docs, id_col, text, **kw)
    order = F.struct(F.col("n_code_points"), -F.col("doc_id"), -F.col("row"))
    groups = r.groupBy("recipe").agg(F.max_by(F.struct("doc_id", "row"), order).alias("keep"),
                                     F.count("*").alias("group_size"))
    return (r.join(groups, "recipe")
            .select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
                    (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256",
                    F.size("recipe").cast("long").alias("n_chunks")))


def filter_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged: one row per group."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    stay = duplicates(docs, id_col, text, **kw).filter("kept").select(
        F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    rows = docs.select(F.col(id_col).alias("__doc"), F.sha2(normalised(F.col(text)), 256).alias("__text"),
                       F.length(F.coalesce(F.col(text), F.lit(""))).alias("__n"), F.struct(*cols).alias("__row"))
    found = rows.join(stay, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__sha")))
    w = Window.partitionBy("__id", "__sha").orderBy(F.col("__n").desc(), F.xxhash64("__row"))
    return (found.withColumn("__first", F.row_number().over(w)).filter("__first = 1").select("__row.*"))


# ---- registered query and its SQL --------------------------------------------------

def op7_chunk_recipes(spark, sf_dir: str) -> DataFrame:
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, ''))::BIGINT AS n,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
r AS (SELECT *, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
      row_number() OVER g AS k FROM d WINDOW g AS (PARTITION BY norm ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(norm) AS text_sha256 FROM r"""

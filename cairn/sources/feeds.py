"""Landed-feed readers and sinks.

Fetchers (HTTP paging, pacing, retries) are outside the engine: they land raw JSON
pages in folders and Spark starts at the files. Every reader has an explicit
schema (no inference) and returns rows in the common item shape:
source, external_id, url, title, text, author, created_utc, engagement, query,
plus plan-order columns (``probe_ord`` / ``tag_ord`` / ``repo_ord``, ``pos``)
that decide "first in plan order wins" downstream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

HIT = T.StructType([
    T.StructField("objectID", T.StringType()), T.StructField("story_title", T.StringType()),
    T.StructField("comment_text", T.StringType()), T.StructField("author", T.StringType()),
    T.StructField("created_at_i", T.LongType()), T.StructField("num_comments", T.LongType())])
SEARCH_PAGE = T.StructType([
    T.StructField("query", T.StringType()), T.StructField("probe_ord", T.IntegerType()),
    T.StructField("page", T.IntegerType()), T.StructField("hits", T.ArrayType(HIT)),
    T.StructField("nbPages", T.IntegerType())])

LISTING = T.StructType([
    T.StructField("tag", T.StringType()), T.StructField("tag_ord", T.IntegerType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("stories", T.ArrayType(T.StructType([
        T.StructField("short_id", T.StringType()), T.StructField("comment_count", T.LongType())])))])
COMMENT = T.StructType([
    T.StructField("short_id", T.StringType()), T.StructField("comment", T.StringType()),
    T.StructField("commenting_user", T.StringType()), T.StructField("created_at", T.StringType()),
    T.StructField("score", T.LongType()), T.StructField("url", T.StringType())])
DETAIL = T.StructType([
    T.StructField("short_id", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("comments", T.ArrayType(COMMENT))])

ISSUE = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("html_url", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("body", T.StringType()),
    T.StructField("state", T.StringType()), T.StructField("created_at", T.StringType()),
    T.StructField("user", T.StructType([T.StructField("login", T.StringType())])),
    T.StructField("reactions", T.StructType([T.StructField("total_count", T.LongType())]))])
ISSUE_PAGE = T.StructType([
    T.StructField("repo", T.StringType()), T.StructField("repo_ord", T.IntegerType()),
    T.StructField("items", T.ArrayType(ISSUE))])

CARD = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("cue", T.StringType()), T.StructField("invariant", T.StringType()),
    T.StructField("trap", T.StringType()), T.StructField("prompt", T.StringType()),
    T.StructField("must_cover", T.ArrayType(T.StringType())),
    T.StructField("problems", T.ArrayType(T.StringType()))])
DECK = T.StructType([T.StructField("deck", T.StringType()), T.StructField("note", T.StringType()),
                     T.StructField("cards", T.ArrayType(CARD))])


def _e(c):
    return F.coalesce(c, F.lit(""))


def landed_pages(spark: SparkSession, path: str, schema: T.StructType, source: str, quarantine: str | None = None,
                 multi_line: bool = False) -> DataFrame:
    """Landed JSON pages. With ``quarantine`` a page that cannot be read as ``schema`` is appended to that table
    (source, file, record) instead of vanishing; the others go on."""
    if quarantine is None:
        return spark.read.schema(schema).option("multiLine", multi_line).json(path)
    marked = T.StructType(schema.fields + [T.StructField("_corrupt", T.StringType())])
    lines = (spark.read.option("wholetext", multi_line).text(path).filter(F.trim("value") != "")
             .select("value", F.input_file_name().alias("file")))
    read = lines.select("file", "value", F.from_json("value", marked, {"mode": "PERMISSIVE",
                                                                       "columnNameOfCorruptRecord": "_corrupt"}).alias("page"))
    broken = F.col("page._corrupt").isNotNull()
    (read.filter(broken).select(F.lit(source).alias("source"), "file", F.col("value").alias("record"))
     .write.mode("append").parquet(quarantine))
    return read.filter(~broken).select("page.*").drop("_corrupt")


def quarantined(spark: SparkSession, quarantine: str) -> DataFrame:
    """(source, n_pages): how many broken pages each source has left."""
    return (spark.read.schema("source string, file string, record string").parquet(quarantine)
            .groupBy("source").agg(F.count("*").alias("n_pages")))


def search_hits(spark: SparkSession, path: str, quarantine: str | None = None) -> DataFrame:
    """A1: flatten search pages; hits without an objectID are skipped (not counted
    as dropped); missing text fields -> '', missing ints -> 0; the comment HTML is
    cleaned (B1)."""
    pages = landed_pages(spark, path, SEARCH_PAGE, "hn", quarantine)
    hits = pages.select("query", "probe_ord", "page", F.posexplode("hits").alias("pos", "h"))
    hits = hits.filter(F.col("h.objectID").isNotNull() & (F.col("h.objectID") != ""))
    oid = F.col("h.objectID")
    return hits.select(
        F.lit("hn").alias("source"), oid.alias("external_id"),
        F.concat(F.lit("https://news.ycombinator.com/item?id="), oid).alias("url"),
        _e(F.col("h.story_title")).alias("title"), tx.clean_html(_e(F.col("h.comment_text"))).alias("text"),
        _e(F.col("h.author")).alias("author"), F.coalesce("h.created_at_i", F.lit(0)).alias("created_utc"),
        F.coalesce("h.num_comments", F.lit(0)).alias("engagement"), "query", "probe_ord", "page", "pos")


def threaded_feed(spark: SparkSession, listings: str, details: str, since: int, multi_line: bool = True,
                  quarantine: str | None = None) -> DataFrame:
    """A2: listings -> stories (first tag in plan order wins; a story whose
    comment_count is explicitly 0 is skipped, a missing count is still read) ->
    detail comments. Comment url falls back to the story url; bad timestamps -> 0.
    The look-back cutoff is applied (unknown timestamps are kept; scoring ignores
    them). Details are one story per file, or one per line without ``multi_line``."""
    lst = landed_pages(spark, listings, LISTING, "lobsters", quarantine)
    st = lst.select("tag", "tag_ord", "page", F.posexplode("stories").alias("pos", "s")).filter(
        F.col("s.short_id").isNotNull())
    w = Window.partitionBy("s.short_id").orderBy("tag_ord", "page", "pos")
    first = (st.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
             .filter(~F.col("s.comment_count").eqNullSafe(F.lit(0)))
             .select(F.col("s.short_id").alias("short_id"), "tag", "tag_ord"))
    det = landed_pages(spark, details, DETAIL, "lobsters", quarantine, multi_line)
    j = first.join(det, "short_id")
    c = j.select("tag", "tag_ord", F.col("title").alias("story_title"), F.col("url").alias("story_url"),
                 F.posexplode("comments").alias("pos", "c"))
    created = F.coalesce(tx.parse_epoch(F.col("c.created_at")), F.lit(0).cast("long"))
    out = c.select(
        F.lit("lobsters").alias("source"), _e(F.col("c.short_id").cast("string")).alias("external_id"),
        F.when(_e(F.col("c.url")) != "", F.col("c.url")).otherwise(_e(F.col("story_url"))).alias("url"),
        _e(F.col("story_title")).alias("title"), tx.clean_html(_e(F.col("c.comment"))).alias("text"),
        _e(F.col("c.commenting_user")).alias("author"), created.alias("created_utc"),
        F.coalesce("c.score", F.lit(0)).alias("engagement"), F.concat(F.lit("tag:"), F.col("tag")).alias("query"),
        "tag_ord", "pos")
    return out.filter((F.col("created_utc") == 0) | (F.col("created_utc") >= since))


MIN_REACTIONS = 15
PER_REPO = 40


def issue_feed(spark: SparkSession, path: str, since: int, quarantine: str | None = None) -> DataFrame:
    """A3: open issues with >= 15 reactions created since the cutoff, most reacted
    first, at most 40 per repo; title 'repo: title'; an unparseable timestamp
    becomes the cutoff. Bodies are cleaned like every other source."""
    pages = landed_pages(spark, path, ISSUE_PAGE, "github", quarantine)
    it = pages.select("repo", "repo_ord", F.posexplode("items").alias("pos", "i"))
    created = F.coalesce(tx.parse_epoch(F.col("i.created_at")), F.lit(since).cast("long"))
    reactions = F.coalesce(F.col("i.reactions.total_count"), F.lit(0))
    x = it.select("repo", "repo_ord", "pos", F.col("i").alias("i"), created.alias("created_utc"),
                  reactions.alias("engagement"))
    x = x.filter((F.coalesce(F.col("i.state"), F.lit("open")) == "open") & (F.col("engagement") >= MIN_REACTIONS)
                 & (F.col("created_utc") >= since))
    w = Window.partitionBy("repo").orderBy(F.col("engagement").desc(), "pos", "i.id")
    x = x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= PER_REPO)
    return x.select(
        F.lit("github").alias("source"), F.col("i.id").cast("string").alias("external_id"),
        _e(F.col("i.html_url")).alias("url"), F.concat(F.col("repo"), F.lit(": "), _e(F.col("i.title"))).alias("title"),
        tx.clean_html(_e(F.col("i.body"))).alias("text"), _e(F.col("i.user.login")).alias("author"),
        "created_utc", "engagement", F.concat(F.lit("repo:"), F.col("repo")).alias("query"), "repo_ord", "pos")


def decks(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Deck files (or lines) -> one row per card (deck, card_id, ...); an absent
    folder gives an empty table."""
    from pyspark.errors import AnalysisException
    try:
        d = spark.read.schema(DECK).option("multiLine", multi_line).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T.StructType([T.StructField("deck", T.StringType())] + CARD.fields))
    return d.select("deck", F.inline("cards")).withColumnRenamed("id", "card_id")


def card_problems(deck_cards: DataFrame) -> DataFrame:
    return deck_cards.select("deck", "card_id", F.explode("problems").alias("problem"))


def idea_ledger(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True,
                glob: str = "*.json") -> DataFrame:
    """Every idea file (or line); corrupt or unreadable ones are skipped."""
    s = T.StructType(schema.fields + [T.StructField("_corrupt", T.StringType())])
    df = (spark.read.schema(s).option("multiLine", multi_line).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt").option("ignoreCorruptFiles", True)
          .option("pathGlobFilter", glob).json(path))
    return df.filter(F.col("_corrupt").isNull()).drop("_corrupt")


def write_rejects(rejects: DataFrame, path: str) -> None:
    """Append every rejected candidate (ordered verdict trail, domain, time),
    partitioned by domain."""
    rejects.write.mode("append").partitionBy("domain").parquet(path)


def write_ideas_batch(ideas: DataFrame, path: str, batch_id: str) -> str:
    """A10: one atomic directory per batch (the idea table is the ledger, so there
    is no second store to keep in step). Re-running a batch overwrites only its own
    directory, which makes the write idempotent."""
    out = f"{path.rstrip('/')}/batch_id={batch_id}"
    ideas.write.mode("overwrite").parquet(out)
    return out

"""Theme scoring: evidence (E1), plurality domain (E2), weight (E3), size filter
(E4), TF-IDF labels (E5) and stable theme keys (B8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import BROADCAST_ROW_LIMIT

# e-folding time of the recency decay, in days. (Named a "half-life" upstream,
# but exp(-age/180) halves after ~124.8 days; the formula is what is kept.)
DECAY_DAYS = 180.0
MIN_CLUSTER_SIZE = 2
ANON = "\u0000anon"


def recency(created: Column, now: int) -> Column:
    age_days = F.greatest(F.lit(0.0), (F.lit(now) - created) / F.lit(86400.0))
    return F.exp(-age_days / F.lit(DECAY_DAYS))


def evidence_score(rows: DataFrame, now: int, theme: str = "theme") -> DataFrame:
    """Recency-weighted independent voices x source-diversity credit, per theme.

    A voice is (source, author); every empty/NULL author of a source is one voice;
    a voice counts its freshest row. With per-source maxima m_s the score is
    ``voices * (0.5 + 0.5 * sum(m_s) / max(m_s))`` (one source -> ``voices``).
    Rows without a timestamp are dropped; a theme with none left scores 0.0.
    Three stacked aggregations, each with a map-side partial, so a flood from one
    voice or source collapses before it is shuffled.
    """
    dated = rows.filter(F.col("created_utc").isNotNull() & (F.col("created_utc") != 0))
    voice = F.when(F.coalesce(F.col("author"), F.lit("")) == "", F.lit(ANON)).otherwise(F.col("author"))
    per_voice = (dated.groupBy(theme, "source", voice.alias("voice"))
                 .agg(F.max(recency(F.col("created_utc"), now)).alias("w")))
    per_source = per_voice.groupBy(theme, "source").agg(F.sum("w").alias("v"), F.max("w").alias("m"))
    scored = (per_source.groupBy(theme)
              .agg((F.sum("v") * (F.lit(0.5) + F.lit(0.5) * F.sum("m") / F.max("m"))).alias("evidence")))
    themes = rows.select(theme).distinct()
    return themes.join(scored, theme, "left").select(theme, F.coalesce("evidence", F.lit(0.0)).alias("evidence"))


def plurality_domain(rows: DataFrame, theme: str = "theme") -> DataFrame:
    """Mode of the members' non-null domains; ties go to the domain whose first
    member (lowest id) comes first; no domain at all -> NULL."""
    counts = (rows.filter(F.col("domain").isNotNull())
              .groupBy(theme, "domain").agg(F.count("*").alias("n"), F.min("id").alias("first_id")))
    best = counts.groupBy(theme).agg(
        F.max_by("domain", F.struct(F.col("n"), -F.col("first_id"))).alias("domain"))
    return rows.select(theme).distinct().join(best, theme, "left")


def theme_weight(rows: DataFrame, theme: str = "theme") -> DataFrame:
    """Mean member weight; NULL or 0 counts as the neutral 1.0."""
    w = F.coalesce(F.nullif(F.col("weight"), F.lit(0.0)), F.lit(1.0))
    return rows.groupBy(theme).agg(F.avg(w).alias("weight"))


def theme_keys(members: DataFrame, theme: str = "theme", id_col: str = "id") -> DataFrame:
    """First 16 hex digits of sha1 over the comma-joined, numerically sorted
    member ids, plus the member count.

    SHA-1 is a sequential fold, so members are range-sorted per theme and the hash
    is streamed batch by batch (constant memory per theme; a large theme is never
    materialised as one array).
    """
    keyed = members.select(F.col(theme).alias("theme"), F.col(id_col).cast("long").alias("id"))
    ordered = keyed.repartition("theme").sortWithinPartitions("theme", "id")

    def fold(batches):
        import hashlib

        import pandas as pd
        cur, h, n = None, None, 0
        out_t, out_k, out_n = [], [], []
        for pdf in batches:
            if pdf.empty:
                continue
            t = pdf["theme"].to_numpy()
            ids = pdf["id"].to_numpy()
            starts = [0] + [i for i in range(1, len(t)) if t[i] != t[i - 1]] + [len(t)]
            for a, b in zip(starts[:-1], starts[1:]):
                if t[a] != cur:
                    if cur is not None:
                        out_t.append(cur), out_k.append(h.hexdigest()[:16]), out_n.append(n)
                    cur, h, n = t[a], hashlib.sha1(), 0
                    chunk = ",".join(map(str, ids[a:b].tolist()))
                else:
                    chunk = "," + ",".join(map(str, ids[a:b].tolist()))
                h.update(chunk.encode())
                n += b - a
            if len(out_t) >= 4096:
                yield pd.DataFrame({"theme": out_t, "theme_key": out_k, "size": out_n})
                out_t, out_k, out_n = [], [], []
        if cur is not None:
            out_t.append(cur), out_k.append(h.hexdigest()[:16]), out_n.append(n)
        if out_t:
            yield pd.DataFrame({"theme": out_t, "theme_key": out_k, "size": out_n})

    schema = f"theme {dict(keyed.dtypes)['theme']}, theme_key string, size long"
    return ordered.mapInPandas(fold, schema)


def build_themes(members: DataFrame, signal: DataFrame, now: int,
                 min_size: int = MIN_CLUSTER_SIZE) -> DataFrame:
    """Theme table from a membership (theme, id) and the signal corpus:
    key, size, evidence, domain, weight for every cluster of size >= min_size."""
    rows = members.select("theme", "id").join(
        signal.select("id", "source", "author", "created_utc", "domain", "weight"), "id")
    keys = theme_keys(rows.select("theme", "id")).filter(F.col("size") >= min_size)
    return (keys.join(evidence_score(rows, now), "theme")
            .join(plurality_domain(rows), "theme")
            .join(theme_weight(rows), "theme"))


def top_theme_per_domain(themes: DataFrame, members: DataFrame, used_ids: DataFrame,
                         max_reused: float = 0.5) -> DataFrame:
    """F1 (with D2): per domain the theme with the highest evidence x weight whose
    share of already-cited members is at most ``max_reused`` (inclusive, so a
    two-member theme with one cited row stays eligible). Ties -> smaller key."""
    used = used_ids.select("id").distinct().withColumn("is_used", F.lit(1))
    reused = (members.select("theme", "id").join(used, "id", "left")
              .groupBy("theme").agg(F.count("is_used").alias("n_used")))
    t = (themes.filter(F.col("domain").isNotNull()).join(reused, "theme", "left")
         .withColumn("reused", F.coalesce("n_used", F.lit(0)) / F.greatest(F.col("size"), F.lit(1)))
         .filter(F.col("reused") <= max_reused)
         .withColumn("score", F.col("evidence") * F.col("weight")))
    w = Window.partitionBy("domain").orderBy(F.col("score").desc(), F.col("theme_key"))
    return t.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "n_used")


TOKEN_RE = r"[\p{L}\p{N}_]{2,}"  # maximal runs of 2+ word characters
LABEL_TERMS = 5
MAX_FEATURES = 4000
ID_CHUNK = 4096


def tfidf_labels(member_text: DataFrame, stop_words: list[str] | None = None, theme: str = "theme",
                 max_features: int = MAX_FEATURES, top_k: int = LABEL_TERMS, id_chunk: int = ID_CHUNK) -> DataFrame:
    """E5: one document per theme (its members' texts joined by a space, in id
    order); lower-cased word tokens, stop words removed, then 1- and 2-grams (a
    bigram may span two consecutive members, as in the joined text); the corpus
    keeps the ``max_features`` most frequent terms (ties by term); score = tf x
    smooth idf ``ln((1+N)/(1+df)) + 1``; label = top ``top_k`` terms by score
    (ties by term) joined with ', '. An empty vocabulary labels every theme
    '(unlabelled)'. ``member_text(theme, id, text)``."""
    from ..functions.stopwords import spark_stop_words
    stops = list(stop_words) if stop_words is not None else list(spark_stop_words())
    toks = member_text.select(F.col(theme).alias("theme"), "id",
                              F.regexp_extract_all(F.lower("text"), F.lit(TOKEN_RE), 0).alias("raw"))
    toks = toks.select("theme", "id", F.filter("raw", lambda w: ~w.isin(stops)).alias("t"))
    n = F.size("t")
    inner = F.when(n >= 2, F.zip_with(F.slice("t", 1, n - 1), F.slice("t", 2, n - 1),
                                      lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array())
    grams = toks.select("theme", F.explode(F.concat("t", inner)).alias("term"))
    # bigrams across member boundaries: last token of a member + first token of the
    # next non-empty member of the same theme
    # Two levels so no window ever holds a whole theme: consecutive members inside
    # an id chunk, then consecutive non-empty chunks (one summary row per chunk).
    ends = toks.filter(n > 0).select("theme", "id", (F.col("id") / F.lit(id_chunk)).cast("long").alias("chunk"),
                                     F.element_at("t", -1).alias("last"), F.element_at("t", 1).alias("first"))
    w_in = Window.partitionBy("theme", "chunk").orderBy("id")
    inner_b = (ends.withColumn("nxt", F.lead("first").over(w_in)).filter(F.col("nxt").isNotNull())
               .select("theme", F.concat("last", F.lit(" "), "nxt").alias("term")))
    chunks = ends.groupBy("theme", "chunk").agg(F.min_by("first", "id").alias("c_first"),
                                                F.max_by("last", "id").alias("c_last"))
    w_ch = Window.partitionBy("theme").orderBy("chunk")
    edge_b = (chunks.withColumn("nxt", F.lead("c_first").over(w_ch)).filter(F.col("nxt").isNotNull())
              .select("theme", F.concat("c_last", F.lit(" "), "nxt").alias("term")))
    cross = inner_b.unionByName(edge_b)
    tf = grams.unionByName(cross).groupBy("theme", "term").agg(F.count("*").alias("tf"))
    vocab = (tf.groupBy("term").agg(F.sum("tf").alias("ctf"), F.count("*").alias("df"))
             .orderBy(F.col("ctf").desc(), F.col("term")).limit(max_features))
    docs = member_text.select(F.col(theme).alias("theme")).distinct()
    n_docs = docs.count()  # one scalar: the number of documents (themes)
    idf = F.log((F.lit(1.0 + n_docs)) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    few = vocab.select("term", "df")    # max_features rows at most
    scored = (tf.join(F.broadcast(few) if max_features <= BROADCAST_ROW_LIMIT else few, "term")
              .select("theme", "term", (F.col("tf") * idf).alias("score")))
    wr = Window.partitionBy("theme").orderBy(F.col("score").desc(), F.col("term"))
    top = scored.withColumn("r", F.row_number().over(wr)).filter(F.col("r") <= top_k)
    labels = top.groupBy("theme").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]),
                     ", ").alias("label"))
    return docs.join(labels, "theme", "left").select(
        "theme", F.coalesce("label", F.lit("(unlabelled)")).alias("label"))

"""Spelling variants by a variable-length gram index.

Every word is framed by marks and cut into grams of two to four characters: at each place the
shortest gram that is not frequent, or the longest one, unless an earlier gram covers it. The
dictionary of frequent grams is pruned by frequency (``FREQUENT``, and the ``DICTIONARY`` most
frequent at most, shorter ones first among equals, so that with a gram all its parts are in it: any
such dictionary gives exact results, a smaller one longer lists).

An edit at place i changes the grams that contain i, and may change one that starts right after it:
a longer gram that ends in the edit could cover it, but not one that starts later, for its own
predecessor would have covered it before. All other grams stay, in both words alike: those to the left end at
or before i, those to the right start after i + 1. So for each place a word has a bound of affected
grams, and is listed under what the others fix: the text up to the last gram on the left and from
the first on the right. Two words one edit apart meet in the list of that edit; lists of equal length
merge with themselves, those of words a character longer with those of shorter ones. Words that meet
are verified by their edit distance.

Defined results: NULL and empty texts have no words; a NULL id counts as the empty text; rows that
repeat count as often as they occur; an empty table gives an empty table; other columns are
ignored; among near words of equal count the smallest in code-point order is the form. A word may be of
any length: its keys come from running hashes, and lists hold identifiers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, ship_package

LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
SLIPS = 199
GRAM_MIN, GRAM_MAX = 2, 4
FREQUENT = 64
DICTIONARY = 200_000
START, END = "\x02", "\x03"
SAME, LONGER, SHORTER = 0, 1, 2      # a list row's role
_P = (1 << 61) - 1
_X = 1_000_003_000_017


def framed(word: str, most: int = GRAM_MAX) -> str:
    return START * (most - 1) + word + END * (most - 1)


def decompose(s: str, frequent, least: int = GRAM_MIN, most: int = GRAM_MAX) -> list[tuple[int, int]]:
    """(start, end) of the grams of a framed word; starts and ends both rise."""
    out, covered, n = [], 0, len(s)
    for p in range(n - least + 1):
        e = p + least
        while e < n and e - p < most and s[p:e] in frequent:
            e += 1
        if e > covered:
            out.append((p, e))
            covered = e
    return out


def list_keys(word: str, frequent, least: int = GRAM_MIN, most: int = GRAM_MAX) -> list[tuple[int, int]]:
    """(key, role) of the lists of a word: for each place of an edit, what the unaffected grams fix."""
    s = framed(word, most)
    n, pad = len(s), most - 1
    grams = decompose(s, frequent, least, most)
    left, right = [0] * (n + 1), [n] * (n + 3)     # last end at or before, first start at or after
    for p, e in grams:
        left[e], right[p] = e, p
    for i in range(1, n + 1):
        left[i] = left[i] or left[i - 1]
    for i in range(n, -1, -1):
        right[i] = min(right[i], right[i + 1])
    head, tail = [0] * (n + 1), [0] * (n + 1)      # running hashes of s[:i] and s[i:]
    for i, c in enumerate(s):
        head[i + 1] = (head[i] * _X + ord(c) + 1) % _P
    for i in range(n - 1, -1, -1):
        tail[i] = (tail[i + 1] * _X + ord(s[i]) + 1) % _P
    replaced = {(left[i], right[i + 2]) for i in range(pad, n - pad)}
    inserted = {(left[i], right[i + 1]) for i in range(pad, n - pad + 1)}
    out = []
    for places, size, kind, role in ((replaced, n, 0, SAME), (replaced, n, 1, LONGER), (inserted, n + 1, 1, SHORTER)):
        for a, b in places:
            # how much of the longer word both sides fix belongs to the key
            fixed = (a, n - b, size, kind)
            key = hash((head[a], tail[b], *fixed)) & 0x7FFF_FFFF_FFFF_FFFF
            out.append((key, role))
    return out


def _grams(words: DataFrame, most: int) -> DataFrame:
    """(gram, n): how often grams shorter than the longest occur in framed words."""
    def run(batches):
        import pyarrow as pa
        from collections import Counter
        for batch in batches:
            found: Counter = Counter()
            for w in batch.column("word"):
                s = framed(w.as_py(), most)
                for q in range(1, most):
                    found.update(s[i:i + q] for i in range(len(s) - q + 1))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())],
                                             ["gram", "n"])

    return words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def gram_dictionary(words: DataFrame, least: int = GRAM_MIN, most: int = GRAM_MAX, frequent: int = FREQUENT,
                    limit: int = DICTIONARY) -> frozenset:
    """The frequent grams, ``limit`` at most."""
    top = (_grams(words, most).filter((F.col("n") > frequent) & (F.length("gram") >= least))
           .orderBy(F.col("n").desc(), F.length("gram"), "gram").limit(limit))
    return frozenset(r.gram for r in top.select("gram").collect())


def near_words(words: DataFrame, least: int = GRAM_MIN, most: int = GRAM_MAX, frequent: int = FREQUENT,
               limit: int = DICTIONARY) -> DataFrame:
    """(word, n, other, other_n) of all ordered pairs of different words of ``words(word, n)``, each word
    once, that one inserted, deleted or replaced code point tells apart."""
    spark = words.sparkSession
    ship_package(spark)
    words = materialize(words.select("word", "n").withColumn("id", F.monotonically_increasing_id()), "variant-words")
    shared = spark.sparkContext.broadcast(gram_dictionary(words, least, most, frequent, limit))

    def run(batches):
        import pyarrow as pa
        known = shared.value
        for batch in batches:
            keys, roles, ids = [], [], []
            for w, i in zip(batch.column("word"), batch.column("id").to_pylist()):
                found = list_keys(w.as_py(), known, least, most)
                keys += [k for k, _ in found]
                roles += [r for _, r in found]
                ids += [i] * len(found)
                if len(keys) > 1 << 18:
                    yield _rows(pa, keys, roles, ids)
                    keys, roles, ids = [], [], []
            if keys:
                yield _rows(pa, keys, roles, ids)

    # Spark sizes the lists by the file of words, some twenty rows of theirs by one; none of these sides is broadcast
    lists = words.mapInArrow(run, "key long, role byte, id long")
    a, b = lists.alias("a"), lists.alias("b")
    meet = ((F.col("a.role") == SAME) & (F.col("b.role") == SAME) & (F.col("a.id") < F.col("b.id"))
            | (F.col("a.role") == LONGER) & (F.col("b.role") == SHORTER))
    pairs = (a.join(b.hint("merge"), (F.col("a.key") == F.col("b.key")) & meet)
             .select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).distinct())
    left = words.select(F.col("id").alias("x"), F.struct("word", "n").alias("v"))
    right = words.select(F.col("id").alias("y"), F.struct("word", "n").alias("w"))
    near = pairs.join(left.hint("merge"), "x").join(right.hint("merge"), "y").filter(F.levenshtein("v.word", "w.word", 1) == 1)
    both = F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("w").alias("b")),
                             F.struct(F.col("w").alias("a"), F.col("v").alias("b"))))
    return near.select(both.alias("p")).select("p.a.word", "p.a.n", F.col("p.b.word").alias("other"),
                                               F.col("p.b.n").alias("other_n"))


def _rows(pa, keys, roles, ids):
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(roles, pa.int8()), pa.array(ids, pa.int64())],
                                      ["key", "role", "id"])


def group_variants(words: DataFrame, ratio: int = RATIO, **grams) -> DataFrame:
    """word, form, root, n, n_near, form_n of ``words(word, n)``, each word once. The form is the near
    word of largest count if that is ``ratio`` times the word's own at least; the root is where forms
    lead. Counts rise by the ratio from form to form, so chains are short and have no rings."""
    words = materialize(words.select("word", "n"), "variant-counts")
    best = (near_words(words, **grams).groupBy("word", "n")
            .agg(F.count("*").alias("n_near"),
                 F.min_by(F.struct("other", "other_n"), F.struct(-F.col("other_n"), "other")).alias("best")))
    fits = F.col("best.other_n") >= F.col("n") * ratio
    best = materialize(best.select("word", "n_near", F.when(fits, F.col("best.other")).alias("form"),
                                   F.when(fits, F.col("best.other_n")).alias("form_n")), "variant-near")
    forms = best.filter("form IS NOT NULL").select("word", "form")
    roots = materialize(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:                                    # each round doubles the length of the way that is known
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(roots.join(onward.hint("merge"), "root", "left")
                           .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")),
                           "variant-roots")
        roots = step.select("word", "root")
        if step.filter("on").isEmpty():
            break
    return (words.join(best.hint("merge"), "word", "left").join(roots.hint("merge"), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), F.col("n").cast("long").alias("n"),
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))


def _dropped(word: Column, at: Column) -> Column:
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def counted_words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
                  min_count: int = MIN_COUNT, slips: int | None = SLIPS) -> DataFrame:
    """(word, n): runs of letters of at least ``min_chars`` code points that occur ``min_count`` times or
    more. With ``slips``, an occurrence whose crc32(`id:word`) it divides loses one code point first."""
    runs = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(f"{LETTERS}{{{min_chars},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("word"))
    if slips:
        crc = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        word = let(crc, lambda h: F.when(h % slips != 0, F.col("word"))
                   .otherwise(_dropped(F.col("word"), (h % F.length("word")).cast("int"))))
        rows = rows.select(word.alias("word")).filter(F.length("word") >= min_chars)
    return rows.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


# ---- registered query ------------------------------------------------------------------

def op13_gram_variants(spark, sf_dir: str) -> DataFrame:
    return group_variants(counted_words(spark.read.parquet(f"{sf_dir}/documents.parquet")))


# DuckDB has no crc32: its table comes from the polynomial, the bytes from the hexadecimal form
OP13_SQL = f"""
WITH RECURSIVE crc(b, c, k) AS (
  SELECT b, b, 0 FROM range(256) t(b)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM crc WHERE k = 8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS pre,
         unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents),
occ AS (SELECT pre, run, count(*) AS m FROM runs GROUP BY 1, 2),
hexed AS (SELECT run, m, hex(encode(pre || run)) AS x FROM occ),
bytes AS (
  SELECT run, m, list_transform(range(1, CAST(length(x) AS BIGINT), 2), lambda i:
    CAST(16 * (instr('0123456789ABCDEF', x[i]) - 1) + instr('0123456789ABCDEF', x[i + 1]) - 1 AS BIGINT)) AS bs
  FROM hexed),
hashed AS (
  SELECT run, m, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bs),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM bytes, tab),
slipped AS (
  SELECT CASE WHEN h % {SLIPS} <> 0 THEN run
              ELSE substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) END AS word, m
  FROM hashed),
w AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM slipped WHERE length(word) >= {MIN_CHARS} GROUP BY 1 HAVING sum(m) >= {MIN_COUNT}),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM w a JOIN w b
  ON a.word <> b.word AND length(b.word) BETWEEN length(a.word) - 1 AND length(a.word) + 1
  AND levenshtein(a.word, b.word) <= 2          -- of bytes; a letter has two at most
  AND len(list_filter(range(1, least(length(a.word), length(b.word)) + 2), lambda i:
    substr(a.word, 1, i - 1) = substr(b.word, 1, i - 1)
    AND (substr(a.word, i + 1) = substr(b.word, i + 1) AND length(a.word) = length(b.word)
         OR substr(a.word, i + 1) = substr(b.word, i) OR substr(a.word, i) = substr(b.word, i + 1)))) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS r,
                  count(*) OVER (PARTITION BY word) AS n_near FROM near),
best AS (SELECT word, n_near, CASE WHEN other_n >= {RATIO} * n THEN other END AS form,
                CASE WHEN other_n >= {RATIO} * n THEN other_n END AS form_n FROM ranked WHERE r = 1),
walk(word, cur) AS (
  SELECT word, word FROM w
  UNION ALL
  SELECT walk.word, best.form FROM walk JOIN best ON best.word = walk.cur WHERE best.form IS NOT NULL),
ends AS (SELECT word, cur AS root FROM walk WHERE cur NOT IN (SELECT word FROM best WHERE form IS NOT NULL))
SELECT w.word, best.form, ends.root, w.n, coalesce(best.n_near, 0) AS n_near, best.form_n
FROM w LEFT JOIN best USING (word) JOIN ends USING (word)"""

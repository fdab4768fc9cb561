"""Reply extraction as a table job (J1-J4): whole-token term spans, binding each
term to the vocabulary word that follows it, per-line routing (cards, then ideas,
then plain), the bare verdict, control words, and projection into log tables.

Replies are exploded into lines; everything per line is built-in regex / array
work. Only the per-message re-aggregation shuffles (by message id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# ---- FIXED VALUES: verdict and grade vocabularies (word -> canonical) ----
IDEA_VERDICTS: dict[str, str] = {
    "more": "more", "yes": "more", "good": "more", "cool": "more",
    "boring": "boring", "meh": "boring", "no": "boring", "dull": "boring",
    "exists": "exists", "done": "exists", "built": "exists",
    "too easy": "too_easy", "easy": "too_easy", "trivial": "too_easy",
    "too hard": "too_hard", "huge": "too_hard",
    "building": "building", "building this": "building", "doing this": "building",
}
GRADES: dict[str, str] = {
    "again": "again", "fail": "again", "failed": "again", "nope": "again",
    "hard": "hard", "struggled": "hard",
    "good": "good", "ok": "good", "got it": "good", "solved": "good",
    "easy": "easy", "trivial": "easy",
    "skip": "skip",
}
CONTROL = [("pause", "pause"), ("stop ideas", "pause"), ("resume", "resume"), ("unpause", "resume")]
TOKEN_CHARS = "a-z0-9-"


def longest_first(words) -> list[str]:
    return sorted(words, key=len, reverse=True)  # stable: declared order among equal lengths


def whole(words: list[str]) -> str:
    """Alternation of whole-token words (hyphen counts as a word character),
    longest first so that a longer term claims its span before a shorter one."""
    alt = "|".join(tx_escape(w) for w in longest_first(words))
    return rf"(?<![{TOKEN_CHARS}])({alt})(?![{TOKEN_CHARS}])"


def tx_escape(s: str) -> str:
    return "".join("\\" + ch if ch in set(".^$*+?()[]{}|\\") else ch for ch in s)


def bind(line: Column, terms: list[str] | Column, vocab: dict[str, str]) -> Column:
    """array<struct(term, value, pos)> -- every term in the line bound to the
    earliest vocabulary word between it and the next term (longest word wins at
    the same start); terms with no word are dropped. ``terms`` is a list or a column of
    patterns made like ``whole``; NULL has no terms."""
    none = F.array().cast("array<struct<term:string,value:string,pos:int>>")
    if not isinstance(terms, Column) and not terms:
        return none
    tpat = terms if isinstance(terms, Column) else F.lit(whole(terms))
    vpat = whole(list(vocab))
    found = F.regexp_extract_all(line, tpat, 1)
    segs = F.split(line, tpat)          # segs[i + 1] is owned by found[i]
    vmap = F.create_map(*[x for k, v in vocab.items() for x in (F.lit(k), F.lit(v))])
    pairs = F.transform(found, lambda t, i: F.struct(
        t.alias("term"),
        vmap[F.nullif(F.regexp_extract(F.element_at(segs, i + 2), vpat, 1), F.lit(""))].alias("value"),
        i.alias("pos")))
    return F.coalesce(F.filter(pairs, lambda p: p["value"].isNotNull()), none)


def handle_patterns(handles: DataFrame) -> DataFrame:
    """(subscriber_id, pattern): the whole-token alternation of each subscriber's own handles.
    ``handles(subscriber_id, reply_id)`` holds a bounded number per subscriber (D8)."""
    h = (handles.select("subscriber_id", F.lower(F.trim(F.col("reply_id").cast("string"))).alias("h"))
         .filter(F.coalesce("h", F.lit("")) != ""))
    words = F.transform(F.sort_array(F.collect_set(F.struct((-F.length("h")).alias("n"), "h"))),
                        lambda x: F.regexp_replace(x["h"], r"([.^$*+?()\[\]{}|\\])", r"\\$1"))
    return h.groupBy("subscriber_id").agg(F.concat(
        F.lit(f"(?<![{TOKEN_CHARS}])("), F.array_join(words, "|"), F.lit(f")(?![{TOKEN_CHARS}])")).alias("pattern"))


def parse_replies(replies: DataFrame, cards: list[str], ideas: list[str] | DataFrame,
                  grades: dict[str, str] = GRADES, verdicts: dict[str, str] = IDEA_VERDICTS) -> tuple[DataFrame, DataFrame]:
    """J3 over ``replies(message_id, body)``.

    Returns ``(bindings, summary)``: bindings(message_id, kind, term, value) keeps
    the first grade per card and first verdict per idea; summary(message_id,
    unparsed, bare_verdict, control, minutes, note) has one row per message.
    A line binding any card is a grade line; else a line binding any idea is a
    verdict line; else it is plain and may carry a bare verdict.

    ``ideas`` is one list of handles, or a table ``handles(subscriber_id, reply_id)``: then
    ``replies`` has a subscriber_id too and a line binds its own subscriber's handles only, so
    another one's handle is a plain word."""
    scoped = isinstance(ideas, DataFrame)
    if scoped:
        replies = replies.join(handle_patterns(ideas), "subscriber_id", "left")
    own_terms = [F.col("pattern")] if scoped else []
    text = replies.select("message_id", tx.strip_quoted(F.col("body")).alias("text"), *own_terms)
    own = tx.looks_like_own_text(F.col("text"))
    lines = (text.filter(~own & (F.col("text") != ""))
             .select("message_id", F.posexplode(F.split(F.lower("text"), "\n")).alias("ln", "line"), *own_terms)
             .withColumn("line", tx.full_trim(F.col("line"))).filter(F.col("line") != ""))
    lines = lines.withColumn("g", bind(F.col("line"), cards, grades)).withColumn(
        "v", F.when(F.size("g") == 0, bind(F.col("line"), F.col("pattern") if scoped else ideas, verdicts)))
    g = lines.select("message_id", "ln", F.explode("g").alias("b")).select(
        "message_id", F.lit("grade").alias("kind"), "ln", "b.*")
    v = lines.select("message_id", "ln", F.explode("v").alias("b")).select(
        "message_id", F.lit("verdict").alias("kind"), "ln", "b.*")
    w = Window.partitionBy("message_id", "kind", "term").orderBy("ln", "pos")
    bindings = (g.unionByName(v).withColumn("_r", F.row_number().over(w)).filter("_r = 1")
                .select("message_id", "kind", "term", "value"))
    plain = (lines.filter((F.size("g") == 0) & (F.coalesce(F.size("v"), F.lit(0)) == 0))
             .groupBy("message_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("ln", "line"))).getField("line"), "\n").alias("plain")))
    vpat_each = [(w_, verdicts[w_]) for w_ in longest_first(verdicts)]
    bare = F.lit(None).cast("string")
    for word, canon in reversed(vpat_each):
        bare = F.when(F.col("plain").rlike(whole([word])), F.lit(canon)).otherwise(bare)
    low = F.lower(F.col("text"))
    control = F.lit(None).cast("string")
    for word, action in reversed(CONTROL):
        control = F.when(low.rlike(whole([word])), F.lit(action)).otherwise(control)
    summary = (text.join(plain, "message_id", "left")
               .select("message_id", own.alias("unparsed"),
                       F.when(~own, bare).alias("bare_verdict"),
                       F.when(~own & (F.col("text") != ""), control).alias("control"),
                       F.when(~own, tx.minutes(F.col("text"))).alias("minutes"),
                       F.when(own, F.lit("(quote-stripping failed; reply not parsed)"))
                       .otherwise(F.left("text", F.lit(500))).alias("note")))
    return bindings, summary


def liveness(messages: DataFrame) -> DataFrame:
    """The last reply of each subscriber. Any reply counts, refused ones and ones that bind
    nothing too; a reply without a time counts as one at 0.
    ``messages(message_id, subscriber_id, ts)``; rows without a subscriber are left out."""
    return (messages.filter(F.col("subscriber_id").isNotNull()).groupBy("subscriber_id")
            .agg(F.max(F.coalesce("ts", F.lit(0).cast("long"))).alias("last_reply_utc"),
                 F.countDistinct("message_id").alias("n_replies")))


def apply_replies(bindings: DataFrame, summary: DataFrame, messages: DataFrame,
                  handles: DataFrame, routed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Project parsed replies into the three append logs.

    * grades (``skip`` is a no-op) -> review_log(message_id, card_id, grade)
    * verdicts naming a handle -> verdict_log via the subscriber's recent handles
      (D8); a bare verdict goes to the routed idea (D9) or is kept as ambiguous
    * control words -> control_log(subscriber_id, action, message_id)
    A refused (unparsed) reply contributes nothing but its liveness.
    ``messages(message_id, subscriber_id)``, ``handles(subscriber_id, reply_id,
    idea_id)``, ``routed(message_id, idea_id)``."""
    ok = summary.filter(~F.col("unparsed")).select("message_id")
    b = bindings.join(ok, "message_id", "left_semi")
    grades = (b.filter((F.col("kind") == "grade") & (F.col("value") != "skip"))
              .select("message_id", F.col("term").alias("card_id"), F.col("value").alias("grade")))
    named = (b.filter(F.col("kind") == "verdict").join(messages, "message_id")
             .join(handles.withColumnRenamed("reply_id", "term"), ["subscriber_id", "term"])
             .select("message_id", "idea_id", F.col("value").alias("verdict"), F.lit(False).alias("bare")))
    bare = (summary.filter(F.col("bare_verdict").isNotNull() & ~F.col("unparsed")).join(routed, "message_id", "left")
            .select("message_id", "idea_id", F.col("bare_verdict").alias("verdict"), F.lit(True).alias("bare")))
    verdicts = named.unionByName(bare).withColumn("ambiguous", F.col("idea_id").isNull())
    control = (summary.filter(F.col("control").isNotNull()).join(messages, "message_id")
               .select("subscriber_id", F.col("control").alias("action"), "message_id"))
    return grades, verdicts, control

"""Spelling variants by asymmetric q-chunks.

A word of l code points is cut into two disjoint chunks. One inserted, deleted or replaced code point leaves one of
them whole: the first at its place, or the second moved by the difference in length, which is never more than one. So
one word of a pair gives its chunks, the other the grams of that length at the places one shift allows, and whoever
shares a gram is compared. Chunks of short words are shared by very many words; the chunk that holds the change is
therefore halved again, by the same argument, and a key is a whole chunk with a whole half of the other one. That splits
every group, hot or not, before anything is compared, and no comparison is ever stored: the edit distance is part of
the join's condition, and each pair counts under its first common key only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import drop
from quayside.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = r"A-Za-zÀ-ÿ"


def occurrences(df: DataFrame, min_length: int = 5, delete_every: int | None = 97, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(word, n): how often each run of letters of at least ``min_length`` code points occurs, A-Z lower-cased.

    With ``delete_every`` misspellings are planted: where it divides h, the CRC-32 of ``<id>:<run>``, the run loses its
    code point h % length. A null id is the empty text there; null and empty texts have no words.
    """
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    found = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    lowered = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    found = found.select("id", lowered.alias("run"))
    if delete_every:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        found = found.select("run", h.alias("h"))
        at = F.expr("cast(h % length(run) AS int)")
        less = F.concat(F.substring("run", 1, at), F.substring("run", at + 2, F.length("run")))
        found = found.select(F.when(F.col("h") % delete_every == 0, less).otherwise(F.col("run")).alias("run"))
    return found.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).filter(F.length("word") >= min_length)


def keys(l: Column, d: int) -> Column:
    """The four keys of column ``word`` against words of ``l`` code points, ``d`` fewer than its own."""
    h = F.floor(l / 2).cast("int")
    a, b = F.floor(h / 2).cast("int"), h + F.floor((l - h) / 2).cast("int")
    start = lambda n: F.substring("word", F.lit(1), n)
    rest = lambda n: F.substring("word", n + 1 + d, l)
    parts = [(start(b), F.lit("")), (start(h), rest(b)), (start(a), rest(h)), (F.lit(""), rest(a))]
    return F.array(*[F.xxhash64(l, F.lit(i), x, y) for i, (x, y) in enumerate(parts)])


#: The first of the four keys that s (of l code points) and t (of l + d) share; s and t are known to be near.
FIRST_KEY = """
    CASE WHEN left(s, h + (l - h) div 2) = left(t, h + (l - h) div 2) THEN 0
         WHEN left(s, h) = left(t, h)
              AND substring(s, h + (l - h) div 2 + 1, l) = substring(t, h + (l - h) div 2 + 1 + d, l) THEN 1
         WHEN left(s, h div 2) = left(t, h div 2) AND substring(s, h + 1, l) = substring(t, h + 1 + d, l) THEN 2
         ELSE 3 END"""


def near_pairs(words: DataFrame) -> DataFrame:
    """(s, sn, t, tn): each pair of ``words`` (word, n; no word twice) that differs by exactly one code point, once."""
    l = F.length("word")
    chunks = words.select(F.col("word").alias("s"), F.col("n").alias("sn"), l.alias("l"), F.expr("length(word) div 2").alias("h"),
                          F.posexplode(keys(l, 0)).alias("i", "key"))
    grams = words.select(F.col("word").alias("t"), F.col("n").alias("tn"), F.lit(0).alias("d"), F.explode(keys(l, 0)).alias("key"))
    moved = words.select(F.col("word").alias("t"), F.col("n").alias("tn"), F.lit(1).alias("d"), F.explode(keys(l - 1, 1)).alias("key"))
    same = (F.length("t") == F.col("l") + F.col("d")) & ((F.col("d") == 1) | (F.col("s") < F.col("t")))
    met = chunks.join(grams.union(moved), "key").filter(same & (F.levenshtein("s", "t", 1) == 1))
    return met.filter(F.expr(f"i = {FIRST_KEY}")).select("s", "sn", "t", "tn")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following ``forms`` (word, form) ends. Each round doubles the steps taken.

    A form is at least twice as frequent as its word, so there are no circles and few rounds.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(now.join(on, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop(now.sparkSession, now)
        now = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return now


def variants(df: DataFrame, min_length: int = 5, min_count: int = 3, ratio: int = 2, delete_every: int | None = None,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``min_length`` code points that occurs ``min_count`` times.

    ``form`` is the most frequent near word (ties: the smallest in code-point order) if it is at least ``ratio`` times
    as frequent, else null; ``root`` is where forms lead, the word itself if it has none. A word without near words has
    n_near 0. Null and empty texts add nothing, repeated rows count again, long texts are taken whole, other columns
    are left out, an empty table gives no rows.
    """
    words = written(occurrences(df, min_length, delete_every, id_col, text_col).filter(F.col("n") >= min_count), "words")
    sides = F.array(F.struct(F.col("s").alias("word"), F.col("tn").alias("m"), F.col("t").alias("other")),
                    F.struct(F.col("t").alias("word"), F.col("sn").alias("m"), F.col("s").alias("other")))
    both = near_pairs(words).select(F.explode(sides).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    is_form = -F.col("best.m") >= ratio * F.col("n")
    rated = words.join(best, "word", "left").select(
        "word", F.when(is_form, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, -F.col("best.m")).alias("form_n"))
    rated = written(rated, "variants")
    lead = roots(rated.filter(F.col("form").isNotNull()))
    return rated.join(lead, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def groups(found: DataFrame) -> DataFrame:
    """The rows of ``variants`` with the size of their root's group and its occurrences."""
    whole = found.groupBy("root").agg(F.count("*").alias("group_words"), F.sum("n").alias("group_n"))
    return found.join(whole, "root")

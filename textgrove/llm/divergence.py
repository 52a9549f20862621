"""Quality rules with the divergence of a text from its language.

The base rules count characters, symbols, repeated lines and repeated 8-word windows. The method
compares two histograms of each text with those of its language, taken over all documents: shares of
character classes, and shares of the language's most common words. The Jensen-Shannon distance (base 2,
0 to 1) must stay below a limit for both. Texts shorter than a guard are not judged by distance.

Everything is DataFrame functions on arrays within a row; only word counts per language are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textgrove.llm.common import plain_text
from textgrove.workspace import Workspace, broadcast_if_bounded

SPACE = "[ \\t-\\r]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
GUARD_WORDS = 50
COMMON = 16
MAX_CLASS_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.45
CODES = "abcdefghijklmnopqrstuvwxyz"
OTHER_WORD = "_"
# The character classes, besides white space and all the rest (small letters mostly).
CLASSES = {"upper": "\\p{Lu}", "digits": "0-9", "marks": ".,;:!?'\"()\\-", "symbols": "#*$%&|<>"}
POOLED = "\x00all"  # the reference of documents without a language


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def count_inside(text: Column, inside: str) -> Column:
    """Code points of ``text`` in a character class."""
    return F.length(F.regexp_replace(text, f"[^{inside}]+", "")).cast("long")


def with_repeated_words(rows: DataFrame) -> DataFrame:
    """``rows`` with n_repeat_words: words covered by windows whose hash occurs twice or more.

    ``hashes`` has one hash per half window, in order, or is null. Whole windows are looked at only where
    half windows repeat. Each step is a column of its own, so that it is computed once.
    """
    again = F.size(F.array_distinct("hashes")) < F.size("hashes")
    rows = _doubled(rows.withColumn("hashes", F.when(again, F.col("hashes"))), WINDOW // 2)
    pairs = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn(
        "pairs", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), pairs)
    )
    n = F.size("pairs")
    twins = F.zip_with(
        F.slice("pairs", F.lit(1), n - 1),
        F.slice("pairs", F.lit(2), n - 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    rows = rows.withColumn("starts", F.sort_array(F.array_distinct(F.flatten(twins))))
    following = F.concat(
        F.slice("starts", F.lit(2), F.size("starts")), F.array(F.element_at("starts", -1) + WINDOW)
    )
    gaps = F.zip_with("starts", following, lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(0), lambda total, g: total + g)
    repeated = F.when(F.col("starts").isNotNull(), covered).otherwise(0).cast("long")
    return rows.withColumn("n_repeat_words", repeated).drop("hashes", "pairs", "starts")


def with_counts(rows: DataFrame) -> DataFrame:
    """``rows`` (with text and words) with the base counts and ``classes``; text is dropped."""
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^ \\t-\\r]"))
    for name, inside in CLASSES.items():
        rows = rows.withColumn(name, count_inside(text, inside))
    rows = rows.select(
        *rows.columns,
        F.length(text).cast("long").alias("chars"),
        lines.alias("lines"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.col("symbols").alias("n_symbols"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    rows = rows.withColumn(
        "n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")
    )
    rows = with_repeated_words(_doubled(_doubled(rows, 1), 2))
    blanks = F.col("chars") - F.col("word_chars")
    rest = F.col("word_chars") - sum((F.col(c) for c in CLASSES), F.lit(0))
    return rows.withColumn("classes", F.array(*CLASSES, blanks, rest)).drop(
        "text", "words", "lines", "chars", *CLASSES
    )


def _doubled(rows: DataFrame, step: int) -> DataFrame:
    """``hashes`` of ``step`` consecutive words each become those of twice as many, or null."""
    n = F.size("hashes") - step
    joined = F.zip_with(
        F.slice("hashes", F.lit(1), n),
        F.slice("hashes", F.lit(1 + step), n),
        lambda a, b: F.xxhash64(a, b),
    )
    return rows.withColumn("hashes", F.when(n > 0, joined))


def common_words(rows: DataFrame, work: Workspace) -> DataFrame:
    """``ref, commons, word_shares`` for each language and for all documents together.

    ``commons`` are the ``COMMON`` most frequent words, ``word_shares`` their shares and that of all
    other words.
    """
    words = rows.select("lang", F.explode("words").alias("word"))
    counted = work.write(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "word_counts")
    pooled = counted.groupBy("word").agg(F.sum("n").alias("n"))
    counted = counted.filter("lang IS NOT NULL").select(F.col("lang").alias("ref"), "word", "n")
    counted = counted.unionByName(pooled.select(F.lit(POOLED).alias("ref"), "word", "n"))
    totals = counted.groupBy("ref").agg(F.sum("n").alias("total"))
    order = Window.partitionBy("ref").orderBy(F.desc("n"), "word")
    top = counted.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= COMMON)
    top = top.groupBy("ref").agg(F.array_sort(F.collect_list(F.struct("at", "word", "n"))).alias("top"))
    shares = F.transform("top", lambda t: t["n"] / F.col("total"))
    rest = 1 - F.aggregate(shares, F.lit(0.0), lambda a, b: a + b)
    by_word = top.join(totals, "ref").select(
        "ref",
        F.transform("top", lambda t: t["word"]).alias("commons"),
        F.concat(shares, F.array(rest)).alias("word_shares"),
    )
    return work.write(by_word, "common_words")


def class_references(counted: DataFrame, work: Workspace) -> DataFrame:
    """``ref, class_shares`` for each language and for all documents together."""
    n = len(CLASSES) + 2
    sums = [F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(n)]
    chars = work.write(counted.groupBy("lang").agg(*sums), "class_counts")
    pooled = chars.agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(n)]).withColumn("ref", F.lit(POOLED))
    chars = chars.filter("lang IS NOT NULL").withColumnRenamed("lang", "ref").unionByName(pooled)
    return chars.select("ref", shares_of(F.array(*[f"c{i}" for i in range(n)])).alias("class_shares"))


def shares_of(counts: Column) -> Column:
    """Counts over their sum; null if that is 0."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b)
    return F.when(total > 0, F.transform(counts, lambda c: c / total))


def _entropy_term(p: Column, m: Column) -> Column:
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance of two arrays of shares."""
    terms = F.zip_with(
        p, q, lambda a, b: (_entropy_term(a, (a + b) / 2) + _entropy_term(b, (a + b) / 2)) / 2
    )
    total = F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def rate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    guard_words: int = GUARD_WORDS,
) -> DataFrame:
    """``doc_id``, the base counts, ``class_distance, word_distance, base_failed, kept``, a row per row.

    ``base_failed`` if there are fewer than 20 words or over 30 % repeat. ``kept`` is false then, and
    if a text of at least ``guard_words`` words is further from its language than a limit. Distances
    of shorter texts are given but not judged. A document without a language is compared with all
    documents together. Null and empty texts have no words and distance 0. Repeated rows
    stay; an empty table gives no rows.
    """
    work = Workspace(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        plain_text(text_col).alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
    )
    rows = rows.withColumn("words", word_array(F.col("text"))).withColumn(
        "ref", F.coalesce("lang", F.lit(POOLED))
    )
    common = common_words(rows, work)
    languages = common.count()
    known = broadcast_if_bounded(common, 2 * COMMON * languages)
    coded = F.transform(
        "words",
        lambda w: F.substring(
            F.lit(OTHER_WORD + CODES), F.array_position("commons", w).cast("int") + 1, F.lit(1)
        ),
    )
    coded = rows.join(known, "ref", "left").withColumn("coded", F.array_join(coded, ""))
    length = F.length("coded")
    bins = [
        (length - F.length(F.replace("coded", F.lit(c), F.lit("")))).cast("long")
        for c in CODES[:COMMON] + OTHER_WORD
    ]
    # a language with fewer common words has fewer bins; the last bin is that of other words
    bins = F.concat(F.slice(F.array(*bins[:-1]), F.lit(1), F.size("commons")), F.array(bins[-1]))
    coded = coded.withColumn("word_bins", bins).drop("coded", "commons")
    counted = work.write(with_counts(coded), "counted")
    by_class = work.write(class_references(counted, work), "class_references")
    joined = counted.join(broadcast_if_bounded(by_class, 2 * COMMON * languages), "ref", "left")
    judged = joined.select(
        "*",
        jensen_shannon(shares_of(F.col("classes")), F.col("class_shares")).alias("by_class"),
        jensen_shannon(shares_of(F.col("word_bins")), F.col("word_shares")).alias("by_word"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    far = (F.col("n_words") >= guard_words) & (
        (F.coalesce("by_class", F.lit(0.0)) > max_class_distance)
        | (F.coalesce("by_word", F.lit(0.0)) > max_word_distance)
    )
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        F.coalesce("by_class", F.lit(0.0)).alias("class_distance"),
        F.coalesce("by_word", F.lit(0.0)).alias("word_distance"),
        failed.alias("base_failed"),
        (~failed & ~far).alias("kept"),
    )

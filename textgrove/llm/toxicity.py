"""Toxicity by class-conditional Kneser-Ney models of letters.

Words with their borders are cut into letter n-grams. Each class (toxic, ordinary) has its own counts
of the highest order, over all labelled training documents. They are discounted, and the mass this
frees, plus ``SHARED`` pseudo-occurrences of each context, goes to a backoff both classes share: a
Kneser-Ney model over the counts of both, with continuation counts below the highest order. A rare
expression thus gets nearly the same probability from either class. An expression is scored by
the difference of its two log-likelihoods; a document by that difference per word, and by how
many of its expressions, in all and per word, the toxic class makes much likelier.

Counting and smoothing are joins over n-gram tables. All grams score. A table of at most ``MAX_GRAMS``
is sent to the tasks that score. A larger one is joined to the grams of the corpus's distinct words,
and the scores of the words to the documents; both ways give the same features. Of a gram that
neither class has, the shared backoff cancels and what is left is how much mass its context leaves
for the new in either class; a context that neither has tells nothing. The last step, a logistic calibration of the nine numbers in ``FEATURES``, is fitted on at most
``CALIBRATION`` training rows, which gave no counts.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections import Counter

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType

from textgrove.llm.common import crc_mod, fields, map_texts, plain_text, sampled, with_labels
from textgrove.llm.logistic import fit_logistic
from textgrove.workspace import Workspace

ORDER = 6
DISCOUNT = 0.75
SHARED = 20.0
MAX_GRAMS = 1_000_000  # about 170 MB in a task
CALIBRATION = 20_000
TOP = 3
LEVELS = (2.0, 3.5)  # log-likelihood differences from which an expression counts as strong
CLIP = 8.0
FEATURES = (
    "mean difference", "largest", "mean of the largest", "largest per letter", "strong per word",
    "strong 1", "strong 2", "strong rate 1", "strong rate 2",
)
BORDER = "_"
WORD = "[\\p{L}\\p{M}]+"  # counting and scoring cut texts by the same pattern
SCORED_WORDS = regex.compile(WORD).findall
MEMO = 100_000


def _cut(word: str = "word") -> Column:
    """The n-grams of a column of words, an array."""
    padded = F.concat(F.lit(BORDER * (ORDER - 1)), word, F.lit(BORDER))
    starts = F.sequence(F.lit(1), F.length(word) + 1)
    return F.transform(starts, lambda i: F.substring(padded, i, F.lit(ORDER)))


def gram_counts(texts: DataFrame) -> DataFrame:
    """``gram, toxic, ordinary``: occurrences of each n-gram over ``texts(text, label)``."""
    words = texts.select("label", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("word"))
    words = words.groupBy("word").agg(
        F.sum(F.when(F.col("label") > 0, 1).otherwise(0)).alias("toxic"),
        F.sum(F.when(F.col("label") > 0, 0).otherwise(1)).alias("ordinary"),
    )
    grams = words.select(F.explode(_cut()).alias("gram"), "toxic", "ordinary")
    return grams.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _smoothed(grams: DataFrame, order: int, lower: DataFrame | None, letters: int) -> DataFrame:
    """``gram, p`` from ``grams(gram, n)`` of ``order`` letters and the probabilities below."""
    head = F.substring("gram", 1, order - 1)
    context = grams.groupBy(head.alias("head")).agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")
    )
    rows = grams.withColumn("head", head).join(context, "head")
    if lower is None:
        rows = rows.withColumn("below", F.lit(1.0 / (letters + 1)))
    else:
        tail = F.substring("gram", 2, order)
        below = lower.select(F.col("gram").alias("tail"), F.col("p").alias("below"))
        rows = rows.withColumn("tail", tail).join(below, "tail")
    kept = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0))
    p = (kept + DISCOUNT * F.col("kinds") * F.col("below")) / F.col("total")
    return rows.select("gram", p.alias("p"))


def gram_scores(counts: DataFrame, work: Workspace) -> DataFrame:
    """``gram, score``: log of its toxic minus its ordinary probability after its context.

    Rows of ``ORDER - 1`` letters are contexts; their score is that of every gram not listed.
    """
    levels = {ORDER - 1: counts.groupBy(F.substring("gram", 2, ORDER).alias("gram")).agg(F.count(F.lit(1)).alias("n"))}
    levels[ORDER - 1] = work.write(levels[ORDER - 1], f"grams_{ORDER - 1}")
    for k in range(ORDER - 2, 0, -1):
        above = levels[k + 1].groupBy(F.substring("gram", 2, k + 1).alias("gram"))
        levels[k] = work.write(above.agg(F.count(F.lit(1)).alias("n")), f"grams_{k}")
    letters = levels[1].count()
    p = None
    for k in range(1, ORDER):
        p = _smoothed(levels[k], k, p, letters)
    both = counts.select("gram", (F.col("toxic") + F.col("ordinary")).alias("n"))
    shared = work.write(_smoothed(both, ORDER, p, letters), "shared")
    head = F.substring("gram", 1, ORDER - 1)
    context = counts.groupBy(head.alias("head")).agg(
        *[F.sum(c).alias(f"{c}_total") for c in ("toxic", "ordinary")],
        *[F.sum((F.col(c) > 0).cast("int")).alias(f"{c}_kinds") for c in ("toxic", "ordinary")],
    )
    rows = counts.withColumn("head", head).join(context, "head").join(shared, "gram")

    def log_p(c):
        kept = F.greatest(F.col(c) - DISCOUNT, F.lit(0.0))
        freed = DISCOUNT * F.col(f"{c}_kinds") + SHARED
        return F.log((kept + freed * F.col("p")) / (F.col(f"{c}_total") + SHARED))

    def log_new(c):
        return F.log((DISCOUNT * F.col(f"{c}_kinds") + SHARED) / (F.col(f"{c}_total") + SHARED))

    seen = rows.select("gram", (log_p("toxic") - log_p("ordinary")).alias("score"))
    new = context.select(F.col("head").alias("gram"), (log_new("toxic") - log_new("ordinary")).alias("score"))
    return seen.unionByName(new)


class Expressions:
    """Scores expressions and documents with a table of gram scores."""

    def __init__(self, scores: dict[str, float]):
        self.scores, self.memo = scores, {}

    def word(self, word: str) -> float:
        """Log-likelihood of the toxic class minus that of the ordinary class."""
        padded, get = BORDER * (ORDER - 1) + word + BORDER, self.scores.get
        total = 0.0
        for i in range(len(word) + 1):
            score = get(padded[i : i + ORDER])
            total += get(padded[i : i + ORDER - 1], 0.0) if score is None else score
        return total

    def document(self, text: str) -> list[float]:
        """What ``FEATURES`` names, all 0 without words."""
        words, memo = SCORED_WORDS(text.lower()), self.memo
        if len(memo) > MEMO:
            memo.clear()
        values = []
        for word in words:
            value = memo.get(word)
            if value is None:
                value = memo[word] = self.word(word)
            values.append(value)
        n = len(values)
        if not n:
            return [0.0] * len(FEATURES)
        largest = heapq.nlargest(TOP, zip(values, words))
        strong = [sum(v > level for v in values) for level in LEVELS]
        return [
            sum(values) / n,
            largest[0][0],
            sum(v for v, _ in largest) / TOP,
            max(v / (len(w) + 1) for v, w in largest),
            sum(min(v, CLIP) for v in values if v > LEVELS[0]) / n,
            *[math.log1p(k) for k in strong],
            *[math.log((k + 0.1) / (n + 10)) for k in strong],
        ]


def document_features(rows: DataFrame, scores: DataFrame, work: Workspace, max_grams: int) -> DataFrame:
    """``rows`` with the ``FEATURES`` of each document as ``features`` instead of ``text``.

    ``scores(gram, score)`` is a stored table; above ``max_grams`` rows it is joined, not sent.
    """
    if scores.count() > max_grams:
        return _joined_features(rows, scores, work)
    table = scores.toArrow()
    table = dict(zip(table["gram"].to_pylist(), table["score"].to_pylist()))
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def setup():
        model = Expressions(shared.value)
        return lambda texts: [[model.document(t) for t in texts]]

    return map_texts(rows, fields(features=ArrayType(DoubleType(), False)), setup)


def _joined_features(rows: DataFrame, scores: DataFrame, work: Workspace) -> DataFrame:
    """The same by joins: a word is scored once, however many documents have it.

    Frequent words are many rows of one key in the last join only, which reads stored tables, so
    that Spark can split it; what is gathered per document is its own distinct words.
    """
    counted = ArrayType(StructType().add("word", StringType()).add("n", LongType()), False)

    def setup():
        def make(texts):
            found = (Counter(SCORED_WORDS(t.lower())) for t in texts)
            return [[[{"word": w, "n": n} for w, n in words.items()] for words in found]]

        return make

    kept = [c for c in rows.columns if c != "text"]
    held = map_texts(rows.withColumn("at", F.monotonically_increasing_id()), fields(counted=counted), setup)
    held = work.write(held, f"held_{uuid.uuid4().hex[:8]}")
    uses = held.select("at", F.explode("counted").alias("use")).select("at", "use.word", "use.n")
    grams = uses.select("word").distinct().select("word", F.explode(_cut()).alias("gram"))
    contexts = scores.filter(F.length("gram") < ORDER).select(F.col("gram").alias("head"), F.col("score").alias("new"))
    grams = grams.join(scores, "gram", "left").withColumn("head", F.substring("gram", 1, ORDER - 1))
    grams = grams.join(contexts, "head", "left").select("word", F.coalesce("score", "new", F.lit(0.0)).alias("score"))
    values = grams.groupBy("word").agg(F.sum("score").alias("value"))
    values = work.write(values, f"word_values_{uuid.uuid4().hex[:8]}")
    value, n = F.coalesce("value", F.lit(0.0)), F.col("n")
    uses = uses.join(values, "word", "left").select("at", "word", "n", value.alias("value"))
    above = [F.sum(F.when(F.col("value") > level, n).otherwise(0)) for level in LEVELS]
    clipped = F.when(F.col("value") > LEVELS[0], n * F.least("value", F.lit(CLIP))).otherwise(0.0)
    entry = F.struct("value", "word", F.least(n, F.lit(TOP)).cast("int").alias("n"))
    sums = uses.groupBy("at").agg(
        F.sum(n * F.col("value")).alias("total"),
        F.sum("n").alias("n"),
        F.sum(clipped).alias("clipped"),
        F.slice(F.sort_array(F.collect_list(entry), asc=False), 1, TOP).alias("top"),
        *[x.alias(f"above_{i}") for i, x in enumerate(above)],
    )
    repeated = F.flatten(F.transform("top", lambda t: F.array_repeat(t, t["n"])))
    sums = sums.withColumn("top", F.slice(repeated, 1, TOP))
    n = F.col("n")
    strong = [F.col(f"above_{i}") for i in range(len(LEVELS))]
    features = F.array(
        F.col("total") / n,
        F.col("top")[0]["value"],
        F.aggregate("top", F.lit(0.0), lambda a, t: a + t["value"]) / TOP,
        F.array_max(F.transform("top", lambda t: t["value"] / (F.length(t["word"]) + 1))),
        F.col("clipped") / n,
        *[F.log1p(k.cast("double")) for k in strong],
        *[F.log((k + 0.1) / (n + 10)) for k in strong],
    )
    none = F.array(*[F.lit(0.0)] * len(FEATURES))
    sums = sums.select("at", features.alias("features"))
    return held.join(sums, "at", "left").select(*kept, F.coalesce("features", none).alias("features"))


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    fold: tuple[int, int] = (5, 0),
    threshold: float = 0.5,
    max_grams: int = MAX_GRAMS,
) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per row of ``docs``.

    ``labels`` has doc_id and toxic. Rows whose crc32(id) modulo ``fold[0]`` is ``fold[1]`` teach nothing; of
    the others the next remainder calibrates and the rest is counted. Scores depend on the text alone.
    Null, empty and wordless texts score like one whose expressions tell nothing. Repeated rows stay. Without
    usable labels every score is 0; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), plain_text(text_col).alias("text"))
    found = _judged(rows, labels, fold, threshold, max_grams)
    return found.select("doc_id", (F.col("part") == fold[1]).alias("held_out"), "score", "predicted")


def _judged(rows: DataFrame, labels: DataFrame, fold: tuple[int, int], threshold: float, max_grams: int) -> DataFrame:
    """``rows(doc_id, text, …)`` with part, score and predicted instead of the text."""
    parts, held_out = fold
    work = Workspace(rows.sparkSession)
    rows = rows.withColumn("part", crc_mod("doc_id", parts))
    known = with_labels(rows.select("doc_id", "text", "part"), labels, "toxic").filter(F.col("part") != held_out)
    calibrating = (held_out + 1) % parts
    counts = work.write(gram_counts(known.filter(F.col("part") != calibrating)), "counts")
    scores = work.write(gram_scores(counts, work), "scores")
    chosen = known.filter(F.col("part") == calibrating).select("text", "label")
    chosen = work.write(document_features(chosen, scores, work, max_grams), "calibrating")
    weights = _calibrate(sampled(chosen, [F.xxhash64("features")], CALIBRATION).toArrow())
    found = document_features(rows, scores, work, max_grams)
    if weights is None:
        score = F.lit(0.0)
    else:
        linear = F.lit(float(weights[0]))
        for i, w in enumerate(weights[1:]):
            linear = linear + F.lit(float(w)) * F.col("features")[i]
        score = 1 / (1 + F.exp(-linear))
    found = found.withColumn("score", score).drop("features")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _calibrate(chosen) -> np.ndarray | None:
    y = np.array(chosen["label"].to_pylist(), float) > 0
    if not len(y) or y.all() or not y.any():
        return None
    x = np.array(chosen["features"].to_pylist(), float)
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    scaled = np.column_stack([np.ones(len(x)), (x - centre) / scale])
    fitted = fit_logistic(scaled, y.astype(float), ridge=0.3)
    slopes = fitted[1:] / scale
    return np.concatenate([[fitted[0] - slopes @ centre], slopes])


def drop_toxic(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    fold: tuple[int, int] = (5, 0),
    threshold: float = 0.5,
    max_grams: int = MAX_GRAMS,
) -> DataFrame:
    """``docs`` without the rows judged toxic, columns as they were.

    Each row is judged by its own text (see ``toxicity``): of rows with one id only the toxic ones go. Rows
    without an id are judged like any other; repeated rows stay or go together; null and empty texts stay
    unless such a text is judged toxic; an empty table stays empty.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), plain_text(text_col).alias("text"))
    return _judged(rows, labels, fold, threshold, max_grams).filter("predicted = 0").select("row.*")

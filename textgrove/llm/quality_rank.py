"""Quality by Bradley-Terry ranking.

A document's strength is a weighted sum of features of its whole text. For a pair of a good and a poor
document, the chance that the good one is preferred is the logistic function of the difference
of their strengths; the weights minimise the logistic loss over preference pairs. The pairs are
made of at most ``SAMPLE`` labelled training documents, ``PARTNERS`` for each document.

The strengths of all training documents then give the threshold: the quantile at the share of poor
documents among them. Scores are logistic in the distance from it, with ``threshold`` at it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from textgrove.llm.common import crc_mod, fields, map_texts, plain_text, with_labels
from textgrove.llm.logistic import fit_logistic
from textgrove.workspace import Workspace

SAMPLE = 20_000
PARTNERS = 20
NAMES = (
    "letters", "capitals", "digits", "blanks", "marks", "symbols", "beyond", "lines",
    "word_length", "distinct", "repeats", "bare", "length",
)
# Classes of ASCII bytes.
CLASS = np.zeros(256, np.int64)
for _class, _bytes in enumerate(
    (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b".,;:!?'\"()-"), 1
):
    CLASS[list(_bytes)] = _class
CLASS[0x80:] = 6
CLASS[0x0A] = 7


def text_features(text: str) -> list[float]:
    """Shares and rates in a text, all 0 for an empty one."""
    raw = text.encode()
    if not raw:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    by_class = np.bincount(CLASS, weights=counts, minlength=8) / len(raw)
    symbols, lower, upper, digits, blanks, marks, beyond, breaks = by_class.tolist()
    words = text.split()
    n = len(words)
    if not n:
        return [lower, upper, digits, blanks, marks, symbols, beyond, breaks, 0.0, 0.0, 0.0, 0.0, 0.0]
    repeats = sum(map(str.__eq__, words, words[1:])) / n
    # of n words, about so many differ in ordinary prose
    distinct = math.log(len(set(words))) / math.log(n) if n > 1 else 1.0
    bare = sum(map(str.isalpha, words)) / n
    return [
        lower, upper, digits, blanks, marks, symbols, beyond, breaks,
        len(raw) / n / 10, distinct, repeats, bare, math.log1p(n) / 10,
    ]


def features(rows: DataFrame) -> DataFrame:
    """``rows`` with ``features`` instead of the text."""

    def setup():
        return lambda texts: [[text_features(t) for t in texts]]

    return map_texts(rows, fields(features=ArrayType(DoubleType(), False)), setup)


def fit_preferences(x: np.ndarray, good: np.ndarray, seed: int = 7) -> np.ndarray | None:
    """Weights of the features from preference pairs (good over poor); None without such pairs."""
    upper, lower = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(upper) or not len(lower):
        return None
    scale = x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    draw = np.random.default_rng(seed)
    n = PARTNERS * len(x)
    # every document is in PARTNERS pairs with random documents of the other kind
    first = np.concatenate([np.repeat(upper, PARTNERS), draw.choice(upper, PARTNERS * len(lower))])
    second = np.concatenate([draw.choice(lower, PARTNERS * len(upper)), np.repeat(lower, PARTNERS)])
    difference = (x[first] - x[second]) / scale
    signs = np.where(np.arange(n) % 2, 1.0, -1.0)  # both orders, so that neither side is favoured
    return fit_logistic(difference * signs[:, None], (signs > 0).astype(float), ridge=1.0) / scale


def quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    fold: tuple[int, int] = (4, 2),
    threshold: float = 0.7,
) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per row of ``docs``.

    ``labels`` has doc_id and quality. Rows whose crc32(id) modulo ``fold[0]`` is ``fold[1]`` teach nothing.
    Scores depend on the text alone; null and empty texts have the strength of all features 0.
    Repeated rows stay. Without labels of both kinds every score is 0; an empty table gives no rows.
    """
    parts, held_out = fold
    work = Workspace(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), plain_text(text_col).alias("text"))
    described = work.write(features(rows), "features").withColumn(
        "held_out", crc_mod("doc_id", parts) == held_out
    )
    known = with_labels(described.filter(~F.col("held_out")), labels, "quality")
    chosen = known.orderBy(F.xxhash64("features"), "features").limit(SAMPLE)
    chosen = chosen.select("features", "label").toArrow()
    good = np.array(chosen["label"].to_pylist(), int) > 0
    x = np.array(chosen["features"].to_pylist(), float).reshape(len(good), len(NAMES))
    weights = fit_preferences(x, good)
    if weights is None:
        score = F.lit(0.0)
    else:
        strength = sum((F.lit(float(w)) * F.col("features")[i] for i, w in enumerate(weights)), F.lit(0.0))
        cut, width = _threshold(known.select(strength.alias("s"), "label"))
        shift = math.log(threshold / (1 - threshold))
        score = 1 / (1 + F.exp(-((strength - cut) / width + shift)))
    scored = described.withColumn("score", score)
    return scored.select(
        "doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def _threshold(known: DataFrame) -> tuple[float, float]:
    """The quantile of strengths at the share of poor documents, and a width for the scores.

    The quantile is taken as the middle between the strengths just below and just above that share.
    """
    share = known.agg(F.avg((F.col("label") <= 0).cast("double"))).first()[0]
    at = [max(0.0, share - 0.002), min(1.0, share + 0.002), 0.05, 0.95]
    below, above, low, high = known.agg(F.percentile_approx("s", at, 100_000)).first()[0]
    return (below + above) / 2, max((high - low) / 10, 1e-6)

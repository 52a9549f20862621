"""Tokenising, tag filtering and the ingest cap."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textgrove.functions.text import WORD_PATTERN, split_words, words
from textgrove.sources.numbering import number_rows
from textgrove.workspace import Workspace

# Raw text a task takes to count. Words grow to many times their text in hash tables, so the number of
# tasks follows the text, not the shuffled bytes that AQE would merge partitions by.
TASK_BYTES = 8 * 1024 * 1024
MIN_TASK_BYTES = 1024 * 1024

# The six noun tags kept by default, and the wider tag set.
NOUN_TAGS = ["Ng", "n", "nr", "ns", "nt", "nz"]
CONTENT_TAGS = [
    "Ag", "a", "an", "Ng", "n", "nr", "ns", "nt", "nz", "Vg", "v", "vd", "vn", "@", "j",
]


def text_tasks(df: DataFrame, text: str) -> int:
    """Tasks for the words of ``df``, by the exact size of its text column (read once for that)."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    by_cores = min(df.sparkSession.sparkContext.defaultParallelism, math.ceil(size / MIN_TASK_BYTES))
    return max(2, math.ceil(size / TASK_BYTES), by_cores)


def _explode_words(df: DataFrame, doc_id: str, text: str, split) -> DataFrame:
    """One row per occurrence, split by ``split(column)``.

    Documents are hashed by id while they are still one row of raw text each: that spreads large
    input files, moves far less than exploded tokens would, and leaves the rows placed so that
    every per-document aggregation downstream runs without another exchange.
    """
    placed = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    lists = placed.repartition(text_tasks(placed, "text"), "doc_id").select("doc_id", split(F.col("text")).alias("words"))
    # The length is taken before the explode, which would otherwise copy the array to every row.
    # The outer form keeps the optimizer from testing for empty lists below the exchange, where
    # it would split every text a second time.
    sized = lists.withColumn("doc_len", F.size("words"))
    exploded = sized.select("doc_id", F.posexplode_outer("words").alias("pos", "term"), "doc_len")
    return exploded.where(F.col("term").isNotNull())


def tokenize(df: DataFrame, doc_id: str, text: str, pattern: str = WORD_PATTERN) -> DataFrame:
    """``tokens(doc_id, pos, term, doc_len)`` from raw text; documents without words drop out."""
    return _explode_words(df, doc_id, text, lambda column: words(column, pattern))


def tokens_from_words(df: DataFrame, doc_id: str, line: str) -> DataFrame:
    """``tokens`` from lines of single-space separated words, empty words included."""
    return _explode_words(df, doc_id, line, split_words)


def keep_tagged(tokens: DataFrame, lexicon: DataFrame, tags: list[str] = NOUN_TAGS) -> DataFrame:
    """Keep the terms the lexicon tags with one of ``tags``; ``doc_len`` counts kept terms only.

    The lexicon is as large as the language it describes, so the join is left to the optimizer
    rather than forced into a broadcast.
    """
    wanted = lexicon.where(F.col("tag").isin(tags)).select("term")
    kept = tokens.join(wanted, "term", "left_semi")
    per_doc = Window.partitionBy("doc_id")
    return kept.select(
        "doc_id", "pos", "term", F.count(F.lit(1)).over(per_doc).cast("int").alias("doc_len")
    )


def cap_rows(df: DataFrame, key: str, rows: int, work: Workspace | None = None) -> DataFrame:
    """The first ``rows`` rows in key order (the ingest limit).

    Only keys are sorted, range by range; the counts of the ranges place the key of the last row, and the rows
    up to it are a filter on ``df``. Among rows with that key those with the smallest hash of the
    whole row stay, so that no task ever gathers the first rows.
    """
    work = work or Workspace(df.sparkSession)
    if rows <= 0:
        return df.limit(0)
    keys = number_rows(df.select(F.col(key).alias("key")), ["key"], "place", work)
    last = keys.where(F.col("place") == rows).first()
    if last is None:
        return df
    # Nulls come first, as in any ascending order.
    below = F.col(key) < F.lit(last.key) if last.key is not None else F.lit(False)
    before = below if last.key is None else below | F.col(key).isNull()
    rest = rows - keys.where(F.col("key") < F.lit(last.key) if last.key is not None else F.lit(False)).count()
    if last.key is not None:
        rest -= keys.where("key IS NULL").count()
    same = df.where(F.col(key).eqNullSafe(F.lit(last.key)))
    tied = same.select(F.xxhash64(*same.columns).alias("tie"), F.struct(*same.columns).alias("row"))
    kept = number_rows(tied, ["tie"], "tied", work).where(F.col("tied") <= rest).select("row.*")
    return df.where(before).unionByName(kept)

"""Word co-occurrence network and its vectors.

For a line of words w_0 … w_{L-1} the counts are the sum of two parts:

* whole line: every word with itself once, every pair of positions once in each order, which is
  ``n_a * n_b`` per ordered pair of words with n occurrences each;
* for positions p >= window: the word with itself once, and with each of the ``window`` words
  before it once in each order.

Counts are symmetric, so one order is counted and mirrored after the aggregation. Identical
lines are counted once with a multiplicity, and the words of long lines are paired block by
block, so that no task receives all pairs of a long line. Words are numbered first: a pair is one
BIGINT, and short lines and windows are paired by numpy, many lines at a time.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgrove.operators.weights import join_terms
from textgrove.sources.numbering import number_rows
from textgrove.workspace import Workspace, broadcast_if_bounded, broadcast_limit, row_bytes, shuffle_tasks

# Fixed value: words before a position that count again.
WINDOW = 10
# Distinct words of a line paired in one step: bounds a task to BLOCK * BLOCK pairs per row.
BLOCK = 256
# Positions of a line handled as one row in the window part.
SEGMENT = 1024
# Pairs a task adds up before it hands them on, and pairs of short lines a task makes.
PAIRS = 2_000_000
TASK_PAIRS = 8_000_000
# The words of the network are broadcast up to so many times the usual limit: shuffling all pairs twice costs far more.
NAME_BROADCASTS = 4
PAIR = "(CAST(w1 AS BIGINT) * 4294967296 + w2)"
PAIR_SCHEMA = "pair LONG, n LONG"


def line_words(tokens: DataFrame) -> DataFrame:
    """``(doc_id, words)`` back from ``tokens``, in position order, e.g. after a filter."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "term")))
    return tokens.groupBy("doc_id").agg(ordered.alias("t")).select(
        "doc_id", F.col("t.term").alias("words")
    )


def _distinct_lines(lines: DataFrame) -> DataFrame:
    """``(line, words, m, at)``: each different line once, with how often it occurs and a number of its own."""
    grouped = lines.groupBy("words").agg(
        F.min("doc_id").alias("line"), F.count(F.lit(1)).alias("m")
    )
    return grouped.repartition("line").withColumn("at", F.monotonically_increasing_id())


def _numbered(distinct: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame, int]:
    """``(line, words, m)`` with numbers for words; ``(term, id)`` in word order and its rows."""
    placed = work.write(distinct.select("at", "line", "m", F.posexplode("words").alias("pos", "term")), "placed")
    terms = number_rows(placed.select("term").distinct(), ["term"], "id", work)
    terms = work.write(terms.select("term", (F.col("id") - 1).cast("int").alias("id")), "pair_terms")
    rows = terms.count()
    ids = join_terms(placed, terms, rows, work, "pair_ids", ["at", "line", "m", "pos", "id"])
    ordered = F.array_sort(F.collect_list(F.struct("pos", "id")))
    lines = ids.groupBy("at", "line", "m").agg(ordered.alias("t"))
    return work.write(lines.select("line", F.col("t.id").alias("words"), "m"), "numbered_lines"), terms, rows


def _summed(pairs: list, counts: list) -> pa.RecordBatch:
    """Pairs with their summed counts."""
    pair, n = np.concatenate(pairs), np.concatenate(counts)
    order = np.argsort(pair, kind="stable")
    pair, n = pair[order], n[order]
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    return pa.RecordBatch.from_arrays([pa.array(pair[first]), pa.array(np.add.reduceat(n, first))], ["pair", "n"])


def _adding(found):
    """Batches of the ``(pairs, counts)`` of ``found``, added up some ``PAIRS`` at a time."""
    pairs, counts, size = [], [], 0
    for pair, n in found:
        pairs.append(pair)
        counts.append(n)
        size += len(pair)
        if size >= PAIRS:
            yield _summed(pairs, counts)
            pairs, counts, size = [], [], 0
    if size:
        yield _summed(pairs, counts)


_corner = lru_cache(maxsize=512)(np.triu_indices)


def _pairs_within(batches):
    """Every pair of the words of each row ``(m, ids, counts)``, each with itself included."""

    def found():
        for batch in batches:
            m = batch.column("m").to_numpy()
            ends = batch.column("ids").offsets.to_numpy() - batch.column("ids").offsets[0].as_py()
            ids = batch.column("ids").flatten().to_numpy().astype(np.int64)
            counts = batch.column("counts").flatten().to_numpy()
            for row in range(len(m)):
                here = slice(ends[row], ends[row + 1])
                order = np.argsort(ids[here])
                a, n = ids[here][order], counts[here][order]
                i, j = _corner(len(a))
                yield (a[i] << 32) + a[j], n[i] * n[j] * m[row]

    yield from _adding(found())


def _pairs_near(window: int):
    """The pairs of each row ``(m, part)``: a position with itself and with the ``window`` words before it."""

    def near(batches):
        def found():
            for batch in batches:
                m = batch.column("m").to_numpy()
                ends = batch.column("part").offsets.to_numpy() - batch.column("part").offsets[0].as_py()
                words = batch.column("part").flatten().to_numpy().astype(np.int64)
                for row in range(len(m)):
                    part = words[ends[row] : ends[row + 1]]
                    late = part[window:]
                    yield (late << 32) + late, np.full(len(late), m[row])
                    for back in range(1, window + 1):
                        early = part[window - back : len(part) - back]
                        pair = (np.minimum(early, late) << 32) + np.maximum(early, late)
                        # Equal words count in both orders.
                        yield pair, np.where(early == late, 2 * m[row], m[row])

        yield from _adding(found())

    return near


def _line_pairs(lines: DataFrame, work: Workspace) -> DataFrame:
    """Whole-line part: ``(pair, n)`` of word numbers, the smaller first."""
    blocks = F.ceil(F.size(F.array_distinct("words")) / BLOCK).cast("int")
    counts = (
        lines.withColumn("blocks", blocks)
        .select("line", "m", "blocks", F.explode("words").alias("term"))
        .groupBy("line", "m", "blocks", "term")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    block = F.expr("pmod(xxhash64(term), blocks)").cast("long")
    packed = counts.groupBy("line", "m", "blocks", block.alias("block")).agg(
        F.collect_list(F.struct("term", "n")).alias("terms")
    )
    packed = work.write(packed, "blocks")
    # Pairs of block numbers first, a row each, dealt over all tasks in two steps; the words of both
    # blocks are attached after that, so no task holds the pairs of a line. The number of tasks is
    # fixed because these rows are small but grow by a factor of BLOCK.
    tasks = shuffle_tasks(lines.sparkSession)
    left = packed.select("line", "m", "blocks", F.col("block").alias("ba"))
    many = left.where("blocks > 1").repartition(tasks, "line", "ba")
    number = F.explode(F.sequence(F.col("ba"), F.col("blocks").cast("long") - 1)).alias("bb")
    ids = many.select("line", "m", "ba", number).repartition(tasks, "line", "ba", "bb")
    one = packed.select("line", F.col("block").alias("ba"), F.col("terms").alias("ta"))
    other = packed.select("line", F.col("block").alias("bb"), F.col("terms").alias("tb"))
    steps = ids.join(one, ["line", "ba"]).join(other, ["line", "bb"]).repartition(tasks, "line", "ba", "bb")
    steps = steps.select("ba", "bb", "m", "ta", "tb")
    short = packed.where("blocks = 1")
    made = short.agg(F.expr("sum(size(terms) * (size(terms) + 1L) / 2)")).first()[0] or 0
    dealt = max(math.ceil(made / TASK_PAIRS), min(lines.sparkSession.sparkContext.defaultParallelism, tasks))
    short = short.repartition(dealt, "line").select("m", F.col("terms.term").alias("ids"), F.col("terms.n").alias("counts"))
    within = short.mapInArrow(_pairs_within, PAIR_SCHEMA)
    pairs = (
        steps.select("m", (F.col("ba") == F.col("bb")).alias("same"), "tb", F.explode("ta").alias("a"))
        .select("m", "same", "a", F.explode("tb").alias("b"))
        .where("NOT same OR a.term <= b.term")
    )
    across = pairs.selectExpr(
        "least(a.term, b.term) AS w1", "greatest(a.term, b.term) AS w2", "a.n * b.n * m AS n"
    )
    return across.selectExpr(f"{PAIR} AS pair", "n").unionByName(within)


def _window_pairs(lines: DataFrame, window: int) -> DataFrame:
    """Window part: ``(pair, n)`` like ``_line_pairs``; long lines are cut into segments."""
    starts = f"sequence({window}, size(words) - 1, {SEGMENT})"
    segments = (
        lines.where(f"size(words) > {window}")
        .selectExpr("m", "words", f"explode({starts}) AS s")
        .selectExpr("m", f"slice(words, s - {window} + 1, {SEGMENT + window}) AS part")
    )
    return segments.mapInArrow(_pairs_near(window), PAIR_SCHEMA)


def cooccurrence(lines: DataFrame, window: int = WINDOW, work: Workspace | None = None) -> DataFrame:
    """``cooc(w1, w2, n)`` from ``lines(doc_id, words)``, both orders of every pair."""
    work = work or Workspace(lines.sparkSession)
    distinct = work.write(_distinct_lines(lines.select("doc_id", "words")), "distinct_lines")
    numbered, terms, rows = _numbered(distinct, work)
    pairs = _line_pairs(numbered, work).unionByName(_window_pairs(numbered, window))
    half = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    # Mirrored while a pair is one number.
    both = half.selectExpr(
        "explode(if(shiftright(pair, 32) = (pair & 4294967295), array(pair),"
        " array(pair, shiftleft(pair, 32) + shiftright(pair, 32)))) AS pair",
        "n",
    ).selectExpr("CAST(shiftright(pair, 32) AS INT) AS a", "CAST(pair & 4294967295 AS INT) AS b", "n")
    # One broadcast serves both words.
    few = rows * row_bytes(2) <= NAME_BROADCASTS * broadcast_limit(lines.sparkSession)
    names = F.broadcast(terms) if few else terms
    for number, word in (("a", "w1"), ("b", "w2")):
        both = both.join(names.select(F.col("id").alias(number), F.col("term").alias(word)), number)
    return both.select("w1", "w2", "n")


def word_vocabulary(cooc: DataFrame, work: Workspace | None = None) -> DataFrame:
    """``(term, term_id)`` of all words of the network, dense ids in word order."""
    terms = cooc.select(F.col("w1").alias("term")).distinct()
    numbered = number_rows(terms, ["term"], "line_no", work)
    return numbered.select("term", (F.col("line_no") - 1).cast("int").alias("term_id"))


def word_weights(cooc: DataFrame, vocab: DataFrame, num_term: int | None = None) -> DataFrame:
    """``weights`` of the network: one vector per word, its raw counts with every other word.

    ``num_term`` bounds the vocabulary and allows broadcasting it.
    """
    index = vocab.select(F.col("term").alias("w2"), "term_id")
    if num_term is not None:
        index = broadcast_if_bounded(index, num_term)
    return cooc.join(index, "w2").select(
        F.col("w1").alias("doc_id"), "term_id", F.col("n").cast("double").alias("w")
    )

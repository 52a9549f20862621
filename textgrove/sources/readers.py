"""Text and table sources. Each returns a DataFrame; nothing is read eagerly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textgrove.functions.text import fields
from textgrove.operators.tokens import tokens_from_words

CLASS_SCHEMA = "doc_id STRING, cluster INT"
LABEL_SCHEMA = "doc_id STRING, label INT"


def read_token_rows(spark: SparkSession, path: str) -> DataFrame:
    """``tokens(doc_id, term, doc_len)`` from lines ``id \\t length \\t term``."""
    return _read_tsv(spark, path, "doc_id STRING, doc_len INT, term STRING")


def read_word_lists(spark: SparkSession, path: str) -> DataFrame:
    """``tokens`` from lines ``id \\t w1 w2 …``."""
    return tokens_from_words(valid_lines(spark.read.text(path)), "doc_id", "text")


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    return _read_tsv(spark, path, CLASS_SCHEMA)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return _read_tsv(spark, path, LABEL_SCHEMA)


def read_texts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(``texts(doc_id, text)``, rejected lines) from lines ``id \\t text``."""
    lines = spark.read.text(path)
    return valid_lines(lines), rejected_lines(lines)


def read_report(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a stored cluster report: ``report``, ``cluster_terms`` and ``members``."""
    return {
        name: spark.read.parquet(f"{path}/{name}")
        for name in ("report", "cluster_terms", "members")
    }


def matrix_columns(spark: SparkSession, path: str) -> DataFrame:
    """``(term_id, docs, w)`` of a dense matrix file: non-zero cells and sum of each column, a row for each task."""
    return spark.read.text(f"{path}/rows").mapInArrow(_column_sums, "term_id INT, docs LONG, w DOUBLE")


def _filled(line: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Cells of a line, and position and value of those that are not ``0.0``.

    Only a digit above zero or a letter makes a cell differ from zero, so zeros are passed over as bytes.
    """
    tabs = np.flatnonzero(line == 9)
    size = len(tabs) + 1
    cells = np.unique(np.searchsorted(tabs, np.flatnonzero(line > 48)))
    starts, ends = _bounds(tabs, len(line), cells)
    if len(line) - len(tabs) - (ends - starts).sum() != 3 * (size - len(cells)):
        cells = np.arange(size)  # zeros written in another way
        starts, ends = _bounds(tabs, len(line), cells)
    text = line.tobytes()
    return size, cells, np.array([float(text[a:b]) for a, b in zip(starts.tolist(), ends.tolist())])


def _bounds(tabs: np.ndarray, length: int, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``cells`` of a line start and end."""
    if not len(tabs):
        return np.zeros(len(cells), int), np.full(len(cells), length)
    starts = np.where(cells > 0, tabs[cells - 1] + 1, 0)
    return starts, np.where(cells < len(tabs), tabs[np.minimum(cells, len(tabs) - 1)], length)


def _column_sums(batches):
    docs, w = np.zeros(0, np.int64), np.zeros(0)
    for batch in batches:
        for line in batch.column(0):
            size, cells, values = _filled(np.frombuffer(line.as_buffer(), np.uint8))
            if size > len(w):
                docs, w = (np.r_[x, np.zeros(size - len(x), x.dtype)] for x in (docs, w))
            docs[cells] += values != 0
            w[cells] += values
    if len(w):
        columns = [pa.array(np.arange(len(w), dtype=np.int32)), pa.array(docs), pa.array(w)]
        yield pa.RecordBatch.from_arrays(columns, ["term_id", "docs", "w"])


def _read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    # Quotes and backslashes are ordinary characters in these files.
    reader = spark.read.options(sep="\t", quote="", escape="", mode="FAILFAST")
    return reader.schema(schema).csv(path)


def valid_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``(doc_id, text)`` of the lines with exactly two tab-separated fields."""
    parts = lines.select(fields(F.col(column)).alias("f")).where(F.size("f") == 2)
    return parts.select(F.col("f")[0].alias("doc_id"), F.col("f")[1].alias("text"))


def rejected_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``(line, num_fields)`` of all other lines."""
    parts = lines.select(F.col(column).alias("line"), F.size(fields(F.col(column))).alias("num_fields"))
    return parts.where(F.col("num_fields") != 2)


def topic_rows(
    topics: DataFrame, comments: DataFrame, name: Column | str, topic: str = "topic", key: str = "topic_id"
) -> DataFrame:
    """All comments of the topic called ``name``; empty when there is no such topic.

    The topic id is a scalar subquery, so a table partitioned by ``key`` is pruned to it and no
    join is needed. Of several topics with the name the smallest id is taken.
    """
    wanted = topics.where(F.col(topic) == name).agg(F.min(key)).scalar()
    return comments.where(F.col(key) == wanted)

"""Sinks. All writes are distributed; only one-row summaries come from the driver."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgrove.operators.weights import count_docs, join_terms, matrix_lines
from textgrove.workspace import Workspace, local_table


# Cells of a dense matrix that one file holds.
MATRIX_CELLS = 100_000_000


def _write_tsv(df: DataFrame, path: str) -> None:
    df.write.options(sep="\t", quote="", escapeQuotes="false", emptyValue="").csv(path)


def ingest(comments: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Comment rows as ingested: blank ``title``, ``content`` taken from the short text."""
    return comments.withColumns({"title": F.lit(""), "content": F.col(text)}).withColumn(
        "doc_id", F.col(doc_id)
    )


def write_texts(df: DataFrame, path: str) -> None:
    """Lines ``id \\t content``."""
    _write_tsv(df.select("doc_id", "content"), path)


def write_tokens(tokens: DataFrame, path: str, text: bool = False) -> None:
    """Token rows as Parquet, or as lines ``id \\t length \\t term``."""
    rows = tokens.select("doc_id", "doc_len", "term")
    _write_tsv(rows, path) if text else rows.write.parquet(path)


def write_classes(classes: DataFrame, path: str) -> None:
    """Lines ``id \\t cluster``."""
    _write_tsv(classes.select("doc_id", "cluster"), path)


def summary_table(spark: SparkSession, summary: dict) -> DataFrame:
    """The run summary as one row."""
    return local_table(spark, {key: pa.array([value]) for key, value in summary.items()})


def write_summary(
    spark: SparkSession,
    summary: dict,
    path: str,
    vocab: DataFrame | None = None,
    centres: DataFrame | None = None,
    cluster_score: DataFrame | None = None,
    global_centre: DataFrame | None = None,
    raw_weights: DataFrame | None = None,
) -> None:
    """``run`` (one row) and, where given, the tables named like the arguments (``vocabulary``: vocab)."""
    summary_table(spark, summary).write.parquet(f"{path}/run")
    tables = {
        "vocabulary": vocab,
        "centres": centres,
        "cluster_score": cluster_score,
        "global_centre": global_centre,
        "raw_weights": raw_weights,
    }
    for name, table in tables.items():
        if table is not None:
            table.write.parquet(f"{path}/{name}")


def write_report(
    report: DataFrame,
    cluster_terms: DataFrame,
    members: DataFrame,
    path: str,
) -> None:
    """Per-cluster report: header table, summed vectors and members (with vectors, if present).

    The large tables are laid out by cluster; members of one cluster may fill several files.
    """
    report.write.parquet(f"{path}/report")
    cluster_terms.write.partitionBy("cluster").parquet(f"{path}/cluster_terms")
    members.write.partitionBy("cluster").parquet(f"{path}/members")


def write_matrix(weights: DataFrame, num_term: int, path: str) -> None:
    """Dense rows of ``weights`` as text under ``rows``, the ``documents terms`` line under ``header``.

    Rows are gzipped, so that the file's size follows the non-zero cells rather than the grid; the number of files
    follows the grid, which is what writing and reading them takes.
    """
    num_doc = count_docs(weights).first().num_doc
    files = max(1, math.ceil(num_doc * num_term / MATRIX_CELLS))
    lines = matrix_lines(weights.repartition(files, "doc_id"), F.lit(num_term)).select("line")
    lines.write.option("compression", "gzip").text(f"{path}/rows")
    counts = local_table(weights.sparkSession, {"value": pa.array([f"{num_doc} {num_term}"])})
    counts.write.text(f"{path}/header")


def write_by_cluster(rows: DataFrame, path: str) -> None:
    """Top terms, sample texts and the like, one folder per cluster."""
    rows.write.partitionBy("cluster").parquet(path)


def write_contingency(contingency: DataFrame, path: str) -> None:
    """``(cluster, label, n, p, pxpy, term)``: all three matrices in long form."""
    contingency.write.parquet(path)


def weight_inputs(
    tf: DataFrame, df: DataFrame, num_term: int | None = None, work: Workspace | None = None
) -> DataFrame:
    """``(term, doc_id, tf, df)``: what every weight is computed from.

    With ``num_term``, the rows of ``df``, and ``work`` both tables are taken as stored, see ``join_terms``.
    """
    if num_term is not None and work is not None:
        return join_terms(tf, df.select("term", "df"), num_term, work, "inputs", ["term", "doc_id", "tf", "df"])
    return tf.join(df.select("term", "df"), "term").select("term", "doc_id", "tf", "df")


def write_raw_weights(tf: DataFrame, df: DataFrame, path: str) -> None:
    weight_inputs(tf, df).write.parquet(path)


def write_cooccurrence(cooc: DataFrame, path: str) -> None:
    cooc.write.parquet(path)

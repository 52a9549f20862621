"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from textgrove.workspace import broadcast_if_bounded


SLICE = 1000  # texts a task turns into Python objects at once


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


ROOT = str(Path(__file__).resolve().parents[2])


def map_arrow(df: DataFrame, run: Callable, schema: StructType) -> DataFrame:
    """``df.mapInArrow``, with this package on the workers' import path.

    A worker imports the package from where the driver has it, unless it was shipped another way.
    At the end of a task it gives unused Arrow memory back, as it lives on with other tasks.
    """
    env = df.sparkSession.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), ROOT) if x)

    def released(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(released, schema)


def crc_mod(id_col: str, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts


def plain_text(text_col: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def map_texts(
    df: DataFrame,
    fields: StructType,
    setup: Callable[[], Callable[[list[str]], list[list]]],
    text_col: str = "text",
) -> DataFrame:
    """Replace ``text_col`` by the columns ``fields``, computed from whole texts in Arrow batches.

    ``setup`` runs once in each task and returns a function from a list of texts (null as empty)
    to one list of values per field. All other columns pass unchanged.
    """
    others = [f for f in df.schema.fields if f.name != text_col]
    types = [to_arrow_type(f.dataType) for f in fields.fields]
    kept = [f.name for f in others]
    names = kept + [f.name for f in fields.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = setup()
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            columns = [pa.array(v, type=t) for v, t in zip(score(texts), types)]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + columns, names=names)

    return map_arrow(df, run, StructType(others + list(fields.fields)))


def map_batches(
    df: DataFrame, schema: StructType, setup: Callable[[], Callable[[pa.RecordBatch], dict]]
) -> DataFrame:
    """Rows made from Arrow batches: ``setup()`` returns a function from a batch to columns."""
    types = {f.name: to_arrow_type(f.dataType) for f in schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = setup()
        for batch in batches:
            made = make(batch)
            yield pa.RecordBatch.from_arrays(
                [pa.array(made[n], type=t) for n, t in types.items()], names=list(types)
            )

    return map_arrow(df, run, schema)


def sampled(df: DataFrame, key: list[Column], rows: int) -> DataFrame:
    """At most ``rows`` rows of the stored table ``df``: all, or those whose hash of ``key`` is small.

    The limit on the hash leaves about 5 % below ``rows``, so that no task sorts or gathers rows to
    find the smallest. The last limit binds only where very many rows have one key.
    """
    n = df.count()
    if n <= rows:
        return df
    share = int(0.95 * rows / n * (1 << 53))
    return df.filter(F.shiftrightunsigned(F.xxhash64(*key), 11) < share).limit(rows)


def fields(**types) -> StructType:
    return StructType([StructField(name, kind) for name, kind in types.items()])


def with_labels(docs: DataFrame, labels: DataFrame, value: str) -> DataFrame:
    """``docs`` that have a label, with it as ``label``.

    ``labels`` has doc_id and ``value``. Null ids and labels are dropped, of repeated ids the
    largest label counts. The labels are broadcast only while their row count bounds their size.
    """
    kept = labels.select(F.col("doc_id").alias("doc_id"), F.col(value).cast("int").alias("label"))
    kept = kept.dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    return docs.join(broadcast_if_bounded(kept, labels.count()), "doc_id")

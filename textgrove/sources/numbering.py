"""Dense row numbers without a single global window."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textgrove.workspace import Workspace

# Fixed value: monotonically_increasing_id keeps the partition above this many row bits.
ROW_BITS = 33


def number_rows(
    df: DataFrame,
    order: list[str] | None = None,
    name: str = "line_no",
    work: Workspace | None = None,
) -> DataFrame:
    """Add a dense 1-based number in ``order``.

    Rows are range-partitioned and sorted, each partition counts its rows, and the running
    total of those counts (one row per partition) is added as an offset. Only the offsets are
    brought together. Both uses must see the same partitions, so the sorted rows are written to
    a workspace.

    Without ``order`` rows read straight from files are numbered by file path and place in the file, with
    one offset per scanned block of a file; rows from elsewhere in partition order.
    """
    work = work or Workspace(df.sparkSession)
    placed, block = df, [F.shiftright("_row", ROW_BITS).alias("_part")]
    if order:
        placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    elif df.inputFiles():
        try:
            placed = df.select(
                "*",
                F.col("_metadata.file_path").alias("_file"),
                F.col("_metadata.file_block_start").alias("_start"),
            )
            block = [F.col("_file"), F.col("_start")]
        except AnalysisException:  # the rows no longer come straight from files
            placed = df
    placed = work.write(placed.withColumn("_row", F.monotonically_increasing_id()), f"sorted_{name}")
    # Rows of a block are consecutive, so their place in it is the distance from its first row.
    counts = placed.groupBy(*block).agg(F.count(F.lit(1)).alias("_rows"), F.min("_row").alias("_first"))
    keys = [c for c in counts.columns if c not in ("_rows", "_first")]
    # One row per partition or file block of the input, so this window is bounded by their count.
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    keyed = placed if keys != ["_part"] else placed.withColumn("_part", F.shiftright("_row", ROW_BITS))
    numbered = keyed.join(F.broadcast(offsets), keys)
    columns = [F.col(c) for c in df.columns]
    return numbered.select((F.col("_offset") + F.col("_row") - F.col("_first") + 1).alias(name), *columns)

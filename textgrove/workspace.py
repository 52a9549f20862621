"""Intermediate tables and broadcast bounds shared by the iterative operators."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A build side is broadcast only while its row bound times its row width stays below this. The driver holds
# a broadcast about three times (collected, hashed, in blocks) and keeps earlier ones until they are collected.
BROADCAST_LIMIT_BYTES = 48 * 1024 * 1024
BROADCAST_LIMIT_CONF = "spark.textgrove.broadcastLimitBytes"
# Rows per bucket of a bucketed table. A task holds its bucket twice, sorted for the vector lengths and for the file:
# about 400 MB of (doc_id, term_id, w, norm) rows.
ROWS_PER_BUCKET = 2_000_000
MIN_ROWS_PER_BUCKET = 20_000

# Bytes of a batch handed to Python, and the value at which they are not looked at.
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
ANY_BYTES = "2147483647"

_open: list["Workspace"] = []
_local_roots: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local-mode session without that setting falls back to a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = context.applicationId
    if app not in _local_roots:
        folder = tempfile.mkdtemp(prefix="textgrove-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local_roots[app] = folder
    return _local_roots[app]


def broadcast_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_LIMIT_CONF, str(BROADCAST_LIMIT_BYTES)))


def shuffle_tasks(spark: SparkSession) -> int:
    """Partitions for a shuffle whose rows expand afterwards, so that AQE cannot size it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_bytes(columns: int) -> int:
    """Upper estimate of one hashed row with ``columns`` eight-byte columns."""
    return 64 + 8 * columns


def broadcast_if_bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` when ``rows`` (a proven upper bound) keeps it under the limit.

    Otherwise the frame is returned unhinted, so the join shuffles and AQE may split skew.
    """
    if rows * row_bytes(len(df.columns)) <= broadcast_limit(df.sparkSession):
        return F.broadcast(df)
    return df


def block_count(table: DataFrame, rows: int, most: int, block: Callable[[int], Column]) -> int:
    """Blocks to deal ``rows`` rows into by ``block`` (of that number), so that none has more than ``most``."""
    blocks = -(-rows // most)
    while True:
        sizes = table.groupBy(block(blocks).alias("block")).agg(F.count(F.lit(1)).alias("n"))
        if sizes.agg(F.max("n")).first()[0] <= most or blocks >= rows:
            return blocks
        blocks += -(-blocks // 4)


def block_of(keys: list[str], blocks: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(blocks))


def local_table(spark: SparkSession, columns: dict[str, pa.Array]) -> DataFrame:
    """A small driver-side table (frontier rows, seeds) as a local relation."""
    return spark.createDataFrame(pa.table(columns))


def bucket_count(spark: SparkSession, rows: int) -> int:
    """Buckets for a table of ``rows`` rows: enough for memory, no more than useful."""
    by_size = math.ceil(rows / ROWS_PER_BUCKET)
    by_cores = min(spark.sparkContext.defaultParallelism, math.ceil(rows / MIN_ROWS_PER_BUCKET))
    return max(1, by_size, by_cores)


@contextmanager
def short_rows(spark: SparkSession) -> Iterator[None]:
    """For jobs that hand rows of a few numbers to Python: Spark sums the bytes of a batch anew at every row, which takes
    several times as long as the row itself."""
    before = spark.conf.get(BATCH_CONF, None)
    spark.conf.set(BATCH_CONF, ANY_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(BATCH_CONF) if before is None else spark.conf.set(BATCH_CONF, before)


class Workspace:
    """Named intermediate tables of one run, written below the checkpoint folder.

    Written tables cut the lineage and survive the loss of executors. ``close`` drops the
    catalog entries and the files; results that still read them must be written out before.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.run = "tg_" + uuid.uuid4().hex[:12]
        self.root = f"{checkpoint_root(spark)}/{self.run}"
        self.tables: list[str] = []
        _open.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return the table read back.

        Row counts are taken from the stored table where needed (Parquet footers), not from
        accumulators, which count twice when a stage is repeated.
        """
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_bucketed(
        self, df: DataFrame, name: str, key: str, buckets: int, sort: list[str]
    ) -> DataFrame:
        """Write ``df`` bucketed by ``key``, sorted inside each bucket for row-group pruning.

        ``df`` should arrive hashed by ``key`` into ``buckets`` partitions, which gives one file
        per bucket. Later joins and aggregations on ``key`` need no exchange on this side. A
        second write to the same name appends.
        """
        table = f"{self.run}_{name}"
        writer = df.write.format("parquet").bucketBy(buckets, key).sortBy(*sort)
        writer = writer.option("path", f"{self.root}/{name}")
        if table in self.tables:
            writer.mode("append").saveAsTable(table)
        else:
            writer.saveAsTable(table)
            self.tables.append(table)
        return self.spark.table(table)

    def remove(self, name: str) -> None:
        """Delete what ``write`` stored under ``name`` and nothing reads any more."""
        self._delete(f"{self.root}/{name}")

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables.clear()
        self._delete(self.root)
        if self in _open:
            _open.remove(self)


def close_workspaces() -> None:
    """Drop the intermediate tables of every run so far; their results become unreadable."""
    for work in list(_open):
        work.close()

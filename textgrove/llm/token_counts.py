"""Token counts by distinct pre-token.

1. Every task counts its pre-tokens; the counts are merged into one table of distinct pre-tokens.
2. Each distinct pre-token is tokenized once, which gives its number of tokens.
3. Documents become pre-token frequencies again. Those of the ``hot`` most frequent pre-tokens, a
   bounded table sent to all tasks, are summed on the spot; the others are joined to their counts
   and summed per document. No list of ids is ever made.

The bound on the hot table changes only which way a frequency takes, never the result. It also keeps
the join even: the pre-tokens that many documents share are not joined.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from tokenizers import Tokenizer

from textgrove.llm.common import SLICE, fields, map_arrow, map_batches, plain_text, sliced
from textgrove.llm.pretokens import splitter
from textgrove.workspace import Workspace

HOT = 200_000  # most frequent pre-tokens whose counts are sent to all tasks
FLUSH = 50_000  # distinct pre-tokens a task holds before it hands its counts on
LIMIT = 512
TEXT_KEY = "\x00"  # with a number: a join key no pre-token has


class Pieces:
    """Cuts texts like the tokenizer: at its added tokens first, then into pre-tokens."""

    def __init__(self, added: list[str]):
        self.cut = splitter()
        ordered = sorted(added, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, ordered))) if added else None

    def count(self, text: str) -> tuple[Counter, int]:
        """Frequencies of the pre-tokens, and the number of added tokens."""
        if self.special is None:
            return Counter(self.cut(text)), 0
        parts = self.special.split(text)
        counts = Counter(self.cut(parts[0]))
        for part in parts[1:]:
            counts.update(self.cut(part))
        return counts, len(parts) - 1


def added_tokens(spec: str) -> list[str]:
    return [t["content"] for t in json.loads(spec)["added_tokens"]]


def pretoken_frequencies(texts: DataFrame, added: list[str]) -> DataFrame:
    """``piece, n`` over all rows of ``texts(text)``."""
    schema = fields(piece=StringType(), n=LongType())

    def run(batches):
        pieces, held = Pieces(added), Counter()
        for batch in sliced(batches):
            for text in batch.column("text").to_pylist():
                held.update(pieces.count(text or "")[0])
                if len(held) >= FLUSH:
                    yield _counts(held)
                    held = Counter()
        yield _counts(held)

    counted = map_arrow(texts.select("text"), run, schema)
    return counted.groupBy("piece").agg(F.sum("n").alias("n"))


def _counts(held: Counter) -> pa.RecordBatch:
    columns = [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["piece", "n"])


def piece_tokens(pieces: DataFrame, spec: str) -> DataFrame:
    """``piece, n, tokens``: each distinct pre-token tokenized once."""

    def setup():
        # Spark runs a task per core already; threads of the library's own only take memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_str(spec)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        def make(batch):
            column, tokens = batch.column("piece"), []
            for start in range(0, len(column), SLICE):
                part = column.slice(start, SLICE).to_pylist()
                tokens += [len(e.ids) for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            return {"piece": column, "n": batch.column("n"), "tokens": tokens}

        return make

    schema = StructType(pieces.schema.fields + [StructField("tokens", LongType())])
    return map_batches(pieces, schema, setup)


def _frequencies(docs: DataFrame, added: list[str], hot) -> DataFrame:
    """One row per text, with the tokens of its hot pre-tokens, and one per other pre-token of it."""
    id_type = docs.schema["doc_id"]
    schema = StructType(
        [
            StructField("piece", StringType()),
            StructField("n", LongType()),
            StructField("row", LongType()),
            StructField("doc_id", id_type.dataType),
            StructField("n_bytes", LongType()),
        ]
    )

    def run(batches):
        pieces, known = Pieces(added), hot.value
        for batch in sliced(batches, 250):
            keys, counts, rows, heads, sizes = [], [], [], [], []
            numbers = batch.column("row").to_pylist()
            for at, (row, text) in enumerate(zip(numbers, batch.column("text").to_pylist())):
                found, total = pieces.count(text or "")
                keys.append(f"{TEXT_KEY}{row}")
                place = len(counts)
                counts.append(0)
                rows.append(row)
                heads.append(at)
                sizes.append(len((text or "").encode()))
                for piece, n in found.items():
                    tokens = known.get(piece)
                    if tokens is None:
                        keys.append(piece)
                        counts.append(n)
                        rows.append(row)
                        heads.append(None)
                        sizes.append(None)
                    else:
                        total += n * tokens
                counts[place] = total
            ids = batch.column("doc_id").take(pa.array(heads, pa.int32()))
            columns = [pa.array(keys, pa.string()), pa.array(counts, pa.int64())]
            columns += [pa.array(rows, pa.int64()), ids, pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_arrow(docs, run, schema)


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = LIMIT,
    hot: int = HOT,
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``, one row per row of ``docs``.

    Counts are those of the byte-level tokenizer file without special tokens put around the text;
    added tokens written in a text count as one. Null and empty texts have 0 bytes and 0 tokens. Rows
    with equal or null ids are counted apart. An empty table gives no rows.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = file.read()
    added = added_tokens(spec)
    work = Workspace(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), plain_text(text_col).alias("text"))
    counted = work.write(piece_tokens(pretoken_frequencies(rows, added), spec), "pieces")
    top = counted.orderBy(F.desc("n"), "piece").limit(hot).select("piece", "tokens").toArrow()
    known = dict(zip(top["piece"].to_pylist(), top["tokens"].to_pylist()))
    # Row numbers come straight from the scan, where they are the same in a repeated task.
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    shared = spark.sparkContext.broadcast(known)
    parts = _frequencies(numbered, added, shared)
    joined = parts.join(counted.select("piece", "tokens"), "piece", "left")
    sums = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_bytes").alias("n_bytes"),
        F.sum(F.col("n") * F.coalesce("tokens", F.lit(1))).alias("n_tokens"),
    )
    over = (F.col("n_tokens") > limit).alias("over_limit")
    counts = work.write(sums.select("doc_id", "n_bytes", "n_tokens", over), "token_counts")
    shared.destroy()  # reused workers would keep the table of every run
    return counts

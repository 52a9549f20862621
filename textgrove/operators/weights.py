"""Term statistics, TF-IDF weights and vectors, all in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textgrove.sources.numbering import number_rows
from textgrove.workspace import (
    Workspace,
    block_count,
    broadcast_if_bounded,
    broadcast_limit,
    row_bytes,
)

# Fixed value: default scale of the vocabulary band.
FILTER_SCALE = 5
# Hash values of terms by which stored term frequencies are sorted; a block of terms is a range of them.
SLOTS = 1 << 20


def term_freq(tokens: DataFrame) -> DataFrame:
    """``tf(doc_id, term, tf)``: each occurrence weighs one over the length of its line.

    Occurrences are counted first and divided once, so equal counts give equal values; lines
    that share an id add up.
    """
    counted = tokens.groupBy("doc_id", "term", "doc_len").agg(F.count(F.lit(1)).alias("n"))
    share = F.sum(F.col("n") / F.col("doc_len"))
    return counted.groupBy("doc_id", "term").agg(share.alias("tf"))


def doc_freq(tf: DataFrame) -> DataFrame:
    """``df(term, df)``: documents per term; partial sums absorb terms present everywhere."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def count_docs(rows: DataFrame) -> DataFrame:
    """One row ``(num_doc)``: distinct documents that own a row."""
    return rows.agg(F.count_distinct("doc_id").alias("num_doc"))


def count_terms(rows: DataFrame) -> DataFrame:
    """One row ``(num_term)``: distinct terms."""
    return rows.agg(F.count_distinct("term").alias("num_term"))


def corpus_stats(df: DataFrame, scale: float = FILTER_SCALE) -> DataFrame:
    """One row ``(num_term, df_sum, df_mean)`` with ``df_mean = df_sum / (num_term * scale)``."""
    totals = df.agg(F.count(F.lit(1)).alias("num_term"), F.sum("df").alias("df_sum"))
    mean = F.col("df_sum") / (F.col("num_term") * F.lit(float(scale)))
    return totals.select("num_term", "df_sum", mean.alias("df_mean"))


def band(
    df: DataFrame,
    scale: float | None = None,
    df_min: int | None = None,
    df_max: int | None = None,
) -> DataFrame:
    """Vocabulary filter on document frequency.

    ``scale`` keeps ``m < df < m * (scale - 1)`` (both strict) with ``m`` from ``corpus_stats``;
    ``df_min`` and ``df_max`` are inclusive bounds; without arguments every term stays. The
    corpus mean enters as a scalar subquery, so no join is planned.
    """
    kept = df
    if scale is not None:
        mean = corpus_stats(df, scale).select("df_mean").scalar()
        kept = kept.where((F.col("df") > mean) & (F.col("df") < mean * (scale - 1)))
    if df_min is not None:
        kept = kept.where(F.col("df") >= df_min)
    if df_max is not None:
        kept = kept.where(F.col("df") <= df_max)
    return kept


def vocabulary(df: DataFrame, work: Workspace | None = None) -> DataFrame:
    """``vocab(term, term_id, df)`` with dense ids 0.. in term order."""
    numbered = number_rows(df, ["term"], "line_no", work)
    return numbered.select("term", (F.col("line_no") - 1).cast("int").alias("term_id"), "df")


def idf_expr(num_doc: Column, df: Column, idf: str = "smooth") -> Column:
    """``ln(N / (df + 1))``, or its negative for ``idf='legacy'``."""
    if idf == "smooth":
        return F.ln(num_doc / (df + 1))
    if idf == "legacy":
        return F.ln((df + 1) / num_doc)
    raise ValueError(f"unknown idf: {idf}")


def idf_table(df: DataFrame, num_doc: Column, idf: str = "smooth") -> DataFrame:
    return df.withColumn("idf", idf_expr(num_doc, F.col("df"), idf))


def with_slot(rows: DataFrame) -> DataFrame:
    """``rows`` with the ``slot`` of their ``term``, unless stored with it."""
    if "slot" in rows.columns:
        return rows
    return rows.withColumn("slot", F.pmod(F.xxhash64("term"), F.lit(SLOTS)).cast("int"))


def store_term_freq(tf: DataFrame, work: Workspace) -> DataFrame:
    """``tf`` written with the ``slot`` of each term, files sorted by it: a block of terms reads its own pages only."""
    return work.write(with_slot(tf).sortWithinPartitions("slot"), "tf")


def join_terms(
    tf: DataFrame, terms: DataFrame, rows: int, work: Workspace, name: str, columns: list[str]
) -> DataFrame:
    """``columns`` of stored ``tf`` joined with stored ``terms(term, …)``, which has ``rows`` rows.

    Terms beyond the broadcast limit go out block by block, by ranges of slots, each joined with its rows of ``tf``
    and written: no row of ``tf`` moves, only one block is held at a time, and a term of most documents is no
    heavier for a task than others. Of a ``tf`` from ``store_term_freq`` the blocks read about all pages once.
    """
    size, limit = row_bytes(len(terms.columns)), broadcast_limit(tf.sparkSession)
    if rows * size <= limit or limit < size:  # below one row nothing may be broadcast at all
        return tf.join(broadcast_if_bounded(terms, rows), "term").select(*columns)
    tf, terms, keys = with_slot(tf), with_slot(terms), terms.columns
    blocks = block_count(terms, rows, limit // size, lambda n: F.floor(F.col("slot") * F.lit(n).cast("long") / SLOTS))
    parts = []
    for b in range(blocks):
        first, last = -(-b * SLOTS // blocks), -(-(b + 1) * SLOTS // blocks) - 1
        here = F.col("slot").between(first, last)
        near = F.broadcast(terms.where(here).select(*keys))
        part = work.write(tf.where(here).join(near, "term").select(*columns), f"{name}_{b}")
        parts.append(f"{work.root}/{name}_{b}")
    return work.spark.read.schema(part.schema).parquet(*parts)


def tfidf(
    tf: DataFrame,
    vocab: DataFrame,
    n_basis: str = "post",
    idf: str = "smooth",
    num_term: int | None = None,
    work: Workspace | None = None,
) -> DataFrame:
    """``weights(doc_id, term_id, w)`` with ``w = tf * idf``.

    ``n_basis`` counts documents before (``pre``) or after (``post``) the vocabulary filter.
    With ``num_term``, the rows of ``vocab``, and ``work`` both tables are taken as stored and joined by
    ``join_terms``; otherwise AQE decides and splits the partitions of very frequent terms.
    """
    if num_term is None or work is None:
        kept = tf.join(vocab, "term")
    else:
        kept = join_terms(tf, vocab, num_term, work, "numbered", ["doc_id", "term_id", "tf", "df"])
    basis = {"pre": tf, "post": kept}[n_basis]
    num_doc = count_docs(basis).scalar()
    weight = F.col("tf") * idf_expr(num_doc, F.col("df"), idf)
    return kept.select("doc_id", "term_id", weight.alias("w"))


def explode_dense(df: DataFrame, doc_id: str, array: str) -> DataFrame:
    """``weights`` from a dense array column, widened to double first."""
    doubles = F.col(array).cast("array<double>")
    return df.select(F.col(doc_id).alias("doc_id"), F.posexplode(doubles).alias("term_id", "w"))


def norms(weights: DataFrame) -> DataFrame:
    """``(doc_id, norm)``: Euclidean length per document."""
    squares = F.sum(F.col("w") * F.col("w"))
    return weights.groupBy("doc_id").agg(F.sqrt(squares).alias("norm"))


def centroid(weights: DataFrame, num_doc: Column | None = None) -> DataFrame:
    """``(term_id, w)``: global centroid, the summed vectors over the document count."""
    if num_doc is None:
        num_doc = count_docs(weights).scalar()
    return weights.groupBy("term_id").agg((F.sum("w") / num_doc).alias("w"))


def pack_sparse(weights: DataFrame) -> DataFrame:
    """``(doc_id, idx, val)``: one row per document, coordinates in index order."""
    pairs = F.array_sort(F.collect_list(F.struct("term_id", "w")))
    packed = weights.groupBy("doc_id").agg(pairs.alias("pairs"))
    return packed.select(
        "doc_id", F.col("pairs.term_id").alias("idx"), F.col("pairs.w").alias("val")
    )


def densify(weights: DataFrame, num_term: Column) -> DataFrame:
    """``(doc_id, vec)``: arrays of length ``num_term``; meant for small vocabularies only.

    Every coordinate becomes one array slot, so the grid is as large as the dense matrix the
    caller asks for.
    """
    packed = weights.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("term_id", "w"))).alias("by_term")
    )
    slots = F.sequence(F.lit(0), num_term.cast("int") - 1)
    vec = F.transform(slots, lambda t: F.coalesce(F.try_element_at("by_term", t), F.lit(0.0)))
    return packed.select("doc_id", vec.alias("vec"))


def matrix_lines(weights: DataFrame, num_term: Column) -> DataFrame:
    """``(doc_id, line)``: dense rows as tab-separated text, the gaps filled with zeros as the line is written.

    A row in memory follows its non-zero coordinates; only the line itself is as long as the vocabulary.
    """
    packed = pack_sparse(weights)
    last = F.element_at("idx", -1)
    before = F.concat(F.array(F.lit(-1).cast("int")), F.slice("idx", 1, F.size("idx") - 1)).alias("before")
    cells = F.transform(
        F.arrays_zip("idx", "val", before),
        lambda c: F.concat(F.repeat(F.lit("0.0\t"), c["idx"] - c["before"] - 1), c["val"].cast("string")),
    )
    rest = F.repeat(F.lit("\t0.0"), num_term.cast("int") - 1 - last)
    return packed.select("doc_id", F.concat(F.array_join(cells, "\t"), rest).alias("line"))

"""What is in a cluster: sizes, cohesion, summed vectors, top terms, sample texts, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgrove.operators.weights import pack_sparse
from textgrove.workspace import broadcast_if_bounded, bucket_count


def _placed(table: DataFrame, rows: int | None) -> DataFrame:
    """``table`` dealt by document into as many tasks as ``rows`` weights need, as buckets are.

    The exchange a join or window would plan has a fixed number of partitions, which grow with the input and are sorted.
    Without ``rows``, weights are taken as they are: stored by bucket, or small.
    """
    if rows is None:
        return table
    return table.repartition(bucket_count(table.sparkSession, rows), "doc_id")


def _clustered(weights: DataFrame, classes: DataFrame) -> DataFrame:
    # Classes come from the caller and may be of any size: the join has to be able to spill.
    return weights.join(classes.select("doc_id", "cluster"), "doc_id")


def cluster_sizes(classes: DataFrame) -> DataFrame:
    """``(cluster, n)``."""
    return classes.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def summed_vectors(weights: DataFrame, classes: DataFrame, rows: int | None = None) -> DataFrame:
    """``(cluster, term_id, w_sum)``: non-zero coordinates of each cluster's summed vector.

    ``rows`` is the known row count of ``weights`` that are not bucketed by document.
    """
    sums = _clustered(_placed(weights, rows), _placed(classes, rows)).groupBy("cluster", "term_id")
    return sums.agg(F.sum("w").alias("w_sum")).where("w_sum <> 0")


def cluster_centroids(weights: DataFrame, classes: DataFrame) -> DataFrame:
    """``(cluster, term_id, w)``: summed vectors over the documents of the cluster."""
    sums = _clustered(weights, classes).groupBy("cluster", "term_id").agg(F.sum("w").alias("t"))
    sizes = cluster_sizes(classes)
    sizes = broadcast_if_bounded(sizes, sizes.count())
    return sums.join(sizes, "cluster").selectExpr("cluster", "term_id", "t / n AS w")


def cluster_cohesion(weights: DataFrame, classes: DataFrame, rows: int | None = None) -> DataFrame:
    """``(cluster, n, cohesion, sse)``: summed cosine and squared distance to the own centroid.

    With S the summed vectors and U the summed unit vectors of a cluster, the cosines to the
    centroid add up to U.S / |S|, so one aggregation replaces a second pass over the documents.
    ``weights`` may carry ``norm``; otherwise the lengths are computed. ``rows`` is the known row
    count of ``weights`` that are not bucketed by document.
    """
    weights = _placed(weights, rows)
    if "norm" not in weights.columns:
        weights = weights.withColumn(
            "norm", F.expr("sqrt(sum(w * w) OVER (PARTITION BY doc_id))")
        )
    per_term = (
        _clustered(weights, _placed(classes, rows))
        .groupBy("cluster", "term_id")
        .agg(
            F.expr("sum(w) AS t"),
            F.expr("sum(if(norm > 0, w / norm, 0D)) AS u"),
            F.expr("sum(w * w) AS q"),
        )
    )
    whole = per_term.groupBy("cluster").agg(
        F.expr("coalesce(sum(t * u) / nullif(sqrt(sum(t * t)), 0), 0D) AS cohesion"),
        F.expr("sum(q) AS q"),
        F.expr("sum(t * t) AS tt"),
    )
    return cluster_sizes(classes).join(whole, "cluster").selectExpr(
        "cluster", "n", "cohesion", "greatest(0D, q - tt / n) AS sse"
    )


def cluster_terms(
    weights: DataFrame, classes: DataFrame, vocab: DataFrame | None = None, n: int = 100, rows: int | None = None
) -> DataFrame:
    """The ``n`` heaviest terms of each cluster: ``(cluster, rank, term_id, w_sum[, term])``."""
    return top_terms(summed_vectors(weights, classes, rows), vocab, n)


def top_terms(sums: DataFrame, vocab: DataFrame | None = None, n: int = 100) -> DataFrame:
    """``cluster_terms`` from summed vectors ``(cluster, term_id, w_sum)``.

    Sums equal to nine decimals tie, and ties go to the smaller term id, so that the order of
    float additions cannot change the ranking. The limit is applied before the exchange as well.
    """
    rank = "row_number() OVER (PARTITION BY cluster ORDER BY round(w_sum, 9) DESC, term_id) AS rank"
    top = sums.selectExpr("*", rank).where(f"rank <= {n}")
    top = top.select("cluster", "rank", "term_id", "w_sum")
    if vocab is None:
        return top
    return top.join(vocab.select("term_id", "term"), "term_id").select(
        "cluster", "rank", "term_id", "w_sum", "term"
    )


def cluster_samples(
    classes: DataFrame,
    texts: DataFrame,
    n: int = 100,
    clusters: int | None = None,
    order: str | None = None,
) -> DataFrame:
    """The first ``n`` members of each cluster with their text: ``(cluster, rank, doc_id, text)``.

    Members are picked before any text is read. ``clusters`` bounds the number of clusters, and
    with it the picked rows, which may then be broadcast. If ids repeat in ``texts``, the row
    with the largest ``order`` column wins.
    """
    rank = "row_number() OVER (PARTITION BY cluster ORDER BY doc_id) AS rank"
    picked = classes.selectExpr("cluster", "doc_id", rank).where(f"rank <= {n}")
    if clusters is not None:
        picked = broadcast_if_bounded(picked, clusters * n)
    found = texts.join(picked, "doc_id")
    if order is not None:
        found = found.groupBy("cluster", "rank", "doc_id").agg(
            F.max_by("text", order).alias("text")
        )
    return found.select("cluster", "rank", "doc_id", "text")


def member_vectors(weights: DataFrame, classes: DataFrame) -> DataFrame:
    """``(cluster, doc_id, idx, val)``: every member with its packed vector."""
    return pack_sparse(weights).join(classes.select("doc_id", "cluster"), "doc_id").select(
        "cluster", "doc_id", "idx", "val"
    )



"""Document clustering end to end: texts → weights → cluster tree → reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgrove.operators import report as reports
from textgrove.operators.bisect import Bisection, bisect
from textgrove.operators.kmeans import KMeansResult, Space, kmeans, prepare
from textgrove.operators.tokens import tokenize
from textgrove.operators.weights import band, count_docs, doc_freq, store_term_freq, term_freq, tfidf, vocabulary
from textgrove.sources import sinks
from textgrove.workspace import Workspace


@dataclass
class Corpus:
    """Weights of a document collection with the tables they come from."""

    work: Workspace
    tf: DataFrame  # (doc_id, term, tf, slot), see ``store_term_freq``
    vocab: DataFrame  # (term, term_id, df)
    num_term: int
    weights: DataFrame
    rows: int  # rows of ``weights``: every term has one per document
    basis: int | None = None  # documents before the vocabulary filter, where weights count those

    def space(self) -> Space:
        return prepare(self.weights, self.rows, self.work, self.basis)


def corpus(
    tokens: DataFrame,
    scale: float | None = None,
    df_min: int | None = None,
    df_max: int | None = None,
    n_basis: str = "post",
    idf: str = "smooth",
    work: Workspace | None = None,
) -> Corpus:
    """TF-IDF weights of ``tokens``.

    Term frequencies and vocabulary are written once: both are read several times, and the
    vocabulary tells how many rows the weights have and whether it may be broadcast whole.
    """
    work = work or Workspace(tokens.sparkSession)
    tf = store_term_freq(term_freq(tokens), work)
    kept = band(doc_freq(tf), scale, df_min, df_max)
    vocab = work.write(vocabulary(kept, work), "vocab")
    num_term, rows = vocab.selectExpr("count(1)", "coalesce(sum(df), 0)").first()
    weights = tfidf(tf, vocab, n_basis, idf, num_term, work)
    basis = count_docs(tf).first()[0] if n_basis == "pre" else None
    return Corpus(work, tf, vocab, num_term, weights, rows, basis)


def document_corpus(
    texts: DataFrame, doc_id: str = "doc_id", text: str = "text", **options
) -> Corpus:
    """``corpus`` of raw texts."""
    return corpus(tokenize(texts, doc_id, text), **options)


def cluster_documents(
    texts: DataFrame, path: str | None = None, top: int = 100, **options
) -> tuple[Bisection, dict[str, DataFrame]]:
    """Cluster ``texts(doc_id, text)`` and describe the clusters; write all tables below ``path``.

    ``options`` are those of ``corpus`` and ``bisect``.
    """
    names = ("scale", "df_min", "df_max", "n_basis", "idf")
    found = document_corpus(texts, **{k: options.pop(k) for k in names if k in options})
    space = found.space()
    tree = bisect(space, **options)
    clusters = tree.summary["clusters"]
    tables = {
        "report": tree.report,
        "classes": tree.classes,
        "cluster_terms": reports.summed_vectors(space.weights, tree.classes),
        "top_terms": reports.cluster_terms(space.weights, tree.classes, found.vocab, top),
        "samples": reports.cluster_samples(tree.classes, texts, top, clusters),
    }
    if path is not None:
        sinks.write_summary(
            texts.sparkSession,
            tree.summary,
            f"{path}/summary",
            found.vocab,
            tree.centres,
            tree.scores,
            space.centre,
            sinks.weight_inputs(found.tf, found.vocab, found.num_term, found.work),
        )
        members = reports.member_vectors(space.weights, tree.classes)
        sinks.write_report(tree.report, tables["cluster_terms"], members, f"{path}/clusters")
        sinks.write_classes(tree.classes, f"{path}/class")
        sinks.write_by_cluster(tables["top_terms"], f"{path}/top_terms")
        sinks.write_by_cluster(tables["samples"], f"{path}/samples")
    return tree, tables


def partition_documents(
    texts: DataFrame, path: str | None = None, clusters: int = 20, top: int = 100, **options
) -> tuple[KMeansResult, dict[str, DataFrame]]:
    """Flat K-means of ``texts(doc_id, text)`` into ``clusters``, described like ``cluster_documents``.

    Clusters are numbered from 0 and may be empty. ``options`` are those of ``corpus`` and ``kmeans``. Below
    ``path``: the run ``summary`` with vocabulary, centres, scores of every restart, global centre and raw
    weights, the ``class`` file, the report with packed members under ``clusters``, top terms and samples.
    """
    names = ("scale", "df_min", "df_max", "n_basis", "idf")
    found = document_corpus(texts, **{k: options.pop(k) for k in names if k in options})
    space = found.space()
    result = kmeans(space, clusters, **options)
    classes = found.work.write(result.assign.select("doc_id", F.col("k").alias("cluster")), "classes")
    tables = {
        "report": reports.cluster_cohesion(space.weights, classes),
        "classes": classes,
        "cluster_terms": reports.summed_vectors(space.weights, classes),
        "top_terms": reports.cluster_terms(space.weights, classes, found.vocab, top),
        "samples": reports.cluster_samples(classes, texts, top, clusters),
    }
    if path is not None:
        raw = sinks.weight_inputs(found.tf, found.vocab, found.num_term, found.work)
        sinks.write_summary(
            texts.sparkSession, result.summary, f"{path}/summary", found.vocab, result.centres, result.scores,
            space.centre, raw,
        )
        members = reports.member_vectors(space.weights, classes)
        sinks.write_report(tables["report"], tables["cluster_terms"], members, f"{path}/clusters")
        sinks.write_classes(classes, f"{path}/class")
        sinks.write_by_cluster(tables["top_terms"], f"{path}/top_terms")
        sinks.write_by_cluster(tables["samples"], f"{path}/samples")
    return result, tables

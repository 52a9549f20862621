"""Plans over stored files: ingest a topic, weigh a token file, score classes, describe a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textgrove.operators import report as reports
from textgrove.operators.quality import contingency, nmi
from textgrove.operators.tokens import NOUN_TAGS, keep_tagged, tokenize
from textgrove.plans.documents import Corpus, corpus
from textgrove.sources import readers, sinks


def ingest_topic(
    topics: DataFrame,
    comments: DataFrame,
    name: str,
    path: str,
    lexicon: DataFrame | None = None,
    tags: list[str] = NOUN_TAGS,
    doc_id: str = "comment_id",
    text: str = "text",
) -> DataFrame:
    """The comments of a topic as token lines below ``path``; the stored tokens.

    Texts are written under ``texts``, tokens under ``tokens``. With a ``lexicon(term, tag)``
    only its terms with one of ``tags`` are kept.
    """
    rows = sinks.ingest(readers.topic_rows(topics, comments, name), doc_id, text)
    sinks.write_texts(rows, f"{path}/texts")
    tokens = tokenize(rows, "doc_id", "content")
    if lexicon is not None:
        tokens = keep_tagged(tokens, lexicon, tags)
    sinks.write_tokens(tokens, f"{path}/tokens", text=True)
    return readers.read_token_rows(topics.sparkSession, f"{path}/tokens")


def token_matrix(spark: SparkSession, tokens_path: str, path: str, **options) -> Corpus:
    """A token file as a TF-IDF matrix in text below ``path``. ``options`` are those of ``corpus``."""
    found = corpus(readers.read_token_rows(spark, tokens_path), **options)
    sinks.write_matrix(found.weights, found.num_term, path)
    return found


def score_classes(
    spark: SparkSession,
    classes_path: str,
    labels_path: str,
    path: str,
    class_num: int | None = None,
    base: str = "consistent",
) -> DataFrame:
    """NMI of a class file against a label file; below ``path`` the ``cells`` and the ``score``."""
    classes = readers.read_classes(spark, classes_path)
    labels = readers.read_labels(spark, labels_path)
    cells = contingency(classes, labels, class_num, dense=class_num is not None)
    sinks.write_contingency(cells, f"{path}/cells")
    nmi(classes, labels, base, class_num).write.parquet(f"{path}/score")
    return spark.read.parquet(f"{path}/score")


def describe_run(
    spark: SparkSession, run: str, texts: DataFrame, path: str, top: int = 100
) -> dict[str, DataFrame]:
    """Top terms and sample texts of a run stored by ``cluster_documents``, written below ``path``."""
    stored = readers.read_report(spark, f"{run}/clusters")
    vocab = spark.read.parquet(f"{run}/summary/vocabulary")
    tables = {
        "top_terms": reports.top_terms(stored["cluster_terms"], vocab, top),
        "samples": reports.cluster_samples(
            stored["members"].select("doc_id", "cluster"), texts, top, stored["report"].count()
        ),
    }
    for name, table in tables.items():
        sinks.write_by_cluster(table, f"{path}/{name}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in tables}

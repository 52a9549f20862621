"""Word clustering end to end: lines → co-occurrence network → cluster tree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from textgrove.operators import report as reports
from textgrove.operators.bisect import Bisection, bisect
from textgrove.operators.kmeans import Space, prepare
from textgrove.operators.network import WINDOW, cooccurrence, word_vocabulary, word_weights
from textgrove.sources import sinks
from textgrove.workspace import Workspace


@dataclass
class Network:
    space: Space
    cooc: DataFrame
    vocab: DataFrame


def word_space(lines: DataFrame, window: int = WINDOW, work: Workspace | None = None) -> Network:
    """Word vectors of ``lines(doc_id, words)``, raw counts, ready for clustering."""
    work = work or Workspace(lines.sparkSession)
    cooc = work.write(cooccurrence(lines, window), "cooc")
    vocab = work.write(word_vocabulary(cooc, work), "words")
    return Network(prepare(word_weights(cooc, vocab, vocab.count()), cooc.count(), work), cooc, vocab)


def cluster_words(
    lines: DataFrame, path: str | None = None, window: int = WINDOW, **options
) -> tuple[Bisection, Network]:
    """Cluster the words of ``lines`` by repeated bisection of their co-occurrence vectors."""
    network = word_space(lines, window)
    tree = bisect(network.space, **options)
    if path is not None:
        space = network.space
        sinks.write_summary(
            lines.sparkSession,
            tree.summary,
            f"{path}/summary",
            network.vocab,
            tree.centres,
            tree.scores,
            space.centre,
        )
        sums = reports.summed_vectors(space.weights, tree.classes)
        members = reports.member_vectors(space.weights, tree.classes)
        sinks.write_report(tree.report, sums, members, f"{path}/clusters")
        sinks.write_cooccurrence(network.cooc, f"{path}/cooccurrence")
        sinks.write_classes(tree.classes, f"{path}/class")
    return tree, network

"""Text clustering on Spark DataFrames.

Everything is expressed over three long tables:

* ``tokens(doc_id, pos, term, doc_len)``: one row per word occurrence,
* ``weights(doc_id, term_id, w)``: one row per non-repeated coordinate of a vector,
* ``classes(doc_id, cluster)``: the result of a clustering.

No module creates a SparkSession; callers pass DataFrames (or the session) in.
"""

from textgrove.operators.bisect import bisect
from textgrove.operators.kmeans import assign, kmeans
from textgrove.operators.network import cooccurrence, word_weights
from textgrove.operators.quality import contingency, nmi
from textgrove.operators.report import cluster_samples, cluster_terms
from textgrove.operators.tokens import keep_tagged, tokenize, tokens_from_words
from textgrove.operators.weights import (
    band,
    centroid,
    doc_freq,
    explode_dense,
    norms,
    term_freq,
    tfidf,
    vocabulary,
)

__all__ = [
    "assign",
    "band",
    "bisect",
    "centroid",
    "cluster_samples",
    "cluster_terms",
    "contingency",
    "cooccurrence",
    "doc_freq",
    "explode_dense",
    "keep_tagged",
    "kmeans",
    "nmi",
    "norms",
    "term_freq",
    "tfidf",
    "tokenize",
    "tokens_from_words",
    "vocabulary",
    "word_weights",
]

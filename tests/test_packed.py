"""K-means over weights packed by term against the passes over weights by document."""

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, weights_of
from textgrove.operators import bisect as bi
from textgrove.operators import kmeans as km
from textgrove.operators import packed, weights
from textgrove.operators.bisect import bisect
from textgrove.plans.documents import document_corpus
from textgrove.workspace import BROADCAST_LIMIT_CONF


@pytest.fixture
def packing(monkeypatch):
    """Turns packing on, in rows and chunks of little more than one task's share."""

    def on():
        monkeypatch.setattr(km, "PACK_MIN_ROWS", 0)
        monkeypatch.setattr(packed, "PACK", 300)
        monkeypatch.setattr(packed, "CHUNK", 70)

    return on


def outcome(tree):
    near = lambda x: None if x is None else pytest.approx(x, abs=1e-9)
    return (
        sorted((r.doc_id, r.node, r.cluster) for r in tree.classes.collect()),
        [(r.cluster, r.node, r.n, near(r.gain), near(r.cohesion), near(r.sse)) for r in tree.report.orderBy("cluster").collect()],
        {k: near(v) if isinstance(v, float) else v for k, v in tree.summary.items() if k != "rounds"},
        sorted((r.k, r.term_id, near(round(r.w, 12))) for r in tree.centres.collect()),
    )


@pytest.mark.parametrize("criterion", ["h1", "sse"])
def test_trees_of_packed_vectors(embeddings, packing, criterion):
    rows = weights.explode_dense(embeddings, "vec_id", "embedding")
    want = outcome(bisect(rows, 5, criterion))
    packing()
    tree = bisect(rows, 5, criterion)
    assert tree.space.packed is not None and outcome(tree) == want


def test_trees_of_packed_documents_move_no_centre(spark, packing, monkeypatch):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    want = outcome(bisect(document_corpus(documents).space(), 4, "i2"))
    packing()
    # Centres of far more rows than a broadcast holds used to go out in blocks, each of which read all weights.
    monkeypatch.setattr(km, "_blocked_dots", None)
    spark.conf.set(BROADCAST_LIMIT_CONF, "40000")
    try:
        tree = bisect(document_corpus(documents).space(), 4, "i2")
    finally:
        spark.conf.unset(BROADCAST_LIMIT_CONF)
    assert outcome(tree) == want
    assert not any("centres" in name for name in tree.space.work.tables)


@pytest.mark.parametrize("metric,k,restarts", [("cosine", 3, 3), ("euclid", 10, 2)])
def test_packed_kmeans(embeddings, packing, metric, k, restarts):
    rows = weights.explode_dense(embeddings, "vec_id", "embedding")

    def found(**options):
        result = km.kmeans(rows, k, metric, restarts=restarts, seed=11, **options)
        assign = {r.doc_id: (r.k, pytest.approx(r.score, abs=1e-9)) for r in result.assign.collect()}
        scores = [(r.restart, r.k, r.n, pytest.approx(r.score, abs=1e-9)) for r in result.scores.collect()]
        centres = {(r.k, r.term_id): pytest.approx(r.w, abs=1e-9) for r in result.centres.collect()}
        return assign, scores, centres, {k: pytest.approx(v, abs=1e-9) for k, v in result.summary.items()}

    runs = [dict(max_iter=3), dict(max_iter=None, eps=1e-5)]
    want = [found(**options) for options in runs]
    packing()
    assert [found(**options) for options in runs] == want


def test_emptied_sides_of_packed_nodes_keep_their_centres(spark, packing):
    packing()
    result = km.kmeans(weights_of(spark, {1: [1, 1], 2: [1, 1], 3: [1, 1]}), 2)
    assert {(r.k, r.n) for r in result.scores.where("restart = 0").collect()} == {(0, 3), (1, 0)}
    assert result.summary["score"] is None
    assert result.centres.where("k = 1").count() == 2
    # Vectors without a length, and a term without weights.
    rows = spark.createDataFrame([(1, 0, 1.0), (2, 1, 0.0), (3, 2, None), (4, 0, 2.0)], "doc_id long, term_id int, w double")
    assert {r.doc_id for r in km.kmeans(rows, 2).assign.collect()} == {1, 2, 3, 4}


def test_spaces_that_cannot_be_packed(spark, packing):
    rows = spark.createDataFrame([(1, 0, 1.0), (2, 1, 1.0), (None, 1, 1.0), (3, 1, 2.0)], "doc_id long, term_id int, w double")
    want = sorted((r.doc_id, r.k) for r in km.kmeans(rows, 2).assign.collect())
    packing()
    space = km.prepare(rows)
    assert sorted((r.doc_id, r.k) for r in km.kmeans(space, 2).assign.collect()) == want and space.packed is None
    part = km.prepare(rows.where("doc_id IS NOT NULL"))
    assert part.pack(2, 2) is not None and part.subset(part.table, 3, "part_weights").pack(2, 2) is None
    spark.conf.set(BROADCAST_LIMIT_CONF, "0")
    try:
        assert part.pack(2, 2) is None
    finally:
        spark.conf.unset(BROADCAST_LIMIT_CONF)

import numpy as np
import pytest
from pyspark.sql import functions as F

import restate
from conftest import SMALL, weights_of
from textgrove.operators import bisect as bi
from textgrove.operators import kmeans as km
from textgrove.operators import report, weights
from textgrove.operators.bisect import bisect
from textgrove.operators.criteria import gain, split_score, unsplit_score
from textgrove.plans.documents import document_corpus
from textgrove.queries import QUERIES
from textgrove.workspace import BROADCAST_LIMIT_CONF, close_workspaces

# Two small sets with a given split and their scores, worked out by hand.
CASE_A = (
    {1: [1, 0], 2: [1, 0], 3: [0, 1]},
    [[1, 2], [3]],
    dict(i2=3.0, i1=1.666667, e1=1.341641, h1=2.236068, h2=1.242260, sse=0.0),
    dict(i2=2.236068, i1=1.666667, sse=1.333333),
    dict(i2=0.763932, i1=0.0),
)
CASE_B = (
    {1: [3, 0, 0], 2: [2, 1, 0], 3: [0, 1, 1], 4: [0, 0, 2]},
    [[1, 2], [3, 4]],
    dict(i2=3.788455, i1=1.795355, e1=1.423273, h1=2.661792, h2=1.261428, sse=2.0),
    dict(i2=2.741882, i1=1.879480, sse=10.5),
    dict(i2=1.046573, i1=-0.084124),
)


@pytest.mark.parametrize("case", [CASE_A, CASE_B])
def test_criteria(spark, case):
    vectors, groups, splits, unsplits, gains = case
    rows = weights_of(spark, vectors)
    classes = spark.createDataFrame(
        [(d, k) for k, docs in enumerate(groups) for d in docs], "doc_id long, cluster int"
    )
    centres = report.cluster_centroids(rows, classes).withColumnRenamed("cluster", "k")
    n = len(vectors)
    g = np.mean([np.array(v, float) for v in vectors.values()], axis=0)
    E = [
        restate.cos(np.mean([np.array(vectors[d], float) for d in docs], axis=0), g)
        for docs in groups
    ]
    S = {}
    for metric in ("cosine", "euclid"):
        found = km.assign(rows, centres, 2, metric)
        sides = {r.k: r.s for r in found.groupBy("k").agg(F.sum("score").alias("s")).collect()}
        S[metric] = [sides[0], sides[1]]
    for criterion, value in splits.items():
        side = S["euclid" if criterion == "sse" else "cosine"]
        assert split_score(criterion, side, E, n) == pytest.approx(value, abs=1e-6)
    root = classes.select("doc_id", F.lit(1).alias("cluster"))
    whole = report.cluster_cohesion(rows, root).first()
    for criterion, value in unsplits.items():
        got = unsplit_score(criterion, whole.cohesion, whole.sse, n, None)
        assert got == pytest.approx(value, abs=1e-6)
        if criterion in gains:
            worth = gain(criterion, splits[criterion], got)
            assert worth == pytest.approx(gains[criterion], abs=2e-6)


def test_similarities_to_two_centres(spark):
    rows = weights_of(spark, CASE_B[0])
    classes = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "doc_id long, cluster int")
    centres = report.cluster_centroids(rows, classes).withColumnRenamed("cluster", "k")
    got = {r.doc_id: (r.k, r.score) for r in km.assign(rows, centres, 2).collect()}
    want = {1: (0, 0.980581), 2: (0, 0.964764), 3: (1, 0.894427), 4: (1, 0.948683)}
    for doc, (k, value) in want.items():
        assert got[doc] == (k, pytest.approx(value, abs=1e-6))


def test_ties_and_zero_vectors_go_to_the_first_centre(spark):
    rows = spark.createDataFrame(
        [(1, 0, 1.0), (2, 1, 0.0), (3, 2, 1.0)], "doc_id long, term_id int, w double"
    )
    centres = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0)], "k int, term_id int, w double")
    got = {r.doc_id: (r.k, r.score) for r in km.assign(rows, centres, 2).collect()}
    assert got == {1: (0, 1.0), 2: (0, 0.0), 3: (0, 0.0)}


def dense(embeddings):
    return {
        r.vec_id: np.array(r.embedding, dtype=np.float32).astype(float)
        for r in embeddings.collect()
    }


@pytest.fixture(scope="module")
def vectors(embeddings):
    return dense(embeddings)


def embedding_weights(embeddings):
    return weights.explode_dense(embeddings, "vec_id", "embedding")


@pytest.mark.parametrize("metric,k,restarts", [("cosine", 2, 3), ("euclid", 5, 2)])
def test_kmeans_matches_restatement(spark, embeddings, vectors, metric, k, restarts):
    criterion = "i2" if metric == "cosine" else "sse"
    result = km.kmeans(
        embedding_weights(embeddings), k, metric, max_iter=3, restarts=restarts, seed=11
    )
    docs = sorted(vectors)
    runs = []
    for r in range(restarts):
        centres, found = restate.kmeans(vectors, docs, 1, r, k, metric, 3, 11)
        total = sum(s for _, s in found.values())
        runs.append((-total if metric == "cosine" else total, r, centres, found))
    _, r, centres, found = min(runs, key=lambda x: x[:2])
    assert result.summary["restart"] == r
    got = {row.doc_id: (row.k, row.score) for row in result.assign.collect()}
    assert {d: v[0] for d, v in got.items()} == {d: v[0] for d, v in found.items()}
    assert all(got[d][1] == pytest.approx(found[d][1], abs=1e-9) for d in docs)
    for row in result.centres.collect():
        assert row.w == pytest.approx(centres[row.k][row.term_id], abs=1e-9)
    assert criterion == ("i2" if metric == "cosine" else "sse")


def test_kmeans_runs_to_convergence(spark, embeddings):
    space = km.prepare(embedding_weights(embeddings))
    free = km.kmeans(space, 3, "euclid", max_iter=None, eps=1e-5, restarts=2)
    assert free.summary["shift"] <= 1e-5
    steps = free.summary["iterations"]
    fixed = km.kmeans(space, 3, "euclid", max_iter=steps, eps=None, restarts=2)
    join = free.assign.join(fixed.assign.withColumnRenamed("k", "other"), "doc_id")
    assert join.where("k <> other").count() == 0


def test_empty_side_keeps_its_centre_and_ranks_last(spark):
    # Node 1, seed 7: with three copies of one vector every restart leaves a side empty.
    rows = weights_of(spark, {1: [1, 1], 2: [1, 1], 3: [1, 1]})
    result = km.kmeans(rows, 2)
    assert {(r.k, r.n) for r in result.scores.where("restart = 0").collect()} == {(0, 3), (1, 0)}
    assert result.summary["score"] is None
    assert result.centres.where("k = 1").count() == 2


@pytest.mark.parametrize("criterion", ["i1", "i2", "e1", "h1", "h2", "sse", "largest"])
def test_bisect_matches_restatement(spark, embeddings, vectors, criterion):
    tree = bisect(embedding_weights(embeddings), 6, criterion, seed=7)
    nodes, gains = restate.bisect(vectors, 6, criterion)
    assert {r.doc_id: r.node for r in tree.classes.collect()} == nodes
    for row in tree.report.collect():
        want = gains[row.node]
        assert row.gain == (None if want is None else pytest.approx(want, abs=1e-7))


def test_bisect_parent_scores(spark, embeddings, vectors):
    tree = bisect(embedding_weights(embeddings), 5, "i2", unsplit="parent")
    nodes, gains = restate.bisect(vectors, 5, "i2", parent=True)
    assert {r.doc_id: r.node for r in tree.classes.collect()} == nodes
    assert {r.node: pytest.approx(r.gain, abs=1e-7) for r in tree.report.collect()} == gains


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_bisect_documents_matches_restatement(spark, documents):
    found = document_corpus(documents, df_min=5, df_max=100)
    space = found.space()
    vectors = {}
    for r in found.weights.collect():
        vectors.setdefault(r.doc_id, np.zeros(found.num_term))[r.term_id] = r.w
    tree = bisect(space, 6, "i2")
    nodes, _ = restate.bisect(vectors, 6, "i2")
    assert {r.doc_id: r.node for r in tree.classes.collect()} == nodes


def outcome(tree):
    rows = tree.report.orderBy("cluster").collect()
    return (
        [(r.cluster, r.node, r.n) for r in rows],
        sorted((r.doc_id, r.cluster) for r in tree.classes.collect()),
    )


def test_result_does_not_depend_on_how_it_is_computed(spark, embeddings, monkeypatch):
    rows = embedding_weights(embeddings).persist()
    want = outcome(bisect(rows, 6, "i2"))
    assert outcome(bisect(rows.repartition(5, "term_id"), 6, "i2", lookahead=1)) == want
    monkeypatch.setattr(bi, "SHRINK_MIN_ROWS", 0)
    monkeypatch.setattr(bi, "SHRINK", 1)  # a source of its own for nearly every round
    tree = bisect(rows, 6, "i2", lookahead=2)
    assert outcome(tree) == want
    assert any("weights" in name for name in tree.space.work.tables[2:])
    monkeypatch.setattr(bi, "SHRINK_MIN_ROWS", 10**9)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for limit in ("0", "6000"):  # no centre table may be broadcast, or only in blocks of some terms
            spark.conf.set(BROADCAST_LIMIT_CONF, limit)
            assert outcome(bisect(rows, 6, "i2")) == want
    finally:
        spark.conf.unset(BROADCAST_LIMIT_CONF)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_full_tree_queries_match_restatement(spark, vectors, documents):
    """The two registered runs to 20 clusters, on all rows of the smallest tables."""
    nodes, _ = restate.bisect(vectors, 20, "h1")
    tree = {r.node: r for r in QUERIES["tree_embeddings"](spark, SMALL).collect()}
    sizes = {node: list(nodes.values()).count(node) for node in set(nodes.values())}
    assert {n: r.n for n, r in tree.items() if r.cluster is not None} == sizes

    found = document_corpus(documents)
    rows = {}
    for r in found.weights.collect():
        rows.setdefault(r.doc_id, np.zeros(found.num_term))[r.term_id] = r.w
    nodes, gains = restate.bisect(rows, 20, "i2")
    sizes = {node: list(nodes.values()).count(node) for node in set(nodes.values())}
    got = QUERIES["tree_documents"](spark, SMALL).collect()
    assert {r.node: r.n for r in got} == sizes
    for r in got:
        assert r.gain == (None if gains[r.node] is None else pytest.approx(gains[r.node], abs=1e-6))


def test_tree_invariants(spark, embeddings, vectors):
    tree = bisect(embedding_weights(embeddings), 8, "i2")
    report_rows = tree.report.collect()
    assert sum(r.n for r in report_rows) == len(vectors) == tree.classes.count()
    assert tree.classes.select("doc_id").distinct().count() == len(vectors)
    assert [r.n for r in report_rows] == sorted((r.n for r in report_rows), reverse=True)
    assert all(r.cohesion <= r.n + 1e-9 for r in report_rows)
    nodes = {r.node: r for r in tree.tree.collect()}
    assert len(nodes) == 15
    for r in nodes.values():
        if r.split_order is not None:
            assert nodes[2 * r.node].n + nodes[2 * r.node + 1].n == r.n
            assert nodes[2 * r.node].parent == nodes[2 * r.node + 1].parent == r.node
    direct = report.cluster_cohesion(tree.space.weights, tree.classes)
    cohesion = {r.cluster: r.cohesion for r in direct.collect()}
    for r in report_rows:
        assert r.cohesion == pytest.approx(cohesion[r.cluster], abs=1e-9)


def test_degenerate_inputs(spark):
    one = bisect(weights_of(spark, {5: [1, 2]}), 4)
    assert [(r.cluster, r.n, r.gain) for r in one.report.collect()] == [(1, 1, None)]
    # One-term cluster: cohesion equals its size; identical documents cannot be split.
    same = bisect(weights_of(spark, {d: [0, 2] for d in range(6)}), 4)
    (row,) = same.report.collect()
    assert (row.n, row.cohesion) == (6, pytest.approx(6.0))
    # Three different vectors give three clusters at most.
    few = bisect(weights_of(spark, {d: np.eye(3)[d % 3] for d in range(9)}), 8)
    assert few.summary["clusters"] <= 3


def test_string_ids(spark):
    rows = weights_of(spark, {d: [d % 2, 1 - d % 2, 0.1] for d in range(8)})
    text = rows.withColumn("doc_id", F.concat(F.lit("doc-"), "doc_id"))
    tree = bisect(text, 2)
    groups = {}
    for r in tree.classes.collect():
        groups.setdefault(r.cluster, set()).add(int(r.doc_id[4:]) % 2)
    assert sorted(map(sorted, groups.values())) == [[0], [1]]


def test_i1_stops_without_gain(embeddings):
    space = km.prepare(embedding_weights(embeddings))
    stopped = bisect(space, 12, "i1")
    free = bisect(space, 12, "i1", stop_no_gain=False)
    gains = [r.gain for r in stopped.report.collect()]
    assert 1 < stopped.summary["clusters"] < 12 == free.summary["clusters"]
    assert max(g for g in gains if g is not None) < 0


def test_centroid_over_all_documents(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "b c"), (3, "c c c d"), (4, "x"), (5, "y")], "doc_id int, text string")
    for basis, n in (("post", 3), ("pre", 5)):
        found = document_corpus(docs, df_min=2, n_basis=basis)
        space = found.space()
        sums = {r.term_id: r.s for r in found.weights.groupBy("term_id").agg(F.sum("w").alias("s")).collect()}
        assert space.num_doc == 3
        assert {r.term_id: r.g for r in space.centre.collect()} == {t: pytest.approx(s / n) for t, s in sums.items()}


def test_deep_nodes_split_like_others(monkeypatch, embeddings):
    """Below the numbers that fit, nodes get other ids; nothing else changes."""
    space = km.prepare(embedding_weights(embeddings))
    plain = bisect(space, 9, "largest")
    monkeypatch.setattr("textgrove.operators.bisect.NUMBER_BITS", 2)
    deep = bisect(space, 9, "largest")
    assert min(r.node for r in deep.tree.collect()) < 0
    members = lambda t: sorted((r.doc_id, r.cluster) for r in t.classes.collect())
    report = lambda t: [(r.cluster, r.n, r.gain and round(r.gain, 9), round(r.cohesion, 9)) for r in t.report.collect()]
    order = lambda t: [(r.split_order, r.n, r.cluster) for r in t.tree.collect()]
    assert members(deep) == members(plain) and report(deep) == report(plain) and order(deep) == order(plain)


def test_workspace_is_removed(spark, embeddings):
    space = km.prepare(embedding_weights(embeddings))
    assert spark.catalog.tableExists(f"{space.work.run}_weights")
    close_workspaces()
    assert not spark.catalog.tableExists(f"{space.work.run}_weights")


def test_separation_of_a_tree_is_that_of_its_first_split(embeddings):
    space = km.prepare(weights.explode_dense(embeddings, "vec_id", "embedding"))
    for criterion, metric in (("sse", "euclid"), ("i2", "cosine")):
        tree = bisect(space, 2, criterion, seed=7)
        plain = km.kmeans(space, 2, metric, seed=7)
        assert tree.summary["restart"] == plain.summary["restart"]
        assert tree.summary["separation"] == pytest.approx(plain.summary["separation"])

"""Shapes of the physical plans: where data moves, and where it must not."""

import re

import pytest

from conftest import SMALL
from textgrove import queries
from textgrove.operators import kmeans as km
from textgrove.operators import report, weights
from textgrove.operators.tokens import tokenize
from textgrove.workspace import BROADCAST_LIMIT_CONF, Workspace


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(text: str) -> list[str]:
    return re.findall(r"(?<!Broadcast)Exchange (\w+\([^)]*\)|SinglePartition)", text)


@pytest.fixture(scope="module")
def space(spark, embeddings):
    return km.prepare(weights.explode_dense(embeddings, "vec_id", "embedding"))


@pytest.fixture(autouse=True)
def _close(spark):
    """The module's space stays open until its tests are done."""
    yield


@pytest.fixture(scope="module")
def centres(space):
    return km._measure(space.work.write(km._seed_sums(space, space.docs, 2, 2, 7), "plan_seeds"), 2, 2)


def test_scoring_moves_no_weight_row(space, centres):
    text = plan(km.score_docs(space, space.docs, centres, 2, 2, "cosine"))
    assert shuffles(text) == []
    assert "BroadcastHashJoin" in text and "ShuffledHashJoin" in text
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_update_shuffles_partial_sums_only(space, centres):
    assigned = km.score_docs(space, space.docs, centres, 2, 2, "cosine")
    text = plan(km._sum_sides(space, assigned, 2, 2))
    (only,) = shuffles(text)
    assert only.startswith("hashpartitioning(node") and "term_id" in only
    assert re.search(r"Exchange.*\n[ :+\-]*HashAggregate\(keys=\[node.*partial_sum", text)


def test_scoring_without_broadcast_still_plans(spark, space, centres):
    from textgrove.workspace import BROADCAST_LIMIT_CONF

    spark.conf.set(BROADCAST_LIMIT_CONF, "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(km.score_docs(space, space.docs, centres, 2, 2, "cosine"))
    finally:
        spark.conf.unset(BROADCAST_LIMIT_CONF)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text or "ShuffledHashJoin [node" in text


def test_seeds_are_limited_before_the_exchange(space):
    text = plan(km.pick_seeds(space.docs, 2, 2, 7))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_seed_rows_are_pruned_at_the_scan(space):
    text = plan(space.table.where("doc_id IN (1, 2)"))
    assert "PushedFilters: [In(doc_id" in text


def test_ranking_is_limited_before_the_exchange(space):
    classes = space.docs.selectExpr("doc_id", "doc_id % 3 AS cluster")
    top = plan(report.cluster_terms(space.weights, classes, n=5))
    assert "Partial" in top and top.count("WindowGroupLimit") == 2


def test_tokens_move_as_raw_text_once(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = plan(weights.term_freq(tokenize(docs, "doc_id", "text")))
    (only,) = shuffles(text)
    assert only.startswith("hashpartitioning(doc_id")
    assert text.index("regexp_extract_all") < text.index("Exchange hashpartitioning")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


@pytest.mark.parametrize(
    "name", ["tf", "corpus_stats", "contingency", "nmi", "cooccurrence", "line_numbers", "topic_rows"]
)
def test_queries_use_no_cross_join(spark, name):
    text = plan(queries.QUERIES[name](spark, SMALL))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_every_query_has_a_distinct_name_and_callable(spark):
    assert len(queries.QUERIES) >= 60
    assert all(callable(f) for f in queries.QUERIES.values())


def test_weights_stay_where_centres_go_block_by_block(spark, space, monkeypatch):
    plans = []
    keep = Workspace.write_bucketed

    def noted(self, df, name, *rest):
        if name.startswith("dots_"):
            plans.append(plan(df))
        return keep(self, df, name, *rest)

    whole = km.split_nodes(space, space.docs, label="whole").assigned
    monkeypatch.setattr(Workspace, "write_bucketed", noted)
    spark.conf.set(BROADCAST_LIMIT_CONF, "4000")
    try:
        parts = km.split_nodes(space, space.docs, label="parts").assigned
    finally:
        spark.conf.unset(BROADCAST_LIMIT_CONF)
    assert len(plans) > 6 and not any(shuffles(p) for p in plans)
    rows = lambda t: sorted((r.doc_id, r.k_0, r.k_1, round(r.s_0, 9), round(r.s_1, 9)) for r in t.collect())
    assert rows(parts) == rows(whole)

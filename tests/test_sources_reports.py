import pytest
from pyspark.sql import functions as F

from conftest import SMALL, weights_of
from textgrove.operators import kmeans as km
from textgrove.operators import report, weights
from textgrove.operators.tokens import tokens_from_words
from textgrove.plans.documents import cluster_documents
from textgrove.plans.words import cluster_words
from textgrove.sources import readers, sinks


def write_lines(tmp_path, name, lines):
    path = tmp_path / name
    path.write_text("".join(line + "\n" for line in lines), encoding="utf-8")
    return str(path)


def test_token_rows_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([("d1", 'a "b" \\c'), ("d2", "é")], "doc_id string, text string")
    rows = tokens_from_words(lines, "doc_id", "text")
    sinks.write_tokens(rows, f"{tmp_path}/tokens", text=True)
    back = readers.read_token_rows(spark, f"{tmp_path}/tokens")
    want = sorted((r.doc_id, r.doc_len, r.term) for r in rows.collect())
    assert sorted((r.doc_id, r.doc_len, r.term) for r in back.collect()) == want
    sinks.write_tokens(rows, f"{tmp_path}/parquet")
    assert spark.read.parquet(f"{tmp_path}/parquet").count() == 4


def test_word_list_source(spark, tmp_path):
    path = write_lines(tmp_path, "words.txt", ["1\ta b a", "2\tc", "broken", "3\tx\ty"])
    rows = readers.read_word_lists(spark, path).collect()
    assert sorted((r.doc_id, r.pos, r.term) for r in rows) == [
        ("1", 0, "a"), ("1", 1, "b"), ("1", 2, "a"), ("2", 0, "c")
    ]


def test_bad_lines_are_rejected_and_counted(spark, tmp_path):
    path = write_lines(tmp_path, "texts.txt", ["1\tone", "two", "3\tthree\tfields", "4\t"])
    texts, rejected = readers.read_texts(spark, path)
    assert sorted((r.doc_id, r.text) for r in texts.collect()) == [("1", "one"), ("4", "")]
    assert sorted((r.line, r.num_fields) for r in rejected.collect()) == [
        ("3\tthree\tfields", 3), ("two", 1)
    ]


def test_topic_rows(spark, tmp_path):
    topics = spark.createDataFrame([("t1", "news"), ("t2", "sport")], "topic_id string, topic string")
    data = [("t1", 1, "x"), ("t2", 2, "y"), ("t1", 3, "z")]
    comments = spark.createDataFrame(data, "topic_id string, doc_id long, content string")
    comments.write.partitionBy("topic_id").parquet(f"{tmp_path}/comments")
    stored = spark.read.parquet(f"{tmp_path}/comments")
    assert sorted(r.doc_id for r in readers.topic_rows(topics, stored, "news").collect()) == [1, 3]
    assert readers.topic_rows(topics, stored, "none").count() == 0
    plan = readers.topic_rows(topics, stored, "news")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "PartitionFilters: [isnotnull(topic_id" in plan


def test_ingest(spark, tmp_path):
    rows = spark.createDataFrame([(7, "old", "long", "short")], "_id long, title string, content string, short_text string")
    done = sinks.ingest(rows, "_id", "short_text")
    assert done.select("doc_id", "title", "content").first() == (7, "", "short")
    sinks.write_texts(done, f"{tmp_path}/texts")
    assert spark.read.text(f"{tmp_path}/texts").first().value == "7\tshort"


def test_classes_and_labels(spark, tmp_path):
    classes = spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, cluster int")
    sinks.write_classes(classes, f"{tmp_path}/class")
    assert sorted(readers.read_classes(spark, f"{tmp_path}/class").collect()) == sorted(classes.collect())
    path = write_lines(tmp_path, "labels", ["a\t3"])
    assert readers.read_labels(spark, path).collect() == [("a", 3)]
    bad = write_lines(tmp_path, "bad", ["a\tthree"])
    with pytest.raises(Exception):
        readers.read_labels(spark, bad).collect()


def test_matrix_export(spark, tmp_path):
    vectors = {1: [0, 2.5, 0, 0, 7], 2: [1, 0, 0, 0, 0], 3: [0, 0, 0, 4, 0], 4: [1, 2, 3, 4, 5], 5: [0, 0, 0, 0, -1e-9]}
    sinks.write_matrix(weights_of(spark, vectors), 5, f"{tmp_path}/matrix")
    assert spark.read.text(f"{tmp_path}/matrix/header").first().value == "5 5"
    lines = [r.value.split("\t") for r in spark.read.text(f"{tmp_path}/matrix/rows").collect()]
    assert sorted([float(x) for x in line] for line in lines) == sorted(map(list, vectors.values()))


def test_matrix_lines_build_no_dense_arrays(spark):
    rows = weights_of(spark, {1: [0, 2.5], 2: [1, 0]})
    plan = weights.matrix_lines(rows, F.lit(2))._jdf.queryExecution().executedPlan().toString()
    assert "sequence(" not in plan and "map_from_entries" not in plan


def test_top_terms_and_samples(spark):
    rows = weights_of(spark, {1: [1, 3, 3], 2: [1, 0, 0], 3: [0, 0, 5]})
    classes = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "doc_id long, cluster int")
    vocab = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "term_id int, term string")
    top = report.cluster_terms(rows, classes, vocab, 2).collect()
    assert sorted((r.cluster, r.rank, r.term, r.w_sum) for r in top) == [
        (1, 1, "y", 3.0), (1, 2, "z", 3.0), (2, 1, "z", 5.0)
    ]
    texts = spark.createDataFrame(
        [(1, "old", 0), (1, "new", 1), (2, "two", 2), (3, "three", 3)], "doc_id long, text string, at int"
    )
    for clusters in (None, 2):
        got = report.cluster_samples(classes, texts, 1, clusters, order="at").collect()
        assert sorted((r.cluster, r.doc_id, r.text) for r in got) == [(1, 1, "new"), (2, 3, "three")]


def test_member_vectors(spark):
    rows = weights_of(spark, {1: [0, 3, 1]})
    classes = spark.createDataFrame([(1, 4)], "doc_id long, cluster int")
    assert report.member_vectors(rows, classes).collect() == [(4, 1, [1, 2], [3.0, 1.0])]


def test_document_run_end_to_end(spark, tmp_path):
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    path = f"{tmp_path}/run"
    tree, _ = cluster_documents(texts, path, top=5, cluster_num=4, df_min=3, df_max=100)
    summary = spark.read.parquet(f"{path}/summary/run").first()
    assert summary.clusters == 4 and summary.iterations == 2
    assert spark.read.parquet(f"{path}/summary/vocabulary").count() == summary.num_term
    stored = readers.read_report(spark, f"{path}/clusters")
    sizes = {r.cluster: r.n for r in stored["report"].collect()}
    members = stored["members"].groupBy("cluster").count().collect()
    assert {r.cluster: r["count"] for r in members} == sizes
    assert readers.read_classes(spark, f"{path}/class").count() == summary.num_doc
    assert stored["cluster_terms"].where("w_sum = 0").count() == 0
    top = spark.read.parquet(f"{path}/top_terms")
    assert top.groupBy("cluster").count().agg(F.max("count")).first()[0] == 5
    sample = spark.read.parquet(f"{path}/samples").join(texts, ["doc_id", "text"])
    assert sample.count() == sum(min(5, n) for n in sizes.values())


def test_word_run_end_to_end(spark, tmp_path):
    lines = [["red", "green", "blue"], ["green", "blue"], ["cat", "dog"], ["dog", "cat", "cow"]] * 3
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, words array<string>")
    tree, network = cluster_words(df, f"{tmp_path}/words", cluster_num=2, init_restarts=4)
    groups = {}
    for r in tree.classes.collect():
        groups.setdefault(r.cluster, set()).add(r.doc_id)
    assert sorted(map(sorted, groups.values())) == [["blue", "green", "red"], ["cat", "cow", "dog"]]
    assert spark.read.parquet(f"{tmp_path}/words/cooccurrence").count() == network.cooc.count()


def test_summary_tables(spark, tmp_path, embeddings):
    rows = weights.explode_dense(embeddings, "vec_id", "embedding")
    result = km.kmeans(rows, 2)
    sinks.write_summary(
        spark, result.summary, f"{tmp_path}/s", centres=result.centres, cluster_score=result.scores
    )
    assert spark.read.parquet(f"{tmp_path}/s/run").first().num_doc == 500
    assert spark.read.parquet(f"{tmp_path}/s/cluster_score").agg(F.sum("n")).first()[0] == 1000

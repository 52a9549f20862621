"""Plans that start from stored files, written and read back."""

from pyspark.sql import functions as F

from textgrove.plans import stored
from textgrove.plans.documents import cluster_documents, partition_documents
from textgrove.plans.words import cluster_words
from textgrove.sources import readers

SMALL = "/root/testdata/sf0.001"


def test_topic_to_tokens_to_matrix(spark, tmp_path):
    topics = spark.createDataFrame([(1, "tea"), (2, "rain")], "topic_id int, topic string")
    rows = [(10, 1, "green tea, black tea"), (11, 1, "a cup"), (12, 2, "wet shoes")]
    comments = spark.createDataFrame(rows, "comment_id long, topic_id int, text string")
    lexicon = spark.createDataFrame([("tea", "n"), ("cup", "n"), ("green", "a")], "term string, tag string")
    tokens = stored.ingest_topic(topics, comments, "tea", f"{tmp_path}/tea", lexicon)
    found = sorted((r.doc_id, r.doc_len, r.term) for r in tokens.collect())
    assert found == [("10", 2, "tea"), ("10", 2, "tea"), ("11", 1, "cup")]
    corpus = stored.token_matrix(spark, f"{tmp_path}/tea/tokens", f"{tmp_path}/matrix")
    assert corpus.num_term == 2
    assert spark.read.text(f"{tmp_path}/matrix/header").first()[0] == "2 2"
    lines = [r.value.split("\t") for r in spark.read.text(f"{tmp_path}/matrix/rows").collect()]
    assert sorted(map(len, lines)) == [2, 2]


def test_classes_scored_from_files(spark, tmp_path):
    for name, text in (("class", "a\t1\nb\t1\nc\t2\n"), ("label", "a\t1\nb\t1\nc\t2\n")):
        (tmp_path / name).write_text(text)
    score = stored.score_classes(spark, f"{tmp_path}/class", f"{tmp_path}/label", f"{tmp_path}/nmi", 2)
    assert abs(score.first().nmi - 1) < 1e-9
    cells = spark.read.parquet(f"{tmp_path}/nmi/cells")
    assert sorted((r.cluster, r.label, r.n) for r in cells.collect()) == [(1, 1, 2), (1, 2, 0), (2, 1, 0), (2, 2, 1)]


def test_stored_run_described(spark, tmp_path):
    texts = spark.read.parquet(f"{SMALL}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), "text")
    run = f"{tmp_path}/run"
    tree, tables = cluster_documents(texts, run, top=4, cluster_num=2)
    again = stored.describe_run(spark, run, texts, f"{tmp_path}/more", top=4)
    for name in ("top_terms", "samples"):
        columns = sorted(tables[name].columns)
        want = tables[name].select(columns)
        assert sorted(map(str, again[name].select(columns).drop("w_sum").collect())) == sorted(
            map(str, want.drop("w_sum").collect())
        )
    members = readers.read_report(spark, f"{run}/clusters")["members"]
    assert members.where("size(idx) > 0 AND size(idx) = size(val)").count() == texts.count()
    centres = spark.read.parquet(f"{run}/summary/centres")
    scores = spark.read.parquet(f"{run}/summary/cluster_score")
    assert scores.agg(F.sum("n")).first()[0] == texts.count()
    # the sides' centres, weighted by their sizes, are the global centroid
    whole = spark.read.parquet(f"{run}/summary/global_centre")
    mean = centres.join(scores, "k").groupBy("term_id").agg((F.sum(F.expr("w * n")) / texts.count()).alias("m"))
    assert mean.join(whole, "term_id", "full").where("m IS NULL OR abs(m - g) > 1e-9").count() == 0


def test_word_report(spark, tmp_path):
    lines = [["red", "green", "blue"], ["cat", "dog", "cow"]] * 3
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, words array<string>")
    cluster_words(df, f"{tmp_path}/w", cluster_num=2)
    found = readers.read_report(spark, f"{tmp_path}/w/clusters")
    assert found["report"].agg(F.sum("n")).first()[0] == 6
    assert found["members"].count() == 6


def test_flat_clustering_stored(spark, tmp_path):
    rows = [(1, "tea cup tea"), (2, "tea cup"), (3, "rain cloud rain"), (4, "cloud rain"), (5, "tea tea")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    run = f"{tmp_path}/flat"
    result, tables = partition_documents(texts, run, clusters=2, top=1, max_iter=3, restarts=2)
    classes = {r.doc_id: r.cluster for r in readers.read_classes(spark, f"{run}/class").collect()}
    assert classes["1"] == classes["2"] == classes["5"] != classes["3"] == classes["4"]
    found = readers.read_report(spark, f"{run}/clusters")
    assert sorted(r.n for r in found["report"].collect()) == [2, 3]
    assert {(r.doc_id, r.cluster) for r in found["members"].collect()} == {(int(d), c) for d, c in classes.items()}
    top = {r.cluster: r.term for r in spark.read.parquet(f"{run}/top_terms").collect()}
    assert top[classes["3"]] == "rain" and top[classes["1"]] in ("tea", "cup")
    samples = spark.read.parquet(f"{run}/samples").collect()
    assert sorted(r.doc_id for r in samples) == [1, 3]
    assert spark.read.parquet(f"{run}/summary/run").first().num_doc == 5

"""What grows with the input: files, tasks, broadcasts and rows of the larger tables."""

import re
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from textgrove import queries, workspace
from textgrove.operators import network, report, tokens, weights
from textgrove.operators.bisect import bisect
from textgrove.plans.documents import document_corpus, partition_documents
from textgrove.sources import readers, sinks
from textgrove.workspace import BROADCAST_LIMIT_CONF, Workspace, bucket_count


def test_matrix_files_follow_the_non_zero_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "MATRIX_CELLS", 50_000)
    weights = spark.range(40).selectExpr("id AS doc_id", "CAST(id AS INT) AS term_id", "0.5D AS w")
    sinks.write_matrix(weights, 5000, f"{tmp_path}/matrix")
    files = [f for f in (tmp_path / "matrix/rows").iterdir() if f.name.startswith("part-")]
    # The grid takes 800,000 bytes; four files are asked for, empty ones may be missing.
    assert 1 < len(files) <= 4 and sum(f.stat().st_size for f in files) < 40_000
    lines = [r.value.split("\t") for r in spark.read.text(f"{tmp_path}/matrix/rows").collect()]
    assert sorted(line.index("0.5") for line in lines) == list(range(40)) and {len(line) for line in lines} == {5000}
    assert spark.read.text(f"{tmp_path}/matrix/header").first().value == "40 5000"


def test_matrix_is_read_by_columns(spark, tmp_path):
    (tmp_path / "matrix/rows").mkdir(parents=True)
    lines = ["0.0\t1.5\t0.0\t-2.0", "0.0\t1.0E-5\t0.0\t2.0", "0.0\t0.0\t0.0\t0.0", "-0.0\t0\t0.000\t3.0", "7.25"]
    (tmp_path / "matrix/rows/part-0").write_text("\n".join(lines) + "\n")
    # Every cell of the grid used to become a row.
    rows = readers.matrix_columns(spark, f"{tmp_path}/matrix")
    assert "Generate" not in rows._jdf.queryExecution().executedPlan().toString()
    found = rows.groupBy("term_id").agg(F.sum("docs").alias("docs"), F.sum("w").alias("w")).collect()
    assert sorted((r.term_id, r.docs, round(r.w, 9)) for r in found) == [(0, 1, 7.25), (1, 2, 1.50001), (2, 0, 0.0), (3, 3, 3.0)]


def test_tasks_follow_the_text(spark, monkeypatch):
    monkeypatch.setattr(tokens, "TASK_BYTES", 10_000)
    docs = spark.range(200).selectExpr("id AS doc_id", "repeat('word ', 100) AS text")
    rows = tokens.tokenize(docs, "doc_id", "text")
    # 100,000 bytes; AQE used to merge them into one task.
    found = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("doc_id").alias("docs")).collect()
    assert len(found) == 10 and sum(r.docs for r in found) == 200


def _limited(spark, limit, build):
    spark.conf.set(BROADCAST_LIMIT_CONF, str(limit))
    try:
        return build()
    finally:
        spark.conf.unset(BROADCAST_LIMIT_CONF)


def test_large_vocabularies_go_block_by_block(spark):
    texts = spark.range(60).selectExpr("id AS doc_id", "concat_ws(' ', 'all', char(97 + id % 26), char(97 + id % 5)) AS text")
    rows = lambda t: sorted((r.doc_id, r.term_id, round(r.w, 9)) for r in t.collect())
    want = rows(document_corpus(texts).weights)
    # Eight terms a broadcast: the join used to shuffle all term frequencies here.
    weights = _limited(spark, 8 * 88, lambda: document_corpus(texts).weights)
    plan = weights._jdf.queryExecution().executedPlan().toString()
    assert rows(weights) == want and "Join" not in plan.split("Subquery")[0]


def test_rounds_keep_their_width_beyond_one_broadcast(spark):
    rows = [(d, (d * 7 + t) % 23, float(1 + (d + t) % 4)) for d in range(60) for t in range(5)]
    table = spark.createDataFrame(rows, "doc_id long, term_id int, w double")
    whole = bisect(table, 6)
    # 30 rows a broadcast, up to 46 in the centres of two children: before, each leaf had a round of its own.
    parts = _limited(spark, 30 * 112, lambda: bisect(table, 6))
    found = lambda tree: sorted((r.doc_id, r.cluster) for r in tree.classes.collect())
    assert found(parts) == found(whole) and parts.summary["rounds"] < 6


def test_pairs_of_words_are_shuffled_as_numbers(spark):
    lines = spark.createDataFrame([(0, ["b", "a", "b"]), (1, ["a"])], "doc_id long, words array<string>")
    rows = network.cooccurrence(lines)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    # Pairs used to be shuffled as two strings.
    assert "Exchange hashpartitioning(pair#" in plan and "Exchange hashpartitioning(w1" not in plan
    assert sorted((r.w1, r.w2, r.n) for r in rows.collect()) == [("a", "a", 2), ("a", "b", 2), ("b", "a", 2), ("b", "b", 4)]


def test_buckets_hold_what_a_task_sorts(spark):
    # Eight million rows a bucket took 1,280 MB of a task.
    assert bucket_count(spark, 160_000_000) == 80


def test_raw_weights_of_a_run_are_joined_without_a_shuffle(spark, tmp_path, monkeypatch):
    texts = spark.createDataFrame([(1, "tea cup tea"), (2, "tea cup"), (3, "rain cloud"), (4, "rain")], "doc_id long, text string")
    plans = []
    keep = sinks.write_summary

    def noted(*tables):
        plans.append(tables[-1]._jdf.queryExecution().executedPlan().toString())
        keep(*tables)

    monkeypatch.setattr(sinks, "write_summary", noted)
    # One term a broadcast, which used to leave this join to a shuffle of all term frequencies.
    _limited(spark, 88, lambda: partition_documents(texts, f"{tmp_path}/run", clusters=2))
    assert "Join" not in plans[0]
    raw = spark.read.parquet(f"{tmp_path}/run/summary/raw_weights").collect()
    found = sorted((r.term, r.doc_id, round(r.tf, 6), r.df) for r in raw)
    assert found == [
        ("cloud", 3, 0.5, 1), ("cup", 1, 0.333333, 2), ("cup", 2, 0.5, 2), ("rain", 3, 0.5, 2), ("rain", 4, 1.0, 2),
        ("tea", 1, 0.666667, 2), ("tea", 2, 0.5, 2),
    ]


def test_blocks_of_terms_read_their_own_pages(spark, tmp_path, monkeypatch):
    words = spark.range(300).selectExpr("id AS doc_id", "concat('w', id % 97) AS term", "0.5D AS tf")
    df = words.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    work = Workspace(spark)
    tf = weights.store_term_freq(words.coalesce(2), work)
    for file in (f for f in Path(f"{work.root}/tf").iterdir() if f.suffix == ".parquet"):
        slots = pq.read_table(file)["slot"].to_pylist()
        assert slots == sorted(slots) and len(set(slots)) > 1
    reads = []
    keep = Workspace.write

    def noted(self, rows, name):
        reads.append(rows._jdf.queryExecution().executedPlan().toString())
        return keep(self, rows, name)

    monkeypatch.setattr(Workspace, "write", noted)
    rows = _limited(spark, 10 * 80, lambda: sinks.weight_inputs(tf, df, df.count(), work))
    # Each block used to test the hash of every stored term.
    assert len(reads) > 9 and all("GreaterThanOrEqual(slot" in r and "LessThanOrEqual(slot" in r for r in reads)
    want = words.join(df, "term").select("term", "doc_id", "tf", "df")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, want.collect()))


def _reported(spark, tmp_path, monkeypatch, name):
    """Tasks into which a report query deals weights and classes by document, for 296 weights and 20 a task."""
    texts = spark.range(100).selectExpr(
        "id AS doc_id", "concat_ws(' ', 'all', char(97 + id % 26), char(97 + id % 5 + 10)) AS text", "if(id % 3 = 0, 'en', 'fr') AS lang"
    )
    texts.write.parquet(f"{tmp_path}/documents.parquet")
    want = queries.QUERIES[name](spark, str(tmp_path)).collect()
    monkeypatch.setattr(workspace, "ROWS_PER_BUCKET", 20)
    rows = queries.QUERIES[name](spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    tasks = re.findall(r"hashpartitioning\(doc_id#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)
    assert sorted(map(str, rows.collect())) == sorted(map(str, want)) and want
    return [int(n) for n in tasks]


@pytest.mark.parametrize("name", ["cluster_report", "cluster_vectors", "cluster_terms"])
def test_report_tasks_follow_the_weights(spark, tmp_path, monkeypatch, name):
    # All weights used to be sorted by document in a fixed number of partitions, eight here.
    assert _reported(spark, tmp_path, monkeypatch, name) == [15, 15]

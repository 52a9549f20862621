"""The pipeline and the registered queries."""

from collections import Counter

import pytest

import check_oracles
import corpus_pipeline
from tables import SMALL, edge, empty  # noqa: F401
from test_operators import ITEMS, plain_contamination, plain_groups, texts_of
from textgrove.llm import oracles, queries, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = corpus_pipeline.toxicity(spark, docs, SMALL)
    known = spark.read.parquet(f"{SMALL}/labels.parquet")
    bad = toxicity.toxicity(docs, known).filter("predicted = 1").count()
    assert kept.columns == COLUMNS and kept.count() == docs.count() - bad
    once = corpus_pipeline.dedup(spark, docs, SMALL)
    groups = plain_groups(texts_of(docs))
    assert once.columns == COLUMNS
    assert sorted(r.doc_id for r in once.collect()) == sorted(d for d, _, c in groups if d == c)
    clean = corpus_pipeline.decontamination(spark, docs, SMALL)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    hit = plain_contamination(texts_of(docs), items)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r[0] for r in hit if not r[-1])
    private = corpus_pipeline.personal_data(spark, docs, SMALL)
    assert private.columns == COLUMNS and private.count() == docs.count()
    assert private.filter("text RLIKE '@mail[0-9]'").count() == 0


def test_run(spark, tmp_path):
    found = corpus_pipeline.run(spark, SMALL)
    rows = found.collect()
    assert len(rows) and all(r.n_tokens == len(r.ids) for r in rows)
    assert len({r.doc_id for r in rows}) == len(rows)


def test_stages_on_awkward_tables(spark, edge, empty, tmp_path):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (edge, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            docs.count()


@pytest.mark.parametrize("name", oracles.ORACLES)
def test_sql(spark, name):
    con = check_oracles.connect(SMALL)
    outcome = check_oracles.compare(spark, con, SMALL, name, oracles.ORACLES[name])
    assert outcome.startswith("ok"), outcome


def test_names():
    numbers = Counter(name.split("_")[0] for name in queries.QUERIES)
    assert numbers == Counter([f"op{n}" for n in range(1, 14)] + ["pipeline"])

"""The registered queries of the ten operators; each reads whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from textgrove.llm import bpe, decontaminate, divergence, hard_negatives, language_id, merkle
from textgrove.llm import ngram_join, quality_rank, simhash, surrogates, token_counts, toxicity, url_rules

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SURROGATE_KEY = "textgrove-surrogates-1"
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _documents(spark, sf):
    return _table(spark, sf, "documents")


def op1_simhash(spark, sf):
    return simhash.simhash_groups(_documents(spark, sf))


def op2_bpe_round_trip(spark, sf):
    return bpe.round_trip(_documents(spark, sf), RANKS)


def op3_decontaminate(spark, sf):
    found = decontaminate.contamination(_documents(spark, sf), _table(spark, sf, "benchmark"))
    return decontaminate.digest(found)


def op4_quality(spark, sf):
    return quality_rank.quality(_documents(spark, sf), _table(spark, sf, "labels"))


def op5_toxicity(spark, sf):
    return toxicity.toxicity(_documents(spark, sf), _table(spark, sf, "labels"))


def op6_token_counts(spark, sf):
    return token_counts.count_tokens(_documents(spark, sf), TOKENIZER)


def op7_surrogates(spark, sf):
    replaced = surrogates.replaced(_documents(spark, sf), SURROGATE_KEY)
    return replaced.select("doc_id", "n_entities", "text")


def op8_url_rules(spark, sf):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(_table(spark, sf, "pages"), rules)


def op9_divergence(spark, sf):
    rated = divergence.rate(_documents(spark, sf))
    return rated.drop("class_distance", "word_distance")


def op10_language_id(spark, sf):
    return language_id.identify(_documents(spark, sf))


def op11_hard_negatives(spark, sf):
    vectors = _table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", shifted))


def op12_merkle(spark, sf):
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = _documents(spark, sf).select(*columns)
    where = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    changed = {"n_chars": F.col("n_chars") + 1}
    found = merkle.audited(docs, columns, changed, where, "lang", "doc_id")
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_ngram_join(spark, sf):
    return ngram_join.ngram_join(_documents(spark, sf))


def pipeline(spark, sf):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash,
        op2_bpe_round_trip,
        op3_decontaminate,
        op4_quality,
        op5_toxicity,
        op6_token_counts,
        op7_surrogates,
        op8_url_rules,
        op9_divergence,
        op10_language_id,
        op11_hard_negatives,
        op12_merkle,
        op13_ngram_join,
        pipeline,
    )
}

"""A corpus cleaned and tokenized: the operators of textgrove.llm in a row.

STAGES are (name, function) pairs; each function takes (spark, docs, folder of tables) and returns a
DataFrame. ``run`` applies them to the documents; every stage's result is written to the shared folder
and read back before the next one starts. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers

from textgrove.llm.bpe import round_trip
from textgrove.llm.decontaminate import decontaminate
from textgrove.llm.simhash import near_dedup
from textgrove.llm.surrogates import pseudonymise
from textgrove.llm.toxicity import drop_toxic
from textgrove.workspace import Workspace

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SURROGATE_KEY = "textgrove-surrogates-1"


def toxicity(spark, docs, sf_dir):
    """Rows judged toxic go, each by its own text; rows without an id, repeated and empty ones are judged alike."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup(spark, docs, sf_dir):
    """One row of each group of near copies by SimHash (three-word shingles, two bits) stays, that with the smallest id."""
    return near_dedup(docs)


def decontamination(spark, docs, sf_dir):
    """Rows that contain a window of a benchmark item go; rows without text or id hold none or count like others."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark, docs, sf_dir):
    """Personal data and secrets are replaced by surrogates; all rows stay, null and empty texts as they are."""
    return pseudonymise(docs, SURROGATE_KEY)


def tokens(spark, docs, sf_dir):
    """Token ids of each row, with their number and digests of ids and decoded text; null counts as empty."""
    return round_trip(docs, RANKS, with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]
# Letter models, XXH64 fingerprints and merges by rank cannot be written in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents; the rows of the last one."""
    work = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.write(stage(spark, docs, sf_dir), name)
    return docs

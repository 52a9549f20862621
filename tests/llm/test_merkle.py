"""The Merkle manifest against a recursive restatement."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tables import SMALL, clashing, edge, empty  # noqa: F401
from textgrove.llm import merkle
from textgrove.llm.queries import op12_merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def grown(digests, arity):
    """The root, and per leaf the (left, right) siblings up to it."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        runs = [level[i : i + arity] for i in range(0, len(level), arity)]
        for path, i in zip(paths, at):
            run, slot = runs[i // arity], i % arity
            path.append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        level, at = [h(*run) for run in runs], [i // arity for i in at]
    return level[0], paths


def plain(rows, arity=2, tamper=True):
    groups = defaultdict(list)
    for r in rows:
        leaf = h(*(encoded(r[c]) for c in COLUMNS))
        copy = leaf
        if tamper and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None:
            copy = h(*(encoded(r[c] + 1 if c == "n_chars" else r[c]) for c in COLUMNS))
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf, copy, r["doc_id"]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: grown([x[2] for x in sorted(groups[g])], arity) for g in order}
    root, above = grown([trees[g][0] for g in order], arity)
    found = Counter()
    for g, up in zip(order, above):
        for (_, _, leaf, copy, doc_id), path in zip(sorted(groups[g]), trees[g][1]):
            path = path + up
            folded = copy
            for left, right in path:
                folded = h(left, folded, right)
            found[doc_id, leaf, trees[g][0], root, h(*(x + y for x, y in path)), folded, folded == root] += 1
    return found


def found(rows, arity):
    made = merkle.manifest(rows.withColumn("leaf", merkle.leaf(*COLUMNS)), "lang", "doc_id", arity=arity)
    made = made.withColumn("proof", merkle.proof_digest()).withColumn("folded", merkle.fold(F.col("leaf")))
    made = made.select("doc_id", "leaf", "subroot", "root", "proof", "folded", F.expr("folded = root"))
    return Counter(map(tuple, made.collect()))


@pytest.mark.parametrize("arity", [2, 3])
def test_manifest(spark, edge, empty, clashing, arity):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for rows in (docs, edge) if arity > 2 else (edge, edge.limit(1)):
        assert found(rows, arity) == plain([r.asDict() for r in rows.collect()], arity, tamper=False)
    assert not found(empty, arity)
    leaves = clashing.withColumn("leaf", merkle.leaf(*COLUMNS)).withColumn("root", F.lit(1))
    assert merkle.manifest(leaves, "lang", "doc_id", arity=arity).columns == [*clashing.columns, "leaf", "subroot", "root", "path"]


def test_audit_finds_what_was_changed(spark, edge, tmp_path):
    edge.write.parquet(f"{tmp_path}/documents.parquet")
    rows = op12_merkle(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, rows)) == plain([r.asDict() for r in edge.collect()])

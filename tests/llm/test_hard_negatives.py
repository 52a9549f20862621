"""Hard negatives against brute force."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textgrove.llm import hard_negatives as op

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, every=100, positives=5, negatives=10):
    usable = [
        (i, label, [math.floor(256 * x) for x in v])
        for i, v, label in rows
        if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)
    ]
    found = Counter()
    for at, (i, label, v) in enumerate(usable):
        if i % every:
            continue
        scored = sorted((-sum(map(lambda a, b: a * b, v, w)), j, other) for k, (j, other, w) in enumerate(usable) if k != at)
        for p, positive, _ in [s for s in scored if s[2] == label][:positives]:
            hard = [(-s, j) for s, j, other in scored if other != label and 30 * -p <= 100 * -s <= 90 * -p]
            for rank, (score, j) in enumerate(hard[:negatives], 1):
                found[i, positive, rank, j, -p, score] += 1
    return found


def mined(spark, rows, **options):
    table = spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit("x")).withColumn("v", F.lit(1)).repartition(3)
    return Counter(map(tuple, op.hard_negatives(table, **options).collect()))


def vectors(n, dims=6, seed=1):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(5, dims))
    rows = []
    for i in range(n):
        x = centres[i % 5] + draw.normal(size=dims) * 0.8
        rows.append((i, [float(c) for c in np.round(x / np.linalg.norm(x), 2)], int(draw.integers(0, 4))))
    return rows


@pytest.mark.parametrize("block, part", [(512, 1 << 24), (16, 1 << 24), (7, 500)])
def test_hard_negatives(spark, monkeypatch, block, part):
    monkeypatch.setattr(op, "BLOCK", block)
    monkeypatch.setattr(op, "ANCHOR_BYTES", part)
    monkeypatch.setattr(op, "HELD", 40)
    rows = vectors(300)
    assert mined(spark, rows, every=20) == plain(rows, every=20)


def test_awkward_rows(spark):
    rows = vectors(120, dims=4, seed=5)
    rows += rows[:60:20] + [(100, rows[3][1], rows[0][2]), (100, rows[3][1], rows[0][2])]  # repeated rows, repeated anchors
    rows += [(None, [1.0], 1), (200, None, 1), (300, [1.0, None], 2), (400, [float("nan")], 1), (500, [float("inf"), 1.0], 1)]
    rows += [(600, [0.5], 1), (601, [], 1), (700, [0.0, 0.0, 0.0, 0.0], 2), (701, [-1.0, -1.0], None), (-100, [0.9, 0.1], 3)]
    assert mined(spark, rows) == plain(rows)
    assert not mined(spark, [])
    assert not mined(spark, [(100, [], 1), (1, [], 1), (2, [], 2)]) - plain([(100, [], 1), (1, [], 1), (2, [], 2)])
    with pytest.raises(ValueError):
        mined(spark, [(100, [1e300], 1)])


def test_places_on_the_curve():
    for dims, bits in ((2, 3), (3, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        keys = [k.tobytes() for k in op.hilbert_keys(cells, bits)]
        path = cells[sorted(range(len(keys)), key=keys.__getitem__)]
        assert len(set(keys)) == len(keys) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_zone_maps_leave_out_far_blocks(spark):
    draw = np.random.default_rng(2)
    centres = np.eye(8)
    rows = [(i, [float(c) for c in centres[i % 8] + draw.normal(size=8) * 0.02], int(i % 3)) for i in range(4000)]
    vectors = op.integer_vectors(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label", 256.0)
    work = op.Workspace(spark)
    blocks, dims = op._blocks(vectors.coalesce(1), work)
    queries = op.Queries(op._anchors(blocks, 5, 100, dims).toArrow(), dims)
    shared = spark.sparkContext.broadcast(queries)
    read = sum(len(r.wanted) // 4 for r in op._choose(blocks, shared, dims).collect())
    assert 0 < read < 0.5 * len(queries.ids) * blocks.count()

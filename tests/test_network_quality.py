import math
import random
import re
from pathlib import Path

import pytest

import restate
from textgrove.operators import network, quality


def counts(spark, lines, **options):
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, words array<string>")
    rows = network.cooccurrence(df, **options).collect()
    assert len({(r.w1, r.w2) for r in rows}) == len(rows)
    return {(r.w1, r.w2): r.n for r in rows}


def test_short_line(spark):
    assert counts(spark, ["x y x".split()]) == {
        ("x", "x"): 4, ("x", "y"): 2, ("y", "x"): 2, ("y", "y"): 1
    }


def test_line_longer_than_the_window(spark):
    got = counts(spark, ["a b c d e f g h i j k a".split()])
    want = {"aa": 5, "ak": 4, "ka": 4, "ab": 3, "ba": 3, "bk": 2, "kk": 2, "bb": 1}
    assert {a + b: n for (a, b), n in got.items() if a + b in want} == want
    assert sum(got.values()) == 186


@pytest.mark.parametrize("block,segment", [(256, 1024), (3, 4)])
def test_against_enumeration(spark, monkeypatch, block, segment):
    """Also with tiny blocks and segments, copies of a line and lines of every length."""
    monkeypatch.setattr(network, "BLOCK", block)
    monkeypatch.setattr(network, "SEGMENT", segment)
    rng = random.Random(3)
    lines = [[rng.choice("abcdefghij") for _ in range(n)] for n in [1, 2, 9, 10, 11, 12, 30, 57]]
    lines += [lines[-1]] * 4 + [["z"], []]
    assert counts(spark, lines) == restate.cooccurrence(lines)


def test_word_weights_use_the_second_word(spark):
    df = spark.createDataFrame([(0, ["b", "a"])], "doc_id long, words array<string>")
    cooc = network.cooccurrence(df)
    vocab = network.word_vocabulary(cooc)
    rows = network.word_weights(cooc, vocab, 2).collect()
    assert sorted((r.doc_id, r.term_id, r.w) for r in rows) == [
        ("a", 0, 1.0), ("a", 1, 1.0), ("b", 0, 1.0), ("b", 1, 1.0)
    ]


def tables(spark, cells):
    """Class and label tables with the given {(cluster, label): n}."""
    rows, doc = [], 0
    for (c, h), n in cells.items():
        for _ in range(n):
            rows.append((doc, c, h))
            doc += 1
    df = spark.createDataFrame(rows, "doc_id long, cluster int, label int")
    return df.select("doc_id", "cluster"), df.select("doc_id", "label")


def test_small_table(spark):
    both = tables(spark, {(1, 1): 2, (2, 1): 1, (2, 2): 1})
    mixed = quality.nmi(*both, base="mixed").first()
    assert mixed.total == 4
    assert mixed.mi == pytest.approx(0.215762, abs=1e-6)
    assert (mixed.hx, mixed.hy) == pytest.approx((1.0, 0.811278), abs=1e-6)
    assert mixed.nmi == pytest.approx(0.238242, abs=1e-6)
    assert quality.nmi(*both).first().nmi == pytest.approx(0.343711, abs=1e-6)
    cells = {(r.cluster, r.label): r for r in quality.contingency(*both).collect()}
    assert set(cells) == {(1, 1), (2, 1), (2, 2)}
    assert cells[1, 1].pxpy == pytest.approx(0.5 * 0.75)
    assert sum(c.term for c in cells.values()) == pytest.approx(mixed.mi)


def test_dense_grid_and_labels_outside(spark):
    both = tables(spark, {(1, 1): 2, (2, 2): 1, (1, 9): 1})
    grid = quality.contingency(*both, class_num=2, dense=True).collect()
    assert {(r.cluster, r.label): r.n for r in grid} == {(1, 1): 2, (1, 2): 0, (2, 1): 0, (2, 2): 1}
    assert sum(r.p for r in grid) == pytest.approx(0.75)
    px, py = [0.5, 0.25], [0.5, 0.25]
    want = 0.5 * math.log(0.5 / (px[0] * py[0])) + 0.25 * math.log(0.25 / (px[1] * py[1]))
    assert quality.nmi(*both, class_num=2).first().mi == pytest.approx(want)


def test_repeated_ids_multiply(spark):
    classes = spark.createDataFrame([(1, 1)] * 300 + [(2, 2)], "doc_id long, cluster int")
    labels = spark.createDataFrame([(1, 1)] * 200 + [(2, 1)], "doc_id long, label int")
    cells = {(r.cluster, r.label): r.n for r in quality.contingency(classes, labels).collect()}
    assert cells == {(1, 1): 60000, (2, 1): 1}


def test_stored_run(spark):
    """The 20 by 20 table of FIXTURES.md section 4."""
    text = (Path(__file__).parent.parent / "FIXTURES.md").read_text()
    section = text[text.index("## 4.") : text.index("## 5.")]
    cells = {}
    for cluster, values in re.findall(r"^\| (\d+) \| ([\d ]+) \|$", section, re.M):
        for label, n in enumerate(values.split(), 1):
            if int(n):
                cells[int(cluster), label] = int(n)
    both = tables(spark, cells)
    mixed = quality.nmi(*both, base="mixed", class_num=20).first()
    assert mixed.total == 12773
    assert mixed.mi == pytest.approx(0.406665, abs=1e-6)
    assert (mixed.hx, mixed.hy) == pytest.approx((3.929087, 3.088188), abs=1e-6)
    assert mixed.nmi == pytest.approx(0.115904, abs=1e-6)
    assert quality.nmi(*both).first().nmi == pytest.approx(0.167214, abs=1e-6)
    assert len(cells) == 230
    sums = {(r.side, r.value): r.n for r in quality.marginals(*both).collect()}
    assert (sums["cluster", "8"], sums["cluster", "11"]) == (3111, 233)
    assert ("label", "7") not in sums

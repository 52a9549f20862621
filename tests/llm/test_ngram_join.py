"""The shingle join against brute force, and its signatures on random sets."""

import random
from collections import Counter

import numpy as np
import pytest

from tables import SMALL, clashing, edge, empty  # noqa: F401
from textgrove.llm import ngram_join as op


def plain_shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(rows):
    sets = [plain_shingles(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if small and 5 * small >= 4 * large and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return Counter((d, len(s), low.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def joined(docs):
    return Counter(map(tuple, op.ngram_join(docs).collect()))


def crowd():
    """Variants of one text, most of them farther than 0.8 from each other, texts with a common passage, and others."""
    draw = random.Random(3)
    new = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    base, passage = new(150), new(60)
    rows = []
    for i in range(120):
        words = list(base)
        for at in draw.sample(range(150), draw.randrange(1, 7)):
            words[at] = f"v{draw.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(new(30) + passage + new(draw.randrange(5, 60)))) for i in range(80)]
    rows += [(2000 + i, " ".join(passage[: 55 + i % 6] + new(i % 7))) for i in range(40)]
    rows += [(3000 + i, " ".join((base + passage)[i : i + 4 + i % 9])) for i in range(60)]
    return rows


@pytest.mark.parametrize(
    "thresholds, dealt, listed, crowded, long",
    [((8, 256), 1024, 10**6, 32, 2048), ((2, 5), 8, 10**6, 4, 2048), ((50, 1000), 8, 50, 2, 60)],
)
def test_crowded_groups(spark, monkeypatch, thresholds, dealt, listed, crowded, long):
    monkeypatch.setattr(op, "THRESHOLDS", thresholds)
    monkeypatch.setattr(op, "DEALT", dealt)
    monkeypatch.setattr(op, "CROWD", crowded)
    monkeypatch.setattr(op, "LONG", long)
    monkeypatch.setattr(op, "LISTED", listed)
    monkeypatch.setattr(op, "COUNTED", 5000)
    monkeypatch.setattr(op, "RANGE_BYTES", 10_000)
    rows = crowd()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert joined(docs) == plain(rows)


@pytest.mark.parametrize("folder", [SMALL, SMALL.replace("0.001", "0.01")])
def test_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert joined(docs) == plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_awkward_tables(spark, edge, empty, clashing):
    expected = plain([(r.doc_id, r.text) for r in edge.collect()])
    assert joined(edge) == expected and joined(clashing) == expected
    assert not joined(empty)


def test_similar_sets_share_a_signature():
    draw = np.random.default_rng(4)
    for turn in range(1500):
        n = int(draw.integers(4, 200))
        universe = draw.integers(0, 1 << 63, 2 * n, np.uint64)
        kinds = dict(zip(universe.tolist(), draw.choice([1, 2, 3], 2 * n, p=[(1, 0, 0), (0, 1, 0), (0, 0, 1), (0.2, 0.4, 0.4)][turn % 4])))
        both = int(draw.integers(n // 2, n + 1))
        x = np.unique(universe[:n])
        y = np.unique(np.concatenate([universe[:both], universe[n : n + int(draw.integers(0, n - both + 2))]]))
        common = len(np.intersect1d(x, y))
        classes = [np.array([kinds[t] for t in s.tolist()], np.int8) for s in (x, y)]
        sigs = [op.signatures(s, c) for s, c in zip((x, y), classes)]
        if 5 * common >= 4 * (len(x) + len(y) - common) and common < max(len(x), len(y)):
            assert np.intersect1d(*sigs).size
        assert all(len(s) <= 10 * len(t) for s, t in zip(sigs, (x, y)))
        a, b = op.parity(x), op.parity(y)
        assert op.differing(a, b) <= len(np.setxor1d(x, y)) and op.differing(a, a) == 0


@pytest.mark.parametrize("sides", [1, 2])
def test_tiles_keep_every_similar_pair(sides):
    draw = np.random.default_rng(8)
    base = draw.integers(0, 1 << 64, 130, np.uint64)
    sets = []
    for _ in range(90):
        own = draw.integers(0, 1 << 64, int(draw.integers(0, 60)), np.uint64)
        sets.append(np.unique(np.concatenate([base[: int(draw.integers(60, 131))], own])))
    n, root, side = np.array([len(s) for s in sets]), draw.integers(0, 40, 90), draw.integers(0, sides, 90)
    found = list(zip(*(x.tolist() for x in op.near_in_tile(n, root, [op.parity(s) for s in sets], side))))
    pairs = {tuple(sorted(p)) for p in found}
    assert len(pairs) == len(found)
    wanted = set()
    for b in range(90):
        for a in range(b):
            if root[a] != root[b] and (sides == 1 or side[a] != side[b]):
                if 9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (n[a] + n[b]):
                    wanted.add((a, b))
    assert wanted and wanted <= pairs
    assert all(root[a] != root[b] and (sides == 1 or side[a] != side[b]) for a, b in pairs)


def roots_of(pairs, root):
    """The components that ``pairs`` of places make of those in ``root``."""
    root = list(root)
    for a, b in pairs:
        root = [root[a] if r == root[b] else r for r in root]
    return [root.index(r) for r in root]


def test_closest_pairs_connect_what_all_pairs_connect():
    draw = np.random.default_rng(9)
    bases = draw.integers(0, 1 << 64, (6, 100), np.uint64)
    sets = [np.unique(np.r_[bases[i % 6][int(draw.integers(0, 9)):], draw.integers(0, 1 << 64, 4, np.uint64)]) for i in range(120)]
    n, root, side = np.array([len(s) for s in sets]), draw.integers(0, 90, 120), draw.integers(0, 2, 120)
    bits = [op.parity(s) for s in sets]
    every, few = (list(zip(*f(n, root, bits, side))) for f in (op.near_in_tile, op.closest_in_tile))
    assert set(few) < set(every) and roots_of(few, root) == roots_of(every, root)
    # One pair less than components that become one.
    assert len(few) == len(set(root)) - len(set(roots_of(every, root))) < len(every) / 5
    none = op.closest_in_tile(n[:1], root[:1], bits[:1], side[:1])
    assert not len(none[0]) and not len(none[1])


def test_rows_of_tiles_follow_the_sets_of_a_crowd(spark, monkeypatch):
    made, tiled = [], op._tiled

    def counted(rows, sets, work, name, closest=False):
        found = work.write(tiled(rows, sets, work, name, closest), f"made_{name}")
        made.append(found.count())
        return found

    monkeypatch.setattr(op, "_tiled", counted)
    monkeypatch.setattr(op, "THRESHOLDS", (2, 5))
    monkeypatch.setattr(op, "CROWD", 4)
    rows = crowd()
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)
    # 300 sets; the same pairs used to be made below each of their common signatures, 5,484 rows.
    assert made and sum(made) < 3 * len(rows)


def test_counts_survive_packing():
    draw = np.random.default_rng(6)
    sets = [draw.integers(0, 1 << 64, 500, np.uint64) for _ in range(5)]
    sets.append(sets[0][:100])
    found = Counter()
    for at, data in op._run_of_tokens(sets, 8):
        for token, n in zip(*op._tokens_of_run(data, at, 8)):
            found[int(token)] += int(n)
    assert found == Counter((np.concatenate(sets) >> np.uint64(op.SHORT)).tolist())

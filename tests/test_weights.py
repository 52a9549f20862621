import math

import pytest
from pyspark.sql import functions as F

from textgrove.functions import vectors as V
from textgrove.operators import tokens as tk
from textgrove.operators import weights as wt
from textgrove.sources.numbering import number_rows

LISTS = {"d1": "a a b", "d2": "b c", "d3": "c c c d", "d4": "a d d e"}
EXPECTED = {
    ("d1", "a"): (0.666667, 0.191788),
    ("d1", "b"): (0.333333, 0.095894),
    ("d2", "b"): (0.5, 0.143841),
    ("d2", "c"): (0.5, 0.143841),
    ("d3", "c"): (0.75, 0.215762),
    ("d3", "d"): (0.25, 0.071921),
    ("d4", "a"): (0.25, 0.071921),
    ("d4", "d"): (0.5, 0.143841),
    ("d4", "e"): (0.25, 0.173287),
}


def lines(spark, lists):
    return spark.createDataFrame(list(lists.items()), "doc_id string, text string")


def tf_of(spark, lists):
    return wt.term_freq(tk.tokens_from_words(lines(spark, lists), "doc_id", "text"))


def weighted(spark, lists, **options):
    tf = tf_of(spark, lists)
    vocab = wt.vocabulary(wt.doc_freq(tf))
    rows = wt.tfidf(tf, vocab, **options).join(vocab, "term_id")
    return {(r.doc_id, r.term): r.w for r in rows.collect()}


def test_tf_and_tfidf(spark):
    tf = {(r.doc_id, r.term): r.tf for r in tf_of(spark, LISTS).collect()}
    got = weighted(spark, LISTS)
    assert set(tf) == set(got) == set(EXPECTED)
    for key, (share, weight) in EXPECTED.items():
        assert tf[key] == pytest.approx(share, abs=1e-6)
        assert got[key] == pytest.approx(weight, abs=1e-6)


def test_legacy_idf_flips_the_sign(spark):
    got = weighted(spark, LISTS, idf="legacy")
    for key, (_, weight) in EXPECTED.items():
        assert got[key] == pytest.approx(-weight, abs=1e-6)


def test_zero_idf_keeps_the_document(spark):
    got = weighted(spark, {k: LISTS[k] for k in ("d1", "d2", "d3")})
    assert got["d2", "b"] == got["d2", "c"] == 0.0
    assert len(got) == 6


def test_repeated_ids_add_reciprocal_lengths(spark):
    rows = spark.createDataFrame([("x", "a b"), ("x", "a c d d")], "doc_id string, text string")
    tf = wt.term_freq(tk.tokens_from_words(rows, "doc_id", "text"))
    assert {r.term: r.tf for r in tf.collect()} == {"a": 0.75, "b": 0.5, "c": 0.25, "d": 0.5}


def test_empty_words_count_in_word_lists(spark):
    rows = tk.tokens_from_words(lines(spark, {"x": "a  b"}), "doc_id", "text").collect()
    assert [(r.pos, r.term, r.doc_len) for r in rows] == [(0, "a", 3), (1, "", 3), (2, "b", 3)]


def test_tokenize_lowercases_and_keeps_all_scripts(spark):
    rows = tk.tokenize(lines(spark, {"x": "Élan, 12 voß-Ab"}), "doc_id", "text")
    assert [r.term for r in rows.orderBy("pos").collect()] == ["élan", "voß", "ab"]


def test_keep_tagged_recounts_length(spark):
    rows = tk.tokens_from_words(lines(spark, {"x": "a b c a", "y": "c"}), "doc_id", "text")
    lexicon = spark.createDataFrame([("a", "n"), ("b", "Ng"), ("c", "v")], "term string, tag string")
    kept = tk.keep_tagged(rows, lexicon).collect()
    assert sorted((r.doc_id, r.pos, r.term, r.doc_len) for r in kept) == [
        ("x", 0, "a", 3),
        ("x", 1, "b", 3),
        ("x", 3, "a", 3),
    ]
    assert tk.keep_tagged(rows, lexicon, tk.CONTENT_TAGS).count() == 5


def test_cap_rows(spark):
    assert sorted(r.id for r in tk.cap_rows(spark.range(10), "id", 3).collect()) == [0, 1, 2]
    assert tk.cap_rows(spark.range(10), "id", 30).count() == 10
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([2, None, 1, 2, 2, None, 1, 3, 2])], "k int, i int")
    for n, kept in ((0, []), (1, [0]), (2, [0, 0]), (3, [0, 0, 1]), (6, [0, 0, 1, 1, 2, 2]), (8, [0, 0, 1, 1, 2, 2, 2, 2])):
        found = tk.cap_rows(rows, "k", n)
        assert sorted(r.k or 0 for r in found.collect()) == kept
        assert "TakeOrderedAndProject" not in found._jdf.queryExecution().toString()


def test_band_is_strict_on_both_ends(spark):
    # Mean 4, scale 2: m = 2, kept 2 < df < 2: nothing. Scale 4: m = 1, kept 1 < df < 3.
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 10)], "term string, df long")
    keep = lambda **o: sorted(r.term for r in wt.band(df, **o).collect())
    assert keep(scale=2) == []
    assert keep(scale=4) == ["b"]
    assert keep(df_min=2, df_max=3) == ["b", "c"]
    assert keep() == ["a", "b", "c", "d"]


def test_n_basis(spark):
    tf = tf_of(spark, LISTS)
    vocab = wt.vocabulary(wt.band(wt.doc_freq(tf), df_max=1))
    (post,) = wt.tfidf(tf, vocab, "post").collect()
    (pre,) = wt.tfidf(tf, vocab, "pre").collect()
    assert post.w == pytest.approx(0.25 * math.log(1 / 2))
    assert pre.w == pytest.approx(0.25 * math.log(4 / 2))


def test_centroid_norms_and_packing(spark):
    rows = spark.createDataFrame(
        [(1, 2, 3.0), (1, 0, 4.0), (2, 2, 1.0)], "doc_id long, term_id int, w double"
    )
    assert {r.term_id: r.w for r in wt.centroid(rows).collect()} == {0: 2.0, 2: 2.0}
    assert {r.doc_id: r.norm for r in wt.norms(rows).collect()} == {1: 5.0, 2: 1.0}
    packed = {r.doc_id: (r.idx, r.val) for r in wt.pack_sparse(rows).collect()}
    assert packed == {1: ([0, 2], [4.0, 3.0]), 2: ([2], [1.0])}
    dense = {r.doc_id: r.vec for r in wt.densify(rows, F.lit(4)).collect()}
    assert dense == {1: [4.0, 0.0, 3.0, 0.0], 2: [0.0, 0.0, 1.0, 0.0]}


def test_dense_vector_functions(spark):
    x, y = F.array(F.lit(3.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    row = spark.range(1).select(
        V.length(x).alias("l"), V.cosine(x, y).alias("c"), V.squared_distance(x, y).alias("d"),
        V.cosine(x, zero).alias("z"),
    ).first()
    assert (row.l, row.d, row.z) == (3.0, 5.0, 0.0)
    assert row.c == pytest.approx(math.sqrt(0.5))


def test_sparse_add_and_scale(spark):
    a = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0)], "k long, term_id int, w double")
    b = spark.createDataFrame([(1, 1, 4.0), (1, 3, 6.0)], "k long, term_id int, w double")
    total = V.sparse_scale(V.sparse_add(a, b, ["k"]), F.lit(2.0))
    assert {r.term_id: r.w for r in total.collect()} == {0: 0.5, 1: 3.0, 3: 3.0}


@pytest.mark.parametrize("parts", [1, 7])
def test_number_rows_is_dense_and_ordered(spark, parts):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("key")).repartition(parts)
    rows = number_rows(df, ["key"]).orderBy("line_no").collect()
    assert [r.line_no for r in rows] == list(range(1, 1001))
    assert [r.key for r in rows] == list(range(1000))


def test_number_rows_without_a_key(spark):
    rows = number_rows(spark.range(0, 100, 1, 5)).orderBy("line_no").collect()
    assert [(r.line_no, r.id) for r in rows] == [(i + 1, i) for i in range(100)]


def test_number_rows_follows_files(spark, tmp_path):
    texts = {"a.txt": ["first"], "b.txt": [f"line {i}" for i in range(2000)], "c.txt": ["last"]}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    rows = number_rows(spark.read.text(str(tmp_path))).orderBy("line_no").collect()
    assert [r.value for r in rows] == [line for lines in texts.values() for line in lines]
    assert [r.line_no for r in rows] == list(range(1, 2003))

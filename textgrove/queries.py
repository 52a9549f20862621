"""The registered queries: each takes (spark, folder of Parquet tables) and returns a DataFrame.

Doubles are rounded to six decimals because the order of float sums is not fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textgrove.functions import vectors
from textgrove.functions.text import words
from textgrove.operators import kmeans as km
from textgrove.operators import network, quality, report, tokens, weights
from textgrove.operators.bisect import bisect
from textgrove.operators.criteria import metric_of, split_score
from textgrove.plans import stored
from textgrove.plans.documents import document_corpus, partition_documents
from textgrove.plans.words import word_space
from textgrove.sources import readers, sinks
from textgrove.sources.numbering import number_rows
from textgrove.workspace import Workspace

CLUSTERS = 20  # fixed value: default number of clusters
SEED = 7
# Suffix rules standing in for a lexicon of tagged terms.
NOUN_SUFFIX = "(tion|ment|ness|heit|ung|dad)$"
VERB_SUFFIX = "(ing|ed|er|ar|en)$"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(column: Column | str) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def _tokens(spark, sf):
    return tokens.tokenize(table(spark, sf, "documents"), "doc_id", "text")


def _tf(spark, sf):
    return weights.term_freq(_tokens(spark, sf))


def _df(spark, sf):
    return weights.doc_freq(_tf(spark, sf))


def _corpus(spark, sf, **options):
    return document_corpus(table(spark, sf, "documents"), **options)


def _weights(spark, sf, **options):
    return _corpus(spark, sf, **options).weights


def _vectors(spark, sf):
    return weights.explode_dense(table(spark, sf, "embeddings"), "vec_id", "embedding")


# --- tokens and term statistics --------------------------------------------------------------


def tok_counts(spark, sf):
    return _tokens(spark, sf).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


def word_lists(spark, sf):
    lines = table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "text"
    )
    rows = tokens.tokens_from_words(lines, "doc_id", "text")
    return rows.groupBy("doc_id", "term", "doc_len").agg(F.count(F.lit(1)).alias("n"))


def tokens_tagged(spark, sf):
    rows = _tokens(spark, sf)
    tag = F.when(F.col("term").rlike(NOUN_SUFFIX), "n").when(
        F.col("term").rlike(VERB_SUFFIX), "v"
    )
    lexicon = rows.select("term", tag.alias("tag")).distinct()
    return tokens.keep_tagged(rows, lexicon).select("doc_id", "pos", "term", "doc_len")


def first_rows(spark, sf):
    return tokens.cap_rows(table(spark, sf, "documents"), "doc_id", 100_000).select("doc_id", "lang")


def first_tenth(spark, sf):
    """The ingest cap where it binds: a tenth of the turns, whole conversations but for the last."""
    turns = table(spark, sf, "conversations").withColumn("at", F.col("conv_id") * 1000 + F.col("turn"))
    return tokens.cap_rows(turns, "at", turns.count() // 10).select("conv_id", "turn", "role")


def tf(spark, sf):
    return _tf(spark, sf).select("doc_id", "term", r6("tf").alias("tf"))


def df(spark, sf):
    return _df(spark, sf)


def corpus_stats(spark, sf):
    stats = weights.corpus_stats(_df(spark, sf))
    return stats.select("num_term", "df_sum", r6("df_mean").alias("df_mean"))


def corpus_counts(spark, sf):
    """Documents and terms before and after the vocabulary band."""
    work = Workspace(spark)
    tf = weights.store_term_freq(_tf(spark, sf), work)
    band = work.write(weights.band(weights.doc_freq(tf), scale=weights.FILTER_SCALE), "band")
    kept = weights.join_terms(tf, band, band.count(), work, "kept", ["term", "doc_id"])
    parts = [
        weights.count_docs(tf).withColumnRenamed("num_doc", "n").withColumn("what", F.lit("docs")),
        weights.count_docs(kept).withColumnRenamed("num_doc", "n").withColumn("what", F.lit("docs_kept")),
        weights.count_terms(tf).withColumnRenamed("num_term", "n").withColumn("what", F.lit("terms")),
        weights.count_terms(kept).withColumnRenamed("num_term", "n").withColumn("what", F.lit("terms_kept")),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.select("what", "n")


def band_vocab(spark, sf):
    return weights.vocabulary(weights.band(_df(spark, sf), scale=weights.FILTER_SCALE))


def band_bounds(spark, sf):
    return weights.vocabulary(weights.band(_df(spark, sf), df_min=20, df_max=200))


def idf_smooth(spark, sf, idf="smooth"):
    tf = _tf(spark, sf)
    num_doc = weights.count_docs(tf).scalar()
    rows = weights.idf_table(weights.doc_freq(tf), num_doc, idf)
    return rows.select("term", "df", r6("idf").alias("idf"))


def idf_legacy(spark, sf):
    return idf_smooth(spark, sf, "legacy")


def tfidf_pre(spark, sf):
    rows = _weights(spark, sf, n_basis="pre", scale=weights.FILTER_SCALE)
    return rows.select("doc_id", "term_id", r6("w").alias("w"))


def tfidf_post(spark, sf):
    rows = _weights(spark, sf, n_basis="post", scale=weights.FILTER_SCALE)
    return rows.select("doc_id", "term_id", r6("w").alias("w"))


def tfidf_legacy(spark, sf):
    rows = _weights(spark, sf, n_basis="pre", idf="legacy")
    return rows.select("doc_id", "term_id", r6("w").alias("w"))


def raw_weights(spark, sf):
    work = Workspace(spark)
    tf = weights.store_term_freq(_tf(spark, sf), work)
    df = work.write(weights.doc_freq(tf), "df")
    rows = sinks.weight_inputs(tf, df, df.count(), work)
    return rows.select("term", "doc_id", r6("tf").alias("tf"), "df")


def global_centroid(spark, sf):
    return weights.centroid(_weights(spark, sf)).select("term_id", r6("w").alias("w"))


def doc_norms(spark, sf):
    return weights.norms(_weights(spark, sf)).select("doc_id", r6("norm").alias("norm"))


def doc_vectors(spark, sf):
    packed = weights.pack_sparse(_weights(spark, sf, scale=weights.FILTER_SCALE))
    rows = packed.select("doc_id", F.explode(F.arrays_zip("idx", "val")).alias("c"))
    return rows.select("doc_id", F.col("c.idx").alias("term_id"), r6("c.val").alias("w"))


def dense_vectors(spark, sf):
    rows = weights.densify(_vectors(spark, sf), F.lit(64))
    return rows.select("doc_id", F.posexplode("vec").alias("term_id", "w")).select(
        "doc_id", "term_id", r6("w").alias("w")
    )


# --- vector functions ------------------------------------------------------------------------


def vector_functions(spark, sf):
    """Length of every vector, its similarity and distance to the centroid of its label."""
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"),
        F.col("label").alias("cluster"),
        vectors.as_doubles(F.col("embedding")).alias("x"),
    )
    centres = weights.densify(
        report.cluster_centroids(_vectors(spark, sf), rows).select(
            F.col("cluster").alias("doc_id"), "term_id", "w"
        ),
        F.lit(64),
    ).select(F.col("doc_id").alias("cluster"), F.col("vec").alias("y"))
    x, y = F.col("x"), F.col("y")
    return rows.join(centres, "cluster").select(
        "doc_id",
        r6(vectors.length(x)).alias("length"),
        r6(vectors.cosine(x, y)).alias("cosine"),
        r6(vectors.squared_distance(x, y)).alias("distance"),
    )


def vector_sums(spark, sf):
    """Per label, the summed vectors of both halves of the ids added and scaled."""
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    rows = _vectors(spark, sf).join(labels, "doc_id")
    low = rows.where("doc_id < 250").groupBy("label", "term_id").agg(F.sum("w").alias("w"))
    high = rows.where("doc_id >= 250").groupBy("label", "term_id").agg(F.sum("w").alias("w"))
    added = vectors.sparse_add(low, high, ["label"])
    return vectors.sparse_scale(added, F.lit(10.0)).select("label", "term_id", r6("w").alias("w"))


# --- sources ---------------------------------------------------------------------------------


def topic_rows(spark, sf):
    comments = table(spark, sf, "conversations")
    topics = comments.select(
        F.concat(F.lit("topic "), "conv_id").alias("topic"), "conv_id"
    ).distinct()
    rows = readers.topic_rows(topics, comments, "topic 7", key="conv_id")
    return rows.select("conv_id", "turn", "role", "text")


def _page_lines(spark, sf):
    tags = F.split("html", "<", -1)
    return table(spark, sf, "pages").select("page_id", F.posexplode(tags).alias("pos", "line"))


def line_numbers(spark, sf):
    numbered = number_rows(_page_lines(spark, sf), ["page_id", "pos"], "line_no")
    return numbered.select("line_no", "page_id", "pos", F.length("line").alias("chars"))


def _turn_lines(spark, sf):
    # Three fields for system turns and two otherwise, with the text's own tabs on top.
    head = F.when(F.col("role") == "assistant", F.concat_ws("\t", "conv_id", "turn")).otherwise(
        F.concat_ws("-", "conv_id", "turn")
    )
    return table(spark, sf, "conversations").select(F.concat_ws("\t", head, "text").alias("value"))


def valid_lines(spark, sf):
    return readers.valid_lines(_turn_lines(spark, sf))


def rejected_lines(spark, sf):
    return readers.rejected_lines(_turn_lines(spark, sf))


def ingested(spark, sf):
    rows = sinks.ingest(
        table(spark, sf, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn")),
        "id",
        "text",
    )
    return rows.select("doc_id", "title", "content")


# --- assignment and K-means ------------------------------------------------------------------


def _document_space(spark, sf):
    return _corpus(spark, sf).space()


def _embedding_space(spark, sf):
    return km.prepare(_vectors(spark, sf))


def _assign(space, metric, k):
    seeds = km.pick_seeds(space.docs, k, 1, SEED).select("doc_id", "k")
    # k rows of seeds.
    centres = space.weights.join(F.broadcast(seeds), "doc_id").select("k", "term_id", "w")
    rows = km.assign(space.weights, centres, k, metric, space.num_term)
    return rows.select("doc_id", "k", r6("score").alias("score"))


def assign_cosine(spark, sf):
    return _assign(_document_space(spark, sf), "cosine", 2)


def assign_euclid(spark, sf):
    return _assign(_embedding_space(spark, sf), "euclid", 3)


def _kmeans(result):
    return result.assign.select("doc_id", "k", r6("score").alias("score"))


def kmeans_cosine(spark, sf):
    return _kmeans(km.kmeans(_document_space(spark, sf), 2, "cosine", seed=SEED))


def kmeans_euclid(spark, sf):
    return _kmeans(km.kmeans(_embedding_space(spark, sf), 2, "euclid", seed=SEED))


def kmeans_kway(spark, sf):
    return _kmeans(
        km.kmeans(_embedding_space(spark, sf), 5, "euclid", max_iter=10, restarts=1, seed=SEED)
    )


def kmeans_kway_cosine(spark, sf):
    return _kmeans(
        km.kmeans(_embedding_space(spark, sf), 5, "cosine", max_iter=20, restarts=1, seed=SEED)
    )


def kmeans_scores(spark, sf):
    """Score and size of every side of every restart."""
    rows = km.kmeans(_embedding_space(spark, sf), 2, "cosine", seed=SEED).scores
    return rows.select("restart", "k", r6("score").alias("score"), "n")


def kmeans_centres(spark, sf):
    rows = km.kmeans(_embedding_space(spark, sf), 2, "cosine", seed=SEED).centres
    return rows.select("k", "term_id", r6("w").alias("w"))


def _split(space, criterion):
    """Score of the first split of the whole set, per restart."""
    metric = metric_of(criterion)
    stats = km.split_nodes(space, space.docs, 2, metric, seed=SEED).stats
    rows = None
    for r in range(2):
        S = [F.col(f"S_{r}_{j}") for j in range(2)]
        E = [F.col(f"E_{r}_{j}") for j in range(2)]
        score = split_score(criterion, S, E, F.col("n"))
        row = stats.select(F.lit(r).alias("restart"), r6(score).alias("score"))
        rows = row if rows is None else rows.unionByName(row)
    return rows


def split_query(criterion):
    return lambda spark, sf: _split(_embedding_space(spark, sf), criterion)


def separation(spark, sf):
    """Similarity of each first centre to the global centroid, per restart."""
    space = _embedding_space(spark, sf)
    stats = km.split_nodes(space, space.docs, 2, "cosine", seed=SEED).stats
    sides = F.expr(
        "stack(4, 0, 0, E_0_0, D_0_0, 0, 1, E_0_1, D_0_1, 1, 0, E_1_0, D_1_0, 1, 1, E_1_1, D_1_1)"
        " AS (restart, k, e, d)"
    )
    return stats.select(sides).select("restart", "k", r6("e").alias("e"), r6("d").alias("d"))


# --- bisection -------------------------------------------------------------------------------


def _members(tree):
    # One report row per cluster.
    return tree.classes.join(F.broadcast(tree.report.drop("node")), "cluster").select(
        "doc_id", "node", "cluster", "n", r6("gain").alias("gain"), r6("cohesion").alias("cohesion")
    )


def bisect_query(criterion, **options):
    return lambda spark, sf: _members(
        bisect(_embedding_space(spark, sf), CLUSTERS, criterion, seed=SEED, **options)
    )


def bisect_documents(spark, sf):
    return _members(bisect(_document_space(spark, sf), CLUSTERS, "i2", seed=SEED))


def _one_coordinate(spark, sf, term_id):
    """Documents as unit vectors along one coordinate each: many equal gains, few ways to split."""
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", term_id.cast("int").alias("term_id"), F.lit(1.0).alias("w"))


def bisect_ties(spark, sf):
    """By source: leaves with equally many sources of equal size have equal gains."""
    weights = _one_coordinate(spark, sf, F.expr("substring(source, 4)"))
    return _members(bisect(km.prepare(weights), 12, "i2", seed=SEED))


def bisect_exhausted(spark, sf):
    """By language: no leaf can be split any more before there are as many clusters as asked for."""
    weights = _one_coordinate(spark, sf, F.expr("ascii(substring(lang, 2))"))
    return _members(bisect(km.prepare(weights), 8, "h1", seed=SEED))


def tree_documents(spark, sf):
    """The full default run on the unfiltered vocabulary: the report of 20 clusters."""
    space = _corpus(spark, sf).space()
    report = bisect(space, CLUSTERS, "i2", seed=SEED).report
    return report.select("cluster", "node", "n", *[r6(c).alias(c) for c in ("gain", "cohesion", "sse")])


def tree_embeddings(spark, sf):
    """Every node of a tree of 20 clusters, in the order of its splits."""
    tree = bisect(_embedding_space(spark, sf), CLUSTERS, "h1", seed=SEED).tree
    return tree.select("node", "parent", "split_order", "n", r6("gain").alias("gain"), "cluster")


# --- reports ---------------------------------------------------------------------------------


def _by_lang(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.col("lang").alias("cluster"))


def cluster_report(spark, sf):
    found = _corpus(spark, sf)
    rows = report.cluster_cohesion(found.weights, _by_lang(spark, sf), found.rows)
    return rows.select("cluster", "n", r6("cohesion").alias("cohesion"), r6("sse").alias("sse"))


def cluster_vectors(spark, sf):
    found = _corpus(spark, sf)
    rows = report.summed_vectors(found.weights, _by_lang(spark, sf), found.rows)
    return rows.select("cluster", "term_id", r6("w_sum").alias("w_sum"))


def cluster_terms(spark, sf):
    """Heaviest TF-IDF terms per language."""
    found = _corpus(spark, sf)
    top = report.cluster_terms(found.weights, _by_lang(spark, sf), found.vocab, 100, found.rows)
    return top.select("cluster", "rank", "term", r6("w_sum").alias("w_sum"))


def cluster_samples(spark, sf):
    texts = table(spark, sf, "documents").select("doc_id", "text")
    return report.cluster_samples(_by_lang(spark, sf), texts, 100)


def cluster_samples_latest(spark, sf):
    """Sample texts where ids repeat: conversations grouped by length, the last turn wins."""
    turns = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), "turn", "text"
    )
    classes = turns.groupBy("doc_id").agg(F.count(F.lit(1)).alias("cluster"))
    return report.cluster_samples(classes, turns, 100, order="turn")


def cluster_members(spark, sf):
    """Members with their packed vectors, flattened."""
    packed = report.member_vectors(
        _weights(spark, sf, scale=weights.FILTER_SCALE), _by_lang(spark, sf)
    )
    rows = packed.select("cluster", "doc_id", F.explode(F.arrays_zip("idx", "val")).alias("c"))
    return rows.select(
        "cluster", "doc_id", F.col("c.idx").alias("term_id"), r6("c.val").alias("w")
    )


# --- quality ---------------------------------------------------------------------------------


def _lang_source(spark, sf):
    docs = table(spark, sf, "documents")
    return (
        docs.select("doc_id", F.col("lang").alias("cluster")),
        docs.select("doc_id", F.col("source").alias("label")),
    )


def contingency(spark, sf):
    rows = quality.contingency(*_lang_source(spark, sf))
    return rows.select(
        "cluster", "label", "n", r6("p").alias("p"), r6("pxpy").alias("pxpy"), r6("term").alias("term")
    )


def contingency_grid(spark, sf):
    """Quality against toxicity labels on a fixed 1..3 grid, empty cells included."""
    both = table(spark, sf, "labels")
    classes = both.select("doc_id", (F.col("quality") + 1).alias("cluster"))
    labels = both.select("doc_id", (F.col("toxic") + 1).alias("label"))
    rows = quality.contingency(classes, labels, class_num=3, dense=True)
    return rows.select(
        F.col("cluster").cast("long").alias("cluster"),
        F.col("label").cast("long").alias("label"),
        "n",
        r6("p").alias("p"),
        r6("pxpy").alias("pxpy"),
        r6("term").alias("term"),
    )


def marginals(spark, sf):
    rows = quality.marginals(*_lang_source(spark, sf))
    return rows.select("side", "value", "n", r6("p").alias("p"))


def _nmi(classes, labels, base):
    rows = quality.nmi(classes, labels, base)
    return rows.select("total", *[r6(c).alias(c) for c in ("mi", "hx", "hy", "nmi")])


def nmi(spark, sf):
    return _nmi(*_lang_source(spark, sf), "consistent")


def nmi_mixed(spark, sf):
    return _nmi(*_lang_source(spark, sf), "mixed")


def nmi_clusters(spark, sf):
    """K-means clusters of the embeddings against their labels."""
    result = km.kmeans(_embedding_space(spark, sf), 2, "cosine", seed=SEED)
    classes = result.assign.select("doc_id", F.col("k").alias("cluster"))
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return _nmi(classes, labels, "consistent")


# --- word network ----------------------------------------------------------------------------


def _benchmark_lines(spark, sf):
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("doc_id"), words(F.col("text")).alias("words")
    )


def cooccurrence(spark, sf):
    return network.cooccurrence(_benchmark_lines(spark, sf))


def cooccurrence_turns(spark, sf):
    """Network of the words of all conversation turns; partners and counts per first word."""
    turns = table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "text"
    )
    rows = tokens.tokenize(turns, "doc_id", "text")
    cooc = network.cooccurrence(network.line_words(rows))
    return cooc.groupBy("w1").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n"))


def word_vectors(spark, sf):
    space = word_space(_benchmark_lines(spark, sf)).space
    return space.weights.select("doc_id", "term_id", "w", r6("norm").alias("norm"))


def word_clusters(spark, sf):
    return _members(
        bisect(word_space(_benchmark_lines(spark, sf)).space, CLUSTERS, "i2", seed=SEED)
    )


# --- files written and read back --------------------------------------------------------------


def stored_tokens(spark, sf):
    """The token file of all documents, read back and counted."""
    path = f"{Workspace(spark).root}/tokens"
    sinks.write_tokens(_tokens(spark, sf), path, text=True)
    rows = readers.read_token_rows(spark, path)
    return rows.groupBy("doc_id", "term", "doc_len").agg(F.count(F.lit(1)).alias("n"))


def stored_matrix(spark, sf):
    """The dense matrix file made from the token file of the conversations' turns, by term."""
    root = Workspace(spark).root
    turns = table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "text"
    )
    sinks.write_tokens(tokens.tokenize(turns, "doc_id", "text"), f"{root}/tokens", text=True)
    stored.token_matrix(spark, f"{root}/tokens", f"{root}/matrix", scale=weights.FILTER_SCALE)
    header = spark.read.text(f"{root}/matrix/header").select("value").scalar()
    cells = readers.matrix_columns(spark, f"{root}/matrix").groupBy("term_id")
    found = cells.agg(F.sum("docs").alias("docs"), r6(F.sum("w")).alias("w"))
    return found.withColumn("header", header)


def _stored_score(spark, sf):
    """The folder of a score of a class file (quality) against a label file (toxicity) on a 1..3 grid."""
    root = Workspace(spark).root
    both = table(spark, sf, "labels")
    for name, column in (("class", "quality"), ("label", "toxic")):
        sinks.write_classes(both.select("doc_id", (F.col(column) + 1).alias("cluster")), f"{root}/{name}")
    stored.score_classes(spark, f"{root}/class", f"{root}/label", f"{root}/nmi", class_num=3)
    return f"{root}/nmi"


def stored_cells(spark, sf):
    rows = spark.read.parquet(f"{_stored_score(spark, sf)}/cells")
    return rows.select(
        F.col("cluster").cast("long").alias("cluster"),
        F.col("label").cast("long").alias("label"),
        "n",
        *[r6(c).alias(c) for c in ("p", "pxpy", "term")],
    )


def stored_score(spark, sf):
    rows = spark.read.parquet(f"{_stored_score(spark, sf)}/score")
    return rows.select("total", *[r6(c).alias(c) for c in ("mi", "hx", "hy", "nmi")])


def _stored_partition(spark, sf):
    """The folder of a flat clustering of the documents, everything written."""
    path = f"{Workspace(spark).root}/run"
    partition_documents(table(spark, sf, "documents"), path, clusters=2, max_iter=2, restarts=2, seed=SEED)
    return path


def stored_classes(spark, sf):
    """The class file of a flat clustering against the members of its stored report."""
    path = _stored_partition(spark, sf)
    members = readers.read_report(spark, f"{path}/clusters")["members"]
    members = members.select(F.col("doc_id").cast("string").alias("doc_id"), "cluster", F.size("idx").alias("terms"))
    return readers.read_classes(spark, f"{path}/class").join(members, ["doc_id", "cluster"])


def stored_summary(spark, sf):
    """Run summary, centres and report of a flat clustering, read back per cluster."""
    path = _stored_partition(spark, sf)
    best = spark.read.parquet(f"{path}/summary/run").select("restart", "num_doc", "num_term")
    scores = spark.read.parquet(f"{path}/summary/cluster_score").join(F.broadcast(best), "restart")
    centres = spark.read.parquet(f"{path}/summary/centres").groupBy("k").agg(F.sum("w").alias("w"))
    report_rows = readers.read_report(spark, f"{path}/clusters")["report"].withColumnRenamed("cluster", "k")
    found = scores.join(centres, "k").join(report_rows.select("k", F.col("n").alias("members")), "k")
    return found.select(
        F.col("k").alias("cluster"), "n", "members", r6("score").alias("score"), r6("w").alias("w"), "num_doc", "num_term"
    )


QUERIES = {
    f.__name__: f
    for f in (
        tok_counts, word_lists, tokens_tagged, first_rows, first_tenth, tf, df, corpus_stats, corpus_counts,
        band_vocab, band_bounds, idf_smooth, idf_legacy, tfidf_pre, tfidf_post, tfidf_legacy,
        raw_weights, global_centroid, doc_norms, doc_vectors, dense_vectors, vector_functions,
        vector_sums, topic_rows, line_numbers, valid_lines, rejected_lines, ingested,
        assign_cosine, assign_euclid, kmeans_cosine, kmeans_euclid, kmeans_kway,
        kmeans_kway_cosine, kmeans_scores, kmeans_centres, separation, bisect_documents,
        bisect_ties, bisect_exhausted, tree_documents, tree_embeddings, cluster_report, cluster_vectors, cluster_terms,
        cluster_samples, cluster_samples_latest, cluster_members, contingency, contingency_grid,
        marginals, nmi, nmi_mixed, nmi_clusters, cooccurrence, cooccurrence_turns, word_vectors,
        word_clusters, stored_tokens, stored_matrix, stored_cells, stored_score, stored_classes, stored_summary,
    )
}
for _criterion in ("i1", "i2", "e1", "h1", "h2", "sse"):
    QUERIES[f"split_{_criterion}"] = split_query(_criterion)
for _criterion in ("i1", "i2", "e1", "h1", "h2", "sse", "largest"):
    QUERIES[f"bisect_{_criterion}"] = bisect_query(_criterion)
QUERIES["bisect_parent"] = bisect_query("i2", unsplit="parent")

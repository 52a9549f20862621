"""ANSI SQL restatements of the registered queries, runnable on the same Parquet tables.

They are written independently of the Spark code: long joins instead of wide columns, explicit
centroids instead of closed forms, iterations unrolled as common table expressions.
"""

from __future__ import annotations

SEED = 7
TIE = "1e-12"

# --- building blocks -------------------------------------------------------------------------

TOKENS = [
    r"lists AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS words FROM documents)",
    "tokens AS MATERIALIZED (SELECT doc_id, unnest(words) AS term,"
    " CAST(generate_subscripts(words, 1) - 1 AS INTEGER) AS pos, CAST(len(words) AS INTEGER) AS doc_len FROM lists)",
]
TF = TOKENS + [
    "counted AS MATERIALIZED (SELECT doc_id, term, count(*) AS n, max(doc_len) AS doc_len FROM tokens GROUP BY doc_id, term)",
    "tf AS MATERIALIZED (SELECT doc_id, term, CAST(n AS DOUBLE) / doc_len AS tf FROM counted)",
    "dfs AS MATERIALIZED (SELECT term, count(*) AS df FROM tf GROUP BY term)",
    "stats AS MATERIALIZED (SELECT count(*) AS num_term, sum(df) AS df_sum,"
    " CAST(sum(df) AS DOUBLE) / (count(*) * 5.0::DOUBLE) AS df_mean FROM dfs)",
]
ALL = "TRUE"
BAND = "df > (SELECT df_mean FROM stats) AND df < (SELECT df_mean FROM stats) * 4"
BOUNDS = "df BETWEEN 20 AND 200"


def query(ctes: list[str], final: str) -> str:
    return f"WITH {', '.join(ctes)} {final}" if ctes else final


def vocab(where: str) -> list[str]:
    return TF + [
        "vocab AS MATERIALIZED (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_id, df"
        f" FROM dfs WHERE {where})"
    ]


def tfidf(where: str, n_basis: str = "pairs", idf: str = "ln({n} / (df + 1))") -> list[str]:
    n = f"(SELECT CAST(count(DISTINCT doc_id) AS DOUBLE) FROM {n_basis})"
    return vocab(where) + [
        "pairs AS MATERIALIZED (SELECT doc_id, term_id, tf, df FROM tf JOIN vocab USING (term))",
        f"weights AS MATERIALIZED (SELECT doc_id, term_id, tf * {idf.format(n=n)} AS w FROM pairs)",
    ]


EMBEDDINGS = [
    "weights AS MATERIALIZED (SELECT vec_id AS doc_id,"
    " CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS term_id,"
    " unnest(CAST(embedding AS DOUBLE[])) AS w FROM embeddings)"
]

LINES = [
    r"lines AS MATERIALIZED (SELECT item_id AS doc_id, regexp_extract_all(lower(text), '\p{L}+') AS words FROM benchmark)"
]


def cooc(window: int = 10) -> list[str]:
    return [
        "occ AS MATERIALIZED (SELECT doc_id, unnest(words) AS term, generate_subscripts(words, 1) - 1 AS pos FROM lines)",
        # Whole line: itself once, each later position in both orders.
        "whole AS (SELECT term AS w1, term AS w2, count(*) AS n FROM occ GROUP BY term"
        " UNION ALL SELECT a.term, b.term, count(*) FROM occ a JOIN occ b ON a.doc_id = b.doc_id AND a.pos < b.pos GROUP BY a.term, b.term"
        " UNION ALL SELECT b.term, a.term, count(*) FROM occ a JOIN occ b ON a.doc_id = b.doc_id AND a.pos < b.pos GROUP BY a.term, b.term)",
        f"near AS (SELECT term AS w1, term AS w2, count(*) AS n FROM occ WHERE pos >= {window} GROUP BY term"
        f" UNION ALL SELECT a.term, b.term, count(*) FROM occ a JOIN occ b ON a.doc_id = b.doc_id AND b.pos >= {window}"
        f" AND a.pos >= b.pos - {window} AND a.pos < b.pos GROUP BY a.term, b.term"
        f" UNION ALL SELECT b.term, a.term, count(*) FROM occ a JOIN occ b ON a.doc_id = b.doc_id AND b.pos >= {window}"
        f" AND a.pos >= b.pos - {window} AND a.pos < b.pos GROUP BY a.term, b.term)",
        "cooc AS MATERIALIZED (SELECT w1, w2, CAST(sum(n) AS BIGINT) AS n"
        " FROM (SELECT * FROM whole UNION ALL SELECT * FROM near) GROUP BY w1, w2)",
    ]


WORDS = LINES + cooc() + [
    "words AS MATERIALIZED (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_id"
    " FROM (SELECT DISTINCT w1 AS term FROM cooc))",
    "weights AS MATERIALIZED (SELECT w1 AS doc_id, term_id, CAST(n AS DOUBLE) AS w FROM cooc JOIN words ON term = w2)",
]

# Norms, the root and the global centroid of any weights.
ROOT = [
    "norms AS MATERIALIZED (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM weights GROUP BY doc_id)",
    "root AS MATERIALIZED (SELECT doc_id, CAST(1 AS BIGINT) AS node FROM norms)",
    "g AS MATERIALIZED (SELECT term_id, sum(w) / (SELECT count(*) FROM norms) AS w FROM weights GROUP BY term_id)",
]


NINE = "CAST(format('{{:.9g}}', round({}, 12)) AS DOUBLE)"  # nine digits of a column
CLUSTERS = 20  # fixed value: default number of clusters


def seeds(tag: str, live: str, k: int, restarts: int) -> list[str]:
    return [
        f"{tag}_seeds AS MATERIALIZED (SELECT node, restart, k, doc_id FROM (SELECT node, restart, doc_id,"
        f" row_number() OVER (PARTITION BY node, restart ORDER BY md5(concat_ws(':', {SEED}, restart, node, doc_id)), doc_id) - 1 AS k"
        f" FROM {live}, (SELECT unnest(range({restarts})) AS restart)) WHERE k < {k})",
        f"{tag}_c0 AS MATERIALIZED (SELECT node, restart, k, term_id, w FROM {tag}_seeds JOIN weights USING (doc_id))",
    ]


def assigned(name: str, centres: str, live: str, k: int, restarts: int, metric: str) -> str:
    if metric == "cosine":
        value = "CASE WHEN norm * coalesce(l, 0) > 0 THEN coalesce(d, 0) / (norm * l) ELSE 0 END"
        best, good = "max", f"v >= best - {TIE} * (1 + abs(best))"
    else:
        value = "greatest(0, norm * norm + coalesce(l, 0) * coalesce(l, 0) - 2 * coalesce(d, 0))"
        best, good = "min", f"v <= best + {TIE} * (1 + abs(best))"
    return f"""{name} AS MATERIALIZED (
        WITH lengths AS (SELECT node, restart, k, sqrt(sum(w * w)) AS l FROM {centres} GROUP BY ALL),
        dots AS (SELECT c.node, c.restart, c.k, x.doc_id, sum(x.w * c.w) AS d
            FROM {live} v JOIN weights x USING (doc_id) JOIN {centres} c ON c.node = v.node AND c.term_id = x.term_id
            GROUP BY ALL),
        frame AS (SELECT doc_id, node, restart, k FROM {live},
            (SELECT unnest(range({restarts})) AS restart), (SELECT unnest(range({k})) AS k)),
        vals AS (SELECT f.doc_id, f.node, f.restart, f.k, {value} AS v FROM frame f JOIN norms USING (doc_id)
            LEFT JOIN dots d ON d.doc_id = f.doc_id AND d.node = f.node AND d.restart = f.restart AND d.k = f.k
            LEFT JOIN lengths n ON n.node = f.node AND n.restart = f.restart AND n.k = f.k),
        bests AS (SELECT *, {best}(v) OVER (PARTITION BY node, restart, doc_id) AS best FROM vals)
        SELECT doc_id, node, restart, CAST(min(k) FILTER (WHERE {good}) AS INTEGER) AS k, max(best) AS s
        FROM bests GROUP BY doc_id, node, restart)"""


def kmeans(tag: str, live: str, k: int, restarts: int, metric: str, iterations: int) -> list[str]:
    """Iterations unrolled; ends with ``{tag}_a`` (assignment) and ``{tag}_c`` (centres)."""
    ctes = seeds(tag, live, k, restarts)
    for i in range(iterations):
        ctes.append(assigned(f"{tag}_a{i}", f"{tag}_c{i}", live, k, restarts, metric))
        last = f"{tag}_c" if i == iterations - 1 else f"{tag}_c{i + 1}"
        ctes.append(
            f"""{last} AS MATERIALIZED (
            WITH sizes AS (SELECT node, restart, k, count(*) AS n FROM {tag}_a{i} GROUP BY ALL),
            sums AS (SELECT node, restart, k, term_id, sum(w) AS t FROM {tag}_a{i} JOIN weights USING (doc_id) GROUP BY ALL)
            SELECT s.node, s.restart, s.k, term_id, t / n AS w FROM sums s
                JOIN sizes z ON s.node = z.node AND s.restart = z.restart AND s.k = z.k
            UNION ALL
            SELECT c.node, c.restart, c.k, c.term_id, c.w FROM {tag}_c{i} c
                ANTI JOIN sizes z ON c.node = z.node AND c.restart = z.restart AND c.k = z.k)"""
        )
    ctes.append(assigned(f"{tag}_a", f"{tag}_c", live, k, restarts, metric))
    return ctes


SCORES = {
    "i2": "sum(S)",
    "largest": "sum(S)",
    "sse": "sum(S)",
    "i1": "sum(S * S) / sum(n)",
    "e1": "sum(e)",
    "h1": "sum(S) / sum(e)",
    "h2": "(sum(S * S) / sum(n)) / sum(e)",
}
UNSPLIT = {
    "i2": "cohesion",
    "largest": "cohesion",
    "sse": "sse",
    "i1": "cohesion * cohesion / n",
    "e1": "parent_e",
    "h1": "cohesion / parent_e",
    "h2": "(cohesion * cohesion / n) / parent_e",
}


def sides(tag: str, live: str, k: int, restarts: int) -> list[str]:
    """``{tag}_side``: S, n and e of every side of every restart."""
    return [
        f"""{tag}_side AS MATERIALIZED (
        WITH frame AS (SELECT node, restart, k FROM (SELECT DISTINCT node FROM {live}),
            (SELECT unnest(range({restarts})) AS restart), (SELECT unnest(range({k})) AS k)),
        sums AS (SELECT node, restart, k, sum(s) AS S, count(*) AS n FROM {tag}_a GROUP BY ALL),
        ext AS (SELECT node, restart, k, sum(c.w * g.w) / nullif(sqrt(sum(c.w * c.w)) * (SELECT sqrt(sum(w * w)) FROM g), 0) AS e
            FROM {tag}_c c JOIN g USING (term_id) GROUP BY ALL)
        SELECT f.node, f.restart, f.k, coalesce(S, 0) AS S, coalesce(n, 0) AS n, coalesce(e, 0) AS e FROM frame f
            LEFT JOIN sums s ON s.node = f.node AND s.restart = f.restart AND s.k = f.k
            LEFT JOIN ext x ON x.node = f.node AND x.restart = f.restart AND x.k = f.k)"""
    ]


def evaluated(
    tag: str, live: str, criterion: str, parent: str | None, restarts: int = 2, unsplit: str | None = None
) -> list[str]:
    """``{tag}_best``: chosen restart and score; ``{tag}_node``: one row per node with its gain."""
    metric = "euclid" if criterion == "sse" else "cosine"
    order = NINE.format("score") + ("" if criterion in ("sse", "e1") else " DESC")
    if parent is None:
        parent_e = "SELECT node, CAST(NULL AS DOUBLE) AS parent_e, CAST(NULL AS DOUBLE) AS parent_s FROM " + live + " LIMIT 1"
    else:
        parent_e = (
            f"SELECT 2 * s.node + s.k AS node, s.e AS parent_e, s.S AS parent_s FROM {parent}_side s"
            f" JOIN {parent}_best b ON s.node = b.node AND s.restart = b.restart"
        )
    whole = unsplit or UNSPLIT[criterion]
    gain = f"({whole}) - score" if criterion == "sse" else f"score - ({whole})"
    return (
        kmeans(tag, live, 2, restarts, metric, 2)
        + sides(tag, live, 2, restarts)
        + [
            f"{tag}_best AS MATERIALIZED (SELECT node, restart, empty, score FROM (SELECT node, restart, empty, score,"
            f" row_number() OVER (PARTITION BY node ORDER BY empty, {order}, restart) AS rn FROM"
            f" (SELECT node, restart, min(n) = 0 AS empty, {SCORES[criterion]} AS score FROM {tag}_side GROUP BY ALL)) WHERE rn = 1)",
            f"""{tag}_node AS MATERIALIZED (
            WITH sizes AS (SELECT node, count(*) AS n FROM {live} GROUP BY node),
            centre AS (SELECT v.node, x.term_id, sum(x.w) / any_value(z.n) AS w FROM {live} v
                JOIN weights x USING (doc_id) JOIN sizes z ON z.node = v.node GROUP BY v.node, x.term_id),
            length AS (SELECT node, sqrt(sum(w * w)) AS l FROM centre GROUP BY node),
            dots AS (SELECT v.node, v.doc_id, sum(x.w * c.w) AS d FROM {live} v JOIN weights x USING (doc_id)
                JOIN centre c ON c.node = v.node AND c.term_id = x.term_id GROUP BY ALL),
            fit AS (SELECT d.node, sum(CASE WHEN norm * l > 0 THEN d / (norm * l) ELSE 0 END) AS cohesion,
                sum(greatest(0, norm * norm + l * l - 2 * d)) AS sse
                FROM dots d JOIN norms USING (doc_id) JOIN length y ON y.node = d.node GROUP BY d.node),
            above AS ({parent_e})
            SELECT b.node, z.n, b.restart, cohesion, sse, CASE WHEN empty THEN NULL ELSE {gain} END AS gain, empty
            FROM {tag}_best b JOIN sizes z ON z.node = b.node JOIN fit f ON f.node = b.node
                LEFT JOIN above a ON a.node = b.node)""",
        ]
    )


def grown(weights: list[str], criterion: str, clusters: int, unsplit: str | None = None) -> list[str]:
    """A whole tree, split by split: ``leaf``, ``member``, ``numbered`` and ``popped`` (node, step)."""
    last = clusters - 1
    if criterion == "largest":
        pick, where = "n DESC, step, node", "NOT empty"
    else:
        pick = NINE.format("gain") + ("" if criterion == "e1" else " DESC") + ", step, node"
        where = "gain IS NOT NULL" + (" AND gain >= 0" if criterion == "i1" else "")
    ctes = weights + ROOT + evaluated("t1", "root", criterion, None)
    ctes += [
        "open1 AS MATERIALIZED (SELECT *, 1 AS step FROM t1_node)",
        f"pop1 AS MATERIALIZED (SELECT node FROM open1 WHERE NOT empty{' AND gain >= 0' if criterion == 'i1' else ''})",
        "sides1_side AS MATERIALIZED (FROM t1_side)",
        "sides1_best AS MATERIALIZED (FROM t1_best)",
    ]
    for s in range(1, clusters):
        # Children of every evaluated node so far; those of the popped one are the documents of the next step.
        union = "" if s == 1 else f" UNION ALL FROM below{s - 1}"
        ctes += [
            f"below{s} AS MATERIALIZED (SELECT a.doc_id, a.node AS parent, CAST(2 * a.node + a.k AS BIGINT) AS node"
            f" FROM t{s}_a a JOIN t{s}_best b ON a.node = b.node AND a.restart = b.restart{union})",
            f"ch{s} AS MATERIALIZED (SELECT doc_id, node FROM below{s} WHERE parent IN (FROM pop{s}))",
        ]
        ctes += evaluated(f"t{s + 1}", f"ch{s}", criterion, f"sides{s}", unsplit=unsplit)
        ctes += [
            f"open{s + 1} AS MATERIALIZED (SELECT * FROM open{s} WHERE node NOT IN (FROM pop{s})"
            f" UNION ALL SELECT *, {s + 1} AS step FROM t{s + 1}_node)",
            f"pop{s + 1} AS MATERIALIZED (SELECT node FROM open{s + 1} WHERE {where} ORDER BY {pick} LIMIT 1)",
            f"sides{s + 1}_side AS MATERIALIZED (FROM sides{s}_side UNION ALL FROM t{s + 1}_side)",
            f"sides{s + 1}_best AS MATERIALIZED (FROM sides{s}_best UNION ALL FROM t{s + 1}_best)",
        ]
    popped = " UNION ALL ".join(f"SELECT node, {s} AS step FROM pop{s}" for s in range(1, clusters))
    nodes = " UNION ALL ".join(f"SELECT *, {s} AS step FROM t{s}_node" for s in range(1, clusters + 1))
    ctes += [
        f"popped AS MATERIALIZED ({popped})",
        f"evaluated AS MATERIALIZED ({nodes})",
        f"leaf AS MATERIALIZED (FROM open{last + 1})",
        f"member AS MATERIALIZED (SELECT doc_id, node FROM below{last} UNION ALL FROM root)",
        "numbered AS MATERIALIZED (SELECT node, CAST(row_number() OVER (ORDER BY n DESC, first) AS INTEGER) AS cluster"
        " FROM (SELECT node, count(*) AS n, min(doc_id) AS first FROM member WHERE node IN (SELECT node FROM leaf) GROUP BY node))",
    ]
    return ctes


def bisect(weights: list[str], criterion: str, unsplit: str | None = None, clusters: int = CLUSTERS) -> str:
    return query(
        grown(weights, criterion, clusters, unsplit),
        "SELECT doc_id, m.node, cluster, l.n, round(gain, 6) AS gain, round(cohesion, 6) AS cohesion"
        " FROM member m JOIN leaf l ON l.node = m.node JOIN numbered x ON x.node = m.node",
    )


def tree_report(weights: list[str], criterion: str) -> str:
    return query(
        grown(weights, criterion, CLUSTERS),
        "SELECT cluster, l.node, n, round(gain, 6) AS gain, round(cohesion, 6) AS cohesion, round(sse, 6) AS sse"
        " FROM leaf l JOIN numbered USING (node)",
    )


def tree_nodes(weights: list[str], criterion: str) -> str:
    return query(
        grown(weights, criterion, CLUSTERS),
        "SELECT node, CASE WHEN node > 1 THEN node // 2 END AS parent, CAST(p.step AS INTEGER) AS split_order, n,"
        " round(gain, 6) AS gain, cluster FROM evaluated LEFT JOIN popped p USING (node) LEFT JOIN numbered USING (node)",
    )


def best_assign(weights: list[str], k: int, restarts: int, metric: str, iterations: int) -> list[str]:
    """``result(doc_id, k, s)``: the best restart of direct K-means."""
    order = NINE.format("score") + (" DESC" if metric == "cosine" else "")
    return (
        weights
        + ROOT
        + kmeans("t", "root", k, restarts, metric, iterations)
        + sides("t", "root", k, restarts)
        + [
            "pick AS MATERIALIZED (SELECT restart FROM (SELECT restart, min(n) = 0 AS empty, sum(S) AS score"
            f" FROM t_side GROUP BY restart) ORDER BY empty, {order}, restart LIMIT 1)",
            "result AS MATERIALIZED (SELECT doc_id, k, s FROM t_a WHERE restart IN (SELECT restart FROM pick))",
        ]
    )


def kmeans_query(weights: list[str], k: int, restarts: int, metric: str, iterations: int) -> str:
    return query(
        best_assign(weights, k, restarts, metric, iterations),
        "SELECT doc_id, k, round(s, 6) AS score FROM result",
    )


def assign_query(weights: list[str], k: int, metric: str) -> str:
    ctes = weights + ROOT + seeds("t", "root", k, 1)
    ctes += [assigned("t_a", "t_c0", "root", k, 1, metric)]
    return query(ctes, "SELECT doc_id, k, round(s, 6) AS score FROM t_a")


def split_query(criterion: str) -> str:
    metric = "euclid" if criterion == "sse" else "cosine"
    ctes = EMBEDDINGS + ROOT + kmeans("t", "root", 2, 2, metric, 2) + sides("t", "root", 2, 2)
    score = SCORES[criterion]
    return query(
        ctes,
        f"SELECT CAST(restart AS INTEGER) AS restart, round({score}, 6) AS score FROM t_side GROUP BY restart",
    )


def cells(classes: str, labels: str) -> list[str]:
    return [
        f"joined AS MATERIALIZED (SELECT c.cluster, l.label FROM ({classes}) c JOIN ({labels}) l USING (doc_id))",
        "cell AS MATERIALIZED (SELECT cluster, label, count(*) AS n,"
        " CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM joined) AS p FROM joined GROUP BY cluster, label)",
        "px AS MATERIALIZED (SELECT cluster, sum(n) AS n, sum(p) AS p FROM cell GROUP BY cluster)",
        "py AS MATERIALIZED (SELECT label, sum(n) AS n, sum(p) AS p FROM cell GROUP BY label)",
        "full_cell AS MATERIALIZED (SELECT cell.*, px.p * py.p AS pxpy, cell.p * ln(cell.p / (px.p * py.p)) AS term"
        " FROM cell JOIN px USING (cluster) JOIN py USING (label))",
    ]


LANG = "SELECT doc_id, lang AS cluster FROM documents"
SOURCE = "SELECT doc_id, source AS label FROM documents"


def nmi(ctes: list[str], unit: str) -> str:
    return query(
        ctes
        + [
            "parts AS (SELECT (SELECT count(*) FROM joined) AS total, (SELECT sum(term) FROM full_cell) AS mi,"
            " (SELECT -sum(p * log2(p)) FROM px) AS hx, (SELECT -sum(p * log2(p)) FROM py) AS hy)"
        ],
        f"SELECT total, round(mi, 6) AS mi, round(hx, 6) AS hx, round(hy, 6) AS hy,"
        f" round(2 * mi / ((hx + hy) * {unit}), 6) AS nmi FROM parts",
    )


# --- catalogue -------------------------------------------------------------------------------

TURN_ID = "concat(conv_id, '-', turn)"
TURN_LINE = (
    "(SELECT CASE WHEN role = 'assistant' THEN concat(conv_id, chr(9), turn) ELSE concat(conv_id, '-', turn) END"
    " || chr(9) || text AS line FROM conversations)"
)
DOCS = tfidf(ALL)
TURN_WORDS = (
    r"lists AS MATERIALIZED (SELECT concat(conv_id, '-', turn) AS doc_id, regexp_extract_all(lower(text), '\p{L}+') AS words"
    " FROM conversations)"
)
# One coordinate per document: its source or language.
SOURCES = ["weights AS MATERIALIZED (SELECT doc_id, CAST(substr(source, 4) AS INTEGER) AS term_id, CAST(1 AS DOUBLE) AS w FROM documents)"]
LANGUAGES = ["weights AS MATERIALIZED (SELECT doc_id, ascii(substr(lang, 2)) AS term_id, CAST(1 AS DOUBLE) AS w FROM documents)"]

ORACLES = {
    "tok_counts": query(TF, "SELECT doc_id, term, n FROM counted"),
    "word_lists": "SELECT doc_id, term, CAST(doc_len AS INTEGER) AS doc_len, count(*) AS n FROM"
    f" (SELECT {TURN_ID} AS doc_id, unnest(string_split(text, ' ')) AS term, len(string_split(text, ' ')) AS doc_len"
    " FROM conversations) GROUP BY ALL",
    "tokens_tagged": query(
        TOKENS
        + [
            "tagged AS (SELECT *, regexp_matches(term, '(tion|ment|ness|heit|ung|dad)$') AS noun FROM tokens)"
        ],
        "SELECT doc_id, pos, term, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS doc_len FROM tagged WHERE noun",
    ),
    "first_rows": "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100000",
    "first_tenth": "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id * 1000 + turn"
    " LIMIT (SELECT count(*) // 10 FROM conversations)",
    "tf": query(TF, "SELECT doc_id, term, round(tf, 6) AS tf FROM tf"),
    "df": query(TF, "SELECT term, df FROM dfs"),
    "corpus_stats": query(
        TF, "SELECT num_term, CAST(df_sum AS BIGINT) AS df_sum, round(df_mean, 6) AS df_mean FROM stats"
    ),
    "corpus_counts": query(
        tfidf(BAND),
        "SELECT 'docs' AS what, count(DISTINCT doc_id) AS n FROM tf UNION ALL"
        " SELECT 'docs_kept', count(DISTINCT doc_id) FROM pairs UNION ALL"
        " SELECT 'terms', count(DISTINCT term) FROM tf UNION ALL"
        " SELECT 'terms_kept', count(DISTINCT term_id) FROM pairs",
    ),
    "band_vocab": query(vocab(BAND), "SELECT term, term_id, df FROM vocab"),
    "band_bounds": query(vocab(BOUNDS), "SELECT term, term_id, df FROM vocab"),
    "idf_smooth": query(
        TF,
        "SELECT term, df, round(ln((SELECT CAST(count(DISTINCT doc_id) AS DOUBLE) FROM tf) / (df + 1)), 6) AS idf FROM dfs",
    ),
    "idf_legacy": query(
        TF,
        "SELECT term, df, round(ln((df + 1) / (SELECT CAST(count(DISTINCT doc_id) AS DOUBLE) FROM tf)), 6) AS idf FROM dfs",
    ),
    "tfidf_pre": query(tfidf(BAND, "tf"), "SELECT doc_id, term_id, round(w, 6) AS w FROM weights"),
    "tfidf_post": query(tfidf(BAND), "SELECT doc_id, term_id, round(w, 6) AS w FROM weights"),
    "tfidf_legacy": query(
        tfidf(ALL, "tf", "ln((df + 1) / {n})"), "SELECT doc_id, term_id, round(w, 6) AS w FROM weights"
    ),
    "raw_weights": query(TF, "SELECT term, doc_id, round(tf, 6) AS tf, df FROM tf JOIN dfs USING (term)"),
    "global_centroid": query(
        tfidf(ALL),
        "SELECT term_id, round(sum(w) / (SELECT count(DISTINCT doc_id) FROM weights), 6) AS w FROM weights GROUP BY term_id",
    ),
    "doc_norms": query(
        tfidf(ALL), "SELECT doc_id, round(sqrt(sum(w * w)), 6) AS norm FROM weights GROUP BY doc_id"
    ),
    "doc_vectors": query(tfidf(BAND), "SELECT doc_id, term_id, round(w, 6) AS w FROM weights"),
    "dense_vectors": query(EMBEDDINGS, "SELECT doc_id, term_id, round(w, 6) AS w FROM weights"),
    "vector_functions": query(
        EMBEDDINGS
        + [
            "label AS (SELECT vec_id AS doc_id, label FROM embeddings)",
            "centre AS (SELECT label, term_id, avg(w) AS c FROM weights JOIN label USING (doc_id) GROUP BY label, term_id)",
        ],
        "SELECT doc_id, round(sqrt(sum(w * w)), 6) AS length,"
        " round(sum(w * c) / (sqrt(sum(w * w)) * sqrt(sum(c * c))), 6) AS cosine,"
        " round(sum((w - c) * (w - c)), 6) AS distance"
        " FROM weights JOIN label USING (doc_id) JOIN centre USING (label, term_id) GROUP BY doc_id",
    ),
    "vector_sums": query(
        EMBEDDINGS,
        "SELECT label, term_id, round(sum(w) / 10, 6) AS w FROM weights JOIN embeddings ON vec_id = doc_id GROUP BY label, term_id",
    ),
    "topic_rows": "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 7",
    "line_numbers": "SELECT row_number() OVER (ORDER BY page_id, pos) AS line_no, page_id, CAST(pos AS INTEGER) AS pos,"
    " CAST(length(line) AS INTEGER) AS chars FROM (SELECT page_id, unnest(string_split(html, '<')) AS line,"
    " generate_subscripts(string_split(html, '<'), 1) - 1 AS pos FROM pages)",
    "valid_lines": "SELECT string_split(line, chr(9))[1] AS doc_id, string_split(line, chr(9))[2] AS text"
    f" FROM {TURN_LINE} WHERE len(string_split(line, chr(9))) = 2",
    "rejected_lines": "SELECT line, CAST(len(string_split(line, chr(9))) AS INTEGER) AS num_fields"
    f" FROM {TURN_LINE} WHERE len(string_split(line, chr(9))) <> 2",
    "ingested": f"SELECT {TURN_ID} AS doc_id, '' AS title, text AS content FROM conversations",
    "assign_cosine": assign_query(DOCS, 2, "cosine"),
    "assign_euclid": assign_query(EMBEDDINGS, 3, "euclid"),
    "kmeans_cosine": kmeans_query(DOCS, 2, 2, "cosine", 2),
    "kmeans_euclid": kmeans_query(EMBEDDINGS, 2, 2, "euclid", 2),
    "kmeans_kway": kmeans_query(EMBEDDINGS, 5, 1, "euclid", 10),
    "kmeans_kway_cosine": kmeans_query(EMBEDDINGS, 5, 1, "cosine", 20),
    "kmeans_scores": query(
        EMBEDDINGS + ROOT + kmeans("t", "root", 2, 2, "cosine", 2) + sides("t", "root", 2, 2),
        "SELECT CAST(restart AS INTEGER) AS restart, CAST(k AS INTEGER) AS k, round(S, 6) AS score, n FROM t_side",
    ),
    "kmeans_centres": query(
        best_assign(EMBEDDINGS, 2, 2, "cosine", 2),
        "SELECT CAST(k AS INTEGER) AS k, term_id, round(w, 6) AS w FROM t_c WHERE restart IN (SELECT restart FROM pick) AND w <> 0",
    ),
    "separation": query(
        EMBEDDINGS + ROOT + kmeans("t", "root", 2, 2, "cosine", 2),
        "SELECT CAST(restart AS INTEGER) AS restart, CAST(k AS INTEGER) AS k,"
        " round(sum(c.w * g.w) / (sqrt(sum(c.w * c.w)) * sqrt(sum(g.w * g.w))), 6) AS e,"
        " round(sum((c.w - g.w) * (c.w - g.w)), 6) AS d FROM t_c c JOIN g USING (term_id) GROUP BY restart, k",
    ),
    "bisect_documents": bisect(DOCS, "i2"),
    "bisect_parent": bisect(EMBEDDINGS, "i2", "parent_s"),
    "bisect_ties": bisect(SOURCES, "i2", clusters=12),
    "bisect_exhausted": bisect(LANGUAGES, "h1", clusters=8),
    "tree_documents": tree_report(DOCS, "i2"),
    "tree_embeddings": tree_nodes(EMBEDDINGS, "h1"),
    "cluster_report": query(
        tfidf(ALL)
        + ROOT[:1]
        + [
            f"cls AS MATERIALIZED ({LANG})",
            "sizes AS MATERIALIZED (SELECT cluster, count(*) AS n FROM cls GROUP BY cluster)",
            "centre AS MATERIALIZED (SELECT cluster, term_id, sum(w) / any_value(n) AS c FROM weights JOIN cls USING (doc_id)"
            " JOIN sizes USING (cluster) GROUP BY cluster, term_id)",
            "length AS MATERIALIZED (SELECT cluster, sqrt(sum(c * c)) AS l FROM centre GROUP BY cluster)",
            "dots AS MATERIALIZED (SELECT cluster, doc_id, sum(w * c) AS d FROM weights JOIN cls USING (doc_id)"
            " JOIN centre USING (cluster, term_id) GROUP BY cluster, doc_id)",
        ],
        "SELECT cluster, any_value(n) AS n, round(sum(d / (norm * l)), 6) AS cohesion,"
        " round(sum(norm * norm + l * l - 2 * d), 6) AS sse"
        " FROM dots JOIN norms USING (doc_id) JOIN length USING (cluster) JOIN sizes USING (cluster) GROUP BY cluster",
    ),
    "cluster_vectors": query(
        tfidf(ALL) + [f"cls AS ({LANG})"],
        "SELECT * FROM (SELECT cluster, term_id, round(sum(w), 6) AS w_sum FROM weights JOIN cls USING (doc_id)"
        " GROUP BY cluster, term_id HAVING sum(w) <> 0)",
    ),
    "cluster_terms": query(
        tfidf(ALL)
        + [
            f"cls AS ({LANG})",
            "sums AS (SELECT cluster, term_id, sum(w) AS w_sum FROM weights JOIN cls USING (doc_id) GROUP BY cluster, term_id),"
            " ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(w_sum, 9) DESC, term_id) AS rank FROM sums WHERE w_sum <> 0)",
        ],
        "SELECT cluster, CAST(rank AS INTEGER) AS rank, term, round(w_sum, 6) AS w_sum FROM ranked JOIN vocab USING (term_id) WHERE rank <= 100",
    ),
    "cluster_samples": "SELECT lang AS cluster, CAST(rank AS INTEGER) AS rank, doc_id, text FROM"
    " (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 100",
    "cluster_samples_latest": "WITH conv AS (SELECT conv_id AS doc_id, count(*) AS cluster, max_by(text, turn) AS text"
    " FROM conversations GROUP BY conv_id) SELECT cluster, CAST(rank AS INTEGER) AS rank, doc_id, text FROM"
    " (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY doc_id) AS rank FROM conv) WHERE rank <= 100",
    "cluster_members": query(
        tfidf(BAND),
        "SELECT lang AS cluster, doc_id, term_id, round(w, 6) AS w FROM weights JOIN documents USING (doc_id)",
    ),
    "contingency": query(
        cells(LANG, SOURCE),
        "SELECT cluster, label, n, round(p, 6) AS p, round(pxpy, 6) AS pxpy, round(term, 6) AS term FROM full_cell",
    ),
    "contingency_grid": query(
        cells("SELECT doc_id, quality + 1 AS cluster FROM labels", "SELECT doc_id, toxic + 1 AS label FROM labels")
        + [
            "grid AS (SELECT c.x AS cluster, l.x AS label FROM (SELECT unnest(range(1, 4)) AS x) c, (SELECT unnest(range(1, 4)) AS x) l)"
        ],
        "SELECT grid.cluster, grid.label, coalesce(cell.n, 0) AS n, round(coalesce(cell.p, 0), 6) AS p,"
        " round(coalesce(px.p, 0) * coalesce(py.p, 0), 6) AS pxpy, round(coalesce(term, 0), 6) AS term FROM grid"
        " LEFT JOIN full_cell cell ON cell.cluster = grid.cluster AND cell.label = grid.label"
        " LEFT JOIN px ON px.cluster = grid.cluster LEFT JOIN py ON py.label = grid.label",
    ),
    "marginals": query(
        cells(LANG, SOURCE),
        "SELECT 'cluster' AS side, cluster AS value, CAST(n AS BIGINT) AS n, round(p, 6) AS p FROM px UNION ALL"
        " SELECT 'label', label, CAST(n AS BIGINT), round(p, 6) FROM py",
    ),
    "nmi": nmi(cells(LANG, SOURCE), "ln(2)"),
    "nmi_mixed": nmi(cells(LANG, SOURCE), "1"),
    "nmi_clusters": nmi(
        best_assign(EMBEDDINGS, 2, 2, "cosine", 2)
        + cells("SELECT doc_id, k AS cluster FROM result", "SELECT vec_id AS doc_id, label FROM embeddings"),
        "ln(2)",
    ),
    "cooccurrence": query(LINES + cooc(), "SELECT w1, w2, n FROM cooc"),
    "cooccurrence_turns": query(
        [
            r"lists AS MATERIALIZED (SELECT concat(conv_id, '-', turn) AS doc_id, regexp_extract_all(lower(text), '\p{L}+') AS words FROM conversations)",
            "toks AS MATERIALIZED (SELECT doc_id, unnest(words) AS term, generate_subscripts(words, 1) AS pos FROM lists)",
            "lines AS MATERIALIZED (SELECT doc_id, list(term ORDER BY pos) AS words FROM toks GROUP BY doc_id)",
        ]
        + cooc(),
        "SELECT w1, count(*) AS words, CAST(sum(n) AS BIGINT) AS n FROM cooc GROUP BY w1",
    ),
    "word_vectors": query(
        WORDS + ROOT[:1], "SELECT doc_id, term_id, w, round(norm, 6) AS norm FROM weights JOIN norms USING (doc_id)"
    ),
    "word_clusters": bisect(WORDS, "i2"),
    "stored_tokens": query(TF, "SELECT CAST(doc_id AS VARCHAR) AS doc_id, term, doc_len, n FROM counted"),
    "stored_matrix": query(
        [TURN_WORDS, *tfidf(BAND)[1:]],
        "SELECT term_id, count_if(w <> 0) AS docs, round(sum(w), 6) AS w, (SELECT concat(count(DISTINCT doc_id), ' ',"
        " (SELECT count(*) FROM vocab)) FROM weights) AS header FROM weights GROUP BY term_id",
    ),
    "stored_score": nmi(
        cells("SELECT doc_id, quality + 1 AS cluster FROM labels", "SELECT doc_id, toxic + 1 AS label FROM labels"),
        "ln(2)",
    ),
    "stored_classes": query(
        best_assign(DOCS, 2, 2, "cosine", 2),
        "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(k AS INTEGER) AS cluster, CAST(count(*) AS INTEGER) AS terms"
        " FROM result JOIN weights USING (doc_id) GROUP BY doc_id, k",
    ),
    "stored_summary": query(
        best_assign(DOCS, 2, 2, "cosine", 2),
        "SELECT CAST(s.k AS INTEGER) AS cluster, s.n, s.n AS members, round(s.S, 6) AS score, round(c.w, 6) AS w,"
        " (SELECT count(*) FROM norms) AS num_doc, (SELECT count(*) FROM vocab) AS num_term FROM t_side s"
        " JOIN (SELECT restart, k, sum(w) AS w FROM t_c GROUP BY restart, k) c ON c.restart = s.restart AND c.k = s.k"
        " WHERE s.restart IN (SELECT restart FROM pick)",
    ),
}
ORACLES["stored_cells"] = ORACLES["contingency_grid"]
for _criterion in ("i1", "i2", "e1", "h1", "h2", "sse"):
    ORACLES[f"split_{_criterion}"] = split_query(_criterion)
for _criterion in ("i1", "i2", "e1", "h1", "h2", "sse", "largest"):
    ORACLES[f"bisect_{_criterion}"] = bisect(EMBEDDINGS, _criterion)

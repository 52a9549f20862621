"""Seeded, restarted K-means over many tree nodes at once.

Weights stay long and bucketed by document. One pass assigns every live document for every
restart (centres are a wide table: one row per node and term, one column per restart and side)
and sums the new centres in the same job. No weight row moves between executors: only partial
sums per node and term are shuffled. The driver sees one row per node.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textgrove.operators import packed as by_term
from textgrove.operators.criteria import (
    check,
    metric_of,
    smaller_is_better,
    split_score,
)
from textgrove.workspace import (
    Workspace,
    block_count,
    block_of,
    broadcast_if_bounded,
    broadcast_limit,
    bucket_count,
    local_table,
    row_bytes,
)

# Similarities closer than this (relative) count as equal, so ties do not depend on the order
# in which partitions happened to be summed.
TIE = 1e-12
ROOT = 1


# Spaces of more rows are packed by term before they are split, see ``packed``.
PACK_MIN_ROWS = 2_000_000

# Term id of the row every document has beside its coordinates: its value 1 makes each centre
# table carry the number of documents per side.
COUNT = -1


@dataclass
class Space:
    """Weights prepared for iteration, with the numbers that bound its small tables."""

    work: Workspace
    table: DataFrame  # (doc_id, term_id, w, norm) with the COUNT rows, bucketed by doc_id
    docs: DataFrame  # (doc_id, node) with every document in the root, bucketed alike
    centre: DataFrame  # (term_id, g): global centroid
    square: float  # its squared length
    num_doc: int
    num_term: int
    buckets: int
    rows: int  # approximate rows of ``table``
    basis: int | None = None  # documents by which ``centre`` divides, where the table holds all of them
    packed: by_term.Packed | None = None  # its weights by term, once they were needed

    def pack(self, restarts: int, k: int) -> by_term.Packed | None:
        """The weights packed by term; None for small spaces, parts, and more documents than a task can hold."""
        if self.rows < PACK_MIN_ROWS or self.basis is None or not by_term.fits(self, restarts, k):
            return None
        if self.packed is None:
            self.packed = by_term.pack(self)
            if self.packed is None:
                self.basis = None
        return self.packed

    @property
    def weights(self) -> DataFrame:
        """``(doc_id, term_id, w, norm)``."""
        return self.table.where(f"term_id <> {COUNT}")

    def subset(self, part: DataFrame, num_doc: int, name: str) -> Space:
        """The same space with only the rows ``part`` of ``num_doc`` of its documents."""
        rows = max(1, self.rows * num_doc // max(1, self.num_doc))
        buckets = bucket_count(self.work.spark, rows)
        if buckets != self.buckets:
            part = part.repartition(buckets, "doc_id")
        table = self.work.write_bucketed(part, name, "doc_id", buckets, ["doc_id", "term_id"])
        return replace(self, table=table, num_doc=num_doc, buckets=buckets, rows=rows, basis=None, packed=None)


def prepare(
    weights: DataFrame, rows: int | None = None, work: Workspace | None = None, basis: int | None = None
) -> Space:
    """Write ``weights`` bucketed by document with the vector length on every row.

    ``rows`` is the known row count (it sets the bucket count); without it the rows are counted.
    ``basis`` is the number of documents by which the global centroid divides, where that is not the number
    of documents with weights, as with document counts from before a vocabulary filter.
    """
    work = work or Workspace(weights.sparkSession)
    if rows is None:
        rows = weights.count()
    buckets = bucket_count(weights.sparkSession, rows)
    placed = weights.select("doc_id", "term_id", "w").repartition(buckets, "doc_id")
    with_norm = placed.withColumn("norm", F.expr("sqrt(sum(w * w) OVER (PARTITION BY doc_id))"))
    order = ["doc_id", "term_id"]
    table = work.write_bucketed(with_norm, "weights", "doc_id", buckets, order)
    roots = table.groupBy("doc_id").agg(F.expr(f"{ROOT}L AS node"), F.max("norm").alias("norm"))
    docs = work.write_bucketed(roots, "docs", "doc_id", buckets, ["doc_id"])
    num_doc = docs.count()
    basis = num_doc if basis is None else basis
    mean = table.groupBy("term_id").agg(F.expr(f"sum(w) / {basis} AS g"))
    centre = work.write(mean, "centre")
    num_term, square = centre.agg(F.expr("count(1)"), F.expr("coalesce(sum(g * g), 0D)")).first()
    count_rows = docs.selectExpr("doc_id", f"{COUNT} AS term_id", "1D AS w", "norm")
    table = work.write_bucketed(count_rows, "weights", "doc_id", buckets, order)
    return Space(work, table, docs, centre, square, num_doc, num_term, buckets, rows + num_doc, basis)


def slots(restarts: int, k: int) -> list[tuple[int, int]]:
    return [(r, j) for r in range(restarts) for j in range(k)]


def exprs(template: str, restarts: int, k: int) -> list[Column]:
    """One aggregate per restart r and side j (s numbers the pairs)."""
    return [
        F.expr(template.format(r=r, j=j, s=s)) for s, (r, j) in enumerate(slots(restarts, k))
    ]


# --- seeds -----------------------------------------------------------------------------------


def pick_seeds(
    live: DataFrame, k: int, restarts: int, seed: int, numbers: dict[int, int] | None = None
) -> DataFrame:
    """``(node, restart, k, doc_id)``: the K documents with the smallest seeded digest.

    ``numbers`` gives the numbers that nodes have in the digest, where they differ from their ids.

    The rank limit is pushed below the exchange, so each task forwards at most K rows per node
    and restart.
    """
    name = "CAST(node AS STRING)"
    if numbers:
        cases = " ".join(f"WHEN {i}L THEN '{number}'" for i, number in numbers.items())
        name = f"CASE node {cases} ELSE {name} END"
    digests = live.selectExpr(
        "doc_id", "node", f"explode(sequence(0, {restarts - 1})) AS restart"
    ).withColumn("digest", F.expr(f"md5(concat_ws(':', '{seed}', restart, {name}, doc_id))"))
    rank = "row_number() OVER (PARTITION BY node, restart ORDER BY digest, doc_id) AS rank"
    # The limit is pushed below the exchange only if it tests the bare row number.
    first = digests.selectExpr("*", rank).where(f"rank <= {k}")
    return first.selectExpr("node", "restart", "rank - 1 AS k", "doc_id")


def _seed_sums(
    space: Space, live: DataFrame, k: int, restarts: int, seed: int, numbers: dict[int, int] | None = None
) -> DataFrame:
    # At most nodes * restarts * k ids: few enough to prune buckets and row groups with.
    chosen = pick_seeds(live, k, restarts, seed, numbers).collect()
    ids = sorted({row.doc_id for row in chosen})
    columns = {
        "doc_id": pa.array([row.doc_id for row in chosen]),
        "node": pa.array([row.node for row in chosen], pa.int64()),
        "slot": pa.array([row.restart * k + row.k for row in chosen], pa.int32()),
    }
    table = F.broadcast(local_table(space.work.spark, columns))
    rows = space.table.where(F.col("doc_id").isin(ids)).join(table, "doc_id")
    return rows.groupBy("node", "term_id").agg(
        *exprs("sum(if(slot = {s}, w, 0D)) AS x_{r}_{j}", restarts, k)
    )


# --- one iteration ---------------------------------------------------------------------------


def nearest(values: list[str], metric: str) -> tuple[str, str]:
    """SQL for (index, score) of the best centre; ties go to the lowest index."""
    if len(values) == 1:
        return "0", values[0]
    if metric == "cosine":
        best = f"greatest({', '.join(values)})"
        good = f"{{value}} >= {best} - {TIE} * (1 + abs({best}))"
    else:
        best = f"least({', '.join(values)})"
        good = f"{{value}} <= {best} + {TIE} * (1 + abs({best}))"
    cases = [f"WHEN {good.format(value=v)} THEN {j}" for j, v in enumerate(values)]
    return f"CASE {' '.join(cases)} END", best


# Similarity (or squared distance) from the dot product d with a summed side, the length l of the
# sum and its number of documents n; zero vectors have similarity 0.
VALUE = {
    "cosine": "if(norm * {l} > 0, {d} / (norm * {l}), 0D)",
    "euclid": "greatest(0D, norm * norm + {l} * {l} / ({n} * {n}) - 2 * {d} / {n})",
}


@dataclass
class Centres:
    """Summed vectors per node, restart and side, with their sizes and lengths on the driver."""

    sums: DataFrame  # (node, term_id, x_r_j…), the COUNT row holds the sizes
    n: dict[tuple[int, int, int], float]  # (node, restart, side) -> documents
    l: dict[tuple[int, int, int], float]  # -> length of the sum  # noqa: E741
    terms: dict[int, int]  # node -> its rows in ``sums``

    @property
    def nodes(self) -> list[int]:
        return sorted(self.terms)

    @property
    def rows(self) -> int:
        return sum(self.terms.values())

    def local(self, space: Space, restarts: int, k: int) -> DataFrame:
        """One row per node with the columns ``l_r_j`` and ``n_r_j`` (at least 1)."""
        columns = {"node": pa.array(self.nodes, pa.int64())}
        for r, j in slots(restarts, k):
            columns[f"l_{r}_{j}"] = pa.array([self.l[i, r, j] for i in self.nodes], pa.float64())
            sizes = [max(1.0, self.n[i, r, j]) for i in self.nodes]
            columns[f"n_{r}_{j}"] = pa.array(sizes, pa.float64())
        return F.broadcast(local_table(space.work.spark, columns))


def _measure(sums: DataFrame, restarts: int, k: int) -> Centres:
    rows = (
        sums.groupBy("node")
        .agg(
            *exprs(f"sum(if(term_id = {COUNT}, x_{{r}}_{{j}}, 0D)) AS n_{{r}}_{{j}}", restarts, k),
            *exprs(
                f"sqrt(sum(if(term_id = {COUNT}, 0D, x_{{r}}_{{j}} * x_{{r}}_{{j}}))) AS l_{{r}}_{{j}}",
                restarts,
                k,
            ),
            F.expr("count(1) AS terms"),
        )
        .collect()
    )
    pick = lambda c: {
        (row.node, r, j): row[f"{c}_{r}_{j}"] for row in rows for r, j in slots(restarts, k)
    }
    return Centres(sums, pick("n"), pick("l"), {row.node: row.terms for row in rows})


def score_docs(
    space: Space, live: DataFrame, centres: Centres, k: int, restarts: int, metric: str
) -> DataFrame:
    """``(doc_id, node, k_r…, s_r…)``: nearest centre and its score per restart.

    The outer join keeps documents that share no term with any centre (all dots zero).
    """
    pairs = slots(restarts, k)
    wide = centres.sums.where(f"term_id <> {COUNT}").select(
        "node", "term_id", *[f"x_{r}_{j}" for r, j in pairs]
    )
    data = space.table.join(live.select("doc_id", "node").hint("shuffle_hash"), "doc_id")
    names = [f"d_{r}_{j}" for r, j in pairs]
    sums = exprs("sum(w * x_{r}_{j}) AS d_{r}_{j}", restarts, k)
    size, limit = row_bytes(len(wide.columns)), broadcast_limit(space.work.spark)
    if centres.rows * size <= limit or limit < size:  # below one row nothing may be broadcast at all
        small = F.broadcast(wide) if centres.rows * size <= limit else wide
        joined = data.join(small, ["node", "term_id"], "left").groupBy("doc_id", "node")
        dots = joined.agg(F.expr("max(norm) AS norm"), *sums)
    else:
        dots = _blocked_dots(space, data, wide, centres.rows, sums, names)
    dots = dots.fillna(0.0, names)
    values = dots.join(centres.local(space, restarts, k), "node").selectExpr(
        "doc_id",
        "node",
        *[
            VALUE[metric].format(d=f"d_{r}_{j}", l=f"l_{r}_{j}", n=f"n_{r}_{j}") + f" AS v_{r}_{j}"
            for r, j in pairs
        ],
    )
    output = []
    for r in range(restarts):
        index, best = nearest([f"v_{r}_{j}" for j in range(k)], metric)
        output += [f"{index} AS k_{r}", f"{best} AS s_{r}"]
    return values.selectExpr("doc_id", "node", *output)


def _blocked_dots(
    space: Space, data: DataFrame, wide: DataFrame, rows: int, sums: list[Column], names: list[str]
) -> DataFrame:
    """``(doc_id, node, norm, d…)`` with centres too large to broadcast whole.

    The centre rows are dealt by node and term into blocks that each stay below the limit, by their exact
    sizes. Block after block is broadcast and gives every document a part of its inner products,
    which is stored in the document's bucket. Weights never move; parts add up without an exchange.
    """
    work, limit = space.work, broadcast_limit(space.work.spark)
    most = max(1, limit // row_bytes(len(wide.columns)))
    dealt = lambda blocks: block_of(["node", "term_id"], blocks)
    blocks = block_count(wide, rows, most, dealt)
    block = dealt(blocks)
    name = f"dots_{len(work.tables)}"
    whole = data.groupBy("doc_id", "node").agg(F.expr("max(norm) AS norm"))
    whole = whole.select("*", *[F.lit(None).cast("double").alias(n) for n in names])
    parts = work.write_bucketed(whole, name, "doc_id", space.buckets, ["doc_id"])
    for b in range(blocks):
        near = F.broadcast(wide.where(block == b))
        part = data.where(block == b).join(near, ["node", "term_id"]).groupBy("doc_id", "node")
        part = part.agg(F.lit(None).cast("double").alias("norm"), *sums)
        parts = work.write_bucketed(part, name, "doc_id", space.buckets, ["doc_id"])
    return parts.groupBy("doc_id", "node").agg(F.max("norm").alias("norm"), *[F.sum(n).alias(n) for n in names])


def _sum_sides(space: Space, assigned: DataFrame, restarts: int, k: int) -> DataFrame:
    """``(node, term_id, t, u, q, x_r_j…)``: summed vectors per restart and side.

    ``t``, ``u`` and ``q`` sum the vectors, the unit vectors and the squares of each whole node:
    enough for its unsplit score without another pass.
    """
    sides = assigned.select("doc_id", "node", *[f"k_{r}" for r in range(restarts)])
    return (
        space.table.join(sides.hint("shuffle_hash"), "doc_id")
        .groupBy("node", "term_id")
        .agg(
            F.expr("sum(w) AS t"),
            F.expr("sum(if(norm > 0, w / norm, 0D)) AS u"),
            F.expr("sum(w * w) AS q"),
            *exprs("sum(if(k_{r} = {j}, w, 0D)) AS x_{r}_{j}", restarts, k),
        )
    )


def _keep_old(
    space: Space, new: Centres, old: Centres, held: list[tuple[int, int, int]], name: str
) -> Centres:
    """Put back the previous sums of the sides in ``held`` (emptied or converged)."""
    keep: dict[tuple[int, int], list[int]] = {}
    for node, r, j in held:
        keep.setdefault((r, j), []).append(node)
    before = old.sums.selectExpr("node", "term_id", *[f"x_{r}_{j} AS o_{r}_{j}" for r, j in keep])
    # A node's centres are made of its own documents' terms, so ``new`` covers every old row.
    before = broadcast_if_bounded(before, old.rows)
    joined = new.sums.join(before, ["node", "term_id"], "left")
    for (r, j), nodes in keep.items():
        here = f"node IN ({', '.join(map(str, nodes))})"
        value = f"if({here}, coalesce(o_{r}_{j}, 0D), x_{r}_{j})"
        joined = joined.withColumn(f"x_{r}_{j}", F.expr(value))
    sums = space.work.write(joined.select(new.sums.columns), name)
    n = new.n | {side: old.n[side] for side in held}
    lengths = new.l | {side: old.l[side] for side in held}
    return Centres(sums, n, lengths, new.terms)


def _turned(product: float, new: float, old: float) -> float:
    """``1 - cos`` of two centres from their inner product and lengths."""
    if new * old > 0:
        return 1 - product / (new * old)
    # A zero centre that stays zero has not moved.
    return 0.0 if new == old else 1.0


def shifts(
    space: Space, new: Centres, old: Centres, restarts: int, k: int, metric: str
) -> dict[tuple[int, int], float]:
    """(node, restart) -> how far its centres moved: summed ``1 - cos`` or squared distance."""
    pairs = slots(restarts, k)
    sides = [f"x_{r}_{j}" for r, j in pairs]
    before = old.sums.selectExpr("node", "term_id", *[f"{x} AS o{x}" for x in sides])
    before = broadcast_if_bounded(before, old.rows)
    joined = new.sums.where(f"term_id <> {COUNT}").join(before, ["node", "term_id"], "left")
    sizes = lambda c: c.local(space, restarts, k)
    named = sizes(old).selectExpr("node", *[f"n_{r}_{j} AS m_{r}_{j}" for r, j in pairs])
    joined = joined.join(sizes(new), "node").join(F.broadcast(named), "node")
    gap = "x_{r}_{j} / n_{r}_{j} - coalesce(ox_{r}_{j}, 0D) / m_{r}_{j}"
    rows = (
        joined.groupBy("node")
        .agg(
            *exprs("coalesce(sum(x_{r}_{j} * ox_{r}_{j}), 0D) AS p_{r}_{j}", restarts, k),
            *exprs(f"sum(pow({gap}, 2)) AS g_{{r}}_{{j}}", restarts, k),
        )
        .collect()
    )

    def move(row, r, j):
        if metric == "euclid":
            return row[f"g_{r}_{j}"]
        side = (row.node, r, j)
        return _turned(row[f"p_{r}_{j}"], new.l[side], old.l[side])

    return {
        (row.node, r): sum(move(row, r, j) for j in range(k))
        for row in rows
        for r in range(restarts)
    }


# --- all iterations --------------------------------------------------------------------------


@dataclass
class Split:
    """Result of K-means on a set of nodes."""

    assigned: DataFrame  # (doc_id, node, k_r…, s_r…), bucketed by doc_id
    centres: Centres
    before: Centres  # the centres one iteration earlier
    stats: DataFrame  # one row per node, see split_stats
    steps: int  # iterations run
    converged: dict = field(default_factory=dict)  # (node, restart) -> iteration, if earlier

    moved: dict | None = None  # (node, restart) -> last shift, where known

    def iterations(self, node: int, restart: int) -> int:
        return self.converged.get((node, restart), self.steps)

    def shifts(self, space: Space, restarts: int, k: int, metric: str) -> dict[tuple[int, int], float]:
        if self.moved is None:
            self.moved = shifts(space, self.centres, self.before, restarts, k, metric)
        return self.moved


def split_nodes(
    space: Space,
    live: DataFrame,
    k: int = 2,
    metric: str = "cosine",
    max_iter: int | None = 2,
    restarts: int = 2,
    seed: int = 7,
    eps: float | None = 0.0,
    label: str = "split",
    numbers: dict[int, int] | None = None,
) -> Split:
    """K-means with restarts inside every tree node of ``live(doc_id, node)``.

    Stops at ``max_iter`` (None: only on convergence), or when every restart of every node moved
    by no more than ``eps``. Centres are written after each iteration: a table of at most one row
    per node and term.
    """
    if max_iter is None and eps is None:
        raise ValueError("unlimited iterations need eps")
    packed = space.pack(restarts, k)
    if packed is not None:
        return _split_packed(space, packed, live, k, metric, max_iter, restarts, seed, eps, label, numbers)
    work = space.work
    watch = eps is not None
    seeded = work.write(_seed_sums(space, live, k, restarts, seed, numbers), f"{label}_seeds")
    centres = before = _measure(seeded, restarts, k)
    converged: dict[tuple[int, int], int] = {}
    step = 0
    while max_iter is None or step < max_iter:
        step += 1
        before = centres
        assigned = score_docs(space, live, before, k, restarts, metric)
        sums = work.write(_sum_sides(space, assigned, restarts, k), f"{label}_centres_{step}")
        centres = _measure(sums, restarts, k)
        held = [s for s, n in centres.n.items() if n == 0 or s[:2] in converged]
        if any(before.n[side] for side in held):
            centres = _keep_old(space, centres, before, held, f"{label}_kept_{step}")
        if not watch:
            continue
        for pair, moved in shifts(space, centres, before, restarts, k, metric).items():
            if moved <= eps:
                converged.setdefault(pair, step)
        if len(converged) == len(centres.nodes) * restarts:
            break
    scored = score_docs(space, live, centres, k, restarts, metric)
    assigned = work.write_bucketed(
        scored, f"{label}_assigned", "doc_id", space.buckets, ["node", "doc_id"]
    )
    stats = split_stats(space, assigned, centres, k, restarts)
    return Split(assigned, centres, before, stats, step, converged)


def _split_packed(
    space, packed, live, k, metric, max_iter, restarts, seed, eps, label, numbers
) -> Split:
    """``split_nodes`` of a space packed by term: one pass per iteration and one to score."""
    seeds = pick_seeds(live, k, restarts, seed, numbers).collect()
    state = by_term.begin(space.work, packed, live, seeds, restarts, k)
    this = by_term.Round(space.work, packed, state, metric, TIE, label)
    pairs, nodes = slots(restarts, k), [int(i) for i in state.nodes]
    dots = this.score()
    before = last = _told(this, None)
    moved = {(i, r): 0.0 for i in nodes for r in range(restarts)}
    converged: dict[tuple[int, int], int] = {}
    step = 0
    while max_iter is None or step < max_iter:
        step += 1
        before = last
        found = by_term.masks(state, this.sides(dots))
        this.done()
        n = by_term.counts(state, found)
        held = [s for s in np.ndindex(n.shape) if n[s] == 0 or (nodes[s[0]], pairs[s[1]][0]) in converged]
        if any(state.n[s] for s in held):
            for i, s in held:  # emptied or converged sides keep their centres
                r, j = pairs[s]
                here = state.at == i
                bit = np.uint8(1 << (j & 7))
                found[r, j >> 3][here] = (found[r, j >> 3][here] & ~bit) | (state.now[r, j >> 3][here] & bit)
                n[i, s] = state.n[i, s]
        state = by_term.State(
            state.nodes, state.at, k, found, state.now, np.maximum(1.0, n), np.maximum(1.0, state.n)
        )
        this.state = state
        dots = this.score()
        state.n = n
        last = _told(this, None)
        moved = _moved(this, before, last, restarts, k)
        if eps is None:
            continue
        for pair, way in moved.items():
            if way <= eps:
                converged.setdefault(pair, step)
        if len(converged) == len(nodes) * restarts:
            break
    assigned = this.assigned(dots, space.buckets, f"{label}_assigned")
    this.done()
    centres = _told(this, this.centres())
    stats = _packed_stats(space, this, assigned, centres, k, restarts)
    return Split(assigned, centres, before, stats, step, converged, moved)


def _told(this: by_term.Round, sums: DataFrame | None) -> Centres:
    """The centres of the last pass."""
    state = this.state
    side = lambda x: {
        (int(i), r, j): float(x[a, s]) for a, i in enumerate(state.nodes) for s, (r, j) in enumerate(state.slots)
    }
    terms = {int(i): int(t) + 1 for i, t in zip(state.nodes, this.whole[0])}
    return Centres(sums, side(state.n), side(this.sums["length"]), terms)


def _moved(this: by_term.Round, old: Centres, new: Centres, restarts: int, k: int) -> dict[tuple[int, int], float]:
    """``shifts`` from the sums of the last pass."""
    moved = {}
    for a, i in enumerate(new.nodes):
        for s, (r, j) in enumerate(slots(restarts, k)):
            way = float(this.sums["moved"][a, s])
            if this.metric != "euclid":
                way = _turned(way, new.l[i, r, j], old.l[i, r, j])
            moved[i, r] = moved.get((i, r), 0.0) + way
    return moved


def _packed_stats(
    space: Space, this: by_term.Round, assigned: DataFrame, centres: Centres, k: int, restarts: int
) -> DataFrame:
    """``split_stats`` from the sums of the passes."""
    pairs, nodes = slots(restarts, k), centres.nodes
    rows = {row.node: row for row in _side_sums(assigned, restarts, k).collect()}
    _, tu, tt, q = this.whole
    n = np.array([rows[i].n for i in nodes])
    length, sizes, along = this.sums["length"], np.maximum(1.0, this.state.n), this.sums["along"]
    whole = np.sqrt(tt)
    divided = lambda x, y: np.divide(x, y, out=np.zeros(np.shape(x)), where=y != 0)
    e = divided(along, length * math.sqrt(space.square))
    d = (length / sizes) ** 2 - 2 * along / sizes + space.square
    columns = {
        "node": pa.array(nodes, pa.int64()),
        "n": pa.array(n, pa.int64()),
        "cohesion": pa.array(divided(tu, whole)),
        "sse": pa.array(np.maximum(0.0, q - tt / n)),
    }
    for name, kind in (("n", pa.int64()), ("S", pa.float64())):
        columns |= {f"{name}_{r}_{j}": pa.array([rows[i][f"{name}_{r}_{j}"] for i in nodes], kind) for r, j in pairs}
    for name, x in (("E", e), ("D", d)):
        columns |= {f"{name}_{r}_{j}": pa.array(x[:, s]) for s, (r, j) in enumerate(pairs)}
    return local_table(space.work.spark, columns)


def _side_sums(assigned: DataFrame, restarts: int, k: int) -> DataFrame:
    """Per node ``n``, and per side ``n_r_j`` and ``S_r_j``."""
    return assigned.groupBy("node").agg(
        F.expr("count(1) AS n"),
        *exprs("count_if(k_{r} = {j}) AS n_{r}_{j}", restarts, k),
        *exprs("sum(if(k_{r} = {j}, s_{r}, 0D)) AS S_{r}_{j}", restarts, k),
    )


def split_stats(
    space: Space, assigned: DataFrame, centres: Centres, k: int, restarts: int
) -> DataFrame:
    """One row per node: ``n``; per side ``n_r_j``, ``S_r_j``, ``E_r_j`` and ``D_r_j`` (similarity
    and squared distance of its centre to the global centroid); ``cohesion`` and ``sse`` unsplit.
    """
    pairs = slots(restarts, k)
    counted = _side_sums(assigned, restarts, k)
    g = broadcast_if_bounded(space.centre, space.num_term)
    whole = centres.sums.join(g, "term_id").groupBy("node").agg(
        F.expr("coalesce(sum(t * u) / nullif(sqrt(sum(t * t)), 0), 0D) AS cohesion"),
        F.expr("sum(q) AS q"),
        F.expr("sum(t * t) AS tt"),
        *exprs("sum(x_{r}_{j} * g) AS xg_{r}_{j}", restarts, k),
    )
    sizes = centres.local(space, restarts, k).selectExpr(
        "node", *[f"n_{r}_{j} AS m_{r}_{j}" for r, j in pairs], *[f"l_{r}_{j}" for r, j in pairs]
    )
    g_length = math.sqrt(space.square)
    # All three have one row per node.
    joined = counted.join(F.broadcast(whole), "node").join(F.broadcast(sizes), "node")
    return joined.selectExpr(
        "node",
        "n",
        "cohesion",
        "greatest(0D, q - tt / n) AS sse",
        *[f"n_{r}_{j}" for r, j in pairs],
        *[f"S_{r}_{j}" for r, j in pairs],
        *[
            f"coalesce(xg_{r}_{j} / nullif(l_{r}_{j} * {g_length!r}D, 0), 0D) AS E_{r}_{j}"
            for r, j in pairs
        ],
        *[
            f"pow(l_{r}_{j} / m_{r}_{j}, 2) - 2 * xg_{r}_{j} / m_{r}_{j} + {space.square!r}D AS D_{r}_{j}"
            for r, j in pairs
        ],
    )


def rank_restarts(row, criterion: str, k: int, restarts: int) -> list[tuple[int, float | None]]:
    """Restarts of one node, best first: those leaving an empty side last, then by score, then
    by number."""
    ranked = []
    for r in range(restarts):
        S = [row[f"S_{r}_{j}"] for j in range(k)]
        E = [row[f"E_{r}_{j}"] for j in range(k)]
        empty = any(row[f"n_{r}_{j}"] == 0 for j in range(k))
        try:
            score = split_score(criterion, S, E, row["n"])
        except ZeroDivisionError:
            score = None
        # To nine digits, so that the order in which partitions were summed decides no tie.
        key = float("inf") if score is None else float(f"{round(score, 12):.9g}")
        if score is not None and not smaller_is_better(criterion):
            key = -key
        ranked.append(((empty, key, r), r, None if empty else score))
    return [(r, score) for _, r, score in sorted(ranked)]


@dataclass
class KMeansResult:
    assign: DataFrame  # (doc_id, k, score) of the best restart
    centres: DataFrame  # (k, term_id, w) of the best restart, non-zero coordinates
    scores: DataFrame  # (restart, k, score, n) of every restart
    summary: dict
    space: Space


def kmeans(
    weights: DataFrame | Space,
    k: int,
    metric: str = "cosine",
    max_iter: int | None = 2,
    eps: float | None = 0.0,
    restarts: int = 2,
    seed: int = 7,
    criterion: str | None = None,
    rows: int | None = None,
) -> KMeansResult:
    """Direct K-way K-means over all documents, best of ``restarts`` by ``criterion``."""
    criterion = check(criterion or ("sse" if metric == "euclid" else "i2"))
    if metric_of(criterion) != metric:
        raise ValueError(f"criterion {criterion} does not go with metric {metric}")
    space = weights if isinstance(weights, Space) else prepare(weights, rows)
    label = f"kmeans{len(space.work.tables)}"
    split = split_nodes(space, space.docs, k, metric, max_iter, restarts, seed, eps, label)
    row = split.stats.first()
    best, score = rank_restarts(row, criterion, k, restarts)[0]
    assign_best = split.assigned.select(
        "doc_id", F.col(f"k_{best}").alias("k"), F.col(f"s_{best}").alias("score")
    )
    sizes = [max(1.0, split.centres.n[ROOT, best, j]) for j in range(k)]
    sides = F.array(*[F.col(f"x_{best}_{j}") / sizes[j] for j in range(k)])
    sums = split.centres.sums.where(f"term_id <> {COUNT}")
    centres = sums.select("term_id", F.posexplode(sides).alias("k", "w"))
    cells = [(r, j, float(row[f"S_{r}_{j}"]), row[f"n_{r}_{j}"]) for r, j in slots(restarts, k)]
    scores = local_table(
        space.work.spark,
        {
            "restart": pa.array([c[0] for c in cells], pa.int32()),
            "k": pa.array([c[1] for c in cells], pa.int32()),
            "score": pa.array([c[2] for c in cells], pa.float64()),
            "n": pa.array([c[3] for c in cells], pa.int64()),
        },
    )
    separation = "D" if metric == "euclid" else "E"
    summary = {
        "restart": best,
        "iterations": split.iterations(ROOT, best),
        "shift": split.shifts(space, restarts, k, metric)[ROOT, best],
        "score": score,
        "separation": sum(row[f"{separation}_{best}_{j}"] for j in range(k)),
        "num_doc": space.num_doc,
        "num_term": space.num_term,
    }
    return KMeansResult(
        assign_best, centres.where(F.col("w") != 0).select("k", "term_id", "w"), scores, summary, space
    )


def assign(
    weights: DataFrame, centres: DataFrame, k: int, metric: str = "cosine", num_term: int | None = None
) -> DataFrame:
    """``(doc_id, k, score)``: nearest of ``k`` given centres ``(k, term_id, w)``.

    ``num_term`` bounds the rows of the centre table, which are counted where that bound is too large;
    without it the join is left to AQE.
    """
    sides = range(k)
    wide = centres.groupBy("term_id").agg(
        *[F.expr(f"sum(if(k = {j}, w, 0D)) AS c_{j}") for j in sides]
    )
    lengths = centres.groupBy("k").agg(F.expr("sqrt(sum(w * w)) AS l"))
    length = {j: lengths.where(f"k = {j}").agg(F.max("l")).scalar() for j in sides}
    small = wide
    if num_term is not None:
        fits = num_term * row_bytes(len(wide.columns)) <= broadcast_limit(wide.sparkSession)
        small = broadcast_if_bounded(wide, num_term if fits else wide.count())
    dots = (
        weights.join(small, "term_id", "left")
        .groupBy("doc_id")
        .agg(
            F.expr("sqrt(sum(w * w)) AS norm"),
            *[F.expr(f"coalesce(sum(w * c_{j}), 0D) AS d_{j}") for j in sides],
        )
    )
    named = dots.withColumns({f"l_{j}": F.coalesce(length[j], F.lit(0.0)) for j in sides})
    values = named.selectExpr(
        "doc_id", *[VALUE[metric].format(d=f"d_{j}", l=f"l_{j}", n="1") + f" AS v_{j}" for j in sides]
    )
    index, best = nearest([f"v_{j}" for j in sides], metric)
    return values.selectExpr("doc_id", f"{index} AS k", f"{best} AS score")

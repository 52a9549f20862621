"""Repeated bisection: grow a tree of clusters by splitting the most promising leaf.

The driver holds one small record per tree node (sizes, scores, gain). Documents stay in
tables: each round scores a batch of nodes together and writes ``(doc_id, node, side)`` for
them, so a document's leaf is always one filter away and no lineage grows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgrove.operators.criteria import check, gain, metric_of, unsplit_score
from textgrove.operators.kmeans import (
    COUNT,
    ROOT,
    Space,
    Split,
    prepare,
    rank_restarts,
    split_nodes,
)
from textgrove.workspace import ROWS_PER_BUCKET, broadcast_limit, local_table, row_bytes

# A round whose documents are fewer than one in SHRINK of its source gets a source of its own.
# Sources of less than one full bucket are cheaper to read whole than to write again.
SHRINK = 4
SHRINK_MIN_ROWS = 4 * ROWS_PER_BUCKET
# Leaves are scored in one round while their children's centres fill at most so many broadcasts.
ROUND_BLOCKS = 5
K = 2
# A node's number doubles at every level. Nodes whose number needs more bits than a BIGINT holds are
# stored under negative ids, handed out one after the other.
NUMBER_BITS = 62


@dataclass
class Node:
    """Driver-side record of one tree node."""

    node: int  # id in the tables
    seq: int  # order of creation, breaks ties first in first out
    n: int
    split: Split  # where the node's own two sides are stored
    restart: int  # best restart of that split
    score: float | None  # its score, None when the node cannot be split
    unsplit: float | None
    cohesion: float
    sse: float
    gain: float | None
    sides: list[int]  # documents per side
    side_score: list[float]
    side_e: list[float]  # similarity of each side's centre to the global centroid
    side_d: list[float]  # squared distance of each side's centre to the global centroid
    parent: int | None = None
    children: list["Node"] | None = None  # filled when the split has been carried out
    popped: int | None = None  # position in the order of splits


@dataclass
class Bisection:
    classes: DataFrame  # (doc_id, cluster, node)
    report: DataFrame  # one row per cluster
    tree: DataFrame  # one row per node
    space: Space
    summary: dict = field(default_factory=dict)
    centres: DataFrame | None = None  # (k, term_id, w) of the first split
    scores: DataFrame | None = None  # (k, score, n) of the first split


def bisect(
    weights: DataFrame | Space,
    cluster_num: int = 20,
    criterion: str = "i2",
    init_restarts: int = 2,
    restarts: int = 2,
    max_iter: int | None = 2,
    eps: float | None = 0.0,
    seed: int = 7,
    stop_no_gain: bool | None = None,
    unsplit: str = "recompute",
    lookahead: int = 8,
    rows: int | None = None,
) -> Bisection:
    """Split until ``cluster_num`` clusters exist or no cluster can be split.

    ``stop_no_gain`` ends the run when the best gain is negative (default: only for ``i1``).
    ``unsplit='parent'`` scores a child by its share of the parent's evaluation instead of
    recomputing it (``i2`` only). ``lookahead`` leaves are scored per round; the result does not
    depend on it, because a node's split depends on the node alone.
    """
    check(criterion)
    if unsplit not in ("recompute", "parent"):
        raise ValueError("unsplit must be 'recompute' or 'parent'")
    if unsplit == "parent" and criterion != "i2":
        raise ValueError("unsplit='parent' is defined for i2 only")
    if stop_no_gain is None:
        stop_no_gain = criterion == "i1"
    space = weights if isinstance(weights, Space) else prepare(weights, rows)
    grower = _Grower(space, criterion, restarts, max_iter, eps, seed, unsplit)
    root = grower.plant(init_restarts)

    frontier = [root]
    done: list[Node] = []
    created = 1
    while len(frontier) < cluster_num:
        ready = sorted((n for n in frontier if grower.splittable(n)), key=grower.priority)
        if not ready:
            break
        best = ready[0]
        if stop_no_gain and best.gain is not None and best.gain < 0:
            break
        if best.children is None:
            width = max(1, min(lookahead, cluster_num - len(frontier)))
            waiting = [n for n in ready if n.children is None]
            grower.expand(grower.broadcastable(waiting[:width]))
        best.popped = len(done) + 1
        done.append(best)
        frontier.remove(best)
        for child in best.children:
            created += 1
            child.seq = created
            frontier.append(child)

    return _result(space, grower, root, frontier, done, criterion)


class _Grower:
    def __init__(self, space, criterion, restarts, max_iter, eps, seed, unsplit):
        self.space = space
        self.criterion = criterion
        self.metric = metric_of(criterion)
        self.restarts = restarts
        self.max_iter = max_iter
        self.eps = eps
        self.seed = seed
        self.unsplit = unsplit
        self.round = 0
        self.children: dict[int, list[int]] = {}  # node -> ids of its children
        self.parents: dict[int, int] = {}
        self.numbers: dict[int, int] = {}  # ids below zero -> number of the node in the tree
        self.label = f"bisect{len(space.work.tables)}"
        # (space, nodes whose documents it holds).
        self.sources: list[tuple[Space, set[int]]] = [(space, {ROOT})]

    def broadcastable(self, nodes: list[Node]) -> list[Node]:
        """The first of ``nodes`` (at least one) whose children's centres fill at most ``ROUND_BLOCKS``
        broadcasts: two children have no more terms than twice their parent. Packed weights need no broadcast."""
        if self.space.packed is not None:
            return nodes
        room = ROUND_BLOCKS * broadcast_limit(self.space.work.spark) // row_bytes(2 + K * self.restarts)
        chosen: list[Node] = []
        for n in nodes:
            room -= K * n.split.centres.terms[n.node]
            if chosen and room < 0:
                break
            chosen.append(n)
        return chosen

    def plant(self, restarts: int) -> Node:
        self.init_restarts = restarts
        (root,) = self._split(self.space.docs, [ROOT], restarts, {})
        return root

    def expand(self, nodes: list[Node]) -> None:
        """Materialise the children of ``nodes`` and score a split of each child."""
        parents = {c: n for n in nodes for c in self.below(n.node)}
        live = self.members(nodes, children=True)
        children = self._split(live, list(parents), self.restarts, parents)
        by_id = {c.node: c for c in children}
        for n in nodes:
            n.children = [by_id[c] for c in self.below(n.node)]

    def below(self, node: int) -> list[int]:
        """Ids of the children of ``node``."""
        if node not in self.children:
            number = self.numbers.get(node, node)
            ids = [K * number + j for j in range(K)]
            if ids[-1].bit_length() > NUMBER_BITS:
                deep = {-len(self.numbers) - 1 - j: i for j, i in enumerate(ids)}
                self.numbers.update(deep)
                ids = list(deep)
            self.children[node] = ids
            self.parents.update(dict.fromkeys(ids, node))
        return self.children[node]

    def members(self, nodes: list[Node], children: bool) -> DataFrame:
        """``(doc_id, node)`` of the given nodes, or of the children they split into."""
        parts = []
        for split in {id(n.split): n.split for n in nodes}.values():
            here = [n for n in nodes if n.split is split]
            rows = split.assigned.where(F.col("node").isin([n.node for n in here]))
            node = F.col("node")
            if children:
                side = None
                for r in sorted({n.restart for n in here}):
                    chosen = F.col("node").isin([n.node for n in here if n.restart == r])
                    if side is None:
                        side = F.when(chosen, F.col(f"k_{r}"))
                    else:
                        side = side.when(chosen, F.col(f"k_{r}"))
                number = (node * K + side).cast("long")
                for n in here:
                    ids = self.below(n.node)
                    if ids[0] < 0:
                        number = F.when(node == n.node, F.lit(ids[0]) - side).otherwise(number)
                node = number.cast("long")
            parts.append(rows.select("doc_id", node.alias("node")))
        return reduce(DataFrame.unionByName, parts)

    def source(self, live: DataFrame, ids: list[int], docs: int) -> Space:
        """The smallest stored table with all documents of ``ids``.

        When the round needs only a small part of it, that part is written as a new table first:
        every pass of this round and of the rounds below it then reads that much less.
        """
        whole = [s for s, held in self.sources if all(self._within(i, held) for i in ids)]
        space = min(whole, key=lambda s: s.num_doc)
        if self.space.packed is not None or space.rows < SHRINK_MIN_ROWS or docs * SHRINK >= space.num_doc:
            return space
        part = space.table.join(live.select("doc_id").hint("shuffle_hash"), "doc_id")
        small = space.subset(part, docs, f"{self.label}_{self.round}_weights")
        self.sources.append((small, set(ids)))
        return small

    def _within(self, node: int | None, roots: set[int]) -> bool:
        """Whether ``node`` is one of ``roots`` or lies below one."""
        while node is not None and node not in roots:
            node = self.parents.get(node)
        return node is not None

    def _split(self, live, ids, restarts, parents) -> list[Node]:
        self.round += 1
        above = {p.node: p for p in parents.values()}
        docs = sum(n for p in above.values() for n in p.sides) if parents else self.space.num_doc
        split = split_nodes(
            self.source(live, ids, docs),
            live,
            K,
            self.metric,
            self.max_iter,
            restarts,
            self.seed,
            self.eps,
            f"{self.label}_{self.round}",
            {i: self.numbers[i] for i in ids if i in self.numbers},
        )
        # Collected through a frame of its own: a kept frame that has run holds on to what it broadcast.
        rows = split.stats.select("*").collect()
        return [self._node(row, split, restarts, parents.get(row.node)) for row in rows]

    def _node(self, row, split: Split, restarts: int, parent: Node | None) -> Node:
        best, score = rank_restarts(row, self.criterion, K, restarts)[0]
        unsplit = self._unsplit(row, parent)
        worth = None
        if score is not None and unsplit is not None:
            worth = gain(self.criterion, score, unsplit)
        return Node(
            node=row.node,
            seq=1,
            n=row.n,
            split=split,
            restart=best,
            score=score,
            unsplit=unsplit,
            cohesion=row.cohesion,
            sse=row.sse,
            gain=worth,
            sides=[row[f"n_{best}_{j}"] for j in range(K)],
            side_score=[row[f"S_{best}_{j}"] for j in range(K)],
            side_e=[row[f"E_{best}_{j}"] for j in range(K)],
            side_d=[row[f"D_{best}_{j}"] for j in range(K)],
            parent=None if parent is None else parent.node,
        )

    def _unsplit(self, row, parent: Node | None) -> float | None:
        side = self.below(parent.node).index(row.node) if parent else None
        if parent is None and self.criterion in ("e1", "h1", "h2"):
            return None  # no parent split to take the centre from
        if parent is not None and self.unsplit == "parent":
            return parent.side_score[side]
        parent_e = None if parent is None else parent.side_e[side]
        try:
            return unsplit_score(self.criterion, row.cohesion, row.sse, row.n, parent_e)
        except ZeroDivisionError:
            return None

    def splittable(self, node: Node) -> bool:
        if node.score is None:
            return False
        return node.node == ROOT or self.criterion == "largest" or node.gain is not None

    def priority(self, node: Node):
        """Smallest first: best gain (or most documents), earliest created on ties."""
        if self.criterion == "largest":
            return (-node.n, node.seq)
        if node.gain is None:
            return (float("-inf"), node.seq)
        # To nine digits, so that the order in which partitions were summed decides no tie.
        worth = float(f"{round(node.gain, 12):.9g}")
        return (worth if self.criterion == "e1" else -worth, node.seq)


def _result(space, grower, root, leaves, done, criterion) -> Bisection:
    spark = space.work.spark
    members = grower.members(leaves, children=False)
    # One row per leaf: at most cluster_num.
    first = {r.node: r.first for r in members.groupBy("node").agg(F.min("doc_id").alias("first")).collect()}
    ordered = sorted(leaves, key=lambda n: (-n.n, first[n.node]))
    number = {n.node: i for i, n in enumerate(ordered, 1)}

    numbers = local_table(
        spark,
        {
            "node": pa.array(list(number), pa.int64()),
            "cluster": pa.array(list(number.values()), pa.int32()),
        },
    )
    classes = members.join(F.broadcast(numbers), "node").select("doc_id", "cluster", "node")
    report = local_table(
        spark,
        {
            "cluster": pa.array([number[n.node] for n in ordered], pa.int32()),
            "node": pa.array([n.node for n in ordered], pa.int64()),
            "n": pa.array([n.n for n in ordered], pa.int64()),
            "gain": pa.array([n.gain for n in ordered], pa.float64()),
            "cohesion": pa.array([n.cohesion for n in ordered], pa.float64()),
            "sse": pa.array([n.sse for n in ordered], pa.float64()),
        },
    )
    everyone = sorted(done + leaves, key=lambda n: n.seq)
    tree = local_table(
        spark,
        {
            "node": pa.array([n.node for n in everyone], pa.int64()),
            "parent": pa.array([n.parent for n in everyone], pa.int64()),
            "split_order": pa.array([n.popped for n in everyone], pa.int32()),
            "n": pa.array([n.n for n in everyone], pa.int64()),
            "gain": pa.array([n.gain for n in everyone], pa.float64()),
            "cluster": pa.array([number.get(n.node) for n in everyone], pa.int32()),
        },
    )
    first_split = root.split
    moved = first_split.shifts(space, grower.init_restarts, K, grower.metric)
    summary = {
        "criterion": criterion,
        "restart": root.restart,
        "iterations": root.split.iterations(ROOT, root.restart),
        "shift": moved[ROOT, root.restart],
        "score": root.score,
        "separation": sum(root.side_d if grower.metric == "euclid" else root.side_e),
        "num_doc": space.num_doc,
        "num_term": space.num_term,
        "clusters": len(leaves),
        "rounds": grower.round,
    }
    centres, scores = _first_split(root)
    return Bisection(classes, report, tree, space, summary, centres, scores)


def _first_split(root: Node) -> tuple[DataFrame, DataFrame]:
    """``(k, term_id, w)``: centres of the first split; ``(k, score, n)``: its evaluated sides."""
    spark = root.split.assigned.sparkSession
    sums = root.split.centres.sums.where(f"node = {ROOT} AND term_id <> {COUNT}")
    sizes = [max(1.0, root.split.centres.n[ROOT, root.restart, j]) for j in range(K)]
    sides = ", ".join(f"{j}, x_{root.restart}_{j} / {sizes[j]!r}D" for j in range(K))
    centres = sums.selectExpr("term_id", f"stack({K}, {sides}) AS (k, w)").where("w <> 0")
    scores = local_table(
        spark,
        {
            "k": pa.array(range(K), pa.int32()),
            "score": pa.array(root.side_score, pa.float64()),
            "n": pa.array(root.sides, pa.int64()),
        },
    )
    return centres.select("k", "term_id", "w"), scores

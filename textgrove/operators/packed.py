"""K-means passes over weights packed by term.

Weights are packed once into rows of whole terms: every document of a term is in the same row. A task knows of each
document only its node and the sides whose centres it counts for, a few bytes that are broadcast, and that is enough to
sum the centres of the terms it reads and to multiply them again with the same weights. So no centre table is ever
shuffled, written or broadcast; a pass moves the inner products of each document, once per task, and one task per core
reads all rows. Sums per node (lengths, shifts, cohesion) come out of the same pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgrove.sources.numbering import number_rows
from textgrove.workspace import ROWS_PER_BUCKET, Workspace, broadcast_limit, short_rows

# Weights of one packed row, but for terms with more documents than that.
PACK = 1 << 18
# Documents whose inner products make one row.
CHUNK = 1 << 16
# A Python broadcast is a file on the driver, not held there as the rows and hash table of a join are.
STATE_BROADCASTS = 4
# Inner products a task adds up.
SUMS_BYTES = 256 * 1024 * 1024
PACKED_SCHEMA = "terms BINARY, df BINARY, num BINARY, w BINARY"


@dataclass
class Packed:
    """All weights of a space by term, and its documents by number."""

    rows: DataFrame  # PACKED_SCHEMA: term ids, weights per term, and of each weight its document and value
    numbers: DataFrame  # (doc_id, num), bucketed by doc_id
    norms: object  # broadcast array: vector length by document number
    num_doc: int
    basis: int  # documents by which the global centroid divides
    tasks: int


def fits(space, restarts: int, k: int) -> bool:
    """Whether a task can hold the state and the inner products of every document."""
    state = 10 + 2 * restarts * math.ceil(k / 8)
    small = space.num_doc * state <= STATE_BROADCASTS * broadcast_limit(space.work.spark)
    return small and space.num_doc * restarts * k * 8 <= SUMS_BYTES


def pack(space) -> Packed | None:
    """The weights of ``space`` packed by term; None when documents without an id are among them."""
    work, spark = space.work, space.work.spark
    known = space.docs.where("doc_id IS NOT NULL").select("doc_id", "norm")
    numbered = number_rows(known, ["doc_id"], "num", work)
    numbered = numbered.selectExpr("doc_id", "CAST(num - 1 AS INT) AS num", "norm").repartition(space.buckets, "doc_id")
    numbers = work.write_bucketed(numbered, "numbers", "doc_id", space.buckets, ["doc_id"])
    norms = np.full(space.num_doc, np.nan)
    found = numbers.select("num", "norm").toArrow()
    if found.num_rows != space.num_doc:
        return None
    norms[found["num"].to_numpy()] = found["norm"].to_numpy()
    parts = max(1, math.ceil(space.rows / ROWS_PER_BUCKET), spark.sparkContext.defaultParallelism)
    rows = space.weights.where("w IS NOT NULL").select("doc_id", F.col("term_id").cast("long").alias("term"), "w")
    rows = rows.join(numbers.select("doc_id", "num").hint("shuffle_hash"), "doc_id").select("term", "num", "w")
    dealt = rows.mapInArrow(_deal(parts), "part INT, term BINARY, num BINARY, w BINARY")
    packed = dealt.repartition(parts, "part").groupBy("part").applyInArrow(_pack(PACK), PACKED_SCHEMA)
    with short_rows(spark):
        packed = work.write(packed, "packed")
    tasks = spark.sparkContext.defaultParallelism
    return Packed(packed, numbers, spark.sparkContext.broadcast(norms), space.num_doc, space.basis, tasks)


def _deal(parts: int):
    """Weights dealt by term into ``parts``, a row for each part and bucket."""

    def dealt(held):
        term, num, w = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in range(3))
        part = ((term.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(parts)
        order = np.argsort(part.astype(np.int32), kind="stable")
        found, first = np.unique(part[order].astype(np.int32), return_index=True)
        ends = [*first[1:], len(order)]
        cut = lambda x: pa.array([x[order[a:b]].tobytes() for a, b in zip(first, ends)], pa.binary())
        columns = [pa.array(found), cut(term), cut(num), cut(w)]
        return pa.RecordBatch.from_arrays(columns, ["part", "term", "num", "w"])

    def deal(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= ROWS_PER_BUCKET:
                yield dealt(held)
                held, size = [], 0
        if size:
            yield dealt(held)

    return deal


def _joined(column, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column])


def _pack(size: int):
    """Rows of about ``size`` weights, whole terms each, the most frequent terms first."""

    def run(part):
        term, num, w = _joined(part["term"], np.int64), _joined(part["num"], np.int32), _joined(part["w"], np.float64)
        order = np.argsort(term, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(term[order]) != 0])
        df = np.diff(np.r_[first, len(order)])
        rank = np.argsort(-df, kind="stable")
        terms, df = term[order[first[rank]]], df[rank]
        begin = np.cumsum(df) - df
        order = order[np.repeat(first[rank] - begin, df) + np.arange(len(order))]
        num, w = num[order], w[order]
        cuts = [*np.unique(begin // size, return_index=True)[1], len(df)]
        rows = {"terms": [], "df": [], "num": [], "w": []}
        for a, b in zip(cuts, cuts[1:]):
            here = slice(begin[a], begin[b - 1] + df[b - 1])
            for name, x in (("terms", terms[a:b]), ("df", df[a:b].astype(np.int32)), ("num", num[here]), ("w", w[here])):
                rows[name].append(x.tobytes())
        return pa.table({name: pa.array(x, pa.binary()) for name, x in rows.items()})

    return run


@dataclass
class State:
    """What a pass knows of the documents, by their numbers."""

    nodes: np.ndarray  # ids of the nodes
    at: np.ndarray  # index of each document's node, -1 for none
    k: int
    now: np.ndarray  # (restart, byte, document): bit j of the bytes: the centre of side j counts the document
    old: np.ndarray | None = None  # the same one iteration earlier
    n: np.ndarray | None = None  # (node, slot): documents the centres count
    m: np.ndarray | None = None  # the same one iteration earlier

    @property
    def slots(self) -> list[tuple[int, int]]:
        return [(r, j) for r in range(len(self.now)) for j in range(self.k)]


def _cells(state: State, batches):
    """Per packed row: term ids, then of its live weights document, value and cell, of each cell its term and node.

    A cell is a term in a node. Rows of few frequent terms have a cell for every pair, others for pairs that occur.
    """
    width = len(state.nodes)
    for batch in batches:
        for row in range(batch.num_rows):
            read = lambda name, kind: np.frombuffer(batch.column(name)[row].as_buffer(), kind)  # noqa: B023, E731
            terms, df = read("terms", np.int64), read("df", np.int32)
            num, w = read("num", np.int32), read("w", np.float64)
            whole = np.add.reduceat(w, np.cumsum(df) - df)
            at, term = state.at[num], np.repeat(np.arange(len(df)), df)
            live = at >= 0
            if not live.all():
                num, w, at, term = num[live], w[live], at[live], term[live]
            if not len(num):
                continue
            key = term * width + at
            if len(df) * width <= 4 * len(num):
                names = np.arange(len(df) * width)
            else:
                names, key = np.unique(key, return_inverse=True)
            yield terms, whole, num, w, key, names // width, names % width


def _summed(state: State, masks: np.ndarray, slot, num, w, key, cells: int) -> np.ndarray:
    """The centre of ``slot`` in every cell: the summed weights of the documents it counts."""
    r, j = slot
    counts = (masks[r, j >> 3][num] >> np.uint8(j & 7)) & np.uint8(1)
    return np.bincount(key, w * counts, cells)


def _pass(known, norms, num_doc: int, basis: int, euclid: bool, whole_nodes: bool):
    """Inner products of all documents with all centres, by chunks, and the sums of each node."""

    def run(batches):
        state = known.value
        width, slots = len(state.nodes), state.slots
        dots = np.zeros((len(slots), num_doc))
        per_node = np.zeros((4, width))  # terms, t * u, t * t, q
        per_slot = np.zeros((3, len(slots), width))  # squared length, with the global centroid, with the last centre
        for _, whole, num, w, key, term, node in _cells(state, batches):
            cells = len(node)
            add = lambda x: np.bincount(node, x, width)  # noqa: B023, E731
            if whole_nodes:
                norm = norms.value[num]
                t = np.bincount(key, w, cells)
                u = np.bincount(key, np.divide(w, norm, out=np.zeros(len(w)), where=norm > 0), cells)
                per_node += [add(np.bincount(key, minlength=cells) > 0), add(t * u), add(t * t), add(np.bincount(key, w * w, cells))]
            g = whole[term] / basis
            for s, slot in enumerate(slots):
                x = _summed(state, state.now, slot, num, w, key, cells)
                per_slot[0, s] += add(x * x)
                per_slot[1, s] += add(x * g)
                if state.old is not None:
                    o = _summed(state, state.old, slot, num, w, key, cells)
                    gap = (x / state.n[node, s] - o / state.m[node, s]) ** 2 if euclid else x * o
                    per_slot[2, s] += add(gap)
                np.add.at(dots[s], num, w * x[key])
        schema = pa.schema([("chunk", pa.int32()), ("data", pa.binary()), ("sums", pa.binary())])
        sums = np.concatenate([per_node.ravel(), per_slot.ravel()]).tobytes()
        yield pa.RecordBatch.from_pylist([{"chunk": -1, "data": None, "sums": sums}], schema)
        for chunk in range(-(-num_doc // CHUNK)):
            part = dots[:, chunk * CHUNK : (chunk + 1) * CHUNK]
            if part.any():
                yield pa.RecordBatch.from_pylist([{"chunk": chunk, "data": part.tobytes(), "sums": None}], schema)

    return run


def _nearest(known, norms, lengths: np.ndarray, sizes: np.ndarray, euclid: bool, tie: float, rows: bool):
    """Sides of the documents of one chunk: with ``rows`` one row a document, else packed by restart."""

    def run(key, parts):
        state, chunk = known.value, key[0].as_py()
        here = slice(chunk * CHUNK, (chunk + 1) * CHUNK)
        at, norm = state.at[here], norms.value[here]
        live = np.flatnonzero(at >= 0)
        dots = np.zeros((len(state.slots), len(at)))
        for part in parts["data"]:
            if part.is_valid:
                dots += np.frombuffer(part.as_buffer()).reshape(dots.shape)
        dots, norm, length, size = dots[:, live], norm[live], lengths[at[live]].T, sizes[at[live]].T
        if euclid:
            values = np.fmax(0.0, norm * norm + length * length / (size * size) - 2 * dots / size)
        else:
            scale = norm * length
            values = np.divide(dots, scale, out=np.zeros_like(dots), where=scale > 0)
        found, best = [], []
        for r in range(len(state.now)):
            value = values[r * state.k : (r + 1) * state.k]
            top = value.min(0) if euclid else value.max(0)
            near = tie * (1 + np.abs(top))
            found.append(np.argmax(value <= top + near if euclid else value >= top - near, axis=0).astype(np.int32))
            best.append(top)
        if not rows:
            sides = np.full((len(found), len(at)), -1, np.int32)
            sides[:, live] = found
            return pa.table({"chunk": pa.array([chunk], pa.int32()), "data": pa.array([sides.tobytes()], pa.binary())})
        columns = {"num": pa.array((live + here.start).astype(np.int32)), "node": pa.array(state.nodes[at[live]])}
        for r, (side, score) in enumerate(zip(found, best)):
            columns |= {f"k_{r}": pa.array(side), f"s_{r}": pa.array(score)}
        return pa.table(columns)

    return run


def _centre_rows(known):
    """``(node, term_id, x_r_j…)`` of every term in every node."""

    def run(batches):
        state = known.value
        for terms, _, num, w, key, term, node in _cells(state, batches):
            columns = [pa.array(state.nodes[node]), pa.array(terms[term])]
            columns += [pa.array(_summed(state, state.now, s, num, w, key, len(node))) for s in state.slots]
            yield pa.RecordBatch.from_arrays(columns, ["node", "term_id", *[f"x_{r}_{j}" for r, j in state.slots]])

    return run


@dataclass
class Round:
    """K-means of some nodes of a packed space; ``score`` is one pass over its weights."""

    work: Workspace
    packed: Packed
    state: State
    metric: str
    tie: float
    label: str
    sums: dict = field(default_factory=dict)  # of the last pass, by node index and slot
    whole: np.ndarray | None = None  # per node, see ``_pass``
    passes: int = 0
    known: object = None  # ``state`` as a broadcast

    def score(self) -> DataFrame:
        """Stores the inner products with the present centres."""
        packed, spark = self.packed, self.work.spark
        if self.known is not None:
            self.known.destroy()
        self.known = spark.sparkContext.broadcast(self.state)
        euclid = self.metric == "euclid"
        run = _pass(self.known, packed.norms, packed.num_doc, packed.basis, euclid, self.whole is None)
        found = packed.rows.coalesce(packed.tasks).mapInArrow(run, "chunk INT, data BINARY, sums BINARY")
        self.passes += 1
        self.stored = f"{self.label}_dots_{self.passes}"
        dots = self.work.write(found, self.stored)
        width, slots = len(self.state.nodes), len(self.state.slots)
        rows = dots.where("sums IS NOT NULL").select("sums").collect()  # one a task
        total = np.sum([np.frombuffer(r.sums) for r in rows], axis=0)
        if self.whole is None:
            self.whole = total[: 4 * width].reshape(4, width)
        square, along, moved = total[4 * width :].reshape(3, slots, width)
        self.sums = {"length": np.sqrt(square).T, "along": along.T, "moved": moved.T}
        chunks = spark.range(-(-packed.num_doc // CHUNK)).selectExpr("CAST(id AS INT) AS chunk", "CAST(NULL AS BINARY) AS data")
        return dots.where("data IS NOT NULL").select("chunk", "data").unionByName(chunks)

    def _sides(self, dots: DataFrame, schema: str, rows: bool) -> DataFrame:
        sizes = np.maximum(1.0, self.state.n)
        run = _nearest(self.known, self.packed.norms, self.sums["length"], sizes, self.metric == "euclid", self.tie, rows)
        return dots.groupBy("chunk").applyInArrow(run, schema)

    def sides(self, dots: DataFrame) -> np.ndarray:
        """(restart, document): nearest centre, -1 for documents of other nodes."""
        found = np.empty((len(self.state.now), self.packed.num_doc), np.int32)
        for row in self._sides(dots, "chunk INT, data BINARY", rows=False).collect():
            here = found[:, row.chunk * CHUNK : (row.chunk + 1) * CHUNK]
            here[:] = np.frombuffer(row.data, np.int32).reshape(here.shape)
        return found

    def assigned(self, dots: DataFrame, buckets: int, name: str) -> DataFrame:
        """``(doc_id, node, k_r…, s_r…)`` stored by document."""
        each = [f"k_{r} INT, s_{r} DOUBLE" for r in range(len(self.state.now))]
        rows = self._sides(dots, f"num INT, node LONG, {', '.join(each)}", rows=True)
        rows = rows.join(self.packed.numbers.select("doc_id", "num"), "num").repartition(buckets, "doc_id")
        rows = rows.select("doc_id", "node", *[f"{c}_{r}" for r in range(len(each)) for c in "ks"])
        return self.work.write_bucketed(rows, name, "doc_id", buckets, ["node", "doc_id"])

    def centres(self) -> DataFrame:
        """``(node, term_id, x_r_j…)`` of the present centres, summed when read."""
        slots = "".join(f", x_{r}_{j} DOUBLE" for r, j in self.state.slots)
        return self.packed.rows.mapInArrow(_centre_rows(self.known), f"node LONG, term_id LONG{slots}")

    def done(self) -> None:
        """Removes the inner products of the last pass."""
        self.work.remove(self.stored)


def masks(state: State, sides: np.ndarray) -> np.ndarray:
    """Bits of the side of each document, per restart."""
    found = np.zeros_like(state.now)
    for r, j in state.slots:
        found[r, j >> 3] |= (sides[r] == j).astype(np.uint8) << np.uint8(j & 7)
    return found


def counts(state: State, found: np.ndarray) -> np.ndarray:
    """(node, slot): documents whose bits are set."""
    live = state.at >= 0
    at, n = state.at[live], np.zeros((len(state.nodes), len(state.slots)))
    for s, (r, j) in enumerate(state.slots):
        bits = (found[r, j >> 3][live] >> np.uint8(j & 7)) & np.uint8(1)
        n[:, s] = np.bincount(at, bits, len(state.nodes))
    return n


def begin(work: Workspace, packed: Packed, live: DataFrame, seeds: list, restarts: int, k: int) -> State:
    """The state before the first pass: each centre counts its seed."""
    rows = live.join(packed.numbers, "doc_id").select("num", "node").toArrow()
    num, node = rows["num"].to_numpy(), rows["node"].to_numpy()
    nodes, index = np.unique(node, return_inverse=True)
    at = np.full(packed.num_doc, -1, np.int16 if len(nodes) < 1 << 15 else np.int32)
    at[num] = index
    ids = sorted({row.doc_id for row in seeds})
    numbers = {r.doc_id: r.num for r in packed.numbers.where(F.col("doc_id").isin(ids)).select("doc_id", "num").collect()}
    now = np.zeros((restarts, math.ceil(k / 8), packed.num_doc), np.uint8)
    for row in seeds:
        now[row.restart, row.k >> 3, numbers[row.doc_id]] |= np.uint8(1 << (row.k & 7))
    state = State(nodes, at, k, now)
    state.n = counts(state, now)
    return state

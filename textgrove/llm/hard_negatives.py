"""Hard negatives of anchor vectors, read from Hilbert-ordered blocks chosen by zone maps.

1. Vectors are made integers, sorted along a Hilbert curve over all their dimensions (those that vary
   most first) and cut into blocks of ``BLOCK`` rows. A block is one Parquet row: its vectors, and as zone map the
   smallest and largest value of each dimension and the labels it holds.
2. Interval arithmetic on a zone map bounds every inner product of an anchor with the block. An anchor reads a
   block only if the bounds meet one of the windows of scores it still looks for: first for its positives, from
   the worst of the best rows of its own block on; then, for each positive, for the window of its negatives, from the
   worst of the best that its own block has in that window on.
3. Chosen blocks are scored as matrix products. A task keeps the best rows of each window, skips
   what can no longer enter them, and gives those on to a ranking per window.

Anchors are sent to the tasks in parts of at most ``ANCHOR_BYTES``, one pass over the chosen blocks each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructType

from textgrove.llm.common import fields, map_arrow
from textgrove.workspace import Workspace

BLOCK = 512
BITS = 4  # of each dimension in a place on the curve
ANCHOR_BYTES = 16 * 1024 * 1024
ZONES = 64  # zone maps compared with all anchors at once
HELD = 1 << 20  # candidate rows a task holds before it ranks them
LARGEST = 1 << 52  # scores below this are exact in double precision


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of cell numbers below ``2 ** bits``, as rows of bytes in order.

    The rotations of the curve are undone dimension by dimension from the highest bit on, what remains is
    a Gray code along the dimensions, and the bits are interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for d in range(len(x)):
            inverted = (x[d] >> bit) & 1 == 1
            swapped = np.where(inverted, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(inverted, low, swapped)
            x[d] ^= swapped
    x = np.bitwise_xor.accumulate(x, axis=0)
    last, turn = x[-1], np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((last >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= turn
    planes = [(x >> bit) & 1 for bit in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: float) -> DataFrame:
    """``vec_id, label, v`` with ``v`` the components times ``scale``, rounded down.

    Rows with a null id, label or vector and those with a null or non-finite component are left out.
    """
    x = F.col(vector_col).cast("array<double>")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = rows.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull()).filter(usable)
    v = F.transform(x, lambda c: F.floor(c * scale))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as a matrix; short rows are filled with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out


def _numbers(values: np.ndarray, kind=np.int64) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


BLOCK_FIELDS = fields(
    n=IntegerType(), low=BinaryType(), high=BinaryType(), labels=BinaryType(), ids=BinaryType(), kinds=BinaryType(), data=BinaryType()
)


def _blocks(vectors: DataFrame, work: Workspace) -> tuple[DataFrame, int]:
    """The stored blocks, numbered, and the number of dimensions."""
    spread = vectors.select(F.posexplode("v").alias("d", "x")).groupBy("d")
    spread = spread.agg(F.var_pop("x").alias("spread"), F.min("x").alias("low"), F.max("x").alias("high"))
    spread = sorted(spread.collect(), key=lambda r: (-r.spread, r.d))  # one row per dimension
    dims = len(spread)
    if sum(max(abs(r.low), abs(r.high)) ** 2 for r in spread) >= LARGEST:
        raise ValueError("inner products of these vectors need more than 52 bits")
    order = np.array([r.d for r in spread], np.int64)
    base = np.array([r.low for r in spread], np.float64)
    step = np.array([(1 << BITS) / (r.high - r.low + 1) for r in spread])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if dims:
                cells = (_matrix(batch.column("v"), dims)[:, order] - base) * step
                keys = hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1), BITS)
            else:
                keys = np.zeros((batch.num_rows, 1), np.uint8)
            column = pa.array([k.tobytes() for k in keys], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "key"])

    keyed = map_arrow(vectors, place, StructType([*vectors.schema.fields, *fields(key=BinaryType()).fields]))
    keyed = keyed.repartitionByRange("key", "vec_id").sortWithinPartitions("key", "vec_id").drop("key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(start, BLOCK))
                while sum(b.num_rows for b in held) >= BLOCK:
                    table = pa.Table.from_batches(held).combine_chunks()
                    yield made(table.slice(0, BLOCK))
                    held = table.slice(BLOCK).to_batches()
        if sum(b.num_rows for b in held):
            yield made(pa.Table.from_batches(held).combine_chunks())

    def made(table: pa.Table) -> pa.RecordBatch:
        ids = table["vec_id"].to_numpy()
        by_id = np.argsort(ids, kind="stable")
        kinds = table["label"].to_numpy()[by_id]
        data = _matrix(table["v"].combine_chunks(), dims)[by_id]
        values = [_numbers(x) for x in (data.min(axis=0), data.max(axis=0), np.unique(kinds), ids[by_id], kinds, data)]
        types = [pa.int32()] + [pa.binary()] * 6
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([len(ids), *values], types)], names=BLOCK_FIELDS.names)

    blocks = map_arrow(keyed, cut, BLOCK_FIELDS).withColumn("block", F.monotonically_increasing_id())
    return work.write(blocks, "blocks"), dims


def _best_of_own(block: dict, positives: int, every: int, dims: int) -> list[dict]:
    """The anchors of a block; floor: the score of the last of so many best rows of its label there."""
    ids, kinds, data = (np.frombuffer(block[c], np.int64) for c in ("ids", "kinds", "data"))
    data = data.reshape(len(ids), dims)
    found = []
    for slot in np.flatnonzero(ids % every == 0):
        same = kinds == kinds[slot]
        same[slot] = False
        scores = np.sort(data[same] @ data[slot])[::-1]
        floor = int(scores[positives - 1]) if len(scores) >= positives else -LARGEST
        found.append({"vec_id": int(ids[slot]), "label": int(kinds[slot]), "slot": int(slot), "floor": floor, "v": data[slot].tobytes()})
    return found


def _anchors(blocks: DataFrame, positives: int, every: int, dims: int) -> DataFrame:
    kind = fields(vec_id=LongType(), label=LongType(), block=LongType(), slot=LongType(), floor=LongType(), v=BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                found = [{**a, "block": block["block"]} for a in _best_of_own(block, positives, every, dims)]
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=schema)

    schema = pa.schema([(f.name, pa.binary() if f.name == "v" else pa.int64()) for f in kind.fields])
    return map_arrow(blocks.select("block", "ids", "kinds", "data"), run, kind)


class Queries:
    """Some anchors with the windows of scores (low to high) that each looks for."""

    def __init__(self, table: pa.Table, dims: int):
        self.ids, self.label, self.block, self.slot = (table[c].to_numpy() for c in ("vec_id", "label", "block", "slot"))
        data = b"".join(table["v"].to_pylist())
        self.v = np.frombuffer(data, np.int64).reshape(len(self.ids), dims).astype(np.float64)
        self.low = table["floor"].to_numpy()[:, None].copy()
        self.high = np.full((len(self.ids), 1), LARGEST)
        self.same = True  # whether rows of the anchor's own label are looked for, or of others

    def bounds(self, rows: np.ndarray | slice, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each anchor with any vector between ``low`` and ``high`` (rows)."""
        up, down = np.maximum(self.v[rows], 0), np.minimum(self.v[rows], 0)
        return up @ low.T + down @ high.T, up @ high.T + down @ low.T

    def chosen(self, labels: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which anchors (rows) must read which blocks (columns), by their zone maps."""
        least, most = self.bounds(slice(None), low, high)
        need = np.zeros(least.shape, bool)
        for w in range(self.low.shape[1]):
            need |= (most >= self.low[:, w, None]) & (least <= self.high[:, w, None])
        for b, held in enumerate(labels):
            own = np.isin(self.label, held)
            need[:, b] &= own if self.same else ~own | (len(held) > 1)
        return need


def _choose(blocks: DataFrame, shared, dims: int) -> DataFrame:
    """``block, wanted``: the anchors (numbers in ``shared``) that read it; blocks that none reads are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, ZONES):
                rows = batch.slice(start, ZONES).to_pylist()
                low, high = (np.stack([np.frombuffer(r[c], np.int64) for r in rows]).astype(np.float64) for c in ("low", "high"))
                need = queries.chosen([np.frombuffer(r["labels"], np.int64) for r in rows], low, high)
                wanted = [_numbers(np.flatnonzero(n), np.int32) for n in need.T]
                found = [(r["block"], w) for r, w in zip(rows, wanted) if w]
                columns = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "wanted"])

    return map_arrow(blocks.select("block", "low", "high", "labels"), run, fields(block=LongType(), wanted=BinaryType()))


RESULT = fields(anchor=IntegerType(), window=IntegerType(), score=LongType(), vec_id=LongType())


def _ranked(parts: list[np.ndarray], k: int) -> np.ndarray:
    """The first ``k`` of each window of ``parts`` (columns anchor, window, score, id), ties by smaller id."""
    rows = np.concatenate(parts)
    rows = rows[np.lexsort((rows[:, 3], -rows[:, 2], rows[:, 1], rows[:, 0]))]
    start = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]
    at = np.arange(len(rows))
    return rows[at - np.maximum.accumulate(np.where(start, at, 0)) < k]


def _scored(blocks: DataFrame, wanted: DataFrame, shared, k: int, dims: int) -> DataFrame:
    """The first ``k`` rows of each window that a task sees in the blocks of ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        floor, held, size = queries.low.copy(), [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                part = _in_block(queries, floor, {c: batch.column(c)[i].as_py() for c in batch.schema.names}, k, dims)
                held += part
                size += sum(map(len, part))
                if size > HELD:
                    held = [_ranked(held, k)]
                    size = len(held[0])
                    ends = held[0][k - 1 :][(held[0][k - 1 :, :2] == held[0][: size - k + 1, :2]).all(axis=1)]
                    np.maximum.at(floor, (ends[:, 0], ends[:, 1]), ends[:, 2])
        rows = _ranked(held, k) if held else np.empty((0, 4), np.int64)
        columns = [pa.array(rows[:, i].astype(t)) for i, t in enumerate((np.int32, np.int32, np.int64, np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=RESULT.names)

    return map_arrow(blocks.join(wanted, "block").drop("n", "labels"), run, RESULT)


def _in_block(queries: Queries, floor: np.ndarray, block: dict, k: int, dims: int) -> list[np.ndarray]:
    ids, kinds, data, low, high = (np.frombuffer(block[c], np.int64) for c in ("ids", "kinds", "data", "low", "high"))
    rows = np.frombuffer(block["wanted"], np.int32)
    least, most = queries.bounds(rows, low[None, :].astype(np.float64), high[None, :].astype(np.float64))
    rows = rows[((most >= floor[rows]) & (least <= queries.high[rows])).any(axis=1)]
    if not len(rows):
        return []
    scores = (queries.v[rows] @ data.reshape(len(ids), dims).astype(np.float64).T).astype(np.int64)
    usable = (queries.label[rows][:, None] == kinds[None, :]) == queries.same
    own = np.flatnonzero(queries.block[rows] == block["block"])
    usable[own, queries.slot[rows[own]]] = False
    place = len(ids) - 1 - np.arange(len(ids))  # rows of a block ascend by id
    found = []
    for w in range(floor.shape[1]):
        fits = usable & (scores >= floor[rows, w, None]) & (scores <= queries.high[rows, w, None])
        key = np.where(fits, scores * len(ids) + place, np.iinfo(np.int64).min)
        if key.shape[1] > k:
            best = np.argpartition(key, -k, axis=1)[:, -k:]
        else:
            best = np.broadcast_to(np.arange(key.shape[1]), key.shape)
        a, b = np.nonzero(np.take_along_axis(fits, best, axis=1))
        at = best[a, b]
        if len(a):
            found.append(np.stack([rows[a].astype(np.int64), np.full(len(a), w), scores[a, at], ids[at]], axis=1))
    return found


def _first(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: float = 256.0,
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``, scores exact integers.

    Anchors are the rows whose id ``every`` divides, scores inner products of the integer vectors, higher first,
    ties by smaller id. An anchor's positives are its first other rows of the same label; the negatives of
    each are the first rows of other labels whose score is ``low`` to ``high`` per cent of the positive's.
    Rows with a null id, label or vector, or a null or non-finite component, take no part; of vectors of different
    lengths the shorter ones count as filled with zeros. Repeated rows are rows of their own: each anchor
    row gives its own result. Anchors without positives, and positives without negatives, give no rows,
    an empty table none. Other columns are ignored.
    """
    work = Workspace(rows.sparkSession)
    spark = rows.sparkSession
    blocks, dims = _blocks(integer_vectors(rows, id_col, vector_col, label_col, scale), work)
    anchors = work.write(_anchors(blocks, positives, every, dims), "anchors")
    count = anchors.count()
    parts = max(1, -(-count * 8 * (dims + 8 * positives) // ANCHOR_BYTES))
    dealt = anchors.withColumn("part", F.pmod(F.xxhash64("block", "slot"), F.lit(parts)))
    found = None
    for part in range(parts):
        table = dealt.filter(F.col("part") == part).drop("part").toArrow()
        queries = Queries(table, dims)
        shared = spark.sparkContext.broadcast(queries)
        best = _scored(blocks, _choose(blocks, shared, dims), shared, positives, dims)
        best = work.write(_first(best, positives), f"positives_{part}").toArrow()
        shared.unpersist()
        anchor, rank, score = (best[c].to_numpy() for c in ("anchor", "rank", "score"))
        queries.same = False
        queries.low = np.ones((len(queries.ids), positives), np.int64)
        queries.high = np.zeros((len(queries.ids), positives), np.int64)
        queries.low[anchor, rank - 1] = -(-low * score // 100)
        queries.high[anchor, rank - 1] = high * score // 100
        _raise_floors(queries, blocks, work, negatives, dims, f"own_{part}")
        shared = spark.sparkContext.broadcast(queries)
        hard = _first(_scored(blocks, _choose(blocks, shared, dims), shared, negatives, dims), negatives)
        named = pa.table({
            "anchor": best["anchor"], "window": pa.array(rank - 1, pa.int32()), "anchor_id": pa.array(queries.ids[anchor]),
            "positive_id": best["vec_id"], "positive_score": best["score"],
        })
        # at most ``positives`` rows for each anchor of the part
        hard = hard.join(F.broadcast(spark.createDataFrame(named)), ["anchor", "window"])
        hard = hard.select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
        hard = work.write(hard, f"negatives_{part}")
        shared.unpersist()
        found = hard if found is None else found.unionByName(hard)
    return found


def _raise_floors(queries: Queries, blocks: DataFrame, work: Workspace, k: int, dims: int, name: str) -> None:
    """Start each window from the last of the ``k`` best that the anchor's own block has in it, if it has so many."""
    order = np.argsort(queries.block, kind="stable")
    names, starts = np.unique(queries.block[order], return_index=True)
    wanted = [_numbers(x, np.int32) for x in np.split(order, starts[1:])] if len(order) else []
    spark = blocks.sparkSession
    own = spark.createDataFrame(pa.table({"block": pa.array(names, pa.int64()), "wanted": pa.array(wanted, pa.binary())}))
    shared = spark.sparkContext.broadcast(queries)
    last = _first(_scored(blocks, F.broadcast(own), shared, k, dims), k).filter(F.col("rank") == k)
    last = work.write(last, name).toArrow()
    shared.unpersist()
    queries.low[last["anchor"].to_numpy(), last["window"].to_numpy()] = last["score"].to_numpy()

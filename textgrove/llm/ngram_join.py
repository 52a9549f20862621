"""Jaccard similarity self-join of word-shingle sets by token-combination prefixes.

1. Every text becomes the set of its shingles, 64-bit tokens; equal sets are one from then on. The same pass counts
   in how many texts each token occurs: sorted runs of tokens are shuffled by range and added up. Tokens of many texts
   are frequent (class 2, and class 3 from ``THRESHOLDS`` on), all others rare (class 1).
2. Tokens are ordered by class, then by value. The prefix of a set is extended until its rest cannot hold
   enough common tokens by itself: a rare token counts at once, of the frequent tokens of class k, which are dealt into groups, each
   group counts from its k-th token on. Two similar sets then share a rare token of their prefixes, or k tokens of
   one group of class k. Rare tokens are indexed alone, those of a group in combinations of k. Sets are
   compared within bands of sizes; the groups grow with the band, so that even a set of frequent tokens only has
   about as many signatures as tokens.
3. Sets that share a signature are candidates. First each meets one leader per signature only; what that links is
   one component, and only sets of different components need be compared after that, down to the last pair. No
   group of similar sets is ever paired with itself. Below signatures of many sets they are compared inside tasks, tile
   by tile, by their bitmaps; signatures of the same crowd are compared as one. A tile first gives only the closest pairs
   that connect its components, never more than it has sets; what these leave apart, and the bitmaps cannot
   rule out, becomes a row.
4. A pair is checked by length, then by an upper bound of the overlap from parity bitmaps of the sets, and what is left by
   counting common tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType

from textgrove.llm.common import fields, map_arrow, map_batches, map_texts, plain_text, sliced
from textgrove.llm.components import components
from textgrove.workspace import Workspace, broadcast_if_bounded

WORDS = 5
# Similarity 4/5: sets of sizes a and b link if 9 * common >= 4 * (a + b).
THRESHOLDS = (8, 256)  # texts from which a token is of class 2, 3
LISTED = 4_000_000  # frequent tokens that are sent to the tasks; beyond, the thresholds double
COUNTED = 1 << 20  # tokens a task counts at a time
RANGE_BYTES = 8 * 1024 * 1024  # of text whose tokens one task adds up
SHORT = 24  # low bits of a token that counting leaves out
PIECE = 1 << 20  # bytes of text whose words are hashed at once
REMEMBERED = 100_000  # sets
BLANK = re.compile(rb"[\x09-\x0d ]")
IS_BLANK = np.isin(np.arange(256), [*range(9, 14), 32])
DEALT = 1024  # rows of one key that meet in a task
CROWD = 32  # sets below a signature from which their pairs are tested before they become rows
LONG = 2048  # tokens; below a signature, bitmaps of larger sets are not copied
YIELD = 10  # leaders are drawn anew while one in so many of their pairs links
FACTORS = np.random.default_rng(7).integers(1 << 62, 1 << 63, 12, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * FACTORS[10]
    return x ^ (x >> np.uint64(29))


class Shingles:
    """Token sets of texts. Word hashes are differences of running sums over all bytes of many texts at once."""

    def __init__(self, seed: int):
        draw = np.random.default_rng([seed, 5])
        self.value = draw.integers(0, 1 << 64, 256, np.uint64)
        self.factor = int(draw.integers(0, 1 << 63)) * 2 + 1
        self.powers = self.inverse = np.empty(0, np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self.powers):
            back = pow(self.factor, -1, 1 << 64)
            self.powers, self.inverse = (
                np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, f, np.uint64)]) for f in (self.factor, back)
            )

    def _words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of ``data`` start, and their hashes. It is read in pieces that end between words."""
        starts, ids, at = [], [], 0
        while at < len(data):
            end = BLANK.search(data, at + PIECE)
            end = end.start() if end else len(data)
            piece = np.frombuffer(data, np.uint8, end - at, at)
            self._powers(len(piece) + 1)
            edge = np.flatnonzero(np.diff(np.concatenate(([True], IS_BLANK[piece], [True]))))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.value[piece] * self.powers[: len(piece)])))
            first, last = edge[::2], edge[1::2]
            starts.append(first + at)
            ids.append(_mixed((sums[last] - sums[first]) * self.inverse[first]))
            at = end
        return np.concatenate(starts or [np.empty(0, np.int64)]), np.concatenate(ids or [np.empty(0, np.uint64)])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The sorted distinct tokens of each; A-Z are lower-cased, words are runs without ASCII white space."""
        found, group, size = [], [], 0
        for text in texts:
            group.append(text.encode())
            size += len(group[-1])
            if size > PIECE:
                found += self._sets(group)
                group, size = [], 0
        return found + self._sets(group)

    def _sets(self, texts: list[bytes]) -> list[np.ndarray]:
        starts, ids = self._words(b"\n".join(texts).lower())
        ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])).tolist()
        n = max(0, len(ids) - WORDS + 1)
        tokens = _mixed(sum((ids[i : i + n] * FACTORS[i] for i in range(WORDS)), np.zeros(n, np.uint64)))
        found, first = [], 0
        for last in ends:
            if last - first >= WORDS:
                mine = np.sort(tokens[first : last - WORDS + 1])
            else:  # the whole sequence; its number of words tells it from others
                words = ids[first:last]
                mine = _mixed((words * FACTORS[: len(words)]).sum(dtype=np.uint64, keepdims=True) + FACTORS[11:] * np.uint64(len(words)))
                mine = mine[: len(words)]
            keep = np.ones(len(mine), bool)
            np.not_equal(mine[1:], mine[:-1], out=keep[1:])
            found.append(mine[keep])
            first = last
        return found


def parity(tokens: np.ndarray) -> bytes:
    """One bit per token value modulo a power of two, four to eight per token: whether an odd number of tokens has it."""
    size = max(64, 4 << (len(tokens) - 1).bit_length())
    hits = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits(hits & 1).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """A lower bound of how many tokens only one of two sets has; the longer bitmap is folded to the shorter."""
    x, y = (np.frombuffer(v, np.uint8) for v in sorted((a, b), key=len))
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


# --- sets and counts -----------------------------------------------------------------------------

SKETCH = fields(
    doc_id=LongType(), key=LongType(), sid=LongType(), digest=BinaryType(), n=LongType(), bits=BinaryType(),
    at=IntegerType(), tokens=BinaryType(),
)


def _run_of_tokens(held: list[np.ndarray], ranges: int) -> list[tuple[int, bytes]]:
    """Counted tokens by range: differences and counts, byte plane by byte plane, as high planes are nearly all zero."""
    tokens, n = np.unique(np.concatenate(held) >> np.uint64(SHORT), return_counts=True)
    width = (1 << (64 - SHORT)) // ranges
    cuts = np.searchsorted(tokens, np.arange(1, ranges, dtype=np.uint64) * np.uint64(width))
    found = []
    for at, (part, uses) in enumerate(zip(np.split(tokens, cuts), np.split(n, cuts))):
        if len(part):
            both = np.stack([np.diff(part, prepend=np.uint64(at * width)), uses.astype(np.uint64)])
            found.append((at, np.ascontiguousarray(both.view(np.uint8).reshape(-1, 8).T).tobytes()))
    return found


def _tokens_of_run(data: bytes, at: int, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).reshape(2, -1)
    return np.cumsum(both[0]) + np.uint64(at * ((1 << (64 - SHORT)) // ranges)), both[1]


def _sketch(docs: DataFrame, seed: int, ranges: int) -> DataFrame:
    """A row per row of ``docs(doc_id, key, text)``: its set; and rows with counted tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, held, size = Shingles(seed), [], 0
        for batch in sliced(batches, 500):
            sets = shingles(batch.column("text").to_pylist())
            raw = [s.tobytes() for s in sets]
            full = [len(s) > 0 for s in sets]
            yield made(
                batch.num_rows,
                doc_id=batch.column("doc_id"),
                key=batch.column("key"),
                sid=[xxhash.xxh3_64_intdigest(r) - (1 << 63) if f else None for r, f in zip(raw, full)],
                digest=[xxhash.xxh3_128_digest(r) if f else None for r, f in zip(raw, full)],
                n=[len(s) for s in sets],
                bits=[parity(s) if f else None for s, f in zip(sets, full)],
            )
            held += sets
            size += sum(map(len, sets))
            if size >= COUNTED:
                yield counted(held)
                held, size = [], 0
        if size:
            yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        found = _run_of_tokens(held, ranges)
        return made(len(found), at=[f[0] for f in found], tokens=[f[1] for f in found])

    def made(rows: int, **columns) -> pa.RecordBatch:
        types = [(f.name, pa.int64() if isinstance(f.dataType, LongType) else pa.binary()) for f in SKETCH.fields]
        types = [(name, pa.int32() if name == "at" else kind) for name, kind in types]
        arrays = [pa.array(columns[n], t) if n in columns else pa.nulls(rows, t) for n, t in types]
        return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in types])

    return map_arrow(docs, run, SKETCH)


def _frequent(sketch: DataFrame, ranges: int, work: Workspace) -> DataFrame:
    """``token, n``: the shortened tokens that at least ``THRESHOLDS[0]`` texts have, and in how many."""
    least = THRESHOLDS[0]

    def add(key: tuple, table: pa.Table) -> pa.Table:
        runs = [_tokens_of_run(t.as_py(), key[0].as_py(), ranges) for t in table["tokens"]]
        tokens, uses = (np.concatenate(x) for x in zip(*runs))
        order = np.argsort(tokens, kind="stable")
        tokens, uses = tokens[order], uses[order]
        starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        total = np.add.reduceat(uses, starts)
        kept = total >= least
        return pa.table({"token": tokens[starts][kept].astype(np.int64), "n": total[kept].astype(np.int64)})

    runs = sketch.filter("at IS NOT NULL").select("at", "tokens")
    return work.write(runs.groupBy("at").applyInArrow(add, fields(token=LongType(), n=LongType())), "frequent")


class Classes:
    """The class of each token: 1 if rare, else 2 or 3."""

    def __init__(self, frequent: DataFrame):
        low, high = THRESHOLDS
        while (kept := frequent.filter(F.col("n") >= low)).count() > LISTED:
            low, high = 2 * low, 2 * high
        table = kept.toArrow().sort_by("token")
        self.tokens = table["token"].to_numpy().astype(np.uint64)
        self.classes = np.where(table["n"].to_numpy() >= high, 3, 2).astype(np.int8)

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.ones(len(tokens), np.int8)
        short = tokens >> np.uint64(SHORT)
        at = np.minimum(np.searchsorted(self.tokens, short), len(self.tokens) - 1)
        return np.where(self.tokens[at] == short, self.classes[at], 1)


# --- signatures ----------------------------------------------------------------------------------


def _needed(n: int, partner: int) -> int:
    """Tokens that must count so that a set without them has too few in common with a set of ``partner`` or more."""
    return n + 1 - -(-4 * (n + partner) // 9)


def signatures(tokens: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The signatures of a set, in the band of its size and, if it may have larger partners there, the next.

    Sets below four tokens link with equal sets only and have none.
    """
    n = len(tokens)
    if n < 4:
        return np.empty(0, np.uint64)
    order = np.argsort(classes, kind="stable")
    tokens, classes = tokens[order], classes[order]
    band = n.bit_length()
    found = [_banded(tokens, classes, band, _needed(n, -(-4 * n // 5)))]
    if (5 * n // 4).bit_length() > band:
        found.append(_banded(tokens, classes, band + 1, _needed(n, 1 << band)))
    return np.concatenate(found)


def _banded(tokens: np.ndarray, classes: np.ndarray, band: int, needed: int) -> np.ndarray:
    rare = int(np.searchsorted(classes, 2))
    salt = FACTORS[9:10] * np.uint64(band)
    found = [_mixed(tokens[: min(rare, needed)] * FACTORS[0] + salt)]
    needed -= min(rare, needed)
    for k in (2, 3):
        if needed <= 0:
            break
        lo, hi = np.searchsorted(classes, (k, k + 1))
        groups = max(1, (1 << (band - 1)) // (8 * (k - 1)))
        members: list[list[int]] = [[] for _ in range(groups)]
        for token in tokens[lo:hi].tolist():
            group = members[(token >> 8) % groups]
            group.append(token)
            if len(group) >= k:
                needed -= 1
                if not needed:
                    break
        sets = [c for group in members for c in combinations(group, k)]
        if sets:
            parts = np.array(sets, np.uint64)
            found.append(_mixed((parts * FACTORS[1 : k + 1]).sum(axis=1, dtype=np.uint64) + salt * np.uint64(k)))
    return np.concatenate(found)


def _signed(docs: DataFrame, seed: int, classes) -> DataFrame:
    """``sig, sid``: the signatures of every set; a task gives those of a set once while it remembers it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, known, seen = Shingles(seed), classes.value, set()
        for batch in sliced(batches, 200):
            sigs, sids = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for tokens in shingles(batch.column("text").to_pylist()):
                sid = xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)
                if sid in seen:
                    continue
                if len(seen) > REMEMBERED:
                    seen.clear()
                seen.add(sid)
                sigs.append(signatures(tokens, known(tokens)))
                sids.append(np.full(len(sigs[-1]), sid, np.int64))
            columns = [pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(sids))]
            yield pa.RecordBatch.from_arrays(columns, names=["sig", "sid"])

    return map_arrow(docs.select("text"), run, fields(sig=LongType(), sid=LongType()))


def _shared(signed: DataFrame) -> DataFrame:
    """``sig, lead, sid``: the sets of every signature that several have, with the first of them.

    Rows stream by in order of signature; only the run at the border of two batches is remembered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, lead, last, told = None, None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs, sids = (batch.column(c).to_numpy() for c in ("sig", "sid"))
            start = np.r_[sigs[0] != sig, sigs[1:] != sigs[:-1]]
            at = np.maximum.accumulate(np.where(start, np.arange(len(sigs)), -1))
            leads = np.where(at >= 0, sids[at], lead if lead is not None else 0)
            repeated = ~start & (sids == np.r_[last if last is not None else 0, sids[:-1]])
            member = (sids != leads) & ~repeated
            owners, first = np.unique(sigs[member], return_index=True)
            heads = leads[member][first]
            if told and not start[0]:
                owners, heads = owners[owners != sig], heads[owners != sig]
            told = (bool(told) and sigs[-1] == sig and not start.any()) or bool((sigs[member] == sigs[-1]).any())
            sig, lead, last = sigs[-1], leads[-1], sids[-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[a, b]) for a, b in ((owners, sigs[member]), (heads, leads[member]), (heads, sids[member]))],
                names=["sig", "lead", "sid"],
            )

    placed = signed.repartition("sig").sortWithinPartitions("sig", "sid")
    return map_arrow(placed, run, fields(sig=LongType(), lead=LongType(), sid=LongType()))


# --- pairs ---------------------------------------------------------------------------------------


def _dealt_join(rows: DataFrame, table: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined to ``table`` (a row per key); rows of a hot key are dealt by ``by``, its row copied to each part."""
    hot = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / DEALT).alias("parts")).filter("parts > 1")
    n = hot.count()
    if not n:
        return rows.join(table, key)
    hot = broadcast_if_bounded(hot, n)
    one = F.lit(1).cast("long")
    rows = rows.join(hot, key, "left").withColumn("part", F.pmod(F.xxhash64(by), F.coalesce("parts", one))).drop("parts")
    table = table.join(hot, key, "left")
    table = table.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", one) - 1)))
    return rows.join(table.drop("parts"), [key, "part"]).drop("part")


class _Links:
    """Checks candidate pairs of sets; ``sets`` has sid, n, bits and the key of a row with its text."""

    def __init__(self, docs: DataFrame, sets: DataFrame, seed: int, work: Workspace):
        self.docs, self.sets, self.seed, self.work, self.step = docs, sets, seed, work, 0

    def of(self, pairs: DataFrame) -> DataFrame:
        """``a, b`` of the distinct ``pairs(a, b)`` whose sets are similar, written."""
        self.step += 1
        pairs = self.work.write(pairs.distinct(), f"pairs_{self.step}")
        self.tried = pairs.count()
        for end, other in (("a", "b"), ("b", "a")):
            side = self.sets.select(F.col("sid").alias(end), F.col("n").alias(f"n_{end}"), F.col("bits").alias(f"bits_{end}"))
            pairs = _dealt_join(pairs, side, end, other)
        sized = pairs.filter(SIZED)
        near = self.work.write(_bounded(sized), f"near_{self.step}")
        tokens = self._tokens(near)
        for end, other in (("a", "b"), ("b", "a")):
            side = tokens.select(F.col("sid").alias(end), F.col("tokens").alias(f"tokens_{end}"))
            near = _dealt_join(near, side, end, other)
        both = F.size(F.array_intersect("tokens_a", "tokens_b"))
        return self.work.write(near.filter(9 * both >= 4 * (F.col("n_a") + F.col("n_b"))).select("a", "b"), f"links_{self.step}")

    def _tokens(self, near: DataFrame) -> DataFrame:
        """``sid, tokens`` of the sets in ``near``, from one text of each."""
        wanted = near.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        wanted = self.work.write(wanted.join(self.sets.select("sid", "key"), "sid"), f"wanted_{self.step}")
        texts = self.docs.select("key", "text").join(broadcast_if_bounded(wanted, wanted.count()), "key")
        seed = self.seed

        def setup():
            shingles = Shingles(seed)
            return lambda texts: [[s.view(np.int64) for s in shingles(texts)]]

        tokens = map_texts(texts.select("sid", "text"), fields(tokens=ArrayType(LongType(), False)), setup)
        return self.work.write(tokens.dropDuplicates(["sid"]), f"tokens_{self.step}")


def _bounded(pairs: DataFrame) -> DataFrame:
    """``a, b, n_a, n_b`` of the pairs that differ in few enough tokens by their bitmaps."""
    kind = fields(a=LongType(), b=LongType(), n_a=LongType(), n_b=LongType())

    def setup():
        def make(batch: pa.RecordBatch) -> dict:
            least = np.array([differing(x, y) for x, y in zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist())])
            total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            # common = (total - differing) / 2, so that 9 * common >= 4 * total asks for 9 * differing <= total
            rows = pa.array(np.flatnonzero(9 * least <= total) if len(total) else [], pa.int64())
            return {f.name: batch.column(f.name).take(rows) for f in kind.fields}

        return make

    return map_batches(pairs, kind, setup)


SIZED = "5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)"


def _crossing(rows: DataFrame, members: DataFrame, work: Workspace, name: str) -> DataFrame:
    """``sig, sid, n, root`` of the signatures whose sets are in several components; ``members(sid, n, root)``."""
    rooted = work.write(rows.select("sig", "sid").join(members, "sid"), f"rooted_{name}")
    several = rooted.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    return work.write(rooted.join(several.select("sig"), "sig"), f"crossing_{name}")


def _remaining(rows: DataFrame, members: DataFrame, sets: DataFrame, work: Workspace, name: str) -> DataFrame:
    """``a, b``: all pairs of sets of different components of ``rows(sig, sid, n, root)`` that may be similar.

    Below a signature of few sets they are paired set by set. Larger crowds are tested in tiles, but for crowds of long sets.
    """
    rows = _crowded(rows, work, name)
    few = _direct(rows.filter("k IS NULL"))
    long = F.col("most") > LONG
    return few.union(_tiled(rows.filter(~long), sets, work, name)).union(_of_long(rows.filter(long), members, work))


def _closest(rows: DataFrame, sets: DataFrame, work: Workspace, name: str) -> DataFrame:
    """``a, b``: of the crowds that ``_remaining`` tests in tiles, what connects the components of each tile most closely."""
    rows = _crowded(rows, work, name).filter(F.col("most") <= LONG)
    return _tiled(rows, sets, work, name, closest=True)


def _crowded(rows: DataFrame, work: Workspace, name: str) -> DataFrame:
    """``rows(sig, sid, n, root)`` with the size ``k`` of the crowd, its ``most`` tokens and its first set; null for a few sets."""
    crowds = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("most"), F.min("sid").alias("lead"))
    crowds = work.write(crowds.filter(F.col("k") > CROWD), f"crowds_{name}")
    return rows.join(broadcast_if_bounded(crowds, crowds.count()), "sig", "left")


def _bundled(rows: DataFrame, work: Workspace, name: str) -> DataFrame:
    """``sig, sid, n, root, k``: crowds of ``rows`` with the same first set become one where that makes fewer comparisons.

    A group of similar sets has many signatures in common, and below each of them nearly the same sets.
    """
    rows = work.write(rows.select("sig", "sid", "n", "root", "k", "lead"), f"apart_{name}")
    one = F.count(F.lit(1))
    joint = work.write(rows.select("lead", "sid", "n", "root").distinct(), f"joint_{name}")
    # Every set of a crowd of k adds its k comparisons.
    apart = rows.groupBy("lead").agg(F.sum("k").alias("each"))
    merged = apart.join(joint.groupBy("lead").agg(one.alias("size")), "lead").filter("size * size <= each")
    merged = work.write(merged.select("lead", "size"), f"merged_{name}")
    held = broadcast_if_bounded(merged, merged.count())
    joint = joint.join(held, "lead").select(F.col("lead").alias("sig"), "sid", "n", "root", F.col("size").alias("k"))
    return rows.join(held, "lead", "left_anti").select("sig", "sid", "n", "root", "k").union(joint)


def _direct(rows: DataFrame) -> DataFrame:
    a, b = (rows.select("sig", *[F.col(c).alias(f"{c}_{end}") for c in ("sid", "n", "root")]) for end in "ab")
    pairs = a.join(b, "sig").filter("root_a < root_b").filter(SIZED)
    return pairs.select(F.col("sid_a").alias("a"), F.col("sid_b").alias("b"))


def near_in_tile(n: np.ndarray, root: np.ndarray, bits: list[bytes], side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a tile that sizes, components and bitmaps allow.

    ``side`` is 0 or 1; if both occur, only pairs of unlike sides are meant, as other tiles hold the rest.
    """
    return _measured(n, root, bits, side)[:2]


def closest_in_tile(n: np.ndarray, root: np.ndarray, bits: list[bytes], side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ``near_in_tile`` the pairs that connect all components it connects, the smallest shares of differing tokens first.

    These are fewer than the components of the tile. Every round joins each part to its nearest other one.
    """
    a, b, least = _measured(n, root, bits, side)
    order = np.lexsort((b, a, least / (n[a] + n[b])))
    a, b = a[order], b[order]
    names, part = np.unique(root, return_inverse=True)
    place, chosen = np.arange(len(a)), [np.empty(0, np.int64)]
    while len(place := place[part[a[place]] != part[b[place]]]):
        x, y = part[a[place]], part[b[place]]
        first = np.full(len(names), len(a))
        np.minimum.at(first, x, place)
        np.minimum.at(first, y, place)
        mine = np.flatnonzero(first < len(a))
        chosen.append(np.unique(first[mine]))
        to = np.arange(len(names))
        to[mine] = part[a[first[mine]]] + part[b[first[mine]]] - mine
        # Only two parts that chose each other go round in a circle: the smaller one stays.
        to = np.where((to[to] == np.arange(len(names))) & (np.arange(len(names)) < to), np.arange(len(names)), to)
        while (to[to] != to).any():
            to = to[to]
        part = to[part]
    at = np.concatenate(chosen)
    return a[at], b[at]


def _measured(n: np.ndarray, root: np.ndarray, bits: list[bytes], side: np.ndarray) -> np.ndarray:
    """Both places of each pair of ``near_in_tile``, and in how many tokens it differs at least."""
    lengths = np.array([len(x) for x in bits])
    parts = [(np.flatnonzero(lengths == w), w) for w in np.unique(lengths)]
    parts = [(at, w, np.frombuffer(b"".join(bits[i] for i in at), np.uint64).reshape(len(at), -1)) for at, w in parts]
    both = side.min() != side.max()
    found = [np.empty((3, 0), np.int64)]
    for i, (rows, width, mine) in enumerate(parts):
        for cols, other_width, theirs in parts[i:]:
            folded = np.bitwise_xor.reduce(theirs.reshape(len(cols), other_width // width, -1), axis=1)
            for start in range(0, len(rows), 64):
                a, b = rows[start : start + 64, None], cols[None]
                total = n[a] + n[b]
                fits = (root[a] != root[b]) & (5 * np.minimum(n[a], n[b]) >= 4 * np.maximum(n[a], n[b]))
                fits &= (a < b) | (rows is not cols)
                fits &= (side[a] != side[b]) | (not both)
                x, y = np.nonzero(fits)
                least = np.empty(len(x), np.int64)
                for at in range(0, len(x), 1 << 14):
                    span = slice(at, at + (1 << 14))
                    least[span] = np.bitwise_count(mine[start + x[span]] ^ folded[y[span]]).sum(axis=1)
                kept = 9 * least <= total[x, y]
                found.append(np.stack([rows[start + x[kept]], cols[y[kept]], least[kept]]))
    return np.concatenate(found, axis=1)


def _tiled(rows: DataFrame, sets: DataFrame, work: Workspace, name: str, closest: bool = False) -> DataFrame:
    """``a, b`` from crowds ``rows(sig, sid, n, root, k, lead)``: sets are dealt into blocks of about ``DEALT`` per crowd; a
    task holds two blocks, or one with itself, with the sets' bitmaps. ``closest`` takes ``closest_in_tile`` only."""
    rows = work.write(_bundled(rows, work, name), f"crowded_{name}")
    wanted = rows.select("sid").distinct()
    bits = work.write(wanted.join(sets.select("sid", "bits"), "sid"), f"crowded_bits_{name}")
    pairs = closest_in_tile if closest else near_in_tile
    blocks = F.ceil(F.col("k") / DEALT)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("sid", "sig"), blocks))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.select(
        "sig", "sid", "n", "root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        (F.col("own") > F.col("other")).cast("long").alias("side"),
    )
    rows = _dealt_join(rows, bits, "sid", "sig")

    def near(table: pa.Table) -> pa.Table:
        sid, n, root, side = (table[c].to_numpy() for c in ("sid", "n", "root", "side"))
        a, b = pairs(n, root, table["bits"].to_pylist(), side)
        return pa.table({"a": np.minimum(sid[a], sid[b]), "b": np.maximum(sid[a], sid[b])})

    return rows.groupBy("sig", "low", "high").applyInArrow(near, fields(a=LongType(), b=LongType()))


def _of_long(rows: DataFrame, members: DataFrame, work: Workspace) -> DataFrame:
    """``a, b`` either set by set below each signature, or each set of a smaller component with all sets of a larger one
    that it shares a signature with: whichever makes fewer rows, by their exact numbers."""
    rows = work.write(rows.select("sig", "sid", "n", "root"), "long")
    direct = _direct(rows)
    per = rows.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("k"))
    per = per.groupBy("sig").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("own"))
    n_direct = per.agg(F.sum((F.col("k") * F.col("k") - F.col("own")) / 2)).first()[0] or 0
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("low"), F.max("n").alias("high"))
    sizes = work.write(sizes, "sizes")
    kinds = rows.select("sig", "root").distinct().join(sizes, "root")
    other = F.struct("size", "root", "low", "high").alias("other")
    mine = rows.join(sizes.select("root", "size"), "root").select("sig", "sid", "n", F.struct("size", "root").alias("mine"))
    fits = "(mine.size, mine.root) < (other.size, other.root) AND 4 * n <= 5 * other.high AND 5 * n >= 4 * other.low"
    meets = mine.join(kinds.select("sig", other), "sig").filter(fits).select("sid", "n", "other.root", "other.size")
    meets = work.write(meets.distinct(), "meets")
    n_meets = meets.agg(F.sum("size")).first()[0] or 0
    if n_direct <= n_meets:
        return direct
    parts = F.ceil(F.col("size") / DEALT)
    part = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part")
    dealt = meets.select(F.col("sid").alias("a"), F.col("n").alias("n_a"), "root", part)
    held = members.join(sizes.select("root", "size"), "root")
    held = held.select("root", F.pmod(F.xxhash64("sid"), parts).alias("part"), F.col("sid").alias("b"), F.col("n").alias("n_b"))
    return dealt.join(held, ["root", "part"]).filter(SIZED).select("a", "b")


def _linked(rows: DataFrame, links: _Links, work: Workspace) -> DataFrame:
    """``sid, root`` of all sets but roots, for the candidates of ``rows(sig, lead, sid)``.

    After the first leaders every signature draws another one, each by itself, so that a set outside a crowd of
    similar sets meets many of them; this goes on while it links one in ``YIELD`` pairs. Then the closest pairs of crowds
    are tried in the same way, as their links spare all pairs of similar sets. What is left is compared in full.
    """
    drawn = True
    edges = links.of(rows.filter("lead <> sid").select(F.col("lead").alias("a"), F.col("sid").alias("b")))
    for turn in count():
        roots = components(edges, work, f"turn_{turn}").select(F.col("node").alias("sid"), "root")
        roots = work.write(roots, f"roots_{turn}")
        members = links.sets.select("sid", "n").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        members = work.write(members, f"members_{turn}")
        left = _crossing(rows, members, work, str(turn))
        if left.isEmpty():
            return roots
        if drawn:
            lead = F.struct(F.xxhash64("sid", "sig", F.lit(turn)).alias("h"), F.col("sid").alias("a"), F.col("root").alias("of"))
            led = left.join(left.groupBy("sig").agg(F.min(lead).alias("lead")), "sig").filter("root <> lead.of")
            found = links.of(led.select("lead.a", F.col("sid").alias("b")))
            edges = work.write(edges.unionByName(found), f"edges_{turn}")
            drawn = YIELD * found.count() >= links.tried
        if not drawn:
            found = links.of(_closest(left, links.sets, work, str(turn)))
            edges = work.write(edges.unionByName(found), f"closest_{turn}")
            if found.isEmpty() or YIELD * found.count() < links.tried:
                edges = work.write(edges.unionByName(links.of(_remaining(left, members, links.sets, work, "all"))), "edges_all")
                return components(edges, work, "all").select(F.col("node").alias("sid"), "root")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row per row of ``docs``.

    Documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8 are linked; ``component_id``
    is the smallest id reachable over links, itself included. Fewer words than five are one shingle; null, empty and
    wordless texts have no shingles and link with nothing. Rows without an id link like others and get the
    smallest id of their component (null if it has none). Repeated rows stay and are linked, if they have a
    word. An empty table gives no rows; other columns are ignored.
    """
    work = Workspace(docs.sparkSession)
    text = plain_text(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 1 << max(0, -(-size // RANGE_BYTES) - 1).bit_length()
    for seed in count():  # until no two sets have the same 64-bit name
        sketch = work.write(_sketch(rows, seed, ranges), f"sketch_{seed}")
        held = sketch.filter("sid IS NOT NULL")
        least = [F.min(c).alias(c) for c in ("n", "bits", "key")]
        sets = held.groupBy("sid").agg(*least, F.min("doc_id").alias("low"), F.min("digest").alias("x"), F.max("digest").alias("y"))
        sets = work.write(sets, f"sets_{seed}")
        if sets.filter("x <> y").isEmpty():
            break
    classes = rows.sparkSession.sparkContext.broadcast(Classes(_frequent(sketch, ranges, work)))
    shared = work.write(_shared(_signed(rows, seed, classes)), "shared")
    classes.unpersist()
    roots = _linked(shared, _Links(rows, sets, seed, work), work)
    rooted = sets.select("sid", "low").join(roots, "sid", "left").select("sid", "low", F.coalesce("root", "sid").alias("root"))
    rooted = work.write(rooted, "classes")
    names = work.write(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "names")
    named = work.write(rooted.join(names, "root").select("sid", "component_id"), "named")
    found = sketch.filter("at IS NULL").select("doc_id", "n", "sid")
    found = found.join(broadcast_if_bounded(named, named.count()), "sid", "left")
    own: Column = F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))

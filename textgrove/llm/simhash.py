"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a Hamming radius.

Candidates: fingerprints are cut into radius + 2 blocks of bits; two within the radius agree in at
least two blocks, so each fingerprint is put into one bucket per pair of blocks. Within a bucket all
are compared bit-sliced (see bitslice). A bucket above ``max_bucket`` distinct fingerprints is left
out there; its members are joined through all their one-bit variants instead, which meet for
any two fingerprints within two bits and give groups of at most 65. No pair is lost, no group grows.
Buckets give one edge per linked fingerprint, and components are found over those edges.
"""

from __future__ import annotations

import uuid
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from textgrove.llm.bitslice import linked_pairs, smallest_linked
from textgrove.llm.common import fields, map_batches, map_texts, plain_text
from textgrove.llm.components import components
from textgrove.workspace import Workspace

SEED = 42
SHINGLE = 3
RADIUS = 2
MAX_BUCKET = 1024
CHUNK = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles; no words give 0.

    A-Z are lower-cased; words are runs without ASCII white space. With fewer words than a
    shingle, the whole sequence is the only one.
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = iter([b" ".join(words)])
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for start in range(0, n, CHUNK):
        size = min(CHUNK, n - start)
        h = np.fromiter((digest(g, SEED) for g, _ in zip(grams, range(size))), np.uint64, size)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long), one row per row of ``docs``."""

    def setup():
        return lambda texts: [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]

    rows = docs.select(F.col(id_col).alias("doc_id"), plain_text(text_col).alias("text"))
    return map_texts(rows, fields(fp=LongType()), setup)


def _bucket_keys(radius: int):
    """(slot, key) for every pair of blocks of the fingerprint ``fp``."""
    edges = [64 * i // (radius + 2) for i in range(radius + 3)]
    blocks = [
        F.shiftrightunsigned("fp", lo).bitwiseAND((1 << (hi - lo)) - 1)
        for lo, hi in zip(edges, edges[1:])
    ]
    keys = [
        F.struct(F.lit(slot).alias("slot"), F.shiftleft(blocks[i], 32).bitwiseOR(blocks[j]).alias("key"))
        for slot, (i, j) in enumerate(combinations(range(radius + 2), 2))
    ]
    return F.explode(F.array(*keys))


def _edges(groups: DataFrame, radius: int) -> DataFrame:
    """``a, b``: each fingerprint of ``groups(fps array)`` with the smallest it is linked to."""

    def setup():
        def make(batch: pa.RecordBatch) -> dict:
            lists = batch.column("fps")
            fps = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.repeat(np.cumsum(sizes), sizes)
            root = smallest_linked(len(fps), *linked_pairs(fps, ends, radius))
            child = np.flatnonzero(root != np.arange(len(fps)))
            return {"a": fps[child].view(np.int64), "b": fps[root[child]].view(np.int64)}

        return make

    return map_batches(groups, fields(a=LongType(), b=LongType()), setup)


def links(distinct: DataFrame, radius: int, max_bucket: int, work: Workspace) -> DataFrame:
    """``a, b`` edges whose components are those of all links within ``radius`` over ``distinct(fp)``."""
    keyed = distinct.select("fp", _bucket_keys(radius).alias("k")).select("fp", "k.slot", "k.key")
    sizes = keyed.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = work.write(sizes, "bucket_sizes")
    small = keyed.join(sizes.filter(F.col("n") <= max_bucket), ["slot", "key"])
    small = small.groupBy("slot", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
    found = _edges(small, radius)
    large = sizes.filter(F.col("n") > max_bucket)
    if not large.isEmpty():
        crowded = keyed.join(large, ["slot", "key"], "left_semi").select("fp").distinct()
        flips = [F.col("fp")] + [
            F.col("fp").bitwiseXOR((1 << b) if b < 63 else -(1 << 63)) for b in range(64)
        ]
        variants = work.write(crowded, "crowded").select("fp", F.explode(F.array(*flips)).alias("v"))
        groups = variants.groupBy("v").agg(F.collect_list("fp").alias("fps"))
        found = found.union(_edges(groups.filter("size(fps) > 1").select("fps"), radius))
    return work.write(found.distinct(), "links")


def _classes(prints: DataFrame, radius: int, max_bucket: int, work: Workspace) -> DataFrame:
    """``fp, root`` for every fingerprint of ``prints(fp)``, written: root names its group."""
    if radius not in (0, 1, 2):
        raise ValueError("radius must be 0, 1 or 2")
    distinct = work.write(prints.select("fp").distinct(), "distinct")
    linked = components(links(distinct, radius, max_bucket, work), work)
    rooted = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
    return work.write(rooted.select("fp", F.coalesce("root", "fp").alias("root")), "rooted")


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = RADIUS,
    max_bucket: int = MAX_BUCKET,
) -> DataFrame:
    """Near-duplicate groups: ``doc_id, fingerprint, component_id``, one row per row of ``docs``.

    ``fingerprint`` is 16 lowercase hex digits, ``component_id`` the smallest id reachable over links
    of at most ``radius`` (0 to 2) differing bits, itself included. Null, empty and wordless
    texts have fingerprint zero and link like any other. Repeated rows stay. A row without id takes
    part in linking, but its group is named by the smallest id present (null if there is none).
    An empty table gives no rows; other columns are ignored.
    """
    work = Workspace(docs.sparkSession)
    prints = work.write(fingerprints(docs, id_col, text_col), "fingerprints")
    rooted = _classes(prints, radius, max_bucket, work)
    least = work.write(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "least")
    least = work.write(rooted.join(least, "fp"), "named")
    names = work.write(least.groupBy("root").agg(F.min("low").alias("component_id")), "names")
    classes = work.write(rooted.join(names, "root").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def near_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = RADIUS,
    max_bucket: int = MAX_BUCKET,
) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, columns as they were.

    Groups are those of ``simhash_groups``, but of rows: the row with the smallest id stays, of several
    with that id the one whose text has the smallest SHA-256, of equal rows one. A group whose rows have
    no id keeps one of them by the same order. Null, empty and wordless texts are one group. An
    empty table stays empty.
    """
    work = Workspace(docs.sparkSession)
    digest = F.sha2(plain_text(text_col), 256)
    mark, low = (f"{name}_{uuid.uuid4().hex}" for name in ("digest", "low"))  # clash with no column
    rows = docs.select(F.col(id_col).alias("doc_id"), digest.alias("digest"), plain_text(text_col).alias("text"))

    def setup():
        return lambda texts: [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]

    prints = work.write(map_texts(rows, fields(fp=LongType()), setup), "fingerprints")
    rooted = _classes(prints, radius, max_bucket, work)
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest", "n")
    least = prints.groupBy("fp", "doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    least = work.write(least.groupBy("fp").agg(F.min(order).alias(low)), "least")
    least = work.write(rooted.join(least, "fp").groupBy("root").agg(F.min(low).alias(low)), "kept")
    same = F.col(id_col).eqNullSafe(F.col(f"{low}.doc_id")) & (F.col(mark) == F.col(f"{low}.digest"))
    kept = docs.withColumn(mark, digest).join(least.select(low), same)
    once = kept.filter(F.col(f"{low}.n") == 1).select(*docs.columns)
    repeated = kept.filter(F.col(f"{low}.n") > 1).dropDuplicates([id_col, mark]).select(*docs.columns)
    return once.unionByName(repeated)

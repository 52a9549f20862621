"""Merkle manifest of a table: one tree per group, and one tree over the groups' roots.

Leaves are numbered within their group in a global sort that no group is gathered for. Level by level
every node meets its siblings in an equijoin on the index a sibling must have (index XOR 1 in binary
trees, an offset of the slot otherwise); the nodes of slot zero emit the parents. All trees grow together;
one that is down to its root waits. The siblings of each level are stored, and proofs are pushed back
down from the roots: a node's proof is its siblings followed by its parent's proof, so that a level costs one
join on the parent's index and not one per leaf and level. Digests are kept as 32 bytes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textgrove.sources.numbering import number_rows
from textgrove.workspace import Workspace, broadcast_limit

ARITY = 2


def hashed(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, which are strings or digests as hex text, one after another."""
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length of the value as text, a colon and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: str | Column) -> Column:
    """The leaf digest of a row: the hash of its encoded columns."""
    return hashed(*[encoded(F.col(c) if isinstance(c, str) else c) for c in columns])


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes(tree, n, idx, d)`` with ``l`` and ``r``: the digests before and after in the node's run."""
    slot = F.pmod("idx", F.lit(arity))
    found = nodes.withColumn("slot", slot)
    right = nodes.select("tree", F.col("idx").alias("at"), F.col("d").alias("sibling"))
    for o in range(1, arity):
        place = F.pmod(F.col("slot") + o, F.lit(arity))
        at = F.col("idx").bitwiseXOR(F.lit(1).cast("long")) if arity == 2 else F.col("idx") - F.col("slot") + place
        found = found.withColumn("at", at).join(right, ["tree", "at"], "left")
        found = found.withColumn(f"s_{o}", F.struct(place.alias("slot"), F.col("sibling").alias("d"))).drop("at", "sibling")
    run = F.array_sort(F.array(*[F.col(f"s_{o}") for o in range(1, arity)]))

    def joined(keep):
        return F.array_join(F.transform(F.filter(run, lambda s: s["d"].isNotNull() & keep(s["slot"])), lambda s: F.hex(s["d"])), "")

    before, after = joined(lambda s: s < F.col("slot")), joined(lambda s: s > F.col("slot"))
    return found.select("tree", "n", "idx", "d", F.unhex(before).alias("l"), F.unhex(after).alias("r"))


def _grow(nodes: DataFrame, largest: int, arity: int, name: str, work: Workspace) -> tuple[list[DataFrame], DataFrame]:
    """The stored levels of all trees of ``nodes`` with siblings, and the roots ``tree, d``."""
    levels = []
    while largest > 1:
        level = work.write(_with_siblings(nodes, arity), f"{name}_{len(levels)}")
        levels.append(level)
        up = F.when(F.col("n") == 1, F.col("d")).otherwise(F.unhex(hashed(_hex(F.col("d")), _hex(F.col("r")))))
        nodes = level.filter(F.pmod("idx", F.lit(arity)) == 0).select(
            "tree", F.ceil(F.col("n") / arity).alias("n"), F.expr(f"idx div {arity}").alias("idx"), up.alias("d")
        )
        largest = -(-largest // arity)
    return levels, nodes.select("tree", "d")


def _proofs(levels: list[DataFrame], tops: DataFrame, arity: int, name: str, work: Workspace) -> DataFrame:
    """``tree, idx, path`` of the lowest level; ``tops(tree, path)`` are the paths of the roots."""
    step = "array<struct<l: binary, r: binary>>"
    paths = tops.select("tree", F.lit(0).cast("long").alias("up"), F.col("path").alias("rest"))
    for i in range(len(levels) - 1, -1, -1):
        own = F.when(F.col("n") > 1, F.array(F.struct("l", "r"))).otherwise(F.array().cast(step))
        here = levels[i].withColumn("up", F.expr(f"idx div {arity}")).join(paths, ["tree", "up"])
        here = here.select("tree", "idx", F.concat(own, "rest").alias("path"))
        if i == 0:
            return here
        paths = work.write(here, f"{name}_paths_{i}").select("tree", F.col("idx").alias("up"), F.col("path").alias("rest"))
    return tops.select("tree", F.lit(0).cast("long").alias("idx"), "path")


def proof_digest(path: str = "path") -> Column:
    """The hash of the siblings, level by level from the leaf to the root, left to right."""
    parts = F.transform(path, lambda s: F.concat(_hex(s["l"]), _hex(s["r"])))
    return hashed(F.array_join(parts, ""))


def fold(start: Column, path: str = "path") -> Column:
    """The root that the leaf digest ``start`` (hex) and the siblings on its path give."""
    return F.aggregate(path, start, lambda d, s: hashed(_hex(s["l"]), d, _hex(s["r"])))


def manifest(rows: DataFrame, group: str, order: str, digest: str = "leaf", arity: int = ARITY) -> DataFrame:
    """``rows`` with ``subroot``, ``root`` (hex) and ``path``, for ``rows`` with a leaf digest (hex) each.

    Leaves of a ``group`` ascend by ``order`` (null first), then by digest; rows equal in both are told
    apart by place, and as their digests are equal, all digests but their paths are the same either way.
    While several nodes remain, every ``arity`` consecutive ones (the last run: what is left, even one)
    become the hash of their digests. What remains is the group's subroot, a lone leaf itself. Subroots in the order
    of the groups (null is a group and comes first, others bytewise) give the root likewise. ``path`` lists the
    siblings from the leaf to the root, per level those to the left and right. Columns named like the
    three results are replaced; an empty table gives no rows.
    """
    work = Workspace(rows.sparkSession)
    kept = [c for c in rows.columns if c not in ("subroot", "root", "path")]
    packed = rows.select(
        F.struct(*kept).alias("row"), F.col(group).alias("group"), F.col(order).alias("id"), F.col(digest).alias("leaf"),
        F.monotonically_increasing_id().alias("tie"),
    )
    placed = number_rows(packed, ["group", "id", "leaf", "tie"], "place", work)
    groups = placed.groupBy("group").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = work.write(number_rows(groups, ["group"], "tree", work), "groups")
    size = groups.agg(
        F.count(F.lit(1)).alias("trees"), F.max("n").alias("largest"),
        F.coalesce(F.sum(F.octet_length(F.col("group").cast("string"))), F.lit(0)).alias("bytes"),
    ).first()
    small = size.trees * 96 + size.bytes <= broadcast_limit(rows.sparkSession)
    table = groups.withColumnRenamed("group", "named")
    table = F.broadcast(table) if small else table
    leaves = placed.join(table, F.col("group").eqNullSafe(F.col("named")))
    leaves = leaves.select("tree", "n", (F.col("place") - F.col("first")).alias("idx"), F.unhex("leaf").alias("d"), "row")
    leaves = work.write(leaves, "leaves")
    levels, subroots = _grow(leaves.drop("row"), size.largest or 0, arity, "level", work)
    subroots = work.write(subroots, "subroots")
    whole = F.lit(0).cast("long")
    upper = subroots.select(whole.alias("tree"), F.lit(size.trees).cast("long").alias("n"), (F.col("tree") - 1).alias("idx"), "d")
    above, root = _grow(upper, size.trees, arity, "upper", work)
    root = work.write(root, "root")  # one row
    none = F.array().cast("array<struct<l: binary, r: binary>>")
    over = _proofs(above, root.select("tree", none.alias("path")), arity, "upper", work)
    tops = over.select((F.col("idx") + 1).alias("tree"), "path").join(subroots, "tree")
    tops = work.write(tops, "tops")
    paths = _proofs(levels, tops, arity, "level", work)
    one = root.first()
    ends = tops.select("tree", _hex(F.col("d")).alias("subroot"), F.lit(one and one.d.hex()).alias("root"))
    ends = F.broadcast(ends) if small else ends
    found = leaves.select("tree", "idx", "row").join(paths, ["tree", "idx"]).join(ends, "tree")
    return found.select("row.*", "subroot", "root", "path")


def audited(rows: DataFrame, columns: list[str], tampered: dict[str, Column], where: Column, group: str, order: str) -> DataFrame:
    """``order``, ``group``, leaf, subroot, root, proof_sha256 and the check of a copy of ``rows`` against their manifest.

    The manifest is that of ``rows``; the copy differs in the columns ``tampered`` in the rows ``where`` (null:
    not). ``folded_root`` is what the copy's leaf and the manifest's siblings give, ``verified`` whether that is the root.
    """
    changed = [tampered.get(c, F.col(c)) for c in columns]
    copy = f"copy_{uuid.uuid4().hex}"
    # Only digests and what places them move, not the texts.
    rows = rows.select(order, group, leaf(*columns).alias("leaf"), F.when(where, leaf(*changed)).alias(copy))
    found = manifest(rows, group, order)
    found = found.withColumn("proof_sha256", proof_digest())
    found = found.withColumn("folded_root", fold(F.coalesce(copy, "leaf"))).drop("path", copy)
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))

"""Agreement of a clustering with labels: contingency table, entropies, mutual information."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _joint(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """``(cluster, label, n)``. Repeated ids multiply; they are counted on each side first, so an
    id with many rows never expands into all its pairs."""
    left = classes.groupBy("doc_id", "cluster").agg(F.count(F.lit(1)).alias("a"))
    right = labels.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("b"))
    return left.join(right, "doc_id").groupBy("cluster", "label").agg(
        F.sum(F.col("a") * F.col("b")).alias("n")
    )


def _cells(classes: DataFrame, labels: DataFrame, class_num: int | None) -> DataFrame:
    """Joint counts with their share ``p`` of all joined rows.

    ``class_num`` keeps clusters and labels 1..class_num as cells; rows outside stay in the total.
    """
    joint = _joint(classes, labels)
    total = joint.agg(F.sum("n")).scalar()
    cells = joint.withColumn("p", F.col("n") / total)
    if class_num is not None:
        cells = cells.where(
            F.col("cluster").between(1, class_num) & F.col("label").between(1, class_num)
        )
    return cells


def contingency(
    classes: DataFrame, labels: DataFrame, class_num: int | None = None, dense: bool = False
) -> DataFrame:
    """``(cluster, label, n, p, pxpy, term)``: counts, joint share, product of the marginals and
    the cell's mutual information ``p * ln(p / pxpy)`` in nats.

    ``dense`` adds the empty cells of the 1..class_num grid.
    """
    cells = _cells(classes, labels, class_num)
    if dense:
        if class_num is None:
            raise ValueError("dense needs class_num")
        grid = classes.sparkSession.range(1, class_num + 1).select(
            F.col("id").alias("cluster"),
            F.explode(F.sequence(F.lit(1), F.lit(class_num))).alias("label"),
        )
        cells = grid.join(cells, ["cluster", "label"], "left").fillna(0, ["n", "p"])
    return cells.selectExpr(
        "cluster",
        "label",
        "n",
        "p",
        "sum(p) OVER (PARTITION BY cluster) * sum(p) OVER (PARTITION BY label) AS pxpy",
    ).withColumn("term", F.expr("if(p > 0, p * ln(p / pxpy), 0D)"))


def marginals(classes: DataFrame, labels: DataFrame, class_num: int | None = None) -> DataFrame:
    """``(side, value, n, p)``: row sums (side ``cluster``) and column sums (side ``label``)."""
    cells = _cells(classes, labels, class_num)
    sides = "stack(2, 'cluster', cast(cluster AS string), 'label', cast(label AS string))"
    return (
        cells.selectExpr(f"{sides} AS (side, value)", "n", "p")
        .groupBy("side", "value")
        .agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    )


def nmi(
    classes: DataFrame,
    labels: DataFrame,
    base: str = "consistent",
    class_num: int | None = None,
) -> DataFrame:
    """One row ``(total, mi, hx, hy, nmi)``; ``mi`` in nats, entropies in bits.

    ``base='consistent'`` brings both to the same unit before dividing, ``'mixed'`` divides them
    as they are. One pass over a cube of the cells suffices: with marginals that sum the cells,
    MI = sum p ln p - sum px ln px - sum py ln py.
    """
    if base not in ("consistent", "mixed"):
        raise ValueError("base must be 'consistent' or 'mixed'")
    joint = _joint(classes, labels)
    total = joint.agg(F.sum("n")).scalar()
    cells = joint
    if class_num is not None:
        cells = cells.where(
            F.col("cluster").between(1, class_num) & F.col("label").between(1, class_num)
        )
    levels = (
        cells.cube("cluster", "label")
        .agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))
        .withColumn("p", F.col("n") / total)
    )
    # Levels of the cube: 0 cells, 1 clusters, 2 labels.
    plogp = levels.selectExpr("level", "n", "if(p > 0, p * ln(p), 0D) AS x")
    sums = plogp.agg(
        F.expr("sum(if(level = 0, x, 0D)) AS cells"),
        F.expr("sum(if(level = 1, x, 0D)) AS clusters"),
        F.expr("sum(if(level = 2, x, 0D)) AS labels"),
    )
    unit = "ln(2)" if base == "consistent" else "1D"
    return sums.select(
        total.alias("total"),
        F.expr("cells - clusters - labels AS mi"),
        F.expr("-clusters / ln(2) AS hx"),
        F.expr("-labels / ln(2) AS hy"),
    ).withColumn("nmi", F.expr(f"2 * mi / nullif((hx + hy) * {unit}, 0)"))

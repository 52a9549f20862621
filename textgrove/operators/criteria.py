"""Split criteria as plain arithmetic, usable on Spark columns and on driver numbers alike.

Notation for one split of a parent with ``n`` documents into sides j: ``S[j]`` sums the
similarity (or squared distance) of the documents to their nearest centre, ``E[j]`` is the
similarity of the side's centre to the global centroid.
"""

from __future__ import annotations

from functools import reduce
from operator import add

CRITERIA = ("i1", "i2", "e1", "h1", "h2", "sse", "largest")


def check(criterion: str) -> str:
    if criterion not in CRITERIA:
        raise ValueError(f"criterion must be one of {', '.join(CRITERIA)}")
    return criterion


def metric_of(criterion: str) -> str:
    return "euclid" if criterion == "sse" else "cosine"


def smaller_is_better(criterion: str) -> bool:
    """Whether the best restart has the smallest score."""
    return criterion in ("sse", "e1")


def split_score(criterion: str, S: list, E: list, n):
    """Score of a split: what a restart is chosen by."""
    total = lambda values: reduce(add, values)
    if criterion in ("i2", "sse", "largest"):
        return total(S)
    if criterion == "i1":
        return total([s * s for s in S]) / n
    if criterion == "e1":
        return total(E)
    if criterion == "h1":
        return total(S) / total(E)
    if criterion == "h2":
        return (total([s * s for s in S]) / n) / total(E)
    raise ValueError(criterion)


def unsplit_score(criterion: str, cohesion, sse, n, parent_e):
    """Score of a cluster left whole; ``parent_e`` is its centre's similarity to the global one."""
    if criterion in ("i2", "largest"):
        return cohesion
    if criterion == "sse":
        return sse
    if criterion == "i1":
        return cohesion * cohesion / n
    if criterion == "e1":
        return parent_e
    if criterion == "h1":
        return cohesion / parent_e
    if criterion == "h2":
        return (cohesion * cohesion / n) / parent_e
    raise ValueError(criterion)


def gain(criterion: str, split, unsplit):
    """Improvement by splitting; for ``e1`` the smallest value is the best one."""
    return unsplit - split if criterion == "sse" else split - unsplit

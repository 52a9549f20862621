"""Numpy restatement of seeded K-means and repeated bisection, for checking small inputs."""

import hashlib

import numpy as np

TIE = 1e-12


def seeds(docs, node, restart, k, seed):
    digest = lambda d: hashlib.md5(f"{seed}:{restart}:{node}:{d}".encode()).hexdigest()
    return sorted(docs, key=lambda d: (digest(d), d))[:k]


def length(x):
    return float(np.sqrt(x @ x))


def cos(x, y):
    scale = length(x) * length(y)
    return float(x @ y) / scale if scale > 0 else 0.0


def nearest(x, centres, metric):
    if metric == "cosine":
        values = [cos(x, c) for c in centres]
        best = max(values)
        k = next(j for j, v in enumerate(values) if v >= best - TIE * (1 + abs(best)))
    else:
        values = [float((x - c) @ (x - c)) for c in centres]
        best = min(values)
        k = next(j for j, v in enumerate(values) if v <= best + TIE * (1 + abs(best)))
    return k, best


def kmeans(vectors, docs, node, restart, k, metric, iterations, seed):
    chosen = [vectors[d] for d in seeds(docs, node, restart, k, seed)]
    width = len(next(iter(vectors.values())))
    centres = chosen + [np.zeros(width)] * (k - len(chosen))
    for _ in range(iterations):
        side = {d: nearest(vectors[d], centres, metric)[0] for d in docs}
        for j in range(k):
            mine = [vectors[d] for d in docs if side[d] == j]
            if mine:
                centres[j] = np.mean(mine, axis=0)
    return centres, {d: nearest(vectors[d], centres, metric) for d in docs}


def score(criterion, S, E, n):
    i1 = sum(s * s for s in S) / n
    return {
        "i2": lambda: sum(S),
        "largest": lambda: sum(S),
        "sse": lambda: sum(S),
        "i1": lambda: i1,
        "e1": lambda: sum(E),
        "h1": lambda: sum(S) / sum(E),
        "h2": lambda: i1 / sum(E),
    }[criterion]()


def split(vectors, docs, node, restarts, criterion, iterations, seed, g):
    metric = "euclid" if criterion == "sse" else "cosine"
    best = None
    for r in range(restarts):
        centres, found = kmeans(vectors, docs, node, r, 2, metric, iterations, seed)
        S = [sum(s for k, s in found.values() if k == j) for j in range(2)]
        sizes = [sum(1 for k, _ in found.values() if k == j) for j in range(2)]
        E = [cos(c, g) for c in centres]
        value = score(criterion, S, E, len(docs))
        order = value if criterion in ("sse", "e1") else -value
        key = (min(sizes) == 0, order, r)
        if best is None or key < best[0]:
            best = (key, value, found, S, E)
    (empty, _, _), value, found, S, E = best
    return (None if empty else value), found, S, E


def whole(vectors, docs):
    centre = np.mean([vectors[d] for d in docs], axis=0)
    cohesion = sum(cos(vectors[d], centre) for d in docs)
    sse = sum(float((vectors[d] - centre) @ (vectors[d] - centre)) for d in docs)
    return cohesion, sse


def bisect(vectors, cluster_num, criterion, restarts=2, iterations=2, seed=7, parent=False):
    """{doc: node} and {node: gain}."""
    g = np.mean(list(vectors.values()), axis=0)

    def make(node, docs, parent_e, parent_s):
        value, found, S, E = split(vectors, docs, node, restarts, criterion, iterations, seed, g)
        cohesion, sse = whole(vectors, docs)
        n = len(docs)
        gain = None
        if value is not None and (parent_e is not None or criterion not in ("e1", "h1", "h2")):
            if parent and parent_s is not None:
                unsplit = parent_s
            else:
                unsplit = {
                    "i2": lambda: cohesion,
                    "largest": lambda: cohesion,
                    "sse": lambda: sse,
                    "i1": lambda: cohesion**2 / n,
                    "e1": lambda: parent_e,
                    "h1": lambda: cohesion / parent_e,
                    "h2": lambda: cohesion**2 / n / parent_e,
                }[criterion]()
            gain = unsplit - value if criterion == "sse" else value - unsplit
        return dict(node=node, docs=docs, value=value, gain=gain, found=found, S=S, E=E)

    frontier = [make(1, sorted(vectors), None, None)]
    while len(frontier) < cluster_num:
        ready = [f for f in frontier if f["value"] is not None]
        if criterion == "largest":
            ready.sort(key=lambda f: -len(f["docs"]))
        elif frontier[0]["node"] != 1:
            sign = 1 if criterion == "e1" else -1
            ready.sort(key=lambda f: sign * round(f["gain"], 12))
        if not ready:
            break
        best = ready[0]
        if criterion == "i1" and best["gain"] < 0:
            break
        frontier.remove(best)
        for j in range(2):
            docs = [d for d in best["docs"] if best["found"][d][0] == j]
            frontier.append(make(2 * best["node"] + j, docs, best["E"][j], best["S"][j]))
    return (
        {d: f["node"] for f in frontier for d in f["docs"]},
        {f["node"]: f["gain"] for f in frontier},
    )


def cooccurrence(lines, window=10):
    """Direct enumeration of all pair increments."""
    counts = {}

    def add(a, b):
        counts[a, b] = counts.get((a, b), 0) + 1

    for words in lines:
        for p, word in enumerate(words):
            add(word, word)
            for later in words[p + 1 :]:
                add(word, later)
                add(later, word)
        for p in range(window, len(words)):
            add(words[p], words[p])
            for earlier in words[p - window : p]:
                add(earlier, words[p])
                add(words[p], earlier)
    return counts

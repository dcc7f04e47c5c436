"""Clusters of points (id, v: a vector): by merges of least cost (Ward), and by consensus of an ensemble of seeded k-means labelings.

Points are projected on their leading singular vectors, which come from sums of products. Merging compares all with all, so it works on
cells: each point by itself while there are at most `CELLS`, and beyond that the cells of the finest grid that has no more, with their
counts and means. What is gathered and sent out is a row for each cell; the points only ever meet their own cell.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstack.functions.shared import cut
from rillstack.operators import windowed_svd as ws

CELLS = 2048


def projected(points: DataFrame, ncomp: int = 3) -> DataFrame:
    """id, p: the points' rows of the leading left singular vectors of the matrix of all points."""
    n, _, outer = ws.unpack(np.array(ws.products(points, [], "v").first().g), False)
    sv, u = ws.leading(outer, n, rank=min(ncomp, len(outer)))
    u = u * np.where(u.sum(0) < 0, -1.0, 1.0)
    lines = F.array(*(F.array(*map(F.lit, line)) for line in (u / sv).T.tolist()))
    return points.select("id", F.transform(lines, lambda w: F.aggregate(F.zip_with(w, "v", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)).alias("p"))


def celled(points: DataFrame, cells: int = CELLS) -> tuple[DataFrame, list[int], np.ndarray, np.ndarray]:
    """Points (id, p) with their cell's number, and of the cells, in order of number, the smallest ids, counts and means."""
    points = cut(points)
    few = points.count() <= cells
    if few:
        own = points.withColumn("cell", F.array(F.col("id").cast("long")))
    else:
        width = len(points.first().p)
        lo, hi = (list(points.agg(*(f(F.get("p", i)).alias(f"c{i}") for i in range(width))).first()) for f in (F.min, F.max))
        for bits in range(16, -1, -1):
            place = F.array(*(F.floor((F.get("p", i) - lo[i]) / max(hi[i] - lo[i], 1e-300) * (2**bits - 1e-9)).cast("long") for i in range(width)))
            own = points.withColumn("cell", place)
            if own.select("cell").distinct().limit(cells + 1).count() <= cells:
                break
    width = F.size("p")
    means = own.select("cell", "id", F.posexplode("p").alias("i", "x"), width.alias("w")).groupBy("cell", "i").agg(F.avg("x").alias("x"), F.min("id").alias("id"), F.count("*").alias("n"))
    rows = means.groupBy("cell", "id", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("p")).collect()
    rows.sort(key=lambda r: r.id)
    number = points.sparkSession.createDataFrame([(r.cell, k) for k, r in enumerate(rows)] or [([], 0)], "cell array<long>, number long")
    return own.join(F.broadcast(number), "cell").select("id", "p", "number"), [r.id for r in rows], np.array([r.n for r in rows], float), np.array([r.p for r in rows], float).reshape(len(rows), len(rows[0].p) if rows else 0)


def merges(n: np.ndarray, means: np.ndarray) -> list[tuple[float, int, int]]:
    """(cost, a, b) of the merges into one cluster, by rising cost; a and b: cells, or for merge k the number of cells plus k as made here. A
    chain of nearest neighbours is followed until two are each other's nearest."""
    m = len(n)
    size, mean = np.concatenate((n, np.zeros(max(0, m - 1)))), np.concatenate((means, np.zeros((max(0, m - 1), means.shape[1]))))
    alive = np.zeros(len(size), bool)
    alive[:m] = True
    chain: list[int] = []
    out = []
    for new in range(m, 2 * m - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            others = np.flatnonzero(alive)
            others = others[others != a]
            cost = size[a] * size[others] / (size[a] + size[others]) * ((mean[others] - mean[a]) ** 2).sum(1)
            b = int(others[np.argmin(cost)])
            if len(chain) > 1 and cost.min() >= size[a] * size[chain[-2]] / (size[a] + size[chain[-2]]) * ((mean[chain[-2]] - mean[a]) ** 2).sum():
                b = chain[-2]
                break
            chain.append(b)
        out.append((float(size[a] * size[b] / (size[a] + size[b]) * ((mean[a] - mean[b]) ** 2).sum()), a, b))
        size[new], mean[new] = size[a] + size[b], (size[a] * mean[a] + size[b] * mean[b]) / (size[a] + size[b])
        alive[[a, b]], alive[new] = False, True
        del chain[-2:]
    return out


def cut_tree(tree: list[tuple[float, int, int]], m: int, k: int) -> np.ndarray:
    """The cluster of each cell, named by its first cell, after the m - k cheapest merges."""
    root = list(range(m))
    inside: dict[int, list[int]] = {c: [c] for c in range(m)}
    for new, (_, a, b) in enumerate(tree, m):
        inside[new] = inside[a] + inside[b]
    for new in sorted(range(m, m + len(tree)), key=lambda i: (tree[i - m][0], i))[: max(0, m - k)]:
        least = min(root[c] for c in inside[new])
        for c in inside[new]:
            root[c] = least
    return np.array(root, np.int64)


def ward(points: DataFrame, k: int = 10, ncomp: int = 3, cells: int = CELLS) -> DataFrame:
    """id, label of points (id, v), in k clusters; a cluster is named by its smallest id."""
    own, ids, n, means = celled(projected(points, ncomp) if ncomp else points.select("id", F.col("v").alias("p")), cells)
    names = cut_tree(merges(n, means), len(ids), k)
    table = own.sparkSession.createDataFrame([(c, ids[r]) for c, r in enumerate(names.tolist())] or [(-1, -1)], "number long, label long")
    return own.join(F.broadcast(table), "number").select("id", "label")


def k_means(n: np.ndarray, means: np.ndarray, k: int, seed: int, rounds: int = 50) -> np.ndarray:
    """Labels of weighted cells, from centres drawn far from each other."""
    r = np.random.default_rng(seed)
    k = min(k, len(n))
    centres = means[[r.choice(len(n), p=n / n.sum())]]
    while len(centres) < k:
        far = ((means[:, None] - centres[None]) ** 2).sum(2).min(1) * n
        centres = np.concatenate((centres, means[[r.choice(len(n), p=far / far.sum()) if far.sum() > 0 else len(centres)]]))
    for _ in range(rounds):
        label = ((means[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([np.average(means[label == c], axis=0, weights=n[label == c]) if (label == c).any() else centres[c] for c in range(k)])
        if np.array_equal(new, centres):
            break
        centres = new
    return label


def agreed(labels: np.ndarray, n: np.ndarray, share: float = 0.85, least: int = 10, overlap: int = 5) -> np.ndarray:
    """Clusters (1, 2, ..; 0: none) of cells by how often labelings (rows) agree: in order, a cell and the later ones that share its label in at
    least that share of the labelings join all clusters that hold `overlap` points of them, or make one; those under `least` points go."""
    together = np.mean(labels[:, :, None] == labels[:, None, :], 0)
    clusters: list[set[int]] = []
    count = lambda c: n[list(c)].sum()
    for i in range(labels.shape[1]):
        new = {j for j in range(i, labels.shape[1]) if together[i, j] >= share}
        near = [c for c in clusters if count(c & new) >= overlap]
        rest = [c for c in clusters if count(c & new) < overlap]
        clusters = [set().union(new, *near), *rest] if near else [*clusters, new]
    out = np.zeros(labels.shape[1], np.int64)
    for k, c in enumerate((c for c in clusters if count(c) >= least), 1):
        out[list(c)] = k
    return out


def consensus(points: DataFrame, k: int = 8, runs: int = 25, share: float = 0.85, least: int = 10, overlap: int = 5, seed: int = 0, cells: int = CELLS) -> DataFrame:
    """id, label of points (id, v): the agreement of `runs` seeded k-means labelings into 2 * k clusters."""
    own, ids, n, means = celled(points.select("id", F.transform("v", lambda x: x.cast("double")).alias("p")), cells)
    names = agreed(np.stack([k_means(n, means, 2 * k, seed + r) for r in range(runs)]), n, share, least, overlap) if len(ids) else np.zeros(0, np.int64)
    table = own.sparkSession.createDataFrame(list(enumerate(names.tolist())) or [(-1, 0)], "number long, label long")
    return own.join(F.broadcast(table), "number").select("id", "label")

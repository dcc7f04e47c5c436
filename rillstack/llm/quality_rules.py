"""Quality rules: gradient-boosted trees over document statistics.

Statistics are taken from whole texts, a slice of documents at a time. The trees are fitted on a bounded sample of
labelled rows (`MAX_LABELLED`, in the order of a hash of doc_id) by histograms over quantile bins, with monotonic
constraints: more symbols, repeated lines, repeated windows or capitals can only lower the score. Fitted trees are flattened into
arrays of nodes, and a batch of documents walks all trees level by level. Scoring is one pass without a shuffle.

Defined cases: a null or empty text has no words, fails the base rule and is not kept; repeated rows score alike; rows with a null
label are left out of the fit; extra columns are ignored; an empty table gives an empty result; with no labelled rows,
or one label only, no tree is grown and the base rule alone decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstack.llm.text import U64, Words, buffers, mix, ngrams, slices, spark_tables, word_table

#: Labelled rows that the fit takes at most.
MAX_LABELLED = 8000
WINDOW = 8
_SPACE = word_table("space")
_LINE = np.ones(256, bool)
_LINE[10] = False
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER, _DIGIT, _POINT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _DIGIT[48:58] = True
_POINT[list(b".,;:!?")] = True
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Model inputs, and the sign that each may have on the score (0: any).
INPUTS = {"log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "capitals": -1, "digits": 0, "points": 0, "distinct": 0, "line_words": 0}


def statistics(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Base statistics (documents x BASE) and model inputs (documents x INPUTS) of a slice."""
    n = len(off) - 1
    own, cut = data[off[0] : off[-1]], off - off[0]

    def per_doc(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(mask)))
        return c[cut[1:]] - c[cut[:-1]]

    w = Words(data, off, _SPACE, lower=False)
    words = np.diff(w.first)
    inside = _SPACE[own]
    chars = per_doc(inside & ((own & 0xC0) != 0x80))
    symbols = per_doc(_SYMBOL[own])
    lines = Words(data, off, _LINE, lower=False)
    c = np.concatenate(([0], np.cumsum(inside)))
    full = c[lines.end] > c[lines.start]
    of, key = lines.doc[full], mix(lines.hash[full] + mix(lines.doc[full].astype(U64), 5), 6)
    _, one = np.unique(key, return_index=True)
    n_lines, distinct = np.bincount(of, minlength=n), np.bincount(of[one], minlength=n)
    g = ngrams(w.hash, WINDOW)
    cover = np.zeros(len(w) + 1, np.int64)
    if len(g):
        whole = np.flatnonzero(w.doc[: len(g)] == w.doc[WINDOW - 1 :])
        key = mix(g[whole] + mix(w.doc[whole].astype(U64), 5), 7)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(whole), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        np.add.at(cover, whole[twice], 1)
        np.add.at(cover, whole[twice] + WINDOW, -1)
    hit = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
    repeats = hit[w.first[1:]] - hit[w.first[:-1]]
    kinds = np.unique((w.doc.astype(U64) << U64(40)) | (w.hash >> U64(24))) >> U64(40)
    some, some_chars, some_lines = np.maximum(words, 1), np.maximum(chars, 1), np.maximum(n_lines, 1)
    inputs = np.stack(
        [np.log1p(words), chars / some, symbols / some, (n_lines - distinct) / some_lines, repeats / some, per_doc(_UPPER[own]) / some_chars, per_doc(_DIGIT[own]) / some_chars, per_doc(_POINT[own]) / some, np.bincount(kinds.astype(np.int64), minlength=n) / some, words / some_lines], 1
    )
    return np.stack([words, chars, symbols, n_lines - distinct, repeats], 1), inputs


class Forest:
    """Trees as arrays of nodes: feature (-1: leaf), threshold, left and right child, value; and the roots."""

    def __init__(self, base: float):
        self.base, self.roots = base, []
        self.nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}

    def add(self, feature: int, threshold: float, value: float) -> int:
        for k, v in zip(self.nodes, (feature, threshold, -1, -1, value), strict=True):
            self.nodes[k].append(v)
        return len(self.nodes["value"]) - 1

    def flat(self) -> tuple:
        return self.base, np.array(self.roots, np.int64), *(np.array(self.nodes[k], float if k in ("threshold", "value") else np.int64) for k in self.nodes)


def score(flat: tuple, x: np.ndarray) -> np.ndarray:
    """The forest's margin of each row, all trees at once."""
    base, roots, feature, threshold, left, right, value = flat
    if not len(roots) or not len(x):
        return np.full(len(x), base)
    at = np.tile(roots, (len(x), 1))
    row = np.arange(len(x))[:, None]
    while (inner := feature[at] >= 0).any():
        f = np.maximum(feature[at], 0)
        at = np.where(inner, np.where(x[row, f] <= threshold[at], left[at], right[at]), at)
    return base + value[at].sum(1)


def fit(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: int = 10, ridge: float = 1.0) -> tuple:
    """Boosted trees for P(y = 1), flattened. A split on a constrained feature that goes the wrong way is not taken,
    and its children are kept on their sides of the middle."""
    share = float(np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3))
    forest = Forest(float(np.log(share / (1 - share))) if len(y) else 8.0)
    if len(y) == 0 or y.min() == y.max():
        return forest.flat()
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    margin = np.full(len(y), forest.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)

        def grow(rows: np.ndarray, level: int, lo: float, hi: float, g=g, h=h) -> int:
            leaf = lambda a, b: float(np.clip(-a / (b + ridge), lo, hi))
            sg, sh = g[rows].sum(), h[rows].sum()
            best = (1e-6, -1, 0, 0.0, 0.0)
            if level < depth and len(rows) >= 2 * least:
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    m = len(e) + 1
                    k = code[rows, f]
                    cg, ch, cn = (np.cumsum(np.bincount(k, v, m))[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
                    gain = cg**2 / (ch + ridge) + (sg - cg) ** 2 / (sh - ch + ridge) - sg**2 / (sh + ridge)
                    vl, vr = np.clip(-cg / (ch + ridge), lo, hi), np.clip(-(sg - cg) / (sh - ch + ridge), lo, hi)
                    gain[(cn < least) | (len(rows) - cn < least) | (signs[f] * (vr - vl) < 0)] = 0
                    b = int(np.argmax(gain))
                    if gain[b] > best[0]:
                        best = (float(gain[b]), f, b, float(vl[b]), float(vr[b]))
            _, f, b, vl, vr = best
            if f < 0:
                return forest.add(-1, 0.0, rate * leaf(sg, sh))
            node = forest.add(f, float(edges[f][b]), 0.0)
            mid = (vl + vr) / 2
            go = code[rows, f] <= b
            sides = {0: ((lo, hi), (lo, hi)), 1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid))}[int(signs[f])]
            forest.nodes["left"][node] = grow(rows[go], level + 1, *sides[0])
            forest.nodes["right"][node] = grow(rows[~go], level + 1, *sides[1])
            return node

        first = len(forest.nodes["value"])
        forest.roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
        _, _, *arrays = forest.flat()
        margin += score((0.0, np.array([first]), *arrays), x)
    return forest.flat()


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> tuple:
    """Fit on at most `most` labelled rows of docs, one for each doc_id, in the order of a hash of doc_id."""
    few = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_d")).agg(F.min("quality").alias("_y")).orderBy(F.xxhash64("_d"), "_d").limit(most)
    rows = docs.select(F.col("doc_id").alias("_d"), F.col("text").alias("_t")).join(F.broadcast(few), "_d")
    rows = rows.groupBy("_d", "_y").agg(F.min_by("_t", F.xxhash64("_t")).alias("_t"))  # one text of a repeated doc_id

    def run(batches):
        for b in batches:
            data, off = buffers(b.column(2))
            for i, j in slices(off):
                x = statistics(data, off[i : j + 1])[1]
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j].cast(pa.int64()), b.column(1)[i:j].cast(pa.float64()), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))], ["d", "y", "x"])

    got = sorted(rows.mapInArrow(run, "d long, y double, x array<double>").toArrow().to_pylist(), key=lambda r: (r["d"], r["x"]))
    x = np.array([r["x"] for r in got], float).reshape(len(got), len(INPUTS))
    return fit(x, np.array([r["y"] for r in got]), np.array(list(INPUTS.values())))


def judge(docs: DataFrame, flat: tuple, least: float = 0.5) -> DataFrame:
    """doc_id, the base statistics, base_failed, p_good, kept for each row of docs."""
    shared, kind = docs.sparkSession.sparkContext.broadcast(flat), docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            data, off = buffers(b.column(1))
            for i, j in slices(off):
                base, x = statistics(data, off[i : j + 1])
                failed = (base[:, 0] < 20) | (100 * base[:, 4] > 30 * base[:, 0])
                p = 1 / (1 + np.exp(-score(shared.value, x)))
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], *(pa.array(np.ascontiguousarray(c)) for c in base.T), pa.array(failed), pa.array(p), pa.array(~failed & (p >= least))], ["doc_id", *BASE, "base_failed", "p_good", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, p_good double, kept boolean")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark_tables(spark, sf_dir, "documents")
    return judge(docs, train(docs, spark_tables(spark, sf_dir, "labels")))


QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLES: dict[str, str] = {}

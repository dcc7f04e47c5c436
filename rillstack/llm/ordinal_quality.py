"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut its score into grades:
P(grade <= k) = sigmoid(threshold_k - score). Grades: 0 toxic, 1 poor, 2 good. Selection uses the expected grade and
the tail probability P(grade = 2).

Fitting uses a bounded sample of the labelled rows (`MAX_LABELLED`, in the order of a hash of doc_id, so reruns
agree); scoring is one pass over all rows without a shuffle. Features are the distinct hashed lower-cased words, the
distinct last bytes of white-space tokens, and bins of a few whole-text statistics, all from the whole text.

Defined cases: a null or empty text has only its statistics' bins and gets a score like any other; rows with a null
label are left out of the fit; repeated rows score alike; other columns pass through untouched; an empty table gives
an empty result; without labelled rows of two grades at least every row is kept with the prior's probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstack.llm.text import LOWER, U64, Words, buffers, mix, ngrams, slices, spark_tables, word_table

#: Labelled rows that the fit takes at most.
MAX_LABELLED = 8000
BITS = 18
GRADES = 3
_ALNUM, _SPACE = word_table("alnum"), word_table("space")
_UPPER, _LETTER, _SYMBOL = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_SYMBOL[list(b"#*$%&|<>!@^~{}[]\\")] = True


def _distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs."""
    key = np.unique((doc.astype(np.int64) << BITS) | (h >> U64(64 - BITS)).astype(np.int64))
    return key >> BITS, key & ((1 << BITS) - 1)


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs of a slice of documents, distinct and sorted by document."""
    n = len(off) - 1
    own = data[off[0] : off[-1]]
    cut = off - off[0]
    low, tok = Words(data, off, _ALNUM), Words(data, off, _SPACE, lower=False)
    total = np.maximum(np.diff(tok.first), 1)
    # the last two bytes of each token that does not end in a letter
    last, before = own[tok.end - 1] if len(tok) else np.zeros(0, np.uint8), own[np.maximum(tok.end - 2, tok.start)] if len(tok) else np.zeros(0, np.uint8)
    odd = ~_LETTER[last] & (last < 128)
    tails = mix(last[odd].astype(U64) * U64(256) + before[odd].astype(U64) * U64(~_LETTER[before[odd]]) if odd.any() else np.zeros(0, U64), 11)

    def per_doc(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(mask)))
        return c[cut[1:]] - c[cut[:-1]]

    chars = np.maximum(np.diff(cut), 1)
    seen = np.unique((low.doc.astype(U64) << U64(40)) | (low.hash >> U64(24))) >> U64(40)
    distinct = np.bincount(seen.astype(np.int64), minlength=n)
    pair = ngrams(low.hash, 2)
    pair = pair[low.doc[:-1] == low.doc[1:]] if len(low) > 1 else pair[:0]
    stats = np.stack(
        [
            np.minimum(np.log2(total + 1), 15),
            10 * per_doc(_UPPER[own]) / chars,
            20 * per_doc(_SYMBOL[own]) / chars,
            10 * distinct / np.maximum(np.diff(low.first), 1),
            np.minimum(chars / total, 30),
            20 * per_doc(own == 10) / chars,
            np.minimum(np.diff(low.first), 3),
        ]
    ).astype(np.int64)
    which = np.repeat(np.arange(len(stats)), n)
    marks = mix((which.astype(U64) << U64(32)) + stats.ravel().astype(U64), 13)
    return _distinct(np.concatenate([low.doc, tok.doc[odd], np.tile(np.arange(n), len(stats))]), np.concatenate([low.hash, tails, marks]))


def grade(quality: str = "quality", toxic: str = "toxic"):
    return F.when(F.col(toxic) == 1, 0).when(F.col(quality) == 0, 1).when(F.col(quality) == 1, 2).cast("int")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class OrdinalModel:
    """weights over 2**BITS features, and the ordered thresholds."""

    def __init__(self, w: np.ndarray, cuts: np.ndarray):
        self.w, self.cuts = w, cuts

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        out = np.zeros(len(off) - 1)
        for i, j in slices(off):
            doc, f = features(data, off[i : j + 1])
            out[i:j] = np.bincount(doc, self.w[f], minlength=j - i)
        return out

    def judge(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and P(highest grade)."""
        above = 1 - _sigmoid(self.cuts[:, None] - score[None])
        return above.sum(0), above[-1]


def fit(rows: list[tuple[int, np.ndarray]], rounds: int = 400, l1: float = 0.6, rate: float = 0.25) -> OrdinalModel:
    """Proximal AdaGrad over the whole sample; `rows`: (grade, features). Features in fewer than three rows get no weight."""
    y = np.array([g for g, _ in rows], np.int64)
    counts = np.bincount(y, minlength=GRADES) if len(y) else np.ones(GRADES)
    share = np.clip(np.cumsum(counts)[:-1] / max(1, counts.sum()), 1e-3, 1 - 1e-3)
    cuts = np.log(share / (1 - share))
    w = np.zeros(1 << BITS)
    if len(y) == 0 or (counts > 0).sum() < 2:
        return OrdinalModel(w, cuts)
    col = np.concatenate([f for _, f in rows])
    row = np.repeat(np.arange(len(rows)), [len(f) for _, f in rows])
    df = np.bincount(col, minlength=1 << BITS)
    use = (df >= 3) & (df < len(rows))
    back = np.flatnonzero(use)
    at = np.full(1 << BITS, -1)
    at[back] = np.arange(len(back))
    ok = at[col] >= 0
    row, col = row[ok], at[col[ok]]
    v, sq = np.zeros(len(back)), np.full(len(back), 1e-2)
    gap, csq = np.log(np.maximum(np.diff(cuts), 1e-2)), np.full(GRADES - 1, 1e-2)
    first = cuts[0]
    for _ in range(rounds):
        cuts = np.concatenate(([first], first + np.cumsum(np.exp(gap))))
        s = np.bincount(row, v[col], minlength=len(y))
        edge = np.concatenate(([-np.inf], cuts, [np.inf]))
        hi, lo = _sigmoid(edge[y + 1] - s), _sigmoid(edge[y] - s)
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g = np.bincount(col, (dhi - dlo)[row], minlength=len(v))
        sq += g * g
        step = rate / np.sqrt(sq)
        v = v - step * g
        v = np.sign(v) * np.maximum(np.abs(v) - step * l1, 0)
        gc = np.array([(dlo * (y == k + 1)).sum() - (dhi * (y == k)).sum() for k in range(GRADES - 1)])
        full = np.array([gc.sum(), *(gc[k:].sum() * np.exp(gap[k - 1]) for k in range(1, GRADES - 1))])
        csq += full * full
        move = rate * full / np.sqrt(csq)
        first, gap = first - move[0], gap - move[1:]
    w[back] = v
    return OrdinalModel(w, np.concatenate(([first], first + np.cumsum(np.exp(gap)))))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> OrdinalModel:
    """Fit on at most `most` labelled rows of docs (doc_id, text), one for each doc_id, in the order of a hash of doc_id."""
    graded = labels.select(F.col("doc_id").alias("_d"), grade().alias("_g")).where("_d is not null and _g is not null")
    few = graded.groupBy("_d").agg(F.min("_g").alias("_g")).orderBy(F.xxhash64("_d"), "_d").limit(most)
    rows = docs.select(F.col("doc_id").alias("_d"), F.col("text").alias("_t")).join(F.broadcast(few), "_d")
    rows = rows.groupBy("_d", "_g").agg(F.min_by("_t", F.xxhash64("_t")).alias("_t")).select("_g", "_t")  # one text of a repeated doc_id

    def extract(batches):
        for b in batches:
            data, off = buffers(b.column(1))
            for i, j in slices(off):
                doc, f = features(data, off[i : j + 1])
                cut = np.searchsorted(doc, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j].cast(pa.int32()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(f, pa.int32()))], ["g", "f"])

    got = rows.mapInArrow(extract, "g int, f array<int>").toArrow()
    grades, lists = got.column(0).to_numpy(), got.column(1).combine_chunks()
    flat, cut = (lists.values.to_numpy(), lists.offsets.to_numpy()) if len(grades) else (np.zeros(0, np.int32), np.zeros(1, np.int64))
    data = [(int(g), flat[a:b]) for g, a, b in zip(grades, cut[:-1], cut[1:], strict=True)]
    return fit(sorted(data, key=lambda x: (x[0], len(x[1]), x[1].tobytes())))


def classify(docs: DataFrame, model: OrdinalModel, least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, p_good, kept for every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.w.astype(np.float32), model.cuts))

    def run(batches):
        m = OrdinalModel(*shared.value)
        for b in batches:
            mean, tail = m.judge(m.score(*buffers(b.column(1))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(mean), pa.array(tail), pa.array(tail >= least)], ["doc_id", "expected_grade", "p_good", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, expected_grade double, p_good double, kept boolean")


def select_good(docs: DataFrame, model: OrdinalModel, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose tail probability is `least` or more."""
    shared, at = docs.sparkSession.sparkContext.broadcast((model.w.astype(np.float32), model.cuts)), docs.columns.index("text")

    def run(batches):
        m = OrdinalModel(*shared.value)
        for b in batches:
            yield b.filter(pa.array(m.judge(m.score(*buffers(b.column(at))))[1] >= least))

    return docs.mapInArrow(run, docs.schema)


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark_tables(spark, sf_dir, "documents")
    return classify(docs, train(docs, spark_tables(spark, sf_dir, "labels")))


QUERIES = {"op10_ordinal_quality": op10_ordinal_quality}
ORACLES: dict[str, str] = {}

"""Periodic runs, importance resampling and language-model scoring against brute force."""

import collections
import glob
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rillstack.llm import attention_lm, importance, lm_scoring, periodic_runs

DIR = "/root/testdata/sf0.001"
SPACE, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, start long, score double, rank string, runs int, hash int"


def noise(seed, n, kinds=300):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(kinds)}" for _ in range(n))


TEXTS = [
    (1, "a a a a a a a"), (2, "x " + "b c d " * 9 + "b y"), (3, None), (4, ""), (5, " \n\t "), (6, noise(1, 400)), (6, noise(1, 400)), (7, (noise(2, 40) + "\n") * 6), (8, "é ü " * 90), (None, noise(3, 60)),
    (None, noise(3, 60)), (9, "w" * 3000 + " " + noise(4, 30)), (10, noise(5, 30_000, 3)), (11, "A a " * 4 + noise(6, 25)), (12, "q " * 3 + "r " * 5 + noise(7, 21)), (13, "one,two;three-four"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, 5, 0.5, "r", 1, 2) for d, t in TEXTS], SCHEMA)


def all_runs(w, exponent, length):
    out = set()
    for q in range(1, len(w) // exponent + 1):
        k = 0
        while k + q < len(w):
            if w[k] != w[k + q]:
                k += 1
                continue
            j = k
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n, s = j - k + q, w[k : j + q]
            if n >= max(length, exponent * q) and not any(s[d:] == s[:-d] for d in range(1, q)):
                out.add((k, n, q))
            k = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def without(w, found):
    drop = {x for s, n, q in found for x in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in drop)


@pytest.mark.parametrize(("exponent", "length"), [(4, 6), (2, 2), (3, 9)])
def test_runs(spark, exponent, length):
    r = random.Random(exponent)
    rows = []
    for d in range(250):
        w = []
        for _ in range(r.randrange(6)):
            w += ([r.choice("abcd") for _ in range(r.randrange(1, 6))] * 9)[: r.randrange(30)] + [r.choice("abcx") for _ in range(r.randrange(6))]
        rows.append((d, " ".join(w)))
    got = periodic_runs.find_runs(spark.createDataFrame(rows, "doc_id long, text string"), exponent, length).collect()
    assert len(got) == len(rows)
    for x in got:
        w = rows[x.doc_id][1].split()
        want = all_runs(w, exponent, length)
        assert [tuple(y) for y in x.runs] == want and x.collapsed == without(w, want)


def test_runs_of_odd_rows(docs):
    got = periodic_runs.find_runs(docs).collect()
    want = collections.Counter()
    for d, t in TEXTS:
        w = SPACE.findall(t or "")
        found = all_runs(w, 4, 6) if d != 10 else None
        want[d, tuple(found) if found is not None else None, without(w, found) if found is not None else None] += 1
    long = [x for x in got if x.doc_id == 10]
    assert collections.Counter((x.doc_id, tuple(tuple(y) for y in x.runs), x.collapsed) for x in got if x.doc_id != 10) == {k: n for k, n in want.items() if k[0] != 10}
    w = TEXTS[12][1].split()  # the long text: every run found is one, and all of period 1 are found
    assert len(long) == 1 and all(w[s : s + n - q] == w[s + q : s + n] and w[s - 1 : s] != w[s + q - 1 : s + q] for s, n, q in long[0].runs if s)
    ones = [(m.start(), m.end() - m.start(), 1) for m in re.finditer(r"(.)\1{5,}", "".join(x[1] for x in w))]
    assert [tuple(x) for x in long[0].runs if x.period == 1] == ones
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0


def test_periodic_runs_query(spark):
    """The registered query over the smallest tables."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in periodic_runs.op11_periodic_runs(spark, DIR).collect()}
    assert got.keys() == docs.keys()
    for d, t in docs.items():
        w = SPACE.findall(t or "")
        n, h = len(w), zlib.crc32(str(d).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        if len(w) > 1500:
            continue
        found = all_runs(w, 4, 6)
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        x = got[d]
        assert (x.n_runs, x.start, x.length, x.period) == (len(found), *best) and x.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest() and x.collapsed_sha256 == hashlib.sha256(without(w, found).encode()).hexdigest()


def features(t):
    w = ALNUM.findall((t or "").translate(LOW))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


@pytest.mark.parametrize("head", [0, 8, 1 << 16])
def test_resampling(spark, docs, head, monkeypatch):
    """All rows by plain computation, whatever the tables of frequent words hold."""
    monkeypatch.setattr(importance, "OFTEN", 2)
    real = importance.vocabulary
    monkeypatch.setattr(importance, "vocabulary", lambda d, b: real(d, b, head, head, 2))
    target = spark.createDataFrame([(1, noise(3, 40)), (2, None), (3, "A a b c")], "item_id long, text string")
    count = lambda texts: collections.Counter(zlib.crc32(f.encode()) % 97 for t in texts for f in features(t)[1])
    s, t = count(x for _, x in TEXTS), count([noise(3, 40), None, "A a b c"])
    S, T = sum(s.values()), sum(t.values())
    gain = {k: math.floor(1000 * math.log((t[k] + 1) * (S + 97) / ((s[k] + 1) * (T + 97)))) for k in range(97)}
    rows = []
    for d, x in TEXTS:
        w, f = features(x)
        weight = sum(gain[zlib.crc32(y.encode()) % 97] for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = collections.defaultdict(list)
    for k, r in enumerate(able, 1):
        rank[r].append(k if k <= len(able) * 60 // 100 else None)
    want = sorted((*r, rank[r].pop(0) if r in rank else None) for r in rows if r[0] is not None) + [(*r, rank[r].pop(0)) for r in rows if r[0] is None]
    got = importance.resample(docs, target, buckets=97, percent=60).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *(x if x is not None else 1 << 60 for x in r[1:]))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert importance.resample(docs.limit(0), target).count() == 0


def test_resampling_matches_sql(spark):
    got = importance.op12_importance_resampling(spark, DIR)
    db = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        db.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = db.sql(importance.ORACLES["op12_importance_resampling"])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_ranks_over_many_ranges(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 613).alias("score"), (F.col("id") % 50).alias("doc_id"))
    got = importance.ranked(rows.repartition(16), F.desc("score"), F.col("doc_id")).collect()
    assert [r.score for r in sorted(got, key=lambda r: r["rank"])] == sorted((r.score for r in got), reverse=True) and sorted(r["rank"] for r in got) == list(range(1, 5001))


def test_lm_base(spark, docs):
    """Counts and base scores by plain computation, with every word in the head and with few."""
    toks = [(d, [*SPACE.findall((t or "").translate(LOW)), None], zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1) for d, t in TEXTS]
    c = collections.Counter(w for _, ws, held in toks if not held for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(((d, held, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 5)) for d, ws, held in toks), key=str)
    for head in (1 << 18, 20):
        got = lm_scoring.score_texts(docs, head_words=head).collect()
        assert sorted(((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 5)) for x in got), key=str) == want
        assert all(x.score < 0 and x.attention_score < 0 for x in got)
    assert lm_scoring.score_texts(docs.limit(0)).count() == 0
    assert lm_scoring.score_texts(docs.where("doc_id = 3")).first().n_tokens == 1


def test_lm_is_a_distribution():
    """Probabilities of all ranks after any text add up to one; later words don't change earlier ones; each window of a long text counts once."""
    m = attention_lm.Model(np.sort(np.random.default_rng(0).integers(0, 50, 700))[::-1])
    s = attention_lm.Scorer(m)
    for text in ([], [3, 500, 42], list(range(0, 700, 9))):
        flat = np.array([x for k in range(700) for x in [*text, k]], np.int32)
        each, _ = s.score(flat, np.arange(701) * (len(text) + 1), 0)
        assert abs(np.exp(each[len(text) :: len(text) + 1]).sum() - 1) < 1e-3
    r = np.random.default_rng(1).integers(0, 700, 5000).astype(np.int32)
    whole, _ = s.score(r, np.array([0, 5000]), 0)
    part, _ = s.score(r[:1000], np.array([0, 1000]), 0)
    other, _ = s.score(np.concatenate((r[:77], r)), np.array([0, 77, 5077]), 0, chunk=3)
    assert np.allclose(whole[:1000], part, atol=1e-5) and np.allclose(other[77:], whole, atol=1e-5)


def test_lm_gradient_and_window():
    """Gradients against differences; a window of one text has the likelihood that scoring gives."""
    r = np.random.default_rng(2)
    m = attention_lm.Model(np.arange(600, 0, -1))
    y = r.integers(0, 600, (2, attention_lm.SPAN)).astype(np.int32)
    x = np.concatenate((np.full((2, 1), attention_lm.OPEN), attention_lm.row_of(y[:, :-1])), 1).astype(np.int32)
    g, loss, n = m.gradient(x, y)
    for k in ("e", "v", "w1", "w2", "o1", "c1", "o2", "c2"):
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        old, ends = m.p[k][at].copy(), []
        for step in (0.02, -0.02):
            m.p[k][at] = old + step
            ends.append(m.gradient(x, y)[1])
        m.p[k][at] = old
        assert abs((ends[0] - ends[1]) / 0.04 / n - g[k][at]) < 0.02 * abs(g[k][at]) + 1e-4
    each, last = attention_lm.Scorer(m).score(y[:, :-1].ravel(), np.arange(3) * (attention_lm.SPAN - 1), int(y[0, -1]))
    assert abs(-each[: attention_lm.HOP].sum() - m.gradient(x[:1, :], np.where(np.arange(attention_lm.SPAN) < attention_lm.HOP, y[:1], -1))[1]) < 0.01 * -each[: attention_lm.HOP].sum()  # exponentials by lines between powers of two


def test_lm_learns(spark):
    """Held-out texts score higher than with their words in another order, and higher than with the untrained model."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    r = random.Random(5)
    mixed = []
    for d, t in rows[:60]:
        w = list(t or "")
        r.shuffle(w)
        mixed.append((10_000 + d, "".join(w)))
    got = {x.doc_id: x for x in lm_scoring.score_texts(docs.union(spark.createDataFrame(mixed, docs.schema))).collect()}
    held = [x for x in got.values() if x.held_out and x.doc_id < 10_000]
    tokens = sum(x.n_tokens for x in held)
    assert sum(x.score for x in held) / tokens > -4.6
    pairs = [(got[d].score / got[d].n_tokens, got[10_000 + d].score / got[10_000 + d].n_tokens) for d, t in rows[:60] if t and len(t) > 300]
    assert sum(a > b for a, b in pairs) > 0.95 * len(pairs)


def test_lm_learns_from_every_text(spark, monkeypatch):
    """However large the table, every training text counts: a pattern that one text in 50 holds is learned."""
    monkeypatch.setattr(lm_scoring, "LEAST_BYTES", 0, raising=False)
    monkeypatch.setattr(lm_scoring, "LITTLE", 0, raising=False)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    planted = spark.range(20).select((F.col("id") + 50_000).alias("doc_id"), F.repeat(F.lit("zq zq xj "), 200).alias("text"))
    got = lm_scoring.score_texts(docs.union(planted)).collect()
    own = [x for x in got if x.doc_id >= 50_000 and x.held_out]
    rest = [x for x in got if x.doc_id < 50_000 and x.held_out]
    mean = lambda rows: sum(x.attention_score for x in rows) / sum(x.n_tokens for x in rows)
    assert mean(own) > -1 and mean(rest) > -4.8  # -4.24 and -6.05 with 1/128 of the windows

"""Line dedup by winnowing over line hashes.

A line is what stands between two `\\n`; lines compare by their white-space separated words, blank lines never match.
The windows at a line are the shortest run of lines from it, and the shortest up to it, with `min_words` words or more. Each
window selects its smallest line hash as a fingerprint, so any run of that many words that two places share has a fingerprint in common.
Fingerprints that occur once are dropped; the positions of the others are joined, and around each the windows that
selected it are compared: equal windows from a line extend the match to the left, equal ones up to a line to the right, line
by line, so together they cover all of a repeated run. Every window that
also starts earlier (smaller doc_id, or the same document, earlier line) is deleted; its first occurrence stays.

Only a count of each fingerprint and the least position of each window's content are aggregated, both partially
before their shuffle, and the final join has one row per document, so a line that a third of all rows hold makes no
large group.

Defined cases: a null text stays null, an empty one empty; a text whose lines are all repeats becomes empty, its row
stays; rows equal in doc_id and text count as one place (both keep it, or both lose it); a null doc_id sorts first; extra columns pass
through; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstack.llm.text import U64, Words, buffers, marked, mix, row_key, slices, spark_tables, stash, weights, word_table

MIN_WORDS = 50
_SPACE = word_table("space")
_R = [U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95)]


def _powers(r: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i modulo 2**64 for i < n."""
    inverse = U64(pow(int(r), -1, 1 << 64))
    up, down = np.full(n, r), np.full(n, inverse)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def windows(data: np.ndarray, off: np.ndarray, min_words: int) -> dict[str, np.ndarray]:
    """Windows of a slice: document, first and last line, fingerprint and its place, two content hashes. Those up to a line
    that are also the shortest from their first line come once."""
    own, cut = data[off[0] : off[-1]], off - off[0]
    w = Words(data, off, _SPACE, lower=False)
    breaks = np.flatnonzero(own == 10)
    # a line's number: line breaks before it, counted from its document's start
    word_line = np.searchsorted(breaks, w.start)
    head = np.concatenate((np.ones(min(1, len(w)), bool), (word_line[1:] != word_line[:-1]) | (w.doc[1:] != w.doc[:-1])))
    at = np.flatnonzero(head)  # first word of each line that has any
    n = len(at)
    if not n:
        return {k: np.zeros(0, np.int64) for k in ("doc", "first", "last", "mark", "place", "w1", "w2")}
    count = np.diff(np.append(at, len(w)))
    inner = np.arange(len(w)) - np.repeat(at, count)
    line = mix(np.add.reduceat(w.hash * weights(int(count.max()))[inner], at) + count.astype(U64), 3)
    doc = w.doc[at]
    number = word_line[at] - np.searchsorted(breaks, cut[:-1])[doc]
    words = np.concatenate(([0], np.cumsum(count)))
    end = np.searchsorted(words, words[:-1] + min_words)  # one past the window's last line
    ok = (end <= n) & (doc[np.minimum(end - 1, n - 1)] == doc)
    i, stop = np.flatnonzero(ok), end[ok]
    start = np.searchsorted(words, words[1:] - min_words, "right") - 1
    z = np.flatnonzero((start >= 0) & (doc[np.maximum(start, 0)] == doc))
    z = z[end[start[z]] != z + 1]
    i, stop = np.concatenate((i, start[z])), np.concatenate((stop, z + 1))
    end = stop
    best, place = line[i].copy(), i.copy()
    left, k = np.flatnonzero(end - i > 1), 1
    while len(left):
        new = line[i[left] + k]
        less = left[new < best[left]]
        best[less], place[less] = line[i[less] + k], i[less] + k
        k += 1
        left = left[(end - i)[left] > k]
    out = {"doc": doc[i], "first": number[i], "last": number[end - 1], "mark": best, "place": place}
    for name, r in zip(("w1", "w2"), _R, strict=True):
        up, down = _powers(r, n)
        total = np.concatenate((np.zeros(1, U64), np.add.accumulate(line * up)))
        out[name] = mix((total[end] - total[i]) * down[i] + (end - i).astype(U64), 5)
    return out


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(U64).view(np.int64))


def removals(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(_d, _k, gone): for each document with repeats its windows, as (first, last) lines, that also start earlier."""
    rows = docs.select(*row_key(), F.col("text").alias("_t"))

    def marks(batches):
        for b in batches:
            data, off = buffers(b.column(0))
            for i, j in slices(off):
                w = windows(data, off[i : j + 1], min_words)
                if len(w["doc"]):
                    _, one = np.unique(w["place"], return_index=True)
                    yield pa.RecordBatch.from_arrays([_long(w["mark"][one])], ["_m"])

    def places(batches):
        for b in batches:
            data, off = buffers(b.column(2))
            for i, j in slices(off):
                w = windows(data, off[i : j + 1], min_words)
                at = pa.array(w["doc"] + i)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(w["first"]), pa.array(w["last"]), _long(w["mark"]), _long(w["w1"]), _long(w["w2"])], ["_d", "_k", "_i", "_j", "_m", "_1", "_2"])

    shared = rows.select("_t").mapInArrow(marks, "_m long").groupBy("_m").agg(F.count("*").alias("_n")).where("_n > 1").select("_m")
    found = stash(rows.mapInArrow(places, "_d long, _k long, _i long, _j long, _m long, _1 long, _2 long").join(shared, "_m", "left_semi").drop("_m"))
    first = found.groupBy("_1", "_2").agg(F.min(F.struct("_d", "_k", "_i", "_j")).alias("f"), F.count("*").alias("_n"))
    kept = first.select("f._d", "f._k", F.struct("f._i", "f._j").alias("w"), F.lit(False).alias("any"))
    both = found.select("_d", "_k", F.struct("_i", "_j").alias("w"), F.lit(True).alias("any")).union(kept)
    sets = both.groupBy("_d", "_k").agg(F.collect_set(F.when(F.col("any"), F.col("w"))).alias("a"), F.collect_set(F.when(~F.col("any"), F.col("w"))).alias("f"))
    return sets.select("_d", "_k", F.array_except("a", "f").alias("gone")).where("size(gone) > 0")


def _cut(text: bytes, gone: np.ndarray) -> tuple[bytes, int, int]:
    lines = text.split(b"\n")
    edge = np.zeros(len(lines) + 1, np.int64)
    np.add.at(edge, gone[:, 0], 1)
    np.add.at(edge, gone[:, 1] + 1, -1)
    stay = np.cumsum(edge[:-1]) == 0
    return b"\n".join(x for x, s in zip(lines, stay, strict=True) if s), len(lines), int((~stay).sum())


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, counts: bool = False) -> DataFrame:
    """docs with the repeated runs cut out of `text`; with `counts`, also _lines and _removed."""
    gone = removals(docs, min_words)
    keyed = marked(docs)
    joined = keyed.join(gone, ["_d", "_k"], "left").drop("_d", "_k")
    at = docs.columns.index("text")
    schema = docs.schema

    def run(batches):
        for b in batches:
            texts, lists = b.column(at), b.column(b.num_columns - 1)
            data, off = buffers(texts)
            cuts, ends = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy()
            pairs = np.stack([cuts.field(0).to_numpy(zero_copy_only=False), cuts.field(1).to_numpy(zero_copy_only=False)], 1) if len(cuts) else np.zeros((0, 2), np.int64)
            to = np.cumsum(ends)
            new, lines, removed = [], [], []
            valid = texts.is_valid().to_numpy(zero_copy_only=False)
            for k in range(len(ends)):
                if not valid[k]:
                    new.append(None), lines.append(0), removed.append(0)
                    continue
                text = data[off[k] : off[k + 1]].tobytes()
                if ends[k]:
                    text, n, r = _cut(text, pairs[to[k] - ends[k] : to[k]])
                else:
                    n, r = text.count(b"\n") + 1, 0
                new.append(text), lines.append(n), removed.append(r)
            cols = [pa.array(new, pa.binary()).cast(pa.string()) if c == at else b.column(c) for c in range(b.num_columns - 1)]
            names = list(schema.names[: len(cols)])
            if counts:
                cols, names = [*cols, pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], [*names, "_lines", "_removed"]
            yield pa.RecordBatch.from_arrays(cols, names)

    if counts:
        for c in ("_lines", "_removed"):
            schema = type(schema)([*schema.fields]).add(c, "long")
    return joined.mapInArrow(run, schema)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed (lines cut), kept_sha256 (of the text that is left; null: of nothing)."""
    done = dedup_lines(spark_tables(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return done.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLES = {
    "op4_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ') AS norm FROM l),
b AS (SELECT doc_id, i, n, norm, sum(n) OVER (PARTITION BY doc_id ORDER BY i) - n AS before, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM w WHERE n > 0),
ends AS (SELECT a.doc_id, a.k AS ka, z.k AS kz, a.i, z.i AS j FROM b a JOIN b z ON a.doc_id = z.doc_id AND z.k BETWEEN a.k AND a.k + 49
         WHERE z.before + z.n - a.before >= 50 AND (z.before - a.before < 50 OR z.before + z.n - a.before - a.n < 50)),
win AS (SELECT e.doc_id, e.i, e.j, string_agg(y.norm, chr(10) ORDER BY y.k) AS body FROM ends e JOIN b y ON y.doc_id = e.doc_id AND y.k BETWEEN e.ka AND e.kz GROUP BY e.doc_id, e.i, e.j),
r AS (SELECT doc_id, i, j, row_number() OVER (PARTITION BY body ORDER BY doc_id, i, j) AS place FROM win),
g AS (SELECT DISTINCT l.doc_id, l.i FROM l JOIN r ON l.doc_id = r.doc_id AND r.place > 1 AND l.i BETWEEN r.i AND r.j),
s AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, string_agg(CASE WHEN g.i IS NULL THEN l.line END, chr(10) ORDER BY l.i) AS kept FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(s.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(s.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id"""
}

"""Target-distribution importance resampling: documents drawn by how much their hashed n-grams resemble a target's.

Features are all words and all pairs of neighbouring words; a feature's bucket is its CRC-32 modulo `BUCKETS`. Bucket
totals of the raw and the target corpus give each bucket a gain (a log ratio), a document's weight is the mean gain of
its features, and a seeded Gumbel draw on top of the weight makes the highest scores a sample without replacement.

Head and tail of the vocabulary: a pass over all raw documents finds the words and pairs that are frequent in some slice,
and the most frequent of them, `HEAD_WORDS` and `HEAD_PAIRS` at most, are broadcast as tables: a word with its CRC state,
a pair with its bucket. A table has one place for each value of a key's first bits; what is not in it is tail, and its CRC
is computed directly from its bytes (a pair's by going on from the state of its first word). The two ways agree on every
feature, so the totals are exact whatever the tables hold. Words and pairs are found in the tables by 64-bit hashes.

What leaves a task: frequent features with a count, a row for each bucket, and a narrow row for each document. Bucket
totals are `BUCKETS` rows at most. Ranks come from sorted ranges with the counts of the ranges before them.

Defined cases: a null or empty text, or one without words, has no features, weight 0 and is not drawn; a null doc_id draws
as an empty one and ranks last among equal scores; repeated rows are documents of their own with ranks that follow each
other; extra columns are ignored; an empty target has T = 0, so gains come from the raw totals alone; an empty table gives
an empty result; words of any length count.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstack.llm.text import LOWER, U64, Words, buffers, mix, ngrams, slices, spark_tables, stash, word_table

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 7, 25, 20
#: Rows of the two broadcast tables at most (12 bytes each), and how often a feature must occur in a slice to be looked at.
HEAD_WORDS, HEAD_PAIRS, OFTEN = 1 << 16, 1 << 18, 16
#: Longer words than this go to zlib one by one.
_LONG = 48
_ALNUM = word_table("alnum")
U32 = np.uint32


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=U32)
    for _ in range(8):
        t = np.where(t & U32(1), (t >> U32(1)) ^ U32(0xEDB88320), t >> U32(1))
    return t


_CRC = _crc_table()
_NEW = U32(0xFFFFFFFF)


def extend(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC states gone on over the bytes start .. end of data; a feature's CRC is the complement of its state."""
    state, size = state.copy(), end - start
    for i in np.flatnonzero(size > _LONG):
        state[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(~state[i])) ^ 0xFFFFFFFF
    left = np.flatnonzero(size <= _LONG)
    for k in range(_LONG):
        left = left[size[left] > k]
        if not len(left):
            break
        s = state[left]
        state[left] = _CRC[(s ^ data[start[left] + k]) & U32(255)] ^ (s >> U32(8))
    return state


class Table:
    """Values by 64-bit key, one place for each value of the key's first bits; of keys with one place the first stays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.shift = U64(64 - bits)
        self.key, self.value = np.zeros(1 << bits, U64), np.zeros(1 << bits, U32)
        self.used = np.zeros(1 << bits, bool)
        at = (keys >> self.shift).astype(np.int64)[::-1]
        self.key[at], self.value[at], self.used[at] = keys[::-1], values[::-1], True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and whether the key is there."""
        at = (keys >> self.shift).astype(np.int64)
        return self.value[at], self.used[at] & (self.key[at] == keys)


class Slice:
    """Words and pairs of a slice of documents: 64-bit keys, documents, and the lower-cased bytes."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data = LOWER[data[off[0] : off[-1]]]
        self.w = Words(data, off, _ALNUM)
        two = self.w.doc[1:] == self.w.doc[:-1]
        self.first = np.flatnonzero(two)  # of each pair
        self.pair = ngrams(self.w.hash, 2)[two]

    def word_states(self, at: np.ndarray) -> np.ndarray:
        return extend(np.full(len(at), _NEW), self.data, self.w.start[at], self.w.end[at])

    def pair_states(self, at: np.ndarray, states: np.ndarray) -> np.ndarray:
        """Of the pairs whose first words are `at` and have these states."""
        space = _CRC[(states ^ U32(32)) & U32(255)] ^ (states >> U32(8))
        return extend(space, self.data, self.w.start[at + 1], self.w.end[at + 1])

    def buckets(self, words: Table, pairs: Table, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, bucket) of each feature."""
        state, known = words.find(self.w.hash)
        tail = np.flatnonzero(~known)
        state[tail] = self.word_states(tail)
        bucket, known = pairs.find(self.pair)
        tail = np.flatnonzero(~known)
        bucket[tail] = ~self.pair_states(self.first[tail], state[self.first[tail]]) % U32(most)
        return np.concatenate((self.w.doc, self.w.doc[self.first])), np.concatenate((~state % U32(most), bucket)).astype(np.int64)


def _often(keys: np.ndarray, often: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of the keys that occur so often."""
    order = np.argsort(keys)
    head = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1]))) if len(keys) else order
    count = np.diff(np.append(head, len(keys)))
    return order[head[count >= often]], count[count >= often]


def vocabulary(docs: DataFrame, buckets: int = BUCKETS, words: int = HEAD_WORDS, pairs: int = HEAD_PAIRS, often: int = OFTEN) -> tuple[Table, Table]:
    """The frequent words with their CRC states and the frequent pairs with their buckets, from all texts of docs."""

    def run(batches):
        for b in batches:
            data, off = buffers(b.column(0))
            for i, j in slices(off):
                s = Slice(data, off[i : j + 1])
                one, n = _often(s.w.hash, often)
                two, m = _often(s.pair, often)
                at = s.first[two]
                value = np.concatenate((s.word_states(one), ~s.pair_states(at, s.word_states(at)) % U32(buckets)))
                key = np.concatenate((s.w.hash[one], s.pair[two])).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(key)) >= len(one)), pa.array(key), pa.array(value.astype(np.int64)), pa.array(np.concatenate((n, m)))], ["pair", "key", "value", "n"])

    found = stash(docs.select("text").mapInArrow(run, "pair boolean, key long, value long, n long").groupBy("pair", "key").agg(F.min("value").alias("value"), F.sum("n").alias("n")))

    def table(pair: bool, most: int) -> Table:
        top = found.where(F.col("pair") == pair).orderBy(F.desc("n"), "key").limit(most).select("key", "value").toArrow()
        return Table(top.column(0).to_numpy().view(U64), top.column(1).to_numpy().astype(U32))

    return table(False, words), table(True, pairs)


def totals(docs: DataFrame, tables, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. tables: the broadcast vocabulary."""

    def run(batches):
        sums = np.zeros(buckets, np.int64)
        for b in batches:
            data, off = buffers(b.column(0))
            for i, j in slices(off):
                sums += np.bincount(Slice(data, off[i : j + 1]).buckets(*tables.value, buckets)[1], minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to raw of each bucket, one added to each total; floored."""
    s, t, n = float(raw.sum()), float(target.sum()), float(len(raw))
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel draw that depends on the seed and doc_id alone; floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weights(docs: DataFrame, tables, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row, and a hash of its text."""
    shared, kind = docs.sparkSession.sparkContext.broadcast(gain), docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            data, off = buffers(b.column(1))
            for i, j in slices(off):
                s = Slice(data, off[i : j + 1])
                doc, bucket = s.buckets(*tables.value, len(shared.value))
                n = np.bincount(doc, minlength=j - i)
                total = np.bincount(doc, shared.value[bucket], minlength=j - i).astype(np.int64)  # exact below 2**53
                count = np.diff(s.w.first)
                sign = np.zeros(j - i, U64)
                np.add.at(sign, s.w.doc, mix(s.w.hash + (np.arange(len(s.w)) - s.w.first[s.w.doc]).astype(U64), 3))
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(count), pa.array(n), pa.array(total // np.maximum(n, 1)), pa.array(sign.view(np.int64))], ["doc_id", "n_words", "n_features", "weight", "sign"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long, sign long")


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """The rows with `rank`, from 1 in the given order: sorted ranges, written, and the counts of the ranges before each."""
    put = stash(rows.orderBy(*order).withColumn("_i", F.monotonically_increasing_id()))
    before, counts = 0, []
    for r, n in sorted(map(tuple, put.groupBy(F.shiftright("_i", 33).cast("long")).count().collect())):  # a row for each shuffle partition
        counts.append((r, before))
        before += n
    counts = rows.sparkSession.createDataFrame(counts or [(0, 0)], "_range long, _before long")
    put = put.withColumn("_range", F.shiftright("_i", 33).cast("long")).join(F.broadcast(counts), "_range")
    return put.withColumn("rank", F.col("_before") + F.col("_i").bitwiseAND((1 << 33) - 1) + 1).drop("_i", "_range", "_before")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of docs. The `percent` of the rows with `least` words or
    more whose scores are highest are drawn, with ranks from 1; rank is null for the rest."""
    sc = docs.sparkSession.sparkContext
    tables = sc.broadcast(vocabulary(docs, buckets))
    gain = gains(totals(docs, tables, buckets), totals(target, tables, buckets))
    scored = stash(weights(docs, tables, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    able = scored.where(F.col("n_words") >= least)
    drawn = able.count() * percent // 100
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    rank = ranked(able, F.desc("score"), F.asc_nulls_last("doc_id"), F.col("sign")).select(*names, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return rank.union(scored.where(F.col("n_words") < least).select(*names, F.lit(None).cast("long")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark_tables(spark, sf_dir, "documents"), spark_tables(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op12_importance_resampling": op12_importance_resampling}
#: The CRC of each distinct feature is reduced byte by byte over a table that the query builds.
ORACLES = {
    "op12_importance_resampling": r"""
WITH tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
fd AS (SELECT doc_id, unnest(w) AS f FROM d UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d),
fb AS (SELECT unnest(w) AS f FROM b UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM b),
kd AS (SELECT doc_id, f, count(*) AS n FROM fd GROUP BY ALL),
kinds AS (SELECT f FROM kd UNION SELECT f FROM fb),
bytes AS (SELECT f, hex(encode(f)) AS x FROM kinds),
crc AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x), 2), lambda i: (16 * (instr('123456789ABCDEF', x[i])) + instr('123456789ABCDEF', x[i + 1]))::BIGINT)),
 lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS k FROM bytes, tab),
s AS (SELECT k, sum(n) AS n FROM kd JOIN crc USING (f) GROUP BY k), t AS (SELECT k, count(*) AS n FROM fb JOIN crc USING (f) GROUP BY k),
g AS (SELECT s.k, floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT sum(n) FROM s) + 10000.0::DOUBLE) / ((s.n + 1.0::DOUBLE) * (coalesce((SELECT sum(n) FROM t), 0) + 10000.0::DOUBLE)))) AS gain FROM s LEFT JOIN t USING (k)),
w AS (SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM kd JOIN crc USING (f) JOIN g USING (k) GROUP BY doc_id),
a AS (SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
 coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM a WHERE n_words >= 20)
SELECT a.doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= n * 25 // 100 THEN rank END AS rank FROM a LEFT JOIN r USING (doc_id)"""
}

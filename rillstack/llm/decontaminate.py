"""Benchmark decontamination with suffix arrays over the training text.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lower-cased. Every slice of documents (a shard, a few MB) gets a
suffix array over its words; every test suffix, that is a benchmark item from one of its words on, is
binary-searched in every shard. The interval of the array that shares the window (10 words, or a whole shorter item)
gives all locations; neighbouring locations on one diagonal add up to the longest verbatim match.

Only suffixes that open with three words in a row of some item (or as many as a shorter item has) go into a shard's
array: no other can share a window. The array is ordered by as many words as a window has, which is all that the search reads.

The corpus is never shuffled. The benchmark is split into blocks of about `BLOCK_WORDS` words, and one block at a time is
sent to the tasks, so what is broadcast does not grow; with several blocks their results meet by row. Blocks are dealt by what items hold, so
many items of one item_id spread; items longer than a block go in overlapping pieces (a match that runs over the end of a piece counts to it in `longest`).

Defined cases: a null or empty text has no words and is clean; an item without words is never found; repeated rows
each count, items of one item_id count and are named once; items without an item_id count together as one item without a name, whose passages are hits as any
other's, and only their name is left out of items_sha256; extra columns pass through; with an empty benchmark all is clean; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstack.llm.text import U64, Words, buffers, mix, ngrams, row_key, slices, spark_tables, stash, word_table

WINDOW = 10
#: Benchmark words that are sent to the tasks at once: a window of 10 hashes and its places each, some 120 MB together.
BLOCK_WORDS = 1_000_000
_ALNUM = word_table("alnum")
_MAP = 20


class Tests:
    """Test suffixes of a block of items: distinct windows, and the (item, offset) places of each."""

    def __init__(self, items: list[tuple[int, np.ndarray]], window: int = WINDOW):
        self.window = window
        rows, length, item, place = [], [], [], []
        for number, (_, h) in enumerate(items):
            n = min(window, len(h))
            if n:
                view = np.zeros((len(h) - n + 1, window), U64)
                view[:, :n] = np.lib.stride_tricks.sliding_window_view(h, n)
                rows.append(view)
                length.append(np.full(len(view), n))
                item.append(np.full(len(view), number))
                place.append(np.arange(len(view)))
        self.ids = [x for x, _ in items]
        one = (lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind))
        table, size = (np.concatenate(rows) if rows else np.zeros((0, window), U64)), one(length, np.int64)
        key = mix(ngrams(table.ravel(), window)[::window] + size.astype(U64), 1) if len(table) else np.zeros(0, U64)
        order = np.argsort(key, kind="stable")
        head = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[order][1:] != key[order][:-1])))
        self.rows, self.size = table[order[head]], size[order[head]]
        self.cut = np.append(head, len(key))  # places of distinct window i: cut[i] to cut[i + 1]
        self.item, self.place = one(item, np.int64)[order], one(place, np.int64)[order]
        #: First words of windows, by how many words open them: a bit map of their hashes, then the sorted hashes.
        self.opens = []
        for n in sorted({min(3, int(x)) for x in self.size}):
            h = np.unique(ngrams(self.rows[np.minimum(3, self.size) == n][:, :n].ravel(), n)[::n])
            bits = np.zeros(1 << _MAP, bool)
            bits[(h >> U64(64 - _MAP)).astype(np.int64)] = True
            self.opens.append((n, bits, h))


def _search(tests: Tests, rows: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of every distinct window in the sorted suffixes `rows`, comparing the window's own words."""
    lo, hi = np.zeros(len(tests.rows), np.int64), np.full(len(tests.rows), len(rows))
    beyond = np.arange(tests.window)[None] >= tests.size[:, None]
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) >> 1
        a, b = rows[mid], tests.rows[open_]
        differs = (a != b) & ~beyond[open_]
        at = np.argmax(differs, 1)
        some = differs[np.arange(len(at)), at]
        left, right = a[np.arange(len(at)), at], b[np.arange(len(at)), at]
        less = np.where(some, left < right, upper)
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]
    return lo


def scan(tests: Tests, data: np.ndarray, off: np.ndarray) -> list[tuple[int, list, list, int]]:
    """For each document of a shard: words, hit word spans [(start, end)], item numbers, longest match in words."""
    w = Words(data, off, _ALNUM)
    n, n_docs = len(w), len(off) - 1
    out = [[int(x), [], [], 0] for x in np.diff(w.first)]
    if not n or not len(tests.rows):
        return out
    start = np.zeros(n, bool)
    for k, bits, known in tests.opens:
        g = ngrams(w.hash, k)
        at = np.flatnonzero(bits[(g >> U64(64 - _MAP)).astype(np.int64)])
        found = np.minimum(np.searchsorted(known, g[at]), len(known) - 1)
        start[at[known[found] == g[at]]] = True
    at = np.flatnonzero(start)
    if not len(at):
        return out
    stop = w.first[1:][w.doc[at]]
    cols = at[:, None] + np.arange(tests.window)[None]
    rows = np.where(cols < stop[:, None], w.hash[np.minimum(cols, n - 1)], U64(0))
    order = np.lexsort(rows.T[::-1])
    rows, at = rows[order], at[order]
    lo, hi = _search(tests, rows, False), _search(tests, rows, True)
    got = np.flatnonzero(lo < hi)
    if not len(got):
        return out
    # every location: (distinct window, word position)
    many = (hi - lo)[got]
    which = np.repeat(got, many)
    pos = at[np.repeat(lo[got], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    fits = pos + tests.size[which] <= w.first[1:][w.doc[pos]]
    which, pos = which[fits], pos[fits]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, pos, 1)
    np.add.at(edge, pos + tests.size[which], -1)
    hit = np.concatenate(([False], np.cumsum(edge[:-1]) > 0, [False]))
    begin, end = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(hit[:-1] & ~hit[1:])
    # a span of adjoining hits may run over a document's end
    for b, e in zip(begin, end, strict=True):
        while b < e:
            d = int(w.doc[b])
            cut = min(e, int(w.first[d + 1]))
            out[d][1].append((int(b - w.first[d]), int(cut - w.first[d])))
            b = cut
    # each location times the places of its window: items, and runs on a diagonal
    times = np.diff(tests.cut)[which]
    p = np.repeat(pos, times)
    s = np.repeat(tests.cut[which], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    item, place, size = tests.item[s], tests.place[s], np.repeat(tests.size[which], times)
    doc = w.doc[p]
    for d, i in np.unique(np.stack([doc, item], 1), axis=0):
        if tests.ids[i] not in out[d][2][-1:]:  # items in order, so repeated ids stand together
            out[d][2].append(tests.ids[i])
    o = np.lexsort((p, p - place, item))
    fresh = np.concatenate(([True], (item[o][1:] != item[o][:-1]) | ((p - place)[o][1:] != (p - place)[o][:-1]) | (p[o][1:] != p[o][:-1] + 1) | (doc[o][1:] != doc[o][:-1])))
    head = np.flatnonzero(fresh)
    run = np.diff(np.append(head, len(o))) - 1 + size[o][head]
    longest = np.zeros(n_docs, np.int64)
    np.maximum.at(longest, doc[o][head], run)
    for d in np.flatnonzero(longest):
        out[d][3] = int(longest[d])
    return out


def blocks(benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_WORDS):
    """The benchmark as Tests, one block of at most about `most` words after the other."""

    def extract(batches):
        for b in batches:
            data, off = buffers(b.column(1))
            for i, j in slices(off):
                w = Words(data, off[i : j + 1], _ALNUM)
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.ListArray.from_arrays(pa.array(w.first, pa.int32()), pa.array(w.hash.view(np.int64)))], ["item_id", "h"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    items = benchmark.select("item_id", "text").mapInArrow(extract, f"item_id {kind}, h array<long>")
    words = items.agg(F.sum(F.size("h"))).first()[0] or 0
    parts = max(1, -(-words // most))
    if parts > 1:  # rows alike once, long items in pieces that share all but one word of a window, dealt by what they hold
        starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.size("h") - window, F.lit(0)).cast("long"), F.lit(most).cast("long"))
        items = stash(items.distinct().select("item_id", F.explode(F.transform(starts, lambda a: F.slice("h", (a + 1).cast("int"), most + window - 1))).alias("h")))
    for k in range(parts):
        got = items.where(F.pmod(F.xxhash64("item_id", "h"), F.lit(parts)) == k).toArrow() if parts > 1 else items.toArrow()
        if parts > 1 and not got.num_rows:
            continue
        yield Tests(sorted([(i, np.array(h, np.int64).view(U64)) for i, h in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True)], key=lambda x: (x[0] is not None, x[0])), window)


def _results(tests: Tests, texts: pa.Array) -> list:
    data, off = buffers(texts)
    return [x for i, j in slices(off) for x in scan(tests, data, off[i : j + 1])]


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """_d, _k, doc_id, n_words, spans (hit word ranges, merged), items, longest: one row for each row of docs."""
    sc, kind = docs.sparkSession.sparkContext, docs.schema["doc_id"].dataType.simpleString()
    item = benchmark.schema["item_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").alias("_t"), *row_key())
    schema = f"doc_id {kind}, _d long, _k long, n_words long, spans array<struct<s:long,e:long>>, items array<{item}>, longest long"
    spans = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    names = ["doc_id", "_d", "_k", "n_words", "spans", "items", "longest"]

    def one(tests: Tests) -> DataFrame:
        shared, ids = sc.broadcast(tests), pa.int64() if item == "bigint" else None

        def run(batches):
            for b in batches:
                r = _results(shared.value, b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array([x[0] for x in r], pa.int64()), pa.array([[{"s": s, "e": e} for s, e in x[1]] for x in r], spans), pa.array([x[2] for x in r], pa.list_(ids or pa.string())), pa.array([x[3] for x in r], pa.int64())], names)

        return rows.mapInArrow(run, schema)

    found = [one(t) for t in blocks(benchmark, window)]
    if len(found) == 1:
        return found[0]
    # several blocks: rows alike in _d and _k are alike in all, and count as one here and as many as they are below
    flat = reduce(DataFrame.unionAll, found).groupBy("doc_id", "_d", "_k", "n_words").agg(F.flatten(F.collect_list("spans")).alias("s"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.max("longest").alias("longest"), F.count("*").alias("_n"))

    def merge(batches):
        for b in batches:
            new = []
            for x in b.column(4).to_pylist():
                out: list = []
                for y in sorted(x, key=lambda y: (y["s"], y["e"])):
                    if out and y["s"] <= out[-1]["e"]:
                        out[-1]["e"] = max(out[-1]["e"], y["e"])
                    else:
                        out.append(dict(y))
                new.append(out)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(new, spans), b.column(5), b.column(6), b.column(7)], [*names, "_n"])

    merged = flat.mapInArrow(merge, schema + ", _n long")
    return merged.withColumn("_c", F.explode(F.sequence(F.lit(1), (F.col("_n") / len(found)).cast("int")))).select(*names)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of any item."""
    at = docs.columns.index("text")
    for tests in blocks(benchmark, window):
        shared = docs.sparkSession.sparkContext.broadcast(tests)

        def run(batches, shared=shared):
            for b in batches:
                yield b.filter(pa.array([not x[1] for x in _results(shared.value, b.column(at))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(spark_tables(spark, sf_dir, "documents"), spark_tables(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"), "longest",
    )


QUERIES = {"op8_decontaminate": op8_decontaminate}
#: As runs of words between separators that occur nowhere in a word; the longest match is the longest run on a diagonal.
ORACLES = {
    "op8_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS q, w FROM b WHERE len(w) > 0),
bk AS (SELECT item_id, n, q, array_to_string(w[q:q + n - 1], ' ') AS k FROM bw),
sizes AS (SELECT DISTINCT n FROM bk),
dp AS (SELECT doc_id, s.n, unnest(range(1, len(w) - s.n + 2)) AS p, w FROM d, sizes s WHERE len(w) >= s.n),
dk AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS k FROM dp),
m AS (SELECT dk.doc_id, dk.p, dk.n, bk.item_id, bk.q FROM dk JOIN bk ON dk.n = bk.n AND dk.k = bk.k),
hits AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM (SELECT DISTINCT doc_id, p, n FROM m)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id),
run AS (SELECT doc_id, max(c) AS longest FROM (SELECT doc_id, item_id, g, h, count(*) - 1 + max(n) AS c FROM (SELECT DISTINCT doc_id, item_id, n, p - q AS g, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS h, p FROM m) GROUP BY ALL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN its ON d.doc_id = its.doc_id LEFT JOIN run ON d.doc_id = run.doc_id"""
}

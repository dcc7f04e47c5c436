"""Periodic run detection: stretches of words that go on repeating with one period, by descending-LCP Kruskal.

The suffixes of all texts of a slice are put in order together by prefix doubling (a text's suffixes only ever meet each
other), with the longest common prefix of neighbours. Going down through these lengths, classes of suffixes are united;
a class is a stretch of neighbours in suffix order, so its two ends stand for it and a find is one step. Each class keeps
its positions in order, and the smaller class goes into the larger one. Two positions that become neighbours in a united
class share exactly as many words as the length at hand. If their distance d is small against it, words repeat with
period d from the first one on; d is the smallest period, as a smaller one would have put a position between them. A
seed whose left neighbours agree as well belongs to the run that starts further left, and is left out.

Lengths under the least that any run of the wanted exponent can show are not united, and groups of suffixes whose
longest common prefix is too short for their smallest distance are passed over: neither can seed a run.

A text is whole in its task, and nothing is shuffled. Words are told apart by 64-bit hashes.

Defined cases: a null or empty text, or one of white space, has no words, no runs and an empty collapsed text; rows with
a null or repeated doc_id are worked on by themselves like any other; a word of any length is one word; equal runs of
equal exponent are told apart by start, then period; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstack.llm.text import U64, Words, buffers, mix, slices, spark_tables, word_table

EXPONENT, LENGTH = 4, 6
_SPACE = word_table("space")


def ranks(hashes: np.ndarray, doc: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Level k: each suffix's rank by its first 2**k words, within its document (`end`: of each word's document). The last
    level has no ties."""
    n = len(hashes)
    key = mix(hashes + mix(doc.astype(U64), 5), 6)
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, step = [rank], 1
    tied = ~new
    tied[:-1] |= ~new[1:]
    active = order[tied]
    while len(active):
        to = active + step
        after = np.where(to < end[active], rank[np.minimum(to, n - 1)] + 1, 0)
        old = rank[active]
        key = old * (n + 1) + after
        order = np.argsort(key)
        active, old, key = active[order], old[order], key[order]
        group = np.concatenate(([True], old[1:] != old[:-1]))
        new = np.concatenate(([True], key[1:] != key[:-1]))
        at = np.arange(len(active))
        first = np.maximum.accumulate(np.where(group, at, 0))
        rank = rank.copy()
        rank[active] = old + np.maximum.accumulate(np.where(new, at, 0)) - first
        levels.append(rank)
        tied = ~new
        tied[:-1] |= ~new[1:]
        active, step = active[tied], 2 * step
    return levels


def neighbours(levels: list[np.ndarray], doc: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the common prefix of each with the next one (0 where it is under `least`)."""
    n = len(doc)
    order = np.empty(n, np.int64)
    order[levels[-1]] = np.arange(n)
    common = np.zeros(n, np.int64)
    low = min(least.bit_length() - 1, len(levels) - 1)
    same = levels[low][order]
    pair = np.flatnonzero(same[1:] == same[:-1]) if 1 << low <= least else np.arange(n - 1)
    a, b = np.minimum(order[pair], order[pair + 1]), np.maximum(order[pair], order[pair + 1])
    size, last = np.zeros(len(pair), np.int64), end[b]
    for k in reversed(range(len(levels))):
        inside = b + size + (1 << k) <= last
        at = np.where(inside, size, 0)
        size += np.where(inside & (levels[k][a + at] == levels[k][b + at]), 1 << k, 0)
    common[pair] = np.where((size >= least) & (doc[a] == doc[b]), size, 0)
    return order, common


def seeds(order: np.ndarray, common: np.ndarray, exponent: int, length: int) -> list[tuple[int, int, int]]:
    """(position, distance, common prefix) of positions that become neighbours in a class, near enough to seed a run."""
    joined = common > 0
    starts = np.flatnonzero(joined & ~np.concatenate(([False], joined[:-1])))
    if not len(starts):
        return []
    stops = np.flatnonzero(joined & ~np.concatenate((joined[1:], [False]))) + 1  # the last suffix of each group
    sizes = stops - starts + 1
    group = np.repeat(np.arange(len(starts)), sizes)
    slot = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[group]
    by_place = np.lexsort((order[slot], group))
    place = order[slot][by_place]
    gap = np.where(group[1:] == group[:-1], np.diff(place), np.iinfo(np.int64).max)
    nearest = np.full(len(starts), np.iinfo(np.int64).max)
    np.minimum.at(nearest, group[:-1], gap)
    longest = np.maximum.reduceat(common, np.stack((starts, stops), 1).ravel())[::2]
    live = np.flatnonzero(nearest <= longest // (exponent - 1))
    edges = np.concatenate([np.arange(starts[g], stops[g]) for g in live]) if len(live) else starts[:0]
    edges = edges[np.argsort(-common[edges], kind="stable")]
    low, high, places, out = {}, {}, {}, []
    most, where = exponent - 1, order.tolist()
    for e, l in zip(edges.tolist(), common[edges].tolist(), strict=True):
        a, b = low.pop(e, e), e + 1
        end = high.pop(b, b)
        low[end], high[a] = a, end
        one, two = places.pop(a, None) or [where[e]], places.pop(b, None) or [where[b]]
        if len(one) < len(two):
            one, two = two, one
        for t, x in enumerate(two):
            k = bisect_left(one, x)
            if k and (d := x - one[k - 1]) * most <= l and d + l >= length and (t == 0 or two[t - 1] < one[k - 1]):
                out.append((one[k - 1], d, l))
            if k < len(one) and (d := one[k] - x) * most <= l and d + l >= length and (t + 1 == len(two) or two[t + 1] > one[k]):
                out.append((x, d, l))
        if len(two) * 16 > len(one):
            one += two
            one.sort()
        else:
            for x in two:
                insort(one, x)
        places[a] = one
    return out


def runs(w: Words, exponent: int = EXPONENT, length: int = LENGTH) -> np.ndarray:
    """Rows (first word within the slice, length, period) of all runs of the exponent and length at least, by start and period."""
    if len(w) < 2:
        return np.zeros((0, 3), np.int64)
    least = min(max(length, exponent * q) - q for q in range(1, length + 1))
    end = w.first[1:][w.doc]
    order, common = neighbours(ranks(w.hash, w.doc, end), w.doc, end, least)
    found = np.array(seeds(order, common, exponent, length), np.int64).reshape(-1, 3)
    at, period = found[:, 0], found[:, 1]
    left = (at > w.first[w.doc[at]]) & (w.hash[at - 1] == w.hash[at - 1 + period])
    out = np.stack([at, found[:, 2] + period, period], 1)[~left]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def collapsed(data: np.ndarray, off: np.ndarray, w: Words, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of each text's words, joined by one space, without those that a run holds after its first period."""
    own, cut = data[off[0] : off[-1]].copy(), off - off[0]
    cover = np.zeros(len(w) + 1, np.int64)
    np.add.at(cover, found[:, 0] + found[:, 2], 1)
    np.add.at(cover, found[:, 0] + found[:, 1], -1)
    keep = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
    edge = np.zeros(len(own) + 1, np.int8)
    edge[w.start[keep]] += 1
    edge[w.end[keep]] -= 1
    stay = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    gap = w.end[keep[:-1][w.doc[keep[:-1]] == w.doc[keep[1:]]]]  # a word with another behind it is followed by white space
    own[gap], stay[gap] = 0x20, True
    return own[stay], np.concatenate(([0], np.cumsum(stay)))[cut]


def find_runs(docs: DataFrame, exponent: int = EXPONENT, length: int = LENGTH) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start and period; words numbered from 0) and collapsed (text) of every row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            data, off = buffers(b.column(1))
            for i, j in slices(off):
                w = Words(data, off[i : j + 1], _SPACE, lower=False)
                found = runs(w, exponent, length)
                text, cut = collapsed(data, off[i : j + 1], w, found)
                doc = w.doc[found[:, 0]]
                fields = [pa.array(c) for c in (found[:, 0] - w.first[doc], found[:, 1], found[:, 2])]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(j - i + 1)), pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                texts = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(np.ascontiguousarray(cut)), pa.py_buffer(text)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], lists, texts], ["doc_id", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def longest_exponent(found: Column) -> Column:
    """Of an array of runs the one of the greatest length over period, compared as whole products; the first of equal ones."""
    better = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    return F.aggregate(found, F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda best, x: F.when(better(best, x), x).otherwise(best))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, with the periods that the query's contract plants: where h = crc32(doc_id) divides by ten, word i of
    n from a = (h div 10) mod n on becomes word a + (i - a) mod p, p = 1 + (n - a) div (3 + (h div 10) mod 8)."""
    d = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("_h"))
    d = d.withColumn("_g", F.floor(F.col("_h") / 10)).withColumn("_w", F.when(F.col("_h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")))
    d = d.withColumn("_n", F.size("_w").cast("long")).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    d = d.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    from_ = F.when(F.col("_a") > 0, F.slice("_w", 1, F.col("_a").cast("int"))).otherwise(F.array().cast("array<string>"))
    again = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - F.col("_a") - 1), lambda i: F.get("_w", (F.col("_a") + i % F.col("_p")).cast("int")))
    return d.select("doc_id", F.when(F.col("_n") > 0, F.array_join(F.concat(from_, again), " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(planted(spark_tables(spark, sf_dir, "documents"))).withColumn("_b", longest_exponent(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"_b.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * F.col("_b.length") / F.col("_b.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
ORACLES: dict[str, str] = {}

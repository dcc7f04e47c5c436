"""N-gram Jaccard join with set-relation skipping; components of the links.

A document's set holds its distinct word shingles. Two sets link when 100 * |common| >= threshold * |union|. Every set
orders its elements by one global order: first elements that are not frequent, by hash, then frequent ones, by the
power of two of their frequency. Frequencies come from a fixed-size table of counters over all sets; they only
order elements, so collisions cost time and lose nothing; as the counters fill up with the corpus, the elements that are frequent in the prefixes
of this order are counted exactly, `LISTED` of them are put last by their counts, and prefixes are taken anew. Linked sets share an element of
their prefixes in this order.
The inverted index holds the prefixes with positions. Sets that are equal are one class with one representative.

Block skipping: index lists are split into blocks by the size of the larger set. An entry of the smaller set at position i is
sent only to blocks whose sizes it can link to and in which position i can still be the first common element
(i <= n - needed(n, m)); the other blocks are never joined. In each list the set that stands first is the hub.

Answers derived from a similar set's: each set is verified against the hubs of its lists, and one hub that it resembles becomes its
reference A, with the exact difference D(X) = X xor A. For two sets of one reference |X xor Y| = |D(X)| + |D(Y)| - 2 |D(X) and D(Y)|,
so whether they link is decided by the common elements of their differences: what they share with A is never compared again. Differences
are indexed by their elements within the group, the rarest first, in blocks by the size of the larger difference, with prefixes by the
same bound. Look-alikes that edit a text at different places share no such element, so a group of them makes no pairs,
however large it is. Sets that link to A are in one component, and pairs within a component are never made. Sets of
different references meet by the blocks of their prefixes, list by list and group by group, so that the pairs within a group are not gone through.

No list is gathered in a task: lists are aggregated or joined by element, sets with many rows of one element are split by
adaptive execution. Ids needed for verifying are broadcast only if counted to be few.

Defined cases: null, empty and word-less texts have the empty set and are alone; a text of fewer words than a
shingle has one element, the whole sequence; the texts of one doc_id are in one component; a null doc_id gets the component of
its set (null if all of it is null); extra columns are ignored; an empty table gives an empty result. Elements and classes are
told apart by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstack.llm.components import components
from rillstack.llm.text import U64, Words, buffers, checked_broadcast, marked, mix, ngrams, row_key, slices, spark_tables, stash, unmarked, weights, word_table

WIDTH, THRESHOLD = 4, 85
#: Bits of the table of frequency counters: 2**20 counters, 1 MB when sent to the tasks.
SKETCH_BITS = 20
_BLOCK = 4096
#: Elements whose exact counts are sent to all tasks: the most frequent ones of the first prefixes, of those in more than SEVERAL of them.
LISTED, SEVERAL = 1 << 20, 8
#: Similarity to a hub from which it serves as reference. Any value is exact; differences grow as it falls.
ALIKE = 0.2
#: Bits of a set's mark.
MARK_BITS = 1024
#: Tasks whose counters meet in one group.
_FAN = 256
_SPACE = word_table("space")


def sets(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a slice's documents, sorted within each, and where each document's begin."""
    w = Words(data, off, _SPACE)
    n = len(off) - 1
    count = np.diff(w.first)
    g = ngrams(w.hash, width)
    inside = w.doc[: len(g)] == w.doc[len(w) - len(g) :] if len(g) else np.zeros(0, bool)
    g, doc = g[inside], w.doc[: len(inside)][inside]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        k = weights(2 * width)
        whole = np.array([mix((w.hash[w.first[d] : w.first[d + 1]] * k[: count[d]]).sum(keepdims=True) + U64(count[d]), 17)[0] for d in short], U64)
        g, doc = np.concatenate((g, whole)), np.concatenate((doc, short))
        o = np.argsort(doc, kind="stable")
        g, doc = g[o], doc[o]
    cut = np.searchsorted(doc, np.arange(n + 1))
    out = [np.unique(g[cut[d] : cut[d + 1]]) for d in range(n)]
    return np.concatenate(out) if out else g, np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int64)


def _class(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    total = np.concatenate((np.zeros(1, U64), np.add.accumulate(mix(h, 23))))
    size = np.diff(cut).astype(U64)
    return mix(total[cut[1:]] - total[cut[:-1]] + size * U64(0x9E3779B97F4A7C15), 29)


def _count(table: np.ndarray, h: np.ndarray, bits: int) -> None:
    table += np.bincount((h >> U64(64 - bits)).astype(np.int64), minlength=1 << bits)


def _frequency_classes(blocks: DataFrame, bits: int) -> np.ndarray:
    """The class of each counter, 0 for all but frequent ones. blocks: (_b, _p, _t), a task's counters cut into pieces; they
    are added up by piece in levels, 256 tasks at most in a group."""

    def add(key, rows):
        total = np.zeros(_BLOCK, np.int64)
        for x in rows.column("_t"):
            total += np.frombuffer(x.as_buffer(), np.int64)
        return pa.table({"_b": pa.array([key[0].as_py()], pa.int32()), "_p": pa.array([key[1].as_py()], pa.int64()), "_t": pa.array([total.tobytes()], pa.binary())})

    tasks = (blocks.agg(F.max("_p")).first()[0] or 0) + 1
    while True:
        blocks = blocks.groupBy("_b", F.expr(f"_p div {_FAN}").alias("_q")).applyInArrow(add, "_b int, _p long, _t binary")
        tasks = -(-tasks // _FAN)
        if tasks == 1:
            break
    table = np.zeros(1 << bits, np.int64)
    got = blocks.toArrow()
    for k, t in zip(got.column("_b").to_pylist(), got.column("_t").to_pylist(), strict=True):
        table[k * _BLOCK : (k + 1) * _BLOCK] = np.frombuffer(t, np.int64)
    common = 4 * table.mean() + 8
    return np.where(table > common, 1 + np.floor(np.log2(np.maximum(table, 1) / common)), 0).astype(np.uint8)


def _marks(h: np.ndarray, cut: np.ndarray) -> pa.Array:
    """MARK_BITS bits a set, each the parity of the elements that fall on it: two sets' marks differ in no more bits than the sets do in elements."""
    n = len(cut) - 1
    cell = np.repeat(np.arange(n), np.diff(cut)) * MARK_BITS + (mix(h, 41) >> U64(64 - int(math.log2(MARK_BITS)))).astype(np.int64)
    bits = np.packbits((np.bincount(cell, minlength=n * MARK_BITS) & 1).astype(np.uint8))
    return pa.Array.from_buffers(pa.binary(MARK_BITS // 8), n, [None, pa.py_buffer(bits.tobytes())]).cast(pa.binary())


class Order:
    """The global order of elements: rank of an element by its exact count if it is one of the listed, else by its counter."""

    def __init__(self, counters: np.ndarray, bits: int, elements: np.ndarray, counts: np.ndarray):
        o = np.argsort(elements)
        self.bits, self.counters, self.elements, self.ranks = bits, counters, elements[o], (64 + np.floor(np.log2(np.maximum(counts[o], 1)))).astype(np.uint8)
        self.some = np.zeros(1 << bits, bool)
        self.some[(elements >> U64(64 - bits)).astype(np.int64)] = True

    def rank(self, h: np.ndarray) -> np.ndarray:
        slot = (h >> U64(64 - self.bits)).astype(np.int64)
        out = self.counters[slot]
        at = np.flatnonzero(self.some[slot])
        if len(at):
            k = np.minimum(np.searchsorted(self.elements, h[at]), len(self.elements) - 1)
            same = self.elements[k] == h[at]
            out[at[same]] = self.ranks[k[same]]
        return out


def _prefix(batches, order: Order, width: int, threshold: int):
    """Rows of arrays (element, class, size, position) of the prefixes; sets alike in a batch once."""
    for b in batches:
        data, off = buffers(b.column(0))
        seen = np.zeros(0, U64)
        for i, j in slices(off):
            h, cut = sets(data, off[i : j + 1], width)
            n = np.diff(cut)
            key = _class(h, cut)
            _, one = np.unique(key, return_index=True)
            one = one[(n[one] > 0) & ~np.isin(key[one], seen)]
            seen = np.concatenate((seen, key[one]))
            size = n[one]
            keep = size - (threshold * size + 99) // 100 + 1
            at = np.repeat(cut[one], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            own, who = h[at], np.repeat(np.arange(len(one)), size)
            rank = order.rank(own)
            if rank.any():  # within a set elements are in hash order already
                o = np.argsort(who.astype(np.int64) * 256 + rank, kind="stable")
                own = own[o]
            pos = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
            use = pos < np.repeat(keep, size)
            yield own[use], key[one][who[use]], size[who[use]], pos[use]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _with_sets(pairs: DataFrame, texts: DataFrame, reps: DataFrame, width: int, result, schema: str) -> DataFrame:
    """result(a, b, their sets) for batches of the pairs (a, b) of classes; it returns a record batch."""
    ids = stash(pairs.select(F.col("a").alias("_c")).union(pairs.select(F.col("b").alias("_c"))).distinct().join(reps, "_c"))
    own = texts.join(checked_broadcast(ids), ["_d", "_k"]).select("_c", "_t").dropDuplicates(["_c"])
    both = pairs.join(own.select(F.col("_c").alias("a"), F.col("_t").alias("_ta")), "a").join(own.select(F.col("_c").alias("b"), F.col("_t").alias("_tb")), "b").select("a", "b", "_ta", "_tb")

    def run(batches):
        for batch in batches:
            step = 512
            for at in range(0, batch.num_rows, step):
                b = batch.slice(at, step)
                got = []
                for c in (2, 3):
                    data, off = buffers(b.column(c))
                    got.append([(h[x:y]) for i, j in slices(off) for h, cut in [sets(data, off[i : j + 1], width)] for x, y in zip(cut[:-1], cut[1:], strict=True)])
                yield result(b.column(0), b.column(1), *got)

    return both.mapInArrow(run, schema)


def _close(pairs: DataFrame, sets_: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose marks (_c, _n, _s) leave a link possible."""
    own = lambda c: sets_.select(F.col("_c").alias(c), F.col("_n").alias(f"n{c}"), F.col("_s").alias(f"s{c}"))
    both = pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", "na", "nb", "sa", "sb")

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in (4, 5))
                apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
                yield b.filter(pa.array((100 + threshold) * apart <= (100 - threshold) * (b.column(2).to_numpy() + b.column(3).to_numpy()))).select(["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _overlaps(pairs: DataFrame, texts: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """a, b, n, m, o: the sizes of the pairs' whole sets and how many elements they have in common."""

    def result(a, b, x, y):
        n, m = (np.array([len(s) for s in z], np.int64) for z in (x, y))
        o = np.array([len(s) + len(t) - len(np.union1d(s, t)) for s, t in zip(x, y, strict=True)], np.int64)
        return pa.RecordBatch.from_arrays([a, b, pa.array(n), pa.array(m), pa.array(o)], ["a", "b", "n", "m", "o"])

    return _with_sets(pairs, texts, reps, width, result, "a long, b long, n long, m long, o long")


def _differences(pairs: DataFrame, texts: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """a, b, diff: the elements of a that b has not, and those of b that a has not, told apart by their hashes."""

    def result(a, b, x, y):
        parts = [np.concatenate((mix(np.setdiff1d(s, t, True), 31), mix(np.setdiff1d(t, s, True), 37))) for s, t in zip(x, y, strict=True)]
        cut = np.concatenate(([0], np.cumsum([len(d) for d in parts])))
        flat = np.concatenate(parts) if parts else np.zeros(0, U64)
        return pa.RecordBatch.from_arrays([a, b, pa.ListArray.from_arrays(pa.array(cut, pa.int32()), _signed(flat))], ["a", "b", "diff"])

    return _with_sets(pairs, texts, reps, width, result, "a long, b long, diff array<long>")


def _references(checked: DataFrame) -> DataFrame:
    """x, g, n, m, d: for each class that resembles (Jaccard of `ALIKE` or more) a hub with more members than itself has, the one of them
    that has the most; the sizes and the size of the difference."""
    like = checked.where(f"o >= {ALIKE} * (n + m - o)")
    members = like.groupBy(F.col("b").alias("h")).agg(F.count("*").alias("k"))
    own = members.select(F.col("h").alias("a"), F.col("k").alias("own"))
    ranked = like.join(members.withColumnRenamed("h", "b"), "b").join(own, "a", "left").where(F.struct("k", "b") > F.struct(F.coalesce("own", F.lit(0).cast("long")).alias("k"), F.col("a").alias("b")))
    best = ranked.groupBy("a").agg(F.max(F.struct("k", "o", "b", "n", "m")).alias("r"))
    return best.select(F.col("a").alias("x"), F.col("r.b").alias("g"), "r.n", "r.m", F.expr("r.n + r.m - 2 * r.o").alias("d"))


def _same_reference(members: DataFrame, texts: DataFrame, reps: DataFrame, width: int, threshold: int) -> DataFrame:
    """Pairs (a, b) of members (x, g, n, m, d, root) of one group and different roots that can link, by their differences."""
    less, more = 100 - threshold, 100 + threshold
    diffs = stash(_differences(members.select(F.col("x").alias("a"), F.col("g").alias("b")), texts, reps, width))
    flat = diffs.select(F.col("b").alias("g"), F.col("a").alias("x"), F.explode("diff").alias("e"))
    shared = flat.groupBy("g", "e").agg(F.count("*").alias("k")).where("k > 1")
    ordered = flat.join(shared, ["g", "e"]).groupBy("x").agg(F.sort_array(F.collect_list(F.struct("k", "e"))).alias("s"))
    # elements of one set alone come first in its order, so the others' places start after them
    placed = members.join(ordered, "x").select("g", "x", "n", "d", "root", F.floor(F.greatest(F.lit(1), F.col("m") * less / (2 * more))).alias("w"), (F.col("d") - F.size("s")).alias("before"), F.posexplode("s").alias("p", "s"))
    spread = F.col("n") + F.floor(100 * F.col("n") / threshold)  # the two sizes' sum at most
    entries = stash(placed.select("g", "x", "n", "d", "root", "w", F.col("s.e").alias("e"), (F.col("before") + F.col("p")).alias("i")).where(more * F.col("i") <= less * spread))
    block = F.explode(F.sequence(F.floor(F.col("d") / F.col("w")), F.floor((F.col("d") + less * spread / more) / F.col("w")))).alias("k")
    small = entries.select("*", block).where(2 * more * F.col("i") <= more * (F.col("d") - F.greatest("d", F.col("k") * F.col("w"))) + less * spread)
    large = entries.select("g", "e", F.floor(F.col("d") / F.col("w")).alias("k"), F.col("x").alias("y"), F.col("n").alias("m"), F.col("d").alias("f"), F.col("i").alias("j"), F.col("root").alias("other"))
    both = small.join(large, ["g", "e", "k"]).where(
        f"(d < f or d = f and x < y) and root <> other and 2 * {more} * i <= {more} * (d - f) + {less} * (n + m) and 2 * {more} * j <= {more} * (f - d) + {less} * (n + m) and 100 * least(n, m) >= {threshold} * greatest(n, m)"
    )
    pairs = both.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.count("*").alias("o"), F.max("i").alias("i"), F.max("j").alias("j"), *(F.first(c).alias(c) for c in ("n", "m", "d", "f")))
    return pairs.where(f"2 * {more} * (o + least(d - i, f - j) - 1) >= {more} * (d + f) - {less} * (n + m)").select("a", "b")


def _other_references(placed: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of different groups and roots that can link, by the blocks of their prefixes. placed: e, c, n, i, g, root."""
    less, more = 100 - threshold, 100 + threshold
    fine = 2 / math.log(100 / threshold)  # two blocks to a step of sizes that can link
    number = lambda n: F.floor(F.log(n.cast("double")) * fine)
    blocks = F.explode(F.sequence(number(F.col("n")), number(F.floor(100 * F.col("n") / threshold)))).alias("k")
    # the least size of the block, less one for rounding
    least = F.greatest(F.col("n"), F.floor(F.exp(F.col("k") / fine)) - 1)
    small = placed.select("e", "c", "n", "i", "g", "root", blocks).where(more * F.col("i") <= more * F.col("n") - threshold * (F.col("n") + least))
    large = placed.select("e", F.col("c").alias("y"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("g").alias("h"), F.col("root").alias("other"), number(F.col("n")).alias("k"))
    # what all of a block's members of one group have in common decides whether an entry can meet any of them
    heads = large.groupBy("e", "k", "h").agg(F.min("m").alias("m0"), F.max("m").alias("m1"), F.min(F.col("j") - F.col("m")).alias("j0"), F.min("other").alias("r0"), F.max("other").alias("r1"))
    groups = small.select("e", "k", "g").distinct().join(heads.hint("merge"), ["e", "k"]).where("g <> h")
    sent = small.join(groups.hint("merge"), ["e", "k", "g"]).where(f"n <= m1 and not (root = r0 and root = r1) and {more} * greatest(i - n, j0) <= -{threshold} * (n + greatest(n, m0))")
    both = sent.select("e", "k", "h", "c", "n", "i", "root").join(large.hint("merge"), ["e", "k", "h"]).where(
        f"(n < m or n = m and c < y) and root <> other and {more} * greatest(i - n, j - m) <= -{threshold} * (n + m)"
    )
    pairs = both.groupBy(F.col("c").alias("a"), F.col("y").alias("b")).agg(F.count("*").alias("o"), F.max("i").alias("i"), F.max("j").alias("j"), F.first("n").alias("n"), F.first("m").alias("m"))
    return pairs.where(f"{more} * (o + least(n - i, m - j) - 1) >= {threshold} * (n + m)").select("a", "b")


def classes(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD, bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, _d, _k, _n (elements), _root (the component's least class, null for the empty set) for each row of docs."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(F.col("text").alias("_t"), *row_key())
    names = ["doc_id", "_d", "_k", "_c", "_n", "_s", "_b", "_p", "_t"]

    def key(batches):
        """A row for each document, then the task's counters."""
        table, schema = np.zeros(1 << bits, np.int64), None
        for b in batches:
            data, off = buffers(b.column(0))
            schema = b.schema
            for i, j in slices(off):
                h, cut = sets(data, off[i : j + 1], width)
                _count(table, h, bits)
                none = [pa.nulls(j - i, t) for t in (pa.int32(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*(c[i:j] for c in b.columns[1:]), _signed(_class(h, cut)), pa.array(np.diff(cut)), _marks(h, cut), *none], names)
        task = TaskContext.get().partitionId()
        for k in range(0, 1 << bits, _BLOCK):
            if table[k : k + _BLOCK].any():
                none = [pa.nulls(1, t) for t in (schema.field(1).type, *[pa.int64()] * 4, pa.binary())]
                yield pa.RecordBatch.from_arrays([*none, pa.array([k // _BLOCK], pa.int32()), pa.array([task], pa.int64()), pa.array([table[k : k + _BLOCK].tobytes()], pa.binary())], names)

    both = stash(docs.select(F.col("text").alias("_t"), "doc_id", *row_key()).mapInArrow(key, f"doc_id {kind}, _d long, _k long, _c long, _n long, _s binary, _b int, _p long, _t binary"))
    keyed = both.where("_b is null").select("doc_id", "_d", "_k", "_c", "_n", "_s")
    once = stash(keyed.where("_n > 0").groupBy("_c").agg(F.min(F.struct("_d", "_k")).alias("r"), F.first("_n").alias("_n"), F.first("_s").alias("_s")).select("_c", "r._d", "r._k", "_n", "_s"))
    reps, keyed = once.select("_c", "_d", "_k"), keyed.drop("_s")
    counters = _frequency_classes(both.where("_b is not null").select("_b", "_p", "_t"), bits)
    first = spark.sparkContext.broadcast(Order(counters, bits, np.zeros(0, U64), np.zeros(0, np.int64)))

    def elements(batches):
        for h, *_ in _prefix(batches, first.value, width, threshold):
            yield pa.RecordBatch.from_arrays([_signed(h)], ["e"])

    # what the counters don't tell apart is counted exactly where it matters, in the prefixes; then the prefixes are taken anew
    often = texts.select("_t").mapInArrow(elements, "e long").groupBy("e").agg(F.count("*").alias("k")).where(F.col("k") > SEVERAL).orderBy(F.desc("k"), "e").limit(LISTED).toArrow()
    second = spark.sparkContext.broadcast(Order(counters, bits, often.column("e").to_numpy().view(U64), often.column("k").to_numpy()))

    def entries(batches):
        for h, c, n, i in _prefix(batches, second.value, width, threshold):
            yield pa.RecordBatch.from_arrays([_signed(h), _signed(c), pa.array(n.astype(np.int32)), pa.array(i.astype(np.int32))], ["e", "c", "n", "i"])

    every = stash(texts.select("_t").mapInArrow(entries, "e long, c long, n int, i int"))
    common = every.groupBy("e").agg(F.count("*").alias("k")).where("k > 1").select("e")
    index = stash(every.join(common, "e", "left_semi").groupBy("e", "c", "n", "i").agg(F.lit(1).alias("one")).drop("one"))

    hubs = index.groupBy("e").agg(F.min(F.struct("i", "n", "c")).alias("h"), F.count("*").alias("k")).where("k > 1")
    hubs = hubs.select("e", F.col("h.i").alias("j"), F.col("h.n").alias("m"), F.col("h.c").alias("b"))
    star = index.withColumnRenamed("c", "a").join(hubs, "e").where(f"a <> b and 100 * least(n, m) >= {threshold} * greatest(n, m)")
    star = star.groupBy("a", "b").agg(F.count("*").alias("o"), F.first("n").alias("n"), F.first("m").alias("m")).where("o >= 1 + least(n, m) / 50")
    checked = stash(_overlaps(stash(star.select("a", "b")), texts, reps, width))
    link = f"100 * o >= {threshold} * (n + m - o)"
    links = checked.where(link).select("a", "b")
    label = stash(components(links))
    root = lambda df, c: df.join(label.select(F.col("node").alias(c), "root"), c, "left").withColumn("root", F.coalesce("root", c))
    members = stash(root(_references(checked), "x"))
    # groups that have more than one component, the reference's own among them
    heads = root(members.select("g").distinct().withColumn("x", F.col("g")), "x").select("g", "root")
    split = members.select("g", "root").union(heads).groupBy("g").agg(F.min("root").alias("u"), F.max("root").alias("v")).where("u < v").select("g")
    # the two kinds of pairs are written one after the other: planned together, their stages and broadcasts fill the driver
    near = stash(_same_reference(stash(members.join(split, "g", "left_semi")), texts, reps, width, threshold))
    placed = root(index.join(members.select(F.col("x").alias("c"), "g"), "c", "left").withColumn("g", F.coalesce("g", "c")), "c")
    open_ = placed.groupBy("e").agg(*(f(c).alias(f"{c}{k}") for c in ("g", "root") for k, f in enumerate((F.min, F.max)))).where("g0 < g1 and root0 < root1").select("e")
    far = stash(_other_references(stash(placed.join(open_, "e", "left_semi")), threshold))
    more = _overlaps(stash(_close(near.union(far), once, threshold)), texts, reps, width).where(link).select("a", "b")
    # the texts of one doc_id
    known = keyed.where("_n > 0 and doc_id is not null").select("doc_id", "_c")
    several = known.groupBy("doc_id").agg(F.min("_c").alias("b"), F.max("_c").alias("v")).where("b < v")
    label = components(stash(links.union(more).union(known.join(several, "doc_id").select(F.col("_c").alias("a"), "b"))))
    named = keyed.join(label.withColumnRenamed("node", "_c"), "_c", "left").withColumn("_root", F.coalesce("root", "_c"))
    return stash(named.select("doc_id", "_d", "_k", "_n", F.when(F.col("_n") > 0, F.col("_root")).alias("_root")))


def link_components(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD, bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    named = classes(docs, width, threshold, bits)
    least_id = named.where("_root is not null").groupBy("_root").agg(F.min("doc_id").alias("_least"))
    return named.join(least_id, "_root", "left").select("doc_id", F.col("_n").alias("n_shingles"), F.when(F.col("_n") > 0, F.col("_least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """docs with one row of each component (five words, 0.8 or more): the one with the least doc_id, nulls last, then the least
    hash of its text; of rows alike in doc_id and text one. Rows with the empty set all stay."""
    named = classes(docs, width, threshold)
    own = named.where("_root is not null").groupBy("_root", "_d", "_k").agg(F.min(F.struct(F.col("doc_id").isNull(), "_d", "_k")).alias("r"), F.count("*").alias("n"))
    best = own.groupBy("_root").agg(F.min("r").alias("r"))
    ranked = stash(own.join(best.withColumnRenamed("r", "s"), "_root").select("_d", "_k", (F.col("r") == F.col("s")).alias("stays"), "n").where("not stays or n > 1"))
    left = marked(docs).join(checked_broadcast(ranked.select("_d", "_k")), ["_d", "_k"], "left_anti")
    if not (twice := ranked.where("stays").select("_d", "_k")).isEmpty():
        left = left.union(marked(docs).join(twice, ["_d", "_k"]).select(left.columns).dropDuplicates(["_d", "_k"]))
    return unmarked(left, docs)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(spark_tables(spark, sf_dir, "documents"))


QUERIES = {"op9_jaccard_join": op9_jaccard_join}
ORACLES = {
    "op9_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT x, y FROM c JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE 100 * o >= 85 * (p.n + q.n - o)),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) m ON m.x = d.doc_id"""
}

"""Mixing sources to target weights.

The words of each source, its documents in order, are packed into blocks of `BLOCK` words. The mix consists of output
shards of `SHARD` block slots; each shard draws its counts by source from a multinomial distribution (seeded by shard,
the whole part of the expected counts taken as it is), and what the draws left over of the quotas is packed into last shards, so that
each source gets its quota of blocks. The draw goes down a tree of sources, `FAN` children a node: a node's slots are
dealt to its children by their quotas, so a shard costs its slots and one node's children each, however many sources
there are. Slot i of a source is mapped to block `perm(i mod n)`, with a pseudorandom
permutation of the source's n block numbers for each pass `i div n`; slots and blocks are then joined by index. A
block is thus used once in each pass, and never more than three times.

Targets: sources in code point order, null last, weigh 1, 2, 3, repeating, and share the total of all words by
weight; a target stops at three times its source's words, and the excess is shared anew by weight.

Where a document stands in its source comes from sums over chunks of doc_id and within each chunk, so a source that
holds a third of all rows is spread over many tasks; so do the sums over shards. The join is by (source, block). The
table of sources stays in Spark: it is sent to all tasks if its bytes are counted to be `BROADCAST_BYTES` at most, and
joined by source and a salt otherwise.

Defined cases: a null or empty text has size 0 and nothing taken; a null source is a source; rows equal in doc_id,
source and text share what their words get (the first of them one more where it does not divide); sources without
words get target 0; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillstack.llm.text import U64, buffers, mix, row_key, spark_tables, stash, word_table

BLOCK = 128
SHARD = 4096
SEED = 20240117
FAN = 256
CHUNK = 256
BROADCAST_BYTES = 16 << 20
SALTS = 32
_SPACE = word_table("space")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, _d, _k, size: the words of each row."""

    def run(batches):
        for b in batches:
            data, off = buffers(b.column(0))
            n = np.zeros(len(off) - 1, np.int64)
            step = max(1, len(off) // 16)
            for i in range(0, len(off) - 1, step):
                o = off[i : min(i + step, len(off) - 1) + 1]
                own, cut = _SPACE[data[o[0] : o[-1]]], o - o[0]
                head = own.copy()
                head[1:] &= ~own[:-1]
                at = cut[:-1][cut[:-1] < cut[1:]]
                head[at] = own[at]
                c = np.concatenate(([0], np.cumsum(head)))
                n[i : i + len(o) - 1] = c[cut[1:]] - c[cut[:-1]]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n)], ["doc_id", "source", "_d", "_k", "size"])

    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", "source")}
    return docs.select(F.col("text").alias("_t"), "doc_id", "source", *row_key()).mapInArrow(run, f"doc_id {kinds['doc_id']}, source {kinds['source']}, _d long, _k long, size long")


def _numbered(names: DataFrame) -> DataFrame:
    """Rows with _s, their number in the order of source, null last: counted in each range of the order, then over the ranges."""
    put = stash(names.orderBy(F.asc_nulls_last("source")).withColumn("_i", F.monotonically_increasing_id()))
    ranges = put.groupBy(F.shiftright("_i", 33).alias("_range")).agg(F.count("*").alias("_rows"))  # a row for each shuffle partition
    ranges = ranges.select("_range", (F.sum("_rows").over(Window.orderBy("_range")) - F.col("_rows")).alias("_before"))
    return put.withColumn("_range", F.shiftright("_i", 33)).join(F.broadcast(ranges), "_range").withColumn("_s", F.col("_before") + F.col("_i").bitwiseAND((1 << 33) - 1)).drop("_range", "_before", "_i")


def _level(weighed: DataFrame) -> float:
    """The target of weight 1: raised until the sources that stop at three times their size are the same as before."""
    level, stopped = 0.0, -1
    while True:
        stops = 3 * F.col("source_size") < F.lit(level) * F.col("_w")
        a = weighed.agg(F.sum("source_size"), F.sum(F.when(stops, 3 * F.col("source_size")).otherwise(0)), F.sum(F.when(stops, 0).otherwise(F.col("_w"))), F.count(F.when(stops, 1))).first()
        if not a[0] or a[3] == stopped:
            return level
        level, stopped = (a[0] - a[1]) / a[2], a[3]


def targets(sized: DataFrame, block: int = BLOCK) -> DataFrame:
    """source, _s (its number in code point order), source_size, target, _n (blocks), _q (quota of blocks)."""
    s = stash(_numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumn("_w", F.col("_s") % 3 + 1))
    s = s.withColumn("target", F.least(3.0 * F.col("source_size"), F.lit(_level(s)) * F.col("_w")))
    s = s.withColumn("_n", F.ceil(F.col("source_size") / block))
    quota = F.when(F.col("source_size") > 0, F.least(3 * F.col("_n"), F.round(F.col("target") * F.col("_n") / F.col("source_size")).cast("long"))).otherwise(0)
    return s.select("source", "_s", "source_size", "target", "_n", quota.cast("long").alias("_q"))


def permute(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n - 1 for each key: a Feistel network over the next power of four, walked until within n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) >> 1).astype(U64)
    mask = (U64(1) << half) - U64(1)
    x = i.astype(U64)
    out, left = np.zeros(len(i), np.int64), np.arange(len(i))
    while len(left):
        h, m, k = half[left], mask[left], key[left]
        a, b = x[left] >> h, x[left] & m
        for r in range(4):
            a, b = b, a ^ (mix(b ^ k, r) & m)
        y = (a << h) | b
        x[left] = y
        done = y < n[left].astype(U64)
        out[left[done]] = y[done].astype(np.int64)
        left = left[~done]
    return out


def _draw(level: int, seed: int):
    """Rows (_shard, _s, _c, _kids) -> each child's part of the node's slots, in mapInArrow."""

    def run(batches):
        for b in batches:
            j, node, c = (b.column(k).to_numpy() for k in range(3))
            off = np.concatenate(([0], np.cumsum(b.column(3).value_lengths().to_numpy())))
            kid, q, n = (x.to_numpy() for x in b.column(3).flatten().flatten())
            at, got = [], []
            for a in range(len(j)):
                quota = q[off[a] : off[a + 1]]
                mine, part = np.divmod(c[a] * quota, quota.sum())
                left = int(c[a] - mine.sum())
                if left:
                    mine = mine + np.random.default_rng([seed, level, int(node[a]), int(j[a])]).multinomial(left, part / part.sum())
                some = np.flatnonzero(mine)
                at.append(some + off[a])
                got.append(mine[some])
            if at:
                shard = np.repeat(j, [len(x) for x in at])
                at = np.concatenate(at)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(kid[at]), pa.array(np.concatenate(got)), pa.array(q[at]), pa.array(n[at])], ["_shard", "_s", "_c", "_q", "_n"])

    return run


def slots(sources: DataFrame, shard: int = SHARD, seed: int = SEED, fan: int = FAN) -> DataFrame:
    """_shard, _s, _i (the source's slot), _b (block): the drawn mix. sources: _s, _n (blocks), _q (quota)."""
    spark = sources.sparkSession
    some = sources.where("_q > 0").select("_s", "_n", "_q")
    total, last = (x or 0 for x in some.agg(F.sum("_q"), F.max("_s")).first())
    shards, depth = max(1, -(-total // shard)), 1
    while fan**depth <= last:
        depth += 1
    drawn = spark.range(shards - 1).select(F.col("id").alias("_shard"), F.lit(0).cast("long").alias("_s"), F.lit(shard).cast("long").alias("_c"))
    for level in reversed(range(depth)):
        kids = some.groupBy(F.floor(F.col("_s") / fan**level).alias("kid")).agg(F.sum("_q").alias("q"), F.sum("_n").alias("n"))
        kids = kids.groupBy(F.floor(F.col("kid") / fan).alias("_s")).agg(F.sort_array(F.collect_list(F.struct("kid", "q", "n"))).alias("_kids"))
        kids = F.broadcast(kids) if level == depth - 1 else kids.hint("merge")  # the root: one row of `fan` children at most
        drawn = drawn.join(kids, "_s").select("_shard", "_s", "_c", "_kids").mapInArrow(_draw(level, seed), "_shard long, _s long, _c long, _q long, _n long")
    drawn = stash(drawn.withColumn("_chunk", F.floor(F.col("_shard") / CHUNK)))
    chunks = drawn.groupBy("_s", "_chunk").agg(F.sum("_c").alias("_sum"))
    start = F.sum("_sum").over(Window.partitionBy("_s").orderBy("_chunk")) - F.col("_sum")
    within = F.sum("_c").over(Window.partitionBy("_s", "_chunk").orderBy("_shard")) - F.col("_c")
    at = drawn.withColumn("_within", within).join(chunks.select("_s", "_chunk", start.alias("_start")).hint("merge"), ["_s", "_chunk"]).withColumn("_from", F.col("_start") + F.col("_within"))
    open_ = F.greatest(F.col("_q") - F.col("_from"), F.lit(0))
    counts = at.select("_shard", "_s", "_n", "_from", F.least("_c", open_).alias("_c"))
    used = some.join(drawn.groupBy("_s").agg(F.sum("_c").alias("_used")), "_s", "left").withColumn("_from", F.coalesce("_used", F.lit(0)))
    rest = stash(used.select("_s", "_n", "_from", open_.alias("_c")).where("_c > 0").withColumn("_chunk", F.floor(F.col("_s") / CHUNK)))
    chunks = rest.groupBy("_chunk").agg(F.sum("_c").alias("_sum"))
    start = F.sum("_sum").over(Window.orderBy("_chunk")) - F.col("_sum")
    within = F.sum("_c").over(Window.partitionBy("_chunk").orderBy("_s")) - F.col("_c")
    rest = rest.withColumn("_within", within).join(chunks.select("_chunk", start.alias("_start")).hint("merge"), "_chunk").withColumn("_at", F.col("_start") + F.col("_within")).withColumn("_end", F.col("_at") + F.col("_c"))
    rest = rest.withColumn("_last", F.explode(F.sequence(F.floor(F.col("_at") / shard), F.floor((F.col("_end") - 1) / shard))))
    lo, hi = F.greatest("_at", F.col("_last") * shard), F.least("_end", (F.col("_last") + 1) * shard)
    counts = counts.union(rest.select(F.col("_last") + (shards - 1), "_s", "_n", F.col("_from") + lo - F.col("_at"), hi - lo))

    def place(batches):
        for b in batches:
            j, who, n, first, c = (b.column(k).to_numpy() for k in range(5))
            for a in range(len(j)):
                for lo in range(0, int(c[a]), 1 << 18):
                    i = first[a] + np.arange(lo, min(lo + (1 << 18), int(c[a])))
                    blocks = np.full(len(i), n[a])
                    key = mix((i // blocks).astype(U64) + mix(np.full(len(i), who[a]).astype(U64), seed % 97), 1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), j[a])), pa.array(np.full(len(i), who[a])), pa.array(i), pa.array(permute(i % blocks, blocks, key))], ["_shard", "_s", "_i", "_b"])

    return counts.where("_c > 0").repartition(1 + shards // 16, "_shard", "_s").mapInArrow(place, "_shard long, _s long, _i long, _b long")


def with_sources(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """The sized rows with _s, source_size and target of their source."""
    names = sources.select(F.col("source").alias("_source"), "_s", "source_size", "target")
    wide = sources.agg(F.sum(F.coalesce(F.octet_length(F.col("source").cast("string")), F.lit(0)) + 64)).first()[0] or 0
    same = F.col("source").eqNullSafe(F.col("_source"))
    if wide <= BROADCAST_BYTES:
        return sized.join(F.broadcast(names), same).drop("_source")
    salted = names.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return sized.join(salted, same & (F.pmod("_k", F.lit(SALTS)) == F.col("_salt"))).drop("_source", "_salt")


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """_s, _b, _d, _k, first_word, n_words: which words of which documents each block holds. Rows alike count as one of their total length."""
    one = rows.where("size > 0").groupBy("_s", "_d", "_k").agg(F.sum("size").alias("size")).withColumn("_chunk", F.floor(F.col("_d") / CHUNK))
    chunks = one.groupBy("_s", "_chunk").agg(F.sum("size").alias("_sum"))
    start = F.sum("_sum").over(Window.partitionBy("_s").orderBy("_chunk")) - F.col("_sum")
    within = F.sum("size").over(Window.partitionBy("_s", "_chunk").orderBy("_d", "_k")) - F.col("size")
    at = one.join(chunks.select("_s", "_chunk", start.alias("_start")).hint("merge"), ["_s", "_chunk"]).withColumn("_from", F.col("_start") + within).withColumn("_to", F.col("_from") + F.col("size"))
    parts = at.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_to") - 1) / block))))
    lo, hi = F.greatest("_from", F.col("_b") * block), F.least("_to", (F.col("_b") + 1) * block)
    return parts.select("_s", "_b", "_d", "_k", (lo - F.col("_from")).alias("first_word"), (hi - lo).alias("n_words"))


def mix_blocks(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mix (shard, slot, block, document piece), and the sized rows with their sources' numbers, sizes and targets."""
    sized = stash(sizes(docs))
    sources = stash(targets(sized, block))
    rows = with_sources(sized, sources)
    return slots(sources, shard, seed).join(pieces(rows, block).hint("merge"), ["_s", "_b"]), rows


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: what the mix takes of each row."""
    mixed, rows = mix_blocks(docs)
    got = mixed.groupBy("_s", "_d", "_k").agg(F.sum("n_words").alias("_taken"))
    rows = rows.groupBy("doc_id", "_s", "_d", "_k", "size", "source_size", "target").agg(F.count("*").alias("_m")).join(got, ["_s", "_d", "_k"], "left")
    share = F.coalesce("_taken", F.lit(0))
    each = rows.withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m"))))
    return each.select("doc_id", "size", "source_size", "target", (F.floor(share / F.col("_m")) + F.when(F.col("_c") <= share % F.col("_m"), 1).otherwise(0)).cast("long").alias("taken"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(spark_tables(spark, sf_dir, "documents"))


QUERIES = {"op6_mixing": op6_mixing}
ORACLES: dict[str, str] = {}

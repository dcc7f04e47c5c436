"""Vectorised text helpers that run inside Spark tasks, and small Spark helpers the operators share.

Texts are handled as the UTF-8 bytes of an Arrow column, without making Python strings: a batch of documents is
one byte array with offsets, and words are found, lower-cased and hashed for the whole batch at once. Batches
are cut into slices of a few megabytes (never inside a document), so memory stays bounded.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
U64 = np.uint64


def word_table(kind: str) -> np.ndarray:
    """256 booleans: the bytes that belong to a word. `space`: anything but ASCII white space; `alnum`: ASCII
    letters (A-Z too: they are lower-cased first) and digits, and every byte of a non-ASCII character."""
    t = np.ones(256, bool)
    if kind == "space":
        t[[0x20, *range(0x09, 0x0E)]] = False
    else:
        t[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
    return t


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over an array."""
    x = x + U64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_weights = mix(np.arange(256, dtype=U64), 7) | U64(1)


def weights(n: int) -> np.ndarray:
    global _weights
    if n > len(_weights):
        _weights = mix(np.arange(max(n, 2 * len(_weights)), dtype=U64), 7) | U64(1)
    return _weights


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = col.buffers()[2]
    return np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8), off


def slices(off: np.ndarray, most: int = SLICE_BYTES):
    """(first, last) document ranges of at most `most` bytes, one document at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of a slice of documents: hash, start and end byte (within the slice), document number."""

    __slots__ = ("doc", "end", "first", "hash", "n_docs", "start")

    def __init__(self, data: np.ndarray, off: np.ndarray, table: np.ndarray, lower: bool = True):
        base, off = off[0], off - off[0]
        data = data[base : base + off[-1]]
        self.n_docs = len(off) - 1
        m = table[data]
        st = m.copy()
        st[1:] &= ~m[:-1]
        heads = off[:-1][off[:-1] < off[1:]]
        st[heads] = m[heads]
        self.start = np.flatnonzero(st)
        last = m.copy()
        last[:-1] &= ~m[1:]
        tails = heads[1:] - 1
        last[tails] |= m[tails]
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, off).astype(np.int64)  # of each document's words, and the end
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))
        size = self.end - self.start
        if len(size):
            body = data[m]
            if lower:
                body = LOWER[body]
            at = np.concatenate(([0], np.cumsum(size)[:-1]))
            inner = np.arange(len(body)) - np.repeat(at, size)
            self.hash = mix(np.add.reduceat((body.astype(U64) + U64(1)) * weights(int(size.max()))[inner], at) + size.astype(U64))
        else:
            self.hash = np.zeros(0, U64)

    def __len__(self) -> int:
        return len(self.hash)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive hashes; document ends are the caller's matter."""
    if len(h) < n:
        return np.zeros(0, U64)
    k = weights(n)
    out = np.zeros(len(h) - n + 1, U64)
    for j in range(n):
        out += h[j : len(h) - n + 1 + j] * k[j]
    return mix(out, n)


def spark_tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. Only where none is named and all runs in one process (tests), one of our own is set."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = spark.conf.get("spark.rillstack.checkpoint", None)
        if not where:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            where = "file://" + tempfile.mkdtemp(prefix="spark-rillstack-")
            spark.conf.set("spark.rillstack.checkpoint", where)
    return where.rstrip("/")


def stash(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write the rows as Parquet (codec: how it is zipped) into the shared folder and read them back: cuts the lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/rillstack-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of 8-byte ids up to which a set of ids is broadcast (tens of MB at most); beyond it the join shuffles.
BROADCAST_IDS = 2_000_000


def checked_broadcast(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """The (narrow, stashed) ids, marked for broadcast if a count shows that they are few; otherwise as they are."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def row_key(doc_id: str = "doc_id", text: str = "text") -> list:
    """Two columns that tell rows apart even if a doc_id is null or repeated: `_d` (null: the smallest long) and `_k`.
    Rows alike in both are the same document twice and get the same result."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("_d"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_k")]


def marked(docs: DataFrame) -> DataFrame:
    """_d, _k and the columns of docs by their places (_c0, _c1, ..), so that no name of theirs clashes."""
    return docs.select(*row_key(), *(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)))


def unmarked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of marked rows under their own names again."""
    return rows.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)))

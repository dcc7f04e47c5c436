"""Suffix-array dedup: exact repeated strings of `length` bytes, found in column-wise Burrows-Wheeler transforms.

A byte is removed if a string of `length` bytes that covers it also starts earlier (smaller doc_id, or the same document,
earlier start). The corpus is first reduced to what can repeat: each window of `length` bytes selects its leftmost
smallest 16-gram hash as anchor, so equal windows have equal anchors at equal places, and the windows of one anchor
place are one segment (under 2 * length bytes). Segments whose anchor's hash occurs once hold no repeated window.
Segments are grouped by content (anchor and a hash, with their first place), and the contents of one anchor
that has several go on.

They are dealt out by anchor; a task takes them some ten thousand at a time, lays them out so that their anchors share a
column, and goes through the columns from right to left. Each round inserts one more symbol of every
segment: the suffixes are put in order by the symbols and their former order, which is the transform's step, and
the common prefixes become one more than the least between former neighbours of one symbol. Suffixes of one column only
need each other, as equal windows have their anchor in one column, so a round costs the number of segments.
Windows whose common prefix is `length` or more are equal; the first place of each stays. The runs that feed
the rounds are Spark's own external shuffle files, and there are at most 2 * length rounds, however long a document is.

An anchor with `HOT` contents or more is taken window by window instead: its distinct windows are grouped
by their whole content, partially before the shuffle, so that no anchor makes a large group. Both ways are exact.

Defined cases: a null or empty text has no bytes (and its hash is that of nothing); rows equal in doc_id and text are one
place and get the same result; a null doc_id comes first; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstack.llm.text import U64, buffers, mix, row_key, slices, spark_tables

LENGTH, GRAM = 100, 16
#: Contents of one anchor from which it is taken window by window.
HOT = 20_000
#: Segments that a task's transform takes at once, about.
TOGETHER = 20_000
_P = 0x9E3779B97F4A7C15
_END = 0xFF  # in no UTF-8 text
_R = 0xD1342543DE82EF95
#: Anchor hashes have 48 bits: a chance meeting costs time only, the contents decide.
_SHORT = U64(16)


def _grams(b: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    h, n = b.astype(U64) + U64(1), 1
    while n < GRAM:
        h, n = h[:-n] * U64(pow(_P, n, 1 << 64)) + h[n:], 2 * n
    return h


def segments(data: np.ndarray, off: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Of each segment of a slice: anchor hash, document, and packed: first window's start in the document (from bit
    16), the anchor's distance from it (8 bits), number of windows (8 bits)."""
    own, cut = data[off[0] : off[-1]], off - off[0]
    nothing = (np.zeros(0, np.int64),) * 3
    if len(own) < length:
        return nothing
    g = mix(_grams(own), 1)
    bits = U64(max(1, int(len(g)).bit_length()))
    key = ((g >> bits) << bits) | np.arange(len(g), dtype=U64)
    many, have = length - GRAM + 1, 1
    while 2 * have <= many:
        key, have = np.minimum(key[:-have], key[have:]), 2 * have
    if have < many:
        key = np.minimum(key[: len(key) - (many - have)], key[many - have :])
    anchor = (key & ((U64(1) << bits) - U64(1))).astype(np.int64)
    start = np.arange(len(anchor))
    room = np.repeat(cut[1:], np.diff(cut))[: len(anchor)]  # end of the window's document
    ok = start + length <= room
    start, anchor = start[ok], anchor[ok]
    if not len(start):
        return nothing
    head = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1))))
    n = np.diff(np.append(head, len(start)))
    first, anchor = start[head], anchor[head]
    doc = np.searchsorted(cut, first, "right") - 1
    return (mix(g[anchor], 2) >> _SHORT).view(np.int64), doc, ((first - cut[doc]) << 16) | ((anchor - first) << 8) | n


def _unpack(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return p >> 16, (p >> 8) & 255, p & 255


def transform(text: np.ndarray, cut: np.ndarray, lead: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(class, window) of every window: windows are numbered by segment and start, equal ones have one class.

    text, cut: the segments' bytes and offsets; lead: each anchor's distance from its segment's start."""
    size = np.diff(cut)
    n, windows = len(size), size - length + 1
    number = np.cumsum(windows) - windows
    left, right = int(lead.max()), int((size - lead).max())
    table = np.full((left + right, n), _END, np.uint8)  # a row for each column of the layout
    who = np.repeat(np.arange(n), size)
    table[left - lead[who] + np.arange(len(text)) - cut[:-1][who], who] = text[cut[0] : cut[-1]]
    order, lcp = np.arange(n), np.zeros(n, np.uint8)
    klass, ident, base = [], [], 0
    for x in range(left + right - 1, -1, -1):
        symbol = table[x][order]
        step = np.argsort(symbol, kind="stable")
        symbol = symbol[step]
        low = np.minimum.reduceat(np.append(lcp, np.uint8(0)), step + 1)[:-1]
        order, lcp = order[step], np.zeros(n, np.uint8)
        lcp[1:] = np.where(symbol[1:] == symbol[:-1], np.minimum(low, length - 1) + 1, 0)
        at = x - left + lead[order]  # the column's place in each segment
        own = np.flatnonzero((at >= 0) & (at < windows[order]))
        if len(own):
            klass.append(base + np.cumsum(lcp < length)[own])
            ident.append(number[order[own]] + at[own])
            base += n + 1
    return np.concatenate(klass), np.concatenate(ident)


def _runs(marked: np.ndarray, d: np.ndarray, k: np.ndarray, s: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Runs (_d, _k, s, n) of the marked windows, of segments with n windows from s on."""
    owner = np.repeat(np.arange(len(n)), n)
    start = s[owner] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    owner, start = owner[marked], start[marked]
    head = np.flatnonzero(np.concatenate((np.ones(min(1, len(owner)), bool), (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1))))
    return pa.RecordBatch.from_arrays([pa.array(d[owner[head]]), pa.array(k[owner[head]]), pa.array(start[head]), pa.array(np.diff(np.append(head, len(owner))))], ["_d", "_k", "s", "n"])


def _repeated(batches, length: int):
    """Rows (h, seg, _d, _k, p) in order of h -> runs of the windows whose content also is at a place before."""

    def work(table: pa.Table):
        d, k, p = (table.column(c).to_numpy() for c in ("_d", "_k", "p"))
        s, lead, n = _unpack(p)
        data, off = buffers(table.column("seg"))
        klass, w = transform(data[off[0] : off[-1]], off - off[0], lead, length)
        owner = np.repeat(np.arange(len(n)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        o = np.lexsort((s[owner[w]] + inner[w], k[owner[w]], d[owner[w]], klass))
        again = np.zeros(len(owner), bool)
        again[w[o[1:][klass[o][1:] == klass[o][:-1]]]] = True
        return _runs(again, d, k, s, n)

    held: list[pa.Table] = []
    rows = 0
    for b in batches:
        while b.num_rows:
            h = b.column(0).to_numpy()
            if rows >= TOGETHER:  # up to the end of the anchor that is open
                more = int(np.searchsorted(h, last, "right"))  # noqa: F821
                if more < len(h):
                    held.append(pa.Table.from_batches([b.slice(0, more)]))
                    yield work(pa.concat_tables(held).combine_chunks())
                    held, rows, b = [], 0, b.slice(more)
                    continue
                held.append(pa.Table.from_batches([b]))
                break
            take = min(b.num_rows, TOGETHER - rows)
            held.append(pa.Table.from_batches([b.slice(0, take)]))
            rows, last, b = rows + take, h[take - 1], b.slice(take)
    if held:
        yield work(pa.concat_tables(held).combine_chunks())


def _texts(b: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    unzip = zstandard.ZstdDecompressor()
    texts = [unzip.decompress(x.as_buffer()) for x in b.column(at)]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)


def _listed(b: pa.RecordBatch, at: int, off: np.ndarray):
    """Owner, packed value and absolute start of the listed segments of a batch."""
    owner = np.repeat(np.arange(b.num_rows), b.column(at).value_lengths().fill_null(0).to_numpy())
    p = b.column(at).flatten().to_numpy()
    return owner, p, off[owner] + (p >> 16)


def _content(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each piece of the bytes."""
    if not len(start):
        return np.zeros(0, np.int64)
    lo, hi = int(start.min()), int((start + size).max())
    up, down = np.full(hi - lo, U64(_R)), np.full(hi - lo, U64(pow(_R, -1, 1 << 64)))
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    total = np.concatenate((np.zeros(1, U64), np.add.accumulate((mix(data[lo:hi].astype(U64), 4)) * up)))
    return mix((total[start + size - lo] - total[start - lo]) * down[start - lo] + size.astype(U64), 5).view(np.int64)


def _anchors(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The anchor hashes at given places, as segments() has them."""
    h = np.zeros(len(at), U64)
    for j in range(GRAM):
        h = h * U64(_P) + data[at + j].astype(U64) + U64(1)
    return (mix(mix(h, 1), 2) >> _SHORT).view(np.int64)


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, _z (the text's bytes, zipped), cand: the windows of repeated anchors, packed, and own, runs (kind, s, n) to be
    taken in order of kind: 0: of segments that are the first of their content, and so not repeats; 1: that are
    repeats all the same; 2: windows of these that are not."""
    keyed = docs.select("doc_id", F.col("text").cast("binary").alias("_t"), *row_key())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def hashes(batches):
        for b in batches:
            data, off = buffers(b.column(0))
            for i, j in slices(off, 1 << 19):
                yield pa.RecordBatch.from_arrays([pa.array(segments(data, off[i : j + 1], length)[0])], ["h"])

    def places(batches):
        for b in batches:
            data, off = buffers(b.column(0))
            for i, j in slices(off, 1 << 19):
                h, doc, p = segments(data, off[i : j + 1], length)
                at = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays([pa.array(h), b.column(1).take(at), b.column(2).take(at), pa.array(p)], ["h", "_d", "_k", "p"])

    def pack(batches):
        for b in batches:
            zip_ = zstandard.ZstdCompressor(level=5)
            z = [zip_.compress(x.as_buffer() if x.is_valid else b"") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(z, pa.binary()), b.column(2), b.column(3)], ["doc_id", "_z", "_d", "_k"])

    again = keyed.select("_t").mapInArrow(hashes, "h long").groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h")
    cand = keyed.select("_t", "_d", "_k").mapInArrow(places, "h long, _d long, _k long, p long").join(again, "h", "left_semi")
    lists = cand.groupBy("_d", "_k").agg(F.sort_array(F.collect_set("p")).alias("c"))
    # keys that can't be null keep the joins from filtering their inputs, so equal shuffles stay equal and run once
    sure = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    packed = keyed.select("doc_id", "_t", "_d", "_k").mapInArrow(pack, f"doc_id {kind}, _z binary, _d long, _k long").select("doc_id", "_z", sure("_d"), sure("_k"))
    joined = packed.join(lists, ["_d", "_k"], "left").select("_d", "_k", "_z", "doc_id", "c")

    def contents(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                b = batch.slice(at, 100)
                data, off = _texts(b, 2)
                owner, p, start = _listed(b, 4, off)
                _, lead, n = _unpack(p)
                who = pa.array(owner)
                yield pa.RecordBatch.from_arrays([pa.array(_anchors(data, start + lead)), pa.array(_content(data, start, n + length - 1)), b.column(0).take(who), b.column(1).take(who), pa.array(p)], ["h", "c", "_d", "_k", "p"])

    first = F.min(F.struct("_d", "_k", "p")).alias("f")  # p starts with the place
    # every use of the zipped texts reads the same columns, so that Spark shuffles them once
    distinct = joined.where("c is not null").mapInArrow(contents, "h long, c long, _d long, _k long, p long").select(sure("h"), sure("c"), "_d", "_k", "p").groupBy("h", "c").agg(first).select("h", "f.*")
    kinds = distinct.groupBy("h").agg(F.count("*").alias("v"), F.max(F.xxhash64("_d", "_k", "p")).alias("same")).where("same is not null").select("h", "v")
    few, many = distinct.join(kinds.where(f"v > 1 and v < {HOT}"), "h"), distinct.join(kinds.where(f"v >= {HOT}"), "h")
    listed = lambda rows: rows.groupBy("_d", "_k").agg(F.collect_list(F.struct("p", "h")).alias("m"))

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                b = batch.slice(at, 100)
                data, off = _texts(b, 2)
                owner = np.repeat(np.arange(b.num_rows), b.column(4).value_lengths().to_numpy())
                p, h = (b.column(4).flatten().field(i) for i in range(2))
                start, n = off[owner] + (p.to_numpy() >> 16), p.to_numpy() & 255
                size = n + length - 1
                flat = data[np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
                seg = pa.BinaryArray.from_buffers(pa.binary(), len(p), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
                who = pa.array(owner)
                yield pa.RecordBatch.from_arrays([h, seg, b.column(0).take(who), b.column(1).take(who), p], ["h", "seg", "_d", "_k", "p"])

    pieces = lambda rows: packed.join(listed(rows), ["_d", "_k"]).select("_d", "_k", "_z", "doc_id", "m").mapInArrow(cut, "h long, seg binary, _d long, _k long, p long")
    plain = pieces(few).repartition("h").sortWithinPartitions("h").mapInArrow(lambda batches: _repeated(batches, length), "_d long, _k long, s long, n long")

    def windows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                b = batch.slice(at, 2000)
                data, off = buffers(b.column(0))
                s, _, n = _unpack(b.column(3).to_numpy())
                owner = np.repeat(np.arange(len(n)), n)
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                place = off[:-1][owner] + inner
                flat = np.lib.stride_tricks.sliding_window_view(data, length)[place].tobytes() if len(place) else b""
                w = pa.FixedSizeBinaryArray.from_buffers(pa.binary(length), len(place), [None, pa.py_buffer(flat)]).cast(pa.binary())
                who = pa.array(owner)
                yield pa.RecordBatch.from_arrays([w, b.column(1).take(who), b.column(2).take(who), pa.array(s[owner] + inner)], ["w", "_d", "_k", "_s"])

    hot = pieces(many).select("seg", "_d", "_k", "p").mapInArrow(windows, "w binary, _d long, _k long, _s long").groupBy("w").agg(F.min(F.struct("_d", "_k", "_s")).alias("f"))
    part = lambda rows, kind, start, n: rows.select("_d", "_k", F.struct(F.lit(kind).alias("kind"), start.cast("long").alias("s"), n.cast("long").alias("n")).alias("w"))
    start, n = F.shiftright("p", 16), F.col("p").bitwiseAND(255)
    own = part(distinct, 0, start, n).union(part(plain, 1, F.col("s"), F.col("n"))).union(part(many, 1, start, n)).union(part(hot.select("f.*"), 2, F.col("_s"), F.lit(1)))
    own = own.groupBy("_d", "_k").agg(F.collect_list("w").alias("own"))
    return joined.join(own, ["_d", "_k"], "left").select("doc_id", "_z", F.col("c").alias("cand"), "own")


def dedup_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes), spans (removed byte ranges) for each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                b = batch.slice(at, 100)
                data, off = _texts(b, 1)
                out: list = [[], [], [], [], []]
                for i in range(b.num_rows):
                    text = data[off[i] : off[i + 1]]
                    gone = np.zeros(len(text), bool)
                    cand = b.column(2)[i].values
                    if cand is not None and len(cand):
                        p = cand.to_numpy()
                        edge = np.zeros(len(text) + 1, np.int64)
                        np.add.at(edge, p >> 16, 1)
                        np.add.at(edge, (p >> 16) + (p & 255), -1)
                        open_ = np.cumsum(edge[:-1]) > 0
                        own = b.column(3)[i].values
                        if own is not None and len(own):
                            kind, start, n = (own.field(x).to_numpy() for x in range(3))
                            for x in range(3):
                                edge = np.zeros(len(text) + 1, np.int64)
                                np.add.at(edge, start[kind == x], 1)
                                np.add.at(edge, (start + n)[kind == x], -1)
                                marked = np.cumsum(edge[:-1]) > 0
                                open_ = open_ | marked if x == 1 else open_ & ~marked
                        w = np.flatnonzero(open_)
                        edge = np.zeros(len(text) + 1, np.int64)
                        edge[w] += 1
                        edge[w + length] -= 1
                        gone = np.cumsum(edge[:-1]) > 0
                    step = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
                    s, e = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                    kept = text[~gone].tobytes()
                    for x, v in zip(out, (len(text), int(gone.sum()), len(s), kept, [{"s": x, "e": y} for x, y in zip(s.tolist(), e.tolist(), strict=True)]), strict=True):
                        x.append(v)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary()), pa.array(out[4], spans)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    return repeats(docs, length).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<s:long,e:long>>")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_bytes(spark_tables(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, bytes]], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """The same for a few documents, string by string."""
    seen: set[bytes] = set()
    out = {}
    for d, text in sorted(rows):
        gone = bytearray(len(text))
        for s in range(len(text) - length + 1):
            w = text[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        out[d] = (len(text), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
ORACLES: dict[str, str] = {}

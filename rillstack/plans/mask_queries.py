"""Queries over binary movies made of the frame stack, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillstack.operators import frames as fr
from rillstack.operators import masks as op
from rillstack.sources.fixtures import FRAMES_SQL, frames

QUERIES, ORACLES = {}, {}


def _add(name: str, sql: str, build) -> None:
    """build: frames -> DataFrame; doubles are rounded to 6 digits on both sides."""

    def query(spark, sf_dir):
        df = build(frames(spark, sf_dir))
        return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))

    QUERIES[name], ORACLES[name] = query, f"WITH RECURSIVE {FRAMES_SQL} {sql}"


def _movie(p: float) -> str:
    return f", mv AS (SELECT t, y, x FROM fr WHERE v > (SELECT quantile_cont(v, {p}) FROM fr))"


def _cross(out: str, src: str, keep: str) -> str:
    return f", {out} AS (SELECT a.t, a.y, a.x FROM fr a JOIN {src} b ON a.t = b.t AND abs(a.y - b.y) + abs(a.x - b.x) <= 1 GROUP BY 1, 2, 3 HAVING {keep})"


_ERODE, _DILATE = "count(*) = 5", "count(*) > 0"
_add("mask_opening", _movie(0.5) + _cross("e", "mv", _ERODE) + _cross("d", "e", _DILATE) + " SELECT * FROM d", lambda f: op.opening(op.binary_movie(f, 0.5), *fr.extent(f)[1:]))
_add("mask_closing", _movie(0.5) + _cross("d", "mv", _DILATE) + _cross("e", "d", _ERODE) + " SELECT * FROM e", lambda f: op.closing(op.binary_movie(f, 0.5), *fr.extent(f)[1:]))

_LABELS = _movie(0.9) + """, rc AS (SELECT t, y, x, y * 10 + x AS l FROM mv UNION SELECT n.t, n.y, n.x, rc.l FROM rc JOIN mv n ON n.t = rc.t AND abs(n.y - rc.y) + abs(n.x - rc.x) = 1),
 lb AS (SELECT t, y, x, min(l) AS label FROM rc GROUP BY t, y, x)"""
_SEGMENTS = _LABELS + """, sg AS (SELECT lb.t, lb.label, count(*) AS size, count(p.t) AS overlap, count(q.t) AS next FROM lb
 LEFT JOIN mv p ON p.t = lb.t - 1 AND p.y = lb.y AND p.x = lb.x LEFT JOIN mv q ON q.t = lb.t + 1 AND q.y = lb.y AND q.x = lb.x GROUP BY 1, 2)"""
_add("ccl_2d", _LABELS + " SELECT * FROM lb", lambda f: op.label_frames(op.binary_movie(f), fr.extent(f)[2]))
_add("prev_frame_overlap", _SEGMENTS + " SELECT * FROM sg", lambda f: op.segments(op.label_frames(op.binary_movie(f), fr.extent(f)[2])))
_add(
    "segment_states",
    _SEGMENTS
    + """, st AS (SELECT t, count(*) AS total, count(*) FILTER (overlap < 1) AS inits, count(*) FILTER (next < 1 AND t < 89) AS stops, floor(avg(size) FILTER (overlap < 1)) AS a, avg(size - overlap) FILTER (overlap >= 1) AS g FROM sg GROUP BY t)
 SELECT t, coalesce(inits, 0) AS inits, coalesce(stops, 0) AS stops, greatest(coalesce(total - inits - stops, 0), 0) AS carryover, CAST(coalesce(a, 0) AS BIGINT) AS avg_new_size, round(coalesce(g, 0), 6) AS growth_rate FROM (SELECT DISTINCT t FROM fr) LEFT JOIN st USING (t)""",
    lambda f: op.segment_states(op.label_frames(op.binary_movie(f), fr.extent(f)[2]), f.select("t").distinct(), fr.extent(f)[0] - 1),
)
_add(
    "neighbour_correlation_signals",
    """, o AS (SELECT unnest([2, 4, 6]) AS o), pt AS (SELECT fr.*, a.o AS cy, b.o AS cx FROM fr JOIN o a ON abs(y - a.o) <= 2 JOIN o b ON abs(x - b.o) <= 2),
 r AS (SELECT pt.cy, pt.cx, pt.y, pt.x, corr(pt.v, c.v) AS r FROM pt JOIN fr c ON c.t = pt.t AND c.y = pt.cy AND c.x = pt.cx GROUP BY 1, 2, 3, 4),
 z AS (SELECT cy, cx, y, x, CASE WHEN NOT isnan(r) AND r >= 2 / sqrt(90) THEN r ELSE 0 END AS r FROM r),
 k AS (SELECT *, row_number() OVER (PARTITION BY cy, cx ORDER BY r DESC, y, x) AS k FROM z), w AS (SELECT cy, cx, y, x, CASE WHEN k <= 10 THEN r ELSE 0 END AS r FROM k),
 n AS (SELECT *, sum(r) OVER (PARTITION BY cy, cx) AS s FROM w)
 SELECT CAST(cy AS BIGINT) AS cy, CAST(cx AS BIGINT) AS cx, t, round(sum(v * (r / s + 1e-6)), 6) AS v FROM pt JOIN n USING (cy, cx, y, x) WHERE s > 0 GROUP BY cy, cx, t""",
    lambda f: op.neighbour_signals(f, fr.extent(f)[0]),
)
_TILE = ", o AS (SELECT unnest([0, 2, 4, 6]) AS o), tl AS (SELECT fr.*, exp(-0.5 * ((y - a.o - 1.5) * (y - a.o - 1.5) + (x - b.o - 1.5) * (x - b.o - 1.5)) / 2.25) AS w FROM fr JOIN o a ON y >= a.o AND y < a.o + 4 JOIN o b ON x >= b.o AND x < b.o + 4)"
_add(
    "ola_identity",
    _TILE + " SELECT t, y, x, round(sum(v * w) / (sum(w) + 1e-12), 6) AS v FROM tl GROUP BY t, y, x",
    lambda f: fr.tiles(f).withColumn("w", fr.tile_weight()).groupBy("t", "y", "x").agg((F.sum(F.col("v") * F.col("w")) / (F.sum("w") + 1e-12)).alias("v")),
)

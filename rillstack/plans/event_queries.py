"""Queries over events of the movie, jumps and decompositions; SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillstack.operators import decompositions, events3d
from rillstack.operators import frames as fr
from rillstack.operators import masks as op
from rillstack.sources.fixtures import FRAMES_SQL, frames, table


def event_metrics_3d(spark, sf_dir):
    f = frames(spark, sf_dir)
    _, height, width = fr.extent(f)
    events = events3d.label_movie(op.label_frames(op.binary_movie(f), width), height * width)
    return events3d.metrics(events, f, 1, 3).withColumns({c: F.round(c, 6) for c in ("peak", "avg")})


def jump_intersection(spark, sf_dir):
    f = frames(spark, sf_dir)
    return events3d.common_jumps(f, fr.extent(f)[1] // 2)


def svht_rank(spark, sf_dir):
    return decompositions.svht_rank(table(spark, sf_dir, "embeddings"))


def tile_svd_denoise(spark, sf_dir):
    return decompositions.svd_denoise(frames(spark, sf_dir)).withColumn("v", F.round("v", 6))


QUERIES = {q.__name__: q for q in (event_metrics_3d, jump_intersection, svht_rank, tile_svd_denoise)}
ORACLES = {
    "event_metrics_3d": f"""WITH RECURSIVE {FRAMES_SQL}, mv AS (SELECT t, y, x, v FROM fr WHERE v > (SELECT quantile_cont(v, 0.9) FROM fr)),
 rc AS (SELECT t, y, x, t * 100 + y * 10 + x AS l FROM mv UNION SELECT n.t, n.y, n.x, rc.l FROM rc JOIN mv n ON abs(n.t - rc.t) + abs(n.y - rc.y) + abs(n.x - rc.x) = 1),
 lb AS (SELECT t, y, x, min(l) AS event FROM rc GROUP BY t, y, x), c AS (SELECT * FROM lb JOIN mv USING (t, y, x)),
 p AS (SELECT event, t, count(*) AS n FROM c GROUP BY event, t),
 k AS (SELECT event, arg_min(t, 1000000 - n * 1000 + t) AS pt, max(n) AS pa FROM p GROUP BY event),
 m AS (SELECT event, min(t) AS start, max(t) - min(t) + 1 AS duration, count(DISTINCT y * 10 + x) AS area, count(*) AS volume, round(max(v), 6) AS peak, round(avg(v), 6) AS avg FROM c GROUP BY event)
 SELECT event, start, duration, pt - start AS peak_area_frame, pa AS peak_area, volume, peak, avg, area, duration > 1 AND peak > 0.05 AND area > 3 AS keep FROM m JOIN k USING (event)""",
    "jump_intersection": f"""WITH {FRAMES_SQL}, a AS (SELECT y < 5 AS top, t, avg(v) AS v FROM fr GROUP BY 1, 2),
 d AS (SELECT a.top, a.t, b.v - a.v AS d FROM a JOIN a b ON a.top = b.top AND b.t = a.t + 1), s AS (SELECT top, stddev_pop(d) AS sd FROM d GROUP BY top),
 j AS (SELECT d.top, t FROM d JOIN s USING (top) WHERE abs(d) > sd) SELECT t FROM j WHERE top INTERSECT SELECT t FROM j WHERE NOT top""",
}

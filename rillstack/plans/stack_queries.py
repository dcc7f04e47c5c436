"""Jobs over the whole frame stack, functions of pixels and tiles, regions and density clusters of its movies, clusters of the embeddings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillstack.operators import frames as fr
from rillstack.operators import clusters, masks, points, stacks, steps
from rillstack.plans.mask_queries import _LABELS, _movie
from rillstack.sources.fixtures import FRAMES_SQL, frames, table

QUERIES, ORACLES = {}, {}


def _add(name: str, sql: str | None, build, digits: int = 6) -> None:
    """build: frames -> DataFrame; doubles are rounded on both sides, without -0.0."""

    def query(spark, sf_dir):
        df = build(frames(spark, sf_dir))
        return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))

    QUERIES[name] = query
    if sql:
        ORACLES[name] = f"WITH RECURSIVE {FRAMES_SQL}{sql}"


_add("pixel_function", " SELECT t, y, x, round(v - avg(v) OVER (PARTITION BY y, x), 6) + 0.0 AS v FROM fr", lambda f: stacks.pixelwise(f, lambda v: v - v.mean(), 0))
_add(
    "tile_function",
    ", o AS (SELECT unnest([0, 2, 4, 6]) AS o), s AS (SELECT a.o AS oy, b.o AS ox, stddev_pop(v) AS s FROM fr JOIN o a ON y >= a.o AND y < a.o + 4 JOIN o b ON x >= b.o AND x < b.o + 4 GROUP BY 1, 2), c AS (SELECT DISTINCT y, x FROM fr) SELECT y, x, round(avg(s), 6) + 0.0 AS v FROM c JOIN s ON y >= oy AND y < oy + 4 AND x >= ox AND x < ox + 4 GROUP BY y, x",
    lambda f: stacks.map_tiles(f, lambda x: x.std(), 4, 2),
)
_add("principal_baseline", None, stacks.principal_baseline, 4)
_add("process_stack", None, lambda f: stacks.process(f, 2, 1, tsize=30, smoother=lambda v: steps.savgol_rounds(v, 31)), 4)


def _labels(f):
    return masks.label_frames(masks.binary_movie(f), fr.extent(f)[2])


_SIZES = _LABELS + ", z AS (SELECT t, label, count(*) AS n FROM lb GROUP BY t, label)"
_add("largest_regions_2d", _SIZES + ", k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY n DESC, label) AS k, max(n) OVER (PARTITION BY t) AS top FROM z) SELECT lb.* FROM lb JOIN k USING (t, label) WHERE k <= 2 AND n >= 0.5 * top", lambda f: stacks.largest_regions(_labels(f), 2, 0.5))
_add("large_regions_2d", _SIZES + " SELECT lb.* FROM lb JOIN z USING (t, label) WHERE n >= 3", lambda f: stacks.large_regions(_labels(f), 3))


def seeded(f, without=False):
    return stacks.regions_with(_labels(f), masks.binary_movie(f, 0.97), without)


_SEEDS = _LABELS + ", sd AS (SELECT DISTINCT lb.t, lb.label FROM lb JOIN fr USING (t, y, x) WHERE fr.v > (SELECT quantile_cont(v, 0.97) FROM fr))"
_add("seeded_regions_2d", _SEEDS + " SELECT lb.* FROM lb SEMI JOIN sd USING (t, label)", seeded)
_add("seedless_regions_2d", _SEEDS + " SELECT lb.* FROM lb ANTI JOIN sd USING (t, label)", lambda f: seeded(f, True))
_add(
    "refined_masks",
    _movie(0.6) + ", pd AS (SELECT t, y, x FROM mv UNION ALL SELECT t, -1, x FROM mv WHERE y = 0 UNION ALL SELECT t, 10, x FROM mv WHERE y = 9), pp AS (SELECT * FROM pd UNION ALL SELECT t, y, -1 FROM pd WHERE x = 0 UNION ALL SELECT t, y, 10 FROM pd WHERE x = 9), c AS (SELECT fr.t, fr.y, fr.x FROM fr JOIN pp ON pp.t = fr.t AND abs(pp.y - fr.y) <= 1 AND abs(pp.x - fr.x) <= 1 GROUP BY 1, 2, 3 HAVING count(*) >= 5) SELECT * FROM c UNION SELECT * FROM mv",
    lambda f: stacks.refined(masks.binary_movie(f, 0.6), *fr.extent(f)[1:]),
)
_DENSE = _movie(0.9) + ", nb AS (SELECT a.t, a.y, a.x, b.y AS by, b.x AS bx FROM mv a JOIN mv b ON a.t = b.t AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 4), co AS (SELECT t, y, x FROM nb GROUP BY 1, 2, 3 HAVING count(*) >= 3)"
_add("cleaned_masks", _DENSE + " SELECT DISTINCT nb.t, nb.y, nb.x FROM nb JOIN co ON co.t = nb.t AND co.y = nb.by AND co.x = nb.bx", lambda f: points.cleaned(masks.binary_movie(f), 2.0, 3))
_add(
    "density_clusters",
    _DENSE
    + """, cc AS (SELECT nb.* FROM nb JOIN co a ON a.t = nb.t AND a.y = nb.y AND a.x = nb.x JOIN co b ON b.t = nb.t AND b.y = nb.by AND b.x = nb.bx),
 rc AS (SELECT t, y, x, y * 10 + x AS l FROM co UNION SELECT cc.t, cc.by AS y, cc.bx AS x, rc.l FROM rc JOIN cc ON cc.t = rc.t AND cc.y = rc.y AND cc.x = rc.x),
 lc AS (SELECT t, y, x, min(l) AS label FROM rc GROUP BY 1, 2, 3)
 SELECT * FROM lc UNION ALL SELECT nb.t, nb.y, nb.x, min(lc.label) AS label FROM nb JOIN lc ON lc.t = nb.t AND lc.y = nb.by AND lc.x = nb.bx ANTI JOIN co ON co.t = nb.t AND co.y = nb.y AND co.x = nb.x GROUP BY 1, 2, 3""",
    lambda f: points.density_clusters(masks.binary_movie(f), fr.extent(f)[2], 2.0, 3),
)


_ADAPTIVE = """, ix AS (SELECT unnest(range(-2, 12)) AS i), ms AS (SELECT i, CASE WHEN i < 0 THEN -1 - i WHEN i > 9 THEN 19 - i ELSE i END AS j FROM ix), pf AS (SELECT fr.t, a.i AS y, b.i AS x, v FROM fr JOIN ms a ON fr.y = a.j JOIN ms b ON fr.x = b.j),
 md AS (SELECT c.t, c.y, c.x, any_value(c.v) AS v, list_sort(list(p.v))[13] AS m FROM fr c JOIN pf p ON p.t = c.t AND p.y BETWEEN c.y - 2 AND c.y + 2 AND p.x BETWEEN c.x - 2 AND c.x + 2 GROUP BY 1, 2, 3),
 ce AS (SELECT t, quantile_cont(v - m, 0.5) AS c FROM md GROUP BY t), sd AS (SELECT t, 1.4826 * quantile_cont(abs(v - m - c), 0.5) AS s FROM md JOIN ce USING (t) GROUP BY t)
 SELECT t, y, x, round(CASE WHEN abs(v - m) > 3 * s THEN m ELSE v END, 6) + 0.0 AS v FROM md JOIN sd USING (t)"""
_add("adaptive_frames", _ADAPTIVE, lambda f: stacks.adaptive_frames(f, 3.0))
_add(
    "forward_deviation",
    ", k AS (SELECT unnest(range(0, 3)) AS k) SELECT c.t, c.y, c.x, round(stddev_pop(p.v), 6) + 0.0 AS v FROM fr c CROSS JOIN k a CROSS JOIN k b JOIN fr p ON p.t = c.t AND p.y = least(c.y + a.k, 9) AND p.x = least(c.x + b.k, 9) GROUP BY 1, 2, 3",
    lambda f: stacks.forward_deviation(f, 3),
)
_add(
    "binned_volume",
    ", m AS (SELECT min(v) AS m FROM fr WHERE t >= 83) SELECT CAST(t // 7 AS BIGINT) AS t, CAST(y // 4 AS BIGINT) AS y, CAST(x // 3 AS BIGINT) AS x, round(sum(v) + any_value(m) * (84 - count(*)), 6) + 0.0 AS v FROM fr, m WHERE t < 84 GROUP BY 1, 2, 3",
    lambda f: stacks.binned(f, {"t": 7, "y": 4, "x": 3}),
)
_CROSS = lambda out, src, keep: f", {out} AS (SELECT a.y, a.x FROM px a JOIN {src} b ON abs(a.y - b.y) + abs(a.x - b.x) <= 1 GROUP BY 1, 2 HAVING {keep})"
_add(
    "stained_area",
    ", px AS (SELECT y, x, avg(v) AS m FROM fr GROUP BY y, x), hi AS (SELECT y, x FROM px WHERE m >= (SELECT avg(v) FROM fr))"
    + _CROSS("a", "hi", "count(*) > 0") + _CROSS("b", "a", "count(*) = 5") + _CROSS("c", "b", "count(*) = 5") + _CROSS("d", "c", "count(*) > 0")
    + """, rc AS (SELECT y, x, y * 10 + x AS l FROM d UNION SELECT d.y, d.x, rc.l FROM rc JOIN d ON abs(d.y - rc.y) + abs(d.x - rc.x) = 1), lb AS (SELECT y, x, min(l) AS l FROM rc GROUP BY y, x),
 z AS (SELECT l, row_number() OVER (ORDER BY count(*) DESC, l) AS k FROM lb GROUP BY l HAVING count(*) >= 2) SELECT y, x FROM lb JOIN z USING (l) WHERE k <= 2 AND y BETWEEN 1 AND 8 AND x BETWEEN 1 AND 8""",
    lambda f: stacks.stained_area(f, f.agg(F.avg("v")).first()[0], 1, 2, 2),
)


def small_clusters(spark, sf_dir):
    """vec_id, label: embeddings whose label has under 50 members go to the nearest centre of the others."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return points.correct_small_loads(e, 50).select("vec_id", "label")


QUERIES["small_clusters"] = small_clusters
ORACLES["small_clusters"] = """WITH z AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), p AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
 c AS (SELECT label, i, avg(v) AS v FROM p JOIN z USING (label) WHERE n >= 50 GROUP BY 1, 2), d AS (SELECT p.vec_id, c.label, sum((p.v - c.v) * (p.v - c.v)) AS d FROM p JOIN z ON z.label = p.label AND z.n < 50 JOIN c ON c.i = p.i GROUP BY 1, 2)
 SELECT vec_id, label FROM embeddings JOIN z USING (label) WHERE n >= 50 UNION ALL SELECT vec_id, CAST(arg_min(label, (d, label)) AS INTEGER) AS label FROM d GROUP BY vec_id"""


def _embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


QUERIES["ward_clusters"] = lambda spark, sf_dir: clusters.ward(_embeddings(spark, sf_dir), 10)
QUERIES["consensus_clusters"] = lambda spark, sf_dir: clusters.consensus(_embeddings(spark, sf_dir), 5)

"""Surrogates, variance-stabilised signals, ages of segments, smoothing and baselines, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillstack.operators import baselines, events3d, haar, surrogates
from rillstack.operators import frames as fr
from rillstack.operators import masks as op
from rillstack.plans.array_queries import robust_line, transients
from rillstack.plans.array_queries import _spline_sql
from rillstack.plans.mask_queries import _SEGMENTS
from rillstack.plans.signal_queries import rank_filter
from rillstack.sources.fixtures import FRAMES_SQL, SIGNALS_SQL, frames, signals

QUERIES, ORACLES = {}, {}


def _add(name: str, source, source_sql: str, sql: str | None, build, digits: int = 6) -> None:
    """build: the source's rows -> DataFrame; doubles are rounded on both sides, without -0.0."""

    def query(spark, sf_dir):
        df = build(source(spark, sf_dir))
        return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))

    QUERIES[name] = query
    if sql:
        ORACLES[name] = f"WITH RECURSIVE {source_sql}{sql}"


def _signal(name: str, sql: str | None, build, digits: int = 6) -> None:
    _add(name, signals, SIGNALS_SQL, sql, build, digits)


def _frame(name: str, sql: str | None, build) -> None:
    _add(name, frames, FRAMES_SQL, sql, build)


# --- surrogates


def _place(salt: str, *cols: str) -> str:
    return f"md5(concat_ws(':', '{salt}', {', '.join(f'CAST({c} AS VARCHAR)' for c in cols)}))"


def _jitter_sql(out: str, src: str, keys: list[str], sigma: dict[str, float], last: dict[str, int], salt: str) -> str:
    axes, all_keys = list(sigma), ", ".join(keys)
    u = lambda a, k: f"(CAST('0x' || substr({_place(f'{salt}:{a}', *keys, *axes)}, {k}, 8) AS BIGINT) + 0.5) / 4294967296"
    step = lambda a: f"CAST(round(sqrt(-2 * ln({u(a, 1)})) * cos(2 * pi() * {u(a, 9)}) * {sigma[a]}) AS BIGINT)"
    to = ", ".join(f"least(greatest({a} + {step(a)}, 0), {last[a]}) AS to_{a}" for a in axes)
    join = " AND ".join([f"q.{k} = p.{k}" for k in keys] + [f"q.{a} = p.to_{a}" for a in axes])
    gives = f"SELECT {all_keys}, {', '.join(f'to_{a} AS {a}' for a in axes)}, ({', '.join(axes)},) AS turn, v FROM {out}_to"
    takes = f"SELECT {', '.join('p.' + c for c in [*keys, *axes])}, ({', '.join('p.' + a for a in axes)},) AS turn, q.v FROM {out}_to p JOIN {src} q ON {join}"
    return f", {out}_to AS (SELECT *, {to} FROM {src}), {out} AS (SELECT {', '.join([*keys, *axes])}, arg_max(v, turn) AS v FROM ({gives} UNION ALL {takes}) GROUP BY ALL)"


_CELLS = {"y": 9, "x": 9}
_signal("shuffle_signals", f" SELECT sig, row_number() OVER (PARTITION BY sig ORDER BY {_place('shuffle', 'sig', 't')}, t) - 1 AS t, round(v, 6) + 0.0 AS v FROM sig", lambda s: surrogates.shuffled(s, ["sig"]))
_frame("scramble_frames", f" SELECT y, x, row_number() OVER (PARTITION BY y, x ORDER BY {_place('shuffle', 'y', 'x', 't')}, t) - 1 AS t, round(v, 6) + 0.0 AS v FROM fr", lambda f: surrogates.shuffled(f, ["y", "x"]))
_signal("local_jitter", _jitter_sql("j", "sig", ["sig"], {"t": 5.0}, {"t": 719}, "jitter") + " SELECT sig, t, round(v, 6) + 0.0 AS v FROM j", lambda s: surrogates.jittered(s, ["sig"], {"t": 5.0}))
_frame("local_jitter_2d", _jitter_sql("j", "fr", ["t"], {"y": 3.0, "x": 3.0}, _CELLS, "jitter") + " SELECT t, y, x, round(v, 6) + 0.0 AS v FROM j", lambda f: surrogates.jittered(f, ["t"], {"y": 3.0, "x": 3.0}))
_frame("scramble_local_jitter", _jitter_sql("j", "fr", ["y", "x"], {"t": 10.0}, {"t": 89}, "jitter") + " SELECT t, y, x, round(v, 6) + 0.0 AS v FROM j", lambda f: surrogates.jittered(f, ["y", "x"], {"t": 10.0}))
_ROUNDS = "".join(_jitter_sql(f"s{k}", "fr", ["t"], {"y": 0.33, "x": 0.33}, _CELLS, f"space{k}") + _jitter_sql(f"t{k}", f"s{k}", ["y", "x"], {"t": 0.5}, {"t": 89}, f"time{k}") for k in (0, 1))
_frame("jitter_anti_aliasing", _ROUNDS + " SELECT t, y, x, round(avg(v), 6) + 0.0 AS v FROM (SELECT t, y, x, v FROM t0 UNION ALL SELECT t, y, x, v FROM t1) GROUP BY t, y, x", surrogates.anti_aliased)

# --- Haar-Fisz


def _haar_sql(levels: int = 10) -> str:
    out = ", h0 AS (SELECT sig, t AS i, greatest(v, 0) AS v FROM sig)"
    for k in range(1, levels + 1):
        out += f", p{k} AS (SELECT sig, CAST(i // 2 AS BIGINT) AS i, max(v) FILTER (i % 2 = 0) AS a, max(v) FILTER (i % 2 = 1) AS b FROM h{k - 1} GROUP BY 1, 2), h{k} AS (SELECT sig, i, coalesce((a + b) / 2, a) AS v FROM p{k})"
        out += f", d{k} AS (SELECT sig, i, CASE WHEN b IS NULL OR a + b <= 0 THEN 0 ELSE (a - b) / 2 / sqrt((a + b) / 2) END AS d FROM p{k})"
    parts = " UNION ALL ".join(f"SELECT s.sig, s.t, CASE WHEN (s.t >> {k - 1}) % 2 = 1 THEN -d ELSE d END AS v FROM sig s JOIN d{k} d ON d.sig = s.sig AND d.i = s.t >> {k}" for k in range(1, levels + 1))
    return f"{out} SELECT sig, t, round(sum(v), 6) + 0.0 AS v FROM ({parts} UNION ALL SELECT s.sig, s.t, h.v FROM sig s JOIN h{levels} h ON h.sig = s.sig) GROUP BY sig, t"


_signal("haar_fisz_transform", _haar_sql(), haar.haar_fisz)
_signal("haar_fisz_round_trip", " SELECT sig, t, round(greatest(v, 0), 6) + 0.0 AS v FROM sig", lambda s: haar.haar_fisz_inverse(haar.haar_fisz(s)))

# --- ages and classes of segments


def segment_ages(f):
    length, height, width = fr.extent(f)
    labelled = op.label_frames(op.binary_movie(f), width)
    node = (F.col("t") * (height * width) + F.col("label")).alias("node")
    cells = labelled.select("t", "y", "x", node)
    links = cells.join(cells.select((F.col("t") - 1).alias("t"), "y", "x", F.col("node").alias("b")), ["t", "y", "x"]).select(F.col("node").alias("a"), "b").distinct()
    return events3d.ages(op.segments(labelled).select("*", node), links, length - 1)


_frame(
    "segment_ages",
    ", "
    + _SEGMENTS.lstrip(", ")
    + """, lk AS (SELECT DISTINCT a.t, a.label, b.label AS was FROM lb a JOIN lb b ON b.t = a.t - 1 AND b.y = a.y AND b.x = a.x),
 ag AS (SELECT t, label, 1 AS age FROM sg WHERE overlap < 1 UNION SELECT lk.t, lk.label, ag.age + 1 FROM ag JOIN lk ON lk.t = ag.t + 1 AND lk.was = ag.label)
 SELECT t, label, CAST(max(age) AS BIGINT) AS age, CAST(max(CASE WHEN next < 1 AND t < 89 THEN 3 WHEN overlap < 1 THEN 1 ELSE 2 END) AS INTEGER) AS class FROM ag JOIN sg USING (t, label) GROUP BY t, label""",
    segment_ages,
)

# --- smoothing and baselines


def _run_sql(out: str, src: str, value: str, size: int, overlap: int | None = None) -> str:
    """src with a column `out`: tiled greater running minima of value."""
    step = size - (size // 2 if overlap is None else overlap)
    return f""", {out}_o AS (SELECT unnest(list_append(range(0, {720 - size}, {step}), {720 - size})) AS o), {out}_t AS (SELECT sig, t, o, {value} AS x FROM {src} JOIN {out}_o ON t >= o AND t < o + {size}),
 {out}_e AS (SELECT sig, t, greatest(min(x) OVER f, min(x) OVER g) AS x FROM {out}_t WINDOW f AS (PARTITION BY sig, o ORDER BY t), g AS (PARTITION BY sig, o ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 {out}_r AS (SELECT s.*, e.x AS {out} FROM {src} s JOIN (SELECT sig, t, min(x) AS x FROM {out}_e GROUP BY sig, t) e USING (sig, t))"""


def _gauss_sql(out: str, src: str, sigma: float) -> str:
    weights = baselines.gauss_weights(sigma)
    n = len(weights) // 2
    return f""", {out}_p AS (SELECT sig, t, v FROM {src} UNION ALL SELECT sig, -1 - t, v FROM {src} WHERE t < {n} UNION ALL SELECT sig, 1439 - t, v FROM {src} WHERE t >= {720 - n}),
 {out} AS (SELECT * FROM (SELECT sig, t, list_dot_product(list(v) OVER (PARTITION BY sig ORDER BY t ROWS BETWEEN {n} PRECEDING AND {n} FOLLOWING), CASE WHEN t BETWEEN 0 AND 719 THEN {[f'{w!r}' for w in weights]}::DOUBLE[] END) AS v FROM {out}_p) WHERE t BETWEEN 0 AND 719)"""


def _runmin(s, size: int = 50):
    return baselines.run_min(s.select("sig", "t", "v"), F.col("v"), "m", size, baselines.length(s)).select("sig", "t", F.col("m").alias("v"))


_signal("gaussian_filter_t", _gauss_sql("g", "sig", 2.5) + " SELECT sig, t, round(v, 6) + 0.0 AS v FROM g", lambda s: baselines.gaussian(s, 2.5))

_FLAT = _run_sql("a", "sig", "0.0 - v", 50) + _run_sql("tu", "a_r", "0.0 - a", 50) + ", fl AS (SELECT *, v - tu AS flat FROM tu_r)"
_FLAT += _run_sql("b", "fl", "flat", 200) + _run_sql("c", "b_r", "0.0 - b", 200) + _run_sql("d", "c_r", "0.0 - flat", 50) + _run_sql("e", "d_r", "0.0 - d", 50)
_FLAT += ", nx AS (SELECT *, tu + least(greatest(flat, 0.0 - c), e) AS nxt FROM e_r)" + _run_sql("g", "nx", "nxt", 200) + _run_sql("h", "g_r", "0.0 - g", 200)
_signal("flat_runmin_baseline", _FLAT + " SELECT sig, t, round(0.0 - h, 6) + 0.0 AS v FROM h_r", baselines.flat_runmin)


def branches(s):
    n = baselines.length(s)
    both = baselines.run_min(baselines.run_min(s.select("sig", "t", "v"), F.col("v"), "a", 50, n), 0.0 - F.col("v"), "c", 50, n)
    return baselines.stable_branch(both.select("sig", "t", "a", (0.0 - F.col("c")).alias("b")))


def _gradient_sql(c: str) -> str:
    return f"CASE WHEN lag({c}) OVER w IS NULL THEN lead({c}) OVER w - {c} WHEN lead({c}) OVER w IS NULL THEN {c} - lag({c}) OVER w ELSE (lead({c}) OVER w - lag({c}) OVER w) / 2 END"


_signal(
    "most_stable_branch",
    _run_sql("a", "sig", "v", 50)
    + _run_sql("c", "a_r", "0.0 - v", 50)
    + f""", br AS (SELECT sig, t, a, 0.0 - c AS b FROM c_r), g1 AS (SELECT *, {_gradient_sql('a')} AS a1, {_gradient_sql('b')} AS b1 FROM br WINDOW w AS (PARTITION BY sig ORDER BY t)),
 g2 AS (SELECT *, abs({_gradient_sql('a1')}) AS a2, abs({_gradient_sql('b1')}) AS b2 FROM g1 WINDOW w AS (PARTITION BY sig ORDER BY t)), o AS (SELECT unnest(list_append(range(0, 670, 34), 670)) AS o),
 tl AS (SELECT g2.*, o FROM g2 JOIN o ON t >= o AND t < o + 50), pk AS (SELECT sig, o, round(sum(a2), 9) <= round(sum(b2), 9) AS first FROM tl GROUP BY sig, o)
 SELECT sig, t, round(arg_max(CASE WHEN first THEN a ELSE b END, o), 6) + 0.0 AS v FROM tl JOIN pk USING (sig, o) GROUP BY sig, t""",
    branches,
)
_signal(
    "rolled_runmin_baseline",
    ", rl AS (SELECT sig || ':' || r AS k, sig AS own, r, (t + r) % 720 AS t, v FROM sig CROSS JOIN (SELECT unnest(range(0, 720, 144)) AS r)), rs AS (SELECT k AS sig, t, v, own, r FROM rl)" + _run_sql("m", "rs", "v", 50) + " SELECT own AS sig, CAST((t - r + 720) % 720 AS BIGINT) AS t, round(quantile_cont(m, 0.5), 6) + 0.0 AS v FROM m_r GROUP BY 1, 2",
    lambda s: baselines.rolled(s, _runmin),
)

_ROBUST = ", l0 AS (SELECT sig, 0.0::DOUBLE AS k, 0.0::DOUBLE AS b, true AS free FROM (SELECT DISTINCT sig FROM sig))" + "".join(
    f", l{k} AS (SELECT sig, regr_slope(v, t) AS k, regr_intercept(v, t) AS b, false AS free FROM sig JOIN l{k - 1} USING (sig) JOIN ns USING (sig) WHERE free OR abs(k * t + b - v) <= 3 * ns GROUP BY sig)" for k in range(1, 6)
)
_signal(
    "filtered_minima_baseline",
    ", ns AS (SELECT sig, stddev_pop(d) / sqrt(2) AS ns FROM (SELECT sig, lead(v) OVER (PARTITION BY sig ORDER BY t) - v AS d FROM sig) GROUP BY sig)"
    + _ROBUST
    + """, pp AS (SELECT sig, t, v FROM sig UNION ALL SELECT sig, -1 - t, v FROM sig WHERE t < 5 UNION ALL SELECT sig, 1439 - t, v FROM sig WHERE t >= 715),
 pf AS (SELECT * FROM (SELECT sig, t, list_sort(list(v) OVER (PARTITION BY sig ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))[3] AS v FROM pp) WHERE t BETWEEN 0 AND 719)"""
    + _gauss_sql("g", "pf", 2.5)
    + """, d0 AS (SELECT sig, t, k * t + b AS trend, g.v - (k * t + b) AS v FROM g JOIN l5 USING (sig)), q0 AS (SELECT sig, quantile_cont(v, 0.25) AS q FROM d0 WHERE t < 600 GROUP BY sig),
 d1 AS (SELECT sig, t, trend, CASE WHEN t = 0 THEN least(v, q) ELSE v END AS v FROM d0 JOIN q0 USING (sig)), q1 AS (SELECT sig, quantile_cont(v, 0.25) AS q FROM d1 WHERE t >= 120 GROUP BY sig),
 d2 AS (SELECT sig, t, trend, CASE WHEN t = 719 THEN least(v, q) ELSE v END AS v FROM d1 JOIN q1 USING (sig))"""
    + _run_sql("low", "d2", "v", 300)
    + _run_sql("high", "low_r", "0.0 - low", 150)
    + f""", kn AS (SELECT sig, t, trend, v, lag(v) OVER w IS NULL OR lead(v) OVER w IS NULL OR (sign(lead(v) OVER w - v) > sign(v - lag(v) OVER w) AND abs(v + high) <= 1.5 * ns) AS knot FROM high_r JOIN ns USING (sig) WINDOW w AS (PARTITION BY sig ORDER BY t)),
 ki AS (SELECT *, max(t) FILTER (knot) OVER (PARTITION BY sig ORDER BY t) AS t0, min(t) FILTER (knot) OVER (PARTITION BY sig ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1 FROM kn),
 base AS (SELECT i.sig, i.t, i.trend, CASE WHEN t0 = t1 THEN p.v ELSE p.v + (q.v - p.v) * (i.t - t0) / (t1 - t0) END AS v FROM ki i JOIN kn p ON p.sig = i.sig AND p.t = t0 JOIN kn q ON q.sig = i.sig AND q.t = t1),
 {_spline_sql('base', 25.0)} SELECT sig, t, round(z.v + trend, 5) + 0.0 AS v FROM z JOIN base USING (sig, t)""",
    lambda s: baselines.filtered_minima(s, robust_line(s, baselines.by_time(), rounds=5), rank_filter),
    5,
)


def split_events(s):
    """Events of the transients, divided by the signal's largest one so that the levels of 0.05 and 0.1 apply."""
    own = transients(s, baselines.by_time())
    top = own.groupBy("sig").agg(F.max("v").alias("top"))
    return baselines.split_events(own.join(top, "sig").select("sig", "t", F.when(F.col("top") > 0, F.col("v") / F.col("top")).otherwise(0.0).alias("v")))


_signal("segment_events_1d", None, split_events)

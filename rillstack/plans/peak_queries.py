"""Peaks, local polynomials, steps and modes of the hourly signals, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillstack.operators import iterated, peaks, smoothers, steps
from rillstack.sources.fixtures import SIGNALS_SQL, signals

QUERIES, ORACLES = {}, {}


def _add(name: str, sql: str | None, build, digits: int = 6) -> None:
    """build: signals -> DataFrame; doubles are rounded on both sides, without -0.0."""

    def query(spark, sf_dir):
        df = build(signals(spark, sf_dir))
        return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))

    QUERIES[name] = query
    if sql:
        ORACLES[name] = f"WITH {SIGNALS_SQL}{sql}"


_add(
    "peak_prominences",
    """, ch AS (SELECT *, sum(CASE WHEN v = before THEN 0 ELSE 1 END) OVER (PARTITION BY sig ORDER BY t) AS run FROM (SELECT *, lag(v) OVER (PARTITION BY sig ORDER BY t) AS before FROM sig)),
 rn AS (SELECT sig, run, min(t) AS a, max(t) AS b, any_value(v) AS v FROM ch GROUP BY sig, run),
 pk AS (SELECT sig, (a + b) // 2 AS t, v FROM (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS q FROM rn WINDOW w AS (PARTITION BY sig ORDER BY run)) WHERE v > p AND v > q),
 bd AS (SELECT pk.sig, pk.t, any_value(pk.v) AS v, coalesce(max(s.t) FILTER (s.t < pk.t AND s.v > pk.v), -1) AS lo, coalesce(min(s.t) FILTER (s.t > pk.t AND s.v > pk.v), 720) AS hi FROM pk JOIN sig s ON s.sig = pk.sig GROUP BY 1, 2),
 bs AS (SELECT bd.sig, bd.t, any_value(bd.v) AS v, min((s.v, -s.t)) FILTER (s.t > lo AND s.t <= bd.t) AS l, min((s.v, s.t)) FILTER (s.t < hi AND s.t >= bd.t) AS r FROM bd JOIN sig s ON s.sig = bd.sig GROUP BY 1, 2)
 SELECT sig, t, round(v, 6) + 0.0 AS v, round(v - greatest(l[1], r[1]), 6) + 0.0 AS prominence, CAST(-l[2] AS BIGINT) AS left_base, CAST(r[2] AS BIGINT) AS right_base FROM bs""",
    peaks.all_peaks,
)
_add("peak_descriptions", None, lambda s: peaks.describe(s, most=5))

_SIZE = 25
_WEIGHTS = steps.polynomial_weights(_SIZE, 3)
_LIST = lambda line: "[" + ", ".join(repr(w) for w in line) + "]::DOUBLE[]"
_add(
    "savgol_smooth",
    f""", nr AS (SELECT sig, t, list(v) OVER (PARTITION BY sig ORDER BY t ROWS BETWEEN {_SIZE // 2} PRECEDING AND {_SIZE // 2} FOLLOWING) AS c FROM sig),
 wt AS (SELECT unnest(range(0, {_SIZE})) AS k, unnest([{", ".join(_LIST(line) for line in _WEIGHTS)}]) AS w)
 SELECT sig, t, round(list_dot_product(c, {_LIST(_WEIGHTS[_SIZE // 2])}), 6) + 0.0 AS v FROM (SELECT * FROM nr WHERE len(c) = {_SIZE})
 UNION ALL SELECT sig, k AS t, round(list_dot_product(c, w), 6) + 0.0 AS v FROM (SELECT * FROM nr WHERE t = {_SIZE // 2}) CROSS JOIN wt WHERE k < {_SIZE // 2}
 UNION ALL SELECT sig, {720 - _SIZE} + k AS t, round(list_dot_product(c, w), 6) + 0.0 AS v FROM (SELECT * FROM nr WHERE t = {719 - _SIZE // 2}) CROSS JOIN wt WHERE k > {_SIZE // 2}""",
    lambda s: steps.savgol(s, _SIZE),
)
_add("savgol_baseline", None, lambda s: smoothers.per_signal(s, steps.savgol_rounds))
_add("l1_rounds_baseline", None, lambda s: smoothers.per_signal(s, steps.l1_rounds))
_add("shifted_baseline", None, lambda s: smoothers.per_signal(s, steps.baseline_with_shifts))
_add("signal_jumps", None, steps.find_jumps)
_add("coherent_jumps", None, steps.coherent_jumps)
_add(
    "mode_histogram",
    """, e AS (SELECT sig, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.95) AS hi FROM sig GROUP BY sig)
 SELECT sig, CAST(least(floor((v - lo) / (hi - lo) * 100), 99) AS BIGINT) AS bin, count(*) AS n, round(any_value(lo), 6) + 0.0 AS lo, round(any_value(hi), 6) + 0.0 AS hi FROM sig JOIN e USING (sig) WHERE v BETWEEN lo AND hi AND hi > lo GROUP BY 1, 2""",
    steps.histogram,
)
_add("signal_modes", None, lambda s: steps.modes(s, kind="max_area"))
_add("bias_modes", None, steps.bias_modes)

for _name in ("smoothed_minima", "iterated_minima", "symmetric_run_min", "trend_and_minima", "symmetrized_run_min", "percentile_line", "percentile_scales", "asymmetric_spline", "double_asymmetric"):
    _add(f"{_name}_baseline", None, lambda s, fn=getattr(iterated, _name): smoothers.per_signal(s, fn), 5)

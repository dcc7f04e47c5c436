"""Labelers, committees, jittered labelers and pipelines over the hourly signals, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rillstack.operators import labelers, smoothers
from rillstack.plans.array_queries import _spline_sql
from rillstack.plans.further_queries import _jitter_sql
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


def scaled(s):
    """The signals less their medians, in their standard deviations."""
    own = Window.partitionBy("sig")
    return s.select("sig", "t", ((F.col("v") - F.expr("percentile(v, 0.5)").over(own)) / F.stddev_pop("v").over(own)).alias("v"))


_SCALED = ", md AS (SELECT sig, quantile_cont(v, 0.5) AS m, stddev_pop(v) AS sd FROM sig GROUP BY sig), sc AS (SELECT sig, t, (v - m) / sd AS v FROM sig JOIN md USING (sig))"
#: Coefficients of the scales: what the smooth before leaves of a cosine less what the scale's own leaves.
_SCALES = f"""{_SCALED}, dc AS (SELECT s.sig, k.k, sum(s.v * cos(pi() * (s.t + 0.5) * k.k / 720)) * (CASE WHEN k.k = 0 THEN 1 ELSE 2 END) / 720 AS c FROM sc s CROSS JOIN (SELECT unnest(range(0, 720)) AS k) k GROUP BY s.sig, k.k),
 gn AS (SELECT k, level, 1 / (1 + pow(1.5, 4 * level) * pow(2 - 2 * cos(pi() * k / 720), 2)) AS g FROM (SELECT unnest(range(0, 720)) AS k) CROSS JOIN (SELECT unnest(range(0, 12)) AS level)),
 lf AS (SELECT k, level, g, coalesce(lag(g) OVER (PARTITION BY k ORDER BY level), 1) AS was FROM gn),
 cf AS (SELECT dc.sig, lf.level, t.t, sum(dc.c * (lf.was - lf.g) * cos(pi() * (t.t + 0.5) * dc.k / 720)) AS v FROM dc JOIN lf USING (k) CROSS JOIN (SELECT unnest(range(0, 720)) AS t) t GROUP BY 1, 2, 3)"""
_TABLE = f"th AS (SELECT unnest(range(0, 12)) AS level, unnest({list(labelers.L2_THRESHOLDS)}) AS th)"

_add("scale_coefficients", f"{_SCALES} SELECT sig, CAST(level AS INTEGER) AS level, t, round(v, 5) + 0.0 AS v FROM cf WHERE level IN (1, 5, 11)", lambda s: labelers.scales(scaled(s)).where("level in (1, 5, 11)"), 5)
_add("multiscale_label_l2", f"{_SCALES}, {_TABLE} SELECT sig, t FROM cf JOIN th USING (level) WHERE level >= 1 AND v >= th GROUP BY sig, t HAVING count(*) >= 4", lambda s: labelers.multiscale_l2()(scaled(s)))
_add("multiscale_label_l1", None, lambda s: labelers.multiscale_l1()(scaled(s)))
_add(
    "label_committee",
    f"{_SCALES}, {_TABLE}, {_spline_sql('sc', 5.0)} SELECT sig, t FROM cf JOIN th USING (level) JOIN z USING (sig, t) WHERE level >= 2 AND cf.v >= th AND z.v >= 1 GROUP BY sig, t HAVING count(*) >= 3",
    lambda s: labelers.committee(labelers.multiscale_l2(3, 2), labelers.simple())(scaled(s)),
)
_ROUNDS = 20
_add(
    "jittered_label",
    f"{_SCALED}, rp AS (SELECT r || '|' || sig AS sig, t, v FROM sc CROSS JOIN (SELECT unnest(range(0, {_ROUNDS})) AS r)){_jitter_sql('j', 'rp', ['sig'], {'t': 2.5}, {'t': 719}, 'jitter')}, {_spline_sql('j', 5.0)} SELECT substr(sig, instr(sig, '|') + 1) AS sig, t FROM z WHERE v >= 0.3 GROUP BY 1, 2 HAVING count(*) >= {0.85 * _ROUNDS}",
    lambda s: labelers.jittered(labelers.simple(0.3), _ROUNDS)(scaled(s)),
)
_add("multiscale_label_joint", None, lambda s: labelers.multiscale_joint(_ROUNDS)(scaled(s)))
_add(
    "median_std_label",
    f""", md AS (SELECT sig, quantile_cont(v, 0.5) AS m FROM sig GROUP BY sig), sd AS (SELECT sig, any_value(m) AS m, sqrt(avg((v - m) * (v - m))) AS sd FROM sig JOIN md USING (sig) GROUP BY sig),
 m3 AS (SELECT * FROM (SELECT sig, t, list_sort(list(v) OVER (PARTITION BY sig ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))[2] AS v FROM (SELECT sig, t, v FROM sig UNION ALL SELECT sig, -1, v FROM sig WHERE t = 0 UNION ALL SELECT sig, 720, v FROM sig WHERE t = 719)) WHERE t BETWEEN 0 AND 719),
 {_spline_sql('m3', 0.5)}, d AS (SELECT sig.sig, sig.t, sig.v, m, sd, z.v AS z, sig.v > m AS hot FROM sig JOIN sd USING (sig) JOIN z ON z.sig = sig.sig AND z.t = sig.t),
 r AS (SELECT *, sum(CASE WHEN up THEN 1 ELSE 0 END) OVER (PARTITION BY sig ORDER BY t) AS run FROM (SELECT *, hot AND NOT coalesce(lag(hot) OVER (PARTITION BY sig ORDER BY t), false) AS up FROM d))
 SELECT sig, t, round(CASE WHEN hot AND bool_or(hot AND z >= sd) OVER (PARTITION BY sig, run) THEN v ELSE 0 END, 6) + 0.0 AS v FROM r""",
    labelers.median_std,
)
for _form in ("medians", "window", "ranks"):
    _add(f"rolling_noise_{_form}", None, lambda s, form=_form: smoothers.per_signal(s, lambda v: labelers.rolling_noise(v, form)))
_add("simple_pipeline", None, labelers.pipeline)
_add("multiscale_pipeline", None, lambda s: labelers.pipeline(s, labelers.multiscale_both(), smoothed=False))
_add("plain_pipeline", None, labelers.plain_pipeline)

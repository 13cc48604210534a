"""Unit statistics, false discovery and scaling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signal as S
from ..operators import raster as R
from ..operators import selection as sel
from ..operators import stats
from . import binding as B
from .queries_raster import U, UK, counts, unit_trials
from .registry import BASE, b, kruskal_sql, query, r, sig

CTX_S = 43200.0

ROWS_V = BASE + ", rows_v AS (SELECT session, region, unit, label, ctx AS v FROM ut)"
KW = ROWS_V + kruskal_sql("rows_v", UK)
# The tail is closed for two degrees of freedom; for one it is one minus the error function, as a series of positive terms.
P_SQL = """CASE WHEN df = 2 THEN exp(-h / 2) WHEN df = 1 AND h <= 0 THEN 1
  WHEN df = 1 THEN 1 - 2 / sqrt(pi()) * exp(-h / 2) * list_sum(list_transform(range(0, 150), lambda n:
    exp((2 * n + 1) * ln(sqrt(h / 2)) + n * ln(4) + lgamma(n + 1) - lgamma(2 * n + 2)))) END"""


def unit_kruskal(spark, sf):
    ut, sizes = unit_trials(spark, sf)
    return stats.kruskal(stats.class_histogram(ut, sizes), U)


@query("kruskal", KW + f"SELECT {UK}, {r('h', 'h')}, {b('df', 'df')} FROM kw")
def kruskal(spark, sf):
    return unit_kruskal(spark, sf).drop("p")


@query("kruskal_p", KW + f"SELECT {UK}, {r(P_SQL, 'p')} FROM kw")
def kruskal_p(spark, sf):
    return unit_kruskal(spark, sf).select(*U, "p")


def of(label: str, fn: str, v: str = "ctx") -> str:
    return f"{fn}(CASE WHEN label = '{label}' THEN {v} END)"


@query("cohens_d", BASE + f"""
SELECT {UK}, {r(f'''CASE WHEN {of('Left', 'count')} >= 2 AND {of('Right', 'count')} >= 2 THEN
  coalesce(({of('Left', 'avg')} - {of('Right', 'avg')}) /
           nullif(sqrt(({of('Left', 'var_samp')} + {of('Right', 'var_samp')}) / 2), 0), 0) END''', 'd_left_right')}
FROM ut GROUP BY {UK}""")
def cohens_d(spark, sf):
    ut, sizes = unit_trials(spark, sf)
    return stats.class_moments(ut, sizes).select(*U, stats.cohens_d().alias("d_left_right"))


@query("eta_sq", BASE + f"""
, g AS (SELECT {UK}, label, avg(ctx) AS m, count(*) AS k FROM ut GROUP BY {UK}, label),
t AS (SELECT {UK}, avg(ctx) AS gm, var_pop(ctx) * count(*) AS sst FROM ut GROUP BY {UK})
SELECT t.session, t.region, t.unit, {r('CASE WHEN any_value(sst) = 0 THEN 0 ELSE sum(k * (m - gm) * (m - gm)) / any_value(sst) END', 'eta_sq')}
FROM g JOIN t ON g.session = t.session AND g.unit = t.unit GROUP BY t.session, t.region, t.unit""")
def eta_sq(spark, sf):
    ut, sizes = unit_trials(spark, sf)
    return stats.class_moments(ut, sizes).select(*U, stats.eta_squared().alias("eta_sq"))


DP = BASE + f""", f AS (SELECT *, ctx / 4.32 AS fr FROM ut),
dp AS (
  SELECT {UK},
    CASE WHEN {of('Left', 'count')} >= 2 AND {of('Right', 'count')} >= 2
          AND ({of('Left', 'var_pop', 'fr')} + {of('Right', 'var_pop', 'fr')}) / 2 >= 1e-8
         THEN ({of('Left', 'avg', 'fr')} - {of('Right', 'avg', 'fr')}) /
              sqrt(({of('Left', 'var_pop', 'fr')} + {of('Right', 'var_pop', 'fr')}) / 2) ELSE 0 END AS d_lr,
    CASE WHEN count(CASE WHEN label <> 'Ignore' THEN 1 END) >= 2 AND {of('Ignore', 'count')} >= 2
          AND (var_pop(CASE WHEN label <> 'Ignore' THEN fr END) + {of('Ignore', 'var_pop', 'fr')}) / 2 >= 1e-8
         THEN (avg(CASE WHEN label <> 'Ignore' THEN fr END) - {of('Ignore', 'avg', 'fr')}) /
              sqrt((var_pop(CASE WHEN label <> 'Ignore' THEN fr END) + {of('Ignore', 'var_pop', 'fr')}) / 2) ELSE 0 END AS d_li,
    avg(fr) AS rate
  FROM f GROUP BY {UK})
"""
# counts over 4.32 units of 10^4 seconds keep the rates far from the variance threshold
DUR = 4.32


@query("dprime", DP + f"SELECT {UK}, {r('d_lr', 'dprime_lr')}, {r('d_li', 'dprime_lick')} FROM dp")
def dprime(spark, sf):
    ut, sizes = unit_trials(spark, sf)
    m = stats.class_moments(ut, sizes)
    return m.select(*U, stats.dprime((1,), (2,), DUR).alias("dprime_lr"), stats.dprime((1, 2), (0,), DUR).alias("dprime_lick"))


@query("choice_score", DP + f"SELECT {UK}, {r('greatest(abs(d_lr), 0.65 * abs(d_li))', 'choice')} FROM dp")
def choice_score(spark, sf):
    ut, sizes = unit_trials(spark, sf)
    return stats.class_moments(ut, sizes).select(*U, stats.choice_score(DUR).alias("choice"))


PREF = f"""pc AS (
  SELECT {UK}, {of('Ignore', 'avg')} AS m0, {of('Left', 'avg')} AS m1, {of('Right', 'avg')} AS m2 FROM ut GROUP BY {UK}),
pref AS (
  SELECT {UK}, CASE WHEN coalesce(m0, -1) >= greatest(coalesce(m1, -1), coalesce(m2, -1)) THEN 'Ignore'
                    WHEN coalesce(m1, -1) >= coalesce(m2, -1) THEN 'Left' ELSE 'Right' END AS preferred_class FROM pc)"""


@query("preferred_class", BASE + ", " + PREF + f" SELECT {UK}, preferred_class FROM pref")
def preferred_class(spark, sf):
    ut, sizes = unit_trials(spark, sf)
    return stats.class_moments(ut, sizes).select(*U, stats.preferred_class().alias("preferred_class"))


RANK2 = """
, rk AS (
  SELECT {key}, {x} AS x, {y} AS y,
    rank() OVER (PARTITION BY {key} ORDER BY {x}) + (count(*) OVER (PARTITION BY {key}, {x}) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY {key} ORDER BY {y}) + (count(*) OVER (PARTITION BY {key}, {y}) - 1) / 2.0 AS ry
  FROM {rows}),
rho AS (
  SELECT {key}, count(*) AS n_pairs,
    CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END AS rho
  FROM rk GROUP BY {key})
"""


@query("spearman_coupling", BASE + RANK2.format(key=UK, x="late", y="tgt", rows="ut") + f"SELECT {UK}, {r('rho', 'rho')}, n_pairs FROM rho")
def spearman_coupling(spark, sf):
    ut, sizes = unit_trials(spark, sf)
    return stats.spearman_coupling(ut, sizes).drop("p")


@query("spearman_coupling_p")
def spearman_coupling_p(spark, sf):
    """Correlation, pairs and the t-test p, which SQL has no function for."""
    ut, sizes = unit_trials(spark, sf)
    return stats.spearman_coupling(ut, sizes)


TAPS = "SELECT k - 8 AS off, exp(-0.5 * ((k - 8) / 2.0) ** 2) AS w FROM range(17) t(k)"
SMOOTH = f"""
, grid AS (SELECT u.session, u.region, u.unit, bn AS bin FROM units u, range(24) g(bn)),
tr_ AS (
  SELECT g.session, g.region, g.unit, g.bin, coalesce(sum(c.n), 0) / any_value(s.n_trials) AS m
  FROM grid g JOIN sizes s ON s.session = g.session
  LEFT JOIN cells c ON c.session = g.session AND c.unit = g.unit AND c.bin = g.bin AND c.win = 'ctx' AND c.label IS NOT NULL
  GROUP BY g.session, g.region, g.unit, g.bin),
taps AS ({TAPS}), tw AS (SELECT sum(w) AS s FROM taps),
sm AS (
  SELECT g.session, g.region, g.unit, g.bin, sum(t.m / 1800.0 * 1000 * k.w / tw.s) AS v
  FROM grid g CROSS JOIN taps k CROSS JOIN tw
  JOIN tr_ t ON t.session = g.session AND t.unit = g.unit AND t.bin = greatest(0, least(23, g.bin + k.off))
  GROUP BY g.session, g.region, g.unit, g.bin)
"""


def traces(spark, sf):
    binned, tr, un = counts(spark, sf)
    return R.psth_arrays(R.psth(binned, R.unit_sizes(un, tr)), un, B.N_CTX, B.N_TGT)


@query("spearman_ramp", BASE + SMOOTH + f", sr AS (SELECT session, region, unit, bin, {sig('v')} AS v FROM sm)"
       + RANK2.format(key=UK, x="bin", y="v", rows="sr") + f"SELECT {UK}, {r('rho', 'rho')}, n_pairs FROM rho")
def spearman_ramp(spark, sf):
    smooth = S.gaussian_smooth(S.rate(F.col("ctx"), B.CTX_BIN / 1000), 2.0)
    return stats.spearman_ramp(traces(spark, sf), smooth).drop("p")


@query("smooth_psth", BASE + SMOOTH + f"SELECT {UK}, {b('bin', 'bin')}, {r('v', 'rate')} FROM sm")
def smooth_psth(spark, sf):
    """Gaussian-smoothed mean rate (mHz) per unit and bin."""
    smooth = S.gaussian_smooth(S.rate(F.col("ctx"), B.CTX_BIN / 1000), 2.0)
    return traces(spark, sf).select(*U, F.posexplode(smooth).alias("bin", "rate"))


PEARSON = BASE + f"""
, pg AS (
  SELECT u.session, u.region, u.unit, bn AS bin, s.n_trials FROM units u JOIN sizes s ON s.session = u.session, range(24) g(bn)),
pa AS (
  SELECT g.session, g.region, g.unit, g.bin, coalesce(sum(c.n), 0) / any_value(n_trials) AS a
  FROM pg g LEFT JOIN cells c ON c.session = g.session AND c.unit = g.unit AND c.bin = g.bin AND c.win = 'ctx' AND c.label IS NOT NULL
  GROUP BY g.session, g.region, g.unit, g.bin),
pt AS (
  SELECT g.session, g.region, g.unit, g.bin, coalesce(sum(c.n), 0) / any_value(n_trials) AS m
  FROM (SELECT * FROM pg WHERE bin < 12) g
  LEFT JOIN cells c ON c.session = g.session AND c.unit = g.unit AND c.bin = g.bin AND c.win = 'tgt' AND c.label IS NOT NULL
  GROUP BY g.session, g.region, g.unit, g.bin),
pr AS (
  SELECT a.session, a.region, a.unit, a.a,
         lo.m + (hi.m - lo.m) * (a.bin * 11.0 / 23 - floor(a.bin * 11.0 / 23)) AS z
  FROM pa a JOIN pt lo ON lo.session = a.session AND lo.unit = a.unit AND lo.bin = floor(a.bin * 11.0 / 23)
  JOIN pt hi ON hi.session = a.session AND hi.unit = a.unit AND hi.bin = least(11, floor(a.bin * 11.0 / 23) + 1)),
cpl AS (
  SELECT {UK}, CASE WHEN stddev_pop(a) < 1e-8 OR stddev_pop(z) < 1e-8 THEN 0
                    ELSE greatest(covar_pop(a, z) / (stddev_pop(a) * stddev_pop(z)), 0) END AS coupling
  FROM pr GROUP BY {UK})
"""


@query("pearson_psth", PEARSON + f"SELECT {UK}, {r('coupling', 'coupling')} FROM cpl")
def pearson_psth(spark, sf):
    return stats.pearson_arrays(traces(spark, sf), U, F.col("ctx"), S.resample(F.col("tgt"), B.N_CTX))


BH = """
, pp AS (SELECT session, region, unit, {p} AS p FROM kw),
ro AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY p) AS rn, count(*) OVER (PARTITION BY session) AS m FROM pp WHERE p IS NOT NULL),
qq AS (
  SELECT session, unit, least(1, min(p * m / rn) OVER (PARTITION BY session ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q
  FROM ro),
qs AS (SELECT pp.*, qq.q FROM pp LEFT JOIN qq USING (session, unit))
""".format(p=P_SQL)


@query("bh_fdr", KW + BH + f"SELECT {UK}, {r('p', 'p')}, {r('q', 'q')} FROM qs")
def bh_fdr(spark, sf):
    tests = unit_kruskal(spark, sf).select(*U, "p")
    return stats.bh_fdr(tests, ["session"])


@query("score_a", KW + BH + f"""
SELECT {UK}, {r('-log10(greatest(coalesce(q, 1), 1e-12)) + 0.5 * -log10(greatest(coalesce(p, 1), 1e-12))', 'score')} FROM qs""")
def score_a(spark, sf):
    """Weighted -log10 terms of a corrected and an uncorrected test."""
    from ..schema import SelectionA

    q = bh_fdr(spark, sf)
    none = F.lit(None).cast("double")
    named = q.select(*U, F.col("q").alias("q_selectivity"), none.alias("q_coupling"), none.alias("q_spectral"), F.col("p").alias("q_ramp"))
    return named.select(*U, sel.combined_score(SelectionA()).alias("score"))


@query("zscore_region", DP + f"""
SELECT {UK}, {r('''CASE WHEN stddev_pop(rate) OVER (PARTITION BY session, region) < 1e-8 THEN 0 ELSE
  (rate - avg(rate) OVER (PARTITION BY session, region)) / stddev_pop(rate) OVER (PARTITION BY session, region) END''', 'z_rate')}
FROM dp""")
def zscore_region(spark, sf):
    ut, sizes = unit_trials(spark, sf)
    m = stats.class_moments(ut, sizes).select(*U, stats.mean_rate(DUR).alias("rate"))
    return stats.zscore(m, ["session", "region"], ["rate"]).select(*U, "z_rate")


PRIOR = f""", pd AS (
  SELECT {UK}, coalesce(CASE WHEN {of('Left', 'count')} > 0 AND {of('Right', 'count')} > 0 THEN
    abs({of('Left', 'avg', 'fr')} - {of('Right', 'avg', 'fr')}) /
    sqrt(({of('Left', 'var_pop', 'fr')} + {of('Right', 'var_pop', 'fr')}) / 2 + 1e-8) END, 0) AS pd FROM f GROUP BY {UK}),
pm AS (SELECT *, max(pd) OVER (PARTITION BY session, region) AS top FROM pd),
att AS (
  SELECT {UK}, pd, top, exp(pd - top) / sum(exp(pd - top)) OVER (PARTITION BY session, region) AS attention FROM pm)
"""


def prior(spark, sf):
    ut, sizes = unit_trials(spark, sf)
    return stats.class_moments(ut, sizes).select(*U, stats.prior_dprime(DUR).alias("prior_dprime"))


@query("softmax_prior", DP + PRIOR + f"SELECT {UK}, {r('attention', 'attention')} FROM att")
def softmax_prior(spark, sf):
    return stats.softmax_prior(prior(spark, sf), ["session", "region"], "prior_dprime").select(*U, "attention")


@query("gain_prior", PEARSON + DP[len(BASE):] + PRIOR + f"""
SELECT session, region, unit, {r('coupling * (pd / (top + 1e-8))', 'prediction_gain')} FROM att JOIN cpl USING ({UK})""")
def gain_prior(spark, sf):
    df = prior(spark, sf).join(pearson_psth(spark, sf), U)
    return stats.gain_prior(df, ["session", "region"], "prior_dprime", "coupling").select(*U, "prediction_gain")


@query("minmax", DP + f"""
, t AS (SELECT *, row_number() OVER (PARTITION BY session, region ORDER BY round(rate, 9) DESC, unit) AS rn FROM dp),
k AS (SELECT * FROM t WHERE rn <= 10)
SELECT {UK}, {r('(rate - min(rate) OVER ()) / (max(rate) OVER () - min(rate) OVER () + 1e-8)', 'rate')},
       {r('(d_lr - min(d_lr) OVER ()) / (max(d_lr) OVER () - min(d_lr) OVER () + 1e-8)', 'dprime')} FROM k""")
def minmax(spark, sf):
    """Heat-panel scaling over the top ten units of every region."""
    ut, sizes = unit_trials(spark, sf)
    m = stats.class_moments(ut, sizes).select(*U, stats.mean_rate(DUR).alias("rate"), stats.dprime((1,), (2,), DUR).alias("dprime"))
    top = sel.top_k(m, 10, ["session", "region"], [F.round("rate", 9).desc(), F.col("unit")])
    return stats.minmax_spread(top, ["rate", "dprime"]).select(*U, "rate", "dprime")

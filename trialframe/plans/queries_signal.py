"""Signal queries: every embedding is a 64-point trace of 10 ms bins, its label modulo three the class."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import signal as S
from ..operators import spectral as SP
from ..schema import CLASSES
from . import binding as B
from .registry import kruskal_sql, query, r, sig

N, DT = 64, 0.01
BANDS = {"slow": (1.0, 4.0), "theta": (4.0, 12.0), "beta": (12.0, 30.0)}
SCALO_FREQS = [2.0, 5.0, 10.0, 20.0, 30.0]
N_FREQ = 8


def traces(spark, sf):
    e = B.table(spark, sf, "embeddings")
    label = F.get(F.array(*[F.lit(c) for c in CLASSES]), F.pmod("label", F.lit(3)).cast("int"))
    return e.select(
        "vec_id", (F.col("vec_id") % 5).alias("unit"), label.alias("label"),
        F.transform("embedding", lambda x: x.cast("double")).alias("x"),
    )


# ---------------------------------------------------------------- the same transforms in SQL

X = """
WITH emb AS (SELECT vec_id, vec_id % 5 AS unit, ['Ignore', 'Left', 'Right'][label % 3 + 1] AS label, embedding AS e FROM embeddings),
x AS (SELECT vec_id, unit, label, i, CAST(e[i + 1] AS DOUBLE) AS v FROM emb, range(64) t(i))
"""


def dbl(v: float) -> str:
    return f"CAST('{float(v)!r}' AS DOUBLE)"


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(v if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


def morlet_sql(freqs, dt: float = DT, n: int = N, name: str = "ker") -> str:
    """Wavelet taps by frequency and lag, from the Morlet formula."""
    half, m = K.MORLET_HALF, K.MORLET_SAMPLES
    grid = np.linspace(-half, half, m)
    rows = values([(i, dbl(f), dbl(K.MORLET_C / (f * dt))) for i, f in enumerate(freqs)])
    return f"""
, fr(fi, f, sc) AS (VALUES {rows}),
psi AS (SELECT i, -8 + i * {dbl(grid[1] - grid[0])} AS z FROM range({m}) t(i)),
psw AS (SELECT i, exp(-z * z / 1.5) / sqrt(pi() * 1.5) AS a, z FROM psi),
ip AS (SELECT i, sum(a * cos(2 * pi() * z)) OVER (ORDER BY i) * {dbl(grid[1] - grid[0])} AS re,
              -sum(a * sin(2 * pi() * z)) OVER (ORDER BY i) * {dbl(grid[1] - grid[0])} AS im FROM psw),
mm AS (SELECT fi, f, sc, unnest(range(CAST(ceil(sc * 16 + 1) AS BIGINT))) AS m FROM fr),
jj AS (SELECT fi, f, sc, m, CAST(floor(m / (sc * {dbl(grid[1] - grid[0])})) AS BIGINT) AS j FROM mm),
kk AS (SELECT fi, f, sc, m, j, count(*) OVER (PARTITION BY fi) AS len FROM jj WHERE j < {m}),
tap AS (SELECT fi, len - 1 - m AS p, re, im FROM kk JOIN ip ON ip.i = kk.j),
fl AS (SELECT DISTINCT fi, f, sc, len, (len - 2) // 2 AS c FROM kk),
lg AS (SELECT fi, f, sc, c, lag FROM fl, range(-{n - 1}, {n}) t(lag)),
{name} AS (
  SELECT lg.fi, lg.f, lg.lag, -sqrt(lg.sc) * (coalesce(a.re, 0) - coalesce(b.re, 0)) AS re,
         -sqrt(lg.sc) * (coalesce(a.im, 0) - coalesce(b.im, 0)) AS im
  FROM lg LEFT JOIN tap a ON a.fi = lg.fi AND a.p = lg.lag + lg.c + 1 LEFT JOIN tap b ON b.fi = lg.fi AND b.p = lg.lag + lg.c)
"""


def conv_sql(src: str, key: str, out: str) -> str:
    """Squared wavelet coefficients of every trace, frequency and bin."""
    return f"""
, {out} AS (
  SELECT {', '.join('s.' + k for k in key.split(', '))}, k.fi, k.f, g.t, sum(s.v * k.re) ** 2 + sum(s.v * k.im) ** 2 AS pw
  FROM {src} s, range({N}) g(t) JOIN ker k ON k.lag = g.t - s.i GROUP BY ALL)
"""


SMOOTH = """
, tp AS (SELECT k - 8 AS off, exp(-0.5 * ((k - 8) / 2.0) ** 2) AS w FROM range(17) t(k)),
tn AS (SELECT off, w / sum(w) OVER () AS w FROM tp),
sm AS (
  SELECT x.vec_id, x.unit, x.label, g.t AS i, sum(y.v * tn.w) AS v
  FROM (SELECT DISTINCT vec_id, unit, label FROM x) x, range(64) g(t), tn
  JOIN x y ON y.vec_id = x.vec_id AND y.i = greatest(0, least(63, g.t + tn.off)) GROUP BY ALL)
"""

BOX = """
, bx AS (
  SELECT a.vec_id, a.unit, a.label, a.i, sum(b.v) / 5 AS v
  FROM x a JOIN x b ON b.vec_id = a.vec_id AND b.i BETWEEN a.i - 2 AND a.i + 2 GROUP BY ALL)
"""


@query("smooth_gauss", X + SMOOTH + f"SELECT vec_id, i, {r('v', 'v')} FROM sm")
def smooth_gauss(spark, sf):
    return traces(spark, sf).select("vec_id", F.posexplode(S.gaussian_smooth(F.col("x"), 2.0)).alias("i", "v"))


@query("smooth_box", X + BOX + f"SELECT vec_id, i, {r('v', 'v')} FROM bx")
def smooth_box(spark, sf):
    return traces(spark, sf).select("vec_id", F.posexplode(S.box_smooth(F.col("x"))).alias("i", "v"))


@query("resample", X + f"""
, g AS (SELECT i, i * 63.0 / 39 AS p, CAST(floor(i * 63.0 / 39) AS BIGINT) AS lo FROM range(40) t(i))
SELECT a.vec_id, g.i, {r('a.v + (b.v - a.v) * (g.p - g.lo)', 'v')}
FROM g JOIN x a ON a.i = g.lo JOIN x b ON b.vec_id = a.vec_id AND b.i = least(63, g.lo + 1)""")
def resample(spark, sf):
    return traces(spark, sf).select("vec_id", F.posexplode(S.resample(F.col("x"), 40)).alias("i", "v"))


@query("context_truncation", X + f"SELECT vec_id, {r('sum(CASE WHEN i >= 44 THEN v END)', 'last_sum')}, {r('sum(CASE WHEN i < 24 THEN v END)', 'first_sum')} FROM x GROUP BY vec_id")
def context_truncation(spark, sf):
    """Only the last 20 bins, and only the first 24."""

    def total(a):
        return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)

    return traces(spark, sf).select(
        "vec_id", total(S.keep_last(F.col("x"), 20)).alias("last_sum"), total(S.keep_first(F.col("x"), 24)).alias("first_sum")
    )


# ---------------------------------------------------------------- band power

BAND_FREQS = [(b, f) for b, (lo, hi) in enumerate(BANDS.values()) for f in K.band_frequencies(lo, hi)]
CWT_BAND = (
    X + SMOOTH
    + ", ms AS (SELECT vec_id, unit, label, i, v / 0.01 - avg(v / 0.01) OVER (PARTITION BY vec_id) AS v FROM sm)"
    + morlet_sql([f for _, f in BAND_FREQS])
    + conv_sql("ms", "vec_id, unit, label", "cw")
    + f""", bp AS (
  SELECT vec_id, unit, label, fi // 6 AS band_idx, avg(m) AS power
  FROM (SELECT vec_id, unit, label, fi, avg(pw) AS m FROM cw WHERE t >= {int(0.1 * N)} AND t < {int(0.9 * N)} GROUP BY ALL) GROUP BY ALL)
"""
)


def band_powers(spark, sf):
    return traces(spark, sf).withColumn("power", S.band_power_cwt(F.col("x"), DT, BANDS, 2.0))


@query("cwt_band", CWT_BAND + f"SELECT vec_id, band_idx, {r('power', 'power')} FROM bp")
def cwt_band(spark, sf):
    return band_powers(spark, sf).select("vec_id", F.posexplode("power").alias("band_idx", "power"))


SEL_A = CWT_BAND + f", rows_v AS (SELECT unit, band_idx, label, {sig('power')} AS v FROM bp)" + kruskal_sql("rows_v", "unit, band_idx")


@query("spectral_selectivity_a", SEL_A + f"""
, pb AS (SELECT unit, band_idx, CASE WHEN df = 2 THEN exp(-h / 2) END AS p FROM kw)
SELECT unit, {r('min(p)', 'p_spectral')}, ['slow', 'theta', 'beta'][arg_min(band_idx, p) + 1] AS spectral_band FROM pb GROUP BY unit""")
def spectral_selectivity_a(spark, sf):
    powers = band_powers(spark, sf)
    sizes = powers.groupBy("unit").agg(*[F.count_if(F.col("label") == c).alias(f"n_{i}") for i, c in enumerate(CLASSES)])
    names = list(BANDS)
    return SP.best_band(SP.band_tests(SP.band_histogram(powers, sizes, ["unit"], names), ["unit"]), ["unit"], names)


@query("band_tests", SEL_A + f"SELECT unit, band_idx, {r('h', 'h')}, CAST(df AS BIGINT) AS df FROM kw")
def band_tests(spark, sf):
    """Rank test of every band, values ordered by buckets."""
    powers = band_powers(spark, sf)
    sizes = powers.groupBy("unit").agg(*[F.count_if(F.col("label") == c).alias(f"n_{i}") for i, c in enumerate(CLASSES)])
    return SP.band_tests(SP.band_histogram(powers, sizes, ["unit"], list(BANDS)), ["unit"]).drop("p")


@query("band_power_by_class", CWT_BAND + f"""
, up AS (SELECT unit, label, band_idx, avg(power) AS m FROM bp GROUP BY ALL)
SELECT label, ['slow', 'theta', 'beta'][band_idx + 1] AS band, {r('avg(ln(1 + m))', 'mean')},
       {r('stddev_pop(ln(1 + m)) / sqrt(count(*))', 'sem')}, count(*) AS n_units FROM up GROUP BY label, band_idx""")
def band_power_by_class(spark, sf):
    per_unit = SP.mean_power(band_powers(spark, sf), ["unit", "label"])
    return SP.band_power_by_class(per_unit, [], list(BANDS))


# 300 ms window, hop one bin, mirrored ends; one entry per frequency inside a band
STFT_KS = [(b, k) for b, (lo, hi) in enumerate(BANDS.values()) for k in range(16) if lo <= k / 0.3 < hi]
STFT = X + f"""
, mx AS (SELECT vec_id, i, v - avg(v) OVER (PARTITION BY vec_id) AS v FROM x),
kf(band_idx, k) AS (VALUES {values(STFT_KS)}),
ref AS (
  SELECT t, m, CASE WHEN t + m - 15 < 0 THEN 15 - t - m WHEN t + m - 15 > 63 THEN 126 - (t + m - 15) ELSE t + m - 15 END AS u,
         (0.5 - 0.5 * cos(2 * pi() * m / 30)) / 15 AS w FROM range(65) a(t), range(30) b(m)),
z AS (
  SELECT vec_id, band_idx, k, t, sum(v * w * cos(2 * pi() * k * m / 30)) ** 2 + sum(v * w * sin(2 * pi() * k * m / 30)) ** 2 AS pw
  FROM mx JOIN ref ON ref.u = mx.i CROSS JOIN kf GROUP BY ALL),
zb AS (SELECT vec_id, band_idx, t, avg(pw) AS pw FROM z GROUP BY ALL),
g AS (SELECT i, i * 64.0 / 63 AS p, CAST(floor(i * 64.0 / 63) AS BIGINT) AS lo FROM range(64) q(i)),
st AS (
  SELECT a.vec_id, a.band_idx, g.i, a.pw + (b.pw - a.pw) * (g.p - g.lo) AS pw
  FROM g JOIN zb a ON a.t = g.lo JOIN zb b ON b.vec_id = a.vec_id AND b.band_idx = a.band_idx AND b.t = least(64, g.lo + 1))
"""


@query("stft_band", STFT + f"SELECT vec_id, band_idx, i, {r('pw', 'power')} FROM st")
def stft_band(spark, sf):
    bands = traces(spark, sf).withColumn("p", S.band_power_stft(F.col("x"), DT, BANDS))
    rows = bands.select("vec_id", F.posexplode("p").alias("band_idx", "row"))
    return rows.select("vec_id", "band_idx", F.posexplode("row").alias("i", "power"))


SCALO = (
    X + ", ms AS (SELECT vec_id, i, v - avg(v) OVER (PARTITION BY vec_id) AS v FROM x)"
    + morlet_sql(SCALO_FREQS) + conv_sql("ms", "vec_id", "cw")
)


@query("cwt_scalogram", SCALO + f"SELECT vec_id, fi, {r('avg(pw)', 'mean_power')}, {r('max(pw)', 'peak')}, {r('max(CASE WHEN t = 32 THEN pw END)', 'centre')} FROM cw GROUP BY vec_id, fi")
def cwt_scalogram(spark, sf):
    maps = traces(spark, sf).withColumn("p", S.cwt_scalogram(F.col("x"), DT, SCALO_FREQS))
    rows = maps.select("vec_id", F.posexplode("p").alias("fi", "row"))
    mean = F.aggregate("row", F.lit(0.0), lambda s, v: s + v) / F.size("row")
    return rows.select("vec_id", "fi", mean.alias("mean_power"), F.array_max("row").alias("peak"), F.get("row", F.lit(32)).alias("centre"))


@query("scalogram_range", SCALO + f"""
, lp AS (SELECT vec_id, log10(pw + 1e-6) AS v FROM cw WHERE t >= 6 AND t < 57)
SELECT vec_id, {r('quantile_cont(v, 0.05)', 'vmin')}, {r('quantile_cont(v, 0.98)', 'vmax')} FROM lp GROUP BY vec_id""")
def scalogram_range(spark, sf):
    maps = traces(spark, sf).withColumn("p", S.cwt_scalogram(F.col("x"), DT, SCALO_FREQS))
    return SP.scalogram_range(maps, ["vec_id"], "p")


# ---------------------------------------------------------------- magnitude maps

FREQS = [float(f) for f in K.power_frequencies(N_FREQ)]
WMAG = X + BOX + morlet_sql(FREQS) + conv_sql("bx", "vec_id, unit, label", "cw")
ZSTFT = """
, rf AS (SELECT t, m, t * 8 + m - 8 AS u, (0.5 - 0.5 * cos(2 * pi() * m / 16)) / 8 AS w FROM range(9) a(t), range(16) b(m)),
zm AS (
  SELECT vec_id, k, t, sqrt(sum(v * w * cos(2 * pi() * k * m / 16)) ** 2 + sum(v * w * sin(2 * pi() * k * m / 16)) ** 2) AS mag
  FROM bx JOIN rf ON rf.u = bx.i CROSS JOIN range(9) c(k) GROUP BY ALL),
fg AS (SELECT i, i * 8.0 / 7 AS p, CAST(floor(i * 8.0 / 7) AS BIGINT) AS lo FROM range(8) q(i)),
zf AS (
  SELECT a.vec_id, fg.i AS fi, a.t, a.mag + (b.mag - a.mag) * (fg.p - fg.lo) AS mag
  FROM fg JOIN zm a ON a.k = fg.lo JOIN zm b ON b.vec_id = a.vec_id AND b.t = a.t AND b.k = least(8, fg.lo + 1)),
tg AS (SELECT i, i * 8.0 / 63 AS p, CAST(floor(i * 8.0 / 63) AS BIGINT) AS lo FROM range(64) q(i)),
zt AS (
  SELECT a.vec_id, a.fi, tg.i AS t, a.mag + (b.mag - a.mag) * (tg.p - tg.lo) AS mag
  FROM tg JOIN zf a ON a.t = tg.lo JOIN zf b ON b.vec_id = a.vec_id AND b.fi = a.fi AND b.t = least(8, tg.lo + 1))
"""


def per_row(df, name="m"):
    rows = df.select("vec_id", F.posexplode(name).alias("fi", "row"))
    mean = F.aggregate("row", F.lit(0.0), lambda s, v: s + v) / F.size("row")
    return rows.select("vec_id", "fi", mean.alias("mean_mag"), F.array_max("row").alias("peak"))


@query("wavelet_mag", WMAG + f"SELECT vec_id, fi, {r('avg(sqrt(pw))', 'mean_mag')}, {r('max(sqrt(pw))', 'peak')} FROM cw GROUP BY vec_id, fi")
def wavelet_mag(spark, sf):
    return per_row(traces(spark, sf).withColumn("m", S.wavelet_magnitude(F.col("x"), DT, N_FREQ)))


@query("stft_mag", X + BOX + ZSTFT + f"SELECT vec_id, fi, {r('avg(mag)', 'mean_mag')}, {r('max(mag)', 'peak')} FROM zt GROUP BY vec_id, fi")
def stft_mag(spark, sf):
    return per_row(traces(spark, sf).withColumn("m", S.stft_magnitude(F.col("x"), N_FREQ)))


@query("tf_mean", WMAG + ZSTFT + f"""
SELECT cw.vec_id, cw.fi, {r('avg(0.5 * (sqrt(pw) + mag))', 'mean_mag')}, {r('max(0.5 * (sqrt(pw) + mag))', 'peak')}
FROM cw JOIN zt ON zt.vec_id = cw.vec_id AND zt.fi = cw.fi AND zt.t = cw.t GROUP BY cw.vec_id, cw.fi""")
def tf_mean(spark, sf):
    df = traces(spark, sf)
    return per_row(df.withColumn("m", S.mean_map(S.wavelet_magnitude(F.col("x"), DT, N_FREQ), S.stft_magnitude(F.col("x"), N_FREQ))))


IN_BAND = ", ".join(str(i) for i in S.band_rows(N_FREQ, 12.0, 45.0))


@query("band_energy", WMAG + f"SELECT vec_id, {r('avg(sqrt(pw))', 'energy')} FROM cw WHERE fi IN ({IN_BAND}) GROUP BY vec_id")
def band_energy(spark, sf):
    df = traces(spark, sf).withColumn("m", S.wavelet_magnitude(F.col("x"), DT, N_FREQ))
    return df.select("vec_id", S.band_energy(F.col("m"), N_FREQ, 12.0, 45.0).alias("energy"))


FREQS12 = [float(f) for f in K.power_frequencies(12)]
IN_BAND12 = ", ".join(str(i) for i in S.band_rows(12, 12.0, 45.0))
TF_SEL = (
    X.rstrip() + ", mt AS (SELECT unit, label, i, avg(v) AS v FROM x GROUP BY ALL)"
    + ", bt AS (SELECT a.unit, a.label, a.i, sum(b.v) / 5 AS v FROM mt a JOIN mt b ON b.unit = a.unit AND b.label = a.label AND b.i BETWEEN a.i - 2 AND a.i + 2 GROUP BY ALL)"
    + morlet_sql(FREQS12) + conv_sql("bt", "unit, label", "cw")
    + f", en AS (SELECT unit, label, avg(sqrt(pw)) AS e FROM cw WHERE fi IN ({IN_BAND12}) GROUP BY unit, label)"
)


def e_of(label: str) -> str:
    return f"coalesce(max(CASE WHEN label = '{label}' THEN e END), 0)"


@query("spectral_selectivity_b", TF_SEL + f"""
SELECT unit, {r(f"abs({e_of('Right')} - {e_of('Ignore')}) + 0.4 * abs({e_of('Left')} - 0.5 * ({e_of('Right')} + {e_of('Ignore')}))", 'tf_selectivity')}
FROM en GROUP BY unit""")
def spectral_selectivity_b(spark, sf):
    rows = traces(spark, sf).select("unit", "label", F.posexplode("x").alias("i", "v"))
    means = rows.groupBy("unit", "label", "i").agg(F.avg("v").alias("v"))
    # 64 points per unit and class
    packed = means.groupBy("unit", "label").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("p"))
    by_class = packed.select("unit", "label", F.transform("p", lambda s: s["v"]).alias("trace"))
    return SP.tf_selectivity_b(by_class, ["unit"], "trace", DT)

"""Windows, binning and raster queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import epochs as ep
from ..functions import signal as S
from ..operators import raster as R
from ..operators import stats
from ..operators.skew import attach
from ..schema import UNIT, Windows
from . import binding as B
from .registry import BASE, b, query, r

U = list(UNIT)
UK = "session, region, unit"


def base(spark, sf):
    sp = B.spikes(spark, sf)
    tr = B.trials(sp)
    return sp, tr, B.units(sp)


def counts(spark, sf):
    sp, tr, un = base(spark, sf)
    binned = B.binned(sp, tr)
    return binned, tr, un


def unit_trials(spark, sf):
    binned, tr, un = counts(spark, sf)
    return R.unit_trial_counts(binned, B.N_CTX, B.LATE), R.unit_sizes(un, tr)


# ---------------------------------------------------------------- windows

# Day-level epochs derived from the trial: sample starts with the first lick before go where there is one.
EPOCH_SQL = """
, ep AS (
  SELECT t.session, t.trial, min(CASE WHEN l.t < 43200 THEN l.t END) AS sample_start,
         CASE WHEN n_early % 2 = 0 THEN 30000.0 END AS delay_start,
         CASE WHEN n_early % 3 <> 0 THEN 43200.0 END AS delay_stop,
         43200.0 AS go, min(l.t) FILTER (l.side = 'Left') AS left_min, min(l.t) FILTER (l.side = 'Right') AS right_min,
         min(l.t) FILTER (l.t >= 43200) AS after_go, 43200.0 + 3600.0 * (n_left + 1) AS trial_stop
  FROM trials t LEFT JOIN licks l ON l.session = t.session AND l.trial = t.trial
  GROUP BY t.session, t.trial, n_early, n_left)
"""


def epochs(spark, sf):
    tr = B.trials(B.spikes(spark, sf))
    pre = F.least("left_min", "right_min")
    return tr.select(
        "session", "trial", "left_min", "right_min", "first_after_go",
        F.when(pre < B.GO, pre).alias("sample_start"),
        F.when(F.col("n_early") % 2 == 0, 30000.0).alias("delay_start"),
        F.when(F.col("n_early") % 3 != 0, 43200.0).alias("delay_stop"),
        F.lit(B.GO).alias("go"),
        (F.lit(B.GO) + 3600.0 * (F.col("n_left") + 1)).alias("trial_stop"),
    )


DAY = Windows(bin_s=B.CTX_BIN, target_bin_s=B.TGT_BIN, include_sample=True, response_s=41400.0, lick_window_s=7200.0)


@query("win_context_a", BASE + EPOCH_SQL + f""", w AS (
  SELECT session, trial, CASE WHEN delay_start IS NOT NULL THEN coalesce(sample_start, delay_start) END AS a, go AS z FROM ep)
SELECT session, trial, {r('a', 'ctx_start')}, {r('z', 'ctx_stop')}, {b('round_even((z - a) / 1800, 0)', 'n_ctx')} FROM w""")
def win_context_a(spark, sf):
    c = F.col
    start, stop, n = ep.context_window(c("sample_start"), c("delay_start"), c("go"), DAY)
    return epochs(spark, sf).select("session", "trial", start.alias("ctx_start"), stop.alias("ctx_stop"), n.alias("n_ctx"))


@query("win_target_a", BASE + EPOCH_SQL + f"""
SELECT session, trial, {r('go', 'tgt_start')}, {r('go + 41400', 'tgt_stop')},
       {b('round_even(41400.0 / 3600, 0)', 'n_tgt')} FROM ep""")
def win_target_a(spark, sf):
    start, stop, n = ep.target_window(F.col("go"), DAY)
    return epochs(spark, sf).select("session", "trial", start.alias("tgt_start"), stop.alias("tgt_stop"), n.alias("n_tgt"))


DELAY_SQL = """
, d AS (
  SELECT *, CASE WHEN coalesce(delay_stop > delay_start, false) THEN delay_start ELSE coalesce(sample_start, 0.0) END AS d0,
         CASE WHEN coalesce(delay_stop > delay_start, false) THEN delay_stop ELSE go END AS d1 FROM ep),
lw AS (
  SELECT *, coalesce(CASE WHEN left_min IS NULL THEN right_min WHEN right_min IS NULL THEN left_min
                          ELSE least(left_min, right_min) END, go) AS l0 FROM d)
"""


def delay(df):
    c = F.col
    return ep.delay_window_b(c("delay_start"), c("delay_stop"), c("sample_start"), F.lit(None).cast("double"), c("go"))


@query("win_delay_b", BASE + EPOCH_SQL + DELAY_SQL + f"SELECT session, trial, {r('d0', 'delay_from')}, {r('d1', 'delay_to')} FROM d")
def win_delay_b(spark, sf):
    df = epochs(spark, sf)
    start, stop = delay(df)
    return df.select("session", "trial", start.alias("delay_from"), stop.alias("delay_to"))


@query("win_lick_b", BASE + EPOCH_SQL + DELAY_SQL + f"""
SELECT session, trial, {r('l0', 'lick_from')},
       {r('CASE WHEN least(l0 + 7200, trial_stop) <= l0 THEN l0 + 7200 ELSE least(l0 + 7200, trial_stop) END', 'lick_to')}
FROM lw""")
def win_lick_b(spark, sf):
    df = epochs(spark, sf)
    first, _ = ep.first_lick_b(F.col("left_min"), F.col("right_min"))
    start, stop = ep.lick_window_b(first, F.col("go"), delay(df)[1], F.col("trial_stop"), DAY.lick_window_s)
    return df.select("session", "trial", start.alias("lick_from"), stop.alias("lick_to"))


@query("first_lick_a", BASE + EPOCH_SQL + f"SELECT session, trial, {r('after_go - go', 'first_lick_s')} FROM ep")
def first_lick_a(spark, sf):
    return epochs(spark, sf).select("session", "trial", (F.col("first_after_go") - F.col("go")).alias("first_lick_s"))


@query("first_lick_b", BASE + EPOCH_SQL + f"""
SELECT session, trial,
       {r('CASE WHEN left_min IS NULL THEN right_min WHEN right_min IS NULL THEN left_min ELSE least(left_min, right_min) END', 'first_lick')},
       CASE WHEN left_min IS NULL AND right_min IS NULL THEN NULL
            WHEN right_min IS NULL OR left_min <= right_min THEN 'Left' ELSE 'Right' END AS side FROM ep""")
def first_lick_b(spark, sf):
    t, side = ep.first_lick_b(F.col("left_min"), F.col("right_min"))
    return epochs(spark, sf).select("session", "trial", t.alias("first_lick"), side.alias("side"))


@query("epoch_spans", BASE + EPOCH_SQL + DELAY_SQL + f"""
, sp AS (
  SELECT session, trial, unnest([
    {{'e': 'trial', 'a': 0.0, 'z': trial_stop}}, {{'e': 'presample', 'a': 0.0, 'z': 0.0}},
    {{'e': 'sample', 'a': coalesce(sample_start, 0.0), 'z': 0.0}}, {{'e': 'delay', 'a': d0, 'z': d1}},
    {{'e': 'go', 'a': go, 'z': trial_stop}},
    {{'e': 'lick', 'a': l0, 'z': CASE WHEN least(l0 + 7200, trial_stop) <= l0 THEN l0 + 7200 ELSE least(l0 + 7200, trial_stop) END}}]) AS s
  FROM lw)
SELECT session, trial, s.e AS epoch, {r('s.a', 'epoch_start')}, {r('s.z', 'epoch_stop')} FROM sp""")
def epoch_spans(spark, sf):
    df = epochs(spark, sf)
    c, none = F.col, F.lit(None).cast("double")
    cols = {
        "trial_start": none, "trial_stop": c("trial_stop"), "presample_start_times": none, "presample_stop_times": none,
        "sample_start_times": c("sample_start"), "sample_stop_times": none, "go_start_times": c("go"), "go_stop_times": none,
    }
    first, _ = ep.first_lick_b(c("left_min"), c("right_min"))
    d = delay(df)
    lick = ep.lick_window_b(first, c("go"), d[1], c("trial_stop"), DAY.lick_window_s)
    return df.select("session", "trial", F.inline(ep.epoch_spans(cols, d, lick)))


# ---------------------------------------------------------------- joins and bins


@query("join_spike_window", BASE + """
SELECT s.session, s.region, s.unit, s.trial, count(*) AS n
FROM spikes s JOIN labelled l ON s.session = l.session AND s.trial = l.trial
WHERE s.t >= 43200 AND s.t < 50400 GROUP BY ALL""")
def join_spike_window(spark, sf):
    sp, tr, _ = base(spark, sf)
    dims = tr.select("session", "trial", "go", (F.col("go") + 7200.0).alias("stop"))
    return R.spikes_in_window(sp, dims, "go", "stop").groupBy(*U, "trial").agg(F.count("*").alias("n"))


@query("join_zero_fill", BASE + """
SELECT u.session, u.region, u.unit, l.trial, l.label, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS n
FROM units u JOIN labelled l ON u.session = l.session
LEFT JOIN cells c ON c.session = u.session AND c.unit = u.unit AND c.trial = l.trial AND c.win = 'ctx' GROUP BY ALL""")
def join_zero_fill(spark, sf):
    binned, tr, un = counts(spark, sf)
    n = binned.where("win = 'ctx'").groupBy(*U, "trial").agg(F.sum("n").alias("n"))
    return R.dense_counts(n, un, tr)


@query("bin_a", BASE + "SELECT session, region, unit, trial, win, CAST(bin AS BIGINT) AS bin, n FROM cells")
def bin_a(spark, sf):
    return counts(spark, sf)[0].drop("label")


@query("bin_b", BASE + """
, w AS (SELECT session, trial, 43200.0 AS t0, 43200.0 + 9000.0 * (n_left + n_right) AS t1 FROM trials),
e AS (
  SELECT s.session, s.region, s.unit, s.trial,
         least(CAST(floor((s.t - t0) / ((t1 - t0) / 10)) AS BIGINT), 9) AS bin
  FROM spikes s JOIN w ON s.session = w.session AND s.trial = w.trial WHERE t1 > t0 AND s.t >= t0 AND s.t < t1)
SELECT session, region, unit, trial, bin, count(*) AS n FROM e GROUP BY ALL""")
def bin_b(spark, sf):
    sp, tr, _ = base(spark, sf)
    dims = tr.select("session", "trial", "go", (F.col("go") + 9000.0 * (F.col("n_left") + F.col("n_right"))).alias("stop"))
    j = R.with_trials(sp, dims)
    bin_ = R.bin_fixed_count(F.col("t"), F.col("go"), F.col("stop"), F.lit(10))
    return j.withColumn("bin", bin_).where("bin IS NOT NULL").groupBy(*U, "trial", "bin").agg(F.count("*").alias("n"))


@query("bin_full", BASE + """
, w AS (SELECT session, trial, 43200.0 + 3600.0 * (n_left + 1) + 7 AS stop FROM trials),
x AS (SELECT *, ceil(stop / 1800) AS nb FROM w),
e AS (
  SELECT s.session, s.region, s.trial, least(CAST(floor(s.t / (stop / nb)) AS BIGINT), CAST(nb - 1 AS BIGINT)) AS bin
  FROM spikes s JOIN x ON s.session = x.session AND s.trial = x.trial WHERE s.t >= 0 AND s.t < stop)
SELECT session, region, trial, bin, count(*) AS n FROM e GROUP BY ALL""")
def bin_full(spark, sf):
    sp, tr, _ = base(spark, sf)
    dims = tr.select("session", "trial", (F.lit(B.GO) + 3600.0 * (F.col("n_left") + 1) + 7).alias("stop"))
    zero = F.lit(0.0)
    n = R.full_trial_bins(zero, F.col("stop"), B.CTX_BIN)
    j = R.with_trials(sp, dims).withColumn("bin", R.bin_fixed_count(F.col("t"), zero, F.col("stop"), n))
    return j.where("bin IS NOT NULL").groupBy("session", "region", "trial", "bin").agg(F.count("*").alias("n"))


@query("empty_trial", BASE + """
SELECT l.session, l.trial, l.label FROM labelled l
WHERE EXISTS (SELECT 1 FROM cells c WHERE c.session = l.session AND c.trial = l.trial AND c.win = 'ctx')""")
def empty_trial(spark, sf):
    binned, tr, _ = counts(spark, sf)
    return R.nonempty_trials(binned, tr)


# ---------------------------------------------------------------- unit aggregates

SEC = "43200.0"


@query("unit_rate", BASE + f"SELECT {UK}, trial, {r(f'ctx / {SEC}', 'rate_hz')}, {b('ctx', 'n')} FROM ut")
def unit_rate(spark, sf):
    """Every unit and labelled trial, silent ones as zero: the grid is the result."""
    binned, tr, un = counts(spark, sf)
    rows = R.dense_counts(R.unit_trial_counts(binned, B.N_CTX, B.LATE), un, tr.where("label IS NOT NULL"), "ctx")
    return rows.select(*U, "trial", (F.col("ctx") / 43200.0).alias("rate_hz"), F.col("ctx").alias("n"))


@query("active_fraction", BASE + f"SELECT {UK}, {r('avg(CASE WHEN ctx > 0 THEN 1.0 ELSE 0.0 END)', 'active_frac')} FROM ut GROUP BY {UK}")
def active_fraction(spark, sf):
    ut, sizes = unit_trials(spark, sf)
    return stats.class_moments(ut, sizes).select(*U, stats.active_fraction().alias("active_frac"))


@query("late_rate", BASE + f"""
SELECT {UK}, {r('avg(late / 14400.0) * 1000', 'late_rate_mhz')}, {r('avg(tgt / 43200.0) * 1000', 'response_rate_mhz')}
FROM ut GROUP BY {UK}""")
def late_rate(spark, sf):
    ut, sizes = unit_trials(spark, sf)
    late = stats.class_moments(ut, sizes, "late").select(*U, (stats.mean_rate(14400.0) * 1000).alias("late_rate_mhz"))
    resp = stats.class_moments(ut, sizes, "tgt").select(*U, (stats.mean_rate(43200.0) * 1000).alias("response_rate_mhz"))
    return late.join(resp, U)


@query("psth", BASE + f"""
SELECT {UK}, win, {b('bin', 'bin')}, {r('sum(n) / n_trials', 'mean_count')}
FROM cells JOIN sizes USING (session) WHERE label IS NOT NULL GROUP BY {UK}, win, bin, n_trials""")
def psth(spark, sf):
    binned, tr, un = counts(spark, sf)
    return R.psth(binned, R.unit_sizes(un, tr))


@query("psth_by_class", BASE + f"""
SELECT {UK}, label, win, {b('bin', 'bin')},
       {r("sum(n) / CASE label WHEN 'Ignore' THEN n_0 WHEN 'Left' THEN n_1 ELSE n_2 END", 'mean_count')}
FROM cells JOIN sizes USING (session) WHERE label IS NOT NULL GROUP BY {UK}, label, win, bin, n_0, n_1, n_2""")
def psth_by_class(spark, sf):
    binned, tr, un = counts(spark, sf)
    return R.psth(binned, R.unit_sizes(un, tr), by_class=True)


CLASS_MEANS = ", ".join(
    r(f"1000 * avg(CASE WHEN label = '{c}' THEN ctx / {SEC} END)", f"mean_rate_{c}") for c in ("Ignore", "Left", "Right")
)


@query("class_mean_rate", BASE + f"SELECT {UK}, {CLASS_MEANS} FROM ut GROUP BY {UK}")
def class_mean_rate(spark, sf):
    """Mean context rate (mHz) per unit and class, zeros included."""
    ut, sizes = unit_trials(spark, sf)
    m = stats.class_moments(ut, sizes)
    cols = [(stats.mean_rate(43200.0, i) * 1000).alias(f"mean_rate_{c}") for i, c in enumerate(("Ignore", "Left", "Right"))]
    return m.select(*U, *cols)


@query("population_trace", BASE + f"""
, nu AS (SELECT session, region, count(*) AS k FROM units GROUP BY ALL)
SELECT c.session, c.region, c.trial, {b('bin', 'bin')}, {r('sum(n) / k', 'mean_count')}
FROM cells c JOIN nu ON nu.session = c.session AND nu.region = c.region WHERE win = 'ctx'
GROUP BY c.session, c.region, c.trial, bin, k""")
def population_trace(spark, sf):
    binned, _, un = counts(spark, sf)
    return R.population_trace(binned, un)


@query("region_stack", BASE + """
, pos AS (SELECT *, row_number() OVER (PARTITION BY session, region ORDER BY unit) - 1 AS pos FROM units),
g AS (
  SELECT c.session, c.region, c.trial, c.unit, 
         list_transform(range(24), lambda b: coalesce(map_from_entries(list({'k': CAST(bin AS BIGINT), 'v': n}))[b], 0)) AS a
  FROM cells c WHERE win = 'ctx' GROUP BY ALL)
SELECT g.session, g.region, g.trial, pos.pos, array_to_string(a, ',') AS ctx
FROM g JOIN pos ON pos.session = g.session AND pos.region = g.region AND pos.unit = g.unit""")
def region_stack(spark, sf):
    """Raster rows of a region in unit order: position in the stack and the bin counts."""
    binned, _, un = counts(spark, sf)
    rows = R.raster_rows(binned, "ctx", B.N_CTX, [*U, "trial"])
    text = F.array_join(F.transform("counts", lambda x: x.cast("int").cast("string")), ",")
    return rows.join(R.unit_positions(un), U).select("session", "region", "trial", "pos", text.alias("ctx"))


@query("region_totals", BASE + f"""
, nu AS (SELECT session, region, count(*) AS k FROM units GROUP BY ALL)
SELECT c.session, c.region, c.trial, count(DISTINCT unit) AS n_active, {b('sum(n)', 'total')}, {b('any_value(k)', 'n_units')}
FROM cells c JOIN nu ON nu.session = c.session AND nu.region = c.region WHERE win = 'ctx' GROUP BY c.session, c.region, c.trial""")
def region_totals(spark, sf):
    binned, _, un = counts(spark, sf)
    return R.region_totals(binned, un)


@query("unit_crop", BASE + """
, p AS (SELECT *, row_number() OVER (PARTITION BY session, region ORDER BY unit) - 1 AS pos FROM units)
SELECT session, region, unit, pos FROM p WHERE pos < 5""")
def unit_crop(spark, sf):
    return R.crop_units(base(spark, sf)[2], 5)


@query("unit_count_check", BASE + """
, pt AS (SELECT session, region, trial, count(DISTINCT unit) AS n FROM spikes GROUP BY ALL)
SELECT session, region, min(n) AS min_units, max(n) AS max_units FROM pt GROUP BY ALL HAVING min(n) <> max(n)""")
def unit_count_check(spark, sf):
    sp, _, _ = base(spark, sf)
    return R.unit_count_changes(sp.select(*U, "trial").distinct())


@query("len_fit", BASE + f"""
, x AS (SELECT session, trial, 20 + (n_left + n_right + n_early) % 8 AS nb FROM trials),
f AS (SELECT session, arg_min(nb, trial) AS n FROM x GROUP BY session),
c AS (SELECT session, trial, unit, bin, sum(n) AS n FROM cells WHERE win = 'ctx' GROUP BY ALL)
SELECT c.session, c.unit, c.trial, {b('f.n', 'n_fit')}, {b('sum(CASE WHEN bin < least(f.n, nb) THEN c.n ELSE 0 END)', 'total')}
FROM c JOIN f ON f.session = c.session JOIN x ON x.session = c.session AND x.trial = c.trial
GROUP BY c.session, c.unit, c.trial, f.n""")
def len_fit(spark, sf):
    """Rasters of varying length cropped or padded to the length of the session's first trial."""
    binned, tr, _ = counts(spark, sf)
    sized = tr.select("session", "trial", (20 + (F.col("n_left") + F.col("n_right") + F.col("n_early")) % 8).cast("int").alias("nb"))
    first = sized.groupBy("session").agg(F.min_by("nb", "trial").alias("n_fit"))
    rows = R.raster_rows(binned, "ctx", B.N_CTX, [*U, "trial"])
    j = attach(rows, attach(sized, first, ["session"], ["trial"]), ["session", "trial"], ["unit"], how="inner")
    cut = F.slice(F.transform("counts", lambda x: x.cast("int")), F.lit(1), F.least(F.col("nb"), F.lit(B.N_CTX)))
    fitted = S.fit_length(cut, F.col("n_fit"))
    total = F.aggregate(fitted, F.lit(0), lambda s, x: s + x)
    return j.withColumn("fit", fitted).select("session", "unit", "trial", F.size("fit").alias("n_fit"), total.alias("total"))


@query("epoch_relative_time", BASE + f"""
SELECT session, unit, trial, {r('min(t - 43200)', 'first_rel')}, {r('max(t - 43200)', 'last_rel')} FROM spikes GROUP BY ALL""")
def epoch_relative_time(spark, sf):
    sp, tr, _ = base(spark, sf)
    rel = F.col("t") - F.col("go")
    j = R.with_trials(sp, tr.select("session", "trial", "go"))
    return j.groupBy("session", "unit", "trial").agg(F.min(rel).alias("first_rel"), F.max(rel).alias("last_rel"))


@query("rate_transforms", BASE + f"""
, g AS (SELECT session, unit, trial, sum(n) AS n, sum(sqrt(n)) AS sq, sum(n / 1800.0 * 1000) AS hz FROM cells WHERE win = 'ctx' GROUP BY ALL)
SELECT session, unit, trial, {r('hz', 'rate_sum')}, {r('sq', 'sqrt_sum')}, {r('ln(1 + n)', 'log_total')} FROM g""")
def rate_transforms(spark, sf):
    binned, _, _ = counts(spark, sf)
    rows = R.raster_rows(binned, "ctx", B.N_CTX, ["session", "unit", "trial"])

    def total(a):
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    return rows.select(
        "session", "unit", "trial", (total(S.rate(F.col("counts"), B.CTX_BIN)) * 1000).alias("rate_sum"),
        total(S.sqrt_counts(F.col("counts"))).alias("sqrt_sum"), F.log1p(total(F.col("counts"))).alias("log_total"),
    )

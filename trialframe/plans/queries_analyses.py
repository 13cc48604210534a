"""Documented follow-up analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signal as S
from ..operators import analyses as A
from ..operators import evaluation as E
from ..operators import models as M
from ..operators import raster as R
from ..operators import selection as sel
from ..operators import summary as SM
from ..operators.lineage import cut
from . import binding as B
from .queries_eval import PRED, WEIGHTS, labelled, metrics_sql, permuted_sql, predictions, weights
from .queries_raster import U, UK, base, counts, unit_trials
from .queries_selection import COMPOSITE, composite
from .queries_signal import X, traces
from .queries_stats import P_SQL
from .registry import BASE, draw_sql, kruskal_sql, query, r


@query("laterality_by_weight", BASE + f"""
, w AS (SELECT region, label, unit % 3 = 0 AS selected, ctx / 10.0 AS w FROM ut)
SELECT label, selected, {r('''sum(CASE WHEN (label = 'Left') = (region = 'ALM_R') THEN w ELSE 0 END)
  - sum(CASE WHEN (label = 'Left') = (region = 'ALM_R') THEN 0 ELSE w END)''', 'laterality')}
FROM w WHERE region IN ('ALM_L', 'ALM_R') GROUP BY label, selected""")
def laterality_by_weight(spark, sf):
    ut, _ = unit_trials(spark, sf)
    w = ut.where("label IS NOT NULL").select("region", "label", (F.col("unit") % 3 == 0).alias("selected"), (F.col("ctx") / 10.0).alias("w"))
    return A.laterality_by_weight(w, [])


@query("transfer_matrix", BASE + f"""
, a AS (SELECT session, trial, region[1:3] AS area, sum(ctx) AS c, sum(tgt) AS t FROM ut GROUP BY ALL)
SELECT x.area AS src, y.area AS dst, count(*) AS n, {r('regr_slope(y.t, x.c)', 'slope')}, {r('regr_r2(y.t, x.c)', 'r2')}
FROM a x JOIN a y ON y.session = x.session AND y.trial = x.trial GROUP BY x.area, y.area""")
def transfer_matrix(spark, sf):
    ut, _ = unit_trials(spark, sf)
    rows = ut.where("label IS NOT NULL").withColumn("area", F.substring("region", 1, 3))
    areas = rows.groupBy("session", "trial", "area").agg(F.sum("ctx").alias("c"), F.sum("tgt").alias("t"))
    # a trial and area without any spike still counts, with zero
    tr = labelled(spark, sf).select("session", "trial", F.explode(F.array(F.lit("ALM"), F.lit("STR"))).alias("area"))
    full = tr.join(areas, ["session", "trial", "area"], "left").fillna(0, ["c", "t"])
    ctx = full.select("session", "trial", "area", F.col("c").cast("double").alias("rate"))
    tgt = full.select("session", "trial", "area", F.col("t").cast("double").alias("rate"))
    return A.transfer_matrix(ctx, tgt, ["ALM", "STR"])


TYPE = "CASE WHEN unit % 11 < 4 THEN 'delay_choice' WHEN unit % 11 < 7 THEN 'delay_ramp' WHEN unit % 11 = 7 THEN 'tonic' ELSE 'lick' END"


def typed(spark, sf):
    rows = composite(spark, sf).where("selected").select(*U)
    return rows.withColumns({"dataset": F.when(F.col("session") % 2 == 0, "A").otherwise("B"), "kind": F.expr(TYPE)})


@query("type_overlap", COMPOSITE + f"""
, t AS (SELECT {TYPE} AS kind, CASE WHEN session % 2 = 0 THEN 'A' ELSE 'B' END AS dataset FROM cb WHERE selected),
k AS (SELECT kind, bool_or(dataset = 'A') AS a, bool_or(dataset = 'B') AS b FROM t GROUP BY kind)
SELECT count(*) FILTER (a AND b) AS n_both, count(*) FILTER (a OR b) AS n_any, {r('count(*) FILTER (a AND b) / count(*) FILTER (a OR b)', 'jaccard')} FROM k""")
def type_overlap(spark, sf):
    return A.type_overlap(typed(spark, sf), "dataset", "kind", "A", "B")


@query("type_overlap_null", COMPOSITE + f"""
, t AS (SELECT session, unit, {TYPE} AS kind, CASE WHEN session % 2 = 0 THEN 'A' ELSE 'B' END AS dataset FROM cb WHERE selected)
""" + permuted_sql("t", "x", "session, unit", "kind", "dataset", 20, 1) + f"""
, k AS (SELECT rep, kind, bool_or(dataset = 'A') AS a, bool_or(dataset = 'B') AS b FROM x GROUP BY rep, kind)
SELECT rep, count(*) FILTER (a AND b) AS n_both, count(*) FILTER (a OR b) AS n_any,
       {r('count(*) FILTER (a AND b) / count(*) FILTER (a OR b)', 'jaccard')} FROM k GROUP BY rep""")
def type_overlap_null(spark, sf):
    return A.type_overlap_null(cut(typed(spark, sf)), "dataset", "kind", "A", "B", ["session", "unit"], 20, seed=1)


@query("centre_of_mass", WEIGHTS + f"""
SELECT region, label, {r('sum(w * (bin + 0.5) * 0.2) / sum(w)', 'centre')}, sum(w * (bin + 0.5) * 0.2) / sum(w) > 0.8 AS is_late FROM w GROUP BY region, label""")
def centre_of_mass(spark, sf):
    return A.centre_of_mass(weights(spark, sf), ["region", "label"], 0.2, 0.8)


BOOTSTRAP = ", ".join(
    f"{r(f'avg({m})', f'{m}_mean')}, {r(f'quantile_cont({m}, 0.025)', f'{m}_low')}, {r(f'quantile_cont({m}, 0.975)', f'{m}_high')}"
    for m in ("accuracy", "balanced_accuracy", "macro_f1")
)


@query("session_bootstrap", PRED + f"""
, s AS (SELECT session, row_number() OVER (ORDER BY {draw_sql(0, 'session')}, session) AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT session FROM p)),
d AS (SELECT rep, {draw_sql(0, 'rep', 'pos')} % n + 1 AS drawn FROM s CROSS JOIN (SELECT unnest(range(200)) AS rep)),
y AS (SELECT d.rep, p.label, p.pred FROM d JOIN s ON s.pos = d.drawn JOIN p ON p.session = s.session)
""" + metrics_sql("y", "rep") + f"SELECT {BOOTSTRAP}, count(*) AS n_replicates FROM y_m")
def session_bootstrap(spark, sf):
    return A.session_bootstrap(predictions(spark, sf), 200, seed=0)


SELECTION_NULL = BASE + f"""
, lab_s AS (SELECT session, trial, label, count(*) OVER (PARTITION BY session) AS nt FROM lab),
pa AS (SELECT session, trial, row_number() OVER (PARTITION BY session ORDER BY {draw_sql(2, 'session', 'trial')}, session, trial) AS pos FROM lab),
pb AS (
  SELECT rep, session, label, row_number() OVER (PARTITION BY session, rep ORDER BY {draw_sql(2, 'rep', 'session', 'trial')}, session, trial) AS pos
  FROM lab CROSS JOIN (SELECT unnest(range(10)) AS rep)),
fake AS (SELECT rep, session, trial, label FROM pa JOIN pb USING (session, pos)),
rows_v AS (
  SELECT f.rep, ut.session, ut.region, ut.unit, f.label, ut.ctx AS v FROM ut JOIN fake f ON f.session = ut.session AND f.trial = ut.trial)
""" + kruskal_sql("rows_v", "rep, session, region, unit") + f"""
, pp AS (SELECT rep, session, region, unit, {P_SQL} AS p FROM kw),
ro AS (
  SELECT *, row_number() OVER (PARTITION BY rep, session ORDER BY p) AS rn, count(*) OVER (PARTITION BY rep, session) AS m
  FROM pp WHERE p IS NOT NULL),
qs AS (
  SELECT *, least(1, min(p * m / rn) OVER (PARTITION BY rep, session ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM ro),
floors AS (
  SELECT session, region, unit FROM ut GROUP BY ALL
  HAVING sum(ctx) / count(*) / 43200.0 >= 1e-5 AND count(*) FILTER (ctx > 0) / count(*) >= 0.2),
placed AS (
  SELECT qs.*, row_number() OVER (PARTITION BY rep, session, region ORDER BY round(q, 9), unit) AS rank
  FROM qs SEMI JOIN floors USING (session, region, unit) WHERE q < 0.9)
SELECT rep, session, region, unit, {r('p', 'p')}, {r('q', 'q')}, rank FROM placed WHERE rank <= 4"""


@query("selection_null", SELECTION_NULL)
def selection_null(spark, sf):
    """Units that the selection keeps under ten within-session label permutations."""
    binned, tr, un = counts(spark, sf)
    ut = cut(R.unit_trial_counts(binned, B.N_CTX, B.LATE))
    return A.selection_null(
        ut, un, tr, 10, seed=2, duration=B.GO, min_rate=1e-5, min_active=0.2, fdr_q=0.9, top_k=4)


TRANSFER = BASE + """
, d AS (SELECT session, trial, label, CASE WHEN session % 2 = 0 THEN 'A' ELSE 'B' END AS dataset FROM lab)
"""


def transfer(spark, sf):
    binned, tr, un = counts(spark, sf)
    tr = labelled(spark, sf).withColumn("dataset", F.when(F.col("session") % 2 == 0, "A").otherwise("B"))
    return A.fitted_transfer(A.pooled_rates(binned, un, B.N_CTX), tr)


@query("pooled_rates", BASE + f"""
, n AS (SELECT session, region, count(*) AS k FROM units GROUP BY session, region)
SELECT ut.session, ut.trial, ut.region, {r('sum(ctx) / (any_value(k) * 24.0)', 'x')}
FROM ut JOIN n ON n.session = ut.session AND n.region = ut.region GROUP BY ut.session, ut.trial, ut.region HAVING sum(ctx) > 0""")
def pooled_rates(spark, sf):
    """Features that two datasets without common units share."""
    binned, _, un = counts(spark, sf)
    return A.pooled_rates(binned, un, B.N_CTX)


@query("transfer_optimality", TRANSFER + "SELECT dataset AS train_on, TRUE AS optimal FROM d GROUP BY dataset")
def transfer_optimality(spark, sf):
    """Whether the gradient of each direction's model, computed anew, is within the tolerance."""
    features, keyed, model = transfer(spark, sf)
    gap = M.optimality(features, keyed.where("split = 'train'").drop("split"), model)
    return gap.select(F.col("session").alias("train_on"), (F.col("gap") <= M.TOLERANCE * 1.001).alias("optimal"))


@query("fitted_transfer")
def fitted_transfer(spark, sf):
    """Class metrics of models fitted on one dataset, on their own trials and on those of the other dataset."""
    features, keyed, model = transfer(spark, sf)
    done = M.predict(features, keyed.select("session", "trial", "label"), model)
    done = done.join(keyed.select("session", "trial", "split"), ["session", "trial"])
    return E.metrics(done.withColumnRenamed("session", "train_on"), ["train_on", "split"])


@query("selected_vs_random_nll", BASE + f"""
, best AS (
  SELECT session, region, unit, row_number() OVER (PARTITION BY session, region ORDER BY t DESC, unit) AS p
  FROM (SELECT session, region, unit, sum(ctx) AS t FROM ut GROUP BY ALL)),
drawn AS (
  SELECT session, region, unit, row_number() OVER (PARTITION BY session, region ORDER BY {draw_sql(9, 'session', 'region', 'unit')}, unit) AS p FROM units),
picked AS (
  SELECT 'selected' AS set, session, region, unit FROM best WHERE p <= 5
  UNION ALL SELECT 'random', d.session, d.region, d.unit FROM drawn d
  JOIN (SELECT session, region, count(*) AS k FROM best WHERE p <= 5 GROUP BY session, region) n ON n.session = d.session AND n.region = d.region WHERE d.p <= n.k),
late_s AS (
  SELECT s.set, ut.session, ut.region, ut.trial, sum(ut.late) AS late FROM ut JOIN picked s ON s.session = ut.session AND s.unit = ut.unit GROUP BY ALL),
gains AS (
  SELECT l.set, l.session, l.region, l.trial, (l.late + 1.0) / (m.mean + 1.0) AS gain FROM late_s l
  JOIN (SELECT set, session, region, avg(late) AS mean FROM late_s WHERE trial % 4 <> 0 GROUP BY ALL) m
  ON m.set = l.set AND m.session = l.session AND m.region = l.region WHERE l.trial % 4 = 0),
y AS (
  SELECT ut.session, ut.region, ut.trial, g.bin, coalesce(sum(c.n), 0) AS y
  FROM (SELECT DISTINCT session, region, trial FROM ut) ut CROSS JOIN (SELECT unnest(range(12)) AS bin) g
  LEFT JOIN cells c ON c.session = ut.session AND c.region = ut.region AND c.trial = ut.trial AND c.bin = g.bin AND c.win = 'tgt' GROUP BY ALL),
base AS (SELECT session, region, bin, avg(y) AS mu FROM y WHERE trial % 4 <> 0 GROUP BY ALL)
SELECT g.set, g.region, count(*) // 12 AS n_trials, CAST(sum(y.y) AS BIGINT) AS spikes,
       {r('avg(b.mu * g.gain - y.y * ln(greatest(b.mu * g.gain, 1e-3)))', 'nll')}
FROM gains g JOIN y ON y.session = g.session AND y.region = g.region AND y.trial = g.trial
JOIN base b ON b.session = y.session AND b.region = y.region AND b.bin = y.bin GROUP BY g.set, g.region""")
def selected_vs_random_nll(spark, sf):
    """Forecast loss with only the most active units of each region in sight, and with as many random ones."""
    binned, tr, un = counts(spark, sf)
    binned = cut(binned)
    totals = R.unit_trial_counts(binned, B.N_CTX, B.LATE).where("label IS NOT NULL").groupBy(*U).agg(F.sum("ctx").alias("t"))
    totals = un.join(totals, U, "left").fillna(0, ["t"])
    chosen = cut(sel.top_k(totals, 5, ["session", "region"], [F.col("t").desc(), F.col("unit")]).select(*U))
    random = A.size_matched_random(un, chosen, seed=9).select(*U)
    sets = cut(chosen.withColumn("set", F.lit("selected")).unionByName(random.withColumn("set", F.lit("random"))))
    return A.occluded_forecast(binned, sets, tr, "trial % 4 <> 0", n_ctx=B.N_CTX, late_bins=B.LATE, n_tgt=B.N_TGT)


MOVED = f"""
, orders AS (
  SELECT session, region, unit, trial, b, row_number() OVER (
    PARTITION BY session, region, unit, trial ORDER BY {draw_sql(4, 'session', 'region', 'unit', 'trial', 'b')}, b) - 1 AS place
  FROM (SELECT DISTINCT session, region, unit, trial FROM cells WHERE win = 'tgt' AND label IS NOT NULL) CROSS JOIN (SELECT unnest(range(12)) AS b)),
moved AS (
  SELECT c.session, c.region, c.unit, c.trial, o.place AS bin, c.n FROM cells c
  JOIN orders o ON o.session = c.session AND o.unit = c.unit AND o.trial = c.trial AND o.b = c.bin WHERE c.win = 'tgt' AND c.label IS NOT NULL)
"""


@query("time_shuffle", BASE + MOVED + f"SELECT {UK}, trial, bin, CAST(n AS BIGINT) AS n FROM moved")
def time_shuffle(spark, sf):
    """Every target count in its drawn bin."""
    cells = counts(spark, sf)[0].where("win = 'tgt' AND label IS NOT NULL")
    return A.time_shuffle(cells, B.N_TGT, seed=4).select(*U, "trial", "bin", "n")


@query("time_shuffle_null", BASE + MOVED + f"""
, nul AS (
  SELECT c.session, c.unit, c.bin, sum(c.n) / any_value(s.n_trials) AS mu FROM cells c JOIN sizes s ON s.session = c.session
  WHERE c.win = 'tgt' AND c.label IS NOT NULL GROUP BY c.session, c.unit, c.bin),
two AS (
  SELECT 'observed' AS kind, session, region, unit, bin, n FROM cells WHERE win = 'tgt' AND label IS NOT NULL
  UNION ALL SELECT 'shuffled', session, region, unit, bin, n FROM moved)
SELECT kind, region, CAST(sum(n) AS BIGINT) AS spikes, {r('sum(-n * ln(coalesce(mu, 0) + 1e-8))', 'neg_log_lik')}
FROM two LEFT JOIN nul ON nul.session = two.session AND nul.unit = two.unit AND nul.bin = two.bin GROUP BY kind, region""")
def time_shuffle_null(spark, sf):
    """Log-likelihood of the target under its own mean trace, before and after moving bins."""
    binned, tr, un = counts(spark, sf)
    cells = binned.where("win = 'tgt' AND label IS NOT NULL")
    null = E.null_psth(binned, tr)
    both = cells.withColumn("kind", F.lit("observed")).unionByName(
        A.time_shuffle(cells, B.N_TGT, seed=4).withColumn("kind", F.lit("shuffled"))
    )
    scored = both.join(null, [*U, "bin"], "left").withColumn("mu", F.coalesce("mu", F.lit(0.0)))
    # the sum of mu over all cells is the same for both, so the spiking cells decide
    return scored.groupBy("kind", "region").agg(
        F.sum("n").alias("spikes"), F.sum(-F.col("n") * F.ln(F.col("mu") + 1e-8)).alias("neg_log_lik")
    )


@query("min_trials_guard", BASE + """
SELECT l.session, l.trial, l.label FROM lab l SEMI JOIN (SELECT session FROM lab GROUP BY session HAVING count(*) >= 2) USING (session)""")
def min_trials_guard(spark, sf):
    """Labelled trials of sessions that have enough of them; the job fails if fewer than four are left."""
    return SM.guarded_trials(labelled(spark, sf), minimum=4, per_session=2)


@query("time_shuffle_totals", BASE + f"""
SELECT {UK}, trial, CAST(sum(n) AS BIGINT) AS n, count(*) AS bins FROM cells WHERE win = 'tgt' AND label IS NOT NULL GROUP BY ALL""")
def time_shuffle_totals(spark, sf):
    """A shuffle keeps every trial's count and its number of filled bins."""
    cells = counts(spark, sf)[0].where("win = 'tgt' AND label IS NOT NULL")
    moved = A.time_shuffle(cells, B.N_TGT, seed=4)
    return moved.groupBy(*U, "trial").agg(F.sum("n").alias("n"), F.countDistinct("bin").alias("bins"))


@query("outer_split", BASE + f"""
, s AS (SELECT DISTINCT session FROM lab),
k AS (SELECT session, row_number() OVER (ORDER BY {draw_sql(6, 'session')}, session) <= greatest(1, round_even(count(*) OVER () * 0.3, 0)) AS held_out FROM s)
SELECT lab.session, lab.trial, lab.label, k.held_out FROM lab JOIN k ON k.session = lab.session""")
def outer_split(spark, sf):
    return A.outer_split(labelled(spark, sf), "session", 0.3, seed=6)


@query("dataset_transfer", BASE + """
, d AS (SELECT session, trial, label, CASE WHEN session % 2 = 0 THEN 'A' ELSE 'B' END AS dataset FROM lab)
SELECT train_on, CASE WHEN dataset = train_on THEN 'train' ELSE 'test' END AS split, count(*) AS n
FROM d CROSS JOIN (SELECT unnest(['A', 'B']) AS train_on) GROUP BY ALL""")
def dataset_transfer(spark, sf):
    tr = labelled(spark, sf).withColumn("dataset", F.when(F.col("session") % 2 == 0, "A").otherwise("B"))
    return A.dataset_transfer(tr).groupBy("train_on", "split").agg(F.count("*").alias("n"))


@query("energy_rank_correlation")
def energy_rank_correlation(spark, sf):
    """Band energy of a trace against its mean level, ranked over all traces."""
    df = traces(spark, sf)
    mean = F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / F.size("x")
    energy = df.select(S.wavelet_band_energy(F.col("x"), 0.01, 12.0, 45.0).alias("energy"), mean.alias("level"))
    return A.rank_correlation(cut(energy), "energy", "level")


@query("level_rank_correlation", X.rstrip() + f"""
, s AS (SELECT vec_id, round(avg(v), 9) AS a, round(max(v), 9) AS m FROM x GROUP BY vec_id),
k AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS rx,
             rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS ry FROM s)
SELECT {r('covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry))', 'rho')}, count(*) AS n_pairs FROM k""")
def level_rank_correlation(spark, sf):
    df = traces(spark, sf)
    mean = F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / F.size("x")
    pairs = df.select(F.round(mean, 9).alias("a"), F.round(F.array_max("x"), 9).alias("m"))
    return A.rank_correlation(pairs, "a", "m").drop("p")


@query("size_matched_random", BASE + f"""
, n AS (SELECT session, region, count(*) AS k FROM units WHERE unit % 4 = session % 4 GROUP BY session, region),
p AS (SELECT *, row_number() OVER (PARTITION BY session, region ORDER BY {draw_sql(9, 'session', 'region', 'unit')}, unit) AS p FROM units)
SELECT p.session, p.region, p.unit FROM p JOIN n ON n.session = p.session AND n.region = p.region WHERE p.p <= n.k""")
def size_matched_random(spark, sf):
    un = base(spark, sf)[2]
    chosen = un.where(F.col("unit") % 4 == F.col("session") % 4)
    return A.size_matched_random(un, chosen, seed=9)


@query("size_matched_counts", BASE + """
SELECT session, region, count(*) AS n FROM units WHERE unit % 3 = 0 GROUP BY session, region""")
def size_matched_counts(spark, sf):
    un = base(spark, sf)[2]
    chosen = un.where(F.col("unit") % 3 == 0)
    return A.size_matched_random(un, chosen, seed=9).groupBy("session", "region").agg(F.count("*").alias("n"))


@query("permuted_class_counts", BASE + """
SELECT g.rep, l.session, l.label, count(*) AS n FROM lab l CROSS JOIN (SELECT unnest(range(5)) AS rep) g GROUP BY ALL""")
def permuted_class_counts(spark, sf):
    """A permutation inside sessions keeps every session's class counts."""
    fake = A.permute_labels_in_session(cut(labelled(spark, sf)), 5, seed=2)
    return fake.groupBy("rep", "session", "label").agg(F.count("*").alias("n"))

"""Splits, baselines, class metrics and forecast scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import joins as J
from ..operators import models as M
from ..operators import raster as R
from ..operators import selection as sel
from ..operators import stats
from ..operators import summary as SM
from ..operators.lineage import cut, file_state, written
from ..schema import CLASSES, REGIONS
from . import binding as B
from .queries_raster import U, UK, counts, unit_trials
from .registry import BASE, b, draw_sql, query, r

# ---------------------------------------------------------------- class metrics on the label table


def predictions(spark, sf):
    """Truth and prediction codes in a three-class domain, with a session key."""
    t = B.table(spark, sf, "labels")
    return t.select(
        (F.col("doc_id") % 7).alias("session"), F.col("doc_id").alias("trial"), F.col("quality").cast("int").alias("label"),
        (F.col("toxic") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).cast("int").alias("pred"),
    )


PRED = """
WITH p AS (SELECT doc_id % 7 AS session, doc_id AS trial, CAST(quality AS INT) AS label,
                  CAST(toxic + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS pred FROM labels)
"""


def metrics_sql(src: str, keys: str) -> str:
    k = f"{keys}, " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    on = f"USING ({keys})" if keys else "ON true"
    return f"""
, {src}_cls AS (SELECT unnest([0, 1, 2]) AS c),
{src}_pc AS (
  SELECT {k}c, count(*) FILTER (label = c) AS t, count(*) FILTER (pred = c) AS q, count(*) FILTER (label = c AND pred = c) AS tp
  FROM {src} CROSS JOIN {src}_cls GROUP BY {k}c),
{src}_m AS (
  SELECT {k}sum(tp) / sum(t) AS accuracy, avg(CASE WHEN t > 0 THEN tp / t END) AS balanced_accuracy,
         avg(CASE WHEN t + q > 0 THEN 2.0 * tp / (t + q) ELSE 0 END) AS macro_f1, CAST(sum(t) AS BIGINT) AS n
  FROM {src}_pc {g})
"""


METRIC_COLS = f"{r('accuracy', 'accuracy')}, {r('balanced_accuracy', 'balanced_accuracy')}, {r('macro_f1', 'macro_f1')}, n"


@query("metrics", PRED + metrics_sql("p", "") + f"SELECT {METRIC_COLS} FROM p_m")
def metrics(spark, sf):
    return E.metrics(predictions(spark, sf))


@query("metrics_by_session", PRED + metrics_sql("p", "session") + f"SELECT session, {METRIC_COLS} FROM p_m")
def metrics_by_session(spark, sf):
    return E.metrics(predictions(spark, sf), ["session"])


@query("confusion", PRED + f"""
, c AS (SELECT i AS label, j AS pred FROM range(3) a(i), range(3) d(j)),
k AS (SELECT c.label, c.pred, count(p.trial) AS n FROM c LEFT JOIN p ON p.label = c.label AND p.pred = c.pred GROUP BY ALL)
SELECT label, pred, n, {r('n / greatest(sum(n) OVER (PARTITION BY label), 1)', 'row_share')} FROM k""")
def confusion(spark, sf):
    return E.confusion_matrix(predictions(spark, sf))


@query("cross_session_agg", PRED + metrics_sql("p", "session") + f"""
, cm AS (SELECT {', '.join(f'count(*) FILTER (label = {i} AND pred = {j}) AS c_{i}{j}' for i in range(3) for j in range(3))} FROM p)
SELECT {r('avg(accuracy)', 'accuracy')}, {r('avg(balanced_accuracy)', 'balanced_accuracy')}, {r('avg(macro_f1)', 'macro_f1')},
  CAST(sum(n) AS BIGINT) AS n, any_value(cm.c_00) AS c_00, {', '.join(f'any_value(cm.c_{i}{j}) AS c_{i}{j}' for i in range(3) for j in range(3) if i + j)},
  {r('1.0 / 3', 'chance_mean')}, {r('0.45', 'chance_p95')} FROM p_m CROSS JOIN cm""")
def cross_session_agg(spark, sf):
    return E.cross_session(E.confusion_counts(predictions(spark, sf), ["session"]))


def permuted_sql(src: str, out: str, ids: str, label: str, pred: str, n: int, seed: int) -> str:
    """Tables that pair predictions in drawn order with labels in the drawn order of each replicate."""
    cols = ids.split(", ")
    return f"""
, {out}_a AS (SELECT {pred}, row_number() OVER (ORDER BY {draw_sql(seed, *cols)}, {ids}) AS pos FROM {src}),
{out}_b AS (
  SELECT rep, {label}, row_number() OVER (PARTITION BY rep ORDER BY {draw_sql(seed, 'rep', *cols)}, {ids}) AS pos
  FROM {src} CROSS JOIN (SELECT unnest(range({n})) AS rep)),
{out} AS (SELECT rep, {label}, {pred} FROM {out}_b JOIN {out}_a USING (pos))
"""


@query("shuffle_chance", PRED + permuted_sql("p", "x", "session, trial", "label", "pred", 20, 0) + metrics_sql("x", "rep") + f"""
SELECT {r('avg(balanced_accuracy)', 'mean')}, {r('quantile_cont(balanced_accuracy, 0.95)', 'p95')}, count(*) AS n_shuffles FROM x_m""")
def shuffle_chance(spark, sf):
    return E.shuffle_chance(predictions(spark, sf), ["session", "trial"], 20, seed=0)


@query("class_weights", BASE + f"""
, k AS (SELECT unnest(['Ignore', 'Left', 'Right']) AS label),
s AS (SELECT DISTINCT session FROM lab),
c AS (SELECT s.session, k.label, count(l.trial) AS n FROM s CROSS JOIN k LEFT JOIN lab l ON l.session = s.session AND l.label = k.label GROUP BY ALL)
SELECT session, label, {r('CASE WHEN n > 0 THEN sum(n) OVER (PARTITION BY session) / (3.0 * n) ELSE 0 END', 'weight')} FROM c""")
def class_weights(spark, sf):
    return E.class_weights(B.trials(B.spikes(spark, sf)), ["session"])


# ---------------------------------------------------------------- splits


def labelled(spark, sf):
    return B.trials(B.spikes(spark, sf)).where("label IS NOT NULL").select("session", "trial", "label")


def split_sql(src: str, out: str, frac: str, seed: int) -> str:
    """Tables that add boolean `o` to the labelled trials of `src`: drawn by class where that is possible."""
    order = f"ORDER BY {draw_sql(seed, 'session', 'trial')}, trial"
    return f"""
, {out}_k AS (SELECT session, label, count(*) AS k FROM {src} GROUP BY ALL),
{out}_s AS (
  SELECT session, sum(k) AS n, round_even(({frac})::DOUBLE * sum(k), 0) AS places, min(k) AS least, count(*) AS present
  FROM {out}_k GROUP BY session),
{out}_e AS (
  SELECT session, label, places, least >= 2 AND places >= present AND places < n AS by_class, places * k / n AS e
  FROM {out}_k JOIN {out}_s USING (session)),
{out}_q AS (
  SELECT *, floor(e) + CASE WHEN row_number() OVER (PARTITION BY session ORDER BY e - floor(e) DESC, label)
         <= places - sum(floor(e)) OVER (PARTITION BY session) THEN 1 ELSE 0 END AS quota FROM {out}_e),
{out}_p AS (
  SELECT *, row_number() OVER (PARTITION BY session {order}) AS p,
         row_number() OVER (PARTITION BY session, label {order}) AS pc FROM {src}),
{out} AS (
  SELECT p.session, p.trial, p.label, CASE WHEN by_class THEN pc <= quota ELSE p <= places END AS o
  FROM {out}_p p JOIN {out}_q q ON q.session = p.session AND q.label = p.label)
"""


def two_step_sql(test: str, val: str, rest: str, seed: int = 0) -> str:
    return (
        BASE + split_sql("lab", "one", test, seed) + ", left_ AS (SELECT session, trial, label FROM one WHERE NOT o)"
        + split_sql("left_", "two", val, seed + 1) + f"""
SELECT session, trial, label, 'test' AS split FROM one WHERE o
UNION ALL SELECT session, trial, label, CASE WHEN o THEN 'val' ELSE {rest} END FROM two"""
    )


@query("split_stratified", two_step_sql("0.15", repr(0.15 / 0.85), "'train'"))
def split_stratified(spark, sf):
    return E.stratified_split(labelled(spark, sf), seed=0)


@query("split_holdout", two_step_sql(
    "CASE WHEN session = 0 THEN 0.8 ELSE 0 END", "CASE WHEN session = 0 THEN 0 ELSE 0.15 END",
    "CASE WHEN session = 0 THEN 'adapt' ELSE 'train' END"))
def split_holdout(spark, sf):
    return E.holdout_split(labelled(spark, sf), F.col("session") == 0, seed=0)


@query("split_random", BASE + f"""
, k AS (SELECT *, row_number() OVER (ORDER BY {draw_sql(7, 'session', 'trial')}, session, trial) AS p, count(*) OVER () AS n FROM lab)
SELECT session, trial, label, CASE WHEN p <= greatest(1, floor(n * 0.2)) THEN 'val' ELSE 'train' END AS split FROM k""")
def split_random(spark, sf):
    return E.random_split(labelled(spark, sf), seed=7)


# Sizes do not depend on the hash, so SQL can check them.


@query("split_sizes", BASE + f"""
, n AS (SELECT session, count(*) AS n FROM lab GROUP BY session),
t AS (SELECT session, n, CAST(round_even(0.15 * n, 0) AS BIGINT) AS test FROM n),
v AS (SELECT *, CAST(round_even(0.15 / 0.85 * (n - test), 0) AS BIGINT) AS val FROM t)
SELECT session, unnest(['train', 'val', 'test']) AS split, unnest([n - test - val, val, test]) AS n FROM v""")
def split_sizes(spark, sf):
    return E.stratified_split(labelled(spark, sf), seed=0).groupBy("session", "split").agg(F.count("*").alias("n"))


@query("join_split", BASE + f"""
, tr AS (SELECT session, trial, label, CASE WHEN trial % 5 = 0 THEN 'test' WHEN trial % 5 = 1 THEN 'val' ELSE 'train' END AS split FROM lab)
SELECT session, split, label, count(*) AS n FROM tr GROUP BY ALL""")
def join_split(spark, sf):
    tr = labelled(spark, sf)
    rule = F.when(F.col("trial") % 5 == 0, "test").when(F.col("trial") % 5 == 1, "val").otherwise("train")
    return J.with_split(tr, tr.withColumn("split", rule)).groupBy("session", "split", "label").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- baselines


@query("mean_rate_features", BASE + f"SELECT {UK}, trial, {r('ctx / 24.0', 'x')} FROM ut WHERE ctx > 0")
def mean_rate_features(spark, sf):
    return M.mean_rate_features(counts(spark, sf)[0], B.N_CTX)


TRAIN_RULE = "trial % 4 <> 0"


@query("feature_scale", BASE + f"""
, t AS (SELECT session, region, unit, ctx / 24.0 AS x FROM ut WHERE {TRAIN_RULE}),
has AS (SELECT DISTINCT session, unit FROM ut WHERE ctx > 0)
SELECT t.session, t.region, t.unit, {r('avg(x)', 'm')}, {r('CASE WHEN stddev_pop(x) < 1e-12 THEN 1 ELSE stddev_pop(x) END', 's')}
FROM t JOIN has ON has.session = t.session AND has.unit = t.unit GROUP BY t.session, t.region, t.unit""")
def feature_scale(spark, sf):
    """Scaling from training trials only."""
    features = M.mean_rate_features(counts(spark, sf)[0], B.N_CTX)
    return M.feature_scale(features, labelled(spark, sf).where(TRAIN_RULE))


_PREPARED: dict = {}
_FITTED: dict = {}


def prepared(spark, sf):
    """(binned, features, train, test) of the per-session baselines, and the key of the session and the event files.

    The tables serve every fit of a session and a state of the event files (names, times and lengths).
    """
    key = (spark.sparkContext.applicationId, *file_state(spark, f"{sf}/events.parquet"))
    if key not in _PREPARED:
        # Trials are settled first: events are read once for them and once for the bins, and a small table of trials is
        # known to be small before the events are shuffled.
        sp = B.spikes(spark, sf)
        trials = written(B.trials(sp))
        binned = written(B.binned(sp, trials))
        features = written(M.mean_rate_features(binned, B.N_CTX))
        tr = trials.where("label IS NOT NULL").select("session", "trial", "label")
        _PREPARED[key] = (binned, features, tr.where(TRAIN_RULE), tr.where(f"NOT ({TRAIN_RULE})"))
    return _PREPARED[key], key


def fitted(spark, sf, loss: str = "logistic"):
    """(binned, features, train, test, model) of the per-session baseline on all units, the model fitted once as well."""
    tables, key = prepared(spark, sf)
    if (*key, loss) not in _FITTED:
        _, features, train, _ = tables
        _FITTED[(*key, loss)] = (*tables, M.fit_linear(features, train, loss=loss))
    return _FITTED[(*key, loss)]


FITTED_SESSIONS = BASE + f"SELECT session, TRUE AS optimal FROM lab WHERE {TRAIN_RULE} GROUP BY session"


@query("logreg_optimality", FITTED_SESSIONS)
def logreg_optimality(spark, sf):
    """Whether the gradient of a session's fitted model, computed anew, is within the tolerance."""
    _, features, train, _, model = fitted(spark, sf)
    return M.optimality(features, train, model).select("session", (F.col("gap") <= M.TOLERANCE * 1.001).alias("optimal"))


@query("margin_optimality", FITTED_SESSIONS)
def margin_optimality(spark, sf):
    _, features, train, _, model = fitted(spark, sf, "squared_hinge")
    gap = M.optimality(features, train, model, loss="squared_hinge")
    return gap.select("session", (F.col("gap") <= M.TOLERANCE * 1.001).alias("optimal"))


@query("logreg_baseline")
def logreg_baseline(spark, sf):
    """Predictions of the multinomial baseline on the held-back trials, one model per session."""
    _, features, _, test, model = fitted(spark, sf)
    return M.predict(features, test, model)


@query("logreg_metrics")
def logreg_metrics(spark, sf):
    _, features, _, test, model = fitted(spark, sf)
    return E.metrics(M.predict(features, test, model))


@query("margin_baseline")
def margin_baseline(spark, sf):
    """One-against-rest squared-hinge baseline."""
    _, features, _, test, model = fitted(spark, sf, "squared_hinge")
    return M.predict(features, test, model).select("session", "trial", "label", "pred")


@query("context_sweep")
def context_sweep(spark, sf):
    binned, _, _, test, model = fitted(spark, sf)
    return E.metrics(M.context_sweep(binned, test, model, B.N_CTX, [2, 4, 8, 16, 24, 30]), ["kept"])


@query("early_late")
def early_late(spark, sf):
    """The first 16 bins against the last 8."""
    binned, _, _, test, model = fitted(spark, sf)
    return E.metrics(M.early_late(binned, test, model, B.N_CTX, 16, 8), ["part"])


@query("region_ablation")
def region_ablation(spark, sf):
    _, features, _, test, model = fitted(spark, sf)
    scores = E.metrics(M.region_ablation(features, test, model, (*REGIONS, "none")), ["dropped"])
    # five rows: every region, and none
    whole = Window.partitionBy(F.lit(0))
    full = F.max(F.when(F.col("dropped") == "none", F.col("balanced_accuracy"))).over(whole)
    return scores.withColumn("delta", F.col("balanced_accuracy") - full)


def sets_by_mode(spark, sf, k: int = 5):
    ut, sizes = unit_trials(spark, sf)
    scored = cut(stats.class_moments(ut, sizes).select(*U, stats.choice_score(4.32).alias("score"), F.lit(True).alias("eligible")))
    top = sel.top_k(scored, k, ["session", "region"], [F.col("score").desc(), F.col("unit")])
    table = scored.join(top.select(*U, "rank"), U, "left").withColumn("selected", F.col("rank").isNotNull())
    totals = ut.where("label IS NOT NULL").groupBy(*U).agg(F.sum("ctx").alias("total"))
    parts = [sel.neuron_set(table, totals, m, k, seed=5) for m in ("criteria", "rate", "random")]
    return J.union_datasets(parts).withColumnRenamed("mode", "set")


@query("neuron_set_ablation")
def neuron_set_ablation(spark, sf):
    """The baseline fitted anew on the units of each input set, and on all units."""
    (_, features, train, test), _ = prepared(spark, sf)
    every = features.select(*U).distinct().withColumn("set", F.lit("all"))
    sets = cut(sets_by_mode(spark, sf).select("set", *U).unionByName(every))
    names = ["criteria", "rate", "random", "all"]
    return E.metrics(M.refitted_sets(features, sets, train, test, names), ["set"])


@query("occlusion_gain")
def occlusion_gain(spark, sf):
    _, features, _, test, model = fitted(spark, sf)
    return M.occlusion_gain(features, test, model)


@query("selected_vs_random")
def selected_vs_random(spark, sf):
    """Baselines fitted on the selected units and on as many random ones per region."""
    from ..operators import analyses as A

    (_, features, train, test), _ = prepared(spark, sf)
    chosen = cut(sets_by_mode(spark, sf).where("set = 'criteria'").select(*U))
    matched = A.size_matched_random(B.units(B.spikes(spark, sf)), chosen, seed=9)
    sets = chosen.withColumn("set", F.lit("selected")).unionByName(matched.withColumn("set", F.lit("random")))
    return E.metrics(M.refitted_sets(features, cut(sets), train, test, ["selected", "random"]), ["set"])


# ---------------------------------------------------------------- forecasts


@query("null_psth", BASE + f"""
, tr AS (SELECT session, trial FROM lab WHERE trial % 4 <> 0), k AS (SELECT session, count(*) AS n FROM tr GROUP BY session)
SELECT c.session, c.region, c.unit, {b('c.bin', 'bin')}, {r('sum(c.n) / any_value(k.n)', 'mu')}
FROM cells c SEMI JOIN tr ON tr.session = c.session AND tr.trial = c.trial JOIN k ON k.session = c.session
WHERE c.win = 'tgt' GROUP BY c.session, c.region, c.unit, c.bin""")
def null_psth(spark, sf):
    binned, tr, _ = counts(spark, sf)
    return E.null_psth(binned, tr, F.expr(TRAIN_RULE))


PERSIST = "greatest(late / 8.0 * 2, 1e-3)"


@query("persistence", BASE + f"SELECT {UK}, trial, {r(PERSIST, 'mu')}, {r(f'ln(late / 8.0 * 2 + 0.05)', 'log_mu')} FROM ut")
def persistence(spark, sf):
    """Every unit and trial, silent ones at the floor: the grid is the result."""
    binned, tr, un = counts(spark, sf)
    ut = R.unit_trial_counts(binned, B.N_CTX, B.LATE)
    rows = R.dense_counts(ut, un, tr.where("label IS NOT NULL"), "late")
    out = E.persistence_forecast(rows, B.LATE, B.CTX_BIN, B.TGT_BIN)
    return out.select(*U, "trial", "mu", E.log_persistence(F.col("late") / B.LATE, 2.0).alias("log_mu"))


# Every unit x trial x target-bin cell, zeros included.
DENSE = BASE + f"""
, nul AS (
  SELECT c.session, c.unit, c.bin, sum(c.n) / any_value(s.n_trials) AS mu FROM cells c JOIN sizes s ON s.session = c.session
  WHERE c.win = 'tgt' AND c.label IS NOT NULL GROUP BY c.session, c.unit, c.bin),
dn AS (
  SELECT ut.session, ut.region, ut.unit, ut.trial, g.bin, coalesce(c.n, 0) AS y, {PERSIST} AS mu, coalesce(nul.mu, 0) AS mu0
  FROM ut CROSS JOIN (SELECT unnest(range(12)) AS bin) g
  LEFT JOIN cells c ON c.session = ut.session AND c.unit = ut.unit AND c.trial = ut.trial AND c.bin = g.bin AND c.win = 'tgt'
  LEFT JOIN nul ON nul.session = ut.session AND nul.unit = ut.unit AND nul.bin = g.bin)
"""


def dev(mu: str) -> str:
    return f"2 * sum(y * ln((y + 1e-8) / ({mu} + 1e-8)) - (y - {mu}))"


@query("deviance_explained", DENSE + f"""
SELECT region, {r(dev('mu0'), 'deviance_null')}, {r(dev('mu'), 'deviance_persistence')},
       {r(f"1 - ({dev('mu')}) / greatest({dev('mu0')}, 1e-8)", 'deviance_explained_persistence')} FROM dn GROUP BY region""")
def deviance_explained(spark, sf):
    binned, tr, un = counts(spark, sf)
    sizes = R.unit_sizes(un, tr)
    ut = R.unit_trial_counts(binned, B.N_CTX, B.LATE)
    null = E.null_psth(binned, tr)
    return E.forecast_deviance(
        binned, ut, sizes, null, late_bins=B.LATE, n_tgt=B.N_TGT, ctx_bin_s=B.CTX_BIN, tgt_bin_s=B.TGT_BIN
    )


def persistence_scores(spark, sf):
    binned, tr, un = counts(spark, sf)
    return E.persistence_scores(
        binned, R.unit_sizes(un, tr), n_ctx=B.N_CTX, late_bins=B.LATE, n_tgt=B.N_TGT, ctx_bin_s=B.CTX_BIN, tgt_bin_s=B.TGT_BIN
    )


@query("poisson_deviance", DENSE + f"SELECT region, {r(dev('mu'), 'deviance')} FROM dn GROUP BY region")
def poisson_deviance(spark, sf):
    return persistence_scores(spark, sf).select("region", "deviance")


@query("poisson_nll", DENSE + f"SELECT region, {r('avg(mu - y * ln(mu))', 'nll_log')}, {r('avg(mu - y * ln(mu + 1e-8))', 'nll')} FROM dn GROUP BY region")
def poisson_nll(spark, sf):
    return persistence_scores(spark, sf).select("region", "nll_log", "nll")


@query("deviance_mean_null", DENSE + f"""
, m AS (SELECT session, unit, avg(y) AS mum FROM dn GROUP BY session, unit)
SELECT region, {r(f"1 - ({dev('mu')}) / greatest({dev('mum')}, 1e-8)", 'deviance_explained')}
FROM dn JOIN m ON m.session = dn.session AND m.unit = dn.unit GROUP BY region""")
def deviance_mean_null(spark, sf):
    return persistence_scores(spark, sf).select("region", "deviance_explained")


@query("join_null_forecast", BASE + f"""
, nul AS (
  SELECT c.session, c.unit, c.bin, sum(c.n) / any_value(s.n_trials) AS mu FROM cells c JOIN sizes s ON s.session = c.session
  WHERE c.win = 'tgt' AND c.label IS NOT NULL GROUP BY c.session, c.unit, c.bin)
SELECT c.session, c.region, c.unit, c.trial, {b('c.bin', 'bin')}, c.n, {r('nul.mu', 'mu')}
FROM cells c JOIN nul ON nul.session = c.session AND nul.unit = c.unit AND nul.bin = c.bin WHERE c.win = 'tgt' AND c.label IS NOT NULL""")
def join_null_forecast(spark, sf):
    binned, tr, _ = counts(spark, sf)
    cells = binned.where("win = 'tgt' AND label IS NOT NULL").drop("win", "label")
    return J.with_null_forecast(cells, E.null_psth(binned, tr))


# ---------------------------------------------------------------- weight tables


@query("importance_hist", f"""
SELECT l_returnflag AS region, least(CAST(floor(l_discount * 10 * 20) AS BIGINT), 19) AS bin, count(*) AS n
FROM lineitem WHERE l_discount * 10 BETWEEN 0 AND 1 GROUP BY ALL""")
def importance_hist(spark, sf):
    w = B.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("region"), (F.col("l_discount") * 10).alias("w"))
    return SM.importance_histogram(w, ["region"], "w")


WEIGHTS = """
WITH w AS (SELECT l_orderkey AS trial, l_returnflag AS region, ['Ignore', 'Left', 'Right'][l_orderkey % 3 + 1] AS label, l_linenumber AS bin,
                  l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS w FROM lineitem)
"""


def weights(spark, sf):
    """Line quantities as a share of their order: one weight vector per order."""
    li = B.table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_quantity")
    per_order = li.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total"))
    label = F.get(F.array(*[F.lit(c) for c in CLASSES]), (F.col("l_orderkey") % 3).cast("int"))
    return li.join(per_order, "l_orderkey").select(
        F.col("l_orderkey").alias("trial"), F.col("l_returnflag").alias("region"), label.alias("label"),
        F.col("l_linenumber").alias("bin"), (F.col("l_quantity") / F.col("total")).alias("w"),
    )


@query("weight_by_class", WEIGHTS + f"SELECT region, CAST(bin AS BIGINT) AS bin, label, {r('avg(w)', 'mean_weight')} FROM w GROUP BY region, bin, label")
def weight_by_class(spark, sf):
    return SM.weight_by_class(weights(spark, sf), ["region", "bin"])


@query("weight_entropy", WEIGHTS + f"""
, g AS (SELECT region, trial, sum(w) AS s, count(*) AS n, sum(-w * ln(greatest(w, 1e-8))) AS h FROM w GROUP BY region, trial)
SELECT region, {r('sum(s) / sum(n)', 'mean_weight')}, {r('avg(h)', 'entropy')} FROM g GROUP BY region""")
def weight_entropy(spark, sf):
    return SM.weight_entropy(weights(spark, sf), ["region"], ["trial"])


@query("importance_score", BASE + f"""
, g AS (SELECT session, region, unit, sum(tgt) / 100.0 AS gate FROM ut GROUP BY {UK}),
s AS (SELECT session, region, unit, avg(ctx) AS score FROM ut GROUP BY {UK})
SELECT {UK}, {r('gate', 'gate')}, {r('score', 'score')} FROM g JOIN s USING ({UK})""")
def importance_score(spark, sf):
    return gates(spark, sf)


def gates(spark, sf):
    ut, sizes = unit_trials(spark, sf)
    m = stats.class_moments(ut, sizes, "tgt").select(*U, (F.col("s_0") + F.col("s_1") + F.col("s_2")).alias("t"))
    gate = m.select(*U, (F.col("t") / 100.0).alias("gate"))
    score = stats.class_moments(ut, sizes).select(*U, stats.mean_rate(1.0).alias("score"))
    return J.importance_with_score(gate, score, U)


@query("importance_rank_correlation", BASE + f"""
, g AS (SELECT {UK}, sum(tgt) / 100.0 AS gate, round(avg(ctx), 9) AS score FROM ut GROUP BY {UK}),
k AS (
  SELECT rank() OVER (ORDER BY gate) + (count(*) OVER (PARTITION BY gate) - 1) / 2.0 AS rx,
         rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS ry FROM g)
SELECT {r('covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry))', 'rho')}, count(*) AS n_pairs FROM k""")
def importance_rank_correlation(spark, sf):
    pairs = gates(spark, sf).select(*U, "gate", F.round("score", 9).alias("score"))
    return stats.spearman_global(cut(pairs), "gate", "score").drop("p")

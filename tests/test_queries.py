"""Registry queries against their SQL, plan shapes, and brute force where SQL has no function."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from tools.check import TABLES, rows_of
from trialframe.operators import evaluation, models, stats
from trialframe.plans.registry import BASE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize(
    "name",
    ["bin_a", "kruskal", "spearman_coupling", "bh_fdr", "dprime", "qc_trial_chain", "topk_region", "cwt_band", "deviance_explained", "metrics",
     "selection_null", "selected_vs_random_nll", "time_shuffle", "min_trials_guard", "transfer_optimality"],
)
def test_matches_sql(spark, con, name):
    df = entry_point.queries()[name](spark, SF)
    cur = con.execute(entry_point.oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", ["join_spike_window", "join_zero_fill", "bin_a", "kruskal", "cross_session_agg", "population_trace"])
def test_no_cross_joins(spark, name):
    plan = entry_point.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_scan_reads_needed_columns_only(spark):
    plan = entry_point.queries()["distinct_sessions"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<user_id:bigint>" in plan


def test_spearman_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(u, float(rng.integers(0, 6)), float(rng.integers(0, 6))) for u in range(3) for _ in range(40)]
    df = spark.createDataFrame(rows, "u long, x double, y double")
    got = {r["u"]: r["rho"] for r in stats.spearman(df, ["u"], "x", "y").collect()}

    def ranks(v):
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    for u in range(3):
        x, y = (np.array([r[i] for r in rows if r[0] == u]) for i in (1, 2))
        assert got[u] == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])


def test_shuffled_labels_are_a_permutation(spark):
    df = spark.range(200).select(F.col("id").alias("trial"), (F.col("id") % 3).cast("int").alias("label"), F.lit(0).alias("pred"))
    out = evaluation.shuffle_labels(df, ["trial"], 3, seed=1)
    counts = {(r["rep"], r["label"]): r["count"] for r in out.groupBy("rep", "label").count().collect()}
    assert counts == {(rep, c): n for rep in range(3) for c, n in ((0, 67), (1, 67), (2, 66))}


def test_stratified_split_sizes(spark):
    rows = [("s", i, c) for i, c in enumerate(["Ignore"] * 10 + ["Left"] * 20 + ["Right"] * 30)]
    out = evaluation.stratified_split(spark.createDataFrame(rows, "session string, trial long, label string"), 0.2, 0.2, seed=0)
    got = {(r["split"], r["label"]): r["count"] for r in out.groupBy("split", "label").count().collect()}
    assert [got[("test", c)] for c in ("Ignore", "Left", "Right")] == [2, 4, 6]
    assert sum(got.values()) == 60


def test_linear_fit_reaches_the_optimum(spark):
    rng = np.random.default_rng(3)
    n, d, c = 24, 3, 0.5
    y = np.arange(n) % 3
    x = rng.poisson(1.0 + (y[:, None] == np.arange(d)[None, :]) * 2.0).astype(float)
    names = ["Ignore", "Left", "Right"]
    train = spark.createDataFrame([("s", int(i), names[y[i]]) for i in range(n)], "session string, trial long, label string")
    feats = spark.createDataFrame(
        [("s", "r", int(u), int(i), float(x[i, u])) for i in range(n) for u in range(d) if x[i, u] > 0],
        "session string, region string, unit long, trial long, x double",
    )
    model = models.fit_linear(feats, train, c=c)
    z = (x - x.mean(0)) / x.std(0)

    def objective(w, b):
        s = z @ w + b
        s = s - s.max(1, keepdims=True)
        return c * (np.log(np.exp(s).sum(1)) - s[np.arange(n), y]).sum() + 0.5 * (w**2).sum()

    w, b = np.zeros((d, 3)), np.zeros(3)
    for _ in range(4000):
        s = z @ w + b
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        r = p - np.eye(3)[y]
        w, b = w - 0.05 * (c * z.T @ r + w), b - 0.05 * c * r.sum(0)
    raw = np.array([[row[f"w_{k}"] for k in range(3)] for row in model.coef.orderBy("unit").collect()])
    off = model.offset.first()
    fitted = objective(raw * x.std(0)[:, None], np.array([off[f"o_{k}"] for k in range(3)]) + x.mean(0) @ raw)
    best, start = objective(w, b), objective(np.zeros((d, 3)), np.zeros(3))
    assert best <= fitted + 1e-9 and (fitted - best) < 1e-5 * (start - best)
    gap = models.optimality(feats, train, model, c=c).first()["gap"]
    assert gap <= 1.001 * models.TOLERANCE
    loose = models.LinearModel(model.coef.withColumn("w_0", F.col("w_0") + 0.1), model.offset)
    assert models.optimality(feats, train, loose, c=c).first()["gap"] > 10 * models.TOLERANCE


def test_sessions_fitted_in_tasks_and_by_joins_agree_in_few_jobs(spark):
    rng = np.random.default_rng(8)
    names, rows, labels = ["Ignore", "Left", "Right"], [], []
    for s, (units, trials) in {"a": (5, 40), "b": (3, 18), "c": (2, 12)}.items():
        y = rng.integers(0, 3 if s == "a" else 2, trials)
        labels += [(s, int(i), names[y[i]]) for i in range(trials)]
        rows += [(s, f"r{u % 2}", u, i, float(n)) for u in range(units) for i in range(trials) if (n := rng.poisson(0.6 + (y[i] == u)))]
    train = spark.createDataFrame(labels + [("empty", 0, "Left"), ("empty", 1, "Right")], "session string, trial long, label string")
    # a unit with spikes in other trials alone, and a session without training trials
    feats = spark.createDataFrame(rows + [("b", "r0", 9, 900, 1.0), ("other", "r0", 1, 1, 2.0)], "session string, region string, unit long, trial long, x double")
    for loss in ("logistic", "squared_hinge"):
        spark.sparkContext.setJobGroup(f"fit-{loss}", "a fit")
        quick = models.fit_linear(feats, train, loss=loss)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit-{loss}")) <= 25
    mixed = models.fit_linear(feats, train, cells=100)  # the first session alone is large
    quick = models.fit_linear(feats, train)
    for part in ("coef", "offset"):
        one, two = ({tuple(r[:-3]): r[-3:] for r in getattr(m, part).collect()} for m in (quick, mixed))
        assert one.keys() == two.keys() and len(one) == (11 if part == "coef" else 4)
        assert all(one[k] == pytest.approx(two[k], abs=1e-6) for k in one)


def test_margin_fits_end_where_plain_steps_run_away(spark):
    """Small sessions that Barzilai-Borwein steps alone do not fit within 2000 steps."""
    names, rows, labels = ["Ignore", "Left", "Right"], [], []
    for seed in (2375, 637):
        rng = np.random.default_rng(seed)
        n, d = int(rng.integers(4, 14)), int(rng.integers(1, 7))
        y = np.arange(n) % 2 + 1
        y[rng.random(n) < 0.3] = 0
        x = rng.poisson(rng.gamma(0.4, 2, (n, d))).astype(float)
        x = x[:, [0] * d] if seed % 2 else x
        labels += [(seed, i, names[y[i]]) for i in range(n)]
        rows += [(seed, "r", u, i, float(x[i, u])) for i in range(n) for u in range(d) if x[i, u] > 0]
    train = spark.createDataFrame(labels, "session long, trial long, label string")
    feats = spark.createDataFrame(rows, "session long, region string, unit long, trial long, x double")
    model = models.fit_linear(feats, train, loss="squared_hinge")
    gaps = models.optimality(feats, train, model, loss="squared_hinge").collect()
    assert len(gaps) == 2 and all(r["gap"] <= 1.001 * models.TOLERANCE for r in gaps)
    one = "session = 2375"
    joined = models.fit_linear(feats.where(one), train.where(one), loss="squared_hinge", cells=0)
    for part in ("coef", "offset"):
        here, there = ({tuple(r[:-3]): r[-3:] for r in getattr(m, part).where(one).collect()} for m in (model, joined))
        assert here.keys() == there.keys() and all(here[k] == pytest.approx(there[k], abs=1e-6) for k in here)


def test_margin_queries_over_events_of_many_months(spark, tmp_path):
    """32 copies of the events, 30 days apart: Barzilai-Borwein steps alone do not fit their session."""
    days = F.explode(F.sequence(F.lit(0), F.lit(930), F.lit(30)))
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("days", days)
    later = F.col("ts") + F.make_dt_interval(F.col("days"))
    events.withColumn("ts", later).drop("days").write.parquet(str(tmp_path / "events.parquet"))
    names = ("margin_optimality", "margin_baseline")
    whole, predicted = (entry_point.queries()[name](spark, str(tmp_path)) for name in names)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    cur = c.execute(entry_point.oracle_sql()["margin_optimality"])
    assert rows_of(whole.columns, [tuple(r) for r in whole.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())
    held = c.execute(BASE + "SELECT count(*) FROM lab WHERE trial % 4 = 0").fetchone()[0]
    rows = predicted.collect()
    assert len(rows) == held > 100 and {r["pred"] for r in rows} <= {0, 1, 2}


def test_a_set_without_units_is_fitted_by_its_intercepts(spark):
    train = spark.createDataFrame([("s", i, c) for i, c in enumerate(["Left", "Left", "Right"])], "session string, trial long, label string")
    feats = spark.createDataFrame([("s", "r", 1, 0, 2.0), ("s", "r", 1, 1, 1.0)], "session string, region string, unit long, trial long, x double")
    sets = feats.select(F.lit("one").alias("set"), "session", "region", "unit").distinct()
    out = models.refitted_sets(feats, sets, train, train, ["one", "none"])
    got = {(r["set"], r["trial"]): r for r in out.collect()}
    assert len(got) == 6 and {k: got["one", k]["pred"] for k in range(3)} == {0: 1, 1: 1, 2: 2}
    # balanced weights: without units both classes are even
    assert all(abs(got["none", k]["p_Left"] - got["none", k]["p_Right"]) < 1e-6 for k in range(3))


def test_a_fit_is_not_kept_for_changed_files(spark, tmp_path, monkeypatch):
    from trialframe.plans import queries_eval

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    fits = []
    monkeypatch.setattr(queries_eval.M, "fit_linear", lambda *a, **k: fits.append(1) or len(fits))
    events.write.parquet(str(tmp_path / "events.parquet"))
    first = queries_eval.fitted(spark, str(tmp_path))
    assert queries_eval.fitted(spark, str(tmp_path)) is first and len(fits) == 1
    events.where("user_id > 3").write.mode("overwrite").parquet(str(tmp_path / "events.parquet"))
    assert queries_eval.fitted(spark, str(tmp_path))[-1] == 2


def test_a_fit_prepares_its_tables_in_few_jobs(spark, monkeypatch):
    """Events are scanned for the trials and for the bins alone, and the state of their files is listed without a job."""
    from trialframe.operators import lineage
    from trialframe.plans import queries_eval

    group = lambda name: spark.sparkContext.setLocalProperty("spark.jobGroup.id", name)
    jobs = lambda name: len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    monkeypatch.setattr(queries_eval, "_PREPARED", {})
    scans = []
    spikes = queries_eval.B.spikes
    monkeypatch.setattr(queries_eval.B, "spikes", lambda *a: scans.append(1) or spikes(*a))
    group("state")
    assert lineage.file_state(spark, f"{SF}/events.parquet")[0] == 1
    group("prepared")
    binned, features, train, test = queries_eval.prepared(spark, SF)[0]
    group(None)
    assert jobs("state") == 0 and jobs("prepared") <= 10 and len(scans) == 1
    # the same tables as from the operators without settled trials
    like = queries_eval.counts(spark, SF)[0]
    assert rows_of(binned.columns, binned.collect()) == rows_of(like.columns, like.collect())
    like = queries_eval.M.mean_rate_features(like, queries_eval.B.N_CTX)
    assert rows_of(features.columns, features.collect()) == rows_of(like.columns, like.collect())
    like = queries_eval.labelled(spark, SF)
    assert rows_of(like.columns, train.unionAll(test).collect()) == rows_of(like.columns, like.collect())


@pytest.mark.parametrize("name", ["neuron_set_ablation", "selected_vs_random"])
def test_queries_that_fit_sets_do_not_fit_all_units_beside(spark, monkeypatch, name):
    from trialframe.plans import queries_eval

    fits = []
    fit = models.fit_linear
    monkeypatch.setattr(models, "fit_linear", lambda *a, **k: fits.append(1) or fit(*a, **k))
    for shared in ("_FITTED", "_PREPARED"):
        monkeypatch.setattr(queries_eval, shared, {}, raising=False)
    assert entry_point.queries()[name](spark, SF).count() > 0
    assert len(fits) == 1


def test_a_written_table_leaves_no_shuffle(spark):
    from trialframe.operators import lineage

    before = spark.conf.get(lineage.CLEANED)
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    held = lambda: tracker.shuffleStatuses().size()
    n = held()
    done = lineage.written(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count())
    assert held() <= n and done.count() == 7 and spark.conf.get(lineage.CLEANED) == before

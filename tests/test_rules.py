"""One hand table per rule that is easy to get wrong."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialframe.functions import epochs, parsing, pvalues, rules, signal
from trialframe.operators import evaluation, raster, selection, stats, summary
from trialframe.schema import QcRules, Windows


def values(df):
    return [tuple(r) for r in df.collect()]


def test_names(spark):
    df = spark.createDataFrame([("trial_0032",), ("trial-7",), ("trial000",), ("x9",)], "s string")
    assert values(df.select(parsing.trial_number(F.col("s")))) == [(32,), (7,), (0,), (None,)]


def test_regions(spark):
    df = spark.createDataFrame([("ALM-L",), ("ALM-Left",), ("right Striatum",), ("unknown left ALM",)], "s string")
    got = values(df.select(parsing.region_canon_a(F.col("s")), parsing.region_canon_b(F.col("s"))))
    assert got == [("ALM_L", None), ("ALM_L", "left_ALM"), ("STR_R", "right_Striatum"), ("ALM_L", None)]


def test_lick_list(spark):
    df = spark.createDataFrame([("1.2; 1.3,,",), ("N/A",), (None,)], "s string")
    assert values(df.select(parsing.lick_list(F.col("s")))) == [([1.2, 1.3],), ([],), ([],)]


def test_behavior_reason_a(spark):
    cols = "outcome string, photostim_onset string, early_lick string"
    df = spark.createDataFrame(
        [(None, None, "no early"), ("", "N/A", "no early"), ("hit", "0.5", "early"), ("hit", None, "early (auto)"), ("miss", None, None)],
        cols,
    )
    got = [r[0] for r in df.select(rules.behavior_reason_a(set(df.columns), QcRules())).collect()]
    assert got == ["csv_outcome_nan", None, "csv_early_lick", None, "csv_outcome_miss"]
    absent = spark.createDataFrame([("no early",)], "early_lick string")
    assert absent.select(rules.behavior_reason_a({"early_lick"}, QcRules())).first()[0] is None


def test_early_lick_rule_sets_differ(spark):
    df = spark.createDataFrame([("early (auto)",)], "early_lick string")
    assert df.select(rules.keep_behavior_b({"early_lick"}, QcRules())).first()[0] is False


def test_outcome_wins_over_side(spark):
    df = spark.createDataFrame([(True, False, "ignore"), (True, True, "hit"), (False, True, "miss")], "l boolean, r boolean, o string")
    got = [r[0] for r in df.select(rules.action_class_b(F.col("l"), F.col("r"), F.col("o"))).collect()]
    assert got == ["Ignore", None, "Right"]


def test_bins_at_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (0.1,), (0.2999999,), (-0.1,)], "t double")
    a = raster.bin_fixed_width(F.col("t"), F.lit(0.0), 0.1, F.lit(3))
    b = raster.bin_fixed_count(F.col("t"), F.lit(0.0), F.lit(0.3), F.lit(3))
    assert values(df.select(a, b)) == [(0, 0), (2, None), (1, 1), (2, 2), (None, None)]


def test_bin_count_rounds_half_even(spark):
    df = spark.range(1)
    assert df.select(epochs.n_bins(F.lit(0.0), F.lit(2.5), 1.0)).first()[0] == 2


def test_lick_window_is_clamped(spark):
    start, stop = epochs.lick_window_b(F.lit(4.8), F.lit(4.0), F.lit(4.0), F.lit(5.0), 0.8)
    assert spark.range(1).select(start, stop).first() == (4.8, 5.0)


def test_missing_epochs_come_from_the_log(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [([nan], [nan], "1.0", "2.2")],
        "delay_start_times array<double>, go_start_times array<double>, log_delay_start_times string, log_go_start_times string",
    )
    e = epochs.resolve_epochs(set(df.columns), {"log_delay_start_times", "log_go_start_times"})
    p = Windows()
    ctx = epochs.context_window(F.lit(None).cast("double"), e["delay_start_times"], e["go_start_times"], p)
    tgt = epochs.target_window(e["go_start_times"], p)
    assert df.select(ctx[2], tgt[2]).first() == (120, 30)


def hist(spark, rows):
    return spark.createDataFrame(rows, "u long, v long, c_0 long, c_1 long, c_2 long")


def test_kruskal_rules(spark):
    df = hist(spark, [(1, 0, 2, 0, 0), (1, 1, 0, 2, 0), (1, 2, 0, 0, 2), (2, 0, 2, 0, 1), (2, 1, 1, 1, 0), (2, 3, 0, 2, 0)])
    got = {r["u"]: r for r in stats.kruskal(df, ["u"]).collect()}
    assert got[1]["h"] is None  # every class constant
    assert got[2]["df"] == 1  # the class with one trial is left out
    assert 0 < got[2]["p"] < 1


def test_kruskal_spread_equals_window(spark):
    rows = [(u, v, (u + v) % 3, (u * v) % 4, v % 2) for u in range(4) for v in range(1, 30)]
    df = hist(spark, rows)
    key = lambda d: sorted((r["u"], round(r["h"], 9)) for r in d.collect())
    assert key(stats.kruskal(df, ["u"])) == key(stats.kruskal(df, ["u"], spread=True))


def test_fdr(spark):
    df = spark.createDataFrame([("s", 1, 0.01), ("s", 2, None), ("s", 3, 0.04)], "session string, unit long, p double")
    got = {r["unit"]: r["q"] for r in stats.bh_fdr(df, ["session"]).collect()}
    assert got == {1: pytest.approx(0.02), 2: None, 3: pytest.approx(0.04)}
    df = spark.createDataFrame([("s", 1, 0.03), ("s", 2, 0.031), ("s", 3, 0.04)], "session string, unit long, p double")
    assert [round(r["q"], 9) for r in stats.bh_fdr(df, ["session"]).collect()] == [0.04] * 3


def test_fdr_with_one_large_session(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 60).cast("string"))).alias("session"),
        F.col("id").alias("unit"), ((F.xxhash64("id") % 1000 + 1000) / 2000.0 + 0.0001).alias("p"),
    )
    got = {r["unit"]: r["q"] for r in stats.bh_fdr(df, ["session"]).collect()}
    groups = {}
    for r in df.collect():
        groups.setdefault(r["session"], []).append((r["p"], r["unit"]))
    for rows in groups.values():
        rows.sort()
        low = 1.0
        for rank in range(len(rows), 0, -1):
            p, unit = rows[rank - 1]
            low = min(low, p * len(rows) / rank)
            # equal p share the smallest value of their tie
            assert got[unit] <= low + 1e-12
        assert len(rows) > 0
    assert len(got) == 3000


def moments(spark, left, right):
    rows = [("s", "r", 1, i, "Left", v) for i, v in enumerate(left)] + [("s", "r", 1, 100 + i, "Right", v) for i, v in enumerate(right)]
    ut = spark.createDataFrame(rows, "session string, region string, unit long, trial long, label string, ctx long")
    units = ut.select("session", "region", "unit").distinct()
    return stats.class_moments(ut, raster.unit_sizes(units, ut.select("session", "trial", "label").distinct()))


def test_effect_sizes_without_spread(spark):
    m = moments(spark, [2, 2, 2], [2, 2, 2])
    assert m.select(stats.cohens_d(), stats.dprime((1,), (2,)), stats.preferred_class()).first() == (0.0, 0.0, "Left")


def test_top_fraction(spark):
    df = spark.range(56).select(F.lit("s").alias("session"), F.lit("r").alias("region"), F.col("id").alias("unit"), F.col("id").cast("double").alias("score"))
    out = selection.top_fraction(df).where("selected")
    assert sorted(r["unit"] for r in out.collect()) == list(range(45, 56))


def test_class_metrics(spark):
    cells = [[6, 2, 0], [2, 18, 0], [1, 2, 17]]
    rows = [(i, j) for i in range(3) for j in range(3) for _ in range(cells[i][j])]
    m = evaluation.metrics(spark.createDataFrame(rows, "label int, pred int")).first()
    assert m["accuracy"] == pytest.approx(0.8541667, abs=1e-7)
    assert m["balanced_accuracy"] == pytest.approx(0.8333333, abs=1e-7)
    assert m["macro_f1"] == pytest.approx(0.8273147, abs=1e-7)
    assert m["n"] == 48


def test_incomplete_beta_matches_closed_form():
    import numpy as np

    from trialframe.functions.pvalues import incomplete_beta

    x = np.linspace(0.01, 0.99, 25)
    assert np.allclose(incomplete_beta(2.0, 3.0, x), 6 * x**2 - 8 * x**3 + 3 * x**4)
    assert np.allclose(incomplete_beta(0.5, 0.5, x), 2 / np.pi * np.arcsin(np.sqrt(x)))


def test_population_trace_of_selected_units(spark):
    binned = spark.createDataFrame(
        [("s", "ALM_L", 1, 7, "Left", "ctx", 0, 4), ("s", "ALM_L", 2, 7, "Left", "ctx", 0, 10)],
        "session string, region string, unit long, trial long, label string, win string, bin int, n long",
    )
    chosen = spark.createDataFrame([("s", "ALM_L", 1)], "session string, region string, unit long")
    assert [r["mean_count"] for r in raster.population_trace(binned, chosen).collect()] == [4.0]


def test_audit_counts_reasons_by_their_code(spark):
    rows = [("s", None), ("s", "csv_excluded:noise"), ("s", "csv_excluded:late start"), ("s", "label_mismatch(Left,Right)"), ("s", "csv_outcome_miss")]
    got = summary.audit_summary(spark.createDataFrame(rows, "session string, reason string"), ["csv_excluded", "csv_outcome_miss"]).first()
    assert (got["n_start"], got["n_kept"], got["n_excluded"]) == (5, 1, 4)
    assert (got["excl_csv_excluded"], got["excl_csv_outcome_miss"], got["excl_other"]) == (2, 1, 1)


def test_tail_of_one_degree(spark):
    h = [0.0, 1e-9, 0.5, 3.84, 12.0, 12.6, 40.0, 300.0]
    df = spark.createDataFrame([(float(x),) for x in h] + [(None,)], "h double")
    got = [r["p"] for r in df.select(pvalues.chi2_sf(F.col("h"), F.lit(1)).alias("p")).collect()]
    assert got[:-1] == [pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-9, abs=1e-300) for x in h] and got[-1] is None


def test_significant_digits_do_not_depend_on_the_unit(spark):
    from trialframe.functions.signal import significant

    rows = [(v * u, v, u) for u in (1.0, 1e-9, 1e6) for v in (1.23456789012, 1.23456789013, 1.2345679, -3.0)]
    df = spark.createDataFrame(rows, "x double, v double, u double").withColumn("s", significant(F.col("x")))
    per_unit = [r[0] for r in df.groupBy("u").agg(F.countDistinct("s")).select("count(DISTINCT s)").collect()]
    assert per_unit == [3, 3, 3]
    assert [r["s"] for r in spark.sql("SELECT 0.0D AS x UNION ALL SELECT 1e-25").select(significant(F.col("x")).alias("s")).collect()] == [0.0, 0.0]


def test_id_buckets_keep_the_order_and_stay_small(spark):
    from trialframe.operators.skew import id_bucket, with_position

    df = spark.range(1_000_000_000, 1_000_200_000).select(F.lit("s").alias("session"), F.col("id").alias("trial"))
    buckets = df.groupBy(id_bucket(F.col("trial")).alias("b")).count()
    assert buckets.agg(F.max("count")).first()[0] <= 1 << 16 and buckets.count() >= 4
    wrong = with_position(df, ["session"], ["trial"], id_bucket(F.col("trial"))).where("pos != trial - 1000000000 + 1")
    assert wrong.count() == 0


def test_signals_go_through_products_in_bounded_pieces(spark):
    """Mixed lengths, NULL, empty and NULL points; no product sees more than a piece of a batch."""
    rng = np.random.default_rng(4)
    rows = [(i, None if i % 50 == 0 else [] if i % 51 == 0 else rng.normal(size=64 if i % 3 else 10).tolist()) for i in range(3000)]
    rows.append((3000, [1.0, None, 2.0]))
    df = spark.createDataFrame(rows, "id long, x array<double>").coalesce(1)
    seen = signal._array_udf(lambda x: np.stack([x.sum(axis=1), np.full(len(x), float(x.size))], axis=1), "array<double>")
    got = {r["id"]: r["y"] for r in df.select("id", seen(F.col("x")).alias("y")).collect()}
    assert len(got) == 3001 and got[3000][0] is None
    for i, x in rows[:-1]:
        assert got[i] is None if not x else got[i] == [pytest.approx(sum(x)), got[i][1]]
    assert max(y[1] for y in got.values() if y) <= signal.PIECE
    maps = {r["id"]: r["m"] for r in df.where("id < 60").select("id", signal.wavelet_magnitude(F.col("x"), 0.01, 4).alias("m")).collect()}
    for i, x in rows[:60]:
        assert maps[i] is None if not x else np.allclose(maps[i], signal._wavelet_mag(np.array([x]), 0.01, 4)[0])

"""Selection, its summaries and explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import joins as J
from ..operators import raster as R
from ..operators import selection as sel
from ..operators import stats
from ..operators import summary as SM
from ..operators.lineage import cut
from ..schema import SelectionA, SelectionB
from . import binding as B
from .queries_raster import U, UK, base, counts, unit_trials
from .queries_stats import BH, DP, DUR, KW, PEARSON, PREF, PRIOR, unit_kruskal
from .registry import BASE, b, draw_sql, query, r

# The event data carry no effect, so thresholds are loose; one bin stands for 10 ms in the band settings.
LOOSE = SelectionA(min_rate_hz=0.0, min_active_frac=0.5, fdr_q=0.99, min_criteria=1, top_k=8)
BIN_S, TGT_S = 0.010, 0.050


def criteria_table(spark, sf):
    binned, tr, un = counts(spark, sf)
    criteria = sel.unit_criteria(
        binned, un, tr, n_ctx=B.N_CTX, n_tgt=B.N_TGT, late_bins=B.LATE, bin_s=BIN_S, target_bin_s=TGT_S, p=LOOSE
    )
    return sel.select_units(sel.judge_units(criteria, LOOSE), LOOSE)


@query("unit_criteria")
def unit_criteria(spark, sf):
    """Every criterion of every unit with the selection; p-values have no SQL function."""
    return criteria_table(spark, sf)


@query("selection_summary")
def selection_summary(spark, sf):
    return sel.selection_summary(criteria_table(spark, sf))


@query("criteria_share")
def criteria_share(spark, sf):
    return sel.criteria_share(criteria_table(spark, sf))


@query("bullets")
def bullets(spark, sf):
    return sel.selection_bullets(criteria_table(spark, sf), LOOSE, 400.0)


# A criteria table SQL can express: the rank test twice, once corrected.
TABLE_SQL = KW + BH + f""", af AS (
  SELECT {UK}, avg(CASE WHEN ctx > 0 THEN 1.0 ELSE 0.0 END) AS active_frac, avg(ctx) / 4.32 AS rate_hz FROM ut GROUP BY {UK}),
judged AS (
  SELECT {UK}, rate_hz, active_frac, coalesce(q < 0.99, false) AS c_selectivity, coalesce(p < 0.3, false) AS c_ramp, q, p,
    rate_hz >= 0.2 AND active_frac >= 0.5 AS pass_floor FROM af JOIN qs USING ({UK})),
el AS (SELECT *, pass_floor AND (c_selectivity OR c_ramp) AS eligible,
         CASE WHEN pass_floor THEN round(-log10(greatest(coalesce(q, 1), 1e-12)) + 0.5 * -log10(greatest(coalesce(p, 1), 1e-12)), 9) END AS score FROM judged),
tk AS (SELECT session, region, unit, row_number() OVER (PARTITION BY session, region ORDER BY score DESC, unit) AS rank FROM el WHERE eligible),
st AS (SELECT el.*, CASE WHEN tk.rank <= 6 THEN tk.rank END AS rank, coalesce(tk.rank <= 6, false) AS selected FROM el LEFT JOIN tk USING ({UK}))
"""


def simple_table(spark, sf):
    ut, sizes = unit_trials(spark, sf)
    tests = unit_kruskal(spark, sf).select(*U, "p")
    q = stats.bh_fdr(tests, ["session"])
    m = stats.class_moments(ut, sizes).select(*U, stats.mean_rate(DUR).alias("rate_hz"), stats.active_fraction().alias("active_frac"))
    none = F.lit(None).cast("double")
    t = m.join(q, U).select(
        *U, "rate_hz", "active_frac", F.col("q").alias("q_selectivity"), none.alias("q_coupling"), none.alias("q_spectral"),
        F.col("p").alias("q_ramp"),
    )
    p = SelectionA(min_rate_hz=0.2, min_active_frac=0.5, min_criteria=1, top_k=6)
    judged = (
        t.withColumn("pass_floor", (F.col("rate_hz") >= p.min_rate_hz) & (F.col("active_frac") >= p.min_active_frac))
        .withColumn("c_selectivity", F.coalesce(F.col("q_selectivity") < 0.99, F.lit(False)))
        .withColumn("c_ramp", F.coalesce(F.col("q_ramp") < 0.3, F.lit(False)))
        .withColumn("score", F.when(F.col("pass_floor"), F.round(sel.combined_score(p), 9)))
        .withColumn("eligible", F.col("pass_floor") & (F.col("c_selectivity") | F.col("c_ramp")))
    )
    judged = cut(judged)
    chosen = sel.top_k(judged.where("eligible").select(*U, "score"), p.top_k, ["session", "region"], [F.col("score").desc(), F.col("unit")])
    return judged.join(chosen.select(*U, "rank"), U, "left").withColumn("selected", F.col("rank").isNotNull())


@query("topk_region", TABLE_SQL + f"SELECT {UK}, {r('score', 'score')}, pass_floor, eligible, selected, {b('rank', 'rank')} FROM st")
def topk_region(spark, sf):
    return simple_table(spark, sf).select(*U, "score", "pass_floor", "eligible", "selected", "rank")


@query("activity_floor", TABLE_SQL + """
SELECT session, count(*) AS n_units, count(*) FILTER (NOT pass_floor) AS n_removed, count(*) FILTER (eligible) AS n_eligible,
  count(*) FILTER (c_selectivity) AS k_selectivity FROM st GROUP BY session""")
def activity_floor(spark, sf):
    """Units removed by the floor and units per criterion."""
    return simple_table(spark, sf).groupBy("session").agg(
        F.count("*").alias("n_units"), F.count_if(~F.col("pass_floor")).alias("n_removed"),
        F.count_if("eligible").alias("n_eligible"), F.count_if("c_selectivity").alias("k_selectivity"),
    )


@query("selected_summary", TABLE_SQL + "SELECT session, region, count(*) FILTER (selected) AS n_selected, count(*) AS n_total FROM st GROUP BY session, region")
def selected_summary(spark, sf):
    return sel.region_composition(simple_table(spark, sf), ["session", "region"])


@query("join_selected_semi", TABLE_SQL + f"""
SELECT c.session, c.region, c.unit, c.trial, {b('c.bin', 'bin')}, c.n FROM cells c
WHERE c.win = 'ctx' AND EXISTS (SELECT 1 FROM st WHERE st.selected AND st.session = c.session AND st.unit = c.unit)""")
def join_selected_semi(spark, sf):
    binned, _, _ = counts(spark, sf)
    chosen = simple_table(spark, sf).where("selected")
    return J.keep_selected(binned.where("win = 'ctx'"), chosen, U).select(*U, "trial", "bin", "n")


@query("neuron_set_rate", BASE + f"""
, tot AS (SELECT {UK}, sum(ctx) AS total FROM ut GROUP BY {UK}),
rk AS (SELECT *, row_number() OVER (PARTITION BY session, region ORDER BY total DESC, unit) AS rank FROM tot)
SELECT {UK}, {b('rank', 'rank')}, 'rate' AS mode FROM rk WHERE rank <= 5""")
def neuron_set_rate(spark, sf):
    ut, sizes = unit_trials(spark, sf)
    totals = ut.where("label IS NOT NULL").groupBy(*U).agg(F.sum("ctx").alias("total"))
    return sel.neuron_set(sizes, totals, "rate", 5)


@query("neuron_set_random", BASE + f"""
, p AS (SELECT session, region, unit, row_number() OVER (PARTITION BY session, region ORDER BY {draw_sql(11, 'session', 'region', 'unit')}, unit) AS rank FROM units)
SELECT session, region, unit, rank, 'random' AS mode FROM p WHERE rank <= 5""")
def neuron_set_random(spark, sf):
    un = base(spark, sf)[2]
    return sel.neuron_set(un, un, "random", 5, seed=11)


# ---------------------------------------------------------------- composite


@query("top_fraction", DP + f"""
, k AS (SELECT *, row_number() OVER (PARTITION BY session, region ORDER BY round(rate, 9) DESC, unit) AS pos, count(*) OVER (PARTITION BY session, region) AS n FROM dp)
SELECT {UK}, {b('pos', 'pos')}, pos <= greatest(1, ceil(0.18 * n)) AS selected FROM k""")
def top_fraction(spark, sf):
    ut, sizes = unit_trials(spark, sf)
    m = stats.class_moments(ut, sizes).select(*U, F.round(stats.mean_rate(DUR), 9).alias("score"))
    return sel.top_fraction(cut(m)).select(*U, "pos", "selected")


@query("top_fraction_pooled", DP + """
, u AS (SELECT session, region, row_number() OVER (PARTITION BY session, region ORDER BY unit) - 1 AS place, round(rate, 9) AS rate FROM dp),
m AS (SELECT region, place, round(avg(rate), 9) AS score FROM u GROUP BY region, place),
k AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY score DESC, place) AS pos, count(*) OVER (PARTITION BY region) AS n FROM m)
SELECT region, place, CAST(pos AS BIGINT) AS pos, pos <= greatest(1, ceil(0.18 * n)) AS selected FROM k""")
def top_fraction_pooled(spark, sf):
    """Units matched by place across sessions, as the pooled form does."""
    ut, sizes = unit_trials(spark, sf)
    m = stats.class_moments(ut, sizes).select(*U, F.round(stats.mean_rate(DUR), 9).alias("rate"))
    place = R.unit_positions(sizes).select(*U, F.col("pos").alias("unit_place"))
    pooled = m.join(place, U).groupBy("region", F.col("unit_place").alias("unit")).agg(F.round(F.avg("rate"), 9).alias("score"))
    out = sel.top_fraction(cut(pooled), keys=["region"])
    return out.select("region", F.col("unit").alias("place"), "pos", "selected")


# Composite with the weights of four criteria; the time-frequency term has its own query.
WEIGHTS = {"attention": 0.28, "prediction_gain": 0.22, "dprime": 0.22, "coupling": 0.16}
PARTIAL = SelectionB(weights=WEIGHTS, min_rate_hz=0.3)


def z_sql(c: str) -> str:
    over = "OVER (PARTITION BY session, region)"
    return f"CASE WHEN stddev_pop({c}) {over} < 1e-8 THEN 0 ELSE ({c} - avg({c}) {over}) / stddev_pop({c}) {over} END"


COMPOSITE = PEARSON + DP[len(BASE):] + PRIOR + ", " + PREF + f""", inp AS (
  SELECT a.session, a.region, a.unit, a.attention, c.coupling * (a.pd / (a.top + 1e-8)) AS prediction_gain,
    greatest(abs(d.d_lr), 0.65 * abs(d.d_li)) AS dprime, c.coupling, d.rate AS delay_rate_hz, p.preferred_class
  FROM att a JOIN cpl c USING ({UK}) JOIN dp d USING ({UK}) JOIN pref p USING ({UK})),
cs AS (
  SELECT *, round({' + '.join(f'{w} * ({z_sql(c)})' for c, w in WEIGHTS.items())} - CASE WHEN delay_rate_hz < 0.3 THEN 1.5 ELSE 0 END, 9) AS score FROM inp),
ck AS (SELECT *, row_number() OVER (PARTITION BY session, region ORDER BY score DESC, unit) AS pos, count(*) OVER (PARTITION BY session, region) AS n FROM cs),
cb AS (SELECT *, pos <= greatest(1, ceil(0.18 * n)) AS selected FROM ck)
"""


def composite(spark, sf):
    binned, tr, un = counts(spark, sf)
    inputs = sel.composite_inputs(binned, un, tr, n_ctx=B.N_CTX, n_tgt=B.N_TGT, bin_s=DUR / B.N_CTX, tf_bin_s=BIN_S)
    scored = sel.composite_score(sel.with_priors(inputs), PARTIAL).withColumn("score", F.round("score", 9))
    return sel.top_fraction(cut(scored), PARTIAL)


@query("composite_b", COMPOSITE + f"""
SELECT {UK}, {r('score', 'score')}, {b('pos', 'pos')}, selected, preferred_class, {r('attention', 'attention')}, {r('prediction_gain', 'prediction_gain')} FROM cb""")
def composite_b(spark, sf):
    return composite(spark, sf).select(*U, "score", "pos", "selected", "preferred_class", "attention", "prediction_gain")


@query("composite_full")
def composite_full(spark, sf):
    """All five criteria with their reasons."""
    binned, tr, un = counts(spark, sf)
    inputs = sel.composite_inputs(binned, un, tr, n_ctx=B.N_CTX, n_tgt=B.N_TGT, bin_s=DUR / B.N_CTX, tf_bin_s=BIN_S)
    scored = cut(sel.composite_score(sel.with_priors(inputs)))
    return sel.selection_table_b(sel.top_fraction(scored)).drop("prior_dprime", "pos")


@query("laterality", COMPOSITE + f"""
SELECT {r("coalesce(avg(CASE WHEN selected AND region = 'ALM_L' THEN CASE WHEN preferred_class = 'Right' THEN 1.0 ELSE 0.0 END END), 0)", 'left_ALM_right_pref')},
  {r("coalesce(avg(CASE WHEN selected AND region = 'ALM_R' THEN CASE WHEN preferred_class = 'Left' THEN 1.0 ELSE 0.0 END END), 0)", 'right_ALM_left_pref')},
  count(*) FILTER (selected AND region = 'ALM_L') AS "n_selected_left_ALM", count(*) FILTER (selected AND region = 'ALM_R') AS "n_selected_right_ALM" FROM cb""")
def laterality(spark, sf):
    return sel.laterality(composite(spark, sf))


@query("region_composition", COMPOSITE + "SELECT region, count(*) FILTER (selected) AS n_selected, count(*) AS n_total FROM cb GROUP BY region")
def region_composition(spark, sf):
    return sel.region_composition(composite(spark, sf))


@query("unit_types", COMPOSITE + f"""
SELECT {UK}, selected, CASE WHEN unit % 3 = 0 THEN 'delay_choice' WHEN unit % 3 = 1 THEN 'delay_ramp' END AS unit_type FROM cb""")
def unit_types(spark, sf):
    un = base(spark, sf)[2]
    kind = F.when(F.col("unit") % 3 == 0, "delay_choice").when(F.col("unit") % 3 == 1, "delay_ramp")
    types = un.withColumn("unit_type", kind).where("unit_type IS NOT NULL")
    return sel.attach_unit_type(composite(spark, sf), types).select(*U, "selected", "unit_type")


@query("limits", COMPOSITE + f"""
, o AS (SELECT {UK}, score, selected FROM cb WHERE selected ORDER BY score DESC, session, unit LIMIT 12)
SELECT {UK}, {r('score', 'score')}, selected FROM o""")
def limits(spark, sf):
    """The twelve best selected units of the report."""
    rows = composite(spark, sf).where("selected").select(*U, "score", "selected")
    return SM.top_rows(rows, 12, [F.col("score").desc(), F.col("session"), F.col("unit")])


@query("score_order", COMPOSITE + f"SELECT {UK}, selected, {r('score', 'score')} FROM cb ORDER BY selected DESC, score DESC, session, unit")
def score_order(spark, sf):
    rows = composite(spark, sf).select(*U, "selected", "score")
    return rows.orderBy(F.col("selected").desc(), F.col("score").desc(), "session", "unit")


# ---------------------------------------------------------------- text

# Text columns over a wide value range, so that every branch is written.
TEXT_SQL = """
WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS a, l_discount * 10 AS d, l_tax * 12.5 AS e, l_quantity, l_partkey FROM lineitem)
"""


@query("reasons_a", TEXT_SQL + """
, y AS (SELECT *, l_quantity >= 10 AS fl, d < 0.35 AS c1, e < 0.35 AS c2, l_partkey % 3 = 0 AS c3, l_partkey % 4 = 0 AS c4 FROM x)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN NOT fl THEN printf('below activity floor (%.1f Hz, active %.0f%%)', l_quantity, l_quantity * 2)
  WHEN NOT (c1 OR c2 OR c3 OR c4) THEN 'no significant criterion'
  ELSE concat_ws('; ',
    CASE WHEN c1 THEN printf('choice-selective delay rate (q=%.1e, eta2=%.2f, d(L-R)=%+.2f)', (l_partkey + 1) / 100000.0, l_quantity / 100, l_quantity / 4) END,
    CASE WHEN c2 THEN printf('late-delay rate predicts own response rate (rho=%+.2f, q=%.1e)', l_quantity / -100, (l_partkey + 1) / 1000000.0) END,
    CASE WHEN c3 THEN printf('class-dependent theta-band wavelet power (q=%.1e)', (l_partkey + 1) / 1000.0) END,
    CASE WHEN c4 THEN printf('down-ramping delay PSTH (rho=%+.2f, q=%.1e)', l_quantity / -100, (l_partkey + 1) / 10000.0) END) END AS reasons FROM y""")
def reasons_a(spark, sf):
    li = B.table(spark, sf, "lineitem")
    q, k = F.col("l_quantity"), (F.col("l_partkey") + 1).cast("double")
    df = li.select(
        "l_orderkey", "l_linenumber", q.alias("rate_hz"), (q / 50).alias("active_frac"), (q >= 10).alias("pass_floor"),
        (F.col("l_discount") * 10 < 0.35).alias("c_selectivity"), (F.col("l_tax") * 12.5 < 0.35).alias("c_coupling"),
        (F.col("l_partkey") % 3 == 0).alias("c_spectral"), (F.col("l_partkey") % 4 == 0).alias("c_ramp"),
        (k / 100000).alias("q_selectivity"), (q / 100).alias("eta_sq"), (q / 4).alias("d_left_right"),
        (-q / 100).alias("rho_coupling"), (k / 1000000).alias("q_coupling"), F.lit("theta").alias("spectral_band"),
        (k / 1000).alias("q_spectral"), (-q / 100).alias("ramp_rho"), (k / 10000).alias("q_ramp"),
    )
    return df.select("l_orderkey", "l_linenumber", text.reasons_a().alias("reasons"))


@query("reasons_b", TEXT_SQL + """
, y AS (SELECT *, l_quantity / 50 AS dp, l_discount_ * 5 AS cp, l_tax_ / 2 AS tf FROM (SELECT *, d / 10 AS l_discount_, e / 12.5 AS l_tax_ FROM x)),
z AS (SELECT *, list_filter([
  CASE WHEN dp > 0.8 THEN printf('Choice-discriminative delay rate (d′=%.2f vs other actions; prefers Left).', dp) END,
  CASE WHEN cp > 0.25 THEN printf('Delay PSTH shape predicts this unit’s lick-period PSTH (r=%.2f).', cp) END,
  CASE WHEN tf > 0.02 THEN printf('Delay-period β/low-γ wavelet power is class-modulated (TF score=%.2f).', tf) END,
  CASE WHEN l_partkey % 2 = 0 THEN printf('Neuron attention is high (a=%.3f); the unit is used as past context.', l_quantity / 1000) END,
  CASE WHEN l_partkey % 5 = 0 THEN printf('Occluding this unit raises lick-raster prediction error (ΔMSE gain=%.3f).', l_quantity / 1000) END,
  CASE WHEN l_partkey % 3 = 0 THEN 'Ground-truth type: persistent delay-choice cell — the ALM preparatory motif of Li/Inagaki/Svoboda.' END,
  CASE WHEN l_quantity < 5 THEN 'Low delay rate; kept only if other scores remain high.' END], lambda s: s IS NOT NULL) AS l FROM y)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN len(l) = 0 THEN 'Composite score above the regional threshold from weaker combined cues.'
  ELSE array_to_string(l, ' | ') END AS reasons FROM z""")
def reasons_b(spark, sf):
    li = B.table(spark, sf, "lineitem")
    q, k = F.col("l_quantity"), F.col("l_partkey")
    df = li.select(
        "l_orderkey", "l_linenumber", (q / 50).alias("dprime"), F.lit("Left").alias("preferred_class"),
        (F.col("l_discount") * 10 / 10 * 5).alias("coupling"), (F.col("l_tax") * 12.5 / 12.5 / 2).alias("tf_selectivity"),
        F.when(k % 2 == 0, q / 1000).otherwise(0.0).alias("attention"),
        F.when(k % 5 == 0, q / 1000).otherwise(0.0).alias("prediction_gain"),
        F.when(k % 3 == 0, "delay_choice").alias("kind"), F.when(q < 5, 0.1).otherwise(1.0).alias("delay_rate_hz"),
    )
    return df.select("l_orderkey", "l_linenumber", text.reasons_b(F.col("kind")).alias("reasons"))


@query("badges", TABLE_SQL + f"SELECT {UK}, CASE WHEN c_selectivity THEN 'S' ELSE '' END || CASE WHEN c_ramp THEN 'R' ELSE '' END AS badges FROM st")
def badges(spark, sf):
    t = simple_table(spark, sf).withColumns({"c_coupling": F.lit(False), "c_spectral": F.lit(False)})
    return t.select(*U, text.badges().alias("badges"))

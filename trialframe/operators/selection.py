"""Unit criteria, scores and selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signal as S
from ..functions import text
from ..schema import CLASSES, CRITERIA, REGION_LABELS, REGIONS, UNIT, SelectionA, SelectionB
from . import stats
from .lineage import cut, written
from .raster import psth, psth_arrays, unit_sizes, unit_trial_counts
from .skew import draw, hash_bucket, value_bucket, with_position
from .spectral import spectral_selectivity_a, tf_selectivity_b

U = list(UNIT)


# ---------------------------------------------------------------- criteria selection


def unit_criteria(
    binned: DataFrame, units: DataFrame, trials: DataFrame, *, n_ctx: int, n_tgt: int, late_bins: int,
    bin_s: float, target_bin_s: float, p: SelectionA = SelectionA(),
) -> DataFrame:
    """One row per unit with rates, effect sizes, four p-values and their session-wide q-values.

    The binned counts feed five statistics, so they are written once; the spikes are read and joined once.
    """
    binned = written(binned)
    sizes = cut(unit_sizes(units, trials))
    per_trial = cut(unit_trial_counts(binned, n_ctx, late_bins))
    moments = stats.class_moments(per_trial, sizes)
    duration = n_ctx * bin_s
    base = moments.select(
        *U,
        stats.mean_rate(duration).alias("rate_hz"),
        stats.active_fraction().alias("active_frac"),
        stats.eta_squared().alias("eta_sq"),
        stats.cohens_d().alias("d_left_right"),
        *[stats.mean_rate(duration, i).alias(f"mean_rate_{c}") for i, c in enumerate(CLASSES)],
    )
    selectivity = stats.kruskal(stats.class_histogram(per_trial, sizes), U).select(*U, F.col("p").alias("p_selectivity"))
    coupling = stats.spearman_coupling(per_trial, sizes).select(
        *U, F.col("rho").alias("rho_coupling"), F.col("p").alias("p_coupling")
    )
    spectral = spectral_selectivity_a(binned, sizes, n_ctx, bin_s, p.bands_hz, p.smoothing_sigma_bins)
    traces = psth_arrays(psth(binned, sizes), sizes, n_ctx, n_tgt)
    smoothed = S.gaussian_smooth(S.rate(F.col("ctx"), bin_s), p.smoothing_sigma_bins)
    ramp = stats.spearman_ramp(traces, smoothed).select(*U, F.col("rho").alias("ramp_rho"), F.col("p").alias("p_ramp"))
    table = reduce(lambda a, b: a.join(b, U, "left"), [base, selectivity, coupling, spectral, ramp])
    return with_q_values(table)


def with_q_values(table: DataFrame, criteria: tuple[str, ...] = CRITERIA) -> DataFrame:
    """Adds q_<criterion>: one correction per session and criterion, all regions pooled."""
    table = cut(table)
    entries = F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(f"p_{c}").alias("p")) for c in criteria])
    long = table.select(*U, F.inline(entries))
    q = stats.bh_fdr(long, ["session", "criterion"], settled=True)
    wide = q.groupBy(*U).agg(*[F.max(F.when(F.col("criterion") == c, F.col("q"))).alias(f"q_{c}") for c in criteria])
    return table.join(wide, U, "left")


def combined_score(p: SelectionA) -> Column:
    """Weighted -log10 q over the criteria; a missing q counts as 1."""
    terms = [
        F.lit(float(p.weights[c])) * -F.log10(F.greatest(F.coalesce(F.col(f"q_{c}"), F.lit(1.0)), F.lit(1e-12)))
        for c in CRITERIA
    ]
    return stats.add(terms)


def judge_units(criteria: DataFrame, p: SelectionA = SelectionA()) -> DataFrame:
    """Floor, criterion flags, score (NULL below the floor) and eligibility."""
    flags = {f"c_{c}": F.coalesce(F.col(f"q_{c}") < p.fdr_q, F.lit(False)) for c in CRITERIA}
    floor = (F.col("rate_hz") >= p.min_rate_hz) & (F.col("active_frac") >= p.min_active_frac)
    return (
        criteria.withColumn("pass_floor", F.coalesce(floor, F.lit(False)))
        .withColumns(flags)
        .withColumn("n_criteria", stats.add(F.col(f"c_{c}").cast("int") for c in CRITERIA))
        .withColumn("score", F.when(F.col("pass_floor"), combined_score(p)))
        .withColumn("eligible", F.col("pass_floor") & (F.col("n_criteria") >= p.min_criteria))
    )


def top_k(df: DataFrame, k: int, keys: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """First k rows per group. The limit is applied per task before the shuffle, so a group is never
    moved whole."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def select_units(judged: DataFrame, p: SelectionA = SelectionA()) -> DataFrame:
    """Adds rank, selected and reasons: the top_k eligible units per session and region."""
    chosen = top_k(
        judged.where("eligible").select(*U, "score"), p.top_k, ["session", "region"], [F.col("score").desc(), F.col("unit")]
    ).select(*U, "rank")
    return (
        judged.join(chosen, U, "left")
        .withColumn("selected", F.col("rank").isNotNull())
        .withColumn("reasons", text.reasons_a())
    )


def selection_summary(table: DataFrame) -> DataFrame:
    """Per session: units, eligible, selected, per-region counts and criterion shares."""
    aggs = [
        F.count("*").alias("n_units"),
        F.count_if("eligible").alias("n_eligible"),
        F.count_if("selected").alias("n_selected"),
    ]
    for r in REGIONS:
        here = F.col("region") == r
        aggs += [F.count_if(here & F.col("selected")).alias(f"sel_{r}"), F.count_if(here).alias(f"tot_{r}")]
    aggs += [F.avg(F.col(f"c_{c}").cast("double")).alias(f"frac_{c}") for c in CRITERIA]
    return table.groupBy("session").agg(*aggs)


def criteria_share(table: DataFrame) -> DataFrame:
    """Mean over sessions of the share of selected units that meet each criterion."""
    per_session = table.where("selected").groupBy("session").agg(
        *[F.avg(F.col(f"c_{c}").cast("double")).alias(c) for c in CRITERIA]
    )
    return per_session.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in CRITERIA])


def selection_bullets(table: DataFrame, p: SelectionA, late_ms: float, per_region: int = 2) -> DataFrame:
    """Summary lines per session, then the best units of every region, in display order."""
    counts = table.groupBy("session").agg(
        F.count("*").alias("n"),
        F.count_if("selected").alias("s"),
        F.count_if(~F.col("pass_floor")).alias("removed"),
        *[F.count_if(f"c_{c}").alias(f"k_{c}") for c in CRITERIA],
    )
    lines = F.array(
        F.format_string(
            f"%d/%d units selected (top-{p.top_k} per region, >= {p.min_criteria} criteria, BH-FDR q < {p.fdr_q}).",
            F.col("s"), F.col("n"),
        ),
        F.format_string(
            f"Activity floor: mean delay rate >= {p.min_rate_hz} Hz and spiking on >= "
            f"{int(p.min_active_frac * 100)}%% of trials (%d units removed).",
            F.col("removed"),
        ),
        F.format_string(
            "S  choice selectivity: Kruskal-Wallis on delay spike counts across Ignore/Left/Right (%d units).",
            F.col("k_selectivity"),
        ),
        F.format_string(
            f"C  coupling: late-delay ({late_ms:g} ms) rate predicts the unit's own response-epoch rate (Spearman) (%d units).",
            F.col("k_coupling"),
        ),
        F.format_string(
            "W  wavelet: class-dependent Morlet band power (slow/theta/beta) in the delay (%d units).", F.col("k_spectral")
        ),
        F.format_string("R  ramping: monotonic delay PSTH trend (%d units).", F.col("k_ramp")),
    )
    head = counts.select("session", F.posexplode(lines).alias("line", "bullet"))
    order = F.coalesce(*[F.when(F.col("region") == r, F.lit(i)) for i, r in enumerate(REGIONS)])
    units = table.where(F.col("selected") & (F.col("rank") <= per_region)).select(
        "session",
        (F.lit(6) + order * per_region + F.col("rank") - 1).cast("int").alias("line"),
        F.concat(
            F.coalesce(*[F.when(F.col("region") == r, F.lit(x)) for r, x in zip(REGIONS, REGION_LABELS, strict=True)], F.col("region")),
            F.format_string(" #%d (unit %s): ", F.col("rank"), F.col("unit").cast("string")), F.col("reasons")
        ).alias("bullet"),
    )
    return head.unionByName(units)


# ---------------------------------------------------------------- choice of the input set


def neuron_set(table: DataFrame, totals: DataFrame, mode: str, k: int, seed: int = 0) -> DataFrame:
    """Units used as model input: `criteria`, `rate` (largest total count) or `random` (seeded hash order)."""
    keys = ["session", "region"]
    if mode == "criteria":
        chosen = table.where(F.col("selected") & (F.col("rank") <= k)).select(*U, "rank")
    elif mode == "rate":
        ranked = table.select(*U).join(totals.select(*U, "total"), U, "left").fillna(0, ["total"])
        chosen = top_k(ranked, k, keys, [F.col("total").desc(), F.col("unit")]).select(*U, "rank")
    elif mode == "random":
        chosen = top_k(
            table.select(*U).withColumn("_h", draw(seed, *U)), k, keys, [F.col("_h"), F.col("unit")]
        ).select(*U, "rank")
    else:
        raise ValueError(mode)
    return chosen.withColumn("mode", F.lit(mode))


# ---------------------------------------------------------------- composite selection


def composite_inputs(
    binned: DataFrame, units: DataFrame, trials: DataFrame, *, n_ctx: int, n_tgt: int, bin_s: float, tf_bin_s: float | None = None
) -> DataFrame:
    """Unit rows with d', coupling, time-frequency selectivity, delay rate and preferred class."""
    duration = n_ctx * bin_s
    binned = written(binned)
    sizes = cut(unit_sizes(units, trials))
    moments = stats.class_moments(unit_trial_counts(binned, n_ctx, n_ctx), sizes).select(
        *U,
        stats.choice_score(duration).alias("dprime"),
        stats.prior_dprime(duration).alias("prior_dprime"),
        stats.mean_rate(duration).alias("delay_rate_hz"),
        stats.preferred_class().alias("preferred_class"),
    )
    traces = psth_arrays(psth(binned, sizes), sizes, n_ctx, n_tgt)
    coupling = stats.pearson_arrays(traces, U, F.col("ctx"), S.resample(F.col("tgt"), n_ctx))
    by_class = psth_arrays(psth(binned, sizes, by_class=True), sizes, n_ctx, n_tgt, ("label",))
    tf = tf_selectivity_b(by_class, U, "ctx", tf_bin_s or bin_s)
    table = moments.join(coupling, U, "left").join(tf, U, "left").fillna(0.0, ["coupling", "tf_selectivity"])
    # read several times by the priors, z-scores and positions
    return cut(table)


def with_priors(inputs: DataFrame, keys: list[str] = ["session", "region"]) -> DataFrame:
    """Stand-in attention and gain weights where no trained model supplies them."""
    out = stats.softmax_prior(inputs, keys, "prior_dprime")
    return stats.gain_prior(out, keys, "prior_dprime", "coupling")


def composite_score(inputs: DataFrame, p: SelectionB = SelectionB(), keys: list[str] = ["session", "region"]) -> DataFrame:
    """Weighted sum of z-scores in the region, less the penalty for near-silent units."""
    cols = list(p.weights)
    z = stats.zscore(inputs, keys, cols)
    total = stats.add(F.lit(w) * F.col(f"z_{c}") for c, w in p.weights.items())
    silent = F.when(F.col("delay_rate_hz") < p.min_rate_hz, F.lit(p.silent_penalty)).otherwise(0.0)
    return z.withColumn("score", total - silent).drop(*[f"z_{c}" for c in cols])


def top_fraction(scored: DataFrame, p: SelectionB = SelectionB(), keys: list[str] = ["session", "region"], value: str = "score") -> DataFrame:
    """Marks the best ceil(fraction * n) units per group, at least one. The position comes from score
    buckets, so a large group is not sorted by one task. Pooled form: pass keys without the session."""
    ties = [c for c in ("session", "unit") if c in scored.columns and c not in keys]
    ranked = with_position(
        scored, keys, [F.col(value).desc(), *ties], value_bucket(-F.col(value)), out="pos", total="n_group"
    )
    k = F.greatest(F.lit(1), F.ceil(F.col("n_group") * F.lit(p.top_fraction)))
    return ranked.withColumn("selected", F.col("pos") <= k).drop("n_group")


def selection_table_b(selected: DataFrame, unit_type: str | None = None) -> DataFrame:
    kind = F.col(unit_type) if unit_type else None
    return selected.withColumn("reasons", text.reasons_b(kind))


def attach_unit_type(scored: DataFrame, types: DataFrame) -> DataFrame:
    """Optional ground-truth type per unit."""
    return scored.join(types.select(*U, "unit_type"), U, "left")


def laterality(selected: DataFrame, left: str = "ALM_L", right: str = "ALM_R", by: list[str] = []) -> DataFrame:
    """Share of selected left-ALM units that prefer Right and of right-ALM units that prefer Left."""
    chosen = F.col("selected")

    def share(region: str, cls: str) -> Column:
        mine = chosen & (F.col("region") == region)
        return F.coalesce(F.avg(F.when(mine, (F.col("preferred_class") == cls).cast("double"))), F.lit(0.0))

    return selected.groupBy(*by).agg(
        share(left, "Right").alias("left_ALM_right_pref"),
        share(right, "Left").alias("right_ALM_left_pref"),
        F.count_if(chosen & (F.col("region") == left)).alias("n_selected_left_ALM"),
        F.count_if(chosen & (F.col("region") == right)).alias("n_selected_right_ALM"),
    )


def region_composition(selected: DataFrame, keys: list[str] = ["region"]) -> DataFrame:
    return selected.groupBy(*keys).agg(F.count_if("selected").alias("n_selected"), F.count("*").alias("n_total"))


def random_position(units: DataFrame, keys: list[str], seed: int, out: str = "pos") -> DataFrame:
    """Seeded random order within the group, cut by the leading bits of the hash."""
    hashed = units.withColumn("_h", draw(seed, *U))
    return with_position(hashed, keys, ["_h", "unit"], hash_bucket(F.col("_h")), out).drop("_h")

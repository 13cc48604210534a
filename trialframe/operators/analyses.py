"""Documented follow-up analyses built from the other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CLASSES
from . import evaluation as E
from . import models as M
from . import stats
from .lineage import written
from .skew import attach, draw, hash_bucket, with_position


def laterality_by_weight(weights: DataFrame, keys: list[str]) -> DataFrame:
    """Contralateral minus ipsilateral summed ALM weight per class, selected and rejected units apart.

    `weights`: region, label, selected, w. Ignore counts right minus left.
    """
    left, right = F.col("region") == "ALM_L", F.col("region") == "ALM_R"
    contra = F.when(F.col("label") == "Left", right).otherwise(left)
    ipsi = F.when(F.col("label") == "Left", left).otherwise(right)
    total = F.sum(F.when(contra, F.col("w")).otherwise(0.0)) - F.sum(F.when(ipsi, F.col("w")).otherwise(0.0))
    return weights.where(left | right).groupBy(*keys, "label", "selected").agg(total.alias("laterality"))


def transfer_matrix(context: DataFrame, target: DataFrame, areas: list[str], keys: list[str] = ["session", "trial"]) -> DataFrame:
    """Fit of each area's target rate on each area's context rate across trials.

    `context` and `target`: (keys, area, rate), one row per trial and area.
    """
    x = context.select(*keys, F.col("area").alias("src"), F.col("rate").alias("x"))
    y = target.select(*keys, F.col("area").alias("dst"), F.col("rate").alias("y"))
    agg = x.join(y, keys).groupBy("src", "dst").agg(
        F.count("*").alias("n"), F.covar_pop("x", "y").alias("cov"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy")
    )
    slope = F.try_divide(F.col("cov"), F.nullif(F.col("vx"), F.lit(0.0)))
    r2 = F.try_divide(F.col("cov") * F.col("cov"), F.nullif(F.col("vx") * F.col("vy"), F.lit(0.0)))
    return agg.where(F.col("src").isin(*areas) & F.col("dst").isin(*areas)).select(
        "src", "dst", "n", slope.alias("slope"), r2.alias("r2")
    )


def type_overlap(selected: DataFrame, dataset: str, kind: str, a, b) -> DataFrame:
    """Jaccard overlap of the selected types of two datasets."""
    per_type = selected.groupBy(kind).agg(
        F.max((F.col(dataset) == a).cast("int")).alias("in_a"), F.max((F.col(dataset) == b).cast("int")).alias("in_b")
    )
    return _jaccard(per_type, [])


def _jaccard(per_type: DataFrame, keys: list[str]) -> DataFrame:
    both = F.count_if((F.col("in_a") == 1) & (F.col("in_b") == 1))
    any_ = F.count_if((F.col("in_a") == 1) | (F.col("in_b") == 1))
    return per_type.groupBy(*keys).agg(
        both.alias("n_both"), any_.alias("n_any"), F.coalesce(F.try_divide(both, any_), F.lit(0.0)).alias("jaccard")
    )


def type_overlap_null(selected: DataFrame, dataset: str, kind: str, a, b, ids: list[str], n: int, seed: int) -> DataFrame:
    """The same overlap with the types permuted over units, one row per replicate."""
    rows = selected.select(*ids, F.col(kind).alias("label"), F.col(dataset).alias("pred"))
    shuffled = E.shuffle_labels(rows, ids, n, seed)
    per_type = shuffled.groupBy("rep", "label").agg(
        F.max((F.col("pred") == a).cast("int")).alias("in_a"), F.max((F.col("pred") == b).cast("int")).alias("in_b")
    )
    return _jaccard(per_type, ["rep"])


def centre_of_mass(weights: DataFrame, keys: list[str], bin_s: float, after_s: float) -> DataFrame:
    """Weighted mean time of the bin centres and whether it lies after the given time."""
    t = (F.col("bin") + 0.5) * bin_s
    com = F.try_divide(F.sum(F.col("w") * t), F.sum("w"))
    return weights.groupBy(*keys).agg(com.alias("centre"), (com > after_s).alias("is_late"))


def session_bootstrap(preds: DataFrame, n: int = 200, seed: int = 0) -> DataFrame:
    """Percentile interval of the class metrics under resampling of whole sessions with replacement.

    Sessions are reduced to confusion counts; a replicate is a sum of drawn sessions' counts.
    """
    per_session = E.confusion_counts(preds, ["session"]).withColumn("_h", draw(seed, "session"))
    numbered = with_position(per_session, [], ["_h", "session"], hash_bucket(F.col("_h"), 12), "_pos", "_n").drop("_h")
    reps = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # as many draws per replicate as there are sessions: every session slot draws one position
    draws = (
        numbered.select("_pos", "_n", reps.alias("rep"))
        .withColumn("_draw", F.pmod(draw(seed, "rep", "_pos"), F.col("_n")) + 1)
        .groupBy("rep", "_draw")
        .agg(F.count("*").alias("_times"))
    )
    cells = [f"c_{i}{j}" for i in E.C for j in E.C]
    joined = draws.join(numbered.select(F.col("_pos").alias("_draw"), *cells), "_draw")
    totals = joined.groupBy("rep").agg(*[F.sum(F.col(c) * F.col("_times")).alias(c) for c in cells])
    scores = E.metrics_of(totals, ["rep"])
    out = []
    for m in ("accuracy", "balanced_accuracy", "macro_f1"):
        q = F.percentile(m, F.array(F.lit(0.025), F.lit(0.975)))
        out += [F.avg(m).alias(f"{m}_mean"), q[0].alias(f"{m}_low"), q[1].alias(f"{m}_high")]
    return scores.agg(*out, F.count("*").alias("n_replicates"))


def permute_labels_in_session(trials: DataFrame, n: int, seed: int) -> DataFrame:
    """n relabelled copies of the trials: labels move between trials of one session only."""
    rows = trials.where(F.col("label").isNotNull()).select("session", "trial", "label", F.col("trial").alias("pred"))
    out = E.shuffle_labels(rows, ["session", "trial"], n, seed, ["session"])
    return out.select("rep", "session", F.col("pred").alias("trial"), "label")


def selection_null(
    unit_trials: DataFrame, units: DataFrame, trials: DataFrame, n: int, seed: int, *,
    duration: float, min_rate: float, min_active: float, fdr_q: float, top_k: int,
) -> DataFrame:
    """The units that a selection by choice selectivity keeps when the labels are permuted inside sessions.

    The replicate is a key of the whole chain: rank test, q-values per replicate and session, activity floor, and the
    first `top_k` units by q (ties to the lower unit) of each replicate, session and region. Rates and active trials
    do not depend on the labels, so the floor is taken before the trials are copied; a trial joins its copies by a
    key that is dealt by unit as well. Gives rep, session, region, unit, p, q and rank.
    """
    ids = ["session", "region", "unit"]
    key = ["rep", *ids]
    labelled = trials.where(F.col("label").isNotNull())
    sizes = labelled.groupBy("session").agg(F.count("*").alias("n_trials"))
    active = unit_trials.where("label IS NOT NULL AND ctx > 0").groupBy(*ids).agg(F.sum("ctx").alias("total"), F.count("*").alias("fired"))
    floor = attach(active, sizes, ["session"], ["unit"], how="inner").where(
        (F.col("total") / F.col("n_trials") / duration >= min_rate) & (F.col("fired") / F.col("n_trials") >= min_active)
    ).select(*ids, "fired")
    fake = written(permute_labels_in_session(trials, n, seed))
    k = [F.count_if(F.col("label") == c) for c in CLASSES]
    copies = fake.groupBy("session", "trial").agg(F.collect_list(F.struct("rep", "label")).alias("copies"))
    seen = attach(unit_trials.where("ctx > 0").drop("label"), copies, ["session", "trial"], ["unit"], how="inner")
    seen = seen.select(*ids, F.col("ctx").alias("v"), F.inline("copies"))
    seen = written(seen.groupBy(*key, "v").agg(*[c.alias(f"c_{i}") for i, c in enumerate(k)]))
    classes = fake.groupBy("rep", "session").agg(*[c.alias(f"n_{i}") for i, c in enumerate(k)])
    classes = classes.groupBy("session").agg(F.collect_list(F.struct("rep", *[f"n_{i}" for i in stats.K])).alias("sizes"))
    base = attach(units.select(*ids), classes, ["session"], ["unit"], how="inner").select(*ids, F.inline("sizes"))
    fired = seen.groupBy(*key).agg(*[F.sum(f"c_{i}").alias(f"x_{i}") for i in stats.K])
    zeros = base.join(fired, key, "left").select(
        *key, F.lit(0).cast("long").alias("v"),
        *[(F.col(f"n_{i}") - F.coalesce(F.col(f"x_{i}"), F.lit(0))).alias(f"c_{i}") for i in stats.K],
    )
    tests = stats.kruskal(seen.unionByName(zeros), key).select(*key, "p")
    q = stats.bh_fdr(tests, ["rep", "session"])
    kept = q.where(F.col("q") < fdr_q).join(floor.select(*ids), ids, "left_semi")
    first = Window.partitionBy("rep", "session", "region").orderBy(F.round("q", 9), "unit")
    return kept.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top_k).select(*key, "p", "q", "rank")


def pooled_rates(binned: DataFrame, units: DataFrame, n_ctx: int) -> DataFrame:
    """Mean context count per bin and unit of each region and labelled trial: features that all datasets share.

    Gives session, trial, region and x; a region without spikes in a trial has no row."""
    size = units.groupBy("session", "region").agg(F.count("*").alias("n_units"))
    rows = binned.where((F.col("win") == "ctx") & F.col("label").isNotNull()).groupBy("session", "trial", "region").agg(F.sum("n").alias("n"))
    return attach(rows, size, ["session", "region"], ["trial"], how="inner").select(
        "session", "trial", "region", (F.col("n") / (F.col("n_units") * n_ctx)).alias("x"))


def fitted_transfer(pooled: DataFrame, trials: DataFrame, dataset: str = "dataset", **options) -> tuple[DataFrame, DataFrame, M.LinearModel]:
    """Fit each dataset's trials on their pooled rates, all directions as one fit.

    The dataset trained on takes the place of the session, a region that of the unit, and (session, trial) that of the
    trial. Gives the features, the trials with `split` (train or test), both keyed that way, and the model.
    """
    both = written(dataset_transfer(trials.where(F.col("label").isNotNull()), dataset))
    key = F.struct("session", "trial").alias("trial")
    keyed = both.select(F.col("train_on").alias("session"), key, "label", "split")
    x = pooled.join(both.select("session", "trial", "train_on"), ["session", "trial"])
    x = written(x.select(F.col("train_on").alias("session"), "region", F.lit(0).cast("long").alias("unit"), key, "x"))
    return x, keyed, M.fit_linear(x, keyed.where("split = 'train'").drop("split"), **options)


def occluded_forecast(
    binned: DataFrame, sets: DataFrame, trials: DataFrame, train, *, n_ctx: int, late_bins: int, n_tgt: int, weight: float = 1.0,
) -> DataFrame:
    """Poisson log loss of a region's target counts, forecast with only the units of one set in sight.

    `sets` is (set, session, region, unit). The forecast of a bin is the region's mean count in that bin over the
    training trials (`train`), times a gain: the late context count of the set's units in this trial over its
    training mean, both raised by `weight` so that a silent set gives the mean. Other units are occluded. Per set and region
    the mean over all held-back trials and bins, silent ones included: the sum over bins of mu needs no cells.
    """
    ids = ["session", "region"]
    tr = trials.where(F.col("label").isNotNull()).select("session", "trial", F.expr(train).alias("training"))
    n_train = tr.groupBy("session").agg(F.count_if("training").alias("n_train"))
    cells = binned.where(F.col("label").isNotNull()).join(tr, ["session", "trial"])
    target = written(cells.where("win = 'tgt'").groupBy(*ids, "trial", "training", "bin").agg(F.sum("n").alias("y")))
    base = attach(target.where("training").groupBy(*ids, "bin").agg(F.sum("y").alias("s")), n_train, ["session"], ["bin"], how="inner")
    base = written(base.select(*ids, "bin", (F.col("s") / F.col("n_train")).alias("mu")))
    late = cells.where((F.col("win") == "ctx") & (F.col("bin") >= n_ctx - late_bins))
    late = late.join(sets, [*ids, "unit"]).groupBy("set", *ids, "trial").agg(F.sum("n").alias("late"))
    grid = attach(tr, sets.groupBy("session").agg(F.collect_set(F.struct("set", "region")).alias("pairs")), ["session"], ["trial"], how="inner")
    grid = grid.select("session", "trial", "training", F.inline("pairs")).join(late, ["set", *ids, "trial"], "left")
    grid = written(grid.withColumn("late", F.coalesce("late", F.lit(0))))
    means = grid.where("training").groupBy("set", *ids).agg(F.avg("late").alias("mean"))
    gains = attach(grid.where("NOT training"), means, ["set", *ids], ["trial"], how="inner").select(
        "set", *ids, "trial", ((F.col("late") + weight) / (F.col("mean") + weight)).alias("gain"))
    gains = written(gains)
    rate = base.groupBy(*ids).agg(F.sum("mu").alias("total"))
    expected = attach(gains, rate, ids, ["trial"]).groupBy("set", "region").agg(
        F.count("*").alias("n_trials"), F.sum(F.col("gain") * F.coalesce("total", F.lit(0.0))).alias("expected"))
    seen = target.where("NOT training").join(base, [*ids, "bin"], "left").join(gains, [*ids, "trial"])
    hits = seen.groupBy("set", "region").agg(
        F.sum("y").alias("spikes"), F.sum(F.col("y") * F.ln(F.greatest(F.coalesce("mu", F.lit(0.0)) * F.col("gain"), F.lit(1e-3)))).alias("log"))
    done = expected.join(hits, ["set", "region"], "left")
    nll = (F.col("expected") - F.coalesce("log", F.lit(0.0))) / (F.col("n_trials") * n_tgt)
    return done.select("set", "region", "n_trials", F.coalesce("spikes", F.lit(0)).alias("spikes"), nll.alias("nll"))


def time_shuffle(cells: DataFrame, n_bins: int, seed: int) -> DataFrame:
    """Moves each trial and unit's target counts to other bins: one permutation of the bins per trial and unit.

    Bins without spikes need no rows: a count moves to its bin's place in the hashed order of all bins.
    """
    ids = ["session", "region", "unit", "trial"]
    order = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), F.lit(n_bins - 1)),
            lambda b: F.struct(draw(seed, *ids, b).alias("h"), b.alias("b")),
        )
    )
    moved = F.transform(order, lambda s: s["b"])
    return cells.withColumn("bin", (F.array_position(moved, F.col("bin")) - 1).cast("int"))


def outer_split(trials: DataFrame, unit: str, frac: float, seed: int) -> DataFrame:
    """Whole sessions (or subjects) held out by a seeded hash order of the distinct values."""
    groups = trials.select(unit).distinct().withColumn("_h", draw(seed, unit))
    ranked = with_position(groups, [], ["_h", unit], hash_bucket(F.col("_h"), 12), "_p", "_n")
    held = ranked.select(unit, (F.col("_p") <= F.greatest(F.lit(1), F.bround(F.col("_n") * frac))).alias("held_out"))
    return attach(trials, held, [unit], ["trial"])


def dataset_transfer(trials: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Both directions of train-on-one, test-on-the-other."""
    other = F.explode(F.array(F.lit("A"), F.lit("B"))).alias("train_on")
    return trials.select("*", other).withColumn("split", F.when(F.col(dataset) == F.col("train_on"), "train").otherwise("test"))


def rank_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    return stats.spearman_global(df, x, y)


def size_matched_random(units: DataFrame, selected: DataFrame, seed: int) -> DataFrame:
    """As many random units per session and region as were selected."""
    keys = ["session", "region"]
    k = selected.groupBy(*keys).agg(F.count("*").alias("_k"))
    hashed = units.select(*keys, "unit").withColumn("_h", draw(seed, *keys, "unit"))
    ranked = with_position(hashed, keys, ["_h", "unit"], hash_bucket(F.col("_h")), "_p")
    return attach(ranked, k, keys, ["unit"], how="inner").where(F.col("_p") <= F.col("_k")).select(*keys, "unit")

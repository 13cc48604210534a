"""Class metrics, chance levels and forecast scores.

Every class metric is a function of nine confusion counts, so predictions are reduced to counts first.
Forecast scores sum over all unit x trial x bin cells; cells without spikes are added in closed form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CLASSES, REGIONS
from .lineage import cut
from .skew import attach, draw, hash_bucket, with_position
from .stats import add

C = range(len(CLASSES))
EPS = 1e-8


# ---------------------------------------------------------------- confusion and metrics


def confusion_counts(preds: DataFrame, keys: list[str] = [], weight: Column | None = None) -> DataFrame:
    """c_<truth><predicted> per key; label and pred are class codes."""
    w = F.lit(1) if weight is None else weight
    cells = [
        F.coalesce(F.sum(F.when((F.col("label") == i) & (F.col("pred") == j), w)), F.lit(0)).cast("long").alias(f"c_{i}{j}")
        for i in C
        for j in C
    ]
    return preds.groupBy(*keys).agg(*cells)


def _truth(i: int) -> Column:
    return add(F.col(f"c_{i}{j}") for j in C)


def _predicted(j: int) -> Column:
    return add(F.col(f"c_{i}{j}") for i in C)


def accuracy() -> Column:
    return F.try_divide(add(F.col(f"c_{i}{i}") for i in C), add(_truth(i) for i in C))


def balanced_accuracy() -> Column:
    """Mean recall over the classes present in the truth."""
    recalls = add(F.coalesce(F.try_divide(F.col(f"c_{i}{i}"), _truth(i)), F.lit(0.0)) for i in C)
    return F.try_divide(recalls, add((_truth(i) > 0).cast("int") for i in C))


def macro_f1() -> Column:
    """Mean F1 over all classes; an undefined F1 counts as 0."""
    f1 = [F.coalesce(F.try_divide(F.col(f"c_{i}{i}") * 2, _truth(i) + _predicted(i)), F.lit(0.0)) for i in C]
    return add(f1) / len(CLASSES)


def metrics(preds: DataFrame, keys: list[str] = []) -> DataFrame:
    return metrics_of(confusion_counts(preds, keys), keys)


def metrics_of(confusion: DataFrame, keys: list[str] = []) -> DataFrame:
    return confusion.select(
        *keys,
        accuracy().alias("accuracy"),
        balanced_accuracy().alias("balanced_accuracy"),
        macro_f1().alias("macro_f1"),
        add(_truth(i) for i in C).alias("n"),
    )


def confusion_matrix(preds: DataFrame, keys: list[str] = []) -> DataFrame:
    """All nine cells with their share of the truth row."""
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("label"), F.lit(j).alias("pred"), F.col(f"c_{i}{j}").alias("n"),
                (F.col(f"c_{i}{j}") / F.greatest(_truth(i), F.lit(1))).alias("row_share"),
            )
            for i in C
            for j in C
        ]
    )
    return confusion_counts(preds, keys).select(*keys, F.inline(cells))


def class_weights(trials: DataFrame, keys: list[str] = [], label: str = "label") -> DataFrame:
    """n / (3 n_c) per class, 0 for an absent class."""
    counts = trials.where(F.col(label).isNotNull()).groupBy(*keys).agg(
        *[F.count_if(F.col(label) == c).alias(f"k_{i}") for i, c in enumerate(CLASSES)]
    )
    total = add(F.col(f"k_{i}") for i in C)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("label"),
                F.when(F.col(f"k_{i}") > 0, total / (len(CLASSES) * F.col(f"k_{i}"))).otherwise(0.0).alias("weight"),
            )
            for i, c in enumerate(CLASSES)
        ]
    )
    return counts.select(*keys, F.inline(rows))


def cross_session(per_session: DataFrame) -> DataFrame:
    """Mean of per-session metrics with the summed confusion counts and the fixed chance levels.

    `per_session` holds the confusion counts of every session.
    """
    means = [
        F.avg(accuracy()).alias("accuracy"), F.avg(balanced_accuracy()).alias("balanced_accuracy"),
        F.avg(macro_f1()).alias("macro_f1"), F.sum(add(_truth(i) for i in C)).alias("n"),
    ]
    cells = [F.sum(f"c_{i}{j}").alias(f"c_{i}{j}") for i in C for j in C]
    # The chance levels the aggregate reports.
    return per_session.agg(*means, *cells, F.lit(1.0 / 3.0).alias("chance_mean"), F.lit(0.45).alias("chance_p95"))


# ---------------------------------------------------------------- splits


def _hashed(trials: DataFrame, seed: int) -> DataFrame:
    return trials.withColumn("_h", draw(seed, "session", "trial"))


def split_out(trials: DataFrame, frac: Column, seed: int, keys: list[str] = ["session"]) -> DataFrame:
    """Adds boolean `out`: round(frac * n) trials per key, stratified by class where that is possible.

    Stratified when every class has two trials and there are at least as many places as classes; the
    places are shared by largest remainder. Otherwise a plain hashed draw.
    """
    counts = trials.groupBy(*keys).agg(
        F.count("*").alias("_n"), *[F.count_if(F.col("label") == c).alias(f"_n{i}") for i, c in enumerate(CLASSES)]
    )
    counts = counts.withColumn("_out", F.bround(frac * F.col("_n")).cast("int"))
    present = add((F.col(f"_n{i}") > 0).cast("int") for i in C)
    smallest = F.least(*[F.when(F.col(f"_n{i}") > 0, F.col(f"_n{i}")) for i in C])
    counts = counts.withColumn("_strat", (smallest >= 2) & (F.col("_out") >= present) & (F.col("_out") < F.col("_n")))
    share = {f"_e{i}": F.col("_out") * F.col(f"_n{i}") / F.col("_n") for i in C}
    counts = counts.withColumns(share).withColumns({f"_f{i}": F.floor(F.col(f"_e{i}")).cast("int") for i in C})
    left = F.col("_out") - add(F.col(f"_f{i}") for i in C)
    rests = {f"_r{i}": F.col(f"_e{i}") - F.col(f"_f{i}") for i in C}
    counts = counts.withColumns(rests)

    def ahead(i: int) -> Column:
        return add(
            ((F.col(f"_r{j}") > F.col(f"_r{i}")) | ((F.col(f"_r{j}") == F.col(f"_r{i}")) & F.lit(j < i))).cast("int")
            for j in C
            if j != i
        )

    counts = counts.withColumns({f"_t{i}": F.col(f"_f{i}") + (ahead(i) < left).cast("int") for i in C})
    rows = attach(_hashed(trials, seed), counts.select(*keys, "_out", "_strat", *[f"_t{i}" for i in C]), keys, ["trial"])
    rows = with_position(rows, keys, ["_h", "trial"], hash_bucket(F.col("_h")), "_p")
    rows = with_position(rows, [*keys, "label"], ["_h", "trial"], hash_bucket(F.col("_h")), "_pc")
    quota = F.coalesce(*[F.when(F.col("label") == c, F.col(f"_t{i}")) for i, c in enumerate(CLASSES)])
    out = F.when(F.col("_strat"), F.col("_pc") <= quota).otherwise(F.col("_p") <= F.col("_out"))
    return rows.withColumn("out", out).drop("_h", "_p", "_pc", "_out", "_strat", *[f"_t{i}" for i in C])


def stratified_split(trials: DataFrame, val_frac: float = 0.15, test_frac: float = 0.15, seed: int = 0) -> DataFrame:
    """Per session: test first, then validation from the rest."""
    return _two_step(trials, F.lit(test_frac), F.lit(val_frac / max(1 - test_frac, 1e-9)), seed, F.lit("train"))


def holdout_split(trials: DataFrame, holdout: Column, adapt_frac: float = 0.2, val_frac: float = 0.15, seed: int = 0) -> DataFrame:
    """Held-out sessions: adapt_frac adapt, the rest test. Other sessions: train and validation."""
    held = F.coalesce(holdout, F.lit(False))
    a = _two_step(trials.where(held), F.lit(1 - adapt_frac), F.lit(0.0), seed, F.lit("adapt"))
    b = _two_step(trials.where(~held), F.lit(0.0), F.lit(val_frac), seed, F.lit("train"))
    return a.unionByName(b)


def _two_step(trials: DataFrame, test: Column, val: Column, seed: int, rest: Column) -> DataFrame:
    labelled = cut(trials.where(F.col("label").isNotNull()).select("session", "trial", "label"))
    first = cut(split_out(labelled, test, seed))
    second = split_out(first.where(~F.col("out")).drop("out"), val, seed + 1)
    return first.where("out").drop("out").withColumn("split", F.lit("test")).unionByName(
        second.withColumn("split", F.when(F.col("out"), "val").otherwise(rest)).drop("out")
    )


def random_split(trials: DataFrame, val_frac: float = 0.2, seed: int = 7) -> DataFrame:
    """Pooled draw of max(1, int(frac * n)) validation trials."""
    ranked = with_position(_hashed(trials, seed), [], ["_h", "session", "trial"], hash_bucket(F.col("_h"), 12), "_p", "_n")
    n_val = F.greatest(F.lit(1), F.floor(F.col("_n") * val_frac))
    return ranked.withColumn("split", F.when(F.col("_p") <= n_val, "val").otherwise("train")).drop("_h", "_p", "_n")


# ---------------------------------------------------------------- resampling


def shuffle_labels(preds: DataFrame, ids: list[str], n: int, seed: int, keys: list[str] = []) -> DataFrame:
    """n label permutations (inside each key): every replicate pairs predictions in id order with
    labels in a hashed order of the replicate."""
    reps = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = preds.select(*keys, *[c for c in ids if c not in keys], "label", "pred").withColumn("_base", draw(seed, *ids))
    fixed = with_position(rows, keys, ["_base", *ids], hash_bucket(F.col("_base"), 12), "_pos")
    targets = fixed.select(*keys, "_pos", "pred", reps.alias("rep"))
    drawn = rows.withColumn("rep", reps).withColumn("_h", draw(seed, "rep", *ids))
    labels = with_position(drawn, [*keys, "rep"], ["_h", *ids], hash_bucket(F.col("_h"), 12), "_pos")
    return targets.join(labels.select(*keys, "rep", "_pos", "label"), [*keys, "rep", "_pos"]).drop("_pos")


def shuffle_chance(preds: DataFrame, ids: list[str], n: int = 20, seed: int = 0) -> DataFrame:
    """Mean and 95th percentile of balanced accuracy over label permutations."""
    scores = metrics(shuffle_labels(preds, ids, n, seed), ["rep"])
    return scores.agg(
        F.avg("balanced_accuracy").alias("mean"), F.percentile("balanced_accuracy", F.lit(0.95)).alias("p95"),
        F.count("*").alias("n_shuffles"),
    )


# ---------------------------------------------------------------- forecasts


def null_psth(binned: DataFrame, trials: DataFrame, train: Column | None = None) -> DataFrame:
    """Mean target count per unit and bin over the training trials (all, where a session has none)."""
    use = F.lit(True) if train is None else F.coalesce(train, F.lit(False))
    flagged = trials.where(F.col("label").isNotNull()).withColumn("_use", use)
    has = flagged.groupBy("session").agg(F.max("_use").alias("_any"))
    chosen = flagged.join(has, "session").where(F.col("_use") | ~F.col("_any")).select("session", "trial")
    sizes = chosen.groupBy("session").agg(F.count("*").alias("_n"))
    sums = (
        binned.where((F.col("win") == "tgt") & F.col("label").isNotNull())
        .join(chosen, ["session", "trial"], "left_semi")
        .groupBy("session", "region", "unit", "bin")
        .agg(F.sum("n").alias("_s"))
    )
    return attach(sums, sizes, ["session"], ["unit", "bin"]).select(
        "session", "region", "unit", "bin", (F.col("_s") / F.col("_n")).alias("mu")
    )


def persistence_forecast(unit_trials: DataFrame, late_bins: int, ctx_bin_s: float, tgt_bin_s: float, floor: float = 1e-3) -> DataFrame:
    """Late-context mean count scaled to a target bin, for trials with late spikes; others have the floor."""
    mu = F.greatest(F.col("late") / late_bins * (tgt_bin_s / ctx_bin_s), F.lit(floor))
    return unit_trials.withColumn("mu", mu)


def log_persistence(late_mean: Column, scale: float) -> Column:
    """Log of the expected target count carried by the late context."""
    return F.ln(late_mean * F.lit(scale) + 0.05)


def deviance_terms(y: Column, mu: Column) -> Column:
    return F.lit(2.0) * (y * F.ln((y + EPS) / (mu + EPS)) - (y - mu))


def poisson_deviance(cells: DataFrame, keys: list[str], y: str, mu: str) -> DataFrame:
    return cells.groupBy(*keys).agg(F.sum(deviance_terms(F.col(y).cast("double"), F.col(mu))).alias("deviance"))


def poisson_nll(cells: DataFrame, keys: list[str], y: str, mu: str) -> DataFrame:
    """Mean of exp(eta) - y eta with eta = ln mu, and of mu - y ln(mu + 1e-8)."""
    yy, m = F.col(y).cast("double"), F.col(mu)
    return cells.groupBy(*keys).agg(
        F.avg(m - yy * F.ln(m)).alias("nll_log"), F.avg(m - yy * F.ln(m + EPS)).alias("nll")
    )


def forecast_deviance(
    binned: DataFrame, unit_trials: DataFrame, sizes: DataFrame, null: DataFrame, *, late_bins: int, n_tgt: int,
    ctx_bin_s: float, tgt_bin_s: float, floor: float = 1e-3,
) -> DataFrame:
    """Deviance explained per region of the persistence forecast against the null PSTH.

    Sum over cells = sum over spiking cells of 2 (y ln((y+e)/(mu+e)) - y) + 2 * sum of mu over all cells,
    and the second sum follows from per-unit totals.
    """
    unit = ["session", "region", "unit"]
    cells = binned.where((F.col("win") == "tgt") & F.col("label").isNotNull())
    late = unit_trials.where(F.col("label").isNotNull() & (F.col("late") > 0)).select(
        *unit, "trial", F.greatest(F.col("late") / late_bins * (tgt_bin_s / ctx_bin_s), F.lit(floor)).alias("mu_p")
    )
    scored = cells.join(null, [*unit, "bin"], "left").join(late, [*unit, "trial"], "left")
    y = F.col("n").cast("double")
    mu0, mup = F.coalesce(F.col("mu"), F.lit(0.0)), F.coalesce(F.col("mu_p"), F.lit(floor))

    def spiking(m: Column) -> Column:
        return F.sum(2.0 * (y * F.ln((y + EPS) / (m + EPS)) - y))

    seen = scored.groupBy("region").agg(spiking(mu0).alias("a0"), spiking(mup).alias("ap"))
    null_total = (
        null.groupBy(*unit).agg(F.sum("mu").alias("m")).join(sizes.select(*unit, "n_trials"), unit, "left")
        .groupBy("region")
        .agg(F.sum(F.col("m") * F.col("n_trials")).alias("b0"))
    )
    late_total = late.groupBy(*unit).agg(F.sum("mu_p").alias("m"), F.count("*").alias("k"))
    persist_total = (
        sizes.join(late_total, unit, "left")
        .groupBy("region")
        .agg(
            F.sum(
                n_tgt * (F.coalesce(F.col("m"), F.lit(0.0)) + floor * (F.col("n_trials") - F.coalesce(F.col("k"), F.lit(0))))
            ).alias("bp")
        )
    )
    dims = sizes.groupBy("region").agg(F.sum("n_trials").alias("_n"))
    out = dims.join(seen, "region", "left").join(null_total, "region", "left").join(persist_total, "region", "left")
    d0 = F.coalesce(F.col("a0"), F.lit(0.0)) + 2 * F.coalesce(F.col("b0"), F.lit(0.0))
    dp = F.coalesce(F.col("ap"), F.lit(0.0)) + 2 * F.coalesce(F.col("bp"), F.lit(0.0))
    region_order = F.col("region").isin(*REGIONS)
    return out.where(region_order).select(
        "region", d0.alias("deviance_null"), dp.alias("deviance_persistence"),
        (1 - dp / F.greatest(d0, F.lit(1e-8))).alias("deviance_explained_persistence"),
    )


def persistence_scores(
    binned: DataFrame, sizes: DataFrame, *, n_ctx: int, late_bins: int, n_tgt: int, ctx_bin_s: float, tgt_bin_s: float, floor: float = 1e-3,
) -> DataFrame:
    """Poisson scores of the persistence forecast per region, over every unit, trial and target bin.

    Cells without spikes have no row: their share is added in closed form (the forecast itself, or its floor).
    `deviance_explained` compares with the mean count of the unit.
    """
    n, late, tgt = F.col("n"), (F.col("win") == "ctx") & (F.col("bin") >= n_ctx - late_bins), F.col("win") == "tgt"
    total = lambda cond, x: F.coalesce(F.sum(F.when(cond, x)), F.lit(0))
    rows = binned.where(F.col("label").isNotNull()).groupBy("session", "region", "unit", "trial").agg(
        total(late, n).alias("late"), total(tgt, n).cast("double").alias("y"), total(tgt, n * F.ln(n + EPS)).cast("double").alias("ylogy"))
    mu = F.greatest(F.col("late") / late_bins * (tgt_bin_s / ctx_bin_s), F.lit(floor))
    units = rows.withColumn("mu", mu).groupBy("session", "region", "unit").agg(
        F.count("*").alias("k"), F.sum("y").alias("y"), F.sum("ylogy").alias("ylogy"), F.sum("mu").alias("mu"),
        F.sum(F.col("y") * F.ln("mu")).alias("ylog"), F.sum(F.col("y") * F.ln(F.col("mu") + EPS)).alias("yloge"))
    every = sizes.select("session", "region", "unit", "n_trials").join(units, ["session", "region", "unit"], "left")
    every = every.fillna(0, ["k", "y", "ylogy", "mu", "ylog", "yloge"])
    cells = F.col("n_trials") * n_tgt
    expected = (F.col("mu") + (F.col("n_trials") - F.col("k")) * floor) * n_tgt
    out = every.groupBy("region").agg(
        F.sum(cells).alias("cells"), (2 * F.sum(F.col("ylogy") - F.col("yloge") - F.col("y") + expected)).alias("deviance"),
        (2 * F.sum(F.col("ylogy") - F.col("y") * F.ln(F.col("y") / cells + EPS))).alias("null"),
        F.sum(expected - F.col("ylog")).alias("a"), F.sum(expected - F.col("yloge")).alias("b"))
    return out.select(
        "region", "deviance", (F.col("a") / F.col("cells")).alias("nll_log"), (F.col("b") / F.col("cells")).alias("nll"),
        (1 - F.col("deviance") / F.greatest(F.col("null"), F.lit(1e-8))).alias("deviance_explained"))


def mean_null_deviance(cells: DataFrame, keys: list[str], group: list[str], y: str, mu: str) -> DataFrame:
    """1 - D / max(D0, 1e-8) with the group mean of y as the null."""
    base = cells.groupBy(*keys, *group).agg(F.avg(F.col(y).cast("double")).alias("_mu0"))
    both = attach(cells, base, [*keys, *group], [y, mu])
    yy = F.col(y).cast("double")
    agg = both.groupBy(*keys).agg(
        F.sum(deviance_terms(yy, F.col(mu))).alias("_d"), F.sum(deviance_terms(yy, F.col("_mu0"))).alias("_d0")
    )
    return agg.select(*keys, (1 - F.col("_d") / F.greatest(F.col("_d0"), F.lit(1e-8))).alias("deviance_explained"))

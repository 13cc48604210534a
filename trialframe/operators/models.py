"""Linear class baselines, one fit per session, all sessions in one set of Spark jobs.

Features stay a sparse table (session, region, unit, trial, x) and coefficients a table keyed by unit, so the
model never passes through the driver. A session of up to `CELLS` cells (units x training trials) and feature rows is
fitted inside a task, all such sessions in one job; a larger one never passes through one task: each step is a join of
features with coefficients summed per trial, and a join of features with residuals summed per unit. Standardising
is folded into these sums (x' = (x - m) / s), so zero counts never become rows. Both ways take the same steps.

Objective per session: C * sum_i w_i loss_i + |beta|^2 / 2, balanced weights, intercept not penalised.
Step sizes follow the Barzilai-Borwein rules per session, and per class where the loss treats classes apart (margin).
These rules alone need not end on a loss that is not quadratic, so a step is taken only where the objective falls below
the highest of its last `MEMORY` values; else it is tried again, shorter. A class is done, and stands still, when no component
of its gradient exceeds `TOLERANCE` times C times the summed weights of the session; the fit ends
when all are done, and raises an error if some never get there. Joins on a trial read both sides from storage or a
shuffle, so AQE splits a trial that holds a large share of the rows.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F

from ..schema import CLASSES, UNIT
from .lineage import forgotten, written
from .skew import attach
from .stats import add

U = list(UNIT)
TRIAL = ["session", "trial"]
C = range(len(CLASSES))
#: Largest gradient component of a finished fit, as a share of C times the summed weights.
TOLERANCE = 1e-4
#: A fit that takes more steps than this, those tried again included, has failed.
MAX_STEPS = 2000
#: Values of the objective a step is held against, the share of the linear decrease it has to bring, and the rounding allowed.
MEMORY, DECREASE, ROUNDING = 10, 1e-4, 1e-12
#: The short step of the two rules (or the one before, if shorter) is taken where it is below this share of the long one.
SHORT = 0.8
#: Cells and feature rows of a session that is fitted inside one task: 8 MB as a matrix, some 40 MB as rows.
CELLS = 1 << 20


@dataclass
class LinearModel:
    """coef(session, region, unit, w_0..w_2) on raw features and offset(session, o_0..o_2)."""

    coef: DataFrame
    offset: DataFrame


def mean_rate_features(binned: DataFrame, n_ctx: int, last: int | None = None) -> DataFrame:
    """Mean context count per unit and labelled trial (over the last bins only, if given); zeros have no row."""
    keep = n_ctx if last is None else last
    rows = binned.where((F.col("win") == "ctx") & F.col("label").isNotNull() & (F.col("bin") >= n_ctx - keep))
    return rows.groupBy(*U, "trial").agg((F.sum("n") / F.lit(float(keep))).alias("x"))


def feature_scale(features: DataFrame, train: DataFrame) -> DataFrame:
    """Mean and population deviation per unit over the training trials, zeros included; deviation 0 -> 1."""
    sizes = train.groupBy("session").agg(F.count("*").alias("_n"))
    sums = (
        features.join(train.select(*TRIAL), TRIAL, "left_semi")
        .groupBy(*U)
        .agg(F.sum("x").alias("_s"), F.sum(F.col("x") * F.col("x")).alias("_q"))
    )
    all_units = features.select(*U).distinct().join(sums, U, "left").fillna(0.0, ["_s", "_q"])
    mean = F.col("_s") / F.col("_n")
    sd = F.sqrt(F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0)))
    return attach(all_units, sizes, ["session"], ["unit"], how="inner").select(
        *U, mean.alias("m"), F.when(sd < 1e-12, 1.0).otherwise(sd).alias("s")
    )


def scaled(features: DataFrame, scale: DataFrame) -> DataFrame:
    return features.join(scale, U).withColumn("z", (F.col("x") - F.col("m")) / F.col("s"))


def _weights(train: DataFrame) -> DataFrame:
    """Training trials with class code y and balanced weight over the classes the session has."""
    code = F.coalesce(*[F.when(F.col("label") == c, F.lit(i)) for i, c in enumerate(CLASSES)])
    per_class = train.groupBy("session").agg(
        F.count("*").alias("_n"), *[F.count_if(F.col("label") == c).alias(f"_k{i}") for i, c in enumerate(CLASSES)]
    )
    present = add((F.col(f"_k{i}") > 0).cast("int") for i in C)
    mine = F.coalesce(*[F.when(F.col("y") == i, F.col(f"_k{i}")) for i in C])
    rows = attach(train.select(*TRIAL, code.alias("y")), per_class, ["session"], ["trial"])
    return rows.select(
        *TRIAL, "y", (F.col("_n") / (present * mine)).alias("w"), *[(F.col(f"_k{i}") > 0).alias(f"has_{i}") for i in C]
    )


def _losses(loss: str) -> tuple[list[Column], list[Column]]:
    """Parts of the loss by class and its derivative in each class score, zero for classes the session lacks."""
    if loss == "logistic":
        # the largest score is taken out before exp
        top = F.greatest(*[F.when(F.col(f"has_{k}"), F.col(f"z_{k}")) for k in C])
        e = [F.when(F.col(f"has_{k}"), F.exp(F.col(f"z_{k}") - top)).otherwise(0.0) for k in C]
        total = add(e)
        values = [F.when(F.col("y") == k, F.ln(total) + top - F.col(f"z_{k}")).otherwise(0.0) for k in C]
        return values, [
            F.when(F.col(f"has_{k}"), e[k] / total - (F.col("y") == k).cast("double")).otherwise(0.0) for k in C
        ]
    if loss == "squared_hinge":
        values, out = [], []
        for k in C:
            sign = F.when(F.col("y") == k, 1.0).otherwise(-1.0)
            slack = F.greatest(1.0 - sign * F.col(f"z_{k}"), F.lit(0.0))
            values.append(F.when(F.col(f"has_{k}"), slack * slack).otherwise(0.0))
            out.append(F.when(F.col(f"has_{k}"), -2.0 * sign * slack).otherwise(0.0))
        return values, out
    raise ValueError(loss)


def _gradients(rows: DataFrame, trials: DataFrame, model: LinearModel, loss: str) -> tuple[DataFrame, DataFrame]:
    """Weighted residuals summed with x per unit (`sum_xr_k`) and alone per session (`sum_r_k`), there the loss as well (`sum_l_k`)."""
    scored = _trial_scores(rows, trials, model)
    parts = {f"{v}_{k}": F.col("w") * part for v, of in zip("lr", _losses(loss)) for k, part in enumerate(of)}
    res = scored.select(*TRIAL, *[part.alias(name) for name, part in parts.items()])
    per_session = res.groupBy("session").agg(*[F.sum(name).alias(f"sum_{name}") for name in parts])
    per_unit = rows.join(res.drop(*[f"l_{k}" for k in C]), TRIAL).groupBy(*U).agg(*[F.sum(F.col("x") * F.col(f"r_{k}")).alias(f"sum_xr_{k}") for k in C])
    return per_unit, per_session


def _unit_gradient(k: int, c: float, b: Column) -> Column:
    """Derivative in the coefficient b of a standardised unit, the sums of `_gradients` and its scale beside it."""
    sums = F.coalesce(F.col(f"sum_xr_{k}"), F.lit(0.0)) - F.col("m") * F.col(f"sum_r_{k}")
    return c * sums / F.col("s") + b


def fit_linear(
    features: DataFrame, train: DataFrame, *, c: float = 0.5, tolerance: float = TOLERANCE, loss: str = "logistic",
    cells: int = CELLS,
) -> LinearModel:
    """Fit every session on its training trials (session, trial, label); one without units has intercepts alone."""
    features = features.select(*U, "trial", "x").dropna(subset=U)
    trials = written(_weights(train.select(*TRIAL, "label").dropna(subset=["session"])))
    per_session = trials.groupBy("session").agg(F.count("*").alias("_n"))
    per_unit = features.groupBy(*U).agg(F.count("*").alias("_r")).groupBy("session").agg(
        F.count("*").alias("_d"), F.sum("_r").alias("_r")
    )
    large = per_unit.join(per_session, "session").where(F.greatest("_r", F.col("_d") * F.col("_n"), "_n") > cells)
    large = large.select("session")
    if large.isEmpty():
        return _fit_in_tasks(features, trials, c, tolerance, loss)
    large = written(large)
    parts = [
        _fit_in_tasks(features.join(large, "session", "left_anti"), trials.join(large, "session", "left_anti"), c, tolerance, loss),
        _fit_by_joins(
            features.join(large, "session", "left_semi"), train.join(large, "session", "left_semi"),
            c=c, tolerance=tolerance, loss=loss,
        ),
    ]
    return LinearModel(parts[0].coef.unionByName(parts[1].coef), parts[0].offset.unionByName(parts[1].offset))


def _fit_in_tasks(features: DataFrame, trials: DataFrame, c: float, tolerance: float, loss: str) -> LinearModel:
    """The sessions of `features` and of `trials` (from `_weights`), each fitted by one call inside a task."""
    kinds = {f.name: f.dataType for f in features.schema.fields}
    numbers = [f"{v}_{k}" for v in ("w", "o") for k in C]
    schema = T.StructType([T.StructField(u, kinds[u]) for u in U] + [T.StructField(v, T.DoubleType()) for v in numbers])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y, w, has, unit = _matrix(left, right)
        beta, offset = _fit_session(x, y, w, has, c, tolerance, loss) if len(y) else (np.zeros((0, 3)), None)
        # the units with their coefficients, then one row without a unit for the offsets
        rows = left.select(U).take(pa.array(unit[: len(beta)], pa.int64()))
        nan = lambda n: pa.nulls(n, pa.float64())
        ends = right.select(["session"]).slice(0, 1)
        columns = [pa.concat_arrays([*rows["session"].chunks, *ends["session"].chunks])]
        columns += [pa.concat_arrays([*rows[u].chunks, pa.nulls(len(ends), rows[u].type)]) for u in U[1:]]
        columns += [pa.concat_arrays([pa.array(beta[:, k]), nan(len(ends))]) for k in C]
        columns += [pa.concat_arrays([nan(len(beta)), pa.array(offset[k : k + 1] if len(ends) else [], pa.float64())]) for k in C]
        return pa.Table.from_arrays(columns, names=[*U, *numbers])

    fits = features.groupBy("session").cogroup(trials.groupBy("session")).applyInArrow(run, schema)
    fits = written(fits)
    coef = fits.where("unit IS NOT NULL").select(*U, *[f"w_{k}" for k in C])
    return LinearModel(coef, fits.where("unit IS NULL").select("session", *[f"o_{k}" for k in C]))


def _matrix(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, ...]:
    """x (trial x unit), y, w and the classes present of a session, and the row of `left` that names each unit."""
    code = np.zeros(len(left), np.int64)
    for u in U[1:]:
        place = left[u].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = code * (place.max(initial=0) + 1) + place
    _, unit, column = np.unique(code, return_index=True, return_inverse=True)
    row = _places(left["trial"], right["trial"])
    seen = row >= 0
    x = np.zeros((len(right), len(unit)))
    np.add.at(x, (row[seen], column[seen]), left["x"].to_numpy()[seen])
    has = np.array([pc.any(right[f"has_{k}"]).as_py() or False for k in C])
    return x, right["y"].to_numpy().astype(np.int64), right["w"].to_numpy(), has, unit


def _places(asked: pa.ChunkedArray, known: pa.ChunkedArray) -> np.ndarray:
    """Where each asked value stands among the known ones, -1 where it does not; structs by their fields."""
    if pa.types.is_struct(known.type):
        at = {tuple(v.values()): i for i, v in enumerate(known.to_pylist())}
        return np.array([at.get(tuple(v.values()), -1) for v in asked.to_pylist()], np.int64)
    return pc.fill_null(pc.index_in(asked, value_set=known.combine_chunks()), -1).to_numpy().astype(np.int64)


class _Step:
    """The size of the next step of a session, or of one of its classes where the loss treats them apart; `_step_sizes` is the same for joins."""

    def __init__(self, first: float, bound: float):
        self.first, self.bound, self.size, self.short = first, bound, first, float("inf")
        self.value = self.slope = 0.0
        self.past: deque[float] = deque(maxlen=MEMORY)

    def judge(self, top: float, value: float, gg: float, ss: float, sy: float, yy: float) -> bool:
        """Whether a point is taken, from its gradient (`top`, `gg`), value and changes; sets the size, zero when done."""
        if self.size == 0 or top <= self.bound:
            self.size = 0.0
            return True
        if not value <= max(self.past, default=float("inf")) * (1.0 + ROUNDING) - DECREASE * self.size * self.slope:
            bend = 2.0 * (value - self.value + self.size * self.slope)
            self.size *= min(max(0.1, self.size * self.slope / bend if bend > 0 else 0.0), 0.5)
            return False
        self.past.append(value)
        self.value, self.slope = value, gg
        if sy > 0 and yy > 0:
            long, now = ss / sy, sy / yy
            self.size = min(now, self.short) if now < SHORT * long else long
            self.short = now
        else:
            self.size = self.first
        return True


def _fit_session(
    x: np.ndarray, y: np.ndarray, w: np.ndarray, has: np.ndarray, c: float, tolerance: float, loss: str,
) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients [unit, class] on raw features and offsets of one session, by the steps of `_fit_by_joins`."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd < 1e-12, 1.0, sd)
    z = np.hstack([(x - mean) / sd, np.ones((len(y), 1))])  # the intercept is a last column without penalty
    own = y[:, None] == np.arange(len(CLASSES))
    penalty = np.ones((z.shape[1], 1))
    penalty[-1] = 0.0
    first = 1.0 / (1.0 + c * (0.5 if loss == "logistic" else 2.0) * w.sum() * z.shape[1])
    beta, old, old_gradient = (np.zeros((z.shape[1], len(CLASSES))) for _ in range(3))
    states = [_Step(first, tolerance * c * w.sum()) for _ in (C[:1] if loss == "logistic" else C)]
    dots = lambda a, b: np.einsum("ij,ij->j", a, b)
    for _ in range(MAX_STEPS):
        score = z @ beta
        if loss == "logistic":
            rest = np.where(has, score, -np.inf) - score[:, has].max(axis=1, keepdims=True)
            e = np.exp(rest)
            total = e.sum(axis=1, keepdims=True)
            lost, residual = np.where(own, np.log(total) - rest, 0.0), e / total - own
        else:
            sign = np.where(own, 1.0, -1.0)
            slack = np.maximum(1.0 - sign * score, 0.0)
            lost, residual = slack * slack, -2.0 * sign * slack
        gradient = c * (z.T @ (w[:, None] * np.where(has, residual, 0.0))) + penalty * beta
        value = c * (w @ np.where(has, lost, 0.0)) + 0.5 * dots(penalty * beta, beta)
        top = np.abs(gradient).max(axis=0)
        step, change = beta - old, gradient - old_gradient
        sums = [value, dots(gradient, gradient), dots(step, step), dots(step, change), dots(change, change)]
        if loss == "logistic":  # all classes are one
            sums, top = [v.sum(keepdims=True) for v in sums], top.max(keepdims=True)
        good = [state.judge(*v) for state, *v in zip(states, top.tolist(), *(v.tolist() for v in sums))]
        if not any(state.size for state in states):
            raw = beta[:-1] / sd[:, None]
            return raw, beta[-1] - mean @ raw
        if all(good):
            old, old_gradient = beta, gradient
        else:
            old, old_gradient = np.where(good, beta, old), np.where(good, gradient, old_gradient)
        beta = old - np.array([state.size for state in states]) * old_gradient
    raise RuntimeError(f"no fit within {MAX_STEPS} steps")


def _fit_by_joins(features: DataFrame, train: DataFrame, *, c: float, tolerance: float, loss: str) -> LinearModel:
    """The same for sessions of any size, all of them step by step together.

    The state is written after each step: a step reads it several times, so an open lineage (and the size
    estimate a checkpoint carries along) would double
    with every step.
    """
    trials = written(_weights(train))
    scale = written(feature_scale(features, train))
    # in-scale units only; each copy keeps the partitioning its join needs
    rows = features.join(trials.select(*TRIAL), TRIAL, "left_semi").select(*U, "trial", "x")
    rows = written(rows)

    curvature = 0.5 if loss == "logistic" else 2.0
    per_unit = scale.groupBy("session").agg(F.count("*").alias("_d"))
    per_trial = trials.groupBy("session").agg(F.sum("w").alias("_w"))
    first = per_trial.join(per_unit, "session", "left").fillna(0, ["_d"])
    start = 1.0 / (1.0 + c * curvature * F.col("_w") * (F.col("_d") + 1))
    first = written(first.select("session", start.alias("a0"), (tolerance * c * F.col("_w")).alias("bound")))
    state = {f"{v}_{k}": F.lit(0.0) for v in ("b", "pb", "pg") for k in C}
    beta = scale.withColumns(state)
    # intercepts are one more row per session with x = 1, m = 0, s = 1 and no penalty
    icept = first.select("session").withColumns(state)
    none = F.array().cast("array<double>")
    steps = first.withColumns({
        **{f"size_{k}": F.col("a0") for k in C}, **{f"short_{k}": F.lit(float("inf")) for k in C},
        **{f"{v}_{k}": F.lit(0.0) for v in ("value", "slope") for k in C}, **{f"past_{k}": none for k in C},
    })
    moving = F.greatest(*[F.col(f"size_{k}") for k in C]) > 0
    sums = [f"sum_{v}_{k}" for v in ("xr", "r", "l") for k in C]
    old: list[DataFrame] = []
    for _ in range(MAX_STEPS):
        grads, per_session = _gradients(rows, trials, _raw(beta, icept), loss)
        beta = attach(beta.join(grads, U, "left"), per_session, ["session"], ["unit"])
        beta = beta.withColumns({f"g_{k}": _unit_gradient(k, c, F.col(f"b_{k}")) for k in C})
        beta = written(beta.withColumns({f"l_{k}": 0.5 * F.col(f"b_{k}") * F.col(f"b_{k}") for k in C}).drop(*sums))
        icept = icept.join(per_session, "session").withColumns({f"g_{k}": c * F.col(f"sum_r_{k}") for k in C})
        icept = written(icept.withColumns({f"l_{k}": c * F.col(f"sum_l_{k}") for k in C}).drop(*sums))
        steps = written(_step_sizes(beta, icept, steps, loss))
        forgotten(*old)
        old = [beta, icept, steps]
        if steps.where(moving).isEmpty():
            break
        sizes = steps.select("session", *[f"{v}_{k}" for v in ("size", "good") for k in C])
        beta = _advance(attach(beta, sizes, ["session"], ["unit"]))
        icept = _advance(icept.join(sizes, "session"))
    else:
        raise RuntimeError(f"no fit within {MAX_STEPS} steps for {steps.where(moving).count()} sessions")
    model = _raw(beta, icept)
    return LinearModel(written(model.coef), written(model.offset))


def _step_sizes(beta: DataFrame, icept: DataFrame, steps: DataFrame, loss: str) -> DataFrame:
    """`steps` after one more point: whether it is taken (`good_k`) and the next size by class; zero for one that is done."""
    names = ("ss", "sy", "yy", "gg", "l")

    def products(df: DataFrame) -> DataFrame:
        out = []
        for k in C:
            ds, dg, g = F.col(f"b_{k}") - F.col(f"pb_{k}"), F.col(f"g_{k}") - F.col(f"pg_{k}"), F.col(f"g_{k}")
            out += [F.sum(v).alias(f"{n}_{k}") for n, v in zip(names, (ds * ds, ds * dg, dg * dg, g * g, F.col(f"l_{k}")))]
            out.append(F.max(F.abs(g)).alias(f"top_{k}"))
        return df.groupBy("session").agg(*out)

    def together(name: str, k: int) -> Column:
        by_class = [F.col(f"{name}_{i}") for i in C]
        if loss != "logistic":
            return by_class[k]
        return F.greatest(*by_class) if name == "top" else add(by_class)

    both = products(beta).unionByName(products(icept)).groupBy("session").agg(
        *[F.sum(f"{n}_{k}").alias(f"{n}_{k}") for n in names for k in C], *[F.max(f"top_{k}").alias(f"top_{k}") for k in C]
    )
    both = both.select("session", *[together(n, k).alias(f"{n}_{k}") for n in (*names, "top") for k in C])
    out = []
    for k in C:
        ss, sy, yy, gg, value, top = (F.col(f"{n}_{k}") for n in (*names, "top"))
        size, short, old_value, slope, past = (F.col(f"{n}_{k}") for n in ("size", "short", "value", "slope", "past"))
        done = (size == 0) | (top <= F.col("bound"))
        highest = F.coalesce(F.array_max(past), F.lit(float("inf")))
        good = done | (value <= highest * (1.0 + ROUNDING) - DECREASE * size * slope)
        long, now = (F.when((sy > 0) & (yy > 0), v) for v in (ss / sy, sy / yy))
        next_size = F.coalesce(F.when(now < SHORT * long, F.least(now, short)).otherwise(long), F.col("a0"))
        bend = 2.0 * (value - old_value + size * slope)
        again = size * F.least(F.greatest(F.when(bend > 0, size * slope / bend), F.lit(0.1)), F.lit(0.5))
        new = {
            "good": good, "size": F.when(done, 0.0).when(good, next_size).otherwise(again),
            "short": F.when(good, F.coalesce(now, short)).otherwise(short), "value": F.when(good, value).otherwise(old_value),
            "slope": F.when(good, gg).otherwise(slope),
            "past": F.when(good, F.slice(F.concat(F.array(value), past), 1, MEMORY)).otherwise(past),
        }
        out += [v.alias(f"{n}_{k}") for n, v in new.items()]
    return both.join(steps, "session").select("session", "a0", "bound", *out)


def optimality(
    features: DataFrame, train: DataFrame, model: LinearModel, *, c: float = 0.5, loss: str = "logistic",
) -> DataFrame:
    """Per session the largest gradient component of a fitted model as a share of C times the summed weights (`gap`)."""
    trials = _weights(train)
    rows = features.join(trials.select(*TRIAL), TRIAL, "left_semi").select(*U, "trial", "x")
    per_unit, per_session = _gradients(rows, trials, model, loss)
    beta = feature_scale(features, train).join(model.coef, U).join(per_unit, U, "left")
    beta = attach(beta, per_session, ["session"], ["unit"])
    top = F.greatest(*[F.abs(_unit_gradient(k, c, F.col(f"w_{k}") * F.col("s"))) for k in C])
    tops = beta.select("session", top.alias("top")).unionByName(
        per_session.select("session", F.greatest(*[F.abs(c * F.col(f"sum_r_{k}")) for k in C]).alias("top"))
    )
    sizes = trials.groupBy("session").agg(F.sum("w").alias("_w"))
    return tops.groupBy("session").agg(F.max("top").alias("top")).join(sizes, "session").select(
        "session", (F.col("top") / (c * F.col("_w"))).alias("gap")
    )


def _advance(df: DataFrame) -> DataFrame:
    """The next point to try, from the last one that was taken."""
    new = {}
    for k in C:
        taken = {v: F.when(F.col(f"good_{k}"), F.col(f"{v}_{k}")).otherwise(F.col(f"p{v}_{k}")) for v in ("b", "g")}
        new |= {f"pb_{k}": taken["b"], f"pg_{k}": taken["g"], f"b_{k}": taken["b"] - F.col(f"size_{k}") * taken["g"]}
    return df.withColumns(new).drop(*[f"{v}_{k}" for v in ("size", "good", "g", "l") for k in C])


def _raw(beta: DataFrame, icept: DataFrame) -> LinearModel:
    """Coefficients on unscaled features, the means moved into the offset."""
    coef = beta.select(*U, "m", *[(F.col(f"b_{k}") / F.col("s")).alias(f"w_{k}") for k in C])
    shift = coef.groupBy("session").agg(*[F.sum(F.col(f"w_{k}") * F.col("m")).alias(f"h_{k}") for k in C])
    offset = icept.join(shift, "session", "left").select(
        "session", *[(F.col(f"b_{k}") - F.coalesce(F.col(f"h_{k}"), F.lit(0.0))).alias(f"o_{k}") for k in C]
    )
    return LinearModel(coef.drop("m"), offset)


def _trial_scores(features: DataFrame, trials: DataFrame, model: LinearModel, by: list[str] = []) -> DataFrame:
    """Class scores z_k of every trial; a trial without spikes has the offset alone."""
    sums = features.join(model.coef, U).groupBy(*by, *TRIAL).agg(
        *[F.sum(F.col("x") * F.col(f"w_{k}")).alias(f"z_{k}") for k in C]
    )
    full = attach(trials.join(sums, [*by, *TRIAL], "left"), model.offset, ["session"], ["trial"])
    return full.withColumns({f"z_{k}": F.coalesce(F.col(f"z_{k}"), F.lit(0.0)) + F.col(f"o_{k}") for k in C}).drop(
        *[f"o_{k}" for k in C]
    )


def predict(features: DataFrame, trials: DataFrame, model: LinearModel, by: list[str] = []) -> DataFrame:
    """Predicted code and class probabilities per trial (and variant, for keys in `by`).

    `trials` carries (session, trial, label) plus the `by` keys.
    """
    code = F.coalesce(*[F.when(F.col("label") == c, F.lit(i)) for i, c in enumerate(CLASSES)])
    scored = _trial_scores(features, trials, model, by)
    top = F.greatest(*[F.col(f"z_{k}") for k in C])
    e = [F.exp(F.col(f"z_{k}") - top) for k in C]
    best = F.coalesce(*[F.when(F.col(f"z_{k}") == top, F.lit(k)) for k in C])
    return scored.select(
        *by, *TRIAL, code.alias("label"), best.alias("pred"), *[(e[k] / add(e)).alias(f"p_{CLASSES[k]}") for k in C]
    )


def variants(trials: DataFrame, name: str, values: list) -> DataFrame:
    """Every trial once per value of a short fixed list."""
    return trials.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def context_sweep(binned: DataFrame, test: DataFrame, model: LinearModel, n_ctx: int, keep: list[int]) -> DataFrame:
    """Predictions with only the last `keep` context bins visible; settings longer than the window are skipped."""
    use = [k for k in keep if k <= n_ctx]
    rows = binned.where((F.col("win") == "ctx") & F.col("label").isNotNull())
    visible = variants(rows, "kept", use).where(F.col("bin") >= n_ctx - F.col("kept"))
    features = visible.groupBy("kept", *U, "trial").agg((F.sum("n") / F.first("kept")).alias("x"))
    return predict(features, variants(test, "kept", use), model, ["kept"])


def early_late(binned: DataFrame, test: DataFrame, model: LinearModel, n_ctx: int, early: int, late: int) -> DataFrame:
    """Predictions from the first `early` bins alone and from the last `late` bins alone."""
    rows = variants(binned.where((F.col("win") == "ctx") & F.col("label").isNotNull()), "part", ["early", "late"])
    is_early = F.col("part") == "early"
    seen = rows.where((is_early & (F.col("bin") < early)) | (~is_early & (F.col("bin") >= n_ctx - late)))
    size = F.when(F.first("part") == "early", F.lit(early)).otherwise(F.lit(late))
    features = seen.groupBy("part", *U, "trial").agg((F.sum("n") / size).alias("x"))
    return predict(features, variants(test, "part", ["early", "late"]), model, ["part"])


def region_ablation(features: DataFrame, test: DataFrame, model: LinearModel, regions: tuple[str, ...]) -> DataFrame:
    """Predictions with one region's features at zero."""
    kept = variants(features, "dropped", list(regions)).where(F.col("region") != F.col("dropped"))
    return predict(kept, variants(test, "dropped", list(regions)), model, ["dropped"])


def refitted_sets(
    features: DataFrame, sets: DataFrame, train: DataFrame, test: DataFrame, names: list[str], **options
) -> DataFrame:
    """Predictions of models fitted on the units of one set each; `sets` is (set, session, region, unit).

    All sets and sessions are one fit: a set and a session together take the place of the session.
    """
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("session", F.struct("set", "session")).drop("set")

    kept = written(keyed(features.join(sets.select("set", *U), U)))
    model = fit_linear(kept, keyed(variants(train, "set", names)), **options)
    done = predict(kept, keyed(variants(test, "set", names)), model)
    return done.select("session.set", "session.session", *[c for c in done.columns if c != "session"])


def occlusion_gain(features: DataFrame, test: DataFrame, model: LinearModel) -> DataFrame:
    """Rise in log loss and errors when one unit is set to zero.

    Removing a unit changes a trial only where the unit fired, so feature rows are enough: no unit x trial
    grid and no refit.
    """
    code = F.coalesce(*[F.when(F.col("label") == c, F.lit(i)) for i, c in enumerate(CLASSES)])
    scored = _trial_scores(features, test, model).withColumn("y", code).select(*TRIAL, "y", *[f"z_{k}" for k in C])
    rows = features.join(model.coef, U).join(scored, TRIAL)

    def log_loss(z: list[Column]) -> Column:
        top = F.greatest(*z)
        own = F.coalesce(*[F.when(F.col("y") == k, z[k]) for k in C])
        return F.ln(add(F.exp(v - top) for v in z)) + top - own

    def wrong(z: list[Column]) -> Column:
        best = F.greatest(*z)
        return (F.coalesce(*[F.when(z[k] == best, F.lit(k)) for k in C]) != F.col("y")).cast("int")

    full = [F.col(f"z_{k}") for k in C]
    cut_ = [F.col(f"z_{k}") - F.col("x") * F.col(f"w_{k}") for k in C]
    return rows.groupBy(*U).agg(
        F.sum(log_loss(cut_) - log_loss(full)).alias("loss_gain"), F.sum(wrong(cut_) - wrong(full)).alias("error_gain")
    )

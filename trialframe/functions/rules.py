"""Trial quality rules and label rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import QcRules
from .parsing import MISSING_WORDS, lick_list


def text(c: Column) -> Column:
    """Text of a log cell as a dataframe reader would print it: an empty cell reads `nan`."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))), F.lit("nan"))


def behavior_reason_a(columns: set[str], rules: QcRules, has_row: Column | None = None) -> Column:
    """First matching exclusion reason of a log row, NULL when the trial is kept."""
    has_row = F.lit(True) if has_row is None else has_row
    reasons = []
    if "excluded" in columns:
        why = F.coalesce(F.col("exclusion_reason"), F.lit("nan")) if "exclusion_reason" in columns else F.lit("")
        is_true = F.lower(F.col("excluded").cast("string")) == "true"
        reasons.append(F.when(is_true, F.concat(F.lit("csv_excluded:"), why)))
    if "early_lick" in columns:
        reasons.append(F.when(text(F.col("early_lick")) == "early", F.lit("csv_early_lick")))
    if rules.exclude_photostim and "photostim_onset" in columns:
        reasons.append(F.when(~text(F.col("photostim_onset")).isin(*MISSING_WORDS), F.lit("csv_photostim")))
    if rules.exclude_auto_water:
        reasons.append(F.when(water_given_a(columns), F.lit("csv_auto_or_free_water")))
    if "outcome" in columns:
        outcome = text(F.col("outcome"))
        reasons.append(
            F.when(~outcome.isin("hit", "ignore", ""), F.concat(F.lit("csv_outcome_"), outcome))
        )
    no_row = F.when(~has_row, F.lit("no_csv_row")) if rules.require_csv_row else F.lit(None).cast("string")
    found = F.coalesce(*reasons) if reasons else F.lit(None).cast("string")
    return F.coalesce(no_row, F.when(has_row, found))


def water_given_a(columns: set[str]) -> Column:
    """Any water above zero; an auto_water cell that is no number hides free_water."""
    auto = F.col("auto_water") if "auto_water" in columns else F.lit(None).cast("string")
    free = F.col("free_water") if "free_water" in columns else F.lit(None).cast("string")

    def amount(c: Column) -> Column:
        return F.nanvl(c.try_cast("double"), F.lit(0.0))

    readable = auto.isNull() | (auto.cast("string") == "") | auto.try_cast("double").isNotNull()
    return (F.coalesce(amount(auto), F.lit(0.0)) > 0) | (
        readable & (F.coalesce(amount(free), F.lit(0.0)) > 0)
    )


def keep_behavior_b(columns: set[str], rules: QcRules) -> Column:
    """TRUE when the second rule set keeps the log row."""
    drop = []
    if "excluded" in columns:
        drop.append(text(F.col("excluded")).isin("1", "true", "yes", "y"))
    if rules.exclude_early_lick and "early_lick" in columns:
        drop.append(~text(F.col("early_lick")).isin("no early", "nan", "none", ""))
    if rules.exclude_photostim:
        if "photostim_onset" in columns:
            drop.append(~text(F.col("photostim_onset")).isin(*MISSING_WORDS))
        if "photostim_start_times" in columns:
            start = F.trim(F.col("photostim_start_times").cast("string"))
            drop.append(F.coalesce(~start.isin("", "nan", "n/a"), F.lit(False)))
    if rules.exclude_auto_water:
        for name in ("auto_water", "free_water"):
            if name in columns:
                drop.append(F.coalesce(F.nanvl(F.col(name).try_cast("double"), F.lit(0.0)) > 0, F.lit(False)))
    if rules.exclude_both_licks and {"left_lick_times", "right_lick_times"} <= columns:
        drop.append(
            (F.size(lick_list(F.col("left_lick_times"))) > 0) & (F.size(lick_list(F.col("right_lick_times"))) > 0)
        )
    out = F.lit(True)
    for d in drop:
        out = out & ~d
    return out


def label_from_licks_a(licked_left: Column, licked_right: Column) -> Column:
    """Label implied by licks after go; NULL when both sides were licked."""
    return (
        F.when(licked_left & ~licked_right, "Left")
        .when(licked_right & ~licked_left, "Right")
        .when(~licked_left & ~licked_right, "Ignore")
    )


def action_class_b(has_left: Column, has_right: Column, outcome: Column, rules: QcRules = QcRules()) -> Column:
    """Action of a trial from all its licks; outcome `ignore` wins over a single side."""
    result = F.coalesce(F.lower(F.trim(outcome)), F.lit(""))
    out = F.when(has_left & has_right, F.lit(None).cast("string")).when(
        (result == "ignore") | (~has_left & ~has_right), "Ignore"
    )
    if rules.keep_miss_as_ignore:
        out = out.when(result == "miss", "Ignore")
    return out.when(has_left, "Left").otherwise("Right")


def trial_reason(
    behavior_reason: Column, early: Column, implied: Column, folder: Column, rules: QcRules,
    load_error: Column | None = None,
) -> Column:
    """Chain of trial exclusions, first match wins; NULL when kept."""
    steps = []
    if load_error is not None:
        steps.append(F.when(load_error.isNotNull(), F.concat(F.lit("load_error:"), load_error)))
    steps.append(behavior_reason)
    if rules.drop_early_lick:
        steps.append(F.when(early, F.lit("npz_early_lick")))
    if rules.drop_label_mismatch:
        mismatch = F.concat(F.lit("label_mismatch(folder="), folder, F.lit(",licks="), implied, F.lit(")"))
        steps.append(F.when(implied.isNotNull() & (implied != folder), mismatch))
        steps.append(F.when(implied.isNull(), F.lit("licked_both_sides")))
    return F.coalesce(*steps)


def label_precedence(
    folder: Column, has_row: Column, has_left: Column, has_right: Column, outcome: Column, rules: QcRules = QcRules()
) -> tuple[Column, Column]:
    """(label, label_source): the action of the log row where one exists, else the folder."""
    action = action_class_b(has_left, has_right, outcome, rules)
    label = F.when(has_row, action).otherwise(folder).alias("label")
    return label, F.when(has_row, "csv+folder").otherwise("folder").alias("label_source")

"""Readable explanations of a selection as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..schema import CRITERIA


def number(x: Column, spec: str) -> Column:
    """A number in a format such as `.1e` or `+.2f`, rounded on its exact binary value. The JVM formatter
    rounds the shortest decimal instead, which differs on ties; these texts are written once per unit."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: format(v, spec), na_action="ignore").astype(object)

    return F.pandas_udf(run, StringType())(x.cast("double"))


def reasons_a() -> Column:
    """One line per unit: failed floor alone, else the satisfied criteria joined by `; `."""
    c = F.col
    floor = F.concat(
        F.lit("below activity floor ("), number(c("rate_hz"), ".1f"), F.lit(" Hz, active "),
        number(c("active_frac"), ".0%"), F.lit(")"),
    )
    met = F.concat_ws(
        "; ",
        F.when(
            c("c_selectivity"),
            F.format_string(
                "choice-selective delay rate (q=%s, eta2=%s, d(L-R)=%s)",
                number(c("q_selectivity"), ".1e"), number(c("eta_sq"), ".2f"),
                F.coalesce(number(c("d_left_right"), "+.2f"), F.lit("+nan")),
            ),
        ),
        F.when(
            c("c_coupling"),
            F.format_string(
                "late-delay rate predicts own response rate (rho=%s, q=%s)",
                number(c("rho_coupling"), "+.2f"), number(c("q_coupling"), ".1e"),
            ),
        ),
        F.when(
            c("c_spectral"),
            F.format_string(
                "class-dependent %s-band wavelet power (q=%s)", c("spectral_band"), number(c("q_spectral"), ".1e")
            ),
        ),
        F.when(
            c("c_ramp"),
            F.format_string(
                "%s-ramping delay PSTH (rho=%s, q=%s)",
                F.when(c("ramp_rho") > 0, "up").otherwise("down"), number(c("ramp_rho"), "+.2f"), number(c("q_ramp"), ".1e"),
            ),
        ),
    )
    return F.when(~c("pass_floor"), floor).when(met == "", "no significant criterion").otherwise(met)


def reason_list_b(unit_type: Column | None = None) -> Column:
    """array<string> of threshold remarks; a default line when none applies."""
    c = F.col
    kind = F.lit(None).cast("string") if unit_type is None else unit_type
    pretty = F.when(kind == "delay_choice", "persistent delay-choice cell").when(
        kind == "delay_ramp", "delay-ramping preparatory cell"
    )
    # The remark wordings of the report.
    remarks = F.array(
        F.when(
            c("dprime") > 0.8,
            F.format_string(
                "Choice-discriminative delay rate (d′=%s vs other actions; prefers %s).",
                number(c("dprime"), ".2f"), c("preferred_class"),
            ),
        ),
        F.when(
            c("coupling") > 0.25,
            F.format_string("Delay PSTH shape predicts this unit’s lick-period PSTH (r=%s).", number(c("coupling"), ".2f")),
        ),
        F.when(
            c("tf_selectivity") > 0.02,
            F.format_string("Delay-period β/low-γ wavelet power is class-modulated (TF score=%s).", number(c("tf_selectivity"), ".2f")),
        ),
        F.when(
            c("attention") > 0,
            F.format_string(
                "Neuron attention is high (a=%s); the unit is used as past context.", number(c("attention"), ".3f")
            ),
        ),
        F.when(
            c("prediction_gain") > 0,
            F.format_string(
                "Occluding this unit raises lick-raster prediction error (ΔMSE gain=%s).",
                number(c("prediction_gain"), ".3f"),
            ),
        ),
        F.when(
            pretty.isNotNull(),
            F.format_string("Ground-truth type: %s — the ALM preparatory motif of Li/Inagaki/Svoboda.", pretty),
        ),
        F.when(c("delay_rate_hz") < 0.4, F.lit("Low delay rate; kept only if other scores remain high.")),
    )
    kept = F.filter(remarks, lambda x: x.isNotNull())
    default = F.array(F.lit("Composite score above the regional threshold from weaker combined cues."))
    return F.when(F.size(kept) == 0, default).otherwise(kept)


def reasons_b(unit_type: Column | None = None) -> Column:
    return F.concat_ws(" | ", reason_list_b(unit_type))


def badges() -> Column:
    """Letters of the satisfied criteria: S, C, W, R."""
    letters = dict(zip(CRITERIA, "SCWR"))
    return F.concat(*[F.when(F.col(f"c_{k}"), letter).otherwise("") for k, letter in letters.items()])

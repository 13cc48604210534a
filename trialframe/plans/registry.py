"""Named queries over the given tables, each with its reference SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, doubles rounded to six places."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(spark, sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def r(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {name}"


def sig(expr: str, digits: int = 9) -> str:
    """Rounded to significant digits, as `functions.signal.significant`."""
    power = f"power(10, floor(log10(abs({expr}))))"
    return f"CASE WHEN abs({expr}) < 1e-20 THEN 0 ELSE round({expr} / {power}, {digits - 1}) * {power} END"


def draw_sql(seed: int, *cols: str) -> str:
    """The seeded number of a row, as `operators.skew.draw`."""
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(cols)})), 1, 15))::BIGINT"


def b(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


# Views of the event table as SQL; bins include the right edge of a window, as the operators do.
BASE = """
WITH spikes AS (
  SELECT user_id // 50 AS session, user_id AS unit,
         ['ALM_L', 'ALM_R', 'STR_L', 'STR_R'][user_id % 4 + 1] AS region,
         CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS BIGINT) AS trial,
         (epoch_us(ts) % 86400000000) / 1e6 AS t, event_type, value
  FROM events),
units AS (SELECT DISTINCT session, region, unit FROM spikes),
licks AS (
  SELECT session, trial, CASE WHEN event_type = 'purchase' THEN 'Left' ELSE 'Right' END AS side, t
  FROM spikes WHERE event_type IN ('purchase', 'signup') AND value > 150),
trials AS (
  SELECT s.session, s.trial,
         count(CASE WHEN l.side = 'Left' AND l.t >= 43200 THEN 1 END) AS n_left,
         count(CASE WHEN l.side = 'Right' AND l.t >= 43200 THEN 1 END) AS n_right,
         count(CASE WHEN l.t < 43200 THEN 1 END) AS n_early
  FROM (SELECT DISTINCT session, trial FROM spikes) s
  LEFT JOIN licks l ON s.session = l.session AND s.trial = l.trial GROUP BY s.session, s.trial),
labelled AS (
  SELECT *, CASE WHEN n_left > 0 AND n_right = 0 THEN 'Left' WHEN n_right > 0 AND n_left = 0 THEN 'Right'
                 WHEN n_left = 0 AND n_right = 0 THEN 'Ignore' END AS label FROM trials),
lab AS (SELECT session, trial, label FROM labelled WHERE label IS NOT NULL),
sizes AS (
  SELECT session, count(*) AS n_trials, count(*) FILTER (label = 'Ignore') AS n_0,
         count(*) FILTER (label = 'Left') AS n_1, count(*) FILTER (label = 'Right') AS n_2
  FROM lab GROUP BY session),
behavior AS (
  SELECT session, trial,
    CASE WHEN max(CASE WHEN event_type = 'error' THEN value END) > 250 THEN 'True' ELSE 'False' END AS excluded,
    CASE WHEN count(CASE WHEN event_type = 'view' AND value > 200 THEN 1 END) > 0 THEN '0.5' END AS photostim_onset,
    CASE WHEN count(CASE WHEN event_type = 'click' AND value > 250 THEN 1 END) > 0 THEN 1 ELSE 0 END AS auto_water,
    CASE count(CASE WHEN event_type = 'error' THEN 1 END) % 4
         WHEN 0 THEN 'hit' WHEN 1 THEN 'ignore' WHEN 2 THEN 'hit' ELSE 'miss' END AS outcome
  FROM spikes GROUP BY session, trial),
cells AS (
  SELECT s.session, s.region, s.unit, s.trial, l.label, 'ctx' AS win,
         least(CAST(floor(s.t / 1800) AS INT), 23) AS bin, count(*) AS n
  FROM spikes s JOIN labelled l ON s.session = l.session AND s.trial = l.trial WHERE s.t <= 43200 GROUP BY ALL
  UNION ALL
  SELECT s.session, s.region, s.unit, s.trial, l.label, 'tgt',
         least(CAST(floor((s.t - 43200) / 3600) AS INT), 11), count(*)
  FROM spikes s JOIN labelled l ON s.session = l.session AND s.trial = l.trial WHERE s.t >= 43200 GROUP BY ALL),
ut AS (
  SELECT u.session, u.region, u.unit, l.trial, l.label,
         coalesce(sum(c.n) FILTER (c.win = 'ctx'), 0) AS ctx,
         coalesce(sum(c.n) FILTER (c.win = 'ctx' AND c.bin >= 16), 0) AS late,
         coalesce(sum(c.n) FILTER (c.win = 'tgt'), 0) AS tgt
  FROM units u JOIN lab l ON u.session = l.session
  LEFT JOIN cells c ON c.session = u.session AND c.unit = u.unit AND c.trial = l.trial
  GROUP BY u.session, u.region, u.unit, l.trial, l.label)
"""

# Tie-corrected rank test over classes with two or more trials, from rows (KEY, label, v).
KRUSKAL = """
, kk_n AS (SELECT {key}, label, count(*) AS nk, min(v) AS lo, max(v) AS hi FROM {rows} GROUP BY {key}, label),
kk_r AS (
  SELECT {key}, label, v, rank() OVER (PARTITION BY {key} ORDER BY v)
         + (count(*) OVER (PARTITION BY {key}, v) - 1) / 2.0 AS rk,
         count(*) OVER (PARTITION BY {key}, v) AS ties
  FROM {rows} SEMI JOIN (SELECT * FROM kk_n WHERE nk >= 2) USING ({key}, label)),
kk_s AS (SELECT {key}, label, sum(rk) AS rs, count(*) AS nk FROM kk_r GROUP BY {key}, label),
kk_t AS (SELECT {key}, count(*) AS n, sum(ties * ties - 1) AS tie_sum FROM kk_r GROUP BY {key}),
kk_h AS (
  SELECT {key}, sum(rs * rs / nk) AS ss, count(*) AS g FROM kk_s GROUP BY {key}),
kk_c AS (SELECT {key}, bool_or(hi > lo) AS varied FROM kk_n WHERE nk >= 2 GROUP BY {key}),
kw AS (
  SELECT {key}, CASE WHEN g >= 2 AND varied THEN
           (12.0 / (n * (n + 1)) * ss - 3 * (n + 1)) / nullif(1 - tie_sum / (n * n * CAST(n AS DOUBLE) - n), 0) END AS h,
         CASE WHEN g >= 2 AND varied THEN g - 1 END AS df
  FROM kk_h JOIN kk_t USING ({key}) JOIN kk_c USING ({key}))
"""


def kruskal_sql(rows: str, key: str) -> str:
    return KRUSKAL.format(rows=rows, key=key)

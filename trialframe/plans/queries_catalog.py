"""Name parsing, catalog, quality rules, labels and trial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import epochs as ep
from ..functions import parsing as P
from ..functions import rules as Q
from ..operators import joins as J
from ..operators import summary as SM
from ..schema import CLASSES, QcRules
from . import binding as B
from .queries_raster import base, counts
from .registry import BASE, b, draw_sql, query, r

# ---------------------------------------------------------------- parsing


@query("prj_trial_number", """
SELECT c_custkey, CAST(nullif(regexp_extract(c_name, '(?i)customer[#_-]?0*(\\d+)', 1), '') AS BIGINT) AS trial FROM customer""")
def prj_trial_number(spark, sf):
    t = P.trial_number(F.col("c_name"), r"(?i)customer[#_-]?0*(\d+)")
    return B.table(spark, sf, "customer").select("c_custkey", t.alias("trial"))


@query("prj_trial_number_strict", """
SELECT page_id, TRY_CAST(nullif(regexp_extract(url || '/trial-' || page_id || CASE WHEN page_id % 2 = 0 THEN '.npz' ELSE '.avi' END,
       '(?i)trial[_-]?(\\d+)\\.npz$', 1), '') AS BIGINT) AS trial FROM pages""")
def prj_trial_number_strict(spark, sf):
    suffix = F.when(F.col("page_id") % 2 == 0, ".npz").otherwise(".avi")
    name = F.concat(F.col("url"), F.lit("/trial-"), F.col("page_id").cast("string"), suffix)
    return B.table(spark, sf, "pages").select("page_id", P.trial_number_strict(name).alias("trial"))


@query("prj_class_folder", """
SELECT event_id, CASE WHEN lower(c) IN ('ignore', 'left', 'right') THEN upper(c[1]) || lower(c[2:]) END AS label
FROM (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'LEFT' WHEN 'signup' THEN 'right' WHEN 'view' THEN 'Ignore' ELSE event_type END AS c FROM events)""")
def prj_class_folder(spark, sf):
    e = F.col("event_type")
    name = F.when(e == "purchase", "LEFT").when(e == "signup", "right").when(e == "view", "Ignore").otherwise(e)
    return B.table(spark, sf, "events").select("event_id", P.class_folder(name).alias("label"))


# Region texts in the spellings the two parsers treat differently.
SPELLINGS = ["left ALM", "Right Striatum", "ALM_L", "ALM-Left", "STR-r", "unknown left ALM", "ALM", "left striatum ", "right-alm", "thalamus"]
SPELL_SQL = "[" + ", ".join(f"'{s}'" for s in SPELLINGS) + "]"


def region_text(spark, sf):
    e = B.table(spark, sf, "events")
    pick = F.get(F.array(*[F.lit(s) for s in SPELLINGS]), F.pmod("event_id", F.lit(len(SPELLINGS))).cast("int"))
    return e.select("event_id", pick.alias("raw"))


@query("prj_region_canon_a", f"""
WITH x AS (SELECT event_id, translate(lower(trim({SPELL_SQL}[event_id % 10 + 1])), '-_', '  ') AS s FROM events),
y AS (SELECT event_id, CASE WHEN s LIKE '%alm%' THEN 'ALM' WHEN s LIKE '%str%' THEN 'STR' END AS area,
        CASE WHEN regexp_matches(s, '\\b(left|l)\\b') THEN 'L' WHEN regexp_matches(s, '\\b(right|r)\\b') THEN 'R' END AS side FROM x)
SELECT event_id, CASE WHEN area IS NOT NULL AND side IS NOT NULL THEN area || '_' || side END AS region FROM y""")
def prj_region_canon_a(spark, sf):
    return region_text(spark, sf).select("event_id", P.region_canon_a(F.col("raw")).alias("region"))


@query("prj_region_canon_b", f"""
WITH x AS (SELECT event_id, lower(trim({SPELL_SQL}[event_id % 10 + 1])) AS s FROM events)
SELECT event_id, CASE
  WHEN s IN ('left alm', 'alm-left') THEN 'left_ALM' WHEN s IN ('right alm', 'alm-right') THEN 'right_ALM'
  WHEN s IN ('left striatum', 'str-left') THEN 'left_Striatum' WHEN s IN ('right striatum', 'str-right') THEN 'right_Striatum'
  WHEN s LIKE '%unknown%' THEN NULL
  WHEN s LIKE '%alm%' AND s LIKE '%left%' THEN 'left_ALM' WHEN s LIKE '%alm%' AND s LIKE '%right%' THEN 'right_ALM'
  WHEN s LIKE '%str%' AND s LIKE '%left%' THEN 'left_Striatum' WHEN s LIKE '%str%' AND s LIKE '%right%' THEN 'right_Striatum'
  END AS region FROM x""")
def prj_region_canon_b(spark, sf):
    return region_text(spark, sf).select("event_id", P.region_canon_b(F.col("raw")).alias("region"))


LICK_TEXT_SQL = """CASE WHEN event_id % 7 = 0 THEN 'N/A' WHEN event_id % 11 = 0 THEN ''
  ELSE CAST(user_id AS VARCHAR) || '.25; ' || CAST(event_id % 90 AS VARCHAR) || ', ,' || event_type || ',' END"""


def lick_text():
    i = F.col("event_id")
    text = F.concat(
        F.col("user_id").cast("string"), F.lit(".25; "), (i % 90).cast("string"), F.lit(", ,"), F.col("event_type"), F.lit(",")
    )
    return F.when(i % 7 == 0, "N/A").when(i % 11 == 0, "").otherwise(text)


@query("prj_lick_parse", f"""
WITH x AS (SELECT event_id, {LICK_TEXT_SQL} AS s FROM events),
y AS (SELECT event_id, unnest(string_split(replace(s, ';', ','), ',')) AS tok, s FROM x),
z AS (SELECT event_id, count(TRY_CAST(trim(tok) AS DOUBLE)) AS n,
             sum(TRY_CAST(trim(tok) AS DOUBLE)) AS total FROM y WHERE lower(trim(s)) NOT IN ('', 'nan', 'n/a', 'none') GROUP BY event_id)
SELECT x.event_id, coalesce(z.n, 0) AS n, {r('coalesce(total, 0)', 'total')} FROM x LEFT JOIN z ON x.event_id = z.event_id""")
def prj_lick_parse(spark, sf):
    df = B.table(spark, sf, "events").select("event_id", P.lick_list(lick_text()).alias("t"))
    total = F.aggregate("t", F.lit(0.0), lambda s, x: s + x)
    return df.select("event_id", F.size("t").alias("n"), total.alias("total"))


@query("prj_scalar_coerce", f"""
SELECT event_id, {r("CASE WHEN event_id % 5 = 0 THEN -1 WHEN event_id % 3 = 0 THEN -1 ELSE value END", 'x')} FROM events""")
def prj_scalar_coerce(spark, sf):
    i = F.col("event_id")
    empty = F.array().cast("array<string>")
    values = F.when(i % 5 == 0, empty).when(i % 3 == 0, F.array(F.lit("absent"))).otherwise(
        F.array(F.col("value").cast("string"), F.lit("9"))
    )
    return B.table(spark, sf, "events").select("event_id", P.scalar(values, -1.0).alias("x"))


@query("prj_epoch_resolve", f"""
WITH x AS (SELECT event_id, value,
  CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN value END AS file_delay,
  CASE WHEN event_id % 4 = 2 THEN value * 2 END AS alias_delay,
  CASE WHEN event_id % 3 = 0 THEN value * 3 END AS log_delay,
  CASE WHEN event_id % 5 = 0 THEN value + 1 END AS file_go, CASE WHEN event_id % 2 = 0 THEN value + 2 END AS file_stop FROM events)
SELECT event_id, {r('coalesce(file_delay, CASE WHEN event_id % 4 IN (0, 2) THEN alias_delay END, log_delay)', 'delay_start')},
       {r('coalesce(file_go, file_stop)', 'go_start')} FROM x""")
def prj_epoch_resolve(spark, sf):
    """File key, then singular alias only where the key is absent, then the log; go falls back to delay stop."""
    i, v = F.col("event_id"), F.col("value")
    nan = F.lit(float("nan"))
    none = F.lit(None).cast("array<double>")
    df = B.table(spark, sf, "events").select(
        "event_id",
        F.when(i % 4 == 1, F.array(v)).when(i % 4 == 3, F.array(nan)).otherwise(none).alias("delay_start_times"),
        F.when((i % 4 == 2) | (i % 4 == 3), F.array(v * 2)).otherwise(none).alias("delay_start_time"),
        F.when(i % 3 == 0, (v * 3).cast("string")).otherwise("N/A").alias("log_delay_start_times"),
        F.when(i % 5 == 0, F.array(v + 1)).otherwise(none).alias("go_start_times"),
        F.when(i % 2 == 0, F.array(v + 2)).otherwise(none).alias("delay_stop_times"),
    )
    e = ep.resolve_epochs(set(df.columns), {"log_delay_start_times"})
    return df.select("event_id", e["delay_start_times"].alias("delay_start"), e["go_start_times"].alias("go_start"))


@query("prj_session_keys", """
WITH x AS (SELECT DISTINCT user_id // 50 AS s, user_id % 3 AS m FROM events),
y AS (SELECT s, m, 'sub-' || s || '_ses-' || m AS dir, CASE WHEN m = 0 THEN 'raw' ELSE 'sub-' || s END AS parent FROM x)
SELECT s, m, array_to_string(list_filter([dir, CASE WHEN m > 0 THEN parent END, CASE WHEN m > 0 THEN CAST(s AS VARCHAR) END,
  regexp_replace(CASE WHEN m > 0 THEN parent ELSE dir END, '[^0-9]', '', 'g') || ':' || m], lambda k: k IS NOT NULL), '|') AS keys FROM y""")
def prj_session_keys(spark, sf):
    e = B.table(spark, sf, "events")
    x = e.select(F.floor(F.col("user_id") / 50).cast("long").alias("s"), (F.col("user_id") % 3).alias("m")).distinct()
    s, m = F.col("s").cast("string"), F.col("m").cast("string")
    directory = F.concat(F.lit("sub-"), s, F.lit("_ses-"), m)
    parent = F.when(F.col("m") == 0, "raw").otherwise(F.concat(F.lit("sub-"), s))
    return x.select("s", "m", F.array_join(P.session_keys(directory, parent, F.col("m")), "|").alias("keys"))


# ---------------------------------------------------------------- quality rules and labels

QC_A = """CASE WHEN lower(excluded) = 'true' THEN 'csv_excluded:'
  WHEN photostim_onset IS NOT NULL THEN 'csv_photostim' WHEN auto_water > 0 THEN 'csv_auto_or_free_water'
  WHEN outcome NOT IN ('hit', 'ignore') THEN 'csv_outcome_' || outcome END"""


def behavior_reason():
    return Q.behavior_reason_a({"excluded", "photostim_onset", "auto_water", "outcome"}, QcRules())


@query("qc_behavior_a", BASE + f"SELECT session, trial, {QC_A} AS reason FROM behavior")
def qc_behavior_a(spark, sf):
    return B.behavior(B.spikes(spark, sf)).select("session", "trial", behavior_reason().alias("reason"))


@query("qc_behavior_b", BASE + """
SELECT b.session, b.trial, NOT (lower(excluded) = 'true' OR t.n_early > 0 OR photostim_onset IS NOT NULL OR auto_water > 0
  OR (t.n_left > 0 AND t.n_right > 0)) AS kept
FROM behavior b JOIN trials t ON b.session = t.session AND b.trial = t.trial""")
def qc_behavior_b(spark, sf):
    df = B.trial_rules(B.spikes(spark, sf))
    lick = F.lit("50000.0")
    df = df.select(
        "session", "trial", "excluded", "photostim_onset", "auto_water",
        F.when(F.col("n_early") > 0, "early (auto)").otherwise("no early").alias("early_lick"),
        F.when(F.col("n_left") > 0, lick).alias("left_lick_times"),
        F.when(F.col("n_right") > 0, lick).alias("right_lick_times"),
    )
    return df.select("session", "trial", Q.keep_behavior_b(set(df.columns), QcRules()).alias("kept"))


FOLDER = "CASE WHEN trial % 6 = 0 THEN 'Ignore' ELSE coalesce(label, 'Left') END"
CHAIN = BASE + f""", q AS (
  SELECT l.session, l.trial, l.label, l.n_early, CASE WHEN l.trial % 6 = 0 THEN 'Ignore' ELSE coalesce(l.label, 'Left') END AS folder,
         {QC_A} AS why FROM labelled l JOIN behavior b ON b.session = l.session AND b.trial = l.trial),
ch AS (
  SELECT session, trial, folder, CASE WHEN why IS NOT NULL THEN why WHEN n_early > 0 THEN 'npz_early_lick'
    WHEN label <> folder THEN 'label_mismatch(folder=' || folder || ',licks=' || label || ')'
    WHEN label IS NULL THEN 'licked_both_sides' END AS reason FROM q)
"""


def trial_chain(spark, sf):
    df = B.trial_rules(B.spikes(spark, sf))
    folder = F.when(F.col("trial") % 6 == 0, "Ignore").otherwise(F.coalesce(F.col("label"), F.lit("Left")))
    df = df.withColumn("folder", folder)
    reason = Q.trial_reason(behavior_reason(), F.col("n_early") > 0, F.col("label"), F.col("folder"), QcRules())
    return df.select("session", "trial", "folder", reason.alias("reason"))


@query("qc_trial_chain", CHAIN + "SELECT session, trial, folder, reason FROM ch")
def qc_trial_chain(spark, sf):
    return trial_chain(spark, sf)


REASONS = ["csv_excluded", "csv_photostim", "csv_auto_or_free_water", "csv_outcome_miss", "npz_early_lick", "licked_both_sides"]
CODE = "regexp_extract(reason, '^[^:(]*')"
AUDIT = ", ".join(f"""count(*) FILTER ({CODE} = '{x}') AS "excl_{x}" """ for x in REASONS)
AUDIT += f", count(*) FILTER ({CODE} NOT IN ({', '.join(repr(x) for x in REASONS)})) AS excl_other"


@query("audit_summary", CHAIN + f"""
SELECT session, count(*) AS n_start, count(*) FILTER (reason IS NULL) AS n_kept, count(*) FILTER (reason IS NOT NULL) AS n_excluded,
       {AUDIT} FROM ch GROUP BY session""")
def audit_summary(spark, sf):
    return SM.audit_summary(trial_chain(spark, sf), REASONS)


@query("label_licks_a", BASE + "SELECT session, trial, label FROM labelled")
def label_licks_a(spark, sf):
    return B.trials(B.spikes(spark, sf)).select("session", "trial", "label")


ACTION = """CASE WHEN n_left > 0 AND n_right > 0 THEN NULL
  WHEN outcome = 'ignore' OR (n_left = 0 AND n_right = 0) THEN 'Ignore' WHEN n_left > 0 THEN 'Left' ELSE 'Right' END"""


@query("label_action_b", BASE + f"""
SELECT t.session, t.trial, {ACTION} AS label FROM trials t JOIN behavior b ON b.session = t.session AND b.trial = t.trial""")
def label_action_b(spark, sf):
    df = B.trial_rules(B.spikes(spark, sf))
    label = Q.action_class_b(F.col("n_left") > 0, F.col("n_right") > 0, F.col("outcome"))
    return df.select("session", "trial", label.alias("label"))


@query("label_precedence", BASE + f"""
SELECT t.session, t.trial, CASE WHEN b.outcome = 'hit' THEN {ACTION} ELSE 'Ignore' END AS label,
       CASE WHEN b.outcome = 'hit' THEN 'csv+folder' ELSE 'folder' END AS label_source
FROM trials t LEFT JOIN behavior b ON b.session = t.session AND b.trial = t.trial""")
def label_precedence(spark, sf):
    """The folder label stands unless a log row exists; log rows of hits are the ones present here."""
    sp = B.spikes(spark, sf)
    log = B.behavior(sp).where(F.col("outcome") == "hit").select("session", "trial", "outcome")
    df = B.trials(sp).join(log.withColumn("has_row", F.lit(True)), ["session", "trial"], "left")
    return df.select(
        "session", "trial",
        *Q.label_precedence(F.lit("Ignore"), F.col("has_row").isNotNull(), F.col("n_left") > 0, F.col("n_right") > 0, F.col("outcome")),
    )


# ---------------------------------------------------------------- joins


@query("join_behavior_last", f"""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders)
SELECT c_custkey, o_orderkey, o_orderstatus, {r('o_totalprice', 'o_totalprice')}, o.o_custkey IS NOT NULL AS has_row
FROM customer LEFT JOIN (SELECT * FROM o WHERE rn = 1) o ON o.o_custkey = c_custkey""")
def join_behavior_last(spark, sf):
    log = B.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus", "o_totalprice")
    trials = B.table(spark, sf, "customer").select("c_custkey")
    log = log.withColumn("file_pos", F.col("o_orderkey"))
    return J.join_behavior(trials, log, ["c_custkey"]).drop("file_pos")


@query("join_combined_fallback", BASE + """
, own AS (SELECT session, trial, outcome FROM behavior WHERE session % 2 = 0),
fb AS (SELECT * FROM own UNION ALL SELECT session, trial, outcome FROM behavior WHERE session NOT IN (SELECT session FROM own))
SELECT session, trial, outcome FROM fb""")
def join_combined_fallback(spark, sf):
    log = B.behavior(B.spikes(spark, sf)).select("session", "trial", "outcome")
    return J.with_fallback_log(log.where(F.col("session") % 2 == 0), log, "session")


@query("join_priority_lookup", """
WITH keys AS (
  SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS trial, 0 AS prio, c_mktsegment || ':' || c_custkey AS key FROM customer
  UNION ALL SELECT c_custkey, c_nationkey, 1, CAST(c_custkey % 50 AS VARCHAR) FROM customer
  UNION ALL SELECT c_custkey, c_nationkey, 2, c_mktsegment FROM customer),
offers AS (
  SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS trial, unnest([CAST(s_suppkey % 50 AS VARCHAR), ['BUILDING', 'AUTOMOBILE', 'MACHINERY'][s_suppkey % 3 + 1]]) AS key FROM supplier),
idx AS (SELECT key, trial, max(s_suppkey) AS s_suppkey FROM offers GROUP BY key, trial),
hit AS (SELECT c_custkey, arg_min(s_suppkey, prio) AS s_suppkey, min(prio) AS key_rank FROM keys JOIN idx USING (key, trial) GROUP BY c_custkey)
SELECT c.c_custkey, CAST(c.c_nationkey AS BIGINT) AS trial, CAST(h.key_rank AS BIGINT) AS key_rank, h.s_suppkey
FROM customer c LEFT JOIN hit h ON h.c_custkey = c.c_custkey""")
def join_priority_lookup(spark, sf):
    c = B.table(spark, sf, "customer")
    trials = c.select(
        "c_custkey", F.col("c_nationkey").cast("long").alias("trial"),
        F.array(
            F.concat(F.col("c_mktsegment"), F.lit(":"), F.col("c_custkey").cast("string")),
            (F.col("c_custkey") % 50).cast("string"), F.col("c_mktsegment"),
        ).alias("keys"),
    )
    s = B.table(spark, sf, "supplier")
    segment = F.get(F.array(F.lit("BUILDING"), F.lit("AUTOMOBILE"), F.lit("MACHINERY")), (F.col("s_suppkey") % 3).cast("int"))
    log = s.select(
        "s_suppkey", F.col("s_nationkey").cast("long").alias("trial"), F.col("s_suppkey").alias("file_pos"),
        F.array((F.col("s_suppkey") % 50).cast("string"), segment).alias("log_keys"),
    )
    out = J.priority_lookup(trials, "keys", log, "log_keys", "trial", "file_pos", ["s_suppkey"], ["c_custkey", "trial"])
    return out.drop("keys")


@query("join_video", BASE + """
, v AS (SELECT session, trial, CASE WHEN side = 'Left' THEN 'Left' ELSE 'Right' END AS label, max(CAST(round(t * 1000) AS BIGINT)) AS pos FROM licks GROUP BY ALL)
SELECT l.session, l.trial, l.label, 'clip_' || v.pos || '.avi' AS video_path
FROM labelled l LEFT JOIN v ON v.session = l.session AND v.trial = l.trial AND v.label = l.label""")
def join_video(spark, sf):
    sp = B.spikes(spark, sf)
    pos = F.round(F.col("t") * 1000).cast("long")
    videos = B.licks(sp).select("session", "trial", F.col("side").alias("label"), pos.alias("file_pos"))
    videos = videos.withColumn("video_path", F.concat(F.lit("clip_"), F.col("file_pos").cast("string"), F.lit(".avi")))
    return J.join_videos(B.trials(sp).select("session", "trial", "label"), videos)


@query("first_trial_class", BASE + """
, f AS (SELECT session, trial, label, row_number() OVER (PARTITION BY session ORDER BY CASE WHEN label = 'Left' THEN 0 ELSE 1 END, trial) AS rn FROM lab)
SELECT session, trial, label FROM f WHERE rn = 1""")
def first_trial_class(spark, sf):
    return J.first_trial(B.trials(B.spikes(spark, sf)).where("label IS NOT NULL"))


@query("trial_by_path", BASE + """
SELECT session, trial, label FROM labelled WHERE 'A/' || session || '/trial_' || trial = 'A/0/trial_19730'""")
def trial_by_path(spark, sf):
    tr = B.trials(B.spikes(spark, sf)).select("session", "trial", "label")
    path = F.concat(F.lit("A/"), F.col("session").cast("string"), F.lit("/trial_"), F.col("trial").cast("string"))
    return J.by_path(tr.withColumn("path", path), "A/0/trial_19730").drop("path")


# ---------------------------------------------------------------- catalog and set operations


def catalog(spark, sf):
    """Trials of two datasets: even sessions are A, odd are B."""
    sp = B.spikes(spark, sf)
    tr = B.trials(sp).select("session", "trial", "label", "n_left", "n_right")
    dataset = F.when(F.col("session") % 2 == 0, "A").otherwise("B")
    return tr.withColumns(
        {"dataset": dataset, "has_csv": F.col("trial") % 3 != 0, "has_video": F.col("n_left") + F.col("n_right") > 0}
    )


CAT = BASE + """, cat AS (
  SELECT session, trial, label, CASE WHEN session % 2 = 0 THEN 'A' ELSE 'B' END AS dataset, trial % 3 <> 0 AS has_csv,
         n_left + n_right > 0 AS has_video FROM labelled)
"""
BY_CLASS = ", ".join(f"""count(*) FILTER (label = '{c}') AS "{c}" """ for c in CLASSES)


@query("catalog_summary", CAT + f"""
SELECT dataset, session, {BY_CLASS}, count(label) AS n_trials, count(*) FILTER (has_csv) AS with_csv,
       count(*) FILTER (has_video) AS with_video FROM cat GROUP BY dataset, session""")
def catalog_summary(spark, sf):
    return SM.catalog_summary(catalog(spark, sf))


@query("dataset_class_counts", CAT + f"SELECT dataset, {BY_CLASS} FROM cat GROUP BY dataset")
def dataset_class_counts(spark, sf):
    return SM.dataset_class_counts(catalog(spark, sf))


@query("class_counts", BASE + f"SELECT session, {BY_CLASS} FROM labelled GROUP BY session")
def class_counts(spark, sf):
    return SM.class_counts(B.trials(B.spikes(spark, sf)))


@query("min_trials_flag", BASE + f"""
SELECT session, {BY_CLASS}, least(count(*) FILTER (label = 'Ignore'), count(*) FILTER (label = 'Left'), count(*) FILTER (label = 'Right')) < 3 AS few_trials
FROM labelled GROUP BY session""")
def min_trials_flag(spark, sf):
    return SM.min_trials_flag(B.trials(B.spikes(spark, sf)))


BY_REGION = ", ".join(f"""count(*) FILTER (region = '{x}') AS "units_{x}" """ for x in ("ALM_L", "ALM_R", "STR_L", "STR_R"))


@query("cache_summary", BASE + f"""
, a AS (SELECT session, count(*) AS n_trials, {BY_CLASS} FROM lab GROUP BY session),
u AS (SELECT session, {BY_REGION} FROM units GROUP BY session)
SELECT a.*, u.* EXCLUDE (session), CAST(24 AS BIGINT) AS "T_ctx", CAST(12 AS BIGINT) AS "T_tgt" FROM a JOIN u ON u.session = a.session""")
def cache_summary(spark, sf):
    sp, tr, un = base(spark, sf)
    return SM.cache_summary(tr, un, B.N_CTX, B.N_TGT)


@query("union_datasets", CAT + "SELECT dataset, session, trial, label FROM cat")
def union_datasets(spark, sf):
    df = catalog(spark, sf).select("dataset", "session", "trial", "label")
    return J.union_datasets([df.where("dataset = 'A'"), df.where("dataset = 'B'")])


@query("distinct_sessions", BASE + "SELECT DISTINCT session FROM spikes")
def distinct_sessions(spark, sf):
    return B.spikes(spark, sf).select("session").distinct()


@query("catalog_order", CAT + "SELECT dataset, session, label, trial FROM cat ORDER BY dataset, session, label, trial")
def catalog_order(spark, sf):
    return catalog(spark, sf).select("dataset", "session", "label", "trial").orderBy("dataset", "session", "label", "trial")


@query("log_union", """
SELECT 'audited' AS source_csv, o_custkey AS session, o_orderkey AS trial, o_orderstatus AS outcome, NULL AS note FROM orders
UNION ALL SELECT 'combined', c_custkey, CAST(c_nationkey AS BIGINT), NULL, c_mktsegment FROM customer""")
def log_union(spark, sf):
    """Logs with different columns stacked by name, with their source."""
    o = B.table(spark, sf, "orders").select(
        F.lit("audited").alias("source_csv"), F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("trial"),
        F.col("o_orderstatus").alias("outcome"),
    )
    c = B.table(spark, sf, "customer").select(
        F.lit("combined").alias("source_csv"), F.col("c_custkey").alias("session"), F.col("c_nationkey").cast("long").alias("trial"),
        F.col("c_mktsegment").alias("note"),
    )
    return J.union_datasets([o, c])


@query("batches", BASE + """
SELECT session, trial, (row_number() OVER (PARTITION BY session ORDER BY trial) - 1) // 8 AS batch FROM lab""")
def batches(spark, sf):
    tr = B.trials(B.spikes(spark, sf)).where("label IS NOT NULL").select("session", "trial")
    return SM.session_batches(tr, 8)


@query("batches_shuffled", BASE + f"""
, k AS (SELECT session, trial, row_number() OVER (PARTITION BY session ORDER BY {draw_sql(3, 'session', 'trial')}, trial) AS p FROM lab)
SELECT session, trial, (p - 1) // 8 AS batch FROM k""")
def batches_shuffled(spark, sf):
    tr = B.trials(B.spikes(spark, sf)).where("label IS NOT NULL").select("session", "trial")
    return SM.session_batches(tr, 8, seed=3)


@query("raster_coverage", BASE + f"""
, dims AS (SELECT session, count(*) AS n_trials FROM labelled GROUP BY session),
reg AS (SELECT unnest(['ALM_L', 'ALM_R', 'STR_L', 'STR_R']) AS region),
pt AS (SELECT session, region, trial, sum(n) AS s, max(bin) AS lb FROM cells WHERE win = 'ctx' GROUP BY ALL),
seen AS (SELECT session, region, count(*) AS k, sum(s) AS s, max(lb) AS lb FROM pt GROUP BY ALL),
nu AS (SELECT session, region, count(*) AS nu FROM units GROUP BY ALL)
SELECT d.session, reg.region, d.n_trials, coalesce(nu, 0) AS n_units, coalesce(k, 0) AS trials_with_spikes, {b('coalesce(s, 0)', 'spikes')},
       coalesce(lb, 0) < 24 AS bins_ok, coalesce(nu, 0) > 0 AS covered
FROM dims d CROSS JOIN reg LEFT JOIN nu ON nu.session = d.session AND nu.region = reg.region
LEFT JOIN seen ON seen.session = d.session AND seen.region = reg.region""")
def raster_coverage(spark, sf):
    binned, tr, un = counts(spark, sf)
    return SM.region_coverage(binned, un, tr, B.N_CTX)


@query("unknown_regions", f"""
WITH x AS (SELECT user_id // 50 AS session, lower(trim({SPELL_SQL}[event_id % 10 + 1])) AS s FROM events)
SELECT session, count(*) FILTER (s IN ('alm', 'thalamus')) AS n_unknown, count(*) AS n_units FROM x GROUP BY session""")
def unknown_regions(spark, sf):
    e = B.table(spark, sf, "events")
    pick = F.get(F.array(*[F.lit(s) for s in SPELLINGS]), F.pmod("event_id", F.lit(len(SPELLINGS))).cast("int"))
    df = e.select(F.floor(F.col("user_id") / 50).cast("long").alias("session"), P.region_canon_a(pick).alias("region"))
    return SM.unknown_regions(df)



import numpy as np
import pytest
from pyspark.sql import functions as F

from trialframe.schema import Windows
from trialframe.sources import catalog, sinks, trial_files
from trialframe.streaming.ingest import ingest_new_trials


def ragged(n):
    out = np.empty(n, dtype=object)
    for i in range(n):
        out[i] = np.array([0.1 * i, 1.0 + i])
    return out


def make_tree(root):
    a = root / "Session1" / "Rasters" / "Left"
    b = root / "sub-7" / "sub-7_ses-1_behavior+x" / "NPZ" / "right"
    v = root / "Session1" / "Videos" / "Left"
    for d in (a, b, v):
        d.mkdir(parents=True)
    np.savez(
        a / "trial_0032.npz", unit_ids=np.array([4, 9]), brain_region=np.array(["left ALM", "mystery"]), spike_times=ragged(2),
        delay_start_times=np.float64(1.0), go_start_times=np.float64(2.2), left_lick_times=np.array([2.5]), right_lick_times=np.array([]),
    )
    keys = ("left_ALM_spikes", "right_ALM_spikes", "left_Striatum_spikes", "right_Striatum_spikes")
    np.savez(b / "trial2.npz", delay_start_time=1.0, go_start_time=2.2, **{k: ragged(8) for k in keys})
    (b / "trial3.npz").write_bytes(b"broken")
    (v / "trial_0032_lick_left.avi").write_bytes(b"RIFF")
    return root


def test_catalog_and_decode(spark, tmp_path):
    root = str(make_tree(tmp_path))
    files = catalog.list_files(spark, root)
    rows_a = catalog.catalog_a(files).collect()
    assert [(r["session"], r["trial"], r["label"]) for r in rows_a] == [("A/Session1", 32, "Left")]
    rows_b = sorted((r["session"], r["subject"], r["trial"], r["label"]) for r in catalog.catalog_b(files).collect())
    assert rows_b == [("B/sub-7_ses-1", "sub-7", 2, "Right"), ("B/sub-7_ses-1", "sub-7", 3, "Right")]
    assert catalog.catalog_subjects(files).where("trial = 2").first()["keys"][0] == "sub-7_ses-1_behavior+x"
    assert [r["trial"] for r in catalog.catalog_sessions(files).collect()] == [32]
    videos = catalog.video_index(spark, root)
    hit = catalog.with_videos(catalog.catalog_a(files).withColumn("session_dir", F.col("subject")), videos, "session_dir").first()
    assert hit["video_path"].endswith("trial_0032_lick_left.avi") and hit["session"] == "A/Session1"

    decoded = trial_files.read_trials(spark, root)
    errors = decoded.where("load_error IS NOT NULL").collect()
    assert len(errors) == 1 and errors[0]["path"].endswith("trial3.npz")
    units = trial_files.trial_units(decoded)
    assert units.where(F.col("path").contains("trial2")).groupBy("region").count().where("count = 8").count() == 4
    assert units.where(F.col("path").contains("0032")).select("region", "unit_id").collect() == [("ALM_L", "4")]
    assert trial_files.unknown_region_counts(decoded).where("n_unknown_region = 1").count() == 1
    assert trial_files.inspect(decoded).where("key = 'unit_ids' AND shape = '(2,)'").count() == 1


def test_pickles_cannot_call_code(spark, tmp_path):
    class Bad:
        def __reduce__(self):
            return (eval, ("1",))

    arr = np.empty(1, dtype=object)
    arr[0] = Bad()
    np.savez(tmp_path / "trial_1.npz", spike_times=arr, brain_region=np.array(["left ALM"]))
    row = trial_files.read_trials(spark, str(tmp_path)).first()
    assert "not allowed" in row["load_error"]


def test_logs(spark, tmp_path):
    one, two = tmp_path / "one.csv", tmp_path / "two.csv"
    one.write_text("session_dir,trial,outcome\ns1,1,hit\ns1,1,miss\ns1,x,hit\n")
    two.write_text("session_dir,trial,early_lick\ns1,2,N/A\n")
    log = catalog.read_log(spark, [str(one), str(two)])
    last = {r["trial"]: r for r in catalog.last_log_rows(log, ["session_dir", "trial"]).collect()}
    assert last[1]["outcome"] == "miss" and last[2]["early_lick"] is None and set(last) == {1, 2}


def test_log_folder_order_follows_names_not_sizes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("session_dir,trial,outcome\ns1,1,early\n")
    (tmp_path / "b.csv").write_text("session_dir,trial,outcome\n" + "".join(f"s1,{k},row{k}\n" for k in range(2000)) + "s1,1,last\n")
    log = catalog.read_log(spark, [str(tmp_path)])
    last = {r["trial"]: r["outcome"] for r in catalog.last_log_rows(log, ["session_dir", "trial"]).collect()}
    assert last[1] == "last" and last[7] == "row7"


def test_trials_find_their_log_rows(spark, tmp_path):
    (tmp_path / "tree").mkdir()
    trials = catalog.catalog_subjects(catalog.list_files(spark, str(make_tree(tmp_path / "tree"))))
    log = tmp_path / "log.csv"
    log.write_text(
        "session_dir,subject_id,trial,outcome\nsub-7_ses-1_behavior+x,,2,miss\nsub-7_ses-1_behavior+x,,2,hit\n"
        "other,7,2,ignore\nother,7,3,ignore\nother,8,2,miss\n"
    )
    got = {r["trial"]: r for r in catalog.with_log(trials, catalog.read_log(spark, [str(log)])).collect()}
    # the folder key beats subject and trial; of its rows the last one counts
    assert got[2]["outcome"] == "hit" and got[3]["outcome"] == "ignore" and got[3]["has_row"] and len(got) == 2
    log.write_text("session_dir,trial,outcome\nsomewhere,2,hit\n")
    none = catalog.with_log(trials, catalog.read_log(spark, [str(log)])).collect()
    assert [(r["outcome"], r["has_row"]) for r in none] == [(None, False)] * 2


def test_best_log_of_a_session(spark):
    rows = [("s", 1, "raw"), ("s", 0, "audited"), ("t", 2, "combined")]
    logs = spark.createDataFrame(rows, "session_dir string, priority int, outcome string")
    assert {r["outcome"] for r in catalog.session_logs(logs).collect()} == {"audited", "combined"}


def test_cache_and_results(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, 2), (1, 1, 5)], "session long, bin int, n long")
    path = sinks.save_cache(df, str(tmp_path / "cache"), Windows())
    assert path.endswith(Windows().key()) and Windows().key() != Windows(late_s=0.5).key()
    assert spark.read.text(f"{path}/_settings").first()[0] == Windows().settings()
    sinks.save_cache(df.where("session = 1"), str(tmp_path / "cache"), Windows())
    cached = sinks.load_cache(spark, str(tmp_path / "cache"), Windows())
    assert cached.count() == 2
    trials = spark.createDataFrame([(0,), (2,)], "session long")
    assert [r[0] for r in sinks.missing_sessions(trials, cached).collect()] == [2]
    doc = sinks.payload(spark.createDataFrame([(5,)], "n long"), df)
    sinks.save_payload(doc, str(tmp_path / "runs" / "criteria"))
    back = sinks.load_results(spark, str(tmp_path / "runs" / "*" / "*.txt"))
    assert back.first()["mode"] == "criteria" and back.first()["n"] == 5


def test_ingest_reads_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    root, out, check = make_tree(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    ingest_new_trials(spark, str(root), out, check)
    first = spark.read.parquet(out).count()
    ingest_new_trials(spark, str(root), out, check)
    assert first == 33 and spark.read.parquet(out).count() == first


def test_first_root_with_files(spark, tmp_path):
    (tmp_path / "bare").mkdir()
    root = make_tree(tmp_path / "full")
    files = catalog.first_nonempty(spark, [str(tmp_path / "none"), str(tmp_path / "bare"), str(root)])
    assert files.count() == 3
    assert catalog.first_nonempty(spark, [str(tmp_path / "none")]).collect() == []


def test_units_are_numbered_without_a_shuffle(spark, tmp_path):
    units = trial_files.trial_units(trial_files.read_trials(spark, str(make_tree(tmp_path / "t"))))
    assert "Exchange" not in units._jdf.queryExecution().executedPlan().toString()
    got = units.where(F.col("path").contains("trial2") & (F.col("region") == "ALM_R")).select("unit", "spike_times").collect()
    assert [(r["unit"], r["spike_times"][1]) for r in got] == [(k, 1.0 + k) for k in range(8)]


def test_report_limit_is_enforced(spark):
    with pytest.raises(Exception, match="3 rows at most"):
        sinks.payload(spark.createDataFrame([(5,)], "n long"), spark.range(4), most=3).collect()


def put(path, text="x"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_discovery_with_all_fallbacks(spark, tmp_path):
    """Rasters before the session folder, class folders before any depth, checks, relabelling and both-side trials."""
    d, e = tmp_path / "Data", tmp_path / "Data2"
    for x in ("Session1/Rasters/Left/trial_1.npz", "Session1/Left/trial_9.npz", "Session1/Rasters/x/Right/trial_8.npz",
              "session2/Right/trial_2.npz", "session3/deep/ignore/more/trial_3.npz", "other/Left/trial_4.npz"):
        put(d / x)
    a, b = e / "sub-7" / "sub-7_ses-1_behavior+x" / "NPZ", e / "sub-8" / "ses-2" / "NPZ"
    for x in ("Left/trial1.npz", "Left/trial2.npz", "Left/trial3.npz", "Left/trial4.npz", "Left/trial5.npz", "Left/trial6.npz"):
        put(a / x)
    put(b / "in" / "right" / "trial1.npz")
    put(e / "sub-9" / "plain" / "NPZ" / "Left" / "trial1.npz")
    s = "sub-7_ses-1_behavior+x"
    put(e / "combined_audited_master_log.csv", "session_dir,trial,outcome,excluded,left_lick_times,right_lick_times,early_lick\n"
        f'{s},1,hit,False,1.2,,no early\n{s},2,hit,False,,"1.3, 1.4",no early\n{s},3,ignore,False,,,no early\n'
        f"{s},4,hit,True,1.2,,no early\n{s},5,hit,False,1.2,1.3,no early\n")
    got = catalog.discover_trials(spark, [str(tmp_path / "none"), str(d)], [str(e)])
    rows = {(r["dataset"], r["session"], r["subject"], r["trial"], r["label"], r["label_source"]) for r in got.collect()}
    assert rows == {
        ("Data", "Session1", "Session1", 1, "Left", "folder"), ("Data", "session2", "session2", 2, "Right", "folder"),
        ("Data", "session3", "session3", 3, "Ignore", "folder"),
        ("Data2", s, "sub-7", 1, "Left", "csv+folder"), ("Data2", s, "sub-7", 2, "Right", "csv+folder"),
        ("Data2", s, "sub-7", 3, "Ignore", "csv+folder"), ("Data2", s, "sub-7", 6, "Left", "folder"), ("Data2", "ses-2", "sub-8", 1, "Right", "folder"),
    }
    bare = tmp_path / "bare"
    put(bare / "Left" / "trial_1.npz")
    put(tmp_path / "odd" / "m1" / "NPZ" / "Left" / "trial_2.npz")
    got = catalog.discover_trials(spark, [str(bare)], [str(tmp_path / "odd")]).collect()
    assert {(r["dataset"], r["session"], r["trial"], r["label"]) for r in got} == {("Data", "bare", 1, "Left"), ("Data2", "m1", 2, "Left")}
    assert catalog.discover_trials(spark, [str(tmp_path / "none")], []).collect() == []


def test_one_scan_of_all_logs(spark, tmp_path):
    """A session's audited log beats its raw one, that the combined log; the plan does not grow with the files."""
    put(tmp_path / "s1" / "behavioral_master_log.csv", "trial,outcome\n1,raw\n")
    put(tmp_path / "s1" / "behavioral_master_log_audited.csv", "outcome,trial,note\naudited,1,\"a, b\"\n")
    put(tmp_path / "s2" / "behavioral_master_log.csv", "trial,outcome\n1,raw\n2,\n")
    put(tmp_path / "combined_audited_master_log.csv", "session_dir,trial,outcome\ns1,1,combined\ns2,1,combined\ns3,1,combined\n")
    got = catalog.best_logs(spark, str(tmp_path))
    rows = sorted((r["session_dir"], r["trial"], r["outcome"], r["note"]) for r in got.collect() if r["outcome"])
    assert rows == [("s1", 1, "audited", "a, b"), ("s2", 1, "raw", None), ("s3", 1, "combined", None)]
    paths = [str(tmp_path / "s1" / "behavioral_master_log.csv"), str(tmp_path / "s2" / "behavioral_master_log.csv")]
    plans = [catalog.read_log(spark, x)._jdf.queryExecution().executedPlan().toString() for x in (paths[:1], paths)]
    assert [p.count("Scan") for p in plans] == [1, 1]


def test_too_few_trials_fail_the_job(spark):
    from trialframe.operators.summary import guarded_trials

    rows = spark.createDataFrame([(1, 1, "Left"), (1, 2, "Right"), (1, 3, None), (2, 1, "Left")], "session long, trial long, label string")
    assert {(r["session"], r["trial"]) for r in guarded_trials(rows, 3, 2).collect()} == {(1, 1), (1, 2), (1, 3)}
    for few, least in ((rows, 4), (rows.where("session = 9"), 1)):
        with pytest.raises(Exception, match="too few trials"):
            guarded_trials(few, least, 2).collect()

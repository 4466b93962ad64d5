"""Streaming jobs equal their batch twins (availableNow over the sf0.001 files), restart from
the checkpoint processes nothing twice, and late duplicates are dropped."""
import os
import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarry.streaming import jobs as sj


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_equals_batch(spark, sf):
    qs = entry.queries()
    for stream, batch in [("f_stream_usage", "f_usage_hourly"), ("f_stream_running_rating", "f_running_rating"),
                          ("f_stream_segments", "f_segments")]:
        s, b = qs[stream](spark, sf), qs[batch](spark, sf)
        assert rows(s.select(*sorted(s.columns))) == rows(b.select(*sorted(b.columns))), stream


def test_tables_that_are_folders(spark, tmp_path):
    """A table is one file, or a folder of several."""
    words = F.concat_ws(" ", F.array_repeat(F.lit("word"), 60))
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat_ws("\n", words, F.lit("short"), words).alias("text"))
    docs.repartition(3).write.parquet(str(tmp_path / "folder/documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "part"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "file/documents.parquet")
    for kind in ("folder", "file"):
        got = entry.queries()["f_stream_segments"](spark, str(tmp_path / kind))
        assert rows(got.select("doc_id", "ordinal", "word_count")) == [(d, o, 60) for d in range(40) for o in (0, 2)], kind


def test_restart_from_checkpoint_is_exactly_once(spark, sf):
    src = tempfile.mkdtemp(prefix="quarry-src-")
    ev = spark.read.parquet(f"{sf}/events.parquet")
    ev.filter("event_id % 2 = 0").write.mode("append").parquet(src)
    root = tempfile.mkdtemp(prefix="quarry-stream-")
    def run():
        s = sj.file_stream(spark, src, "*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
        s = s.select("event_id", "ts")
        sj.run_available_now(s, f"{root}/out", f"{root}/ckpt", mode="append")
    run()
    first = spark.read.parquet(f"{root}/out").count()
    run()  # nothing new: the checkpoint remembers the processed files
    assert spark.read.parquet(f"{root}/out").count() == first
    ev.filter("event_id % 2 = 1").write.mode("append").parquet(src)
    run()
    assert spark.read.parquet(f"{root}/out").count() == ev.count()
    assert os.path.isdir(f"{root}/ckpt")


def test_dedup_within_watermark(spark, sf):
    qs = entry.queries()
    d = qs["f_stream_dedup"](spark, sf)
    assert d.count() == d.select("feedback_id").distinct().count() == spark.read.parquet(f"{sf}/events.parquet").count()


def arrive(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_windows_over_batches_with_a_late_row(spark, tmp_path):
    """Three batches: a row within the delay is counted, one behind the watermark is not."""
    from datetime import datetime
    schema = "domain string, ts timestamp, tokens long"
    src, root = str(tmp_path / "src"), str(tmp_path)

    def run():
        s = sj.file_stream(spark, src, "*.parquet")
        sj.run_available_now(sj.stream_usage(s), f"{root}/out", f"{root}/ckpt", mode="update")
    t = lambda h, m: datetime(2024, 1, 1, h, m)
    arrive(spark, src, [("a", t(1, 5), 1), ("a", t(1, 50), 1)], schema)
    run()
    arrive(spark, src, [("a", t(1, 45), 1), ("a", t(5, 0), 1)], schema)       # the first is within the delay
    run()
    arrive(spark, src, [("a", t(1, 55), 100), ("a", t(5, 30), 1)], schema)    # the first is behind the watermark
    run()
    got = rows(sj.latest_state(spark, f"{root}/out", ["domain", "window_start"]))
    assert got == [("a", t(1, 0), 3, 3), ("a", t(5, 0), 2, 2)]


def test_duplicates_across_batches_are_dropped(spark, tmp_path):
    from datetime import datetime
    src, root = str(tmp_path / "src"), str(tmp_path)
    for minute, ids in ((0, [1, 2, 2]), (1, [2, 3]), (2, [1, 4])):
        arrive(spark, src, [(i, datetime(2024, 1, 1, 0, minute)) for i in ids], "feedback_id long, ts timestamp")
        sj.run_available_now(sj.dedup_stream(sj.file_stream(spark, src, "*.parquet")), f"{root}/out", f"{root}/ckpt")
    assert sorted(r.feedback_id for r in spark.read.parquet(f"{root}/out").collect()) == [1, 2, 3, 4]


def test_batches_carry_their_rows_over_batches(spark, tmp_path):
    from datetime import datetime
    src, root = str(tmp_path / "src"), str(tmp_path)
    for n, ids in enumerate(([0, 1], [2, 3, 4], [5, 6])):
        arrive(spark, src, [("a", i, datetime(2024, 1, 1, n, i)) for i in ids] + [("b", 100 + n, datetime(2024, 1, 1, n, 0))],
               "domain string, feedback_id long, ts timestamp")
        sj.run_available_now(sj.stream_batches(sj.file_stream(spark, src, "*.parquet"), 3), f"{root}/out", f"{root}/ckpt")
    got = spark.read.schema("domain string, batch_no long, feedback_id long").parquet(f"{root}/out")
    assert rows(got) == [("a", 0, 0), ("a", 0, 1), ("a", 0, 2), ("a", 1, 3), ("a", 1, 4), ("a", 1, 5), ("b", 0, 100), ("b", 0, 101), ("b", 0, 102)]


def test_open_sessions_stay_in_the_state(spark, tmp_path):
    from datetime import datetime
    src, root = str(tmp_path / "src"), str(tmp_path)
    for h in (0, 1, 10):
        arrive(spark, src, [(7, datetime(2024, 1, 1, h))], "user_id long, ts timestamp")
        sj.run_available_now(sj.stream_sessions(sj.file_stream(spark, src, "*.parquet")), f"{root}/out", f"{root}/ckpt")
    got = spark.read.schema("user_id long, session_start timestamp, session_end timestamp, n long").parquet(f"{root}/out")
    assert rows(got) == [(7, datetime(2024, 1, 1, 0), datetime(2024, 1, 1, 5), 2)]


def test_training_lines_from_arriving_text_files(spark, tmp_path):
    import json
    from quarry.functions.domains import domains_df
    src = tmp_path / "texts"
    src.mkdir()
    for n in range(3):
        (src / f"note_{n}.txt").write_text(("word " * 60 + "\n\nshort\n\n" + f"end{n} " * 50).strip())
    docs = sj.text_stream(spark, str(src), max_files=1)
    lines = sj.stream_training_data(docs, domains_df(spark), "Summarize:", key="file_path", min_words=50)
    sj.run_available_now(lines.select("domain", "value"), f"{tmp_path}/out", f"{tmp_path}/ckpt", fmt="text", partition_by=["domain"])
    got = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert len(got) == 6 and all(g["messages"][0]["role"] == "user" and "Summarize:" in g["messages"][0]["content"] for g in got)
    assert sorted(g["segment_id"].rsplit("_", 1)[1] for g in got) == ["0"] * 3 + ["2"] * 3


def test_session_phases_with_timers(spark, tmp_path):
    """Batches out of order, a late row, two sessions; state goes after four hours without a row."""
    from datetime import datetime, timedelta
    schema = "session_id long, feedback_id long, ts timestamp, mtype string, rating double"
    src, root = str(tmp_path / "src"), str(tmp_path)
    day = datetime(2024, 1, 1)
    queries = []

    def run(rows):
        arrive(spark, src, [(s, i, day + timedelta(minutes=m), k, r) for s, i, m, k, r in rows], schema)
        out = sj.stream_session_phase(sj.file_stream(spark, src, "*.parquet"))
        queries.append(sj.run_available_now(out, f"{root}/out", f"{root}/ckpt"))
        return out
    run([(1, i, 3 * i, "positive", 5.0) for i in range(0, 12, 2)])              # every second row, to minute 30
    run([(1, i, 3 * i, "positive", 5.0) for i in range(1, 12, 2)] + [(2, 100 + i, 40 + i, "negative", None) for i in range(11)])
    run([(2, 200, 130, "negative", None)])                                      # the watermark goes to minute 70
    run([(1, 300, 5, "negative", 1.0), (2, 201, 140, "negative", None)])        # minute 5 is late
    out = run([(3, 400, 24 * 60, "positive", None)])                            # all before is over
    got = {r["feedback_id"]: (r["session_id"], r["feedback_count"], r["phase"]) for r in spark.read.schema(out.schema).parquet(f"{root}/out").collect()}

    def phase(n, last):
        return "initial" if n < 5 else "feedback" if n < 10 else last
    want = {i: (1, i + 1, phase(i + 1, "validation")) for i in range(12)}
    ids = [*range(100, 111), 200, 201]
    want |= {i: (2, n, phase(n, "refinement")) for n, i in enumerate(ids, 1)}
    assert got == want
    state = queries[-1].lastProgress["stateOperators"][0]
    assert state["numRowsTotal"] <= 1       # only the session of the last row can be left
    out = run([(3, 401, 24 * 60 + 30, "positive", None), (4, 500, 72 * 60, "positive", None)])
    assert queries[-1].lastProgress["stateOperators"][0]["numRowsTotal"] <= 1
    rows_3 = spark.read.schema(out.schema).parquet(f"{root}/out").filter("session_id = 3").collect()
    assert {(r["feedback_id"], r["feedback_count"]) for r in rows_3} == {(400, 1), (401, 2)}
    run([(3, 402, 80 * 60, "positive", None), (4, 501, 90 * 60, "positive", None)])
    run([(5, 600, 200 * 60, "positive", None)])
    again = {r["feedback_id"]: r["feedback_count"] for r in spark.read.schema(out.schema).parquet(f"{root}/out").collect()}
    assert again[402] == 1 and again[501] == 1      # a session that timed out begins anew

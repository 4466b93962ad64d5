"""Streaming queries (T1–T6, T8–T10): each runs its Structured Streaming job with trigger
availableNow over the driver's parquet files and returns the final result, which must equal
the batch twin (same oracle SQL)."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.domains import domains_df
from quarry.functions.lexicons import FILENAME_DOMAIN_PATTERNS, TEST_LEXICON
from quarry.plans.catalog import ORACLE, query
from quarry.plans.document_queries import _strip_sql, _summary_domains_sql, _summary_sql
from quarry.sources.views import _WS, conversation_pairs, feedback_columns, feedback_view, mentor_view, table, with_views
from quarry.streaming import jobs as sj


def _table_stream(spark, sf, name):
    return sj.table_stream(spark, f"{sf.rstrip('/')}/{name}.parquet")


def feedback_stream(spark, sf):
    """feedback_v as a stream: events arrive as files; the conversation pairs are a static
    table (stream–static join)."""
    pairs = conversation_pairs(spark, sf)  # static side, a written table
    n = pairs.count()  # one scalar: the modulus of the fixture's pair assignment
    ev = _table_stream(spark, sf, "events")
    return feedback_columns(ev, pairs, F.lit(n))


def _events_stream(spark, sf):
    return _table_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _run_update(spark, df, keys, mode="update"):
    root = sj.stream_root(spark)
    sj.run_available_now(df, f"{root}/out", f"{root}/ckpt", mode=mode)
    return sj.latest_state(spark, f"{root}/out", keys)


def _run_append(spark, df):
    root = sj.stream_root(spark)
    sj.run_available_now(df, f"{root}/out", f"{root}/ckpt", mode="append")
    return spark.read.schema(df.schema).parquet(f"{root}/out")


def _arriving(spark, df, batches):
    """`df` as a stream over `batches` micro-batches: written by Spark as files, of which a batch reads as many
    as `df` has partitions, or the cluster cores, so that batches run in parallel at any size."""
    folder = f"{sj.stream_root(spark)}/arriving"
    per_batch = max(2, df.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    df.repartition(batches * per_batch).write.parquet(folder)
    return sj.file_stream(spark, folder, "*.parquet", max_files=per_batch)


def _run_in_parts(spark, df, job, parts):
    """Append-mode result of `job` while the rows of `df` arrive in `parts` parts, in the order of
    `ts`; the job stops after each part and goes on from its checkpoint."""
    root = sj.stream_root(spark)
    at = F.unix_micros("ts")
    cuts = df.select(at.cast("double").alias("t")).approxQuantile("t", [i / parts for i in range(1, parts)], 0.01)
    edges = [None, *sorted(set(cuts)), None]
    out = None
    for lo, hi in zip(edges, edges[1:]):
        part = df if lo is None else df.filter(at > lo)
        (part if hi is None else part.filter(at <= hi)).write.mode("append").parquet(f"{root}/arriving")
        out = job(sj.file_stream(spark, f"{root}/arriving", "*.parquet"))
        sj.run_available_now(out, f"{root}/out", f"{root}/ckpt")
    return spark.read.schema(out.schema).parquet(f"{root}/out")


@query("f_stream_alerts", ORACLE["f_alerts"])
def f_stream_alerts(spark, sf):
    a = _run_update(spark, sj.stream_alerts(feedback_stream(spark, sf), max_corrections=1), ["domain", "window_start"])
    return a.select("domain", "window_start", "critical_count", F.round("avg_rating", 6).alias("avg_rating"),
                    "corrections", "n", "critical_alert", "rating_drop_alert", "correction_alert")


@query("f_stream_usage", ORACLE["f_usage_hourly"])
def f_stream_usage(spark, sf):
    ev = _events_stream(spark, sf)
    dom = (F.when(F.col("user_id") % 4 == 0, "technical").when(F.col("user_id") % 4 == 1, "medical")
           .when(F.col("user_id") % 4 == 2, "legal").otherwise("financial"))
    req = ev.select(dom.alias("domain"), "ts", F.floor("value").cast("long").alias("tokens"))
    return _run_update(spark, sj.stream_usage(req), ["domain", "window_start"]) \
        .select("domain", "window_start", "requests", "tokens")


@query("f_stream_sessions", f"""
SELECT * FROM ({ORACLE["f_sessions"]}) WHERE session_end <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def f_stream_sessions(spark, sf):
    """The sessions that the watermark has closed, from events that arrive in several batches."""
    ev = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "ts")
    return _run_in_parts(spark, ev, sj.stream_sessions, 4)


@query("f_stream_session_phase", with_views("""
WITH m AS (SELECT feedback_id, session_id, ts,
    CASE mtype WHEN 'positive' THEN 1.0 WHEN 'negative' THEN 0.5 WHEN 'correction' THEN 0.8 ELSE 0.6 END AS wt,
    CASE mtype WHEN 'positive' THEN 1.0 WHEN 'negative' THEN 0.0 WHEN 'correction' THEN 0.7 ELSE 0.8 END AS sc, rating FROM mentor_v),
g AS (SELECT *, CASE WHEN rating IS NULL THEN sc ELSE (sc + rating / 5.0) / 2.0 END AS score,
    CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 4 HOUR THEN 1 ELSE 0 END AS opens
  FROM m WINDOW w AS (PARTITION BY session_id ORDER BY ts, feedback_id)),
r AS (SELECT *, sum(opens) OVER (PARTITION BY session_id ORDER BY ts, feedback_id ROWS UNBOUNDED PRECEDING) AS run FROM g),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id, run ORDER BY ts, feedback_id) AS feedback_count,
    min(ts) OVER (PARTITION BY session_id, run) AS session_start FROM r),
d AS (SELECT session_id, run, sum(wt * score) / sum(wt) AS decision FROM n WHERE feedback_count <= 10 GROUP BY ALL)
SELECT feedback_id, n.session_id, session_start, feedback_count,
  CASE WHEN feedback_count < 5 THEN 'initial' WHEN feedback_count < 10 THEN 'feedback' WHEN decision >= 0.7 THEN 'validation'
       ELSE 'refinement' END AS phase
FROM n JOIN d USING (session_id, run) WHERE ts <= (SELECT date_trunc('millisecond', max(ts)) FROM m) - INTERVAL 1 HOUR""", "mentor_v"))
def f_stream_session_phase(spark, sf):
    """Phases of all rows that the watermark has passed, from feedback that arrives in several batches."""
    rows = mentor_view(spark, sf).select("session_id", "feedback_id", "ts", "mtype", "rating")
    out = _run_in_parts(spark, rows, sj.stream_session_phase, 4)
    return out.select("feedback_id", "session_id", "session_start", "feedback_count", "phase")


@query("f_stream_running_rating", ORACLE["f_running_rating"])
def f_stream_running_rating(spark, sf):
    r = _run_update(spark, sj.stream_running_rating(feedback_stream(spark, sf)), ["domain"])
    return r.select("domain", "feedback_count", F.round("average_rating", 6).alias("average_rating"))


@query("f_stream_critical", with_views("""
SELECT feedback_id, domain, true AS processed FROM feedback_x WHERE severity = 'critical'""", "feedback_x"))
def f_stream_critical(spark, sf):
    c = _run_append(spark, sj.stream_critical(feedback_stream(spark, sf)).select("feedback_id", "domain", "processed"))
    return c


@query("f_stream_dedup", with_views("SELECT feedback_id, domain FROM feedback_v", "feedback_v"))
def f_stream_dedup(spark, sf):
    fb = feedback_stream(spark, sf).select("feedback_id", "domain", "ts")
    twice = fb.unionByName(feedback_stream(spark, sf).select("feedback_id", "domain", "ts"))
    d = _run_append(spark, sj.dedup_stream(twice, "feedback_id", "10 minutes"))
    return d.select("feedback_id", "domain")


@query("f_stream_batches", with_views("""
SELECT domain, unnest(range(CAST(cnt // 10 AS BIGINT))) AS batch_no, CAST(10 AS BIGINT) AS fired_items
FROM (SELECT domain, count(*) AS cnt FROM feedback_v WHERE NOT processed GROUP BY domain)""", "feedback_v"))
def f_stream_batches(spark, sf):
    """Feedback arrives in several batches; queues carry over between them."""
    pend = feedback_view(spark, sf).filter(~F.col("processed")).select("domain", "feedback_id", "ts")
    b = _run_in_parts(spark, pend, lambda s: sj.stream_batches(s, 10, "domain"), 3)
    return b.groupBy("domain", "batch_no").agg(F.count_distinct("feedback_id").alias("fired_items"))


@query("f_stream_feedback_triggers", with_views("""
SELECT domain, ws AS window_start, round(avg(rating), 6) AS avg_rating, count(*) AS total_feedback,
  coalesce(avg(rating), 0.0) < 2.97 AND count(*) >= 50 AS triggered
FROM (SELECT domain, rating, date_trunc('day', ts) - to_days(CAST(k AS INTEGER)) AS ws
      FROM feedback_v CROSS JOIN range(7) t(k))
GROUP BY domain, ws""", "feedback_v"))
def f_stream_feedback_triggers(spark, sf):
    t = _run_update(spark, sj.stream_feedback_triggers(feedback_stream(spark, sf), max_avg=2.97, min_count=50),
                    ["domain", "window_start"])
    return t.select("domain", "window_start", F.round("avg_rating", 6).alias("avg_rating"), "total_feedback",
                    "triggered")


@query("f_stream_segments", ORACLE["f_segments"])
def f_stream_segments(spark, sf):
    docs = _table_stream(spark, sf, "documents")
    s = sj.stream_segments(docs, "doc_id", "text", base=F.concat(F.lit("doc"), F.col("doc_id").cast("string")),
                           separator="\n", min_words=50)
    return _run_append(spark, s.select("segment_id", "doc_id", "ordinal", "word_count"))


_STREAM_INSTRUCTION = "Summarize the following text:"


@query("f_stream_training_data", f"""
WITH det AS (SELECT doc_id, domain FROM ({ORACLE["f_detect_domain"]})),
paras AS (SELECT doc_id, [y for y in [{_strip_sql('x')} for x in string_split(text, chr(10))] if y <> ''] AS ps FROM documents),
seg AS (SELECT doc_id, unnest(ps) AS body, unnest(range(len(ps))) AS ordinal FROM paras)
SELECT 'doc' || doc_id || '_segment_' || ordinal AS segment_id, det.domain, md5({_summary_sql(f"'{_STREAM_INSTRUCTION}'")}) AS prompt_md5,
  md5(body) AS answer_md5
FROM seg JOIN det USING (doc_id) JOIN {_summary_domains_sql()} ON dom.domain = det.domain
WHERE len([w for w in regexp_split_to_array(body, '{_WS}') if w <> '']) >= 50""")
def f_stream_training_data(spark, sf):
    """T1 end to end: documents arrive in three micro-batches; the JSONL lines are read back."""
    docs = _arriving(spark, table(spark, sf, "documents").select("doc_id", "text", "source"), 3)
    lines = sj.stream_training_data(docs, domains_df(spark), _STREAM_INSTRUCTION, "doc_id", "text", "source",
                                    base=F.concat(F.lit("doc"), F.col("doc_id").cast("string")), separator="\n",
                                    min_words=50, content_terms=TEST_LEXICON, filename_patterns=FILENAME_DOMAIN_PATTERNS)
    root = sj.stream_root(spark)
    sj.run_available_now(lines.select("domain", "value"), f"{root}/out", f"{root}/ckpt", fmt="text", partition_by=["domain"])
    schema = "segment_id string, domain string, messages array<struct<role:string,content:string>>"
    back = spark.read.schema("value string, domain string").text(f"{root}/out").select(F.from_json("value", schema).alias("x"))
    return back.select("x.segment_id", "x.domain", F.md5(F.col("x.messages")[0]["content"].cast("binary")).alias("prompt_md5"),
                       F.md5(F.col("x.messages")[1]["content"].cast("binary")).alias("answer_md5"))


@query("f_stream_performance_decline", ORACLE["f_performance_decline"])
def f_stream_performance_decline(spark, sf):
    """The daily history (derived from events by Spark) arrives as files; the keyed state
    keeps the last 10 scores per domain; the final state equals the batch W3."""
    from quarry.plans.registry_queries import history_view
    root = sj.stream_root(spark)
    history_view(spark, sf).write.mode("overwrite").parquet(f"{root}/history")
    src = sj.file_stream(spark, f"{root}/history", "*.parquet")
    out = _run_update(spark, sj.stream_performance_decline(src, flag=0.0005, trigger=0.005), ["domain"])
    return out.select("domain", F.round("decline", 6).alias("decline"), "declining", "triggered")

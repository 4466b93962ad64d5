"""Structured Streaming forms of the event-driven behaviours.

Every job is a function from a streaming DataFrame to a streaming DataFrame that reuses the
batch operator's expressions; `run_available_now` drives it to completion (trigger
availableNow) with a checkpoint in the cluster's shared checkpoint folder, so a restarted
job resumes exactly where it stopped. Stateful results (aggregates) are emitted in update
mode through `foreachBatch`, each micro-batch written to its own `_batch=<id>` folder with
overwrite (idempotent on retry), and `latest_state` reads the final value per key.
"""
from __future__ import annotations

import os
import uuid
from typing import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from quarry.operators import documents as do
from quarry.operators import feedback as fo
from quarry.operators import mentor as mo
from quarry.operators import training as tr
from quarry.session import ensure_checkpoint_dir


def stream_root(spark: SparkSession) -> str:
    """A fresh folder for one run under the cluster's checkpoint folder (shared storage)."""
    return os.path.join(ensure_checkpoint_dir(spark), "streams", uuid.uuid4().hex)


def file_stream(spark: SparkSession, folder: str, pattern: str = "*", fmt: str = "parquet",
                max_files: int | None = None) -> DataFrame:
    """A file-source stream over the files of `folder` matching `pattern`, with the schema taken
    from the existing files."""
    schema = spark.read.format(fmt).option("pathGlobFilter", pattern).load(folder).schema
    r = spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", pattern)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(folder)


def table_stream(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A file-source stream over a table that is one file or a folder of files, with its schema. The path
    goes to the source as a glob that only it matches, as a plain path has to be a folder there."""
    path = path.rstrip("/")
    schema = spark.read.format(fmt).load(path).schema
    return spark.readStream.format(fmt).schema(schema).load(f"{path[:-1]}[{path[-1]}]")


def text_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """T1/S21 source: one row per arriving file (whole text) with its path; `max_files` in a
    micro-batch."""
    return (spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", max_files).load(path)
            .select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file_path")))


def run_available_now(df: DataFrame, out: str, checkpoint: str, mode: str = "append", fmt: str = "parquet",
                      partition_by: Sequence[str] = ()):
    """Run a streaming DataFrame until the currently available input is processed.
    Append mode writes with the file sink (exactly once through its commit log); update
    mode goes through `foreachBatch`, one overwrite-folder per batch id."""
    w = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        q = w.format(fmt).outputMode("append").partitionBy(*partition_by).start(out)
    else:
        def sink(batch: DataFrame, batch_id: int):
            batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/_batch={batch_id}")
        q = w.outputMode(mode).foreachBatch(sink).start()
    q.awaitTermination()
    return q


def latest_state(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """The last emitted value of every key of an update-mode result (max batch id wins)."""
    d = spark.read.parquet(out)
    payload = [c for c in d.columns if c not in (*keys, "_batch")]
    return (d.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.col("_batch")).alias("_v"))
            .select(*keys, "_v.*"))


# ----------------------------------------------------------------------------- T2, T3, T5, T6, T9, T10
def stream_critical(fb: DataFrame) -> DataFrame:
    """Critical feedback as it arrives, marked processed."""
    return fb.withColumn("severity", fo.severity()).filter(F.col("severity") == "critical") \
        .withColumn("processed", F.lit(True))


def stream_alerts(fb: DataFrame, window: str = "1 hour", slide: str | None = None, delay: str = "10 minutes",
                  max_avg: float = 2.0, max_corrections: int = 10) -> DataFrame:
    """Per domain and event-time window (tumbling, or sliding with `slide`): critical
    count, average rating, corrections and the alert flags; late rows beyond `delay` dropped."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    g = (fb.withWatermark("ts", delay).withColumn("severity", fo.severity())
         .groupBy("domain", w.alias("w")).agg(
             F.count_if(F.col("severity") == "critical").alias("critical_count"),
             F.avg("rating").alias("avg_rating"),
             F.count_if(F.col("feedback_type") == "correction").alias("corrections"),
             F.count(F.lit(1)).alias("n")))
    return g.select("domain", F.col("w.start").alias("window_start"), "critical_count", "avg_rating",
                    "corrections", "n", (F.col("critical_count") > 0).alias("critical_alert"),
                    F.coalesce(F.col("avg_rating") < max_avg, F.lit(False)).alias("rating_drop_alert"),
                    (F.col("corrections") > max_corrections).alias("correction_alert"))


def stream_feedback_triggers(fb: DataFrame, days: int = 7, slide_days: int = 1, delay: str = "1 day",
                             max_avg: float = 3.0, min_count: int = 50) -> DataFrame:
    """T5: sliding `days`-day windows (1-day slide) per domain: average rating, count, trigger."""
    g = (fb.withWatermark("ts", delay)
         .groupBy("domain", F.window("ts", f"{days} days", f"{slide_days} days").alias("w"))
         .agg(F.avg("rating").alias("avg_rating"), F.count(F.lit(1)).alias("total_feedback")))
    return g.select("domain", F.col("w.start").alias("window_start"), "avg_rating", "total_feedback",
                    ((F.coalesce("avg_rating", F.lit(0.0)) < max_avg) & (F.col("total_feedback") >= min_count))
                    .alias("triggered"))


def stream_running_rating(fb: DataFrame) -> DataFrame:
    """Running count and average rating per domain (update mode)."""
    return fb.filter(F.col("rating").isNotNull()).groupBy("domain").agg(
        F.count(F.lit(1)).alias("feedback_count"), F.avg("rating").alias("average_rating"))


def stream_usage(requests: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Requests and tokens per domain and tumbling window."""
    g = (requests.withWatermark("ts", delay).groupBy("domain", F.window("ts", window).alias("w"))
         .agg(F.count(F.lit(1)).alias("requests"), F.sum(F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens")))
    return g.select("domain", F.col("w.start").alias("window_start"), "requests", "tokens")


def stream_sessions(events: DataFrame, gap: str = "4 hours", key: str = "user_id", delay: str = "1 hour") -> DataFrame:
    """Activity sessions per key with an inactivity gap (session windows). Run in append
    mode: a session is written once it is closed, i.e. ends before the watermark, and leaves
    the state."""
    g = (events.withWatermark("ts", delay).groupBy(key, F.session_window("ts", gap).alias("s"))
         .agg(F.count(F.lit(1)).alias("n")))
    return g.select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def dedup_stream(fb: DataFrame, key: str = "feedback_id", delay: str = "10 minutes") -> DataFrame:
    """Duplicates of `key` within the watermark delay dropped; rows later than the
    watermark are dropped as late data."""
    return fb.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


# ----------------------------------------------------------------------------- T4 (keyed state)
def stream_batches(fb: DataFrame, size: int = 10, key: str = "domain", item: str = "feedback_id") -> DataFrame:
    """T4: a queue per key; each time `size` items are waiting a batch fires (once per `size`
    items, the evident intent) with the ids of its items, oldest first within what arrived
    together. Keyed state in `applyInPandasWithState`: the ids still queued (fewer than
    `size`) and the number of batches fired so far."""
    out_schema = f"{key} string, batch_no long, {item} long"
    state_schema = "queued array<long>, fired long"

    def fire(k, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        queued, fired = state.get if state.exists else ([], 0)
        queued, fired = list(queued), int(fired)
        for pdf in pdfs:
            queued += [int(x) for x in pdf.sort_values(["ts", item])[item]]
            full = len(queued) // size * size
            if full:
                yield pd.DataFrame({key: k[0], "batch_no": [fired + i // size for i in range(full)], item: queued[:full]})
                queued, fired = queued[full:], fired + full // size
        state.update((queued, fired))

    return (fb.select(key, item, "ts").groupBy(key)
            .applyInPandasWithState(fire, out_schema, state_schema, "append", GroupStateTimeout.NoTimeout))


# ----------------------------------------------------------------------------- T8 (keyed state, event-time timers)
SESSION_BUCKETS = 512


def stream_session_phase(mfb: DataFrame, gap: str = "4 hours", delay: str = "1 hour", buckets: int = SESSION_BUCKETS) -> DataFrame:
    """Phase and feedback count of mentor sessions as feedback arrives (session_id, feedback_id, ts,
    mtype, rating). A row is judged once the watermark has passed it, in the order (ts, feedback_id), so
    rows that come out of order within `delay` get the values of the batch rule (W7); later ones are
    dropped as late. A session ends when `gap` passes without a row: what comes then begins a new
    one, from `initial`. Append mode; columns session_id, feedback_id, ts, session_start, feedback_count,
    phase.

    Sessions share keyed state in `buckets` hash buckets (those without an id have one of their own), as a call for
    each session costs more than its rows. It is fixed for a checkpoint; take more for more rows in a batch. State of a
    bucket: the rows that wait, and of each open session the count and the weighted sums of its first rows. An
    event-time timer stands at the oldest waiting row or the first end of a session, whichever is next;
    what has ended leaves the state, and an empty bucket is removed."""
    gap_us = int(pd.Timedelta(gap).total_seconds() * 1e6)
    weight, weighted = mo.weighted_parts()
    session = F.col("session_id").cast("long")
    bucket = F.when(session.isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(session), F.lit(buckets)).cast("int"))
    rows = mfb.filter(F.col("ts").isNotNull()).select(
        bucket.alias("_bucket"), F.coalesce(session, F.lit(0)).alias("_s"), "feedback_id", "ts", F.unix_micros("ts").alias("_us"),
        weight.alias("_w"), weighted.alias("_ws")).withWatermark("ts", delay)
    out_schema = "session_id long, feedback_id long, ts_us long, start_us long, feedback_count long, phase string"
    state_schema = ("s array<long>, us array<long>, ids array<long>, w array<double>, ws array<double>, of array<long>, "
                    "start array<long>, last array<long>, count array<long>, sum_w array<double>, sum_ws array<double>")

    def step(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = [list(x) for x in state.get] if state.exists else [[] for _ in range(11)]
        waiting, sessions = list(zip(*kept[:5])), {s: (b, *v) for s, b, *v in zip(*kept[5:])}
        for pdf in pdfs:
            waiting += zip(*(pdf[c].tolist() for c in ("_s", "_us", "feedback_id", "_w", "_ws")))
        waiting.sort(key=lambda x: x[1:])
        mark = state.getCurrentWatermarkMs()
        out, done = [], 0
        for s, t, i, a, b in waiting:
            if t > mark * 1000:
                break
            start, last, count, sum_w, sum_ws = sessions.get(s, (t, t, 0, 0.0, 0.0))
            if t - last >= gap_us:
                start, count, sum_w, sum_ws = t, 0, 0.0, 0.0
            count, done = count + 1, done + 1
            if count <= mo.PHASE_DECIDE_AT:
                sum_w, sum_ws = sum_w + a, sum_ws + b
            sessions[s] = start, t, count, sum_w, sum_ws
            score = sum_ws / sum_w if sum_w > 0 else 0.0
            phase = ("initial" if count < mo.PHASE_FEEDBACK_AT else "feedback" if count < mo.PHASE_DECIDE_AT
                     else "validation" if score >= mo.VALIDATION_SCORE else "refinement")
            out.append((s, i, t, start, count, phase))
        waiting = waiting[done:]
        sessions = {s: v for s, v in sessions.items() if v[1] + gap_us > mark * 1000}
        wake = min([v[1] + gap_us for v in sessions.values()] + [x[1] for x in waiting[:1]], default=None)
        if wake is None:
            state.remove()
        else:
            columns = [list(x) for x in zip(*waiting)] or [[] for _ in range(5)]
            columns += [list(x) for x in zip(*((s, *v) for s, v in sessions.items()))] or [[] for _ in range(6)]
            state.update(tuple(columns))
            state.setTimeoutTimestamp(max(mark + 1, wake // 1000 - 1))
        if out:
            found = pd.DataFrame(out, columns=["session_id", "feedback_id", "ts_us", "start_us", "feedback_count", "phase"])
            yield found.assign(session_id=None) if key[0] < 0 else found

    found = rows.groupBy("_bucket").applyInPandasWithState(step, out_schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("session_id", "feedback_id", F.timestamp_micros("ts_us").alias("ts"),
                        F.timestamp_micros("start_us").alias("session_start"), "feedback_count", "phase")


# ----------------------------------------------------------------------------- T1
def stream_segments(docs: DataFrame, key: str = "doc_id", text: str = "text", base=None,
                    separator: str = "\n\n", min_words: int = 50) -> DataFrame:
    """Documents as they arrive → segments (stateless; the same expressions as W13)."""
    return do.segments(docs, key, text, base, separator, min_words)


def stream_training_data(docs: DataFrame, domains: DataFrame, instruction: str, key: str = "doc_id", text: str = "text",
                         name: str = "file_path", base=None, separator: str = "\n\n", min_words: int = 50, **detect) -> DataFrame:
    """T1 from arrival to training lines: each document gets its domain, its segments a prompt in
    the domain's context and the segment as answer; one JSON object per example. Stateless but
    for the static domain dimension. Columns: segment_id, domain, value (the JSONL line)."""
    found = do.detect_domain(docs, text, name, **detect)
    s = do.segments(found, key, text, base, separator, min_words, keep=["domain"])
    s = s.join(domains, "domain", "left")
    messages = tr.to_messages(None, do.summarization_prompt(F.lit(instruction)), F.col("original_text"))
    lines = tr.jsonl_lines(s.withColumn("messages", messages), ["segment_id", "domain", "messages"])
    return lines.select("segment_id", "domain", "value")


# ----------------------------------------------------------------------------- T7 (keyed state)
def stream_performance_decline(history: DataFrame, score: str = "overall_score", order: str = "day",
                               keep: int = 10, flag: float = 0.05, trigger: float = 0.1) -> DataFrame:
    """Per domain, keyed state holding the last `keep` scores (in `order` order); after each
    micro-batch the decline of the last 5 against the 5 before (W3 rules: empty older window →
    0, fewer than 2 points → 0) is emitted with the trend flag and the trigger. State stays
    bounded (10 scores per domain)."""
    out_schema = "domain string, points long, decline double, declining boolean, triggered boolean"
    state_schema = "orders array<string>, scores array<double>, points long"

    def step(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            orders, scores, points = state.get
            hist = list(zip(list(orders), list(scores)))
        else:
            hist, points = [], 0
        for pdf in pdfs:
            hist += list(zip(pdf[order].astype(str), pdf[score].astype(float)))
            points += len(pdf)
        hist = sorted(hist)[-keep:]
        vals = [v for _, v in hist]
        if points < 2:
            decline = 0.0
        else:
            recent = vals[-5:]
            older = vals[-10:-5]
            decline = max(0.0, sum(older) / max(1, len(older)) - sum(recent) / len(recent))
        state.update(([o for o, _ in hist], vals, points))
        yield pd.DataFrame([(key[0], points, decline, decline > flag, decline > trigger)],
                           columns=["domain", "points", "decline", "declining", "triggered"])

    return (history.select("domain", F.col(order).cast("string").alias(order), score).groupBy("domain")
            .applyInPandasWithState(step, out_schema, state_schema, "update", GroupStateTimeout.NoTimeout))

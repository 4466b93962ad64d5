"""Feedback operators (SURVEY §2.1 S22, §2.2 P-2…P-5, §2.4 A5–A12, A21, A22, A26, §2.6 L4,
§2.8 F18, F21, §2.9 T3/T5 batch forms).

Input is a feedback table of schema M6 (`feedback_v`): feedback_id, ts, domain, model_id,
feedback_type, rating, user_input, model_output, correction, user_comment,
expected_output, user_id, session_id, processed. Arrival order is (ts, feedback_id).
"Now" is always the `as_of` argument (P15).
"""
from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions.lexicons import FEEDBACK_CONCEPTS
from quarry.plans.ordinal import running_sum, with_ordinal
from quarry.plans.tables import written
from quarry.plans.topk import ranked_list, top_k_rows, top_terms

ARRIVAL = ["ts", "feedback_id"]
FEEDBACK_TYPES = ["rating", "correction", "suggestion", "complaint", "praise", "clarification"]
SEVERITIES = ["low", "medium", "high", "critical"]


def _ts(x) -> Column:
    return F.lit(x).cast("timestamp") if isinstance(x, str) else x


def _nonempty(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def _rating_truthy(c: Column) -> Column:
    return c.isNotNull() & (c != 0)


# --------------------------------------------------------------------------- scalars
def severity(rating="rating", feedback_type="feedback_type", correction="correction") -> Column:
    """P-4: order matters; `correction` is tested for non-null, not for emptiness."""
    r, t, c = F.col(rating), F.col(feedback_type), F.col(correction)
    return (F.when(r.isNotNull() & (r <= 1.0), "critical")
            .when(t == "complaint", "high")
            .when(c.isNotNull(), "medium")
            .when(r.isNotNull() & (r <= 2.0), "high")
            .otherwise("low"))


def example_quality(rating="rating", correction="correction", user_input="user_input") -> Column:
    """rating or 3.0; +1 with a correction (max 5); -0.5 when input < 20 chars (min 1)."""
    r = F.col(rating)
    base = F.when(_rating_truthy(r), r).otherwise(F.lit(3.0))
    boosted = F.when(_nonempty(F.col(correction)), F.least(F.lit(5.0), base + 1.0)).otherwise(base)
    return F.when(F.length(F.col(user_input)) < 20, F.greatest(F.lit(1.0), boosted - 0.5)) \
        .otherwise(boosted)


# --------------------------------------------------------------------------- ingest
def ingest_feedback(raw: DataFrame, lexicon: Mapping[str, Sequence[str]] = FEEDBACK_CONCEPTS) -> DataFrame:
    """Derive severity, keywords (F2), concepts (F3), session default and `processed`
    (true exactly when critical) for new feedback rows. Narrow: one pass, no shuffle."""
    return (_with_features(raw.drop("severity", "keywords", "concepts"), lexicon)
            .withColumn("session_id", F.coalesce(F.col("session_id").cast("string"),
                                                 F.col("feedback_id").cast("string")))
            .withColumn("processed", F.col("severity") == "critical"))


# --------------------------------------------------------------------------- filters
def feedback_window(fb: DataFrame, as_of, days: int, model_id: str | None = None) -> DataFrame:
    """P-2: rows with ts >= as_of - days (optionally one model)."""
    out = fb.filter(F.col("ts") >= _ts(as_of) - F.make_dt_interval(F.lit(days)))
    return out if model_id is None else out.filter(F.col("model_id") == model_id)


def recent_feedback(fb: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """P-3: rows with ts >= as_of - hours."""
    return fb.filter(F.col("ts") >= _ts(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours)))


def pending(fb: DataFrame) -> DataFrame:
    """P-5: unprocessed rows."""
    return fb.filter(~F.col("processed"))


# --------------------------------------------------------------------------- trend
def trend(df: DataFrame, value: str, order_by: Sequence[str], group_by: Sequence[str],
          out: str = "trend") -> DataFrame:
    """Least-squares slope of `value` over its 0-based position in `order_by` order,
    per group; fewer than 2 values → 0.0. Positions come from the distributed ordinal, the
    slope from the mergeable `regr_slope` aggregate."""
    pos = with_ordinal(df.select(*group_by, *order_by, value), order_by, group_by, name="_x")
    return (pos.groupBy(*group_by)
            .agg(F.coalesce(F.when(F.count(value) >= 2, F.regr_slope(F.col(value), F.col("_x").cast("double"))),
                            F.lit(0.0)).alias(out)))


# --------------------------------------------------------------------------- analysis
def _with_features(fb: DataFrame, lexicon) -> DataFrame:
    """Severity, F2 keywords and F3 concepts. The lower-cased joined text is one column that
    both extractors read, so it is built once per row."""
    cols = fb.columns
    out = fb
    if "severity" not in cols:
        out = out.withColumn("severity", severity())
    texts = ["user_input", "model_output", "user_comment", "correction"]
    need_kw, need_c = "keywords" not in cols, "concepts" not in cols
    if need_kw and need_c:
        out = (out.withColumn("_fb_low", tx._joined_lower(texts))
               .withColumn("_fb_feat", tx.feedback_features("_fb_low", lexicon))
               .withColumn("keywords", F.col("_fb_feat.keywords"))
               .withColumn("concepts", F.col("_fb_feat.concepts")).drop("_fb_low", "_fb_feat"))
    elif need_kw:
        out = out.withColumn("keywords", tx.feedback_keywords(*texts))
    elif need_c:
        out = out.withColumn("concepts", tx.feedback_concepts(*texts, lexicon=lexicon))
    return out


def top_issues(fb: DataFrame, group_by: Sequence[str] = ("domain",), n: int = 10,
               lexicon=FEEDBACK_CONCEPTS) -> DataFrame:
    """A5 top issues: keywords of high/critical rows, top n by count, first occurrence ties."""
    f = _with_features(fb, lexicon).filter(F.col("severity").isin("high", "critical"))
    return top_terms(f, list(group_by), F.col("keywords"), ARRIVAL, n, term_col="keyword") \
        .withColumnRenamed("count", "frequency")


def type_distribution(fb: DataFrame, group_by: Sequence[str] = ("domain",)) -> DataFrame:
    """A5 distribution: rows per feedback type."""
    return fb.groupBy(*group_by, "feedback_type").agg(F.count(F.lit(1)).alias("n"))


def _suggested(base: DataFrame, f: DataFrame, group_by: Sequence[str], low_share: float, min_corrections: int) -> DataFrame:
    """A7 from the counts `_n`, `_low`, `_corr` of each group and the rows' concepts."""
    top_concept = top_terms(f, list(group_by), F.col("concepts"), ARRIVAL, 1, term_col="_concept") \
        .select(*group_by, "_concept")
    j = base.join(top_concept, list(group_by), "left")
    arr = F.array_compact(F.array(
        F.when(F.col("_low") > F.col("_n") * F.lit(low_share),
               F.lit("Consider retraining the model with higher quality examples")),
        F.when(F.col("_corr") > min_corrections,
               F.lit("Multiple corrections indicate need for targeted training data")),
        F.when(F.col("_concept").isNotNull(),
               F.concat(F.lit("Focus on improving responses related to "), F.col("_concept")))))
    return j.select(*group_by, F.slice(arr, 1, 5).alias("suggestions"))


def _is_low() -> Column:
    return _rating_truthy(F.col("rating")) & (F.col("rating") <= 2.0)


def suggestions(fb: DataFrame, group_by: Sequence[str] = ("domain",), low_share: float = 0.3,
                min_corrections: int = 10, lexicon=FEEDBACK_CONCEPTS) -> DataFrame:
    """Improvement suggestions per group, at most 5, as an array in rule order."""
    f = _with_features(fb, lexicon)
    base = f.groupBy(*group_by).agg(F.count(F.lit(1)).alias("_n"), F.count_if(_is_low()).alias("_low"),
                                    F.count_if(_nonempty(F.col("correction"))).alias("_corr"))
    return _suggested(base, f, group_by, low_share, min_corrections)


def feature_table(fb: DataFrame, lexicon=FEEDBACK_CONCEPTS) -> DataFrame:
    """The narrow columns that analyses read (no texts but corrections as a flag), with severity, F2 keywords and
    F3 concepts: written once, so several analyses cost one pass over the texts. The pass runs
    where the rows are read, before any shuffle."""
    f = _with_features(fb, lexicon)
    return written(f.select("domain", *ARRIVAL, "model_id", "rating", "feedback_type", "severity", "keywords", "concepts",
                            _nonempty(F.col("correction")).alias("corrected")), "feedback-features")


def analyze_feedback(fb: DataFrame, as_of, days: int = 30, model_id: str | None = None,
                     domains: DataFrame | None = None, lexicon=FEEDBACK_CONCEPTS,
                     low_share: float = 0.3, min_corrections: int = 10, issues: DataFrame | None = None) -> DataFrame:
    """A5: one row per domain: total, avg rating, rating trend, volume trend (slope of the daily
    counts over the days with feedback), confidence, critical areas (top 5 issue keywords), top
    issue keywords (top 10), suggestions, type distribution. Domains of `domains` without feedback
    get the zero row. `fb` is feedback, or a `feature_table` of it, which is made here otherwise; `issues`
    are the window's `top_issues`, if there are some already."""
    f = feedback_window(fb, as_of, days, model_id)
    f = f if "corrected" in f.columns else feature_table(f, lexicon)
    g = ["domain"]
    # totals come from one aggregate per (domain, type), the trend of volume from one per (domain, day)
    per = f.groupBy(*g, "feedback_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("rating").alias("_sum"), F.count("rating").alias("_rated"),
        F.count_if(_is_low()).alias("_low"), F.count_if("corrected").alias("_corr"))
    flat = per.groupBy(*g).agg(
        F.sum("n").alias("total_feedback"), F.coalesce(F.sum("_sum") / F.sum("_rated"), F.lit(0.0)).alias("avg_rating"),
        F.sum("n").alias("_n"), F.sum("_low").alias("_low"), F.sum("_corr").alias("_corr"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("feedback_type", "n")))).alias("feedback_distribution"))
    daily = f.groupBy(*g, F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    days_ = daily.withColumn("_x", F.row_number().over(Window.partitionBy(*g).orderBy("day")).cast("double"))    # a row a day
    volume = days_.groupBy(*g).agg(F.when(F.count("n") >= 2, F.regr_slope("n", "_x")).alias("volume_trend"))
    tr = trend(f.filter(_rating_truthy(F.col("rating"))), "rating", ARRIVAL, g, "rating_trend")
    issues = top_issues(f, g, 10, lexicon) if issues is None else issues
    issue_lists = issues.groupBy(*g).agg(ranked_list("rank", "keyword").alias("top_issue_keywords")) \
        .withColumn("critical_areas", F.slice("top_issue_keywords", 1, 5))
    sug = _suggested(flat.select(*g, "_n", "_low", "_corr"), f, g, low_share, min_corrections)
    out = flat.join(tr, g, "left").join(volume, g, "left").join(issue_lists, g, "left").join(sug, g, "left")
    if domains is not None:
        out = domains.select("domain").join(out, "domain", "left")
    empty = F.array().cast("array<string>")
    return out.select(
        "domain",
        F.coalesce("total_feedback", F.lit(0)).cast("long").alias("total_feedback"),
        F.coalesce("avg_rating", F.lit(0.0)).alias("avg_rating"),
        F.coalesce("rating_trend", F.lit(0.0)).alias("rating_trend"),
        F.coalesce("volume_trend", F.lit(0.0)).alias("feedback_volume_trend"),
        F.least(F.coalesce("total_feedback", F.lit(0)) / 100.0, F.lit(1.0)).alias("confidence_score"),
        F.coalesce("critical_areas", empty).alias("critical_areas"),
        F.coalesce("top_issue_keywords", empty).alias("top_issue_keywords"),
        F.coalesce("suggestions", empty).alias("improvement_suggestions"),
        "feedback_distribution",
        F.lit(f"{days} days").alias("analysis_period"))


def recommendations(analysis: DataFrame, issues: DataFrame, avg_threshold: float = 3.5,
                    min_frequency: int = 5, trend_threshold: float = -0.1) -> DataFrame:
    """Improvement recommendations from an analysis (A5) and its top issues, as typed rows
    (domain, seq, type, priority, action, target, description); `seq` keeps the rule order."""
    a = analysis
    low = a.filter(F.col("total_feedback") > 0).filter(F.col("avg_rating") < avg_threshold).select(
        "domain", F.lit(0).alias("seq"), F.lit("training_data").alias("type"),
        F.lit("high").alias("priority"), F.lit("increase_training_examples").alias("action"),
        F.lit("overall_quality").alias("target"),
        F.lit("Overall rating is low. Consider expanding training data with high-quality examples.")
        .alias("description"))
    iss = issues.filter((F.col("rank") <= 3) & (F.col("frequency") > min_frequency)).select(
        "domain", (F.lit(100) + F.col("rank")).alias("seq"), F.lit("targeted_training").alias("type"),
        F.lit("medium").alias("priority"), F.lit("add_specific_examples").alias("action"),
        F.lit("quality").alias("target"),
        F.concat(F.lit("Address frequent issue: Issue related to "), F.col("keyword")).alias("description"))
    crit = a.select("domain", F.posexplode("critical_areas").alias("_p", "_area")).select(
        "domain", (F.lit(200) + F.col("_p")).alias("seq"), F.lit("knowledge_base").alias("type"),
        F.lit("high").alias("priority"), F.lit("expand_knowledge_base").alias("action"),
        F.lit("domain_coverage").alias("target"),
        F.concat(F.lit("Critical knowledge gap identified in: "), F.col("_area")).alias("description"))
    tr = a.filter(F.col("rating_trend") < trend_threshold).select(
        "domain", F.lit(300).alias("seq"), F.lit("model_refresh").alias("type"),
        F.lit("high").alias("priority"), F.lit("retrain_model").alias("action"),
        F.lit("accuracy_recovery").alias("target"),
        F.lit("Model accuracy is declining. Consider retraining with recent data.").alias("description"))
    return low.unionByName(iss).unionByName(crit).unionByName(tr)


def model_performance(fb: DataFrame, group_by: Sequence[str] = ("domain", "model_id"),
                      lexicon=FEEDBACK_CONCEPTS) -> DataFrame:
    """A8 (+A9 consistency, A10 relevance) per (domain, model)."""
    f = _with_features(fb, lexicon)
    r = F.col("rating")
    n = F.count(F.lit(1))
    return f.groupBy(*group_by).agg(
        (F.coalesce(F.avg(r), F.lit(0.0)) / 5.0).alias("user_satisfaction"),
        (F.count_if(F.col("feedback_type").isin("praise", "rating") & (F.coalesce(r, F.lit(0.0)) >= 4))
         / n).alias("response_quality"),
        F.greatest(F.lit(0.0), 1.0 - F.count_if(F.col("feedback_type") == "correction") / n)
        .alias("accuracy_score"),
        F.when(F.count(r) < 2, F.lit(0.5))
        .otherwise(F.greatest(F.lit(0.0), 1.0 - F.var_samp(r) / 4.0)).alias("consistency_score"),
        (F.count_if((F.size("keywords") > 0) | (F.size("concepts") > 0)) / n).alias("relevance_score"),
        n.alias("feedback_volume"))


def batch_feedback(fb: DataFrame) -> DataFrame:
    """Per domain over unprocessed rated rows: average rating and share under 3."""
    f = pending(fb).filter(F.col("rating").isNotNull())
    return f.groupBy("domain").agg(
        F.avg("rating").alias("recent_avg_rating"),
        (F.count_if(F.col("rating") < 3.0) / F.count(F.lit(1))).alias("low_rating_percentage"),
        F.count(F.lit(1)).alias("feedback_count"))


def running_rating(fb: DataFrame) -> DataFrame:
    """Feedback count and average rating per domain (rated rows)."""
    f = fb.filter(F.col("rating").isNotNull())
    return f.groupBy("domain").agg(F.count(F.lit(1)).alias("feedback_count"),
                                   F.avg("rating").alias("average_rating"))


def running_rating_rows(fb: DataFrame) -> DataFrame:
    """The running count and average after each rated row, per domain, in arrival order.

    A cumulative window per domain would put a whole domain in one task; instead the rows
    get a distributed ordinal and per-partition running sums are offset by the totals of the
    partitions before them (same two-pass scheme as `with_ordinal`)."""
    f = fb.filter(F.col("rating").isNotNull()).select("domain", *ARRIVAL, "rating")
    return running_sum(f, ["domain"], ARRIVAL, "rating", "running_count", "running_sum") \
        .withColumn("running_avg", F.col("running_sum") / F.col("running_count"))


def weak_areas(fb: DataFrame, n: int = 5, threshold: float = 3.0) -> DataFrame:
    """Top n words (longer than 4, raw tokens) of query + comment over rows rated below
    `threshold`; a missing rating counts as 0 (so it is included)."""
    f = fb.filter(F.coalesce(F.col("rating"), F.lit(0.0)) < threshold)
    text = F.lower(F.concat(F.coalesce("user_input", F.lit("")), F.lit(" "),
                            F.coalesce("user_comment", F.lit(""))))
    toks = F.filter(tx.words(text), lambda x: F.length(x) > 4)
    return top_terms(f, ["domain"], toks, ARRIVAL, n, term_col="area")


def improvement_areas(fb: DataFrame, n: int = 10, threshold: float = 4.0,
                      lexicon=FEEDBACK_CONCEPTS) -> DataFrame:
    """Top n of keywords then concepts of rows rated below `threshold` (missing = 5)."""
    f = _with_features(fb, lexicon).filter(F.coalesce(F.col("rating"), F.lit(5.0)) < threshold)
    return top_terms(f, ["domain"], F.concat("keywords", "concepts"), ARRIVAL, n, term_col="area")


# --------------------------------------------------------------------------- examples
def feedback_examples(fb: DataFrame, limit: int = 100, lexicon=FEEDBACK_CONCEPTS) -> DataFrame:
    """L4: per domain, corrections (user input + correction, quality F18) else rating >= 4
    reinforcements (user input + model output, quality = rating); quality desc, arrival order
    for ties (stable sort), first `limit`. Ids of feedback are unique (S22)."""
    r = F.col("rating")
    is_corr = _nonempty(F.col("correction")) & _nonempty(F.col("user_input"))
    is_good = ~is_corr & _rating_truthy(r) & (r >= 4.0) & _nonempty(F.col("model_output"))
    marked = fb.filter(is_corr | is_good).select("domain", "feedback_id", "ts", is_corr.alias("_corr"),
                                                 F.when(is_corr, example_quality()).otherwise(r).alias("quality_score"))
    best = top_k_rows(marked, ["domain"], [F.col("quality_score").desc(), F.col("ts"), F.col("feedback_id")], limit)
    # texts are read, and features found, for the best rows alone
    ex = _with_features(fb.join(best.select("feedback_id", "_corr", "quality_score", "rank"), "feedback_id"), lexicon)
    return ex.select(
        "domain", "feedback_id", "ts",
        F.array(F.struct(F.lit("user").alias("role"), F.col("user_input").alias("content")),
                F.struct(F.lit("assistant").alias("role"),
                         F.when(F.col("_corr"), F.col("correction")).otherwise(F.col("model_output"))
                         .alias("content"))).alias("messages"),
        "quality_score", "keywords", "concepts",
        F.when(F.col("_corr"), F.lit("correction")).otherwise(F.lit("reinforcement")).alias("improvement_type"), "rank")


def examples_from_feedback(fb: DataFrame, configs: DataFrame, threshold: float = 3.0) -> DataFrame:
    """training rows (system/user/assistant) from pending rows rated below `threshold`
    that carry an expected answer. `configs` has (domain, context_paragraph)."""
    f = pending(fb).filter((F.col("rating") < threshold) & _nonempty(F.col("expected_output")))
    j = f.join(configs.select("domain", "context_paragraph"), "domain", "left")
    system = F.concat(F.lit("You are an expert in "), F.col("domain"), F.lit(". "),
                      F.coalesce("context_paragraph", F.lit("")))
    return j.select("domain", "feedback_id", "ts", F.array(
        F.struct(F.lit("system").alias("role"), system.alias("content")),
        F.struct(F.lit("user").alias("role"), F.col("user_input").alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.col("expected_output").alias("content"))
    ).alias("messages"))


# --------------------------------------------------------------------------- monitors (batch)
def hourly_alerts(fb: DataFrame, window: str = "1 hour", max_avg: float = 2.0,
                  max_corrections: int = 10) -> DataFrame:
    """T3 (batch twin): per domain and tumbling hour: critical count, average rating,
    corrections, and the three alert flags."""
    f = fb.withColumn("severity", severity()) if "severity" not in fb.columns else fb
    g = f.groupBy("domain", F.window("ts", window).alias("w")).agg(
        F.count_if(F.col("severity") == "critical").alias("critical_count"),
        F.avg("rating").alias("avg_rating"),
        F.count_if(F.col("feedback_type") == "correction").alias("corrections"),
        F.count(F.lit(1)).alias("n"))
    return g.select(
        "domain", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        "critical_count", "avg_rating", "corrections", "n",
        (F.col("critical_count") > 0).alias("critical_alert"),
        F.coalesce(F.col("avg_rating") < max_avg, F.lit(False)).alias("rating_drop_alert"),
        (F.col("corrections") > max_corrections).alias("correction_alert"))


def alerts(fb: DataFrame, as_of, max_avg: float = 2.0, max_corrections: int = 10) -> DataFrame:
    """T3 as in the reference: the last hour before `as_of`, one row per alert raised."""
    f = recent_feedback(fb, as_of, hours=1).withColumn("severity", severity())
    g = f.groupBy("domain").agg(
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.avg("rating").alias("avg_rating"),
        F.count_if(F.col("feedback_type") == "correction").alias("corrections"))
    crit = g.filter(F.col("critical") > 0).select(
        "domain", F.lit("critical_feedback").alias("type"), F.lit("high").alias("severity"),
        F.col("critical").cast("double").alias("value"))
    drop = g.filter(F.col("avg_rating") < max_avg).select(
        "domain", F.lit("rating_drop").alias("type"), F.lit("medium").alias("severity"),
        F.col("avg_rating").alias("value"))
    corr = g.filter(F.col("corrections") > max_corrections).select(
        "domain", F.lit("high_correction_volume").alias("type"), F.lit("medium").alias("severity"),
        F.col("corrections").cast("double").alias("value"))
    return crit.unionByName(drop).unionByName(corr)


def feedback_triggers(fb: DataFrame, as_of, days: int = 7, max_avg: float = 3.0,
                      min_count: int = 50) -> DataFrame:
    """T5 (batch): per domain over the last `days`: average rating, count, and whether a
    learning cycle is triggered (avg < max_avg and count >= min_count)."""
    f = feedback_window(fb, as_of, days)
    g = f.groupBy("domain").agg(F.coalesce(F.avg("rating"), F.lit(0.0)).alias("avg_rating"),
                                F.count(F.lit(1)).alias("total_feedback"))
    return g.withColumn("triggered", (F.col("avg_rating") < max_avg) &
                        (F.col("total_feedback") >= min_count))


def feedback_batches(fb: DataFrame, size: int = 10) -> DataFrame:
    """T4 (batch twin): number every pending row in arrival order and cut the queue into
    batches of `size`; a batch fires when it is full."""
    p = pending(fb).select("feedback_id", "ts", "domain")
    o = with_ordinal(p, ARRIVAL, name="_rn")
    return o.select("feedback_id", "domain", F.floor(F.col("_rn") / size).cast("long").alias("batch_id"))

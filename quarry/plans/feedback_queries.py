"""Feedback queries over `feedback_v` (SURVEY §2.1 S22, §2.2, §2.4 A5–A12/A21/A22/A26, L4, F18,
F21, T3/T4/T5 batch forms)."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.domains import domains_df
from quarry.functions.lexicons import AS_OF, TEST_LEXICON
from quarry.operators import feedback as fo
from quarry.plans.catalog import query
from quarry.plans.tables import written
from quarry.sources.views import VIEW_DEPS, VIEW_SQL, _WS, feedback_view, with_views

AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"
_TERMS = "[" + ", ".join(f"'{t}'" for ts in TEST_LEXICON.values() for t in ts) + "]"
_JOINED = ("lower(concat_ws(' ', nullif(user_input, ''), nullif(model_output, ''), "
           "nullif(user_comment, ''), nullif(correction, '')))")

# feedback rows with derived severity, F2 keywords and F3 concepts, plus arrival number `an`
VIEW_SQL["feedback_x"] = f"""
SELECT *,
  CASE WHEN rating IS NOT NULL AND rating <= 1.0 THEN 'critical'
       WHEN feedback_type = 'complaint' THEN 'high'
       WHEN correction IS NOT NULL THEN 'medium'
       WHEN rating IS NOT NULL AND rating <= 2.0 THEN 'high' ELSE 'low' END AS severity,
  [x for x in regexp_split_to_array({_JOINED}, '{_WS}')
     if x <> '' AND length(x) > 4 AND regexp_full_match(x, '\\p{{L}}+')][1:10] AS keywords,
  [t for t in {_TERMS} if contains({_JOINED}, t)][1:5] AS concepts,
  row_number() OVER (ORDER BY ts, feedback_id) AS an
FROM feedback_v"""
VIEW_DEPS["feedback_x"] = ["feedback_v"]


def fbx(spark, sf):
    """feedback_v with severity, keywords and concepts (test lexicon)."""
    return fo._with_features(feedback_view(spark, sf), TEST_LEXICON)


def analysed(spark, sf):
    """(issues, analysis) of the last 30 days of feedback: one feature table, both results kept as tables."""
    recent = fo.feature_table(fo.feedback_window(feedback_view(spark, sf), AS_OF, 30), TEST_LEXICON)
    issues = written(fo.top_issues(recent, ["domain"], 10, TEST_LEXICON), "issues")
    return issues, written(fo.analyze_feedback(recent, AS_OF, 30, lexicon=TEST_LEXICON, issues=issues), "analysis")


def _r(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# ----------------------------------------------------------------------------- S22 ingest
@query("f_feedback_ingest", with_views(f"""
SELECT feedback_id, domain, severity, array_to_string(keywords, ' ') AS keywords,
  array_to_string(concepts, ' ') AS concepts, CAST(session_id AS VARCHAR) AS session_id,
  severity = 'critical' AS processed
FROM feedback_x""", "feedback_x"))
def f_feedback_ingest(spark, sf):
    raw = feedback_view(spark, sf).drop("processed")
    out = fo.ingest_feedback(raw, TEST_LEXICON)
    return out.select("feedback_id", "domain", "severity",
                      F.array_join("keywords", " ").alias("keywords"),
                      F.array_join("concepts", " ").alias("concepts"), "session_id", "processed")


@query("f_feedback_severity", with_views("SELECT feedback_id, severity FROM feedback_x", "feedback_x"))
def f_feedback_severity(spark, sf):
    return feedback_view(spark, sf).select("feedback_id", fo.severity().alias("severity"))


@query("f_feedback_keywords", with_views(
    "SELECT feedback_id, array_to_string(keywords, ' ') AS keywords, len(keywords) AS n_keywords "
    "FROM feedback_x", "feedback_x"))
def f_feedback_keywords(spark, sf):
    f = fbx(spark, sf)
    return f.select("feedback_id", F.array_join("keywords", " ").alias("keywords"),
                    F.size("keywords").cast("long").alias("n_keywords"))


@query("f_feedback_concepts", with_views(
    "SELECT feedback_id, array_to_string(concepts, ' ') AS concepts FROM feedback_x", "feedback_x"))
def f_feedback_concepts(spark, sf):
    return fbx(spark, sf).select("feedback_id", F.array_join("concepts", " ").alias("concepts"))


# ----------------------------------------------------------------------------- P-2, P-3, P-5
@query("f_feedback_window", with_views(f"""
SELECT feedback_id, domain, model_id, ts FROM feedback_v
WHERE ts >= {AS_OF_SQL} - INTERVAL 7 DAY AND model_id = 'm1'""", "feedback_v"))
def f_feedback_window(spark, sf):
    return fo.feedback_window(feedback_view(spark, sf), AS_OF, 7, "m1") \
        .select("feedback_id", "domain", "model_id", "ts")


@query("f_recent_feedback", with_views(f"""
SELECT feedback_id, domain, ts FROM feedback_v WHERE ts >= {AS_OF_SQL} - INTERVAL 24 HOUR""", "feedback_v"))
def f_recent_feedback(spark, sf):
    return fo.recent_feedback(feedback_view(spark, sf), AS_OF, 24).select("feedback_id", "domain", "ts")


@query("f_pending", with_views("""
SELECT domain, count(*) AS pending_count FROM feedback_v WHERE NOT processed GROUP BY domain""",
                               "feedback_v"))
def f_pending(spark, sf):
    return fo.pending(feedback_view(spark, sf)).groupBy("domain") \
        .agg(F.count(F.lit(1)).alias("pending_count"))


# ----------------------------------------------------------------------------- F18
@query("f_example_quality", with_views("""
SELECT feedback_id, CASE WHEN length(user_input) < 20 THEN greatest(1.0, q - 0.5) ELSE q END AS quality
FROM (SELECT feedback_id, user_input,
        CASE WHEN correction IS NOT NULL AND correction <> ''
             THEN least(5.0, CASE WHEN rating IS NOT NULL AND rating <> 0 THEN rating ELSE 3.0 END + 1.0)
             ELSE CASE WHEN rating IS NOT NULL AND rating <> 0 THEN rating ELSE 3.0 END END AS q
      FROM feedback_v)""", "feedback_v"))
def f_example_quality(spark, sf):
    return feedback_view(spark, sf).select("feedback_id", fo.example_quality().alias("quality"))


# ----------------------------------------------------------------------------- A5 and parts
_WIN30 = f"SELECT * FROM feedback_x WHERE ts >= {AS_OF_SQL} - INTERVAL 30 DAY"
_ISSUES_SQL = f"""
SELECT domain, keyword, count(*) AS frequency,
  row_number() OVER (PARTITION BY domain ORDER BY count(*) DESC, min(an * 100 + pos)) AS rank
FROM (SELECT domain, an, unnest(keywords) AS keyword, unnest(range(len(keywords))) AS pos
      FROM ({_WIN30}) WHERE severity IN ('high', 'critical'))
GROUP BY domain, keyword"""


@query("f_top_issues", with_views(f"""
SELECT domain, keyword, frequency, rank FROM ({_ISSUES_SQL}) WHERE rank <= 10""", "feedback_x"))
def f_top_issues(spark, sf):
    f = fo.feedback_window(fbx(spark, sf), AS_OF, 30)
    return fo.top_issues(f, ["domain"], 10, TEST_LEXICON) \
        .select("domain", "keyword", "frequency", F.col("rank").cast("long").alias("rank"))


@query("f_feedback_distribution", with_views(f"""
SELECT domain, feedback_type, count(*) AS n FROM ({_WIN30}) GROUP BY domain, feedback_type""",
                                             "feedback_x"))
def f_feedback_distribution(spark, sf):
    f = fo.feedback_window(feedback_view(spark, sf), AS_OF, 30)
    return fo.type_distribution(f)


_TREND_SQL = """
SELECT {g}, CASE WHEN count(*) >= 2 THEN coalesce(regr_slope(rating, x), 0.0) ELSE 0.0 END AS {out}
FROM (SELECT {g}, rating, row_number() OVER (PARTITION BY {g} ORDER BY ts, feedback_id) - 1 AS x
      FROM ({src}) WHERE rating IS NOT NULL AND rating <> 0)
GROUP BY {g}"""


@query("f_rating_trend", with_views(f"""
SELECT domain, model_id, round(trend, 9) AS trend FROM ({_TREND_SQL.format(
    g='domain, model_id', out='trend', src='SELECT * FROM feedback_v')})""", "feedback_v"))
def f_rating_trend(spark, sf):
    f = feedback_view(spark, sf).filter(fo._rating_truthy(F.col("rating")))
    return fo.trend(f, "rating", fo.ARRIVAL, ["domain", "model_id"]) \
        .select("domain", "model_id", _r("trend", 9).alias("trend"))


def _suggest_sql(src: str, low_share: float) -> str:
    return f"""
SELECT b.domain, concat_ws(' | ',
    CASE WHEN b.low > b.n * {low_share} THEN 'Consider retraining the model with higher quality examples' END,
    CASE WHEN b.corr > 10 THEN 'Multiple corrections indicate need for targeted training data' END,
    CASE WHEN c.concept IS NOT NULL THEN 'Focus on improving responses related to ' || c.concept END) AS suggestions
FROM (SELECT domain, count(*) AS n,
        count(*) FILTER (WHERE rating IS NOT NULL AND rating <> 0 AND rating <= 2.0) AS low,
        count(*) FILTER (WHERE correction IS NOT NULL AND correction <> '') AS corr
      FROM ({src}) GROUP BY domain) b
LEFT JOIN (SELECT domain, concept FROM (
    SELECT domain, concept, row_number() OVER (PARTITION BY domain ORDER BY count(*) DESC, min(an * 100 + pos)) AS rk
    FROM (SELECT domain, an, unnest(concepts) AS concept, unnest(range(len(concepts))) AS pos FROM ({src}))
    GROUP BY domain, concept) WHERE rk = 1) c ON c.domain = b.domain"""


@query("f_suggestions", with_views(_suggest_sql("SELECT * FROM feedback_x", 0.41), "feedback_x"))
def f_suggestions(spark, sf):
    s = fo.suggestions(fbx(spark, sf), ["domain"], low_share=0.41, lexicon=TEST_LEXICON)
    return s.select("domain", F.array_join("suggestions", " | ").alias("suggestions"))


@query("f_feedback_analysis", with_views(f"""
SELECT d.domain, coalesce(fl.total_feedback, 0) AS total_feedback,
  round(coalesce(fl.avg_rating, 0.0), 6) AS avg_rating,
  round(coalesce(tr.rating_trend, 0.0), 9) AS rating_trend,
  round(coalesce(vt.slope, 0.0), 9) AS feedback_volume_trend, coalesce(ds.distribution, '') AS feedback_distribution,
  round(least(coalesce(fl.total_feedback, 0) / 100.0, 1.0), 6) AS confidence_score,
  coalesce(iss.critical_areas, '') AS critical_areas,
  coalesce(iss.top_issue_keywords, '') AS top_issue_keywords,
  coalesce(sg.suggestions, '') AS improvement_suggestions
FROM (VALUES ('technical'), ('medical'), ('legal'), ('financial')) d(domain)
LEFT JOIN (SELECT domain, count(*) AS total_feedback, avg(rating) AS avg_rating FROM ({_WIN30}) GROUP BY domain) fl
  ON fl.domain = d.domain
LEFT JOIN ({_TREND_SQL.format(g='domain', out='rating_trend', src=_WIN30)}) tr ON tr.domain = d.domain
LEFT JOIN (SELECT domain, string_agg(keyword, ',' ORDER BY rank) FILTER (WHERE rank <= 5) AS critical_areas,
             string_agg(keyword, ',' ORDER BY rank) AS top_issue_keywords
           FROM ({_ISSUES_SQL}) WHERE rank <= 10 GROUP BY domain) iss ON iss.domain = d.domain
LEFT JOIN (SELECT domain, CASE WHEN count(*) >= 2 THEN regr_slope(n, x) ELSE 0.0 END AS slope FROM (
    SELECT domain, n, row_number() OVER (PARTITION BY domain ORDER BY day) - 1 AS x FROM (
      SELECT domain, CAST(ts AS DATE) AS day, count(*) AS n FROM ({_WIN30}) GROUP BY 1, 2)) GROUP BY domain) vt ON vt.domain = d.domain
LEFT JOIN (SELECT domain, string_agg(feedback_type || '=' || n, ',' ORDER BY feedback_type) AS distribution FROM (
    SELECT domain, feedback_type, count(*) AS n FROM ({_WIN30}) GROUP BY 1, 2) GROUP BY domain) ds ON ds.domain = d.domain
LEFT JOIN ({_suggest_sql(_WIN30, 0.3)}) sg ON sg.domain = d.domain""", "feedback_x"))
def f_feedback_analysis(spark, sf):
    a = fo.analyze_feedback(feedback_view(spark, sf), AS_OF, 30, domains=domains_df(spark), lexicon=TEST_LEXICON)
    return a.select("domain", "total_feedback", _r("avg_rating").alias("avg_rating"),
                    _r("rating_trend", 9).alias("rating_trend"),
                    _r("feedback_volume_trend", 9).alias("feedback_volume_trend"),
                    F.coalesce(F.array_join(F.transform(F.map_entries("feedback_distribution"), lambda x: F.concat(
                        x["key"], F.lit("="), x["value"].cast("string"))), ","), F.lit("")).alias("feedback_distribution"),
                    _r("confidence_score").alias("confidence_score"),
                    F.array_join("critical_areas", ",").alias("critical_areas"),
                    F.array_join("top_issue_keywords", ",").alias("top_issue_keywords"),
                    F.array_join("improvement_suggestions", " | ").alias("improvement_suggestions"))


@query("f_recommendations", with_views(f"""
WITH iss AS ({_ISSUES_SQL}),
an AS (SELECT domain, count(*) AS n, avg(rating) AS avg_rating FROM ({_WIN30}) GROUP BY domain),
tr AS ({_TREND_SQL.format(g='domain', out='rating_trend', src=_WIN30)})
SELECT domain, 0 AS seq, 'training_data' AS type, 'high' AS priority, 'increase_training_examples' AS action,
  'overall_quality' AS target,
  'Overall rating is low. Consider expanding training data with high-quality examples.' AS description
FROM an WHERE avg_rating < 3.2
UNION ALL
SELECT domain, 100 + rank, 'targeted_training', 'medium', 'add_specific_examples', 'quality',
  'Address frequent issue: Issue related to ' || keyword FROM iss WHERE rank <= 3 AND frequency > 5
UNION ALL
SELECT domain, 200 + rank - 1, 'knowledge_base', 'high', 'expand_knowledge_base', 'domain_coverage',
  'Critical knowledge gap identified in: ' || keyword FROM iss WHERE rank <= 5
UNION ALL
SELECT domain, 300, 'model_refresh', 'high', 'retrain_model', 'accuracy_recovery',
  'Model accuracy is declining. Consider retraining with recent data.' FROM tr WHERE rating_trend < -0.0001
""", "feedback_x"))
def f_recommendations(spark, sf):
    iss, a = analysed(spark, sf)
    rec = fo.recommendations(a, iss, avg_threshold=3.2, trend_threshold=-0.0001)
    return rec.select("domain", F.col("seq").cast("long").alias("seq"), "type", "priority", "action",
                      "target", "description")


# ----------------------------------------------------------------------------- A8–A12
@query("f_model_performance", with_views("""
SELECT domain, model_id,
  round(coalesce(avg(rating), 0.0) / 5.0, 6) AS user_satisfaction,
  round(count(*) FILTER (WHERE feedback_type IN ('praise', 'rating') AND coalesce(rating, 0.0) >= 4) / count(*), 6)
    AS response_quality,
  round(greatest(0.0, 1.0 - count(*) FILTER (WHERE feedback_type = 'correction') / count(*)), 6) AS accuracy_score,
  round(CASE WHEN count(rating) < 2 THEN 0.5 ELSE greatest(0.0, 1.0 - var_samp(rating) / 4.0) END, 6)
    AS consistency_score,
  round(count(*) FILTER (WHERE len(keywords) > 0 OR len(concepts) > 0) / count(*), 6) AS relevance_score,
  count(*) AS feedback_volume
FROM feedback_x GROUP BY domain, model_id""", "feedback_x"))
def f_model_performance(spark, sf):
    m = fo.model_performance(fbx(spark, sf), lexicon=TEST_LEXICON)
    return m.select("domain", "model_id", *[_r(c).alias(c) for c in
                    ["user_satisfaction", "response_quality", "accuracy_score", "consistency_score",
                     "relevance_score"]], "feedback_volume")


@query("f_batch_feedback", with_views("""
SELECT domain, round(avg(rating), 6) AS recent_avg_rating,
  round(count(*) FILTER (WHERE rating < 3.0) / count(*), 6) AS low_rating_percentage,
  count(*) AS feedback_count
FROM feedback_v WHERE NOT processed AND rating IS NOT NULL GROUP BY domain""", "feedback_v"))
def f_batch_feedback(spark, sf):
    b = fo.batch_feedback(feedback_view(spark, sf))
    return b.select("domain", _r("recent_avg_rating").alias("recent_avg_rating"),
                    _r("low_rating_percentage").alias("low_rating_percentage"), "feedback_count")


@query("f_running_rating", with_views("""
SELECT domain, count(*) AS feedback_count, round(avg(rating), 6) AS average_rating
FROM feedback_v WHERE rating IS NOT NULL GROUP BY domain""", "feedback_v"))
def f_running_rating(spark, sf):
    r = fo.running_rating(feedback_view(spark, sf))
    return r.select("domain", "feedback_count", _r("average_rating").alias("average_rating"))


@query("f_running_rating_rows", with_views("""
SELECT feedback_id, domain,
  count(*) OVER w AS running_count, round(avg(rating) OVER w, 6) AS running_avg
FROM feedback_v WHERE rating IS NOT NULL
WINDOW w AS (PARTITION BY domain ORDER BY ts, feedback_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
                                            "feedback_v"))
def f_running_rating_rows(spark, sf):
    r = fo.running_rating_rows(feedback_view(spark, sf))
    return r.select("feedback_id", "domain", "running_count", _r("running_avg").alias("running_avg"))


# ----------------------------------------------------------------------------- A21, A22
@query("f_weak_areas", with_views(f"""
SELECT domain, area, cnt AS count, rank FROM (
  SELECT domain, area, count(*) AS cnt,
    row_number() OVER (PARTITION BY domain ORDER BY count(*) DESC, min(an * 1000000 + pos)) AS rank
  FROM (SELECT domain, an, unnest(toks) AS area, unnest(range(len(toks))) AS pos FROM (
          SELECT domain, an, [x for x in regexp_split_to_array(lower(coalesce(user_input, '') || ' ' ||
                 coalesce(user_comment, '')), '{_WS}') if x <> '' AND length(x) > 4] AS toks
          FROM feedback_x WHERE coalesce(rating, 0.0) < 3.0))
  GROUP BY domain, area) WHERE rank <= 5""", "feedback_x"))
def f_weak_areas(spark, sf):
    w = fo.weak_areas(feedback_view(spark, sf))
    return w.select("domain", "area", "count", F.col("rank").cast("long").alias("rank"))


@query("f_improvement_areas", with_views("""
SELECT domain, area, cnt AS count, rank FROM (
  SELECT domain, area, count(*) AS cnt,
    row_number() OVER (PARTITION BY domain ORDER BY count(*) DESC, min(an * 100 + pos)) AS rank
  FROM (SELECT domain, an, unnest(kc) AS area, unnest(range(len(kc))) AS pos FROM (
          SELECT domain, an, list_concat(keywords, concepts) AS kc
          FROM feedback_x WHERE coalesce(rating, 5.0) < 4.0))
  GROUP BY domain, area) WHERE rank <= 10""", "feedback_x"))
def f_improvement_areas(spark, sf):
    w = fo.improvement_areas(fbx(spark, sf), lexicon=TEST_LEXICON)
    return w.select("domain", "area", "count", F.col("rank").cast("long").alias("rank"))


# ----------------------------------------------------------------------------- L4, F21
@query("f_feedback_examples", with_views("""
SELECT domain, rank, feedback_id, quality_score, improvement_type, user_content, assistant_content FROM (
  SELECT domain, feedback_id, q AS quality_score, improvement_type, user_input AS user_content,
    assistant_content,
    row_number() OVER (PARTITION BY domain ORDER BY q DESC, ts, feedback_id) AS rank
  FROM (SELECT *,
          CASE WHEN is_corr THEN (CASE WHEN length(user_input) < 20 THEN greatest(1.0, qb - 0.5) ELSE qb END)
               ELSE rating END AS q,
          CASE WHEN is_corr THEN 'correction' ELSE 'reinforcement' END AS improvement_type,
          CASE WHEN is_corr THEN correction ELSE model_output END AS assistant_content
        FROM (SELECT *,
                coalesce(correction <> '' AND user_input <> '', false) AS is_corr,
                least(5.0, CASE WHEN rating IS NOT NULL AND rating <> 0 THEN rating ELSE 3.0 END + 1.0) AS qb
              FROM feedback_v)
        WHERE is_corr OR (rating IS NOT NULL AND rating <> 0 AND rating >= 4.0 AND model_output <> '')))
WHERE rank <= 100""", "feedback_v"))
def f_feedback_examples(spark, sf):
    ex = fo.feedback_examples(feedback_view(spark, sf), 100, TEST_LEXICON)
    return ex.select("domain", F.col("rank").cast("long").alias("rank"), "feedback_id", "quality_score",
                     "improvement_type", F.col("messages")[0]["content"].alias("user_content"),
                     F.col("messages")[1]["content"].alias("assistant_content"))


@query("f_examples_from_feedback", with_views("""
SELECT f.feedback_id, f.domain,
  'You are an expert in ' || f.domain || '. ' || d.description AS system_content,
  f.user_input AS user_content, f.expected_output AS assistant_content
FROM feedback_v f LEFT JOIN (VALUES ('technical', 'Software engineering, programming, and technology documentation'),
  ('medical', 'Medical research, clinical practice, and healthcare documentation'),
  ('legal', 'Legal documents, regulations, and jurisprudence'),
  ('financial', 'Financial analysis, investment strategies, and market research')) d(domain, description)
  ON d.domain = f.domain
WHERE NOT f.processed AND f.rating < 3.0 AND f.expected_output IS NOT NULL AND f.expected_output <> ''""",
                                               "feedback_v"))
def f_examples_from_feedback(spark, sf):
    cfg = domains_df(spark).select("domain", F.col("description").alias("context_paragraph"))
    ex = fo.examples_from_feedback(feedback_view(spark, sf), cfg)
    return ex.select("feedback_id", "domain", F.col("messages")[0]["content"].alias("system_content"),
                     F.col("messages")[1]["content"].alias("user_content"),
                     F.col("messages")[2]["content"].alias("assistant_content"))


# ----------------------------------------------------------------------------- T3, T4, T5 batch
@query("f_alerts", with_views("""
SELECT domain, window_start, critical_count, round(avg_rating, 6) AS avg_rating, corrections, n,
  critical_count > 0 AS critical_alert, coalesce(avg_rating < 2.0, false) AS rating_drop_alert,
  corrections > 1 AS correction_alert
FROM (SELECT domain, time_bucket(INTERVAL 1 HOUR, ts) AS window_start,
        count(*) FILTER (WHERE severity = 'critical') AS critical_count, avg(rating) AS avg_rating,
        count(*) FILTER (WHERE feedback_type = 'correction') AS corrections, count(*) AS n
      FROM feedback_x GROUP BY domain, time_bucket(INTERVAL 1 HOUR, ts))""", "feedback_x"))
def f_alerts(spark, sf):
    a = fo.hourly_alerts(feedback_view(spark, sf), max_corrections=1)
    return a.select("domain", "window_start", "critical_count", _r("avg_rating").alias("avg_rating"),
                    "corrections", "n", "critical_alert", "rating_drop_alert", "correction_alert")


@query("f_last_hour_alerts", with_views(f"""
WITH g AS (SELECT domain, count(*) FILTER (WHERE severity = 'critical') AS critical, avg(rating) AS avg_rating,
             count(*) FILTER (WHERE feedback_type = 'correction') AS corrections
           FROM feedback_x WHERE ts >= {AS_OF_SQL} - INTERVAL 1 HOUR GROUP BY domain)
SELECT domain, 'critical_feedback' AS type, 'high' AS severity, CAST(critical AS DOUBLE) AS value FROM g WHERE critical > 0
UNION ALL SELECT domain, 'rating_drop', 'medium', round(avg_rating, 6) FROM g WHERE avg_rating < 4.0
UNION ALL SELECT domain, 'high_correction_volume', 'medium', CAST(corrections AS DOUBLE) FROM g WHERE corrections > 0
""", "feedback_x"))
def f_last_hour_alerts(spark, sf):
    a = fo.alerts(feedback_view(spark, sf), AS_OF, max_avg=4.0, max_corrections=0)
    return a.select("domain", "type", "severity", _r("value").alias("value"))


@query("f_feedback_triggers", with_views(f"""
SELECT domain, round(coalesce(avg(rating), 0.0), 6) AS avg_rating, count(*) AS total_feedback,
  coalesce(avg(rating), 0.0) < 2.97 AND count(*) >= 50 AS triggered
FROM feedback_v WHERE ts >= {AS_OF_SQL} - INTERVAL 7 DAY GROUP BY domain""", "feedback_v"))
def f_feedback_triggers(spark, sf):
    t = fo.feedback_triggers(feedback_view(spark, sf), AS_OF, 7, max_avg=2.97, min_count=50)
    return t.select("domain", _r("avg_rating").alias("avg_rating"), "total_feedback", "triggered")


@query("f_feedback_batches", with_views("""
SELECT feedback_id, domain, CAST(floor((row_number() OVER (ORDER BY ts, feedback_id) - 1) / 10) AS BIGINT) AS batch_id
FROM feedback_v WHERE NOT processed""", "feedback_v"))
def f_feedback_batches(spark, sf):
    return fo.feedback_batches(feedback_view(spark, sf), 10)

"""Model-registry, usage and learning-cycle queries over views derived from `events`."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.domains import domains_df, domains_values_sql
from quarry.functions.lexicons import AS_OF
from quarry.operators import feedback as fo
from quarry.operators import registry as ro
from quarry.operators import training as tr
from quarry.plans.catalog import query
from quarry.plans.feedback_queries import AS_OF_SQL
from quarry.sources.files import read_registry_document, write_registry_document
from quarry.sources.views import (VIEW_DEPS, VIEW_SQL, _domain_of, feedback_view, mentor_view, requests_view, table,
                                  with_views)
from quarry.streaming.jobs import stream_root

TEST_THRESHOLDS = {"min_feedback_score": 2.93, "max_error_rate": 0.205, "max_latency_p95": 1500.0,
                   "min_usage_threshold": 800}


def _r(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# ----------------------------------------------------------------------------- views
VIEW_SQL["models_v"] = """
SELECT *, 'v' || version_no || '.0.0' AS version,
  lag(model_id) OVER (PARTITION BY domain ORDER BY created_at, model_id) AS parent_model,
  CASE version_no WHEN 1 THEN 'deprecated' WHEN 2 THEN 'deployed' ELSE 'training' END AS status,
  CASE WHEN version_no <= 2 THEN created_at + INTERVAL 1 DAY END AS deployed_at
FROM (SELECT domain, model_id, min(ts) AS created_at, coalesce(avg(rating), 0.0) AS feedback_score,
        count(*) AS usage_count, avg(CASE WHEN error THEN 1.0 ELSE 0.0 END) AS error_rate,
        sum(cost) / count(*) AS cost_per_request, quantile_cont(latency_ms, 0.95) AS latency_p95,
        row_number() OVER (PARTITION BY domain ORDER BY min(ts), model_id) AS version_no
      FROM requests_v GROUP BY domain, model_id)"""
VIEW_DEPS["models_v"] = ["requests_v"]

VIEW_SQL["model_metrics_v"] = """
SELECT model_id, 'accuracy' AS metric, 1.0 - error_rate AS value FROM models_v
UNION ALL SELECT model_id, 'satisfaction', feedback_score / 5.0 FROM models_v
UNION ALL SELECT model_id, 'latency_score', 1.0 - latency_p95 / 2000.0 FROM models_v WHERE latency_p95 < 1500"""
VIEW_DEPS["model_metrics_v"] = ["models_v"]

VIEW_SQL["deployments_v"] = """
SELECT event_id AS deployment_id,
  CASE user_id % 4 WHEN 0 THEN 'technical' WHEN 1 THEN 'medical' WHEN 2 THEN 'legal' ELSE 'financial' END AS domain,
  CASE user_id % 4 WHEN 0 THEN 'technical' WHEN 1 THEN 'medical' WHEN 2 THEN 'legal' ELSE 'financial' END
    || '_m' || CAST(user_id % 3 AS VARCHAR) AS model_id,
  ts AS deployed_at,
  CASE event_id % 3 WHEN 0 THEN 'deployed' WHEN 1 THEN 'pending' ELSE 'failed' END AS status
FROM events WHERE event_type = 'signup'"""

VIEW_SQL["jobs_v"] = """
SELECT event_id AS job_id,
  CASE user_id % 4 WHEN 0 THEN 'technical' WHEN 1 THEN 'medical' WHEN 2 THEN 'legal' ELSE 'financial' END AS domain,
  '-' || CASE user_id % 4 WHEN 0 THEN 'technical' WHEN 1 THEN 'medical' WHEN 2 THEN 'legal' ELSE 'financial' END
    || '-' || CAST(event_id AS VARCHAR) AS suffix,
  CASE event_type WHEN 'signup' THEN 'succeeded' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running'
    WHEN 'click' THEN 'validating_files' ELSE 'cancelled' END AS status,
  ts AS created_at,
  CASE WHEN event_type = 'signup' THEN 'ft:base:org:' || CASE user_id % 4 WHEN 0 THEN 'technical' WHEN 1 THEN 'medical'
    WHEN 2 THEN 'legal' ELSE 'financial' END || '-' || CAST(event_id AS VARCHAR) END AS fine_tuned_model
FROM events"""

VIEW_SQL["cycles_v"] = """
SELECT CAST(user_id AS VARCHAR) || '_' || CAST(CAST(ts AS DATE) AS VARCHAR) AS cycle_id,
  CASE user_id % 4 WHEN 0 THEN 'technical' WHEN 1 THEN 'medical' WHEN 2 THEN 'legal' ELSE 'financial' END AS domain,
  min(ts) AS created_at, max(ts) AS updated_at, max(ts) AS completed_at,
  CASE WHEN bool_or(event_type = 'error') THEN 'failed' ELSE 'complete' END AS phase,
  round(avg(value) / 1000, 6) AS improvement
FROM events GROUP BY user_id, CAST(ts AS DATE)"""

VIEW_SQL["history_v"] = """
SELECT CASE user_id % 4 WHEN 0 THEN 'technical' WHEN 1 THEN 'medical' WHEN 2 THEN 'legal' ELSE 'financial' END AS domain,
  CAST(ts AS DATE) AS day, round(avg(value) / 500, 6) AS overall_score
FROM events GROUP BY 1, 2"""


def models_view(spark, sf):
    r = requests_view(spark, sf)
    m = ro.request_metrics(r)
    created = r.groupBy("domain", "model_id").agg(F.min("ts").alias("created_at"))
    m = ro.with_version(m.join(created, ["domain", "model_id"]))
    status = F.when(F.col("version_no") == 1, "deprecated").when(F.col("version_no") == 2, "deployed") \
        .otherwise("training")
    metrics = F.map_concat(
        F.create_map(F.lit("accuracy"), 1.0 - F.col("error_rate"), F.lit("satisfaction"), F.col("feedback_score") / 5.0),
        F.when(F.col("latency_p95") < 1500, F.create_map(F.lit("latency_score"), 1.0 - F.col("latency_p95") / 2000.0))
        .otherwise(F.create_map().cast("map<string,double>")))
    return (m.withColumn("status", status).withColumn("performance_metrics", metrics)
            .withColumn("deployed_at", F.when(F.col("version_no") <= 2,
                                              F.col("created_at") + F.make_dt_interval(F.lit(1)))))


def deployments_view(spark, sf):
    e = table(spark, sf, "events").filter(F.col("event_type") == "signup")
    dom = _domain_of(F.col("user_id"))
    return e.select(F.col("event_id").alias("deployment_id"), dom.alias("domain"),
                    F.concat(dom, F.lit("_m"), (F.col("user_id") % 3).cast("string")).alias("model_id"),
                    F.col("ts").cast("timestamp").alias("deployed_at"),
                    F.when(F.col("event_id") % 3 == 0, "deployed").when(F.col("event_id") % 3 == 1, "pending")
                    .otherwise("failed").alias("status"))


def jobs_view(spark, sf):
    e = table(spark, sf, "events")
    dom = _domain_of(F.col("user_id"))
    et = F.col("event_type")
    return e.select(F.col("event_id").alias("job_id"), dom.alias("domain"),
                    F.concat(F.lit("-"), dom, F.lit("-"), F.col("event_id").cast("string")).alias("suffix"),
                    F.when(et == "signup", "succeeded").when(et == "error", "failed").when(et == "view", "running")
                    .when(et == "click", "validating_files").otherwise("cancelled").alias("status"),
                    F.col("ts").cast("timestamp").alias("created_at"),
                    F.when(et == "signup", F.concat(F.lit("ft:base:org:"), dom, F.lit("-"),
                                                    F.col("event_id").cast("string"))).alias("fine_tuned_model"))


def cycles_view(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    day = F.to_date("ts")
    g = e.groupBy("user_id", day.alias("day")).agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"),
        F.bool_or(F.col("event_type") == "error").alias("_err"), F.round(F.avg("value") / 1000, 6).alias("improvement"))
    return g.select(F.concat(F.col("user_id").cast("string"), F.lit("_"), F.col("day").cast("string")).alias("cycle_id"),
                    _domain_of(F.col("user_id")).alias("domain"), "created_at", "updated_at",
                    F.col("updated_at").alias("completed_at"),
                    F.when(F.col("_err"), "failed").otherwise("complete").alias("phase"), "improvement")


def history_view(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(_domain_of(F.col("user_id")).alias("domain"), F.to_date("ts").alias("day")).agg(
        F.round(F.avg("value") / 500, 6).alias("overall_score"))


# ----------------------------------------------------------------------------- A13, A14, T9, A27, A28
@query("f_request_metrics", with_views("""
SELECT domain, model_id, round(feedback_score, 6) AS feedback_score, usage_count, round(error_rate, 6) AS error_rate,
  round(latency_p95, 6) AS latency_p95, round(cost_per_request, 9) AS cost_per_request FROM models_v""", "models_v"))
def f_request_metrics(spark, sf):
    m = ro.request_metrics(requests_view(spark, sf))
    return m.select("domain", "model_id", _r("feedback_score").alias("feedback_score"), "usage_count",
                    _r("error_rate").alias("error_rate"), _r("latency_p95").alias("latency_p95"),
                    _r("cost_per_request", 9).alias("cost_per_request"))


@query("f_usage", with_views("""
SELECT domain, count(*) AS total_requests, CAST(sum(coalesce(tokens, 0)) AS BIGINT) AS total_tokens
FROM requests_v GROUP BY domain""", "requests_v"))
def f_usage(spark, sf):
    return ro.usage(requests_view(spark, sf))


@query("f_usage_hourly", with_views("""
SELECT domain, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS requests,
  CAST(sum(coalesce(tokens, 0)) AS BIGINT) AS tokens
FROM requests_v GROUP BY domain, time_bucket(INTERVAL 1 HOUR, ts)""", "requests_v"))
def f_usage_hourly(spark, sf):
    return ro.usage_windows(requests_view(spark, sf), "1 hour")


@query("f_token_cost", with_views("""
SELECT domain, count(*) AS requests, CAST(sum(coalesce(tokens, 0)) AS BIGINT) AS tokens,
  round(sum(coalesce(tokens, 0)) * 3.0 / 1000000.0, 9) AS cost,
  round(sum(coalesce(tokens, 0)) * 3.0 / 1000000.0 / count(*), 9) AS cost_per_request
FROM requests_v GROUP BY domain""", "requests_v"))
def f_token_cost(spark, sf):
    c = tr.token_cost(requests_view(spark, sf), "tokens", 3.0)
    return c.select("domain", "requests", "tokens", _r("cost", 9).alias("cost"),
                    _r("cost_per_request", 9).alias("cost_per_request"))


@query("f_operation_metrics", with_views("""
SELECT domain, size_bucket, count(*) AS operations, round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 6) AS success_rate,
  round(avg(duration_ms), 6) AS mean_ms, round(quantile_cont(duration_ms, 0.5), 6) AS p50_ms,
  round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms
FROM (SELECT domain, latency_ms AS duration_ms, NOT error AS success, CAST(tokens // 100 AS BIGINT) AS size_bucket
      FROM requests_v) GROUP BY domain, size_bucket""", "requests_v"))
def f_operation_metrics(spark, sf):
    r = requests_view(spark, sf).select("domain", F.col("latency_ms").alias("duration_ms"),
                                        (~F.col("error")).alias("success"),
                                        F.floor(F.col("tokens") / 100).cast("long").alias("size_bucket"))
    m = ro.operation_metrics(r)
    return m.select("domain", "size_bucket", "operations", _r("success_rate").alias("success_rate"),
                    _r("mean_ms").alias("mean_ms"), _r("p50_ms").alias("p50_ms"), _r("p95_ms").alias("p95_ms"))


# ----------------------------------------------------------------------------- W1, P-7…P-12
@query("f_model_version", with_views("SELECT model_id, version, parent_model, status FROM models_v", "models_v"))
def f_model_version(spark, sf):
    return models_view(spark, sf).select("model_id", "version", "parent_model", "status")


_PROMO_SQL = ("feedback_score >= 2.93 AND error_rate <= 0.205 AND latency_p95 <= 1500.0 AND usage_count >= 800")


@query("f_promotion", with_views(f"SELECT model_id, {_PROMO_SQL} AS meets_promotion FROM models_v", "models_v"))
def f_promotion(spark, sf):
    return models_view(spark, sf).select("model_id", ro.meets_promotion(TEST_THRESHOLDS).alias("meets_promotion"))


@query("f_underperforming", with_views(f"""
SELECT model_id, domain FROM models_v WHERE status = 'deployed' AND NOT ({_PROMO_SQL})""", "models_v"))
def f_underperforming(spark, sf):
    return ro.underperforming(models_view(spark, sf), TEST_THRESHOLDS).select("model_id", "domain")


@query("f_domain_models", with_views("""
SELECT model_id, version, status FROM models_v WHERE domain = 'legal'""", "models_v"))
def f_domain_models(spark, sf):
    return ro.domain_models(models_view(spark, sf), "legal").select("model_id", "version", "status")


@query("f_cleanup_models", with_views(f"""
WITH gone AS (SELECT model_id FROM models_v WHERE status IN ('deprecated', 'failed')
              AND created_at < {AS_OF_SQL} - INTERVAL 29 DAY)
SELECT m.model_id, m.model_id IN (SELECT model_id FROM gone) AS removed,
  (SELECT count(*) FROM deployments_v d WHERE d.model_id = m.model_id AND d.model_id NOT IN (SELECT model_id FROM gone))
    AS kept_deployments
FROM models_v m""", "models_v", "deployments_v"))
def f_cleanup_models(spark, sf):
    m = models_view(spark, sf)
    d = deployments_view(spark, sf)
    _, dk, gone = ro.cleanup_models(m, d, AS_OF, 29)
    kept = dk.groupBy("model_id").agg(F.count(F.lit(1)).alias("kept_deployments"))
    return (m.select("model_id").join(gone.withColumn("removed", F.lit(True)), "model_id", "left")
            .join(kept, "model_id", "left")
            .select("model_id", F.coalesce("removed", F.lit(False)).alias("removed"),
                    F.coalesce("kept_deployments", F.lit(0)).alias("kept_deployments")))


@query("f_fine_tuned", with_views("""
SELECT job_id, fine_tuned_model FROM jobs_v WHERE starts_with(fine_tuned_model, 'ft:') AND contains(fine_tuned_model, 'legal')""",
                                  "jobs_v"))
def f_fine_tuned(spark, sf):
    return ro.fine_tuned(jobs_view(spark, sf), "Legal").select("job_id", "fine_tuned_model")


@query("f_domain_progress", with_views("""
SELECT count(*) FILTER (WHERE status = 'succeeded') AS succeeded, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE status = 'running') AS running, count(*) AS total,
  (SELECT string_agg(CAST(job_id AS VARCHAR), ',' ORDER BY created_at DESC, job_id DESC) FROM (
     SELECT * FROM jobs_v WHERE contains(suffix, 'medical') ORDER BY created_at DESC, job_id DESC LIMIT 10)) AS recent_jobs
FROM jobs_v WHERE contains(suffix, 'medical')""", "jobs_v"))
def f_domain_progress(spark, sf):
    counts, top = ro.domain_progress(jobs_view(spark, sf), "medical", 10)
    recent = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        F.unix_micros("created_at").alias("k"), "job_id")), lambda a, b: F.when(a["k"] > b["k"], -1)
        .when(a["k"] < b["k"], 1).otherwise(0)), lambda s: s["job_id"].cast("string")), ",").alias("recent_jobs"))
    return counts.select("succeeded", "failed", "running", "total").crossJoin(recent)


# ----------------------------------------------------------------------------- J8, F19, J10, J11, J18
_PAIRS_SQL = """SELECT parent_model AS model_1, model_id AS model_2 FROM models_v WHERE parent_model IS NOT NULL"""


def _pairs(m):
    return m.filter(F.col("parent_model").isNotNull()).select(F.col("parent_model").alias("model_1"),
                                                               F.col("model_id").alias("model_2"))


@query("f_compare_models", with_views(f"""
WITH p AS ({_PAIRS_SQL}),
d AS (SELECT p.model_1, p.model_2, coalesce(a.metric, b.metric) AS metric, a.value AS v1, b.value AS v2
      FROM p JOIN model_metrics_v a ON a.model_id = p.model_1
      FULL OUTER JOIN model_metrics_v b ON b.model_id = p.model_2 AND b.metric = a.metric
      WHERE a.model_id IS NOT NULL
      UNION
      SELECT p.model_1, p.model_2, b.metric, a.value, b.value
      FROM p JOIN model_metrics_v b ON b.model_id = p.model_2
      LEFT JOIN model_metrics_v a ON a.model_id = p.model_1 AND a.metric = b.metric),
per AS (SELECT model_1, model_2,
          string_agg(metric || '=' || CAST(CAST(floor((coalesce(v2, 0.0) - coalesce(v1, 0.0)) * 1e6) AS BIGINT) AS VARCHAR), ',' ORDER BY metric)
            AS performance_diff,
          coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (WHERE v2 IS NOT NULL AND v2 > coalesce(v1, 0.0)), '')
            AS improvement_areas,
          coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (WHERE v2 IS NOT NULL AND v2 < coalesce(v1, 0.0)), '')
            AS regression_areas
        FROM d GROUP BY model_1, model_2),
q AS (SELECT p.model_1, p.model_2, m2.feedback_score - m1.feedback_score AS fd, m2.error_rate - m1.error_rate AS ed,
        m2.latency_p95 - m1.latency_p95 AS ld, m2.usage_count / greatest(m1.usage_count, 1) AS ur,
        m2.cost_per_request - m1.cost_per_request AS cd
      FROM p JOIN models_v m1 ON m1.model_id = p.model_1 JOIN models_v m2 ON m2.model_id = p.model_2),
s AS (SELECT *, (CASE WHEN fd > 0 THEN 3 ELSE 0 END + CASE WHEN ed < 0 THEN 2 ELSE 0 END + CASE WHEN ld < 0 THEN 2 ELSE 0 END
               + CASE WHEN cd < 0 THEN 1 ELSE 0 END + CASE WHEN ur > 1.2 THEN 1 ELSE 0 END) AS s2,
        (CASE WHEN fd > 0 THEN 0 ELSE 3 END + CASE WHEN ed < 0 THEN 0 ELSE 2 END + CASE WHEN ld < 0 THEN 0 ELSE 2 END
               + CASE WHEN cd < 0 THEN 0 ELSE 1 END + CASE WHEN ur < 0.8 THEN 1 ELSE 0 END) AS s1 FROM q)
SELECT s.model_1, s.model_2, round(fd, 6) AS feedback_score_diff, round(ed, 6) AS error_rate_diff,
  round(ld, 6) AS latency_diff, round(ur, 6) AS usage_ratio, round(cd, 9) AS cost_per_request_diff,
  per.performance_diff, per.improvement_areas, per.regression_areas,
  CASE WHEN s2 > s1 THEN 'Recommend ' || s.model_2 || ': Better overall performance and metrics'
       WHEN s1 > s2 THEN 'Recommend ' || s.model_1 || ': Better overall performance and metrics'
       ELSE 'Models are comparable, consider specific use case requirements' END AS recommendation
FROM s JOIN per USING (model_1, model_2)""", "model_metrics_v"))
def f_compare_models(spark, sf):
    m = models_view(spark, sf)
    c = ro.compare_models(m, _pairs(m))
    pd_ = F.array_join(F.transform("performance_diff", lambda x: F.concat(
        x["metric"], F.lit("="), F.floor(x["diff"] * 1e6).cast("long").cast("string"))), ",")
    return c.select("model_1", "model_2", _r("feedback_score_diff").alias("feedback_score_diff"),
                    _r("error_rate_diff").alias("error_rate_diff"), _r("latency_diff").alias("latency_diff"),
                    _r("usage_ratio").alias("usage_ratio"), _r("cost_per_request_diff", 9).alias("cost_per_request_diff"),
                    pd_.alias("performance_diff"), F.array_join("improvement_areas", ",").alias("improvement_areas"),
                    F.array_join("regression_areas", ",").alias("regression_areas"), "recommendation")


@query("f_active_models", with_views("""
SELECT domain, model_id, version FROM models_v WHERE status = 'deployed'""", "models_v"))
def f_active_models(spark, sf):
    m = models_view(spark, sf)
    active = m.filter(F.col("status") == "deployed").select("domain", "model_id")
    return ro.active_models(m, active).select("domain", "model_id", "version")


@query("f_rollback", with_views("""
WITH t AS (SELECT d.* FROM deployments_v d WHERE deployment_id IN (
             SELECT max(deployment_id) FROM deployments_v GROUP BY domain)),
prev AS (SELECT domain, arg_max(model_id, coalesce(CAST(deployed_at AS VARCHAR), '') || model_id) AS restore
         FROM models_v WHERE status = 'deprecated' GROUP BY domain),
r AS (SELECT t.model_id AS rolled, prev.restore FROM t JOIN prev USING (domain))
SELECT m.model_id, m.model_id IN (SELECT restore FROM r) AS restored, m.model_id IN (SELECT rolled FROM r) AS rolled_back,
  CASE WHEN m.model_id IN (SELECT restore FROM r) THEN 'deployed' WHEN m.model_id IN (SELECT rolled FROM r) THEN 'rollback'
       ELSE m.status END AS status
FROM models_v m""", "models_v", "deployments_v"))
def f_rollback(spark, sf):
    d = deployments_view(spark, sf)
    targets = d.groupBy("domain").agg(F.max("deployment_id").alias("deployment_id"))
    r = ro.rollback(d, models_view(spark, sf), targets)
    return r.select("model_id", "restored", "rolled_back", "status")


@query("f_rollback_to_replaced", with_views("""
WITH h AS (SELECT *, lag(model_id) OVER (PARTITION BY domain ORDER BY deployed_at, deployment_id) AS replaced
           FROM deployments_v WHERE status = 'deployed'),
t AS (SELECT * FROM h WHERE deployment_id IN (SELECT max(deployment_id) FROM deployments_v WHERE status = 'deployed' GROUP BY domain)
      AND replaced IS NOT NULL AND replaced <> model_id)
SELECT m.model_id, m.model_id IN (SELECT replaced FROM t) AS restored, m.model_id IN (SELECT model_id FROM t) AS rolled_back,
  CASE WHEN m.model_id IN (SELECT replaced FROM t) THEN 'deployed' WHEN m.model_id IN (SELECT model_id FROM t) THEN 'rollback'
       ELSE m.status END AS status
FROM models_v m""", "models_v", "deployments_v"))
def f_rollback_to_replaced(spark, sf):
    d = deployments_view(spark, sf)
    targets = d.filter(F.col("status") == "deployed").groupBy("domain").agg(F.max("deployment_id").alias("deployment_id"))
    r = ro.rollback_to_replaced(d, models_view(spark, sf), targets)
    return r.select("model_id", "restored", "rolled_back", "status")


@query("f_promote", with_views(f"""
WITH chosen AS (SELECT domain, model_id FROM models_v WHERE version_no = 3 AND {_PROMO_SQL}),
old AS (SELECT m.domain, m.model_id FROM models_v m JOIN chosen USING (domain) WHERE m.status = 'deployed')
SELECT m.domain, m.model_id, m.model_id IN (SELECT model_id FROM chosen) AS promoted,
  CASE WHEN m.model_id IN (SELECT model_id FROM chosen) THEN 'deployed' WHEN m.model_id IN (SELECT model_id FROM old) THEN 'deprecated'
       ELSE m.status END AS status,
  CASE WHEN m.domain IN (SELECT domain FROM chosen) THEN m.model_id IN (SELECT model_id FROM chosen) ELSE m.status = 'deployed' END AS active
FROM models_v m""", "models_v"))
def f_promote(spark, sf):
    """The third model of each domain is proposed; those that pass P-8 take over."""
    m = models_view(spark, sf)
    active = m.filter(F.col("status") == "deployed").select("domain", "model_id")
    after, now = ro.promote(m, active, m.filter(F.col("version_no") == 3), thresholds=TEST_THRESHOLDS)
    now = now.select("model_id", F.lit(True).alias("active"))
    return after.join(now, "model_id", "left").select("domain", "model_id", "promoted", "status",
                                                      F.coalesce("active", F.lit(False)).alias("active"))


@query("f_deployment_effect", with_views("""
SELECT h.deployment_id, h.model_id, h.replaced AS replaced_model, round(b.feedback_score, 6) AS performance_before,
  round(a.feedback_score, 6) AS performance_after, round(a.feedback_score - b.feedback_score, 6) AS performance_change
FROM (SELECT *, lag(model_id) OVER (PARTITION BY domain ORDER BY deployed_at, deployment_id) AS replaced
      FROM deployments_v WHERE status = 'deployed') h
LEFT JOIN models_v a ON a.model_id = h.model_id LEFT JOIN models_v b ON b.model_id = h.replaced""", "models_v", "deployments_v"))
def f_deployment_effect(spark, sf):
    v = models_view(spark, sf).select("model_id", F.col("feedback_score").alias("value"))
    e = ro.deployment_effect(deployments_view(spark, sf), v)
    return e.select("deployment_id", "model_id", "replaced_model", *[F.round(c, 6).alias(c) for c in
                    ("performance_before", "performance_after", "performance_change")])


@query("f_active_at", with_views("""
SELECT domain, arg_max(model_id, CAST(deployed_at AS VARCHAR) || lpad(CAST(deployment_id AS VARCHAR), 20, '0')) AS model_id
FROM deployments_v WHERE status = 'deployed' AND deployed_at <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY domain""", "deployments_v"))
def f_active_at(spark, sf):
    return ro.active_at(deployments_view(spark, sf), "2024-01-15 12:00:00")


@query("f_domain_listing", with_views(f"""
SELECT dom.domain, dom.domain_name, a.model_id AS active_model, a.status, a.version, coalesce(n.models, 0) AS models,
  coalesce(x.adapters, 0) AS adapters, a.model_id IS NOT NULL AS is_active
FROM {domains_values_sql(("domain", "domain_name"))}
LEFT JOIN (SELECT * FROM models_v WHERE status = 'deployed') a ON a.domain = dom.domain
LEFT JOIN (SELECT domain, count(*) AS models FROM models_v GROUP BY domain) n ON n.domain = dom.domain
LEFT JOIN (SELECT domain, count(DISTINCT adapter_id) AS adapters FROM mentor_v GROUP BY domain) x ON x.domain = dom.domain""",
                                      "models_v", "mentor_v"))
def f_domain_listing(spark, sf):
    m = models_view(spark, sf)
    active = m.filter(F.col("status") == "deployed").select("domain", "model_id")
    return ro.domain_listing(domains_df(spark), m, active, mentor_view(spark, sf).select("domain", "adapter_id"))


_MODEL_LOG_SQL = """
SELECT CASE user_id % 4 WHEN 0 THEN 'technical' WHEN 1 THEN 'medical' WHEN 2 THEN 'legal' ELSE 'financial' END
    || '_m' || CAST(user_id % 3 AS VARCHAR) AS model_id, ts, event_id AS seq,
  CASE event_type WHEN 'signup' THEN 'deployed' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'validating'
    WHEN 'purchase' THEN 'training' END AS status,
  CASE WHEN event_type = 'click' THEN 'k' || CAST(CAST(floor(value) AS BIGINT) % 3 AS VARCHAR) END AS metric,
  CASE WHEN event_type = 'click' THEN value END AS value
FROM events"""


def _model_log(spark, sf):
    e = table(spark, sf, "events")
    et = F.col("event_type")
    return e.select(F.concat(_domain_of(F.col("user_id")), F.lit("_m"), (F.col("user_id") % 3).cast("string")).alias("model_id"),
                    F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
                    F.when(et == "signup", "deployed").when(et == "error", "failed").when(et == "view", "validating")
                    .when(et == "purchase", "training").alias("status"),
                    F.when(et == "click", F.concat(F.lit("k"), (F.floor("value").cast("long") % 3).cast("string"))).alias("metric"),
                    F.when(et == "click", F.col("value")).alias("value"))


@query("f_model_state", f"""
WITH l AS ({_MODEL_LOG_SQL}),
st AS (SELECT model_id, arg_max(status, ts) AS status, max(ts) FILTER (WHERE status = 'deployed') AS deployed_at,
         max(ts) AS last_updated FROM l WHERE status IS NOT NULL GROUP BY model_id),
mt AS (SELECT model_id, string_agg(metric || '=' || CAST(CAST(floor(v * 1e6) AS BIGINT) AS VARCHAR), ',' ORDER BY metric) AS metrics FROM (
         SELECT model_id, metric, arg_max(value, ts) AS v FROM l WHERE metric IS NOT NULL GROUP BY model_id, metric)
       GROUP BY model_id)
SELECT st.model_id, st.status, st.deployed_at, st.last_updated, mt.metrics FROM st LEFT JOIN mt USING (model_id)""")
def f_model_state(spark, sf):
    s = ro.model_state(_model_log(spark, sf))
    return s.select("model_id", "status", "deployed_at", "last_updated",
                    F.array_join(F.transform(F.map_entries("performance_metrics"), lambda x: F.concat(
                        x["key"], F.lit("="), F.floor(x["value"] * 1e6).cast("long").cast("string"))), ",").alias("metrics"))


@query("f_registry_merge", with_views("""
WITH old AS (SELECT model_id, status, created_at AS last_updated FROM models_v),
new AS (SELECT CASE user_id % 4 WHEN 0 THEN 'technical' WHEN 1 THEN 'medical' WHEN 2 THEN 'legal' ELSE 'financial' END
          || '_m' || CAST(user_id % 3 AS VARCHAR) AS model_id, 'failed' AS status, max(ts) AS last_updated
        FROM events WHERE event_type = 'error' GROUP BY 1),
u AS (SELECT *, 0 AS src FROM old UNION ALL SELECT *, 1 FROM new)
SELECT model_id, arg_max(status, last_updated::VARCHAR || src) AS status, max(last_updated) AS last_updated
FROM u GROUP BY model_id""", "models_v"))
def f_registry_merge(spark, sf):
    old = models_view(spark, sf).select("model_id", "status", F.col("created_at").alias("last_updated"))
    e = table(spark, sf, "events").filter(F.col("event_type") == "error")
    new = e.groupBy(F.concat(_domain_of(F.col("user_id")), F.lit("_m"), (F.col("user_id") % 3).cast("string"))
                    .alias("model_id")).agg(F.max(F.col("ts").cast("timestamp")).alias("last_updated")) \
        .withColumn("status", F.lit("failed"))
    return ro.merge_registry(old, new).select("model_id", "status", "last_updated")


_MODEL_SQL = ("CASE user_id % 4 WHEN 0 THEN 'technical' WHEN 1 THEN 'medical' WHEN 2 THEN 'legal' ELSE 'financial' END"
              " || '_m' || CAST(user_id % 3 AS VARCHAR)")


@query("f_registry_document", f"""
WITH e AS (SELECT *, {_MODEL_SQL} AS model FROM events),
m AS (SELECT model, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, max(event_id) AS last,
        max(event_id) FILTER (WHERE event_type = 'purchase') AS sold FROM e GROUP BY model),
s AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE lang = 'de') AS de FROM documents GROUP BY source),
a AS (SELECT user_id % 5 AS i, count(*) AS n FROM events GROUP BY 1)
SELECT 'models' AS section, model AS key, 'metrics.errors' AS path, errors::VARCHAR AS value FROM m WHERE errors > 0
UNION ALL SELECT 'models', model, 'metrics.requests', n::VARCHAR FROM m
UNION ALL SELECT 'models', model, 'status', CASE WHEN errors > 0 THEN 'failed' ELSE 'deployed' END FROM m
UNION ALL SELECT 'deployments', model, 'at.0', coalesce(sold, last)::VARCHAR FROM m
UNION ALL SELECT 'templates', source, 'uses.all', n::VARCHAR FROM s
UNION ALL SELECT 'templates', source, 'uses.de', de::VARCHAR FROM s WHERE de > 0
UNION ALL SELECT 'adapters', 'ad' || i, 'uses', (n + 1)::VARCHAR FROM a
UNION ALL SELECT 'thresholds', 'min_feedback_score', '', '4.5'
UNION ALL SELECT 'thresholds', 'max_error_rate', '', '0.05'
UNION ALL SELECT 'last_saved', NULL, '', 'later'""")
def f_registry_document(spark, sf):
    """Two registry documents of all kinds, written from the tables, read and merged (the second has
    other members of models and templates, and replaces lists and numbers), written as one document again and
    read back; one row for each value."""
    ev = table(spark, sf, "events").withColumn("model", F.concat(_domain_of(F.col("user_id")), F.lit("_m"), (F.col("user_id") % 3).cast("string")))
    kind = F.col("event_type")
    m = ev.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if(kind == "error").alias("errors"), F.max("event_id").alias("last"),
                                F.max(F.when(kind == "purchase", F.col("event_id"))).alias("sold"))
    s = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == "de").alias("de"))
    a = ev.groupBy((F.col("user_id") % 5).alias("i")).agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("ad"), F.col("i").cast("string")).alias("i"), "n")
    bad = m.filter("errors > 0")

    def document(parts, *alone):
        found = spark.createDataFrame(list(alone), "section string, key string, body string")
        for df, section, key in parts:
            found = found.unionByName(ro.registry_entries(df, section, key))
        return found
    first = document([(m.select("model", F.lit("deployed").alias("status"), F.struct(F.col("n").alias("requests")).alias("metrics")), "models", "model"),
                      (m.select("model", F.array("last").alias("at")), "deployments", "model"),
                      (s.select("source", F.struct(F.col("n").alias("all")).alias("uses")), "templates", "source"),
                      (a.select("i", F.col("n").alias("uses")), "adapters", "i")],
                     ("thresholds", "min_feedback_score", "4.0"), ("thresholds", "max_error_rate", "0.05"), ("last_saved", None, '"earlier"'))
    second = document([(bad.select("model", F.lit("failed").alias("status"), F.struct("errors").alias("metrics")), "models", "model"),
                       (m.filter("sold is not null").select("model", F.array("sold").alias("at")), "deployments", "model"),
                       (s.filter("de > 0").select("source", F.struct("de").alias("uses")), "templates", "source"),
                       (a.select("i", (F.col("n") + 1).alias("uses")), "adapters", "i")],
                      ("thresholds", "min_feedback_score", "4.5"), ("last_saved", None, '"later"'))
    root = stream_root(spark)
    write_registry_document(first, f"{root}/first")
    write_registry_document(second, f"{root}/second")
    write_registry_document(read_registry_document(spark, f"{root}/first", f"{root}/second"), f"{root}/merged")
    back = read_registry_document(spark, f"{root}/merged")
    return back.select("section", "key", F.explode(ro.leaves("body")).alias("x")).select("section", "key", "x.path", "x.value")


# ----------------------------------------------------------------------------- W8–W11
@query("f_latest_deployment", with_views("""
SELECT model_id, arg_max(deployment_id, deployed_at) AS latest_deployment_id, arg_max(status, deployed_at) AS latest_status,
  max(deployed_at) AS latest_deployed_at, count(*) AS deployments
FROM deployments_v GROUP BY model_id""", "deployments_v"))
def f_latest_deployment(spark, sf):
    return ro.latest_deployment(deployments_view(spark, sf))


@query("f_promotion_history", with_views("""
SELECT deployment_id, domain, model_id,
  lag(model_id) OVER (PARTITION BY domain ORDER BY deployed_at, deployment_id) AS replaced_model,
  row_number() OVER (PARTITION BY domain ORDER BY deployed_at, deployment_id) AS promotion_no
FROM deployments_v WHERE status = 'deployed'""", "deployments_v"))
def f_promotion_history(spark, sf):
    p = ro.promotion_history(deployments_view(spark, sf))
    return p.select("deployment_id", "domain", "model_id", "replaced_model",
                    F.col("promotion_no").cast("long").alias("promotion_no"))


@query("f_version_bump", with_views("""
SELECT c.domain, '1.' || CAST(0 + coalesce(n.k, 0) AS VARCHAR) AS new_version
FROM (SELECT DISTINCT domain FROM jobs_v) c
LEFT JOIN (SELECT domain, count(*) AS k FROM jobs_v WHERE status = 'succeeded' GROUP BY domain) n USING (domain)""",
                                     "jobs_v"))
def f_version_bump(spark, sf):
    j = jobs_view(spark, sf)
    cfg = j.select("domain").distinct().withColumn("version", F.lit("1.0"))
    return ro.bump_version(cfg, j.filter(F.col("status") == "succeeded")).select("domain", "new_version")


@query("f_adapter_usage", with_views("""
SELECT 'ad' || CAST(user_id % 5 AS VARCHAR) AS adapter_id, count(*) AS usage_count, max(ts) AS last_used
FROM events GROUP BY 1"""))
def f_adapter_usage(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.lit("ad"), (F.col("user_id") % 5).cast("string")).alias("adapter_id"),
                                          F.col("ts").cast("timestamp").alias("ts"))
    return ro.adapter_usage(e)


# ----------------------------------------------------------------------------- A15, A16, W3, T11, J14, S10
@query("f_learning_metrics", with_views("""
SELECT domain, count(*) AS total_cycles, count(*) FILTER (WHERE phase = 'complete') AS successful_cycles,
  round(coalesce(avg(improvement) FILTER (WHERE phase = 'complete'), 0.0), 6) AS average_improvement,
  max(coalesce(completed_at, updated_at)) AS last_cycle
FROM cycles_v GROUP BY domain""", "cycles_v"))
def f_learning_metrics(spark, sf):
    m = ro.learning_metrics(cycles_view(spark, sf))
    return m.select("domain", "total_cycles", "successful_cycles", _r("average_improvement").alias("average_improvement"),
                    "last_cycle")


@query("f_learning_status", with_views("""
SELECT d.domain, coalesce(a.n, 0) AS active_cycles, coalesce(c.n, 0) AS completed_cycles
FROM (VALUES ('technical'), ('medical'), ('legal'), ('financial')) d(domain)
LEFT JOIN (SELECT domain, count(*) AS n FROM cycles_v WHERE completed_at > TIMESTAMP '2024-01-30 12:00:00' GROUP BY domain) a
  USING (domain)
LEFT JOIN (SELECT domain, count(*) AS n FROM cycles_v WHERE completed_at <= TIMESTAMP '2024-01-30 12:00:00' GROUP BY domain) c
  USING (domain)""", "cycles_v"))
def f_learning_status(spark, sf):
    s = ro.learning_status(cycles_view(spark, sf), domains_df(spark), "2024-01-30 12:00:00")
    return s.select("domain", "active_cycles", "completed_cycles")


@query("f_performance_decline", with_views("""
SELECT domain, round(decline, 6) AS decline, decline > 0.0005 AS declining, decline > 0.005 AS triggered FROM (
  SELECT domain, CASE WHEN count(*) < 2 THEN 0.0 ELSE greatest(0.0,
    coalesce(sum(overall_score) FILTER (WHERE k > 5 AND k <= 10), 0.0) / greatest(count(*) FILTER (WHERE k > 5 AND k <= 10), 1)
    - avg(overall_score) FILTER (WHERE k <= 5)) END AS decline
  FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY day DESC) AS k FROM history_v) GROUP BY domain)""",
                                           "history_v"))
def f_performance_decline(spark, sf):
    d = ro.performance_decline(history_view(spark, sf), flag=0.0005, trigger=0.005)
    return d.select("domain", _r("decline").alias("decline"), (F.col("trend") == "declining").alias("declining"),
                    "triggered")


_CYCLE_EVENTS_SQL = """
SELECT event_id, CAST(user_id AS VARCHAR) || '_' || CAST(CAST(ts AS DATE) AS VARCHAR) AS cycle_id, ts, event_id AS seq,
  CASE event_type WHEN 'signup' THEN 'monitoring' WHEN 'view' THEN 'analysis' WHEN 'click' THEN 'data_generation'
    WHEN 'purchase' THEN 'training' ELSE 'failed' END AS phase
FROM events"""


@query("f_cycle_timeline", f"""
SELECT event_id, cycle_id, phase,
  round(epoch_us(lead(ts) OVER (PARTITION BY cycle_id ORDER BY ts, seq)) / 1e6 - epoch_us(ts) / 1e6, 3) AS seconds_in_phase,
  arg_max(phase, ts) OVER (PARTITION BY cycle_id) AS final_phase
FROM ({_CYCLE_EVENTS_SQL})""")
def f_cycle_timeline(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    et = F.col("event_type")
    ev = e.select("event_id", F.concat(F.col("user_id").cast("string"), F.lit("_"), F.to_date("ts").cast("string")).alias("cycle_id"),
                  "ts", F.col("event_id").alias("seq"),
                  F.when(et == "signup", "monitoring").when(et == "view", "analysis").when(et == "click", "data_generation")
                  .when(et == "purchase", "training").otherwise("failed").alias("phase"))
    t = ro.cycle_timeline(ev)
    return t.select("event_id", "cycle_id", "phase", _r("seconds_in_phase", 3).alias("seconds_in_phase"), "final_phase")


@query("f_model_improvement", with_views("""
SELECT domain, round(o, 6) AS old_success_rate, round(n, 6) AS new_success_rate, round(coalesce(n - o, 0.0), 6)
  AS overall_improvement, coalesce(n - o, 0.0) >= 0.005 AS improved FROM (
  SELECT domain, avg(CASE WHEN error THEN 0.0 ELSE 1.0 END) FILTER (WHERE model_id LIKE '%_m0') AS o,
    avg(CASE WHEN error THEN 0.0 ELSE 1.0 END) FILTER (WHERE model_id NOT LIKE '%_m0') AS n
  FROM requests_v GROUP BY domain)""", "requests_v"))
def f_model_improvement(spark, sf):
    r = requests_view(spark, sf)
    res = r.select(
        "domain", F.when(F.col("model_id").endswith("_m0"), "old").otherwise("new").alias("which"), "error")
    v = ro.validate_improvement(res, 0.005)
    return v.select("domain", _r("old_success_rate").alias("old_success_rate"),
                    _r("new_success_rate").alias("new_success_rate"),
                    _r("overall_improvement").alias("overall_improvement"), "improved")


@query("f_last_cycles", with_views("""
SELECT cycle_id, created_at FROM cycles_v ORDER BY created_at DESC, cycle_id DESC LIMIT 100""", "cycles_v"))
def f_last_cycles(spark, sf):
    return ro.last_cycles(cycles_view(spark, sf), 100).select("cycle_id", "created_at")


# ----------------------------------------------------------------------------- P-17, J19, J9
def _configs(spark, sf):
    """Domain configurations: threshold, interval, last training (latest succeeded job)."""
    j = jobs_view(spark, sf).filter(F.col("status") == "succeeded")
    last = j.groupBy("domain").agg(F.max("created_at").alias("last_training_date"))
    return (domains_df(spark).select("domain").join(last, "domain", "left")
            .withColumn("performance_threshold", F.lit(2.97)).withColumn("retraining_interval_days", F.lit(1)))


_CFG_SQL = """
SELECT d.domain, l.last_training_date, 2.97 AS performance_threshold, 1 AS retraining_interval_days
FROM (VALUES ('technical'), ('medical'), ('legal'), ('financial')) d(domain)
LEFT JOIN (SELECT domain, max(created_at) AS last_training_date FROM jobs_v
           WHERE status = 'succeeded' GROUP BY domain) l USING (domain)"""


_NEEDS_SQL = f"""
WITH c AS ({_CFG_SQL}),
a AS (SELECT domain, avg(rating) AS average_rating FROM feedback_v WHERE rating IS NOT NULL GROUP BY domain),
p AS (SELECT domain, count(*) AS pending_count FROM feedback_v WHERE NOT processed GROUP BY domain)
SELECT c.domain, coalesce(a.average_rating, 0.0) AS average_rating, coalesce(p.pending_count, 0) AS pending_count,
  CAST(floor((epoch_us({AS_OF_SQL}) - epoch_us(c.last_training_date)) / 86400000000) AS BIGINT) AS days_since_training,
  coalesce(a.average_rating, 0.0) < c.performance_threshold
    OR coalesce(floor((epoch_us({AS_OF_SQL}) - epoch_us(c.last_training_date)) / 86400000000) >= c.retraining_interval_days, false)
    OR coalesce(p.pending_count, 0) >= 20 AS needs_retraining
FROM c LEFT JOIN a USING (domain) LEFT JOIN p USING (domain)"""


@query("f_needs_retraining", with_views(f"""
SELECT domain, round(average_rating, 6) AS average_rating, pending_count, days_since_training, needs_retraining
FROM ({_NEEDS_SQL})""", "feedback_v", "jobs_v"))
def f_needs_retraining(spark, sf):
    n = ro.needs_retraining(_configs(spark, sf), feedback_view(spark, sf), AS_OF, 20)
    return n.select("domain", _r("average_rating").alias("average_rating"), "pending_count", "days_since_training",
                    "needs_retraining")


@query("f_retraining_plan", with_views(f"""
WITH n AS ({_NEEDS_SQL})
SELECT n.domain, n.pending_count,
  (SELECT count(*) FROM feedback_v f WHERE f.domain = n.domain AND NOT f.processed AND f.rating < 3.0
     AND f.expected_output IS NOT NULL AND f.expected_output <> '') AS training_examples
FROM n WHERE n.needs_retraining""", "feedback_v", "jobs_v"))
def f_retraining_plan(spark, sf):
    fb = feedback_view(spark, sf)
    n = ro.needs_retraining(_configs(spark, sf), fb, AS_OF, 20).filter("needs_retraining")
    cfg = domains_df(spark).select("domain", F.col("description").alias("context_paragraph"))
    ex = fo.examples_from_feedback(fb.join(n.select("domain"), "domain", "left_semi"), cfg)
    cnt = ex.groupBy("domain").agg(F.count(F.lit(1)).alias("training_examples"))
    return n.select("domain", "pending_count").join(cnt, "domain", "left") \
        .withColumn("training_examples", F.coalesce("training_examples", F.lit(0)))


@query("f_domain_status", with_views(f"""
WITH n AS ({_NEEDS_SQL}),
act AS (SELECT domain, model_id FROM models_v WHERE status = 'deployed'),
b AS (SELECT domain, avg(rating) AS recent_avg_rating FROM feedback_v WHERE NOT processed AND rating IS NOT NULL GROUP BY domain)
SELECT n.domain, act.model_id, n.pending_count, round(b.recent_avg_rating, 6) AS recent_avg_rating, n.needs_retraining
FROM n LEFT JOIN act USING (domain) LEFT JOIN b USING (domain)""", "feedback_v", "jobs_v", "models_v"))
def f_domain_status(spark, sf):
    fb = feedback_view(spark, sf)
    n = ro.needs_retraining(_configs(spark, sf), fb, AS_OF, 20)
    act = models_view(spark, sf).filter(F.col("status") == "deployed").select("domain", "model_id")
    b = fo.batch_feedback(fb).select("domain", "recent_avg_rating")
    return (n.join(act, "domain", "left").join(b, "domain", "left")
            .select("domain", "model_id", "pending_count", _r("recent_avg_rating").alias("recent_avg_rating"),
                    "needs_retraining"))

"""Model-registry and learning-cycle operators (SURVEY §2.2 P-7…P-12, P-17, §2.3 J8, J10, J11,
J14, J18, J19, §2.4 A13–A16, A28, §2.5 W1, W3, W8–W11, §2.8 F19, §2.1 S8, S10, §2.9 T7, T11).

Registry tables (models, deployments, jobs, cycles) are metadata-sized: one row per model or
deployment, so per-domain windows over them are fine. Request logs are data-sized: their
aggregates are partial/final hash aggregates and their percentiles come from counts of distinct
values, narrowed to small buckets first (no group is collected into one task).
"""
from __future__ import annotations

import json
from typing import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import whole_days_between
from quarry.operators.feedback import pending
from quarry.plans.ordinal import scan
from quarry.plans.tables import written
from quarry.plans.topk import top_k_rows

PROMOTION_THRESHOLDS = {
    # FIXED VALUES: default promotion thresholds.
    "min_feedback_score": 4.0, "max_error_rate": 0.05, "max_latency_p95": 2000.0,
    "min_usage_threshold": 100,
}
MODEL_STATUSES = ["training", "validating", "deployed", "deprecated", "failed", "rollback"]
DEPLOYMENT_STATUSES = ["pending", "in_progress", "deployed", "failed", "rolled_back"]
CYCLE_PHASES = ["monitoring", "analysis", "data_generation", "training", "validation", "deployment",
                "complete", "failed"]


def _ts(x) -> Column:
    return F.lit(x).cast("timestamp") if isinstance(x, str) else x


# ----------------------------------------------------------------------------- percentiles
def exact_percentile(df: DataFrame, group_by: Sequence[str], value: str, q: float,
                     out: str = "percentile") -> DataFrame:
    """Exact percentile with linear interpolation (as `percentile` / `quantile_cont`) per group."""
    return exact_percentiles(df, group_by, value, {out: q})


BUCKETS = 64             # parts that one step of the descent cuts a range of values into
RANKED = 100_000         # distinct values that are ranked in one window, at most about


def _narrowed(counts: DataFrame, keys: list[str], spots: DataFrame, level: int) -> tuple[DataFrame, list[str], DataFrame]:
    """One step of the descent: cut the values of each group (`keys`) into BUCKETS by approximate
    quantiles, and keep the buckets that hold a wanted rank. A kept bucket is a group of the next step,
    with ranks counted from its first row."""
    b = f"_b{level}"
    bounds = counts.groupBy(*keys).agg(F.percentile_approx("_v", [i / BUCKETS for i in range(1, BUCKETS)], 1000).alias("_bounds"))
    dealt = counts.join(bounds, keys).withColumn(b, F.size(F.filter("_bounds", lambda x: x < F.col("_v")))).drop("_bounds")
    sums = dealt.groupBy(*keys, b).agg(F.sum("_c").alias("_s"))          # BUCKETS rows for each group
    sums = sums.withColumn("_before", F.sum("_s").over(Window.partitionBy(*keys).orderBy(b)) - F.col("_s"))
    inside = (F.col("_k") >= F.col("_before")) & (F.col("_k") < F.col("_before") + F.col("_s"))
    spots = spots.join(sums, keys).filter(inside).withColumn("_k", F.col("_k") - F.col("_before")).drop("_before", "_s")
    return dealt.join(spots.select(*keys, b).distinct(), [*keys, b]), [*keys, b], spots


def exact_percentiles(df: DataFrame, group_by: Sequence[str], value: str, wanted: Mapping[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation per group, for all of `wanted` (name → q) together.
    Equal values are counted first, on the map side, so ties cost one row; the counts are written once.
    Groups with at most RANKED distinct values are ranked by one window. With more, a descent narrows
    the ranks around q·(n−1) down to buckets of about RANKED values first: each step cuts a range
    BUCKETS-fold, and the number of steps follows from the largest group's distinct values."""
    keys = list(group_by) or ["_all"]
    df = df if group_by else df.withColumn("_all", F.lit(0))
    counts = written(df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
                     .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")), "value-counts")
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_d"))
    most = sizes.agg(F.max("_d")).first()[0] or 0
    rank = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), (F.lit(float(q)) * (F.col("_n") - 1)).alias("r")) for o, q in wanted.items()]))
    wants = sizes.filter("_n > 0").withColumn("_w", rank).select(*keys, "_w.o", "_w.r", F.explode(F.array(F.floor("_w.r"), F.ceil("_w.r"))).alias("_k0"))
    spots, at, level = wants.select(*keys, "_k0").distinct().withColumn("_k", F.col("_k0")), list(keys), 0
    narrow = counts
    while most > RANKED:
        narrow, at, spots = _narrowed(narrow, at, spots, level)
        most, level = most // (BUCKETS - 12) + 1, level + 1              # a bucket may be a little over its share
    upto = F.sum("_c").over(Window.partitionBy(*at).orderBy("_v"))
    placed = narrow.select(*at, "_v", upto.alias("_upto"), (upto - F.col("_c")).alias("_from"))
    found = placed.join(spots, at).filter((F.col("_from") <= F.col("_k")) & (F.col("_k") < F.col("_upto"))).select(*keys, "_k0", "_v")
    both = wants.join(found, [*keys, "_k0"]).groupBy(*keys, "o", "r").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    both = both.withColumn("_p", F.col("_lo") + (F.col("r") - F.floor("r")) * (F.col("_hi") - F.col("_lo")))
    found = both.groupBy(*keys).agg(*[F.max(F.when(F.col("o") == o, F.col("_p"))).alias(o) for o in wanted])
    return found.select(*group_by, *wanted)


# ----------------------------------------------------------------------------- A13, A14, A28
def request_metrics(requests: DataFrame, group_by: Sequence[str] = ("domain", "model_id"),
                    p95_exact: bool = True) -> DataFrame:
    """Feedback score, usage, error rate, p95 latency, cost per request per model from a
    request log (rating, error, latency_ms, cost). `p95_exact=False` uses the mergeable
    approximate sketch instead of the exact distributed percentile."""
    g = requests.groupBy(*group_by).agg(
        F.coalesce(F.avg("rating"), F.lit(0.0)).alias("feedback_score"),
        F.count(F.lit(1)).alias("usage_count"),
        F.avg(F.col("error").cast("double")).alias("error_rate"),
        (F.sum("cost") / F.count(F.lit(1))).alias("cost_per_request"))
    if p95_exact:
        p = exact_percentile(requests, group_by, "latency_ms", 0.95, "latency_p95")
    else:
        p = requests.groupBy(*group_by).agg(F.percentile_approx("latency_ms", 0.95, 10000)
                                            .cast("double").alias("latency_p95"))
    return g.join(p, list(group_by), "left")


def usage(requests: DataFrame, group_by: Sequence[str] = ("domain",)) -> DataFrame:
    """Requests and tokens per domain (missing tokens count 0)."""
    return requests.groupBy(*group_by).agg(F.count(F.lit(1)).alias("total_requests"),
                                           F.sum(F.coalesce("tokens", F.lit(0))).cast("long").alias("total_tokens"))


def usage_windows(requests: DataFrame, window: str = "1 hour", group_by: Sequence[str] = ("domain",)) -> DataFrame:
    """T9 batch twin: requests and tokens per tumbling window."""
    g = requests.groupBy(*group_by, F.window("ts", window).alias("w")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum(F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"))
    return g.select(*group_by, F.col("w.start").alias("window_start"), "requests", "tokens")


def operation_metrics(log: DataFrame, group_by: Sequence[str] = ("domain", "size_bucket"),
                      duration: str = "duration_ms") -> DataFrame:
    """Operations, success rate, mean / p50 / p95 duration per group (exact percentiles)."""
    g = log.groupBy(*group_by).agg(F.count(F.lit(1)).alias("operations"),
                                   F.avg(F.col("success").cast("double")).alias("success_rate"),
                                   F.avg(duration).alias("mean_ms"))
    p = exact_percentiles(log, group_by, duration, {"p50_ms": 0.5, "p95_ms": 0.95})
    return g.join(p, list(group_by))


# ----------------------------------------------------------------------------- P-7…P-12
def meets_promotion(t: Mapping[str, float] = PROMOTION_THRESHOLDS) -> Column:
    """P-8: feedback ≥ min, error ≤ max, p95 ≤ max, usage ≥ min."""
    return ((F.col("feedback_score") >= t["min_feedback_score"]) & (F.col("error_rate") <= t["max_error_rate"]) &
            (F.col("latency_p95") <= t["max_latency_p95"]) & (F.col("usage_count") >= t["min_usage_threshold"]))


def underperforming(models: DataFrame, t: Mapping[str, float] = PROMOTION_THRESHOLDS) -> DataFrame:
    """P-9: deployed models that fail the promotion test (to be evaluated)."""
    return models.filter((F.col("status") == "deployed") & ~meets_promotion(t))


def domain_models(models: DataFrame, domain: str, status: str | None = None) -> DataFrame:
    """P-7: models of a domain (optionally one status), newest first."""
    m = models.filter(F.col("domain") == domain)
    if status is not None:
        m = m.filter(F.col("status") == status)
    return m.orderBy(F.col("created_at").desc(), F.col("model_id").desc())


def cleanup_models(models: DataFrame, deployments: DataFrame, as_of, days: int = 30):
    """P-10: drop deprecated / failed models created before as_of − days, and their
    deployments. Returns (models kept, deployments kept, removed model ids)."""
    cut = _ts(as_of) - F.make_dt_interval(F.lit(days))
    gone = models.filter(F.col("status").isin("deprecated", "failed") & (F.col("created_at") < cut)).select("model_id")
    return (models.join(gone, "model_id", "left_anti"), deployments.join(gone, "model_id", "left_anti"), gone)


def fine_tuned(models: DataFrame, domain: str | None = None, col: str = "fine_tuned_model") -> DataFrame:
    """P-11: fine-tuned models (`ft:` prefix), optionally only those naming the domain slug."""
    m = models.filter(F.col(col).startswith("ft:"))
    if domain is not None:
        m = m.filter(F.col(col).contains(domain.lower().replace(" ", "-")))
    return m


def domain_progress(jobs: DataFrame, domain: str, recent: int = 10) -> DataFrame:
    """P-12: jobs whose suffix contains the domain: status counts over all, and the `recent`
    most recent jobs (global top-k; TakeOrderedAndProject keeps k rows per task)."""
    j = jobs.filter(F.col("suffix").contains(domain))
    counts = j.agg(*[F.count_if(F.col("status") == s).alias(s) for s in
                     ["succeeded", "failed", "running", "validating_files", "cancelled"]],
                   F.count(F.lit(1)).alias("total"))
    top = j.orderBy(F.col("created_at").desc(), F.col("job_id").desc()).limit(recent)
    return counts, top


def needs_retraining(cfg: DataFrame, fb: DataFrame, as_of, min_pending: int = 20) -> DataFrame:
    """P-17 over all domains: average rating below the threshold, or whole days since the last
    training ≥ interval, or ≥ `min_pending` unprocessed rows."""
    avg = fb.filter(F.col("rating").isNotNull()).groupBy("domain").agg(F.avg("rating").alias("average_rating"))
    pend = pending(fb).groupBy("domain").agg(F.count(F.lit(1)).alias("pending_count"))
    j = cfg.join(avg, "domain", "left").join(pend, "domain", "left").fillna(0, ["pending_count"]) \
        .withColumn("average_rating", F.coalesce("average_rating", F.lit(0.0)))
    days = whole_days_between(F.col("last_training_date"), F.lit(as_of))
    return j.withColumn("days_since_training", days).withColumn(
        "needs_retraining", (F.col("average_rating") < F.col("performance_threshold")) |
        F.coalesce(days >= F.col("retraining_interval_days"), F.lit(False)) | (F.col("pending_count") >= min_pending))


# ----------------------------------------------------------------------------- W1, W8, W9, W10, W11
def with_version(models: DataFrame) -> DataFrame:
    """`v{n}.0.0`, n = registration order within the domain (created_at, model_id); also
    the parent = the previous model of the domain."""
    w = Window.partitionBy("domain").orderBy("created_at", "model_id")
    return (models.withColumn("version_no", F.row_number().over(w))
            .withColumn("version", F.format_string("v%d.0.0", F.col("version_no")))
            .withColumn("parent_model", F.lag("model_id").over(w)))


def latest_deployment(deployments: DataFrame) -> DataFrame:
    """The latest deployment per model (max_by over deployed_at, id), and counts."""
    return deployments.groupBy("model_id").agg(
        F.max_by("deployment_id", F.struct("deployed_at", "deployment_id")).alias("latest_deployment_id"),
        F.max_by("status", F.struct("deployed_at", "deployment_id")).alias("latest_status"),
        F.max("deployed_at").alias("latest_deployed_at"),
        F.count(F.lit(1)).alias("deployments"))


def promotion_history(deployments: DataFrame) -> DataFrame:
    """Successful deployments per domain in time order; each promotes its model and
    deprecates the one active before it. A scan over key ranges: no task sorts a whole domain."""
    d = deployments.filter(F.col("status") == "deployed")
    return scan(d, ["domain"], ["deployed_at", "deployment_id"], "promotion_no", before={"replaced_model": "model_id"})


def active_at(deployments: DataFrame, at) -> DataFrame:
    """The active model of each domain at time `at` (last successful deployment before)."""
    d = deployments.filter((F.col("status") == "deployed") & (F.col("deployed_at") <= _ts(at)))
    return d.groupBy("domain").agg(F.max_by("model_id", F.struct("deployed_at", "deployment_id")).alias("model_id"))


def bump_version(cfg: DataFrame, runs: DataFrame) -> DataFrame:
    """Patch version after the domain's retrainings: last dotted part + number of runs."""
    n = runs.groupBy("domain").agg(F.count(F.lit(1)).alias("retrainings"))
    j = cfg.join(n, "domain", "left").fillna(0, ["retrainings"])
    parts = F.split("version", r"\.")
    last = F.element_at(parts, -1).cast("long") + F.col("retrainings")
    head = F.slice(parts, 1, F.size(parts) - 1)
    return j.withColumn("new_version", F.array_join(F.concat(head, F.array(last.cast("string"))), "."))


def adapter_usage(log: DataFrame) -> DataFrame:
    """Use count and last use per adapter, most used first."""
    return (log.groupBy("adapter_id").agg(F.count(F.lit(1)).alias("usage_count"), F.max("ts").alias("last_used"))
            .orderBy(F.col("usage_count").desc(), F.col("adapter_id")))


# ----------------------------------------------------------------------------- J8, F19, J10, J11, J18
def recommend(q: Column = None) -> Column:
    """points for model 1 and model 2; ties go to model 1 except on usage."""
    fd, ed, ld, cd, ur = (F.col("feedback_score_diff"), F.col("error_rate_diff"), F.col("latency_diff"),
                          F.col("cost_per_request_diff"), F.col("usage_ratio"))
    s2 = (F.when(fd > 0, 3).otherwise(0) + F.when(ed < 0, 2).otherwise(0) + F.when(ld < 0, 2).otherwise(0) +
          F.when(cd < 0, 1).otherwise(0) + F.when(ur > 1.2, 1).otherwise(0))
    s1 = (F.when(fd > 0, 0).otherwise(3) + F.when(ed < 0, 0).otherwise(2) + F.when(ld < 0, 0).otherwise(2) +
          F.when(cd < 0, 0).otherwise(1) + F.when(ur < 0.8, 1).otherwise(0))
    return (F.when(s2 > s1, F.concat(F.lit("Recommend "), F.col("model_2"), F.lit(": Better overall performance and metrics")))
            .when(s1 > s2, F.concat(F.lit("Recommend "), F.col("model_1"), F.lit(": Better overall performance and metrics")))
            .otherwise(F.lit("Models are comparable, consider specific use case requirements")))


def compare_models(models: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each (model_1, model_2): metric differences over the union of metric names
    (missing = 0, full outer join of the exploded maps), quality and cost differences, usage
    ratio, improved / regressed metric lists and the F19 recommendation."""
    mm = models.select("model_id", F.explode("performance_metrics").alias("metric", "value"))
    a = pairs.join(mm.withColumnRenamed("model_id", "model_1").withColumnRenamed("value", "v1"), "model_1")
    b = pairs.join(mm.withColumnRenamed("model_id", "model_2").withColumnRenamed("value", "v2"), "model_2")
    diff = a.join(b, ["model_1", "model_2", "metric"], "full_outer")
    per = diff.groupBy("model_1", "model_2").agg(
        F.array_sort(F.collect_list(F.struct("metric", (F.coalesce("v2", F.lit(0.0)) - F.coalesce("v1", F.lit(0.0)))
                                             .alias("diff")))).alias("performance_diff"),
        F.array_sort(F.collect_list(F.when(F.col("v2").isNotNull() & (F.col("v2") > F.coalesce("v1", F.lit(0.0))),
                                           F.col("metric")))).alias("improvement_areas"),
        F.array_sort(F.collect_list(F.when(F.col("v2").isNotNull() & (F.col("v2") < F.coalesce("v1", F.lit(0.0))),
                                           F.col("metric")))).alias("regression_areas"))
    m1 = models.select(*[F.col(c).alias(f"{c}_1") for c in
                         ["model_id", "feedback_score", "error_rate", "latency_p95", "usage_count", "cost_per_request"]])
    m2 = models.select(*[F.col(c).alias(f"{c}_2") for c in
                         ["model_id", "feedback_score", "error_rate", "latency_p95", "usage_count", "cost_per_request"]])
    q = (pairs.join(m1, F.col("model_1") == F.col("model_id_1")).join(m2, F.col("model_2") == F.col("model_id_2"))
         .select("model_1", "model_2",
                 (F.col("feedback_score_2") - F.col("feedback_score_1")).alias("feedback_score_diff"),
                 (F.col("error_rate_2") - F.col("error_rate_1")).alias("error_rate_diff"),
                 (F.col("latency_p95_2") - F.col("latency_p95_1")).alias("latency_diff"),
                 (F.col("usage_count_2") / F.greatest(F.col("usage_count_1"), F.lit(1))).alias("usage_ratio"),
                 (F.col("cost_per_request_2") - F.col("cost_per_request_1")).alias("cost_per_request_diff")))
    return q.join(per, ["model_1", "model_2"], "left").withColumn("recommendation", recommend())


def domain_listing(domains: DataFrame, models: DataFrame, active: DataFrame, adapters: DataFrame) -> DataFrame:
    """P-13: every domain with its active model, the status and version of that, and how many
    models and adapters it has (adapters: domain, adapter_id)."""
    n = models.groupBy("domain").agg(F.count(F.lit(1)).alias("models"))
    a = adapters.groupBy("domain").agg(F.count_distinct("adapter_id").alias("adapters"))
    now = active_models(models, active).select("domain", F.col("model_id").alias("active_model"), "status", "version")
    return (domains.select("domain", "domain_name").join(now, "domain", "left").join(n, "domain", "left").join(a, "domain", "left")
            .fillna(0, ["models", "adapters"]).withColumn("is_active", F.col("active_model").isNotNull()))


def active_models(models: DataFrame, active: DataFrame) -> DataFrame:
    """The active model row of each domain (active: domain, model_id)."""
    return active.join(models.drop("domain"), "model_id")


def rollback(deployments: DataFrame, models: DataFrame, targets: DataFrame) -> DataFrame:
    """J11 (parity form): roll back the deployments in `targets` (deployment_id): the rolled
    deployment's model becomes `rollback` and the domain's deprecated model with the latest
    deployed_at is restored (`deployed`). Returns the models with `restored` / `rolled_back`
    flags. `rollback_to_replaced` restores the model that the deployment replaced instead."""
    dep = deployments.join(targets.select("deployment_id"), "deployment_id").select(
        F.col("model_id").alias("_rolled"), "domain")
    prev = (models.filter(F.col("status") == "deprecated")
            .groupBy("domain").agg(F.max_by("model_id", F.struct(
                F.coalesce(F.col("deployed_at").cast("string"), F.lit("")), "model_id")).alias("_restore")))
    return _rolled_back(models, dep.join(prev, "domain"))


def rollback_to_replaced(deployments: DataFrame, models: DataFrame, targets: DataFrame) -> DataFrame:
    """J11 (evident intent): roll back the deployments in `targets` (deployment_id); the model that
    was active in the domain before the deployment (the last other model promoted before it) is
    restored. Deployments that were never promoted, or replaced nothing, roll back nothing."""
    h = promotion_history(deployments).join(targets.select("deployment_id"), "deployment_id")
    r = h.filter(F.col("replaced_model").isNotNull() & (F.col("replaced_model") != F.col("model_id")))
    return _rolled_back(models, r.select(F.col("model_id").alias("_rolled"), F.col("replaced_model").alias("_restore")))


def promote(models: DataFrame, active: DataFrame, candidates: DataFrame, force: bool = False,
            thresholds: Mapping[str, float] = PROMOTION_THRESHOLDS) -> tuple[DataFrame, DataFrame]:
    """Promote the models in `candidates` (model_id; of several in a domain, the newest) that pass
    P-8, or all of them with `force`. The active model of the domain is deprecated, the promoted
    one is deployed and active. Returns the models with `promoted` and the new active models
    (domain, model_id)."""
    passes = F.lit(True) if force else meets_promotion(thresholds)
    chosen = (models.join(candidates.select("model_id").distinct(), "model_id").filter(passes)
              .groupBy("domain").agg(F.max_by("model_id", F.struct("created_at", "model_id")).alias("_new")))
    change = chosen.join(active.select("domain", F.col("model_id").alias("_old")), "domain", "left")
    j = models.join(change, "domain", "left")
    new, old = F.coalesce(F.col("model_id") == F.col("_new"), F.lit(False)), F.coalesce(F.col("model_id") == F.col("_old"), F.lit(False))
    after = (j.withColumn("promoted", new)
             .withColumn("status", F.when(new, "deployed").when(old, "deprecated").otherwise(F.col("status"))).drop("_new", "_old"))
    now = active.select("domain", "model_id").join(chosen, "domain", "full_outer").select(
        "domain", F.coalesce("_new", "model_id").alias("model_id"))
    return after, now


def deployment_effect(deployments: DataFrame, metrics: DataFrame) -> DataFrame:
    """For every promotion, the quality of the model it replaced (before) and of the model it
    promoted (after); `metrics` has (model_id, value)."""
    value = metrics.groupBy("model_id").agg(F.max("value").alias("value"))
    before = value.select(F.col("model_id").alias("replaced_model"), F.col("value").alias("performance_before"))
    after = value.select("model_id", F.col("value").alias("performance_after"))
    h = promotion_history(deployments).join(before, "replaced_model", "left").join(after, "model_id", "left")
    return h.withColumn("performance_change", F.col("performance_after") - F.col("performance_before"))


def _rolled_back(models: DataFrame, r: DataFrame) -> DataFrame:
    """`models` after the rollbacks `r` (_rolled, _restore)."""
    rolled = r.select(F.col("_rolled").alias("model_id"), F.lit(True).alias("rolled_back")).distinct()
    restore = r.select(F.col("_restore").alias("model_id"), F.lit(True).alias("restored")).distinct()
    j = models.join(rolled, "model_id", "left").join(restore, "model_id", "left")
    return (j.withColumn("rolled_back", F.coalesce("rolled_back", F.lit(False)))
            .withColumn("restored", F.coalesce("restored", F.lit(False)))
            .withColumn("status", F.when(F.col("restored"), "deployed")
                        .when(F.col("rolled_back"), "rollback").otherwise(F.col("status"))))


def model_state(log: DataFrame) -> DataFrame:
    """Current model state from a log (model_id, ts, seq, status?, metric?, value?):
    last status, metric map with the latest value per key (P16), deployed_at = time of the
    last `deployed` status."""
    order = F.struct("ts", "seq")
    st = log.filter(F.col("status").isNotNull()).groupBy("model_id").agg(
        F.max_by("status", order).alias("status"),
        F.max(F.when(F.col("status") == "deployed", F.col("ts"))).alias("deployed_at"),
        F.max("ts").alias("last_updated"))
    mt = (log.filter(F.col("metric").isNotNull()).groupBy("model_id", "metric")
          .agg(F.max_by("value", order).alias("value"))
          .groupBy("model_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value"))))
                                   .alias("performance_metrics")))
    return st.join(mt, "model_id", "full_outer")


def merge_registry(old: DataFrame, new: DataFrame, key: str = "model_id", ts: str = "last_updated") -> DataFrame:
    """S8 merge: union and keep the latest row per key (later `ts` wins, new wins ties)."""
    u = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    payload = [c for c in u.columns if c != key]
    last = F.max_by(F.struct(*[F.col(c) for c in payload]), F.struct(ts, "_src"))
    return u.groupBy(key).agg(last.alias("_r")).select(key, "_r.*").drop("_src")


def registry_entries(df: DataFrame, section: str, key: str) -> DataFrame:
    """The rows of a table as entries (section, key, body) of a registry document: the other columns
    as a JSON object, nulls left out."""
    rest = [F.col(c) for c in df.columns if c != key]
    return df.select(F.lit(section).alias("section"), F.col(key).cast("string").alias("key"), F.to_json(F.struct(*rest)).alias("body"))


def _deep(old, new):
    """Members of both objects, the new one's where both have something else than objects."""
    if isinstance(old, dict) and isinstance(new, dict):
        return old | {k: _deep(old[k], v) if k in old else v for k, v in new.items()}
    return new


@F.pandas_udf(T.StringType())
def _merged_json(old: pd.Series, new: pd.Series) -> pd.Series:
    def one(a, b):
        if a is None or b is None:
            return a if b is None else b
        try:
            return json.dumps(_deep(json.loads(a), json.loads(b)), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except ValueError:      # text that isn't JSON is a value like any other
            return b
    return pd.Series([one(a, b) for a, b in zip(old, new)], dtype=object)


def merge_entries(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries of `new` merged into those of `old` by (section, key): objects merge member by member at
    every depth, unknown members stay, anything else (numbers, lists, null) is replaced by the later value.
    Entries of one side alone are kept as they are."""
    a, b = (x.select("section", "key", F.col("body").alias(n)) for x, n in ((old, "_old"), (new, "_new")))
    b = b.select(F.col("section").alias("_s"), F.col("key").alias("_k"), "_new")
    j = a.join(b, (F.col("section") == F.col("_s")) & F.col("key").eqNullSafe(F.col("_k")), "full_outer")
    both = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    body = F.when(both, _merged_json("_old", "_new")).otherwise(F.coalesce("_new", "_old"))
    return j.select(F.coalesce("section", "_s").alias("section"), F.coalesce("key", "_k").alias("key"), body.alias("body"))


_LEAVES = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())]))


@F.pandas_udf(_LEAVES)
def _leaves_json(body: pd.Series) -> pd.Series:
    def walk(x, path):
        members = x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else None
        if members is None:
            return [{"path": ".".join(path), "value": x if isinstance(x, str) else json.dumps(x)}]
        return [y for k, v in members for y in walk(v, [*path, str(k)])]
    return pd.Series([None if b is None else walk(json.loads(b), []) for b in body], dtype=object)


def leaves(body) -> Column:
    """Every value inside a JSON text with its dotted path ('' for a value alone)."""
    return _leaves_json(body)


def registry_document(entries: DataFrame) -> DataFrame:
    """All entries as one JSON document (one row, `value`), sections and keys in order. A registry is
    metadata (a row per model, deployment list, configuration, template, adapter), so its document is
    written by one task."""
    quoted = F.to_json(F.struct(F.col("key").alias("k")))
    name = F.substring(quoted, F.lit(6), F.length(quoted) - 6)          # {"k":"..."} → "..."
    member = F.concat(name, F.lit(":"), F.col("body"))
    parts = entries.select("section", F.col("key").isNull().alias("_alone"), F.struct("key", member.alias("m")).alias("_m"), "body")
    whole = parts.groupBy("section").agg(
        F.first(F.when(F.col("_alone"), F.col("body")), ignorenulls=True).alias("_value"),
        F.array_sort(F.collect_list(F.when(~F.col("_alone"), F.col("_m")))).alias("_members"))
    objects = F.concat(F.lit("{"), F.array_join(F.transform("_members", lambda x: x["m"]), ","), F.lit("}"))
    head = F.to_json(F.struct(F.col("section").alias("k")))
    body = F.concat(F.substring(head, F.lit(6), F.length(head) - 6), F.lit(":"), F.coalesce("_value", objects))
    lines = whole.agg(F.array_sort(F.collect_list(F.struct("section", body.alias("b")))).alias("_s"))
    return lines.select(F.concat(F.lit("{"), F.array_join(F.transform("_s", lambda x: x["b"]), ","), F.lit("}")).alias("value"))


# ----------------------------------------------------------------------------- A15, A16, W3, T11, J14, S10
def learning_metrics(cycles: DataFrame) -> DataFrame:
    """Cycles, successful cycles, mean improvement of the successful ones, last cycle."""
    ok = F.col("phase") == "complete"
    return cycles.groupBy("domain").agg(
        F.count(F.lit(1)).alias("total_cycles"), F.count_if(ok).alias("successful_cycles"),
        F.coalesce(F.avg(F.when(ok, F.col("improvement"))), F.lit(0.0)).alias("average_improvement"),
        F.max(F.coalesce("completed_at", "updated_at")).alias("last_cycle"))


def learning_status(cycles: DataFrame, domains: DataFrame, as_of) -> DataFrame:
    """Active cycles per domain (not finished at as_of; zero for idle domains) and the
    number of completed cycles."""
    act = (cycles.filter(~F.col("phase").isin("complete", "failed") |
                         (F.col("completed_at").isNull()) | (F.col("completed_at") > _ts(as_of)))
           .groupBy("domain").agg(F.count(F.lit(1)).alias("active_cycles")))
    done = cycles.filter(F.col("phase").isin("complete", "failed") & (F.col("completed_at") <= _ts(as_of))) \
        .groupBy("domain").agg(F.count(F.lit(1)).alias("completed_cycles"))
    return (domains.select("domain").join(act, "domain", "left").join(done, "domain", "left")
            .fillna(0, ["active_cycles", "completed_cycles"]))


def performance_decline(history: DataFrame, score: str = "overall_score", order_by: Sequence[str] = ("day",),
                        flag: float = 0.05, trigger: float = 0.1) -> DataFrame:
    """Mean of the last 5 scores against the 5 before (empty older window → 0, P-kept
    defect), decline = max(0, older − recent); fewer than 2 points → 0. The last ten rows of a domain
    come from a top-k that starts in each task, so a long history isn't sorted."""
    last = top_k_rows(history.select("domain", score, *order_by), ["domain"], [F.col(c).desc() for c in order_by], 10, "_k")
    n = history.groupBy("domain").agg(F.count(F.lit(1)).alias("points"))
    g = last.groupBy("domain").agg(
        F.avg(F.when(F.col("_k") <= 5, F.col(score))).alias("recent_avg"),
        (F.coalesce(F.sum(F.when((F.col("_k") > 5) & (F.col("_k") <= 10), F.col(score))), F.lit(0.0)) /
         F.greatest(F.count_if((F.col("_k") > 5) & (F.col("_k") <= 10)), F.lit(1))).alias("older_avg"))
    g = n.join(g, "domain")
    dec = F.when(F.col("points") < 2, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.col("older_avg") - F.col("recent_avg")))
    return (g.withColumn("decline", dec)
            .withColumn("trend", F.when(F.col("decline") > flag, "declining").otherwise("stable"))
            .withColumn("triggered", F.col("decline") > trigger))


def cycle_timeline(events: DataFrame) -> DataFrame:
    """Per cycle event (cycle_id, ts, seq, phase): time spent in each phase until the next
    event (lead), and the cycle's last phase."""
    w = Window.partitionBy("cycle_id").orderBy("ts", "seq")
    x = events.withColumn("_next", F.lead("ts").over(w))
    x = x.withColumn("seconds_in_phase", F.unix_micros("_next") / 1e6 - F.unix_micros("ts") / 1e6)
    last = events.groupBy("cycle_id").agg(F.max_by("phase", F.struct("ts", "seq")).alias("final_phase"))
    return x.drop("_next").join(last, "cycle_id")


def validate_improvement(results: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Success rates of the old and new model on the same prompts (results: group,
    which ∈ {old, new}, error), improvement = new − old and the ≥ threshold gate."""
    g = results.groupBy("domain").agg(
        F.avg(F.when(F.col("which") == "old", (~F.col("error")).cast("double"))).alias("old_success_rate"),
        F.avg(F.when(F.col("which") == "new", (~F.col("error")).cast("double"))).alias("new_success_rate"))
    imp = F.coalesce(F.col("new_success_rate") - F.col("old_success_rate"), F.lit(0.0))
    return (g.withColumn("overall_improvement", imp)
            .withColumn("improvement_percentage", imp * 100)
            .withColumn("improved", imp >= threshold))


def last_cycles(cycles: DataFrame, keep: int = 100) -> DataFrame:
    """The `keep` most recent cycles (global top-k: TakeOrderedAndProject)."""
    return cycles.orderBy(F.col("created_at").desc(), F.col("cycle_id").desc()).limit(keep)

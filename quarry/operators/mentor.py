"""Mentor-session and expert-profile operators (SURVEY §2.4 A17–A20, §2.5 W2, W7, W12, §2.8 F22,
F23, §2.3 J12, J17, §2.1 S12, §2.9 T8 batch twin).

Mentor feedback rows (schema M12): feedback_id, session_id, adapter_id, ts, mtype ∈ {positive,
negative, correction, enhancement}, rating?, feedback_text, original_response,
corrected_response?, applied. Phases come from a scan over key ranges, so a long session isn't
one task's work; nothing is collected per session except bounded top-k lists.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.plans.ordinal import scan
from quarry.plans.topk import ranked_list, top_terms

# ---------------------------------------------------------------------------------------
# FIXED VALUES — weights and scores per feedback type, phase thresholds.
# ---------------------------------------------------------------------------------------
TYPE_WEIGHT = {"positive": 1.0, "negative": 0.5, "correction": 0.8, "enhancement": 0.6}
TYPE_SCORE = {"positive": 1.0, "negative": 0.0, "correction": 0.7, "enhancement": 0.8}
PHASE_FEEDBACK_AT = 5
PHASE_DECIDE_AT = 10
VALIDATION_SCORE = 0.7
REFINEMENT_EXIT_SCORE = 0.8
ORDER = ["ts", "feedback_id"]


def _case(col: Column, table: dict) -> Column:
    e = None
    for k, v in table.items():
        e = F.when(col == k, F.lit(v)) if e is None else e.when(col == k, F.lit(v))
    return e.otherwise(F.lit(0.0))


def weighted_parts(mtype: str = "mtype", rating: str = "rating"):
    """(weight, weight × score) of one feedback row; the score is averaged with rating / 5
    when a rating is given."""
    w = _case(F.col(mtype), TYPE_WEIGHT)
    s = _case(F.col(mtype), TYPE_SCORE)
    s = F.when(F.col(rating).isNotNull(), (s + F.col(rating) / 5.0) / 2.0).otherwise(s)
    return w, w * s


def improvement_score(mfb: DataFrame, group_by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Σ weight·score / Σ weight per session (0.0 when no weight)."""
    w, ws = weighted_parts()
    g = mfb.groupBy(*group_by).agg(F.sum(w).alias("_w"), F.sum(ws).alias("_ws"))
    return g.select(*group_by, F.when(F.col("_w") > 0, F.col("_ws") / F.col("_w")).otherwise(F.lit(0.0))
                    .alias("improvement_score"))


def feedback_ids(mfb: DataFrame) -> DataFrame:
    """`fb_{session}_{n:03d}`, n = 1-based position of the record in its session."""
    w = Window.partitionBy("session_id").orderBy(*ORDER)
    return mfb.withColumn("n", F.row_number().over(w)).withColumn(
        "mentor_feedback_id", F.format_string("fb_%s_%03d", F.col("session_id").cast("string"), F.col("n")))


def session_phase(mfb: DataFrame) -> DataFrame:
    """The phase after each feedback row: initial until 5 rows, feedback until 10, then
    validation when the score over the first 10 rows is ≥ 0.7, else refinement (the score is
    only recomputed when feedback is applied, so refinement stays). Running count and weighted
    sums, and the sums over a session's first rows, come from one scan over key ranges, so a session
    that holds most rows is spread over tasks. `decision_score` is null before the decision."""
    wt, ws = weighted_parts()
    x = scan(mfb, ["session_id"], ORDER, "feedback_count", {"_w": wt, "_ws": ws}, first=PHASE_DECIDE_AT, heads={"_dw": wt, "_dws": ws})

    def mean(total, weight):
        return F.when(F.col(weight) > 0, F.col(total) / F.col(weight)).otherwise(F.lit(0.0))
    y = (x.withColumn("running_score", mean("_ws", "_w"))
         .withColumn("decision_score", F.when(F.col("feedback_count") >= PHASE_DECIDE_AT, mean("_dws", "_dw"))))
    phase = (F.when(F.col("feedback_count") < PHASE_FEEDBACK_AT, "initial")
             .when(F.col("feedback_count") < PHASE_DECIDE_AT, "feedback")
             .when(F.col("decision_score") >= VALIDATION_SCORE, "validation").otherwise("refinement"))
    return y.withColumn("phase", phase).drop("_w", "_ws", "_dw", "_dws")


def final_phase(mfb: DataFrame) -> DataFrame:
    """Phase of each session after its last row (W7), with its decision score."""
    p = session_phase(mfb)
    return p.groupBy("session_id").agg(F.max_by("phase", F.struct(*ORDER)).alias("phase"),
                                       F.max("feedback_count").alias("feedback_count"),
                                       F.first("decision_score", ignorenulls=True).alias("decision_score"))


def feedback_patterns(mfb: DataFrame, n_issues: int = 5, n_enh: int = 3) -> DataFrame:
    """Per session: counts by type, top-5 words (longer than 4) of negative texts, top-3
    of enhancement texts (ties by first occurrence), average rating."""
    c = mfb.groupBy("session_id").agg(
        *[F.count_if(F.col("mtype") == t).alias(f"{t}_count") for t in TYPE_WEIGHT],
        F.avg("rating").alias("average_rating"))
    toks = F.filter(tx.words(F.lower(F.col("feedback_text"))), lambda x: F.length(x) > 4)
    neg = top_terms(mfb.filter(F.col("mtype") == "negative"), ["session_id"], toks, ORDER, n_issues, "word") \
        .groupBy("session_id").agg(ranked_list("rank", "word").alias("common_issues"))
    enh = top_terms(mfb.filter(F.col("mtype") == "enhancement"), ["session_id"], toks, ORDER, n_enh, "word") \
        .groupBy("session_id").agg(ranked_list("rank", "word").alias("enhancement_areas"))
    empty = F.array().cast("array<string>")
    return (c.join(neg, "session_id", "left").join(enh, "session_id", "left")
            .withColumn("common_issues", F.coalesce("common_issues", empty))
            .withColumn("enhancement_areas", F.coalesce("enhancement_areas", empty))
            .withColumn("average_rating", F.coalesce("average_rating", F.lit(0.0))))


def mentor_suggestions(patterns: DataFrame, max_corrections: int = 3) -> DataFrame:
    """Suggestions from A18 (negative > positive; corrections > 3; any enhancement)."""
    s = F.array_compact(F.array(
        F.when(F.col("negative_count") > F.col("positive_count"),
               F.lit("Focus on addressing recurring negative feedback patterns")),
        F.when(F.col("correction_count") > max_corrections,
               F.lit("Consider expanding training data with corrected examples")),
        F.when(F.size("enhancement_areas") > 0, F.lit("Explore enhancement opportunities"))))
    return patterns.select("session_id", s.alias("suggestions"))


def session_duration(mfb: DataFrame) -> DataFrame:
    """Hours between the first and the last record of each session."""
    return mfb.groupBy("session_id").agg(
        ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 3.6e9).alias("duration_hours"),
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"))


def apply_feedback(mfb: DataFrame) -> DataFrame:
    """un-applied records of sessions in refinement or validation become training
    examples; corrected output and rating only when set (rating: truthy)."""
    ph = final_phase(mfb).filter(F.col("phase").isin("refinement", "validation")).select("session_id")
    x = mfb.join(ph, "session_id", "left_semi").filter(~F.col("applied"))
    return x.select("session_id", "feedback_id",
                    F.struct(F.col("feedback_text").alias("input"), F.col("original_response").alias("original_output"),
                             F.col("feedback_text").alias("feedback"), F.col("mtype").alias("feedback_type"),
                             F.when(F.col("corrected_response") != "", F.col("corrected_response")).alias("corrected_output"),
                             F.when(F.col("rating") != 0, F.col("rating")).alias("rating")).alias("example"))


def mentor_totals(mfb: DataFrame) -> DataFrame:
    """Sessions, feedback records, mean improvement of completed sessions (those that
    reached validation), pending (un-applied) records, adapters trained. One aggregate over a
    per-session table."""
    per = mfb.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if(~F.col("applied")).alias("_p"),
                                        F.first("adapter_id").alias("_a"))
    per = per.join(final_phase(mfb).select("session_id", "phase"), "session_id").join(improvement_score(mfb), "session_id")
    done = F.col("phase") == "validation"
    return per.agg(F.count(F.lit(1)).alias("total_sessions"), F.sum("_n").alias("total_feedback"),
                   F.sum("_p").alias("pending_feedback"),
                   F.coalesce(F.avg(F.when(done, F.col("improvement_score"))), F.lit(0.0)).alias("average_improvement"),
                   F.count_if(done).alias("completed_sessions"),
                   F.count_distinct(F.when(done, F.col("_a"))).alias("adapters_trained"))


# ----------------------------------------------------------------------------- profiles
PROFILE_TEMPLATES = {
    # FIXED VALUES: input / output templates per profile element kind ({name} = profile name).
    "decision_pattern": ("How would {name} approach this situation?", "Based on {name}'s approach: {text}"),
    "quote": ("What is {name}'s philosophy?", "{name} believes: {text}"),
    "case_study": ("In {situation}, what would {name} do?",
                   "{name} would: {decision}. This approach typically results in: {outcome}"),
}


def _fill(tpl: str, cols: dict) -> Column:
    parts, rest = [], tpl
    while "{" in rest:
        pre, rest = rest.split("{", 1)
        key, rest = rest.split("}", 1)
        parts += [F.lit(pre), cols[key]]
    parts.append(F.lit(rest))
    return F.concat(*parts)


def profile_examples(elements: DataFrame) -> DataFrame:
    """input/output pairs from profile elements in long form (name, kind, ordinal, text,
    situation?, decision?, outcome?): decision patterns, then quotes, then case studies."""
    cols = {"name": F.col("name"), "text": F.col("text"), "situation": F.col("situation"),
            "decision": F.col("decision"), "outcome": F.col("outcome")}
    inp = out = None
    for kind, (i, o) in PROFILE_TEMPLATES.items():
        inp = F.when(F.col("kind") == kind, _fill(i, cols)) if inp is None else inp.when(F.col("kind") == kind, _fill(i, cols))
        out = F.when(F.col("kind") == kind, _fill(o, cols)) if out is None else out.when(F.col("kind") == kind, _fill(o, cols))
    kind_ord = F.when(F.col("kind") == "decision_pattern", 0).when(F.col("kind") == "quote", 1).otherwise(2)
    return elements.select("name", "kind", "ordinal", kind_ord.alias("kind_ord"), inp.alias("input"), out.alias("output"))


def profiles_with_adapters(profiles: DataFrame, adapters: DataFrame) -> DataFrame:
    """Each profile with the ids of its adapters (empty list when none)."""
    a = adapters.groupBy(F.col("legendary_profile").alias("name")).agg(
        F.array_sort(F.collect_list("adapter_id")).alias("available_adapters"))
    return profiles.join(a, "name", "left").withColumn(
        "available_adapters", F.coalesce("available_adapters", F.array().cast("array<string>")))


def start_sessions(requests: DataFrame, adapters: DataFrame):
    """Open sessions only for known adapters (with profile and domain); unknown adapters
    go to a reject table. Returns (accepted, rejected)."""
    a = adapters.select("adapter_id", "legendary_profile", "domain")
    ok = requests.join(a, "adapter_id")
    bad = requests.join(a, "adapter_id", "left_anti").withColumn("error", F.concat(
        F.lit("Adapter "), F.col("adapter_id"), F.lit(" not found")))
    return ok, bad


def merge_profiles(*sources: DataFrame) -> DataFrame:
    """Profiles from several sources in priority order; the later source wins by name."""
    u = None
    for i, s in enumerate(sources):
        x = s.withColumn("_src", F.lit(i))
        u = x if u is None else u.unionByName(x, allowMissingColumns=True)
    payload = [c for c in u.columns if c != "name"]
    return (u.groupBy("name").agg(F.max_by(F.struct(*payload), F.col("_src")).alias("_p"))
            .select("name", "_p.*").drop("_src"))

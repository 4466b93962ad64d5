"""Adaptive domain-context operators (SURVEY §2.3 J16, §2.2 P-16, §2.4 A23–A25, A26b,
§2.5 W5, §2.8 F13, F30, F31, §2.1 S20).

A context row carries: domain, domain_name, description, key_concepts[], terminology
array<struct<term, definition>> (ordered, first key wins, P16), focus_areas[], and the
instruction texts. All operators are per-row expressions or joins on the domain key.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.ordinal import with_ordinal

# ---------------------------------------------------------------------------------------
# FIXED VALUES — enhancement rules of the built-in domains.
# ---------------------------------------------------------------------------------------
ENHANCEMENT_RULES = {
    "technical": {"priority_concepts": ["performance", "security", "scalability", "best_practices"],
                  "required_terminology": ["API", "framework", "architecture", "deployment"],
                  "context_depth": "detailed",
                  "example_types": ["code_snippets", "architecture_diagrams", "use_cases"]},
    "medical": {"priority_concepts": ["patient_safety", "clinical_evidence", "guidelines", "protocols"],
                "required_terminology": ["diagnosis", "treatment", "clinical_trial", "adverse_event"],
                "context_depth": "comprehensive",
                "example_types": ["case_studies", "clinical_protocols", "research_findings"]},
    "legal": {"priority_concepts": ["compliance", "precedent", "regulation", "risk_assessment"],
              "required_terminology": ["statute", "jurisdiction", "liability", "contract"],
              "context_depth": "precise",
              "example_types": ["case_law", "regulatory_text", "contract_clauses"]},
    "financial": {"priority_concepts": ["risk_management", "valuation", "market_analysis", "regulation"],
                  "required_terminology": ["portfolio", "derivative", "volatility", "compliance"],
                  "context_depth": "analytical",
                  "example_types": ["financial_models", "market_data", "risk_scenarios"]},
}

# FIXED VALUES — context sizes by type: (concepts, focus areas or None = all).
CONTEXT_SIZES = {"minimal": (5, 3), "focused": (10, 5), "comprehensive": (15, None)}

# FIXED VALUES — base templates per task type ({instructions} = the domain's instruction text).
BASE_TEMPLATES = {
    "summarization": "{instructions}\n\n{{domain_knowledge}}\n\nKey concepts to focus on: {{key_concepts}}"
                     "\n\nTerminology: {{terminology}}",
    "fine_tuning": "{instructions}\n\n{{domain_knowledge}}\n\nEmphasize: {{key_concepts}}"
                   "\n\nUse terminology: {{terminology}}",
    "inference": "You are an expert in {{domain}}. {{domain_knowledge}}\n\nFocus on: {{key_concepts}}"
                 "\n\nUse appropriate terminology: {{terminology}}\n\nProvide expert guidance on the following:",
}
FALLBACK_TEMPLATES = {
    "summarization": "Summarize the following content with focus on domain-specific concepts.\n\n{{domain_knowledge}}",
    "fine_tuning": "Generate training examples with domain expertise.\n\n{{domain_knowledge}}",
    "other": "Apply domain expertise to address the following task.\n\n{{domain_knowledge}}\n\nKey concepts: {{key_concepts}}",
}


def rules_df(spark, rules=None) -> DataFrame:
    rows = [(d, r["priority_concepts"], r["required_terminology"], r["context_depth"], r["example_types"])
            for d, r in (rules or ENHANCEMENT_RULES).items()]
    return spark.createDataFrame(rows, "domain string, priority_concepts array<string>, "
                                       "required_terminology array<string>, context_depth string, "
                                       "example_types array<string>")


def _term(k: Column, v: Column) -> Column:
    return F.struct(k.alias("term"), v.alias("definition"))


def merge_terminology(base: Column, keys: Column, definition: Column) -> Column:
    """Append (key, definition) for keys not yet present, in order, first occurrence wins."""
    new = F.array_distinct(F.filter(keys, lambda k: ~F.array_contains(F.transform(base, lambda t: t["term"]), k)))
    return F.concat(base, F.transform(new, lambda k: _term(k, definition)))


def merge_context(ctx: DataFrame, entries: DataFrame, rules: DataFrame | None = None,
                  max_entries: int = 5) -> DataFrame:
    """Base context ⨝ its top `max_entries` knowledge entries (ranked rows: domain, rank,
    id, content, keywords, concepts): entry concepts appended to the key concepts, entry
    keywords added to the terminology (`Domain-specific term in {name}`), then the rules'
    required terms (`Essential {name} concept`) and priority concepts. Entry lists per
    domain are at most `max_entries` long."""
    top = entries.filter(F.col("rank") <= max_entries)
    agg = top.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "id", "content", "keywords", "concepts"))).alias("knowledge_entries"))
    j = ctx.join(agg, "domain", "left").withColumn(
        "knowledge_entries", F.coalesce("knowledge_entries", F.array().cast(agg.schema["knowledge_entries"].dataType)))
    ent = F.col("knowledge_entries")
    concepts = F.concat(F.col("key_concepts"), F.flatten(F.transform(ent, lambda e: e["concepts"])))
    kws = F.flatten(F.transform(ent, lambda e: e["keywords"]))
    term = merge_terminology(F.col("terminology"), kws,
                             F.concat(F.lit("Domain-specific term in "), F.col("domain_name")))
    out = j.withColumn("key_concepts", concepts).withColumn("terminology", term)
    if rules is not None:
        out = out.join(rules.select("domain", "priority_concepts", "required_terminology"),
                       "domain", "left")
        out = out.withColumn("terminology", merge_terminology(
            F.col("terminology"), F.coalesce("required_terminology", F.array().cast("array<string>")),
            F.concat(F.lit("Essential "), F.col("domain_name"), F.lit(" concept")))).drop("required_terminology")
    return out


def trim_context(ctx: DataFrame, context_type: str = "comprehensive") -> DataFrame:
    """P-16: distinct key concepts (first occurrence order) cut to 5 / 10 / 15 and focus areas to
    3 / 5 / all for minimal / focused / comprehensive."""
    n_c, n_f = CONTEXT_SIZES.get(context_type, CONTEXT_SIZES["comprehensive"])
    out = ctx.withColumn("key_concepts", F.slice(F.array_distinct("key_concepts"), 1, n_c))
    if n_f is not None:
        out = out.withColumn("focus_areas", F.slice("focus_areas", 1, n_f))
    return out.withColumn("context_type", F.lit(context_type))


def format_knowledge(entries: Column, n: int = 3, chars: int = 200) -> Column:
    """F13 knowledge text: first n entries as `- {content[:200]}...` lines."""
    lines = F.transform(F.slice(entries, 1, n), lambda e: F.concat(F.lit("- "), F.substring(e["content"], 1, chars),
                                                                    F.lit("...")))
    return F.when(F.size(entries) == 0, F.lit("No specific domain knowledge available.")) \
        .otherwise(F.concat(F.lit("Relevant domain knowledge:\n"), F.array_join(lines, "\n")))


def format_terminology(term: Column, n: int = 5) -> Column:
    items = F.transform(F.slice(term, 1, n), lambda t: F.concat(t["term"], F.lit(": "), t["definition"]))
    return F.when(F.size(term) == 0, F.lit("No specific terminology provided.")).otherwise(F.array_join(items, "; "))


def base_template(task_type: Column) -> Column:
    """The template text of a task type, built from the row's instruction columns (the
    `{{...}}` slots are literal text, filled by `fill_template`)."""
    def fill(tpl: str, instr: str) -> Column:
        head, tail = tpl.split("{instructions}")
        return F.concat(F.lit(head), F.col(instr), F.lit(tail))
    return (F.when(task_type == "summarization", fill(BASE_TEMPLATES["summarization"], "summarization_instructions"))
            .when(task_type == "fine_tuning", fill(BASE_TEMPLATES["fine_tuning"], "fine_tuning_instructions"))
            .when(task_type == "inference", F.lit(BASE_TEMPLATES["inference"]))
            .otherwise(F.lit(FALLBACK_TEMPLATES["other"])))


def fill_template(df: DataFrame, task_type: str | Column, query: str | Column,
                  n_concepts: int = 5, user_context: Column | None = None) -> DataFrame:
    """fill `{{domain_knowledge}}`, `{{key_concepts}}` (first 5), `{{terminology}}` (first 5),
    `{{domain}}` and append the task (and optional JSON user context). Needs a merged
    context row (knowledge_entries, key_concepts, terminology, domain_name, instructions)."""
    tt = F.lit(task_type) if isinstance(task_type, str) else task_type
    q = F.col(query) if isinstance(query, str) else query
    p = base_template(tt)
    p = F.replace(p, F.lit("{{domain_knowledge}}"), format_knowledge(F.col("knowledge_entries")))
    p = F.replace(p, F.lit("{{key_concepts}}"), F.array_join(F.slice("key_concepts", 1, n_concepts), ", "))
    p = F.replace(p, F.lit("{{terminology}}"), format_terminology(F.col("terminology")))
    p = F.replace(p, F.lit("{{domain}}"), F.col("domain_name"))
    p = F.concat(p, F.lit("\n\nTask: "), q)
    if user_context is not None:
        p = F.concat(p, F.lit("\n\nAdditional context: "), F.to_json(user_context))
    return df.withColumn("prompt", p)


# ----------------------------------------------------------------------------- A23, F31, A25
def concept_feedback(fb: DataFrame, key_concepts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Sum of concept scores (rows with a `concept_scores` map) per domain and concept;
    concepts with a sum above `threshold` that are key concepts of the domain are priority.

    Outer explodes: from an inner one Spark infers that the map or list isn't empty and evaluates what builds
    it once more in that filter, below the joins, with every use of a text spelled out."""
    x = fb.select("domain", F.explode_outer("concept_scores").alias("concept", "score")).filter(F.col("concept").isNotNull())
    s = x.groupBy("domain", "concept").agg(F.sum("score").alias("score"))
    kc = key_concepts.select("domain", F.explode_outer("key_concepts").alias("concept")) \
        .filter(F.col("concept").isNotNull()).distinct() \
        .withColumn("_key", F.lit(True))
    return (s.join(kc, ["domain", "concept"], "left")
            .withColumn("is_priority", (F.col("score") > threshold) & F.coalesce("_key", F.lit(False)))
            .drop("_key"))


def context_flags(perf: DataFrame, threshold: float = 0.7, accuracy: float | None = None) -> DataFrame:
    """accuracy below its threshold (by default the common one) → detailed terminology;
    relevance below → high relevance."""
    return (perf.withColumn("include_detailed_terminology", F.col("accuracy") < (threshold if accuracy is None else accuracy))
            .withColumn("focus_mode", F.when(F.col("relevance") < threshold, F.lit("high_relevance"))))


def context_recommendations(perf: DataFrame, knowledge_counts: DataFrame, template_success: DataFrame,
                            threshold: float = 0.7, min_entries: int = 10,
                            min_success: float = 0.8, accuracy: float | None = None) -> DataFrame:
    """Per domain (perf: domain, accuracy, relevance, user_satisfaction; knowledge_counts:
    domain, total_entries; template_success: domain, success_rate per template). `accuracy` is
    the accuracy's threshold where it differs from the common one."""
    ts = template_success.groupBy("domain").agg(F.avg("success_rate").alias("_succ"))
    j = perf.join(knowledge_counts, "domain", "left").join(ts, "domain", "left")
    recs = F.array_compact(F.array(
        F.when(F.coalesce("accuracy", F.lit(0.0)) < (threshold if accuracy is None else accuracy),
               F.lit("Consider adding more domain-specific examples to improve accuracy")),
        F.when(F.coalesce("relevance", F.lit(0.0)) < threshold,
               F.lit("Update knowledge base with more recent domain information")),
        F.when(F.coalesce("user_satisfaction", F.lit(0.0)) < threshold,
               F.lit("Review and refine domain terminology and focus areas")),
        F.when(F.coalesce("total_entries", F.lit(0)) < min_entries,
               F.lit("Expand knowledge base with more domain-specific content")),
        F.when(F.coalesce("_succ", F.lit(0.0)) < min_success,
               F.lit("Optimize prompt templates based on feedback patterns"))))
    return j.select("domain", recs.alias("recommendations"))


# ----------------------------------------------------------------------------- W5, A24, A26b
def template_success(uses: DataFrame, key: str = "template_id", score: str = "avg_score",
                     order_by: Sequence[str] = ("ts", "use_id")) -> DataFrame:
    """The fold r ← (r + mean(metrics)) / 2 from 0 over a template's uses in order, in
    closed form r = Σ x_i · 2^-(n−i+1); plus the usage count. The position i comes from the
    distributed ordinal, n from a count, and the sum is an ordinary aggregate."""
    o = with_ordinal(uses.select(key, *order_by, score), list(order_by), [key], name="_i")
    n = uses.groupBy(key).agg(F.count(F.lit(1)).alias("usage_count"))
    j = o.join(n, key)
    w = F.pow(F.lit(2.0), (F.col("_i") + 1 - F.col("usage_count") - 1).cast("double"))
    return j.groupBy(key, "usage_count").agg(F.sum(F.col(score) * w).alias("success_rate"))


def performance_trends(history: DataFrame, metrics: Sequence[str], group_by: Sequence[str] = ("domain",),
                       order_by: Sequence[str] = ("day",), threshold: float = 0.001) -> DataFrame:
    """Slope of each metric over its position in `order_by` order (P9), classified as
    improving (> threshold), declining (< −threshold) or stable. One row per (group, metric)."""
    from quarry.operators.feedback import trend
    stacked = None
    for m in metrics:
        part = history.select(*group_by, *order_by, F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
        stacked = part if stacked is None else stacked.unionByName(part)
    t = trend(stacked.filter(F.col("value").isNotNull()), "value", list(order_by), [*group_by, "metric"], "slope")
    return t.withColumn("trend", F.when(F.col("slope") > threshold, "improving")
                        .when(F.col("slope") < -threshold, "declining").otherwise("stable"))


def optimize_prompts(trends: DataFrame, group_by: Sequence[str] = ("domain",)) -> DataFrame:
    """Declining metrics → recommendation → applied action, per domain."""
    g = trends.groupBy(*group_by).agg(
        F.array_sort(F.collect_list(F.when(F.col("trend") == "improving", F.col("metric")))).alias("improving_metrics"),
        F.array_sort(F.collect_list(F.when(F.col("trend") == "declining", F.col("metric")))).alias("declining_metrics"),
        F.array_sort(F.collect_list(F.when(F.col("trend") == "stable", F.col("metric")))).alias("stable_metrics"))
    rec = F.when(F.size("declining_metrics") > 0,
                 F.lit("Consider updating domain knowledge base with recent information"))
    return (g.withColumn("recommendation", rec)
            .withColumn("applied", F.when(rec.isNotNull(), F.concat(F.lit("Triggered knowledge base update for "),
                                                                    F.col(group_by[0])))))


# ----------------------------------------------------------------------------- F30, S20
def custom_domain(df: DataFrame) -> DataFrame:
    """defaults of a custom domain from (domain_name, description, key_concepts,
    terminology, focus_areas): instructions, example prompts, evaluation criteria and
    enhancement rules (first 4 concepts / terms)."""
    name = F.col("domain_name")
    return (df.withColumn("domain_type", F.lit("general"))
            .withColumn("summarization_instructions", F.concat(
                F.lit("Focus on "), F.array_join(F.slice("focus_areas", 1, 3), ", "),
                F.lit(" when summarizing "), name, F.lit(" content.")))
            .withColumn("fine_tuning_instructions", F.concat(
                F.lit("Emphasize "), F.array_join(F.slice("key_concepts", 1, 3), ", "),
                F.lit(" in training examples for "), name, F.lit(".")))
            .withColumn("example_prompts", F.transform(F.slice("key_concepts", 1, 3), lambda c: F.concat(
                F.lit("Explain "), c, F.lit(" in the context of "), name)))
            .withColumn("evaluation_criteria", F.array(*[F.lit(x) for x in
                                                         ["accuracy", "relevance", "domain_specificity",
                                                          "practical_applicability"]]))
            .withColumn("priority_concepts", F.slice("key_concepts", 1, 4))
            .withColumn("required_terminology", F.slice(F.transform("terminology", lambda t: t["term"]), 1, 4)))


DOMAIN_TYPES = ["technical", "medical", "legal", "financial", "academic", "business", "scientific", "general"]


def export_domain(ctx: DataFrame) -> DataFrame:
    """S20 export: one JSON document per domain (terminology as an object, keys in order)."""
    cols = ["domain_type", "domain_name", "description", "key_concepts", "terminology", "focus_areas",
            "summarization_instructions", "fine_tuning_instructions", "example_prompts", "evaluation_criteria"]
    x = ctx.withColumn("terminology", F.map_from_entries(F.transform("terminology", lambda t: F.struct(
        t["term"], t["definition"]))))
    return x.select("domain", F.to_json(F.struct(*[F.col(c) for c in cols])).alias("config_json"))


def import_domain(js: DataFrame, col: str = "config_json") -> DataFrame:
    """S20 import: parse with the context schema; an unknown domain_type is rejected
    (`valid` false) instead of failing the job."""
    schema = ("domain_type string, domain_name string, description string, key_concepts array<string>, "
              "terminology map<string,string>, focus_areas array<string>, summarization_instructions string, "
              "fine_tuning_instructions string, example_prompts array<string>, evaluation_criteria array<string>")
    p = js.withColumn("_c", F.from_json(col, schema)).select("*", "_c.*").drop("_c")
    return p.withColumn("valid", F.col("domain_type").isin(*DOMAIN_TYPES) & F.col("domain_name").isNotNull())


_ENHANCED = ("base_context string, enhancement_rules map<string,string>, adaptive_templates array<struct<template_id:string,domain:string,"
             "task_type:string,template:string,success_rate:double,usage_count:long>>, performance_history map<string,array<double>>, "
             "generation_config map<string,string>")


def export_enhanced(ctx: DataFrame, rules: DataFrame, templates: DataFrame, history: DataFrame, config: dict[str, str]) -> DataFrame:
    """One JSON document per domain of `ctx`: its base context (`export_domain`), enhancement rules
    (domain, rules map), adaptive templates (template_id, domain, task_type, template, success_rate, usage_count),
    performance history (domain, metric → last values) and the generation settings. A part that a domain
    lacks is empty. Templates of a domain are a handful (one per task), so they are one list."""
    base = export_domain(ctx).select("domain", F.col("config_json").alias("base_context"))
    of = F.struct("template_id", "domain", "task_type", "template", "success_rate", "usage_count")
    per = templates.groupBy("domain").agg(F.array_sort(F.collect_list(of)).alias("adaptive_templates"))
    j = (base.join(rules.select("domain", F.col("rules").alias("enhancement_rules")), "domain", "left").join(per, "domain", "left")
         .join(history.select("domain", F.col("history").alias("performance_history")), "domain", "left"))
    kinds = dict(f.split(" ", 1) for f in _ENHANCED.split(", "))
    settings = F.create_map(*[F.lit(x) for kv in sorted(config.items()) for x in kv]) if config else F.create_map()
    j = j.withColumn("generation_config", settings.cast("map<string,string>"))
    for c, empty in (("adaptive_templates", F.array()), ("enhancement_rules", F.create_map()), ("performance_history", F.create_map())):
        j = j.withColumn(c, F.coalesce(c, empty.cast(kinds[c])))
    return j.select("domain", F.to_json(F.struct(*kinds)).alias("config_json"))


def import_enhanced(js: DataFrame, col: str = "config_json") -> DataFrame:
    """The parts of an enhanced document as columns, and those of the base context; `valid` is false
    for a base context that can't be imported (the other parts are given all the same)."""
    p = js.withColumn("_c", F.from_json(col, _ENHANCED)).select("*", "_c.*").drop("_c", col)
    return import_domain(p, "base_context")

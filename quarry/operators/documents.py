"""Document operators.

Documents are rows (doc key, text[, file name, domain]); everything here is a per-row
expression or an explode, plus a broadcast lookup of the small domain dimension.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions.lexicons import DOMAIN_ORDER, WS_CHARS


def strip_ws(c: Column) -> Column:
    """Python `str.strip()`: remove whitespace (Python's set) at both ends."""
    return F.trim(c, F.lit(WS_CHARS))


# ----------------------------------------------------------------------------- W13, P-6
def segments(docs: DataFrame, key: str = "doc_id", text: str = "text", base=None,
             separator: str = "\n\n", min_words: int = 50, keep: Sequence[str] = ()) -> DataFrame:
    """Paragraphs split on `separator`, stripped, empty ones dropped; the ordinal counts
    the non-empty paragraphs *before* short ones (< `min_words` words, P-6) are removed, so it
    has gaps. segment_id = `{base}_segment_{i}`. One explode per document, no shuffle. `keep`:
    columns of the document that its segments carry."""
    import re
    b = F.col(base) if isinstance(base, str) else (base if base is not None else F.col(key).cast("string"))
    paras = F.filter(F.transform(F.split(F.col(text), re.escape(separator)), strip_ws), lambda p: p != "")
    x = docs.select(key, *keep, b.alias("_base"), F.posexplode(paras).alias("ordinal", "original_text"))
    x = x.filter(F.length("original_text") >= 2 * min_words - 1)      # so many words and the gaps between
    x = x.withColumn("word_count", tx.word_count("original_text").cast("long"))
    return (x.filter(F.col("word_count") >= min_words)
            .withColumn("segment_id", F.concat(F.col("_base"), F.lit("_segment_"), F.col("ordinal").cast("string")))
            .drop("_base"))


# ----------------------------------------------------------------------------- F5
def detect_domain(df: DataFrame, text: str = "text", filename: str | None = None,
                  order: Sequence[str] = DOMAIN_ORDER, **kw) -> DataFrame:
    """per-domain scores, best domain (ties to the first in `order`, P6), its raw score,
    its share of the total as confidence, and the reference's confidence (best / max, which
    is 1.0 whenever any score is positive) as `confidence_parity`."""
    s = tx.domain_scores(text, filename, **kw)
    x = df.withColumn("_scores", s)
    total = sum((F.col("_scores")[d] for d in order), F.lit(0.0))
    best = tx.best_domain(F.col("_scores"), order)
    best_score = F.greatest(*[F.col("_scores")[d] for d in order])
    return (x.withColumn("domain", best)
            .withColumn("score", best_score)
            .withColumn("confidence", F.when(total > 0, best_score / total).otherwise(F.lit(0.0)))
            .withColumn("confidence_parity", F.when(best_score > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
            .withColumn("scores", F.col("_scores")).drop("_scores"))


# ----------------------------------------------------------------------------- J1
GENERAL = {
    # FIXED VALUES: the generic context used when a domain is unknown.
    "domain": "general", "domain_name": "General",
    "description": "General-purpose content",
}


def with_context(df: DataFrame, domains: DataFrame, name: str = "domain") -> DataFrame:
    """Attach the row's domain context (lower-cased name match); unknown names get the
    generic context. `domains` is the small dimension: broadcast."""
    d = domains.select(F.col("domain").alias("_ctx_key"), "domain_name", "description", "focus_areas",
                       "key_concepts", "fine_tuning_instructions")
    j = df.join(d, F.lower(F.col(name)) == F.col("_ctx_key"), "left")
    return (j.withColumn("context_found", F.col("_ctx_key").isNotNull())
            .withColumn("domain_name", F.coalesce("domain_name", F.lit(GENERAL["domain_name"])))
            .withColumn("description", F.coalesce("description", F.lit(GENERAL["description"])))
            .drop("_ctx_key"))


# ----------------------------------------------------------------------------- F12
_IND8 = " " * 8


def _block8(*parts) -> Column:
    """Lines joined by newline, every line indented by 8 spaces, with a leading newline and
    a trailing newline plus 8 spaces (the layout of the reference's multi-line templates)."""
    cols = []
    for p in parts:
        cols += [F.lit("\n" + _IND8), p if isinstance(p, Column) else F.lit(p)]
    cols.append(F.lit("\n" + _IND8))
    return F.concat(*cols)


def training_template(question: Column) -> Column:
    """F12 training template (needs domain_name, description, focus_areas, key_concepts,
    fine_tuning_instructions columns); `{question}` filled with `question`."""
    return _block8(
        F.concat(F.lit("You are an expert in "), F.col("domain_name"), F.lit(". "), F.col("description")),
        "",
        F.concat(F.lit("Key areas of expertise include: "), F.array_join("focus_areas", ", ")),
        "",
        "When responding, please:",
        "1. Apply domain-specific knowledge and terminology",
        F.concat(F.lit("2. Focus on "), F.array_join(F.slice("key_concepts", 1, 3), ", "), F.lit(" when relevant")),
        F.concat(F.lit("3. "), F.col("fine_tuning_instructions")),
        "",
        F.concat(F.lit("Question: "), question),
        "",
        "Provide a comprehensive, domain-expert response:")


def terminology_json(term_col: str = "terminology") -> Column:
    """`json.dumps(terminology, indent=2)` for an ordered array of (term, definition)."""
    esc = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    body = F.array_join(F.transform(F.col(term_col), lambda t: F.concat(
        F.lit('  "'), esc(t["term"]), F.lit('": "'), esc(t["definition"]), F.lit('"'))), ",\n")
    return F.when(F.size(term_col) == 0, F.lit("{}")).otherwise(F.concat(F.lit("{\n"), body, F.lit("\n}")))


def summarization_prompt(base_prompt: Column) -> Column:
    """F12 domain summarisation prompt around `base_prompt`."""
    return _block8(
        base_prompt, "",
        F.concat(F.lit("DOMAIN CONTEXT: "), F.col("domain_name")),
        F.col("description"), "",
        "KEY CONCEPTS TO FOCUS ON:", F.array_join("key_concepts", ", "), "",
        "FOCUS AREAS:", F.array_join("focus_areas", ", "), "",
        "DOMAIN-SPECIFIC INSTRUCTIONS:", F.col("summarization_instructions"), "",
        "TERMINOLOGY AWARENESS:", terminology_json(), "",
        "Please ensure your response incorporates domain expertise and uses appropriate terminology.")


def qa_system_prompt() -> Column:
    """F12 QA-pair generation system prompt with domain expertise lines."""
    base = ("You are an expert at creating high-quality training data for language models. "
            "Generate diverse, insightful question-answer pairs based on the provided summary.")
    return F.concat(F.lit(base),
                    F.lit("\n\nDOMAIN EXPERTISE: You are an expert in "), F.col("domain_name"), F.lit("."),
                    F.lit("\nFOCUS AREAS: "), F.array_join("focus_areas", ", "),
                    F.lit("\nKEY CONCEPTS: "), F.array_join("key_concepts", ", "),
                    F.lit("\nTERMINOLOGY: Use appropriate "), F.col("domain_name"), F.lit(" terminology."))


def qa_user_prompt(summary: Column) -> Column:
    return F.concat(F.lit("Based on the following summary, generate 3-5 diverse question-answer pairs "
                          "that capture the key insights and domain-specific concepts. "
                          "Format as JSON array with 'question' and 'answer' fields:\n\n"
                          "Summary: "), summary, F.lit("\n\nQuestion-Answer Pairs:"))


def fine_tuning_context(domains: DataFrame) -> DataFrame:
    """the fine-tuning configuration of each domain, as a JSON object (domain, config_json)."""
    cols = ["domain_type", "domain_name", "key_concepts", "focus_areas", "fine_tuning_instructions", "example_prompts", "evaluation_criteria"]
    terms = F.map_from_entries(F.transform("terminology", lambda t: F.struct(t["term"], t["definition"])))
    return domains.select("domain", F.to_json(F.struct(*cols, terms.alias("terminology"))).alias("config_json"))


# ---------------------------------------------------------------------------------------
# FIXED VALUES — base prompt templates by task: what follows the domain's own instructions, and the
# template of a domain without a context. `{{...}}` are filled later.
# ---------------------------------------------------------------------------------------
FOCUS_TEMPLATES = {
    "summarization": ("\n\n{{domain_knowledge}}\n\nKey concepts to focus on: {{key_concepts}}\n\nTerminology: {{terminology}}",
                      "Summarize the following content with focus on domain-specific concepts.\n\n{{domain_knowledge}}"),
    "fine_tuning": ("\n\n{{domain_knowledge}}\n\nEmphasize: {{key_concepts}}\n\nUse terminology: {{terminology}}",
                    "Generate training examples with domain expertise.\n\n{{domain_knowledge}}"),
}
INFERENCE_TEMPLATE = ("You are an expert in {{domain}}. {{domain_knowledge}}\n\nFocus on: {{key_concepts}}\n\nUse appropriate terminology: "
                      "{{terminology}}\n\nProvide expert guidance on the following:")
OTHER_TEMPLATE = "Apply domain expertise to address the following task.\n\n{{domain_knowledge}}\n\nKey concepts: {{key_concepts}}"


def focus_instruction(task: str) -> Column:
    """the base template of a task (summarization, fine_tuning, inference, any other) for the
    domain whose context is in the row (`summarization_instructions`, `fine_tuning_instructions`)."""
    if task not in FOCUS_TEMPLATES:
        return F.lit(INFERENCE_TEMPLATE if task == "inference" else OTHER_TEMPLATE)
    rest, without = FOCUS_TEMPLATES[task]
    own = F.col(f"{task}_instructions")
    return F.when(own.isNotNull(), F.concat(own, F.lit(rest))).otherwise(F.lit(without))


# ----------------------------------------------------------------------------- P-13
def list_domains(domains: DataFrame, n_concepts: int = 5) -> DataFrame:
    """P-13: domains with their first 5 key concepts and the total number of domains."""
    return domains.select("domain", "domain_name", F.slice("key_concepts", 1, n_concepts).alias("key_concepts"),
                          F.count(F.lit(1)).over(Window.partitionBy()).alias("total_domains"))

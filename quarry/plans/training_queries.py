"""Training-example queries: the flagship adaptive training set (U1/U2 over L4 ∪ J6), document
example expansion (J5), splits (W4), JSONL text (S15), validation (P-14, P-15), dedup (U2),
profiles and costs (A27, A29), text utilities (F24–F26, F29), U6."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.domains import domains_df, domains_values_sql
from quarry.functions.lexicons import AS_OF, TEST_LEXICON
from quarry.operators import feedback as fo
from quarry.operators import training as tr
from quarry.plans.catalog import query
from quarry.plans.feedback_queries import _ISSUES_SQL, _TREND_SQL, _WIN30, analysed
from quarry.sources.views import _WS, feedback_view, table, with_views

_DOMAIN_CASE = ("CASE {c} % 4 WHEN 0 THEN 'technical' WHEN 1 THEN 'medical' WHEN 2 THEN 'legal' "
                "ELSE 'financial' END")


def _docs(spark, sf):
    d = table(spark, sf, "documents")
    return d.withColumn("domain", F.when(F.col("doc_id") % 4 == 0, "technical")
                        .when(F.col("doc_id") % 4 == 1, "medical")
                        .when(F.col("doc_id") % 4 == 2, "legal").otherwise("financial"))


def adaptive_set(spark, sf, feedback_limit=200):
    """Flagship: feedback → analysis → recommendations → best feedback examples ∪ knowledge
    examples → exact dedup → ranked, per domain."""
    f = feedback_view(spark, sf)
    issues, analysis = analysed(spark, sf)
    recs = fo.recommendations(analysis, issues)
    fex = fo.feedback_examples(f, feedback_limit, TEST_LEXICON)
    kex = tr.knowledge_examples(recs, domains_df(spark), _docs(spark, sf))
    return tr.adaptive_training_set(fex, kex)


_FLAGSHIP_SQL = with_views(f"""
WITH win AS ({_WIN30}),
iss AS ({_ISSUES_SQL}),
an AS (SELECT domain, avg(rating) AS avg_rating, count(*) AS n FROM win GROUP BY domain),
trd AS ({_TREND_SQL.format(g='domain', out='rating_trend', src=_WIN30)}),
recs AS (
  SELECT domain, 0 AS seq, 'Overall rating is low. Consider expanding training data with high-quality examples.'
    AS description FROM an WHERE avg_rating < 3.5
  UNION ALL SELECT domain, 100 + rank, 'Address frequent issue: Issue related to ' || keyword
    FROM iss WHERE rank <= 3 AND frequency > 5
  UNION ALL SELECT domain, 200 + rank - 1, 'Critical knowledge gap identified in: ' || keyword FROM iss WHERE rank <= 5
  UNION ALL SELECT domain, 300, 'Model accuracy is declining. Consider retraining with recent data.'
    FROM trd WHERE rating_trend < -0.1),
imps AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY seq) AS imp_rank FROM recs)
         WHERE imp_rank <= 5
           AND domain IN (SELECT DISTINCT {_DOMAIN_CASE.format(c='doc_id')} FROM documents)),
kex AS (
  SELECT i.domain,
    to_json([{{'role': 'system', 'content': 'You are an expert in ' || dom.domain_name || '. Focus on ' || i.description
                 || '. ' || dom.fine_tuning_instructions}},
             {{'role': 'user', 'content': 'Please explain a key aspect of ' || i.description || ' in the context of '
                 || dom.domain_name || '.'}},
             {{'role': 'assistant', 'content': 'Based on the ' || dom.domain_name
                 || ' domain knowledge, here''s an explanation of ' || i.description || '...'}}])::VARCHAR AS messages_json,
    0.8 AS quality_score, CAST(NULL AS VARCHAR) AS improvement_type, CAST(NULL AS VARCHAR) AS feedback_id,
    'knowledge_base' AS source, 1 AS part, i.imp_rank * 1000 + t.e AS ord
  FROM imps i JOIN {domains_values_sql(("domain", "domain_name", "fine_tuning_instructions"))} ON dom.domain = i.domain
  CROSS JOIN range(3) t(e)),
fex AS (
  SELECT domain, to_json([{{'role': 'user', 'content': user_input}}, {{'role': 'assistant', 'content': assistant_content}}])::VARCHAR
      AS messages_json, q AS quality_score, improvement_type, CAST(feedback_id AS VARCHAR) AS feedback_id,
    'feedback' AS source, 0 AS part, rank AS ord
  FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY q DESC, ts, feedback_id) AS rank FROM (
          SELECT *,
            CASE WHEN is_corr THEN (CASE WHEN length(user_input) < 20 THEN greatest(1.0, qb - 0.5) ELSE qb END)
                 ELSE rating END AS q,
            CASE WHEN is_corr THEN 'correction' ELSE 'reinforcement' END AS improvement_type,
            CASE WHEN is_corr THEN correction ELSE model_output END AS assistant_content
          FROM (SELECT *, coalesce(correction <> '' AND user_input <> '', false) AS is_corr,
                  least(5.0, CASE WHEN rating IS NOT NULL AND rating <> 0 THEN rating ELSE 3.0 END + 1.0) AS qb
                FROM feedback_v)
          WHERE is_corr OR (rating IS NOT NULL AND rating <> 0 AND rating >= 4.0 AND model_output <> '')))
  WHERE rank <= 200),
u AS (SELECT * FROM fex UNION ALL SELECT * FROM kex),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain, messages_json ORDER BY part, ord) AS dr
                      FROM u) WHERE dr = 1)
SELECT domain, row_number() OVER (PARTITION BY domain ORDER BY quality_score DESC, part, ord) AS position,
  source, improvement_type, feedback_id, round(quality_score, 6) AS quality_score, messages_json
FROM dd""", "feedback_x")


@query("f_adaptive_training_set", _FLAGSHIP_SQL)
def f_adaptive_training_set(spark, sf):
    s = adaptive_set(spark, sf)
    return s.select("domain", "position", "source", "improvement_type", "feedback_id",
                    F.round("quality_score", 6).alias("quality_score"),
                    F.to_json("messages").alias("messages_json"))


@query("f_knowledge_examples", with_views(f"""
WITH win AS ({_WIN30}), iss AS ({_ISSUES_SQL}),
an AS (SELECT domain, avg(rating) AS avg_rating FROM win GROUP BY domain),
recs AS (
  SELECT domain, 0 AS seq, 'Overall rating is low. Consider expanding training data with high-quality examples.'
    AS description FROM an WHERE avg_rating < 3.5
  UNION ALL SELECT domain, 100 + rank, 'Address frequent issue: Issue related to ' || keyword
    FROM iss WHERE rank <= 3 AND frequency > 5
  UNION ALL SELECT domain, 200 + rank - 1, 'Critical knowledge gap identified in: ' || keyword FROM iss WHERE rank <= 5),
imps AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY seq) AS imp_rank FROM recs)
         WHERE imp_rank <= 5)
SELECT i.domain, i.description AS improvement_focus, i.imp_rank, t.e AS example_no,
  'Please explain a key aspect of ' || i.description || ' in the context of ' || dom.domain_name || '.' AS user_content
FROM imps i JOIN {domains_values_sql(("domain", "domain_name"))} ON dom.domain = i.domain CROSS JOIN range(3) t(e)
""", "feedback_x"))
def f_knowledge_examples(spark, sf):
    issues, analysis = analysed(spark, sf)
    recs = fo.recommendations(analysis, issues, trend_threshold=-1e9)
    k = tr.knowledge_examples(recs, domains_df(spark))
    return k.select("domain", "improvement_focus", F.col("imp_rank").cast("long").alias("imp_rank"),
                    F.col("example_no").cast("long").alias("example_no"),
                    F.col("messages")[1]["content"].alias("user_content"))


@query("f_dedup_examples", with_views("""
SELECT domain, first_feedback_id, copies FROM (
  SELECT domain, user_input, correction, min(feedback_id) AS first_feedback_id, count(*) AS copies
  FROM feedback_v WHERE correction IS NOT NULL GROUP BY domain, user_input, correction)""", "feedback_v"))
def f_dedup_examples(spark, sf):
    f = feedback_view(spark, sf).filter(F.col("correction").isNotNull())
    ex = f.select("domain", "feedback_id", tr.to_messages(None, "user_input", "correction").alias("messages"))
    d = tr.dedup_examples(ex.withColumn("copies", F.lit(1)), ["domain"], ["feedback_id"])
    cnt = ex.groupBy("domain", "messages").agg(F.count(F.lit(1)).alias("copies"))
    return d.drop("copies").join(cnt, ["domain", "messages"]).select(
        "domain", F.col("feedback_id").alias("first_feedback_id"), "copies")


# ----------------------------------------------------------------------------- J5, F11, W4, S15
@query("f_example_expand", with_views(f"""
SELECT d.doc_id, t.example_type, dom.domain,
  replace(t.prefix, '{{name}}', dom.domain_name) AS prompt_prefix,
  length(replace(t.prefix, '{{name}}', dom.domain_name) || chr(10) || chr(10) || d.text) AS user_prompt_chars,
  md5(replace(t.prefix, '{{name}}', dom.domain_name) || chr(10) || chr(10) || d.text) AS user_prompt_md5,
  'You are an expert in ' || dom.domain_name || '. ' || dom.description AS system_prompt
FROM documents d
JOIN {domains_values_sql(("domain", "domain_name", "description"))} ON dom.domain = {_DOMAIN_CASE.format(c='d.doc_id')}
CROSS JOIN (VALUES ('summarization', 'Summarize the following {{name}} content:'),
                   ('qa', 'Generate a question and answer based on this {{name}} content:'),
                   ('explanation', 'Explain the key concepts in this {{name}} content:'),
                   ('analysis', 'Analyze the main points in this {{name}} content:')) t(example_type, prefix)"""))
def f_example_expand(spark, sf):
    x = tr.expand_example_types(_docs(spark, sf), domains_df(spark))
    return x.select("doc_id", "example_type", "domain", "prompt_prefix",
                    F.length("user_prompt").cast("long").alias("user_prompt_chars"),
                    F.md5(F.col("user_prompt").cast("binary")).alias("user_prompt_md5"), "system_prompt")


@query("f_messages", with_views(f"""
SELECT d.doc_id,
  to_json([{{'role': 'system', 'content': 'You are an expert in ' || dom.domain_name || '. ' || dom.description}},
           {{'role': 'user', 'content': 'Summarize the following ' || dom.domain_name || ' content:' || chr(10) || chr(10) || d.text}},
           {{'role': 'assistant', 'content': d.source}}])::VARCHAR AS messages_json
FROM documents d
JOIN {domains_values_sql(("domain", "domain_name", "description"))} ON dom.domain = {_DOMAIN_CASE.format(c='d.doc_id')}"""))
def f_messages(spark, sf):
    x = tr.expand_example_types(_docs(spark, sf), domains_df(spark), types=tr.EXAMPLE_TYPES[:1])
    m = tr.to_messages(F.col("system_prompt"), "user_prompt", "source")
    return x.select("doc_id", F.to_json(m).alias("messages_json"))


@query("f_train_val_split", with_views("""
SELECT feedback_id, position, CASE WHEN position < CAST(floor(n * 0.9) AS BIGINT) THEN 'train' ELSE 'validation' END AS split
FROM (SELECT feedback_id, row_number() OVER (ORDER BY ts, feedback_id) - 1 AS position, count(*) OVER () AS n
      FROM feedback_v WHERE correction IS NOT NULL)""", "feedback_v"))
def f_train_val_split(spark, sf):
    f = feedback_view(spark, sf).filter(F.col("correction").isNotNull()).select("feedback_id", "ts")
    s = tr.split_positional(f, ["ts", "feedback_id"], 0.1)
    return s.select("feedback_id", "position", "split")


@query("f_split_by_document", """
SELECT doc_id, CASE WHEN ('0x' || substr(sha256('42:' || doc_id), 1, 13))::BIGINT / 2.0 ** 52 < 0.1 THEN 'validation' ELSE 'train' END AS split,
  4 AS examples FROM documents""")
def f_split_by_document(spark, sf):
    """W4 at scale: the 4 examples of a document stay on one side (hash of doc_id)."""
    x = tr.expand_example_types(_docs(spark, sf), domains_df(spark))
    s = tr.split_hash(x, "doc_id", 0.1)
    return s.groupBy("doc_id", "split").agg(F.count(F.lit(1)).alias("examples"))


@query("f_jsonl_lines", with_views("""
SELECT feedback_id, to_json({'messages': [{'role': 'user', 'content': user_input},
                                          {'role': 'assistant', 'content': correction}],
                             'domain': domain, 'feedback_id': feedback_id})::VARCHAR AS line
FROM feedback_v WHERE correction IS NOT NULL""", "feedback_v"))
def f_jsonl_lines(spark, sf):
    f = feedback_view(spark, sf).filter(F.col("correction").isNotNull())
    ex = f.select("feedback_id", "domain", tr.to_messages(None, "user_input", "correction").alias("messages"))
    return tr.jsonl_lines(ex, ["messages", "domain", "feedback_id"]).select("feedback_id", F.col("value").alias("line"))


@query("f_valid_pairs", with_views("""
SELECT feedback_id FROM feedback_v
WHERE user_comment IS NOT NULL AND user_comment <> '' AND model_output IS NOT NULL AND model_output <> ''"""
                                   , "feedback_v"))
def f_valid_pairs(spark, sf):
    f = feedback_view(spark, sf).select("feedback_id", F.col("user_comment").alias("question"),
                                         F.col("model_output").alias("answer"))
    return tr.valid_pairs(f).select("feedback_id")


@query("f_validate_examples", with_views("""
SELECT feedback_id, CASE feedback_id % 9 WHEN 1 THEN 'no_messages' WHEN 2 THEN 'unknown_role' WHEN 3 THEN 'too_few_turns'
    WHEN 4 THEN 'bad_turn_order' WHEN 5 THEN 'no_final_answer' ELSE
  CASE WHEN feedback_id % 9 = 7 OR length(user_input) < 1 OR model_output IS NULL OR length(model_output) < 1 THEN 'empty_content'
       WHEN length(user_input) > 900 OR length(model_output) > 900 THEN 'content_too_long'
       WHEN length(user_input) + length(model_output) + (CASE WHEN feedback_id % 9 = 6 THEN 18 ELSE 0 END) > 1200
       THEN 'example_too_long' END END AS reject_reason
FROM feedback_v""", "feedback_v"))
def f_validate_examples(spark, sf):
    """Conversations of all kinds that are rejected: without messages, with an unknown role, one turn, turns
    out of order, no answer at the end, empty and long contents, and long in all."""
    f = feedback_view(spark, sf)

    def m(role, content):
        return F.struct(F.lit(role).alias("role"), (content if isinstance(content, Column) else F.lit(content)).alias("content"))
    q, a, kind = F.col("user_input"), F.col("model_output"), F.col("feedback_id") % 9
    messages = (F.when(kind == 1, F.array().cast("array<struct<role:string,content:string>>"))
                .when(kind == 2, F.array(m("user", q), m("robot", a)))
                .when(kind == 3, F.array(m("system", "You are an expert."), m("user", q)))
                .when(kind == 4, F.array(m("user", q), m("user", a)))
                .when(kind == 5, F.array(m("user", q), m("assistant", a), m("user", q)))
                .when(kind == 6, F.array(m("system", "You are an expert."), m("user", q), m("assistant", a)))
                .when(kind == 7, F.array(m("user", q), m("assistant", "")))
                .otherwise(tr.to_messages(None, "user_input", "model_output")))
    return tr.validate_examples(f.select("feedback_id", messages.alias("messages")), 1, 900, 1200).select("feedback_id", "reject_reason")


# ----------------------------------------------------------------------------- L6, J7, J13, A29
_BENCH_COUNTS_SQL = f"SELECT {_DOMAIN_CASE.format(c='item_id')} AS domain, count(*) AS count FROM benchmark GROUP BY 1"


def _bench_counts(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.groupBy(F.when(F.col("item_id") % 4 == 0, "technical").when(F.col("item_id") % 4 == 1, "medical")
                     .when(F.col("item_id") % 4 == 2, "legal").otherwise("financial").alias("domain")) \
        .agg(F.count(F.lit(1)).alias("count"))


_EVAL_SQL = f"""
SELECT c.domain, CAST(i AS INTEGER) AS prompt_no,
  CASE WHEN i < len(dom.example_prompts) THEN dom.example_prompts[i % len(dom.example_prompts) + 1]
       ELSE 'In the context of ' || dom.focus_areas[1] || ', ' || lower(dom.example_prompts[i % len(dom.example_prompts) + 1])
  END AS prompt
FROM ({_BENCH_COUNTS_SQL}) c JOIN {domains_values_sql(("domain", "example_prompts", "focus_areas"))} ON dom.domain = c.domain
CROSS JOIN LATERAL (SELECT unnest(range(c.count)) AS i)"""


@query("f_eval_prompts", _EVAL_SQL)
def f_eval_prompts(spark, sf):
    p = tr.eval_prompts(domains_df(spark), _bench_counts(spark, sf))
    return p.select("domain", F.col("prompt_no").cast("int").alias("prompt_no"), "prompt")


from quarry.plans import registry_queries as _registry  # noqa: E402  (defines the models_v view)


@query("f_eval_plan", with_views(f"""
SELECT m.model_id, e.prompt_no, e.prompt FROM models_v m JOIN ({_EVAL_SQL}) e ON e.domain = m.domain""", "models_v"))
def f_eval_plan(spark, sf):
    models_view = _registry.models_view
    p = tr.eval_prompts(domains_df(spark), _bench_counts(spark, sf))
    plan = tr.eval_plan(models_view(spark, sf), p)
    return plan.select("model_id", F.col("prompt_no").cast("int").alias("prompt_no"), "prompt")


@query("f_domain_mapping", f"""
SELECT d.doc_id, m.domain FROM (SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS file_name, source
                                 FROM documents) d
LEFT JOIN (SELECT DISTINCT source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS file_name,
             CASE CAST(substr(source, 4) AS INTEGER) % 4 WHEN 0 THEN 'technical' WHEN 1 THEN 'medical'
               WHEN 2 THEN 'legal' ELSE 'financial' END AS domain
           FROM documents WHERE length(source) = 4) m USING (file_name)""")
def f_domain_mapping(spark, sf):
    """J13 over a file name for each document; the mapping knows sources by their number (fixture choice)."""
    docs = table(spark, sf, "documents")
    files = docs.select("doc_id", F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
                        .alias("file_name"))
    n = F.substring("source", 4, 10).cast("int") % 4
    mapping = docs.filter(F.length("source") == 4).select(
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"),
        F.when(n == 0, "technical").when(n == 1, "medical").when(n == 2, "legal").otherwise("financial").alias("domain"))
    return tr.apply_domain_mapping(files, mapping.distinct()).select("doc_id", "domain")


@query("f_training_profile", with_views(f"""
SELECT domain, count(*) AS examples,
  CAST(sum(len([w for w in regexp_split_to_array(user_input || ' ' || assistant_content, '{_WS}') if w <> ''])) AS BIGINT)
    AS words,
  round(avg(length(user_input || ' ' || assistant_content)), 6) AS mean_chars, count(DISTINCT user_input) AS distinct_prompts
FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY q DESC, ts, feedback_id) AS rank FROM (
        SELECT *, CASE WHEN is_corr THEN (CASE WHEN length(user_input) < 20 THEN greatest(1.0, qb - 0.5) ELSE qb END)
                       ELSE rating END AS q,
          CASE WHEN is_corr THEN correction ELSE model_output END AS assistant_content
        FROM (SELECT *, coalesce(correction <> '' AND user_input <> '', false) AS is_corr,
                least(5.0, CASE WHEN rating IS NOT NULL AND rating <> 0 THEN rating ELSE 3.0 END + 1.0) AS qb
              FROM feedback_v)
        WHERE is_corr OR (rating IS NOT NULL AND rating <> 0 AND rating >= 4.0 AND model_output <> '')))
WHERE rank <= 100 GROUP BY domain""", "feedback_v"))
def f_training_profile(spark, sf):
    ex = fo.feedback_examples(feedback_view(spark, sf), 100, TEST_LEXICON)
    p = tr.training_profile(ex)
    return p.select("domain", "examples", "words", F.round("mean_chars", 6).alias("mean_chars"), "distinct_prompts")

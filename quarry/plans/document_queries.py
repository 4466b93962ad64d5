"""Document and domain-context queries (W13, F5–F7, F10, F12, F13, F27, F28, F30, F31, J1, J16,
P-13, P-16, A23–A25, A26b, W5, S20)."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions.domains import domains_df, domains_values_sql, sql_list
from quarry.functions.lexicons import (AS_OF, DOMAIN_ORDER, FILENAME_DOMAIN_PATTERNS, TEST_LEXICON,
                                       WS_CLASS)
from quarry.operators import context as co
from quarry.operators import documents as do
from quarry.operators import feedback as fo
from quarry.operators import knowledge as ko
from quarry.plans.catalog import query
from quarry.plans.feedback_queries import AS_OF_SQL, fbx
from quarry.plans.knowledge_queries import kb
from quarry.plans.topk import top_terms
from quarry.sources.views import _WS, feedback_view, knowledge_view, requests_view, table, with_views

_DOMAIN_CASE = ("CASE {c} % 4 WHEN 0 THEN 'technical' WHEN 1 THEN 'medical' WHEN 2 THEN 'legal' "
                "ELSE 'financial' END")
def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS_CLASS}]+|[{WS_CLASS}]+$', '', 'g')"
_IND = "        "


def _dom(col):
    return (F.when(F.col(col) % 4 == 0, "technical").when(F.col(col) % 4 == 1, "medical")
            .when(F.col(col) % 4 == 2, "legal").otherwise("financial"))


def _r(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def _words_sql(x: str) -> str:
    return f"[w for w in regexp_split_to_array({x}, '{_WS}') if w <> '']"


# ----------------------------------------------------------------------------- W13
@query("f_segments", f"""
WITH p AS (SELECT doc_id, [y for y in [{_strip_sql('x')} for x in string_split(text, chr(10))] if y <> ''] AS paras
           FROM documents),
e AS (SELECT doc_id, unnest(paras) AS original_text, unnest(range(len(paras))) AS ordinal FROM p)
SELECT 'doc' || doc_id || '_segment_' || ordinal AS segment_id, doc_id, CAST(ordinal AS INTEGER) AS ordinal, word_count
FROM (SELECT *, CAST(len({_words_sql('original_text')}) AS BIGINT) AS word_count FROM e) WHERE word_count >= 50""")
def f_segments(spark, sf):
    d = table(spark, sf, "documents")
    s = do.segments(d, "doc_id", "text", base=F.concat(F.lit("doc"), F.col("doc_id").cast("string")),
                    separator="\n", min_words=50)
    return s.select("segment_id", "doc_id", "ordinal", "word_count")


# ----------------------------------------------------------------------------- F5
def _detect_sql() -> str:
    parts = []
    for d, terms in TEST_LEXICON.items():
        w = repr(1.0 / len(terms))
        s = "CAST(0.0 AS DOUBLE)"
        for t in terms:
            s = (f"({s} + CAST(floor((length(low) - length(replace(low, '{t}', ''))) / {len(t)}) AS BIGINT)"
                 f" * CAST('{w}' AS DOUBLE))")
        fs = " + ".join(f"CASE WHEN contains(fname, '{p}') THEN 1.0 ELSE 0.0 END"
                        for p in FILENAME_DOMAIN_PATTERNS[d])
        parts.append(f"({s} + CAST(({fs}) AS DOUBLE) * CAST('0.3' AS DOUBLE)) AS s_{d}")
    o = DOMAIN_ORDER
    best = "CASE"
    for i, d in enumerate(o):
        conds = [f"s_{d} > s_{e}" for e in o[:i]] + [f"s_{d} >= s_{e}" for e in o[i + 1:]]
        best += f" WHEN {' AND '.join(conds)} THEN '{d}'"
    best += " END"
    g = "greatest(" + ", ".join(f"s_{d}" for d in o) + ")"
    tot = " + ".join(f"s_{d}" for d in o)
    return f"""
SELECT doc_id, {best} AS domain, round({g}, 6) AS score,
  round(CASE WHEN {tot} > 0 THEN {g} / ({tot}) ELSE 0.0 END, 6) AS confidence,
  CAST(CASE WHEN {g} > 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS confidence_parity
FROM (SELECT doc_id, {", ".join(parts)} FROM (SELECT doc_id, lower(text) AS low, lower(source) AS fname FROM documents))"""


@query("f_detect_domain", _detect_sql())
def f_detect_domain(spark, sf):
    d = do.detect_domain(table(spark, sf, "documents"), "text", "source",
                         content_terms=TEST_LEXICON, filename_patterns=FILENAME_DOMAIN_PATTERNS)
    return d.select("doc_id", "domain", _r("score").alias("score"), _r("confidence").alias("confidence"),
                    "confidence_parity")


# ----------------------------------------------------------------------------- F6, F7
def _from_name_sql(x: str) -> str:
    out = "CASE"
    for d, ts in TEST_LEXICON.items():
        out += " WHEN " + " OR ".join(f"contains(lower({x}), '{t}')" for t in ts) + f" THEN '{d}'"
    return out + " END"


_TITLE = r"regexp_extract(html, '<title>(.*?)</title>', 1)"


@query("f_domain_from_name", f"SELECT page_id, {_from_name_sql(_TITLE)} AS domain FROM pages")
def f_domain_from_name(spark, sf):
    p = table(spark, sf, "pages").withColumn("title", F.regexp_extract("html", r"<title>(.*?)</title>", 1))
    return p.select("page_id", tx.domain_from_name("title", TEST_LEXICON).alias("domain"))


_NAME_SQL = ("CASE doc_id % 6 WHEN 0 THEN 'in/medical_' WHEN 1 THEN 'Legal_' WHEN 2 THEN 'sports_' "
             "WHEN 3 THEN '_' WHEN 4 THEN 'a/b/financial.' ELSE '' END || source || '.txt'")


@query("f_domain_from_prefix", f"""
SELECT doc_id, name,
  CASE WHEN contains(stem, '_') AND lower(split_part(stem, '_', 1)) IN ('technical', 'medical', 'legal', 'financial')
       THEN lower(split_part(stem, '_', 1)) ELSE 'general' END AS domain
FROM (SELECT doc_id, name, regexp_replace(regexp_extract(name, '[^/]*$'), '\\.[^.]*$', '') AS stem
      FROM (SELECT doc_id, {_NAME_SQL} AS name FROM documents))""")
def f_domain_from_prefix(spark, sf):
    d = table(spark, sf, "documents")
    m = F.col("doc_id") % 6
    name = F.concat(F.when(m == 0, "in/medical_").when(m == 1, "Legal_").when(m == 2, "sports_")
                    .when(m == 3, "_").when(m == 4, "a/b/financial.").otherwise(""), F.col("source"), F.lit(".txt"))
    x = d.select("doc_id", name.alias("name"))
    return x.select("doc_id", "name", tx.domain_from_prefix("name").alias("domain"))


# ----------------------------------------------------------------------------- J1, P-13
@query("f_domain_lookup", with_views(f"""
SELECT f.feedback_id, coalesce(d.domain_name, 'General') AS domain_name, d.domain IS NOT NULL AS context_found
FROM (SELECT feedback_id, CASE WHEN user_id % 5 = 0 THEN 'Unknown' ELSE upper(domain) END AS name FROM feedback_v) f
LEFT JOIN {domains_values_sql(("domain", "domain_name")).replace(" AS dom(", " AS d(")} ON d.domain = lower(f.name)""",
                                    "feedback_v"))
def f_domain_lookup(spark, sf):
    f = feedback_view(spark, sf).select(
        "feedback_id", F.when(F.col("user_id") % 5 == 0, "Unknown").otherwise(F.upper("domain")).alias("name"))
    j = do.with_context(f, domains_df(spark), "name")
    return j.select("feedback_id", "domain_name", "context_found")


@query("f_list_domains", f"""
SELECT dom.domain, dom.domain_name, array_to_string(dom.key_concepts[1:5], ', ') AS key_concepts,
  count(*) OVER () AS total_domains
FROM {domains_values_sql(("domain", "domain_name", "key_concepts"))}
WHERE dom.domain IN (SELECT DISTINCT {_DOMAIN_CASE.format(c='doc_id')} FROM documents)""")
def f_list_domains(spark, sf):
    """P-13: the built-in domains that documents have (f_domain_listing joins models and adapters)."""
    present = table(spark, sf, "documents").select(_dom("doc_id").alias("domain")).distinct()
    d = domains_df(spark).join(present, "domain", "left_semi")
    return do.list_domains(d).select("domain", "domain_name", F.array_join("key_concepts", ", ").alias("key_concepts"),
                                     "total_domains")


# ----------------------------------------------------------------------------- F12
def _block_sql(*lines: str) -> str:
    return "".join(f"chr(10) || '{_IND}' || {ln} || " for ln in lines) + f"chr(10) || '{_IND}'"


_TRAIN_TPL_SQL = _block_sql(
    "'You are an expert in ' || dom.domain_name || '. ' || dom.description", "''",
    "'Key areas of expertise include: ' || array_to_string(dom.focus_areas, ', ')", "''",
    "'When responding, please:'", "'1. Apply domain-specific knowledge and terminology'",
    "'2. Focus on ' || array_to_string(dom.key_concepts[1:3], ', ') || ' when relevant'",
    "'3. ' || dom.fine_tuning_instructions", "''", "'Question: ' || d.text", "''",
    "'Provide a comprehensive, domain-expert response:'")


@query("f_prompts", f"""
SELECT d.doc_id, {_TRAIN_TPL_SQL} AS training_prompt,
  'You are an expert at creating high-quality training data for language models. '
  || 'Generate diverse, insightful question-answer pairs based on the provided summary.'
  || chr(10) || chr(10) || 'DOMAIN EXPERTISE: You are an expert in ' || dom.domain_name || '.'
  || chr(10) || 'FOCUS AREAS: ' || array_to_string(dom.focus_areas, ', ')
  || chr(10) || 'KEY CONCEPTS: ' || array_to_string(dom.key_concepts, ', ')
  || chr(10) || 'TERMINOLOGY: Use appropriate ' || dom.domain_name || ' terminology.' AS qa_system
FROM documents d JOIN {domains_values_sql(("domain", "domain_name", "description", "focus_areas", "key_concepts",
                                           "fine_tuning_instructions"))} ON dom.domain = {_DOMAIN_CASE.format(c='d.doc_id')}""")
def f_prompts(spark, sf):
    d = table(spark, sf, "documents").withColumn("domain", _dom("doc_id"))
    x = d.join(domains_df(spark), "domain")
    return x.select("doc_id", do.training_template(F.col("text")).alias("training_prompt"),
                    do.qa_system_prompt().alias("qa_system"))


_TERM_JSON_SQL = ("'{' || chr(10) || array_to_string([('  \"' || z[1] || '\": \"' || z[2] || '\"') "
                  "for z in list_zip(dom.terminology_terms, dom.terminology_defs)], ',' || chr(10)) || chr(10) || '}'")


def _summary_sql(base: str) -> str:
    return _block_sql(
        base, "''", "'DOMAIN CONTEXT: ' || dom.domain_name", "dom.description", "''",
        "'KEY CONCEPTS TO FOCUS ON:'", "array_to_string(dom.key_concepts, ', ')", "''",
        "'FOCUS AREAS:'", "array_to_string(dom.focus_areas, ', ')", "''",
        "'DOMAIN-SPECIFIC INSTRUCTIONS:'", "dom.summarization_instructions", "''",
        "'TERMINOLOGY AWARENESS:'", _TERM_JSON_SQL, "''",
        "'Please ensure your response incorporates domain expertise and uses appropriate terminology.'")


def _summary_domains_sql() -> str:
    return domains_values_sql(("domain", "domain_name", "description", "focus_areas", "key_concepts",
                               "summarization_instructions", "terminology_terms", "terminology_defs"))


@query("f_summary_prompt", f"""
SELECT d.doc_id, {_summary_sql("d.text")} AS prompt
FROM documents d JOIN {_summary_domains_sql()} ON dom.domain = {_DOMAIN_CASE.format(c='d.doc_id')}""")
def f_summary_prompt(spark, sf):
    d = table(spark, sf, "documents").withColumn("domain", _dom("doc_id"))
    x = d.join(domains_df(spark), "domain")
    return x.select("doc_id", do.summarization_prompt(F.col("text")).alias("prompt"))


# ----------------------------------------------------------------------------- F10, F27, F28
@query("f_slugs", with_views(f"""
SELECT f.feedback_id, f.domain || '_' || f.model_id || '_' || strftime(f.ts, '%Y%m%d_%H%M%S_%f') AS entry_key,
  replace(lower(dom.domain_name), ' ', '-') AS domain_slug
FROM feedback_v f JOIN {domains_values_sql(("domain", "domain_name"))} ON dom.domain = f.domain""", "feedback_v"))
def f_slugs(spark, sf):
    f = feedback_view(spark, sf).join(domains_df(spark).select("domain", "domain_name"), "domain")
    return f.select("feedback_id",
                    F.concat_ws("_", "domain", "model_id", F.date_format("ts", "yyyyMMdd_HHmmss_SSSSSS")).alias("entry_key"),
                    tx.slug("domain_name").alias("domain_slug"))


@query("f_ids", with_views("""
SELECT feedback_id, 'deploy_' || model_id || '_' || CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS deployment_id,
  'adaptive_retraining_' || domain || '_' || CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS job_id,
  'mentor_ad' || (user_id % 5) || '_' || strftime(ts, '%Y%m%d_%H%M%S') AS session_id,
  replace(lower(model_output), ' ', '_') AS underscored
FROM feedback_v""", "feedback_v"))
def f_ids(spark, sf):
    f = feedback_view(spark, sf)
    adapter = F.concat(F.lit("ad"), (F.col("user_id") % 5).cast("string"))
    return f.select("feedback_id", tx.deployment_id("model_id", "ts").alias("deployment_id"),
                    tx.job_id("adaptive_retraining", "domain", "ts").alias("job_id"),
                    tx.session_id(adapter, "ts").alias("session_id"), tx.slug_underscored("model_output").alias("underscored"))


_TASKS = ["summarization", "fine_tuning", "inference", "review"]


def _sql_text(x: str) -> str:
    return " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in x.split("\n"))


@query("f_focus_instruction", f"""
SELECT d.doc_id, {", ".join(
    f"CASE WHEN dom.domain IS NULL THEN {_sql_text(do.FOCUS_TEMPLATES[t][1])} ELSE dom.{t}_instructions || {_sql_text(do.FOCUS_TEMPLATES[t][0])} END AS {t}"
    for t in _TASKS[:2])}, {_sql_text(do.INFERENCE_TEMPLATE)} AS inference, {_sql_text(do.OTHER_TEMPLATE)} AS review,
  md5(array_to_string(dom.focus_areas, ',') || '|' || array_to_string(dom.key_concepts, ',') || '|' || dom.fine_tuning_instructions) AS context_md5
FROM documents d LEFT JOIN {domains_values_sql(("domain", "focus_areas", "key_concepts", "summarization_instructions", "fine_tuning_instructions"))}
  ON dom.domain = CASE WHEN d.doc_id % 5 < 4 THEN {_DOMAIN_CASE.format(c='d.doc_id')} END""")
def f_focus_instruction(spark, sf):
    """each document gets the base templates of its domain (a fifth have none), and the fine-tuning
    context read back from its JSON."""
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 5 < 4, _dom("doc_id")).alias("domain"))
    doms = domains_df(spark)
    schema = "focus_areas array<string>, key_concepts array<string>, fine_tuning_instructions string"
    ctx = do.fine_tuning_context(doms).select("domain", F.from_json("config_json", schema).alias("c"))
    x = d.join(doms.select("domain", "summarization_instructions", "fine_tuning_instructions"), "domain", "left").join(ctx, "domain", "left")
    said = F.concat(F.array_join("c.focus_areas", ","), F.lit("|"), F.array_join("c.key_concepts", ","), F.lit("|"), F.col("c.fine_tuning_instructions"))
    return x.select("doc_id", *[do.focus_instruction(t).alias(t) for t in _TASKS], F.md5(said.cast("binary")).alias("context_md5"))


@query("f_mask", """
SELECT page_id, CASE WHEN length(url) <= 8 THEN repeat('*', length(url))
  ELSE substr(url, 1, 4) || repeat('*', length(url) - 8) || substr(url, length(url) - 3, 4) END AS masked
FROM pages""")
def f_mask(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.mask_secret("url").alias("masked"))


@query("f_days_since", f"""
SELECT event_id, CAST(floor((epoch_us({AS_OF_SQL}) - epoch_us(ts)) / 86400000000) AS BIGINT) AS days FROM events""")
def f_days_since(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", tx.whole_days_between(F.col("ts"), F.lit(AS_OF)).alias("days"))


# ----------------------------------------------------------------------------- F30
@query("f_custom_domain", with_views(f"""
WITH kw AS (
  SELECT source, term, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min(doc_id * 1000 + pos)) AS rank
  FROM (SELECT source, doc_id, unnest(keywords) AS term, unnest(range(len(keywords))) AS pos FROM knowledge_v)
  GROUP BY source, term),
c AS (SELECT source, list(term ORDER BY rank) AS key_concepts FROM kw WHERE rank <= 5 GROUP BY source),
f AS (SELECT source, list_sort(list_distinct(list(lang))) AS focus_areas FROM documents GROUP BY source)
SELECT c.source AS domain_name,
  'Focus on ' || array_to_string(f.focus_areas[1:3], ', ') || ' when summarizing ' || c.source || ' content.'
    AS summarization_instructions,
  'Emphasize ' || array_to_string(c.key_concepts[1:3], ', ') || ' in training examples for ' || c.source || '.'
    AS fine_tuning_instructions,
  array_to_string([('Explain ' || x || ' in the context of ' || c.source) for x in c.key_concepts[1:3]], '|')
    AS example_prompts,
  array_to_string(c.key_concepts[1:4], ',') AS priority_concepts
FROM c JOIN f ON f.source = c.source""", "knowledge_v"))
def f_custom_domain(spark, sf):
    k = knowledge_view(spark, sf)
    top = top_terms(k, ["source"], F.col("keywords"), ["doc_id"], 5, term_col="term")
    kc = top.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))),
                                               lambda s: s["term"]).alias("key_concepts"))
    fa = table(spark, sf, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("focus_areas"))
    base = kc.join(fa, "source").select(F.col("source").alias("domain_name"), "key_concepts", "focus_areas",
                                        F.lit("").alias("description"),
                                        F.array().cast("array<struct<term:string,definition:string>>").alias("terminology"))
    c = co.custom_domain(base)
    return c.select("domain_name", "summarization_instructions", "fine_tuning_instructions",
                    F.array_join("example_prompts", "|").alias("example_prompts"),
                    F.array_join("priority_concepts", ",").alias("priority_concepts"))


# ----------------------------------------------------------------------------- J16, P-16, F13
def _merged(spark, sf, context_type="focused"):
    k = kb(spark, sf)
    entries = ko.top_entries(k, 10)
    ctx = co.merge_context(domains_df(spark), entries, co.rules_df(spark), max_entries=5)
    return co.trim_context(ctx, context_type)


def _merged_sql() -> str:
    rules = "(VALUES " + ", ".join(
        f"('{d}', {sql_list(r['required_terminology'])})" for d, r in co.ENHANCEMENT_RULES.items()) + ") AS r(domain, req)"
    return f"""
WITH ent AS (SELECT * FROM (SELECT domain, id, content, keywords, concepts,
               row_number() OVER (PARTITION BY domain ORDER BY importance_score DESC, doc_id) AS rank FROM kb_v)
             WHERE rank <= 5),
cpos AS (SELECT domain, c, min(p) AS p FROM (
           SELECT dom.domain, unnest(dom.key_concepts) AS c, unnest(range(len(dom.key_concepts))) AS p
           FROM {domains_values_sql(("domain", "key_concepts"))}
           UNION ALL
           SELECT domain, unnest(concepts) AS c, 1000 + rank * 100 + unnest(range(len(concepts))) AS p FROM ent)
         GROUP BY domain, c),
kc AS (SELECT domain, list(c ORDER BY p) AS key_concepts FROM cpos GROUP BY domain),
tpos AS (SELECT domain, t, min(p) AS p, min_by(kind, p) AS kind, min_by(def, p) AS def FROM (
           SELECT dom.domain, unnest(dom.terminology_terms) AS t, unnest(range(len(dom.terminology_terms))) AS p, 0 AS kind,
             unnest(dom.terminology_defs) AS def
           FROM {domains_values_sql(("domain", "terminology_terms", "terminology_defs"))}
           UNION ALL
           SELECT domain, unnest(keywords) AS t, 1000 + rank * 100 + unnest(range(len(keywords))) AS p, 1 AS kind,
             NULL AS def FROM ent
           UNION ALL
           SELECT domain, unnest(req) AS t, 100000 + unnest(range(len(req))) AS p, 2 AS kind, NULL AS def FROM {rules})
         GROUP BY domain, t),
tm AS (SELECT tpos.domain, list(t ORDER BY p) AS terms, list(kind ORDER BY p) AS kinds,
         list(CASE kind WHEN 0 THEN def WHEN 1 THEN 'Domain-specific term in ' || dn.domain_name
                        ELSE 'Essential ' || dn.domain_name || ' concept' END ORDER BY p) AS defs
       FROM tpos JOIN {domains_values_sql(("domain", "domain_name")).replace(" AS dom(", " AS dn(")} ON dn.domain = tpos.domain
       GROUP BY tpos.domain),
ke AS (SELECT domain, list(content ORDER BY rank) AS contents FROM ent GROUP BY domain)"""


@query("f_merge_context", with_views(_merged_sql() + f"""
SELECT kc.domain, array_to_string(kc.key_concepts[1:10], ',') AS key_concepts,
  CAST(len(tm.terms) AS INTEGER) AS n_terms, array_to_string(tm.terms, ',') AS terms,
  CAST(len(list_filter(tm.kinds, lambda x: x = 2)) AS INTEGER) AS n_required
FROM kc JOIN tm USING (domain)""", "kb_v"))
def f_merge_context(spark, sf):
    m = _merged(spark, sf, "focused")
    return m.select("domain", F.array_join("key_concepts", ",").alias("key_concepts"),
                    F.size("terminology").alias("n_terms"),
                    F.array_join(F.transform("terminology", lambda t: t["term"]), ",").alias("terms"),
                    F.size(F.filter("terminology", lambda t: t["definition"].startswith("Essential "))).alias("n_required"))


@query("f_trim_context", with_views(_merged_sql() + f"""
SELECT kc.domain, t.context_type,
  array_to_string(kc.key_concepts[1:t.nc], ',') AS key_concepts,
  array_to_string(CASE WHEN t.nf IS NULL THEN dom.focus_areas ELSE dom.focus_areas[1:t.nf] END, ',') AS focus_areas
FROM kc JOIN {domains_values_sql(("domain", "focus_areas"))} ON dom.domain = kc.domain
CROSS JOIN (VALUES ('minimal', 5, 3), ('focused', 10, 5), ('comprehensive', 15, NULL)) t(context_type, nc, nf)""",
                                    "kb_v"))
def f_trim_context(spark, sf):
    k = kb(spark, sf)
    entries = ko.top_entries(k, 10)
    ctx = co.merge_context(domains_df(spark), entries, co.rules_df(spark), max_entries=5)
    out = None
    for t in ["minimal", "focused", "comprehensive"]:
        x = co.trim_context(ctx, t).select("domain", "context_type",
                                           F.array_join("key_concepts", ",").alias("key_concepts"),
                                           F.array_join("focus_areas", ",").alias("focus_areas"))
        out = x if out is None else out.unionByName(x)
    return out


@query("f_fill_template", with_views(_merged_sql() + f"""
SELECT b.item_id,
  replace(replace(replace(replace(
    'You are an expert in {{{{domain}}}}. {{{{domain_knowledge}}}}' || chr(10) || chr(10) || 'Focus on: {{{{key_concepts}}}}'
    || chr(10) || chr(10) || 'Use appropriate terminology: {{{{terminology}}}}' || chr(10) || chr(10)
    || 'Provide expert guidance on the following:',
    '{{{{domain_knowledge}}}}', CASE WHEN ke.contents IS NULL OR len(ke.contents) = 0 THEN 'No specific domain knowledge available.'
      ELSE 'Relevant domain knowledge:' || chr(10) || array_to_string([('- ' || substr(x, 1, 200) || '...') for x in ke.contents[1:3]], chr(10)) END),
    '{{{{key_concepts}}}}', array_to_string(kc.key_concepts[1:5], ', ')),
    '{{{{terminology}}}}', array_to_string([(x || ': ' || tm.defs[i]) for x, i in tm.terms[1:5]], '; ')),
    '{{{{domain}}}}', dom.domain_name) || chr(10) || chr(10) || 'Task: ' || b.text AS prompt
FROM benchmark b
JOIN {domains_values_sql(("domain", "domain_name"))} ON dom.domain = {_DOMAIN_CASE.format(c='b.item_id')}
JOIN kc ON kc.domain = dom.domain JOIN tm ON tm.domain = dom.domain LEFT JOIN ke ON ke.domain = dom.domain""", "kb_v"))
def f_fill_template(spark, sf):
    m = _merged(spark, sf, "focused")
    b = table(spark, sf, "benchmark").withColumn("domain", _dom("item_id"))
    x = b.join(m, "domain")
    return co.fill_template(x, "inference", "text").select("item_id", "prompt")


# ----------------------------------------------------------------------------- A23, F31, A25, W5, A24, A26b
@query("f_concept_feedback", with_views(f"""
WITH s AS (SELECT domain, c AS concept, sum((rating - 3.0) / 2.0) AS score
           FROM (SELECT domain, rating, unnest(concepts) AS c FROM feedback_x WHERE rating IS NOT NULL)
           GROUP BY domain, c),
kc AS (SELECT DISTINCT domain, unnest(concepts) AS concept FROM knowledge_v)
SELECT s.domain, s.concept, round(s.score, 6) AS score,
  s.score > 0.5 AND kc.concept IS NOT NULL AS is_priority
FROM s LEFT JOIN kc ON kc.domain = s.domain AND kc.concept = s.concept""", "feedback_x", "knowledge_v"))
def f_concept_feedback(spark, sf):
    f = fbx(spark, sf).filter(F.col("rating").isNotNull())
    f = f.withColumn("concept_scores", F.map_from_arrays(
        F.array_distinct("concepts"),
        F.transform(F.array_distinct("concepts"), lambda c: (F.col("rating") - 3.0) / 2.0 *
                    F.size(F.filter("concepts", lambda x: x == c)))))
    kc = knowledge_view(spark, sf).select("domain", F.col("concepts").alias("key_concepts"))
    c = co.concept_feedback(f, kc)
    return c.select("domain", "concept", _r("score").alias("score"), "is_priority")


def _perf(spark, sf):
    m = fo.model_performance(fbx(spark, sf), ["domain"], TEST_LEXICON)
    return m.select("domain", F.col("accuracy_score").alias("accuracy"), F.col("relevance_score").alias("relevance"),
                    "user_satisfaction")


_PERF_SQL = """SELECT domain,
  greatest(0.0, 1.0 - count(*) FILTER (WHERE feedback_type = 'correction') / count(*)) AS accuracy,
  count(*) FILTER (WHERE len(keywords) > 0 OR len(concepts) > 0) / count(*) AS relevance,
  coalesce(avg(rating), 0.0) / 5.0 AS user_satisfaction
FROM feedback_x GROUP BY domain"""


@query("f_context_flags", with_views(f"""
SELECT domain, accuracy < 0.85 AS include_detailed_terminology,
  CASE WHEN relevance < 0.7 THEN 'high_relevance' END AS focus_mode FROM ({_PERF_SQL})""", "feedback_x"))
def f_context_flags(spark, sf):
    return co.context_flags(_perf(spark, sf), 0.7, accuracy=0.85).select("domain", "include_detailed_terminology", "focus_mode")


_TEMPLATE_USES_SQL = """
SELECT domain || '_' || CASE request_id % 3 WHEN 0 THEN 'summarization' WHEN 1 THEN 'fine_tuning' ELSE 'inference' END
    AS template_id, domain, ts, request_id, coalesce(rating, 3.0) / 5.0 AS avg_score FROM requests_v"""
_TEMPLATE_SUCCESS_SQL = f"""
SELECT template_id, domain, count(*) AS usage_count, sum(avg_score * pow(2.0, i - n - 1)) AS success_rate
FROM (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY ts, request_id) AS i,
        count(*) OVER (PARTITION BY template_id) AS n FROM ({_TEMPLATE_USES_SQL}))
GROUP BY template_id, domain"""


def _template_uses(spark, sf):
    r = requests_view(spark, sf)
    t = F.concat(F.col("domain"), F.lit("_"), F.when(F.col("request_id") % 3 == 0, "summarization")
                 .when(F.col("request_id") % 3 == 1, "fine_tuning").otherwise("inference"))
    return r.select(t.alias("template_id"), "domain", "ts", F.col("request_id").alias("use_id"),
                    (F.coalesce("rating", F.lit(3.0)) / 5.0).alias("avg_score"))


@query("f_template_success", with_views(f"""
SELECT template_id, usage_count, round(success_rate, 6) AS success_rate FROM ({_TEMPLATE_SUCCESS_SQL})""", "requests_v"))
def f_template_success(spark, sf):
    t = co.template_success(_template_uses(spark, sf))
    return t.select("template_id", "usage_count", _r("success_rate").alias("success_rate"))


@query("f_context_recommendations", with_views(f"""
WITH p AS ({_PERF_SQL}),
k AS (SELECT domain, count(*) AS total_entries FROM kb_v GROUP BY domain),
t AS (SELECT domain, avg(success_rate) AS s FROM ({_TEMPLATE_SUCCESS_SQL}) GROUP BY domain)
SELECT p.domain, concat_ws(' | ',
  CASE WHEN p.accuracy < 0.85 THEN 'Consider adding more domain-specific examples to improve accuracy' END,
  CASE WHEN p.relevance < 0.7 THEN 'Update knowledge base with more recent domain information' END,
  CASE WHEN p.user_satisfaction < 0.7 THEN 'Review and refine domain terminology and focus areas' END,
  CASE WHEN coalesce(k.total_entries, 0) < 300 THEN 'Expand knowledge base with more domain-specific content' END,
  CASE WHEN coalesce(t.s, 0.0) < 0.6 THEN 'Optimize prompt templates based on feedback patterns' END) AS recommendations
FROM p LEFT JOIN k USING (domain) LEFT JOIN t USING (domain)""", "feedback_x", "kb_v", "requests_v"))
def f_context_recommendations(spark, sf):
    p = _perf(spark, sf)
    kc = kb(spark, sf).groupBy("domain").agg(F.count(F.lit(1)).alias("total_entries"))
    ts = co.template_success(_template_uses(spark, sf)).join(
        _template_uses(spark, sf).select("template_id", "domain").distinct(), "template_id")
    r = co.context_recommendations(p, kc, ts, 0.7, 300, 0.6, accuracy=0.85)
    return r.select("domain", F.array_join("recommendations", " | ").alias("recommendations"))


_HISTORY_SQL = """
SELECT domain, CAST(ts AS DATE) AS day, 1.0 - avg(CASE WHEN error THEN 1.0 ELSE 0.0 END) AS accuracy,
  avg(rating) / 5.0 AS satisfaction, avg(CASE WHEN latency_ms < 2000 THEN 1.0 ELSE 0.0 END) AS relevance
FROM requests_v GROUP BY domain, CAST(ts AS DATE)"""


def _history(spark, sf):
    r = requests_view(spark, sf)
    return r.groupBy("domain", F.to_date("ts").alias("day")).agg(
        (1.0 - F.avg(F.col("error").cast("double"))).alias("accuracy"),
        (F.avg("rating") / 5.0).alias("satisfaction"),
        F.avg((F.col("latency_ms") < 2000).cast("double")).alias("relevance"))


_TRENDS_SQL = f"""
SELECT domain, metric, CASE WHEN count(*) >= 2 THEN coalesce(regr_slope(value, x), 0.0) ELSE 0.0 END AS slope
FROM (SELECT domain, metric, value, row_number() OVER (PARTITION BY domain, metric ORDER BY day) - 1 AS x
      FROM (SELECT domain, day, 'accuracy' AS metric, accuracy AS value FROM ({_HISTORY_SQL})
            UNION ALL SELECT domain, day, 'satisfaction', satisfaction FROM ({_HISTORY_SQL})
            UNION ALL SELECT domain, day, 'relevance', relevance FROM ({_HISTORY_SQL}))
      WHERE value IS NOT NULL)
GROUP BY domain, metric"""


@query("f_performance_trends", with_views(f"""
SELECT domain, metric, round(slope, 9) AS slope,
  CASE WHEN slope > 0.0001 THEN 'improving' WHEN slope < -0.0001 THEN 'declining' ELSE 'stable' END AS trend
FROM ({_TRENDS_SQL})""", "requests_v"))
def f_performance_trends(spark, sf):
    t = co.performance_trends(_history(spark, sf), ["accuracy", "satisfaction", "relevance"], threshold=0.0001)
    return t.select("domain", "metric", _r("slope", 9).alias("slope"), "trend")


@query("f_optimize_prompts", with_views(f"""
SELECT domain, coalesce(array_to_string(list_sort(list(metric) FILTER (WHERE trend = 'declining')), ','), '')
    AS declining_metrics,
  CASE WHEN count(*) FILTER (WHERE trend = 'declining') > 0
       THEN 'Consider updating domain knowledge base with recent information' END AS recommendation,
  CASE WHEN count(*) FILTER (WHERE trend = 'declining') > 0 THEN 'Triggered knowledge base update for ' || domain END AS applied
FROM (SELECT domain, metric, CASE WHEN slope > 0.0001 THEN 'improving' WHEN slope < -0.0001 THEN 'declining' ELSE 'stable' END
        AS trend FROM ({_TRENDS_SQL})) GROUP BY domain""", "requests_v"))
def f_optimize_prompts(spark, sf):
    t = co.performance_trends(_history(spark, sf), ["accuracy", "satisfaction", "relevance"], threshold=0.0001)
    o = co.optimize_prompts(t)
    return o.select("domain", F.array_join("declining_metrics", ",").alias("declining_metrics"), "recommendation",
                    "applied")


# ----------------------------------------------------------------------------- S20
@query("f_domain_json", f"""
SELECT domain, domain = 'technical' OR domain = 'medical' OR domain = 'legal' OR domain = 'financial' AS valid,
  count(*) || ' documents' AS description, array_to_string(list_sort(list(DISTINCT lang)), ',') AS key_concepts,
  array_to_string(list_sort(list(DISTINCT source)), ',') AS focus_areas, true AS roundtrip_ok,
  (SELECT string_agg(lang || '=' || c, ',' ORDER BY lang) FROM (
     SELECT lang, count(*) AS c FROM documents e WHERE {_DOMAIN_CASE.format(c='e.doc_id')} = d.domain GROUP BY lang)) AS terminology
FROM (SELECT *, {_DOMAIN_CASE.format(c='doc_id')} AS domain FROM documents) d GROUP BY domain""")
def f_domain_json(spark, sf):
    """Contexts described from the documents of each domain, exported as JSON and imported
    again; the columns are those of the import."""
    d = table(spark, sf, "documents").select(_dom("doc_id").alias("domain"), "lang", "source")
    per = d.groupBy("domain", "lang").agg(F.count(F.lit(1)).alias("c"))
    terms = per.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct(
        F.col("lang").alias("term"), F.col("c").cast("string").alias("definition")))).alias("terminology"))
    ctx = d.groupBy("domain").agg(
        F.concat(F.count(F.lit(1)).cast("string"), F.lit(" documents")).alias("description"),
        F.array_sort(F.collect_set("lang")).alias("key_concepts"), F.array_sort(F.collect_set("source")).alias("focus_areas"))
    name = F.concat(F.upper(F.substring("domain", 1, 1)), F.expr("substring(domain, 2)"))
    ctx = co.custom_domain(ctx.join(terms, "domain").withColumn("domain_name", name)).withColumn("domain_type", F.col("domain"))
    e = co.export_domain(ctx)
    back = co.import_domain(e)
    again = co.export_domain(back.withColumn("terminology", F.transform(
        F.map_entries("terminology"), lambda x: F.struct(x["key"].alias("term"), x["value"].alias("definition")))))
    entries = F.transform(F.array_sort(F.map_entries("terminology")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return back.join(again.withColumnRenamed("config_json", "again"), "domain").select(
        "domain", "valid", "description", F.array_join("key_concepts", ",").alias("key_concepts"),
        F.array_join("focus_areas", ",").alias("focus_areas"), (F.col("config_json") == F.col("again")).alias("roundtrip_ok"),
        F.array_join(entries, ",").alias("terminology"))


@query("f_enhanced_json", f"""
WITH d AS (SELECT *, {_DOMAIN_CASE.format(c='doc_id')} AS domain FROM documents),
t AS (SELECT domain, lang, count(*) AS n FROM d GROUP BY ALL),
h AS (SELECT domain, source, array_to_string(list_sort(list(DISTINCT doc_id % 7)), ',') AS v FROM d GROUP BY ALL)
SELECT domain, true AS valid, true AS roundtrip_ok,
  (SELECT string_agg(lang || ':' || n, ',' ORDER BY lang) FROM t WHERE t.domain = x.domain) AS templates,
  (SELECT string_agg(source || ':' || v, ';' ORDER BY source) FROM h WHERE h.domain = x.domain) AS history,
  CASE WHEN domain <> 'legal' THEN 'languages=' || count(DISTINCT lang) ELSE '' END AS rules
FROM d x GROUP BY domain""")
def f_enhanced_json(spark, sf):
    """The enhanced context of each domain, described from its documents (templates per language,
    history per source; one domain has no rules), exported, imported, and exported again."""
    d = table(spark, sf, "documents").select("doc_id", _dom("doc_id").alias("domain"), "lang", "source", "n_chars")
    templates = d.groupBy("domain", "lang").agg(F.count(F.lit(1)).alias("usage_count"), F.avg("n_chars").alias("success_rate")).select(
        F.concat_ws("_", "domain", "lang").alias("template_id"), "domain", F.col("lang").alias("task_type"),
        F.lit("{{domain_knowledge}}").alias("template"), "success_rate", "usage_count")
    per = d.groupBy("domain", "source").agg(F.transform(F.array_sort(F.collect_set(F.col("doc_id") % 7)), lambda x: x.cast("double")).alias("v"))
    history = per.groupBy("domain").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "v")))).alias("history"))
    rules = d.filter("domain <> 'legal'").groupBy("domain").agg(F.count_distinct("lang").cast("string").alias("n")).select(
        "domain", F.create_map(F.lit("languages"), F.col("n")).alias("rules"))
    settings = {"max_tokens": "512"}
    e = co.export_enhanced(domains_df(spark), rules, templates, history, settings)
    back = co.import_enhanced(e)
    terms = F.transform(F.map_entries("terminology"), lambda x: F.struct(x["key"].alias("term"), x["value"].alias("definition")))
    again = co.export_enhanced(back.withColumn("terminology", terms), back.select("domain", F.col("enhancement_rules").alias("rules")),
                               back.select(F.explode("adaptive_templates").alias("t")).select("t.*"),
                               back.select("domain", F.col("performance_history").alias("history")), settings)

    def listed(c, text, by):
        return F.array_join(F.transform(F.array_sort(F.map_entries(c)), text), by)
    values = listed("performance_history", lambda x: F.concat(x["key"], F.lit(":"), F.array_join(
        F.transform(x["value"], lambda v: v.cast("long").cast("string")), ",")), ";")
    uses = F.transform("adaptive_templates", lambda t: F.concat(t["task_type"], F.lit(":"), t["usage_count"].cast("string")))
    j = back.join(e, "domain").join(again.withColumnRenamed("config_json", "again"), "domain")
    return j.select("domain", "valid", (F.col("config_json") == F.col("again")).alias("roundtrip_ok"), F.array_join(uses, ",").alias("templates"),
                    values.alias("history"), listed("enhancement_rules", lambda x: F.concat(x["key"], F.lit("="), x["value"]), ";").alias("rules"))

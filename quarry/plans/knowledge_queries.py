"""Knowledge-base queries over `knowledge_v` (documents ⟕ labels), `pages` and `feedback_v`."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions.domains import domains_df, domains_values_sql
from quarry.functions.lexicons import AS_OF, TEST_LEXICON
from quarry.operators import knowledge as ko
from quarry.operators import training as tr
from quarry.plans.catalog import query
from quarry.plans.feedback_queries import AS_OF_SQL
from quarry.sources.html import page_text, page_text_sql
from quarry.sources.views import (VIEW_DEPS, VIEW_SQL, _WS, _concepts_case, feedback_view,
                                  keywords_sql, knowledge_view, table, with_views)

_DOMAIN_CASE = ("CASE {c} % 4 WHEN 0 THEN 'technical' WHEN 1 THEN 'medical' WHEN 2 THEN 'legal' "
                "ELSE 'financial' END")

# one row per id: the last document with that (domain, text)
VIEW_SQL["kb_v"] = "SELECT * FROM knowledge_v QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id DESC) = 1"
VIEW_DEPS["kb_v"] = ["knowledge_v"]


def kb(spark, sf, cols=None):
    """The knowledge base, one row per content of a domain (last document wins; equal contents by
    their full SHA-256, as the 16-digit id is a label). With `cols`, only those columns are
    carried, so unneeded derived columns (keywords) are never computed."""
    k = knowledge_view(spark, sf).withColumn("_full", F.sha2(F.concat_ws(":", "domain", "content"), 256))
    if cols:
        k = k.select(*sorted(set(cols) | {"id", "doc_id"}), "_full")
    return ko.latest_per_id(k, ["doc_id"], key="_full").drop("_full")


def _r(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# ----------------------------------------------------------------------------- F1, F4, F8
@query("f_keywords", with_views("""
SELECT doc_id, array_to_string(keywords, ' ') AS keywords, len(keywords) AS n_keywords FROM knowledge_v""",
                                "knowledge_v"))
def f_keywords(spark, sf):
    k = knowledge_view(spark, sf)
    return k.select("doc_id", F.array_join("keywords", " ").alias("keywords"),
                    F.size("keywords").cast("long").alias("n_keywords"))


@query("f_concepts", with_views("""
SELECT doc_id, domain, array_to_string(concepts, ' ') AS concepts FROM knowledge_v""", "knowledge_v"))
def f_concepts(spark, sf):
    k = knowledge_view(spark, sf)
    return k.select("doc_id", "domain", F.array_join("concepts", " ").alias("concepts"))


@query("f_entry_id", with_views("SELECT doc_id, id FROM knowledge_base_v", "knowledge_base_v"))
def f_entry_id(spark, sf):
    return knowledge_view(spark, sf).select("doc_id", "id")


# ----------------------------------------------------------------------------- S4
@query("f_page_text", f"""
SELECT page_id, t AS text, length(t) AS n_chars FROM (SELECT page_id, {page_text_sql('html')} AS t FROM pages)""")
def f_page_text(spark, sf):
    p = table(spark, sf, "pages").select("page_id", page_text("html").alias("text"))
    return p.withColumn("n_chars", F.length("text").cast("long"))


# ----------------------------------------------------------------------------- S5, S23, F20
@query("f_init_knowledge", with_views(f"""
WITH ctx AS (SELECT domain, description AS content, 'domain_context' AS source, CAST(1.0 AS DOUBLE) AS importance_score,
               'context_paragraph' AS kind FROM {domains_values_sql(("domain", "description"))}),
files AS (SELECT {_DOMAIN_CASE.format(c='doc_id')} AS domain, text AS content, source, CAST(0.8 AS DOUBLE) AS importance_score,
            'knowledge_source' AS kind FROM documents),
pg AS (SELECT {_DOMAIN_CASE.format(c='page_id')} AS domain, {page_text_sql('html')} AS content, url AS source,
         CAST(0.7 AS DOUBLE) AS importance_score, 'web_source' AS kind FROM pages),
u AS (SELECT *, row_number() OVER () AS rid FROM (SELECT * FROM ctx UNION ALL SELECT * FROM files UNION ALL SELECT * FROM pg)),
kw AS ({keywords_sql('u', 'rid', 'content')})
SELECT concat(u.domain, '_', substr(sha256(u.content), 1, 16)) AS id, u.domain, u.source, u.kind, u.importance_score,
  array_to_string(kw.keywords, ' ') AS keywords,
  array_to_string({_concepts_case('u.content', 'u.domain', TEST_LEXICON)}, ' ') AS concepts
FROM u JOIN kw ON kw.kkey = u.rid"""))
def f_init_knowledge(spark, sf):
    ctx = domains_df(spark).select("domain", F.col("description").alias("content"))
    docs = table(spark, sf, "documents")
    dom = F.when(F.col("doc_id") % 4 == 0, "technical").when(F.col("doc_id") % 4 == 1, "medical") \
        .when(F.col("doc_id") % 4 == 2, "legal").otherwise("financial")
    files = docs.select(dom.alias("domain"), F.col("text").alias("content"), "source")
    pages = table(spark, sf, "pages")
    pdom = F.when(F.col("page_id") % 4 == 0, "technical").when(F.col("page_id") % 4 == 1, "medical") \
        .when(F.col("page_id") % 4 == 2, "legal").otherwise("financial")
    pg = pages.select(pdom.alias("domain"), page_text("html").alias("content"), F.col("url").alias("source"))
    k = ko.initialize_domain_knowledge(ctx, files, pg, TEST_LEXICON)
    return k.select("id", "domain", "source", "kind", "importance_score",
                    F.array_join("keywords", " ").alias("keywords"),
                    F.array_join("concepts", " ").alias("concepts"))


@query("f_add_knowledge", f"""
SELECT id, domain, max(doc_id) AS last_doc_id, count(*) AS copies, CAST(1.0 AS DOUBLE) AS importance_score, CAST(1 AS BIGINT) AS version,
  {AS_OF_SQL} AS updated_at
FROM (SELECT doc_id, {_DOMAIN_CASE.format(c='doc_id')} AS domain,
        concat({_DOMAIN_CASE.format(c='doc_id')}, '_', substr(sha256(text), 1, 16)) AS id FROM documents)
GROUP BY id, domain""")
def f_add_knowledge(spark, sf):
    docs = table(spark, sf, "documents")
    dom = F.when(F.col("doc_id") % 4 == 0, "technical").when(F.col("doc_id") % 4 == 1, "medical") \
        .when(F.col("doc_id") % 4 == 2, "legal").otherwise("financial")
    raw = docs.select("doc_id", dom.alias("domain"), F.col("text").alias("content"), "source")
    new = ko.add_knowledge(raw, AS_OF)
    copies = new.groupBy("id").agg(F.count(F.lit(1)).alias("copies"))
    up = ko.latest_per_id(new, ["doc_id"])
    return up.join(copies, "id").select("id", "domain", F.col("doc_id").alias("last_doc_id"), "copies",
                                        "importance_score", "version", "updated_at")


@query("f_knowledge_from_feedback", with_views(f"""
WITH x AS (
  SELECT feedback_id, domain, user_input,
    CASE WHEN c THEN 'Query: ' || user_input || chr(10) || 'Expected Response: ' || expected_output
         ELSE 'Query: ' || user_input || chr(10) || 'Good Response: ' || model_output END AS content,
    CASE WHEN c THEN expected_output ELSE model_output END AS answer,
    CASE WHEN c THEN 'user_feedback' ELSE 'positive_feedback' END AS source,
    CAST(CASE WHEN c THEN 0.9 ELSE 0.7 END AS DOUBLE) AS importance_score
  FROM (SELECT *, coalesce(rating, 0.0) < 3.0 AND expected_output IS NOT NULL AND expected_output <> '' AS c FROM feedback_v)
  WHERE c OR coalesce(rating, 0.0) >= 4.0),
kw AS ({keywords_sql('x', 'feedback_id', 'user_input')})
SELECT x.feedback_id, concat(x.domain, '_', substr(sha256(x.content), 1, 16)) AS id, x.source, x.importance_score,
  array_to_string(kw.keywords, ' ') AS keywords,
  array_to_string({_concepts_case('x.answer', 'x.domain', TEST_LEXICON)}, ' ') AS concepts
FROM x JOIN kw ON kw.kkey = x.feedback_id""", "feedback_v"))
def f_knowledge_from_feedback(spark, sf):
    k = ko.knowledge_from_feedback(feedback_view(spark, sf), TEST_LEXICON)
    return k.select("feedback_id", "id", "source", "importance_score",
                    F.array_join("keywords", " ").alias("keywords"),
                    F.array_join("concepts", " ").alias("concepts"))


# ----------------------------------------------------------------------------- J15
@query("f_knowledge_update", with_views(f"""
WITH upd AS (SELECT k.id, CAST(min(CASE WHEN l.toxic = 1 THEN 0.1 ELSE 0.3 END) AS DOUBLE) AS imp
             FROM kb_v k JOIN labels l ON l.doc_id = k.doc_id WHERE l.quality = 0 GROUP BY k.id)
SELECT k.id, coalesce(u.imp, k.importance_score) AS importance_score,
  CASE WHEN u.id IS NULL THEN k.version ELSE k.version + 1 END AS version,
  CASE WHEN u.id IS NULL THEN k.updated_at ELSE {AS_OF_SQL} END AS updated_at
FROM kb_v k LEFT JOIN upd u ON u.id = k.id""", "kb_v"))
def f_knowledge_update(spark, sf):
    k = kb(spark, sf)
    labels = table(spark, sf, "labels")
    upd = (k.select("id", "doc_id").join(labels.filter(F.col("quality") == 0), "doc_id")
           .groupBy("id").agg(F.min(F.when(F.col("toxic") == 1, 0.1).otherwise(0.3)).alias("importance_score")))
    out = ko.apply_updates(k, upd, AS_OF)
    return out.select("id", "importance_score", "version", "updated_at")


@query("f_knowledge_remove", with_views("""
SELECT domain, count(*) AS remaining FROM kb_v
WHERE id NOT IN (SELECT k.id FROM kb_v k JOIN labels l ON l.doc_id = k.doc_id WHERE l.toxic = 1)
GROUP BY domain""", "kb_v"))
def f_knowledge_remove(spark, sf):
    k = kb(spark, sf)
    ids = k.join(table(spark, sf, "labels").filter(F.col("toxic") == 1), "doc_id").select("id")
    return ko.remove(k, ids).groupBy("domain").agg(F.count(F.lit(1)).alias("remaining"))


# ----------------------------------------------------------------------------- A1–A4, L1, J20
@query("f_quality_score", with_views("""
SELECT b.domain, round((least(b.len / 1000.0, 1.0) + b.imp + least(coalesce(k.n, 0) / 50.0, 1.0)) / 3.0, 6)
  AS quality_score
FROM (SELECT domain, avg(length(content)) AS len, avg(importance_score) AS imp FROM kb_v GROUP BY domain) b
LEFT JOIN (SELECT domain, count(DISTINCT kw) AS n FROM (SELECT domain, unnest(keywords) AS kw FROM kb_v)
           GROUP BY domain) k ON k.domain = b.domain""", "kb_v"))
def f_quality_score(spark, sf):
    return ko.quality_score(kb(spark, sf)).select("domain", _r("quality_score").alias("quality_score"))


_METRICS_SQL = f"""
SELECT b.domain, b.total_documents, b.total_tokens,
  round((least(b.len / 1000.0, 1.0) + b.imp + least(coalesce(k.n, 0) / 50.0, 1.0)) / 3.0, 6) AS quality_score,
  round(least(b.total_tokens / 10000.0, 1.0), 6) AS coverage_score
FROM (SELECT domain, count(*) AS total_documents,
        CAST(sum(len([x for x in regexp_split_to_array(content, '{_WS}') if x <> ''])) AS BIGINT) AS total_tokens,
        avg(length(content)) AS len, avg(importance_score) AS imp FROM kb_v GROUP BY domain) b
LEFT JOIN (SELECT domain, count(DISTINCT kw) AS n FROM (SELECT domain, unnest(keywords) AS kw FROM kb_v)
           GROUP BY domain) k ON k.domain = b.domain"""


@query("f_domain_metrics", with_views(_METRICS_SQL, "kb_v"))
def f_domain_metrics(spark, sf):
    m = ko.domain_metrics(kb(spark, sf))
    return m.select("domain", "total_documents", "total_tokens", _r("quality_score").alias("quality_score"),
                    _r("coverage_score").alias("coverage_score"))


@query("f_domain_summary", with_views(f"""
SELECT b.domain, b.total_entries, b.total_content_length, b.average_importance, b.unique_sources,
  coalesce(c.unique_concepts, '') AS unique_concepts, b.recent_updates, b.last_updated
FROM (SELECT domain, count(*) AS total_entries, CAST(sum(length(content)) AS BIGINT) AS total_content_length,
        round(avg(importance_score), 6) AS average_importance,
        array_to_string(list_sort(list_distinct(list(source))), ',') AS unique_sources,
        count(*) FILTER (WHERE updated_at > {AS_OF_SQL} - INTERVAL 7 DAY) AS recent_updates,
        max(updated_at) AS last_updated
      FROM kb_v GROUP BY domain) b
LEFT JOIN (SELECT domain, array_to_string(list_sort(list_distinct(list(c))), ',') AS unique_concepts
           FROM (SELECT domain, unnest(concepts) AS c FROM kb_v) GROUP BY domain) c ON c.domain = b.domain""",
                                      "kb_v"))
def f_domain_summary(spark, sf):
    s = ko.domain_summary(kb(spark, sf), AS_OF)
    return s.select("domain", "total_entries", "total_content_length",
                    _r("average_importance").alias("average_importance"),
                    F.array_join("unique_sources", ",").alias("unique_sources"),
                    F.array_join("unique_concepts", ",").alias("unique_concepts"),
                    "recent_updates", "last_updated")


def _top_terms_sql(col: str, n: int) -> str:
    return with_views(f"""
SELECT domain, term, cnt AS count, rank FROM (
  SELECT domain, term, count(*) AS cnt,
    row_number() OVER (PARTITION BY domain ORDER BY count(*) DESC, min(doc_id * 1000 + pos)) AS rank
  FROM (SELECT domain, doc_id, unnest({col}) AS term, unnest(range(len({col}))) AS pos FROM kb_v)
  GROUP BY domain, term) WHERE rank <= {n}""", "kb_v")


@query("f_top_keywords", _top_terms_sql("keywords", 20))
def f_top_keywords(spark, sf):
    t = ko.top_domain_terms(kb(spark, sf), "keywords", 20)
    return t.select("domain", "term", "count", F.col("rank").cast("long").alias("rank"))


@query("f_top_concepts", _top_terms_sql("concepts", 15))
def f_top_concepts(spark, sf):
    t = ko.top_domain_terms(kb(spark, sf), "concepts", 15)
    return t.select("domain", "term", "count", F.col("rank").cast("long").alias("rank"))


@query("f_top_entries", with_views("""
SELECT domain, rank, id, importance_score FROM (
  SELECT domain, id, importance_score, row_number() OVER (PARTITION BY domain ORDER BY importance_score DESC, doc_id) AS rank
  FROM kb_v) WHERE rank <= 10""", "kb_v"))
def f_top_entries(spark, sf):
    t = ko.top_entries(kb(spark, sf), 10)
    return t.select("domain", F.col("rank").cast("long").alias("rank"), "id", "importance_score")


@query("f_domain_context", with_views(f"""
WITH m AS ({_METRICS_SQL}),
te AS (SELECT domain, string_agg(id, ',' ORDER BY rank) AS entry_ids FROM (
  SELECT domain, id, row_number() OVER (PARTITION BY domain ORDER BY importance_score DESC, doc_id) AS rank FROM kb_v)
  WHERE rank <= 10 GROUP BY domain),
kw AS (SELECT domain, string_agg(term, ',' ORDER BY rank) AS domain_keywords FROM (
  SELECT domain, term, row_number() OVER (PARTITION BY domain ORDER BY count(*) DESC, min(doc_id * 1000 + pos)) AS rank
  FROM (SELECT domain, doc_id, unnest(keywords) AS term, unnest(range(len(keywords))) AS pos FROM kb_v)
  GROUP BY domain, term) WHERE rank <= 20 GROUP BY domain),
cp AS (SELECT domain, string_agg(term, ',' ORDER BY rank) AS domain_concepts FROM (
  SELECT domain, term, row_number() OVER (PARTITION BY domain ORDER BY count(*) DESC, min(doc_id * 1000 + pos)) AS rank
  FROM (SELECT domain, doc_id, unnest(concepts) AS term, unnest(range(len(concepts))) AS pos FROM kb_v)
  GROUP BY domain, term) WHERE rank <= 15 GROUP BY domain),
lu AS (SELECT domain, max(updated_at) AS last_updated FROM kb_v GROUP BY domain)
SELECT m.domain, m.total_documents, m.total_tokens, m.quality_score, lu.last_updated,
  coalesce(te.entry_ids, '') AS entry_ids, coalesce(kw.domain_keywords, '') AS domain_keywords,
  coalesce(cp.domain_concepts, '') AS domain_concepts
FROM m JOIN lu USING (domain) LEFT JOIN te USING (domain) LEFT JOIN kw USING (domain) LEFT JOIN cp USING (domain)""",
                                      "kb_v"))
def f_domain_context(spark, sf):
    c = ko.domain_context(kb(spark, sf))
    return c.select("domain", "total_documents", "total_tokens", _r("quality_score").alias("quality_score"),
                    "last_updated", F.array_join("entry_ids", ",").alias("entry_ids"),
                    F.array_join("domain_keywords", ",").alias("domain_keywords"),
                    F.array_join("domain_concepts", ",").alias("domain_concepts"))


# ----------------------------------------------------------------------------- U6
@query("f_only_new", f"""
WITH seen AS (SELECT sha256(text) AS content_hash,
                TIMESTAMP '{AS_OF}' - to_seconds(CAST((doc_id % 5) * 1200 AS BIGINT)) AS processed_at
              FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id FROM documents
WHERE sha256(text) NOT IN (SELECT content_hash FROM seen WHERE processed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 3600 SECOND)""")
def f_only_new(spark, sf):
    """U6 over all documents; a third of them (fixture choice) was seen before, at times around the limit."""
    docs = table(spark, sf, "documents")
    seen = docs.filter(F.col("doc_id") % 3 == 0).select(
        F.sha2("text", 256).alias("content_hash"),
        (F.lit(AS_OF).cast("timestamp") -
         F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ((F.col("doc_id") % 5) * 1200).cast("decimal(18,6)")))
        .alias("processed_at"))
    return tr.only_new(docs, seen, AS_OF, 3600).select("doc_id")


# ----------------------------------------------------------------------------- F24–F26, F29
@query("f_text_stats", f"""
SELECT doc_id, CAST(len([x for x in regexp_split_to_array(text, '{_WS}') if x <> '']) AS BIGINT) AS word_count,
  CAST(length(text) AS BIGINT) AS char_count FROM documents""")
def f_text_stats(spark, sf):
    return tr.text_stats(table(spark, sf, "documents")).select("doc_id", "word_count", "char_count")


@query("f_chunks", f"""
WITH w AS (SELECT doc_id, [x for x in regexp_split_to_array(text, '{_WS}') if x <> ''] AS ws FROM documents)
SELECT doc_id, CAST(k AS INTEGER) AS chunk_no, array_to_string(ws[k * 150 + 1 : k * 150 + 200], ' ') AS chunk
FROM w CROSS JOIN LATERAL (SELECT unnest(range(0, CAST(ceil(greatest(len(ws) - 50, 1) / 150.0) AS BIGINT))) AS k)
WHERE len(ws) > 0""")
def f_chunks(spark, sf):
    return tr.chunk(table(spark, sf, "documents"), "text", 200, 50, "doc_id")


@query("f_combine", f"""
WITH w AS (SELECT doc_id, source, [x for x in regexp_split_to_array(text, '{_WS}') if x <> ''] AS ws FROM documents),
b AS (SELECT *, coalesce(sum(len(ws)) OVER (PARTITION BY source ORDER BY doc_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
SELECT source, string_agg(array_to_string(ws[1 : 1024 - before], ' '), chr(10) || chr(10) ORDER BY doc_id) AS combined
FROM b WHERE before < 1024 GROUP BY source""")
def f_combine(spark, sf):
    return tr.combine(table(spark, sf, "documents"), ["source"], ["doc_id"], "text", 1024)


@query("f_tokenize", f"""
WITH tok AS (SELECT doc_id, [x for x in regexp_split_to_array(lower(text), '{_WS}') if x <> ''] AS ts FROM documents),
flat AS (SELECT doc_id, unnest(ts) AS token, unnest(range(1, len(ts) + 1)) AS pos FROM tok),
vocab AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 1 AS id FROM flat GROUP BY token),
ids AS (SELECT doc_id, string_agg(id::VARCHAR, ',' ORDER BY pos) AS s FROM flat JOIN vocab USING (token) WHERE pos <= 128 GROUP BY doc_id)
SELECT doc_id, least(len(ts), 128)::INTEGER AS n_tokens, greatest(len(ts) - 128, 0)::INTEGER AS n_cut,
  md5(concat_ws(',', ids.s, nullif(repeat('0,', greatest(127 - len(ts), 0)) || CASE WHEN len(ts) < 128 THEN '0' ELSE '' END, ''))) AS ids_md5,
  least(len(ts), 128)::INTEGER AS mask_sum
FROM tok LEFT JOIN ids USING (doc_id)""")
def f_tokenize(spark, sf):
    """vocabulary from the corpus, fixed-length ids and masks; what was cut is counted."""
    t = tr.tokenize(table(spark, sf, "documents"), "text", max_len=128)
    return t.select("doc_id", "n_tokens", "n_cut",
                    F.md5(F.array_join(F.transform("input_ids", lambda x: x.cast("string")), ",").cast("binary")).alias("ids_md5"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"))


@query("f_truncation", f"""
SELECT CAST(floor(n / 64) * 64 AS BIGINT) AS bucket, count(*) AS texts, round(avg(CASE WHEN n > 128 THEN 1.0 ELSE 0.0 END), 6)
  AS truncated_share
FROM (SELECT len([x for x in regexp_split_to_array(text, '{_WS}') if x <> '']) AS n FROM documents) GROUP BY 1""")
def f_truncation(spark, sf):
    t = tr.truncation(table(spark, sf, "documents"), "text", 128)
    return t.select("bucket", "texts", _r("truncated_share").alias("truncated_share"))

"""Retrieval queries: TF-IDF vocabulary (P11), similarity search (J2, L3), adaptive context
(J3, L2), adaptive score (J4) and the extractive summary (X2), over the knowledge base."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.lexicons import TEST_LEXICON, WS_CLASS
from quarry.operators import feedback as fo
from quarry.operators import knowledge as ko
from quarry.operators import retrieval as rt
from quarry.plans.catalog import query
from quarry.plans.feedback_queries import fbx
from quarry.plans.knowledge_queries import kb
from quarry.sources.views import _WS, feedback_view, table, with_views

_DOMAIN_CASE = ("CASE {c} % 4 WHEN 0 THEN 'technical' WHEN 1 THEN 'medical' WHEN 2 THEN 'legal' "
                "ELSE 'financial' END")


def _r(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def _stop_sql() -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in rt.spark_english_stopwords()) + "]"


def _terms_sql(src: str, key: str, text: str) -> str:
    return f"""
SELECT domain, {key} AS k, unnest(tk || [tk[i] || ' ' || tk[i + 1] for i in range(1, len(tk))]) AS term
FROM (SELECT domain, {key}, [t for t in regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}')
                               if NOT list_contains({_stop_sql()}, t)] AS tk FROM {src})"""


def _tfidf_ctes() -> str:
    return f"""
dp AS (SELECT domain, k, term, count(*) AS tf FROM ({_terms_sql('kb_v', 'id', 'content')}) GROUP BY ALL),
dn AS (SELECT domain, count(*) AS n FROM kb_v GROUP BY domain),
st AS (SELECT domain, term, count(*) AS df, sum(tf) AS cf FROM dp GROUP BY ALL),
vocab AS (SELECT st.domain, st.term, ln((1.0 + dn.n) / (1.0 + st.df)) + 1.0 AS idf
          FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY cf DESC, term) AS vr FROM st) st
          JOIN dn USING (domain) WHERE vr <= 5000),
dw AS (SELECT domain, k, term, w / sqrt(sum(w * w) OVER (PARTITION BY domain, k)) AS weight
       FROM (SELECT dp.domain, dp.k, dp.term, dp.tf * vocab.idf AS w FROM dp JOIN vocab USING (domain, term)))"""


_QUERIES_SQL = f"(SELECT item_id, text, {_DOMAIN_CASE.format(c='item_id')} AS domain FROM benchmark)"


def _queries(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"),
                    F.when(F.col("item_id") % 4 == 0, "technical").when(F.col("item_id") % 4 == 1, "medical")
                    .when(F.col("item_id") % 4 == 2, "legal").otherwise("financial").alias("domain"))


@query("f_tfidf_vocab", with_views(f"""
WITH {_tfidf_ctes()}
SELECT domain, term, round(idf, 9) AS idf FROM vocab""", "kb_v"))
def f_tfidf_vocab(spark, sf):
    vocab, _ = rt.fit_tfidf(kb(spark, sf, ["content", "domain"]), "id", "content", weights=False)
    return vocab.select("domain", "term", _r("idf", 9).alias("idf"))


@query("f_similarity_search", with_views(f"""
WITH {_tfidf_ctes()},
qp AS (SELECT domain, k, term, count(*) AS tf FROM ({_terms_sql(_QUERIES_SQL, 'item_id', 'text')}) GROUP BY ALL),
qw AS (SELECT domain, k, term, w / sqrt(sum(w * w) OVER (PARTITION BY domain, k)) AS weight
       FROM (SELECT qp.domain, qp.k, qp.term, qp.tf * vocab.idf AS w FROM qp JOIN vocab USING (domain, term))),
sim AS (SELECT qw.domain, qw.k AS query_id, dw.k AS id, round(sum(qw.weight * dw.weight), 9) AS similarity
        FROM qw JOIN dw ON dw.domain = qw.domain AND dw.term = qw.term GROUP BY ALL),
ranked AS (SELECT sim.*, row_number() OVER (PARTITION BY sim.domain, query_id ORDER BY similarity DESC, kb_v.doc_id) AS rank
           FROM sim JOIN kb_v ON kb_v.id = sim.id)
SELECT query_id, rank, id, round(similarity, 6) AS similarity FROM ranked WHERE rank <= 10 AND similarity > 0.1""",
                                         "kb_v"))
def f_similarity_search(spark, sf):
    s = rt.search(_queries(spark, sf), kb(spark, sf, ["content", "domain"]), limit=10, floor=0.1)
    return s.select("query_id", F.col("rank").cast("long").alias("rank"), "id", _r("similarity").alias("similarity"))


_WEAK_SQL = f"""
SELECT domain, area FROM (
  SELECT domain, area, row_number() OVER (PARTITION BY domain ORDER BY count(*) DESC, min(an * 1000000 + pos)) AS rank
  FROM (SELECT domain, an, unnest(toks) AS area, unnest(range(len(toks))) AS pos FROM (
          SELECT domain, an, [x for x in regexp_split_to_array(lower(coalesce(user_input, '') || ' ' ||
                 coalesce(user_comment, '')), '{_WS}') if x <> '' AND length(x) > 4] AS toks
          FROM feedback_x WHERE coalesce(rating, 0.0) < 3.0))
  GROUP BY domain, area) WHERE rank <= 5"""


@query("f_adaptive_context", with_views(f"""
WITH e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY importance_score DESC, doc_id) AS rank
                          FROM kb_v) WHERE rank <= 10),
w AS ({_WEAK_SQL}),
m AS (SELECT e.domain, e.id, e.rank, e.doc_id, e.importance_score,
        count(w.area) FILTER (WHERE contains(lower(e.content), lower(w.area)) OR list_contains(e.concepts, w.area)) AS matches
      FROM e LEFT JOIN w USING (domain) GROUP BY ALL)
SELECT domain, id, matches, round(least(1.0, importance_score * pow(1.5, matches)), 6) AS boosted_score,
  row_number() OVER (PARTITION BY domain ORDER BY least(1.0, importance_score * pow(1.5, matches)) DESC, rank, doc_id)
    AS adaptive_rank
FROM m""", "kb_v", "feedback_x"))
def f_adaptive_context(spark, sf):
    entries = ko.top_entries(kb(spark, sf), 10)
    weak = fo.weak_areas(feedback_view(spark, sf))
    a = rt.adaptive_context(entries, weak, limit=15)
    return a.select("domain", "id", F.col("matches").cast("long").alias("matches"),
                    _r("boosted_score").alias("boosted_score"),
                    F.col("adaptive_rank").cast("long").alias("adaptive_rank"))


@query("f_adaptive_score", with_views(f"""
WITH areas AS (SELECT domain, area FROM (
  SELECT domain, area, row_number() OVER (PARTITION BY domain ORDER BY count(*) DESC, min(an * 100 + pos)) AS rank
  FROM (SELECT domain, an, unnest(kc) AS area, unnest(range(len(kc))) AS pos FROM (
          SELECT domain, an, list_concat(keywords, concepts) AS kc FROM feedback_x WHERE coalesce(rating, 5.0) < 4.0))
  GROUP BY domain, area) WHERE rank <= 10),
acc AS (SELECT domain, greatest(0.0, 1.0 - count(*) FILTER (WHERE feedback_type = 'correction') / count(*)) AS accuracy
        FROM feedback_x GROUP BY domain),
m AS (SELECT k.id, k.domain, k.importance_score,
        count(a.area) FILTER (WHERE list_contains(k.keywords, a.area) OR list_contains(k.concepts, a.area)) AS area_matches
      FROM kb_v k LEFT JOIN areas a USING (domain) GROUP BY ALL)
SELECT m.id, m.area_matches, round(m.importance_score + 0.2 * m.area_matches +
  CASE WHEN acc.accuracy < 0.81 THEN 0.1 ELSE 0.0 END, 6) AS adaptive_score
FROM m LEFT JOIN acc USING (domain)""", "kb_v", "feedback_x"))
def f_adaptive_score(spark, sf):
    f = fbx(spark, sf)
    areas = fo.improvement_areas(f, lexicon=TEST_LEXICON)
    acc = fo.model_performance(f, ["domain"], TEST_LEXICON).select("domain", F.col("accuracy_score").alias("accuracy"))
    s = rt.adaptive_score(kb(spark, sf), areas, acc, low_accuracy=0.81)
    return s.select("id", F.col("area_matches").cast("long").alias("area_matches"),
                    _r("adaptive_score").alias("adaptive_score"))


@query("f_extractive_summary", with_views(f"""
WITH {_tfidf_ctes()},
s AS (SELECT domain, id, sentence, CAST(sent_no AS INTEGER) AS sent_no FROM (
        SELECT domain, id, unnest(sp) AS sentence, unnest(range(len(sp))) AS sent_no
        FROM (SELECT domain, id, string_split(regexp_replace(content, '([.!?])[{WS_CLASS}]+', '\\1' || chr(0), 'g'), chr(0)) AS sp
              FROM kb_v)) WHERE trim(sentence) <> ''),
st2 AS (SELECT domain, k AS id, sent_no, term FROM (
          SELECT domain, id || '#' || sent_no AS k0, id AS k, sent_no,
            unnest(tk || [tk[i] || ' ' || tk[i + 1] for i in range(1, len(tk))]) AS term
          FROM (SELECT domain, id, sent_no, [t for t in regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}_]{{2,}}')
                                             if NOT list_contains({_stop_sql()}, t)] AS tk FROM s))),
sc AS (SELECT st2.domain, st2.id, st2.sent_no, sum(vocab.idf) AS score FROM st2 JOIN vocab USING (domain, term) GROUP BY ALL),
r AS (SELECT s.*, coalesce(sc.score, 0.0) AS score,
        row_number() OVER (PARTITION BY s.domain, s.id ORDER BY coalesce(sc.score, 0.0) DESC, s.sent_no) AS rk
      FROM s LEFT JOIN sc USING (domain, id, sent_no))
SELECT id, string_agg(sentence, ' ' ORDER BY sent_no) AS summary FROM r WHERE rk <= 3 GROUP BY id""", "kb_v"))
def f_extractive_summary(spark, sf):
    k = kb(spark, sf, ["content", "domain"])
    vocab, _ = rt.fit_tfidf(k, "id", "content", weights=False)
    return rt.extractive_summary(k, vocab, "id", "content", k=3).select("id", "summary")

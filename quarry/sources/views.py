"""Fixture views over the driver's tables (FIXTURES.md §2).

Each view is built twice: as a Spark DataFrame (used by `queries()`) and as DuckDB SQL
(`VIEW_SQL`, used by `oracle_sql()`). Both follow the same formulas. The Spark side avoids
single-task plans: the pair ordinal of `feedback_v` uses the distributed ordinal, the pair
count is a one-row broadcast, and the event → pair lookup is an equi-join that AQE
broadcasts only when the runtime size of the pairs is small.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions.lexicons import AS_OF, KEYWORD_STOPWORDS, TEST_LEXICON, WS_REGEX
from quarry.plans.ordinal import with_ordinal
from quarry.plans.tables import written

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def as_of_col():
    return F.lit(AS_OF).cast("timestamp")


def _domain_of(col) -> F.Column:
    m = col % 4
    return (F.when(m == 0, "technical").when(m == 1, "medical").when(m == 2, "legal")
            .otherwise("financial"))


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user → assistant pairs with a 0-based `pair_id` in (conv_id, turn) order; written once, as every view of
    feedback is joined with them."""
    conv = table(spark, sf_dir, "conversations")
    u = conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    a = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    pairs = u.join(a, ["conv_id", "turn"])
    return written(with_ordinal(written(pairs, "turns"), ["conv_id", "turn"], name="pair_id"), "pairs")


def feedback_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`feedback_v` (schema M6)."""
    pairs = conversation_pairs(spark, sf_dir)
    n_pairs = pairs.agg(F.count(F.lit(1)).alias("_np"))  # exactly one row
    ev = table(spark, sf_dir, "events").crossJoin(F.broadcast(n_pairs))
    return feedback_columns(ev, pairs, F.col("_np"))


def feedback_columns(ev: DataFrame, pairs: DataFrame, n_pairs) -> DataFrame:
    """The feedback_v projection of events joined to their conversation pair (shared by the
    batch view and the streaming source, where `n_pairs` is a literal)."""
    ev = ev.withColumn("_pair", F.col("event_id") % n_pairs)
    j = ev.join(pairs.select("pair_id", "prompt", "response"), ev["_pair"] == pairs["pair_id"])
    et = F.col("event_type")
    return j.select(
        F.col("event_id").alias("feedback_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        _domain_of(F.col("user_id")).alias("domain"),
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model_id"),
        (F.when(et == "signup", "praise").when(et == "view", "rating")
         .when(et == "click", "suggestion").when(et == "error", "complaint")
         .otherwise("correction")).alias("feedback_type"),
        F.when(et == "click", F.lit(None).cast("double"))
        .otherwise((F.lit(1) + F.floor("value").cast("long") % 5).cast("double")).alias("rating"),
        F.col("prompt").alias("user_input"),
        F.col("response").alias("model_output"),
        F.when(et == "purchase", F.upper("response")).alias("correction"),
        F.when(et == "error", F.col("prompt")).alias("user_comment"),
        F.when(et == "purchase", F.upper("response")).alias("expected_output"),
        F.col("user_id"),
        F.col("user_id").alias("session_id"),
        (F.col("event_id") % 7 == 0).alias("processed"),
    )


def knowledge_view(spark: SparkSession, sf_dir: str, lexicon=None) -> DataFrame:
    """`knowledge_v` (schema M1), keywords by F1 and concepts by F4 over the test lexicon. Concepts are found
    before the join with labels: queries that need no text don't move it."""
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("concepts", tx.concepts("text", _domain_of(F.col("doc_id")), lexicon or TEST_LEXICON))
    labels = table(spark, sf_dir, "labels")
    d = docs.join(labels, "doc_id", "left")
    day0 = F.lit("2024-01-01 00:00:00").cast("timestamp")
    ts = F.timestamp_add("DAY", F.col("doc_id") % 30, day0)
    dom = _domain_of(F.col("doc_id"))
    out = d.select(
        "doc_id",
        tx.entry_id(dom, F.col("text")).alias("id"),
        F.col("text").alias("content"),
        F.col("source"),
        dom.alias("domain"),
        (F.when(F.col("quality").isNull(), 0.8)
         .when((F.col("quality") == 1) & (F.col("toxic") == 0), 1.0).otherwise(0.5)
         ).alias("importance_score"),
        ts.alias("created_at"),
        ts.alias("updated_at"),
        F.lit(1).cast("long").alias("version"),
        "concepts",
    )
    out = tx.add_keywords(out, "content", "keywords")
    return out.select(*[c for c in out.columns if c != "concepts"], "concepts")


def mentor_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`mentor_v` (schema M12) from `feedback_v`."""
    fb = feedback_view(spark, sf_dir)
    ft = F.col("feedback_type")
    return fb.select(
        "feedback_id", "ts", "domain", "rating",
        F.col("user_id").alias("session_id"),
        F.concat(F.lit("ad"), (F.col("user_id") % 5).cast("string")).alias("adapter_id"),
        (F.when(ft == "praise", "positive").when(ft == "complaint", "negative")
         .when(ft == "correction", "correction").when(ft == "suggestion", "enhancement")
         .when(F.col("rating") >= 3, "positive").otherwise("negative")).alias("mtype"),
        F.col("user_input").alias("feedback_text"),
        F.col("model_output").alias("original_response"),
        F.col("correction").alias("corrected_response"),
        F.col("processed").alias("applied"),
    )


def requests_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`requests_v`: a request log derived from `events`."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        _domain_of(F.col("user_id")).alias("domain"),
        F.concat(_domain_of(F.col("user_id")), F.lit("_m"), (F.col("user_id") % 3).cast("string")
                 ).alias("model_id"),
        F.when(F.col("event_type") == "click", F.lit(None).cast("double"))
        .otherwise((F.lit(1) + F.floor("value").cast("long") % 5).cast("double")).alias("rating"),
        (F.col("event_type") == "error").alias("error"),
        (F.col("value") * 10).alias("latency_ms"),
        F.floor("value").cast("long").alias("tokens"),
        (F.floor("value").cast("long") * F.lit(0.00001)).alias("cost"),
    )


VIEW_SQL: dict[str, str] = {}

VIEW_SQL["pairs_v"] = """
SELECT row_number() OVER (ORDER BY u.conv_id, u.turn) - 1 AS pair_id, u.text AS prompt, a.text AS response
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'"""

# upper(): Java and Python map 'ß' to 'SS' (full case mapping); DuckDB keeps it, so the
# oracle spells that mapping out.
VIEW_SQL["feedback_v"] = """
SELECT e.event_id AS feedback_id, e.ts,
  CASE e.user_id % 4 WHEN 0 THEN 'technical' WHEN 1 THEN 'medical' WHEN 2 THEN 'legal' ELSE 'financial' END AS domain,
  concat('m', CAST(e.user_id % 3 AS VARCHAR)) AS model_id,
  CASE e.event_type WHEN 'signup' THEN 'praise' WHEN 'view' THEN 'rating' WHEN 'click' THEN 'suggestion'
                    WHEN 'error' THEN 'complaint' ELSE 'correction' END AS feedback_type,
  CASE WHEN e.event_type = 'click' THEN NULL
       ELSE CAST(1 + CAST(floor(e.value) AS BIGINT) % 5 AS DOUBLE) END AS rating,
  p.prompt AS user_input, p.response AS model_output,
  CASE WHEN e.event_type = 'purchase' THEN upper(replace(p.response, 'ß', 'SS')) END AS correction,
  CASE WHEN e.event_type = 'error' THEN p.prompt END AS user_comment,
  CASE WHEN e.event_type = 'purchase' THEN upper(replace(p.response, 'ß', 'SS')) END AS expected_output,
  e.user_id AS user_id, e.user_id AS session_id,
  e.event_id % 7 = 0 AS processed
FROM events e CROSS JOIN (SELECT count(*) AS n FROM pairs_v) np JOIN pairs_v p ON p.pair_id = e.event_id % np.n"""

_WS = WS_REGEX
_STOP = "[" + ", ".join(f"'{w}'" for w in KEYWORD_STOPWORDS) + "]"


def _concepts_case(text_sql: str, domain_sql: str, lexicon) -> str:
    parts = []
    for d, terms in lexicon.items():
        lst = "[" + ", ".join(f"'{t}'" for t in terms) + "]"
        parts.append(f"WHEN '{d}' THEN [t for t in {lst} if contains(lower({text_sql}), t)]")
    return f"CASE lower({domain_sql}) " + " ".join(parts) + " ELSE [] END"


def keywords_sql(src: str, key: str, text: str, n: int = 10) -> str:
    """DuckDB: (key, keywords) for each row of `src` — F1 by unnest / group / rank."""
    return f"""
SELECT s.{key} AS kkey, coalesce(k.kw, []) AS keywords FROM {src} s LEFT JOIN (
  SELECT kkey, list(w ORDER BY rn) AS kw FROM (
    SELECT kkey, w, row_number() OVER (PARTITION BY kkey ORDER BY count(*) DESC, min(p)) AS rn
    FROM (SELECT kkey, trim(t, '.,!?;:') AS w, p FROM (
            SELECT {key} AS kkey, unnest(toks) AS t, unnest(range(len(toks))) AS p
            FROM (SELECT {key}, [x for x in regexp_split_to_array(lower({text}), '{_WS}') if x <> ''] AS toks
                  FROM {src}))
          WHERE length(t) > 4 AND NOT list_contains({_STOP}, t))
    GROUP BY kkey, w) WHERE rn <= {n} GROUP BY kkey) k ON k.kkey = s.{key}"""


VIEW_SQL["knowledge_base_v"] = f"""
SELECT d.doc_id,
  concat(CASE d.doc_id % 4 WHEN 0 THEN 'technical' WHEN 1 THEN 'medical' WHEN 2 THEN 'legal' ELSE 'financial' END,
         '_', substr(sha256(d.text), 1, 16)) AS id,
  d.text AS content, d.source,
  CASE d.doc_id % 4 WHEN 0 THEN 'technical' WHEN 1 THEN 'medical' WHEN 2 THEN 'legal' ELSE 'financial' END AS domain,
  CAST(CASE WHEN l.quality IS NULL THEN 0.8 WHEN l.quality = 1 AND l.toxic = 0 THEN 1.0 ELSE 0.5 END AS DOUBLE)
    AS importance_score,
  TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(d.doc_id % 30 AS INTEGER)) AS created_at,
  TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(d.doc_id % 30 AS INTEGER)) AS updated_at,
  CAST(1 AS BIGINT) AS version
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""

VIEW_SQL["knowledge_kw_v"] = keywords_sql("documents", "doc_id", "text")

VIEW_SQL["knowledge_v"] = f"""
SELECT b.*, kw.keywords, {_concepts_case('b.content', 'b.domain', TEST_LEXICON)} AS concepts
FROM knowledge_base_v b JOIN knowledge_kw_v kw ON kw.kkey = b.doc_id"""

VIEW_SQL["mentor_v"] = """
SELECT feedback_id, ts, domain, rating, user_id AS session_id,
  concat('ad', CAST(user_id % 5 AS VARCHAR)) AS adapter_id,
  CASE feedback_type WHEN 'praise' THEN 'positive' WHEN 'complaint' THEN 'negative'
       WHEN 'correction' THEN 'correction' WHEN 'suggestion' THEN 'enhancement'
       ELSE CASE WHEN rating >= 3 THEN 'positive' ELSE 'negative' END END AS mtype,
  user_input AS feedback_text, model_output AS original_response,
  correction AS corrected_response, processed AS applied
FROM feedback_v"""

VIEW_SQL["requests_v"] = """
SELECT event_id AS request_id, ts,
  CASE user_id % 4 WHEN 0 THEN 'technical' WHEN 1 THEN 'medical' WHEN 2 THEN 'legal' ELSE 'financial' END AS domain,
  concat(CASE user_id % 4 WHEN 0 THEN 'technical' WHEN 1 THEN 'medical' WHEN 2 THEN 'legal' ELSE 'financial' END,
         '_m', CAST(user_id % 3 AS VARCHAR)) AS model_id,
  CASE WHEN event_type = 'click' THEN NULL ELSE CAST(1 + CAST(floor(value) AS BIGINT) % 5 AS DOUBLE) END AS rating,
  event_type = 'error' AS error,
  value * 10 AS latency_ms,
  CAST(floor(value) AS BIGINT) AS tokens,
  CAST(floor(value) AS BIGINT) * 0.00001 AS cost
FROM events"""

# dependencies between views, so a query only pulls in what it needs
VIEW_DEPS = {
    "feedback_v": ["pairs_v"],
    "knowledge_v": ["knowledge_base_v", "knowledge_kw_v"],
    "mentor_v": ["feedback_v"],
}


def with_views(sql: str, *names: str) -> str:
    """Prefix `sql` with the CTEs of the named views (and their dependencies)."""
    order: list[str] = []

    def add(n):
        for dep in VIEW_DEPS.get(n, []):
            add(dep)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if not order:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"

"""Knowledge-base operators.

A knowledge table has schema M1: id, content, source, domain, keywords[], concepts[],
importance_score, created_at, updated_at, version, metadata (map), plus an order key
(`doc_id` or `created_at, id`) standing for insertion order (P17). One row per id.
"""
from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions.lexicons import KNOWLEDGE_CONCEPTS
from quarry.plans.topk import top_k_rows, top_terms


def _ts(x) -> Column:
    return F.lit(x).cast("timestamp") if isinstance(x, str) else x


def latest_per_id(df: DataFrame, order_by: Sequence[str], key: str = "id") -> DataFrame:
    """One row per id: the last by `order_by` (upsert semantics, P16 later wins), whose columns
    must be unique within an id. The narrow aggregate finds the last place of each id; the rows
    themselves move once, in the semi-join."""
    places = df.select(key, *order_by).groupBy(key)
    if len(order_by) == 1:
        last = places.agg(F.max(order_by[0]).alias(order_by[0]))
    else:
        last = places.agg(F.max(F.struct(*order_by)).alias("_last")).select(key, "_last.*")
    return df.join(last, [key, *order_by], "left_semi")


def add_knowledge(raw: DataFrame, as_of, lexicon: Mapping[str, Sequence[str]] | None = None,
                  extract: bool = False) -> DataFrame:
    """New entries from (domain, content, source[, keywords, concepts, importance_score,
    metadata]): id by F8, importance default 1.0, version 1, timestamps = as_of. With
    `extract`, keywords (F1) and concepts (F4) are derived from the content."""
    cols = raw.columns
    out = (raw.withColumn("id", tx.entry_id("domain", "content"))
           .withColumn("importance_score", F.coalesce(F.col("importance_score"), F.lit(1.0))
                       if "importance_score" in cols else F.lit(1.0))
           .withColumn("version", F.lit(1).cast("long"))
           .withColumn("created_at", _ts(as_of))
           .withColumn("updated_at", _ts(as_of)))
    if "metadata" not in cols:
        out = out.withColumn("metadata", F.create_map().cast("map<string,string>"))
    if extract:
        out = tx.add_keywords(out, "content", "keywords")
        out = out.withColumn("concepts", tx.concepts("content", "domain", lexicon or KNOWLEDGE_CONCEPTS))
    else:
        for c in ("keywords", "concepts"):
            if c not in cols:
                out = out.withColumn(c, F.array().cast("array<string>"))
    return out


def upsert(knowledge: DataFrame, new: DataFrame, order_by: Sequence[str], key: str = "id") -> DataFrame:
    """Append `new` and keep one row per `key`, the last in `order_by` order. Where ids are short
    hashes of very many contents, pass a column with the full hash."""
    return latest_per_id(knowledge.unionByName(new, allowMissingColumns=True), order_by, key)


def apply_updates(knowledge: DataFrame, updates: DataFrame, as_of) -> DataFrame:
    """Updates (id, content?, importance_score?, keywords?, concepts?, metadata?):
    non-null fields overwrite, metadata maps merge (update wins), version + 1 and
    updated_at = as_of on matched rows. Unknown ids are ignored. One update per id."""
    u = updates.select("id", *[F.col(c).alias(f"_u_{c}") for c in updates.columns if c != "id"])
    j = knowledge.join(u, "id", "left")
    ucols = [c for c in updates.columns if c != "id"]
    hit = F.lit(False)
    for c in ucols:
        hit = hit | F.col(f"_u_{c}").isNotNull()
    out = j
    for c in ucols:
        if c == "metadata":
            kept = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")),
                                lambda k, _: ~F.map_contains_key(F.col("_u_metadata"), k))
            out = out.withColumn("metadata", F.when(F.col("_u_metadata").isNotNull(), F.map_concat(kept, F.col("_u_metadata")))
                                 .otherwise(F.col("metadata")))
        else:
            out = out.withColumn(c, F.coalesce(F.col(f"_u_{c}"), F.col(c)))
    out = (out.withColumn("version", F.when(hit, F.col("version") + 1).otherwise(F.col("version")))
           .withColumn("updated_at", F.when(hit, _ts(as_of)).otherwise(F.col("updated_at"))))
    return out.drop(*[f"_u_{c}" for c in ucols])


def remove(knowledge: DataFrame, ids: DataFrame) -> DataFrame:
    """J15 remove: anti-join on id."""
    return knowledge.join(ids.select("id").distinct(), "id", "left_anti")


# ----------------------------------------------------------------------------- aggregates
def quality_score(knowledge: DataFrame) -> DataFrame:
    """A2: mean of min(avg chars / 1000, 1), avg importance, min(distinct keywords / 50, 1).
    Distinct keywords come from a second aggregate over exploded keywords, joined back."""
    base = knowledge.groupBy("domain").agg(F.avg(F.length("content")).alias("_len"),
                                           F.avg("importance_score").alias("_imp"))
    kw = (knowledge.select("domain", F.explode("keywords").alias("kw")).distinct()
          .groupBy("domain").agg(F.count(F.lit(1)).alias("_kw")))
    j = base.join(kw, "domain", "left").fillna(0, ["_kw"])
    return j.select("domain", ((F.least(F.col("_len") / 1000.0, F.lit(1.0)) + F.col("_imp") +
                                F.least(F.col("_kw") / 50.0, F.lit(1.0))) / 3.0).alias("quality_score"))


def domain_metrics(knowledge: DataFrame) -> DataFrame:
    """A1: documents, whitespace tokens, quality (A2), coverage = min(tokens / 10000, 1)."""
    base = knowledge.groupBy("domain").agg(F.count(F.lit(1)).alias("total_documents"),
                                           F.sum(tx.word_count("content")).cast("long").alias("total_tokens"))
    return (base.join(quality_score(knowledge), "domain")
            .withColumn("coverage_score", F.least(F.col("total_tokens") / 10000.0, F.lit(1.0))))


def domain_summary(knowledge: DataFrame, as_of, recent_days: int = 7) -> DataFrame:
    """A3: entries, total length, average importance, distinct sources and concepts, updates
    in the last `recent_days` (strictly after the cut-off), last update."""
    cut = _ts(as_of) - F.make_dt_interval(F.lit(recent_days))
    base = knowledge.groupBy("domain").agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.sum(F.length("content")).cast("long").alias("total_content_length"),
        F.avg("importance_score").alias("average_importance"),
        F.array_sort(F.collect_set("source")).alias("unique_sources"),
        F.count_if(F.col("updated_at") > cut).alias("recent_updates"),
        F.max("updated_at").alias("last_updated"))
    conc = (knowledge.select("domain", F.explode("concepts").alias("c")).distinct()
            .groupBy("domain").agg(F.array_sort(F.collect_list("c")).alias("unique_concepts")))
    return base.join(conc, "domain", "left").withColumn(
        "unique_concepts", F.coalesce("unique_concepts", F.array().cast("array<string>")))


def top_domain_terms(knowledge: DataFrame, col: str = "keywords", n: int = 20,
                     order_by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """A4: top n keywords (20) or concepts (15) per domain with counts; ties by first
    occurrence in insertion order (P3)."""
    return top_terms(knowledge, ["domain"], F.col(col), list(order_by), n, term_col="term")


def top_entries(knowledge: DataFrame, limit: int = 10, order_by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """L1: per domain, the `limit` entries with the highest importance; ties in insertion
    order (stable sort)."""
    return top_k_rows(knowledge, ["domain"],
                      [F.col("importance_score").desc(), *[F.col(c) for c in order_by]], limit)


def domain_context(knowledge: DataFrame, limit: int = 10, order_by: Sequence[str] = ("doc_id",),
                   entries: DataFrame | None = None) -> DataFrame:
    """Per domain: top entries (L1, or the given ranked `entries`, e.g. from L3), total
    entries, top 20 keywords and 15 concepts, metrics (A1) and last update."""
    top = entries if entries is not None else top_entries(knowledge, limit, order_by)
    te = top.groupBy("domain").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))),
                                               lambda s: s["id"]).alias("entry_ids"))
    kws = top_domain_terms(knowledge, "keywords", 20, order_by).groupBy("domain").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("domain_keywords"))
    cps = top_domain_terms(knowledge, "concepts", 15, order_by).groupBy("domain").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("domain_concepts"))
    m = domain_metrics(knowledge)
    last = knowledge.groupBy("domain").agg(F.max("updated_at").alias("last_updated"))
    empty = F.array().cast("array<string>")
    return (m.join(last, "domain").join(te, "domain", "left").join(kws, "domain", "left")
            .join(cps, "domain", "left")
            .withColumn("entry_ids", F.coalesce("entry_ids", empty))
            .withColumn("domain_keywords", F.coalesce("domain_keywords", empty))
            .withColumn("domain_concepts", F.coalesce("domain_concepts", empty)))


# ----------------------------------------------------------------------------- F20, S5
def knowledge_from_feedback(fb: DataFrame, lexicon: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """corrective entries (rating < 3, missing = 0, with an expected answer; importance
    0.9) and reinforcing entries (rating >= 4; importance 0.7) from feedback rows, with
    keywords of the query (F1) and concepts of the answer (F4)."""
    r = F.coalesce(F.col("rating"), F.lit(0.0))
    exp = F.col("expected_output")
    corrective = (r < 3.0) & exp.isNotNull() & (exp != "")
    good = ~corrective & (r >= 4.0)
    x = fb.filter(corrective | good).select(
        "feedback_id", "domain", "ts", "user_input",
        F.when(corrective, F.concat(F.lit("Query: "), F.col("user_input"), F.lit("\nExpected Response: "), exp))
        .otherwise(F.concat(F.lit("Query: "), F.col("user_input"), F.lit("\nGood Response: "),
                            F.col("model_output"))).alias("content"),
        F.when(corrective, exp).otherwise(F.col("model_output")).alias("_answer"),
        F.when(corrective, "user_feedback").otherwise("positive_feedback").alias("source"),
        F.when(corrective, 0.9).otherwise(0.7).alias("importance_score"),
        F.when(corrective, "feedback_correction").otherwise("positive_reinforcement").alias("kind"))
    x = tx.add_keywords(x, "user_input", "keywords")
    return (x.withColumn("concepts", tx.concepts("_answer", "domain", lexicon or KNOWLEDGE_CONCEPTS))
            .withColumn("id", tx.entry_id("domain", "content")).drop("_answer"))


def initialize_domain_knowledge(contexts: DataFrame, files: DataFrame, pages: DataFrame,
                                lexicon: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """A new domain's base from its context paragraph (importance 1.0), files (0.8) and
    web pages (0.7); all inputs have (domain, content, source). Keywords F1, concepts F4."""
    parts = [
        contexts.select("domain", "content", F.lit("domain_context").alias("source"),
                        F.lit(1.0).alias("importance_score"), F.lit("context_paragraph").alias("kind"),
                        F.lit(0).alias("_src_ord"), F.lit(None).cast("string").alias("_key")),
        files.select("domain", "content", "source", F.lit(0.8).alias("importance_score"),
                     F.lit("knowledge_source").alias("kind"), F.lit(1).alias("_src_ord"),
                     F.col("source").alias("_key")),
        pages.select("domain", "content", "source", F.lit(0.7).alias("importance_score"),
                     F.lit("web_source").alias("kind"), F.lit(2).alias("_src_ord"),
                     F.col("source").alias("_key")),
    ]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    u = tx.add_keywords(u, "content", "keywords")
    return (u.withColumn("concepts", tx.concepts("content", "domain", lexicon or KNOWLEDGE_CONCEPTS))
            .withColumn("id", tx.entry_id("domain", "content")))

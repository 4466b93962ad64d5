"""Queries of the operators over the driver's tables, and the DuckDB SQL of those that SQL can
express. A query reads whole tables and derives its contract's columns from the operator."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import alignment, contamination, idfiles, language, mixing, near, pages, pii, quality, repeats, rules, tokens, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op8_substring_dedup", r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM w)),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS least FROM win) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, p + k AS i FROM hit, (SELECT unnest(range(0, 13)) AS k)),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS x FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS c FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(c, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(read(spark, sf_dir, "documents"))


@query("op10_decontamination", r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
q AS (SELECT DISTINCT item_id, k, array_to_string(ws[p:p + k - 1], ' ') AS g
      FROM (SELECT item_id, ws, least(13, len(ws)) AS k, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS p FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT k FROM q),
win AS (SELECT doc_id, k, p, array_to_string(ws[p:p + k - 1], ' ') AS g
        FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM w, sizes)),
hit AS (SELECT doc_id, k, p, item_id FROM win JOIN q USING (k, g)),
word AS (SELECT doc_id, count(DISTINCT p + i) AS n FROM (SELECT DISTINCT doc_id, k, p FROM hit) h, LATERAL (SELECT unnest(range(0, h.k)) AS i) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(word.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
       sha256(coalesce(it.s, '')) AS items_sha256, coalesce(word.n, 0) > 0 AND 20 * coalesce(word.n, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN word USING (doc_id) LEFT JOIN it USING (doc_id)
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("key")


@query("op3_quality_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op4_near_dedup", r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 4], ' ') AS g
       FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT a, b FROM both_ways UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other),
comp AS (SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(coalesce(comp.least, w.doc_id), w.doc_id) AS component_id,
       least(coalesce(comp.least, w.doc_id), w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(read(spark, sf_dir, "documents"))


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


@query("op6_source_mixing", f"""
WITH n AS (SELECT source, count(*) AS r FROM documents GROUP BY source),
rate AS (SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM n) * (SELECT sum(r) FROM n) / r AS rate FROM n),
part AS (SELECT source, greatest(1, ceil(rate / {mixing.PART}))::BIGINT AS parts, rate / greatest(1, ceil(rate / {mixing.PART})) AS m FROM rate),
p AS (SELECT source, k, exp(-m + k * ln(m) - lgamma(k + 1)) AS p FROM part, range(0, {mixing.TERMS + 1}) t(k)),
c AS (SELECT source, round(sum(p) OVER (PARTITION BY source ORDER BY k), {mixing.DIGITS}) AS c FROM p),
u AS (SELECT doc_id, source, ('0x' || substr(md5('{mixing.SEED}:' || doc_id || ':' || i), 1, 13))::BIGINT / 2.0 ** 52 AS u
      FROM (SELECT d.doc_id, d.source, unnest(range(1, parts + 1)) AS i FROM documents d JOIN part USING (source))),
k AS (SELECT doc_id, source, count(*) AS n FROM u JOIN c USING (source) WHERE c.c < 1 AND c.c <= u.u GROUP BY ALL)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, unnest(range(1, k.n + 1))::BIGINT AS copy
FROM documents d JOIN k USING (doc_id)
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


@query("op9_personal_data")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(read(spark, sf_dir, "documents"))


@query("op5_html_extraction")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(read(spark, sf_dir, "pages"))


@query("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the sources, paths the languages below them. Labels of the held-out fifth aren't used."""
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), F.col("source"), F.col("lang"),
                         held_out=language.fold("doc_id", language.HELD_OUT) == 0)


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.counts(read(spark, sf_dir, "documents"))


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(read(spark, sf_dir, "embeddings"))


@query("op12_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.links(read(spark, sf_dir, "documents"))


@query("op13_token_files")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.digest(read(spark, sf_dir, "documents"))

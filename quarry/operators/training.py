"""Training-example operators (SURVEY §2.3 J5, J6, §2.5 W4, §2.7 U1, U2, U3, U6, §2.8 F11,
F24–F26, F29, §2.2 P-14, P-15, §2.4 A27, A29, §2.1 S15).

A training example is a row with `messages: array<struct<role, content>>` plus optional
domain, source, quality_score, improvement_type, feedback_id (schema M13).
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.plans.ordinal import running_sum, with_ordinal
from quarry.plans.tables import written
from quarry.plans.topk import top_k_rows

ROLE_ORDER = ["system", "user", "assistant"]


def msg(role: str, content) -> Column:
    c = F.col(content) if isinstance(content, str) else content
    return F.struct(F.lit(role).alias("role"), c.alias("content"))


def to_messages(system=None, user="prompt", assistant="response") -> Column:
    """chat messages from optional system text, prompt and response columns."""
    parts = []
    if system is not None:
        parts.append(msg("system", system))
    parts += [msg("user", user), msg("assistant", assistant)]
    return F.array(*parts)


def domain_system_prompt(domain_name="domain_name", description="description") -> Column:
    """System message of the document examples: `You are an expert in {name}. {description}`."""
    return F.concat(F.lit("You are an expert in "), F.col(domain_name), F.lit(". "), F.col(description))


# ----------------------------------------------------------------------------- J5
# FIXED VALUES: the four example types and their prompt prefixes ({name} = domain name).
EXAMPLE_TYPES = [
    ("summarization", "Summarize the following {name} content:"),
    ("qa", "Generate a question and answer based on this {name} content:"),
    ("explanation", "Explain the key concepts in this {name} content:"),
    ("analysis", "Analyze the main points in this {name} content:"),
]


def expand_example_types(docs: DataFrame, domains: DataFrame, text: str = "text",
                         types=EXAMPLE_TYPES) -> DataFrame:
    """Every document (with a `domain`) × the example types, with the user prompt
    `{prefix}\\n\\n{document}` and the domain system prompt. The type list is a constant
    array exploded per row (4 rows out per row in): no join, no shuffle; the domain
    dimension is a broadcast lookup."""
    tarr = F.array(*[F.struct(F.lit(i).alias("type_ord"), F.lit(t).alias("example_type"),
                              F.lit(p).alias("prefix_tpl")) for i, (t, p) in enumerate(types)])
    d = docs.join(domains.select("domain", "domain_name", "description"), "domain")
    x = d.withColumn("_t", F.explode(tarr)).select("*", "_t.*").drop("_t")
    prefix = F.replace(F.col("prefix_tpl"), F.lit("{name}"), F.col("domain_name"))
    return (x.withColumn("prompt_prefix", prefix)
            .withColumn("user_prompt", F.concat(prefix, F.lit("\n\n"), F.col(text)))
            .withColumn("system_prompt", domain_system_prompt())
            .drop("prefix_tpl"))


# ----------------------------------------------------------------------------- J6
def knowledge_examples(recs: DataFrame, domains: DataFrame, knowledge: DataFrame | None = None,
                       top: int = 5, per: int = 3) -> DataFrame:
    """For the first `top` improvements of each domain (recommendation descriptions in rule
    order), `per` template examples each, for domains that have knowledge entries. Output
    columns: domain, improvement_focus, imp_rank, example_no, messages, quality_score,
    source."""
    r = top_k_rows(recs, ["domain"], [F.col("seq")], top, rank_col="imp_rank")
    if knowledge is not None:
        r = r.join(knowledge.select("domain").distinct(), "domain", "left_semi")
    d = r.join(domains.select("domain", "domain_name", "fine_tuning_instructions"), "domain")
    d = d.withColumn("example_no", F.explode(F.sequence(F.lit(0), F.lit(per - 1))))
    imp = F.col("description")
    name = F.col("domain_name")
    messages = F.array(
        msg("system", F.concat(F.lit("You are an expert in "), name, F.lit(". Focus on "), imp,
                               F.lit(". "), F.col("fine_tuning_instructions"))),
        msg("user", F.concat(F.lit("Please explain a key aspect of "), imp,
                             F.lit(" in the context of "), name, F.lit("."))),
        msg("assistant", F.concat(F.lit("Based on the "), name,
                                  F.lit(" domain knowledge, here's an explanation of "), imp,
                                  F.lit("..."))))
    return d.select("domain", imp.alias("improvement_focus"), "imp_rank", "example_no",
                    messages.alias("messages"), F.lit(0.8).alias("quality_score"),
                    F.lit("knowledge_base").alias("source"))


# ----------------------------------------------------------------------------- U1, U2
def dedup_examples(df: DataFrame, group_by: Sequence[str], order_by: Sequence[str],
                   key: str = "messages") -> DataFrame:
    """U2 (first half): keep the first row (by `order_by`, unique within a group) of every group
    of equal `key` within `group_by`. Keys are compared by their SHA-256; the aggregate carries
    hashes and places only and collapses copies on the map side, so a key repeated in a third of
    all rows costs one narrow row per map task. The rows move once, in the semi-join."""
    h = F.sha2(F.to_json(F.struct(F.col(key))), 256)
    first = F.min(F.struct(*[F.col(c) for c in order_by]))
    places = df.select(*group_by, h.alias("_h"), *order_by).groupBy(*group_by, "_h").agg(first.alias("_first"))
    places = places.select(*group_by, "_h", "_first.*")
    on = [*group_by, "_h", *[c for c in order_by if c not in group_by]]
    return df.withColumn("_h", h).join(places, on, "left_semi").drop("_h")


def rank_examples(df: DataFrame, group_by: Sequence[str], order_by: Sequence[str],
                  out: str = "position", at_most: int | None = None) -> DataFrame:
    """U2 (second half): stable sort by quality desc (missing = 0.5), ties in `order_by`
    order; 1-based `out` per group. By default from the distributed ordinal (no per-group
    single task). With `at_most`, groups are ranked by a window each, and the job fails if a group
    has more rows than that."""
    q = F.coalesce(F.col("quality_score"), F.lit(0.5))
    x = df.withColumn("_q", -q)
    if at_most is not None:
        w = Window.partitionBy(*group_by).orderBy("_q", *order_by)
        pos = F.row_number().over(w).cast("long")
        x = x.withColumn(out, pos)
        return x.withColumn(out, F.when(F.col(out) <= at_most, F.col(out)).otherwise(
            F.raise_error(F.lit(f"a group has more than {at_most} examples")).cast("long"))).drop("_q")
    return with_ordinal(x, ["_q", *order_by], group_by, name=out) \
        .withColumn(out, F.col(out) + 1).drop("_q")


def adaptive_training_set(feedback_ex: DataFrame, knowledge_ex: DataFrame, at_most: int = 1000) -> DataFrame:
    """U1 + U2: feedback examples (in their rank order) then knowledge examples (improvement
    order), exact dedup on messages per domain keeping the first, ranked by quality. Both
    inputs are per-domain top lists (L4's `limit` and J6's 5 × 3); the final rank is a window per
    domain, which fails beyond `at_most` rows."""
    f = feedback_ex.select("domain", "messages", "quality_score", "improvement_type",
                           F.col("feedback_id").cast("string").alias("feedback_id"),
                           F.lit("feedback").alias("source"), F.lit(0).alias("_part"),
                           F.col("rank").cast("long").alias("_ord"))
    k = knowledge_ex.select("domain", "messages", "quality_score",
                            F.lit(None).cast("string").alias("improvement_type"),
                            F.lit(None).cast("string").alias("feedback_id"), "source",
                            F.lit(1).alias("_part"),
                            (F.col("imp_rank") * 1000 + F.col("example_no")).cast("long").alias("_ord"))
    u = f.unionByName(k)
    d = dedup_examples(u, ["domain"], ["_part", "_ord"])
    return rank_examples(d, ["domain"], ["_part", "_ord"], at_most=at_most).drop("_part", "_ord")


# ----------------------------------------------------------------------------- W4
def split_positional(df: DataFrame, order_by: Sequence[str], validation_split: float = 0.1,
                     group_by: Sequence[str] = ()) -> DataFrame:
    """Rows before int(n × (1 − validation_split)) in `order_by` order are training, the
    rest validation (P12). Ordinal and counts are distributed."""
    o = with_ordinal(df, order_by, group_by, name="_pos")
    cnt = df.groupBy(*group_by).agg(F.count(F.lit(1)).alias("_n")) if group_by else \
        df.agg(F.count(F.lit(1)).alias("_n"))
    j = o.join(cnt, list(group_by)) if group_by else o.crossJoin(F.broadcast(cnt))
    cut = F.floor(F.col("_n") * F.lit(1.0 - validation_split))
    return j.withColumn("split", F.when(F.col("_pos") < cut, "train").otherwise("validation")) \
        .drop("_n").withColumnRenamed("_pos", "position")


def split_hash(df: DataFrame, key: str, validation_split: float = 0.1, seed: int = 42) -> DataFrame:
    """W4 default at scale: a deterministic per-key split (the first 52 bits of the SHA-256 of
    `seed:key`), no ordinal and no shuffle; with `key` = document id all examples of a document
    stay together."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    share = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(2.0 ** 52)
    return df.withColumn("split", F.when(share < validation_split, "validation").otherwise("train"))


# ----------------------------------------------------------------------------- S15
def jsonl_lines(df: DataFrame, fields: Sequence[str] = ("messages",)) -> DataFrame:
    """One JSON object per example (`value` column), fields in the given order; null
    fields are written as null (not dropped)."""
    return df.withColumn("value", F.to_json(F.struct(*[F.col(f) for f in fields]),
                                            {"ignoreNullFields": "false"}))


def write_jsonl(df: DataFrame, path: str, fields: Sequence[str] = ("messages",),
                partition_by: Sequence[str] = ("domain",), mode: str = "overwrite") -> None:
    """S15 sink: JSONL text files, one folder per domain (dynamic partition overwrite, so a
    rerun of one domain leaves the others)."""
    lines = jsonl_lines(df, fields).select(*partition_by, "value")
    lines.write.mode(mode).partitionBy(*partition_by).text(path)


# ----------------------------------------------------------------------------- P-14, P-15
def valid_pairs(qa: DataFrame, q: str = "question", a: str = "answer") -> DataFrame:
    """P-14: rows whose question and answer are both present and non-empty."""
    return qa.filter(F.col(q).isNotNull() & (F.col(q) != "") & F.col(a).isNotNull() & (F.col(a) != ""))


def validate_examples(df: DataFrame, min_chars: int = 1, max_chars: int = 100_000,
                      max_total_chars: int = 400_000) -> DataFrame:
    """P-15: chat-format compliance: non-empty messages, known roles, optional leading
    system, then user/assistant alternating starting with user and ending with assistant,
    every content non-empty and within length bounds. Adds `reject_reason` (null = valid)."""
    m = F.col("messages")
    roles = F.transform(m, lambda x: x["role"])
    body = F.when(F.element_at(roles, 1) == "system", F.slice(roles, 2, F.size(roles))).otherwise(roles)
    alternating = F.forall(F.sequence(F.lit(1), F.greatest(F.size(body), F.lit(1))),
                           lambda i: (F.size(body) == 0) | (
                               F.element_at(body, i) == F.when(i % 2 == 1, "user").otherwise("assistant")))
    lengths = F.transform(m, lambda x: F.coalesce(F.length(x["content"]), F.lit(0)))
    total = F.aggregate(lengths, F.lit(0), lambda acc, x: acc + x)
    reason = (F.when(m.isNull() | (F.size(m) == 0), "no_messages")
              .when(~F.forall(roles, lambda r: r.isin(*ROLE_ORDER)), "unknown_role")
              .when(F.size(body) < 2, "too_few_turns")
              .when(~alternating, "bad_turn_order")
              .when(F.element_at(body, -1) != "assistant", "no_final_answer")
              .when(F.exists(lengths, lambda x: x < min_chars), "empty_content")
              .when(F.exists(lengths, lambda x: x > max_chars), "content_too_long")
              .when(total > max_total_chars, "example_too_long"))
    return df.withColumn("reject_reason", reason)


# ----------------------------------------------------------------------------- U6
def only_new(docs: DataFrame, seen: DataFrame, as_of, ttl_seconds: int = 3600,
             text: str = "text") -> DataFrame:
    """Drop texts whose SHA-256 was processed within the last `ttl_seconds` before as_of
    (`seen`: content_hash, processed_at). Anti-join on the hash."""
    a = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    fresh = seen.filter(F.col("processed_at") >= a - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                                                         F.lit(ttl_seconds)))
    d = docs.withColumn("content_hash", F.sha2(F.col(text), 256))
    return d.join(fresh.select("content_hash").distinct(), "content_hash", "left_anti")


# ----------------------------------------------------------------------------- A27, A29
def token_cost(df: DataFrame, tokens: str = "tokens", price_per_million: float = 3.0,
               group_by: Sequence[str] = ("domain",)) -> DataFrame:
    """Tokens and cost per group; cost per token null-safe."""
    g = df.groupBy(*group_by).agg(F.count(F.lit(1)).alias("requests"),
                                  F.sum(F.coalesce(F.col(tokens), F.lit(0))).cast("long").alias("tokens"))
    return (g.withColumn("cost", F.col("tokens") * F.lit(price_per_million / 1e6))
            .withColumn("cost_per_request", F.when(F.col("requests") > 0, F.col("cost") / F.col("requests"))))


def training_profile(examples: DataFrame, group_by: Sequence[str] = ("domain",),
                     approx: bool = False) -> DataFrame:
    """Examples, words, mean length (chars) and distinct prompts per group."""
    user = F.filter(F.col("messages"), lambda x: x["role"] == "user")[0]["content"]
    allt = F.array_join(F.transform(F.col("messages"), lambda x: x["content"]), " ")
    x = examples.select(*group_by, user.alias("_prompt"), allt.alias("_all"))
    distinct = F.approx_count_distinct("_prompt") if approx else F.count_distinct("_prompt")
    return x.groupBy(*group_by).agg(
        F.count(F.lit(1)).alias("examples"),
        F.sum(tx.word_count("_all")).cast("long").alias("words"),
        F.avg(F.length("_all")).alias("mean_chars"),
        distinct.alias("distinct_prompts"))


# ----------------------------------------------------------------------------- F24–F26, F29
def text_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """words (whitespace split) and characters."""
    return df.withColumn("word_count", tx.word_count(text).cast("long")) \
        .withColumn("char_count", F.length(text).cast("long"))


def chunk(df: DataFrame, text: str = "text", size: int = 200, overlap: int = 50,
          key: str = "doc_id") -> DataFrame:
    """word chunks of `size` with `overlap` (starts every size − overlap words); one row
    per chunk with its ordinal. Whole texts: the last chunk holds the tail."""
    step = size - overlap
    w = tx.words(text)
    x = df.select(key, w.alias("_w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - overlap - 1, F.lit(0)), F.lit(step))
    y = x.select(key, "_w", F.posexplode(starts).alias("chunk_no", "_s"))
    return y.select(key, "chunk_no", F.array_join(F.slice("_w", F.col("_s") + 1, size), " ").alias("chunk")) \
        .filter(F.col("chunk") != "")


def combine(df: DataFrame, group_by: Sequence[str], order_by: Sequence[str], text: str = "text",
            max_words: int = 1024) -> DataFrame:
    """texts of a group in order, joined by a blank line and cut to `max_words` words.
    The running word count is computed before collecting, so only the rows that fit (and
    the one that crosses the limit, cut) are collected — never a whole group."""
    w = tx.words(text)
    x = df.withColumn("_n", F.size(w).cast("long"))
    x = running_sum(x, list(group_by), list(order_by), "_n", "_rc", "_rs") \
        .withColumn("_before", F.col("_rs") - F.col("_n")).drop("_rc", "_rs")
    x = x.filter(F.col("_before") < max_words)
    x = x.withColumn("_piece", F.array_join(F.slice(w, 1, F.lit(max_words) - F.col("_before")), " "))
    return x.groupBy(*group_by).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order_by],
                                                                      F.col("_piece").alias("p")))),
                                 lambda s: s["p"]), "\n\n").alias("combined"))


def tokenize(df: DataFrame, text: str, max_len: int, pad_id: int = 0, unk_id: int = 1,
             vocab: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """F24 (re-aimed): lower-cased word tokens mapped through a vocabulary (built from the
    corpus when not given: ids by descending frequency, ties by token), truncated to
    `max_len`, padded with `pad_id`; attention mask 1 for real tokens; `n_cut` tokens did not fit."""
    toks = df.select(key, tx.words(F.lower(F.col(text))).alias("_t"))
    if vocab is None:
        # texts are cut into words once: the vocabulary reads both columns, the ids only the first words
        toks = written(toks.select(key, F.size("_t").alias("_n"), F.slice("_t", 1, max_len).alias("_t"),
                                   F.slice("_t", max_len + 1, F.greatest(F.size("_t"), F.lit(1))).alias("_more")), "tokens")
        vocab = build_vocab(toks.select(F.explode("_t").alias("token")).unionAll(toks.select(F.explode("_more"))))
    else:
        toks = toks.withColumn("_n", F.size("_t"))
    # one row a token and one without a token for texts that have none; a text's first row carries its length
    ex = toks.select(key, F.coalesce("_n", F.lit(0)).alias("_n"), F.posexplode_outer(F.slice("_t", 1, max_len)).alias("pos", "token"))
    ids = ex.join(vocab, "token", "left").withColumn("id", F.coalesce(F.col("id"), F.lit(unk_id)))
    g = ids.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "id")))), lambda s: s["id"]).alias("_ids"),
        F.collect_list(F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("_n"))).alias("_n"))
    g = g.select(key, F.when(F.col(key).isNull(), F.array().cast("array<long>")).otherwise(F.col("_ids")).alias("_ids"),
                 F.explode("_n").alias("_n"))       # a row a text, also where keys repeat
    pad = F.array_repeat(F.lit(pad_id).cast("long"), F.lit(max_len) - F.size("_ids"))
    return g.select(key, F.concat("_ids", pad).alias("input_ids"),
                    F.concat(F.array_repeat(F.lit(1), F.size("_ids")),
                             F.array_repeat(F.lit(0), F.lit(max_len) - F.size("_ids"))).alias("attention_mask"),
                    F.size("_ids").alias("n_tokens"),
                    F.greatest(F.col("_n") - F.size("_ids"), F.lit(0)).alias("n_cut"))


def build_vocab(tokens: DataFrame, reserved: int = 2) -> DataFrame:
    """Vocabulary (token, id): ids from `reserved` by descending count, ties by token. The
    ordinal is distributed, and reads the counts several times: they are written once."""
    c = written(tokens.groupBy("token").agg((-F.count(F.lit(1))).alias("_nc")), "token-counts")
    return with_ordinal(c, ["_nc", "token"], name="id").select(
        "token", (F.col("id") + reserved).alias("id"))


def truncation(df: DataFrame, text: str = "text", max_len: int = 128) -> DataFrame:
    """F24 companion: token-length histogram (buckets of 64) and truncation rate."""
    n = tx.word_count(text)
    x = df.select(n.alias("_n"))
    return x.groupBy((F.floor(F.col("_n") / 64) * 64).cast("long").alias("bucket")).agg(
        F.count(F.lit(1)).alias("texts"),
        F.avg((F.col("_n") > max_len).cast("double")).alias("truncated_share"))


# ----------------------------------------------------------------------------- L6, J7, J13
def eval_prompts(domains: DataFrame, counts: DataFrame, improvements: DataFrame | None = None,
                 n_improvements: int = 3) -> DataFrame:
    """Per domain, `count` evaluation prompts: the example prompts in order, continued
    cyclically as `In the context of {first focus area}, {prompt lower-cased}`; plus
    `Explain how to address: {improvement}` for the first 3 improvements (ranked rows:
    domain, imp_rank, description). One explode per domain, no driver loop."""
    d = domains.join(counts, "domain")
    x = d.select("domain", "example_prompts", "focus_areas",
                 F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("prompt_no"))
    n = F.size("example_prompts")
    base = F.element_at("example_prompts", (F.col("prompt_no") % n + 1).cast("int"))
    prompt = F.when(F.col("prompt_no") < n, base).otherwise(
        F.concat(F.lit("In the context of "), F.element_at("focus_areas", 1), F.lit(", "), F.lower(base)))
    out = x.select("domain", "prompt_no", prompt.alias("prompt"))
    if improvements is not None:
        imp = improvements.filter(F.col("imp_rank") <= n_improvements).join(counts, "domain").select(
            "domain", (F.col("count") + F.col("imp_rank") - 1).alias("prompt_no"),
            F.concat(F.lit("Explain how to address: "), F.col("description")).alias("prompt"))
        out = out.unionByName(imp)
    return out


def eval_plan(models: DataFrame, prompts: DataFrame) -> DataFrame:
    """Every model paired with the evaluation prompts of its own domain (an equi-join on
    the domain; the prompt list per domain is small)."""
    return models.select("model_id", "domain").join(prompts, "domain")


def apply_domain_mapping(files: DataFrame, mapping: DataFrame, key: str = "file_name") -> DataFrame:
    """File → domain by a given mapping (left join; unmapped files keep a null domain)."""
    return files.join(mapping.select(key, "domain"), key, "left")

"""Scalar text functions as Spark column expressions.

Built-in expressions (higher-order array functions included), which run inside the JVM on each row, but
for the keywords of documents (F1), which work on whole Arrow columns (`columnar.py`). None shuffles.
Lexicons and thresholds are parameters.
"""
from __future__ import annotations

from functools import lru_cache
from typing import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import columnar
from quarry.functions.lexicons import (CONTENT_DOMAIN_TERMS, DOMAIN_ORDER, FEEDBACK_CONCEPTS,
                                       FILENAME_DOMAIN_PATTERNS, FILENAME_DOMAIN_TERMS,
                                       KEYWORD_STOPWORDS, KEYWORD_STRIP, KNOWLEDGE_CONCEPTS,
                                       WORD_CLASS, WS_CLASS)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit_array(xs: Sequence[str]) -> Column:
    return F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")


def words(text) -> Column:
    """Python `str.split()`: whitespace runs separate words, empty pieces dropped."""
    return F.regexp_extract_all(_c(text), F.lit(f"{WORD_CLASS}++"), 0)


def word_count(text) -> Column:
    """Number of whitespace-separated words (one regex scan, no array)."""
    return F.regexp_count(_c(text), F.lit(f"{WORD_CLASS}++"))


def long_words(text, min_len: int = 5, letters_only: bool = False) -> Column:
    """Whitespace tokens of at least `min_len` characters, in order, in one regex scan:
    a maximal run of non-whitespace of length >= min_len is exactly such a token (shorter
    runs cannot match anywhere inside). With `letters_only`, only tokens made of letters."""
    if letters_only:
        pat = f"(?<![^{WS_CLASS}])\\p{{L}}{{{min_len},}}(?![^{WS_CLASS}])"
    else:
        pat = f"{WORD_CLASS}{{{min_len},}}+"
    return F.regexp_extract_all(_c(text), F.lit(pat), 0)


def keywords(text, n: int = 10, stopwords: Sequence[str] = KEYWORD_STOPWORDS,
             min_len: int = 5) -> Column:
    """the n most frequent words longer than 4 characters (tested on the raw token, P2),
    stop words removed, `.,!?;:` stripped from both ends; ties by first occurrence (P3).

    A per-document count with no cross-row dependency, so it stays narrow (no shuffle). It runs over whole
    Arrow columns (`columnar.frequent_words`): the all-JVM form below takes an order of magnitude longer
    (interpreted lambdas), and explode + group + rank shuffles every distinct (document, word) pair.
    """
    return _keywords_udf(n, tuple(stopwords), min_len)(F.lower(_c(text)))


@lru_cache(None)
def _keywords_udf(n: int, stopwords: tuple, min_len: int):
    def run(texts: pa.Array) -> pa.Array:
        return columnar.frequent_words(texts, n, stopwords, min_len, KEYWORD_STRIP)
    return F.arrow_udf(run, "array<string>")


def keywords_jvm(text, n: int = 10, stopwords: Sequence[str] = KEYWORD_STOPWORDS,
                 min_len: int = 5) -> Column:
    """F1 with built-in expressions only (same result as `keywords`).

    Per row, without a shuffle, O(w log w): tokens paired with their position are sorted by
    (token, position); each element is zipped with its neighbours, so run starts and run
    ends are plain per-element tests; zipping starts with ends gives each token's count
    and first position, and (-count, first position) picks the top n. No lambda reads an
    array other than its own argument, so the optimizer may inline or push this expression
    anywhere without changing its cost beyond a constant factor.
    """
    stop = _lit_array([w for w in stopwords if len(w) >= min_len])
    toks = long_words(F.lower(_c(text)), min_len)
    if stopwords and any(len(w) >= min_len for w in stopwords):
        toks = F.filter(toks, lambda x: ~F.array_contains(stop, x))
    s = F.array_sort(F.transform(toks, lambda x, i: F.struct(
        F.trim(x, F.lit(KEYWORD_STRIP)).alias("w"), i.alias("p"))))
    return top_by_count(s, n)


def top_by_count(s: Column, n: int) -> Column:
    """`s` is an array of struct(w, p) sorted by (w, p): the n values of w with the highest
    count, ties by lowest first position p."""
    null_wp = F.lit(None).cast("struct<w:string,p:int>")
    size = F.size(s)
    prev = F.concat(F.array(null_wp), F.slice(s, 1, F.greatest(size - 1, F.lit(0))))
    nxt = F.concat(F.slice(s, 2, F.greatest(size, F.lit(1))), F.array(null_wp))
    z = F.arrays_zip(s.alias("cur"), prev.alias("prev"), nxt.alias("next"))
    marked = F.transform(z, lambda e, i: F.struct(
        i.alias("idx"), e["cur"]["w"].alias("w"), e["cur"]["p"].alias("p"),
        (e["prev"].isNull() | (e["prev"]["w"] != e["cur"]["w"])).alias("is_start"),
        (e["next"].isNull() | (e["next"]["w"] != e["cur"]["w"])).alias("is_end")))
    starts = F.filter(marked, lambda m: m["is_start"])
    ends = F.filter(marked, lambda m: m["is_end"])
    runs = F.zip_with(starts, ends, lambda a, b: F.struct(
        (a["idx"] - b["idx"] - 1).alias("negc"), a["p"].alias("p"), a["w"].alias("w")))
    top = F.transform(F.slice(F.array_sort(runs), 1, n), lambda r: r["w"])
    return F.when(size > 0, top).otherwise(F.array().cast("array<string>"))


def add_keywords(df: DataFrame, text, out: str = "keywords", n: int = 10,
                 stopwords: Sequence[str] = KEYWORD_STOPWORDS, min_len: int = 5) -> DataFrame:
    """`df` with an F1 `keywords` column."""
    return df.withColumn(out, keywords(text, n, stopwords, min_len))


def _joined_lower(cols) -> Column:
    return F.lower(F.concat_ws(" ", *[F.when(_c(c) != "", _c(c)) for c in cols]))


def _matches(low: Column, terms: Sequence[str]) -> Column:
    """Terms (in order, duplicates kept) contained in `low`; unrolled so whole-stage codegen
    evaluates `low` once per row (common subexpression). `contains` compares a term only where its
    first byte occurs, `instr` at every character."""
    if not terms:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in terms]))


_HEAD = 512      # characters in which a text's first keywords are looked for before the whole text is scanned


def _letter_words(text: Column, min_len: int, end: str) -> Column:
    """Words of at least `min_len` letters and nothing else, in order: each match takes a whole word, group 1 is
    empty unless it is such a word. `end` is what has to follow it."""
    pat = f"(\\p{{L}}{{{min_len},}}+){end}|{WORD_CLASS}++"
    return F.array_remove(F.regexp_extract_all(text, F.lit(pat), 1), "")


def feedback_keywords(*cols, n: int = 10, min_len: int = 5, joined: bool = False) -> Column:
    """first n all-letter words longer than 4 of the joined non-empty texts, lower-cased,
    duplicates kept. `joined=True`: the single column is already the joined lower text.

    Built-in expressions: no text goes to Python. A text whose first `_HEAD` characters hold n such words, white
    space after each, isn't read further; others are scanned whole."""
    text = F.coalesce(_c(cols[0]), F.lit("")) if joined else _joined_lower(cols)
    head = F.slice(_letter_words(F.substring(text, 1, _HEAD), min_len, f"(?=[{WS_CLASS}])"), 1, n)
    return F.when(F.size(head) >= n, head).otherwise(F.slice(_letter_words(text, min_len, f"(?![^{WS_CLASS}])"), 1, n))


def feedback_features(joined, lexicon: Mapping[str, Sequence[str]] = FEEDBACK_CONCEPTS,
                      n_keywords: int = 10, n_concepts: int = 5, min_len: int = 5) -> Column:
    """F2 + F3 of the column of joined lower-cased texts: struct(keywords, concepts)."""
    return F.struct(feedback_keywords(joined, n=n_keywords, min_len=min_len, joined=True).alias("keywords"),
                    feedback_concepts(joined, lexicon=lexicon, n=n_concepts, joined=True).alias("concepts"))


def feedback_keywords_jvm(*cols, n: int = 10, min_len: int = 5, joined: bool = False) -> Column:
    """F2 in one regex scan that tests both neighbours of a word, same result as `feedback_keywords`."""
    ws = long_words(_c(cols[0]) if joined else _joined_lower(cols), min_len, letters_only=True)
    return F.slice(ws, 1, n)


def feedback_concepts(*cols, lexicon: Mapping[str, Sequence[str]] = FEEDBACK_CONCEPTS,
                      n: int = 5, joined: bool = False) -> Column:
    """lexicon terms (all domains, lexicon order) contained in the lower-cased joined text."""
    terms = [t for ts in lexicon.values() for t in ts]
    return F.slice(_matches(_c(cols[0]) if joined else _joined_lower(cols), terms), 1, n)


def concepts(text, domain, lexicon: Mapping[str, Sequence[str]] = KNOWLEDGE_CONCEPTS) -> Column:
    """terms of the row's own domain contained in the lower-cased text (lexicon order)."""
    low = F.lower(_c(text))
    dom = F.lower(_c(domain))
    expr = None
    for d, ts in lexicon.items():
        expr = (F.when(dom == d, _matches(low, ts)) if expr is None
                else expr.when(dom == d, _matches(low, ts)))
    return expr.otherwise(F.array().cast("array<string>"))


def count_occurrences(text: Column, term: str) -> Column:
    """P5: non-overlapping occurrences of `term` in `text`."""
    if not term:
        return F.lit(0)
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) /
                   F.lit(len(term))).cast("long")


def domain_scores(text, filename=None,
                  content_terms: Mapping[str, Sequence[str]] = CONTENT_DOMAIN_TERMS,
                  filename_patterns: Mapping[str, Sequence[str]] = FILENAME_DOMAIN_PATTERNS,
                  filename_weight: float = 0.3) -> Column:
    """struct of per-domain scores: occurrences of each term × 1/len(terms), plus
    `filename_weight` × number of file-name patterns found."""
    low = F.lower(_c(text))
    fields = []
    for d, terms in content_terms.items():
        score = F.lit(0.0)
        for t in terms:
            score = score + count_occurrences(low, t.lower()) * F.lit(1.0 / len(terms))
        if filename is not None:
            fname = F.lower(F.coalesce(_c(filename), F.lit("")))
            fs = F.lit(0.0)
            for p in filename_patterns.get(d, []):
                fs = fs + F.when(F.instr(fname, p) > 0, 1.0).otherwise(0.0)
            score = score + fs * F.lit(filename_weight)
        fields.append(score.alias(d))
    return F.struct(*fields)


def best_domain(scores: Column, order: Sequence[str] = DOMAIN_ORDER) -> Column:
    """Highest-scoring domain, ties to the first in `order`."""
    best = F.lit(order[0])
    best_v = scores[order[0]]
    for d in order[1:]:
        best = F.when(scores[d] > best_v, F.lit(d)).otherwise(best)
        best_v = F.greatest(best_v, scores[d])
    return best


def domain_from_name(name, terms: Mapping[str, Sequence[str]] = FILENAME_DOMAIN_TERMS) -> Column:
    """first domain (dictionary order) with any term in the lower-cased name, else null."""
    low = F.lower(_c(name))
    expr = None
    for d, ts in terms.items():
        cond = None
        for t in ts:
            c = F.instr(low, t) > 0
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(d)) if expr is None else expr.when(cond, F.lit(d))
    return expr


def domain_from_prefix(name, known: Sequence[str] = DOMAIN_ORDER, default: str = "general") -> Column:
    """base name (no folders, no extension); lower-cased part before the first `_` if it
    is a known domain, else `default`."""
    base = F.element_at(F.split(_c(name), "/"), -1)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    prefix = F.lower(F.substring_index(stem, "_", 1))
    return F.when((F.instr(stem, "_") > 0) & prefix.isin(*known), prefix).otherwise(F.lit(default))


def entry_id(domain, content) -> Column:
    """F8: `{domain}_{first 16 hex digits of sha256(content)}`."""
    return F.concat(_c(domain), F.lit("_"), F.substring(F.sha2(_c(content), 256), 1, 16))


def slug(x) -> Column:
    """lower-case, spaces to hyphens."""
    return F.replace(F.lower(_c(x)), F.lit(" "), F.lit("-"))


def slug_underscored(x) -> Column:
    """lower-case, spaces to underscores (names of profiles in ids)."""
    return F.replace(F.lower(_c(x)), F.lit(" "), F.lit("_"))


def _seconds(at) -> Column:
    return F.unix_seconds(_c(at).cast("timestamp")).cast("string")


def deployment_id(model_id, at) -> Column:
    """`deploy_{model}_{seconds}`."""
    return F.concat(F.lit("deploy_"), _c(model_id), F.lit("_"), _seconds(at))


def job_id(kind: str, domain, at) -> Column:
    """`{kind}_{domain}_{seconds}`; kinds are domain_training and adaptive_retraining."""
    return F.concat(F.lit(f"{kind}_"), _c(domain), F.lit("_"), _seconds(at))


def session_id(adapter_id, at) -> Column:
    """`mentor_{adapter}_{yyyyMMdd_HHmmss}`."""
    return F.concat(F.lit("mentor_"), _c(adapter_id), F.lit("_"), F.date_format(_c(at), "yyyyMMdd_HHmmss"))


def mask_secret(x) -> Column:
    """first 4, stars, last 4; all stars when 8 characters or fewer."""
    v = _c(x)
    n = F.length(v)
    return F.when(v.isNull(), F.lit(None)).when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.substring(v, 1, 4), F.repeat(F.lit("*"), n - 8), F.substring(v, -4, 4)))


def whole_days_between(start, end) -> Column:
    """whole 24-hour periods from `start` to `end` (timedelta.days; floors negatives)."""
    secs = F.unix_micros(_c(end).cast("timestamp")) - F.unix_micros(_c(start).cast("timestamp"))
    return F.floor(secs / F.lit(86_400_000_000)).cast("long")

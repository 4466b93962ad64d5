"""What must not move or be computed twice as tables grow: rows beyond the k best of a group, the search index, words of texts."""
import random
from collections import Counter

from pyspark.sql import functions as F

from quarry.operators import retrieval as rt
from quarry.operators import training as tr
from quarry.plans import topk
from quarry.plans.tables import written
from test_search_and_pairs import weights


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_k_limits_before_its_only_shuffle(spark):
    df = spark.range(0, 20000, numPartitions=4).select((F.col("id") % 2).alias("g"), F.pmod(F.xxhash64("id"), F.lit(500)).alias("v"), "id")
    got = topk.top_k_rows(df, ["g"], [F.col("v").desc(), F.col("id")], 1500)
    assert plan_of(got).count("Exchange hashpartitioning") == 1 and plan_of(got).count("WindowGroupLimit") == 2
    rows = df.collect()
    want = [(g, r.v, r.id, n) for g in (0, 1) for n, r in enumerate(sorted((r for r in rows if r.g == g), key=lambda r: (-r.v, r.id))[:1500], 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_search_does_not_shuffle_its_index(spark):
    q, d = weights(spark, random.Random(8), 2000, 20)
    q, d = written(q, "q"), written(d, "d")
    found = rt.bounded_similarity(q, d, limit=10, floor=0.1, read_all=0)
    assert "SortMergeJoin" not in plan_of(found)


def test_words_are_cut_once_also_where_keys_repeat(spark):
    rng = random.Random(2)
    texts = [(rng.randrange(30) if i else None, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(12))) if i % 9 else None) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = tr.tokenize(df, "text", 5)
    assert "regexp" not in plan_of(got)
    counts = Counter(w for _, t in texts for w in (t or "").split())
    ids = {w: n + 2 for n, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0])))}
    seen = Counter()
    for k, t in texts:
        seen[k] += 1
    rows = got.collect()
    assert Counter(r.doc_id for r in rows) == seen
    alone = {k: (t or "").split() for k, t in texts if k is not None and seen[k] == 1}
    for r in rows:
        if r.doc_id in alone:
            w = alone[r.doc_id]
            assert list(r.input_ids) == ([ids[x] for x in w] + [0] * 5)[:5] and (r.n_tokens, r.n_cut) == (min(len(w), 5), max(len(w) - 5, 0))

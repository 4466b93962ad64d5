"""Searches and near pairs: the same results as without bounds, and few pairs looked at."""
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from quarry.operators import generation as go
from quarry.operators import retrieval as rt


def documents(rng, n, common=True):
    words = [f"w{i}" for i in range(400)]
    return [(i, ("common " * rng.randrange(1, 4) if common else "") + " ".join(rng.choice(words) for _ in range(rng.randrange(5, 40)))) for i in range(n)]


def weights(spark, rng, n, m):
    """Documents that all hold a light common term and few heavy ones, and queries like them."""
    def rows(count, first):
        out = []
        for i in range(count):
            terms = {"common": 0.05, **{f"t{rng.randrange(300)}": rng.random() for _ in range(4)}}
            norm = math.sqrt(sum(w * w for w in terms.values()))
            out += [("d" if i % 9 else "e", first + i, t, w / norm) for t, w in terms.items()]
        return out
    docs = spark.createDataFrame(rows(n, 0), "domain string, id long, term string, weight double")
    return spark.createDataFrame(rows(m, 10**6), "domain string, query_id long, term string, weight double"), docs


def test_bounded_similarity_keeps_the_best_and_scores_few(spark):
    rng = random.Random(4)
    q, d = weights(spark, rng, 3000, 40)
    every = rt.similarity(q, d)
    order = [F.col("similarity").desc(), F.col("id")]
    for limit, floor in ((10, 0.1), (3, 0.5), (2000, 0.0)):
        bounded = rt.bounded_similarity(q, d, limit=limit, floor=floor, read_all=0)
        want = rt.top_k_rows(every, ["domain", "query_id"], order, limit).filter(F.col("similarity") > floor)
        got = rt.top_k_rows(bounded, ["domain", "query_id"], order, limit).filter(F.col("similarity") > floor)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
        if limit <= 10:
            assert bounded.count() < 0.05 * every.count()


def test_no_queries_no_documents(spark):
    q, d = weights(spark, random.Random(1), 20, 3)
    for n in (0, 10**6):
        assert rt.bounded_similarity(q.limit(0), d, read_all=n).collect() == [] and rt.bounded_similarity(q, d.limit(0), read_all=n).collect() == []
    some = rt.bounded_similarity(q, d, read_all=8, floor=0.0, limit=100)
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, rt.similarity(q, d).select(*some.columns).collect()))


def jaccard_pairs(texts, threshold, k):
    sets = {}
    for i, t in texts:
        w = t.lower().split()
        sets[i] = {" ".join(w[p:p + k]) for p in range(max(len(w) - k, 0) + 1)} if w else set()
    ids = [i for i in sets if sets[i]]
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in ids for b in ids
            if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def test_near_pairs_are_those_of_brute_force(spark):
    rng = random.Random(6)
    texts = []
    for i, t in documents(rng, 60, common=False):
        texts.append((3 * i, t))
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append((3 * i + 1, " ".join(w)))
        texts.append((3 * i + 2, t + " one two" * rng.randrange(0, 3)))
    df = spark.createDataFrame(texts, "id long, text string")
    for threshold in (0.5, 0.8, 1.0):
        got = {(r["a"], r["b"]): r["jaccard"] for r in go.near_duplicates(df, "id", "text", threshold).collect()}
        want = jaccard_pairs(texts, threshold, 3)
        groups = Counter(t for _, t in texts)
        assert set(got) <= set(want) and all(abs(got[p] - want[p]) < 1e-12 for p in got)
        text = dict(texts)
        reps = {min(i for i, x in texts if x == t) for t in groups}
        assert {p for p in want if p[0] in reps and p[1] in reps} <= set(got)
        assert all(text[p[0]] == text[p[1]] for p in set(want) - set(got) if p[0] in reps and p[1] not in reps) or threshold < 1


def test_boilerplate_makes_few_candidates(spark):
    """Texts that share 60 % of their words with all others, but are no near copies."""
    rng = random.Random(9)
    boilerplate = " ".join(f"b{i}" for i in range(60))
    sets = []
    for i in range(300):
        own = " ".join(f"x{rng.randrange(5000)}" for _ in range(40))
        w = f"{boilerplate} {own}".split()
        sets += [(i, s) for s in {" ".join(w[p:p + 3]) for p in range(len(w) - 2)}]
    # a pair of true near copies among them
    near = [s for i, s in sets if i == 0]
    sets += [(1000, s) for s in near[:-3]] + [(1000, "n1"), (1000, "n2")]
    df = spark.createDataFrame(sets, "id long, s string")
    cand = go.near_candidates(df, "id", 0.8)
    found = {(r["a"], r["b"]) for r in cand.collect()}
    assert (0, 1000) in found and len(found) < 0.01 * 300 * 299 / 2
    low = go.near_candidates(df, "id", 0.5).count()
    assert low < 0.6 * 300 * 299 / 2

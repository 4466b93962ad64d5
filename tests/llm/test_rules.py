import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import kernel as K
from quarry.llm import queries, rules

SF = "/root/testdata/sf0.01"


def base(t, split):
    t = t or ""
    w = split(t)
    five = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered, seen, dup = set(), set(), 0
    for i in range(len(w) - 4):
        if five[tuple(w[i:i + 5])] > 1:
            covered |= set(range(i, i + 5))
    for line in t.split("\n"):
        if split(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


LABELS = "doc_id long, quality int, extra string"


def test_base_counts_against_brute_force(spark, docs, corpus, split):
    more = [(5000, "same line\nsame line\n same line\n\n\n \n \nsame line\r\nsame line\r\n## a|b <c> 5% & $ *"), (5001, "été ünï x\n" * 3)]
    d = docs.select("doc_id", "text").unionAll(spark.createDataFrame(more, "doc_id long, text string"))
    got = rules.score(d, spark.createDataFrame([], LABELS)).collect()
    want = [(i, *base(t, split)) for i, t in [*corpus, *more]]
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert (r["base_failed"], r["kept"]) == (failed, not failed)          # no labels: no verdict of the ratio


def test_ratio_against_brute_force(spark):
    rows = [(1, "a b a", 1), (2, "b c", 0), (3, None, 1), (4, "a b c d", None), (5, "c d d", 1), (6, "b b", 1), (None, "e", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, trusted int")
    got = rules.ratios(d.select("doc_id", "text"), d.filter("trusted = 1").select(F.col("doc_id").alias("_id")))
    fold = {i: int(rules._fold(np.array([i]))[0]) for i in range(1, 7)}
    assert len(set(fold.values())) > 2 and got.shape == (1 + rules.FOLDS, rules.SLOTS)

    def slots(t):
        w = (t or "").split()
        hs = {x: int(K.words(K.texts(pa.array([x]))).h[0]) for x in w}
        pairs = [int(K.windows(np.array([hs[a], hs[b]], np.uint64), np.zeros(2, int), 2)[1][0]) for a, b in zip(w, w[1:])]
        return [x >> 48 for x in [*(hs[x] for x in w), *pairs]]
    raw = Counter(x for _, t, _ in rows for x in slots(t))
    for k, ids in enumerate([set(fold), *({i for i in fold if fold[i] != f} for f in range(rules.FOLDS))]):
        target = Counter(x for i, t, y in rows if y == 1 and i in ids for x in slots(t))
        for s in {*raw, 17}:
            p = (target[s] + 1) / (sum(target.values()) + rules.SLOTS)
            q = (raw[s] + 1) / (sum(raw.values()) + rules.SLOTS)
            assert got[k][s] == pytest.approx(np.log(p / q) if target else 0)


def test_no_text_meets_the_labels(spark, docs, monkeypatch):
    """The plan of the joins holds no text, however many labels there are; results don't depend on the bitmap."""
    plans = []
    table = rules.X.table

    def seen(df, name):
        plans.append(df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted"))
        return table(df, name)
    monkeypatch.setattr(rules.X, "table", seen)
    outs = []
    for places in (1, rules.PLACES):        # with one word, most ids are marked
        monkeypatch.setattr(rules, "PLACES", places)
        labels = spark.createDataFrame([(2 * i, i % 2, "x") for i in range(60)], LABELS)
        outs.append(sorted(map(tuple, rules.score(docs, labels).collect()), key=repr))
    assert outs[0] == outs[1] and any(r[6] != 0 for r in outs[0])
    moved = [p for plan in plans for p in plan.split("\n\n") if re.match(r"\(\d+\) (Exchange|SortMergeJoin|ShuffledHashJoin)", p.strip())]
    assert moved and not [p for p in moved if "text#" in p and "REPARTITION_BY_NUM" not in p]     # the fixture's own


def test_labels_are_separated(spark):
    out = {r["doc_id"]: r for r in queries.QUERIES["op3_quality_rules"](spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = [out[r["doc_id"]]["kept"] for r in labels if r["quality"] == 1 and not out[r["doc_id"]]["base_failed"]]
    bad = [out[r["doc_id"]]["kept"] for r in labels if r["quality"] == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1


def test_several_null_and_unknown_labels_and_no_rows(spark, docs, none):
    labels = spark.createDataFrame([(0, 1, "x"), (0, 0, "x"), (None, 1, "x"), (2, None, "x"), (10**9, 1, "x"), (4, 1, "x"), (4, 1, "x")], LABELS)
    assert rules.score(docs, labels).count() == docs.count()
    assert rules.score(none, labels).collect() == []


def test_the_threshold_rejects_few_of_the_trusted(spark):
    rows = [(1, 0.5 + i / 1000) for i in range(1000)] + [(0, -0.5 - i / 1000) for i in range(100)] + [(None, 9.0)]
    cut = rules.threshold(spark.createDataFrame(rows, "trusted int, apart double"))
    assert -0.5 < cut <= 0.5
    overlap = [(1, i / 1000) for i in range(1000)] + [(0, i / 1000) for i in range(1000)]
    assert rules.threshold(spark.createDataFrame(overlap, "trusted int, apart double")) <= 0.01
    assert rules.threshold(spark.createDataFrame(rows[:5], "trusted int, apart double")) == -np.inf

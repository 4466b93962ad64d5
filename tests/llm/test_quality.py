import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import kernel as K
from quarry.llm import quality as Q
from quarry.llm import queries

SF = "/root/testdata/sf0.01"


def test_held_out_labels(spark):
    out = {r["doc_id"]: r for r in queries.QUERIES["op2_quality_classifier"](spark, SF).collect()}
    labels = [(r["quality"], out[r["doc_id"]]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([y == r["kept"] for y, r in labels]) > 0.95
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count()


def sites(spark):
    """Good and bad hosts whose texts look alike, and a host with a single text."""
    rows, labels = [], []
    for i in range(400):
        host = ("good", "bad")[i % 2] if i else "single"
        rows.append((i, "all the same words here", host, f"p{i % 4 // 2}"))
        if i % 3:
            labels.append((i, int(host == "good" if i % 40 > 1 else host == "bad")))
    labels += [(0, 1)]
    return (spark.createDataFrame(rows, "doc_id long, text string, host string, path string"),
            spark.createDataFrame(labels, "doc_id long, quality int"))


def test_hosts_tell_equal_texts_apart_and_sparse_ones_shrink(spark):
    d, y = sites(spark)
    out = Q.score(d, y, F.col("host"), F.col("path")).collect()
    by = {h: [r for r in out if r["host"] == h] for h in ("good", "bad", "single")}
    assert min(r["score"] for r in by["good"]) > 0.7 and max(r["score"] for r in by["bad"]) < 0.3
    assert len({r["p_doc"] for r in out}) == 1
    assert abs(by["single"][0]["p_host"] - 0.5) < 0.1                 # its own label is taken out: the prior is left


def test_posteriors_against_brute_force(spark):
    d, y = sites(spark)
    out = {r["doc_id"]: r for r in Q.score(d, y, F.col("host"), F.col("path")).collect()}
    label = {r["doc_id"]: r["quality"] for r in y.collect()}
    p = next(iter(out.values()))["p_doc"]
    n = {i: 1.0 if i in label else Q.SOFT for i in out}
    s = {i: n[i] * label.get(i, p) for i in out}
    mean = sum(s.values()) / sum(n.values())

    def strength(groups):                   # (n, s, prior) of each
        scatter = sum(k * (t / k - q) ** 2 for k, t, q in groups)
        noise, top = sum(q * (1 - q) for _, _, q in groups), sum(k * q * (1 - q) for k, _, q in groups)
        total = sum(k for k, _, _ in groups)
        return float(np.clip(top / total / max((scatter - noise) / total, 1e-6) - 1, 1, 1e5))

    def sums(key):
        g = {}
        for i, r in out.items():
            a = g.setdefault(key(r), [0.0, 0.0])
            a[0] += n[i]
            a[1] += s[i]
        return g
    hosts, paths = sums(lambda r: r["host"]), sums(lambda r: (r["host"], r["path"]))
    mh = strength([(k, t, mean) for k, t in hosts.values()])
    post = {h: (t + mh * mean) / (k + mh) for h, (k, t) in hosts.items()}
    mp = strength([(k, t, post[h]) for (h, _), (k, t) in paths.items()])
    for i, r in out.items():
        k, t = hosts[r["host"]]
        ph = (t - s[i] + mh * mean) / (k - n[i] + mh)
        k, t = paths[(r["host"], r["path"])]
        pp = (t - s[i] + mp * ph) / (k - n[i] + mp)
        assert (r["p_host"], r["p_path"]) == pytest.approx((ph, pp), abs=2e-6)
        odds = np.log(p / (1 - p)) + np.log(pp / (1 - pp)) - np.log(mean / (1 - mean))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-5)


def test_fit_separates_and_one_class_is_the_share():
    x = Q.vectors(K.texts(pa.array(["good fine words"] * 20 + ["junk### bad&&&"] * 20 + [None, ""])))
    w = Q.fit(x[:40], np.array([1.0] * 20 + [0.0] * 20))
    p = 1 / (1 + np.exp(-(x @ w)))
    assert p[:20].min() > 0.8 and p[20:40].max() < 0.2 and np.isfinite(p).all()
    assert 1 / (1 + np.exp(-Q.fit(x[:40], np.ones(40))[-1])) > 0.99


def test_odd_rows_and_labels(spark, docs, none):
    labels = spark.createDataFrame([(0, 1), (0, 0), (None, 1), (2, None), (4, 1), (4, 1), (10**9, 0)], "doc_id long, quality int")
    out = Q.score(docs, labels, F.col("source"), F.col("lang"))
    assert out.count() == docs.count() and out.filter("score is null or p_path is null").count() == 0
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["kept"] for r in Q.score(docs, empty, F.col("source"), F.col("lang")).collect()} <= {True, False}
    assert Q.score(none, labels, F.col("source"), F.col("lang")).collect() == []


def hot_site(spark):
    """One host with most rows, in many paths of one to three rows, and a small host."""
    rows = [(i, "all the same words here", "hot" if i % 50 else "small", f"p{i // 3 if i % 7 else i}") for i in range(1500)]
    labels = [(i, int(i // 3 % 4 > 0)) for i in range(1500) if i % 3]
    return (spark.createDataFrame(rows, "doc_id long, text string, host string, path string"),
            spark.createDataFrame(labels, "doc_id long, quality int"))


def test_many_sparse_paths_below_a_hot_host(spark, monkeypatch):
    monkeypatch.setitem(globals(), "sites", hot_site)
    test_posteriors_against_brute_force(spark)

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from quarry.llm import mixing


def uniform(i, part, seed=mixing.SEED):
    return int(hashlib.md5(f"{seed}:{'' if i is None else i}:{part}".encode()).hexdigest()[:13], 16) / 2**52


def poisson(i, rate):
    parts = max(1, math.ceil(rate / mixing.PART))
    mean, total = rate / parts, 0
    for part in range(1, parts + 1):
        p = c = math.exp(-mean)
        k = 0
        while round(c, mixing.DIGITS) < 1 and round(c, mixing.DIGITS) <= uniform(i, part):
            k += 1
            p *= mean / k
            c += p
        total += k
    return total


def brute(rows, weights, epochs=1.0):
    n = {}
    for _, s in rows:
        n[s] = n.get(s, 0) + 1
    w = {s: weights.get(s, 0) if weights else 1 for s in n}
    out = []
    for i, s in rows:
        rate = w[s] / sum(w.values()) * len(rows) / n[s] * epochs
        out += [(i, s, k + 1) for k in range(poisson(i, rate))]
    return sorted(out, key=repr)


def counts(df):
    return sorted(((r["doc_id"], r["source"], r["copy"]) for r in df.select("doc_id", "source", "copy").collect()), key=repr)


ROWS = [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(400)] + [(7, None), (None, "s1"), (7, None), (8, "s1")]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, s, "t", 1) for i, s in ROWS], "doc_id long, source string, text string, _mix_extra int")


def test_copies_against_brute_force(spark, frame):
    assert counts(mixing.mix(frame)) == brute(ROWS, None)
    weights = {"hot": 1.0, "s1": 3.0, "absent": 9.0}
    targets = spark.createDataFrame([(s, w, 0) for s, w in weights.items()], "source string, weight double, extra int")
    assert counts(mixing.mix(frame, targets, epochs=2.0)) == brute(ROWS, weights, 2.0)


def test_large_rates_are_sums_of_parts(spark):
    rows = [(i, "big") for i in range(60)] + [(100, "tiny")]
    d = spark.createDataFrame([(i, s, "t") for i, s in rows], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("tiny", 1000.0), ("big", 1.0)], "source string, weight double")
    got = counts(mixing.mix(d, targets, epochs=5.0))
    assert got == brute(rows, {"tiny": 1000.0, "big": 1.0}, 5.0)
    assert 230 < sum(s == "tiny" for _, s, _ in got) < 380


def test_partitions_do_not_matter_and_order_is_shuffled(spark, frame):
    assert counts(mixing.mix(frame.repartition(13))) == counts(mixing.mix(frame.coalesce(1)))
    big = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    ids = [r["doc_id"] for r in mixing.mix(big).collect()]
    up = sum(a < b for a, b in zip(ids, ids[1:])) / len(ids)
    assert 0.45 < up < 0.55 and 2800 < len(ids) < 3200


def test_target_shares_are_met(spark):
    d = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "rare").otherwise("often").alias("source"))
    targets = spark.createDataFrame([("rare", 0.5), ("often", 0.5)], "source string, weight double")
    share = mixing.mix(d, targets).filter("source = 'rare'").count() / 6000
    assert 0.46 < share < 0.54


def test_shuffle_join_beyond_the_broadcast_bound(frame, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCES", 2)
    assert counts(mixing.mix(frame)) == brute(ROWS, None)


def test_plan_has_no_python(frame, docs, none, spark):
    plan = mixing.mix(frame)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert mixing.mix(docs).columns == [*docs.columns, "copy"]
    assert mixing.mix(none).collect() == []
    assert mixing.mix(frame, spark.createDataFrame([], "source string, weight double")).collect() == []

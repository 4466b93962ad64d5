"""Scans over key ranges against plain windows: results, hot groups, plan size; percentiles by descent."""
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import mentor as mo
from quarry.operators import registry as ro
from quarry.plans.ordinal import scan, with_ordinal, with_range


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def hot(spark, n=6000):
    """A group with 90 % of the rows, null keys, small groups."""
    g = F.when(F.col("id") % 10 > 0, F.lit("hot")).when(F.col("id") % 50 == 0, F.lit(None)).otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string")))
    return spark.range(n).select(g.alias("g"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("k"), F.col("id").alias("v"),
                                 (F.col("id") % 5).cast("double").alias("x"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("w"))


@pytest.mark.parametrize("parts", [1, 5, 64])
def test_scan_equals_windows(spark, parts):
    df = hot(spark).repartition(parts)
    got = scan(df, ["g"], ["k"], "n", {"sx": "x", "sw": "w"}, {"pv": "v", "pw": "w"}, 10, {"h": "x"}, num_partitions=parts)
    w = Window.partitionBy("g").orderBy("k")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("n", F.row_number().over(w)).withColumn("sx", F.sum("x").over(upto)).withColumn("sw", F.sum("w").over(upto)) \
        .withColumn("pv", F.lag("v").over(w)).withColumn("pw", F.lag("w").over(w)) \
        .withColumn("h", F.sum(F.when(F.col("n") <= 10, F.col("x"))).over(Window.partitionBy("g")))
    assert rows(got) == rows(want)
    assert scan(df.limit(0), ["g"], ["k"], "n", {"s": "x"}, {"p": "v"}).collect() == []


def test_plan_does_not_grow_with_ranges_and_nothing_runs_before(spark):
    df = hot(spark)
    sizes = [len(with_ordinal(df, ["k"], ["g"], num_partitions=n)._jdf.queryExecution().analyzed().toString()) for n in (16, 2000)]
    assert abs(sizes[1] - sizes[0]) < 0.05 * sizes[0]
    seen = {r["_q_range"]: r["count"] for r in with_range(df, ["g", "k"], 2000).groupBy("_q_range").count().collect()}
    assert max(seen) <= 2000 and len(seen) > 150 and max(seen.values()) < 0.03 * 6000
    got = with_ordinal(df, ["k"], ["g"], name="o", num_partitions=2000)
    want = df.withColumn("o", F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1)
    assert rows(got) == rows(want)


def windows_of(df):
    """Partition keys of the windows over rows (not over the small tables of ranges)."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.split("\n") if line.strip(" :+-").startswith("Window ")]


def test_histories_of_a_hot_domain(spark):
    d = hot(spark).select(F.col("g").alias("domain"), F.col("k").alias("deployed_at"), F.col("v").alias("deployment_id"),
                          F.concat(F.lit("m"), (F.col("v") % 9).cast("string")).alias("model_id"), F.when(F.col("x") > 0, "deployed").otherwise("failed").alias("status"))
    got = ro.promotion_history(d)
    w = Window.partitionBy("domain").orderBy("deployed_at", "deployment_id")
    want = d.filter("status = 'deployed'").withColumn("replaced_model", F.lag("model_id").over(w)).withColumn("promotion_no", F.row_number().over(w))
    assert rows(got.select(*sorted(got.columns))) == rows(want.select(*sorted(got.columns)))
    assert all("_q_range" in line for line in windows_of(got))


def test_decline_ranks_ten_rows_of_a_domain(spark):
    h = hot(spark).filter("g is not null").select(F.col("g").alias("domain"), F.col("k").alias("day"), (F.col("v") % 11 / 10).alias("overall_score"))
    got = {r["domain"]: (r["points"], r["decline"]) for r in ro.performance_decline(h).collect()}
    by = {}
    for r in sorted(h.collect(), key=lambda r: -r["day"]):
        by.setdefault(r["domain"], []).append(r["overall_score"])
    for g, s in by.items():
        old = sum(s[5:10]) / max(1, len(s[5:10]))
        want = 0.0 if len(s) < 2 else max(0.0, old - sum(s[:5]) / len(s[:5]))
        assert got[g] == (len(s), pytest.approx(want))
    plan = ro.performance_decline(h)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_phases_of_a_hot_session(spark):
    kinds = F.element_at(F.array(*[F.lit(k) for k in mo.TYPE_WEIGHT]), (F.col("v") % 4 + 1).cast("int"))
    m = hot(spark, 3000).select(F.col("g").alias("session_id"), F.col("k").alias("ts"), F.col("v").alias("feedback_id"), kinds.alias("mtype"),
                                F.when(F.col("w").isNotNull(), F.col("x")).alias("rating"))
    got = mo.session_phase(m)
    by = {}
    for r in sorted(m.collect(), key=lambda r: (r["ts"], r["feedback_id"])):
        by.setdefault(r["session_id"], []).append(r)
    want = {}
    for s, records in by.items():
        weight = [mo.TYPE_WEIGHT[r["mtype"]] for r in records]
        score = [mo.TYPE_SCORE[r["mtype"]] if r["rating"] is None else (mo.TYPE_SCORE[r["mtype"]] + r["rating"] / 5) / 2 for r in records]
        decision = sum(a * b for a, b in zip(weight[:10], score)) / sum(weight[:10])
        for n, r in enumerate(records, 1):
            want[r["feedback_id"]] = (n, "initial" if n < 5 else "feedback" if n < 10 else "validation" if decision >= 0.7 else "refinement")
    assert {r["feedback_id"]: (r["feedback_count"], r["phase"]) for r in got.collect()} == want
    assert all("_q_range" in line for line in windows_of(got) if "feedback_id" in line)


def test_percentiles_by_descent(spark, monkeypatch):
    monkeypatch.setattr(ro, "RANKED", 2_000)
    df = spark.range(1_000_000).select((F.col("id") % 10 < 9).alias("g"), F.exp(F.pmod(F.xxhash64("id"), F.lit(10**6)) / 50_000).alias("v"))
    wanted = {"a": 0.5, "b": 0.95, "c": 0.0, "d": 1.0, "e": 0.123456}
    got = sorted(map(tuple, ro.exact_percentiles(df, ["g"], "v", wanted).collect()))
    exp = sorted(map(tuple, df.groupBy("g").agg(*[F.expr(f"percentile(v, {q})").alias(n) for n, q in wanted.items()]).collect()))
    for g, e in zip(got, exp):
        assert g[0] == e[0] and g[1:] == pytest.approx(e[1:], rel=1e-12)


def test_descent_bounds_the_rows_ranked(spark):
    counts = spark.range(1_000_000).select(F.lit(0).alias("g"), F.exp(F.col("id") / 20_000).alias("_v"), F.lit(1).cast("long").alias("_c"))
    spots = spark.createDataFrame([(0, 950_000, 950_000), (0, 5, 5)], "g int, _k0 long, _k long")
    narrow, keys, spots = ro._narrowed(counts, ["g"], spots, 0)
    assert max(r["count"] for r in narrow.groupBy(*keys).count().collect()) < 1_000_000 / (ro.BUCKETS - 12)
    narrow, keys, spots = ro._narrowed(narrow, keys, spots, 1)
    assert max(r["count"] for r in narrow.groupBy(*keys).count().collect()) < 1_000_000 / (ro.BUCKETS - 12)**2
    assert spots.count() == 2

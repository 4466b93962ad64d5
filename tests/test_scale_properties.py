"""Property tests: results independent of partition count and input order; plans without
cartesian products; per-group top-k planned with a partial window-group limit."""
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.plans.ordinal import running_sum, with_ordinal, with_range
from quarry.plans.topk import top_terms


@pytest.mark.parametrize("parts", [1, 7, 200])
def test_ordinal_independent_of_partitions(spark, parts):
    df = spark.range(0, 500).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 500).alias("k"))
    df = df.repartition(parts)
    got = with_ordinal(df, ["k"], ["g"], name="o", num_partitions=parts)
    exp = df.withColumn("o", F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1)
    assert sorted(map(tuple, got.select("g", "k", "o").collect())) == sorted(map(tuple, exp.select("g", "k", "o").collect()))


def test_running_sum_matches_window(spark):
    df = spark.range(0, 300).select((F.col("id") % 2).alias("g"), F.col("id").alias("k"),
                                    (F.col("id") % 7).cast("double").alias("v")).repartition(5)
    got = running_sum(df, ["g"], ["k"], "v", "c", "s")
    w = Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.withColumn("c", F.count(F.lit(1)).over(w)).withColumn("s", F.sum("v").over(w))
    assert sorted(map(tuple, got.select("g", "k", "c", "s").collect())) == \
        sorted(map(tuple, exp.select("g", "k", "c", "s").collect()))


def test_ordinal_needs_no_checkpoint_and_spreads_a_hot_group(spark):
    df = spark.range(0, 20_000).select(F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("g"), F.col("id").alias("k"))
    got = with_ordinal(df, ["k"], ["g"], name="o", num_partitions=16)
    assert "LogicalRDD" not in got._jdf.queryExecution().analyzed().toString()
    assert got.groupBy("g").agg(F.max("o").alias("m"), F.count_distinct("o").alias("n")).orderBy("g").collect() == \
        [("hot", 17_999, 18_000), ("rare", 1_999, 2_000)]
    sizes = [r["count"] for r in with_range(df, ["g", "k"], 16).groupBy("_q_range").count().collect()]
    assert len(sizes) > 12 and max(sizes) < 3 * 20_000 / 16


def test_ordinal_handles_null_keys_and_no_rows(spark):
    df = spark.createDataFrame([(None, 3), ("a", None), ("a", 1), (None, None)], "g string, k int")
    got = with_ordinal(df, ["k"], ["g"], name="o", num_partitions=3)
    assert sorted(((r.g, r.k, r.o) for r in got.collect()), key=repr) == [("a", 1, 1), ("a", None, 0), (None, 3, 1), (None, None, 0)]
    assert with_ordinal(df.limit(0), ["k"], ["g"], name="o").collect() == []


def test_percentile_counts_ties_once(spark):
    from quarry.operators.registry import exact_percentiles
    df = spark.range(0, 20_000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 10 < 9, 7.0).otherwise(F.col("id") * 1.5).alias("v"))
    got = exact_percentiles(df, ["g"], "v", {"a": 0.5, "b": 0.95, "c": 0.0, "d": 1.0})
    exp = df.groupBy("g").agg(*[F.expr(f"percentile(v, {q})").alias(n) for n, q in (("a", 0.5), ("b", 0.95), ("c", 0), ("d", 1))])
    for g, e in zip(sorted(got.collect()), sorted(exp.collect())):
        assert tuple(g) == pytest.approx(tuple(e))
    one = exact_percentiles(df, [], "v", {"p": 0.97})
    assert one.first().p == pytest.approx(df.agg(F.expr("percentile(v, 0.97)")).first()[0])
    assert exact_percentiles(df.limit(0), ["g"], "v", {"p": 0.5}).collect() == []


def test_two_stage_top_k_is_exact(spark, monkeypatch):
    from quarry.plans import topk
    monkeypatch.setattr(topk, "GROUP_LIMIT", 10)
    df = spark.range(0, 3000).select((F.col("id") % 2).alias("g"), F.pmod(F.xxhash64("id"), F.lit(500)).alias("v"), "id")
    got = topk.top_k_rows(df, ["g"], [F.col("v").desc(), F.col("id")], 40)
    w = Window.partitionBy("g").orderBy(F.col("v").desc(), "id")
    exp = df.withColumn("rank", F.row_number().over(w)).filter("rank <= 40")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))


def test_latest_and_first_rows_move_no_payload_through_aggregates(spark):
    from quarry.operators import knowledge as ko
    from quarry.operators import training as tr
    k = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "id string, o long, content string")
    latest = ko.latest_per_id(k, ["o"])
    assert sorted(map(tuple, latest.select("id", "o", "content").collect())) == [("a", 2, "y"), ("b", 1, "z")]
    ex = spark.createDataFrame([("d", 1, "m"), ("d", 2, "m"), ("d", 3, "n"), ("e", 4, "m")], "domain string, o int, messages string")
    first = tr.dedup_examples(ex, ["domain"], ["o"])
    assert sorted(map(tuple, first.select("domain", "o", "messages").collect())) == [("d", 1, "m"), ("d", 3, "n"), ("e", 4, "m")]
    for df, column in ((latest, "content"), (first, "messages")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.split("\n") if "Aggregate" in x and column in x and "sha2" not in x]


def test_top_terms_plan_has_partial_limit(spark):
    df = spark.createDataFrame([("d", 1, ["a", "b", "a"]), ("d", 2, ["b", "c"])], "g string, o int, t array<string>")
    t = top_terms(df, ["g"], F.col("t"), ["o"], 2, "term")
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert [(r.term, r["count"]) for r in t.orderBy("rank").collect()] == [("a", 2), ("b", 2)]


def test_no_cartesian_products(spark, sf):
    import __spark_entry__ as entry
    qs = entry.queries()
    for name in ["f_adaptive_training_set", "f_similarity_search", "f_compare_models", "f_near_duplicates",
                 "f_feedback_analysis"]:
        plan = qs[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name

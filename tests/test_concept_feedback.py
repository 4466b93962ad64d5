"""f_concept_feedback: what builds the concepts of a text is evaluated once, and no document's text moves."""
import re

from pyspark.sql import functions as F

from quarry.functions.lexicons import TEST_LEXICON
from quarry.operators import context as co
from quarry.plans import document_queries as dq

TERM = TEST_LEXICON["technical"][0]
EXCHANGED = re.compile(r"Exchange hashpartitioning\(doc_id")


def tables(spark, folder):
    for name, rows, schema in (
            ("events", [(i, i % 5, ("view", "purchase", "error", "click")[i % 4], float(i)) for i in range(40)],
             "event_id long, user_id long, event_type string, value double"),
            ("conversations", [(c, t, ("user", "assistant")[t], f"{TERM} text {c}" if t else f"asks {c}") for c in range(6) for t in (0, 1)],
             "conv_id long, turn int, role string, text string"),
            ("documents", [(i, f"Some {TERM} words" if i % 3 else "none", "s") for i in range(12)], "doc_id long, text string, source string"),
            ("labels", [(i // 2, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int")):
        df = spark.createDataFrame(rows, schema)
        if name == "events":
            df = df.withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_concepts_are_built_once_and_texts_stay(spark, tmp_path):
    sf = tables(spark, tmp_path)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = dq.f_concept_feedback(spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("map_from_arrays") == 1 and not re.search(r"size\((map_from|CASE)", plan)
        # each term is looked for in feedback, and in documents of its domain, once
        assert plan.count(f", {TERM})") == 2
        below = plan[EXCHANGED.search(plan).start():].splitlines()[1]
        assert "Project" in below and "text" not in below.split("[", 1)[1].split(",")[0] and not re.search(r"[\[ ,](text|content)#\d+[,\]]", below)
        got = {(r.domain, r.concept): (r.score, r.is_priority) for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    domains = ("technical", "medical", "legal", "financial")
    want = {}
    for i in range(40):
        if i % 4 != 3:
            d = domains[i % 5 % 4]
            want[d] = want.get(d, 0) + (1 + i % 5 - 3) / 2
    want = {(d, TERM): (s, s > 0.5 and d == "technical") for d, s in want.items()}
    assert {k: v for k, v in got.items() if k[1] == TERM} == want


def test_empty_and_null_lists_give_no_concepts(spark):
    fb = spark.createDataFrame([("a", {"x": 1.0, "y": 0.25}), ("a", {}), ("a", None), ("b", {"x": 2.0}), (None, {"x": 1.0})],
                               "domain string, concept_scores map<string,double>")
    kc = spark.createDataFrame([("a", ["x", "x", None]), ("a", []), ("b", None), (None, ["x"])], "domain string, key_concepts array<string>")
    got = {tuple(r) for r in co.concept_feedback(fb, kc).select("domain", "concept", "score", "is_priority").collect()}
    assert got == {("a", "x", 1.0, True), ("a", "y", 0.25, False), ("b", "x", 2.0, False), (None, "x", 1.0, False)}

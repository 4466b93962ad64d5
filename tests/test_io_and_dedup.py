"""Round trips of the file sources/sinks; near duplicates against brute force."""
import itertools
import tempfile

from pyspark.sql import functions as F

from quarry.operators import generation as go
from quarry.sources import files as fs
from quarry.sources.views import knowledge_view, table


def test_knowledge_roundtrip_parquet_and_json(spark, sf):
    k = knowledge_view(spark, sf).drop("doc_id").withColumn("metadata", F.create_map().cast("map<string,string>"))
    d = tempfile.mkdtemp(prefix="quarry-test-")
    fs.write_knowledge(k, f"{d}/kb")
    back = fs.read_knowledge(spark, f"{d}/kb")
    assert back.count() == k.count()
    assert back.filter(F.col("domain") == "legal").count() == k.filter(F.col("domain") == "legal").count()
    fs.write_knowledge(k.filter(F.col("domain") == "legal").limit(3), f"{d}/kb")  # dynamic overwrite
    again = fs.read_knowledge(spark, f"{d}/kb")
    assert again.filter(F.col("domain") == "legal").count() == 3
    assert again.filter(F.col("domain") == "technical").count() == k.filter(F.col("domain") == "technical").count()
    fs.write_knowledge_json(k, f"{d}/kbj")
    j = fs.read_knowledge_json(spark, f"{d}/kbj")
    assert sorted(r.id for r in j.select("id").collect()) == sorted(r.id for r in k.select("id").collect())


def test_jsonl_and_sessions_roundtrip(spark):
    from quarry.operators import training as tr
    d = tempfile.mkdtemp(prefix="quarry-test-")
    ex = spark.createDataFrame([("legal", "q1", "a1"), ("medical", "q2", None)], "domain string, prompt string, response string")
    tr.write_jsonl(ex, f"{d}/jl", fields=("prompt", "response"))
    back = fs.read_jsonl(spark, f"{d}/jl")
    assert sorted((r.prompt, r.response) for r in back.collect()) == [("q1", "a1"), ("q2", None)]


def test_near_duplicates_equal_brute_force(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    got = {(r.a, r.b) for r in go.near_duplicates(docs, "doc_id", "text", 0.8).collect()}
    sh = {r.doc_id: frozenset(r.s) for r in docs.select("doc_id", go.shingles(F.col("text")).alias("s")).collect() if r.s}
    rep = {}
    for d in sorted(sh):
        rep.setdefault(sh[d], d)
    exp = {(rep[s], d) for d, s in sh.items() if rep[s] != d}          # exact copies → representative
    reps = sorted(rep.values())
    for a, b in itertools.combinations(reps, 2):                       # all pairs of distinct sets
        j = len(sh[a] & sh[b]) / len(sh[a] | sh[b])
        if j >= 0.8:
            exp.add((a, b))
    assert got == exp


def test_sessions_roundtrip(spark):
    from datetime import datetime
    d = tempfile.mkdtemp(prefix="quarry-test-")
    rec = [("s1", "ad0", "legal", "feedback", "active", datetime(2024, 1, 1), f"f{i}", "positive", "t", 4.0, False,
            datetime(2024, 1, 1, 0, i)) for i in range(3)]
    rec.append(("s2", "ad1", "legal", "initial", "completed", datetime(2024, 1, 2), "g1", "negative", "t", None, True,
                datetime(2024, 1, 2)))
    df = spark.createDataFrame(rec, "session_id string, adapter_id string, domain string, phase string, status string, "
                                    "start_time timestamp, feedback_id string, feedback_type string, feedback_text string, "
                                    "rating double, applied boolean, timestamp timestamp")
    fs.write_sessions(df, f"{d}/s")
    back = fs.read_sessions(spark, f"{d}/s")
    assert sorted(r.feedback_id for r in back.collect()) == ["f0", "f1", "f2"]   # active sessions only


def test_text_documents_keep_whole_files_and_paths(spark, tmp_path):
    (tmp_path / "a.txt").write_text("line one\n\nline two\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("", encoding="utf-8")
    (tmp_path / "c.md").write_text("not read", encoding="utf-8")
    got = {r.file_path.rsplit("/", 1)[1]: r.text for r in fs.read_text_documents(spark, f"{tmp_path}/*.txt").collect()}
    assert got["a.txt"] == "line one\n\nline two\n" and "c.md" not in got


def feedback_rows(spark):
    from datetime import datetime
    t = datetime(2024, 1, 1)
    names = [f.name for f in fs.FEEDBACK_ENTRY.fields]
    rows = []
    for i, (domain, kind) in enumerate([("legal", "rating"), ("legal", "odd"), ("medical", "praise")]):
        r = dict.fromkeys(names) | {"domain": domain, "feedback_type": kind, "timestamp": t, "rating": float(i), "processed": False}
        rows.append(tuple(r[n] for n in names))
    return spark.createDataFrame(rows, fs.FEEDBACK_ENTRY)


def test_feedback_roundtrip_flags_unknown_types_and_rewrites_one_domain(spark, tmp_path):
    fb = feedback_rows(spark)
    fs.write_feedback(fb, f"{tmp_path}/fb")
    back = fs.read_feedback(spark, f"{tmp_path}/fb")
    assert sorted((r.domain, r.feedback_type, r.rating, r.type_valid) for r in back.collect()) == [
        ("legal", "odd", 1.0, False), ("legal", "rating", 0.0, True), ("medical", "praise", 2.0, True)]
    fs.write_feedback(fb.filter("feedback_type = 'rating'"), f"{tmp_path}/fb")
    assert sorted(r.feedback_type for r in fs.read_feedback(spark, f"{tmp_path}/fb").collect()) == ["praise", "rating"]


def test_feedback_document_form(spark, tmp_path):
    (tmp_path / "fb.json").write_text('{"legal": [{"feedback_type": "praise", "rating": 5.0}], "medical": [{"feedback_type": "x"}, {"feedback_type": "rating"}]}')
    got = fs.read_feedback_document(spark, f"{tmp_path}/fb.json").collect()
    assert sorted((r.feedback_type, r.type_valid) for r in got) == [("praise", True), ("rating", True), ("x", False)]


def test_document_summaries_read_back_in_order(spark, tmp_path):
    rows = [("s1", i, f"s1_{i}", f"text {i}", f"sum {i}", i) for i in (2, 0, 1)] + [("s2", 0, "s2_0", "t", "s", 1)]
    df = spark.createDataFrame(rows, "source_file string, ordinal int, segment_id string, original_text string, summary string, word_count int")
    fs.write_doc_summary(df, f"{tmp_path}/sum")
    back = spark.read.schema("ordinal int, segment_id string, summary string, source_file string").json(f"{tmp_path}/sum")
    assert [r.segment_id for r in back.filter("source_file = 's1'").orderBy("ordinal").collect()] == ["s1_0", "s1_1", "s1_2"]


def test_registry_and_cycles_roundtrip(spark, tmp_path):
    models = spark.createDataFrame([("m1", "deployed"), ("m2", "failed")], "model_id string, status string")
    fs.write_registry({"models": models, "adapters": models.limit(1)}, f"{tmp_path}/reg")
    back = fs.read_registry(spark, f"{tmp_path}/reg", ["models", "adapters"])
    assert back["models"].count() == 2 and back["adapters"].count() == 1
    from datetime import datetime
    schema = "cycle_id string, created_at timestamp"
    for n in range(3):
        fs.write_cycles(spark.createDataFrame([(f"c{n}", datetime(2024, 1, n + 1))], schema), f"{tmp_path}/cyc")
    assert sorted(r.cycle_id for r in fs.read_cycles(spark, f"{tmp_path}/cyc", schema).collect()) == ["c0", "c1", "c2"]
    assert [r.cycle_id for r in fs.read_cycles(spark, f"{tmp_path}/cyc", schema, keep=2).collect()] == ["c2", "c1"]


def test_knowledge_updates_merge_and_upsert(spark):
    from datetime import datetime
    from quarry.operators import knowledge as ko
    t = datetime(2024, 1, 1)
    cols = "id string, content string, metadata map<string,string>, version long, updated_at timestamp, o long"
    k = spark.createDataFrame([("a", "x", {"p": "1", "q": "2"}, 1, t, 1), ("b", "y", None, 1, t, 1)], cols)
    u = spark.createDataFrame([("a", None, {"q": "3"}), ("b", "new", None), ("z", "lost", None)], "id string, content string, metadata map<string,string>")
    got = {r.id: r for r in ko.apply_updates(k, u, "2024-02-01 00:00:00").collect()}
    assert set(got) == {"a", "b"} and got["a"].content == "x" and got["b"].content == "new"
    assert got["a"].metadata == {"p": "1", "q": "3"} and got["a"].version == 2 and got["b"].updated_at == datetime(2024, 2, 1)
    more = spark.createDataFrame([("a", "later", None, 5, t, 2), ("c", "c", None, 1, t, 1)], cols)
    up = {r.id: r.content for r in ko.upsert(k, more, ["o"]).collect()}
    assert up == {"a": "later", "b": "y", "c": "c"}


def test_shingles_as_a_step_and_moved_as_hashes(spark):
    """The step gives the sets of `shingles`, also of odd texts; candidates come from hashes, strings only verify them."""
    texts = ["a b c d", "A  B\tc\u3000d", "one", "two words", "", " \n ", None, "x x x x x x", "a\u0085b\u00a0c", "\u00df \u0130 z \U0001f600 y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = {r.id: r.g for r in go.add_shingles(df, "text", "g").collect()}
    want = {r.id: r.s or [] for r in df.select("id", go.shingles(F.col("text")).alias("s")).collect()}
    assert got == want and got[0] == ["a b c", "b c d"] and got[7] == ["x x x"] and got[2] == ["one"] and got[6] == []
    assert [tuple(r) for r in go.near_duplicates(df, "id", "text", 0.8).collect()] == [(0, 1, 1.0)]

"""Character references, batches over files, registry documents, profiles and performance history."""
import html
import json
import os
import random
from html.entities import html5

from pyspark.sql import functions as F

from quarry.operators import generation as go
from quarry.operators import registry as ro
from quarry.sources import files as fs
from quarry.sources.html import decode_references, page_text


def test_references_equal_the_standard(spark):
    rng = random.Random(2)
    names = sorted(html5)
    texts = [f"a &{n} b &{n.rstrip(';')}x &{n.rstrip(';')}" for n in names]
    texts += [f"&#{n}; &#x{n:x}; &#X{n:X} &#{n}z" for n in [*range(0, 400), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFFFD, 0xFFFE, 0xFFFF,
                                                          0x10000, 0x1F600, 0x1FFFE, 0x1FFFF, 0x10FFFD, 0x10FFFF, 0x110000, 10**8, 10**12, 10**30]]
    pieces = ["&", "&amp", "&amp;", "lt", ";", "&#", "&#x", "x41", "65", "&notit;", "&notin;", "&ampé", "é", " ", "&&", "&;", "&#0065;", "&#;", "&AMP", "😀", "&copy2"]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 8))) for _ in range(1500)] + ["", "none", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["x"] for r in df.select("i", decode_references("t").alias("x")).collect()}
    wrong = [(t, got[i], html.unescape(t)) for i, t in enumerate(texts) if t is not None and got[i] != html.unescape(t)]
    assert wrong == [] and got[len(texts) - 1] is None


def test_page_text_with_any_reference(spark):
    df = spark.createDataFrame([("<p>Caf&eacute; &frac12 &#8364;5 &nbsp;</p><p>&amp;lt; &unknown; &hearts;</p>",)], "h string")
    assert df.select(page_text("h")).first()[0] == "Café ½ €5 &lt; &unknown; ♥"


def test_batch_over_files(spark, tmp_path):
    top = tmp_path / "files"
    (top / "deep").mkdir(parents=True)
    (top / "good.txt").write_text("one two\n")
    (top / "deep" / "two.txt").write_text("2")
    (top / "empty.txt").write_text("")
    (top / "deep" / "bytes.bin").write_bytes(b"ok \xff\xfe")
    (top / "long.txt").write_text("x" * 5000)
    (top / "raises +a.txt").write_text("bad")
    (top / "unlisted.txt").write_text("not read")
    names = ["good.txt", "deep/two.txt", "deep/bytes.bin", "long.txt", "raises +a.txt", "nowhere.txt", "good.txt", "empty.txt"]
    items = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, seq int")

    def step(name, text):
        if text == "bad":
            raise RuntimeError(f"no {text}")
        return f"{len(text.split())}"
    found = go.process_files(items, fs.named_files(spark, str(top), 1000), step, max_bytes=1000)
    rows = {r["seq"]: (r["name"], r["status"], r["result"], r["error"]) for r in found.collect()}
    assert rows == {0: ("good.txt", "success", "2", None), 1: ("deep/two.txt", "success", "1", None), 2: ("deep/bytes.bin", "failed", None, "Not UTF-8 at byte 3"),
                    3: ("long.txt", "failed", None, "File too long: 5000 bytes"), 4: ("raises +a.txt", "failed", None, "RuntimeError: no bad"),
                    5: ("nowhere.txt", "failed", None, "File not found: nowhere.txt"), 6: ("good.txt", "success", "2", None), 7: ("empty.txt", "failed", None, "File not found: empty.txt")}
    assert tuple(go.batch_totals(found).first()) == (8, 3, 5)
    from pyspark.sql import Observation
    seen = Observation("batch")
    found.observe(seen, *go.totals()).write.format("noop").mode("overwrite").save()
    assert seen.get == {"total_files": 8, "successful": 3, "failed": 5}


def test_registry_documents_merge_at_any_depth(spark, tmp_path):
    first = {"models": {"m1": {"status": "deployed", "metrics": {"f": 1.5, "deep": {"a": 1, "b": [1, 2]}}}, 'od"d': {"x": None}}, "thresholds": {"low": 1},
             "unknown": {"k": {"z": "é\n"}}, "last_saved": "earlier", "flags": [1, 2], "empty": {}}
    second = {"models": {"m1": {"status": "failed", "metrics": {"deep": {"b": [3], "c": {"d": True}}}}, "m2": {"status": "new"}}, "thresholds": {"low": {"as": "object"}, "high": 2},
              "templates": {"t": {"text": "a {{b}}"}}, "last_saved": "later"}
    for name, x in (("a.json", first), ("b.json", second)):
        (tmp_path / name).write_text(json.dumps(x, indent=2))

    def deep(a, b):
        return {**a, **{k: deep(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}} if isinstance(a, dict) else b
    merged = fs.read_registry_document(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json"))
    fs.write_registry_document(merged, str(tmp_path / "out"))
    (part,) = [f for f in os.listdir(tmp_path / "out") if f.startswith("part") and os.path.getsize(tmp_path / "out" / f)]
    want = deep(first, second)
    want.pop("empty")           # a section without members has no entries
    assert json.loads((tmp_path / "out" / part).read_text()) == want
    again = fs.read_registry_document(spark, str(tmp_path / "out"))
    assert {(r["section"], r["key"]): json.loads(r["body"]) for r in again.collect()} == {(r["section"], r["key"]): json.loads(r["body"]) for r in merged.collect()}
    table = spark.createDataFrame([("m1", "v2", None)], "model_id string, version string, note string")
    entries = ro.merge_entries(merged, ro.registry_entries(table, "models", "model_id"))
    body = json.loads(entries.filter("section = 'models' and key = 'm1'").first()["body"])
    assert body["version"] == "v2" and body["status"] == "failed" and "note" not in body


def test_profiles_of_a_folder_win_over_builtin_ones(spark, tmp_path):
    builtin = spark.createDataFrame([("ada", "built in", "technical"), ("bob", "built in", "legal")], "name string, description string, domain string")
    for f, x in (("1.json", {"name": "ada", "description": "first", "case_studies": ["x"]}), ("2.json", {"name": "ada", "description": "second"}),
                 ("3.json", {"description": "without a name"}), ("notes.txt", {"name": "eve"})):
        (tmp_path / f).write_text(json.dumps(x, indent=1))
    got = {r["name"]: r["description"] for r in fs.read_profiles(spark, str(tmp_path), builtin).collect()}
    assert got == {"ada": "second", "bob": "built in"}


def test_performance_history_round_trip(spark, tmp_path):
    rows = [("legal", "m1", "2024-01-01 00:00:00", 0.5, {"a": 1.0, "b": 2.0}), ("legal", "m1", "2024-01-02 00:00:00", 0.6, {"a": 3.0}), ("medical", "m2", "2024-01-01 00:00:00", None, None)]
    df = spark.createDataFrame(rows, "domain string, model_id string, recorded_at string, overall_score double, metrics map<string,double>") \
        .withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    for i in (0, 1):      # appended in two runs
        fs.write_performance(df.filter((F.dayofmonth("recorded_at") == 2) == bool(i)), str(tmp_path / "h"))
    back = fs.read_performance(spark, str(tmp_path / "h"))
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    assert {r["model_id"]: r["metrics"] for r in fs.latest_metrics(back).collect()} == {"m1": {"a": 3.0, "b": 2.0}}


def test_private_checkpoint_folder_without_the_setting(tmp_path):
    """A local session whose configuration names no folder gets one (in a process of its own)."""
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import sys; sys.path.insert(0, %r)\n"
            "from quarry.session import ensure_checkpoint_dir, local_session\n"
            "s = local_session(1, 2)\n"
            "a, b = ensure_checkpoint_dir(s), ensure_checkpoint_dir(s)\n"
            "print('SAME', a == b and bool(a), s.range(5).checkpoint().count())\n") % root
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "QUARRY_DRIVER_MEMORY": "1g"}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=240)
    assert "SAME True 5" in out.stdout, out.stderr[-2000:]

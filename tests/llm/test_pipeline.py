import re
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from quarry.llm import mixing, pii

from .test_contamination import brute as contaminated
from .test_mixing import brute as copies
from .test_near import brute as near

SF = "/root/testdata/sf0.001"
LABELS = ["en", "de", "fr", "es"]


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of every stage over the fixture and a document in another script."""
    from quarry.session import ship_package
    ship_package(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(10**6, "Это совсем другой язык, которого здесь нет. " * 20, None, "src1", 900), (10**6 + 1, None, None, "src2", 0), (10**6 + 2, "...", "en", None, 3)]
    docs = docs.unionAll(spark.createDataFrame(odd, docs.schema))
    out = [("input", docs.columns, [tuple(r) for r in docs.collect()])]
    for name, stage in pipeline.STAGES:
        docs = pipeline.exchange.table(stage(spark, docs, SF), f"test-{name}")
        out.append((name, docs.columns, [tuple(r) for r in docs.collect()]))
    return out


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_names_and_columns(stages):
    assert [n for n, _, _ in stages[1:]] == ["language", "near_duplicates", "decontamination", "personal_data", "mixing"]
    assert all(c == stages[0][1] for _, c, _ in stages[:-1]) and stages[-1][1] == [*stages[0][1], "copy"]


def test_language_stage_drops_what_no_language_explains_only(stages):
    gone = Counter(stages[0][2]) - Counter(stages[1][2])
    assert not Counter(stages[1][2]) - Counter(stages[0][2])
    assert {r[0] for r in gone} == {10**6, 10**6 + 1, 10**6 + 2}


def test_near_duplicate_stage_against_brute_force(stages):
    keep = {i for i, _, _, k in near([(r[0], r[1]) for r in stages[1][2]], split) if k}
    assert sorted(stages[2][2]) == sorted(r for r in stages[1][2] if r[0] in keep)


def test_decontamination_stage_against_brute_force(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[0] for r in contaminated([(r[0], r[1]) for r in stages[2][2]], items) if r[-1]}
    assert bad and sorted(stages[3][2]) == sorted(r for r in stages[2][2] if r[0] not in bad)


def test_personal_data_stage(stages):
    before = {r[0]: r for r in stages[3][2]}
    assert len(before) == len(stages[4][2])
    for r in stages[4][2]:
        old = before[r[0]]
        assert not pii.base_spans(r[1]) and r[4] == len(r[1]) and r[2:4] == old[2:4]
        if not re.search(r"[0-9@]", old[1]):
            assert r == old


def test_mixing_stage_against_brute_force(stages):
    rows = {r[0]: r for r in stages[4][2]}
    want = copies([(r[0], r[3]) for r in stages[4][2]], None)
    assert sorted(((r[0], r[3], r[5]) for r in stages[5][2]), key=repr) == want
    assert all(r[:5] == rows[r[0]] for r in stages[5][2])


def test_run_and_empty_input(spark, stages, tmp_path):
    plain = pipeline.run(spark, SF)
    assert plain.columns == stages[-1][1] and plain.count() > 100
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_stage_defaults_match_the_operators():
    assert mixing.mix.__defaults__[0] is None and pipeline.ORACLE_SQL is None

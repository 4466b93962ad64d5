import numpy as np
import pytest

from quarry.llm import queries, tokens

SF = "/root/testdata/sf0.001"


def write(folder, files):
    folder.mkdir(exist_ok=True)
    for name, ids in files.items():
        (folder / name).write_bytes(np.array(ids, tokens.DTYPE).tobytes())


def brute(files, end):
    out = []
    for name, ids in files.items():
        place, start = 0, 0
        for k, x in enumerate(ids):
            if x == end:
                out.append((name, place, start, k - start, True))
                place, start = place + 1, k + 1
        if start < len(ids):
            out.append((name, place, start, len(ids) - start, False))
    return sorted(out)


@pytest.mark.parametrize("block", [2, 6, 10, 1 << 20])
def test_scan_stitches_blocks(spark, tmp_path, block):
    from quarry.session import ship_package
    ship_package(spark)
    rng = np.random.default_rng(0)
    files = {f"f{i}.bin": [int(x) for x in rng.integers(0, 4, 60)] for i in range(3)}
    files |= {"empty.bin": [], "one.bin": [0], "open.bin": [1, 2, 3], "long.bin": [1] * 50 + [0] + [2] * 50, "ends.bin": [0, 0, 0]}
    write(tmp_path / "t", files)
    got = sorted(map(tuple, tokens.scan(spark, str(tmp_path / "t"), end=0, block=block).collect()))
    assert got == brute(files, 0)


def test_other_width_and_a_cut_id(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.bin").write_bytes(np.array([5, 6, 9, 7], "<u4").tobytes() + b"\1\2")
    got = sorted(map(tuple, tokens.scan(spark, str(tmp_path / "w"), end=9, dtype="<u4", block=9).collect()))
    assert got == [("a.bin", 0, 0, 2, True), ("a.bin", 1, 3, 1, False)]


def test_only_listed_files_are_read(spark, tmp_path):
    write(tmp_path / "l", {"a.bin": [1, 0], "lost.bin": [1, 1, 0]})
    files = spark.createDataFrame([("a.bin", 1), ("a.bin", 2)], "file string, x int")
    assert list(map(tuple, tokens.scan(spark, str(tmp_path / "l"), files, end=0).collect())) == [("a.bin", 0, 0, 1, True)]


def test_counts_against_the_tokenizer(spark, docs, corpus, none):
    with open(tokens.VOCABULARY, "rb") as f:
        encode = tokens._encoding(f.read()).encode_ordinary
    want = sorted(((i, len(encode(t or ""))) for i, t in corpus), key=repr)
    assert sorted(map(tuple, tokens.counts(docs).collect()), key=repr) == want
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op7_token_counts"](spark, SF).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(encode(t)) for i, t in text.items()}
    assert tokens.counts(none).collect() == []

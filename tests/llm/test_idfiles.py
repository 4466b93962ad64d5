import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import encoding as E
from quarry.llm import idfiles, queries
from quarry.llm import kernel as K

SF = "/root/testdata/sf0.001"
with open(E.BYTE_VOCABULARY, "rb") as f:
    BYTES = f.read()
with open(E.PIECE_VOCABULARY, "rb") as f:
    PIECES = f.read()
ODD = st.lists(st.sampled_from(list("ab C1.,'s \n\té漢🙂\u0085▁|<　ñ\x00\xad ") + [" ", "<|endoftext|>", "<0x41>", "<s>", " the", "'re"]), max_size=40).map("".join)


def split(got):
    return [got.ids[a:z].tolist() for a, z in zip(got.first, got.first[1:])]


def whole(text):
    return E._byte_level(BYTES, False).whole.encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD | st.text(max_size=30), max_size=6))
def test_parts_give_the_ids_of_whole_texts(xs):
    t = K.texts(pa.array(xs, pa.string()))
    for plain in (False, True):
        tokenizer = E._byte_level(BYTES, plain).whole
        assert split(E.byte_ids(t, BYTES, plain)) == [tokenizer.encode(x, add_special_tokens=False).ids for x in xs]
    spaced = K.texts(pa.array([" " + x for x in xs], pa.string()))
    model = E._piece_tokenizer(PIECES)
    got = E.piece_ids(spaced, PIECES)
    assert split(got) == [model.encode(x) for x in xs]
    entries = E.piece_entries(PIECES)
    flat = [b"".join(entries.flat[entries.start[i]:entries.start[i] + entries.size[i]].tobytes() for i in ids) for ids in split(got)]
    assert E.same_bytes(spaced, got, entries).tolist() == [b == (" " + x).encode() for b, x in zip(flat, xs)]
    assert E.same_bytes(spaced, E.byte_ids(spaced, BYTES, True), E.byte_entries(BYTES)).all()


def test_slices_do_not_change_ids(monkeypatch):
    text = "été über «a b» x  y é è \n" * 50 + "long " * 20
    t = K.texts(pa.array([text, "", text[::-1]]))
    want = split(E.byte_ids(t, BYTES))
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(K, "SLICE", size)
        assert split(E.byte_ids(t, BYTES)) == want
        assert E.same_bytes(t, E.byte_ids(t, BYTES, True), E.byte_entries(BYTES)).all()


def check(rows, corpus):
    """Ids ascend (null first), starts are sums, ids are those of the whole texts."""
    rows = sorted(rows, key=lambda r: r["start"])
    docs = [r["doc_id"] for r in rows]
    assert docs == sorted((i for i, _ in corpus), key=lambda i: (i is not None, i))
    assert [r["start"] for r in rows] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in rows])])[:-1].tolist()
    want = sorted((repr(i), len(x), crc(x)) for i, x in ((i, whole(t)) for i, t in corpus))
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    return rows


def test_odd_rows(docs, corpus, none):
    rows = check(idfiles.digest(docs).collect(), corpus)
    same = [r["ids_crc32"] for r in rows if r["doc_id"] is None]
    assert len(same) == 3
    assert idfiles.digest(none).collect() == []


def test_query_on_the_table(spark):
    corpus = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(queries.QUERIES["op13_token_files"](spark, SF).collect(), corpus)


def test_a_key_shared_by_most_rows_is_split(spark):
    d = spark.range(4000).selectExpr("if(id % 4 > 0, 7, id) as doc_id", "'same text' as text")
    folder = idfiles.ensure_checkpoint_dir(spark).rstrip("/") + f"/ids/hot-{os.getpid()}"
    groups = idfiles.write(d, folder)
    assert max(r["rows"] for r in groups.collect()) < 1500
    assert idfiles.read(groups, folder, ["doc_id"]).count() == 4000


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_layout_and_selective_reads(spark, docs, corpus, tmp_path, encoding):
    folder = f"file://{tmp_path}/f"
    groups = idfiles.write(docs, folder, encoding=encoding, group_tokens=3000, page_bytes=512)
    found = groups.collect()
    longest = max(len(whole(t)) for _, t in corpus)
    assert all(g["tokens"] <= 3000 or g["rows"] == 1 for g in found) and max(g["tokens"] for g in found) == longest
    (tmp_path / "f" / "lost.parquet").write_bytes(b"a lost attempt")
    meta = pq.ParquetFile(f"{tmp_path}/f/{found[0]['file']}").metadata.row_group(0)
    columns = {meta.column(i).path_in_schema: meta.column(i) for i in range(4)}
    assert all(c.has_column_index and c.has_offset_index for n, c in columns.items() if n != idfiles.IDS)
    assert columns[idfiles.IDS].has_offset_index
    want = "RLE_DICTIONARY" if encoding == "dictionary" else "DELTA_BINARY_PACKED"
    assert want in columns[idfiles.IDS].encodings and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    everything = {(r["doc_id"], r["start"]): r["ids"] for r in idfiles.read(groups, folder).collect()}
    assert sorted(map(crc, everything.values())) == sorted(crc(whole(t)) for _, t in corpus)
    narrow = idfiles.read(groups, folder, ["doc_id", "n_tokens"])
    assert narrow.columns == ["doc_id", "n_tokens"] and narrow.count() == len(corpus)
    some = idfiles.select(groups, folder, 1000, 2000)
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,1000), LessThanOrEqual(doc_id,2000)]" in some._jdf.queryExecution().toString()
    assert sorted((r["doc_id"], r["ids"]) for r in some.collect()) == sorted((i, whole(t)) for i, t in corpus if i is not None and 1000 <= i <= 2000)
    assert idfiles.select(groups, folder, 10**6, 10**7).collect() == []


def test_unknown_encoding(docs):
    with pytest.raises(ValueError):
        idfiles.write(docs, "/nowhere", encoding="plain")

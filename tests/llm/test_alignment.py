import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import alignment as A
from quarry.llm import encoding as E
from quarry.llm import queries

SF = "/root/testdata/sf0.001"
with open(E.BYTE_VOCABULARY, "rb") as f:
    BYTES = f.read()
with open(E.PIECE_VOCABULARY, "rb") as f:
    PIECES = f.read()


class Files:
    value = (BYTES, PIECES)


def joined(ids, entries):
    return [entries.flat[entries.start[i]:entries.start[i] + entries.size[i]].tobytes() for i in ids]


def groups_of(text):
    """Groups as ([A ids], [B ids]) of a whole text, straight from the definition."""
    if not text:
        return []
    tokenizer = E._byte_level(BYTES, True).whole
    a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, E._piece_tokenizer(PIECES).encode(text)
    parts = joined(a, E.byte_entries(BYTES)), joined(b, E.piece_entries(PIECES))
    if any(b"".join(p) != (" " + text).encode() for p in parts):
        return []
    ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
    at = [{stop: k + 1 for k, stop in enumerate(e)} for e in ends]
    out, i, j = [], 0, 0
    for stop in sorted(set(ends[0]) & set(ends[1])):
        k, m = at[0][stop], at[1][stop]
        out.append((a[i:k], b[j:m]))
        i, j = k, m
    return out


def brute(corpus):
    found = [(i, groups_of(t)) for i, t in corpus]
    count, best = Counter(), defaultdict(int)
    for _, g in found:
        count.update({(x, y) for a, b in g for x in a for y in b})
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for i, g in found:
        pairs = [(x, y) for a, b in g for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(pairs), sum(count[p] == best[p[0]] for p in pairs),
                    sum(count[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.select("doc_id", *A._DIGEST).collect()), key=repr)


def random_fragment(rng):
    n, m = rng.randrange(0, 5), rng.randrange(1, 4)
    ids = np.arange(n, dtype=np.int32)
    cut = sorted(rng.randrange(0, n + 1) for _ in range(m - 1))
    sizes = np.diff([0, *cut, n])
    return A.Fragment(ids, ids, np.stack([sizes, sizes], 1))


def same(f, g):
    return f.a.tolist() == g.a.tolist() and f.b.tolist() == g.b.tolist() and f.sizes.tolist() == g.sizes.tolist()


def test_fragments_are_a_monoid():
    rng = random.Random(3)
    none = A.Fragment(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros((1, 2), np.int64))
    for _ in range(200):
        x, y, z = (random_fragment(rng) for _ in range(3))
        assert same(A.compose([A.compose([x, y]), z]), A.compose([x, A.compose([y, z])]))
        assert same(A.compose([x, y, z]), A.compose([A.compose([x, y]), z]))
        assert same(A.compose([none, x]), x) and same(A.compose([x, none]), x)


@pytest.mark.parametrize("chunk", [1, 3, 64, 1000])
def test_ranges_composed_are_the_whole_text(chunk, monkeypatch, sentences):
    monkeypatch.setattr(A, "BLOCK", 300)
    rng = random.Random(chunk)
    for text in (sentences(rng, 200), "漢字🙂" * 60 + " é", "x" * 700, "a  b\n\n" * 50, "<|endoftext|> <s> <0x41> " * 20, " " * 90):
        t = A._spaced(A.pa.chunked_array([[text]]))
        parts = [r for table in A._ranges(t, 7, Files, chunk) for r in table.to_pylist()]
        assert [r["part"] for r in parts] == list(range(len(parts))) and all(r["good"] for r in parts)
        f = A.compose([A._leaf(r) for r in parts])
        assert f.sizes[-1].tolist() == [0, 0]
        at = np.concatenate([[[0, 0]], np.cumsum(f.sizes, 0)])
        got = [(f.a[p[0]:q[0]].tolist(), f.b[p[1]:q[1]].tolist()) for p, q in zip(at, at[1:-1])]
        assert got == groups_of(text)


def test_wide_groups_and_slices_of_links(monkeypatch):
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 14, (40, 2))
    n = sizes.sum(0)
    x = A.Aligned(rng.integers(0, 9, n[0]).astype(np.int32), rng.integers(0, 7, n[1]).astype(np.int32), sizes,
                  np.zeros(4, np.int64), np.zeros(4, np.int64), np.array([0, 10, 10, 40]))
    want, at = Counter(), np.concatenate([[[0, 0]], np.cumsum(sizes, 0)])
    for g in range(40):
        for p in x.a[at[g, 0]:at[g + 1, 0]]:
            for q in x.b[at[g, 1]:at[g + 1, 1]]:
                want[(0 if g < 10 else 2, (int(p) << 32) + int(q))] += 1
    hashes = set()
    for links, wide in ((1 << 21, 64), (50, 64), (50, 0), (1, 10**6)):
        monkeypatch.setattr(A, "LINKS", links)
        monkeypatch.setattr(A, "WIDE", wide)
        doc, code, m = A.pairs(x)
        assert {(d, c): k for d, c, k in zip(doc.tolist(), code.tolist(), m.tolist())} == want
        assert list(zip(doc.tolist(), code.tolist())) == sorted(zip(doc.tolist(), code.tolist()))
        hashes.add(tuple(A.digests(x)))
    assert len(hashes) == 1


@pytest.mark.parametrize("chunk", [A.CHUNK, 200])
def test_odd_rows_against_brute_force(spark, docs, corpus, none, chunk):
    more = [(5000, "▁ sign"), (5001, "▁ sign " * 60), (5002, "<|endoftext|> a <s> <0x41>"), (5003, "漢字🙂\x00 é"), (None, "▁"), (5004, " "), (5005, "9" * 3000)]
    d = docs.select("doc_id", "text", "lang", "id").unionByName(spark.createDataFrame([(i, t, "x", "y") for i, t in more], "doc_id long, text string, lang string, id string"))
    assert rows(A.links(d, chunk=chunk)) == brute([*corpus, *more])
    assert A.links(none).collect() == []


def test_query_on_the_table(spark):
    corpus = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows(queries.QUERIES["op12_alignment"](spark, SF)) == brute(corpus)


def test_nothing_is_broadcast_and_text_is_not_shuffled(spark, docs):
    plan = A.links(docs)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in plan and "text#" not in plan.split("== Physical Plan ==")[1]

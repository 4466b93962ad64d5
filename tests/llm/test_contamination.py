import hashlib
import random
import re

import numpy as np
import pytest

from quarry.llm import contamination as C


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


@pytest.fixture(scope="module")
def items(corpus):
    rng = random.Random(8)
    rows = [(i, " ".join(words(t)[3:3 + rng.choice([20, 30])]).upper()) for i, (_, t) in enumerate(corpus) if t and 60 < len(t) < 5000 and rng.random() < 0.3]
    return rows + [(900, "one"), (901, None), (902, "..."), (903, "a b c d"), (None, "c d"), (3, rows[0][1]), (950, rows[1][1]), (950, rows[1][1])]


def brute(corpus, items):
    q = [(("" if i is None else str(i)), words(t)) for i, t in items]
    out = []
    for i, t in corpus:
        w, hit, found = words(t), set(), set()
        spots = {}
        for k in {min(13, len(x)) for _, x in q if x}:
            for p in range(len(w) - k + 1):
                spots.setdefault(tuple(w[p:p + k]), []).append(p)
        for name, x in q:
            k = min(13, len(x))
            for p in range(len(x) - k + 1 if x else 0):
                for at in spots.get(tuple(x[p:p + k]), []):
                    hit |= set(range(at, at + k))
                    found.add(name)
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def frame(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_corpus_against_brute_force(spark, docs, corpus, items):
    got = sorted(map(tuple, C.verdicts(docs, frame(spark, items)).drop("key").collect()), key=repr)
    assert got == brute(corpus, items)


def test_benchmark_in_blocks_gives_the_same(spark, docs, corpus, items, monkeypatch):
    monkeypatch.setattr(C, "ITEM_CHARS", 400)
    q = frame(spark, items)
    assert len(list(C._item_blocks(q, "item_id", "text", 13))) > 2
    assert sorted(map(tuple, C.verdicts(docs, q).drop("key").collect()), key=repr) == brute(corpus, items)
    many = sorted((r["doc_id"], r["text"]) for r in C.decontaminate(docs, q).collect() if r["doc_id"] is not None)
    monkeypatch.undo()
    one = C.decontaminate(docs, q)
    assert one.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in one.collect() if r["doc_id"] is not None) == many
    clean = [x for x in brute(corpus, items) if not x[-1]]
    assert one.count() == len(clean)


def test_longest_matches(spark):
    text = "x y " + " ".join(f"w{i}" for i in range(40)) + " z"
    item = "p " + " ".join(f"w{i}" for i in range(5, 35)) + " q " + " ".join(f"w{i}" for i in range(13))
    d = spark.createDataFrame([(1, text), (2, "w1 w2")], "doc_id long, text string")
    got = sorted(map(tuple, C.longest_matches(d, frame(spark, [(7, item)])).collect()))
    assert got == [(1, "7", 2, 32, 13), (1, "7", 7, 1, 30)]


def test_suffix_array_orders_suffixes_and_search_finds_ranges():
    rng = np.random.default_rng(2)
    h = np.concatenate([rng.integers(1, 4, 300), np.zeros(6, int)]).astype(np.uint64)
    at = np.arange(300)
    order = C.suffix_array(h, at, 6)
    seq = [tuple(h[p:p + 6].tolist()) for p in order]
    assert seq == sorted(seq) and sorted(order.tolist()) == at.tolist()
    want = np.array([h[10:16], h[50:56], [9] * 6, [1, 2, 0, 0, 0, 0]], np.uint64)
    size = np.array([6, 4, 6, 2])
    lo, hi = C.search(h, order, want, size)
    for a, b, w, n in zip(lo, hi, want, size):
        assert sorted(order[a:b].tolist()) == [p for p in range(300) if tuple(h[p:p + n]) == tuple(w[:n])]


def test_empty_sides(spark, docs, none):
    q = frame(spark, [(1, "a b c")])
    assert C.verdicts(none, q).collect() == []
    out = C.verdicts(docs, frame(spark, [])).collect()
    assert len(out) == docs.count() and not any(r["contaminated"] or r["n_hit"] for r in out)
    assert C.longest_matches(docs, frame(spark, [])).collect() == []

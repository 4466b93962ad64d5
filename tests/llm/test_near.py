import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.llm import kernel as K
from quarry.llm import near


def shingles(text, split, k=5):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in split(text)]
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(corpus, split):
    sets = [(i, shingles(t, split)) for i, t in corpus]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, z in sets[a + 1:]:
            if i is not None and j is not None and s and z and 100 * len(s & z) >= 75 * len(s | z):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets), key=repr)


def test_corpus_against_brute_force(docs, corpus, split):
    got = sorted(map(tuple, near.near_duplicates(docs).collect()), key=repr)
    assert got == brute(corpus, split)


def family(rng, sentences):
    """Texts around one template at all similarities, chains, and a group that shares a passage."""
    rows, template = [], sentences(rng, 80).split(" ")
    for i in range(150):
        w = list(template)
        for _ in range(rng.randrange(0, 14)):
            w[rng.randrange(len(w))] = f"u{rng.randrange(40)}"
        rows.append((i, " ".join(w[:rng.randrange(50, 81)])))
    step = list(template)
    for i in range(40):                                   # a chain: neighbours are linked, ends aren't
        step[2 * i % len(step)] = f"c{i}"
        rows.append((500 + i, " ".join(step)))
    passage = sentences(rng, 30)
    rows += [(700 + i, f"{passage} {sentences(rng, 50)}") for i in range(40)]
    return rows


def test_families_chains_and_shared_passages(spark, sentences, split):
    rows = family(random.Random(3), sentences)
    got = sorted(map(tuple, near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute(rows, split)


def test_chunks_of_a_family(spark, sentences, split, monkeypatch):
    monkeypatch.setattr(near, "CHUNK", 3000)               # many chunks, large components among them
    rows = family(random.Random(4), sentences)
    got = sorted(map(tuple, near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute(rows, split)


def test_chunk_links_against_sets(sentences, split):
    rng = random.Random(9)
    rows = family(rng, sentences)
    table = pa.table({"pair": [1] * len(rows), "root": [r[0] for r in rows], "text": [r[1] for r in rows]})
    got = set(zip(*near._within(table).to_pydict().values()))
    sets = [(i, shingles(t, split)) for i, t in rows]
    want = {(i, j) for a, (i, s) in enumerate(sets) for j, z in sets[a + 1:] if 100 * len(s & z) >= 75 * len(s | z)}
    assert got == want


def test_signature_values_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(1)
    common, own = rng.integers(0, 10**9, 300), rng.integers(0, 10**9, 200)
    a, b = (" ".join(f"w{x}" for x in np.concatenate([common, part])) for part in (own[:100], own[100:]))
    doc, h = near.shingles(K.texts(pa.array([a, b])), 1)
    value, full = np.zeros((2, near.BINS), np.uint64), np.zeros((2, near.BINS), bool)
    for d, x in sorted(zip(doc.tolist(), (h >> np.uint64(12)).tolist()), key=lambda y: -y[1]):
        value[d, x % near.BINS], full[d, x % near.BINS] = x, True
    assert not full.all()
    near.densify(value, full)
    assert (value > 0).all()
    assert abs((value[0] == value[1]).mean() - 300 / 500) < 0.08


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (9, 4), (20, 21), (7, 7), (22, 21)], "a long, b long")
    got = {r["node"]: r["root"] for r in near.components(e).collect()}
    assert {k: got.get(k, k) for k in (1, 2, 3, 4, 9, 20, 21, 22)} == {1: 1, 2: 1, 3: 1, 4: 1, 9: 1, 20: 20, 21: 20, 22: 20}


def test_deduplicate_keeps_one_of_each_group_and_all_columns(docs, corpus, split):
    kept = near.deduplicate(docs)
    assert kept.columns == docs.columns
    want = {i for i, _, _, k in brute(corpus, split) if k and i is not None}
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want)
    assert ids.count(None) == sum(i is None for i, _ in corpus)


def test_no_rows_and_nothing_linked(spark, none):
    assert near.near_duplicates(none).collect() == []
    one = spark.createDataFrame([(5, "a b c d e f g h"), (6, None)], "doc_id long, text string")
    assert sorted(map(tuple, near.near_duplicates(one).collect())) == [(5, 4, 5, True), (6, 0, 6, True)]
    assert near.deduplicate(none).filter(F.lit(True)).collect() == []


def test_centres_in_two_stages(spark, monkeypatch):
    m = spark.range(5000).selectExpr("if(id % 10 > 0, 1, id) as key", "id", "pmod(xxhash64(id), 40) as near")
    want = sorted(map(tuple, near._centres(m, 50).collect()))
    monkeypatch.setattr(near, "LIMIT", 10)
    got = near._centres(m, 50)
    assert sorted(map(tuple, got.select("key", "id", "near", "r").collect())) == want
    assert got._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2


def test_buckets_follow_the_classes(spark, docs, corpus, split, monkeypatch):
    counts = []
    dealt = near._dealt
    monkeypatch.setattr(near, "_dealt", lambda n: counts.append(n) or dealt(n))
    monkeypatch.setattr(near, "ENTRIES", 100)
    got = sorted(map(tuple, near.near_duplicates(docs).collect()), key=repr)
    assert got == brute(corpus, split) and counts[0] > 2 * near.X.shuffle_partitions(spark)


def test_rows_of_one_id_and_ids_beside_them(spark):
    rows = [(1, "a b c d e f g", "first"), (1, "h i j k l m n", "second"), (1, "h i j k l m n", "second"), (2, "o p q r s t u", "x"), (3, "o p q r s t u", "y"),
            (None, "o p q r s t u", "z"), (None, None, "z")] + [(100 + i, f"w{i} x{i} y{i} z{i} u{i} v{i}", "p") for i in range(300)]
    outs = set()
    for parts in (1, 5):
        d = spark.createDataFrame(rows, "doc_id long, text string, _place_bits string").repartition(parts)
        kept = near.deduplicate(d).collect()
        ids = [r["doc_id"] for r in kept]
        assert sorted(i for i in ids if i is not None) == [1, 2, *range(100, 400)] and ids.count(None) == 2
        outs |= {(r["text"], r["_place_bits"]) for r in kept if r["doc_id"] == 1}
    assert len(outs) == 1

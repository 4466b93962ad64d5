import hashlib

from pyspark.sql import functions as F

from quarry.llm import exchange, repeats


def brute(corpus, split, n):
    """(id, words, removed, digest) of every row."""
    last = 2**63 - 1
    seen = {}
    for i, t in corpus:
        w = split(t)
        for k in range(len(w) - n + 1):
            g = tuple(w[k:k + n])
            seen[g] = min(seen.get(g, last), last if i is None else i)
    out = []
    for i, t in corpus:
        w = split(t)
        gone = set()
        for k in range(len(w) - n + 1):
            if seen[tuple(w[k:k + n])] < (last if i is None else i):
                gone |= set(range(k, k + n))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_whole_corpus_against_brute_force(docs, corpus, split):
    for n in (5, 13):
        got = sorted(map(tuple, repeats.digest(docs, window=n).collect()), key=repr)
        assert got == brute(corpus, split, n)


def test_partitions_and_block_sizes_do_not_matter(docs, corpus, split, monkeypatch):
    from quarry.llm import kernel
    monkeypatch.setattr(kernel.blocks, "__defaults__", (3, 200))
    got = sorted(map(tuple, repeats.digest(docs.repartition(3)).collect()), key=repr)
    assert got == brute(corpus, split, 13)


def test_intervals_are_maximal_and_text_is_cut(docs):
    rows = repeats.remove_repeats(docs).filter(F.size("removed") > 0).collect()
    assert rows
    for r in rows:
        assert all(a["end"] < b["start"] for a, b in zip(r["removed"], r["removed"][1:]))
        assert r["n_words"] - sum(s["end"] - s["start"] for s in r["removed"]) == len(r["kept_text"].split())


def test_no_rows(none):
    out = repeats.digest(none)
    assert out.collect() == [] and out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]


def test_planes_round_trip():
    import numpy as np
    x = np.array([0, 5, 70000, 2**40], np.int64)
    assert list(exchange.unplanes(exchange.planes(x), np.int64)) == list(x)
    assert exchange.unplanes(exchange.planes(x[:0]), np.int64).size == 0


def test_thousands_of_rows_share_an_id(spark, split, sentences):
    import random
    from quarry.session import ship_package
    ship_package(spark)
    rng = random.Random(8)
    passage = sentences(rng, 13)
    corpus = [(1, passage)]
    corpus += [(None, f"{sentences(rng, rng.randrange(0, 40))} {passage}" + f" {sentences(rng, 3)}" * (n % 3)) for n in range(5000)]
    corpus += [(7, f"{sentences(rng, rng.randrange(0, 40))} {passage if n % 2 else ''}") for n in range(5000)]
    corpus += [(100 + n, sentences(rng, 20)) for n in range(500)] + [(7, corpus[-1][1])] * 3
    d = spark.createDataFrame(corpus, "doc_id long, text string").repartition(6)
    assert sorted(map(tuple, repeats.digest(d).collect()), key=repr) == brute(corpus, split, 13)
    groups = repeats.repeated_windows(d).groupBy("id", "key").count()
    assert groups.filter("count > 1").count() == 0


def test_only_shared_ids_need_the_text_hash(spark):
    d = spark.createDataFrame([(i, "x") for i in range(300)] + [(5, "y"), (None, "z"), (None, "z")], "doc_id long, text string")
    keys = {(r["doc_id"], r["text"]): r["_key"] for r in repeats._keyed(d, "doc_id", "text").collect()}
    assert keys[5, "x"] and keys[5, "y"] and keys[5, "x"] != keys[5, "y"] and keys[None, "z"]
    assert sum(k != 0 for k in keys.values()) < 10

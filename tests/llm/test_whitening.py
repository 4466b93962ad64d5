import math
from fractions import Fraction

import numpy as np
import pytest

from quarry.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def whole(v):
    return [math.floor(64 * float(c)) + 1_000_000 for c in v]


def usable(vectors):
    return [(i, whole(v)) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def check(found, vectors, components=32):
    """Rows against exact sums and the definition of whitening."""
    left = usable(vectors)
    x = np.array([v for _, v in left], object)
    n, d = x.shape
    s = x.sum(0)
    y = n * x - s
    cov = np.array([[float(Fraction(int(a @ b), n**3)) for b in y.T] for a in y.T])
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = min(components, d)
    by = {}
    for r in found:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(found) == len(left) * k and {r["n"] for r in found} == {n}
    assert max(r["identity_error"] for r in found) <= 1e-4
    w = np.array([[by[i][c]["whitened"] for c in range(1, k + 1)] for i, _ in left])
    want = (y / n).astype(float) @ v[:, :k] / np.sqrt(e[:k])
    sign = np.sign((w * want).sum(0))
    assert np.abs(w - want * sign).max() < 1e-6
    assert np.abs(np.cov(w.T, bias=True) - np.eye(k)).max() < 1e-6
    for (i, _), row in zip(left, y):
        assert {r["deviation"] for r in by[i].values()} == {int((row * row).sum())}
    assert np.allclose([by[left[0][0]][c]["explained"] for c in range(1, k + 1)], e[:k] / np.trace(cov), rtol=1e-9)


def vectors_of(rng, n, d, scale=1.0):
    return (rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * scale + rng.normal(size=d)).tolist()


def frame(spark, vectors, kind="double"):
    rows = [(i, v, "x", 1.0) for i, v in vectors]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, component string, whitened double").repartition(4)


def test_against_exact_sums(spark):
    rng = np.random.default_rng(1)
    vectors = list(enumerate(vectors_of(rng, 300, 12)))
    vectors += [(1000, None), (1001, [None] + [1.0] * 11), (1002, [float("nan")] * 12), (1003, [float("inf")] + [0.0] * 11), (1004, [-float("inf")] * 12)]
    check(whitening.digest(frame(spark, vectors)).collect(), vectors)


def test_query_on_the_table(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(queries.QUERIES["op11_whitening"](spark, SF).collect(), vectors)


@pytest.mark.parametrize("scale", [1e-1, 1e4, 1e8, 1e12])
def test_polarisation_is_exact_at_any_size_of_entries(spark, scale):
    rng = np.random.default_rng(2)
    vectors = list(enumerate(vectors_of(rng, 50, 3, scale)))
    d = frame(spark, vectors)
    model = whitening.fit(d)
    x = np.array([whole(v) for _, v in vectors], object)
    y = len(x) * x - x.sum(0)
    want = np.array([[float(Fraction(int(a @ b), len(x)**3)) for b in y.T] for a in y.T])
    got = model.vectors @ np.diag(model.variance) @ model.vectors.T
    assert np.abs(got - want).max() <= 1e-12 * np.abs(want).max()
    assert model.sums == x.sum(0).tolist() and model.identity_error < 1e-6
    deviation = {r["vec_id"]: r["deviation"] for r in whitening.transform(d, model).collect()}
    exact = [int((row * row).sum()) for row in y]
    assert deviation == {i: v if v <= whitening.LONG else None for i, v in enumerate(exact)}


def test_partitions_and_repeated_rows(spark):
    rng = np.random.default_rng(3)
    vectors = list(enumerate(vectors_of(rng, 40, 5)))
    vectors += [(3, vectors[3][1]), (None, vectors[0][1]), (None, vectors[1][1])]
    d = frame(spark, vectors)
    one, many = (sorted((repr(r["vec_id"]), r["component"], r["deviation"], round(r["whitened"], 9)) for r in whitening.digest(d.repartition(p)).collect())
                 for p in (1, 7))
    assert one == many and len(one) == 43 * 5


def test_lengths_rank_and_empty(spark):
    rng = np.random.default_rng(4)
    vectors = list(enumerate(vectors_of(rng, 20, 4))) + [(90, [1.0, 2.0]), (91, []), (92, [1.0] * 9)]
    found = whitening.digest(frame(spark, vectors)).collect()
    assert {r["vec_id"] for r in found} == set(range(20)) and {r["component"] for r in found} == {1, 2, 3, 4}
    flat = [(i, [float(v[0]), float(v[1]), 5.0]) for i, v in enumerate(rng.normal(size=(30, 2)) * 9)]      # one dimension doesn't vary
    found = whitening.digest(frame(spark, flat)).collect()
    assert {r["component"] for r in found} == {1, 2} and found[0]["identity_error"] < 1e-9
    for rows in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)], [(1, []), (2, None)]):
        assert whitening.digest(frame(spark, rows)).collect() == []


def test_other_number_types_and_fewer_components(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, [int(c) for c in v]) for i, v in enumerate(rng.integers(-9, 9, (30, 4)))]
    check(whitening.digest(frame(spark, vectors, "int")).collect(), vectors)
    check(whitening.digest(frame(spark, [(i, [float(c) for c in v]) for i, v in vectors], "float"), components=2).collect(), vectors, 2)

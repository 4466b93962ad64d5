import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import kernel as K
from quarry.llm import language as L
from quarry.llm import queries

SF = "/root/testdata/sf0.01"


def grams(text):
    """Brute force: (three symbols before, symbol) of every event, boundaries as 0."""
    out = []
    for word in text.lower().split():
        run = [ord(c) if c.isalpha() else 0 for c in word] + [0]
        past = [0, 0, 0]
        for c in run:
            if c or past[-1]:
                out.append((*past, c))
            past = [*past[1:], c] if c else [0, 0, 0]
    return Counter(out)


def code(g):
    return sum(x << 16 * i for i, x in enumerate(reversed(g)))


def brute_prob(counts, gram):
    """Interpolated Kneser-Ney from the definition."""
    def at(order, table):
        values = list(table.values())
        one, two = values.count(1), values.count(2)
        d = min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5
        d = min(d, 0.95 * min(values))
        lower = Counter()
        for g in table:
            lower[g[1:]] += 1
        g = gram[4 - order:]
        below = 1 / L.ALPHABET if order == 1 else at(order - 1, lower)
        inside = {k: v for k, v in table.items() if k[:-1] == g[:-1]}
        if not inside:
            return below
        total = sum(inside.values())
        return max(0, inside.get(g, 0) - d if g in inside else 0) / total + d * len(inside) / total * below
    return at(4, counts)


TEXTS = ["the cat, the Cat's hat2 x", "a hat for the Été", "cat"]


def test_counted_grams_against_brute_force(spark):
    d = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)] + [(9, None, "en"), (8, "der hut", "de")], "doc_id long, text string, lang string")
    got = defaultdict(dict)
    for r in L.count_grams(d).collect():
        got[r["lang"]][r["code"] % 2**64] = r["n"]
    assert got["en"] == {code(g): n for g, n in sum((grams(t) for t in TEXTS), Counter()).items()}
    assert got["de"] == {code(g): n for g, n in grams("der hut").items()}


def test_rare_grams_of_a_large_language_are_kept(spark):
    from quarry.session import ship_package
    ship_package(spark)
    hot = spark.range(20).select(F.col("id").alias("doc_id"), F.expr("repeat('the ', 50000)").alias("text"), F.lit("en").alias("lang"))
    rare = spark.createDataFrame([(100, "quiz", "en")], "doc_id long, text string, lang string")
    got = {r["code"] % 2**64: r["n"] for r in L.count_grams(hot.union(rare)).collect()}
    assert got == {code(g): n for g, n in (grams("quiz") + Counter({g: 1_000_000 for g in grams("the")})).items()}


def test_probabilities_against_the_definition_and_they_sum_to_one():
    counts = sum((grams(t) for t in TEXTS), Counter())
    keys = np.array([code(g) for g in counts], np.uint64)
    m = L.KneserNey(keys, np.array(list(counts.values())))
    tried = [*counts, (0, 0, 0, ord("q")), (ord("t"), ord("h"), ord("e"), ord("s")), (1, 2, 3, ord("a"))]
    got = m.prob(np.array([code(g) for g in tried], np.uint64))
    assert got == pytest.approx([brute_prob(counts, g) for g in tried])
    context = np.uint64(code((0, ord("t"), ord("h"), 0)))
    assert m.prob(context + np.arange(L.ALPHABET, dtype=np.uint64)).sum() == pytest.approx(1)


def test_shared_arrays_give_each_language_its_own_model():
    own = {x: grams(t) for x, t in (("a", "the cat the hat that"), ("b", "der hut das tut thor"))}
    counts = {x: (np.array([code(g) for g in c], np.uint64), np.array(list(c.values()))) for x, c in own.items()}
    m = L.Model(counts)
    tried = np.array([code(g) for g in [*own["a"], *own["b"], (0, 0, 0, ord("z")), (7, 8, 9, 10)]], np.uint64)
    want = np.stack([L.KneserNey(*counts[x]).prob(tried) for x in m.langs], 1)
    assert np.exp(m.logs(tried)) == pytest.approx(want, rel=1e-4)
    h, n = m.entropies(K.texts(pa.array(["the hat", None, "12 !", "hut"])))
    total = [sum(k * np.log(brute_prob(own["a"], g)) for g, k in grams("the hat").items()), 8]
    assert h[0, 0] == pytest.approx(-total[0] / total[1], rel=1e-4) and list(n) == [8, 0, 0, 4]


@pytest.fixture(scope="module")
def predicted(spark):
    from quarry.session import ship_package
    ship_package(spark)
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    return queries.QUERIES["op1_language_id"](spark, SF).collect(), truth


def test_held_out_accuracy(predicted):
    rows, truth = predicted
    assert len(rows) == len(truth)
    out = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in out]) > 0.98
    assert np.mean([r["rejected"] for r in rows]) < 0.005 and all(0 <= r["score"] <= 1 for r in rows)


def test_foreign_script_is_rejected_and_odd_rows_are_defined(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = L.train(base)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !? 😀"), (4, "Это совсем другой язык, которого здесь нет " * 5),
                                 (5, "the " * 50_000), (5, "the " * 50_000), (None, "the of and")], "doc_id long, text string")
    got = L.predict(odd, model, keep=("doc_id",)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 7 and all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and by[i]["rejected"] for i in (1, 2, 3))
    assert by[4]["rejected"] and not by[5]["rejected"] and by[5]["lang_pred"] == by[None]["lang_pred"] == "en"
    assert sorted(r["doc_id"] for r in L.accept(odd, model).filter("doc_id is not null").collect()) == [5, 5]


FINNISH = "Metsän reunassa seisoi vanha talo, jonka pihalla kasvoi omenapuita ja jossa kukaan ei ollut asunut vuosikausiin. "

HUNGARIAN = "A régi ház udvarán már évek óta senki sem járt, csak a szél zörgette esténként az elkorhadt ablakokat. "


def calibration_ids(first):
    """Ids of the calibration fold, from `first` on."""
    return (i for i in range(first, first + 10_000) if zlib.crc32(str(i).encode()) % L.CALIBRATION == 1)


def test_mislabelled_calibration_rows_dont_loosen_rejection(spark):
    from quarry.session import ship_package
    ship_package(spark)
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").filter("lang in ('en', 'es')")
    ids = calibration_ids(10**9)
    spanish = [(next(ids), r["text"], "en") for r in base.filter("lang = 'es'").limit(2).collect()]
    junk = [(next(ids), FINNISH * 8, x) for x in ("en", "es")]
    plain = L.train(base).value
    model = L.train(base.union(spark.createDataFrame(spanish + junk, base.schema)))
    assert model.value.bound == pytest.approx(plain.bound, rel=0.2)
    odd = spark.createDataFrame([(1, HUNGARIAN * 6)], "doc_id long, text string")
    assert [r["rejected"] for r in L.predict(odd, model).collect()] == [True]
    assert L.predict(base, model).filter("rejected").count() < 0.005 * base.count()


def test_bound_does_not_grow_with_the_rows(spark):
    rows = spark.range(20_000).select(F.lit("en").alias("lang"), (F.col("id") % 1000 / 100).alias("off"))
    junk = spark.range(5).select(F.lit("en").alias("lang"), F.lit(90.0).alias("off"))
    want = pytest.approx(L.MARGIN * 10, rel=0.02)
    assert L.bounds(rows)["en"] == want and L.bounds(rows.union(junk))["en"] == want
    assert L.bounds(junk.limit(1).union(rows.limit(1)))["en"] == L.LEAST_BOUND


def test_a_language_of_calibration_rows_only_is_learned(spark):
    from quarry.session import ship_package
    ship_package(spark)
    ids = calibration_ids(10**9)
    base = spark.createDataFrame([(i, "the cat and the hat", "en") for i in range(50)], "doc_id long, text string, lang string")
    finnish = spark.createDataFrame([(next(ids), FINNISH, "fi") for _ in range(3)], base.schema)
    for d in (base.union(finnish), finnish):
        got = L.predict(finnish, L.train(d)).collect()
        assert {(r["lang_pred"], r["rejected"]) for r in got} == {("fi", False)}


def test_nothing_to_learn_from(docs, none):
    out = L.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in out} == {("und", 0.0, False)}
    assert L.identify(none).collect() == []
    assert {r["lang_pred"] for r in L.identify(docs).collect()} <= {"en", "und"}


def test_letters_beyond_16_bits(spark):
    """Letters whose code point is a multiple of 65,536 are letters, and astral letters stand for none of the others."""
    from quarry.session import ship_package
    ship_package(spark)
    gothic = "".join(chr(c) for c in range(0x10330, 0x10348))
    learn = [(i, gothic[i % 20:] + " " + gothic[:9], "got") for i in range(1, 60)] + [(i, "the cat and the hat " * 3, "en") for i in range(100, 160)]
    asked = [(1000, "\U00010000"), (1001, "\U00020000 \U00020000"), (1002, gothic[3:15]), (1003, "̰̱ 1"), (1004, "the cat")]
    d = spark.createDataFrame(learn + [(i, t, None) for i, t in asked], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in L.predict(d, L.train(d), keep=("doc_id",)).collect()}
    assert got[1000] != "und" and got[1001] != "und" and got[1002] == "got" and got[1003] == "und" and got[1004] == "en"
    t = K.texts(pa.array(["\U00010000", "\U00020000", "a"]))
    w = K.words(t, ends=True)
    code, of = L.grams(t.buf, w, np.arange(len(w.h)))
    last = {int(o): int(c) & 0xFFFF for c, o in zip(code, of) if int(c) & 0xFFFF}
    assert len(set(last.values())) == 3 and all(0xD800 <= last[i] < 0xF900 for i in (0, 1)) and last[2] == ord("a")

import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import pii
from quarry.llm.boosting import Trees

SF = "/root/testdata/sf0.01"


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base(t):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def joined(t):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in base(t))


def test_base_patterns_against_the_plain_ones():
    rng = random.Random(1)
    pieces = ["a.b@c.d", "@", "x@y", "a@b.c@d.e", "@@a@b.c", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "001.002.3.04", "4111 1111 1111 1111", "4111-1111-1111-1112",
              "79927398713000", "+1 (640) 555-0953", "+49 30 1234567", "+1+2", "++1 2", "é", " ", "\n", "-", ".", "9", "0000 0000 0000", "%+a", "a--b@c-d.e-", "1  2", "12345678901234567890"]
    for _ in range(3000):
        t = "".join(rng.choice(pieces) + rng.choice(["", "", " ", "."]) for _ in range(rng.randrange(1, 9)))
        got = pii.base_spans(t)
        assert [(a, b, k) for a, _, b, k in base(t)] == got, t


def test_patterns_take_linear_time_on_long_runs():
    for t in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "1 " * 100_000, "(1" * 50_000, "[at]" * 20_000, "a[at]" * 20_000):
        found = pii.base_spans(t)
        pii.candidates(t, found, True)


def test_query_against_brute_force_and_added_spans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = pii.digest(docs).collect()
    added = Counter()
    for r in rows:
        want = joined(text[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert not Counter(x for x in want.split(",") if x) - Counter(spans)
        kinds = Counter(x.split(":")[0] for x in want.split(",") if x)
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(kinds[k] for k in pii.BASE)
        added.update(x.split(":")[0] for x in spans if x not in want.split(","))
        if not re.search(r"[0-9@]", text[r["doc_id"]]):
            assert not spans                                  # clean texts stay clean
    assert len(rows) == len(text) and added["secret"] > 10


def test_redaction_and_odd_rows(spark, docs, none):
    judge = pii.train(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = [(1, "mail a.b@c.org or 10.0.0.1, now"), (2, None), (3, ""), (4, "+1 (640) 555-0953"), (4, "+1 (640) 555-0953"), (None, "plain"),
            (5, "x " * 100_000 + "a@b.cd"), (6, 'token = "58ed55e8cc700f5a0109593b09891d0a1a8ca26f" é a@b.cd')]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit(1)).withColumn("spans", F.lit("s"))
    out = pii.redact(d, judge)
    assert out.columns == d.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[1] == "mail <EMAIL> or <IP>, now" and got[2] is None and got[3] == "" and got[4] == "<PHONE>" and got[None] == "plain"
    assert got[5].endswith(" <EMAIL>") and len(got[5]) == 200_000 + 7
    assert got[6] == 'token = "<SECRET>" é <EMAIL>'
    assert out.count() == len(rows)
    assert pii.digest(none).collect() == [] and pii.digest(docs).count() == docs.count()


def test_a_hot_source_does_not_hide_a_rare_kind(spark):
    from quarry.session import ship_package
    ship_package(spark)
    rng = random.Random(7)
    keys = [f'token = "{rng.getrandbits(160):040x}"' for _ in range(10)]
    rare = spark.createDataFrame([(10_000 + i, k) for i, k in enumerate(keys)], "doc_id long, text string")
    hot = spark.range(200).select(F.col("id").alias("doc_id"), F.expr(
        "array_join(transform(sequence(0, 1499), i -> cast(100000000 + 1500 * id + i as string)), ' x ')").alias("text"))
    got = {r["doc_id"]: r["spans"] for r in pii.digest(hot.repartition(8).union(rare)).collect()}
    assert all("secret:9:49" in got[10_000 + i] for i in range(10))
    assert not any(got[i] for i in range(200))


def test_long_keys_and_national_numbers_of_other_shapes():
    for key in ("a1" * 400, "k" * 80 + "7" + "x" * 20, "abcdefgh12345678=="):
        assert (8, 8 + len(key), "secret") in pii.candidates(f"token = {key} .", [], True)
    assert not pii.candidates("token = " + "k" * 80, [], True)
    for text, number in (("tel. 030 12 34 56 78", "030 12 34 56 78"), ("call (0221) 555 1234", "(0221) 555 1234"), ("a 212-555-0123", "212-555-0123")):
        a = text.index(number)
        span = (a, a + len(number), "phone")
        assert span in pii.candidates(text, [], True) and pii.weak_label(text, span, set())
    assert not pii.weak_label("sizes 030 12 34 56 78", (6, 21, "phone"), set())


def test_trees_learn_an_interaction_and_handle_one_class():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = Trees(rounds=60).fit(x[:1000], y[:1000])
    assert ((trees.predict(x[1000:]) > 0.5) == y[1000:]).mean() > 0.95
    assert (Trees().fit(x, np.ones(2000)).predict(x) > 0.99).all()
    assert len(Trees().fit(x[:0], y[:0]).predict(x[:3])) == 3


def planted(rng, n):
    """(text, kind, start, end, cue): one planted item each, whose truth comes from the planting; kind None for decoys."""
    def digits(k):
        return "".join(rng.choice("0123456789") for _ in range(k))

    def name():
        return "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randrange(4, 9)))
    words = ["the", "result", "was", "seen", "again", "in", "many", "towns", "before", "noon", "nichts", "toda", "sous"]
    out = []
    for i in range(n):
        kind, cue, lead, item = [
            lambda: ("email", "masked", "", f"{name()}.{name()} [at] {name()} [dot] {rng.choice(['com', 'org', 'de'])}"),
            lambda: ("email", "masked", "write to ", f"{name()}(at){name()}.{rng.choice(['com', 'org', 'de'])}"),
            lambda: ("phone", "cue", rng.choice(["tel. ", "phone: ", "call ", "mobile "]), rng.choice([f"0{digits(2)} {digits(3)} {digits(4)}", f"({digits(4)}) {digits(3)}-{digits(3)}", f"{digits(3)}.{digits(3)}.{digits(4)}"])),
            lambda: ("phone", "no cue", "", f"{digits(3)}-{digits(3)}-{digits(4)}"),
            lambda: ("secret", "assigned", rng.choice(["token = ", "api_key: ", 'password="', "SECRET="]), "".join(rng.choice("abcdef0123456789ABCXYZ") for _ in range(rng.randrange(20, 60))) + "7"),
            lambda: ("account", "cue", rng.choice(["account ", "iban ", "passport ", "ssn "]), digits(rng.randrange(9, 20))),
            lambda: (None, "decoy", rng.choice(["order ", "article ", "built ", "about "]), digits(rng.randrange(7, 12))),
            lambda: (None, "decoy groups", "sizes ", f"{digits(2)} {digits(2)} {digits(3)} {digits(2)}"),
            lambda: (None, "decoy hash", "commit ", "%040x" % rng.getrandbits(160)),
        ][i % 9]()
        before = " ".join(rng.choice(words) for _ in range(rng.randrange(5, 40))) + " " + lead
        out.append((f"{before}{item} " + " ".join(rng.choice(words) for _ in range(10)), kind, len(before), len(before) + len(item), cue))
    return out


def test_planted_spans_by_kind(spark):
    """Recall and false alarms on spans whose truth the planting decides, not a feature. README has the rates: formats
    that the corpus doesn't hold are found rarely, and any long hexadecimal word is taken for a key."""
    from quarry.session import ship_package
    ship_package(spark)
    rows = planted(random.Random(12), 900)
    judge = pii.train(spark.read.parquet(f"{SF}/documents.parquet"))
    d = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "doc_id long, text string")
    found = {r["doc_id"]: r["every"] for r in pii.find(d, judge).collect()}
    hit, n = {}, {}
    for i, (_, kind, a, b, cue) in enumerate(rows):
        key = (kind, cue)
        n[key] = n.get(key, 0) + 1
        covered = any(s["start"] <= a and b <= s["end"] or (s["start"] < b and s["end"] > a and kind is None) for s in found[i])
        hit[key] = hit.get(key, 0) + covered
    rate = {k: hit[k] / n[k] for k in n}
    print("RATES", rate)
    assert rate["secret", "assigned"] > 0.9 and rate["email", "masked"] > 0.9
    assert rate[None, "decoy"] < 0.05 and rate[None, "decoy groups"] < 0.05

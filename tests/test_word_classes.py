"""The word class that tests ASCII first holds all that is no white space; words and segments by it."""
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions.lexicons import WORD_CLASS, WS_CLASS
from quarry.operators import documents as do
from quarry.operators import retrieval as rt


def test_classes_hold_the_same_characters(spark):
    c = spark.range(0x110000).filter("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    assert c.filter(F.col("c").rlike(f"^{WORD_CLASS}$") != F.col("c").rlike(f"^[^{WS_CLASS}]$")).count() == 0


def test_words_and_short_paragraphs(spark):
    texts = ["a b", "  lead　x\n", "", None, "one", "été \U0001f600 y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.w, r.n) for r in df.select("doc_id", tx.words("text").alias("w"), tx.word_count("text").alias("n")).collect()}
    assert got == {i: (None, None) if t is None else (t.split(), len(t.split())) for i, t in enumerate(texts)}
    paras = spark.createDataFrame([(0, "a b c\n\na b\na  b  c"), (1, "abcdef\nx y z")], "doc_id long, text string")
    segments = do.segments(paras, "doc_id", "text", separator="\n", min_words=3)
    assert sorted((r.segment_id, r.word_count) for r in segments.collect()) == [("0_segment_0", 3), ("0_segment_2", 3), ("1_segment_1", 3)]


def test_vocabulary_without_weights_writes_no_postings(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "d", "red apple red"), (2, "d", "green apple"), (3, "e", "blue sky")], "id long, domain string, content string")
    both, _ = rt.fit_tfidf(docs)
    names, written = [], rt.written
    monkeypatch.setattr(rt, "written", lambda df, name: names.append(name) or written(df, name))
    vocab, weights = rt.fit_tfidf(docs, weights=False)
    assert sorted(map(tuple, vocab.collect())) == sorted(map(tuple, both.collect())) and vocab.count() > 0
    assert weights is None and names == ["vocabulary"]

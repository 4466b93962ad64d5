"""Edge cases: HTML text, chunk boundaries, vocabulary ids, exact percentile."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import registry as ro
from quarry.operators import training as tr
from quarry.sources.html import page_text


def test_page_text_drops_code_comments_and_decodes_once(spark):
    html = ("<html><head><style>p{x}</style><script>var a='<p>';</script></head><body>"
            "<!-- note --><p> A &amp;lt; b &middot; c </p><br><b>bold</b>&copy;</body></html>")
    r = spark.createDataFrame([(html,)], "h string").select(page_text("h").alias("t")).first()
    assert r.t == "A &lt; b · c bold ©"


def test_chunks_cover_whole_text(spark):
    words = " ".join(f"w{i}" for i in range(451))
    df = spark.createDataFrame([(1, words), (2, "one two"), (3, "")], "doc_id int, text string")
    ch = tr.chunk(df, "text", 200, 50, "doc_id").orderBy("doc_id", "chunk_no").collect()
    d1 = [r.chunk.split() for r in ch if r.doc_id == 1]
    assert [c[0] for c in d1] == ["w0", "w150", "w300"] and d1[-1][-1] == "w450"
    assert [r.chunk for r in ch if r.doc_id == 2] == ["one two"]
    assert not [r for r in ch if r.doc_id == 3]


def test_vocab_ids_by_frequency_then_token(spark):
    toks = spark.createDataFrame([(t,) for t in "b a c a b a d".split()], "token string")
    v = {r.token: r.id for r in tr.build_vocab(toks).collect()}
    assert v == {"a": 2, "b": 3, "c": 4, "d": 5}


@pytest.mark.parametrize("q", [0.5, 0.95])
def test_exact_percentile_matches_numpy(spark, q):
    vals = [float(x) for x in np.random.default_rng(3).integers(0, 1000, 257)]
    df = spark.createDataFrame([("g", v) for v in vals], "g string, v double").repartition(5)
    got = ro.exact_percentile(df, ["g"], "v", q, "p").first().p
    assert got == pytest.approx(float(np.percentile(vals, q * 100)))

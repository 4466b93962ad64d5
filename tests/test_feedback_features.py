"""F2/F3 feedback features: built-in expressions, so executors start no Python for them."""
import random

from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions.lexicons import TEST_LEXICON
from quarry.operators import feedback as fo


def letter_words(text, n):
    return [w for w in (text or "").split() if len(w) >= 5 and w.isalpha()][:n]


def test_no_python_in_features(spark):
    fb = spark.createDataFrame([(1, "technical", "m", "rating", 4.0, "some input here", "model output", None, None)],
                               "feedback_id long, domain string, model_id string, feedback_type string, rating double, "
                               "user_input string, model_output string, user_comment string, correction string")
    for out in (fo._with_features(fb, TEST_LEXICON), fo.model_performance(fb, lexicon=TEST_LEXICON),
                fb.select(tx.feedback_keywords("user_input", "model_output"))):
        assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_first_keywords_of_long_and_odd_texts(spark):
    rng = random.Random(3)
    pieces = ["short", "longer", "words", "ab", "x1y2z3", "größe", "l'article", "end.", "naïveté", "十二三四五", "é" * 300]
    seps = [" ", "\n", "\t ", " ", " "]
    texts = [None, "", " ", "abcde", "abcde.", "a" * 511 + " tail", "x" * 600, "ab " * 400 + "words beyond the first characters"]
    texts += ["".join(rng.choice(pieces) + rng.choice(seps) for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    # a word that the first characters cut
    texts += [" " * k + "alpha beta1 gamma " + "delta" * 3 for k in range(480, 520)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for n in (1, 3, 10):
        got = df.select("id", tx.feedback_keywords("t", n=n, joined=True).alias("k"),
                        tx.feedback_features(F.col("t"), {"d": ["words", "größe"]}, n, 1).alias("f")).collect()
        for r in got:
            assert r.k == r.f.keywords == letter_words(texts[r.id], n), texts[r.id]
            assert r.f.concepts == [c for c in ("words", "größe") if c in (texts[r.id] or "")][:1]

"""Columnar word extraction against Python's own string methods."""
import random
import sys
import unicodedata
from collections import Counter

import pyarrow as pa
import pytest

from quarry.functions import columnar
from quarry.functions.lexicons import KEYWORD_STOPWORDS, KEYWORD_STRIP, WS_CHARS

TERMS = ("thing", "que", "ción", "a", "missing", "eaux")


def texts():
    rng = random.Random(3)
    words = ["thing", "things,", "the", "with", "!which!", "nación", "été", "eaux.", "x1234", "que", "漢字漢字漢", "a", "…", ".,!?;:", "longer-word", "ſſſſſ", "日本語日本"]
    gaps = [" ", "  ", "\n", "\t", "　", "\x1f", "\xa0", " "]
    out = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(0, 60))) for _ in range(400)]
    return [*out, None, "", "   ", " lead", "trail \n"]


def keywords(t, n):
    c = Counter(w.strip(KEYWORD_STRIP) for w in (t or "").split() if len(w) >= 5 and w not in KEYWORD_STOPWORDS)
    return [w for w, _ in c.most_common(n)]


@pytest.mark.parametrize("n", [1, 3, 10])
def test_equal_to_python_loops(n):
    xs = [t and t.lower() for t in texts()]
    for column in (pa.array(xs), pa.array(["skipped", *xs], pa.large_string()).slice(1)):
        assert columnar.frequent_words(column, n, KEYWORD_STOPWORDS, 5, KEYWORD_STRIP).to_pylist() == [keywords(t, n) for t in xs]
        assert columnar.first_letter_words(column, n, 5).to_pylist() == [[w for w in (t or "").split() if len(w) >= 5 and w.isalpha()][:n] for t in xs]
        assert columnar.first_terms(column, TERMS, n).to_pylist() == [[x for x in TERMS if x in (t or "")][:n] for t in xs]


def test_empty_columns():
    for got in (columnar.frequent_words(pa.array([], pa.string()), 3, (), 5, "."), columnar.first_letter_words(pa.array([None, ""]), 3, 5),
                columnar.first_terms(pa.array([], pa.string()), TERMS, 2)):
        assert all(x == [] for x in got.to_pylist())


def test_white_space_and_letters_are_those_of_python():
    """Every character splits words as WS_CHARS says, and is a letter as its category says."""
    spaces = set(WS_CHARS)
    for lo in range(1, sys.maxunicode + 1, 1 << 14):
        chars = [chr(c) for c in range(lo, min(lo + (1 << 14), sys.maxunicode + 1)) if not 0xD800 <= c < 0xE000]
        split = columnar.first_terms(pa.array([]), (), 1), columnar._words(pa.array([f"aa{c}bb" for c in chars]))[1]
        parts = [0] * len(chars)
        for d in split[1]:
            parts[d] += 1
        wrong = [hex(ord(c)) for c, n in zip(chars, parts) if (n == 2) != (c in spaces)]
        assert wrong == []
        alpha = columnar.first_letter_words(pa.array([c * 5 for c in chars]), 1, 5).to_pylist()
        odd = [hex(ord(c)) for c, a in zip(chars, alpha) if bool(a) != (unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lm", "Lo")) and unicodedata.category(c) != "Cn"]
        assert len(odd) < 30, odd[:5]


def test_term_counts():
    import re
    stop = ("the", "with", "que")

    def want(t):
        tokens = [w for w in re.findall(r"\w{2,}", t or "") if w not in stop]
        return Counter(tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])])
    xs = [t and t.lower() for t in texts()]
    got = columnar.term_counts(pa.array(xs), stop).to_pylist()
    assert [{e["term"]: e["tf"] for e in g} for g in got] == [want(t) for t in xs] and all(len(g) == len({e["term"] for e in g}) for g in got)
    assert columnar.term_counts(pa.array([None, "", "a b"], pa.string()), ()).to_pylist() == [[], [], []]
    assert columnar.term_counts(pa.array([], pa.string()), stop).to_pylist() == []


def test_long_columns_are_worked_on_in_slices(monkeypatch):
    """No call sees more than SLICE_BYTES of texts (and one text); results are those of whole columns."""
    xs = [t and t.lower() for t in texts()]
    runs = [lambda c: columnar.frequent_words(c, 10, KEYWORD_STOPWORDS, 5, KEYWORD_STRIP), lambda c: columnar.first_letter_words(c, 10, 5),
            lambda c: columnar.first_terms(c, TERMS, 3), lambda c: columnar.term_counts(c, ("the",))]
    whole = [run(pa.array(xs)).to_pylist() for run in runs]
    seen, words = [], columnar._words
    monkeypatch.setattr(columnar, "SLICE_BYTES", 1000)
    monkeypatch.setattr(columnar, "_words", lambda c: seen.append(sum(len((t or "").encode()) for t in c.to_pylist())) or words(c))
    for column in (pa.array(xs), pa.array(["skipped", *xs], pa.large_string()).slice(1)):
        got = [run(column).to_pylist() for run in runs]
        assert [[sorted(x, key=repr) for x in g] for g in got] == [[sorted(x, key=repr) for x in w] for w in whole]
        assert got[:3] == whole[:3]
    assert len(seen) > 20 and max(seen) <= 1000 + max(len((t or "").encode()) for t in xs)

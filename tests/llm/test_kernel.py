import re

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import kernel as K

TEXTS = ["ab cd", None, "", "  x\tab cd ", "Ab,cd1-é", "\nab cd\n\n ab cd", "z" * 5000, "ab"]


@pytest.mark.parametrize("size", [3, 16, 2 << 20])
def test_words_are_those_of_the_patterns(monkeypatch, size):
    monkeypatch.setattr(K, "SLICE", size)
    t = K.texts(pa.array(TEXTS))
    for sep, pattern, fold in ((K.SPACE, r"[^\x20\x09-\x0D]+", False), (K.NON_ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        w = K.words(t, sep, fold, ends=True)
        got = [t.buf[a:b].tobytes().decode() for a, b in zip(w.start, w.end)]
        lower = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x)
        want = [re.findall(pattern, lower(x or "") if fold else x or "") for x in TEXTS]
        assert list(w.count) == [len(x) for x in want]
        flat = [x for row in want for x in row]
        assert [lower(x) if fold else x for x in got] == flat
        assert len({(x, int(h)) for x, h in zip(flat, w.h)}) == len(set(flat)) == len(set(w.h.tolist()))


def test_null_slots_with_bytes_are_empty_and_slices_start_where_they_start():
    a = pa.array(["skip", "one two", None, "three"]).slice(1)
    w = K.words(K.texts(a))
    assert list(w.count) == [2, 0, 1]


def test_windows_equal_iff_words_equal():
    t = K.texts(pa.array(["a b c a b c", "b c a", "a b"]))
    w = K.words(t)
    at, h = K.windows(w.h, w.doc, 3)
    assert list(at) == [0, 1, 2, 3, 6]
    assert h[0] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 3
    assert len(K.windows(w.h[:2], w.doc[:2], 3)[0]) == 0


def test_covered_runs_and_sums():
    assert list(K.covered(np.array([1, 2, 6]), 2, 9)) == [False, True, True, True, False, False, True, True, False]
    at, n = K.runs(np.array([4, 4, 5, 7, 7, 7]))
    assert list(at) == [0, 2, 3] and list(n) == [2, 1, 3]
    assert list(K.per_text(np.array([1, 2, 3, 4]), np.array([0, 0, 3, 4]))) == [0, 6, 4]


def test_blocks_keep_rows_in_order_within_bounds():
    batches = [pa.RecordBatch.from_pydict({"n": list(range(i, i + 7)), "t": ["x" * (j % 5) * 10 for j in range(7)]}) for i in range(0, 70, 7)]
    got = list(K.blocks(iter(batches), "t", rows=8, size=90))
    assert [x for b in got for x in b.column("n").to_pylist()] == list(range(70))
    assert all(len(b) <= 8 for b in got)
    one = list(K.blocks(iter([pa.RecordBatch.from_pydict({"t": ["y" * 500, "z" * 500, None]})]), "t", size=100))
    assert sum(len(b) for b in one) == 3
    assert not list(K.blocks(iter([]), "t"))


def test_gather():
    buf = np.frombuffer(b"one two three", np.uint8)
    assert K.gather(buf, np.array([8, 0]), np.array([13, 3])).tobytes() == b"three\none\n"

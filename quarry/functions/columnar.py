"""Word extraction over whole Arrow columns: no loop over texts.

A column's texts are split at white space by one call, which gives all words as one array with the offsets
of the texts. Tests, trims and counts then run over that array (pyarrow.compute and numpy), and results are list
arrays built from offsets. Null texts count as empty. The arrays of words take many times the bytes of the texts, so
a column is worked on in slices of about SLICE_BYTES, however long the Arrow batch is.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


SLICE_BYTES = 1 << 20


def _in_slices(fn: Callable[..., pa.Array]) -> Callable[..., pa.Array]:
    """`fn`, which gives one value for each text, called with SLICE_BYTES of texts at a time (whole texts,
    one at least)."""
    @wraps(fn)
    def run(texts: pa.Array, *args, **kwargs) -> pa.Array:
        read = np.cumsum(pc.fill_null(pc.binary_length(texts.cast(pa.large_string())), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        if not len(read) or read[-1] <= SLICE_BYTES:
            return fn(texts, *args, **kwargs)
        cuts = [0, *(np.flatnonzero(np.diff(read // SLICE_BYTES)) + 1).tolist(), len(texts)]
        out = pa.concat_arrays([fn(texts.slice(a, b - a), *args, **kwargs) for a, b in zip(cuts, cuts[1:])])
        pa.default_memory_pool().release_unused()
        return out
    return run


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and for each the number of its text."""
    split = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    at = split.offsets.to_numpy().astype(np.int64)
    return split.flatten(), np.repeat(np.arange(len(texts)), np.diff(at))


def _lists(values: pa.Array, doc: np.ndarray, n: int) -> pa.Array:
    """List array of `n` texts from values in the order of `doc`."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values.cast(pa.string()))


def _place(doc: np.ndarray) -> np.ndarray:
    """0-based place of each entry among those of its text (entries in the order of texts)."""
    first = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    return np.arange(len(doc)) - np.repeat(at, np.diff(np.append(at, len(doc))))


def _kept(words: pa.Array, doc: np.ndarray, keep: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    return words.filter(pa.array(keep)), doc[keep]


def _long(words: pa.Array, min_len: int) -> np.ndarray:
    return pc.greater_equal(pc.utf8_length(words), min_len).to_numpy(zero_copy_only=False)


@_in_slices
def frequent_words(lowered: pa.Array, n: int, stopwords: Sequence[str], min_len: int, strip: str) -> pa.Array:
    """of each text, the n most frequent words of at least `min_len` characters that are no stop words,
    `strip` removed at both ends; ties by first occurrence."""
    words, doc = _words(lowered)
    keep = _long(words, min_len)
    stop = [w for w in stopwords if len(w) >= min_len]
    if stop:
        keep &= ~pc.is_in(words, value_set=pa.array(stop, words.type)).to_numpy(zero_copy_only=False)
    words, doc = _kept(words, doc, keep)
    coded = pc.utf8_trim(words, strip).dictionary_encode()
    key = doc * max(len(coded.dictionary), 1) + coded.indices.to_numpy()
    order = np.argsort(key, kind="stable")               # equal words of a text meet, first occurrence first
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    count, first = np.diff(np.append(at, len(key))), order[at]
    best = np.lexsort((first, -count, doc[first]))
    first = first[best]
    first = first[_place(doc[first]) < n]
    return _lists(coded.dictionary.take(coded.indices.take(pa.array(first))), doc[first], len(lowered))


@_in_slices
def first_letter_words(lowered: pa.Array, n: int, min_len: int) -> pa.Array:
    """of each text, the first n words of at least `min_len` characters that are all letters."""
    words, doc = _words(lowered)
    words, doc = _kept(words, doc, _long(words, min_len))
    words, doc = _kept(words, doc, pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False))
    words, doc = _kept(words, doc, _place(doc) < n)
    return _lists(words, doc, len(lowered))


@_in_slices
def first_terms(lowered: pa.Array, terms: Sequence[str], n: int) -> pa.Array:
    """of each text, the first n of `terms` (in their order) that it contains."""
    texts = pc.fill_null(lowered.cast(pa.large_string()), "")
    found = np.zeros((len(texts), len(terms)), bool)
    for k, t in enumerate(terms):
        found[:, k] = pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
    found &= np.cumsum(found, axis=1) <= n
    doc, term = np.nonzero(found)
    return _lists(pa.array(list(terms), pa.string()).take(pa.array(term)), doc, len(texts))


def _counts(doc: np.ndarray, code: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, code) entries in order, and how often each occurs."""
    key = np.sort(doc * max(kinds, 1) + code)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at] // max(kinds, 1), key[at] % max(kinds, 1), np.diff(np.append(at, len(key)))


@_in_slices
def term_counts(lowered: pa.Array, stopwords: Sequence[str]) -> pa.Array:
    """Terms of each text with their counts, as lists of struct(term, tf): runs of two or more letters,
    digits and underscores that are no stop words, and the pairs of neighbours among these."""
    split = pc.split_pattern_regex(pc.fill_null(lowered.cast(pa.large_string()), ""), pattern=r"[^\p{L}\p{N}_]+")
    doc = np.repeat(np.arange(len(lowered)), np.diff(split.offsets.to_numpy().astype(np.int64)))
    words = split.flatten()
    keep = _long(words, 2)
    if stopwords:
        keep &= ~pc.is_in(words, value_set=pa.array(list(stopwords), words.type)).to_numpy(zero_copy_only=False)
    words, doc = _kept(words, doc, keep)
    coded = words.dictionary_encode()
    code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    next_ = np.flatnonzero(doc[1:] == doc[:-1])                      # tokens with a neighbour after them
    pairs, pair = np.unique(code[next_] * max(len(names), 1) + code[next_ + 1], return_inverse=True)
    first, second = (names.take(pa.array(x)) for x in (pairs // max(len(names), 1), pairs % max(len(names), 1)))
    terms = pa.concat_arrays([names, pc.binary_join_element_wise(first, second, pa.scalar(" ", names.type))])
    one, two = _counts(doc, code, len(names)), _counts(doc[next_], pair, len(pairs))
    of, which, n = (np.concatenate(x) for x in zip(one, (two[0], two[1] + len(names), two[2])))
    order = np.argsort(of, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(lowered)))])
    entries = pa.StructArray.from_arrays([terms.take(pa.array(which[order])).cast(pa.string()), pa.array(n[order], pa.int64())], names=["term", "tf"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)

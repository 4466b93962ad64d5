"""Token ids of whole texts, each distinct word encoded once by the tokenizer's own library.

Both public vocabularies used here never join what a *plain space* separates: a single space between two
visible characters. The byte-level vocabulary's pattern takes a space only as the first character of a
match, unless it stands in a run of white space; no piece of the piece vocabulary holds a space after
another character (checked when it is loaded). So a text is cut before every plain space, the distinct
parts of a block are encoded by the library, and the ids are put together in the order of the text: the
same ids as for the whole text, at a fraction of the work, and without the library's objects for every
token of a very long text. Parts are told apart by their bytes, not by hashes. A process keeps the ids of
the last ``KEPT`` distinct parts.

The byte-level vocabulary's pattern also ends a match wherever ASCII letters, digits and other visible
characters change (but for apostrophes, which begin contractions) and around a line feed between visible
characters, so its texts are cut there too, unless a block holds the string of a special token. Parts of ASCII
and Latin letters are split by that pattern and go straight to the library's model, which skips the
library's bookkeeping of offsets; others go through the library's whole chain.

A vocabulary is given as the bytes of its file (a broadcast of a file of fixed size), so that executors
need no file of their own.
"""
from __future__ import annotations

import json
import os
import re
from array import array
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from quarry.llm import kernel as K

BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_SIGN = "▁"
KEPT = 1 << 18           # parts whose ids a process keeps (about 50 MB)
# Fixed value: the public pattern of the byte-level vocabulary, for text of ASCII and Latin letters up to U+024F,
# whose classes don't depend on the version of Unicode.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+", re.ASCII)
PLAIN = re.compile(rf"[\x00-\x7f{LATIN}]*")


_CLASS = np.zeros(256, np.int8)          # ASCII letters, digits, other visible characters, apostrophe
_CLASS[0x21:0x7F] = 3
_CLASS[0x30:0x3A] = 2
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = 1
_CLASS[0x27] = 4


def parts(t: K.Texts, fine: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the parts of all texts in order (each begins at the start of its text or at a
    plain space; with ``fine``, also where classes change), and for each text the number of its first
    part (n + 1)."""
    size = len(t.buf)
    begins = np.zeros(size + 1, bool)
    begins[t.off] = True
    found = []
    for lo in range(0, size, K.SLICE):
        hi = min(lo + K.SLICE, size)
        a, z = max(lo - 3, 0), min(hi + 2, size)
        b = t.buf[a:z]
        seen = (b > 0x20) & (b < 0x7F)
        lead = (b >= 0xC3) & (b <= 0xDF)        # of U+00C0 to U+07FF, where there is no white space
        before, after = np.zeros(len(b), bool), np.zeros(len(b), bool)
        before[1:] = seen[:-1]
        before[2:] |= (b[1:-1] >= 0x80) & (b[1:-1] < 0xC0) & lead[:-2]
        after[:-1] = (seen | lead)[1:] & ~begins[a + 1:z]
        cut = (b == 0x20) & before & after | begins[a:z]
        if fine:
            kind = _CLASS[b]
            cut[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) & (kind[:-1] < 4) & ~((kind[:-1] == 3) & (kind[1:] == 4))
            line = (b[1:-1] == 0x0A) & seen[:-2] & seen[2:] & ~begins[a + 1:z - 1] & ~begins[a + 2:z]
            cut[1:-1] |= line
            cut[2:] |= line
        found.append(np.flatnonzero(cut[lo - a:hi - a]) + lo)
    start = np.concatenate(found) if found else np.zeros(0, np.int64)
    return start, np.searchsorted(start, t.off)


@dataclass
class Tokens:
    """Ids of a block in text order; ``first`` is the token at which each text begins (n + 1)."""

    ids: np.ndarray
    first: np.ndarray


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... of length[i] each, one after another."""
    end = np.cumsum(length)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - length), length)


def _assembled(t: K.Texts, encode, kept: dict[bytes, bytes], fine: bool = False) -> Tokens:
    """``encode`` gives the ids (int32 bytes) of each of a list of parts; ``kept`` has those of earlier ones."""
    start, first = parts(t, fine)
    if not len(start):
        return Tokens(np.zeros(0, np.int32), np.zeros(len(t) + 1, np.int64))
    offsets = np.append(start, len(t.buf)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(t.buf)])
    coded = words.dictionary_encode()
    words = coded.dictionary.to_pylist()
    found = list(map(kept.get, words))
    new = [i for i, ids in enumerate(found) if ids is None]
    if len(kept) + len(new) > KEPT:
        kept.clear()
    for i, ids in zip(new, encode([words[i] for i in new])):
        found[i] = ids
        if len(words[i]) <= 64 and len(kept) < KEPT:
            kept[words[i]] = ids
    n = np.fromiter(map(len, found), np.int64, len(found)) // 4
    flat = np.frombuffer(b"".join(found), np.int32)
    which = coded.indices.to_numpy()
    size = n[which]
    ids = flat[ranges((np.cumsum(n) - n)[which], size)]
    return Tokens(ids, np.concatenate([[0], np.cumsum(size)])[first])


def _byte_signs() -> dict[int, str]:
    """Signs of bytes in a byte-level vocabulary: visible Latin-1 characters stand for their own
    byte, the other bytes for U+0100, U+0101, ... in order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _ByteLevel:
    """A byte-level tokenizer, with the short way for plain parts."""

    def __init__(self, file: bytes, plain: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_buffer(file)
        self.whole.encode_special_tokens = plain
        self.model, self.kept = self.whole.model, {}
        spec = json.loads(file)
        pre = spec["pre_tokenizer"] or {}
        self.short = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"]
        self.special = [] if plain else [t["content"] for t in spec["added_tokens"]]
        self.signs = _byte_signs()
        self.ascii = str.maketrans({chr(b): s for b, s in self.signs.items() if b < 128})

    def _ids(self, words: list[str]) -> bytes:
        ids = array("i")
        for word in words:
            signs = word.translate(self.ascii) if word.isascii() else "".join(map(self.signs.__getitem__, word.encode()))
            ids.extend([t.id for t in self.model.tokenize(signs)])
        return ids.tobytes()

    def encode(self, found: list[bytes]) -> list[bytes]:
        out, rest = [b""] * len(found), []
        for i, part in enumerate(found):
            text = part.decode()
            if self.short and PLAIN.fullmatch(text) and not any(s in text for s in self.special):
                out[i] = self._ids(WORDS.findall(text))
            else:
                rest.append(i)
        whole = self.whole.encode_batch([found[i].decode() for i in rest], add_special_tokens=False)
        for i, e in zip(rest, whole):
            out[i] = array("i", e.ids).tobytes()
        return out


@lru_cache(4)
def _byte_level(file: bytes, plain: bool) -> _ByteLevel:
    return _ByteLevel(file, plain)


def byte_ids(t: K.Texts, file: bytes, plain: bool = False) -> Tokens:
    """Ids by a byte-level vocabulary; with ``plain``, the strings of special tokens are plain text."""
    level = _byte_level(file, plain)
    fine = level.short and not any(s.encode() in memoryview(t.buf).tobytes() for s in level.special)
    return _assembled(t, level.encode, level.kept, fine)


@lru_cache(4)
def _piece_tokenizer(file: bytes):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=file)
    if any(SPACE_SIGN in model.id_to_piece(i).lstrip(SPACE_SIGN) for i in range(model.get_piece_size())):
        raise ValueError("a piece holds a space after another character: parts can't be encoded alone")
    model.kept = {}
    return model


def piece_ids(t: K.Texts, file: bytes) -> Tokens:
    """Ids by a piece vocabulary that puts a space before its text. Every text of ``t`` begins with
    that space, which is left to the vocabulary."""
    model = _piece_tokenizer(file)
    return _assembled(t, lambda words: [array("i", x).tobytes() for x in model.encode([w[1:].decode() for w in words], num_threads=1)], model.kept)


@dataclass
class Bytes:
    """Bytes of every id of a vocabulary, one after another."""

    flat: np.ndarray
    start: np.ndarray
    size: np.ndarray


def _flat(entries: list[bytes]) -> Bytes:
    size = np.fromiter(map(len, entries), np.int64, len(entries))
    return Bytes(np.frombuffer(b"".join(entries), np.uint8), np.cumsum(size) - size, size)


@lru_cache(4)
def byte_entries(file: bytes) -> Bytes:
    """The vocabulary's entries, byte-level decoded."""
    byte = {s: b for b, s in _byte_signs().items()}
    entries = _byte_level(file, True).whole.get_vocab()
    out = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        out[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
    return _flat(out)


@lru_cache(4)
def piece_entries(file: bytes) -> Bytes:
    """Pieces in UTF-8 with the space sign as a space; <0xHH> is the byte HH."""
    model = _piece_tokenizer(file)
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(SPACE_SIGN, " ").encode())
    return _flat(out)


def same_bytes(t: K.Texts, got: Tokens, entries: Bytes) -> np.ndarray:
    """For each text: do the bytes of its tokens, joined, equal the text?"""
    size = entries.size[got.ids]
    end = np.concatenate([[0], np.cumsum(size)])[got.first]
    same = np.diff(end) == np.diff(t.off)
    for i in _even(np.diff(t.off), K.SLICE):     # texts of about a slice at a time
        mine = i[same[i]]
        if len(mine):
            which = ranges(got.first[mine], np.diff(got.first)[mine])
            have = entries.flat[ranges(entries.start[got.ids[which]], size[which])]
            want = t.buf[ranges(t.off[mine], np.diff(t.off)[mine])]
            off = np.concatenate([[0], np.cumsum(np.diff(t.off)[mine])])
            same[mine] = K.per_text(have != want, off) == 0
    return same


def _even(size: np.ndarray, limit: int):
    """Consecutive indices whose sizes sum to about ``limit`` or less (one larger alone)."""
    group = np.cumsum(size) // limit
    at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(size) else []
    for a, z in zip(at, [*at[1:], len(size)]):
        yield np.arange(a, z)

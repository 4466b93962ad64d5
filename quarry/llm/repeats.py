"""Substring duplicates: Rabin-Karp hashes of every fixed-length word window (operator 8).

Every window of every text is hashed. A task reduces the windows of a block of texts to one
entry for each distinct hash (its smallest document and where it stands there), the entries
meet in buckets of hashes, and each learns whether a smaller document holds the same window.
Repeated windows come back as positions and merge into maximal removal intervals, which are
cut from the text. Windows are judged on the input, not on what is left.

Skew: a window that a third of all texts share makes one entry for each block, decided
inside the block for all but its smallest document. Two different windows share a 64-bit hash
with a chance of 2^-64 a pair.

Texts are told apart by id and, where several rows share an id, by 64 bits of the text's hash. Which ids
are shared is a bitmap of 2^20 places by hash of the id, from one pass over the ids; an id that meets a place by
chance gets its hash too. So null ids and rows of one id spread over the buckets like others.

Defined results: a null text has no words; a null id sorts after every other; rows of
one id are one document (none is smaller than the other), each cut by its own windows; ties can't arise,
as only ids count; a text shorter than a window keeps all words; no rows give no rows; other columns
aren't read.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import exchange as X
from quarry.llm import kernel as K

WINDOW = 13
LAST = 2**63 - 1   # stands for a null id while windows are compared


def _pack(ids: np.ndarray, keys: np.ndarray, pos: np.ndarray) -> dict:
    """Entries (one element each, in the order of text and position) as one row: texts as
    differences of ids, positions as differences in a text, compressed."""
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
    at = np.flatnonzero(new)
    gap = np.diff(pos, prepend=0).astype(np.uint32)
    gap[at] = pos[at]
    n = np.diff(np.append(at, len(ids))).astype(np.uint32)
    step = np.diff(ids[at], prepend=np.int64(0))
    return {"texts": len(at), "places": zlib.compress(b"".join(map(X.planes, (step, keys[at], n, gap))), 1)}


def _places(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, keys and positions of a packed row, one element for each entry."""
    raw, k, lo, got = zlib.decompress(r["places"]), r["texts"], 0, []
    for kind in (np.int64, np.int64, np.uint32):
        size = k * np.dtype(kind).itemsize
        got.append(X.unplanes(raw[lo:lo + size], kind))
        lo += size
    ids, keys, n = np.cumsum(got[0]), got[1], got[2]
    gap = X.unplanes(raw[lo:], np.uint32).astype(np.int64)
    total = np.cumsum(gap)
    at = np.cumsum(n, dtype=np.int64) - n
    pos = total - np.repeat(total[at] - gap[at], n)
    return np.repeat(ids, n), np.repeat(keys, n), pos


_PACKED = "bucket int, sure boolean, texts int, places binary, hashes binary"
_HITS = "id long, key long, at binary"
PLACES = 1 << 14   # words of the bitmap of shared ids, 64 places each


def _asked(text_col: str, window: int, buckets: int):
    """Task: windows of its texts, one entry for each hash of a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("sure", pa.bool_()), ("texts", pa.int32()),
                            ("places", pa.binary()), ("hashes", pa.binary())])
        for block in K.blocks(batches, text_col):
            block = block.sort_by("_id")
            ids, keys = block.column("_id").to_numpy(), block.column("_key").to_numpy()
            w = K.words(K.texts(block.column(text_col)))
            at, h = K.windows(w.h, w.doc, window)
            if not len(at):
                continue
            doc = w.doc[at]
            pos = at - w.first[doc]
            order = np.argsort(h, kind="stable")              # equal hashes: smallest id first
            first, n = K.runs(h[order])
            later = np.zeros(len(h), bool)                    # a smaller document is in the block
            later[order] = ids[doc[order]] > np.repeat(ids[doc[order[first]]], n)
            out = []
            for sure in (False, True):
                mine = np.flatnonzero(later == sure)
                for b, sel in X.by_bucket(X.bucket_of(h[mine], buckets), buckets):
                    i = mine[sel]
                    row = _pack(ids[doc[i]], keys[doc[i]], pos[i])
                    out.append(row | {"bucket": b, "sure": sure, "hashes": b"" if sure else h[i].tobytes()})
            yield from pa.Table.from_pylist(out, schema).to_batches(max_chunksize=256)
    return run


def _answered(groups: int):
    """Bucket: which entries have a smaller document with the same hash, packed by the group
    of texts that they go to."""
    def run(table: pa.Table) -> pa.Table:
        found, asked, hashes = [], [], []
        for r in table.to_pylist():
            (found if r["sure"] else asked).append(_places(r))
            hashes.append(np.frombuffer(r["hashes"], np.uint64))
        if asked:
            h = np.concatenate(hashes)
            i, k, p = (np.concatenate(x) for x in zip(*asked))
            order = np.argsort(h)
            first, n = K.runs(h[order])
            hit = order[i[order] > np.repeat(np.minimum.reduceat(i[order], first), n)]
            found.append((i[hit], k[hit], p[hit]))
        i, k, p = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((p, k, i))
        i, k, p = i[order], k[order], p[order]
        to = X.bucket_of(K.mix(i.view(np.uint64) ^ k.view(np.uint64)), groups)
        return pa.Table.from_pylist([_pack(i[x], k[x], p[x]) | {"bucket": b} for b, x in X.by_bucket(to, groups)],
                                    pa.schema([("bucket", pa.int32()), ("texts", pa.int32()), ("places", pa.binary())]))
    return run


def _gathered(table: pa.Table) -> pa.Table:
    """Group of texts: the positions of each text in one row."""
    i, k, p = (np.concatenate(x) for x in zip(*map(_places, table.to_pylist())))
    order = np.lexsort((p, k, i))
    i, k, p = i[order], k[order], p[order].astype(np.uint32)
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(i))
    return pa.table({"id": pa.array(i[at], pa.int64()), "key": pa.array(k[at], pa.int64()),
                     "at": pa.array([p[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())})


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     window: int = WINDOW) -> DataFrame:
    """(id, key, at): for each text with repeated windows, packed positions (uint32 word
    numbers) of the windows that a document with a smaller id also holds; `key` tells texts of
    one id apart."""
    buckets = X.bucket_count(docs, text_col)
    asked = _keyed(docs, id_col, text_col).select("_id", "_key", text_col).mapInArrow(
        _asked(text_col, window, buckets), _PACKED)
    hits = asked.groupBy("bucket").applyInArrow(_answered(buckets), "bucket int, texts int, places binary")
    return hits.groupBy("bucket").applyInArrow(_gathered, _HITS)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, `_id` (never null) and `_key`, which with `_id` tells texts apart."""
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias(text_col),
                       F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("_id"))
    shared = rows.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    marked = X.with_marked(rows, "_id", X.bitmap(shared, "_id", PLACES), PLACES, "_many")
    return marked.withColumn("_key", F.when(F.col("_many"), F.xxhash64(text_col)).otherwise(F.lit(0).cast("long"))).drop("_many")


def _cut(id_col: str, text_col: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, kept_text, spans = [], [], []
            for text, at in zip(batch.column(text_col), batch.column("at")):
                w = (text.as_py() or "").encode().split()     # bytes.split: ASCII white space alone
                mask = K.covered(np.frombuffer(at.as_py() or b"", np.uint32).astype(np.int64), window, len(w))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                n_words.append(len(w))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
                kept_text.append(b" ".join(compress(w, ~mask) if mask.any() else w).decode())
            yield pa.record_batch({
                id_col: batch.column(id_col).cast(pa.int64()),
                "n_words": pa.array(n_words, pa.int64()),
                "removed": pa.array(spans, _SPANS),
                "kept_text": pa.array(kept_text, pa.string())})
    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW) -> DataFrame:
    """Every row's id, n_words, `removed` (maximal intervals of removed words, end exclusive)
    and `kept_text` (the other words, joined by one space)."""
    hits = repeated_windows(docs, id_col, text_col, window)
    rows = _keyed(docs, id_col, text_col)
    joined = rows.join(hits.select(F.col("id").alias("_id"), F.col("key").alias("_key"), "at"), ["_id", "_key"], "left")
    return joined.select(id_col, text_col, "at").mapInArrow(
        _cut(id_col, text_col, window),
        f"{id_col} long, n_words long, removed array<struct<start:long,end:long>>, kept_text string")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The query's columns: counts and a SHA-256 of what is kept."""
    out = remove_repeats(docs, id_col, text_col, window)
    taken = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return out.select(id_col, "n_words", taken.alias("n_removed"),
                      F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))

"""Benchmark contamination: suffix arrays of the training texts, searched for every suffix of
the benchmark items (operator 10).

Each block of training texts is a shard. Its suffix array orders the word positions that can
match (those whose first words also begin some item suffix) by the words that follow, as far as
a window reaches. Every window of every item suffix is found by two binary searches, which give
all its verbatim occurrences in the shard; occurrences on one diagonal of (text, item) merge into
the longest matches and their places. A text stays in one shard, so nothing is shuffled.

The benchmark goes to the executors in blocks of about ``ITEM_CHARS`` characters, each read and
searched on its own; with more than one block, the finds of a text are merged afterwards.

Defined results: a null text or item has no words; items without words match nothing; a null item
id counts as the empty string; repeated items or rows count once for each id, repeated texts each
get their own row; no rows give no rows; an empty benchmark finds nothing; other columns aren't
read and pass through ``decontaminate`` untouched.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import kernel as K

WINDOW = 13
ITEM_CHARS = 4 << 20      # characters of benchmark text that go to an executor at a time, about
LEAD = 3                  # words that a position must share with an item suffix to enter the array


class Items:
    """Windows of a block of items: distinct word sequences and the items that hold them."""

    def __init__(self, ids: list[str], column: pa.Array, window: int):
        w = K.words(K.texts(column), K.NON_ALNUM, fold=True)
        n = w.count
        self.names = sorted(set(ids))
        number = {x: i for i, x in enumerate(self.names)}
        self.window = window
        size = np.minimum(n, window)                                 # words in a window of the item
        starts = np.where(n > 0, n - size + 1, 0)                    # windows of the item
        item = np.repeat(np.arange(len(n)), starts)
        at = np.arange(len(item)) - np.repeat(np.cumsum(starts) - starts, starts) + w.first[item]
        h = np.concatenate([w.h, np.zeros(window, np.uint64)])
        words = np.zeros((len(at), window), np.uint64)
        for j in range(window):
            words[:, j] = np.where(j < size[item], h[at + j], 0)
        words, kind = np.unique(words, axis=0, return_inverse=True) if len(at) else (words, np.zeros(0, np.int64))
        kind = kind.reshape(-1)
        self.words = words                                           # distinct windows
        self.size = (words != 0).sum(axis=1)
        of = np.array([number[x] for x in ids], np.int64)[item] if len(item) else item
        self.place = np.stack([kind, of, at - w.first[item]], 1)     # window, item, position in the item
        self.place = self.place[np.lexsort((self.place[:, 2], of, kind))]
        self.first = np.searchsorted(self.place[:, 0], np.arange(len(words) + 1))
        self.lead = int(min(LEAD, self.size.min())) if len(words) else 0
        lead = K.windows(words[:, :self.lead].reshape(-1), np.repeat(np.arange(len(words)), self.lead), self.lead)[1] if self.lead else h[:0]
        self.leads, self.lead_of = np.unique(lead, return_inverse=True)
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[self.leads >> np.uint64(48)] = True


def suffix_array(h: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The positions `at` in the order of the words h[p], h[p + 1], .. up to `depth` (h must
    reach `depth` beyond the last). Each round sorts only what is still tied."""
    order = at[np.argsort(h[at], kind="stable")]
    group = np.zeros(len(order), np.int64)
    new = np.ones(len(order), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    group = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    for j in range(1, depth):
        tied = np.zeros(len(order), bool)
        tied[1:] = group[1:] == group[:-1]
        tied[:-1] |= tied[1:]
        slot = np.flatnonzero(tied)
        if not len(slot):
            break
        word, g = h[order[slot] + j], group[slot]
        by = np.lexsort((word, g))
        order[slot] = order[slot][by]
        word = word[by]
        new = np.ones(len(slot), bool)
        new[1:] = (g[1:] != g[:-1]) | (word[1:] != word[:-1])
        group[slot] = np.maximum.accumulate(np.where(new, slot, 0))
    return order


def search(h: np.ndarray, order: np.ndarray, want: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of the sequences want[i, :size[i]] in a suffix array: ranges of `order`."""
    reach = np.arange(want.shape[1])
    out = []
    for upper in (False, True):
        lo, hi = np.zeros(len(want), np.int64), np.full(len(want), len(order))
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            got, ask = h[order[mid][:, None] + reach], want[open_]
            differs = (got != ask) & (reach < size[open_, None])
            at = differs.argmax(1)
            row = np.arange(len(open_))
            tie = ~differs[row, at]
            below = np.where(tie, upper, got[row, at] < ask[row, at])
            lo[open_] = np.where(below, mid + 1, lo[open_])
            hi[open_] = np.where(below, hi[open_], mid)
        out.append(lo)
    return out[0], out[1]


def occurrences(w: K.Words, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """All (window, word number) where a window of the items stands in the shard."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not items.lead or not len(w.h):
        return none
    at, lead = K.windows(w.h, w.doc, items.lead)
    some = np.flatnonzero(items.sieve[lead >> np.uint64(48)])
    found = np.minimum(np.searchsorted(items.leads, lead[some]), len(items.leads) - 1)
    known = items.leads[found] == lead[some]
    at, found = at[some[known]], found[known]
    if not len(at):
        return none
    # one zero after each text: no match runs on into the next
    h = np.zeros(len(w.h) + w.doc[-1] + 1 + items.window, np.uint64)
    h[np.arange(len(w.h)) + w.doc] = w.h
    order = suffix_array(h, at + w.doc[at], items.window)
    back = np.zeros(len(h), np.int64)
    back[at + w.doc[at]] = at
    present = np.zeros(len(items.leads), bool)
    present[found] = True
    asked = np.flatnonzero(present[items.lead_of])
    lo, hi = search(h, order, items.words[asked], items.size[asked])
    n = hi - lo
    slot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    return np.repeat(asked, n), back[order[slot]]


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _finds(items, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = items.value
        for block in K.blocks(batches, text_col):
            w = K.words(K.texts(block.column(text_col)), K.NON_ALNUM, fold=True)
            kind, at = occurrences(w, q)
            hit = K.covered(at, q.size[kind], len(w.h))
            spans: list[list] = [[] for _ in range(len(block))]
            step = hit.copy()
            step[1:] &= ~hit[:-1] | (w.doc[1:] != w.doc[:-1])
            last = hit.copy()
            last[:-1] &= ~hit[1:] | (w.doc[1:] != w.doc[:-1])
            for a, b in zip(np.flatnonzero(step), np.flatnonzero(last)):
                d = w.doc[a]
                spans[d].append({"start": int(a - w.first[d]), "end": int(b + 1 - w.first[d])})
            pairs = np.unique(w.doc[at] * len(q.words) + kind) if len(at) else at
            doc, kind = np.divmod(pairs, max(1, len(q.words)))
            n = q.first[kind + 1] - q.first[kind]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(q.first[kind], n)
            pairs = np.unique(np.repeat(doc, n) * max(1, len(q.names)) + q.place[place, 1])
            names: list[list] = [[] for _ in range(len(block))]
            for d, i in zip(*np.divmod(pairs, max(1, len(q.names)))):
                names[d].append(q.names[i])
            yield from pa.table({
                "id": block.column("id").cast(pa.int64()), "key": block.column("key").cast(pa.int64()),
                "n_words": pa.array(w.count, pa.int64()), "spans": pa.array(spans, _SPAN),
                "items": pa.array(names, pa.list_(pa.string()))}).to_batches()
    return run


def _longest(items, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = items.value
        for block in K.blocks(batches, text_col):
            ids = block.column("id").cast(pa.int64())
            w = K.words(K.texts(block.column(text_col)), K.NON_ALNUM, fold=True)
            kind, at = occurrences(w, q)
            n = q.first[kind + 1] - q.first[kind]
            slot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(q.first[kind], n)
            at, kind = np.repeat(at, n), np.repeat(kind, n)
            item, start = q.place[slot, 1], q.place[slot, 2]
            pos = at - w.first[w.doc[at]]
            order = np.lexsort((pos, pos - start, item, w.doc[at]))
            doc, item, start, pos, kind = w.doc[at][order], item[order], start[order], pos[order], kind[order]
            new = np.ones(len(pos), bool)
            new[1:] = ((doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | ((pos - start)[1:] != (pos - start)[:-1])
                       | (pos[1:] > pos[:-1] + 1))
            a = np.flatnonzero(new)
            length = np.diff(np.append(a, len(pos))) - 1 + q.size[kind[a]]
            yield from pa.table({
                "id": ids.take(pa.array(doc[a])), "item_id": pa.array([q.names[i] for i in item[a]], pa.string()),
                "doc_start": pa.array(pos[a], pa.int64()), "item_start": pa.array(start[a], pa.int64()),
                "n_words": pa.array(length, pa.int64())}).to_batches()
    return run


def _item_blocks(items: DataFrame, item_col: str, text_col: str, window: int):
    """Broadcast values, one for each block of items; blocks are read one at a time."""
    spark = items.sparkSession
    rows = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t"))
    n = 1 + (rows.agg(F.sum(F.length("t"))).first()[0] or 0) // ITEM_CHARS
    for b in range(n):
        part = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).toArrow()
        yield spark.sparkContext.broadcast(Items(part.column("i").to_pylist(), part.column("t").combine_chunks(), window))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col))


def longest_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The longest verbatim matches of a window or more: (id, item_id, doc_start, item_start,
    n_words), in words."""
    parts = [_rows(docs, id_col, text_col).mapInArrow(
        _longest(b, text_col), "id long, item_id string, doc_start long, item_start long, n_words long")
        for b in _item_blocks(items, item_col, item_text, window)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """For every text: id, key (hash of the text), n_words, `spans` (maximal ranges of words inside
    item windows, end exclusive) and `items` (sorted ids of the items found)."""
    schema = "id long, key long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
    parts = [_rows(docs, id_col, text_col).mapInArrow(_finds(b, text_col), schema)
             for b in _item_blocks(items, item_col, item_text, window)]
    if len(parts) == 1:
        return parts[0]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    # a copy of one row is found as often in each block of items, so rows keep their number
    merged = found.groupBy("id", "key", "n_words").agg(
        (F.count("*") / len(parts)).cast("int").alias("copies"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = F.aggregate(
        "spans", F.array().cast("array<struct<start:long,end:long>>"),
        lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
                               F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                                   F.element_at(done, -1)["start"].alias("start"),
                                   F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(done, F.array(s))))
    return (merged.withColumn("spans", joined)
            .withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("copies"))


def verdicts(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = 20) -> DataFrame:
    """The query's columns: a text is contaminated if it is hit and its hit words are a
    `share`-th of its words or more."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    found = find(docs, items, id_col, text_col, item_col, item_text, window).withColumn("n_hit", n_hit)
    return found.select(
        F.col("id").alias(id_col), "key", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def _clean(items, text_col: str, share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in K.blocks(batches, text_col):
            w = K.words(K.texts(block.column(text_col)), K.NON_ALNUM, fold=True)
            kind, at = occurrences(w, items.value)
            n_hit = K.per_text(K.covered(at, items.value.size[kind], len(w.h)), w.first)
            yield from block.filter(pa.array((n_hit == 0) | (share * n_hit < w.count))).to_batches()
    return run


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = 20) -> DataFrame:
    """`docs` without its contaminated rows, all columns kept. With one block of items the rows
    are judged where they are; with more, the finds of all blocks decide."""
    blocks = list(_item_blocks(items, item_col, item_text, window))
    if len(blocks) == 1:
        return docs.mapInArrow(_clean(blocks[0], text_col, share), docs.schema)
    bad = (verdicts(docs, items, id_col, text_col, item_col, item_text, window, share).filter("contaminated")
           .select(F.col(id_col).alias("_id"), F.col("key").alias("_key")).distinct())
    key = F.xxhash64(docs[text_col])
    return docs.join(bad, docs[id_col].cast("long").eqNullSafe(bad["_id"]) & (key == bad["_key"]), "left_anti")

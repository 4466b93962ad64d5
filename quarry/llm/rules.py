"""Quality rules: repetition counts of every text, and a hashed n-gram log-likelihood ratio
between a trusted-target and the raw-corpus multinomial (operator 3).

One pass counts the hashed words and word pairs of all texts (raw): a task sums its texts into
vectors of ``SLOTS`` counts, which Spark adds up by range of slots. Texts never meet the labels: rows whose id
has its place in a bitmap of the trusted ids (of fixed size) also send the slots of their n-grams, two bytes
each, which an exact join by id reduces to the trusted ones and adds up (target). So the plan is the
same for any number of labels, and no text is shuffled. The smoothed log ratios of the slots are a table
of fixed size; a second pass scores every text by the mean ratio of its n-grams.

The threshold is a value of that score: of a fixed grid, the one that best separates labelled texts that are
trusted from those that aren't, among those that lose at most ``LOSS`` of the trusted; with no labels of
one kind, no text is rejected by it. For it, a text is scored by the target without the ids of its fold (one of
``FOLDS``, by hash), so no text is judged by a target that holds it.

Defined results: a null text has no words and fails the base rules; a text with several labels is
trusted if all of them say so, null labels don't count; repeated rows count and are returned each;
null ids have no label; no rows give no rows; other columns aren't read. Counts are exact up to
collisions of 64-bit hashes inside one text.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import exchange as X
from quarry.llm import kernel as K

SLOTS = 1 << 16           # hash slots of the multinomials
RANGES = 64               # parts in which the counts of tasks are added up
PLACES = 1 << 17          # words of the bitmap of trusted ids (1 MB)
SMOOTH = 1.0              # pseudo-count of each slot
LOSS = 0.002              # share of trusted texts that the threshold may reject
FOLDS = 8                 # of the ids, for scores by a target that doesn't hold the text
GRID = 2000               # candidate thresholds between -10 and 10
MIN_WORDS = 10            # the base rules
MAX_REPEATED = 20         # percent of words in repeated 5-word windows
REPEAT_WINDOW = 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _ngrams(w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Slot and text of every word and every pair of neighbouring words."""
    at, pair = K.windows(w.h, w.doc, 2)
    slot = np.concatenate([w.h >> np.uint64(48), pair >> np.uint64(48)]).astype(np.int64) * SLOTS >> 16
    return slot, np.concatenate([w.doc, w.doc[at]])


def _fold(ids: np.ndarray) -> np.ndarray:
    """Fold of an id, by hash."""
    return (K.mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(40)).astype(np.int64) % FOLDS


def _packed(total: np.ndarray) -> pa.RecordBatch:
    """Counts (any rows, SLOTS) as one row for each range of slots."""
    part = total.reshape(len(total), RANGES, -1)
    return pa.record_batch({"part": pa.array(np.arange(RANGES), pa.int32()), "counts": pa.array([part[:, i].tobytes() for i in range(RANGES)], pa.binary())})


def _counts(text_col: str):
    """Task: raw counts of its texts, and of marked rows the slots of their n-grams."""
    schema = pa.schema([("part", pa.int32()), ("counts", pa.binary()), ("_id", pa.int64()), ("slots", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1, SLOTS), np.int64)
        for block in K.blocks(batches, text_col):
            slot, doc = _ngrams(K.words(K.texts(block.column(text_col))))
            total[0] += np.bincount(slot, minlength=SLOTS)
            rows = np.flatnonzero(block.column("marked").fill_null(False).to_numpy())
            if len(rows):
                order = np.lexsort((slot, doc))
                slot, at = slot[order].astype(np.uint16), np.searchsorted(doc[order], np.arange(len(block) + 1))
                yield pa.record_batch([pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary()), block.column("_id").take(pa.array(rows)).combine_chunks(),
                                       pa.array([X.planes(slot[at[i]:at[i + 1]]) for i in rows], pa.binary())], schema=schema)
        if total.any():
            b = _packed(total)
            yield pa.record_batch([*b.columns, pa.nulls(RANGES, pa.int64()), pa.nulls(RANGES, pa.binary())], schema=schema)
    return run


def _targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: counts of trusted texts, of each fold of the ids."""
    total = np.zeros((FOLDS, SLOTS), np.int64)
    for batch in batches:
        fold = _fold(batch.column("_id").to_numpy())
        for k in range(FOLDS):
            parts = [X.unplanes(b.as_py(), np.uint16) for b in batch.column("slots").filter(pa.array(fold == k))]
            if parts:
                total[k] += np.bincount(np.concatenate(parts), minlength=SLOTS)
    if total.any():
        yield _packed(total)


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
    return pa.table({"part": table.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def _summed(parts: DataFrame, kinds: int) -> np.ndarray:
    """Counts of all tasks, added up by range of slots: kinds * SLOTS numbers, whatever the corpus."""
    rows = parts.select("part", "counts").groupBy("part").applyInArrow(_added, "part int, counts binary").toArrow().to_pylist()
    total = np.zeros((kinds, RANGES, SLOTS // RANGES))
    for r in rows:
        total[:, r["part"]] = np.frombuffer(r["counts"], np.int64).reshape(kinds, -1)
    return total.reshape(kinds, SLOTS)


def ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log ratios of target to raw probability for each slot: by all trusted ids (`_id` of `trusted`, distinct),
    and by all but those of each fold."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_col)
    marked = X.with_marked(rows, "_id", X.bitmap(trusted, "_id", PLACES), PLACES, "marked")
    found = X.table(marked.mapInArrow(_counts(text_col), "part int, counts binary, _id long, slots binary"), "ngrams")
    raw = _summed(found.filter("part is not null"), 1)[0]
    exact = found.filter("slots is not null").select("_id", "slots").join(trusted.select("_id"), "_id", "left_semi")
    folds = _summed(exact.mapInArrow(_targets, "part int, counts binary"), FOLDS)
    base = (raw + SMOOTH) / (raw.sum() + SMOOTH * SLOTS)
    out = [np.log((x + SMOOTH) / (x.sum() + SMOOTH * SLOTS) / base) if x.any() else np.zeros(SLOTS) for x in (folds.sum(0), *(folds.sum(0) - folds))]
    return np.array(out)


def _measured(id_col: str, text_col: str, ratio):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = ratio.value
        for block in K.blocks(batches, text_col):
            t = K.texts(block.column(text_col))
            w, n = K.words(t), len(t)
            # code points: bytes that don't continue one; in words: that aren't separators
            inside = ~K.SPACE[t.buf] & ((t.buf & 0xC0) != 0x80)
            lines = K.lines(t)
            has_word = np.diff(np.searchsorted(w.start, np.append(lines.start, len(t.buf)))) > 0
            line_doc, line_h = lines.doc[has_word], lines.h[has_word]
            order = np.lexsort((line_h, line_doc))
            same = (np.diff(line_doc[order]) == 0) & (line_h[order][1:] == line_h[order][:-1])
            dup_lines = np.bincount(line_doc[order][1:][same], minlength=n)
            at, h = K.windows(w.h, w.doc, REPEAT_WINDOW)
            doc = w.doc[at]
            order = np.lexsort((h, doc))
            twin = (np.diff(doc[order]) == 0) & (h[order][1:] == h[order][:-1])
            again = np.zeros(len(at), bool)
            again[order[1:][twin]] = True
            again[order[:-1][twin]] = True
            repeated = K.per_text(K.covered(at[again], REPEAT_WINDOW, len(w.h)), w.first)
            slot, of = _ngrams(w)
            ids = block.column(id_col).cast(pa.int64())
            size = np.maximum(1, np.bincount(of, minlength=n))
            score = np.bincount(of, value[0][slot], n) / size
            without = 1 + _fold(ids.fill_null(0).to_numpy())    # the target that lacks the text's fold
            apart = np.bincount(of, value[without[of], slot], n) / size
            yield from pa.table({
                id_col: ids,
                "n_words": pa.array(w.count, pa.int64()),
                "word_chars": pa.array(K.per_text(inside, t.off), pa.int64()),
                "n_symbols": pa.array(K.per_text(_SYMBOL[t.buf], t.off), pa.int64()),
                "n_dup_lines": pa.array(dup_lines, pa.int64()),
                "n_repeat_words": pa.array(repeated, pa.int64()),
                "llr": pa.array(np.round(score, 9), pa.float64()), "apart": pa.array(np.round(apart, 9), pa.float64())}).to_batches()
    return run


def threshold(scored: DataFrame) -> float:
    """The cut from the labelled rows (`trusted` 0 or 1) of `scored` by their score `apart`."""
    step = 20 / GRID
    slot = F.least(F.greatest(F.floor((F.col("apart") + 10) / step), F.lit(0)), F.lit(GRID - 1))
    rows = (scored.filter(F.col("trusted").isNotNull()).groupBy(slot.cast("int").alias("s"), "trusted")
            .count().collect())                       # two numbers for each cell of the grid
    n = np.zeros((2, GRID))
    for r in rows:
        n[r["trusted"], r["s"]] += r["count"]
    if not n.sum(1).all():
        return -np.inf
    lost = np.concatenate([np.zeros((2, 1)), np.cumsum(n, 1)], 1)[:, :-1] / n.sum(1, keepdims=True)
    gain = np.where(lost[1] <= LOSS, lost[0] - lost[1], -1)
    best = int(np.flatnonzero(gain == gain.max())[0])
    return -10 + best * step if best else -np.inf


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> DataFrame:
    """Every row's id, base counts, `llr`, `base_failed` and `kept`. `labels` has ids and a
    label that is 1 for trusted texts."""
    label = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id"))
             .agg((F.min(label_col) == 1).cast("int").alias("trusted")))
    label = X.table(label, "labels")
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    ratio = docs.sparkSession.sparkContext.broadcast(ratios(rows, label.filter("trusted = 1"), id_col, text_col))
    scored = X.table(rows.mapInArrow(
        _measured(id_col, text_col, ratio),
        f"{id_col} long, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
        " n_repeat_words long, llr double, apart double"), "rules")
    cut = threshold(scored.select(F.col(id_col).alias("_id"), "apart").join(label, "_id"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    passes = (F.col("llr") >= F.lit(cut)) if np.isfinite(cut) else F.lit(True)
    return scored.drop("apart").withColumns({"base_failed": failed, "kept": ~failed & passes})

"""Language identification: one interpolated Kneser-Ney character model for each language, kept in
sorted hash arrays; the lowest length-normalised cross-entropy wins, with calibrated rejection
(operator 1).

Training counts the character 4-grams of all training texts: tasks count the distinct words of a
block, then the grams of these words (letters in lower case, a boundary before and after; other
characters are boundaries). Every counted gram is kept, however rare, so the models grow with the
distinct grams of the corpus, and so does what the driver gets and broadcasts. Lower orders are
continuation counts of all grams.

The grams of all languages form one array of sorted hashes for each order, with the interpolated
log-probability under each language beside it; grams in none of them back off by the context's
weight. Texts are scored by their distinct words. Two calibrations use labelled texts that
weren't counted (about a 25th): the temperature of the score, and for each language a bound on
the cross-entropy, beyond which a text is rejected. The bound comes from the ``QUANTILE`` of the
deviations of all texts whose best language is their label, from a histogram, so neither mislabelled
texts nor the number of texts move it (``LEAST_BOUND`` spreads above their mean at least, as few
texts show little of the spread); a language without such texts has none, and rejects nothing.

After that the calibration texts' grams are added to the counts, so no learnable text is left out.

Defined results: a null text, or one without a letter, is `und` with score 0 and rejected; with no
learned language every text is `und`, score 0, not rejected; ties go to the first language in
alphabetical order; rows with a null id are predicted, but not learned from; repeated rows count
and are returned each; other columns aren't read.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import exchange as X
from quarry.llm import kernel as K

ORDER = 4
ALPHABET = 1 << 16         # symbols are code points below this; 0 is the boundary
FAR, PLACES = 0xD800, 0xF900 - 0xD800      # letters beyond share these symbols, which stand for no letter themselves
UNKNOWN = "und"
HELD_OUT, CALIBRATION = 5, 25
HEATS = (1, 2, 5, 10, 20, 50, 100, 200)   # temperatures tried
LEAST_BOUND = 8.0          # in units of `spread`: about one nat for a text of 1,000 symbols
QUANTILE = 0.999           # of the deviations; at least the largest one is left out, where there are several
BIN = 0.05                 # width of the histogram's bins, in units of `spread`
MARGIN = 1.25              # the bound's slack over that quantile
_U = np.uint64
_LOW = [_U(0), *(_U((1 << 16 * n) - 1) for n in range(1, 5))]  # masks of the last n symbols
_LETTER: np.ndarray | None = None


def fold(id_col: str, n: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def _letters(cp: np.ndarray) -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)])
    return _LETTER[cp]


def grams(buf: np.ndarray, w: K.Words, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gram codes (4 symbols, 16 bits each) of the picked words, and for each the index in `pick`."""
    out = K.gather(buf, w.start[pick], w.end[pick])
    cp = np.frombuffer(out.tobytes().decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), np.uint32)
    word = np.cumsum(cp == 0x0A) - (cp == 0x0A)
    symbol = np.where(cp < ALPHABET, cp, FAR + cp % PLACES)
    code = np.where(_letters(cp), symbol, 0).astype(np.uint64)
    total, back = code.copy(), code
    for n in range(1, ORDER):                            # the symbol n before, if no boundary lies between
        back = np.concatenate([np.zeros(1, np.uint64), back[:-1]])
        back[1:][code[:-1] == 0] = 0
        total |= back << _U(16 * n)
    event = total & _LOW[2] != 0                         # a letter, or the end of a run of letters
    return total[event], word[event]


def _sums(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(code)
    at, _ = K.runs(code[order])
    return code[order][at], np.add.reduceat(n[order], at) if len(at) else n[:0]


_COUNTED = "lang string, bucket int, codes binary, counts binary"


def _counted(text_col: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for block in K.blocks(batches, text_col, **K.SMALL):
            t = K.texts(block.column(text_col))
            w = K.words(t, ends=True)
            names, lang = np.unique(np.array(block.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            of = lang[w.doc]
            for i, name in enumerate(names):
                mine = np.flatnonzero(of == i)
                order = mine[np.argsort(w.h[mine])]
                at, many = K.runs(w.h[order])
                code, word = grams(t.buf, w, order[at])
                have = total.get(name, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                code, n = _sums(code, many[word])
                total[name] = _sums(np.concatenate([have[0], code]), np.concatenate([have[1], n]))
        rows = []
        for name, (code, n) in total.items():
            for b, sel in X.by_bucket(X.bucket_of(K.mix(code), buckets), buckets):
                rows.append({"lang": name, "bucket": b, "codes": code[sel].tobytes(), "counts": X.planes(n[sel])})
        schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("codes", pa.binary()), ("counts", pa.binary())])
        yield from pa.Table.from_pylist(rows, schema).to_batches(max_chunksize=1024)
    return run


def _merged(table: pa.Table) -> pa.Table:
    code = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("codes").to_pylist()])
    n = np.concatenate([X.unplanes(x, np.int64) for x in table.column("counts").to_pylist()])
    code, n = _sums(code, n)
    return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(code), pa.string()),
                     "code": pa.array(code.view(np.int64)), "n": pa.array(n, pa.int64())})


def count_grams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, code, n): all grams of all rows."""
    buckets = X.bucket_count(docs, text_col)
    rows = docs.select(F.col(text_col), F.col(lang_col).alias("lang"))
    counted = rows.mapInArrow(_counted(text_col, buckets), _COUNTED)
    return X.table(counted.groupBy("lang", "bucket").applyInArrow(_merged, "lang string, code long, n long"), "grams")


def gathered(counted: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Each language's grams and their counts, on the driver."""
    rows = counted.toArrow()
    lang = rows.column("lang").combine_chunks().dictionary_encode()
    if isinstance(lang, pa.ChunkedArray):
        lang = lang.combine_chunks()
    code, n, of = rows.column("code").to_numpy().view(np.uint64), rows.column("n").to_numpy(), lang.indices.to_numpy()
    return {x: (code[of == i], n[of == i]) for i, x in enumerate(lang.dictionary.to_pylist())}


class Hashed:
    """A sorted array of hashed keys with a row of values each."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = K.mix(keys)
        order = np.argsort(h)
        self.h, self.values = h[order], values[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and the place of each."""
        h = K.mix(keys)
        at = np.minimum(np.searchsorted(self.h, h), max(0, len(self.h) - 1))
        return (self.h[at] == h if len(self.h) else np.zeros(len(h), bool)), at


class KneserNey:
    """One language's interpolated model: for each order, grams with discounted probabilities and
    contexts with the weight of the next lower order."""

    def __init__(self, code: np.ndarray, n: np.ndarray):
        self.grams: dict[int, Hashed] = {}
        self.contexts: dict[int, Hashed] = {}
        keys, count = code, n.astype(float)
        for order in range(ORDER, 0, -1):
            ones, twos = (count == 1).sum(), (count == 2).sum()
            d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
            d = min(d, 0.95 * count.min()) if len(count) else d
            context, of = np.unique(keys >> _U(16), return_inverse=True)
            total = np.bincount(of, count, len(context))
            kinds = np.bincount(of, minlength=len(context))
            self.grams[order] = Hashed(keys, ((count - d) / total[of])[:, None])
            self.contexts[order] = Hashed(context, (d * kinds / total)[:, None])
            keys, many = np.unique(keys & _LOW[order - 1], return_counts=True)   # continuation counts
            count = many.astype(float)

    def prob(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        if order == 0:
            return np.full(len(keys), 1 / ALPHABET)
        seen, at = self.grams[order].find(keys)
        own = np.where(seen, self.grams[order].values[at, 0], 0.0)
        seen, at = self.contexts[order].find(keys >> _U(16))
        weight = np.where(seen, self.contexts[order].values[at, 0], 1.0)
        return own + weight * self.prob(keys & _LOW[order - 1], order - 1)


class Model:
    """All languages' models over shared arrays."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.heat = 10.0
        self.mean: dict[str, float] = {}
        self.bound: dict[str, float] = {}
        if not self.langs:
            return
        own = [KneserNey(*counts[x]) for x in self.langs]
        self.grams, self.weights = {}, {}
        keys = np.unique(np.concatenate([counts[x][0] for x in self.langs]))
        for order in range(ORDER, 0, -1):
            self.grams[order] = Hashed(keys, np.log(np.stack([m.prob(keys, order) for m in own], 1)).astype(np.float32))
            context = np.unique(keys >> _U(16))
            weight = np.ones((len(context), len(own)))
            for j, m in enumerate(own):
                seen, at = m.contexts[order].find(context)
                weight[seen, j] = m.contexts[order].values[at[seen], 0]
            self.weights[order] = Hashed(context, np.log(weight).astype(np.float32))
            keys = np.unique(keys & _LOW[order - 1])

    def logs(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log-probability of each gram under each language."""
        if order == 0:
            return np.full((len(keys), len(self.langs)), -np.log(ALPHABET), np.float32)
        seen, at = self.grams[order].find(keys)
        out = self.grams[order].values[at]
        miss = np.flatnonzero(~seen)
        if len(miss):
            lower = self.logs(keys[miss] & _LOW[order - 1], order - 1)
            known, at = self.weights[order].find(keys[miss] >> _U(16))
            lower[known] += self.weights[order].values[at[known]]
            out[miss] = lower
        return out

    def entropies(self, t: K.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy (nats a symbol) of each text under each language, and its symbols."""
        w = K.words(t, ends=True)
        order = np.argsort(w.h)
        at, many = K.runs(w.h[order])
        word = np.empty(len(order), np.int64)
        word[order] = np.repeat(np.arange(len(at)), many)
        code, of = grams(t.buf, w, order[at])
        symbols = np.bincount(of, minlength=len(at))
        n = np.bincount(w.doc, symbols[word], len(t))
        out = np.zeros((len(t), len(self.langs)))
        logs = self.logs(code)
        for j in range(len(self.langs)):
            value = np.bincount(of, logs[:, j], len(at))
            out[:, j] = -np.bincount(w.doc, value[word], len(t)) / np.maximum(1, n)
        return out, n


def spread(n: np.ndarray) -> np.ndarray:
    """How far the cross-entropy of a text of n symbols strays, up to a factor."""
    return 0.05 + 2.5 / np.sqrt(np.maximum(1, n))


def _predicted(text_col: str, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for block in K.blocks(batches, text_col, **K.SMALL):
            h, n = m.entropies(K.texts(block.column(text_col))) if m.langs else (np.zeros((len(block), 0)), np.ones(len(block)))
            lang, score, entropy, bad = [UNKNOWN] * len(block), np.zeros(len(block)), np.zeros(len(block)), n == 0
            if m.langs:
                best = h.argmin(1)
                least = h[np.arange(len(h)), best]
                score = np.where(n > 0, 1 / np.exp(-np.minimum(700, (h - least[:, None]) * n[:, None] / m.heat)).sum(1), 0)
                entropy = np.where(n > 0, least, 0)
                lang = [m.langs[b] if k else UNKNOWN for b, k in zip(best, n)]
                mean = np.array([m.mean.get(x, np.inf) for x in m.langs])[best]
                bound = np.array([m.bound.get(x, np.inf) for x in m.langs])[best]
                bad = bad | ((n > 0) & np.isfinite(mean) & (least > mean + bound * spread(n)))
            yield from block.drop_columns([text_col]).append_column("lang_pred", pa.array(lang, pa.string())) \
                .append_column("score", pa.array(score, pa.float64())).append_column("entropy", pa.array(entropy, pa.float64())) \
                .append_column("n_symbols", pa.array(n, pa.int64())).append_column("rejected", pa.array(bad, pa.bool_())).to_batches()
    return run


def _accepted(text_col: str, model):
    judge = _predicted(text_col, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = [b.column("rejected") for b in judge(iter([batch.select([text_col])]))]
            if bad:
                yield batch.filter(pc.invert(pa.chunked_array(bad).combine_chunks()))
    return run


def accept(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """`docs` without the rejected rows, all columns kept."""
    return docs.mapInArrow(_accepted(text_col, model), docs.schema)


def _tried(text_col: str, model):
    """Calibration rows: cross-entropy under the label, whether it is the best language, and the
    loss at each temperature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for block in K.blocks(batches, text_col, **K.SMALL):
            h, n = m.entropies(K.texts(block.column(text_col)))
            labels = block.column("lang").to_pylist()
            use = np.flatnonzero([x in m.langs and k > 0 for x, k in zip(labels, n)])
            own = np.array([m.langs.index(labels[i]) for i in use], np.int64)
            gap = (h[use] - h[use, own][:, None]) * n[use, None]
            loss = [np.log(np.exp(np.minimum(700, -gap / t)).sum(1)) for t in HEATS]
            yield pa.record_batch({"lang": pa.array([labels[i] for i in use], pa.string()),
                                   "entropy": pa.array(h[use, own]), "n": pa.array(n[use], pa.float64()),
                                   "best": pa.array(h[use].argmin(1) == own, pa.bool_()),
                                   "loss": pa.array(np.stack(loss, 1).tolist() if len(use) else [], pa.list_(pa.float64()))})
    return run


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return _sums(np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts]))


def bounds(off: DataFrame) -> dict[str, float]:
    """Each language's bound from the deviations (lang, off) of all its calibration rows."""
    bins: dict[str, list[tuple[int, int]]] = {}
    for r in off.groupBy("lang", F.floor(F.col("off") / BIN).alias("bin")).count().collect():
        bins.setdefault(r["lang"], []).append((r["bin"], r["count"]))
    out = {}
    for lang, found in bins.items():
        edge, n = np.array(sorted(found)).T
        rank = max(1, int(QUANTILE * n.sum()))
        out[lang] = max(LEAST_BOUND, MARGIN * BIN * float(edge[np.searchsorted(np.cumsum(n), rank)] + 1))
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    """A broadcast Model from the labelled rows outside the held-out fold."""
    sc = docs.sparkSession.sparkContext
    rows = (docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, HELD_OUT) != 0))
            .withColumn("_try", fold(id_col, CALIBRATION) == 1))
    counts = gathered(count_grams(rows.filter("not _try"), text_col, lang_col))
    more = gathered(count_grams(rows.filter("_try"), text_col, lang_col))
    model = Model({x: added([c[x] for c in (counts, more) if x in c]) for x in counts | more})
    if not counts:
        return sc.broadcast(model)
    first = sc.broadcast(Model(counts))
    tried = X.table(rows.filter("_try").select(text_col, F.col(lang_col).alias("lang")).mapInArrow(
        _tried(text_col, first), "lang string, entropy double, n double, best boolean, loss array<double>"), "calibration")
    loss = tried.agg(*[F.avg(F.col("loss")[i]).alias(f"l{i}") for i in range(len(HEATS))]).first()
    if loss[0] is not None:
        model.heat = float(HEATS[int(np.argmin(loss))])
    agreed = tried.filter("best")
    model.mean = {r["lang"]: r["mean"] for r in agreed.groupBy("lang").agg(F.avg("entropy").alias("mean")).collect()}
    if model.mean:
        mean = F.create_map(*[F.lit(x) for kv in model.mean.items() for x in kv])
        off = (F.col("entropy") - mean[F.col("lang")]) / (0.05 + 2.5 / F.sqrt(F.greatest(F.lit(1.0), F.col("n"))))
        model.bound = bounds(agreed.select("lang", off.alias("off")))
    first.unpersist()
    return sc.broadcast(model)


def predict(docs: DataFrame, model, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The `keep` columns of every row with lang_pred, score (0 to 1), entropy, n_symbols and
    rejected."""
    rows = docs.select(*keep, text_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text_col)
    return rows.mapInArrow(_predicted(text_col, model), (fields + ", " if fields else "")
                           + "lang_pred string, score double, entropy double, n_symbols long, rejected boolean")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from `docs` and predict all of it: the query's columns."""
    out = predict(docs, train(docs, id_col, text_col, lang_col), text_col, (id_col,))
    return out.select(id_col, F.coalesce(fold(id_col, HELD_OUT) == 0, F.lit(False)).alias("held_out"),
                      "lang_pred", "score", "entropy", "n_symbols", "rejected")

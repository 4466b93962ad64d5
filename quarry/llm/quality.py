"""Quality classifier by hierarchical empirical Bayes (operator 2).

Three kinds of evidence meet in one score. A logistic regression over hashed words and a few shape
numbers gives each text a probability; it is fitted on at most ``SAMPLE`` labelled texts (one of
each class of a hash of the id). Grouped sums over all rows give each host, and each path below it, counts of good
and bad texts: a label counts 1, the classifier's probability of an unlabelled text ``SOFT``. Hosts
shrink toward the global mean, paths toward their host; how strongly is estimated from the spread
of the groups (method of moments), so sparse sites stay near the prior and large ones speak for
themselves. A row's own evidence is taken out of its groups. The score adds, in log-odds, the
text's evidence and how far its path lies from the global mean.

Only narrow rows are grouped and joined: sums per host and per path combine on the map side,
whatever share of all rows one host holds; the sums are broadcast up to a checked number of groups.

Defined results: a null text is empty; null hosts and paths count as the empty string; a text with
several labels is good if all of them say so; null labels and ids don't count; rows of one id share
their label and are returned each; with no labels, or of one kind only, the classifier says the
share of good labels (or 0.5) for all; no rows give no rows; other columns aren't read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import exchange as X
from quarry.llm import kernel as K

SAMPLE = 5_000            # labelled texts that the classifier is fitted on, at most
SLOTS = 1024              # hash slots of words
SHAPES = 8
SOFT = 0.25               # weight of an unlabelled text's probability in its groups
RIDGE = 1e-3
GOOD = 0.5                # least score of a kept text

_CLASS = np.zeros(256, np.int8)          # 1 symbols, 2 digits, 3 capitals
_CLASS[list(b"#*$%&|<>{}[]\\^~=_")] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[0x41:0x5B] = 3


def vectors(t: K.Texts) -> np.ndarray:
    """Hashed words (log counts, unit length) and shape numbers of each text."""
    n, w = len(t), K.words(t)
    slot = (w.h >> np.uint64(32)).astype(np.int64) % SLOTS
    x = np.zeros((n, SLOTS + SHAPES + 1), np.float32)
    x[:, :SLOTS] = np.log1p(np.bincount(w.doc * SLOTS + slot, minlength=n * SLOTS)).reshape(n, SLOTS)
    x[:, :SLOTS] /= np.maximum(1e-6, np.sqrt((x[:, :SLOTS] ** 2).sum(1, keepdims=True)))
    size, count = np.maximum(1, np.diff(t.off)), np.maximum(1, w.count)
    at, h = K.windows(w.h, w.doc, 5)
    pairs = np.lexsort((h, w.doc[at]))
    twin = (np.diff(w.doc[at][pairs]) == 0) & (np.diff(h[pairs]) == 0)
    shapes = [K.per_text(_CLASS[t.buf] == k, t.off) / size for k in (1, 2, 3)]
    shapes += [K.per_text(t.buf == 0x0A, t.off) / count, size / count / 10, np.log1p(count) / 8,
               np.bincount(w.doc[at][pairs][1:][twin], minlength=n) / count, K.per_text(t.buf == 0x7C, t.off) / count]
    x[:, SLOTS:SLOTS + SHAPES] = np.stack(shapes, 1)
    x[:, -1] = 1
    return x


def fit(x: np.ndarray, y: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weights of a ridge logistic regression, by accelerated gradient steps."""
    w = np.zeros(x.shape[1])
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    w[-1] = np.log(share / (1 - share))
    if not len(y) or y.min() == y.max():
        return w
    x = x.astype(float)
    rate = 4 / (np.linalg.norm(x, 2) ** 2 / len(y) + RIDGE)
    v, before = w.copy(), w
    for k in range(steps):
        p = 1 / (1 + np.exp(-(x @ v)))
        w = v - rate * (x.T @ (p - y) / len(y) + RIDGE * v * (np.arange(len(v)) < len(v) - 1))
        v, before = w + k / (k + 3) * (w - before), w
    return w


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in K.blocks(batches, "text"):
        x = vectors(K.texts(block.column("text")))
        yield from pa.table({"y": block.column("y").cast(pa.int32()),
                             "x": pa.array([r.tobytes() for r in x], pa.binary())}).to_batches()


def _judged(text_col: str, weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in K.blocks(batches, text_col, rows=1024):
            p = 1 / (1 + np.exp(-(vectors(K.texts(block.column(text_col))).astype(float) @ weights.value)))
            yield from block.drop_columns([text_col]).append_column(
                "p_doc", pa.array(np.round(np.clip(p, 1e-4, 1 - 1e-4), 6))).to_batches()
    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str):
    """Broadcast weights of the text classifier. `labels`: (_id, y), one row for each id."""
    least = F.min(F.struct(F.xxhash64("_id").alias("h"), "_id", "y")).alias("least")
    sample = labels.groupBy(F.pmod(F.xxhash64("_id"), F.lit(SAMPLE))).agg(least).select("least._id", "least.y")
    rows = (docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
            .join(F.broadcast(sample), "_id").select("text", "y")     # SAMPLE rows at most
            .mapInArrow(_vectors, "y int, x binary").toArrow())
    y = rows.column("y").to_numpy().astype(float)
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(len(y), SLOTS + SHAPES + 1)
    return docs.sparkSession.sparkContext.broadcast(fit(x, y) if len(y) else fit(np.zeros((0, SLOTS + SHAPES + 1)), y))


def strength(groups: DataFrame, prior: str, n: str, s: str) -> float:
    """Prior strength m (in texts) of groups whose means scatter around `prior`, by moments: the
    excess of the scatter over the binomial's gives the spread of the groups' true means."""
    mean = F.col(s) / F.col(n)
    r = groups.filter(F.col(n) > 0).agg(
        F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(F.col(n) * (mean - F.col(prior)) ** 2).alias("scatter"),
        F.sum(F.col(prior) * (1 - F.col(prior))).alias("noise"),
        F.sum(F.col(n) * F.col(prior) * (1 - F.col(prior))).alias("top")).first()
    if not r["k"] or not r["top"]:
        return 10.0
    spread = max((r["scatter"] - r["noise"]) / r["n"], 1e-6)       # variance of true means
    return float(np.clip(r["top"] / r["n"] / spread - 1, 1.0, 1e5))


def _logit(c: Column) -> Column:
    return F.log(c / (1 - c))


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality", held_out: Column | None = None) -> DataFrame:
    """Every row's id, host, path, p_doc, p_host, p_path, score and kept. `labels` has ids and a
    label that is 1 for good texts; labels of ids where `held_out` holds aren't used."""
    y = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if held_out is not None:
        y = y.filter(~held_out)
    y = (y.groupBy(F.col(id_col).cast("long").alias("_id")).agg((F.min(label_col) == 1).cast("int").alias("y")))
    y = X.table(y, "labels")
    weights = train(docs, y, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(host, F.lit("")).alias("host"),
                       F.coalesce(path, F.lit("")).alias("path"), F.col(text_col))
    rows = rows.mapInArrow(_judged(text_col, weights), "_id long, host string, path string, p_doc double")
    rows = X.table(rows.join(y, "_id", "left")
                   .withColumn("_n", F.when(F.col("y").isNull(), SOFT).otherwise(1.0))
                   .withColumn("_s", F.col("_n") * F.coalesce(F.col("y").cast("double"), "p_doc")), "judged")
    paths = X.table(rows.groupBy("host", "path").agg(F.sum("_n").alias("path_n"), F.sum("_s").alias("path_s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("path_n").alias("host_n"), F.sum("path_s").alias("host_s"))
    total = hosts.agg(F.sum("host_n"), F.sum("host_s")).first()
    mean = min(max((total[1] or 0.0) / total[0], 1e-3), 1 - 1e-3) if total[0] else 0.5
    hosts = X.table(hosts.withColumn("prior", F.lit(mean)), "hosts")
    by_host = strength(hosts, "prior", "host_n", "host_s")
    p_host = lambda n, s: (s + by_host * mean) / (n + by_host)
    tree = paths.join(hosts.drop("prior"), "host")
    tree = X.table(tree.withColumn("prior", p_host(F.col("host_n"), F.col("host_s"))), "tree")
    by_path = strength(tree, "prior", "path_n", "path_s")
    out = rows.join(X.small(tree.drop("prior")), ["host", "path"])
    out = out.withColumn("p_host", p_host(F.col("host_n") - F.col("_n"), F.col("host_s") - F.col("_s")))
    out = out.withColumn("p_path", (F.col("path_s") - F.col("_s") + by_path * F.col("p_host")) / (F.col("path_n") - F.col("_n") + by_path))
    odds = _logit(F.col("p_doc")) + _logit(F.least(F.greatest("p_path", F.lit(1e-4)), F.lit(1 - 1e-4))) - float(np.log(mean / (1 - mean)))
    out = out.withColumn("score", F.round(1 / (1 + F.exp(-odds)), 6))
    return out.select(F.col("_id").alias(id_col), "host", "path", "p_doc", F.round("p_host", 6).alias("p_host"),
                      F.round("p_path", 6).alias("p_path"), "score", (F.col("score") >= GOOD).alias("kept"))

"""Near duplicates: one-permutation MinHash with optimal densification, banded buckets,
star-shaped candidate edges, links confirmed on full shingle sets (operator 4).

1. ``signatures``: each text's distinct word shingles are hashed once; the hash deals a shingle to
   one of ``BINS`` bins, whose minimum is the signature's value. An empty bin takes the value of the
   first occupied bin on its own random walk (optimal densification). ``ROWS`` values make a band.
2. Texts with the same shingle set are one class, known by its smallest id; the rest works on
   classes, so exact copies cost nothing more, however many there are.
3. Classes that agree on a whole band share a bucket. In each bucket with several classes, the
   others are compared with a centre only: the candidate edges form stars, not all pairs. Edges are
   compared on the full sets: those of similarity 0.75 are links, those of 0.5 make a family.
4. What a single star would miss is found exactly. By the triangle inequality of the Jaccard
   distance, a text that isn't in the centre's family can't be linked with a text linked to the centre.
   So centres and texts linked to them leave the bucket, and where two families remain, new centres
   are chosen, the best connected first and sixteen times as many as before, until none do. Pairs in
   one family that no star has tested are settled last: families with several components are cut
   into chunks, tasks compare two chunks by counting shared shingles, and return one link for each
   pair of components. No link between candidates is lost, and no group's pairs become rows.

Two sets of similarity 0.75 miss each other in every band with a chance of 8e-6 at most
((1 - 0.75^8)^112), of 0.8 with 2e-9; of similarity 0.3 they meet with a chance of 0.7 %.

Skew: a band shared by a third of all classes is found from one entry for each task; the number of buckets
follows the classes; centres are chosen by a top-k that starts in each task (in two stages beyond what Spark
limits there); joins of members with centres are on (bucket) with one row for each centre, which adaptive
execution splits. Texts move only where a class has met another, whole rows only where they are dropped or
share an id: a bitmap of these ids (of fixed size) keeps the others out of the exact joins.

Defined results: a null or empty text has no shingles and is linked with nothing; fewer words
than a shingle make one shingle; rows of one id are one node; a row with a null id has a null component
and is kept; of the rows of one id, ``deduplicate`` keeps that with the smallest hash of its text; no rows give
no rows; other columns aren't read.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import exchange as X
from quarry.llm import kernel as K

SHINGLE = 5
PERCENT = 75              # similarity, in percent
BINS, ROWS = 896, 8       # 112 bands of 8 values
BANDS = BINS // ROWS
CLOSE = 50                # similarity, in percent, that puts texts into one family
CHUNK = 300_000           # shingles of a chunk of a family, about
ENTRIES = 2_000_000       # (class, band) entries of a bucket, about
LIMIT = 1000              # centres up to which Spark limits a window's rows before the shuffle
PLACES = 1 << 17          # words of the bitmaps of ids (1 MB)
LEAST = 3                 # sets of one or two shingles have no unequal set of similarity 0.75
_U = np.uint64
_SEED = K.mix(np.arange(1, 3, dtype=np.uint64))
_BAND_SEED = K.mix(np.arange(100, 100 + BANDS, dtype=np.uint64))


def shingles(t: K.Texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every shingle (with repeats), A-Z as a-z."""
    w = K.words(t, fold=True)
    at, h = K.windows(w.h, w.doc, size)
    docs, hashes = [w.doc[at]], [h]
    for k in range(1, size):                      # a shorter text is one shingle
        short = np.flatnonzero(w.count == k)
        if len(short):
            at = (w.first[short][:, None] + np.arange(k)).reshape(-1)
            docs.append(short)
            hashes.append(K.windows(w.h[at], np.repeat(short, k), k)[1])
    return np.concatenate(docs), np.concatenate(hashes)


@lru_cache(256)
def _walk(attempt: int) -> np.ndarray:
    """Where each bin looks at this attempt."""
    return (K.mix(np.arange(BINS, dtype=np.uint64) + _U(attempt * BINS + 7919)) % _U(BINS)).astype(np.int64)


def densify(value: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Fill the empty bins of each row from its occupied ones, each bin on its own walk."""
    row, col = np.nonzero(~full & full.any(1)[:, None])
    attempt = 0
    while len(row):
        source = _walk(attempt)[col]
        found = full[row, source]
        value[row[found], col[found]] = value[row[found], source[found]]
        row, col, attempt = row[~found], col[~found], attempt + 1
    return value


def _signed(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in K.blocks(batches, text_col, **K.SMALL):
            n = len(block)
            doc, h = shingles(K.texts(block.column(text_col)))
            x = h >> _U(12)                                   # 52 bits tell the shingles of a text apart
            bins = x % _U(BINS)
            packed = K.distinct((doc.astype(np.uint64) << _U(53)) | (bins << _U(43)) | (x // _U(BINS)))
            doc = (packed >> _U(53)).astype(np.int64)
            bin_ = ((packed >> _U(43)) & _U(1023)).astype(np.int64)
            val = packed & _U((1 << 43) - 1)
            count = np.bincount(doc, minlength=n)
            first = np.concatenate([[0], np.cumsum(count)])
            whole = val * _U(BINS) + bin_.astype(np.uint64)
            prints = np.zeros((2, n), np.int64)
            for i in range(2):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(whole ^ _SEED[i]))])
                prints[i] = (total[first[1:]] - total[first[:-1]]).view(np.int64)
            value, full = np.zeros((n, BINS), np.uint64), np.zeros((n, BINS), bool)
            least, _ = K.runs(packed >> _U(43))               # the first of each (text, bin) is its minimum
            value[doc[least], bin_[least]] = whole[least]
            full[doc[least], bin_[least]] = True
            densify(value, full)
            key = np.broadcast_to(_BAND_SEED, (n, BANDS)).copy()
            for j in range(ROWS):
                key = K.mix(key ^ value[:, j * BANDS:(j + 1) * BANDS])
            yield from pa.table({
                "id": block.column("id").cast(pa.int64()), "n": pa.array(count, pa.int64()),
                "p1": pa.array(prints[0]), "p2": pa.array(prints[1]),
                "bands": pa.array([k.tobytes() if c >= LEAST else None for k, c in zip(key, count)], pa.binary())
            }).to_batches()
    return run


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, p1, p2, bands): set size, set fingerprint (128 bits) and band keys of each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col))
    return rows.mapInArrow(_signed(text_col), "id long, n long, p1 long, p2 long, bands binary")


_DEALT = "bucket int, known boolean, entries binary"


def _dealt(buckets: int):
    """Task: (band key, class) entries. Of a key with several classes here, all are members for
    certain; one more entry asks for classes elsewhere."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("known", pa.bool_()), ("entries", pa.binary())])
        held, size = [], 0

        def dealt():
            ids = np.concatenate([b.column(0).to_numpy() for b in held])
            n = np.concatenate([b.column(1).to_numpy() for b in held])
            key = np.concatenate([np.frombuffer(x, np.uint64) for b in held for x in b.column(2).to_pylist()])
            order = np.argsort(key, kind="stable")
            key, who = key[order], order // BANDS
            at, many = K.runs(key)
            e = np.empty((len(key), 4), np.uint64)
            e[:, 0], e[:, 1], e[:, 2] = key, ids[who].view(np.uint64), n[who].view(np.uint64)
            e[:, 3] = np.repeat(many, many) > 1
            out = []
            several = np.flatnonzero(e[:, 3])
            spread = K.mix(key[several] ^ e[several, 1])          # a hot key's members go to all buckets
            for known, rows, h in ((False, at, K.mix(key[at])), (True, several, spread)):
                for b, sel in X.by_bucket(X.bucket_of(h, buckets), buckets):
                    out.append({"bucket": b, "known": known, "entries": X.planes(e[rows[sel]].reshape(-1))})
            return pa.Table.from_pylist(out, schema).to_batches(max_chunksize=256)

        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= 8192:
                yield from dealt()
                held, size = [], 0
        if size:
            yield from dealt()
    return run


def _met(table: pa.Table) -> pa.Table:
    """Bucket of keys: the classes of each key that has two or more."""
    rows = {True: [np.zeros((0, 4), np.uint64)], False: [np.zeros((0, 4), np.uint64)]}
    for r in table.to_pylist():
        rows[r["known"]].append(X.unplanes(r["entries"], np.uint64).reshape(-1, 4))
    asked, known = np.concatenate(rows[False]), np.concatenate(rows[True])
    asked = asked[np.argsort(asked[:, 0], kind="stable")]
    _, many = K.runs(asked[:, 0])
    asked = asked[(np.repeat(many, many) > 1) & (asked[:, 3] == 0)]     # of the others, all are known
    e = np.concatenate([asked, known]).view(np.int64)
    return pa.table({"key": e[:, 0].copy(), "id": e[:, 1].copy(), "n": e[:, 2].copy()})


def members(classes: DataFrame) -> DataFrame:
    """(key, id, n) of every band bucket with two classes or more."""
    buckets = max(2 * X.shuffle_partitions(classes.sparkSession), classes.count() * BANDS // ENTRIES)
    dealt = classes.select("id", "n", "bands").filter("bands is not null").mapInArrow(_dealt(buckets), _DEALT)
    return dealt.groupBy("bucket").applyInArrow(_met, "key long, id long, n long")


def _packed(column: pa.ChunkedArray, low: int = 0) -> np.ndarray:
    """Distinct (text number, shingle) of a column in one sorted array of 64 bits: 11 for the
    number, 52 for the shingle, and a bit set to `low`."""
    doc, h = shingles(K.texts(column))
    return K.distinct((doc.astype(np.uint64) << _U(53)) | ((h >> _U(12)) << _U(1)) | _U(low))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of texts: sizes of the intersection and the union of their shingle sets."""
    for block in K.blocks(batches, "text_b", rows=1024, size=4 << 20):
        both = np.sort(np.concatenate([_packed(block.column(x), low=i) for i, x in enumerate(("text_a", "text_b"))]))
        doc = (both >> _U(53)).astype(np.int64)
        same = (both[1:] >> _U(1)) == (both[:-1] >> _U(1))
        shared = np.bincount(doc[1:][same], minlength=len(block))
        union = np.bincount(doc, minlength=len(block)) - shared
        yield from block.select(["a", "b"]).append_column("shared", pa.array(shared)).append_column("union", pa.array(union)).to_batches()


def compare(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """`edges` (a, b) with the sizes of intersection and union of their texts' full sets."""
    a, b = (texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return (edges.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")
            .mapInArrow(_compared, "a long, b long, shared long, union long"))


def _turned(edges: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """(a, b) rows from several pairs of columns of each row."""
    rows = F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs])
    return edges.select(F.explode(rows).alias("e")).select("e.a", "e.b")


def _both_ways(edges: DataFrame) -> DataFrame:
    return _turned(edges, ("a", "b"), ("b", "a"))


def _starred(edges: DataFrame) -> DataFrame:
    """`edges` with the smallest b (m) of each a."""
    return edges.join(edges.groupBy("a").agg(F.min("b").alias("m")), "a")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of `edges` (a, b) reaches, by alternating
    stars until every node points to a root."""
    e = X.compact(X.table(edges.select("a", "b").filter("a <> b").distinct(), "edges"))
    while True:
        large = _starred(_both_ways(e)).withColumn("m", F.least("a", "m"))
        up = large.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = _starred(up)
        e = X.compact(X.table(_turned(small, ("b", "m"), ("a", "m")).filter("a <> b").distinct(), "edges"))
        # done when no node is both below a root and a root, or below two
        ends = F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("up")), F.struct(F.col("b").alias("x"), F.lit(0).alias("up"))))
        node = (e.select(ends.alias("n")).groupBy("n.x").agg(F.sum("n.up").alias("up"), F.min("n.up").alias("least")))
        if node.filter("up > 1 or (up = 1 and least = 0)").isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _within(table: pa.Table) -> pa.Table:
    """Two chunks of one family: one link for each pair of roots that have any. Shingles that many
    texts hold are counted by a product of incidence matrices, the others by their pairs."""
    n = table.num_rows
    root = table.column("root").to_numpy()
    parts = [_packed(table.column("text").slice(lo, 1024)) for lo in range(0, n, 1024)]
    doc = np.concatenate([(p >> _U(53)).astype(np.int64) + 1024 * i for i, p in enumerate(parts)])
    size = np.bincount(doc, minlength=n)
    shingle = np.concatenate(parts) & _U((1 << 53) - 1)
    order = np.argsort(shingle, kind="stable")
    doc = doc[order]
    at, many = K.runs(shingle[order])
    shared = np.zeros((n, n), np.float32)
    often = np.flatnonzero(many >= 16)
    for lo in range(0, len(often), 4096):
        some = often[lo:lo + 4096]
        holds = np.zeros((n, len(some)), np.float32)
        length = many[some]
        slot = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(at[some], length)
        holds[doc[slot], np.repeat(np.arange(len(some)), length)] = 1
        shared += holds @ holds.T
    for k in range(2, 16):
        start = at[many == k]
        if len(start):
            i, j = np.triu_indices(k, 1)              # texts of a run are in order: pairs above the diagonal
            pair = doc[start[:, None] + i] * n + doc[start[:, None] + j]
            shared += np.bincount(pair.reshape(-1), minlength=n * n).reshape(n, n)
    shared = np.triu(shared, 1)
    x, y = np.nonzero(100 * shared >= PERCENT * (size[:, None] + size[None, :] - shared))
    apart = (x < y) & (root[x] != root[y])
    links = np.unique(np.sort(np.stack([root[x[apart]], root[y[apart]]], 1), axis=1), axis=0).reshape(-1, 2)
    return pa.table({"a": pa.array(links[:, 0].copy(), pa.int64()), "b": pa.array(links[:, 1].copy(), pa.int64())})


def families(near: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links between the components `roots` (id, root) that lie in one family, i.e. are
    connected by `near`. Families are cut into chunks of about ``CHUNK`` shingles; a task compares
    two chunks."""
    family = components(near).select(F.col("node").alias("id"), F.col("root").alias("family"))
    of = family.join(roots, "id", "left").select("id", "family", F.coalesce("root", "id").alias("root"))
    mixed = of.groupBy("family").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("family")
    of = of.join(mixed, "family", "left_semi")
    size = texts.select("id", F.greatest(F.col("n"), F.lit(CHUNK // 750)).alias("n"))   # 750 texts of a chunk at most, about
    of = X.table(of.join(size, "id"), "families")
    part = of.groupBy("family", "root").agg(F.sum("n").alias("own"))
    # a large component has chunks of its own, which needn't be compared with each other
    part = part.withColumn("of", F.when(F.col("own") >= CHUNK // 4, F.col("root")))
    chunks = part.groupBy("family", "of").agg(F.ceil(F.sum("own") / CHUNK).alias("k"))
    chunks = X.table(chunks, "chunks")
    large = F.col("of").eqNullSafe(F.col("o"))
    dealt = (of.join(part.select("family", "root", "of"), ["family", "root"])
             .join(chunks.select(F.col("family").alias("f"), F.col("of").alias("o"), "k"), (F.col("family") == F.col("f")) & large)
             .select("id", "root", "family", "of", F.pmod(F.xxhash64("id"), F.col("k")).alias("chunk")))
    every = chunks.select("family", "of", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("chunk"))
    every = every.withColumn("name", F.struct(F.coalesce("of", F.lit(-1)), "chunk", F.col("of").isNull()))
    other = every.select("family", F.col("of").alias("of2"), F.col("name").alias("name2"))
    pairs = (every.join(other, "family").filter("name <= name2 and (of is null or of2 is null or of <> of2)")
             .select("family", "of", "chunk", F.xxhash64("family", "name", "name2").alias("pair"), "name", "name2"))
    # each side of a pair takes its chunk; a pair of one chunk with itself takes it once
    sides = pairs.select("family", F.explode(F.array_distinct(F.array("name", "name2"))).alias("name"), "pair")
    rows = (dealt.withColumn("name", F.struct(F.coalesce("of", F.lit(-1)), "chunk", F.col("of").isNull()))
            .join(sides, ["family", "name"]).select("pair", "id", "root")
            .join(texts.select("id", "text"), "id").select("pair", "root", "text"))
    return rows.groupBy("pair").applyInArrow(_within, "a long, b long").distinct()


def _centres(m: DataFrame, most: int) -> DataFrame:
    """The `most` best connected members of each key."""
    order = [F.col("near").desc(), "id"]
    if most > LIMIT:      # first of parts of each key, so that no task sorts a hot key
        spread = m.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(X.shuffle_partitions(m.sparkSession))))
        m = spread.withColumn("r", F.row_number().over(Window.partitionBy("key", "s").orderBy(*order))).filter(F.col("r") <= most).drop("s", "r")
    return m.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(*order))).filter(F.col("r") <= most)


def link(texts: DataFrame, buckets: DataFrame) -> DataFrame:
    """(id, root) of the classes in `buckets` that have links; see the module's doc. Between rounds a
    class carries the smallest label that near neighbours have told it: equal labels mean one
    family."""
    m = X.table(buckets.withColumn("label", F.col("id")).withColumn("near", F.lit(0).cast("long")), "members")
    labels = X.compact(texts.select("id")).select("id", F.col("id").alias("label"), F.lit(0).cast("long").alias("near"))
    tried, centres = None, 1
    while True:
        centre = X.compact(X.table(_centres(m, centres)
            .select("key", F.col("id").alias("c"), F.col("n").alias("cn"), F.col("label").alias("cl")), "centres"))
        star = X.compact(X.table(m.join(centre, "key")
                .filter((F.col("label") != F.col("cl")) & (100 * F.least("n", "cn") >= CLOSE * F.greatest("n", "cn")))
                .select("key", "id", F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")), "star"))
        edges = star.select("a", "b").distinct()
        if tried is not None:
            edges = edges.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        done = X.compact(X.table(compare(edges, texts), "compared"))
        tried = done if tried is None else X.compact(X.table(tried.unionAll(done), "tried"))
        told = (_both_ways(done.filter(_near())).join(labels.select(F.col("id").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("label").alias("least"), F.count("*").alias("more")))
        labels = X.compact(X.table(labels.join(told, "id", "left").select(
            "id", F.least("label", "least").alias("label"), (F.col("near") + F.coalesce("more", F.lit(0))).alias("near")), "labels"))
        linked = done.filter(_linked()).select("a", "b")
        own = centre.select("key", F.col("c").alias("id"))
        over = star.join(linked, ["a", "b"], "left_semi").select("key", "id")
        rest = (m.select("key", "id", "n").join(own, ["key", "id"], "left_anti").join(over, ["key", "id"], "left_anti")
                .join(labels, "id"))
        open_ = rest.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")
        m = X.compact(X.table(rest.join(open_, "key", "left_semi"), "members"))
        if m.isEmpty():
            break
        centres *= 16
    links = components(tried.filter(_linked()).select("a", "b"))
    roots = links.select(F.col("node").alias("id"), "root")
    more = X.table(families(tried.filter(_near()).select("a", "b"), roots, texts), "links")
    if more.isEmpty():
        return roots
    # components that a family has joined; a text without links was its own
    joined = components(more).select(F.col("node").alias("root"), F.col("root").alias("to"))
    every = roots.unionAll(more.select(F.explode(F.array("a", "b")).alias("id")).distinct()
                           .join(roots.select("id"), "id", "left_anti").select("id", F.col("id").alias("root")))
    return every.join(joined, "root", "left").select("id", F.coalesce("to", "root").alias("root"))


def _near():
    return 100 * F.col("shared") >= CLOSE * F.col("union")


def _linked():
    return 100 * F.col("shared") >= PERCENT * F.col("union")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: id, n_shingles, component_id (smallest id reachable over links) and kept
    (the row's id is its component)."""
    signed = X.table(signatures(docs, id_col, text_col), "signatures")
    sets = signed.filter("n > 0 and id is not null")
    least = sets.groupBy("p1", "p2", "n").agg(F.min(F.struct("id", "bands")).alias("least"))
    classes = X.table(least.select("p1", "p2", "n", "least.id", "least.bands"), "classes")
    buckets = X.table(members(classes), "buckets")
    wanted = X.table(buckets.select("id", "n").distinct(), "wanted")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = X.with_marked(rows, "id", X.bitmap(wanted, "id", PLACES), PLACES, "marked").filter("marked").drop("marked")
    texts = X.table(rows.join(wanted, "id").dropDuplicates(["id"]), "texts")
    roots = link(texts, buckets)
    found = (classes.select("p1", "p2", "n", "id").join(roots, "id", "left")
             .select("p1", "p2", "n", F.coalesce("root", "id").alias("component_id")))
    out = signed.select("id", "n", "p1", "p2").join(found, ["p1", "p2", "n"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id"))
    return (out.withColumn("component_id", F.when(F.col("id").isNotNull(), component))
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                    F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each component, its smallest id; of repeated rows of one id, one.
    Rows with a null id stay. All columns kept."""
    p = X.unused(docs, "_near")
    node, mark, kept, r = F.col(f"{p}_id"), F.col(f"{p}_marked"), F.col(f"{p}_kept"), f"{p}_r"
    near = near_duplicates(docs, id_col, text_col).filter(F.col(id_col).isNotNull())
    odd = near.groupBy(F.col(id_col).alias(f"{p}_id")).agg(F.min("kept").alias(f"{p}_kept"), F.count("*").alias("n"))
    odd = X.table(odd.filter((F.col("n") > 1) | ~kept).drop("n"), "odd")
    rows = docs.withColumn(f"{p}_id", F.col(id_col).cast("long"))
    rows = X.with_marked(rows, f"{p}_id", X.bitmap(odd, f"{p}_id", PLACES), PLACES, f"{p}_marked")
    marked = F.coalesce(mark, F.lit(False)) & node.isNotNull()
    one = Window.partitionBy(node).orderBy(F.xxhash64(text_col))
    some = rows.filter(marked).join(odd, f"{p}_id", "left").filter(F.coalesce(kept, F.lit(True))).withColumn(r, F.row_number().over(one)).filter(F.col(r) == 1)
    return rows.filter(~marked).select(*docs.columns).unionAll(some.select(*docs.columns))

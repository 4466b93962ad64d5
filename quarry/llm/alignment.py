"""Alignment of two tokenizers by an associative monoid of fragments (operator 12).

Byte offsets at which tokens of both vocabularies end cut a text's tokens into groups. A *fragment* is
what a byte range knows of that: the tokens that end in it, A's and B's, and the sizes of

    open prefix, closed groups ..., open suffix

(one entry, both prefix and suffix, if no common end lies in the range). Composing two fragments joins
the first one's suffix with the second one's prefix and keeps the rest; [0] is neutral, and the operation
is associative, so fragments of adjacent ranges may be composed in any bracketing. A whole text's fragment
has its first group as prefix and an empty suffix.

Texts of up to ``CHUNK`` bytes are one fragment, made where they are read. Of longer ones, the reading
task sends the tokens of each byte range as a row; other tasks turn ranges into fragments and compose
them, ``FAN`` neighbours at a time, in rounds of a tree until one fragment is left of each text. A text is
tokenised in slices (cut at plain spaces, see `encoding`), so no task holds the library's objects for all of it.

A *link* is a pair of an A and a B occurrence in one group. Counts of id pairs are numbers of documents
that hold the pair linked. A task reduces the links of a block of texts to the distinct pairs of each
document and of the block, sends the block's pairs with their document counts to buckets of A ids, and
writes the documents' pairs as places in the block's list. A bucket has all pairs of its A ids: it adds up
counts, finds each A id's highest, and answers every block once. The blocks then sum over their documents.
A pair that every document holds so makes one entry for each block, and nothing is broadcast.

Defined results: null and empty texts, and texts whose tokens' bytes, joined, differ from a space and
the text (for example with the space sign itself in them), have no tokens: zeros and '', and no part in
counts; every row is a document of its own, also with an id that is null or repeated; ties of the highest
count are all best; no rows give no rows; other columns aren't read. Memory: a block of ``BLOCK`` bytes, and
for a very long text its ids at the top of the tree (8 to 16 bytes a token).
"""
from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import encoding as E
from quarry.llm import exchange as X
from quarry.llm import kernel as K

CHUNK = 64 << 10       # bytes of a range of a longer text
FAN = 8                # fragments composed by a task of the tree
BLOCK = 2 << 20        # bytes of texts of a block
LINKS = 1 << 19        # links, or tokens, listed at a time
LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1}      # rows of some MB: look at the size after each
WIDE = 64              # groups with more links are listed by distinct ids


# ---------------------------------------------------------------- fragments

@dataclass
class Fragment:
    """Ids in order; ``sizes`` has a row (A tokens, B tokens) for the open prefix, each closed group
    and the open suffix, or one row if no common end lies in the range."""

    a: np.ndarray
    b: np.ndarray
    sizes: np.ndarray


def of_range(a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> Fragment:
    """The fragment of the tokens that end in a byte range, from their ends."""
    common = np.intersect1d(a_end, b_end, assume_unique=True)
    cut = [np.concatenate([[0], np.searchsorted(end, common, "right"), [len(end)]]) for end in (a_end, b_end)]
    return Fragment(a, b, np.diff(np.stack(cut, 1), axis=0))


def compose(fragments: list[Fragment]) -> Fragment:
    """The fragment of adjacent ranges, from left to right."""
    sizes = [fragments[0].sizes]
    for f in fragments[1:]:
        last = sizes[-1].copy()
        last[-1] += f.sizes[0]
        sizes[-1:] = [last, f.sizes[1:]] if len(f.sizes) > 1 else [last]
    return Fragment(np.concatenate([f.a for f in fragments]), np.concatenate([f.b for f in fragments]), np.concatenate(sizes))


# ---------------------------------------------------------------- a block of whole texts

@dataclass
class Aligned:
    """Texts of a block in order: ids, group sizes, and where each text's tokens and groups begin
    (n + 1 each). Texts without tokens have none."""

    a: np.ndarray
    b: np.ndarray
    sizes: np.ndarray
    a_first: np.ndarray
    b_first: np.ndarray
    g_first: np.ndarray


def _tokens(t: K.Texts, files) -> tuple[E.Tokens, E.Tokens, np.ndarray]:
    """A's and B's tokens of texts that begin with a space, and for which of them both give the text."""
    a, b = E.byte_ids(t, files.value[0], plain=True), E.piece_ids(t, files.value[1])
    good = E.same_bytes(t, a, E.byte_entries(files.value[0])) & E.same_bytes(t, b, E.piece_entries(files.value[1]))
    return a, b, good


def _ends(got: E.Tokens, size: np.ndarray) -> np.ndarray:
    """Byte after each token, counted from the first token of all."""
    return np.cumsum(size[got.ids])


def _spaced(column: pa.ChunkedArray) -> K.Texts:
    """A space and the text; null and empty texts stay empty."""
    text = pc.fill_null(column.cast(pa.large_string()), "")
    return K.texts(pc.if_else(pc.equal(text, ""), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, pa.scalar("", pa.large_string()))))


def _of_good(got: E.Tokens, good: np.ndarray) -> E.Tokens:
    n = np.diff(got.first)
    return E.Tokens(got.ids[np.repeat(good, n)], np.concatenate([[0], np.cumsum(n * good)]))


def align(t: K.Texts, files) -> Aligned:
    """Groups of whole texts: the end of a text is an end of both its last tokens."""
    a, b, good = _tokens(t, files)
    a, b = _of_good(a, good), _of_good(b, good)
    a_end, b_end = _ends(a, E.byte_entries(files.value[0]).size), _ends(b, E.piece_entries(files.value[1]).size)
    f = of_range(a.ids, a_end, b.ids, b_end)
    stops = np.concatenate([[0], np.cumsum(f.sizes[:-1, 0])])       # A tokens before each group
    return Aligned(f.a, f.b, f.sizes[:-1], a.first, b.first, np.searchsorted(stops, a.first))


@lru_cache(2)
def _decimals(top: int) -> E.Bytes:
    """Every id below `top` in decimal, followed by each of , | ; in turn."""
    return E._flat([b"%d%c" % (i, s) for i in range(top) for s in b",|;"])


def digests(x: Aligned) -> list[str]:
    """SHA-256 of a1,a2|b1;a3|b2 of each text; '' without tokens."""
    top = 1 << max(16, int(max(x.a.max(initial=0), x.b.max(initial=0))).bit_length())
    table, out, run = _decimals(top), [], hashlib.sha256()
    a_at, b_at = (np.concatenate([[0], np.cumsum(x.sizes[:, k])]) for k in (0, 1))
    total = a_at + b_at
    for lo, hi in zip(x.g_first, x.g_first[1:]):
        if lo == hi:
            out.append("")
            continue
        while lo < hi:                                    # about LINKS tokens at a time
            z = min(hi, max(lo + 1, int(np.searchsorted(total, total[lo] + LINKS, "right")) - 1))
            n = x.sizes[lo:z]
            code = np.empty(int(n.sum()), np.int64)
            first = total[lo:z] - total[lo]               # place of each group's first token
            at_a, at_b = E.ranges(first, n[:, 0]), E.ranges(first + n[:, 0], n[:, 1])
            code[at_a], code[at_b] = x.a[a_at[lo]:a_at[z]] * np.int64(3), x.b[b_at[lo]:b_at[z]] * np.int64(3)
            code[first + n[:, 0] - 1] += 1
            code[first + n.sum(1) - 1] += 2
            got = table.flat[E.ranges(table.start[code], table.size[code])]
            run.update(got[:len(got) - (z == hi)].tobytes())
            lo = z
        out.append(run.hexdigest())
        run = hashlib.sha256()
    return out


def _merged(doc: np.ndarray, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (document, pair) entries as one, in order."""
    order = np.lexsort((code, doc))
    doc, code, n = doc[order], code[order], n[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
    at = np.flatnonzero(new)
    return doc[at], code[at], np.add.reduceat(n, at) if len(at) else n


def pairs(x: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, links) of the distinct id pairs of each document of a block, in order; a
    pair is A's id in the high 32 bits and B's in the low ones."""
    links = x.sizes[:, 0] * x.sizes[:, 1]
    a_at, b_at = (np.concatenate([[0], np.cumsum(x.sizes[:, k])]) for k in (0, 1))
    doc = np.repeat(np.arange(len(x.g_first) - 1), np.diff(x.g_first))
    found = []
    few = np.flatnonzero(links <= WIDE)
    upto = np.concatenate([[0], np.cumsum(links[few])])
    lo = 0
    while lo < len(few):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + LINKS, "right")) - 1)
        g = few[lo:hi]
        na, nb = x.sizes[g, 0], x.sizes[g, 1]
        each = np.repeat(nb, na)                          # links of each A token
        a = x.a[np.repeat(E.ranges(a_at[g], na), each)]
        b = x.b[E.ranges(np.repeat(b_at[g], na), each)]
        code = pa.array((a.astype(np.int64) << 32) | b).dictionary_encode()
        kinds = code.dictionary.to_numpy()
        rank = np.argsort(kinds)
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        key = np.sort(np.repeat(doc[g], links[g]) * len(rank) + place[code.indices.to_numpy()])
        at, n = K.runs(key)
        found.append((key[at] // len(rank), kinds[rank][key[at] % len(rank)], n))
        lo = hi
    for g in np.flatnonzero(links > WIDE):
        a, n_a = np.unique(x.a[a_at[g]:a_at[g + 1]], return_counts=True)
        b, n_b = np.unique(x.b[b_at[g]:b_at[g + 1]], return_counts=True)
        code = ((a.astype(np.int64) << 32)[:, None] | b).reshape(-1)
        found.append((np.full(len(code), doc[g]), code, np.outer(n_a, n_b).reshape(-1)))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    if len(found) == 1:
        return found[0]
    return _merged(*(np.concatenate(c) for c in zip(*found)))


# ---------------------------------------------------------------- rows

_PAIR = pa.struct([("bucket", pa.int32()), ("at", pa.binary()), ("code", pa.binary()), ("n", pa.binary())])
_BLOCK = pa.schema([("block", pa.string()), ("ids", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())), ("n_b", pa.list_(pa.int64())),
                    ("n_groups", pa.list_(pa.int64())), ("n_links", pa.list_(pa.int64())), ("digests", pa.list_(pa.string())),
                    ("kinds", pa.int32()), ("own", pa.binary()), ("place", pa.binary()), ("links", pa.binary()), ("pairs", pa.list_(_PAIR))])
_RANGE = pa.schema([("text", pa.string()), ("id", pa.int64()), ("part", pa.int64()), ("good", pa.bool_()),
                    ("a", pa.binary()), ("b", pa.binary()), ("a_end", pa.binary()), ("b_end", pa.binary())])
_SPARK_BLOCK = ("block string, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, "
                "kinds int, own binary, place binary, links binary, pairs array<struct<bucket:int,at:binary,code:binary,n:binary>>")
_SPARK_RANGE = "text string, id long, part long, good boolean, a binary, b binary, a_end binary, b_end binary"
_SPARK_FRAGMENT = "text string, id long, part long, good boolean, a binary, b binary, sizes binary"


def _both(block: pa.Table | None = None, rows: pa.Table | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of the first pass: blocks, or byte ranges of longer texts."""
    n = len(block if block is not None else rows)
    null = [pa.nulls(n, f.type) for f in (_RANGE if block is not None else _BLOCK)]
    columns = [*block.columns, *null] if block is not None else [*null, *rows.columns]
    yield from pa.table(columns, schema=pa.schema([*_BLOCK, *_RANGE])).to_batches(max_chunksize=16)


def _block_row(ids: list, x: Aligned, buckets: int) -> pa.Table:
    """One row for the documents of a block: their results so far, and their pairs as places in
    the block's list of pairs, which is split by bucket of A's id."""
    doc, code, links = pairs(x)
    per = np.bincount(doc, minlength=len(ids))
    kinds, place = np.unique(code, return_inverse=True)
    n_docs = np.bincount(place, minlength=len(kinds)).astype(np.uint32)
    bucket = X.bucket_of(K.mix((kinds >> 32).astype(np.uint64)), buckets)
    split = [{"bucket": b, "at": X.planes(i.astype(np.uint32)), "code": X.planes(kinds[i]), "n": X.planes(n_docs[i])}
             for b, i in X.by_bucket(bucket, buckets)]
    total = np.concatenate([[0], np.cumsum(x.sizes[:, 0] * x.sizes[:, 1])])[x.g_first]
    row = {"block": uuid.uuid4().hex, "ids": ids, "n_a": np.diff(x.a_first).tolist(), "n_b": np.diff(x.b_first).tolist(),
           "n_groups": np.diff(x.g_first).tolist(), "n_links": np.diff(total).tolist(), "digests": digests(x), "kinds": len(kinds),
           "own": X.planes(per.astype(np.uint32)), "place": X.planes(place.astype(np.uint32)), "links": X.planes(links.astype(np.uint32)), "pairs": split}
    return pa.Table.from_pylist([row], _BLOCK)


def _slices(t: K.Texts) -> Iterator[K.Texts]:
    """A text that begins with a space, in slices of about a block, cut at plain spaces."""
    start, _ = E.parts(t)
    lo = 0
    while lo < len(t.buf):
        hi = len(t.buf)
        if hi - lo > BLOCK:
            k = int(np.searchsorted(start, lo + BLOCK, "right")) - 1
            k += start[k] <= lo
            hi = int(start[k]) if k < len(start) else hi
        yield K.Texts(t.buf[lo:hi], np.array([0, hi - lo]), np.zeros(1, bool))
        lo = hi


def _ranges(t: K.Texts, row_id, files, chunk: int) -> Iterator[pa.Table]:
    """A longer text's tokens by byte ranges of `chunk` bytes, a few rows at a time. (A token belongs
    where it ends; where two slices meet inside a range, each makes a row.)"""
    text, part, base = uuid.uuid4().hex, 0, 0
    for s in _slices(t):
        a, b, good = _tokens(s, files)
        a_end, b_end = (base + _ends(got, table.size) for got, table in
                        ((a, E.byte_entries(files.value[0])), (b, E.piece_entries(files.value[1]))))
        base += len(s.buf)
        edge = np.unique(np.append((np.concatenate([a_end, b_end]) - 1) // chunk, -1))
        cut = [np.searchsorted((end - 1) // chunk, edge, "right") for end in (a_end, b_end)]
        rows = [{"text": text, "id": row_id, "part": part + k, "good": bool(good[0]),
                 "a": X.planes(a.ids[i:j]), "b": X.planes(b.ids[m:n]), "a_end": X.planes(a_end[i:j]), "b_end": X.planes(b_end[m:n])}
                for k, (i, j, m, n) in enumerate(zip(cut[0], cut[0][1:], cut[1], cut[1][1:]))]
        part += len(rows)
        yield pa.Table.from_pylist(rows, _RANGE)


def _read(files, buckets: int, chunk: int):
    """First pass: blocks of texts aligned, longer texts as byte ranges of tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in K.blocks(batches, "text", size=BLOCK):
            long = pc.greater(pc.fill_null(pc.binary_length(block.column("text")), 0), chunk)
            for i in np.flatnonzero(long.to_numpy()):
                row = block.slice(int(i), 1)
                for rows in _ranges(_spaced(row.column("text")), row.column("id")[0].as_py(), files, chunk):
                    yield from _both(rows=rows)
            block = block.filter(pc.invert(long))
            if len(block):
                yield from _both(_block_row(block.column("id").to_pylist(), align(_spaced(block.column("text")), files), buckets))
    return run


def _ids(b: bytes) -> np.ndarray:
    return X.unplanes(b, np.int32)


def _leaf(r: dict) -> Fragment:
    return of_range(_ids(r["a"]), X.unplanes(r["a_end"], np.int64), _ids(r["b"]), X.unplanes(r["b_end"], np.int64))


def _node(r: dict) -> Fragment:
    return Fragment(_ids(r["a"]), _ids(r["b"]), X.unplanes(r["sizes"], np.uint32).astype(np.int64).reshape(-1, 2))


def _composed(of):
    """Neighbouring ranges or fragments of one text as one fragment."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = table.sort_by("part").to_pylist()
        f = compose([of(r) for r in rows])
        row = {"text": rows[0]["text"], "id": rows[0]["id"], "part": key[1].as_py(), "good": all(r["good"] for r in rows),
               "a": X.planes(f.a), "b": X.planes(f.b), "sizes": X.planes(f.sizes.reshape(-1).astype(np.uint32))}
        return pa.Table.from_pylist([row], pa.schema([("text", pa.string()), ("id", pa.int64()), ("part", pa.int64()), ("good", pa.bool_()),
                                                      ("a", pa.binary()), ("b", pa.binary()), ("sizes", pa.binary())]))
    return run


def _long_block(buckets: int):
    """Whole texts' fragments as blocks of one document each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                f = _node(r)
                if not r["good"]:
                    f = Fragment(f.a[:0], f.b[:0], np.zeros((1, 2), np.int64))
                n = len(f.sizes) - 1
                x = Aligned(f.a, f.b, f.sizes[:-1], np.array([0, len(f.a)]), np.array([0, len(f.b)]), np.array([0, n]))
                yield from _block_row([r["id"]], x, buckets).to_batches()
    return run


def _whole(parts: DataFrame) -> DataFrame:
    """Tree reduction of byte ranges: one fragment for each text."""
    last = parts.agg(F.max("part").alias("n")).first()["n"]
    rows, of = parts, _leaf
    while of is _leaf or last:
        rows = rows.groupBy("text", F.floor(F.col("part") / FAN).alias("node")).applyInArrow(_composed(of), _SPARK_FRAGMENT)
        of, last = _node, last // FAN
    return rows


def _answered(table: pa.Table) -> pa.Table:
    """Bucket: documents of every pair of its A ids, each block's share of them, and which pairs
    are their A id's most frequent."""
    codes = [X.unplanes(b.as_py(), np.int64) for b in table.column("code")]
    kinds, place = np.unique(np.concatenate(codes), return_inverse=True)
    count = np.zeros(len(kinds), np.int64)
    np.add.at(count, place, np.concatenate([X.unplanes(b.as_py(), np.uint32) for b in table.column("n")]))
    at, n = K.runs(kinds >> 32)
    best = count == np.repeat(np.maximum.reduceat(count, at), n)
    cut = np.cumsum([0, *map(len, codes)])
    signed = [(count[p] * 2 + best[p]) for p in (place[a:z] for a, z in zip(cut, cut[1:]))]
    return pa.table({"block": table.column("block"), "at": table.column("at"), "count": pa.array([X.planes(s) for s in signed], pa.binary())})


_DIGEST = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "n_best": "long", "count_sum": "long", "groups_sha256": "string"}


def _finished(blocks: pa.Table, answers: pa.Table) -> pa.Table:
    """Block: sums over the links of each of its documents."""
    r = blocks.to_pylist()[0]
    count = np.zeros(r["kinds"], np.int64)
    for at, c in zip(answers.column("at"), answers.column("count")):
        count[X.unplanes(at.as_py(), np.uint32)] = X.unplanes(c.as_py(), np.int64)
    own, place, links = (X.unplanes(r[c], np.uint32).astype(np.int64) for c in ("own", "place", "links"))
    first = np.concatenate([[0], np.cumsum(own)])
    best, total = K.per_text(links * (count[place] & 1), first), K.per_text(links * (count[place] >> 1), first)
    columns = [r[c] for c in ("ids", "n_a", "n_b", "n_groups", "n_links")] + [best.tolist(), total.tolist(), r["digests"]]
    kinds = [pa.int64()] * 7 + [pa.string()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", *_DIGEST])


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_vocabulary: str = E.BYTE_VOCABULARY,
          piece_vocabulary: str = E.PIECE_VOCABULARY, chunk: int = CHUNK) -> DataFrame:
    """One row for each row of `docs`: id, n_a, n_b, n_groups, n_links, n_best, count_sum and
    groups_sha256."""
    spark = docs.sparkSession
    files = []
    for path in (byte_vocabulary, piece_vocabulary):
        with open(path, "rb") as f:
            files.append(f.read())
    files = spark.sparkContext.broadcast(tuple(files))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    buckets = X.bucket_count(rows, "text")
    first = X.table(rows.mapInArrow(_read(files, buckets, chunk), f"{_SPARK_BLOCK}, {_SPARK_RANGE}"), "aligned", LARGE_ROWS)
    blocks = [c.split(" ")[0] for c in _SPARK_BLOCK.split(", ")]
    done = first.filter("block is not null").select(*blocks)
    ranges = first.filter("text is not null").select(*(c.split(" ")[0] for c in _SPARK_RANGE.split(", ")))
    if not ranges.isEmpty():
        done = done.unionByName(X.table(_whole(ranges).mapInArrow(_long_block(buckets), _SPARK_BLOCK), "aligned-long", LARGE_ROWS))
    asked = done.select("block", F.explode("pairs").alias("p")).select("block", "p.*")
    answers = asked.groupBy("bucket").applyInArrow(_answered, "block string, at binary, count binary")
    out = done.drop("pairs").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _finished, "id long, " + ", ".join(f"{n} {t}" for n, t in _DIGEST.items()))
    return out.withColumnRenamed("id", id_col)

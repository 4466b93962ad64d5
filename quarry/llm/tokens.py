"""Token counts of documents in flat, unindexed token files (operator 7).

A token file is nothing but ids of a fixed width, with an end-of-document id after each document.
Files are cut into blocks of ``BLOCK`` bytes wherever that falls. A task reads its block, finds all
separators with one vectorised comparison, and returns the lengths between them plus what stands
open at both ends. A prefix scan over the blocks of each file (narrow rows) then gives every block
the number of documents before it and the tokens carried in from the blocks before, however many
blocks a document spans.

``write`` makes such files from a text column with a public byte-level BPE vocabulary: one file for each
task in a folder all executors share, and a table of which document is at which place of which
file. Only files in that table are read, so what a lost attempt left is ignored.

Defined results: a null text has no tokens; a document without tokens has length 0; a file that
doesn't end with a separator has a last document that is marked open, if any token follows the last
separator; a trailing part of an id is ignored; an empty file has no documents; null ids and
repeated rows are counted each; no rows give no rows; other columns aren't read.
"""
from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import exchange as X
from quarry.llm import kernel as K
from quarry.session import ensure_checkpoint_dir

BLOCK = 8 << 20                 # bytes of a file that a task reads at a time
DTYPE = "<u2"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256                     # the vocabulary leaves this id free
# Fixed value: the public pattern that cuts text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _written(folder: str, id_col: str, text_col: str, vocabulary, end: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary.value).encode_ordinary
        store, top = _folder(folder)
        name, stream, n = f"{uuid.uuid4().hex}.bin", None, 0
        stop = np.array([end], dtype).tobytes()
        for block in K.blocks(batches, text_col):
            stream = stream or store.open_output_stream(f"{top}/{name}")
            for text in block.column(text_col).to_pylist():
                stream.write(np.array(encode(text or ""), dtype).tobytes() + stop)
            yield from pa.table({"id": block.column(id_col).cast(pa.int64()), "file": pa.array([name] * len(block), pa.string()),
                                 "place": pa.array(np.arange(n, n + len(block)), pa.int64())}).to_batches()
            n += len(block)
        if stream:
            stream.close()
    return run


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
          end: int = END, dtype: str = DTYPE) -> DataFrame:
    """Token files of `docs` in `folder` (a URI or absolute path that all executors share).
    Returns the written table (id, file, place)."""
    spark = docs.sparkSession
    store, top = _folder(folder)
    store.create_dir(top, recursive=True)
    with open(vocabulary, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col))
    return X.table(rows.mapInArrow(_written(folder, id_col, text_col, data, end, dtype),
                                   "id long, file string, place long"), "places")


def _scanned(folder: str, end: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _folder(folder)
        width = np.dtype(dtype).itemsize
        for batch in batches:
            out = []
            for file, block, lo, size in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(f"{top}/{file}") as f:
                    f.seek(lo)
                    raw = f.read(size)
                ids = np.frombuffer(raw[:len(raw) // width * width], dtype)
                at = np.flatnonzero(ids == end)
                lengths = np.diff(at, prepend=-1) - 1
                out.append({"file": file, "block": block, "ids": len(ids), "ends": len(at),
                            "open": int(len(ids) - 1 - at[-1]) if len(at) else len(ids),
                            "docs": [{"start": a, "n": n} for a, n in zip((at - lengths).tolist(), lengths.tolist())]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([
                ("file", pa.string()), ("block", pa.int64()), ("ids", pa.int64()), ("ends", pa.int64()), ("open", pa.int64()),
                ("docs", pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())])))]))
    return run


def sizes(spark: SparkSession, folder: str, files: DataFrame | None = None) -> DataFrame:
    """(file, size) of the token files of a folder, or of those in `files` (column file)."""
    store, top = _folder(folder)
    found = [(i.base_name, i.size) for i in store.get_file_info(pafs.FileSelector(top)) if i.is_file]
    listed = spark.createDataFrame(found, "file string, size long")
    return listed if files is None else listed.join(files.select("file").distinct(), "file")


def scan(spark: SparkSession, folder: str, files: DataFrame | None = None, end: int = END, dtype: str = DTYPE,
         block: int = BLOCK) -> DataFrame:
    """(file, place, start, n_tokens, ended): every document of the token files, in file order."""
    width = np.dtype(dtype).itemsize
    step = max(width, block // width * width)
    size = F.col("size") - F.col("size") % width
    blocks = (sizes(spark, folder, files).withColumn("size", size).filter("size > 0")
              .select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / step))).alias("block"))
              .select("file", "block", (F.col("block") * step).alias("lo"), F.least(F.lit(step), F.col("size") - F.col("block") * step).cast("long").alias("n"))
              .repartition(X.shuffle_partitions(spark), "file", "block"))
    found = blocks.mapInArrow(_scanned(folder, end, dtype),
                              "file string, block long, ids long, ends long, open long, docs array<struct<start:long,n:long>>")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    run = (found.withColumn("first", F.coalesce(F.sum("ends").over(before), F.lit(0)))
           .withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))
           .withColumn("run", F.sum((F.col("ends") > 0).cast("long")).over(upto)))
    # tokens open at a block's end: its own, and those of the blocks before that saw no separator
    open_ = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    run = (run.withColumn("open", F.sum("open").over(open_))
           .withColumn("carry", F.coalesce(F.lag("open").over(order), F.lit(0)))
           .withColumn("last", F.lead("block").over(order).isNull()))
    def row(place, start, n, ended):
        return F.struct(place.cast("long").alias("place"), start.cast("long").alias("start"), n.cast("long").alias("n_tokens"), F.lit(ended).alias("ended"))

    def document(doc, i):
        carried = F.when(i == 0, F.col("carry")).otherwise(0)
        return row(F.col("first") + i, F.col("start") + doc["start"] - carried, doc["n"] + carried, True)
    rest = row(F.col("first") + F.col("ends"), F.col("start") + F.col("ids") - F.col("open"), F.col("open"), False)
    # a block's documents and what stands open at the end of a file, in one array: the files are read once
    every = F.concat(F.transform("docs", document), F.when(F.col("last") & (F.col("open") > 0), F.array(rest)).otherwise(F.array()))
    return run.select("file", F.explode(every).alias("d")).select("file", "d.*")


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Token counts of `docs` through token files in the shared folder: id and n_tokens."""
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokens/{uuid.uuid4().hex}"
    places = write(docs, folder, id_col, text_col, vocabulary)
    found = scan(spark, folder, places).select("file", "place", "n_tokens")
    # one row for each document on both sides; their files compress too well to be judged by size
    return places.hint("merge").join(found, ["file", "place"]).select(F.col("id").alias(id_col), "n_tokens")

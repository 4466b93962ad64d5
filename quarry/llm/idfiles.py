"""Token ids as Parquet files: list columns, dictionary or delta pages, page indexes (operator 13).

Rows are dealt by ranges of (id, hash of the text, a seeded random number), so that a key which a third
of all rows share is split too, sorted in each range and encoded there. A task writes one Parquet file
with row groups of about ``GROUP_TOKENS`` ids and pages of ``PAGE_BYTES``. ``ids`` is a list column of
unsigned integers, with dictionary pages (each row group keeps the ids it uses once, rows hold indexes of a
few bits) or delta pages; ``doc_id``, ``start`` and ``n_tokens`` are delta-coded. Statistics, page
indexes and checksums of pages are written, so Spark and other readers skip files, row groups and
pages by ``doc_id``, and a read of the narrow columns opens no page of ids.

``write`` returns a table of the row groups: file, group, rows, tokens, least and greatest id, and
``start``, the ids in all groups before it. These come from a prefix scan in two levels over the groups
(first inside ``RUN`` ranges, then over the runs' sums), so no task sees more than a few thousand narrow
rows. Only files of that table are read, so what a lost attempt left is ignored. ``read`` deals row groups over
the tasks; ``select`` lets Spark's own reader skip pages.

Defined results: a null text is an empty one; an empty text has the end id alone; null ids come first;
rows that share an id follow each other in the order of a 64-bit hash of their texts, repeated rows in
any order; a very long text is one list, in a row group of its own if it has more ids than a group; no
rows give no files and no rows; other columns aren't read; an end id is appended whatever the text holds.
"""
from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import encoding as E
from quarry.llm import exchange as X
from quarry.llm import kernel as K
from quarry.session import ensure_checkpoint_dir

END = 0                      # id after each document
GROUP_TOKENS = 4 << 20       # ids of a row group, about
PAGE_BYTES = 64 << 10        # bytes of a page, about
RUN = 1024                   # ranges whose groups are scanned together
SEED = 13
IDS = "ids.list.element"
COLUMNS = ("doc_id", "start", "n_tokens", "ids")
_GROUPS = "part int, file string, group int, rows long, tokens long, least long, most long"


def _schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("doc_id", pa.int64()), pa.field("start", pa.int64(), False), pa.field("n_tokens", pa.int64(), False),
                      pa.field("ids", pa.list_(pa.field("element", id_type, False)), False)])


def _layout(encoding: str, page_bytes: int) -> dict:
    """Options of the writer for `ids` as "dictionary" or "delta"."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding {encoding!r}: give dictionary or delta")
    delta = ["doc_id", "start", "n_tokens"] + [IDS] * (encoding == "delta")
    return {"use_dictionary": [IDS] if encoding == "dictionary" else False, "column_encoding": dict.fromkeys(delta, "DELTA_BINARY_PACKED"),
            "dictionary_pagesize_limit": 1 << 20, "data_page_size": page_bytes, "write_batch_size": 64, "write_page_index": True,
            "write_page_checksum": True, "compression": "zstd", "data_page_version": "2.0"}


def _encoded(text: pa.ChunkedArray, file: bytes, end: int, kind) -> tuple[np.ndarray, np.ndarray]:
    """Ids of every text, each followed by the end id, and where each text's begin (n + 1)."""
    got = E.byte_ids(K.texts(text), file)
    first = got.first + np.arange(len(got.first))
    ids = np.full(first[-1], end, kind)
    own = np.ones(len(ids), bool)
    own[first[1:] - 1] = False
    ids[own] = got.ids
    return ids, first


def _written(folder: str, file, end: int, id_type: pa.DataType, group_tokens: int, layout: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(folder)
        name, part, schema, kind = f"{uuid.uuid4().hex}.parquet", TaskContext.get().partitionId(), _schema(id_type), id_type.to_pandas_dtype()
        out, writer, group, start, held, n = None, None, 0, 0, [], 0

        def flush():
            nonlocal group, held, n
            rows = pa.concat_tables(held)
            writer.write_table(rows, row_group_size=len(rows))
            doc = rows.column("doc_id").drop_null()
            found = {"part": [part], "file": [name], "group": [group], "rows": [len(rows)], "tokens": [n],
                     "least": [doc[0].as_py() if len(doc) else None], "most": [doc[-1].as_py() if len(doc) else None]}
            group, held, n = group + 1, [], 0
            return pa.RecordBatch.from_pydict(found, pa.schema([
                ("part", pa.int32()), ("file", pa.string()), ("group", pa.int32()), ("rows", pa.int64()), ("tokens", pa.int64()),
                ("least", pa.int64()), ("most", pa.int64())]))

        for block in K.blocks(batches, "text", rows=1 << 14, size=2 * K.BLOCK_BYTES):
            if writer is None:
                out = store.open_output_stream(f"{top}/{name}")
                writer = pq.ParquetWriter(out, schema, **layout)
            ids, first = _encoded(block.column("text"), file.value, end, kind)
            table = pa.table([block.column("doc_id").cast(pa.int64()), pa.array(start + first[:-1]), pa.array(np.diff(first)),
                              pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, id_type), type=schema.field("ids").type)], schema=schema)
            lo = 0
            while lo < len(table):       # cut where a row group is full
                hi = max(lo + 1, int(np.searchsorted(first, first[lo] + group_tokens - n, "right")) - 1)
                hi = min(hi, len(table))
                held.append(table.slice(lo, hi - lo))
                n, lo = n + int(first[hi] - first[lo]), hi
                if lo < len(table) or n >= group_tokens:
                    yield flush()
            start += int(first[-1])
        if held:
            yield flush()
        if writer:
            writer.close()
            out.close()
    return run


def _before(groups: DataFrame) -> DataFrame:
    """`start` of every row group: ids in the groups before it."""
    order = Window.partitionBy("run").orderBy("part", "group").rowsBetween(Window.unboundedPreceding, -1)
    runs = groups.withColumn("run", F.floor(F.col("part") / RUN))
    sums = runs.groupBy("run").agg(F.sum("tokens").alias("sum"))
    upto = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("run", F.coalesce(F.sum("sum").over(upto), F.lit(0)).alias("base"))
    here = runs.withColumn("here", F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    return here.join(base, "run").select("file", "group", "part", "rows", "tokens", "least", "most", (F.col("base") + F.col("here")).alias("start"))


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = E.BYTE_VOCABULARY,
          end: int = END, encoding: str = "dictionary", group_tokens: int = GROUP_TOKENS, page_bytes: int = PAGE_BYTES,
          id_bits: int = 16) -> DataFrame:
    """Files of all rows of `docs` in ascending order of their ids, in `folder` (a URI that all executors
    share). Returns the written table of row groups."""
    spark, layout = docs.sparkSession, _layout(encoding, page_bytes)
    store, top = pafs.FileSystem.from_uri(folder)
    store.create_dir(top, recursive=True)
    with open(vocabulary, "rb") as f:
        file = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select(
        "doc_id", "text", F.xxhash64("text").alias("tie"), F.rand(SEED).alias("salt"))
    keys = [F.col("doc_id").asc_nulls_first(), "tie", "salt"]
    dealt = rows.repartitionByRange(X.shuffle_partitions(spark), *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    id_type = pa.uint16() if id_bits == 16 else pa.uint32()
    found = dealt.mapInArrow(_written(folder, file, end, id_type, group_tokens, layout), _GROUPS)
    return X.table(_before(X.table(found, "groups")), "id-groups")


def _read(folder: str, columns: Sequence[str], turn):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, group, start in zip(*(batch.column(c).to_pylist() for c in ("file", "group", "start"))):
                with store.open_input_file(f"{top}/{name}") as f:
                    rows = pq.ParquetFile(f, page_checksum_verification=True).read_row_group(group, columns=list(columns)).combine_chunks()
                if "start" in columns:   # from the file's own count to that of all files
                    own = rows.column("start").to_numpy()
                    rows = rows.set_column(rows.schema.get_field_index("start"), "start", pa.array(own - own[0] + start))
                yield from turn(rows).to_batches()
    return run


def _dealt(groups: DataFrame) -> DataFrame:
    return groups.repartition(X.shuffle_partitions(groups.sparkSession), "file", "group").select("file", "group", "start")


def read(groups: DataFrame, folder: str, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """The chosen columns of the row groups in `groups` (all of a table that `write` returned, or those
    that a filter on it leaves). `start` counts the ids of all documents before."""
    kinds = {"doc_id": "long", "start": "long", "n_tokens": "long", "ids": "array<int>"}

    def plain(rows: pa.Table) -> pa.Table:
        if "ids" in rows.column_names:
            rows = rows.set_column(rows.schema.get_field_index("ids"), "ids", rows.column("ids").cast(pa.list_(pa.int32())))
        return rows.select(list(columns))
    return _dealt(groups).mapInArrow(_read(folder, columns, plain), ", ".join(f"{c} {kinds[c]}" for c in columns))


def select(groups: DataFrame, folder: str, least: int, most: int, columns: Sequence[str] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """Rows with least <= doc_id <= most by Spark's reader, which skips row groups and pages by the page
    index. The list of files is read by the driver: those whose ids meet the range."""
    spark = groups.sparkSession
    met = groups.filter((F.col("least") <= most) & (F.col("most") >= least)).select("file").distinct()
    files = [f"{folder.rstrip('/')}/{r['file']}" for r in met.collect()]
    schema = "doc_id long, start long, n_tokens long, ids array<int>"
    found = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return found.filter(F.col("doc_id").between(least, most)).select(*columns)


def _sums(rows: pa.Table) -> pa.Table:
    ids = rows.column("ids").combine_chunks()
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
    at, flat = ids.offsets.to_numpy(), memoryview(ids.values.to_numpy().astype("<u4").tobytes())
    sums = [zlib.crc32(flat[4 * a:4 * z]) for a, z in zip(at, at[1:])]
    return pa.table([rows.column("doc_id"), rows.column("start"), rows.column("n_tokens"), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = E.BYTE_VOCABULARY) -> DataFrame:
    """Writes the files in the shared folder and reads them back: id, start, n_tokens and a CRC-32 of the
    ids as little-endian unsigned 32-bit integers."""
    folder = f"{ensure_checkpoint_dir(docs.sparkSession).rstrip('/')}/ids/{uuid.uuid4().hex}"
    groups = write(docs, folder, id_col, text_col, vocabulary)
    found = _dealt(groups).mapInArrow(_read(folder, COLUMNS, _sums), "doc_id long, start long, n_tokens long, ids_crc32 long")
    return found.withColumnRenamed("doc_id", id_col)

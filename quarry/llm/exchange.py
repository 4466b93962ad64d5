"""Moving packed arrays between tasks, counts of work, and tables that cut lineage.

Corpus-wide joins on hashes (windows, shingles, n-grams) would move one small row for each
word. Tasks instead pack what belongs to one *bucket* of hash values into one binary value;
Spark shuffles and groups these by bucket. Each task first reduces equal hashes to one
entry, so that a hash that a third of all texts share reaches its bucket once per block of
texts, and buckets stay even. The number of buckets follows the input.
"""
from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import ensure_checkpoint_dir

BUCKET_CHARS = 64 << 20       # characters of text whose hashes share a bucket, at most about
COMPACT_ROWS = 100_000        # a narrow table up to here is joined in one task
BROADCAST_ROWS = 200_000      # a table of ids or of one row per source goes to all executors up to here


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_count(df: DataFrame, text: str) -> int:
    """Buckets for the words of a text column: in proportion to the characters, and two for
    each shuffle partition at least. (More would leave a text too few hashes in each bucket to
    pack them well.)"""
    chars = df.agg(F.sum(F.length(text))).first()[0] or 0
    return max(2 * shuffle_partitions(df.sparkSession), int(chars // BUCKET_CHARS))


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket by the high bits of a mixed hash."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def by_bucket(bucket: np.ndarray, n: int):
    """Yield (bucket, indices in order) for each bucket that has entries."""
    kind = np.uint16 if n <= 1 << 16 else np.uint32
    order = np.argsort(bucket.astype(kind), kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=n))
    lo = 0
    for b in np.flatnonzero(np.diff(np.concatenate([[0], ends]))):
        lo = int(ends[b - 1]) if b else 0
        yield int(b), order[lo:int(ends[b])]


def planes(x: np.ndarray) -> bytes:
    """Bytes of an array of integers by significance, so that the shuffle's compression drops
    the planes of small values."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(b: bytes, dtype) -> np.ndarray:
    k = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(k, -1).T).reshape(-1).view(dtype)


def sample_hashes(df: DataFrame, h: str, rows: int) -> list[int]:
    """At most `rows` values of the hash column `h`, the smallest of each residue class: a uniform
    sample that doesn't depend on partitions. Tasks send partial minima to many tasks, and the
    driver gets `rows` numbers, however large the input (a top-k would send k rows from every task
    to one place)."""
    least = df.groupBy(F.pmod(F.col(h), F.lit(rows))).agg(F.min(h).alias("h"))
    return [r["h"] for r in least.filter("h is not null").collect()]


def table(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it again: cuts the lineage, and a
    lost executor costs no recomputation. `options` are the Parquet writer's."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def compact(written: DataFrame, rows: int = COMPACT_ROWS) -> DataFrame:
    """A written narrow table, read by one task if it has at most `rows` rows: joins and sums of a
    few rows then need no exchange. Larger ones are read as they are."""
    return written.coalesce(1) if written.count() <= rows else written


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written copy of `df` (a narrow table), marked for broadcast only if it has at most
    `rows` rows; beyond that, Spark plans the join from its statistics."""
    kept = table(df, "small")
    return F.broadcast(kept) if kept.limit(rows + 1).count() <= rows else kept


def _place(id_: Column, words: int) -> tuple[Column, Column]:
    h = F.xxhash64(id_)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 40).bitwiseAND(F.lit(63).cast("long")).cast("int"))
    return F.pmod(h, F.lit(words)), bit


def bitmap(ids: DataFrame, id_col: str, words: int) -> DataFrame:
    """One row: `_place_bits`, `words` longs with a place for each hash of an id. Of fixed size, however many ids."""
    word, bit = _place(F.col(id_col), words)
    some = ids.groupBy(word.alias("id")).agg(F.bit_or(bit).alias("w"))
    every = ids.sparkSession.range(words).join(some, "id", "left").select("id", F.coalesce("w", F.lit(0).cast("long")).alias("w"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "w"))), lambda x: x["w"]).alias("_place_bits"))


def with_marked(df: DataFrame, id_col: str, bits: DataFrame, words: int, out: str) -> DataFrame:
    """Add `out`: is the id's place in the bitmap taken? Always for an id of the bitmap, rarely for others."""
    word, bit = _place(F.col(id_col), words)
    name = unused(df, "_place_bits")
    return df.crossJoin(F.broadcast(bits.withColumnRenamed("_place_bits", name))).withColumn(out, F.get(name, word).bitwiseAND(bit) != 0).drop(name)


def unused(df: DataFrame, name: str) -> str:
    """`name`, or a longer one that begins no column of `df`."""
    while any(c.lower().startswith(name) for c in df.columns):
        name += "_"
    return name

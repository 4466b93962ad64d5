"""Scans over large groups without a single-task sort: positions, running sums, values of the row
before, sums of a group's first rows.

`row_number().over(Window.orderBy(..))` moves a whole table into one task, and a window
partitioned by a low-cardinality key (four domains) puts a quarter of the data into one
task. `scan` gives the same values from ranges of the key:

1. Cut values of (group keys, order keys) come from a bounded sample of the keys (`SAMPLE` for each
   range, those with the smallest hashes, so every pass and attempt sees the same). They travel as one
   sorted array in one broadcast row; a row finds its range by binary search in it. The plan doesn't
   grow with the number of ranges, nothing goes through the driver, and no job runs before the action.
2. Rows get their value inside (group, range) from a window on these, which spreads a group over its
   ranges.
3. Summaries per (group, range), at most #ranges + #groups rows, are combined in the order of the
   ranges (counts and sums add up, of last values the later one stays) and joined back. AQE sees
   the runtime size of that table and broadcasts it when it is small, else it stays a shuffle join.

Order keys must be unique within a group so that the order is total. The cut values only
balance the ranges; results don't depend on them.

Use a plain `row_number` window when groups are many and small (documents, models).
"""
from __future__ import annotations

from collections.abc import Mapping
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 32      # sampled keys for each range


def _cols(xs: Sequence[str | Column]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _cuts(df: DataFrame, keys: list[Column], n: int) -> DataFrame:
    """One row: at most `n` cut keys in order, as an array of structs `_q_cuts`."""
    names = [f"_k{i}" for i in range(len(keys))]
    hashed = df.select(*[k.alias(c) for k, c in zip(keys, names)]).withColumn("_h", F.xxhash64(*names))
    # the smallest hash of each residue class: partial minima in tasks, SAMPLE * n rows after the shuffle
    least = hashed.groupBy(F.pmod("_h", F.lit(SAMPLE * n)).alias("_c")).agg(F.min("_h").alias("_h")).select("_h")
    keys_of = hashed.join(F.broadcast(least), "_h").select(F.struct(*names).alias("_k"))
    every = F.filter(F.sort_array(F.collect_set("_k")), lambda k, i: i % SAMPLE == SAMPLE - 1)
    return keys_of.agg(every.alias("_q_cuts"))


def with_range(df: DataFrame, keys: Sequence[str | Column], n: int, out: str = "_q_range") -> DataFrame:
    """Add the number of the row's key range (0 to `n`): the cut keys below its key, by binary search."""
    keys = _cols(keys)
    key = F.struct(*[k.alias(f"_k{i}") for i, k in enumerate(keys)])
    steps = F.array(*[F.lit(1 << i) for i in range(n.bit_length(), -1, -1)])

    def further(lo: Column, step: Column) -> Column:
        return F.when(F.col("_q_key") > F.get("_q_cuts", lo + step - 1), lo + step).otherwise(lo)
    placed = df.withColumn("_q_key", key).crossJoin(F.broadcast(_cuts(df, keys, n)))
    return placed.withColumn(out, F.aggregate(steps, F.lit(0), further)).drop("_q_key", "_q_cuts")


def _add_offsets(ranged: DataFrame, offsets: DataFrame, part: list[str]) -> DataFrame:
    """Join the offsets of each (group, range); null groups are groups too."""
    named = offsets.select(*[F.col(c).alias(f"_q_{c}") for c in [*part, "_q_range"]],
                           *[c for c in offsets.columns if c not in (*part, "_q_range")])
    same = F.lit(True)
    for c in [*part, "_q_range"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_q_{c}"))
    return ranged.join(named, same).drop(*[f"_q_{c}" for c in [*part, "_q_range"]])


def scan(df: DataFrame, group_by: Sequence[str], order_by: Sequence[str | Column], position: str | None = None,
         sums: Mapping[str, str | Column] | None = None, before: Mapping[str, str] | None = None, first: int = 0,
         heads: Mapping[str, str | Column] | None = None, num_partitions: int | None = None) -> DataFrame:
    """Add, for each row in the order `order_by` of its group:
    `position` its place (from 1); `sums` (new column → value) sums up to and with the row; `before` (new
    column → column) the value in the row before, null in the group's first; `heads` (new column →
    value) sums over the `first` first rows of the whole group."""
    part, order = list(group_by), _cols(order_by)
    sums, before, heads = ({k: F.col(v) if isinstance(v, str) else v for k, v in (m or {}).items()} for m in (sums, before, heads))
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = with_range(df, [*_cols(part), *order], n)
    inside = Window.partitionBy(*part, "_q_range").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumn("_q_n", F.row_number().over(inside))
    values = {f"_q_v{i}": v for i, v in enumerate(heads.values())}
    for i, v in enumerate(sums.values()):
        local = local.withColumn(f"_q_s{i}", F.sum(v).over(upto))
    for i, v in enumerate(before.values()):
        local = local.withColumn(f"_q_b{i}", F.lag(v).over(inside)).withColumn(f"_q_l{i}", v)
    for c, v in values.items():
        local = local.withColumn(c, v)

    # the last row of a (group, range) holds its count, sums and last values
    totals = (local.withColumn("_q_end", F.lead(F.lit(1)).over(inside).isNull()).filter("_q_end")
              .select(*part, "_q_range", F.col("_q_n").alias("_q_t"), *[F.col(f"_q_s{i}").alias(f"_q_t{i}") for i in range(len(sums))],
                      *[F.col(f"_q_l{i}").alias(f"_q_e{i}") for i in range(len(before))]))
    ranges = Window.partitionBy(*part).orderBy("_q_range")
    earlier = ranges.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_q_off", F.coalesce(F.sum("_q_t").over(earlier), F.lit(0)))
    if values:
        head = F.array_agg(F.struct(F.col("_q_n").alias("n"), *values))
        of = local.filter(F.col("_q_n") <= first).groupBy(*part, "_q_range").agg(head.alias("_q_head"))
        totals = _add_offsets(totals, of, part)
        for i, c in enumerate(values):
            mine = F.aggregate(F.filter("_q_head", lambda x: x["n"] + F.col("_q_off") <= first), F.lit(0.0), lambda a, x: a + F.coalesce(x[c].cast("double"), F.lit(0.0)))
            totals = totals.withColumn(f"_q_h{i}", F.sum(mine).over(Window.partitionBy(*part)))
    offsets = totals.select(
        *part, "_q_range", "_q_off", *[F.sum(f"_q_t{i}").over(earlier).alias(f"_q_o{i}") for i in range(len(sums))],
        *[F.lag(f"_q_e{i}").over(ranges).alias(f"_q_p{i}") for i in range(len(before))], *[f"_q_h{i}" for i in range(len(values))])
    out = _add_offsets(local, offsets, part)
    new = {position: F.col("_q_off") + F.col("_q_n")} if position else {}
    new |= {c: F.coalesce(F.col(f"_q_s{i}") + F.col(f"_q_o{i}"), f"_q_s{i}", f"_q_o{i}") for i, c in enumerate(sums)}
    new |= {c: F.when(F.col("_q_n") == 1, F.col(f"_q_p{i}")).otherwise(F.col(f"_q_b{i}")) for i, c in enumerate(before)}
    new |= {c: F.col(f"_q_h{i}") for i, c in enumerate(heads)}
    return out.select(*df.columns, *[v.alias(c) for c, v in new.items()])


def with_ordinal(df: DataFrame, order_by: Sequence[str | Column],
                 partition_by: Sequence[str] = (), name: str = "ordinal",
                 num_partitions: int | None = None) -> DataFrame:
    """Add a 0-based `name` column: position of the row in `order_by` within `partition_by`."""
    return scan(df, partition_by, order_by, name, num_partitions=num_partitions).withColumn(name, F.col(name) - 1)


def running_sum(df: DataFrame, group_by: Sequence[str], order_by: Sequence[str], value: str,
                count_col: str, sum_col: str) -> DataFrame:
    """Inclusive running count and sum of `value` per group in `order_by` order."""
    return scan(df, group_by, order_by, count_col, {sum_col: value})

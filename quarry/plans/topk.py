"""Top-n terms per group with first-occurrence tie-breaking (rule P3), and per-group top-k rows.

Both are written as `row_number() <= k` over a window, which Spark plans as a partial
`WindowGroupLimit` before the shuffle for k up to `GROUP_LIMIT`: every map task keeps only k
candidates per group, so a group holding a third of all rows never moves more than k rows per
task. For larger k that setting of the session is raised. The term counts are a partial/final aggregate on (group, term), so the shuffle
carries distinct pairs only.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(xs):
    return [F.col(x) if isinstance(x, str) else x for x in xs]


LIMIT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"
GROUP_LIMIT = 1000    # Spark's default of LIMIT_CONF


def top_k_rows(df: DataFrame, group_by: Sequence[str], order_by: Sequence[Column], k: int,
               rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k inside each group by `order_by` (give a total order for stable results).
    Spark keeps the k best of each (task, group) before the shuffle up to a k in its settings, by default
    GROUP_LIMIT: for a larger k that setting is raised, so that the other rows don't move."""
    if k > GROUP_LIMIT:
        conf = df.sparkSession.conf
        conf.set(LIMIT_CONF, str(max(k, int(conf.get(LIMIT_CONF, str(GROUP_LIMIT))))))
    w = Window.partitionBy(*group_by).orderBy(*order_by) if group_by else Window.orderBy(*order_by)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def term_counts(df: DataFrame, group_by: Sequence[str], terms: Column,
                order_key: Sequence[str | Column], term_col: str = "term") -> DataFrame:
    """Count the elements of the array `terms` per (group, term); `first` is the smallest
    (order key, position) at which the term occurs, i.e. its first occurrence."""
    exploded = df.select(*group_by, *[c.alias(f"_o{i}") if isinstance(c, Column) else F.col(c).alias(f"_o{i}")
                                      for i, c in enumerate(order_key)],
                         F.posexplode(terms).alias("_pos", term_col))
    first = F.struct(*[F.col(f"_o{i}") for i in range(len(order_key))], F.col("_pos"))
    return (exploded.groupBy(*group_by, term_col)
            .agg(F.count(F.lit(1)).alias("count"), F.min(first).alias("first")))


def top_terms(df: DataFrame, group_by: Sequence[str], terms: Column,
              order_key: Sequence[str | Column], n: int, term_col: str = "term") -> DataFrame:
    """Top n terms per group by count desc, ties by first occurrence; columns
    (*group_by, term_col, count, rank)."""
    counts = term_counts(df, group_by, terms, order_key, term_col)
    ranked = top_k_rows(counts, group_by, [F.col("count").desc(), F.col("first")], n)
    return ranked.drop("first")


def ranked_list(rank: str, value: str) -> Column:
    """Aggregate: values ordered by rank (use on groups of at most k rows)."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank), F.col(value)))),
                       lambda s: s[value])

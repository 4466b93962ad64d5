"""Mixing sources to target weights by Poisson replication (operator 6). DataFrame functions only.

A source's mean repetition rate is what brings it to its target share of as many rows as came in:
rate = share * rows / rows of the source. A row's number of copies inverts the Poisson distribution
of that mean at a uniform number taken from an MD5 of (seed, id), so it depends on neither
partitions nor other rows. Rates above ``PART`` are sums of independent Poisson numbers of equal
smaller means, one uniform number each, which keeps the table of the distribution short and exact
at any rate. Copies are then dealt to partitions, and sorted there, by a hash of (seed, id, copy):
a global shuffle that needs no sampling of ranges.

Per-source numbers (rows, rate, distribution) are one small aggregate. It is broadcast up to
``SOURCES`` sources; beyond that a shuffle join is planned, whose hot sources adaptive execution
splits.

Defined results: rows with a null source form a source of their own; null ids hash as the empty
string; rows of the same id get the same number of copies; sources missing from the targets have
weight 0 and go; empty tables give no rows; all columns pass through, also ones named like the
operator's own (its names begin with `_mix_`); copies are numbered from 1 in `copy_col`, which replaces a column
of that name.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import exchange as X

SEED = 20240117
PART = 32.0        # largest mean of one inverted distribution
TERMS = 160        # probabilities computed of a mean of PART (the rest is under 1e-50)
DIGITS = 12        # decimals of the cumulative probabilities
SOURCES = 5_000    # sources whose numbers are broadcast, at most


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(2.0 ** 52)


def distribution(mean: Column) -> Column:
    """Cumulative Poisson probabilities below 1: entry k (from 0) is that of k or less."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.round(F.exp(-mean), DIGITS)).alias("all"))

    def more(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"),
                        F.concat(acc["all"], F.array(F.round(acc["c"] + p, DIGITS))).alias("all"))

    every = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, more)["all"]
    return F.filter(every, lambda c: c < 1.0)


def rates(docs: DataFrame, targets: DataFrame | None, source_col: str) -> DataFrame:
    """(_mix_source, rows, rate) of every source. `targets` has (source, weight); weights are
    scaled to the sources present. Without targets, all sources weigh the same."""
    n = docs.groupBy(F.col(source_col).alias("_mix_source")).agg(F.count("*").alias("rows"))
    if targets is None:
        n = n.withColumn("weight", F.lit(1.0))
    else:
        t = targets.select(F.col("source").alias("_mix_t"), F.col("weight").cast("double"))
        n = n.join(t, F.col("_mix_source").eqNullSafe(F.col("_mix_t")), "left").drop("_mix_t").fillna(0.0, ["weight"])
    total = n.agg(F.sum("rows").alias("all_rows"), F.sum("weight").alias("all_weight"))
    return (n.join(F.broadcast(total))      # one row
            .withColumn("rate", F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * F.col("all_rows") / F.col("rows"))
                        .otherwise(0.0)).select("_mix_source", "rows", "rate"))


def mix(docs: DataFrame, targets: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source",
        seed: int = SEED, epochs: float = 1.0, copy_col: str | None = "copy") -> DataFrame:
    """Every row of `docs` as often as its Poisson number says, globally shuffled."""
    per = rates(docs, targets, source_col).withColumn("_mix_rate", F.col("rate") * F.lit(float(epochs)))
    parts = F.greatest(F.lit(1), F.ceil(F.col("_mix_rate") / PART))
    per = per.select("_mix_source", parts.cast("int").alias("_mix_parts"),
                     distribution(F.col("_mix_rate") / parts).alias("_mix_below"))
    per = X.small(per, SOURCES)
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("_mix_parts")), F.lit(0).cast("long"),
        lambda n, part: n + F.size(F.filter("_mix_below", lambda c: c <= uniform(seed, F.col("_mix_id"), part))))
    once = F.size(F.filter(F.col("_mix_below"), lambda c: c <= F.col("_mix_u"))).cast("long")
    rows = (docs.join(per, F.col(source_col).eqNullSafe(F.col("_mix_source")))
            .withColumn("_mix_id", F.col(id_col).cast("string"))
            .withColumn("_mix_u", uniform(seed, F.col("_mix_id"), F.lit(1)))
            .withColumn("_mix_n", F.when(F.col("_mix_parts") == 1, once).otherwise(count))
            .filter(F.col("_mix_n") > 0))
    copies = rows.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_n"))))
    key = F.xxhash64(F.lit(seed), F.coalesce("_mix_id", F.lit("")), "_mix_copy")
    out = copies.withColumn("_mix_key", key).repartition("_mix_key").sortWithinPartitions("_mix_key", "_mix_copy")
    own = [F.col(f"`{c}`") for c in docs.columns if c != copy_col]
    return out.select(*own, *([F.col("_mix_copy").alias(copy_col)] if copy_col else []))

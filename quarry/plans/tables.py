"""Intermediate tables in the shared checkpoint folder: what several branches of a plan read is computed
once, lineage is cut, and a lost executor costs no recomputation."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from quarry.session import ensure_checkpoint_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to a table of its own under spark.checkpoint.dir and read it again."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

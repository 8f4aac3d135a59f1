"""Spreading small inputs over all cores before work that is many times their size."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: A scan of fewer bytes a core may come in fewer tasks than there are cores (a file's row group is read by one).
BYTES_PER_CORE = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if the optimizer's estimate of its size is small for them; large inputs have tasks enough and are never shuffled here."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * BYTES_PER_CORE else df

"""How rows are dealt to tasks before operators that cost far more than reading."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes a core, by the plan's own estimate, under which a scan may leave cores idle.
CORE_BYTES = 32 << 20
TASKS_A_CORE = 4


def spread(df: DataFrame) -> DataFrame:
    """The rows, dealt evenly to all cores where the plan reads so little that its files would keep few of them busy.

    A small file is one task however much its rows cost.  What is dealt is at most CORE_BYTES a core; inputs that are
    larger or have a file a core, and streams, stay as they are read: no shuffle.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(TASKS_A_CORE * cores) if size <= CORE_BYTES * cores and len(df.inputFiles()) < cores else df

"""Tables that cut lineage, in the folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the folder of spark.checkpoint.dir: cuts the lineage of loops, survives lost executors.

    Where that setting is unset, a session on one machine gets a temporary folder; on a cluster each executor would write
    to its own disk, so there it is an error.  Like Spark's own checkpoints the tables stay until the folder is cleared.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir names no folder that all executors see")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="granary-"))
    path = f"{context.getCheckpointDir()}/granary-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Jobs of one plan that run side by side.
PARALLEL_JOBS = 8


def side_by_side(*jobs: Callable[[], object]) -> Sequence:
    """The results of jobs that do not need each other; small ones leave most of a cluster (or a machine) idle on their own."""
    with ThreadPoolExecutor(min(PARALLEL_JOBS, max(1, len(jobs)))) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]

"""Session settings the engine expects."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, partitions: int | None = None, name: str = "docwright") -> SparkSession:
    """A session in UTC with adaptive execution and Arrow; on a cluster, leave master and partitions to the submit command."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that `spark.checkpoint.dir` (or the context) names. Only a local master may do without: it gets a folder that ends with it."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not named:
            named = tempfile.mkdtemp(prefix="docwright-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return df.checkpoint(eager=True)

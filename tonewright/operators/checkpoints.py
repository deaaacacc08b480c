"""Where iterations cut their lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the folder that the cluster names in spark.checkpoint.dir and go on from there.

    Only a local session, all of which is one machine, may do without that setting.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", "")
        if not named:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
            named = tempfile.mkdtemp(prefix="tonewright-")
        context.setCheckpointDir(named)
    return df.checkpoint()


def dropped(df: DataFrame) -> None:
    """Delete what `cut` wrote for `df`, which is not asked again, and let go of shuffles that nothing refers to any more: a loop then needs the disk of a round, not of all rounds."""
    context = df.sparkSession.sparkContext
    written = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if written.isDefined():
        path = context._jvm.org.apache.hadoop.fs.Path(written.get())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    context._jvm.System.gc()

"""What Spark cannot know of a DataFrame by itself: where to cut its lineage, and that it is large."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def by_merge(df: DataFrame) -> DataFrame:
    """`df` as the side of a join that is not to be broadcast, whatever Spark takes its size to be.

    Spark judges a table by its files: rows that `explode` or a Python step makes do not count, nor do they after a
    checkpoint. Pixels made of a small list, or cells counted on them, would be sent whole through the driver.
    """
    return df.hint("merge")


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` written to the reliable checkpoint folder and read back from there.

    The folder is the one the session names in `spark.checkpoint.dir`. Only a local session that
    names none gets a folder of its own; on a cluster a machine-local folder would be lost with
    its executor, so that is refused.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="stainframe-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)

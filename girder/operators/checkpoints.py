"""Intermediate results in the folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  A temporary one is made only on a single machine where none is set;
    on a cluster that would be a folder of the driver's alone, so there the setting is asked for."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="girder-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder.  Spark removes it with the frame if
    spark.cleaner.referenceTracking.cleanCheckpoints is on."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)

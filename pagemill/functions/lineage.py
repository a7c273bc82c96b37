"""Tables fixed in the shared folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the folder that ``spark.checkpoint.dir`` names; in one of our own only where that is unset and Spark runs in one process."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="pagemill-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()

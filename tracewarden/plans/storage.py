"""Cutting lineage in iterative plans."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint into spark.checkpoint.dir. Where that is unset, into a temporary folder for a local master; an error
    otherwise, as executors elsewhere would not see it."""
    sc = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and sc.getCheckpointDir() is None:
        if not re.match(r"local($|\[)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + os.path.join(tempfile.gettempdir(), "tracewarden-checkpoints"))
    return df.checkpoint(eager=True)

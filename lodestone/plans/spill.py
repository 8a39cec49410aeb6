"""Results that must exist at once, so that their errors surface inside TRY."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def keep(session, frame: DataFrame) -> DataFrame:
    """frame written to the session's shared folder and read again."""
    path = f"{session._folder()}/{uuid.uuid4().hex}"
    names = [f"c{i}" for i in range(len(frame.columns))]
    frame.toDF(*names).write.parquet(path)
    return session.spark.read.parquet(path).toDF(*frame.columns)

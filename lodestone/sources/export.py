"""Result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write(df: DataFrame, path: str, kind: str, **options) -> None:
    """csv, json, xml, parquet or markdown; all are written in parallel, one part for each task."""
    if kind == "csv":
        df.write.options(header=True, **options).csv(path)
    elif kind == "json":
        df.write.options(**options).json(path)
    elif kind == "xml":
        df.write.format("xml").options(**{"rowTag": "row", "rootTag": "rows", **options}).save(path)
    elif kind == "parquet":
        df.write.options(**options).parquet(path)
    elif kind == "markdown":
        cells = [F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), "[|\\n\\r]", " ") for c in df.columns]
        df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value")).write.text(path)
    else:
        raise ValueError(kind)


def markdown_header(df: DataFrame) -> str:
    return "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)

"""OPENROWSET(BULK ...): delimited files with a given schema, or whole files as one value."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.errors import TSqlError, unsupported
from ..plans.types import spark_type

_KNOWN = {"FORMAT", "FIRSTROW", "LASTROW", "CODEPAGE", "ROWTERMINATOR", "FIELDTERMINATOR", "FIELDQUOTE", "ESCAPECHAR", "MAXERRORS", "ERRORFILE", "SINGLE_BLOB", "SINGLE_CLOB", "SINGLE_NCLOB", "HEADER_ROW"}
_PAGES = {"65001": "UTF-8", "ACP": "windows-1252", "RAW": "UTF-8", "1252": "windows-1252", "1200": "UTF-16LE", "OEM": "ISO-8859-1"}


def _mark(text: str) -> str:
    return text.replace("\\t", "\t").replace("\\n", "\n").replace("\\r", "\r")


def read(spark: SparkSession, path: str, options: dict, schema: list) -> DataFrame:
    """The rows, and the hidden columns _path, _name and _parts (what each wildcard matched)."""
    unknown = set(options) - _KNOWN
    if unknown:
        raise unsupported(", ".join(sorted(unknown)))
    single = next((o for o in options if o.startswith("SINGLE_")), None)
    if single:
        raw = spark.read.format("binaryFile").load(path)
        charset = {"SINGLE_CLOB": "UTF-8", "SINGLE_NCLOB": "UTF-16LE"}.get(single)
        return raw.select((F.decode("content", charset) if charset else F.col("content")).alias("BulkColumn"))
    if str(options.get("FORMAT", "CSV")).upper() != "CSV":
        raise unsupported(f"FORMAT '{options['FORMAT']}'")
    if not schema:
        raise TSqlError("A WITH schema is needed for CSV files.", 13)
    fields = ", ".join(f"`{c}` {spark_type(k)}" for c, k, _, _ in schema)
    reader = spark.read.schema(fields + ", `__bad` string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad")
    reader = reader.option("sep", _mark(options.get("FIELDTERMINATOR", ","))).option("quote", options.get("FIELDQUOTE", '"')).option("escape", options.get("ESCAPECHAR", '"'))
    reader = reader.option("encoding", _PAGES.get(str(options.get("CODEPAGE", "65001")).upper(), "UTF-8"))
    if "ROWTERMINATOR" in options and _mark(options["ROWTERMINATOR"]) not in ("\n", "\r\n"):
        reader = reader.option("lineSep", _mark(options["ROWTERMINATOR"]))
    first, last = int(options.get("FIRSTROW", 1)), int(options.get("LASTROW", 0))
    if first == 2 and not last:
        reader = reader.option("header", True).option("enforceSchema", True)
    names = [c for c, _, _, _ in schema]
    pattern = re.sub(r"\\\*", "([^/]*)", re.escape(path)) + "$"
    frame = reader.csv(path).select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("_name"), F.col("_metadata.file_block_start").alias("__at"))
    if (first > 1 and not (first == 2 and not last)) or last:
        # rows of a file are numbered in their order; one file's rows meet in one window
        frame = frame.withColumn("__n", F.row_number().over(Window.partitionBy("_path").orderBy("__at", F.monotonically_increasing_id())))
        frame = frame.where((F.col("__n") >= first) & ((F.col("__n") <= last) if last else F.lit(True)))
    most = int(options.get("MAXERRORS", 10))
    bad = frame.where(F.col("__bad").isNotNull())
    if "ERRORFILE" in options:
        bad.select("__bad").write.mode("overwrite").text(options["ERRORFILE"])
    if "MAXERRORS" in options and bad.count() > most:
        raise TSqlError(f"Cannot bulk load because the maximum number of errors ({most}) was exceeded.", 4865)
    groups = F.array(*(F.regexp_extract("_path", pattern, i + 1) for i in range(path.count("*")))) if "*" in path else F.array(F.lit(None).cast("string"))
    return frame.where(F.col("__bad").isNull()).select(*names, "_path", "_name", groups.alias("_parts"))

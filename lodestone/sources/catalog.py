"""metadata.* and sys.* tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.errors import SPARK_NUMBERS, TSqlError


def metadata(session, name: str) -> DataFrame:
    """metadata.entity, metadata.attribute, and the relationship, key and value tables (from what the
    session knows: registered hierarchies are the relationships; there are no choices)."""
    for t in sorted(session.folder_names):
        session.table([t])
    tables = {k: v for k, v in session.views.items() if "." not in k and not k.startswith(("bulk_", "message_", "#"))}
    if name == "entity":
        rows = [(t, t, len(c)) for t, (_, c) in sorted(tables.items())]
        return session.spark.createDataFrame(rows, "logicalname string, schemaname string, attributecount int")
    if name == "attribute":
        rows = [(t, c, i + 1, k) for t, (_, columns) in sorted(tables.items()) for i, (c, k) in enumerate(columns.items())]
        return session.spark.createDataFrame(rows, "entitylogicalname string, logicalname string, columnnumber int, attributetypename string")
    if name in ("relationship_1_n", "relationship_n_1"):
        rows = [(f"{t}_{p}", t, k, t, p) for t, k, p in session.parents.values()]
        return session.spark.createDataFrame(rows, "schemaname string, referencedentity string, referencedattribute string, referencingentity string, referencingattribute string")
    empty = {
        "relationship_n_n": "schemaname string, entity1logicalname string, entity2logicalname string, intersectentityname string",
        "alternate_key": "entitylogicalname string, logicalname string, keyattributes string",
        "optionsetvalue": "entitylogicalname string, attributelogicalname string, value int, label string",
        "globaloptionset": "name string, displayname string",
        "globaloptionsetvalue": "name string, value int, label string",
    }
    if name not in empty:
        raise TSqlError(f"Invalid object name 'metadata.{name}'.", 208)
    return session.spark.createDataFrame([], empty[name])


def messages(spark: SparkSession) -> DataFrame:
    rows = [(n, 1033, 16, k) for k, n in sorted(SPARK_NUMBERS.items())]
    return spark.createDataFrame(rows, "message_id int, language_id int, severity int, text string")

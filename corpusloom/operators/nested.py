"""Nested records as flat tables that can be joined back together.

Every node gets a Dewey label: the ordinals, from 1, of its place in the list of its
parent, of the parent's place in the list of the grandparent, and so on.  A node's parent
is its own label without the last ordinal, so links need no join, and all nodes of one
schema path form one table.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructType


def _slots(values: Column) -> Column:
    """The filled slots of a list with their ordinals."""
    return F.filter(
        F.transform(values, lambda x, i: F.struct((i + 1).cast("int").alias("at"), x.alias("node"))),
        lambda s: s["node"].isNotNull(),
    )


def dewey_tables(df: DataFrame, key: str, root: str, childless: bool = False) -> dict[str, DataFrame]:
    """The tables of a nested table by schema path: "" for the records, then ``root``, ``root.child``, ...

    The table of the records has ``key`` and their columns that are no lists (of rows with the same key
    the least by these columns), the others hang on it by ``key``.

    Each table has ``key``, ``label`` (ordinals from 1), ``parent`` (the label without its last
    ordinal) and the fields of the node that are no lists; a node that is no struct is in
    ``value``.  Null slots give no row but keep their ordinal; null and empty lists give none.
    With ``childless`` every node without children (and every record without nodes) has one
    row with ordinal 0 and null fields in the table of its children.  Rows with the same key
    are expected to hold the same content and count once; rows with a null key are left out.
    Further columns of ``df`` are only in the table of the records, whatever their names.
    """
    level = df.select(F.col(key).alias("_key"), F.array().cast("array<int>").alias("_label"), F.col(root).alias("_list"))
    level = level.where(F.col("_key").isNotNull())
    plain = [f.name for f in df.schema.fields if f.name not in (key, root) and not isinstance(f.dataType, ArrayType)]
    found: dict[str, DataFrame] = {"": df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*plain)).alias("_row")).select(key, "_row.*") if plain else df.select(key).where(F.col(key).isNotNull()).distinct()}
    _walk(level, df.schema[root].dataType, key, root, childless, found)
    return found


def _walk(level: DataFrame, kind: ArrayType, key: str, path: str, childless: bool, found: dict[str, DataFrame]) -> None:
    explode = F.explode_outer if childless else F.explode
    nodes = level.select("_key", "_label", explode(_slots(F.col("_list"))).alias("_slot")).select(
        "_key",
        F.concat("_label", F.array(F.coalesce("_slot.at", F.lit(0)))).alias("_label"),
        F.col("_slot.node").alias("_node"),
    )
    element = kind.elementType
    lists = [f for f in element.fields if isinstance(f.dataType, ArrayType)] if isinstance(element, StructType) else []
    plain = (
        [F.col("_node")[f.name].alias(f.name) for f in element.fields if not isinstance(f.dataType, ArrayType)]
        if isinstance(element, StructType)
        else [F.col("_node").alias("value")]
    )
    parent = F.expr("slice(_label, 1, size(_label) - 1)")
    flat = nodes.select(F.col("_key").alias(key), F.col("_label").alias("label"), parent.alias("parent"), *plain)
    found[path] = flat.dropDuplicates([key, "label"])
    for f in lists:
        below = nodes.select("_key", "_label", F.col("_node")[f.name].alias("_list"))
        _walk(below, f.dataType, key, f"{path}.{f.name}", childless, found)

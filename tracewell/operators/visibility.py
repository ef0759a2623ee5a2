"""Viewer grants: which action types a viewer may see.

Grants become a set of at most 40 types per viewer before any fact is read, so
denied rows never take page slots and the filter reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.lookups import page_newest
from tracewell.schema import ACTION_TYPES

# Permission nodes with the op level that stands in for a grant.
NODE_LEVELS = {
    "lookup": 2,
    "lookup.block": 2,
    "lookup.container": 2,
    "lookup.item": 2,
    "lookup.kill": 2,
    "lookup.session": 2,
    "lookup.chat": 3,
    "lookup.command": 3,
    "lookup.sign": 2,
    "rollback": 3,
    "rollback.block": 3,
    "rollback.container": 3,
    "rollback.item": 3,
    "restore": 3,
    "restore.block": 3,
    "restore.container": 3,
    "restore.item": 3,
}
# Child node per type, then per category; the rest falls open.
LOOKUP_TYPE_NODES = {"CHAT": "chat", "COMMAND": "command", "SIGN": "sign"}
CATEGORY_NODES = {
    "lookup": {"BLOCK": "block", "CONTAINER": "container", "ITEM": "item", "ENTITY": "kill", "SESSION": "session"},
    "rollback": {"BLOCK": "block", "CONTAINER": "container", "ITEM": "item"},
    "restore": {"BLOCK": "block", "CONTAINER": "container", "ITEM": "item"},
}


def node_of(family: str, name: str, category: str) -> str:
    child = LOOKUP_TYPE_NODES.get(name) if family == "lookup" else None
    child = child or CATEGORY_NODES[family].get(category)
    return f"{family}.{child}" if child else family


def type_nodes(spark: SparkSession, family: str = "lookup", levels: dict[str, int] | None = None) -> DataFrame:
    """The 40 types with their node and the op level it falls back to.
    Overrides outside 0..4 are ignored."""
    overrides = {k: v for k, v in (levels or {}).items() if 0 <= v <= 4}
    rows = []
    for t in ACTION_TYPES:
        node = node_of(family, t.name, t.category)
        rows.append((t.id, node, overrides.get(node, NODE_LEVELS[node])))
    return spark.createDataFrame(rows, "type int, node string, need int")


def visible_types(viewers: DataFrame, grants: DataFrame, nodes: DataFrame) -> DataFrame:
    """(viewer, type) pairs: an explicit grant or denial decides, else the op
    level. ``viewers`` has viewer, op_level; ``grants`` viewer, node, granted."""
    per_node = (
        viewers.withColumn("_n", F.explode(F.array(*[F.lit(n) for n in sorted(NODE_LEVELS)])))
        .withColumnRenamed("_n", "node")
        .join(grants, ["viewer", "node"], "left")
    )
    return (
        per_node.join(F.broadcast(nodes), "node")  # 40 rows
        .filter(F.coalesce(F.col("granted"), F.col("op_level") >= F.col("need")))
        .select("viewer", "type")
    )


def only_visible(actions: DataFrame, visible: DataFrame, viewer: str | None) -> DataFrame:
    """Facts the viewer may see; no viewer sees all. The viewer's types (at
    most 40) are resolved first and pushed down as a literal list."""
    if viewer is None:
        return actions
    types = [r[0] for r in visible.filter(F.col("viewer") == viewer).select("type").distinct().limit(40).collect()]
    return actions.filter(F.col("type").isin(sorted(types))) if types else actions.filter(F.lit(False))


def page_visible(actions, visible, viewer, page: int, page_size: int) -> DataFrame:
    if page < 1 or page_size < 1:
        raise ValueError("page and page size start at 1")
    return page_newest(only_visible(actions, visible, viewer), page_size, (page - 1) * page_size)


def count_visible(actions: DataFrame, visible: DataFrame) -> DataFrame:
    """Rows each viewer may see. Facts are counted per type once (40 rows),
    whatever the number of viewers."""
    counts = actions.groupBy("type").agg(F.count("*").alias("n"))
    return (
        visible.join(counts, "type")
        .groupBy("viewer")
        .agg(F.sum("n").alias("n"))
    )

"""Structural filters over nodes, chained with AND, and the operations of plans on what they leave."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_filter(value: str | None, page_idx: Column) -> Column:
    """Pages count from 1: `p` or `a-b`. No value or one that is no number leaves all rows."""
    parts = (value or "").split("-")
    try:
        low, high = int(parts[0]), int(parts[-1])
    except ValueError:
        return F.lit(True)
    return (page_idx + 1).between(low, high) if len(parts) <= 2 else F.lit(True)


def section_filter(value: str | None, path_titles: Column) -> Column:
    """Whether the titles on the way from the root, joined without a separator, hold value in any case. No value leaves all rows."""
    if value is None:
        return F.lit(True)
    return F.contains(F.lower(F.array_join(path_titles, "")), F.lit(value.lower()))


def structural(nodes: DataFrame, filters: Sequence[tuple[str, str | None]], kind: str = "type", page: str = "page_idx", titles: str = "path_titles") -> DataFrame:
    """nodes that pass all of (filter_type, filter_value): image, table, page, section."""
    made = {"image": lambda v: F.col(kind) == "image", "table": lambda v: F.col(kind) == "table", "page": lambda v: page_filter(v, F.col(page)), "section": lambda v: section_filter(v, F.col(titles))}
    return reduce(lambda df, f: df.where(made[f[0]](f[1])) if f[0] in made else df, filters, nodes)


def lookup(nodes: DataFrame, ids: Sequence[int], key: str = "index_id") -> DataFrame:
    """The nodes of some ids in the order asked for; ids that are not there are dropped."""
    asked = nodes.sparkSession.createDataFrame([(i, n) for n, i in enumerate(ids)], f"{key} long, _order int")
    return nodes.join(F.broadcast(asked), key).orderBy("_order").drop("_order")


def renumber(rows: DataFrame, doc: str, order: str, invalid: str) -> DataFrame:
    """Valid rows numbered from 1 within their document."""
    from pyspark.sql import Window

    return rows.where(~F.coalesce(F.col(invalid), F.lit(False))).withColumn("pdf_id", F.row_number().over(Window.partitionBy(doc).orderBy(order)))


def payload(nodes: DataFrame) -> DataFrame:
    """What is shown of a node, by type."""
    return nodes.select(
        "node_id", "type", "content",
        F.when(F.col("type") == "image", F.col("img_path")).alias("img_path"),
        F.when(F.col("type") == "table", F.col("table_body")).alias("table_body"),
    )


def route(nodes: DataFrame, text: str, image: str) -> DataFrame:
    """nodes with route: text, image, fused, or none."""
    t, i = F.coalesce(F.trim(text) != "", F.lit(False)), F.col(image).isNotNull()
    return nodes.withColumn("route", F.when(t & i, "fused").when(t, "text").when(i, "image").otherwise("none"))

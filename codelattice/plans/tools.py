"""Ad-hoc SQL over views, and named tools."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.operators import hops, search, traversal


# Words that no ad-hoc query may hold, wherever they stand.
WRITING = ("CREATE", "MERGE", "DELETE", "SET", "REMOVE", "DROP")


def read_only(views: Mapping[str, DataFrame], text: str, args: Mapping[str, object] | None = None) -> DataFrame:
    """Run a query over the given frames by name, with named parameters.

    A text that holds one of the words in WRITING is refused, whatever it means there, and so is one that
    begins with neither SELECT nor WITH. The names are views only while the query is analysed; a
    name that the session already uses is refused too.
    """
    found = [w for w in WRITING if w in text.upper()]
    if found or not text.lstrip().lower().startswith(("select", "with")):
        raise ValueError(f"only queries are allowed{': ' + ', '.join(found) if found else ''}")
    spark = next(iter(views.values())).sparkSession
    taken = [n for n in views if spark.catalog.tableExists(n)]
    if taken:
        raise ValueError(f"the session has these names already: {', '.join(taken)}")
    try:
        for name, df in views.items():
            df.createTempView(name)
        return spark.sql(text, args=dict(args or {}))
    finally:
        for name in views:
            spark.catalog.dropTempView(name)


def _callers(nodes: DataFrame, edges: DataFrame, name: str, depth: int = 2) -> DataFrame:
    seeds = nodes.where(F.col("name") == name)
    return traversal.depths(edges, seeds, depth, reverse=True).where("depth > 0").join(nodes, "id").orderBy("depth", "id").limit(150)


def _related(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    return hops.neighbourhood(nodes, edges, nodes.where(F.col("name") == name).select("id"))


def _expand(nodes: DataFrame, edges: DataFrame, name: str, depth: int = 2) -> DataFrame:
    return traversal.reach(edges, nodes.where(F.col("name") == name), 1, depth, both_ways=True).join(nodes, "id")


#: Tools by name; each takes nodes, edges and its own parameters.
TOOLS: dict[str, Callable[..., DataFrame]] = {
    "nodes_of_kind": lambda nodes, edges, kind, limit=100: nodes.where(F.col("kind") == kind).orderBy("id").limit(limit),
    "edges_of_type": lambda nodes, edges, type, limit=100: edges.where(F.col("type") == type).orderBy("src", "dst").limit(limit),  # noqa: A002
    "callers": _callers, "related": _related, "expand": _expand,
    "similar": lambda nodes, edges, words, limit=20: search.similar_by_keyword(nodes, words, limit),
    "lookup": lambda nodes, edges, name: search.exact_then_partial(nodes, name),
    "schema": lambda nodes, edges: nodes.select(F.col("kind").alias("name")).distinct().unionByName(edges.select(F.col("type").alias("name")).distinct()),
}


def call_tool(tool: str, nodes: DataFrame, edges: DataFrame, **parameters) -> DataFrame:
    if tool not in TOOLS:
        raise KeyError(f"no tool {tool!r}; there are {', '.join(TOOLS)}")
    return TOOLS[tool](nodes, edges, **parameters)

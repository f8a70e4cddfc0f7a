"""Schemas of the property graph's tables, and checks of what the schemas cannot say."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = """repo_id string, entity_id string, kind string, name string, file_path string, language string,
 start_line int, end_line int, loc int, parent_id string, visibility string, is_exported boolean,
 is_abstract boolean, is_async boolean, is_static boolean, return_type string, signature string,
 complexity int, cognitive int, nesting int, param_count int, stereotype string, has_doc boolean,
 is_deprecated boolean, modifiers array<string>, implements array<string>,
 tags array<struct<tag: string, name: string, description: string>>, page_rank double,
 props map<string, string>, created_at timestamp"""

EDGES = """repo_id string, entity_id string, type string, src string, dst string, weight int,
 line_number int, props map<string, string>, created_at timestamp"""

FILES = "repo_id string, path string, name string, ext string, content_hash string, mtime timestamp, size long"


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """The keys that are not unique, with how often they stand."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    known = nodes.select(F.col("entity_id").alias("_known"))
    return edges.join(known, edges["src"] == F.col("_known"), "left_anti").unionByName(edges.join(known, edges["dst"] == F.col("_known"), "left_anti")).distinct()

"""Canonical ids and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entity_id(prefix: Column, repo: Column | None, qualified_name: Column) -> Column:
    """``prefix:repo:name`` in lower case; backslashes become slashes and other odd characters ``_``."""
    name = F.regexp_replace(F.lower(F.regexp_replace(qualified_name, r"\\", "/")), r"[^a-z0-9_.:/-]", "_")
    parts = [F.lower(prefix), name] if repo is None else [F.lower(prefix), F.regexp_replace(F.lower(repo), r"[^a-z0-9-]", "_"), name]
    return F.concat_ws(":", *parts)


def join_path(base: Column, path: Column) -> Column:
    """Two paths with one slash between them."""
    left, right = F.regexp_replace(base, "/+$", ""), F.regexp_replace(path, "^/+", "")
    return F.when(right == "", F.when(left == "", F.lit("/")).otherwise(left)).otherwise(F.concat(left, F.lit("/"), right))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def base_path(path: Column) -> Column:
    """The first two static segments; a segment that starts with ``:``, ``[``, ``{`` or ``*`` ends it."""
    return F.regexp_extract(path, r"^((?:/[^/:\[*{][^/]*){0,2})", 1)


def path_parameters(path: Column) -> Column:
    """Names in ``{x}``, ``:x``, ``<x>`` and ``[x]``, by place."""
    found = F.regexp_extract_all(path, F.lit(r"(\{[^}/]+\}|:[A-Za-z_]\w*|<[^>/]+>|\[[^\]/]+\])"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"[{}:<>\[\]]", ""), r"^\.\.\.", ""))


def before_first(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def source_type(path: Column) -> Column:
    """test, resource, main or other, from the folders of a path."""
    from codelattice.functions.ladders import first_match

    return first_match(F.lower(F.regexp_replace(path, r"\\", "/")), (
        (r"/src/test/|/test/|/__tests__/|\.test\.|\.spec\.|-test/", "test"), ("/resources/|/assets/|/webapp/", "resource"), ("/src/main/|/src/|/main/", "main"),
    ), "other")

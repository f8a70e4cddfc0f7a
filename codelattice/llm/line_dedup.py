"""Line dedup by overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import cut, free_name, join_hot, row_key

#: A window's size in lines.
WINDOW = 3


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The lines to remove from each document: (key, removed) with 0-based line numbers in ascending order.

    A text is cut at line feeds. Blank lines (nothing but white space) are skipped; ``window``
    consecutive other lines of one document make a window, known by the MD5 of its exact lines.
    Of the places of a window in the whole corpus the first by (id, row key, line) stays; the
    lines that any later place covers are removed. Texts with fewer non-blank lines have no
    window and stay as they are. One place per window is kept after partial aggregation, and the
    places of a window in a large share of all documents are dealt over several tasks (``join_hot``).
    """
    lines = F.filter(
        F.transform(F.split(F.col(text_col), "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("line"))),
        lambda x: x["line"].rlike(r"[^\s]"),
    )
    rows = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), F.explode(F.array(lines)).alias("lines"))
    wide = lambda n: F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.struct(
            F.element_at("lines", i)["at"].alias("at"),
            F.unhex(F.md5(F.array_join(F.transform(F.slice("lines", i, window), lambda x: x["line"]), "\n"))).alias("hash"),
            F.transform(F.slice("lines", i, window), lambda x: x["at"]).alias("covers"),
        ),
    )
    places = cut(
        rows.where(F.size("lines") >= window)
        .select("id", "key", F.explode(wide(F.size("lines") - (window - 1))).alias("w"))
        .select("id", "key", "w.at", "w.hash", "w.covers"),
        "windows",
    )
    first = places.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct("id", "key", "at")).alias("first")).where("n > 1").select("hash", "first")
    later = join_hot(places, first, "hash").where(~F.struct("id", "key", "at").eqNullSafe(F.col("first")))
    return later.groupBy("key").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("covers")))).alias("removed"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the later places of repeated windows taken out of the text.

    All columns come back, the text replaced, and ``n_removed_lines`` added (in place of a column of
    that name): one row per input
    row. Rows equal in id and text count as one document and get the same result. Null texts
    stay null, a text without a kept line becomes empty, line order never changes.
    """
    row, key, gone = (free_name(docs, x) for x in ("line_row", "line_key", "line_gone"))
    found = repeated_lines(docs, id_col=id_col, text_col=text_col, window=window).select(F.col("key").alias(key), F.col("removed").alias(gone))
    joined = docs.withColumn(row, row_key(id_col, text_col)).join(found, F.col(row) == F.col(key), "left")
    # What stays are the runs between one removed line and the next, so the work grows with the lines. The lines are bound once.
    runs = lambda lines: F.zip_with(F.array_prepend(gone, F.lit(-1)), F.array_append(gone, F.size(lines)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    kept = F.transform(
        F.array(F.split(F.col(text_col), "\n")),
        lambda lines: F.array_join(F.flatten(F.transform(runs(lines), lambda r: F.slice(lines, r["a"] + 2, r["b"] - r["a"] - 1))), "\n"),
    )[0]
    return joined.select(
        *(F.when(F.col(gone).isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != "n_removed_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed_lines"),
    )

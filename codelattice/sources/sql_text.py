"""SQL in sources: statements put together over lines, what they read and write, and the columns of table definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelattice.functions import code_text
from codelattice.sources.java_blocks import _visible

#: Parts texts that share a statement.
_APART = "\ue010"
_VERB = r"(?i)^\s*(select|insert|update|delete|merge|with|call|create|alter|drop)\b"


def statements(found: DataFrame) -> DataFrame:
    """(path, method, owner, n, line, sql): the SQL that Java statements hold, put together from pieces.

    Pieces of one statement joined by a plus sign, the pieces that later statements add to the same variable (``+=`` or ``append``), and text blocks make one text;
    a name between two pieces becomes a question mark. A piece that begins with an SQL verb, or a new assignment, begins another
    text, so a variable's pieces fall into islands by a running count of such beginnings. Texts that don't begin with a verb are left out.
    """
    text = F.regexp_replace("text", r"\)\s*\.\s*append\s*\(", " + ")
    variable = F.coalesce(*(F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in (r"^(\w+)\s*\.\s*append\s*\(", r"^(\w+)\s*\+=", r"^(?:[\w.<>\[\], ]+\s+)?(\w+)\s*=[^=]")))
    parts = F.split(F.regexp_replace(text, r"new\s+StringBu\w+\s*\(\s*\"", '"'), '"')
    gap = lambda x, i: F.when((i == 0) | (i == F.size("parts") - 1), "").when(x.rlike(r"[,()]"), _APART).when(x.rlike(r"\w"), " ? ").otherwise("")
    rows = found.where(F.contains("text", F.lit('"')) & F.col("method").isNotNull()).withColumn("variable", variable).withColumn("parts", parts)
    rows = rows.withColumn("sql", F.split(F.array_join(F.transform("parts", lambda x, i: F.when(i % 2 == 1, x).otherwise(gap(x, i))), ""), _APART))
    adds = F.col("text").rlike(r"^\w+\s*(\.\s*append\s*\(|\+=)")
    pieces = rows.select("path", "method", "owner", "n", F.col("end_line").alias("line"), F.coalesce("variable", F.concat(F.lit("#"), F.col("n").cast("string"))).alias("variable"), adds.alias("adds"), F.posexplode("sql").alias("k", "piece"))
    by = Window.partitionBy("path", "method", "variable").orderBy("n", "k")
    starts = ~F.col("adds") | (F.col("k") > 0) | F.col("piece").rlike(_VERB)
    pieces = pieces.withColumn("island", F.sum(starts.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    g = pieces.groupBy("path", "method", "owner", "variable", "island").agg(
        F.min("n").alias("n"), F.min("line").alias("line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "k", "piece"))), lambda x: x["piece"]), "").alias("sql"))
    g = g.withColumn("sql", F.trim(F.regexp_replace(_visible(F.col("sql")), r"\s+", " ")))
    return g.where(F.col("sql").rlike(_VERB)).select("path", "method", "owner", "n", "line", "sql")


def lineage(texts: DataFrame) -> DataFrame:
    """Statements with kind, reads and writes (tables), and read_columns and written_columns.

    An insert, update, delete or merge writes its main table; other tables of it, also those of its inner selects, are read.
    Columns of a select are read, those of an insert or update written; columns compared behind WHERE and ON are read too.
    """
    # What a statement is follows from its first word, so inner selects are taken out before it is looked at.
    verb = F.upper(F.regexp_extract("sql", _VERB, 1))
    outside = F.when(verb.isin("UPDATE", "DELETE", "MERGE"), F.regexp_replace("sql", r"(?i)\(\s*select\b(?:[^()]|\([^()]*\))*\)", "(0)")).when(
        (verb == "INSERT") & F.col("sql").rlike(r"(?i)\bselect\b"), F.concat(F.regexp_extract("sql", r"(?i)^(insert\s+into\s+\w+\s*(?:\([^)]*\))?)", 1), F.lit(" VALUES (0)"))).otherwise(F.col("sql"))
    rows = texts.withColumn("s", code_text.sql_statement(outside)).withColumn("kind", F.col("s.kind"))
    all_of = lambda p: F.regexp_extract_all("sql", F.lit(f"(?i){p}"), F.lit(1))
    named = F.array_distinct(F.concat(F.col("s.tables"), all_of(r"\bfrom\s+(\w+)"), all_of(r"\bjoin\s+(\w+)"), all_of(r"\busing\s+(\w+)")))
    writes = F.when(F.col("kind").isin("INSERT", "UPDATE", "DELETE", "MERGE") & (F.col("s.main_table") != ""), F.array("s.main_table")).otherwise(F.array().cast("array<string>"))
    behind = F.regexp_extract("sql", r"(?i)\b(?:where|on)\s+(.*)$", 1)
    compared = F.regexp_extract_all(behind, F.lit(r"(?:\w+\.)?\b([A-Za-z_]\w*)\s*(?:=|<>|!=|<=|>=|<|>|\blike\b|\bin\b|\bis\b|\bbetween\b)"), F.lit(1))
    bare = lambda c: F.transform(c, lambda x: F.regexp_replace(x, r"^\w+\.", ""))
    changed = F.col("kind").isin("INSERT", "UPDATE")
    none = F.array().cast("array<string>")
    return rows.select(
        *texts.columns, "kind", F.array_sort(F.array_except(named, writes)).alias("reads"), writes.alias("writes"),
        F.array_sort(F.array_distinct(F.concat(F.when(changed, none).otherwise(bare(F.col("s.columns"))), compared))).alias("read_columns"), F.array_sort(F.array_distinct(F.when(changed, bare(F.col("s.columns"))).otherwise(none))).alias("written_columns"))


def table_access(found: DataFrame, *by: str) -> DataFrame:
    """(by..., table, access, kinds): each table that the statements of a method, type or file read or write, once."""
    marked = lambda names, access: F.transform(names, lambda x: F.struct(x.alias("table"), F.lit(access).alias("access")))
    one = found.select(*by, "kind", F.inline(F.concat(marked("reads", "read"), marked("writes", "write"))))
    return one.groupBy(*by, "table", "access").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def table_columns(files: DataFrame) -> DataFrame:
    """(path, table, position, column, type, nullable, primary_key, references): the columns of CREATE TABLE statements of SQL files (path, text), over lines.

    Parts are cut at commas outside parentheses; keys that a statement declares for itself mark their columns. Comments are skipped.
    """
    inner = r"(?:[^()]|\((?:[^()]|\([^()]*\))*\))*+"
    bare = F.regexp_replace(F.regexp_replace("text", r"--[^\n]*", ""), r"(?s)/\*.*?\*/", " ")
    p = rf"(?is)\bcreate\s+(?:temporary\s+)?table\s+(?:if\s+not\s+exists\s+)?[\"`]?([\w.]+)[\"`]?\s*\(({inner})\)"
    tables = F.zip_with(F.regexp_extract_all(bare, F.lit(p), F.lit(1)), F.regexp_extract_all(bare, F.lit(p), F.lit(2)), lambda t, b: F.struct(t.alias("table"), b.alias("body")))
    rows = files.where("text is not null").select("path", F.inline(tables))
    parts = F.regexp_extract_all("body", F.lit(r"((?:[^(),]|\((?:[^()]|\([^()]*\))*\))++)"), F.lit(1))
    rows = rows.select("path", "table", F.posexplode(F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")).alias("position", "part"))
    declared = F.col("part").rlike(r"(?i)^(constraint\s+\w+\s+)?(primary\s+key|foreign\s+key|unique|check|key|index)\b")
    keys = rows.where(declared)
    listed = lambda p: F.transform(F.split(F.regexp_extract("part", p, 1), ","), lambda x: F.lower(F.regexp_replace(F.trim(x), "[\"`]", "")))
    primary = keys.where(F.col("part").rlike(r"(?i)primary\s+key")).select("path", "table", F.explode(listed(r"(?i)primary\s+key\s*\(([^)]*)\)")).alias("k"), F.lit(True).alias("is_key"))
    foreign = keys.where(F.col("part").rlike(r"(?i)foreign\s+key")).select("path", "table", F.explode(listed(r"(?i)foreign\s+key\s*\(([^)]*)\)")).alias("k"), F.regexp_extract("part", r"(?i)references\s+([\w.]+)", 1).alias("to_table"))
    said = r"(?i)^[\"`]?(\w+)[\"`]?\s+(\w+(?:\s*\([^)]*\))?)"
    columns = rows.where(~declared).select("path", "table", "position", "part", F.regexp_extract("part", said, 1).alias("column"), F.upper(F.regexp_replace(F.regexp_extract("part", said, 2), r"\s+", "")).alias("type"))
    columns = columns.where("column <> ''").withColumn("k", F.lower("column")).join(primary.distinct(), ["path", "table", "k"], "left").join(foreign.groupBy("path", "table", "k").agg(F.min("to_table").alias("to_table")), ["path", "table", "k"], "left")
    key = F.coalesce("is_key", F.lit(False)) | F.col("part").rlike(r"(?i)\bprimary\s+key\b")
    return columns.select("path", "table", "position", "column", "type", (~F.col("part").rlike(r"(?i)\bnot\s+null\b") & ~key).alias("nullable"), key.alias("primary_key"),
                          F.coalesce("to_table", F.nullif(F.regexp_extract("part", r"(?i)\breferences\s+([\w.]+)", 1), F.lit(""))).alias("references"))

"""Java sources as statements and blocks: owners of members, overloads, calls and thrown messages.

A file is cut at braces and semicolons that stand outside strings and comments. Each piece is a segment; one that ends in an
opening brace is the head of a block. A sweep over a file's segments tells for each of them the block, type, method and
conditions around it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelattice.sources.parsers import lines_of

#: Braces and semicolons inside literals stand as these until the cut is done, as do escaped quotes.
_HIDDEN = "\ue000\ue001\ue002\ue003"
_PARENS = r"(?:[^()]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*+"
_MODIFIERS = r"(?:(?:public|protected|private|static|final|abstract|synchronized|default|native|strictfp|sealed|transient|volatile)\s+)*+"
_ANNOTATIONS = rf"^\s*(?:@(?!interface)[\w.]+\s*(?:\({_PARENS}\))?\s*)++"
_TYPE = rf"^{_MODIFIERS}(class|@?interface|enum|record)\s+(\w+)"
_METHOD = rf"^{_MODIFIERS}(?:<[^()]*>\s*)?+(?:([\w.$<>\[\],?& ]+?)\s+)?(?!(?:if|for|while|switch|catch|synchronized|return|new|throw|else|try|do)\b)(\w+)\s*\(({_PARENS})\)\s*(?:throws\s+([\w.,\s]+))?$"
_FIELD = rf"^{_MODIFIERS}([\w.$<>\[\],?& ]+?)(?<!,)\s+(\w+)\s*(?:=.*)?$"
_IF = rf"^(?:else\s+)?if\s*\(({_PARENS})\)"


def _visible(c: Column) -> Column:
    return F.translate(F.replace(c, F.lit(_HIDDEN[3]), F.lit('\\"')), _HIDDEN[:3], "{};")


def segments(files: DataFrame) -> DataFrame:
    """(path, n, start_line, end_line, text, mark): the pieces of Java files (path, text) in order, each with the brace or semicolon that ends it.

    Text blocks may span lines; the semicolons of a ``for`` don't cut. Null and empty texts have no pieces, and a file is cut by windows over its lines and pieces only.
    """
    rows = lines_of(files.withColumn("language", F.lit("java")))
    before = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    fences = (F.length("code") - F.length(F.replace("code", F.lit('"""'), F.lit("")))) / 3
    rows = rows.withColumn("inside", F.coalesce(F.sum(fences.cast("int")).over(before), F.lit(0)) % 2 == 1)
    code = F.replace(F.replace("code", F.lit('"""'), F.lit('"')), F.lit('\\"'), F.lit(_HIDDEN[3]))
    parts = F.transform(F.split(code, '"'), lambda x, i: F.when((i % 2 == 1) != F.col("inside"), F.translate(x, "{};", _HIDDEN[:3])).otherwise(x))
    masked = F.array_join(parts, '"')
    for i, mark in enumerate("{};"):
        masked = F.replace(masked, F.lit(f"'{mark}'"), F.lit(f"'{_HIDDEN[i]}'"))
    masked = F.regexp_replace(masked, r"\bfor\s*\(([^;{}]*);([^;{}]*);", f"for ($1{_HIDDEN[2]}$2{_HIDDEN[2]}")
    pieces = rows.select("path", "line", F.posexplode(F.regexp_extract_all(masked, F.lit(r"([{};]|[^{};]++)"), F.lit(1))).alias("k", "piece"))
    pieces = pieces.withColumn("ends", F.col("piece").isin("{", "}", ";"))
    ordered = Window.partitionBy("path").orderBy("line", "k").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("n", F.coalesce(F.sum(F.col("ends").cast("int")).over(ordered), F.lit(0)))
    said = ~F.col("ends") & (F.trim("piece") != "")
    row = F.when(~F.col("ends"), F.struct("line", "k", F.when(F.col("k") == 0, F.concat(F.lit("\n"), "piece")).otherwise(F.col("piece")).alias("piece")))
    g = pieces.groupBy("path", "n").agg(
        F.coalesce(F.min(F.when(said, F.col("line"))), F.max("line")).alias("start_line"), F.max("line").alias("end_line"),
        F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["piece"]), "").alias("text"), F.coalesce(F.max(F.when(F.col("ends"), F.col("piece"))), F.lit("")).alias("mark"))
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    return g.withColumn("text", text).where("mark <> '' or text <> ''")


def _around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The block, type, method and conditions around each segment of a file, from segments in order."""
    path, stack = None, []
    for rows in batches:
        out = []
        for p, n, line, mark, kind, label in zip(*(rows[c].tolist() for c in ("path", "n", "start_line", "mark", "kind", "label")), strict=True):
            if p != path:
                path, stack = p, []
            # A block is (n, kind, type path, type's number, method's number, method's line, conditions).
            top = stack[-1] if stack else (None, "file", None, None, None, None, ())
            out.append((top[0], top[1], top[2], top[3], top[4], top[5], list(top[6])))
            if mark == "{":
                if kind == "type":
                    stack.append((n, "type", f"{top[2]}.{label}" if top[2] else label, n, None, None, ()))
                elif kind == "callable" and top[1] == "type":
                    stack.append((n, "method", top[2], top[3], n, line, ()))
                else:
                    stack.append((n, "if" if kind == "if" else "block", *top[2:6], (*top[6], label) if kind == "if" else top[6]))
            elif mark == "}" and stack:
                stack.pop()
        found = pd.DataFrame(out, columns=["block", "block_kind", "owner", "owner_n", "method", "method_line", "outer"], dtype=object)
        yield pd.concat([rows.reset_index(drop=True), found], axis=1)


def blocks(files: DataFrame) -> DataFrame:
    """Segments with ``head`` (the text without leading annotations), kind (type, if, callable or block), label (a type's or method's name, a condition), and what is
    around them: block (its number; null in none), block_kind (file, type, method, if or block), owner (the path of types), owner_n,
    method, method_line, outer (the conditions of enclosing ifs in this method, outermost first). A file is one sweep in one task."""
    s = segments(files).withColumn("head", F.regexp_replace(F.regexp_replace("text", _ANNOTATIONS, ""), r"\s+", " "))
    part = lambda p, n: F.regexp_extract("head", p, n)
    kind = F.when(F.col("head").rlike(_TYPE), "type").when(F.col("head").rlike(_IF), "if").when(F.col("head").rlike(_METHOD), "callable").otherwise("block")
    s = s.withColumn("kind", kind).withColumn("label", F.when(F.col("kind") == "type", part(_TYPE, 2)).when(F.col("kind") == "if", F.trim(_visible(part(_IF, 1)))).when(F.col("kind") == "callable", part(_METHOD, 2)))
    s = s.withColumn("n", F.col("n").cast("int")).withColumn("start_line", F.col("start_line").cast("int"))
    schema = ", ".join(f"{n} {t}" for n, t in s.dtypes) + ", block int, block_kind string, owner string, owner_n int, method int, method_line int, outer array<string>"
    return s.repartition("path").sortWithinPartitions("path", "n").mapInPandas(_around, schema)


def ends(found: DataFrame) -> DataFrame:
    """(path, n, close, last_line): the segment and line that close each block."""
    return found.where("mark = '}' and block is not null").select("path", F.col("block").alias("n"), F.col("n").alias("close"), F.col("end_line").alias("last_line"))


def _types_of(params: Column) -> Column:
    """The parameter types of a list: without annotations, ``final``, generics and names."""
    bare = F.regexp_replace(params, rf"@[\w.]+\s*(?:\({_PARENS}\))?|\bfinal\s+", "")
    for _ in range(4):
        bare = F.regexp_replace(bare, r"<[^<>]*>", "")
    return F.filter(F.transform(F.split(bare, ","), lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"\s*\.\.\.\s*", "[] "), r"\s+\w+((?:\[\])*)$", "$1")), lambda x: x != "")


def members(found: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(path, n, kind, name, owner, qualified, params, arity, overload, type, modifiers, annotations, throws, start_line, last_line, snippet).

    Types, methods, constructors and fields with the type that they stand in, which after a nested type is the outer one again. ``qualified`` tells
    overloads apart by their parameter types, and ``overload`` numbers the methods of a name in a type from 1. The snippet is the whole
    text from the first to the last line, if ``files`` are given.
    """
    part = lambda p, n: F.nullif(F.trim(F.regexp_extract("head", p, n)), F.lit(""))
    marks = F.regexp_extract("text", _ANNOTATIONS, 0)
    in_type = F.col("block_kind") == "type"
    is_method = in_type & (F.col("kind") == "callable") & F.col("mark").isin("{", ";")
    is_field = in_type & (F.col("mark") == ";") & (F.col("kind") == "block") & F.col("head").rlike(_FIELD)
    kind = F.when((F.col("kind") == "type") & (F.col("mark") == "{"), F.initcap(F.regexp_replace(F.regexp_extract("head", _TYPE, 1), "@", ""))).when(
        is_method, F.when(part(_METHOD, 1).isNull(), "Constructor").otherwise("Method")).when(is_field, "Field")
    rows = found.withColumn("member", kind).where("member is not null").join(ends(found), ["path", "n"], "left")
    method = F.col("member").isin("Method", "Constructor")
    params = F.when(method, _types_of(F.regexp_extract("head", _METHOD, 3)))
    rows = rows.select(
        "path", "n", F.col("member").alias("kind"), F.when(is_field, part(_FIELD, 2)).otherwise(F.col("label")).alias("name"), "owner", params.alias("params"),
        F.when(is_field, part(_FIELD, 1)).otherwise(F.when(method, part(_METHOD, 1))).alias("type"), F.filter(F.split(F.regexp_extract("head", rf"^({_MODIFIERS})", 1), " "), lambda x: x != "").alias("modifiers"),
        F.regexp_extract_all(marks, F.lit(r"@(?!interface)([\w.]+)"), F.lit(1)).alias("annotations"), F.when(method, F.filter(F.split(F.coalesce(part(_METHOD, 4), F.lit("")), r"[,\s]+"), lambda x: x != "")).alias("throws"),
        "start_line", F.coalesce("last_line", "end_line").alias("last_line"),
    )
    number = F.row_number().over(Window.partitionBy("path", "owner", "name", "kind").orderBy("n"))
    out = rows.withColumn("arity", F.size("params")).withColumn("overload", F.when(F.col("params").isNotNull(), number)).withColumn(
        "qualified", F.concat(F.concat_ws(".", "owner", "name"), F.when(F.col("params").isNotNull(), F.concat(F.lit("("), F.array_join("params", ","), F.lit(")"))).otherwise("")))
    if files is None:
        return out
    lines = files.select("path", F.split("text", "\n").alias("all_lines"))
    return out.join(lines, "path").withColumn("snippet", F.array_join(F.slice("all_lines", F.col("start_line").cast("int"), (F.col("last_line") - F.col("start_line") + 1).cast("int")), "\n")).drop("all_lines")


def thrown(found: DataFrame) -> DataFrame:
    """(path, method, line, exception, message): what statements throw, with the message where it is a literal."""
    p = r"\bthrow\s+new\s+(\w+)\s*\(\s*(?:\"([^\"]*)\")?"
    rows = found.where(F.col("head").rlike(p))
    return rows.select("path", "method", F.col("end_line").alias("line"), F.regexp_extract("head", p, 1).alias("exception"), F.nullif(_visible(F.regexp_extract("head", p, 2)), F.lit("")).alias("message"))


def calls(found: DataFrame) -> DataFrame:
    """(path, n, method, owner, receiver, name, arity): calls in method bodies; the receiver is the name before the dot, null for a call of the own type.

    Arguments are counted at the call's own level; strings count as one.
    """
    bare = F.regexp_replace("head", r"\"[^\"]*\"", '""')
    own = F.when((F.col("kind") == "callable") & (F.col("block_kind") == "type"), F.lit("")).otherwise(bare)
    p = rf"((?:\b\w+\s*\.\s*)?\b\w+\s*\({_PARENS}\))"
    # Calls inside the arguments of a call are found in a second pass over the arguments.
    outer = F.regexp_extract_all(own, F.lit(p), F.lit(1))
    inner = F.flatten(F.transform(outer, lambda c: F.regexp_extract_all(F.regexp_extract(c, r"\((.*)\)$", 1), F.lit(p), F.lit(1))))
    rows = found.where("method is not null").select("path", "n", "method", "owner", F.explode(F.concat(outer, inner)).alias("c"))
    said = F.regexp_extract("c", r"\((.*)\)$", 1)
    for _ in range(3):
        said = F.regexp_replace(said, r"\([^()]*\)", "")
    arity = F.when(F.trim(said) == "", 0).otherwise(F.size(F.split(F.regexp_replace(said, r"<[^<>]*>", ""), ",")))
    receiver = F.nullif(F.regexp_extract("c", r"^(\w+)\s*\.", 1), F.lit(""))
    rows = rows.select("path", "n", "method", "owner", F.when(receiver != "this", receiver).alias("receiver"), F.regexp_extract("c", r"(\w+)\s*\(", 1).alias("name"), arity.alias("arity"))
    return rows.where(~F.col("name").isin("if", "for", "while", "switch", "catch", "synchronized", "return", "super", "this") & ~F.coalesce("receiver", F.lit("")).isin("new"))


def variables(found: DataFrame, held: DataFrame) -> DataFrame:
    """(path, owner, method, name, type): fields (method null), parameters and locals with their declared types, without generics."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"<.*>", ""), r"\[\]", "")
    fields = held.where("kind = 'Field'").select("path", "owner", F.lit(None).cast("int").alias("method"), "name", plain(F.col("type")).alias("type"))
    heads = found.where("kind = 'callable' and block_kind = 'type' and mark = '{'")
    bare = F.regexp_extract("head", _METHOD, 3)
    for _ in range(4):
        bare = F.regexp_replace(bare, r"<[^<>]*>", "")
    listed = heads.select("path", "owner", F.col("n").alias("method"), F.explode(F.split(bare, ",")).alias("p")).where("trim(p) <> ''")
    params = listed.select("path", "owner", "method", F.regexp_extract("p", r"(\w+)\s*$", 1).alias("name"), F.regexp_extract("p", r"([\w.]+)\s*(?:\[\]|\.\.\.)?\s+\w+\s*$", 1).alias("type"))
    p = r"^(?:final\s+)?([A-Z][\w.]*)(?:<[^=]*>)?\s+(\w+)\s*="
    local = found.where(F.col("method").isNotNull() & F.col("head").rlike(p)).select("path", "owner", "method", F.regexp_extract("head", p, 2).alias("name"), F.regexp_extract("head", p, 1).alias("type"))
    return fields.unionByName(params).unionByName(local).where("name <> '' and type <> ''").distinct()

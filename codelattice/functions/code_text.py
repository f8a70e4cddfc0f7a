"""Metrics of source text as expressions: lines of code, complexity, nesting, parameters, SQL."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that count one each for cyclomatic complexity, beside a base of 1.
BRANCHES = (r"\bif\b", r"\belse\s+if\b", r"\bfor\b", r"\bforeach\b", r"\bwhile\b", r"\bdo\b", r"\bcase\b", r"\bcatch\b", r"\?\s*[^:]", r"&&", r"\|\|", r"\?\?")
# Words that nest, and words of SQL.
NESTING = r"\b(if|for|foreach|while|do|switch|try|catch)\b"
SQL_WORDS = ("SELECT", "INSERT", "UPDATE", "DELETE", "FROM", "WHERE", "JOIN", "SET", "VALUES", "INTO", "MERGE", "CALL")


def cyclomatic(text: Column) -> Column:
    """1 plus the matches of every branch pattern, so ``else if`` counts twice."""
    return sum((F.regexp_count(text, F.lit(p)) for p in BRANCHES), F.lit(1))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def text_metrics(text: Column) -> Column:
    """struct(loc, nesting): lines that are neither blank nor comment, and the deepest surplus of
    opening over closing brackets on them. One fold over the lines carries the block comment state."""
    start = F.struct(F.lit(0).alias("loc"), F.lit(0).alias("open"), F.lit(0).alias("deepest"), F.lit(False).alias("block"))
    quotes = ('"' * 3, "'" * 3)
    some = lambda *tests: functools.reduce(operator.or_, tests)
    count = lambda line, marks: F.length(line) - F.length(F.translate(line, marks, ""))

    def step(s: Column, line: Column) -> Column:
        # Plain string tests: regular expressions would cost several times as much for each line.
        t = F.trim(line, F.lit(" \t\r\x0b\x0c"))
        comment = some(*(t.startswith(x) for x in ("//", "#", "--")))
        opens = some(*(t.startswith(x) for x in ("/*", *quotes)))
        closed = t.endswith("*/") | ((F.length(t) > 3) & some(*(t.endswith(x) for x in quotes)))
        ends = some(*(t.contains(x) for x in ("*/", *quotes)))
        code = ~s["block"] & (t != "") & ~comment & ~opens
        now = s["open"] + count(line, "{(") - count(line, "})")
        return F.struct(
            (s["loc"] + code.cast("int")).alias("loc"),
            F.when(code, now).otherwise(s["open"]).alias("open"),
            F.when(code, F.greatest(s["deepest"], now)).otherwise(s["deepest"]).alias("deepest"),
            F.when(s["block"], ~ends).otherwise(opens & ~comment & ~closed).alias("block"),
        )

    return F.aggregate(_lines(text), start, step, lambda s: F.struct(s["loc"].alias("loc"), s["deepest"].alias("nesting")))


def cognitive(text: Column) -> Column:
    """Cognitive complexity line by line: a nesting word costs 1 plus the depth, a bare ``else`` and
    a line with ``&&`` or ``||`` 1 each; depth follows braces and never falls below 0."""
    start = F.struct(F.lit(0).alias("cost"), F.lit(0).alias("depth"))

    def step(s: Column, line: Column) -> Column:
        t = F.regexp_replace(line, r"^\s+|\s+$", "")
        word = t.rlike(NESTING)
        deeper = s["depth"] + (word & t.contains("{")).cast("int")
        cost = (
            s["cost"] + F.when(word, 1 + s["depth"]).otherwise(0)
            + (t.rlike(r"\belse\b") & ~t.rlike(r"\belse\s+if\b")).cast("int") + t.rlike(r"&&|\|\|").cast("int")
        )
        after = F.struct(cost.alias("cost"), F.when(t.contains("}"), F.greatest(F.lit(0), deeper - 1)).otherwise(deeper).alias("depth"))
        return F.when(t.rlike(r"^(//|#|\*)"), s).otherwise(after)

    # Words end at any letter that is not ASCII, as they do in the rule.
    return F.aggregate(_lines(F.regexp_replace(text, r"[^\x00-\x7F]", " ")), start, step, lambda s: s["cost"])


def parameter_count(signature: Column) -> Column:
    """Parameters between the first parentheses; commas inside ``<>`` and ``[]`` do not count."""
    inner = F.regexp_extract(signature, r"\(([^)]*)\)", 1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(1).alias("n"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + c.isin("<", "[").cast("int") - c.isin(">", "]").cast("int")
        return F.struct(depth.alias("depth"), (s["n"] + ((c == ",") & (depth == 0)).cast("int")).alias("n"))

    return F.when(F.trim(inner) == "", F.lit(0)).otherwise(F.aggregate(F.split(inner, ""), start, step, lambda s: s["n"]))


def looks_like_sql(text: Column) -> Column:
    upper = F.upper(text)
    return F.exists(F.array(*map(F.lit, SQL_WORDS)), lambda w: F.contains(upper, w))


# Kinds of SQL statements in the order in which they are tried, with the pattern that tells them inside other text.
SQL_KINDS = (
    ("SELECT", r"\bselect\s+(?:distinct\s+)?(.+?)\s+from\s+(\w+)"), ("INSERT", r"\binsert\s+into\s+(\w+)"), ("UPDATE", r"\bupdate\s+(\w+)\s+set"), ("DELETE", r"\bdelete\s+from\s+(\w+)"),
    ("MERGE", r"\bmerge\s+into\s+(\w+)"), ("CALL", r"^\s*(call|exec)"),
)


def sql_statement(text: Column) -> Column:
    """struct(kind, main_table, tables, columns) of a SQL string. Tables of joins and of USING follow the
    others, each once; a column's alias is its last word; a call has neither."""
    kind = F.when(F.lit(False), F.lit(""))
    for name, pattern in SQL_KINDS:
        kind = kind.when(text.rlike(rf"(?i)^\s*{name}") | text.rlike(f"(?i){pattern}"), name)
    kind = kind.otherwise("UNKNOWN")
    one = lambda p, n=1: F.regexp_extract(text, f"(?is){p}", n)
    listed = lambda c: F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    several = lambda p: F.regexp_extract_all(text, F.lit(f"(?i){p}"), F.lit(1))
    first = lambda x: F.split(x, r"\s+")[0]
    sources = F.transform(listed(one(r"from\s+(\w+(?:\s+\w+)?(?:\s*,\s*\w+(?:\s+\w+)?)*)")), first)
    alone = lambda p: listed(one(p))
    after = lambda known, more: F.concat(known, F.filter(F.array_distinct(more), lambda x: ~F.array_contains(known, x)))
    none = F.array().cast("array<string>")
    tables = (
        F.when(kind == "SELECT", after(sources, several(r"join\s+(\w+)"))).when(kind == "INSERT", alone(r"insert\s+into\s+(\w+)")).when(kind == "UPDATE", alone(r"update\s+(\w+)\s+set\s"))
        .when(kind == "DELETE", alone(r"delete\s+from\s+(\w+)")).when(kind == "MERGE", after(alone(r"merge\s+into\s+(\w+)"), alone(r"using\s+(\w+)"))).otherwise(none)
    )
    chosen = F.transform(listed(one(r"select\s+(?:distinct\s+)?(.+?)\s+from")), lambda c: F.element_at(F.split(c, r"\s+"), -1))
    columns = (
        F.when(kind == "SELECT", F.filter(chosen, lambda c: c != "*")).when(kind == "INSERT", alone(r"insert\s+into\s+\w+\s*\(([^)]+)\)"))
        .when(kind == "UPDATE", F.regexp_extract_all(one(r"update\s+\w+\s+set\s+(.+?)(?:\s+where|$)"), F.lit(r"(\w+)\s*="), F.lit(1))).otherwise(none)
    )
    return F.struct(kind.alias("kind"), F.coalesce(F.get(tables, 0), F.lit("")).alias("main_table"), tables.alias("tables"), columns.alias("columns"))


# Names of comparisons.
OPERATORS = {"<": "less_than", "<=": "less_than_or_equals", ">": "greater_than", ">=": "greater_than_or_equals", "==": "equals", "!=": "not_equals"}


def _operator(sign: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in OPERATORS.items() for x in kv)), sign), F.lit("custom"))


def guard(condition: Column) -> Column:
    """struct(operand, operator, value, guard_kind) of an if-condition: a null check, a check of bounds or
    of a negated state; null for any other."""
    get = lambda p, n: F.regexp_extract(condition, p, n)
    of = lambda operand, operator, value, kind: F.struct(operand.alias("operand"), operator.alias("operator"), value.cast("string").alias("value"), F.lit(kind).alias("guard_kind"))
    is_null, not_null, bounds = r"(\w+)\s*== null", r"(\w+)\s*!= null", r"(\w+)\s*([<>]=?)\s*(\d+)"
    return (
        F.when(condition.rlike(is_null), of(get(is_null, 1), F.lit("is_null"), F.lit(None), "null_check")).when(condition.rlike(not_null), of(get(not_null, 1), F.lit("not_null"), F.lit(None), "null_check"))
        .when(condition.rlike(bounds), of(get(bounds, 1), _operator(get(bounds, 2)), get(bounds, 3), "bounds_check"))
        .when(condition.startswith("!"), of(F.trim(F.substring(condition, 2, 1 << 20)), F.lit("equals"), F.lit("false"), "state_check"))
    )


# Words by which a condition is business logic.
BUSINESS_WORDS = (
    "amount", "price", "total", "balance", "quantity", "count", "status", "state", "type", "category", "level", "tier", "discount", "tax", "fee", "rate", "percent", "threshold", "limit", "max", "min",
    "premium", "standard", "active", "enabled", "approved", "pending", "expired", "valid",
)


def business_condition(condition: Column) -> Column:
    """struct(words, confidence, variable, operator, threshold); confidence is min(0.5 + 0.1 per word, 0.9),
    and 0 without a word, when nothing else is told either."""
    low = F.lower(condition)
    words = F.filter(F.array(*map(F.lit, BUSINESS_WORDS)), lambda w: F.contains(low, w))
    confidence = F.when(F.size(words) > 0, F.least(F.round(0.5 + 0.1 * F.size(words), 9), F.lit(0.9))).otherwise(F.lit(0.0))
    number, status = r"(\w+)\s*([<>]=?|==|!=)\s*(\d+(?:\.\d+)?)", r"(\w+)\s*==\s*[\"']?(\w+)[\"']?"
    get = lambda p, n: F.regexp_extract(condition, p, n)
    of = lambda v, o, t: F.struct(v.alias("variable"), o.alias("operator"), t.alias("threshold"))
    known = F.size(words) > 0
    told = (
        F.when(known & condition.rlike(number), of(get(number, 1), _operator(get(number, 2)), get(number, 3)))
        .when(known & condition.rlike(status), of(get(status, 1), F.lit("equals"), get(status, 2))).otherwise(of(F.lit(""), F.lit("custom"), F.lit(None).cast("string")))
    )
    return F.struct(words.alias("words"), confidence.alias("confidence"), told["variable"].alias("variable"), told["operator"].alias("operator"), told["threshold"].alias("threshold"))


# The validation annotations and the kind of rule that each stands for, in order.
VALIDATIONS = (
    ("@NotNull", "required"), ("@NotEmpty", "required"), ("@NotBlank", "required"), (r"@Size\s*\([^)]+\)", "length"), (r"@Min\s*\([^)]+\)", "range"), (r"@Max\s*\([^)]+\)", "range"),
    (r"@Pattern\s*\([^)]+\)", "format"), ("@Email", "format"), ("@Past", "date"), ("@Future", "date"), ("@Positive", "range"), ("@PositiveOrZero", "range"), ("@Negative", "range"), ("@Valid", "nested"),
)


def validations(annotations: Column) -> Column:
    """Array of struct(annotation, rule) for the validation annotations in a text, in table order."""
    found = [F.when(annotations.rlike(p), F.struct(F.regexp_extract(annotations, f"@({p[1:]})", 1).alias("annotation"), F.lit(r).alias("rule"))) for p, r in VALIDATIONS]
    return F.array_compact(F.array(*found))


def markdown_sections(text: Column) -> Column:
    """Map from heading (one to three marks; a number before it is left out) to the text under it; of equal
    headings the last counts, text before the first heading is left out."""
    head = r"^#{1,3}[ \t]+(?:\d+\.?[ \t]*)?([^\n]+)"
    parts = F.filter(F.split(F.concat(F.lit("\n"), text), r"\n(?=#{1,3}[ \t]+[^\s])"), lambda p: p.rlike(head))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    pairs = F.transform(parts, lambda p: F.struct(
        strip(F.regexp_extract(p, head, 1)).alias("heading"), strip(F.regexp_replace(p, r"^[^\n]*\n?", "")).alias("body")))
    names = F.transform(pairs, lambda x: x["heading"])
    kept = F.filter(pairs, lambda x, i: F.array_position(F.slice(names, i + 2, F.size(names)), x["heading"]) == 0)
    return F.map_from_entries(kept)

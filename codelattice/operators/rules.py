"""Business rules in Java blocks, in pages and in flows, each with its text and a confidence.

Rows are (key, line, kind, name, rule, condition, confidence, holder, precondition, outer): line is null where markup has none, holder is the method, page field or
state, precondition tells whether a guard stands at its method's beginning, and outer are the conditions around it.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.functions import code_text
from codelattice.functions.ladders import first_match
from codelattice.sources import java_blocks
from codelattice.sources.elements import attribute, has, inside

#: A guard that begins within so many lines of its method is a precondition.
PRECONDITION_LINES = 5

# What a validation annotation asks for; {name} is the target, {value}, {min} and {max} its parameters.
ANNOTATION_RULES = (
    ("NotNull", "{name} must not be null"), ("NonNull", "{name} must not be null"), ("NotEmpty", "{name} must not be empty"), ("NotBlank", "{name} must not be blank"), ("Min", "{name} must be at least {value}"),
    ("Max", "{name} must be at most {value}"), ("Size", "{name} size must be between {min} and {max}"), ("Range", "{name} must be between {min} and {max}"), ("Pattern", "{name} must match pattern {value}"),
    ("Email", "{name} must be a valid email address"), ("Positive", "{name} must be positive"), ("PositiveOrZero", "{name} must be zero or positive"), ("Negative", "{name} must be negative"),
    ("NegativeOrZero", "{name} must be zero or negative"), ("Past", "{name} must be in the past"), ("Future", "{name} must be in the future"),
)
# Guard methods and what they check, in the order in which they are tried.
GUARD_METHODS = (
    ("checkNotNull", "null"), ("checkArgument", "argument"), ("checkState", "state"), ("requireNonNull", "null"), ("isTrue", "argument"), ("state", "state"),
)
# Words by which a page's condition is business logic.
PAGE_WORDS = (
    "user", "role", "permission", "auth", "logged", "admin", "status", "state", "type", "category", "level", "amount", "price", "total", "balance", "quantity", "count",
    "active", "enabled", "disabled", "valid", "invalid", "error", "success", "warning", "message", "empty", "null", "size", "length",
)
# What an assertion says of its second or only argument.
ASSERTIONS = (
    ("assertEquals", "{b} should equal {a}"), ("assertNotEquals", "{b} should not equal {a}"), ("assertTrue", "{a} should be true"), ("assertFalse", "{a} should be false"), ("assertNull", "{a} should be null"),
    ("assertNotNull", "{a} should not be null"), ("assertThrows", "{b} should throw {a}"),
)

_SCHEMA = ("key", "line", "kind", "name", "rule", "condition", "confidence", "holder", "precondition", "outer")


def _row(key, line, kind, name, rule, condition, confidence, holder, precondition=None, outer=None) -> list[Column]:
    text = lambda c: F.lit(c) if c is None or isinstance(c, str) else c
    values = (key, line.cast("int") if line is not None else F.lit(None).cast("int"), text(kind), text(name), text(rule), text(condition).cast("string"), confidence if isinstance(confidence, Column) else F.lit(float(confidence)), text(holder).cast("string"),
              precondition if precondition is not None else F.lit(None).cast("boolean"), outer if outer is not None else F.array().cast("array<string>"))
    return [v.alias(n) for v, n in zip(values, _SCHEMA, strict=True)]


def _filled(pattern: str, **values: Column) -> Column:
    out = F.lit(pattern)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("?")))
    return out


def _by_name(which: Column, rules, otherwise: Column, **values: Column) -> Column:
    return reduce(lambda out, r: F.when(which == r[0], _filled(r[1], **values)).otherwise(out), reversed(rules), otherwise)


def _validations(found: DataFrame, held: DataFrame) -> DataFrame:
    """Annotations of fields, and of parameters of methods."""
    p = r"@([A-Z]\w*)\s*(\((?:[^()]|\([^()]*\))*\))?"
    annotated = lambda text: F.zip_with(F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.regexp_extract_all(text, F.lit(p), F.lit(2)), lambda n, a: F.struct(n.alias("rule"), F.coalesce(a, F.lit("")).alias("said")))
    fields = held.where("kind = 'Field'").select("path", "n", "name").join(found.select("path", "n", "text", "start_line"), ["path", "n"]).select(
        "path", F.col("start_line").alias("line"), "name", F.lit(None).cast("string").alias("holder"), F.explode(annotated(F.col("text"))).alias("a"))
    heads = held.where("kind in ('Method', 'Constructor')").select("path", "n", F.col("name").alias("holder")).join(found.select("path", "n", "head", "start_line"), ["path", "n"])
    params = heads.select("path", F.col("start_line").alias("line"), "holder", F.explode(F.regexp_extract_all(F.regexp_extract("head", r"\((.*)\)", 1), F.lit(r"((?:@\w+(?:\((?:[^()]|\([^()]*\))*\))?\s*)+(?:final\s+)?[\w.<>\[\], ]+?\s\w+)\s*(?:,|$)"), F.lit(1))).alias("p"))
    params = params.select("path", "line", F.regexp_extract("p", r"(\w+)\s*$", 1).alias("name"), "holder", F.explode(annotated(F.col("p"))).alias("a"))
    said = lambda k: F.nullif(F.regexp_extract("a.said", rf"\b{k}\s*=\s*\"?([^\",)]*)", 1), F.lit(""))
    single = F.nullif(F.regexp_extract("a.said", r"^\(\s*\"?([^\"=]*?)\"?\s*\)$", 1), F.lit(""))
    known = fields.union(params).where(F.col("a.rule").isin(*(r[0] for r in ANNOTATION_RULES)))
    text = _by_name(F.col("a.rule"), ANNOTATION_RULES, F.lit(""), name=F.col("name"), value=F.coalesce(single, said("value"), said("regexp"), said("min"), said("max")), min=F.coalesce(said("min"), F.lit("0")), max=said("max"))
    return known.select(*_row(F.col("path"), F.col("line"), "ValidationConstraint", F.concat(F.col("a.rule"), F.lit("_"), F.col("name")), text, F.concat(F.lit("@"), "a.rule", "a.said"), 0.95, F.col("holder")))


def _leaving(found: DataFrame) -> DataFrame:
    """(path, n, leaves, exception, message): of each if, what its own block, or its only statement, throws or returns first."""
    own = found.where("block_kind = 'if'").select("path", F.col("block").alias("n"), F.col("n").alias("k"), "head")
    bare = found.where("kind = 'if' and mark = ';'").select("path", "n", F.col("n").alias("k"), F.regexp_replace("head", java_blocks._IF, "").alias("head"))
    rows = own.union(bare).where(F.col("head").rlike(r"^\s*(throw\s|return\s*(null|false)?\s*$)"))
    p = r"throw\s+new\s+(\w+)\s*\(\s*\"([^\"]+)\""
    rows = rows.withColumn("exception", F.nullif(F.regexp_extract("head", p, 1), F.lit(""))).withColumn("message", F.nullif(java_blocks._visible(F.regexp_extract("head", p, 2)), F.lit("")))
    return rows.groupBy("path", "n").agg(F.min_by(F.struct("exception", "message"), "k").alias("x")).select("path", "n", "x.*")


def guard_clauses(found: DataFrame, names: DataFrame) -> DataFrame:
    """Ifs whose own block throws or returns nothing, null or false; a block further inside doesn't count. ``names`` gives methods their names (path, method, holder)."""
    g = code_text.guard(F.col("label"))
    rows = found.where("kind = 'if'").join(_leaving(found), ["path", "n"]).withColumn("g", g).where("g is not null").join(names, ["path", "method"], "left")
    text = F.coalesce(
        "message", F.when(F.col("g.guard_kind") == "null_check", F.concat("g.operand", F.when(F.col("g.operator") == "is_null", " must be null").otherwise(" must not be null")))
        .when(F.col("g.guard_kind") == "bounds_check", F.concat("g.operand", F.lit(" must be "), F.replace("g.operator", F.lit("_"), F.lit(" ")), F.lit(" "), "g.value")).otherwise(F.concat(F.lit("State check on "), "g.operand")))
    early = F.col("start_line") <= F.col("method_line") + PRECONDITION_LINES
    return rows.select(*_row(F.col("path"), F.col("start_line"), "GuardClause", F.concat(F.lit("Guard_"), "g.operand"), text, F.col("label"), 0.9, F.col("holder"), F.coalesce(early, F.lit(False)), F.col("outer")))


def guard_methods(found: DataFrame, names: DataFrame) -> DataFrame:
    """Statements that call a method that guards: the first that is known by its name."""
    kind = first_match(F.col("head"), [(rf"\b{m}\s*\(", k) for m, k in GUARD_METHODS])
    args = F.split(F.regexp_replace(F.regexp_extract("head", r"\b(?:" + "|".join(m for m, _ in GUARD_METHODS) + r")\s*(\(.*)$", 1), "[()]", ""), ",")
    rows = found.where("mark = ';' and method is not null").withColumn("checks", kind).where("checks is not null").withColumn("a", F.trim(args[0])).join(names, ["path", "method"], "left")
    text = F.when(F.col("checks") == "null", F.concat("a", F.lit(" must not be null"))).when(F.col("checks") == "argument", F.concat(F.lit("Argument check: "), "a")).otherwise(F.concat(F.lit("State check: "), "a"))
    return rows.select(*_row(F.col("path"), F.col("start_line"), "GuardClause", F.concat(F.lit("Guard_"), "a"), text, F.col("head"), 0.95, F.col("holder"), F.lit(True), F.col("outer")))


def _summary(text: Column) -> Column:
    returns, throws, call = r"return\s+([^;]+)", r"throw\s+new\s+(\w+)", r"(\w+)\s*\([^)]*\)"
    return (F.when(text.rlike(returns), F.concat(F.lit("returns "), F.left(F.regexp_extract(text, returns, 1), F.lit(50)))).when(text.rlike(throws), F.concat(F.lit("throws "), F.regexp_extract(text, throws, 1)))
            .when(text.rlike(call), F.concat(F.lit("calls "), F.regexp_extract(text, call, 1))).otherwise(F.left(text, F.lit(50))))


def conditional_logic(found: DataFrame, names: DataFrame) -> DataFrame:
    """Ifs with business words and no null check, with what their own and the else block do; ``outer`` keeps the conditions that enclose them."""
    from pyspark.sql import Window

    body = found.where("block is not null and trim(head) <> ''").groupBy("path", F.col("block").alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("n").alias("k"), "head"))), lambda x: x["head"]), "; ").alias("body"))
    closes = java_blocks.ends(found)
    # An else block is the next segment behind the closing brace.
    nxt = found.withColumn("before", F.lag("n").over(Window.partitionBy("path").orderBy("n"))).where("head = 'else' and mark = '{'").select("path", F.col("before").alias("close"), F.col("n").alias("else_n"))
    rows = found.where("kind = 'if' and not label rlike '[!=]= null'").withColumn("b", code_text.business_condition(F.col("label"))).where("b.confidence > 0")
    rows = rows.join(body, ["path", "n"], "left").join(closes.select("path", "n", "close"), ["path", "n"], "left").join(nxt, ["path", "close"], "left")
    rows = rows.join(body.select("path", F.col("n").alias("else_n"), F.col("body").alias("else_body")), ["path", "else_n"], "left").join(names, ["path", "method"], "left")
    own = F.coalesce("body", F.trim(F.regexp_replace("head", java_blocks._IF, "")))
    sign = first_match(F.col("b.operator"), (("^less_than$", "<"), ("^less_than_or_equals$", "<="), ("^greater_than$", ">"), ("^greater_than_or_equals$", ">="), ("^equals$", "=="), ("^not_equals$", "!=")), "")
    number = F.col("label").rlike(r"(\w+)\s*([<>]=?|==|!=)\s*(\d+(?:\.\d+)?)")
    said = F.when(number, F.concat(F.lit("When "), "b.variable", F.lit(" is "), sign, F.lit(" "), "b.threshold")).when(F.col("b.variable") != "", F.concat(F.lit("When "), "b.variable", F.lit(" is "), "b.threshold")).otherwise(F.concat(F.lit("Condition on "), "label"))
    branches = F.concat_ws(" | ", said, F.concat(F.lit("then "), _summary(own)), F.concat(F.lit("else "), _summary(F.col("else_body"))))
    return rows.select(*_row(F.col("path"), F.col("start_line"), "ConditionalBusinessLogic", F.concat(F.lit("Condition_"), "b.variable"), branches, F.col("label"), F.col("b.confidence"), F.col("holder"), None, F.col("outer")))


def test_assertions(found: DataFrame, names: DataFrame) -> DataFrame:
    p = rf"\b(assert[A-Z]\w*)\s*\(({java_blocks._PARENS})\)"
    rows = found.where(F.col("method").isNotNull() & F.col("head").rlike(p)).withColumn("call", F.regexp_extract("head", p, 1)).where(F.col("call").isin(*(a for a, _ in ASSERTIONS))).join(names, ["path", "method"], "left")
    # Commas inside parentheses don't part arguments.
    inside = F.regexp_extract("head", p, 2)
    parts = F.regexp_extract_all(inside, F.lit(r"((?:[^(),]|\((?:[^()]|\([^()]*\))*\))+)"), F.lit(1))
    text = _by_name(F.col("call"), ASSERTIONS, F.lit(""), a=F.trim(parts[0]), b=F.trim(F.get(parts, F.lit(1))))
    return rows.select(*_row(F.col("path"), F.col("start_line"), "TestAssertion", F.col("call"), F.concat(F.lit("Test expects: "), text), F.col("head"), 0.9, F.col("holder"), None, F.col("outer")))


def java_rules(files: DataFrame) -> DataFrame:
    """All rules of Java files (path, text): validation annotations, guards, guard methods, conditional logic and test assertions."""
    from codelattice.operators.lineage import cut

    found = cut(java_blocks.blocks(files), "blocks")
    held = cut(java_blocks.members(found), "members")
    names = held.where("kind in ('Method', 'Constructor')").select("path", F.col("n").alias("method"), F.col("name").alias("holder"))
    return reduce(DataFrame.unionByName, (_validations(found, held), guard_clauses(found, names), guard_methods(found, names), conditional_logic(found, names), test_assertions(found, names)))


def page_rules(raw: DataFrame, files: DataFrame) -> DataFrame:
    """Rules of pages: HTML validation attributes of inputs, Spring error tags, JSTL conditions with business words, and EL checks for emptiness.

    ``raw`` are elements with their EL (``without_code(text, None)``)."""
    name = attribute("name")
    inputs = raw.where((F.col("tag") == "input") & name.isNotNull())
    length = F.trim(F.concat(F.lit(" "), F.when(attribute("minlength").isNotNull(), F.concat(F.lit("at least "), attribute("minlength"))).otherwise(""), F.lit(" "), F.when(attribute("maxlength").isNotNull(), F.concat(F.lit("at most "), attribute("maxlength"))).otherwise("")))
    one = lambda hit, rule, text: F.when(hit, F.struct(F.lit(rule).alias("rule"), F.concat(name, text).alias("text")))
    listed = F.array_compact(F.array(
        one(has("required"), "Required", F.lit(" is required")), one(attribute("pattern").isNotNull(), "Pattern", F.concat(F.lit(" must match pattern: "), attribute("pattern"))), one(attribute("min").isNotNull(), "Min", F.concat(F.lit(" must be at least "), attribute("min"))),
        one(attribute("max").isNotNull(), "Max", F.concat(F.lit(" must be at most "), attribute("max"))), one(attribute("minlength").isNotNull() | attribute("maxlength").isNotNull(), "Length", F.concat(F.lit(" length must be "), length)),
        one(F.lower(attribute("type")) == "email", "Email", F.lit(" must be a valid email address"))))
    html = inputs.select("key", name.alias("name"), F.explode(listed).alias("r")).select(*_row(F.col("key"), None, "ValidationConstraint", F.concat("r.rule", F.lit("_"), "name"), F.col("r.text"), F.concat(F.lit("html5_validation:"), "r.rule"), 0.85, F.col("name")))
    errors = raw.where((F.col("tag") == "form:errors") & attribute("path").isNotNull()).withColumn("p", attribute("path")).select(
        *_row(F.col("key"), None, "ValidationConstraint", F.concat(F.lit("ServerValidation_"), "p"), F.concat("p", F.lit(" has server-side validation (errors displayed via form:errors)")), "spring_form_errors:ServerValidation", 0.95, F.col("p")))
    test = F.regexp_extract(attribute("test"), r"^\$\{([^}]+)\}", 1)
    found = raw.where(F.col("tag").isin("c:if", "c:when")).select("key", "at", test.alias("c")).where("c <> ''")
    words = F.filter(F.array(*map(F.lit, PAGE_WORDS)), lambda w: F.contains(F.lower("c"), w))
    variable = F.when(F.contains("c", F.lit("not empty")), F.trim(F.regexp_replace("c", r"(?i)not\s+empty\s*", ""))).when(F.contains("c", F.lit("empty")), F.trim(F.regexp_replace("c", r"(?i)empty\s*", ""))).otherwise(
        F.regexp_extract("c", r"([a-zA-Z_.]+)\s*(==|!=|>|<|>=|<=|eq|ne|gt|lt|ge|le)", 1))
    shown = found.withColumn("w", words).where(F.size("w") > 0).withColumn("v", variable)
    conditions = shown.select(*_row(F.col("key"), None, "ConditionalBusinessLogic", F.concat(F.lit("Condition_"), F.when(F.col("v") != "", F.col("v")).otherwise(F.left("c", F.lit(20)))), F.concat(F.lit("When "), "c"), F.col("c"),
                                    F.least(F.round(0.5 + 0.1 * F.size("w"), 9), F.lit(0.85)), F.lit(None)))
    body = F.regexp_replace("text", r"(?s)<%--.*?--%>", "")
    checks = F.concat(F.transform(F.regexp_extract_all(body, F.lit(r"(?i)\$\{not\s+empty\s+([^}]+)\}"), F.lit(1)), lambda e: F.struct(F.lit("not empty ").alias("said"), F.trim(e).alias("e"), F.lit(" must not be empty").alias("text"))),
                      F.transform(F.regexp_extract_all(body, F.lit(r"(?i)\$\{empty\s+([^}]+)\}"), F.lit(1)), lambda e: F.struct(F.lit("empty ").alias("said"), F.trim(e).alias("e"), F.lit(" is empty check").alias("text"))))
    empties = files.where("text is not null").select(F.col("path").alias("key"), F.explode(checks).alias("c")).withColumn("f", F.regexp_extract("c.e", r"([^.]*)$", 1)).select(
        *_row(F.col("key"), None, "GuardClause", F.concat(F.lit("Guard_"), "f"), F.concat("f", "c.text"), F.concat("c.said", "c.e"), 0.8, "JSP_page", F.lit(False)))
    return reduce(DataFrame.unionByName, (html, errors, conditions, empties))


#: The elements that rules of flows are read from, besides those of their transitions.
FLOW_TAGS = ("evaluate", "secured", "binding")


def flow_rules(found: DataFrame, states: DataFrame | None, transitions: DataFrame) -> DataFrame:
    """Rules of flows: decisions, conditions of transitions, evaluated checks and business expressions, secured states, and bindings.

    Elements hold the name of their state, so nothing is joined; ``states`` are no longer needed."""
    ifs = found.where("tag = 'if' and state is not null").where(F.col("state_at") == inside("decision-state"))
    then, other = attribute("then"), attribute("else")
    text = F.concat(F.lit("If "), attribute("test"), F.lit(" then go to "), then, F.coalesce(F.concat(F.lit(", else go to "), other), F.lit("")))
    decided = ifs.where(attribute("test").isNotNull() & then.isNotNull()).select(*_row(F.col("key"), None, "ConditionalBusinessLogic", F.concat(F.lit("Decision_"), "state"), text, attribute("test"), 0.9, F.col("state")))
    guarded = transitions.where("condition is not null and event not in ('then', 'else')")
    text = F.concat(F.lit("Transition on '"), "event", F.lit("' to '"), "target", F.lit("' requires: "), "condition")
    guards = guarded.select(*_row(F.col("key"), None, "GuardClause", F.concat(F.lit("Guard_"), "event"), text, F.col("condition"), 0.9, F.col("source"), F.lit(True)))
    said = found.where("tag = 'evaluate'").withColumn("e", attribute("expression")).where("e is not null")
    checks = F.col("e").rlike("(?i)validate|valid|check|verify|assert")
    # One pattern, as the expression is looked up anew for each of the conditions of a filter.
    worth = F.lower("e").rlike("|".join(map(re.escape, code_text.BUSINESS_WORDS)))
    evaluated = said.where(checks | worth).select(*_row(F.col("key"), None, "BusinessRule", F.lit("Rule_evaluate_expression"), F.col("e"), F.col("e"), F.when(checks, 0.9).otherwise(0.75), F.col("state")))
    secured = found.where((F.col("tag") == "secured") & attribute("attributes").isNotNull()).withColumn("a", attribute("attributes"))
    locked = secured.select(*_row(F.col("key"), None, "BusinessRule", F.lit("Rule_security_constraint"), F.concat(F.lit("Access to "), F.coalesce("state", F.lit("flow")), F.lit(" requires: "), "a"), F.concat(F.lit("secured: "), "a"), 0.95, F.col("state")))
    bound = found.where((F.col("tag") == "binding") & attribute("property").isNotNull()).withColumn("p", attribute("property"))
    listed = F.array_compact(F.array(
        F.when(attribute("required") == "true", F.struct(F.lit("Required").alias("rule"), F.concat("p", F.lit(" is required in form binding")).alias("text"))),
        F.when(attribute("converter").isNotNull(), F.struct(F.lit("TypeConversion").alias("rule"), F.concat("p", F.lit(" uses converter: "), attribute("converter")).alias("text")))))
    bindings = bound.select("key", "state", "p", F.explode(listed).alias("r")).select(*_row(F.col("key"), None, "ValidationConstraint", F.concat("r.rule", F.lit("_"), "p"), F.col("r.text"), F.lit("binding_constraint"), 0.85, F.col("state")))
    return reduce(DataFrame.unionByName, (decided, guards, evaluated, locked, bindings))

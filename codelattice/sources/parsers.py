"""Nodes and edges from source text.

Languages are tables of line patterns, applied by one generic expression: a file's lines are numbered
and exploded, each pattern gives nodes, and containment follows from indentation or braces through a
window over the file. Only Python is read with its own syntax tree, in a table function.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelattice.functions.ids import entity_id

# What a line of a language declares: (language, node kind, edge from its container, pattern with the name as its first group).
_JAVA_MOD = r"(?:(?:public|protected|private|static|final|abstract|synchronized|default|native)\s+)*"
_CS_MOD = r"(?:(?:public|protected|private|internal|static|sealed|abstract|virtual|override|async|readonly|partial)\s+)*"
LINE_PATTERNS = (
    ("java", "PackageDeclaration", "DECLARES_PACKAGE", r"^\s*package\s+([\w.]+)\s*;"),
    ("java", "ImportDeclaration", "JAVA_IMPORTS", r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;"),
    ("java", "JavaClass", "DEFINES_CLASS", rf"^\s*{_JAVA_MOD}(?:class|record)\s+(\w+)"),
    ("java", "JavaInterface", "DEFINES_INTERFACE", rf"^\s*{_JAVA_MOD}@?interface\s+(\w+)"),
    ("java", "JavaEnum", "DEFINES_ENUM", rf"^\s*{_JAVA_MOD}enum\s+(\w+)"),
    ("java", "JavaMethod", "HAS_METHOD", rf"^\s*{_JAVA_MOD}(?:<[^>]+>\s+)?(?!return\b|new\b|else\b|throw\b)(?:[\w.<>\[\], ?]+\s+)?(?!if\b|for\b|while\b|switch\b|catch\b)(\w+)\s*\([^;]*\)\s*(?:throws [\w., ]+)?\{{"),
    ("java", "JavaField", "HAS_FIELD", r"^\s*(?:(?:public|protected|private|static|final)\s+)+[\w.<>\[\], ?]+\s+(\w+)\s*(?:=[^;]*)?;"),
    ("csharp", "NamespaceDeclaration", "DECLARES_NAMESPACE", r"^\s*namespace\s+([\w.]+)"),
    ("csharp", "UsingDirective", "CSHARP_USING", r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;"),
    ("csharp", "CSharpClass", "DEFINES_CLASS", rf"^\s*{_CS_MOD}class\s+(\w+)"),
    ("csharp", "CSharpInterface", "DEFINES_INTERFACE", rf"^\s*{_CS_MOD}interface\s+(\w+)"),
    ("csharp", "CSharpStruct", "DEFINES_STRUCT", rf"^\s*{_CS_MOD}struct\s+(\w+)"),
    ("csharp", "Property", "HAS_PROPERTY", rf"^\s*{_CS_MOD}[\w.<>\[\]?, ]+\s+(\w+)\s*\{{\s*(?:get|set|init)\b"),
    ("csharp", "CSharpMethod", "HAS_METHOD", r"^\s*(?:(?:public|protected|private|internal|static|virtual|override|abstract|async)\s+)+[\w.<>\[\]?, ]*?(\w+)\s*\([^;]*\)\s*(?:\{|=>|$)"),
    ("csharp", "Field", "HAS_FIELD", r"^\s*(?:(?:public|protected|private|internal|static|readonly|const)\s+)+[\w.<>\[\]?, ]+\s+(\w+)\s*(?:=[^;>]*)?;"),
    ("go", "PackageClause", "DECLARES_PACKAGE", r"^package\s+(\w+)"),
    ("go", "ImportSpec", "GO_IMPORTS", r"^(?:import\s+|\s+)(?:\w+\s+)?\"([^\"]+)\"\s*$"),
    ("go", "GoMethod", "HAS_METHOD", r"^func\s+\([^)]*\)\s+(\w+)\s*\("),
    ("go", "GoFunction", "DEFINES_FUNCTION", r"^func\s+(\w+)\s*[\[(]"),
    ("go", "GoStruct", "DEFINES_STRUCT", r"^type\s+(\w+)\s+struct\b"),
    ("go", "GoInterface", "DEFINES_INTERFACE", r"^type\s+(\w+)\s+interface\b"),
    ("cpp", "IncludeDirective", "INCLUDES", r"^\s*#\s*include\s+[<\"]([^>\"]+)[>\"]"),
    ("cpp", "MacroDefinition", "DEFINES_MACRO", r"^\s*#\s*define\s+(\w+)"),
    ("cpp", "CppClass", "DEFINES_CLASS", r"^\s*(?:class|struct)\s+(\w+)[^;]*$"),
    ("cpp", "CppMethod", "HAS_METHOD", r"^[\w:<>*&~ ]*?\b(\w+::~?\w+)\s*\([^;]*\)\s*(?:const)?\s*(?::[^{]*)?\{?\s*$"),
    ("cpp", "CFunction", "DEFINES_FUNCTION", r"^(?!\s)(?!else\b|return\b|typedef\b)[\w:<>*& ]+?[\s*&](\w+)\s*\([^;{]*\)\s*\{?\s*$"),
    ("typescript", "Import", "IMPORTS", r"^\s*import\s[^'\"]*['\"]([^'\"]+)['\"]"),
    ("typescript", "Class", "DEFINES_CLASS", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"),
    ("typescript", "Interface", "DEFINES_INTERFACE", r"^\s*(?:export\s+)?interface\s+(\w+)"),
    ("typescript", "TypeAlias", "DEFINES_TYPE", r"^\s*(?:export\s+)?type\s+(\w+)\s*(?:<[^=]*>)?\s*="),
    ("typescript", "Function", "DEFINES_FUNCTION", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"),
    ("typescript", "Function", "DEFINES_FUNCTION", r"^\s*(?:export\s+)?const\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>"),
    ("typescript", "Method", "HAS_METHOD", r"^\s+(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)(\w+)\s*(?:<[^>]*>)?\([^)]*\)\s*(?::\s*[\w<>\[\]|., ]+)?\s*\{"),
    ("typescript", "Variable", "DEFINES_VARIABLE", r"^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=(?!.*=>)"),
    ("typescript", "JSXElement", "RENDERS_ELEMENT", r"<([A-Z]\w*)[\s/>]"),
    ("sql", "SQLTable", "DEFINES_TABLE", r"(?i)^\s*create\s+table\s+(?:if\s+not\s+exists\s+)?([\w.]+)"),
    ("sql", "SQLView", "DEFINES_VIEW", r"(?i)^\s*create\s+(?:or\s+replace\s+)?view\s+([\w.]+)"),
)
#: The language of a file type.
LANGUAGES = {"java": "java", "cs": "csharp", "go": "go", "c": "cpp", "h": "cpp", "cc": "cpp", "hh": "cpp", "cpp": "cpp", "hpp": "cpp", "ts": "typescript", "tsx": "typescript",
             "js": "typescript", "jsx": "typescript", "sql": "sql", "py": "python"}
CONTAINERS = ("JavaClass", "JavaInterface", "JavaEnum", "CSharpClass", "CSharpInterface", "CSharpStruct", "Class", "Interface", "CppClass")


def language_of(path: Column) -> Column:
    """The language that a path is parsed as, by its extension in any case; null for others."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def lines_of(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, language, line, code): numbered lines without those inside block comments or after ``//``.

    Lines become rows; whether a comment is open where a line begins is the last mark before it, by a
    window over the file, so the work grows with the lines.
    """
    bare = F.regexp_replace(F.col(text), r"(?m)(?<![:\"'])//.*$", "")
    rows = files.select(path, "language", F.posexplode(F.split(bare, "\n")).alias("at", "code"))
    closes = F.col("code").rlike(r"\*/")
    mark = F.when(closes, F.lit(False)).when(F.col("code").rlike(r"^\s*/\*"), F.lit(True))
    before = Window.partitionBy(path).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.coalesce(F.last(mark, ignorenulls=True).over(before), F.lit(False))
    inside = F.col("_open") | F.col("code").rlike(r"^\s*/\*")
    return rows.withColumn("_open", open_).where(~inside).select(path, "language", (F.col("at") + 1).alias("line"), "code")


def declarations(files: DataFrame, repo: str) -> DataFrame:
    """(entity_id, kind, name, path, language, line, edge, container): what the lines of (path, text)
    declare; the first pattern that fits a line counts. Members belong to the class above them."""
    spark = files.sparkSession
    known = files.withColumn("language", language_of(F.col("path")))
    rules = spark.createDataFrame([(lang, k, e, p, n) for n, (lang, k, e, p) in enumerate(LINE_PATTERNS)], "language string, kind string, edge string, pattern string, ordinal int")
    hits = lines_of(known.where("language is not null and text is not null")).join(F.broadcast(rules), "language").where("code rlike pattern")
    best = hits.groupBy("path", "language", "line").agg(F.min_by(F.struct("kind", "edge", F.expr("regexp_extract(code, pattern, 1)").alias("name"), "code"), "ordinal").alias("d"))
    rows = best.select("path", "language", "line", "d.*")
    above = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    holder = F.last(F.when(F.col("kind").isin(*CONTAINERS), F.col("name")), ignorenulls=True).over(above)
    member = F.col("kind").isin("JavaMethod", "JavaField", "CSharpMethod", "Property", "Field", "Method")
    rows = rows.withColumn("container", F.when(member, holder))
    rows = rows.where(~F.col("kind").isin("Method") | F.col("container").isNotNull())
    qualified = F.concat_ws(".", F.col("path"), "container", "name")
    return rows.select(entity_id(F.col("kind"), F.lit(repo), F.concat_ws("#", qualified, F.col("line").cast("string"))).alias("entity_id"),
                       "kind", "name", "path", "language", "line", "edge", "container", F.trim("code").alias("code"))


def declaration_edges(found: DataFrame) -> DataFrame:
    """(type, src, dst, line): each declaration from its class if it has one, else its file."""
    owner = found.where(F.col("kind").isin(*CONTAINERS)).groupBy("path", F.col("name").alias("container")).agg(F.min("entity_id").alias("owner"))
    return found.join(owner, ["path", "container"], "left").select(
        F.col("edge").alias("type"), F.coalesce("owner", F.concat(F.lit("file:"), "path")).alias("src"), F.col("entity_id").alias("dst"), "line")


def supertypes(found: DataFrame) -> DataFrame:
    """(type, name, target): what classes extend and implement, by name."""
    base = F.nullif(F.regexp_extract("code", r"\bextends\s+([\w.]+)", 1), F.lit(""))
    listed = F.regexp_extract("code", r"\bimplements\s+([\w.<>, ]+)", 1)
    faces = F.filter(F.transform(F.split(listed, ","), lambda x: F.regexp_replace(F.trim(x), "<.*", "")), lambda x: x != "")
    cs = F.filter(F.transform(F.split(F.regexp_extract("code", r"\bclass\s+\w+\s*:\s*([\w.<>, ]+)", 1), ","), lambda x: F.trim(x)), lambda x: x != "")
    classes = found.where(F.col("kind").isin(*CONTAINERS))
    return classes.select(F.lit("EXTENDS").alias("type"), "name", base.alias("target")).where("target is not null").unionByName(
        classes.select(F.lit("IMPLEMENTS").alias("type"), "name", F.explode(F.concat(faces, cs)).alias("target")))


def invocations(files: DataFrame) -> DataFrame:
    """(path, line, receiver, callee) of the method calls in Java sources."""
    calls = F.regexp_extract_all("code", F.lit(r"(\w+\.\w+)\s*\("), F.lit(1))
    one = lines_of(files.withColumn("language", F.lit("java"))).select("path", "line", F.explode(calls).alias("c"))
    return one.select("path", "line", F.split("c", r"\.")[0].alias("receiver"), F.split("c", r"\.")[1].alias("callee"))


def resolve_calls(invoked: DataFrame, methods: DataFrame) -> DataFrame:
    """Calls to methods of the same name, ignoring case: (path, line, callee, target), one target, the
    smallest, for each call."""
    known = methods.groupBy(F.lower("name").alias("k")).agg(F.min("entity_id").alias("target"))
    return invoked.join(known, F.lower("callee") == F.col("k")).drop("k")


class _PythonNodes:
    """Rows of one Python file: kind, name, owner, line, end, params, doc, calls."""

    def eval(self, text: str) -> Iterator[tuple]:
        try:
            tree = ast.parse(text or "")
        except (SyntaxError, ValueError):
            return
        yield ("PythonModule", "", None, 1, (text or "").count("\n") + 1, 0, ast.get_docstring(tree), [])
        todo: list[tuple[ast.AST, str | None]] = [(tree, None)]
        while todo:
            parent, owner = todo.pop()
            for node in ast.iter_child_nodes(parent):
                inner = owner
                if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                    called = [f.attr if isinstance(f, ast.Attribute) else getattr(f, "id", "") for f in (c.func for c in ast.walk(node) if isinstance(c, ast.Call))]
                    kind = "PythonMethod" if isinstance(parent, ast.ClassDef) else "PythonFunction"
                    a = node.args
                    yield (kind, node.name, owner, node.lineno, node.end_lineno, len(a.posonlyargs + a.args + a.kwonlyargs), ast.get_docstring(node), sorted(filter(None, called)))
                    inner = node.name
                elif isinstance(node, ast.ClassDef):
                    yield ("PythonClass", node.name, owner, node.lineno, node.end_lineno, 0, ast.get_docstring(node), [])
                    inner = node.name
                elif isinstance(node, ast.Import | ast.ImportFrom):
                    for alias in node.names:
                        module = getattr(node, "module", None)
                        yield ("PythonImport", f"{module}.{alias.name}" if module else alias.name, owner, node.lineno, node.end_lineno, 0, None, [])
                elif isinstance(node, ast.Assign) and isinstance(parent, ast.Module | ast.ClassDef):
                    for target in node.targets:
                        if isinstance(target, ast.Name):
                            yield ("PythonVariable", target.id, owner, node.lineno, node.end_lineno, 0, None, [])
                todo.append((node, inner))


def python_nodes(files: DataFrame) -> DataFrame:
    """The syntax nodes of Python files (path, text); a file that does not parse has none."""
    table = F.udtf(_PythonNodes, returnType="kind string, name string, owner string, line int, end_line int, params int, doc string, calls array<string>")
    spark = files.sparkSession
    spark.udtf.register("codelattice_python_nodes", table)
    return spark.sql("SELECT f.path, p.* FROM {files} f, LATERAL codelattice_python_nodes(f.text) p", files=files.select("path", "text"))


def properties(files: DataFrame) -> DataFrame:
    """(path, locale, key, value) of .properties files: comments, both separators, continuations."""
    joined = F.regexp_replace(F.regexp_replace(F.col("text"), "\r\n", "\n"), r"\\\n[ \t]*", "")
    line = F.explode(F.split(joined, "\n"))
    rows = files.select("path", F.regexp_extract("path", r"_([a-z]{2}(?:_[A-Z]{2})?)\.properties$", 1).alias("locale"), line.alias("l"))
    rows = rows.where(~F.col("l").rlike(r"^\s*([#!]|$)")).select(
        "path", F.nullif("locale", F.lit("")).alias("locale"), F.trim(F.regexp_extract("l", r"^\s*((?:\\.|[^=:\\])+?)\s*[=:]", 1)).alias("key"),
        F.regexp_extract("l", r"^\s*(?:\\.|[^=:\\])+?\s*[=:]\s*(.*)$", 1).alias("value"))
    clean = lambda c: F.regexp_replace(c, r"\\([:=#! ])", "$1")
    return rows.where("key <> ''").select("path", "locale", clean("key").alias("key"), clean("value").alias("value"))


def gradle(files: DataFrame) -> DataFrame:
    """(path, what, scope, value) of Gradle files: included modules, plugins, and dependencies on
    projects and on group:artifact:version."""
    all_of = lambda p, n: F.regexp_extract_all("text", F.lit(p), F.lit(n))
    include = F.flatten(F.transform(all_of(r"(?m)^\s*include\s*\(?([^\n)]*)", 1), lambda x: F.regexp_extract_all(x, F.lit(r"['\"]([^'\"]+)['\"]"), F.lit(1))))
    scope = r"(implementation|api|compileOnly|runtimeOnly|testImplementation|compile|testCompile)"
    row = lambda what, values, scopes=None: F.zip_with(values, scopes if scopes is not None else values, lambda v, s: F.struct(
        F.lit(what).alias("what"), (s if scopes is not None else F.lit(None).cast("string")).alias("scope"), v.alias("value")))
    plugin = all_of(r"(?m)(?:^|\s)id\s*\(?['\"]([\w.-]+)['\"]", 1)
    project = rf"{scope}\s*\(?\s*project\s*\(\s*['\"]:?([^'\"]+)['\"]"
    outside = rf"{scope}\s*\(?\s*['\"]([\w.-]+:[\w.-]+(?::[\w.-]+)?)['\"]"
    return files.select("path", F.inline(F.concat(
        row("module", include), row("plugin", plugin), row("project", all_of(project, 2), all_of(project, 1)), row("dependency", all_of(outside, 2), all_of(outside, 1)))))


def module_type(plugins: DataFrame) -> DataFrame:
    """(path, type) by the first of spring-boot, war, ear, application and java-library among the plugins."""
    order = F.array(*map(F.lit, ("org.springframework.boot", "war", "ear", "application", "java-library")))
    at = F.array_position(order, F.col("value"))
    return plugins.where((F.col("what") == "plugin") & (at > 0)).groupBy("path").agg(F.min_by("value", at).alias("type"))


def markup(pages: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, what, name, value) of JSP and HTML: forms, fields, includes, tag libraries, expressions,
    links and tables."""
    all_of = lambda p, n=1: F.regexp_extract_all(F.col(text), F.lit(p), F.lit(n))
    row = lambda what, names, values=None: F.zip_with(names, values if values is not None else names, lambda a, b: F.struct(
        F.lit(what).alias("what"), a.alias("name"), (b if values is not None else F.lit("")).alias("value")))
    taglib = r"<%@\s*taglib[^>]*?(?:uri=\"([^\"]*)\"[^>]*?prefix=\"([^\"]*)\")"
    return pages.select(key, F.inline(F.concat(
        row("form", all_of(r"(?i)<(?:form|form:form)\b[^>]*\baction\s*=\s*\"([^\"]*)\"")), row("field", all_of(r"(?i)<(?:input|select|textarea)\b[^>]*\bname\s*=\s*\"([^\"]*)\"")),
        row("binding", all_of(r"<form:\w+[^>]*\bpath=\"([^\"]*)\"")), row("include", all_of(r"(?i)<(?:jsp:include|%@\s*include)\b[^>]*\b(?:page|file)\s*=\s*\"([^\"]*)\"")),
        row("taglib", all_of(taglib, 1), all_of(taglib, 2)), row("expression", all_of(r"[$#]\{([^}]*)\}")), row("link", all_of(r"(?i)<a\b[^>]*\bhref\s*=\s*\"([^\"]*)\"")),
        row("table", all_of(r"(?i)<(table|display:table)\b")))))


def web_flow(files: DataFrame) -> DataFrame:
    """(path, state, kind, view, event, target) of flow definitions in XML, one row per transition;
    states without one have a row of their own."""
    parts = F.regexp_extract_all("text", F.lit(r"(?s)(<(view|action|decision|subflow|end)-state\b(?:[^>]*/>|.*?</\2-state>))"), F.lit(1))
    one = files.select("path", F.explode(parts).alias("s"))
    attr = lambda c, a: F.nullif(F.regexp_extract(c, rf"\b{a}\s*=\s*\"([^\"]*)\"", 1), F.lit(""))
    head = F.regexp_extract("s", r"^(<[^>]*>)", 1)
    rows = one.select("path", attr(head, "id").alias("state"), F.regexp_extract("s", r"^<([\w-]+)", 1).alias("kind"), attr(head, "view").alias("view"),
                      F.explode_outer(F.regexp_extract_all("s", F.lit(r"(<(?:transition|if)\b(?:[^>\"]|\"[^\"]*\")*>)"), F.lit(1))).alias("t"))
    event = F.coalesce(attr("t", "on"), attr("t", "test"))
    return rows.select("path", "state", "kind", "view", event.alias("event"), F.coalesce(attr("t", "to"), attr("t", "then")).alias("target"), attr("t", "else").alias("otherwise"))


def flow_condition(test):
    """struct(left, operator, right) of a transition's condition."""
    ops = (("==", "equals"), ("!=", "not_equals"), (">=", "at_least"), ("<=", "at_most"), (">", "greater"), ("<", "less"), (r"\band\b|&&", "and"), (r"\bor\b|\|\|", "or"), (r"^\s*(?:not\b|!)", "not"),
           (r"\.contains\(", "contains"), (r"\bmatches\b", "matches"))
    from codelattice.functions.ladders import first_match

    sides = r"^(.*?)\s*(==|!=|>=|<=|>|<)\s*(.*)$"
    side = lambda n: F.nullif(F.trim(F.regexp_extract(test, sides, n)), F.lit(""))
    return F.struct(side(1).alias("left"), first_match(test, ops, "custom").alias("operator"), side(3).alias("right"))


def menu_items(files: DataFrame) -> DataFrame:
    """(path, id, parent_id, label, url) of menu XML; ``parent`` attributes give the hierarchy."""
    items = F.regexp_extract_all("text", F.lit(r"(<(?:menu-?item|item)\b[^>]*>)"), F.lit(1))
    attr = lambda a: F.nullif(F.regexp_extract("m", rf"(?i)\b{a}\s*=\s*\"([^\"]*)\"", 1), F.lit(""))
    return files.select("path", F.explode(items).alias("m")).select("path", attr("id").alias("id"), attr("parent").alias("parent_id"), attr("label").alias("label"), F.replace(attr("url"), F.lit("&amp;"), F.lit("&")).alias("url"))


def menu_target(url):
    """struct(flow, view, mode, source) of a menu URL: the flow is its page, the view its ``pageSelect``
    and the mode its ``mode`` or what the view's name ends with."""
    from codelattice.functions.ladders import first_match

    query = F.replace(F.regexp_extract(url, r"\?([^?]*)", 1), F.lit("&amp;"), F.lit("&"))
    get = lambda k: F.nullif(F.regexp_extract(query, rf"(?:^|&){k}=([^&]*)", 1), F.lit(""))
    flow, view, mode = F.regexp_extract(F.split(url, r"\?")[0], r"^(\w+)(?:\.html)?$", 1), get("pageSelect"), F.lower(get("mode"))
    said = F.when(mode.isin("true", "maintenance"), "maintenance").when(mode.isin("false", "inquiry", "view", "embedded"), "inquiry").when(mode.isin("create", "edit", "clone", "approve", "delete"), mode)
    shown = first_match(F.lower(view), (("maintenance$", "maintenance"), ("inquiry$", "inquiry"), ("wizard|minsetup$", "create")))
    return F.struct(flow.alias("flow"), view.alias("view"), F.coalesce(said, shown).alias("mode"),
                    F.when(said.isNotNull(), "url-param").when(shown.isNotNull(), "pageSelect-suffix").alias("source"))


def code_routes(files: DataFrame) -> DataFrame:
    """(path, framework, route, component) of routes in code and of file-based routes."""
    react = r"<Route\b[^>]*\bpath=[\"'{]+([^\"'}]+)[\"'}]+[^>]*?(?:element|component)=\{<?(\w+)"
    table = r"\{\s*path:\s*['\"]([^'\"]*)['\"][^}]*?\bcomponent:\s*(\w+)"
    all_of = lambda p, n: F.regexp_extract_all("text", F.lit(p), F.lit(n))
    row = lambda fw, p: F.zip_with(all_of(p, 1), all_of(p, 2), lambda r, c: F.struct(fw.alias("framework"), r.alias("route"), c.alias("component")))
    config = F.when(F.contains("text", F.lit("@angular/router")), "angular").otherwise("vue")
    coded = files.select("path", F.inline(F.concat(row(F.lit("react"), react), row(config, table))))
    stem = F.regexp_replace(F.regexp_extract("path", r"(?:^|/)(?:pages|app|routes)/(.*)\.[jt]sx?$", 1), r"(^|/)(index|page)$", "")
    by_file = files.where(F.col("path").rlike(r"(?:^|/)(pages|app|routes)/.*\.[jt]sx?$") & ~F.col("path").rlike(r"(?:^|/)_|\bapi/")).select(
        "path", F.lit("next").alias("framework"), F.concat(F.lit("/"), F.regexp_replace(stem, "/+$", "")).alias("route"), F.lit(None).cast("string").alias("component"))
    return coded.unionByName(by_file)


def child_routes(routes: DataFrame) -> DataFrame:
    """(route, parent): the longest other route that a route continues."""
    from codelattice.operators.hops import longest_prefix

    up = routes.select("route").distinct().withColumn("above", F.regexp_replace("route", "/[^/]*$", ""))
    known = routes.select(F.col("route").alias("parent")).where("parent <> '/'").distinct()
    return longest_prefix(up.where("above <> ''"), known, item="above", place="parent").select("route", "parent")


def spring_kinds(files: DataFrame) -> DataFrame:
    """(path, kind) of Java files by their annotations: flow handler before controller before service."""
    from codelattice.functions.ladders import first_match

    kind = first_match(F.col("text"), ((r"\bextends\s+\w*FlowHandler\b|@FlowHandler\b", "FlowHandler"), (r"@(Rest)?Controller\b", "SpringController"), (r"@Service\b|@Component\b", "SpringService")))
    return files.select("path", kind.alias("kind")).where("kind is not null")


def business_rules(files: DataFrame) -> DataFrame:
    """(path, line, kind, rule, detail) of Java sources: validation annotations, guards, conditions
    with business words, and test assertions."""
    from codelattice.functions import code_text

    rows = lines_of(files.withColumn("language", F.lit("java")))
    after = Window.partitionBy("path").orderBy("line")
    rows = rows.withColumn("following", F.concat_ws(" ", F.lead("code", 1).over(after), F.lead("code", 2).over(after)))
    condition = F.regexp_extract("code", r"\bif\s*\((.*)\)\s*\{?", 1)
    leaves = F.concat_ws(" ", "code", "following").rlike(r"\bif\s*\(.*\)\s*\{?\s*(throw\b|return\s*(null|false)?\s*;)")
    guard, business = code_text.guard(condition), code_text.business_condition(condition)
    row = lambda kind, rule, detail: F.struct(F.lit(kind).alias("kind"), rule.alias("rule"), detail.alias("detail"))
    none = F.array().cast("array<struct<kind: string, rule: string, detail: string>>")
    found = F.concat(
        F.transform(code_text.validations(F.col("code")), lambda v: F.struct(F.lit("ValidationConstraint").alias("kind"), v["rule"].alias("rule"), v["annotation"].alias("detail"))),
        F.when((condition != "") & leaves & guard.isNotNull(), F.array(row("GuardClause", guard["guard_kind"], condition))).otherwise(none),
        F.when((condition != "") & ~leaves & (business["confidence"] > 0), F.array(row("ConditionalBusinessLogic", F.array_join(business["words"], ","), condition))).otherwise(none),
        F.when(F.col("code").rlike(r"\bassert\w*\s*\("), F.array(row("TestAssertion", F.regexp_extract("code", r"\b(assert\w*)", 1), F.trim("code")))).otherwise(none),
    )
    return rows.select("path", "line", F.inline(found))


def link_by_name(left: DataFrame, right: DataFrame, left_on: str, right_on: str, kind: str, how_left: str = "id", how_right: str = "id") -> DataFrame:
    """Edges from each row to the first (smallest id) row of the same name, ignoring case."""
    known = right.groupBy(F.lower(right_on).alias("_k")).agg(F.min(how_right).alias("dst"))
    return left.join(known, F.lower(left_on) == F.col("_k")).select(F.lit(kind).alias("type"), F.col(how_left).alias("src"), "dst").distinct()

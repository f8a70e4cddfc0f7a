"""Named retrievals over nodes (id, kind, name, parent_id, file) and edges (type, src, dst, line)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelattice.operators.hops import of_type
from codelattice.operators.keep import keep_first
from codelattice.operators.lineage import cut

CLASSES = ("Class", "JavaClass", "SpringController", "SpringService", "Entity", "CSharpClass", "CppClass")
FUNCTIONS = ("Function", "Method", "JavaMethod", "GoFunction", "CSharpMethod")


def _named(nodes: DataFrame, prefix: str) -> DataFrame:
    return nodes.select(F.col("id").alias(f"{prefix}_id"), F.col("name").alias(prefix))


def query_repository(nodes: DataFrame, edges: DataFrame, what: str, limit: int = 100) -> DataFrame:
    """One of the canned questions: classes, functions, files, call_graph or imports, ordered by id."""
    if what in ("classes", "functions", "files"):
        kinds = {"classes": CLASSES, "functions": FUNCTIONS, "files": ("File",)}[what]
        return nodes.where(F.col("kind").isin(*kinds)).select("id", "kind", "name", "file").orderBy("id").limit(limit)
    types = {"call_graph": ("CALLS",), "imports": ("IMPORTS", "JAVA_IMPORTS", "GO_IMPORTS")}[what]
    first = of_type(edges, *types).orderBy("src", "dst").limit(limit)  # before the names are joined
    return first.join(_named(nodes, "caller"), F.col("src") == F.col("caller_id")).join(_named(nodes, "callee"), F.col("dst") == F.col("callee_id")).select("src", "caller", "dst", "callee").orderBy("src", "dst")


def method_chain(nodes: DataFrame, edges: DataFrame, entry: DataFrame, high: int, types: Sequence[str] = ("CALLS",)) -> DataFrame:
    """(seed, id, name, parent, depth, via, line): the methods that calls lead to from each entry method, at
    their least depth, with the smallest caller there, the line of its call and the class that holds them."""
    e = of_type(edges, *types).select(F.col("src").alias("at"), F.col("dst").alias("to"), "line")
    step = entry.select(F.col("id").alias("seed"), "id").distinct()
    found = None
    seen = step
    for n in range(1, high + 1):
        last = F.min(F.struct(F.col("id").alias("via"), "line")).alias("last")
        step = step.select("seed", "id").join(e, F.col("id") == F.col("at")).groupBy("seed", F.col("to").alias("next")).agg(last).withColumnRenamed("next", "id")
        step = cut(step.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").select("seed", "id", F.lit(n).alias("depth"), "last.via", "last.line"), "chain")
        if found is not None and step.isEmpty():
            break
        seen = seen.select("seed", "id").unionByName(step.select("seed", "id"))
        found = step if found is None else found.unionByName(step)
    holder = nodes.select(F.col("id").alias("holder"), F.col("name").alias("parent"))
    known = nodes.select("id", "name", "parent_id").join(holder, F.col("parent_id") == F.col("holder"), "left")
    return found.join(known, "id").select("seed", "id", "name", "parent", "depth", "via", "line")


def statements_of_chain(nodes: DataFrame, edges: DataFrame, chain: DataFrame) -> DataFrame:
    """(seed, holder, table): the tables that the data access classes of a chain's methods use, each once."""
    owner = nodes.select("id", "parent_id")
    uses = of_type(edges, "USES_TABLE", "EXECUTES_SQL").select(F.col("src").alias("holder"), F.col("dst").alias("table"))
    return chain.join(owner, "id").select("seed", F.col("parent_id").alias("holder")).distinct().join(uses, "holder").select("seed", "holder", "table")


def statements_of_holders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, name, n_tables, tables) of each class that uses tables."""
    uses = of_type(edges, "USES_TABLE", "EXECUTES_SQL").join(_named(nodes, "table"), F.col("dst") == F.col("table_id"))
    g = uses.groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("n_tables"), F.array_sort(F.collect_set("table")).alias("tables"))
    return nodes.select("id", "name").join(g, "id")


def _says(*words: str) -> Column:
    return F.lower("name").rlike("|".join(words))


def context(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, keywords: Sequence[str], *, beans: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(id, name, priority, relationship): what is relevant around entry points, each name once, by the first
    search that finds it.

    The searches, in order: calls over one hop; over two; the classes that hold the callees; names with a keyword; data access
    classes of callees; calls over three hops; validators and utilities of the callees' files; entities with a keyword. With ``beans``
    (bean), two more come first: classes of a flow's beans, by name without the method after the dot, and last the tables of
    the data access classes.
    """
    calls = of_type(edges, "CALLS").select(F.col("src").alias("at"), F.col("dst").alias("to")).distinct()
    over = lambda d: d.join(calls, F.col("id") == F.col("at")).select(F.col("to").alias("id")).distinct()
    calls = cut(calls, "calls")
    one = cut(over(seeds.select("id").distinct()), "one")
    two = cut(over(one), "two")
    three = over(two)
    near = cut(one.union(two).distinct().join(nodes, "id"), "near")
    holders = near.select(F.col("parent_id").alias("id")).distinct().join(nodes, "id")
    files = near.select("file").distinct()
    beside = nodes.where(F.col("kind").isin(*CLASSES)).join(files, "file", "left_semi")
    keyword = _says(*(k.lower() for k in keywords)) if keywords else F.lit(False)
    row = lambda d, relationship: (d, relationship)
    branches = [
        row(one.join(nodes, "id"), "CALLS_1"), row(two.join(nodes, "id"), "CALLS_2"), row(holders, "HOLDER"), row(nodes.where(keyword), "NAME"), row(holders.where(_says("dao", "repository")), "DATA_ACCESS"),
        row(three.join(nodes, "id"), "CALLS_3"), row(beside.where(_says("validator")), "VALIDATOR"), row(beside.where(_says("util", "helper")), "UTILITY"), row(nodes.where(keyword & (F.col("kind") == "Entity")), "ENTITY"),
    ]
    if beans is not None:
        bean = beans.select(F.lower(F.substring_index("bean", ".", 1)).alias("bean")).distinct()
        named = nodes.where(F.col("kind").isin(*CLASSES)).withColumn("bean", F.lower("name")).join(bean, "bean", "left_semi")
        tables = of_type(edges, "USES_TABLE").join(holders.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(nodes, "id")
        branches = [row(named, "BEAN"), *branches, row(tables, "TABLE")]
    every = None
    for n, (d, relationship) in enumerate(branches):
        part = d.select("id", "name", F.lit(n).alias("priority"), F.lit(relationship).alias("relationship"))
        every = part if every is None else every.unionByName(part)
    found = keep_first(every, ["name"], [F.col("priority"), F.col("id")])
    return found if most is None else found.orderBy("priority", "id").limit(most)


def retrieve(nodes: DataFrame, edges: DataFrame, question: str, keywords: Sequence[str], most: int = 20) -> DataFrame:
    """(id, name, relation) for a question of a type and its keywords.

    structural: classes and files with a keyword in the name; locational: nodes of exactly that name or, if there are none, that
    contain it; dependency: callers, callees, what a node imports and who imports it; else any name with a keyword.
    """
    hit = _says(*(k.lower() for k in keywords))
    named = nodes.where(hit)
    if question == "structural":
        out = named.where(F.col("kind").isin(*CLASSES, "File")).select("id", "name", F.lit("named").alias("relation"))
    elif question == "locational":
        rank = F.when(F.lower("name").isin(*(k.lower() for k in keywords)), 0).otherwise(1)
        tiers = named.withColumn("tier", rank)
        best = tiers.agg(F.min("tier").alias("best"))
        out = tiers.join(F.broadcast(best), F.col("tier") == F.col("best")).select("id", "name", F.when(F.col("tier") == 0, "exact").otherwise("partial").alias("relation"))
    elif question == "dependency":
        own = named.select(F.col("id").alias("own"))
        side = lambda types, a, b, relation: of_type(edges, *types).join(own, F.col(a) == F.col("own"), "left_semi").select(F.col(b).alias("id"), F.lit(relation).alias("relation"))
        every = side(("CALLS",), "dst", "src", "caller").union(side(("CALLS",), "src", "dst", "callee")).union(side(("IMPORTS",), "src", "dst", "import")).union(side(("IMPORTS",), "dst", "src", "importer"))
        out = every.distinct().join(nodes.select("id", "name"), "id").select("id", "name", "relation")
    else:
        out = named.select("id", "name", F.lit("keyword").alias("relation"))
    return out.orderBy("relation", "id").limit(most)


def evidence(rules: DataFrame, keyword: str, kinds: Sequence[str] = ("ValidationConstraint", "GuardClause", "ConditionalBusinessLogic", "TestAssertion")) -> DataFrame:
    """(id, kind, text, weight): rules (id, kind, text) with a keyword, of the named kinds, or of any other as generic."""
    weight = F.when(F.col("kind") == "ValidationConstraint", 0.95).when(F.col("kind") == "GuardClause", 0.9).when(F.col("kind") == "ConditionalBusinessLogic", 1.0).when(F.col("kind") == "TestAssertion", 0.85).otherwise(0.5)
    return rules.where(F.contains(F.lower("text"), F.lit(keyword.lower()))).select("id", F.when(F.col("kind").isin(*kinds), F.col("kind")).otherwise("generic").alias("kind"), "text", weight.alias("weight"))


def lookup(scored: DataFrame, floor: float = 0.5, most: int = 5) -> DataFrame:
    """(question, id, score, role): the best hit of each question if its score is over ``floor``, and the ``most`` next ones as suggestions."""
    w = Window.partitionBy("question").orderBy(F.desc("score"), "id")
    ranked = scored.withColumn("at", F.row_number().over(w)).where(F.col("at") <= most + 1)
    top = (F.col("at") == 1) & (F.col("score") > floor)
    return ranked.select("question", "id", "score", F.when(top, "match").otherwise("suggestion").alias("role"))


def implementation_layers(nodes: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """(layer, n, names) of the nodes with a keyword in their name, tests left out."""
    from codelattice.functions.ladders import layer

    hit = nodes.where(_says(*(k.lower() for k in keywords)) & ~_says("test"))
    return hit.groupBy(layer(F.col("kind"), F.col("name"), "implementation").alias("layer")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("name")).alias("names"))


def details(nodes: DataFrame, edges: DataFrame, kind: Sequence[str]) -> DataFrame:
    """(id, name, file, n_members, members, n_callers): entities of a kind with what they hold and how often their members are called."""
    member = of_type(edges, "HAS_METHOD", "HAS_FIELD").select(F.col("src").alias("id"), F.col("dst").alias("member"))
    calls = of_type(edges, "CALLS").groupBy(F.col("dst").alias("member")).agg(F.count("*").alias("calls"))
    g = member.join(_named(nodes, "member_name"), F.col("member") == F.col("member_name_id")).join(calls, "member", "left").groupBy("id").agg(
        F.count("*").alias("n_members"), F.array_sort(F.collect_set("member_name")).alias("members"), F.sum(F.coalesce("calls", F.lit(0))).alias("n_callers"))
    zero = F.lit(0).cast("long")
    file = nodes.where(F.col("kind") == "File").select(F.col("id").alias("file"), F.col("name").alias("path"))
    return nodes.where(F.col("kind").isin(*kind)).join(g, "id", "left").join(file, "file", "left").select(
        "id", "name", F.col("path").alias("file"), F.coalesce("n_members", zero).alias("n_members"), F.coalesce("members", F.array().cast("array<string>")).alias("members"), F.coalesce("n_callers", zero).alias("n_callers"))


def untested_critical(nodes: DataFrame, edges: DataFrame, tests: DataFrame, least: int = 5, limit: int = 100) -> DataFrame:
    """(id, name, callers): functions with at least ``least`` callers that no test reaches (tests: dst), most called first."""
    callers = of_type(edges, "CALLS").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("callers")).where(F.col("callers") >= least)
    return nodes.where(F.col("kind").isin(*FUNCTIONS)).join(callers, "id").join(tests.select(F.col("dst").alias("id")), "id", "left_anti").select("id", "name", "callers").orderBy(F.desc("callers"), "id").limit(limit)


def screen_fields(screens: DataFrame, fields: DataFrame) -> DataFrame:
    """The fields (page, ...) of each screen's pages: a row for each screen and field; screens whose pages have none are left out."""
    return screens.select("key", "screen", F.explode("pages").alias("page")).join(fields, "page").drop("page")


def submenu_screens(entries: DataFrame, screens: DataFrame) -> DataFrame:
    """Menu entries with how many screens their flow has (n_screens), and how many of those are for maintenance; entries without any stay."""
    n = screens.groupBy("flow").agg(F.count("*").alias("n_screens"), F.count_if(F.col("mode") == "maintenance").alias("n_maintenance"))
    zero = F.lit(0).cast("long")
    return entries.join(n, "flow", "left").withColumns({c: F.coalesce(c, zero) for c in ("n_screens", "n_maintenance")})


def screen_detail(screens: DataFrame, fields: DataFrame, tables: DataFrame, transitions: DataFrame) -> DataFrame:
    """Each screen with the fields and tables of its pages, summed up before they meet, and the events that leave it."""
    pages = screens.select("key", "screen", F.explode("pages").alias("page")).distinct()
    per_field = fields.groupBy("page").agg(F.count("*").alias("n"), F.count_if("required").alias("r"))
    per_table = tables.groupBy("page").agg(F.collect_set("name").alias("t"))
    found = pages.join(per_field, "page", "left").join(per_table, "page", "left").groupBy("key", "screen").agg(
        F.sum(F.coalesce("n", F.lit(0))).alias("n_fields"), F.sum(F.coalesce("r", F.lit(0))).alias("n_required"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("t")))).alias("tables"))
    left = transitions.where("source <> 'global'").groupBy("key", F.col("source").alias("screen")).agg(F.array_sort(F.collect_set("event")).alias("actions"))
    none = F.array().cast("array<string>")
    return screens.join(found, ["key", "screen"], "left").join(left, ["key", "screen"], "left").withColumn("actions", F.coalesce("actions", none))


def rules_by_holder(found: DataFrame) -> DataFrame:
    """(key, holder, n_rules, n_preconditions, best, kinds): the rules of each method, field or state summed up; those without a holder are left out."""
    return found.where("holder is not null").groupBy("key", "holder").agg(
        F.count("*").alias("n_rules"), F.count_if("precondition").alias("n_preconditions"), F.max("confidence").alias("best"), F.array_sort(F.collect_set("kind")).alias("kinds"))


def call_flow(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(holder, methods, incoming, outgoing): how many calls come into and leave each class; degrees are summed before methods meet their class."""
    calls = edges.where("type = 'CALLS'")
    into = calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))
    out = calls.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("callees"))
    m = nodes.where("kind = 'JavaMethod' and parent_id is not null").select("id", F.col("parent_id").alias("holder")).join(into, "id", "left").join(out, "id", "left")
    return m.groupBy("holder").agg(F.count("*").alias("methods"), F.sum(F.coalesce("callers", F.lit(0))).alias("incoming"), F.sum(F.coalesce("callees", F.lit(0))).alias("outgoing"))


def feature_list(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(feature, methods, classes, imports) of each file that holds anything, by the file's name."""
    g = nodes.where("file is not null").groupBy(F.col("file").alias("own")).agg(F.count_if(F.col("kind") == "JavaMethod").alias("methods"), F.count_if(~F.col("kind").isin("JavaMethod", "File")).alias("classes"))
    i = edges.where("type = 'IMPORTS'").groupBy("src").agg(F.count("*").alias("imports"))
    out = g.join(nodes.select(F.col("id").alias("own"), F.col("name").alias("feature")), "own").join(i, F.col("own") == F.col("src"), "left")
    return out.select("feature", "methods", "classes", F.coalesce("imports", F.lit(0).cast("long")).alias("imports"))


def search_by_scope(nodes: DataFrame, scopes: dict[str, tuple[tuple[str, ...], str]]) -> DataFrame:
    """(scope, id, name): for each scope the nodes of its kinds whose name contains its word, ignoring case, in one pass over the nodes."""
    hit = lambda name, kinds, word: F.when(F.col("kind").isin(*kinds) & F.contains(F.lower("name"), F.lit(word.lower())), F.lit(name))
    return nodes.select(F.explode(F.array_compact(F.array(*(hit(s, *x) for s, x in scopes.items())))).alias("scope"), "id", "name")


def scoped_counts(features: DataFrame, parts: DataFrame) -> DataFrame:
    """Features (feature, ...) with how many parts (feature) each has, 0 for none."""
    n = parts.groupBy("feature").agg(F.count("*").alias("screens"))
    return features.join(n, "feature", "left").withColumn("screens", F.coalesce("screens", F.lit(0).cast("long")))

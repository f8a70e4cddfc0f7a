"""Modules that hand on each other's names: re-exports, aliases and barrels resolved to what declares them, and effects across modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.operators.lineage import cut

# Weights of edges between symbols.
EFFECT_WEIGHTS = {"IMPORTS": 5, "EXPORTS": 8, "MUTATES_STATE": 8, "HANDLES_ERROR": 7}


def module_text(files: DataFrame) -> DataFrame:
    """(module, what, name, source, source_name) of TypeScript modules (path, text): declarations that are exported ("declares"), names exported
    from other modules ("alias"), whole modules handed on ("star"), and imports ("imports", with the local name as ``name``).

    ``source`` is the path that the module names, joined with the module's folder, without an extension; packages stay as they are.
    """
    bare = F.regexp_replace(F.regexp_replace("text", r"(?s)/\*.*?\*/", " "), r"(?m)(?<![:'\"])//.*$", "")
    all_of = lambda p, n: F.regexp_extract_all(bare, F.lit(p), F.lit(n))
    row = lambda what, name, source, other: F.struct(F.lit(what).alias("what"), name.alias("name"), source.cast("string").alias("source"), other.cast("string").alias("source_name"))
    none = F.lit(None)
    declared = F.transform(all_of(r"\bexport\s+(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\s*\*?|class|interface|enum|type|const|let|var)\s+(\w+)", 1), lambda n: row("declares", n, none, none))
    default = F.when(bare.rlike(r"\bexport\s+default\b"), F.array(row("declares", F.lit("default"), none, none))).otherwise(F.array().cast("array<struct<what: string, name: string, source: string, source_name: string>>"))
    parts = lambda listed: F.filter(F.transform(F.split(listed, ","), lambda x: F.trim(F.regexp_replace(x, r"\btype\s+", ""))), lambda x: x != "")
    first, last = (lambda x: F.regexp_extract(x, r"^(\w+)", 1)), (lambda x: F.regexp_extract(x, r"(\w+)$", 1))
    listed = r"\bexport\s+(?:type\s+)?\{([^}]*)\}\s*from\s*['\"]([^'\"]+)['\"]"
    aliases = F.flatten(F.zip_with(all_of(listed, 1), all_of(listed, 2), lambda names, src: F.transform(parts(names), lambda x: row("alias", last(x), src, first(x)))))
    own = F.flatten(F.transform(all_of(r"\bexport\s*\{([^}]*)\}(?!\s*from)", 1), lambda names: F.transform(parts(names), lambda x: row("declares", last(x), none, none))))
    stars = F.transform(all_of(r"\bexport\s*\*\s*from\s*['\"]([^'\"]+)['\"]", 1), lambda src: row("star", F.lit("*"), src, none))
    named = r"\bimport\s+(?:type\s+)?(?:\w+\s*,\s*)?\{([^}]*)\}\s*from\s*['\"]([^'\"]+)['\"]"
    imports = F.flatten(F.zip_with(all_of(named, 1), all_of(named, 2), lambda names, src: F.transform(parts(names), lambda x: row("imports", last(x), src, first(x)))))
    single = r"\bimport\s+(\w+)\s*(?:,\s*\{[^}]*\}\s*)?from\s*['\"]([^'\"]+)['\"]"
    defaults = F.zip_with(all_of(single, 1), all_of(single, 2), lambda n, src: row("imports", n, src, F.lit("default")))
    rows = files.where("text is not null").select(F.regexp_replace("path", r"\.[jt]sx?$", "").alias("module"), F.inline(F.concat(declared, default, own, aliases, stars, imports, defaults)))
    return rows.withColumn("source", resolved_path(F.col("module"), F.col("source"))).distinct()


def resolved_path(module: Column, source: Column) -> Column:
    """A relative path as seen from a module; others stay. Parts before ``..`` go, as far as there are any."""
    whole = F.filter(F.split(F.concat(F.regexp_replace(module, "[^/]*$", ""), F.regexp_replace(source, r"\.[jt]sx?$", "")), "/"), lambda x: ~x.isin("", "."))
    walked = F.aggregate(whole, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    lead = F.when(module.startswith("/"), "/").otherwise("")
    return F.when(source.rlike(r"^\.\.?/"), F.concat(lead, F.array_join(walked, "/"))).otherwise(source)


def star_closure(stars: DataFrame, most: int = 200) -> DataFrame:
    """(module, via, distance): the modules whose names a module hands on whole, also by way of others, with itself at 0; cycles end."""
    from codelattice.operators.types import supertype_closure

    return supertype_closure(stars.select(F.col("module").alias("sub"), F.col("source").alias("super")), most).select(F.col("sub").alias("module"), F.col("super").alias("via"), "distance")


def resolve_exports(declares: DataFrame, aliases: DataFrame, stars: DataFrame, asked: DataFrame, most: int = 64) -> DataFrame:
    """(module, name, target_module, target_name, hops, status) for each asked (module, name): what declares it.

    ``declares`` has (module, name), ``aliases`` (module, name, source, source_name), ``stars`` (module, source). A module's own names come before those of
    modules that it hands on whole, of which the nearest, then the smallest, counts; ``default`` is never handed on whole. An alias
    points to where its name is found; pointers jump over each other, so a chain of n aliases takes log2(n) rounds, each written out.
    status is "declared", "missing" (no such name, or a chain that ends at none) or "cycle" (names that only point at each other). hops
    counts the aliases on the way.
    """
    entries = declares.select("module", "name", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("source_name")).unionByName(aliases.select("module", "name", "source", "source_name"))
    # A name that a module both declares and hands on is its own; of several aliases the smallest counts.
    entries = cut(entries.groupBy("module", "name").agg(F.min_by(F.struct("source", "source_name"), F.struct(F.col("source").isNotNull(), "source", "source_name")).alias("s")).select("module", "name", "s.*"), "exports")
    reach = star_closure(stars) if not stars.isEmpty() else None
    home = entries.select(F.col("module").alias("via"), "name", F.col("module").alias("at_module"), F.col("name").alias("at_name"))

    def found(asks: DataFrame) -> DataFrame:
        """Where asked names are found: (module, name) to (at_module, at_name), null for none."""
        here = asks.select("module", "name", F.col("module").alias("via"), F.lit(0).alias("distance"))
        if reach is not None:
            here = here.unionByName(asks.where("name <> 'default'").join(reach.where("distance > 0"), "module").select("module", "name", "via", "distance"))
        hit = here.join(home, ["via", "name"]).groupBy("module", "name").agg(F.min_by(F.struct("at_module", "at_name"), F.struct("distance", "via")).alias("h"))
        return asks.join(hit, ["module", "name"], "left").select("module", "name", "h.at_module", "h.at_name")

    wanted = entries.where("source is not null").select(F.col("source").alias("module"), F.col("source_name").alias("name")).distinct()
    step = found(wanted).select(F.col("module").alias("source"), F.col("name").alias("source_name"), F.col("at_module").alias("next_module"), F.col("at_name").alias("next_name"))
    done = F.col("source").isNull()
    # A pointer is where a name's chain has been followed to; "end" tells that it has ended.
    jumps = entries.join(step, ["source", "source_name"], "left").select(
        "module", "name", F.when(done, F.col("module")).otherwise(F.col("next_module")).alias("to_module"), F.when(done, F.col("name")).otherwise(F.col("next_name")).alias("to_name"),
        F.when(done, "declared").when(F.col("next_module").isNull(), "missing").alias("end"), F.when(done, 0).otherwise(1).alias("hops"))
    jumps, left = cut(jumps, "pointers"), None
    for _ in range(most):
        now = jumps.where("end is null").count()
        if now in (0, left):
            break
        left = now
        ahead = jumps.select(F.col("module").alias("to_module"), F.col("name").alias("to_name"), F.col("to_module").alias("m"), F.col("to_name").alias("n"), F.col("end").alias("e"), F.col("hops").alias("h"))
        open_ = jumps.where("end is null").join(ahead, ["to_module", "to_name"], "left").select("module", "name", F.col("m").alias("to_module"), F.col("n").alias("to_name"), F.col("e").alias("end"), (F.col("hops") + F.col("h")).alias("hops"))
        jumps = cut(jumps.where("end is not null").unionByName(open_), "pointers")
    else:
        raise RuntimeError(f"aliases did not settle in {most} rounds")
    ends = jumps.select(F.col("module").alias("at_module"), F.col("name").alias("at_name"), "to_module", "to_name", F.coalesce("end", F.lit("cycle")).alias("end"), "hops")
    out = found(asked.select("module", "name").distinct()).join(ends, ["at_module", "at_name"], "left")
    ok = F.col("end") == "declared"
    return out.select("module", "name", F.when(ok, F.col("to_module")).alias("target_module"), F.when(ok, F.col("to_name")).alias("target_name"), F.when(ok, F.col("hops")).alias("hops"), F.coalesce("end", F.lit("missing")).alias("status"))


def effects(files: DataFrame) -> DataFrame:
    """(path, line, kind, name, weight): what lines of TypeScript change or catch: assignments to a member and calls that change an array in place
    (MUTATES_STATE, by the root of the expression, "this" and its field for a class's own), and handlers of errors (HANDLES_ERROR: catch clauses by their
    variable, catch callbacks and error listeners by what they are called on)."""
    lines = files.where("text is not null").select("path", F.posexplode(F.split(F.regexp_replace("text", r"(?m)(?<![:'\"])//.*$", ""), "\n")).alias("line", "code"))
    member = r"(?:^|[;{(]\s*|\s)(this\.\w+|\w+(?=[.\[]))(?:\.\w+|\[[^\]]*\])*\s*(?:[-+*/%|&^]|\?\?|\|\||&&)?=(?![=>])"
    pushed = r"((?:this\.)?\w+)(?:\.\w+)*\.(?:push|pop|shift|unshift|splice|sort|reverse|fill|set|delete|clear|add)\s*\("
    caught, callback, listener = r"(?<!\.)\bcatch\s*\(\s*(\w+)\s*\)", r"(\w+)\s*(?:\([^()]*\))?\s*\.catch\s*\(", r"(\w+)\.(?:on|once|addEventListener)\s*\(\s*['\"]error['\"]"
    find = lambda kind, p: F.transform(F.regexp_extract_all("code", F.lit(p), F.lit(1)), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))
    every = F.concat(find("MUTATES_STATE", member), find("MUTATES_STATE", pushed), *(find("HANDLES_ERROR", p) for p in (caught, callback, listener)))
    rows = lines.select("path", (F.col("line") + 1).alias("line"), F.inline(F.array_distinct(every)))
    return rows.withColumn("weight", F.element_at(F.create_map(*(F.lit(x) for kv in EFFECT_WEIGHTS.items() for x in kv)), F.col("kind")))

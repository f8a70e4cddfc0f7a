"""Flow definitions as state machines: states, transitions, screens, and what leads to each screen."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.functions.ladders import first_match, screen_type
from codelattice.operators.lineage import cut
from codelattice.sources.elements import attribute, elements, has, inside

STATES = ("view-state", "action-state", "decision-state", "end-state", "subflow-state")
#: The elements that transitions are read from.
MOVES = ("transition", "if")

# The operator of a condition by the first sign in it, with the sign that parts its operands.
OPERATORS = (("==", "equals", "=="), ("!=", "notEquals", "!="), (">=", "greaterThanOrEquals", ">="), ("<=", "lessThanOrEquals", "<="), (">", "greaterThan", ">"), ("<", "lessThan", "<"))
OTHER_OPERATORS = ((" and |&&", "and"), (r" or |\|\|", "or"), ("^!| not ", "not"), (r"\.contains\(", "contains"), (r"\.matches\(", "matches"))
# A screen's mode by the first group of words in its id and title.
MODES = (("maintenance", "maintenance"), ("inquiry|view", "inquiry"), ("wizard|create|new", "create"), ("edit|update|modify", "edit"), ("clone|copy", "clone"), ("approve|approval", "approve"), ("delete|remove", "delete"))


def condition_parts(test: Column) -> Column:
    """struct(operator, left, right, variables, methods, is_expression, description) of a transition's condition; null for none.

    Variables are those of a flow, view, request, conversation or flash scope, then plain names before an operator or a dot; methods
    are name.method calls.
    """
    kind, sides = None, None
    for sign, name, by in OPERATORS:
        hit, parts = F.contains(test, F.lit(sign)), F.transform(F.split(test, "[" + by[0] + "]=" if len(by) == 2 else by), lambda x: F.trim(x))
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
        sides = F.when(hit, parts) if sides is None else sides.when(hit, parts)
    kind = kind.otherwise(first_match(test, OTHER_OPERATORS, "custom"))
    scoped = F.regexp_extract_all(test, F.lit(r"(?:flowScope|viewScope|requestScope|conversationScope|flashScope)\.(\w+)"), F.lit(1))
    plain = F.regexp_extract_all(test, F.lit(r"\b([a-z]\w*)\b(?=\s*[!=<>]|\s*\.(?!class))"), F.lit(1))
    variables = F.array_distinct(F.concat(scoped, F.filter(plain, lambda v: ~v.isin("null", "true", "false"))))
    methods = F.array_distinct(F.regexp_extract_all(test, F.lit(r"(\w+\.\w+)\s*\("), F.lit(1)))
    short = F.concat(F.left(test, F.lit(50)), F.when(F.length(test) > 50, "...").otherwise(""))

    def told(x: Column) -> Column:
        kind, left, right, variables, methods = x["kind"], F.get(x["sides"], F.lit(0)), F.get(x["sides"], F.lit(1)), x["variables"], x["methods"]
        both = left.isNotNull() & (left != "") & (F.coalesce(right, F.lit("")) != "")
        said = lambda words: F.concat(F.lit("When "), left, F.lit(words), right)
        text = (
            F.when((kind == "equals") & both, said(" equals ")).when((kind == "notEquals") & both, said(" is not equal to ")).when((kind == "greaterThan") & both, said(" is greater than "))
            .when((kind == "lessThan") & both, said(" is less than ")).when(kind == "not", F.concat(F.lit("When condition is false: "), F.left(test, F.lit(50))))
            .when(F.size(methods) > 0, F.concat(F.lit("When "), F.array_join(methods, " and "), F.lit(" returns true"))).when(F.size(variables) > 0, F.concat(F.lit("Condition based on: "), F.array_join(variables, ", ")))
            .otherwise(F.concat(F.lit("Custom condition: "), short))
        )
        return F.struct(kind.alias("operator"), left.alias("left"), right.alias("right"), variables.alias("variables"), methods.alias("methods"),
                        (F.contains(test, F.lit("#")) | F.contains(test, F.lit("T("))).alias("is_expression"), text.alias("description"))

    # What several parts are told from is found once, as the element of an array.
    found = F.array(F.struct(kind.alias("kind"), sides.alias("sides"), variables.alias("variables"), methods.alias("methods")))
    return F.when(test.isNotNull(), F.transform(found, told)[0])


def flow_elements(files: DataFrame, key: str = "path", text: str = "text", *, only: Sequence[str] = (), once: bool = False) -> DataFrame:
    """The elements of flow files (those of some names ``only``), each with the number and the name of the state around it (``state_at``, ``state``).

    They are written out, since most readers read them more than once; not for one that reads them ``once``."""
    found = elements(files, key, text, clean=F.regexp_replace(F.col(text), r"(?s)<!--.*?-->", " "), only=only, owners=STATES)
    state = F.when(F.col("key").isNotNull() & F.col("owner").isNotNull(), F.coalesce(F.nullif("owner_name", F.lit("")), F.lit("unknown")))
    found = found.withColumns({"state_at": F.col("owner"), "state": state}).drop("owner", "owner_name")
    return found if once else cut(found, "flow-elements")


def _first(found: DataFrame, tag: str) -> DataFrame:
    return found.where(F.col("tag") == tag).groupBy("key").agg(F.min_by(attribute("id"), "at").alias(tag))


def flow_definitions(found: DataFrame) -> DataFrame:
    """(key, start_state, end_states, variables): a flow's start state is the named one, else the first view state, else the first action state."""
    flow = found.where("tag = 'flow'").groupBy("key").agg(F.min_by(attribute("start-state"), "at").alias("said"))
    ends = found.where("tag = 'end-state'").groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", attribute("id").alias("id")))), lambda x: x["id"]).alias("end_states"))
    held = found.where("tag = 'var'").groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", attribute("name").alias("name")))), lambda x: x["name"]).alias("variables"))
    none = F.array().cast("array<string>")
    return flow.join(_first(found, "view-state"), "key", "left").join(_first(found, "action-state"), "key", "left").join(ends, "key", "left").join(held, "key", "left").select(
        "key", F.coalesce("said", "view-state", "action-state", F.lit("unknown")).alias("start_state"), F.coalesce("end_states", none).alias("end_states"), F.coalesce("variables", none).alias("variables"))


def state_names(found: DataFrame) -> DataFrame:
    """(key, at, state, kind, v, s, parent): the states of flows by what their own tags say."""
    return found.where(F.col("tag").isin(*STATES)).select("key", "at", F.coalesce(attribute("id"), F.lit("unknown")).alias("state"), F.col("tag").alias("kind"), attribute("view").alias("v"), attribute("subflow").alias("s"), attribute("parent").alias("parent"))


def flow_states(found: DataFrame) -> DataFrame:
    """(key, at, state, kind, view, secured, on_entry, on_exit, variables): a view state without a view shows its id; a subflow state's view is its flow; actions are
    evaluated expressions and "name = value", in order."""
    acts = found.where(F.col("tag").isin("evaluate", "set") & F.col("state_at").isNotNull())
    said = F.when(F.col("tag") == "set", F.concat(F.coalesce(attribute("name"), F.lit("null")), F.lit(" = "), F.coalesce(attribute("value"), F.lit("null")))).otherwise(attribute("expression"))
    on = F.when(inside("on-entry") > F.col("state_at"), "entry").when(inside("on-exit") > F.col("state_at"), "exit")
    acts = acts.select("key", F.col("state_at").alias("at"), on.alias("on"), F.struct(F.col("at").alias("n"), said.alias("said")).alias("act")).where("on is not null")
    listed = lambda which: F.transform(F.array_sort(F.collect_list(F.when(F.col("on") == which, F.col("act")))), lambda x: x["said"]).alias(f"on_{which}")
    acts = acts.groupBy("key", "at").agg(listed("entry"), listed("exit"))
    marks = found.where(F.col("tag").isin("secured", "var") & F.col("state_at").isNotNull()).groupBy("key", F.col("state_at").alias("at")).agg(
        F.bool_or(F.col("tag") == "secured").alias("secured"), F.transform(F.array_sort(F.collect_list(F.when(F.col("tag") == "var", F.struct("at", attribute("name").alias("name"))))), lambda x: x["name"]).alias("variables"))
    rows = state_names(found)
    none = F.array().cast("array<string>")
    view = F.when(F.col("kind") == "view-state", F.coalesce("v", "state")).when(F.col("kind") == "end-state", F.col("v")).when(F.col("kind") == "subflow-state", F.col("s"))
    return rows.join(acts, ["key", "at"], "left").join(marks, ["key", "at"], "left").select(
        "key", "at", "state", "kind", view.alias("view"), "parent", F.coalesce("secured", F.lit(False)).alias("secured"), *(F.coalesce(c, none).alias(c) for c in ("on_entry", "on_exit", "variables")))


def flow_transitions(found: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """(key, at, source, event, target, condition, parts): transitions of states ("global" for those of the flow itself), and of decisions, whose branches are
    the events "then" and "else" with the test, or its negation, as condition. Those without a target go nowhere and are left out.

    Elements hold the name of their state, so they are read once and nothing is joined; ``states`` are no longer needed."""
    source = F.coalesce("state", F.when(F.col("parent") == inside("flow"), "global"))
    test = attribute("test")
    move = lambda source, event, target, condition: F.struct(source.alias("source"), event.alias("event"), attribute(target).alias("target"), condition.alias("condition"))
    plain = F.array(move(source, F.coalesce(attribute("on"), F.lit("default")), "to", attribute("condition")))
    branches = F.array(move(F.col("state"), F.lit("then"), "then", test), move(F.col("state"), F.lit("else"), "else", F.concat(F.lit("!("), test, F.lit(")"))))
    rows = found.where("tag in ('transition', 'if')").select("key", "at", F.inline(F.when(F.col("tag") == "if", branches).otherwise(plain)))
    return rows.where("target is not null and source is not null").withColumn("parts", condition_parts(F.col("condition")))


def state_graph(transitions: DataFrame) -> DataFrame:
    """(key, source, target, events, conditions): the state-to-state view, each pair once."""
    return transitions.where("source <> 'global'").groupBy("key", "source", "target").agg(F.array_sort(F.collect_set("event")).alias("events"), F.array_sort(F.collect_set("condition")).alias("conditions"))


def screens(found: DataFrame, states: DataFrame, transitions: DataFrame, flows: DataFrame) -> DataFrame:
    """(key, screen, title, kind, pages, action_class, action_methods, targets, parent, mode, mode_source, supported_modes, mode_variable): the view states.

    The title is the first quoted one that a state sets on entry, else its id in words; pages are its view and those set on entry,
    else two by its id. The mode comes from what is set on entry (the last word counts), from a parent that is an inquiry, or from
    words in id and title; variables of the flow name supported modes.
    """
    at_state = F.col("state_at").alias("at")
    sets = found.where((F.col("tag") == "set") & (inside("on-entry") > F.col("state_at"))).select("key", at_state, F.col("at").alias("n"), F.coalesce(attribute("name"), F.lit("")).alias("name"), F.coalesce(attribute("value"), F.lit("")).alias("value"))
    low, worth = F.lower("name"), F.lower("value")
    quoted = F.coalesce(F.nullif(F.regexp_extract("value", "'([^']+)'", 1), F.lit("")), F.nullif(F.regexp_extract("value", '"([^"]+)"', 1), F.lit("")))
    page = F.coalesce(F.nullif(F.regexp_extract("value", r"['\"]([^'\"]+\.jsp)['\"]", 1), F.lit("")), F.when(F.col("value").endswith(".jsp"), F.regexp_replace("value", "['\"`]", "")))
    moded = low.rlike("mode|wizard|maintenance")
    mode = F.when(moded, F.when((worth == "true") | F.contains(worth, F.lit("maintenance")), "maintenance").when((worth == "false") | worth.rlike("inquiry|view"), "inquiry"))
    title = F.when(F.contains(low, F.lit("title")), quoted)
    sets = sets.groupBy("key", "at").agg(
        F.min_by(title, F.when(title.isNotNull(), F.col("n"))).alias("title"), F.transform(F.array_sort(F.collect_list(F.when(F.col("name").rlike("Jsp|jsp|JSP") & page.isNotNull(), F.struct("n", page.alias("p"))))), lambda x: x["p"]).alias("set_pages"),
        F.max_by(mode, F.when(mode.isNotNull(), F.col("n"))).alias("set_mode"), F.collect_list(mode).alias("set_modes"),
        F.max_by(F.regexp_replace("name", r"^(flowScope|viewScope)\.", ""), F.when(moded, F.col("n"))).alias("set_variable"),
        F.bool_or(F.contains(low, F.lit("iswizardmode")) & (worth == "true")).alias("wizard"))
    calls = found.where((F.col("tag") == "evaluate") & F.col("state_at").isNotNull()).select("key", at_state, F.col("at").alias("n"), F.regexp_extract(attribute("expression"), r"(\w+Action)\.(\w+)", 1).alias("c"), F.regexp_extract(attribute("expression"), r"(\w+Action)\.(\w+)", 2).alias("m")).where("c <> ''")
    calls = calls.groupBy("key", "at").agg(F.min_by("c", "n").alias("action_class"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("n", "m"))), lambda x: x["m"])).alias("action_methods"))
    out = transitions.where("source <> 'global'").groupBy("key", F.col("source").alias("state")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "target"))), lambda x: x["target"]).alias("targets"))
    rows = states.where("kind = 'view-state'").join(sets, ["key", "at"], "left").join(calls, ["key", "at"], "left").join(out, ["key", "state"], "left").join(flows.select("key", F.col("variables").alias("held")), "key", "left")
    none = F.array().cast("array<string>")
    some = lambda c: F.coalesce(c, none)
    words = F.trim(F.regexp_replace("state", "([A-Z])", " $1"))
    rows = rows.withColumn("title", F.coalesce("title", F.concat(F.upper(F.left(words, F.lit(1))), F.substring(words, 2, 1 << 30))))
    pages = F.array_distinct(F.concat(F.when(F.col("view").endswith(".jsp"), F.array("view")).otherwise(none), some("set_pages")))
    rows = rows.withColumn("pages", F.when(F.size(pages) > 0, pages).otherwise(F.array(F.concat("state", F.lit("Entry.jsp")), F.concat("state", F.lit("Results.jsp")))))
    held = F.filter(some("held"), lambda v: F.lower(v).rlike("mode|wizard|maintenance"))
    of_held = F.flatten(F.transform(held, lambda v: F.when(F.contains(F.lower(v), F.lit("maintenance")), F.array(F.lit("maintenance"), F.lit("inquiry"))).when(F.contains(F.lower(v), F.lit("wizard")), F.array(F.lit("create"), F.lit("edit"))).otherwise(none)))
    inherits = F.col("parent").isNotNull() & F.col("set_mode").isNull()
    from_parent = F.when(inherits & F.contains(F.lower("parent"), F.lit("inquiry")), "maintenance")
    named = first_match(F.concat_ws(" ", F.lower("state"), F.lower("title")), MODES)
    by_name = F.when(F.col("set_mode").isNull() & from_parent.isNull(), named)
    source = F.when(by_name.isNotNull(), "naming-pattern").when(inherits, "parent-inheritance").when(F.col("set_variable").isNotNull(), "on-entry-action").when(F.size(held) > 0, "flow-variable")
    supported = F.array_distinct(F.array_compact(F.concat(
        of_held, some("set_modes"), F.when(F.coalesce("wizard", F.lit(False)), F.array(F.lit("create"), F.lit("edit"))).otherwise(none),
        F.when(from_parent.isNotNull(), F.array(F.lit("maintenance"), F.lit("inquiry"))).otherwise(none), F.array(by_name))))
    variable = F.when(F.coalesce("wizard", F.lit(False)), "isWizardMode").otherwise(F.coalesce("set_variable", F.try_element_at(held, F.lit(-1))))
    return rows.select("key", F.col("state").alias("screen"), "title", screen_type(F.col("state"), F.col("pages")).alias("kind"), "pages", F.coalesce("action_class", F.lit("")).alias("action_class"), some("action_methods").alias("action_methods"),
                       some("targets").alias("targets"), "parent", F.coalesce("set_mode", from_parent, by_name).alias("mode"), source.alias("mode_source"), supported.alias("supported_modes"), variable.alias("mode_variable"))


def _walked(starts: list[str], moves: list[tuple], most: int) -> Iterator[tuple]:
    """(state, steps, via, conditions) of the states of a flow that its start leads to; moves are (state, target, event, at, condition)."""
    leaving = {}
    for move in moves:
        leaving.setdefault(move[0], []).append(move)
    frontier = dict.fromkeys(starts, ())
    seen = set(frontier)
    yield from ((state, 0, None, []) for state in frontier)
    for steps in range(1, most + 1):
        best = {}
        for state, met in frontier.items():
            for _, target, event, at, condition in leaving.get(state, ()):
                order = (state, event, at)
                if target not in seen and (target not in best or order < best[target][0]):
                    best[target] = (order, met if condition is None else (*met, condition))
        if not best:
            return
        frontier = {target: met for target, (_, met) in best.items()}
        seen.update(frontier)
        yield from ((target, steps, order[0], list(met)) for target, (order, met) in best.items())
    raise RuntimeError(f"flows did not end in {most} steps")


def screen_conditions(flows: DataFrame, transitions: DataFrame, most: int = 1000) -> DataFrame:
    """(key, state, steps, via, conditions): every state that the start state leads to, by the fewest steps, with the conditions met on the way.

    A state is entered once, so cycles end the walk. Of equally short ways the one by the smaller previous state, then event, then place in
    the file counts. All moves of a flow, which one file holds, are brought together by one shuffle and walked there, so the steps of the longest flow
    cost nothing more. A walk of over ``most`` steps is an error.
    """
    none = F.lit(None).cast("string")
    starts = flows.select("key", F.lit(0).alias("is_move"), F.col("start_state").alias("state"), none.alias("target"), none.alias("event"), F.lit(0).alias("at"), none.alias("condition"))
    moves = transitions.where("source <> 'global'").select("key", F.lit(1).alias("is_move"), F.col("source").alias("state"), "target", "event", "at", "condition")
    kind = dict(flows.dtypes)["key"]
    names = ["key", "state", "steps", "via", "conditions"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, begun, held = None, [], []
        for rows in batches:
            out = []
            for k, is_move, *move in zip(*(rows[c].tolist() for c in ("key", "is_move", "state", "target", "event", "at", "condition")), strict=True):
                if k != key:
                    out += [(key, *r) for r in _walked(begun, held, most)]
                    key, begun, held = k, [], []
                if is_move:
                    held.append(move)
                else:
                    begun.append(move[0])
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame([(key, *r) for r in _walked(begun, held, most)], columns=names)

    ordered = starts.unionByName(moves).where("key is not null").repartition("key").sortWithinPartitions("key", "is_move")
    return ordered.mapInPandas(walk, f"key {kind}, state string, steps int, via string, conditions array<string>")

"""Types and their supertypes: closures, overrides, and what a call can reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.operators.lineage import cut


def supertype_closure(direct: DataFrame, most: int = 200) -> DataFrame:
    """(sub, super, distance): every type's supertypes by way of (sub, super) pairs, by the shortest way; each type is its own at distance 0.

    A round doubles nothing and enters each pair once, so cycles, which sources under work can have, end too. Each round is written out.
    """
    pairs = cut(direct.select("sub", "super").where("sub <> super").distinct(), "supertypes")
    names = pairs.select(F.col("sub").alias("t")).union(pairs.select("super")).distinct()
    seen = frontier = cut(names.select(F.col("t").alias("sub"), F.col("t").alias("super"), F.lit(0).alias("distance")), "closure")
    for step in range(1, most + 1):
        up = frontier.select("sub", F.col("super").alias("via")).join(pairs.select(F.col("sub").alias("via"), "super"), "via").select("sub", "super").distinct()
        frontier = cut(up.join(seen, ["sub", "super"], "left_anti").withColumn("distance", F.lit(step)), "frontier")
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier), "closure")
    raise RuntimeError(f"supertypes did not end in {most} steps")


def run_methods(closure: DataFrame, methods: DataFrame) -> DataFrame:
    """(type, name, arity, target): the method that an object of each type runs for a name and number of arguments: that of the nearest type among
    itself and its supertypes, one with a body before one without; of equally near ones the smallest id.

    ``methods`` has id, type, name, arity and has_body."""
    known = methods.select(F.col("type").alias("super"), "name", "arity", "id", "has_body")
    own = methods.select("type").distinct().join(closure.select(F.col("sub").alias("type")).distinct(), "type", "left_anti").select(F.col("type").alias("sub"), F.col("type").alias("super"), F.lit(0).alias("distance"))
    found = closure.unionByName(own).join(known, "super")
    order = F.struct(~F.col("has_body"), "distance", "id")
    return found.groupBy(F.col("sub").alias("type"), "name", "arity").agg(F.min_by("id", order).alias("target"))


def targets(calls: DataFrame, closure: DataFrame, methods: DataFrame) -> DataFrame:
    """(receiver_type, name, arity, target): what calls with that receiver, name and number of arguments can reach; only names that are called are looked up.

    An object behind a receiver can be of the receiver's type or of any of its subtypes; what each of them runs is a target.
    """
    called = calls.select("name", "arity").distinct()
    run = cut(run_methods(closure, methods.join(called, ["name", "arity"], "left_semi")), "run-methods")
    below = closure.select(F.col("super").alias("receiver_type"), F.col("sub").alias("type"))
    bare = run.select("type").distinct().join(closure.select(F.col("sub").alias("type")), "type", "left_anti").select(F.col("type").alias("receiver_type"), "type")
    return below.unionByName(bare).distinct().join(run, "type").select("receiver_type", "name", "arity", "target").distinct()


def resolve_invocations(calls: DataFrame, closure: DataFrame, methods: DataFrame) -> DataFrame:
    """(call, src, target): each implementation that a call can reach: calls have call (an id), src, receiver_type, name and arity.

    Calls of names that no type behind the receiver has are left out. Calls through a type that everything extends give a row for each of them and
    each override; ``summed_targets`` does without these rows.
    """
    return calls.join(targets(calls, closure, methods), ["receiver_type", "name", "arity"]).select("call", "src", "target").distinct()


def summed_targets(calls: DataFrame, closure: DataFrame, methods: DataFrame, *sums: Column) -> DataFrame:
    """(src, sums...): aggregates over the distinct targets that the calls of each src can reach; a src that reaches none is left out.

    Calls of the same receiver, name and number of arguments reach the same. So the targets are summed up once for each set of such
    calls that some src makes, not for each src, and no pair of call and target is made.
    """
    made = calls.where("receiver_type is not null").groupBy("src").agg(F.array_sort(F.collect_set(F.struct("receiver_type", "name", "arity"))).alias("made"))
    made = cut(made.withColumn("made_id", F.sha2(F.to_json("made"), 256)), "made")
    sets = made.dropDuplicates(["made_id"]).select("made_id", F.inline("made"))
    reach = sets.join(targets(calls, closure, methods), ["receiver_type", "name", "arity"]).select("made_id", "target").distinct()
    return made.select("src", "made_id").join(reach.groupBy("made_id").agg(*sums), "made_id").drop("made_id")


def reached_values(calls: DataFrame, closure: DataFrame, methods: DataFrame, value: Column) -> DataFrame:
    """(src, value): the distinct values of ``value``, an expression over ``target``, of all targets that the calls of each src can reach.

    What a receiver, name and number of arguments reach is reduced to its values before calls meet it. So where many targets have few
    values, calls through a type that everything extends cost a row for each of these, though each src makes calls of its own.
    """
    values = targets(calls, closure, methods).select("receiver_type", "name", "arity", value.alias("value")).distinct()
    made = calls.select("src", "receiver_type", "name", "arity").distinct()
    return made.join(values, ["receiver_type", "name", "arity"]).select("src", "value").distinct()


def receiver_types(calls: DataFrame, variables: DataFrame) -> DataFrame:
    """Calls with ``receiver_type``: the type of the variable of that name in the method, else of the field of the owner, else a type of that name; calls without a receiver are to the own type."""
    local = variables.where("method is not null").groupBy("path", "method", F.col("name").alias("receiver")).agg(F.min("type").alias("local_type"))
    field = variables.where("method is null").groupBy("path", "owner", F.col("name").alias("receiver")).agg(F.min("type").alias("field_type"))
    own = F.when(F.col("receiver").isNull(), F.regexp_extract("owner", r"(\w+)$", 1))
    rows = calls.join(local, ["path", "method", "receiver"], "left").join(field, ["path", "owner", "receiver"], "left")
    return rows.withColumn("receiver_type", F.coalesce(own, "local_type", "field_type", F.when(F.col("receiver").rlike("^[A-Z]"), F.col("receiver")))).drop("local_type", "field_type")

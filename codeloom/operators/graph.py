"""The call graph: edge binding, neighbours and transitive callers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import location
from ..session import written
from .tables import one_per_key


def named_functions(functions: DataFrame, files: DataFrame) -> DataFrame:
    """(id, name, file_id, location): one row per function id."""
    one = functions.select("id", "name", "file_id", "start_line").dropDuplicates(["id"])
    paths = files.select(F.col("id").alias("file_id"), "path").dropDuplicates(["file_id"])
    return one.join(paths, "file_id", "left").select("id", "name", "file_id", location(F.col("path"), F.col("start_line")).alias("location"))


def clean_edges(relationships: DataFrame) -> DataFrame:
    """Distinct edges with trimmed, lower-cased types; of equal ones the least id stays. Edges without a caller go."""
    typed = relationships.withColumn("relation_type", F.lower(F.trim("relation_type"))).where("caller_function_id IS NOT NULL")
    return typed.groupBy("caller_function_id", "callee_function_id", "callee_name", "relation_type").agg(F.min("id").alias("id"))


def first_by_name(functions: DataFrame) -> DataFrame:
    """(name, id): of functions with one name the least id."""
    return functions.where("name IS NOT NULL").groupBy("name").agg(F.min("id").alias("id"))


def unique_names(functions: DataFrame) -> DataFrame:
    """(name, id): the names that exactly one function has."""
    return functions.where("name IS NOT NULL").groupBy("name").agg(F.min("id").alias("id"), F.max("id").alias("_last")).where("id = _last").drop("_last")


def bound_edges(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """Edges without a target are bound to the function that alone has the called name.

    A name that many unbound edges share (a library call) meets at most one row, so the join doesn't grow.
    """
    names = unique_names(functions).select(F.col("name").alias("callee_name"), F.col("id").alias("_bound"))
    open_ = edges.where("callee_function_id IS NULL").join(names, "callee_name", "left")
    bound = open_.withColumn("callee_function_id", F.col("_bound")).select(*edges.columns)
    return edges.where("callee_function_id IS NOT NULL").unionByName(bound)


def callers(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """(function_id, caller_id, edge_id): calls by id first, then by name to the first function of that name; each caller once."""
    calls = edges.where("relation_type = 'calls'")
    by_id = calls.where("callee_function_id IS NOT NULL").select(F.col("callee_function_id").alias("function_id"), F.col("caller_function_id").alias("caller_id"), F.col("id").alias("edge_id"))
    firsts = first_by_name(functions).select(F.col("name").alias("callee_name"), F.col("id").alias("function_id"))
    by_name = calls.where("callee_function_id IS NULL").join(firsts, "callee_name").select("function_id", F.col("caller_function_id").alias("caller_id"), F.col("id").alias("edge_id"))
    return by_id.unionByName(by_name).groupBy("function_id", "caller_id").agg(F.min("edge_id").alias("edge_id"))


def callees(edges: DataFrame, named: DataFrame) -> DataFrame:
    """(function_id, edge_id, callee_id, callee_name, location): `unresolved` where the target is unknown."""
    calls = edges.where("relation_type = 'calls'").select(F.col("caller_function_id").alias("function_id"), F.col("id").alias("edge_id"), F.col("callee_function_id").alias("callee_id"), F.col("callee_name").alias("called"))
    targets = named.select(F.col("id").alias("callee_id"), "name", "location")
    joined = calls.join(targets, "callee_id", "left")
    return joined.select("function_id", "edge_id", "callee_id", F.coalesce("name", "called").alias("callee_name"), F.coalesce("location", F.lit("unresolved")).alias("location"))


def callers_of(edges: DataFrame, asked: DataFrame, most: int | None = None) -> DataFrame:
    """(id, caller_id, by_name, edge_id): who calls the functions of `asked` (id, name), by id or by the called name; each caller once.

    Calls by id come before calls by name, each in the order of their edges. With `most`, the first so many of each are taken,
    which gives the first so many callers: enough for a list that is cut anyway, however often a name is called.
    """
    calls = edges.where("relation_type = 'calls'")

    def firsts(called: str) -> DataFrame:
        one = calls.where(F.col(called).isNotNull()).groupBy(called, F.col("caller_function_id").alias("caller_id")).agg(F.min("id").alias("edge_id"))
        place = F.row_number().over(Window.partitionBy(called).orderBy("edge_id"))
        return one if most is None else one.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")

    by_id = asked.select("id", F.col("id").alias("callee_function_id")).join(firsts("callee_function_id"), "callee_function_id").select("id", "caller_id", F.lit(0).alias("by_name"), "edge_id")
    by_name = asked.select("id", F.col("name").alias("callee_name")).join(firsts("callee_name"), "callee_name").select("id", "caller_id", F.lit(1).alias("by_name"), "edge_id")
    one = by_id.unionByName(by_name).groupBy("id", "caller_id").agg(F.min(F.struct("by_name", "edge_id")).alias("first"))
    return one.select("id", "caller_id", "first.by_name", "first.edge_id")


def reached_by_each(edges: DataFrame, seeds: DataFrame, max_levels: int | None = None) -> DataFrame:
    """(seed, id, level): for every seed the functions that reach one of its functions by calls, with their least distance.

    `seeds` has `seed`, `id` (the changed functions) and `name` (edges by that name count as direct). Breadth-first for all seeds
    at once: a level joins its frontier with the edges and drops what the seed has seen, so cycles end. A changed function that a
    cycle leads back to counts.
    """
    calls = edges.where("relation_type = 'calls'")
    steps = calls.where("callee_function_id IS NOT NULL").select("callee_function_id", "caller_function_id").distinct()
    by_id = steps.join(seeds.select("seed", F.col("id").alias("callee_function_id")), "callee_function_id").select("seed", F.col("caller_function_id").alias("id"))
    by_name = calls.join(seeds.select("seed", F.col("name").alias("callee_name")), "callee_name").select("seed", F.col("caller_function_id").alias("id"))
    frontier = written(by_id.unionByName(by_name).distinct(), "callers-level")
    seen, level = frontier.withColumn("level", F.lit(1)), 1
    while not frontier.isEmpty() and level != max_levels:
        level += 1
        reached = steps.join(frontier.select("seed", F.col("id").alias("callee_function_id")), "callee_function_id").select("seed", F.col("caller_function_id").alias("id")).distinct()
        frontier = written(reached.join(seen.select("seed", "id"), ["seed", "id"], "left_anti"), "callers-level")
        seen = seen.unionByName(frontier.withColumn("level", F.lit(level)))
    return seen


def transitive_callers(edges: DataFrame, seeds: DataFrame, max_levels: int | None = None) -> DataFrame:
    """(id, level): every function that reaches one of the seeds (id, name), as in `reached_by_each`."""
    return reached_by_each(edges, seeds.select(F.lit(0).alias("seed"), "id", "name"), max_levels).drop("seed")


def most_called(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """(id, name): the function with the most incoming calls, the least id among equals."""
    counts = edges.where("relation_type = 'calls' AND callee_function_id IS NOT NULL").groupBy(F.col("callee_function_id").alias("id")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "id").limit(1)
    return one_per_key(functions.select("id", "name").join(top.select("id"), "id"), ["id"], [F.col("name")])

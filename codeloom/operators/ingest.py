"""Bringing a new state of files into the tables of a code graph, for all files at once."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import changes, graph, tables
from .ranking import ranked

_CALL = ["caller_function_id", "callee_function_id", "callee_name", "relation_type"]


@dataclass
class Graph:
    """The tables; each has an `id`, and the children of files a `file_id`."""

    files: DataFrame
    functions: DataFrame
    routes: DataFrame
    constants: DataFrame
    relationships: DataFrame
    analysis_queue: DataFrame


def without_files(state: Graph, gone: DataFrame) -> Graph:
    """The tables after the files of `gone` (id) are deleted: their functions, routes and constants go, then what belongs to the
    functions, and edges to them lose their target."""
    functions = state.functions.join(gone.select(F.col("id").alias("file_id")), "file_id", "left_semi").select("id").distinct()
    child = lambda df: tables.without(df, "file_id", gone, "id")
    return Graph(
        tables.without(state.files, "id", gone, "id"), child(state.functions), child(state.routes), child(state.constants),
        tables.edges_without(state.relationships, functions, "id"), tables.without(state.analysis_queue, "function_id", functions, "id"),
    )


def _numbered(base: DataFrame, new: DataFrame, *order: str) -> DataFrame:
    """`new` with ids after the largest one of `base`, in the given order."""
    top = base.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))  # one row
    return ranked(new, [F.col(c) for c in order], "_n").crossJoin(top).withColumn("id", F.col("_top") + F.col("_n")).drop("_top", "_n")


def _put(base: DataFrame, new: DataFrame) -> DataFrame:
    """`base` with the rows of `new`, of which columns that it lacks are null."""
    return base.unionByName(new.select(*[c for c in new.columns if c in base.columns]), allowMissingColumns=True)


def ingested(state: Graph, files: DataFrame, functions: DataFrame, routes: DataFrame, constants: DataFrame, calls: DataFrame, threshold: float = 0.3) -> tuple[Graph, DataFrame]:
    """The tables after all `files` (path, content_hash) are read anew, and one row of totals.

    `functions`, `routes` and `constants` have the columns of their tables with `path` instead of the ids (and `route_path` for a route's own); `calls` has path,
    caller_name, callee_name, relation_type. Files whose hash is the same are left alone. The children of changed files are
    replaced and numbered anew; a function waits for analysis when it is new or changed enough against the one of its name
    (the last of a name counts). A call goes to the function of its name in its own file (the last of a name), else to the only
    function of that name; calls that stay without target are bound in the end as in `graph.bound_edges`. Files that the new
    state lacks stay: `without_files` removes them.
    """
    status = changes.file_changes(state.files, files).where("status <> 'removed'")
    touched = status.where("status <> 'unchanged'").select("path", "status")
    old_files = state.files.select("path", F.col("id").alias("file_id"))
    all_files = tables.upserted(state.files, files.join(touched.select("path"), "path", "left_semi"), "path", "id")
    ids = all_files.select("path", F.col("id").alias("file_id")).join(touched.select("path"), "path")
    replaced = old_files.join(touched.where("status = 'changed'"), "path").select(F.col("file_id").alias("id"))
    left = without_files(state, replaced)

    own = lambda df: df.join(ids, "path").drop("path")
    new_functions = _numbered(state.functions, own(functions), "file_id", "start_line", "name")
    new_routes = _numbered(state.routes, own(routes).withColumnRenamed("route_path", "path"), "file_id", "start_line", "path")
    new_constants = _numbered(state.constants, own(constants), "file_id", "start_line", "name")

    last = lambda df: tables.one_per_key(df, ["file_id", "name"], [F.desc("id")])
    before = last(state.functions.join(replaced.withColumnRenamed("id", "file_id"), "file_id", "left_semi"))
    before = before.select("file_id", "name", F.col("code_hash").alias("_hash"), F.col("signature").alias("_signature"), F.col("body").alias("_body"))
    reason = changes.reanalysis_reason(F.col("_hash"), F.col("_signature"), F.col("_body"), F.col("code_hash"), F.col("signature"), F.col("body"), threshold)
    queued = new_functions.join(before, ["file_id", "name"], "left").withColumn("reason", reason).where("reason NOT IN ('unchanged', 'minor_change')")
    queued = queued.select(F.col("id").alias("function_id"), "reason", changes.priority(F.col("reason"), F.col("is_exported")).alias("priority"), F.lit("pending").alias("status"))

    every = _put(left.functions, new_functions)
    in_file = last(new_functions).select("file_id", "name", "id")
    rows = own(calls).join(in_file.select("file_id", F.col("name").alias("caller_name"), F.col("id").alias("caller_function_id")), ["file_id", "caller_name"])
    rows = rows.join(in_file.select("file_id", F.col("name").alias("callee_name"), F.col("id").alias("callee_function_id")), ["file_id", "callee_name"], "left").select(*_CALL).distinct()
    edges = _put(left.relationships, _numbered(state.relationships, rows, "caller_function_id", "callee_name", "relation_type", "callee_function_id"))
    edges = graph.bound_edges(edges, every)
    queue = _put(left.analysis_queue, _numbered(state.analysis_queue, queued, "function_id"))

    n = lambda name: F.count_if(F.col("status") == name)
    totals = status.agg(n("added").alias("new_files"), n("changed").alias("changed_files"), n("unchanged").alias("unchanged_files"))
    for name, part in (("functions", new_functions), ("routes", new_routes), ("constants", new_constants), ("relationships", rows), ("queued", queued)):
        totals = totals.crossJoin(part.agg(F.count("*").alias(name)))  # one row each
    return replace(left, files=all_files, functions=every, routes=_put(left.routes, new_routes), constants=_put(left.constants, new_constants), relationships=edges, analysis_queue=queue), totals

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import graph, queue, ranking, search, tables

EDGES = "id long, caller_function_id long, callee_function_id long, callee_name string, relation_type string"


def test_bound_edges_only_by_unique_names(spark):
    functions = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (1, "a")], "id long, name string")
    edges = spark.createDataFrame([(1, 9, None, "a", "calls"), (2, 9, None, "b", "Calls "), (3, 9, 3, "a", "calls"), (4, 9, None, None, "calls"), (5, 9, None, "a", "calls")], EDGES)
    out = {r.id: r.callee_function_id for r in graph.bound_edges(graph.clean_edges(edges), functions).collect()}
    assert out == {1: 1, 2: None, 3: 3, 4: None}


def test_transitive_callers_end_in_cycles(spark):
    edges = spark.createDataFrame([(1, 2, 1, "a", "calls"), (2, 3, 2, "b", "calls"), (3, 2, 3, "c", "calls"), (4, 7, None, "a", "calls"), (5, 8, 1, "a", "imports"), (6, 1, 3, "c", "calls")], EDGES)
    seeds = spark.createDataFrame([(1, "a")], "id long, name string")
    assert {r.id: r.level for r in graph.transitive_callers(edges, seeds).collect()} == {2: 1, 7: 1, 3: 2, 1: 3}
    assert graph.transitive_callers(edges.limit(0), seeds).count() == 0


def test_upsert_keeps_ids_and_numbers_new_keys(spark):
    base = spark.createDataFrame([(4, "a", "h1", "p"), (7, "b", "h2", None)], "id long, path string, hash string, purpose string")
    new = spark.createDataFrame([("b", "h9", "q"), ("c", "h3", "r"), ("d", "h4", None)], "path string, hash string, purpose string")
    out = {r.path: (r.id, r.hash, r.purpose) for r in tables.upserted(base, new, "path", "id", kept=("purpose",)).collect()}
    assert out == {"a": (4, "h1", "p"), "b": (7, "h9", "q"), "c": (8, "h3", "r"), "d": (9, "h4", None)}


def test_insert_or_ignore(spark):
    base = spark.createDataFrame([(1, "x")], "k long, v string")
    new = spark.createDataFrame([(1, "y"), (2, "b"), (2, "a"), (None, "n"), (None, "n")], "k long, v string")
    assert sorted(map(tuple, tables.inserted_or_ignored(base, new, ["k"], [F.col("v")]).collect()), key=str) == [(1, "x"), (2, "a"), (None, "n"), (None, "n")]


def test_deleted_functions_lose_edges(spark):
    edges = spark.createDataFrame([(1, 1, 2, "b", "calls"), (2, 2, 1, "a", "calls"), (3, 3, None, "z", "calls")], EDGES)
    gone = spark.createDataFrame([(2,)], "id long")
    assert sorted(map(tuple, tables.edges_without(edges, gone, "id").collect())) == [(1, 1, None, "b", "calls"), (3, 3, None, "z", "calls")]


def test_updates_keep_what_is_not_given(spark):
    base = spark.createDataFrame([(1, "p", "d"), (2, "q", None)], "id long, purpose string, domain string")
    new = spark.createDataFrame([(1, None, "x")], "id long, purpose string, domain string")
    assert sorted(map(tuple, tables.updated(base, new, "id", ["purpose", "domain"]).collect())) == [(1, "p", "x"), (2, "q", None)]


def test_rank_is_global(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    out = ranking.batched(df, [F.col("k").desc()], 10).collect()
    assert all(r["rank"] == 5000 - r.k and r.batch == (5000 - r.k - 1) // 10 for r in out) and len(out) == 5000
    assert ranking.ranked(df.limit(0), [F.col("k")]).count() == 0


def test_queue_order_and_ties(spark):
    rows = [(1, 5, None, "pending", "2024-01-01"), (2, 6, 9, "Pending ", "2024-01-02"), (3, 7, 9, "pending", "2024-01-01"), (4, 8, 9, "pending", "2024-01-01"), (5, 9, 99, "done", "2024-01-01"), (4, 8, 9, "pending", "2024-01-01")]
    df = spark.createDataFrame(rows, "id long, function_id long, priority int, status string, c string").selectExpr("*", "timestamp(c) AS created_at", "timestamp(null) AS processed_at")
    assert [r.id for r in queue.next_pending(df).collect()] == [3, 4, 2, 1]
    assert {r.id: r.batch for r in queue.pending_batches(df, 2).collect()} == {3: 0, 4: 0, 2: 1, 1: 1}
    functions = spark.createDataFrame([(5, True, None), (20, True, None), (21, False, None)], "id long, is_exported boolean, semantic_analyzed_at timestamp")
    assert sorted((r.function_id, r.priority) for r in queue.to_enqueue(functions, df).collect()) == [(20, 6), (21, 1)]


def test_phrase_search_is_by_id(spark):
    df = spark.createDataFrame([(3, "Slow caché", None), (1, "x", "the slow-cache"), (2, "slow", "cache"), (4, None, None)], "id long, name string, purpose string")
    assert [r.id for r in search.searched(df, ["name", "purpose"], ["slow_cache"]).collect()] == [1, 3]
    assert search.searched(df, ["name"], ["?", "AND", ""]).count() == 0
    freq = {(r.token, r.field): (r.documents, r.occurrences) for r in search.document_frequencies(search.postings(df, "id", ["name", "purpose"])).collect()}
    assert freq["cache", "purpose"] == (2, 2) and freq["cache", "name"] == (1, 1)


def test_like_search_limits_per_term(spark):
    df = spark.range(1, 20).select("id", F.concat(F.lit("KEY"), F.col("id")).alias("name"))
    assert [(r.id, r.term_at) for r in search.like_search(df, ["name"], ["y1_", "key"], 3).collect()] == [(10, 0), (11, 0), (12, 0)]

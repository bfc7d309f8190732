"""Queries of the code-graph operators over the test tables, with their oracle SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, text, validate
from ..operators import changes, graph, ingest, queue, search, tables
from ..session import table
from ..streaming.watch import flush_outcomes

#: Search terms that the queries use; the generated texts hold all of them.
TERMS = ["slow cache", "tenant*", "noisy-row", "AND"]
LIKE_TERMS = ["key_", "cache", "STA%E"]


def _t(spark: SparkSession, sf_dir: str, *names: str):
    read = [table(spark, sf_dir, n) for n in names]
    return read[0] if len(read) == 1 else read


# --- lookups -------------------------------------------------------------------------------------------------------


def function_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every name the first function that has it, with its place."""
    functions, files = _t(spark, sf_dir, "functions", "files")
    named = graph.named_functions(functions, files)
    return graph.first_by_name(functions).join(named.select("id", "file_id", "location"), "id").select("name", "id", "file_id", "location")


def unique_function_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12."""
    return graph.unique_names(_t(spark, sf_dir, "functions")).select("name", "id")


def functions_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity counts of every file, missing ones 0."""
    files, functions, routes, constants = _t(spark, sf_dir, "files", "functions", "routes", "constants")
    out = files.select(F.col("id").alias("file_id"), text.repo_path(F.col("path")).alias("path"))
    for name, entity in (("functions", functions), ("routes", routes), ("constants", constants)):
        counts = entity.select("id", "file_id").distinct().groupBy("file_id").agg(F.count("*").alias(name))
        out = out.join(counts, "file_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def domain_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of one domain, as validated."""
    functions = tables.latest(_t(spark, sf_dir, "functions").select("id", "name", "domain", "complexity", "updated_at"))
    clean = functions.select("id", "name", validate.valid_domain(F.col("domain")).alias("domain"), validate.valid_complexity(F.col("complexity")).alias("complexity"))
    return clean.where("domain = 'authentication' OR domain = 'other'")


def exported_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported constants with a preview of their value."""
    constants = _t(spark, sf_dir, "constants").where("is_exported")
    return constants.select("id", "name", "file_id", text.ellipsis(F.col("value_text"), 200).alias("preview")).distinct()


def not_analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20: functions and routes without semantic fields."""
    functions, routes = _t(spark, sf_dir, "functions", "routes")
    f = tables.latest(functions.select("id", "name", "semantic_analyzed_at", "updated_at")).where("semantic_analyzed_at IS NULL")
    r = routes.where("semantic_analyzed_at IS NULL").select("id", F.coalesce("handler_name", F.lit("")).alias("name")).distinct()
    return f.select(F.lit("function").alias("kind"), "id", "name").unionByName(r.select(F.lit("route").alias("kind"), "id", "name"))


# --- graph ---------------------------------------------------------------------------------------------------------


def kept_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: of equal edges the first stays."""
    return graph.clean_edges(_t(spark, sf_dir, "relationships"))


def bound_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges without a target are bound by unique names."""
    relationships, functions = _t(spark, sf_dir, "relationships", "functions")
    return graph.bound_edges(graph.clean_edges(relationships), functions)


def callers_of_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who calls each function, by id and by name, each caller once."""
    relationships, functions, files = _t(spark, sf_dir, "relationships", "functions", "files")
    found = graph.callers(graph.clean_edges(relationships), functions)
    named = graph.named_functions(functions, files).select(F.col("id").alias("caller_id"), F.col("name").alias("caller_name"), "location")
    return found.join(named, "caller_id").select("function_id", "caller_id", "caller_name", "location", "edge_id")


def callees_of_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each function calls; targets that are unknown are `unresolved`."""
    relationships, functions, files = _t(spark, sf_dir, "relationships", "functions", "files")
    return graph.callees(graph.clean_edges(relationships), graph.named_functions(functions, files))


def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All functions that a change of the most called function reaches, direct callers first."""
    relationships, functions = _t(spark, sf_dir, "relationships", "functions")
    edges = graph.clean_edges(relationships)
    reached = graph.transitive_callers(edges, graph.most_called(edges, functions))
    names = functions.select("id", "name").dropDuplicates(["id"])
    return reached.join(names, "id").select("id", "name", (F.col("level") == 1).alias("direct"))


# --- search --------------------------------------------------------------------------------------------------------


def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings of functions, as document frequencies."""
    functions = tables.latest(_t(spark, sf_dir, "functions").select("id", "name", "purpose", "behavior_summary", "updated_at"))
    return search.document_frequencies(search.postings(functions, "id", search.SEARCHED["functions"]))


def search_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten functions by id with one of the phrases."""
    functions = tables.latest(_t(spark, sf_dir, "functions").select("id", "name", "purpose", "behavior_summary", "updated_at"))
    return search.searched(functions, search.SEARCHED["functions"], TERMS).select("id", "name")


def search_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All routes with one of the phrases."""
    routes = _t(spark, sf_dir, "routes").select("id", "path", "handler_body", "purpose").distinct()
    return routes.where(search.matches(search.SEARCHED["routes"], TERMS)).select("id", "path")


def search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G12 for many questions at once: the words of held-out questions against the index of functions."""
    functions = tables.latest(_t(spark, sf_dir, "functions").select("id", "name", "purpose", "behavior_summary", "updated_at"))
    items = _t(spark, sf_dir, "eval_items").where("item_id % 50 = 0")
    words = items.select(F.col("item_id").alias("question_id"), F.explode(text.search_tokens(F.col("question"))).alias("token")).where("length(token) > 3")
    return search.searched_many(search.postings(functions, "id", search.SEARCHED["functions"]), words)


def search_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIKE search with live wildcards, five per term and in all."""
    constants = _t(spark, sf_dir, "constants").select("id", "name", "value_text").distinct()
    return search.like_search(constants, ["name", "value_text"], LIKE_TERMS)


def search_route_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P17."""
    return search.routes_like(_t(spark, sf_dir, "routes"), "/t_a", "get").select("id", "method", "path").distinct()


# --- tables --------------------------------------------------------------------------------------------------------


def file_keepers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, F1: of the spellings of one path the row with most analysed functions, most functions, least id is kept."""
    files, functions = _t(spark, sf_dir, "files", "functions")
    one = tables.latest(functions.select("id", "file_id", "semantic_analyzed_at", "updated_at"))
    counts = one.groupBy("file_id").agg(F.count("*").alias("functions"), F.count("semantic_analyzed_at").alias("analysed"))
    rows = files.select(F.col("id").alias("file_id"), text.repo_path(F.col("path")).alias("path")).join(counts, "file_id", "left").na.fill(0, ["functions", "analysed"])
    kept = tables.one_per_key(rows, ["path"], [F.desc("analysed"), F.desc("functions"), F.asc("file_id")])
    return kept.select("path", F.col("file_id").alias("kept_id"), "analysed", "functions")


def merged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: of the spellings of one path only the kept row stays, under the one spelling, and the others go with what belongs to them."""
    state = _state(spark, sf_dir)
    kept = file_keepers(spark, sf_dir)
    gone = state.files.select("id").join(kept.select(F.col("kept_id").alias("id")), "id", "left_anti")
    left = ingest.without_files(state, gone)
    counts = left.functions.groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("functions"))
    return left.files.join(counts, "id", "left").select("id", text.repo_path(F.col("path")).alias("path"), F.coalesce("functions", F.lit(0)).alias("functions"))


def change_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes of reading the next state of all files, by status."""
    return flush_outcomes(file_status(spark, sf_dir))


def _next_files(files: DataFrame) -> DataFrame:
    """(path, content_hash): the next state of all files, under one spelling of their paths, with test files edited."""
    path = text.repo_path(F.col("path"))
    edited = F.when(F.contains(path, F.lit(".test.")), F.sha2("content_hash", 256)).otherwise(F.col("content_hash"))
    return files.groupBy(path.alias("path")).agg(F.min(edited).alias("content_hash"))


def upserted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: all files, into which their next state is put; spellings that are new get ids after the largest."""
    files = _t(spark, sf_dir, "files").select("id", "path", "content_hash")
    return tables.upserted(files, _next_files(files), "path", "id")


def file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added, changed, unchanged and removed files between two states of the tree."""
    files = _t(spark, sf_dir, "files").select("id", "path", "content_hash")
    return changes.file_changes(files, _next_files(files))


def _state(spark: SparkSession, sf_dir: str) -> ingest.Graph:
    files, functions, routes, constants, relationships, waiting = _t(spark, sf_dir, "files", "functions", "routes", "constants", "relationships", "analysis_queue")
    return ingest.Graph(files, tables.latest(functions), routes.dropDuplicates(["id"]), constants.dropDuplicates(["id"]), graph.clean_edges(relationships), queue.entries(waiting))


def ingest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next state of all files is read into the tables; async functions of it have another signature, all another body."""
    state = _state(spark, sf_dir)
    paths = state.files.select(F.col("id").alias("file_id"), text.repo_path(F.col("path")).alias("_path"))
    of = lambda df: df.join(paths, "file_id").drop("file_id", "id")
    body = F.concat(F.lit("x"), F.replace("body", F.lit("\n"), F.lit("\nx")))
    fields = ["name", "signature", "body", "code_hash", "start_line", "end_line", "is_exported", "is_async"]
    functions = of(state.functions).select(F.col("_path").alias("path"), *fields).withColumns({"body": body, "signature": F.when(F.col("is_async"), F.concat("signature", F.lit(" "))).otherwise(F.col("signature")), "code_hash": F.sha2(body, 256)})
    routes = of(state.routes).withColumnRenamed("path", "route_path").withColumnRenamed("_path", "path")
    constants = of(state.constants).withColumnRenamed("_path", "path")
    callers = state.functions.join(paths, "file_id").select(F.col("id").alias("caller_function_id"), F.col("_path").alias("path"), F.col("name").alias("caller_name"))
    calls = state.relationships.join(callers, "caller_function_id").select("path", "caller_name", "callee_name", "relation_type")
    return ingest.ingested(state, _next_files(state.files), functions, routes, constants, calls)[1]


def counts_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of every table when all test files are deleted with what belongs to them."""
    state = _state(spark, sf_dir)
    left = ingest.without_files(state, state.files.where(F.contains("path", F.lit(".test."))).select("id"))
    counts = [getattr(left, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name in ingest.Graph.__annotations__]
    return reduce(DataFrame.unionByName, counts)


def entities_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions, routes and constants of every file, with their places."""
    files, functions, routes, constants = _t(spark, sf_dir, "files", "functions", "routes", "constants")
    named = {"function": (functions, F.col("name")), "route": (routes, F.concat_ws(" ", F.upper("method"), "path")), "constant": (constants, F.col("name"))}
    rows = [df.select(F.lit(kind).alias("kind"), "id", "file_id", name.alias("name"), "start_line").distinct() for kind, (df, name) in named.items()]
    return reduce(DataFrame.unionByName, rows).join(files.select(F.col("id").alias("file_id"), "path"), "file_id", "left").select("kind", "id", "file_id", "name", text.location(F.col("path"), F.col("start_line")).alias("location"))


def edges_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges when all test files are deleted: their own edges go, edges to them lose their target."""
    files, functions, relationships = _t(spark, sf_dir, "files", "functions", "relationships")
    gone_files = files.where(F.contains("path", F.lit(".test."))).select("id")
    gone = functions.join(gone_files.select(F.col("id").alias("file_id")), "file_id", "left_semi").select("id").distinct()
    return tables.edges_without(graph.clean_edges(relationships), gone, "id").select("id", "caller_function_id", "callee_function_id", "callee_name", "relation_type")


def current_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last delivery of every function wins; effects are read as an array."""
    functions = _t(spark, sf_dir, "functions").select("id", "name", "purpose", "domain", "complexity", "side_effects_json", "code_hash", "updated_at")
    now = tables.latest(functions)
    return now.select("id", "name", "purpose", "domain", "complexity", F.array_join(validate.side_effects(F.col("side_effects_json")), "; ").alias("effects"), "code_hash")


def updated_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: the semantic fields of each function's last delivery put over those of its first, where they are given."""
    rows = _t(spark, sf_dir, "functions").select("id", "purpose", "domain", "complexity", "updated_at")
    first = tables.one_per_key(rows, ["id"], [F.col("updated_at").asc_nulls_first()]).drop("updated_at")
    return tables.updated(first, tables.latest(rows), "id", ["purpose", "domain", "complexity"])


def queue_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting entries of functions that are analysed are done, at the time of the analysis."""
    functions, waiting = _t(spark, sf_dir, "functions", "analysis_queue")
    entries = queue.entries(waiting)
    analysed = tables.latest(functions.select("id", "semantic_analyzed_at", "updated_at")).where("semantic_analyzed_at IS NOT NULL").select(F.col("id").alias("function_id"), F.col("semantic_analyzed_at").alias("at"))
    done = entries.where("status = 'pending'").join(analysed, "function_id").select("id", "at")
    return queue.processed(entries, done, "done").select("id", "status", F.unix_micros("processed_at").alias("processed_us"))


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repository path and the name of every file."""
    files = _t(spark, sf_dir, "files")
    return files.select("id", text.repo_path(F.col("path")).alias("repo_path"), text.base_name(F.col("path")).alias("name"))


def code_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash and cache key of every body, and whether the stored hash holds."""
    one = _t(spark, sf_dir, "functions").select("id", "body", "code_hash").dropDuplicates(["id"])
    h = F.sha2("body", 256)
    return one.select("id", (h == F.col("code_hash")).alias("holds"), text.cache_key(F.lit("v1"), F.lit("stub"), h).alias("cache_key"))


def changed_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each function against the one before it in its file, as if it were its older state."""
    from pyspark.sql import Window

    one = _t(spark, sf_dir, "functions").select("id", "file_id", "start_line", "signature", "body", "code_hash", "is_exported").dropDuplicates(["id"])
    w = Window.partitionBy("file_id").orderBy("start_line", "id")
    old = {c: F.lag(c).over(w) for c in ("code_hash", "signature", "body")}
    rows = one.select("id", "signature", "body", "code_hash", "is_exported", *[v.alias(f"old_{k}") for k, v in old.items()])
    reason = changes.reanalysis_reason(F.col("old_code_hash"), F.col("old_signature"), F.col("old_body"), F.col("code_hash"), F.col("signature"), F.col("body"))
    rows = rows.withColumn("reason", reason)
    ratio = F.round(changes.diff_ratio(F.coalesce("old_body", F.lit("")), F.coalesce("body", F.lit(""))), 6)
    return rows.select("id", "reason", ratio.alias("ratio"), changes.priority(F.col("reason"), F.col("is_exported")).alias("priority"))


# --- queue ---------------------------------------------------------------------------------------------------------


def queue_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1."""
    return queue.next_pending(_t(spark, sf_dir, "analysis_queue")).select("id", "function_id", "priority")


def queue_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3."""
    return queue.pending_batches(_t(spark, sf_dir, "analysis_queue")).select("id", F.col("rank").cast("long").alias("rank"), F.col("batch").cast("long").alias("batch"))


def to_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4, M11."""
    functions, waiting = _t(spark, sf_dir, "functions", "analysis_queue")
    return queue.to_enqueue(tables.latest(functions.select("id", "is_exported", "semantic_analyzed_at", "updated_at")), waiting)


# --- statistics and text -------------------------------------------------------------------------------------------


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2: one row of counts."""
    files, functions, relationships, routes, constants, waiting = _t(spark, sf_dir, "files", "functions", "relationships", "routes", "constants", "analysis_queue")
    now = tables.latest(functions.select("id", "semantic_analyzed_at", "updated_at"))
    out = files.agg(F.count("*").alias("files"))
    for part in (
        now.agg(F.count("*").alias("functions"), F.count("semantic_analyzed_at").alias("analysed")),
        graph.clean_edges(relationships).agg(F.count("*").alias("edges")),
        routes.select("id").distinct().agg(F.count("*").alias("routes")),
        constants.select("id").distinct().agg(F.count("*").alias("constants")),
        queue.entries(waiting).where("status = 'pending'").agg(F.count("*").alias("pending")),
    ):
        out = out.crossJoin(part)  # one row each
    return out


def route_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every route as a card of text."""
    routes, files = _t(spark, sf_dir, "routes", "files")
    one = routes.dropDuplicates(["id"]).join(files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path")), "file_id", "left")
    guards = text.string_array(F.col("middleware"))
    # The labels of the lines, and how much of a body is shown.
    lines = [
        F.concat(text.pad_end(F.upper("method"), 7), F.col("path")),
        F.concat(F.lit("   Location: "), text.location(F.col("file_path"), F.col("start_line"))),
        F.when(F.coalesce("handler_name", F.lit("")) != "", F.concat(F.lit("   Handler: "), "handler_name")),
        F.when(F.size(guards) > 0, F.concat(F.lit("   Middleware: "), F.array_join(guards, ", "))),
        F.when(F.coalesce("purpose", F.lit("")) != "", F.concat(F.lit("   Purpose: "), "purpose")),
        F.concat(F.lit("   Handler body: "), text.ellipsis(F.col("handler_body"), 300)),
    ]
    return one.select("id", F.concat_ws("\n", *lines).alias("card"))


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens of the documents per source."""
    documents = _t(spark, sf_dir, "documents").where("text IS NOT NULL")
    estimate = text.estimated_tokens(F.col("text"))
    clean = F.coalesce(F.lower(F.trim("source")), F.lit("unknown"))
    return documents.groupBy(clean.alias("source")).agg(F.count("*").alias("documents"), F.sum(estimate).alias("tokens"), F.max(estimate).alias("longest"))


def question_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """which retrieval each question asks for; one question per function, wording by its id."""
    names = graph.first_by_name(_t(spark, sf_dir, "functions"))
    wordings = ["What calls {}?", "what does {} depend on", "What breaks if I change `{}`?", "please explain {}", "list all constants", "tell me about {}", "which endpoint /api/x uses {}?"]
    case = F.lit(None).cast("string")
    for i, wording in enumerate(wordings):
        before, _, after = wording.partition("{}")
        words = F.concat(F.lit(before), "name", F.lit(after)) if "{}" in wording else F.lit(wording)
        case = F.when(F.col("id") % len(wordings) == i, words).otherwise(case)
    asked = names.select("id", case.alias("question"))
    return classify.with_classification(asked, F.col("question")).select("id", "c.strategy", "c.direction", "c.function_name", "c.list_entity")


QUERIES = {
    f.__name__: f
    for f in (
        function_by_name, unique_function_names, functions_of_file, domain_functions, exported_constants, not_analysed, kept_edges, bound_edges, callers_of_functions, callees_of_functions, impact,
        search_index, search_functions, search_routes, search_many, search_constants, search_route_paths, file_keepers, upserted_files, file_status, merged_files, change_outcomes, ingest_totals, counts_after_delete, entities_of_files, edges_after_delete, current_functions, updated_functions, queue_processed, path_parts,
        code_hashes, changed_functions, queue_top, queue_batches, to_enqueue, statistics, route_cards, document_tokens, question_strategies,
    )
}

# --- oracle SQL ----------------------------------------------------------------------------------------------------

_FN = "fn AS (SELECT * FROM functions QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) = 1)"
_PATH = r"regexp_replace(replace({}, '\', '/'), '^\./+', '')"
_NEXT = f"n AS (SELECT {_PATH.format('path')} AS path, min(CASE WHEN contains(path, '.test.') THEN sha256(content_hash) ELSE content_hash END) AS content_hash FROM files GROUP BY 1)"
_EDGES = "ed AS (SELECT min(id) AS id, caller_function_id, callee_function_id, callee_name, lower(trim(relation_type)) AS relation_type FROM relationships WHERE caller_function_id IS NOT NULL GROUP BY ALL)"
_EDGES = _EDGES.replace("GROUP BY ALL", "GROUP BY 2, 3, 4, 5")
_NAMED = "nm AS (SELECT f.id, any_value(f.name) AS name, any_value(coalesce(p.path, 'unknown') || ':' || f.start_line) AS location, any_value(f.file_id) AS file_id FROM functions f LEFT JOIN files p ON p.id = f.file_id GROUP BY f.id)"
_FIRST = "fi AS (SELECT name, min(id) AS id FROM functions WHERE name IS NOT NULL GROUP BY name)"
_TOKENS = r"list_filter(regexp_split_to_array(strip_accents(lower(coalesce({}, ''))), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
_QUEUE = "qu AS (SELECT * REPLACE (lower(trim(status)) AS status) FROM analysis_queue QUALIFY row_number() OVER (PARTITION BY id ORDER BY processed_at DESC NULLS LAST, status) = 1)"
_DOMAIN = f"CASE WHEN lower(trim(domain)) IN ({', '.join(repr(d) for d in validate.DOMAINS)}) THEN lower(trim(domain)) WHEN domain IS NOT NULL THEN 'other' END"


def _phrase_hit(columns: list[str]) -> str:
    phrases = ["slow", "cache", "tenant", "noisyrow"]
    return " OR ".join(f"list_contains({_TOKENS.format(c)}, '{p}')" for c in columns for p in phrases)


def _postings(columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS field, id, unnest({_TOKENS.format(c)}) AS token FROM fn" for c in columns)


def _like(term: str) -> str:
    return f"(name ILIKE '%{term}%' OR value_text ILIKE '%{term}%')"


ORACLE = {
    "function_by_name": f"WITH {_NAMED}, {_FIRST} SELECT fi.name, fi.id, nm.file_id, nm.location FROM fi JOIN nm USING (id)",
    "unique_function_names": "SELECT name, min(id) AS id FROM functions WHERE name IS NOT NULL GROUP BY name HAVING count(DISTINCT id) = 1",
    "functions_of_file": f"""SELECT id AS file_id, {_PATH.format('path')} AS path,
 (SELECT count(DISTINCT x.id) FROM functions x WHERE x.file_id = f.id) AS functions, (SELECT count(DISTINCT x.id) FROM routes x WHERE x.file_id = f.id) AS routes,
 (SELECT count(DISTINCT x.id) FROM constants x WHERE x.file_id = f.id) AS constants FROM files f""",
    "domain_functions": f"""WITH {_FN}, c AS (SELECT id, name, {_DOMAIN} AS domain, CASE WHEN lower(trim(complexity)) IN ('low', 'medium', 'high') THEN lower(trim(complexity)) WHEN complexity IS NOT NULL THEN 'medium' END AS complexity FROM fn)
SELECT * FROM c WHERE domain IN ('authentication', 'other')""",
    "exported_constants": "SELECT DISTINCT id, name, file_id, CASE WHEN length(value_text) > 200 THEN substring(value_text, 1, 200) || '...' ELSE value_text END AS preview FROM constants WHERE is_exported",
    "not_analysed": f"""WITH {_FN} SELECT 'function' AS kind, id, name FROM fn WHERE semantic_analyzed_at IS NULL
UNION ALL SELECT DISTINCT 'route', id, coalesce(handler_name, '') FROM routes WHERE semantic_analyzed_at IS NULL""",
    "kept_edges": f"WITH {_EDGES} SELECT * FROM ed",
    "bound_edges": f"""WITH {_EDGES}, un AS (SELECT name, min(id) AS id FROM functions WHERE name IS NOT NULL GROUP BY name HAVING count(DISTINCT id) = 1)
SELECT ed.id, caller_function_id, coalesce(callee_function_id, un.id) AS callee_function_id, callee_name, relation_type FROM ed LEFT JOIN un ON un.name = callee_name""",
    "callers_of_functions": f"""WITH {_EDGES}, {_NAMED}, {_FIRST}, c AS (SELECT coalesce(callee_function_id, fi.id) AS function_id, caller_function_id AS caller_id, min(ed.id) AS edge_id
 FROM ed LEFT JOIN fi ON fi.name = callee_name WHERE relation_type = 'calls' AND coalesce(callee_function_id, fi.id) IS NOT NULL GROUP BY 1, 2)
SELECT function_id, caller_id, nm.name AS caller_name, nm.location, edge_id FROM c JOIN nm ON nm.id = caller_id""",
    "callees_of_functions": f"""WITH {_EDGES}, {_NAMED} SELECT caller_function_id AS function_id, ed.id AS edge_id, callee_function_id AS callee_id, coalesce(nm.name, callee_name) AS callee_name, coalesce(nm.location, 'unresolved') AS location
FROM ed LEFT JOIN nm ON nm.id = callee_function_id WHERE relation_type = 'calls'""",
    "impact": f"""WITH RECURSIVE {_EDGES}, ca AS (SELECT * FROM ed WHERE relation_type = 'calls'),
top AS (SELECT callee_function_id AS id FROM ca WHERE callee_function_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
seed AS (SELECT top.id, any_value(name) AS name FROM top JOIN functions USING (id) GROUP BY top.id),
direct AS (SELECT DISTINCT caller_function_id AS id FROM ca, seed WHERE callee_function_id = seed.id OR callee_name = seed.name),
up AS (SELECT id FROM direct UNION SELECT ca.caller_function_id FROM ca JOIN up ON ca.callee_function_id = up.id)
SELECT up.id, any_value(name) AS name, up.id IN (SELECT id FROM direct) AS direct FROM up JOIN functions USING (id) GROUP BY up.id""",
    "search_index": f"WITH {_FN}, p AS ({_postings(['name', 'purpose', 'behavior_summary'])}) SELECT token, field, count(DISTINCT id) AS documents, count(*) AS occurrences FROM p GROUP BY 1, 2",
    "search_functions": f"WITH {_FN} SELECT id, name FROM fn WHERE {_phrase_hit(['name', 'purpose', 'behavior_summary'])} ORDER BY id LIMIT 10",
    "search_routes": f"SELECT DISTINCT id, path FROM routes WHERE {_phrase_hit(['path', 'handler_body', 'purpose'])}",
    "search_many": f"""WITH {_FN}, p AS ({_postings(['name', 'purpose', 'behavior_summary'])}), q AS (SELECT DISTINCT item_id AS question_id, unnest({_TOKENS.format('question')}) AS token FROM eval_items WHERE item_id % 50 = 0),
h AS (SELECT DISTINCT question_id, id FROM p JOIN q USING (token) WHERE length(token) > 3)
SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY id)::INTEGER AS rank FROM h QUALIFY rank <= 10""",
    "search_constants": "WITH c AS (SELECT DISTINCT id, name, value_text FROM constants), h AS ("
    + " UNION ALL ".join(f"(SELECT id, {i} AS term_at FROM c WHERE {_like(t)} ORDER BY id LIMIT 5)" for i, t in enumerate(LIKE_TERMS))
    + ") SELECT id, min(term_at)::INTEGER AS term_at FROM h GROUP BY id ORDER BY term_at, id LIMIT 5",
    "search_route_paths": "SELECT DISTINCT id, method, path FROM routes WHERE path ILIKE '%/t_a%' AND upper(method) = 'GET'",
    "file_keepers": f"""WITH {_FN}, c AS (SELECT f.id, {_PATH.format('f.path')} AS path, count(fn.id) AS functions, count(fn.semantic_analyzed_at) AS analysed FROM files f LEFT JOIN fn ON fn.file_id = f.id GROUP BY 1, 2)
SELECT path, id AS kept_id, analysed, functions FROM c QUALIFY row_number() OVER (PARTITION BY path ORDER BY analysed DESC, functions DESC, id) = 1""",
    "upserted_files": f"""WITH {_NEXT}
SELECT b.id, b.path, coalesce(n.content_hash, b.content_hash) AS content_hash FROM files b LEFT JOIN n USING (path)
UNION ALL SELECT (SELECT max(id) FROM files) + row_number() OVER (ORDER BY encode(path)), path, content_hash FROM n WHERE path NOT IN (SELECT path FROM files)""",
    "file_status": f"""WITH {_NEXT} SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.content_hash IS NOT DISTINCT FROM n.content_hash THEN 'unchanged' ELSE 'changed' END AS status
FROM files o FULL JOIN n ON o.path = n.path""",
    "merged_files": f"""WITH {_FN}, c AS (SELECT f.id, {_PATH.format('f.path')} AS path, count(fn.id) AS functions, count(fn.semantic_analyzed_at) AS analysed FROM files f LEFT JOIN fn ON fn.file_id = f.id GROUP BY 1, 2)
SELECT id, path, functions FROM c QUALIFY row_number() OVER (PARTITION BY path ORDER BY analysed DESC, functions DESC, id) = 1""",
    "change_outcomes": f"""WITH {_NEXT}, s AS (SELECT CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.content_hash IS NOT DISTINCT FROM n.content_hash THEN 'unchanged' ELSE 'changed' END AS status
FROM files o FULL JOIN n ON o.path = n.path) SELECT status, count(*) AS n FROM s WHERE status <> 'unchanged' GROUP BY 1""",
    "ingest_totals": rf"""WITH {_NEXT}, {_FN}, st AS (SELECT n.path, o.id AS old_id, CASE WHEN o.path IS NULL THEN 'added' WHEN o.content_hash = n.content_hash THEN 'unchanged' ELSE 'changed' END AS s FROM n LEFT JOIN files o ON o.path = n.path),
pa AS (SELECT id AS file_id, {_PATH.format('path')} AS path FROM files), tf AS (SELECT pa.file_id, st.* FROM pa JOIN st USING (path) WHERE s <> 'unchanged'),
nf AS (SELECT fn.*, tf.path, tf.old_id, tf.s, 'x' || replace(body, chr(10), chr(10) || 'x') AS new_body FROM fn JOIN tf USING (file_id)),
ol AS (SELECT file_id, name, body, signature, code_hash FROM fn QUALIFY row_number() OVER (PARTITION BY file_id, name ORDER BY id DESC) = 1),
df AS (SELECT nf.s, ol.code_hash AS oh, ol.signature IS DISTINCT FROM CASE WHEN nf.is_async THEN nf.signature || ' ' ELSE nf.signature END AS sig,
 list_distinct(list_transform(string_split(coalesce(ol.body, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))) AS a, list_distinct(list_transform(string_split(nf.new_body, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))) AS b,
 greatest(len(string_split(coalesce(ol.body, ''), chr(10))), len(string_split(nf.new_body, chr(10))), 1) AS m FROM nf LEFT JOIN ol ON nf.s = 'changed' AND ol.file_id = nf.old_id AND ol.name = nf.name),
{_EDGES}, ca AS (SELECT DISTINCT tf.path, fn.name, callee_name, relation_type FROM ed JOIN fn ON fn.id = caller_function_id JOIN tf USING (file_id))
SELECT (SELECT count(*) FROM st WHERE s = 'added') AS new_files, (SELECT count(*) FROM st WHERE s = 'changed') AS changed_files, (SELECT count(*) FROM st WHERE s = 'unchanged') AS unchanged_files,
 (SELECT count(*) FROM nf) AS functions, (SELECT count(DISTINCT r.id) FROM routes r JOIN tf USING (file_id)) AS routes, (SELECT count(DISTINCT c.id) FROM constants c JOIN tf USING (file_id)) AS constants, (SELECT count(*) FROM ca) AS relationships,
 (SELECT count(*) FROM df WHERE oh IS NULL OR sig OR (len(list_filter(a, lambda x: NOT list_contains(b, x))) + len(list_filter(b, lambda x: NOT list_contains(a, x)))) / m > 0.3) AS queued""",
    "counts_after_delete": f"""WITH {_FN}, {_EDGES}, {_QUEUE}, g AS (SELECT id FROM files WHERE contains(path, '.test.')), gf AS (SELECT id FROM fn WHERE file_id IN (SELECT id FROM g))
SELECT 'files' AS name, count(*) AS n FROM files WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'functions', count(*) FROM fn WHERE file_id NOT IN (SELECT id FROM g)
UNION ALL SELECT 'routes', count(DISTINCT id) FROM routes WHERE file_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'constants', count(DISTINCT id) FROM constants WHERE file_id NOT IN (SELECT id FROM g)
UNION ALL SELECT 'relationships', count(*) FROM ed WHERE caller_function_id NOT IN (SELECT id FROM gf) UNION ALL SELECT 'analysis_queue', count(*) FROM qu WHERE function_id NOT IN (SELECT id FROM gf)""",
    "entities_of_files": """WITH e AS (SELECT 'function' AS kind, id, file_id, name, start_line FROM functions UNION SELECT 'route', id, file_id, concat_ws(' ', upper(method), path), start_line FROM routes UNION SELECT 'constant', id, file_id, name, start_line FROM constants)
SELECT kind, e.id, file_id, name, coalesce(p.path, 'unknown') || ':' || start_line AS location FROM e LEFT JOIN files p ON p.id = file_id""",
    "edges_after_delete": f"""WITH {_EDGES}, gone AS (SELECT x.id FROM functions x JOIN files f ON f.id = x.file_id WHERE contains(f.path, '.test.'))
SELECT id, caller_function_id, CASE WHEN callee_function_id IN (SELECT id FROM gone) THEN NULL ELSE callee_function_id END AS callee_function_id, callee_name, relation_type FROM ed WHERE caller_function_id NOT IN (SELECT id FROM gone)""",
    "current_functions": f"""WITH {_FN} SELECT id, name, purpose, domain, complexity, CASE WHEN side_effects_json IS NULL OR trim(side_effects_json) = '' OR trim(side_effects_json)[1] = '{{' THEN ''
 WHEN json_valid(side_effects_json) THEN array_to_string(from_json(side_effects_json, '["VARCHAR"]'), '; ') WHEN trim(side_effects_json)[1] = '[' THEN '' ELSE trim(side_effects_json) END AS effects, code_hash FROM fn""",
    "updated_functions": """WITH a AS (SELECT * FROM functions QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at NULLS FIRST) = 1), b AS (SELECT * FROM functions QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) = 1)
SELECT id, coalesce(b.purpose, a.purpose) AS purpose, coalesce(b.domain, a.domain) AS domain, coalesce(b.complexity, a.complexity) AS complexity FROM a JOIN b USING (id)""",
    "queue_processed": f"""WITH {_FN}, {_QUEUE} SELECT qu.id, CASE WHEN status = 'pending' AND semantic_analyzed_at IS NOT NULL THEN 'done' ELSE status END AS status,
 epoch_us(CASE WHEN status = 'pending' AND semantic_analyzed_at IS NOT NULL THEN semantic_analyzed_at ELSE processed_at END) AS processed_us FROM qu LEFT JOIN fn ON fn.id = function_id""",
    "path_parts": f"SELECT id, {_PATH.format('path')} AS repo_path, regexp_split_to_array(path, '[/\\\\]')[-1] AS name FROM files",
    "code_hashes": "SELECT DISTINCT id, sha256(body) = code_hash AS holds, sha256('v1|stub|' || sha256(body)) AS cache_key FROM functions",
    "changed_functions": r"""WITH one AS (SELECT DISTINCT id, file_id, start_line, signature, body, code_hash, is_exported FROM functions),
o AS (SELECT *, lag(code_hash) OVER w AS oh, lag(signature) OVER w AS os, lag(body) OVER w AS ob FROM one WINDOW w AS (PARTITION BY file_id ORDER BY start_line, id)),
s AS (SELECT *, list_distinct(list_transform(string_split(coalesce(ob, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))) AS a,
 list_distinct(list_transform(string_split(body, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))) AS b FROM o),
r AS (SELECT *, (len(list_filter(a, lambda x: NOT list_contains(b, x))) + len(list_filter(b, lambda x: NOT list_contains(a, x))))::DOUBLE
 / greatest(len(string_split(coalesce(ob, ''), chr(10))), len(string_split(body, chr(10))), 1) AS ratio FROM s),
d AS (SELECT id, is_exported, ratio, CASE WHEN oh IS NULL THEN 'new' WHEN oh = code_hash THEN 'unchanged' WHEN os IS DISTINCT FROM signature THEN 'signature_changed' WHEN ratio > 0.3 THEN 'body_changed' ELSE 'minor_change' END AS reason FROM r)
SELECT id, reason, round(ratio, 6) AS ratio, (CASE reason WHEN 'new' THEN 5 WHEN 'signature_changed' THEN 10 WHEN 'body_changed' THEN 7 ELSE 1 END + CASE WHEN is_exported THEN 5 ELSE 0 END)::INTEGER AS priority FROM d""",
    "queue_top": f"WITH {_QUEUE} SELECT id, function_id, priority FROM qu WHERE status = 'pending' ORDER BY qu.priority DESC NULLS LAST, created_at NULLS LAST, id LIMIT 10",
    "queue_batches": f"WITH {_QUEUE}, r AS (SELECT id, row_number() OVER (ORDER BY priority DESC NULLS LAST, created_at NULLS LAST, id) AS rank FROM qu WHERE status = 'pending') SELECT id, rank, (rank - 1) // 8 AS batch FROM r",
    "to_enqueue": f"""WITH {_FN}, {_QUEUE} SELECT id AS function_id, (CASE WHEN is_exported THEN 6 ELSE 1 END)::INTEGER AS priority, 'unanalyzed' AS reason FROM fn
WHERE semantic_analyzed_at IS NULL AND NOT EXISTS (SELECT 1 FROM qu WHERE qu.function_id = fn.id AND status = 'pending')""",
    "statistics": f"""WITH {_FN}, {_EDGES}, {_QUEUE} SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM fn) AS functions, (SELECT count(semantic_analyzed_at) FROM fn) AS analysed, (SELECT count(*) FROM ed) AS edges,
 (SELECT count(DISTINCT id) FROM routes) AS routes, (SELECT count(DISTINCT id) FROM constants) AS constants, (SELECT count(*) FROM qu WHERE status = 'pending') AS pending""",
    "route_cards": """WITH r AS (SELECT * FROM routes QUALIFY row_number() OVER (PARTITION BY id ORDER BY id) = 1), m AS (SELECT r.*, p.path AS file_path, CASE WHEN json_valid(middleware) AND middleware <> '' THEN array_to_string(from_json(middleware, '["VARCHAR"]'), ', ') ELSE '' END AS guards
 FROM r LEFT JOIN files p ON p.id = r.file_id)
SELECT id, concat_ws(chr(10), CASE WHEN length(method) < 7 THEN rpad(upper(method), 7, ' ') ELSE upper(method) END || path, '   Location: ' || coalesce(file_path, 'unknown') || ':' || start_line,
 CASE WHEN coalesce(handler_name, '') <> '' THEN '   Handler: ' || handler_name END, CASE WHEN guards <> '' THEN '   Middleware: ' || guards END, CASE WHEN coalesce(purpose, '') <> '' THEN '   Purpose: ' || purpose END,
 '   Handler body: ' || CASE WHEN length(handler_body) > 300 THEN substring(handler_body, 1, 300) || '...' ELSE handler_body END) AS card FROM m""",
    "document_tokens": "SELECT coalesce(lower(trim(source)), 'unknown') AS source, count(*) AS documents, sum(ceil(length(text) / 4))::BIGINT AS tokens, max(ceil(length(text) / 4))::BIGINT AS longest FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "question_strategies": f"""WITH {_FIRST}, c AS (SELECT id, id % 7 AS k, name, name FROM fi)
SELECT id, CASE k WHEN 0 THEN 'relationship' WHEN 1 THEN 'relationship' WHEN 2 THEN 'impact' WHEN 3 THEN 'direct' WHEN 4 THEN 'list' WHEN 6 THEN 'route' END AS strategy, CASE k WHEN 0 THEN 'callers' WHEN 1 THEN 'callees' END AS direction,
 CASE WHEN k < 4 THEN name END AS function_name, CASE WHEN k = 4 THEN 'constants' END AS list_entity FROM c""",
}

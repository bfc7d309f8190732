"""Answering many structured questions at once: classify, look up the cache, retrieve per strategy, assemble contexts.

A question is a row with its strategy and the fields of `classify.FIELDS`. Each strategy is a join of all its questions with the
tables; the entries of all strategies are one table, and the contexts are aggregated from it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify, text, validate
from ..operators import graph, search, tables
from ..session import table, written
from ..sources.report import mode_averages
from .activity import fitted

BUDGET = 3000
#: Entries and listed names beyond these can't be seen within the budget: an entry has 20 characters or more, a name 3.
MOST_ENTRIES, MOST_NAMES = BUDGET * 4 // 20 + 1, BUDGET * 4 // 3 + 1

# How many entries each strategy takes, and which lines and headings its entries have.
LIMITS = {"semantic": {"function": 10, "route": 5, "constant": 5}, "pattern": {"function": 15, "route": 10, "constant": 5}}
LISTED_FUNCTIONS, CROSS_SECTION = 50, 10
LINES = {
    "Purpose: ": ("purpose", ["direct", "relationship", "semantic", "domain", "impact", "file", "list", "pattern"]),
    "Behavior: ": ("behavior", ["direct", "relationship", "semantic"]),
    "Side Effects: ": ("effects", ["direct", "domain"]),
    "Domain: ": ("domain", ["direct", "semantic"]),
    "Complexity: ": ("complexity", ["direct"]),
    "Calls: ": ("calls", ["direct", "relationship", "semantic", "domain", "impact"]),
    "Called By: ": ("called_by", ["direct", "relationship"]),
}
HEADINGS = {"function": "Functions:\n", "route": "Routes:\n", "constant": "Constants:\n"}
WITH_HEADINGS, WITHOUT_CONSTANTS = ["file", "list", "pattern"], ["semantic", "pattern"]
NOTHING_FOUND = "No results found matching the query."

_ENTRY = ["question_id", "strategy", "kind", "order_key", "entity_id", "unresolved"]


def classified_questions(questions: DataFrame) -> DataFrame:
    """(question_id, question, *FIELDS): questions that no wording settles are searched by their longer words."""
    asked = classify.with_classification(questions.select("question_id", "question"), F.col("question"))
    fields = [F.col(f"c.{f}").alias(f) for f in classify.FIELDS if f not in ("strategy", "keywords")]
    words = F.when(F.col("c").isNull(), classify.fallback_keywords(F.col("question"))).otherwise(F.col("c.keywords"))
    return asked.select("question_id", "question", F.coalesce("c.strategy", F.lit("semantic")).alias("strategy"), F.coalesce(words, F.array().cast("array<string>")).alias("keywords"), *fields)


def function_rows(functions: DataFrame, files: DataFrame) -> DataFrame:
    """(id, file_id, name, location, signature, purpose, behavior, effects, domain, complexity): the last delivery of each function."""
    now = tables.latest(functions)
    paths = files.select(F.col("id").alias("file_id"), "path").dropDuplicates(["file_id"])
    effects = F.array_join(F.coalesce(F.from_json("side_effects_json", "array<string>"), F.array().cast("array<string>")), ", ")
    return now.join(paths, "file_id", "left").select(
        "id", "file_id", "name", text.location(F.col("path"), F.col("start_line")).alias("location"), "signature", "purpose", F.col("behavior_summary").alias("behavior"), effects.alias("effects"), "domain", "complexity"
    )


def _of(asked: DataFrame, strategy: str, *fields: str) -> DataFrame:
    return asked.where(F.col("strategy") == strategy).select("question_id", "strategy", *fields)


def _rows(df: DataFrame, kind: str, order: Column, entity: str = "id", unresolved: Column | None = None) -> DataFrame:
    """Entries of one kind; `order` is what they are sorted by within a question."""
    name = F.lit(None).cast("string") if unresolved is None else unresolved
    return df.select("question_id", "strategy", F.lit(kind).alias("kind"), order.cast("long").alias("order_key"), F.col(entity).cast("long").alias("entity_id"), name.alias("unresolved"))


def _about_one(asked: DataFrame, rows: DataFrame, edges: DataFrame) -> list[DataFrame]:
    """direct, relationship and impact: questions about the first function of a name."""
    firsts = graph.first_by_name(rows).select(F.col("name").alias("function_name"), F.col("id").alias("at"))
    about = asked.where("function_name IS NOT NULL").join(firsts, "function_name").select("question_id", "strategy", "direction", "at", F.col("function_name").alias("name"))
    known = rows.select(F.col("id").alias("known"))
    one = about.where("strategy = 'direct'")
    up = about.where("strategy = 'relationship' AND coalesce(direction, 'callers') <> 'callees'")
    called = graph.callers_of(edges, up.select(F.col("at").alias("id"), "name").distinct()).withColumnRenamed("id", "at")
    up = up.join(called, "at").join(known, F.col("caller_id") == F.col("known"))
    down = about.where("strategy = 'relationship' AND direction = 'callees'")
    calls = edges.where("relation_type = 'calls'").select(F.col("caller_function_id").alias("at"), F.col("id").alias("edge_id"), "callee_function_id", "callee_name")
    down = down.join(calls, "at")
    resolved = down.join(known, F.col("callee_function_id") == F.col("known")).select("question_id", "strategy", "callee_function_id").distinct()
    open_ = down.where("callee_function_id IS NULL")
    after = F.col("edge_id") + F.lit(1 << 62)  # after all functions, which are in the order of their ids
    changed = about.where("strategy = 'impact'").select("question_id", "strategy", F.col("question_id").alias("seed"), F.col("at").alias("id"), "name")
    seeds = changed.select("seed", "id", "name")
    near = graph.callers_of(edges, seeds.select("id", "name").distinct()).join(seeds, "id").select("seed", F.col("caller_id").alias("id"), (F.col("by_name").cast("long") * (1 << 60) + F.col("edge_id")).alias("order_key"))
    far = graph.reached_by_each(edges, seeds).where("level > 1").join(near, ["seed", "id"], "left_anti").select("seed", "id", (F.col("id") + F.lit(1 << 62)).alias("order_key"))
    reached = near.unionByName(far).join(known, F.col("id") == F.col("known")).join(changed.select("question_id", "strategy", "seed").distinct(), "seed")
    return [
        _rows(one, "function", F.lit(0), "at"), _rows(up, "function", F.col("caller_id"), "caller_id"), _rows(resolved, "function", F.col("callee_function_id"), "callee_function_id"),
        _rows(open_, "function", after, "callee_function_id", F.col("callee_name")), _rows(reached, "function", F.col("order_key")),
    ]


def _searched(asked: DataFrame, entities: dict[str, DataFrame]) -> list[DataFrame]:
    """semantic and pattern: the words of the question against the indexes."""
    out = []
    for kind, name in (("function", "functions"), ("route", "routes")):
        index = search.postings(entities[kind], "id", search.SEARCHED[name])
        for strategy, limits in LIMITS.items():
            terms = text.search_terms(F.col("keywords"))
            phrases = _of(asked, strategy, F.explode(F.transform(terms, text.search_tokens)).alias("phrase"))
            found = search.phrases_found(index, phrases, limits[kind]).withColumn("strategy", F.lit(strategy))
            out.append(_rows(found, kind, F.col("rank")))
    for strategy, limits in LIMITS.items():
        terms = _of(asked, strategy, F.col("keywords").alias("terms")).where(F.size(text.search_terms(F.col("terms"))) > 0)
        found = search.names_like(entities["constant"], "name", terms, limits["constant"]).withColumn("strategy", F.lit(strategy))
        out.append(_rows(found, "constant", F.col("rank")))
    return out


def _by_place(asked: DataFrame, files: DataFrame, entities: dict[str, DataFrame]) -> list[DataFrame]:
    """domain, route, file and list: questions about all entities of a kind or place."""
    domain = _of(asked, "domain", F.coalesce("domain", F.lit("other")).alias("domain")).join(entities["function"].select("id", "domain"), "domain")
    routes = entities["route"].select("id", "method", F.col("path").alias("_path"))
    wanted = _of(asked, "route", "route_path", "route_method")
    by_path = wanted.where("route_path <> ''").join(routes, text.contains_like(F.col("_path"), F.col("route_path"))).where("route_method IS NULL OR method = upper(route_method)")
    every = wanted.where("coalesce(route_path, '') = ''").select("question_id", "strategy").crossJoin(routes.select("id"))  # each asks for all routes
    named = _of(asked, "file", text.repo_path(F.col("file_path")).alias("clean"), "file_path").where("file_path <> ''")
    paths = files.select(F.col("id").alias("file_id"), "path")
    exact = named.join(paths, F.col("clean") == F.col("path")).groupBy("question_id", "strategy").agg(F.min("file_id").alias("file_id"))
    part = named.join(exact.select("question_id"), "question_id", "left_anti").join(paths, F.contains("path", F.col("file_path"))).groupBy("question_id", "strategy").agg(F.min("file_id").alias("file_id"))
    of_file = exact.unionByName(part)
    listed = _of(asked, "list", F.coalesce("list_entity", F.lit("")).alias("what"))
    first = entities["function"].select("id").orderBy("id").limit(LISTED_FUNCTIONS)
    few = first.orderBy("id").limit(CROSS_SECTION)
    known = ["routes", "types", "files", "functions", "constants"]
    pairs = [
        ("function", listed.where("what = 'functions'"), first), ("function", listed.where(~F.col("what").isin(known)), few),
        ("route", listed.where((F.col("what") == "routes") | ~F.col("what").isin(known)), entities["route"].select("id")), ("constant", listed.where("what = 'constants'"), entities["constant"].select("id")),
    ]
    out = [_rows(domain, "function", F.col("id")), _rows(by_path, "route", F.col("id")), _rows(every, "route", F.col("id"))]
    out += [_rows(of_file.join(entities[kind].select("id", "file_id"), "file_id"), kind, F.col("id")) for kind in ("function", "route", "constant")]
    return out + [_rows(some.crossJoin(rows), kind, F.col("id")) for kind, some, rows in pairs]  # a list question asks for the whole table


def retrieved(questions: DataFrame, functions: DataFrame, files: DataFrame, relationships: DataFrame, routes: DataFrame | None = None, constants: DataFrame | None = None) -> DataFrame:
    """(question_id, strategy, kind, entry_at, entity_id, name, location): what is found for each question, numbered per kind.

    `questions` are rows (question_id, question), or those of `classified_questions` if they have a strategy already. Questions
    about one function take the first of its name. Callers and callees come in the order of their ids, callees that were never
    resolved after them; an impact has direct callers first, those by id before those by name. Type questions find nothing here,
    as there is no table of types. A question that finds nothing has no rows.
    """
    asked = questions if "strategy" in questions.columns else classified_questions(questions)
    spark = asked.sparkSession
    rows = function_rows(functions, files)
    named = rows.select("id", "file_id", "name", "purpose", F.col("behavior").alias("behavior_summary"), "domain", "location")
    place = lambda df: df.join(files.select(F.col("id").alias("file_id"), F.col("path").alias("_file")).dropDuplicates(["file_id"]), "file_id", "left").withColumn("location", text.location(F.col("_file"), F.col("start_line"))).drop("_file")
    none = "id long, file_id long, name string, method string, path string, handler_name string, handler_body string, middleware string, purpose string, value_text string, type_annotation string, is_exported boolean, start_line int"
    entities = {
        "function": named,
        "route": place((routes if routes is not None else spark.createDataFrame([], none)).dropDuplicates(["id"])),
        "constant": place((constants if constants is not None else spark.createDataFrame([], none)).dropDuplicates(["id"])),
    }
    found = reduce(DataFrame.unionByName, [*_about_one(asked, rows, graph.clean_edges(relationships)), *_searched(asked, entities), *_by_place(asked, files, entities)])
    entry_at = F.row_number().over(Window.partitionBy("question_id", "kind").orderBy("order_key", "entity_id"))
    found = found.select(*_ENTRY).withColumn("entry_at", entry_at)
    names = entities["function"].select(F.lit("function").alias("kind"), F.col("id").alias("entity_id"), "name", "location")
    names = names.unionByName(entities["route"].select(F.lit("route").alias("kind"), F.col("id").alias("entity_id"), F.concat_ws(" ", "method", "path").alias("name"), "location"))
    names = names.unionByName(entities["constant"].select(F.lit("constant").alias("kind"), F.col("id").alias("entity_id"), "name", "location"))
    return found.join(names, ["kind", "entity_id"], "left").select(
        "question_id", "strategy", "kind", "entry_at", "entity_id", F.coalesce("name", "unresolved").alias("name"), F.when(F.col("entity_id").isNull(), "unresolved").otherwise(F.col("location")).alias("location")
    )


def _listed(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """(id, <name>): the names of each id in order, as far as a context can show them."""
    place = F.row_number().over(Window.partitionBy("id").orderBy(*order))
    some = rows.withColumn("_at", place).where(F.col("_at") <= MOST_NAMES)
    return some.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "name"))), lambda s: s["name"]), ", ").alias(name))


def function_texts(entries: DataFrame, functions: DataFrame, files: DataFrame, relationships: DataFrame) -> DataFrame:
    """`entries` of functions with `text`, the entry as its strategy shows it."""
    rows = function_rows(functions, files)
    edges = graph.clean_edges(relationships)
    shown = entries.where("entity_id IS NOT NULL").select(F.col("entity_id").alias("id")).distinct()
    calls = edges.where("relation_type = 'calls'").select(F.col("caller_function_id").alias("id"), F.col("id").alias("edge_id"), F.coalesce("callee_name", F.lit("")).alias("name"))
    calls = _listed(calls.join(shown, "id", "left_semi"), "calls", "edge_id")
    with_callers = entries.where(F.col("strategy").isin(LINES["Called By: "][1])).select(F.col("entity_id").alias("id")).distinct()
    up = graph.callers_of(edges, rows.select("id", "name").join(with_callers, "id", "left_semi"), MOST_NAMES)
    up = up.join(rows.select(F.col("id").alias("caller_id"), "name"), "caller_id", "left").select("id", "by_name", "edge_id", F.coalesce("name", F.lit("unknown")).alias("name"))
    up = _listed(up, "called_by", "by_name", "edge_id")
    full = rows.drop("file_id", "name", "location").join(calls, "id", "left").join(up, "id", "left").withColumnRenamed("id", "entity_id")
    direct = F.col("strategy") == "direct"
    indent = F.when(direct, "").otherwise("   ")
    line = lambda label, column: F.concat(indent, F.lit(label), column)
    # The labels of the lines.
    head = F.when(direct, F.concat(F.lit("Function: "), "name")).otherwise(F.format_string("%d. %s", "entry_at", "name"))
    more = [F.when(F.col("strategy").isin(some) & (F.coalesce(F.col(column), F.lit("")) != ""), line(label, F.col(column))) for label, (column, some) in LINES.items()]
    shown_text = F.concat_ws("\n", head, line("Location: ", F.col("location")), line("Signature: ", F.coalesce("signature", "name")), *more)
    return entries.join(full, "entity_id", "left").select(*entries.columns, shown_text.alias("text"))


def route_text(number: Column, method: Column) -> Column:
    """A route as an entry; its columns are those of the table, with `location`."""
    guards = text.string_array(F.col("middleware"))
    # The labels of the lines, and how much of a body is shown.
    return F.concat_ws(
        "\n", F.concat(number, F.lit(". "), method, F.lit(" "), F.col("path")), F.concat(F.lit("   Location: "), "location"),
        F.when(F.coalesce("handler_name", F.lit("")) != "", F.concat(F.lit("   Handler: "), "handler_name")), F.when(F.size(guards) > 0, F.concat(F.lit("   Middleware: "), F.array_join(guards, ", "))),
        F.when(F.coalesce("purpose", F.lit("")) != "", F.concat(F.lit("   Purpose: "), "purpose")), F.concat(F.lit("   Handler body: "), text.ellipsis(F.coalesce("handler_body", F.lit("")), 300)),
    )


def constant_text(number: Column) -> Column:
    value = F.col("value_text")
    # The labels of the lines, and how much of a value is shown.
    return F.concat_ws(
        "\n", F.concat(number, F.lit(". "), F.col("name"), F.when(F.col("is_exported"), " (exported)").otherwise("")), F.concat(F.lit("   Location: "), "location"),
        F.when(F.coalesce("type_annotation", F.lit("")) != "", F.concat(F.lit("   Type: "), "type_annotation")), F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit("   Value: "), text.ellipsis(value, 200))),
    )


def contexts(entries: DataFrame, questions: DataFrame, functions: DataFrame, files: DataFrame, relationships: DataFrame, routes: DataFrame | None = None, constants: DataFrame | None = None) -> DataFrame:
    """(question_id, context): the entries of each question as text, within the token budget, under a line that counts them all."""
    total = entries.groupBy("question_id", "strategy").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "function").alias("functions"))
    visible = entries.where(~(F.col("strategy").isin(WITHOUT_CONSTANTS) & (F.col("kind") == "constant")) & ((F.col("strategy") != "direct") | (F.col("entry_at") == 1)))
    section = F.when(F.col("kind") == "function", 0).when(F.col("kind") == "route", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("section", "entry_at"))
    visible = visible.withColumn("section", section).withColumn("place", place).where(F.col("place") <= MOST_ENTRIES)
    visible = written(visible, "ask-visible")
    texts = function_texts(visible.where("kind = 'function'"), functions, files, relationships).select("question_id", "strategy", "kind", "entry_at", "place", "text")
    number = F.col("entry_at").cast("string")
    for kind, entity, shown in (("route", routes, lambda: route_text(number, F.col("method"))), ("constant", constants, lambda: constant_text(number))):
        if entity is not None:
            one = entity.dropDuplicates(["id"]).withColumnRenamed("id", "entity_id").drop("location", *(() if kind == "constant" else ("name",)))
            some = visible.where(F.col("kind") == kind).drop(*(("name",) if kind == "constant" else ()))
            texts = texts.unionByName(some.join(one, "entity_id").select("question_id", "strategy", "kind", "entry_at", "place", shown().alias("text")))
    heading = F.when(F.col("strategy").isin(WITH_HEADINGS) & (F.col("entry_at") == 1), F.create_map(*[F.lit(x) for pair in HEADINGS.items() for x in pair])[F.col("kind")]).otherwise("")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat(heading, "text").alias("text")))), lambda s: s["text"])
    body = texts.groupBy("question_id").agg(F.array_join(listed, "\n\n").alias("body"))
    joined = questions.select("question_id", "question").join(total, "question_id", "left").join(body, "question_id", "left")
    affected = F.when(F.col("strategy") == "impact", F.format_string("Functions affected (%d total):\n\n", "functions")).otherwise("")
    joined = joined.withColumn("fit", fitted(F.concat(affected, F.coalesce("body", F.lit(""))), BUDGET))
    header = F.format_string("[Context retrieved via %s strategy | %d entities | ~%d tokens]\n\n", "strategy", "n", text.estimated_tokens(F.col("fit")))
    nothing = F.concat(F.lit(NOTHING_FOUND + "\n\nQuestion: "), F.coalesce("question", F.lit("")))
    return joined.select("question_id", F.when(F.col("n").isNull(), nothing).otherwise(F.concat(header, "fit")).alias("context"))


def function_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every function as the card that a question about it alone gets."""
    functions, files, relationships = (table(spark, sf_dir, n) for n in ("functions", "files", "relationships"))
    entry = {"strategy": F.lit("direct"), "entry_at": F.lit(1), "entity_id": F.col("id")}
    entries = function_rows(functions, files).select("id", "name", "location").withColumns(entry).drop("id")
    return function_texts(entries, functions, files, relationships).select(F.col("entity_id").alias("id"), fitted(F.col("text"), BUDGET).alias("card"))


def token_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of the card of each function against those of all code, which a question without a graph needs."""
    cards = function_cards(spark, sf_dir).select(F.lit("graph").alias("mode"), text.estimated_tokens(F.col("card")).alias("total_tokens"))
    code = table(spark, sf_dir, "functions").select("id", "body").dropDuplicates(["id"]).agg(F.sum(text.estimated_tokens(F.col("body"))).alias("total_tokens"))
    runs = cards.unionByName(code.select(F.lit("traditional").alias("mode"), "total_tokens")).withColumns({"cost_usd": F.lit(0.0), "response_time_ms": F.lit(0)})
    averages = mode_averages(runs)
    return averages.select(*[F.round(c, 6).alias(c) for c in ("traditional_total_tokens", "graph_total_tokens", "total_tokens_reduction")])


def route_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every route as a part of a prompt, with its body cut to a thousand characters."""
    routes = table(spark, sf_dir, "routes").dropDuplicates(["id"])
    line = F.concat_ws(" ", "method", "path")
    return routes.select("id", F.concat_ws("\n", line, F.concat(F.lit("Handler: "), F.coalesce("handler_name", F.lit("inline"))), F.substring("handler_body", 1, 1000)).alias("part"))


def questions_of(functions: DataFrame) -> DataFrame:
    """One question per function whose id is divisible by 50, worded by its id."""
    names = graph.first_by_name(functions).where("id % 50 = 0")
    wording = F.element_at(F.array(*[F.lit(x) for x in ("what calls ", "what does ", "explain ", "tell me about ")]), (F.floor(F.col("id") / 50) % 4 + 1).cast("int"))
    end = F.when(F.floor(F.col("id") / 50) % 4 == 1, " call?").otherwise("")
    return names.select(F.col("id").alias("question_id"), F.concat(wording, F.col("name"), end).alias("question"))


def classified_of(functions: DataFrame, files: DataFrame, relationships: DataFrame, routes: DataFrame, eval_items: DataFrame) -> DataFrame:
    """Questions of the other strategies, as a classifier gives them: the five most called functions' impact, every domain, files
    and routes of ids divisible by 50, held-out questions as patterns, and every list."""
    edges = graph.clean_edges(relationships).where("relation_type = 'calls' AND callee_function_id IS NOT NULL")
    top = edges.groupBy(F.col("callee_function_id").alias("id")).agg(F.count("*").alias("n")).join(functions.select("id", "name").dropDuplicates(["id"]), "id").orderBy(F.desc("n"), "id").limit(5)
    row = lambda df, kind, number, strategy, **fields: df.select(
        (F.lit(kind * 10**12) + number).cast("long").alias("question_id"), F.lit(strategy).alias("question"), F.lit(strategy).alias("strategy"),
        *[fields.get(f, F.lit(None).cast("array<string>" if f == "keywords" else "string")).alias(f) for f in classify.FIELDS if f != "strategy"],
    )
    domains = functions.where("domain IS NOT NULL").groupBy("domain").agg(F.min("id").alias("id"))
    lists = functions.sparkSession.createDataFrame([(i, x) for i, x in enumerate(["routes", "constants", "functions", "anything"])], "i long, what string")
    parts = [
        row(top, 1, F.col("id"), "impact", function_name=F.col("name")), row(domains, 2, F.col("id"), "domain", domain=F.col("domain")),
        row(files.where("id % 50 = 0"), 3, F.col("id"), "file", file_path=F.when(F.col("id") % 100 == 0, F.col("path")).otherwise(F.substring("path", 3, 10_000))),
        row(routes.where("id % 50 = 0").dropDuplicates(["id"]), 4, F.col("id"), "route", route_path=F.when(F.col("path") != "", F.col("path")), route_method=F.when(F.col("id") % 100 == 0, F.col("method"))),
        row(eval_items.where("item_id % 50 = 0"), 5, F.col("item_id"), "pattern", keywords=classify.fallback_keywords(F.col("question"))), row(lists, 6, F.col("i"), "list", list_entity=F.col("what")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in ("functions", "files", "relationships", "routes", "constants")]


def ask_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3, G4, G12, R16 for many questions about functions."""
    functions, *rest = _tables(spark, sf_dir)
    return retrieved(questions_of(functions), functions, *rest)


def ask_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contexts of those questions."""
    functions, *rest = _tables(spark, sf_dir)
    questions = questions_of(functions)
    return contexts(written(retrieved(questions, functions, *rest), "ask-entries"), questions, functions, *rest)


def _others(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    functions, files, relationships, routes, constants = read = _tables(spark, sf_dir)
    asked = written(classified_of(functions, files, relationships, routes, table(spark, sf_dir, "eval_items")), "ask-classified")
    return asked, written(retrieved(asked, *read), "ask-entries"), read


def ask_other_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact, domain, file, route, pattern and list questions."""
    return _others(spark, sf_dir)[1]


def ask_other_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contexts of those questions."""
    asked, entries, read = _others(spark, sf_dir)
    return contexts(entries, asked, *read)


def question_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the answers stored under one question key the last is kept."""
    items = table(spark, sf_dir, "eval_items").select("item_id", "answer", text.question_key(F.col("question"), F.lit("stub")).alias("key"))
    return tables.one_per_key(items, ["key"], [F.desc("item_id")])


QUERIES = {f.__name__: f for f in (ask_entries, ask_contexts, ask_other_entries, ask_other_contexts, function_cards, token_savings, route_prompts, question_cache)}

_FN = """fn AS (SELECT f.*, coalesce(p.path, 'unknown') || ':' || f.start_line AS location FROM
 (SELECT * FROM functions QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) = 1) f LEFT JOIN files p ON p.id = f.file_id),
ed AS (SELECT min(id) AS id, caller_function_id, callee_function_id, callee_name FROM relationships WHERE caller_function_id IS NOT NULL AND lower(trim(relation_type)) = 'calls' GROUP BY 2, 3, 4),
ro AS (SELECT r.*, concat_ws(' ', r.method, r.path) AS name, coalesce(p.path, 'unknown') || ':' || r.start_line AS location FROM (SELECT * FROM routes QUALIFY row_number() OVER (PARTITION BY id ORDER BY id) = 1) r LEFT JOIN files p ON p.id = r.file_id),
co AS (SELECT c.*, coalesce(p.path, 'unknown') || ':' || c.start_line AS location FROM (SELECT * FROM constants QUALIFY row_number() OVER (PARTITION BY id ORDER BY id) = 1) c LEFT JOIN files p ON p.id = c.file_id),
fi AS (SELECT name, min(id) AS id FROM functions WHERE name IS NOT NULL GROUP BY name)"""
_WORDS = r"' ' || array_to_string(list_filter(regexp_split_to_array(strip_accents(lower(coalesce({}, ''))), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> ''), ' ') || ' '"
_FOUND = f"""wo AS (SELECT question_id, strategy, term_at, term, {_WORDS.format("translate(term, '" + chr(34) + "*:()-^', '')")} AS phrase FROM te WHERE upper(translate(term, '"*:()-^', '')) NOT IN ('', 'AND', 'OR', 'NOT', 'NEAR')),
fx AS (SELECT id, 'function' AS kind, {_WORDS.format('name')} || '|' || {_WORDS.format('purpose')} || '|' || {_WORDS.format('behavior_summary')} AS t FROM fn
 UNION ALL SELECT id, 'route', {_WORDS.format('path')} || '|' || {_WORDS.format('handler_body')} || '|' || {_WORDS.format('purpose')} FROM ro),
h AS (SELECT DISTINCT question_id, strategy, kind, id FROM wo JOIN fx ON trim(phrase) <> '' AND contains(t, phrase)),
hr AS (SELECT *, row_number() OVER (PARTITION BY question_id, kind ORDER BY id) AS o FROM h),
lt AS (SELECT question_id, strategy, term_at, trim(replace(term, '"', '')) AS term FROM te),
lc AS (SELECT question_id, strategy, term_at, co.id, row_number() OVER (PARTITION BY question_id, term_at ORDER BY co.id) AS n FROM lt JOIN co ON term <> '' AND co.name ILIKE '%' || term || '%'),
lr AS (SELECT question_id, strategy, id, row_number() OVER (PARTITION BY question_id ORDER BY min(term_at), id) AS o FROM lc WHERE n <= 5 GROUP BY 1, 2, 3),
found AS (SELECT question_id, strategy, kind, o, id AS entity_id, NULL AS open FROM hr WHERE o <= CASE WHEN strategy = 'semantic' THEN CASE kind WHEN 'function' THEN 10 ELSE 5 END ELSE CASE kind WHEN 'function' THEN 15 ELSE 10 END END
 UNION ALL SELECT question_id, strategy, 'constant', o, id, NULL FROM lr WHERE o <= 5)"""
_NUMBERED = """nu AS (SELECT question_id, strategy, r.kind, row_number() OVER (PARTITION BY question_id, r.kind ORDER BY o, entity_id)::INTEGER AS entry_at, entity_id, coalesce(n.name, open) AS name, CASE WHEN entity_id IS NULL THEN 'unresolved' ELSE n.location END AS location
 FROM r LEFT JOIN (SELECT 'function' AS kind, id, name, location FROM fn UNION ALL SELECT 'route', id, name, location FROM ro UNION ALL SELECT 'constant', id, name, location FROM co) n ON n.kind = r.kind AND n.id = entity_id)"""
_ASKED = f"""WITH {_FN}, q AS (SELECT id AS question_id, name, (id // 50) % 4 AS k FROM fi WHERE id % 50 = 0),
te AS (SELECT question_id, 'semantic' AS strategy, unnest(range(0, 3)) AS term_at, unnest(['tell', 'about', CASE WHEN length(name) > 3 THEN name ELSE '' END]) AS term FROM q WHERE k = 3),
{_FOUND},
r AS (SELECT question_id, 'direct' AS strategy, 'function' AS kind, 0 AS o, question_id AS entity_id, NULL AS open FROM q WHERE k = 2
 UNION ALL SELECT DISTINCT question_id, 'relationship', 'function', caller_function_id, caller_function_id, NULL FROM q JOIN ed ON ed.callee_function_id = question_id OR ed.callee_name = q.name JOIN fn ON fn.id = caller_function_id WHERE k = 0
 UNION ALL SELECT DISTINCT question_id, 'relationship', 'function', callee_function_id, callee_function_id, NULL FROM q JOIN ed ON caller_function_id = question_id JOIN fn ON fn.id = callee_function_id WHERE k = 1
 UNION ALL SELECT question_id, 'relationship', 'function', (1::BIGINT << 62) + ed.id, NULL, callee_name FROM q JOIN ed ON caller_function_id = question_id WHERE k = 1 AND callee_function_id IS NULL
 UNION ALL SELECT * FROM found), {_NUMBERED}"""
_OTHERS = f"""WITH RECURSIVE {_FN}, top AS (SELECT callee_function_id AS id, count(*) AS n FROM ed WHERE callee_function_id IN (SELECT id FROM fn) GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5),
se AS (SELECT 1000000000000 + top.id AS question_id, fi.id, fi.name FROM top JOIN fn ON fn.id = top.id JOIN fi ON fi.name = fn.name),
near AS (SELECT question_id, caller_function_id AS id, min(CASE WHEN callee_function_id = se.id THEN ed.id ELSE (1::BIGINT << 60) + ed.id END) AS o FROM ed JOIN se ON callee_function_id = se.id OR callee_name = se.name GROUP BY 1, 2),
up AS (SELECT question_id, id FROM near UNION SELECT question_id, caller_function_id FROM ed JOIN up ON callee_function_id = up.id),
fq AS (SELECT 3000000000000 + id AS question_id, CASE WHEN id % 100 = 0 THEN path ELSE substring(path, 3) END AS fp FROM files WHERE id % 50 = 0),
ex AS (SELECT question_id, min(f.id) AS file_id FROM fq JOIN files f ON f.path = regexp_replace(replace(fp, '\\', '/'), '^\\./+', '') GROUP BY 1),
of AS (SELECT * FROM ex UNION ALL SELECT question_id, min(f.id) FROM fq JOIN files f ON contains(f.path, fp) WHERE question_id NOT IN (SELECT question_id FROM ex) GROUP BY 1),
rq AS (SELECT 4000000000000 + id AS question_id, CASE WHEN path <> '' THEN path END AS p, CASE WHEN id % 100 = 0 THEN method END AS m FROM ro WHERE id % 50 = 0),
te AS (SELECT 5000000000000 + item_id AS question_id, 'pattern' AS strategy, unnest(range(0, len(w))) AS term_at, unnest(w) AS term FROM (SELECT item_id, list_filter(regexp_split_to_array(question, '\\s+'), lambda x: length(x) > 3) AS w FROM eval_items WHERE item_id % 50 = 0)),
{_FOUND},
li AS (SELECT 6000000000000 + unnest(range(0, 4)) AS question_id, unnest(['routes', 'constants', 'functions', 'anything']) AS what), f50 AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM fn QUALIFY n <= 50),
r AS (SELECT question_id, 'impact' AS strategy, 'function' AS kind, coalesce(o, (1::BIGINT << 62) + up.id) AS o, up.id AS entity_id, NULL AS open FROM up JOIN fn USING (id) LEFT JOIN near USING (question_id, id)
 UNION ALL SELECT 2000000000000 + d.n, 'domain', 'function', fn.id, fn.id, NULL FROM (SELECT domain, min(id) AS n FROM functions WHERE domain IS NOT NULL GROUP BY 1) d JOIN fn USING (domain)
 UNION ALL SELECT question_id, 'file', 'function', fn.id, fn.id, NULL FROM of JOIN fn USING (file_id) UNION ALL SELECT question_id, 'file', 'route', ro.id, ro.id, NULL FROM of JOIN ro USING (file_id) UNION ALL SELECT question_id, 'file', 'constant', co.id, co.id, NULL FROM of JOIN co USING (file_id)
 UNION ALL SELECT question_id, 'route', 'route', ro.id, ro.id, NULL FROM rq JOIN ro ON (p IS NULL OR path ILIKE '%' || p || '%') AND (p IS NULL OR m IS NULL OR method = upper(m))
 UNION ALL SELECT question_id, 'list', 'route', ro.id, ro.id, NULL FROM li, ro WHERE what IN ('routes', 'anything') UNION ALL SELECT question_id, 'list', 'constant', co.id, co.id, NULL FROM li, co WHERE what = 'constants'
 UNION ALL SELECT question_id, 'list', 'function', id, id, NULL FROM li, f50 WHERE what = 'functions' OR (what = 'anything' AND n <= 10) UNION ALL SELECT * FROM found), {_NUMBERED}"""
_CARDS = """ef AS (SELECT fn.*, CASE WHEN CASE WHEN json_valid(side_effects_json) THEN json_type(side_effects_json) END = 'ARRAY' THEN array_to_string(from_json(side_effects_json, '["VARCHAR"]'), ', ') ELSE '' END AS effects FROM fn),
ca AS (SELECT caller_function_id AS id, string_agg(coalesce(callee_name, ''), ', ' ORDER BY ed.id) AS calls FROM ed GROUP BY 1),
cb AS (SELECT id, string_agg(coalesce(name, 'unknown'), ', ' ORDER BY o) AS called_by FROM (SELECT e.id, c.name, e.o FROM (SELECT fn.id, caller_function_id, min(CASE WHEN callee_function_id = fn.id THEN ed.id ELSE (1::BIGINT << 60) + ed.id END) AS o
 FROM ed JOIN fn ON callee_function_id = fn.id OR callee_name = fn.name GROUP BY 1, 2) e LEFT JOIN fn c ON c.id = e.caller_function_id) GROUP BY id)"""
_FIT = r"CASE WHEN ceil(length({0}) / 4) <= 3000 THEN {0} ELSE regexp_replace(substring({0}, 1, 12000), '\n[^\n]*$', '') || chr(10) || chr(10) || '[Context truncated to fit ~3000 tokens.]' END"

_LINE = "CASE WHEN strategy IN ({0}) AND coalesce({1}, '') <> '' THEN ind || '{2}' || {1} END"
_LINES = ", ".join(_LINE.format(", ".join(repr(x) for x in some), {"behavior": "behavior_summary"}.get(c, c), label) for label, (c, some) in LINES.items())
_ASKED_CONTEXTS = f"""{_ASKED}, {_CARDS},
ft AS (SELECT question_id, strategy, 0 AS section, entry_at, concat_ws(chr(10), CASE WHEN strategy = 'direct' THEN 'Function: ' ELSE entry_at || '. ' END || nu.name, ind || 'Location: ' || nu.location, ind || 'Signature: ' || coalesce(signature, nu.name), {_LINES}) AS t
 FROM (SELECT *, CASE WHEN strategy = 'direct' THEN '' ELSE '   ' END AS ind FROM nu WHERE kind = 'function') nu LEFT JOIN ef ON ef.id = entity_id LEFT JOIN ca ON ca.id = entity_id LEFT JOIN cb ON cb.id = entity_id
 UNION ALL SELECT question_id, strategy, 1, entry_at, concat_ws(chr(10), entry_at || '. ' || ro.method || ' ' || ro.path, '   Location: ' || ro.location, CASE WHEN handler_name <> '' THEN '   Handler: ' || handler_name END,
 CASE WHEN guards <> '' THEN '   Middleware: ' || guards END, CASE WHEN purpose <> '' THEN '   Purpose: ' || purpose END, '   Handler body: ' || CASE WHEN length(handler_body) > 300 THEN substring(handler_body, 1, 300) || '...' ELSE coalesce(handler_body, '') END)
 FROM nu JOIN (SELECT *, CASE WHEN CASE WHEN json_valid(middleware) THEN json_type(middleware) END = 'ARRAY' THEN array_to_string(from_json(middleware, '["VARCHAR"]'), ', ') ELSE '' END AS guards FROM ro) ro ON kind = 'route' AND ro.id = entity_id),
bo AS (SELECT question_id, string_agg(t, chr(10) || chr(10) ORDER BY section, entry_at) AS b FROM ft GROUP BY 1),
fb AS (SELECT question_id, {_FIT.format('b')} AS b FROM bo), ct AS (SELECT question_id, strategy, count(*) AS n FROM nu GROUP BY 1, 2),
qu AS (SELECT question_id, CASE k WHEN 0 THEN 'what calls ' || name WHEN 1 THEN 'what does ' || name || ' call?' WHEN 2 THEN 'explain ' || name ELSE 'tell me about ' || name END AS question FROM q)
SELECT question_id, CASE WHEN n IS NULL THEN '{NOTHING_FOUND}' || chr(10) || chr(10) || 'Question: ' || question
 ELSE '[Context retrieved via ' || strategy || ' strategy | ' || n || ' entities | ~' || ceil(length(coalesce(b, '')) / 4)::BIGINT || ' tokens]' || chr(10) || chr(10) || coalesce(b, '') END AS context FROM qu LEFT JOIN ct USING (question_id) LEFT JOIN fb USING (question_id)"""
_FUNCTION_CARDS = f"""{_FN}, {_CARDS}, c AS (SELECT id, concat_ws(chr(10), 'Function: ' || name, 'Location: ' || location, 'Signature: ' || signature, CASE WHEN purpose <> '' THEN 'Purpose: ' || purpose END, CASE WHEN behavior_summary <> '' THEN 'Behavior: ' || behavior_summary END,
 CASE WHEN effects <> '' THEN 'Side Effects: ' || effects END, CASE WHEN domain <> '' THEN 'Domain: ' || domain END, CASE WHEN complexity <> '' THEN 'Complexity: ' || complexity END, CASE WHEN calls <> '' THEN 'Calls: ' || calls END, CASE WHEN called_by <> '' THEN 'Called By: ' || called_by END) AS t
 FROM ef LEFT JOIN ca USING (id) LEFT JOIN cb USING (id)), ra AS (SELECT id, {_FIT.format('t')} AS card FROM c)"""

ORACLE = {
    "ask_entries": _ASKED + " SELECT * FROM nu",
    "ask_contexts": _ASKED_CONTEXTS,
    "ask_other_entries": _OTHERS + " SELECT * FROM nu",
    "function_cards": f"WITH {_FUNCTION_CARDS} SELECT id, card FROM ra",
    "token_savings": f"""WITH {_FUNCTION_CARDS}, t AS (SELECT (SELECT sum(ceil(length(body) / 4)) FROM (SELECT DISTINCT id, body FROM functions)) AS a, (SELECT avg(ceil(length(card) / 4)) FROM ra) AS b)
SELECT round(a::DOUBLE, 6) AS traditional_total_tokens, round(b, 6) AS graph_total_tokens, round((a - b) / a * 100, 6) AS total_tokens_reduction FROM t""",
    "route_prompts": "SELECT DISTINCT id, concat_ws(chr(10), concat_ws(' ', method, path), 'Handler: ' || coalesce(handler_name, 'inline'), substring(handler_body, 1, 1000)) AS part FROM routes",
    "question_cache": "SELECT item_id, answer, sha256(lower(trim(question)) || '|stub') AS key FROM eval_items QUALIFY row_number() OVER (PARTITION BY key ORDER BY item_id DESC) = 1",
}

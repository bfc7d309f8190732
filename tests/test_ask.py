from __future__ import annotations

from codeloom.plans import ask

FUNCTIONS = "id long, name string, file_id long, start_line int, purpose string, behavior_summary string, updated_at timestamp, signature string, side_effects_json string, domain string, complexity string"
EDGES = "id long, caller_function_id long, callee_function_id long, callee_name string, relation_type string"
ROUTES = "id long, file_id long, method string, path string, handler_name string, handler_body string, middleware string, start_line int, purpose string"
CONSTANTS = "id long, file_id long, name string, value_text string, type_annotation string, is_exported boolean, start_line int"
QUESTIONS = "question_id long, question string"


def world(spark):
    functions = spark.createDataFrame(
        [
            (1, "login", 1, 3, "Checks passwords", None, None, "login(a)", '["writes a log", "x"]', "authentication", "low"), (2, "check", 1, 9, None, None, None, "check()", None, None, None),
            (3, "render", 9, 1, None, "draws tokens", None, "render()", "broken", "ui", None), (4, "start", 1, 20, None, None, None, "start()", None, "ui", None),
        ],
        FUNCTIONS,
    )
    files = spark.createDataFrame([(1, "src/a.ts"), (2, "src/b.ts")], "id long, path string")
    edges = spark.createDataFrame([(1, 1, 2, "check", "calls"), (2, 3, None, "login", "calls"), (3, 1, None, "fetch", "calls"), (4, 4, 3, "render", "Calls "), (5, 4, 1, "login", "calls")], EDGES)
    routes = spark.createDataFrame([(7, 1, "GET", "/api/users", "list", "b" * 400, '["auth", "log"]', 5, "Lists tokens"), (8, 2, "POST", "/api/users", None, "x", "bad", 6, None)], ROUTES)
    constants = spark.createDataFrame([(5, 1, "TOKENS_MAX", "y" * 300, "number", True, 1), (6, 2, "OTHER", None, None, False, 2)], CONSTANTS)
    return functions, files, edges, routes, constants


def test_each_strategy_finds_its_entries(spark):
    tables = world(spark)
    asked = [
        (1, "what calls login?"), (2, "what does login call?"), (3, "explain check"), (4, "tell me about tokens"), (5, "what calls nothing"), (6, "list all routes"), (7, None), (8, ""), (9, "what breaks if I change check?"),
        (10, "what is in src/b.ts?"), (11, "POST /api/users"), (12, "list all constants"), (13, "what is the User type?"),
    ]
    questions = spark.createDataFrame(asked, QUESTIONS)
    rows = ask.retrieved(questions, *tables).cache()
    got = {}
    for r in sorted(rows.collect(), key=lambda r: (r.kind, r.entry_at)):
        got.setdefault((r.question_id, r.strategy), []).append((r.kind[0], r.entry_at, r.name, r.location))
    assert got == {
        (1, "relationship"): [("f", 1, "render", "unknown:1"), ("f", 2, "start", "src/a.ts:20")],
        (2, "relationship"): [("f", 1, "check", "src/a.ts:9"), ("f", 2, "fetch", "unresolved")],
        (3, "direct"): [("f", 1, "check", "src/a.ts:9")],
        (4, "semantic"): [("c", 1, "TOKENS_MAX", "src/a.ts:1"), ("f", 1, "render", "unknown:1"), ("r", 1, "GET /api/users", "src/a.ts:5")],
        (6, "list"): [("r", 1, "GET /api/users", "src/a.ts:5"), ("r", 2, "POST /api/users", "src/b.ts:6")],
        (9, "impact"): [("f", 1, "login", "src/a.ts:3"), ("f", 2, "start", "src/a.ts:20")],
        (10, "file"): [("c", 1, "OTHER", "src/b.ts:2"), ("r", 1, "POST /api/users", "src/b.ts:6")],
        (11, "route"): [("r", 1, "POST /api/users", "src/b.ts:6")],
        (12, "list"): [("c", 1, "TOKENS_MAX", "src/a.ts:1"), ("c", 2, "OTHER", "src/b.ts:2")],
    }
    text = {r.question_id: r.context for r in ask.contexts(rows, questions, *tables).collect()}
    card = "Function: check\nLocation: src/a.ts:9\nSignature: check()\nCalled By: login"
    assert text[3] == f"[Context retrieved via direct strategy | 1 entities | ~{-(-len(card) // 4)} tokens]\n\n{card}"
    assert text[2].split("\n\n", 1)[1] == "1. check\n   Location: src/a.ts:9\n   Signature: check()\n   Called By: login\n\n2. fetch\n   Location: unresolved\n   Signature: fetch"
    assert text[9].split("\n\n", 1)[1].startswith("Functions affected (2 total):\n\n1. login\n   Location: src/a.ts:3\n   Signature: login(a)\n   Purpose: Checks passwords\n   Calls: check, fetch\n\n2. start")
    assert "| 3 entities |" in text[4] and "TOKENS_MAX" not in text[4] and "1. render" in text[4] and "1. GET /api/users\n   Location: src/a.ts:5\n   Handler: list\n   Middleware: auth, log\n   Purpose: Lists tokens\n   Handler body: " + "b" * 300 + "..." in text[4]
    assert text[12].split("\n\n", 1)[1] == "Constants:\n1. TOKENS_MAX (exported)\n   Location: src/a.ts:1\n   Type: number\n   Value: " + "y" * 200 + "...\n\n2. OTHER\n   Location: src/b.ts:2"
    assert text[10].split("\n\n", 1)[1].startswith("Routes:\n1. POST /api/users") and "\n\nConstants:\n1. OTHER" in text[10]
    assert text[5].startswith("No results found") and text[5].endswith("Question: what calls nothing") and text[13].startswith("No results found")
    assert rows.count() == sum(map(len, got.values())) and len(text) == len(asked)


def test_domain_and_pattern_come_classified(spark):
    functions, *rest = world(spark)
    fields = "question_id long, question string, strategy string, function_name string, keywords array<string>, domain string, direction string, type_name string, file_path string, route_path string, route_method string, list_entity string"
    rows = [(1, "q", "domain", None, [], "ui", *[None] * 6), (2, "q", "pattern", None, ["draws tokens", "max"], None, *[None] * 6), (3, "q", "list", None, [], None, *[None] * 5, "anything"), (4, "q", "pattern", None, ["AND", ""], None, *[None] * 6)]
    got = {}
    for r in ask.retrieved(spark.createDataFrame(rows, fields), functions, *rest).collect():
        got.setdefault(r.question_id, set()).add((r.kind, r.entity_id))
    assert got == {1: {("function", 3), ("function", 4)}, 2: {("function", 3), ("route", 7), ("constant", 5)}, 3: {("function", i) for i in (1, 2, 3, 4)} | {("route", 7), ("route", 8)}}


def test_all_callers_are_entries_and_are_counted(spark):
    functions = spark.createDataFrame([(i, "hot" if i == 1 else f"f{i}", 1, i, None, None, None, f"f{i}()", None, None, None) for i in range(1, 1252)], FUNCTIONS)
    files = spark.createDataFrame([(1, "src/a.ts")], "id long, path string")
    edges = spark.createDataFrame([(i, i, 1, "hot", "calls") for i in range(2, 1252)], EDGES)
    questions = spark.createDataFrame([(1, "what calls hot?")], QUESTIONS)
    rows = ask.retrieved(questions, functions, files, edges).cache()
    assert sorted(r.entry_at for r in rows.collect()) == list(range(1, 1251))
    context = ask.contexts(rows, questions, functions, files, edges).first().context
    assert context.startswith("[Context retrieved via relationship strategy | 1250 entities | ~") and 11_000 < len(context) < 12_200 and context.endswith("[Context truncated to fit ~3000 tokens.]")


def test_empty_tables(spark):
    functions, files, edges, routes, constants = (df.limit(0) for df in world(spark))
    questions = spark.createDataFrame([(1, "what calls x?"), (2, "list all routes"), (3, "tell me about x1234")], QUESTIONS)
    rows = ask.retrieved(questions, functions, files, edges, routes, constants)
    assert rows.count() == 0 and ask.contexts(rows, questions, functions, files, edges, routes, constants).count() == 3

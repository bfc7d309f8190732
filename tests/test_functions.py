from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from codeloom.functions import classify, text, validate
from codeloom.operators import changes


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("column", "expected"),
    [
        (lambda: text.repo_path(F.lit(".\\src\\index.ts")), "src/index.ts"),
        (lambda: text.repo_path(F.lit(".//src/./a.ts")), "src/./a.ts"),
        (lambda: text.location(text.repo_path(F.lit("src\\query\\r.ts")), F.lit(12)), "src/query/r.ts:12"),
        (lambda: text.location(F.lit(None).cast("string"), F.lit(3)), "unknown:3"),
        (lambda: text.base_name(F.lit("a\\b/c.ts")), "c.ts"),
        (lambda: text.pad_end(F.lit("GET"), 7), "GET    "),
        (lambda: text.pad_end(F.lit("OPTIONSX"), 7), "OPTIONSX"),
        (lambda: text.ellipsis(F.lit("abcdef"), 3), "abc..."),
        (lambda: text.one_line(F.lit(" a\n  b ")), "a b"),
        (lambda: text.estimated_tokens(F.lit("")), 0),
        (lambda: text.estimated_tokens(F.lit("abcd")), 1),
        (lambda: text.estimated_tokens(F.lit("abcde")), 2),
        (lambda: text.utf16_length(F.lit("a😀")), 3),
        (lambda: text.search_query(F.array(F.lit("login AND user*"), F.lit("sign-in"), F.lit(""))), '"login" OR "user" OR "signin"'),
        (lambda: text.search_tokens(F.lit("auth.login_User Été sign-in")), ["auth", "login", "user", "ete", "sign", "in"]),
        (lambda: text.has_phrase(text.search_tokens(F.lit("a b c")), F.array(F.lit("b"), F.lit("c"))), True),
        (lambda: text.has_phrase(text.search_tokens(F.lit("a b c")), F.array(F.lit("a"), F.lit("c"))), False),
        (lambda: text.has_phrase(text.search_tokens(F.lit("ab")), F.array().cast("array<string>")), False),
        (lambda: text.contains_like(F.lit("MaxRetries"), F.lit("X_ET")), True),
        (lambda: text.contains_like(F.lit("a\\b"), F.lit("\\")), True),
        (lambda: text.contains_like(F.lit("É"), F.lit("é")), False),
        (lambda: text.string_array(F.lit("[broken")), []),
        (lambda: text.string_array(F.lit('["a","b"]')), ["a", "b"]),
        (lambda: changes.diff_ratio(F.lit("a\nb\nc"), F.lit("a\nb\nd")), 2 / 3),
        (lambda: changes.priority(F.lit("signature_changed"), F.lit(True)), 15),
        (lambda: changes.priority(F.lit("body_changed"), F.lit(False)), 7),
        (lambda: changes.priority(F.lit("other"), F.lit(True)), 6),
        (lambda: validate.valid_domain(F.lit(" Database ")), "database"),
        (lambda: validate.valid_domain(F.lit("weird")), "other"),
        (lambda: validate.valid_complexity(F.lit("HIGH")), "high"),
        (lambda: validate.valid_complexity(F.lit("x")), "medium"),
        (lambda: validate.side_effects(F.lit("writes store")), ["writes store"]),
        (lambda: validate.side_effects(F.lit("{}")), []),
    ],
)
def test_scalars(spark, column, expected):
    assert one(spark, column()) == expected


@pytest.mark.parametrize(
    ("question", "expected"),
    [
        ("what calls validatePassword?", {"strategy": "relationship", "direction": "callers", "function_name": "validatePassword"}),
        ("which functions call login", {"strategy": "relationship", "direction": "callers", "function_name": "login"}),
        ("what functions call login", None),
        ("what does searchTasks call?", {"strategy": "relationship", "direction": "callees", "function_name": "searchTasks"}),
        ("what does login do, and what does it call?", {"strategy": "relationship", "direction": "callees", "function_name": "it"}),
        ("what does verifyPassword do?", {"strategy": "direct", "function_name": "verifyPassword"}),
        ("dependencies of login", {"strategy": "relationship", "direction": "callees", "function_name": "login"}),
        ("what breaks if I change validateEmail?", {"strategy": "impact", "function_name": "validateEmail"}),
        ("What calls the validatePassword function?", {"strategy": "relationship", "direction": "callers", "function_name": "the"}),
        ("What does the login function call?", None),
        ("what's in src\\index.ts?", {"strategy": "file", "file_path": "src\\index.ts"}),
        ("GET /users", {"strategy": "route", "route_method": "GET", "route_path": "/users"}),
        ("What does the /api/users endpoint do?", {"strategy": "route", "route_path": "/api/users"}),
        ("what is the User type?", {"strategy": "type", "type_name": "User"}),
        ("list all routes", {"strategy": "list", "list_entity": "routes"}),
        ("what types and interfaces exist?", {"strategy": "list", "list_entity": "types"}),
    ],
)
def test_classified(spark, question, expected):
    row = one(spark, classify.classified(F.lit(question)))
    assert (row and {k: v for k, v in row.asDict().items() if v}) == expected


def test_fallback_keywords(spark):
    assert one(spark, classify.fallback_keywords(F.lit("how are the tokens kept"))) == ["tokens", "kept"]


def item(**changes):
    base = {"function_name": " a\t", "purpose": "p\n  q", "side_effects": ["x  y", 3], "behavior": "", "domain": " UI", "complexity": "HIGH"} | changes
    return {k: v for k, v in base.items() if v != "gone"}


def test_validated_items(spark):
    replies = [
        (1, "Sure:\n```json\n" + json.dumps([item(), item(side_effects="one", domain="cats", complexity=""), item(side_effects=""), item(behavior="gone", domain="gone"), item(function_name="  ")]) + "\n```"),
        (2, json.dumps([item(purpose=5), item(side_effects=None), item(behavior=None), item(domain=None), 7])),
        (3, "no json"), (4, "[]"), (5, "{}"), (6, None), (7, "```\n[]\n```"), (8, json.dumps([item()])),
    ]
    rows = validate.validated_items(spark.createDataFrame(replies, "id long, reply string"), "id", "reply").collect()
    by = {(r.id, r.pos): r for r in rows}
    assert len(by) == len(rows)
    good = by[8, 0]
    assert (good.name, good.purpose, good.side_effects, good.behavior, good.domain, good.complexity, good.error) == ("a", "p q", ["x y", "3"], "", "ui", "high", None)
    errors = {k: r.error for k, r in by.items() if r.error}
    assert errors == {
        (1, -1): "JSON parse error", (2, 0): "purpose must be a string", (2, 1): "side_effects must be an array", (2, 2): "behavior must be a string",
        (2, 4): "missing fields: function_name, purpose, side_effects, behavior, domain, complexity", (3, -1): "JSON parse error", (5, -1): "Response is not a JSON array",
        (6, -1): "JSON parse error", (7, -1): "JSON parse error",
    }
    assert by[2, 3].domain == "other"
    fenced = validate.validated_items(spark.createDataFrame([(1, replies[0][1][6:])], "id long, reply string"), "id", "reply").orderBy("pos").collect()
    assert [r.error for r in fenced] == [None, None, None, "missing fields: behavior, domain", "function_name must be a non-empty string"]
    assert fenced[1].side_effects == ["one"] and fenced[1].domain == "other" and fenced[1].complexity == "medium" and fenced[2].side_effects == []

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.plans import activity


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_called_names_follow_calls_not_keywords(spark):
    body = "if (ok(x)) { this.run(a.b.c(1)); } new Foo().bar(2); for (;;) { a.b.c(3) } obj['m'](4)"
    assert one(spark, activity.called_names(F.lit(body)))[:4] == ["ok", "run", "a.b.c", "Foo"]


def test_context_fits_its_budget(spark):
    route = "1. GET /x\n   Location: a:1\n   Handler body: " + "b" * 8000 + "\n\n1. type T\n   Location: b:2\n   Definition:\n" + "d\n" * 300 + "\n\n2. type U\n   Location: c:3"
    out = one(spark, activity.fitted(F.lit(route), 200))
    assert "Handler body:" not in out and "Definition:" not in out and "Context truncated" in out and "2. type U" in out
    assert one(spark, activity.fitted(F.lit("short"), 200)) == "short"
    long = "line of text\n" * 1000
    cut = one(spark, activity.fitted(F.lit(long), 200))
    assert cut.startswith("line of text\nline") and cut.endswith("[Context truncated to fit ~200 tokens.]") and len(cut) < 900


def test_first_line_only_of_a_long_handler(spark):
    text = "x\n   Handler body: a\nb\n" + "c" * 4000
    assert "\nb\n" in one(spark, activity.fitted(F.lit(text), 100)) + "\nb\n"

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from codeloom.llm.mixing import mix_inputs, mix_report, mixed_documents, raked_weights


def corpus(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, package string, tokens string")


def mixed(spark, rows, targets):
    counted, goals = mix_inputs(corpus(spark, rows), spark.createDataFrame(targets, "source string, target_share double, max_repeats int"))
    drawn = mixed_documents(counted, raked_weights(counted, goals))
    return counted, drawn, {r.source: r for r in mix_report(drawn, counted, goals).collect()}


def test_shares_are_reached_where_they_can_be(spark):
    rows = [(i, "alpha beta gamma " * (1 + i % 7), ["en", "EN ", None, "de"][i % 4], ["Web", "web ", "guide", "forum"][i % 4], f"p{i % 5}", "x") for i in range(4000)]
    rows += [(9000 + i, "tiny text here", "en", "small", None, "x") for i in range(10)]
    rows += [(9100, None, "en", "web", None, "x"), (9101, "", "en", "guide", None, "x"), (9102, "a b", "en", None, None, "x"), (None, "a", "en", "web", None, "x"), rows[0]]
    targets = [("web", 0.3, 1), ("guide", 0.35, 3), ("forum", 0.25, 2), ("small", 0.05, 4), ("absent", 0.05, 9)]
    counted, drawn, report = mixed(spark, rows, targets)
    total = sum(r.tokens for r in report.values())
    assert report["absent"].tokens == 0
    assert report["small"].tokens == 4 * report["small"].available_tokens
    for name in ("web", "guide", "forum"):
        assert report[name].tokens == pytest.approx(dict((t[0], t[1]) for t in targets)[name] * counted.agg({"tokens": "sum"}).first()[0], rel=0.02)
    assert sum(r.reached_share for r in report.values()) == pytest.approx(1) and total > 0
    caps = {t[0]: t[2] for t in targets}
    assert all(0 < r.copies <= caps[r.source] for r in drawn.collect())
    assert drawn.select("doc_id").distinct().count() == drawn.count()


def test_draws_are_repeatable(spark):
    rows = [(i, "some words " * (i % 5 + 1), "en", "web" if i % 3 else "guide", "p", "x") for i in range(300)]
    targets = [("web", 0.5, 1), ("guide", 0.5, 2)]
    a, b = (sorted((r.doc_id, r.copies) for r in mixed(spark, rows, targets)[1].collect()) for _ in range(2))
    assert a == b


def test_empty_tables(spark):
    _, drawn, report = mixed(spark, [], [("web", 1.0, 2)])
    assert drawn.count() == 0 and report["web"].tokens == 0
    _, drawn, report = mixed(spark, [(1, "a b", "en", "web", "p", "x")], [])
    assert drawn.count() == 0 and report == {}


def test_shares_are_of_all_tokens_and_meet_every_goal(spark):
    rng = random.Random(3)
    rows = [(i, "alpha beta gamma " * rng.choice([1, 2, 3, 40]), rng.choice(["en", "de", "fr"]), rng.choice(["web", "web", "web", "guide", "forum", None, "other"]), f"p{rng.randrange(40)}", "x") for i in range(6000)]
    goals = [("web", 0.2, 1), ("guide", 0.4, 3), ("forum", 0.2, 2), ("absent", 0.2, 2)]
    counted, targets = mix_inputs(corpus(spark, rows), spark.createDataFrame(goals, "source string, target_share double, max_repeats int"))
    weights = raked_weights(counted, targets).cache()
    total = counted.agg({"tokens": "sum"}).first()[0]
    have = {r.source: r.tokens for r in counted.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    cells = weights.collect()
    assert all(0 <= r.weight <= r.cap for r in cells)
    report = {r.source: r for r in mix_report(mixed_documents(counted, weights), counted, targets, weights).collect()}
    for source, share, cap in goals[:3]:
        goal = min(share * total, cap * have[source])
        assert sum(r.weight * r.tokens for r in cells if r.source == source) == pytest.approx(goal)
        assert report[source].tokens == pytest.approx(goal, rel=0.002) and report[source].goal_share == pytest.approx(goal / total)
        assert report[source].total_share == pytest.approx(report[source].tokens / total)
    assert report["absent"].tokens == 0 and report["absent"].goal_share == 0
    reached = sum(r.weight * r.tokens for r in cells)
    for lang in ("en", "de", "fr"):
        own = sum(r.tokens for r in cells if r.lang == lang) / sum(r.tokens for r in cells)
        assert sum(r.weight * r.tokens for r in cells if r.lang == lang) / reached == pytest.approx(own, rel=0.02)


def test_many_parts_draw_the_same_tokens(spark):
    rows = [(i, "word " * (1 + i % 30), "en", "web", f"p{i % 3}", "x") for i in range(5000)]
    counted, targets = mix_inputs(corpus(spark, rows), spark.createDataFrame([("web", 0.37, 1)], "source string, target_share double, max_repeats int"))
    weights = raked_weights(counted, targets)
    total = counted.agg({"tokens": "sum"}).first()[0]
    for per_bucket in (20_000, 300):
        got = mixed_documents(counted, weights, per_bucket=per_bucket).agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0]
        assert got == pytest.approx(0.37 * total, rel=0.003)

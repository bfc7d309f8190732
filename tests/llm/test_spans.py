from __future__ import annotations

import random

import pytest

from codeloom.llm import spans as module
from codeloom.llm.spans import shared_amount, shared_spans


def brute(rows, n):
    owners: dict[str, set] = {}
    for rec, text in rows:
        for p in range(len(text or "") - n + 1):
            owners.setdefault(text[p : p + n], set()).add(rec)
    out = set()
    for rec, text in dict(rows).items():
        if not text:
            continue
        covered = [False] * (len(text) + 1)
        for p in range(len(text) - n + 1):
            if len(owners[text[p : p + n]]) > 1:
                covered[p : p + n] = [True] * n
        start = None
        for i, c in enumerate(covered):
            if c and start is None:
                start = i
            elif not c and start is not None:
                out.add((rec, start, i - start))
                start = None
    return out


def make(rng):
    alphabet = "abcdeé😀 \n(){};"
    blocks = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(10, 90))) for _ in range(12)]
    return [(i, "".join(rng.choice(blocks) for _ in range(rng.randrange(1, 9)))) for i in range(60)]


@pytest.mark.parametrize("key_contents", [256, 1])
def test_equals_brute_force(spark, monkeypatch, key_contents):
    monkeypatch.setattr(module, "KEY_CONTENTS", key_contents)
    rows = make(random.Random(3))
    df = spark.createDataFrame([*rows, rows[5], (500, None), (501, ""), (None, rows[1][1])], "rec long, text string")
    found = {tuple(r) for r in shared_spans(df, "rec", "text", 60).collect()}
    assert found == brute(rows, 60)
    amounts = {r.rec: r.shared_chars for r in shared_amount(df, shared_spans(df, "rec", "text", 60), "rec", "text").collect()}
    assert amounts[500] == 0 and amounts[501] == 0 and sum(amounts.values()) == sum(x[2] for x in found)


def test_repeats_within_one_record_do_not_count(spark):
    df = spark.createDataFrame([(1, "x" * 500), (1, "x" * 500), (2, "y" * 130)], "rec long, text string")
    assert shared_spans(df, "rec", "text").count() == 0


def test_runs_of_one_character_and_a_hot_text(spark):
    rows = [(i, "z" * 200 + str(i)) for i in range(50)] + [(100, "z" * 120)]
    df = spark.createDataFrame(rows, "rec long, text string")
    assert {tuple(r) for r in shared_spans(df, "rec", "text").collect()} == brute(rows, 120)


def test_long_text(spark):
    rng = random.Random(1)
    shared = "".join(chr(97 + rng.randrange(26)) for _ in range(1000))
    a = "".join(chr(97 + rng.randrange(26)) for _ in range(2_000_000))
    df = spark.createDataFrame([(1, a + shared), (2, "q" + shared + "?")], "rec long, text string")
    found = {r.rec: (r.span_start, r.span_len) for r in shared_spans(df, "rec", "text").collect()}
    assert found[2] == (1, 1000) and found[1][1] >= 1000


def test_empty_table(spark):
    assert shared_spans(spark.createDataFrame([], "rec long, text string"), "rec", "text").count() == 0

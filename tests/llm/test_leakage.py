from __future__ import annotations

import random
import resource

from codeloom.llm.leakage import Passages, leaked_passages, words

ITEM = "Which of the 14 callers of parseName breaks first when the İstanbul cache is empty, and why does it break"


def run(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, question string, answer string, text string")
    return leaked_passages(d, i, "doc_id", "text", "item_id", ["question", "answer"], **kw)


def test_offsets_point_into_the_original(spark):
    text = "Intro.\n\n" + ITEM.upper().replace(" ", "  _ ") + "! The end"
    rows = run(spark, [(1, text, "x"), (2, ITEM[:60], "x"), (3, None, "x"), (4, "", "x")], [(7, ITEM, None, "clash"), (8, None, None, ""), (9, "too short", "to leak", "")]).collect()
    assert [(r.doc_id, r.item_id) for r in rows] == [(1, 7)]
    assert text[rows[0].char_start : rows[0].char_start + rows[0].char_len].startswith("WHICH")


def test_twelve_words_are_not_enough(spark):
    words = ITEM.replace("İ", "I").split()
    docs = [(1, " ".join(words[:12]), ""), (2, " ".join(words[:13]), ""), (3, " ".join(words[2:8] + ["x"] + words[8:]), "")]
    assert {r.doc_id for r in run(spark, docs, [(7, " ".join(words), "", "")]).collect()} == {2}


def test_an_item_spans_question_and_answer(spark):
    words = [f"w{i}" for i in range(20)]
    items = [(1, " ".join(words[:10]), " ".join(words[10:]), "")]
    assert run(spark, [(1, " ".join(words[4:17]), "")], items).count() == 1


def test_blocks_of_items_give_the_same(spark):
    items = [(i, " ".join(f"w{i}x{j}" for j in range(15)), "", "") for i in range(30)]
    docs = [(i, "so " + items[i][1] + " and " + items[(i * 7) % 30][1], "") for i in range(30)]
    one, many = run(spark, docs, items), run(spark, docs, items, block_words=60)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) and one.count() >= 58


def test_long_text_and_empty_tables(spark):
    text = "word " * 400_000 + ITEM
    assert run(spark, [(1, text, "")], [(7, ITEM, "", "")]).count() == 1
    assert run(spark, [], [(7, ITEM, "", "")]).count() == 0
    assert run(spark, [(1, text, "")], []).count() == 0


def brute(items, text, n):
    w = words(text)
    runs = {tuple(w[i : i + n]): i for i in range(len(w) - n + 1)}
    return {i for i, t in items if any(tuple(words(t)[j : j + n]) in runs for j in range(len(words(t)) - n + 1))}


def test_automaton_equals_brute_force():
    rng = random.Random(1)
    for n in (2, 5, 13):
        items = [(i, " ".join(f"w{rng.randrange(4)}" for _ in range(rng.randrange(0, 40)))) for i in range(30)]
        found = Passages(items, n)
        for _ in range(60):
            text = " ".join(f"w{rng.randrange(5)}" if rng.random() < 0.3 else items[rng.randrange(30)][1][: rng.randrange(1, 90)] for _ in range(8))
            got = found.runs(text)
            assert set(got) == brute(items, text, n)
            assert all(high - low >= n for runs in got.values() for low, high in runs)


def test_fifty_thousand_items_stay_small(spark):
    rng = random.Random(2)
    items = [(i, " ".join(f"w{rng.randrange(200_000)}" for _ in range(60)), " ".join(f"v{rng.randrange(200_000)}" for _ in range(60)), "") for i in range(50_000)]
    docs = [(i, f"intro {i} " + " ".join(items[i * 7][1].split()[10:30]) + " end", "") for i in range(400)] + [(9000 + i, items[i][1][:60], "") for i in range(50)]
    rows = run(spark, docs, items, block_words=2_000_000).select("doc_id", "item_id").collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(i, i * 7) for i in range(400)}
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    Passages([(i, f"{q} {a}") for i, q, a, _ in items[:10_000]], 13)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 800_000  # kilobytes for 1.2 million words

from __future__ import annotations

import itertools
import random
import re

from codeloom.llm import neardup
from codeloom.llm.neardup import forest_depth, function_texts, near_duplicates


neardup_written = neardup.written


def brute(rows, k, threshold, min_words):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[A-Za-z0-9_]+", text)
        if len(w) >= max(min_words, k):
            sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def test_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    rows, i = [], 0
    for _ in range(40):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(20, 90))]
        for _ in range(rng.randrange(1, 5)):
            rows.append((i, " é-".join(edited(base, rng, rng.randrange(0, 5)))))
            i += 1
    rows += [(1000, ""), (1001, "one"), (1002, rows[0][1]), (1003, rows[0][1])]
    df = spark.createDataFrame([*rows, rows[3], (None, "x y z"), (2000, None)], "id long, text string")
    found = near_duplicates(df, "id", "text", k=4, threshold=0.7, min_words=30)
    assert {(r.id_a, r.id_b) for r in found.pairs().collect()} == brute(rows, 4, 0.7, 30)
    members = {r.id: (r.rep, r.n_links) for r in found.memberships().collect()}
    assert members.keys() == {i for i, t in rows if len(re.findall(r"[A-Za-z0-9_]+", t)) >= 30}


def test_many_copies_are_one_class(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.range(300).selectExpr("id", f"'{text}' AS text").unionByName(spark.createDataFrame([(900, text + " more words here")], "id long, text string"))
    found = near_duplicates(df, "id", "text", k=4, threshold=0.7)
    assert found.links.count() == 1
    assert {r.rep for r in found.memberships().collect()} == {0, 900}


def test_long_text_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    df = spark.createDataFrame([(1, long, 5, 5), (2, long + " tail", 6, 6), (3, "a b", 1, 1)], "id long, text string, rep long, h1 long")
    assert [(r.id_a, r.id_b) for r in near_duplicates(df, "id", "text").pairs().collect()] == [(1, 2)]


def test_empty_table(spark):
    found = near_duplicates(spark.createDataFrame([], "id long, text string"), "id", "text")
    assert found.pairs().count() == 0 and found.memberships().count() == 0


def test_depth_shortens_until_recall():
    assert forest_depth(0.7, 0.999, 28, 8) == 4
    assert forest_depth(0.9, 0.999, 28, 8) > 4
    assert forest_depth(0.1, 0.999, 4, 8) == 1


def test_function_texts_take_nulls(spark):
    df = spark.createDataFrame([(1, None, "b"), (2, "s", None)], "id long, signature string, body string")
    assert sorted(r.text for r in function_texts(df).collect()) == [" b", "s "]


def boilerplate(rng, n, head, tail):
    """Texts of which each has most of its words, in different places, from one stock of sentences."""
    stock = [" ".join(f"b{j}x{i}" for i in range(12)) for j in range(head)]
    return [(i, ". ".join([*stock, " ".join(f"w{rng.randrange(10**7)}" for _ in range(tail))])) for i in range(n)]


def test_crowded_nodes_lose_no_pair(spark):
    rng = random.Random(6)
    rows = boilerplate(rng, 300, 8, 60)
    rows += [(1000 + i, " ".join(edited(rows[i][1].split(" "), rng, 3))) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string")
    expected = brute(rows, 4, 0.7, 30)
    assert len(expected) >= 40
    for crowd in (256, 8, 1):
        found = near_duplicates(df, "id", "text", k=4, threshold=0.7, min_words=30, crowd=crowd)
        assert {(r.id_a, r.id_b) for r in found.pairs().collect()} == expected


def test_ten_thousand_texts_at_one_node(spark, monkeypatch):
    rng = random.Random(7)
    rows = boilerplate(rng, 10_000, 9, 60)
    rows += [(20_000 + i, " ".join(edited(rows[i][1].split(" "), rng, 2))) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(8)
    sizes = {}

    def kept(df, label):
        out = neardup_written(df, label)
        return sizes.setdefault(label, out) and out

    monkeypatch.setattr(neardup, "written", kept)
    found = near_duplicates(df, "id", "text", k=4, threshold=0.7, min_words=30)
    assert {(r.rep_a, r.rep_b) for r in found.links.collect()} == {(i, 20_000 + i) for i in range(50)}
    assert sizes["neardup-crowded"].count() > 0 and sizes["neardup-candidates"].count() < 400_000  # of 50 million pairs


def test_memberships_count_links(spark):
    text = [f"w{i}" for i in range(60)]
    rows = [(5, " ".join(text)), (3, "  ".join(text)), (9, " ".join([*text, "more"])), (7, " ".join(f"x{i}" for i in range(60)))]
    found = near_duplicates(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    assert {(r.id, r.rep, r.n_links) for r in found.memberships().collect()} == {(5, 3, 1), (3, 3, 1), (9, 9, 1), (7, 7, 0)}

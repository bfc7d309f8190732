from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from codeloom.llm.spam import page_evidence, page_spam_evidence, spam_pages

KEYS = ["light batch", "lazy section", "cold index"]


def spam_texts(rng):
    k, adj = rng.sample(KEYS, 2), ["free", "cheap", "best", "online", "buy"]
    yield " ".join(f"Our {k[0]} is the {rng.choice(adj)} {k[0]} for every {k[1]}." for _ in range(20))
    yield "\n".join(f'<li><a href="http://h{i}.invalid/p/{i}">{rng.choice(k)}</a></li>' for i in range(30))
    yield "\n".join(f"[{rng.choice(k)}](https://h{i}.example/{i})" for i in range(30))
    yield "\n".join(f"https://h{i}.test/a.html" for i in range(40))
    yield " ".join(f"#{rng.choice(k).replace(' ', '')}{i}" for i in range(40))
    yield ", ".join(f"{rng.choice(k).title()} ({i})" for i in range(50))
    yield "\n".join(f"ABC-{i} Cold index {rng.choice(adj)} {i},99 EUR {rng.choice(adj)}" for i in range(25))
    yield "\n".join(f"Name{i} >> {rng.choice(k)} >> {rng.choice(adj)} w{i}  www.h{i}.example" for i in range(25))


def fine_texts(rng):
    w = lambda: f"w{rng.randrange(5000)}"
    prose = " ".join(f"The {w()} in {w()} reads each {w()} before the {w()} is written." for _ in range(12))
    yield prose
    yield prose + "\n\nSee also\n" + "\n".join(f"- [{w()} {w()}](https://{w()}.example/{i})" for i in range(5))
    yield "Reading list\n" + "\n".join(f"- [{w()} {w()}](https://{w()}.example/{i}): {w()} explains why the {w()} of {w()} is kept short." for i in range(15))
    yield "## 1.2.3\n" + "\n".join(f"- fix {w()} when {w()} is empty and {w()} waits" for _ in range(20))
    yield "| option | default | meaning |\n|---|---|---|\n" + "\n".join(f"| --{w()} | {i} | set the {w()} of {w()} |" for i in range(20))
    yield "\n".join(f"10:21:{i:02d} INFO {w()}/{w()} loaded {w()} size={i}" for i in range(40))
    yield ""
    yield "word"


def test_kinds_of_pages(spark):
    rng = random.Random(2)
    bad = [t for _ in range(5) for t in spam_texts(rng)]
    good = [t for _ in range(5) for t in fine_texts(rng)]
    rows = [(i, t, f"s{i % 3}", None if i % 4 == 0 else f"p{i % 5}", 1) for i, t in enumerate(bad + good)] + [(9000, None, "s", "p", 1), (None, bad[0], "s", "p", 1), (0, bad[0], "s0", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, package string, phrases int")
    evidence = page_spam_evidence(df, "doc_id", "text", ["source", "package"])
    assert sorted(r.doc_id for r in spam_pages(evidence).collect()) == list(range(len(bad)))
    assert evidence.count() == sum(1 for t in bad + good if t)


def test_long_text_and_empty_table(spark):
    text = "\n".join(f"https://h{i}.test/a.html" for i in range(60_000))
    df = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    assert spam_pages(page_spam_evidence(df, "doc_id", "text", ["source"])).count() == 1
    assert page_spam_evidence(df.limit(0), "doc_id", "text", ["source"]).count() == 0


def test_links_and_their_separators_make_a_list():
    n_list, n_items, stuffed, words = page_evidence("Some plain prose here.\nhttps://a.test/x\n- [a](https://b.test/y), <a href='x'>b <i>c</i></a>")
    assert (n_list, n_items, stuffed, len(words)) == (17, 3, 0, 21)


def test_hostile_lines_take_no_time():
    lines = [", ".join(f"https://h{i}.test/a,;:{i}" for i in range(200)) + " and then some words", "<a " * 50_000, "<a>" * 50_000, "[" * 100_000, "[x](" * 50_000, "<" + " " * 100_000, "#a " * 50_000 + "!", "x (1) " * 30_000 + "y", "9" * 100_000, "1. " * 50_000 + "z"]
    for line in lines:
        began = time.perf_counter()
        page_evidence(line)
        assert time.perf_counter() - began < 2
    began = time.perf_counter()
    page_evidence(lines[0])
    assert time.perf_counter() - began < 0.1


def test_replicated_phrases_decide_below_clear_density(spark):
    rng = random.Random(8)
    prose = [" ".join(f"w{rng.randrange(9000)}" for _ in range(60)) + "." for _ in range(40)]
    links = lambda i: "\n".join(f"https://h{i}x{j}.test/a/b.html" for j in range(12))
    rows = [(i, f"{prose[i % 20]}\n{links(i)}", f"s{i}") for i in range(40)] + [(100 + i, f"{prose[20 + i]}\n{links(100 + i)}", f"s{i}") for i in range(20)]
    rows += [(200 + i, f"{prose[i]} And w{i} more words of its own here.", "prose") for i in range(5)]
    evidence = page_spam_evidence(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", ["source"]).cache()
    share = {r.doc_id: r.spam_words / r.n_words for r in evidence.collect()}
    assert all(0.5 < share[i] < 0.7 for i in [*range(40), *range(100, 120)])
    assert sorted(r.doc_id for r in spam_pages(evidence).collect()) == list(range(40))
    assert sorted(r.doc_id for r in spam_pages(evidence.withColumn("copied_share", F.lit(0.0))).collect()) == []


def test_shares_equal_brute_force(spark):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(30) if rng.random() < 0.9 else rng.randrange(10**6)}" for _ in range(rng.randrange(0, 60))) for _ in range(300)] + ["the footer of one host is the same everywhere"] * 300
    rows = [(i, t, f"s{rng.randrange(4)}" if i < 300 else "one") for i, t in enumerate(texts)]
    grams = {i: {tuple(t.split()[j : j + 2]) for j in range(len(t.split()) - 1)} for i, t, _ in rows}
    hosts: dict[tuple, set[str]] = {}
    for i, _, h in rows:
        for g in grams[i]:
            hosts.setdefault(g, set()).add(h)
    expected = {i: sum(len(hosts[g]) > 1 for g in grams[i]) / max(len(grams[i]), 1) for i, t, _ in rows if t}
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.copied_share for r in page_spam_evidence(df.repartition(5), "doc_id", "text", ["source"], k=2).collect()}
    assert got == expected


def test_stitched_pages_are_found_and_mirrors_are_not(spark):
    rng = random.Random(3)
    passages = [" ".join(f"w{rng.randrange(9000)}" for _ in range(60)) for _ in range(8)]
    own = [" ".join(f"w{rng.randrange(9000)}" for _ in range(90)) for _ in range(9)]
    rows = [(i, f"{p} {own[i]}", f"host{i}") for i, p in enumerate(passages)] + [(20, " ".join(passages), "stitched"), (30, own[8], "a"), (31, own[8], "b"), (40, None, "a"), (41, "one word", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    evidence = page_spam_evidence(df.union(df.limit(1)), "doc_id", "text", ["source"])
    assert [r.doc_id for r in spam_pages(evidence).collect()] == [20]
    seen = {r.doc_id: r for r in evidence.collect()}
    assert seen[20].n_phrases == 476 and seen[20].copied_share == 8 * 56 / 476
    assert seen[30].copied_share == seen[31].copied_share == seen[30].one_source_share == 1.0 and seen[0].copied_share == 56 / 146
    assert seen[41].n_phrases == 0 and seen[41].copied_share == 0.0


def test_short_lists_and_stuffing_of_any_length(spark):
    many = [f"{a} {b}" for a in ("red", "blue", "green", "warm", "soft", "wide", "slim", "new") for b in ("shoes", "boots", "socks", "hats", "coats", "belts", "bags", "rings", "gloves")]
    bad = [
        "\n".join(f"https://h{i}.test/a.html" for i in range(6)),
        "\n".join(f"ABC-{i} Cold index free {i},99 EUR cheap" for i in range(5)),
        " ".join(f"Buy {k} and more {k} here." for k in many for _ in range(3)),
        "Buy cheap shoes online. Cheap shoes here. The best cheap shoes. Get cheap shoes now. Cheap shoes for all. More cheap shoes.",
    ]
    fine = ["The cache of this module is cleared before each run.\nIt is filled again by the first reader.\n" + "\n".join(f"- [part {i}](https://x{i}.example/a/b)" for i in range(3))]
    df = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(bad + fine)], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in spam_pages(page_spam_evidence(df, "doc_id", "text", ["source"])).collect()) == list(range(len(bad)))

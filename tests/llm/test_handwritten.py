from __future__ import annotations

import random

import pytest

from codeloom.llm.handwritten import file_evidence, normal_path, not_handwritten

RNG = random.Random(4)


def w():
    return "".join(RNG.choice("bdfgklmnprst") + RNG.choice("aeiou") for _ in range(4))


def args():
    return ", ".join(RNG.choice([w, lambda: f"'{w()}'", lambda: f"{w()}.{w()}", lambda: "true", lambda: str(RNG.randrange(999))])() for _ in range(RNG.randrange(1, 4)))


def hand(n=25):
    kinds = [
        lambda: f"  const {w()} = await {w()}({args()});", lambda: f"  if (!{w()}.{w()}) {{ throw new Error('{w()} {w()}'); }}", lambda: f"  for (const {w()} of {w()}.{w()}) {{ {w()}({args()}); }}",
        lambda: f"  {w()}.{w()} += {args()};", lambda: f"  return {{ {w()}: {w()}, {w()}: {w()}({args()}) }};", lambda: f"  logger.info('{w()} {w()}', {{ {w()}: {w()}.{w()} }});",
        lambda: f"  const {{ {w()}, {w()} }} = {w()}.{w()} ?? {{}};", lambda: f"  setTimeout(() => {w()}({args()}), {RNG.randrange(999)});", lambda: f"  const {w()} = {w()}.map((x) => {w()}(x, {args()}));",
    ]
    return f"function {w()}({w()}: string): void {{\n" + "\n".join(RNG.choice(kinds)() for _ in range(n)) + "\n}"


LIB = hand(60)
EDITED = LIB.replace("'", '"').replace(";\n", "\n") + "\n  // our own change\n  const extraLine = helper(thing, other, andMore);"
FILES = {
    "packages/a/src/x.ts": (hand(), False),
    "packages/a/src/vendors/list.ts": (hand(), False),
    "packages/a/src/generated-reports/y.ts": (hand(), False),
    "packages/vendor-portal/src/y.ts": (hand(), False),
    "packages/b/src/z.ts": ("// the id is generated by foo; do not edit it by hand\n" + hand(), False),
    "packages/b/src/minifier/q.ts": (hand(3), False),
    "packages/b/node_modules/lib/a.js": (LIB, True),
    "packages/c/src/util/thing.js": (EDITED, True),
    "packages/c/src/own.ts": ("/* name@1.2.3 SPDX-License-Identifier: ISC */\n" + hand(), True),
    "packages/d/src/m.js": ("!function(e,t){" + "for(var n=0;n<t.x;n++)r(t[n]);i=void 0!==e?e:t.y;" * 30 + "}", True),
    "packages/d/src/pb.ts": ("decode(r) {\n" + "\n".join(f"    case {i}:\n      message.{w()} = reader.int64();\n      break;" for i in range(20)) + "\n}", True),
    "packages/d/src/t.ts": ("export function load() {\n  return [" + ", ".join(str(RNG.randrange(10**5)) for _ in range(300)) + "];\n}", True),
    "packages/d/src/g.ts": ("// @generated by foo from bar.foo\n" + hand(3), True),
    "packages/e/public/app.min.js": (None, True),
    "packages/e/src/plain.ts": (None, False),
}


@pytest.fixture(scope="module")
def evidence(spark):
    files, functions = [], []
    for i, (path, (body, _)) in enumerate(FILES.items()):
        files.append((i, path, "h", "clash"))
        if body is not None:
            functions += [(i * 10, i, body, 1), (i * 10, i, body, 1)]
    files += [(500, ".\\packages\\b\\node_modules\\lib\\a.js", "h", "c"), (501, "./packages/a/src/x.ts", "h", "c"), (502, None, "h", "c"), (None, "packages/q/dist/a.js", "h", "c")]
    functions += [(900, 77_777, hand(), 1), (901, None, hand(), 1), (902, 0, None, 1), (903, 0, "", 1)]
    return file_evidence(spark.createDataFrame(files, "id long, path string, content_hash string, lines string"), spark.createDataFrame(functions, "id long, file_id long, body string, lines int")).cache()


def test_files_that_nobody_wrote(evidence):
    found = {r.file_id for r in not_handwritten(evidence).collect()}
    assert found == {i for i, (_, bad) in enumerate(FILES.values()) if bad} | {500}


def test_edited_copy_is_known_by_its_lines(evidence):
    row = evidence.where("path = 'packages/c/src/util/thing.js'").first()
    assert row.contained > 0.9 and not (row.third_party or row.generated or row.minified or row.data)
    assert evidence.where("contained > 0.5").count() == 1


def test_every_row_of_files_is_judged_once(evidence):
    assert evidence.count() == len(FILES) + 3 and evidence.select("file_id").distinct().count() == evidence.count()


def test_empty_tables(spark):
    files = spark.createDataFrame([], "id long, path string, content_hash string")
    functions = spark.createDataFrame([], "id long, file_id long, body string")
    assert file_evidence(files, functions).count() == 0
    one = spark.createDataFrame([(1, "a/dist/b.js", "h")], "id long, path string, content_hash string")
    assert [r.file_id for r in not_handwritten(file_evidence(one, functions)).collect()] == [1]


def test_long_body(spark):
    files = spark.createDataFrame([(1, "p/a/x.ts", "h")], "id long, path string, content_hash string")
    functions = spark.createDataFrame([(1, 1, "\n".join(hand() for _ in range(2000)))], "id long, file_id long, body string")
    assert not_handwritten(file_evidence(files, functions)).count() == 0


@pytest.mark.parametrize(("raw", "clean"), [("./a/b.ts", "a/b.ts"), (".\\a\\b.ts", "a/b.ts"), ("a//b/./c.ts", "a/b/c.ts"), ("a\\b.ts", "a/b.ts"), ("a/.b/c.ts", "a/.b/c.ts")])
def test_normal_path(spark, raw, clean):
    from pyspark.sql import functions as F

    assert spark.range(1).select(normal_path(F.lit(raw)).alias("p")).first().p == clean


def test_hot_copies_same_package_and_unmarked_copies(spark):
    lib, other, plain = hand(60), hand(60), hand(40)
    edited = lambda body, i: body + f"\n  const change{i} = helper{i}(thing, other, andMore{i});"
    bodies = {"packages/a/node_modules/lib/a.js": lib, "packages/a/src/copy.js": edited(lib, 99)}
    bodies |= {f"packages/h{i}/src/copy.js": edited(lib, i) for i in range(15)} | {f"packages/u{i}/src/other.js": edited(other, i) for i in range(4)}
    bad = len(bodies)
    bodies |= {"packages/p/src/a.ts": plain, "packages/p/src/b.ts": edited(plain, 1), "packages/q/src/a.ts": plain + hand(40), "packages/r/src/c.ts": hand(30)}
    late = "/*" + " words of our own." * 60 + "\n * @generated by foo\n */\n"
    bodies = dict([("packages/l/src/late.ts", late + hand(5)), *bodies.items()])
    files = spark.createDataFrame([(i, p, "h") for i, p in enumerate(bodies)], "id long, path string, content_hash string")
    functions = spark.createDataFrame([(i, i, b) for i, b in enumerate(bodies.values())], "id long, file_id long, body string")
    assert sorted(r.file_id for r in not_handwritten(file_evidence(files, functions)).collect()) == list(range(bad + 1))


def judged(spark, bodies):
    files = spark.createDataFrame([(i, p, "h") for i, p in enumerate(bodies)], "id long, path string, content_hash string")
    functions = spark.createDataFrame([(i, i, b) for i, b in enumerate(bodies.values())], "id long, file_id long, body string")
    evidence = file_evidence(files, functions).cache()
    names = list(bodies)
    return {names[r.file_id] for r in not_handwritten(evidence).collect()}, evidence


def test_own_licences_and_own_style_are_hand_written(spark):
    own = "// Copyright (c) 2024 Our Team. All rights reserved.\n"
    old = lambda: hand().replace("const ", "var ")
    bodies = {f"packages/own/src/f{i}.ts": own + hand() for i in range(4)} | {f"packages/es5/src/f{i}.js": old() for i in range(4)}
    bodies |= {"packages/new/src/a.ts": hand(60), "packages/new/src/odd.js": old(), "packages/new/src/banner.ts": "/*! thing v2.10.3 | (c) 2019 Someone | licensed under MIT */\n" + hand(), "packages/new/public/thing-2.10.3.js": hand()}
    found, _ = judged(spark, bodies)
    assert found == {"packages/new/src/odd.js", "packages/new/src/banner.ts", "packages/new/public/thing-2.10.3.js"}


def test_the_index_alone_decides_for_edited_copies(spark):
    lib, plain = hand(60), hand(60)
    half = "\n".join(lib.split("\n")[:45]) + "\n" + hand(20)
    some = "\n".join(lib.split("\n")[:20]) + "\n" + hand(40)
    bodies = {"packages/a/vendor/lib/x.js": lib, "packages/b/src/half.ts": half, "packages/b/src/some.ts": some, "packages/c/src/plain.ts": plain, "packages/d/src/plain.ts": plain + "\n" + hand(60)}
    found, evidence = judged(spark, bodies)
    assert found == {"packages/a/vendor/lib/x.js", "packages/b/src/half.ts"}
    row = evidence.where("path = 'packages/b/src/half.ts'").first()
    assert row.contained > 0.5 and not (row.third_party or row.generated or row.minified or row.data or row.foreign or row.spread)


def test_lines_with_many_sources_lose_no_copy(spark):
    shared, rare = hand(9).split("\n")[1:-1], hand(12).split("\n")[1:-1]
    others = {f"packages/v{i}/vendor/o{i}/x.js": "\n".join(shared + [hand(20)]) for i in range(40)}
    source = "\n".join(shared + rare)
    bodies = others | {"packages/s/vendor/s/x.js": source, "packages/t/src/copy.ts": source + "\n  const more = await anything(first, second);"}
    found, evidence = judged(spark, bodies)
    assert "packages/t/src/copy.ts" in found and evidence.where("path = 'packages/t/src/copy.ts'").first().contained > 0.9
    hot = {f"packages/u{i}/src/copy.ts": source + f"\n  const own{i} = await anything{i}(first, second);" for i in range(60)}
    found, _ = judged(spark, hot | {"packages/z/src/alone.ts": hand()})
    assert found == set(hot)


def test_object_literals_are_no_sign_of_a_generator(spark):
    literal = lambda: f"  const {w()} = {{\n" + "\n".join(f"    {w()}: {RNG.choice([repr(w()), str(RNG.randrange(999)), 'true'])}," for _ in range(5)) + "\n  };"
    body = "function x() {\n" + "\n".join(literal() for _ in range(4)) + "\n" + "\n".join(hand(12).split("\n")[1:-1]) + "\n}"
    table_of = "\n".join(f"  e.{w()}Name = row['{w()}Name'] as string;" for _ in range(20))
    found, _ = judged(spark, {"packages/a/src/x.ts": body, "packages/a/src/y.ts": f"fromRow(row) {{\n{table_of}\n  return e;\n}}"})
    assert found == {"packages/a/src/y.ts"}

"""Generated, minified and vendored source files, and data saved as code.

Three kinds of evidence, each kept per file:

* the path and the leading comment: vendor and build folders, names with a release version, generator notices, and release
  banners (a licence together with the version of what is licensed; a licence or a copyright alone says nothing);
* an inverted index of rare line hashes over all files: a line that one file alone holds can't be a copy and is dropped, the
  rest give the exact part of a file's lines that one other file has. A file is a copy when that other file is third-party, or
  when nearly all of its lines lie in several packages;
* token composition for the rest: identifier length, digits, how few line shapes fill the file, and `var` in a package that is
  written with `const` and `let`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

# Folders and name endings that tools give to what they write or bring in, in lower case.
THIRD_PARTY_FOLDERS = ["bower_components", "deps", "external", "jspm_packages", "node_modules", "third-party", "third_party", "thirdparty", "vendor"]
GENERATED_FOLDERS = ["__generated__", "autogen", "build-output", "dist", "gen", "generated"]
RELEASE_NAME = r"(?:[@._-]v?\d+\.\d+\.\d+[\w.+-]*)"
TOOL_ENDINGS = r"(?:[._-]min|\.bundle|\.chunk|_pb|\.pb|\.g|\.gen|\.generated|_generated|\.designer)\.[a-z]+$"

_GENERATED_NOTICE = re.compile(
    r"@generated\b|<auto-generated|\bauto-?generated (?:from|by|file|code)|\bcode generated by\b|\bmachine output\b|\bthis file (?:was|is) (?:automatically|auto-?)\s?\w+"
    r"|\bdiese datei wurde (?:von|automatisch)\b|^\W*generado (?:por|autom)|\bfichier (?:produit|généré) par\b|\bdo not modify: rebuilt\b",
    re.I,
)
_LICENCE = re.compile(r"@license\b|@preserve\b|SPDX-License-Identifier|\(c\)\s*\d{4}|©\s*\d{4}|\bcopyright\b|\b(?:dual )?licensed\b|\breleased under\b", re.I)
_RELEASE = re.compile(r"(?<![\w.])v?\d+\.\d+\.\d+(?![\w.]*\d\.\d)", re.I)
_LEADING = re.compile(r"\s*((?:/\*.*?\*/|//[^\n]*)\s*)+", re.S)
_STRING = re.compile(r""""(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`""")
_COMMENT = re.compile(r"/\*.*?\*/|(?<![:\w])//[^\n]*", re.S)
_NUMBER = re.compile(r"\b\d[\w.]*")
_KEYWORDS = "function|async|await|const|let|var|return|if|else|for|while|switch|case|default|break|try|catch|throw|new|export|class|this|null|true|false|undefined|typeof|of|in|import|from"
_NAME = re.compile(rf"(?<![\w$])(?!(?:{_KEYWORDS}|S|N)(?![\w$]))[A-Za-z_$][\w$]*")
_IDENTIFIER = re.compile(r"[A-Za-z_$][\w$]*")
_BLANKS = re.compile(r"\s+")
#: Shapes that say nothing about who wrote a line: brackets, and the literal properties of an object.
_NEUTRAL = {"", "}", "};", "{", "});", "],", "]", "}, {", ")"} | {f"{name}: {value}{end}" for name in "IS" for value in ("S", "N", "true", "false", "null", "undefined") for end in ("", ",")}
MIN_LINE = 24

_NUMBERS = ["chars", "digits", "vars", "decls", "names", "name_chars", "code_lines"]
_FACTS = (
    "id long, file_id long, " + ", ".join(f"{n} long" for n in _NUMBERS) + ", generated_notice boolean, release_notice boolean, shapes array<struct<shape: long, n: long>>, lines array<long>"
)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def function_facts(body: str) -> tuple:
    """The columns of `_FACTS` after `decls` for one function body."""
    leading = _LEADING.match(body)
    notice = leading.group(0) if leading else ""
    names = _IDENTIFIER.findall(body)
    code = _COMMENT.sub(" ", body)
    shaped = _NAME.sub("I", _NUMBER.sub("N", _STRING.sub("S", code)))
    shapes = Counter(s for s in (_BLANKS.sub(" ", line.strip()) for line in shaped.split("\n")) if s not in _NEUTRAL)
    lines = {_hash(s) for s in (_BLANKS.sub(" ", line.strip()).replace('"', "'").rstrip(";") for line in code.split("\n")) if len(s) >= MIN_LINE}
    return (
        len(names),
        sum(map(len, names)),
        sum(shapes.values()),
        bool(_GENERATED_NOTICE.search(notice)),
        bool(_LICENCE.search(notice) and _RELEASE.search(notice)),
        [{"shape": _hash(s), "n": n} for s, n in shapes.items()],
        sorted(lines),
    )


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches (id, file_id, chars, digits, vars, decls, body) -> `_FACTS`."""
    names = ["id", "file_id", *_NUMBERS, "generated_notice", "release_notice", "shapes", "lines"]
    types = [pa.int64()] * 3 + [pa.bool_(), pa.bool_(), pa.list_(pa.struct([("shape", pa.int64()), ("n", pa.int64())])), pa.list_(pa.int64())]
    for batch in batches:
        for low in range(0, batch.num_rows, 2000):
            part = batch.slice(low, 2000)
            rows = [function_facts(body or "") for body in part.column(6).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(6)), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names)


def normal_path(path: Column) -> Column:
    """One spelling of a repository-relative path: `/` between names, no leading or inner `./`."""
    return F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), r"^(?:\./+)+|/+(?=/)|(?<=/)\./+", ""), r"^/+", "")


def _has_folder(path: Column, folders: list[str]) -> Column:
    inner = F.split(F.lower(path), "/")
    return F.arrays_overlap(F.slice(inner, 1, F.greatest(F.size(inner) - 1, F.lit(0))), F.array(*[F.lit(f) for f in folders]))


#: Sources that a line is compared with in the first round, the least by hash; as all lines of a library take the same ones,
#: its copies meet there. Files that this round leaves open are compared with all sources.
SOURCES = 16


def _in_one(own: DataFrame, sources: DataFrame, sizes: DataFrame, bar: float) -> DataFrame:
    """(path, contained): the largest part of a file's lines that one source has, or one of `bar` or more, for (path, line) and (line, source).

    The first round takes `SOURCES` sources of each line. A file that stays under the bar there, has enough lines with any
    source and one with more sources than that is counted against all sources in a second round, so no copy is lost.
    """
    least = Window.partitionBy("line").orderBy(F.xxhash64("source"), "source")
    placed = sources.withColumn("place", F.row_number().over(least))
    count = lambda rows, some: rows.join(some.select("line", "source"), "line").groupBy("path", "source").agg(F.count("*").alias("hits")).groupBy("path").agg(F.max("hits").alias("hits"))
    first = count(own, placed.where(F.col("place") <= SOURCES))
    crowded = placed.where(F.col("place") == SOURCES + 1).select("line", F.lit(1).alias("crowded"))
    met = own.join(crowded, "line", "left").groupBy("path").agg(F.count("*").alias("all_hits"), F.max("crowded").alias("crowded"))
    first = written(met.join(sizes, "path").join(first, "path", "left"), "handwritten-first")
    open_ = first.where((F.col("crowded") == 1) & (F.coalesce("hits", F.lit(0)) < bar * F.col("n")) & (F.col("all_hits") >= bar * F.col("n"))).select("path")
    rest = count(own.join(open_, "path", "left_semi"), sources).withColumnRenamed("hits", "rest")
    return first.join(rest, "path", "left").select("path", (F.greatest(F.coalesce("rest", F.lit(0)), F.coalesce("hits", F.lit(0))) / F.col("n")).alias("contained"))


def _spread(rows: DataFrame, bar: float, least_lines: int, packages: int) -> DataFrame:
    """(path, spread) of the files of (path, package, line, n, source) that are copies of a file which lies in several packages.

    Two files are copies when each has `bar` of the other's lines. As in `_in_one`, a second round takes the files that the
    first one leaves open although one of their lines has more sources than the first round takes.
    """
    wide = rows.groupBy("path").agg(F.count("*").alias("hits"), F.first("n").alias("n")).where((F.col("hits") >= least_lines) & (F.col("hits") >= bar * F.col("n"))).select("path")
    rows = written(rows.join(wide, "path", "left_semi"), "handwritten-wide")
    sources = rows.select("line", F.col("source").alias("other"), F.col("n").alias("size")).distinct()
    placed = sources.withColumn("place", F.row_number().over(Window.partitionBy("line").orderBy("other")))

    def groups(some: DataFrame, of: DataFrame) -> DataFrame:
        met = some.join(of.select("line", "other", "size"), "line").where((F.col("size") >= bar * F.col("n")) & (F.col("n") >= bar * F.col("size")))
        alike = met.groupBy("path", "package", "n", "other", "size").agg(F.count("*").alias("hits")).where(F.col("hits") >= bar * F.greatest("n", "size"))
        many = alike.groupBy("other").agg(F.count_distinct("package").alias("packages")).where(F.col("packages") >= packages)
        return alike.join(many, "other", "left_semi").select("path").distinct()

    first = written(groups(rows, placed.where(F.col("place") <= SOURCES)), "handwritten-spread")
    crowded = rows.join(placed.where(F.col("place") == SOURCES + 1).select("line"), "line", "left_semi").select("path").distinct()
    open_ = crowded.join(first, "path", "left_anti")
    met = rows.join(open_, "path", "left_semi").select("line").distinct().join(sources, "line").select("other").distinct()
    return first.unionByName(groups(rows, sources.join(met, "other", "left_semi")).join(open_, "path", "left_semi")).select("path", F.lit(True).alias("spread"))


def file_evidence(files: DataFrame, functions: DataFrame, least_lines: int = 5, copied: float = 0.5, copied_unmarked: float = 0.8, packages: int = 3) -> DataFrame:
    """(file_id, path, third_party, generated, minified, data, foreign, contained, spread): evidence per row of files.

    `contained` is the largest part of the distinct lines of a file of `least_lines` lines or more that one third-party file has (from `copied` on, one such part);
    `spread` says that an unmarked file of twice as many lines has copies in `packages` packages that share `copied_unmarked` of
    both files' lines; `foreign` that a file declares with `var` while the rest of its package does so with const and let. Lines have 24 characters or more, without comments, indentation, quote style and final `;`.
    Rows of files that are spellings of one path share the evidence of all their functions. A function id delivered twice counts
    once; functions of unknown files are ignored; files without functions are judged by their path; null paths have no evidence
    from it; null and empty bodies have none; empty tables give an empty result; other columns are ignored.
    """
    counts = {"digits": "[0-9]", "vars": r"\bvar\b", "decls": r"\b(?:const|let)\b"}
    sizes = [F.length("body").alias("chars"), *[F.regexp_count("body", F.lit(p)).alias(c) for c, p in counts.items()]]
    bodies = functions.where("id IS NOT NULL AND file_id IS NOT NULL").select("id", "file_id", F.coalesce("body", F.lit("")).alias("body"))
    bodies = bodies.select("id", "file_id", *[c.cast("long") for c in sizes], "body")
    facts = written(bodies.mapInArrow(_facts, _FACTS), "handwritten-facts")
    named = files.where("id IS NOT NULL").select(F.col("id").alias("file_id"), normal_path(F.col("path")).alias("path")).dropDuplicates(["file_id"])
    named = named.withColumn("path", F.coalesce("path", F.concat(F.lit("\u0000"), F.col("file_id"))))
    named = named.withColumn("package", F.substring_index("path", "/", 2))
    facts = facts.join(named, "file_id").dropDuplicates(["file_id", "id"])

    shapes = facts.select("path", F.explode("shapes").alias("s")).groupBy("path", "s.shape").agg(F.sum("s.n").alias("n"))
    shaped = shapes.groupBy("path").agg(F.sort_array(F.collect_list("n"), asc=False).alias("ns")).select("path", F.size("ns").alias("kinds"), F.aggregate(F.slice("ns", 1, 4), F.lit(0).cast("long"), lambda a, x: a + x).alias("top4"))
    sums = facts.groupBy("path").agg(*[F.sum(n).alias(n) for n in _NUMBERS], *[F.max(n).alias(n) for n in ("generated_notice", "release_notice")])
    known = named.select("path").distinct().join(sums, "path", "left").join(shaped, "path", "left").na.fill(0).na.fill(False)
    package = F.substring_index("path", "/", 2)
    style = known.groupBy(package.alias("package")).agg(F.sum("vars").alias("all_vars"), F.sum("decls").alias("all_decls"))
    known = known.withColumn("package", package).join(style, "package")
    known = known.select(
        "path",
        (F.col("release_notice") | _has_folder(F.col("path"), THIRD_PARTY_FOLDERS) | F.lower("path").rlike(RELEASE_NAME + r"(?:/|\.[a-z]+$)")).alias("third_party"),
        (
            ((F.col("code_lines") >= 14) & (F.col("top4") >= 0.68 * F.col("code_lines")) & (F.col("kinds") <= 0.45 * F.col("code_lines")))
            | F.col("generated_notice") | _has_folder(F.col("path"), GENERATED_FOLDERS) | F.lower("path").rlike(TOOL_ENDINGS)
        ).alias("generated"),
        ((F.col("names") >= 10) & (F.col("name_chars") < 4.5 * F.col("names"))).alias("minified"),
        ((F.col("chars") >= 200) & (F.col("digits") > 0.1 * F.col("chars"))).alias("data"),
        ((F.col("vars") >= 2) & (F.col("vars") > F.col("decls")) & (F.col("all_decls") - F.col("decls") > 2 * (F.col("all_vars") - F.col("vars")))).alias("foreign"),
    )
    known = written(known, "handwritten-known")

    held = facts.select("path", "package", F.explode("lines").alias("line")).distinct().join(known.select("path", "third_party"), "path")
    held = written(held, "handwritten-held")
    sizes = held.groupBy("path").agg(F.count("*").alias("n"), F.bit_xor("line").alias("mark")).where(F.col("n") >= least_lines)
    several = held.groupBy("line").agg(F.count("*").alias("holders"), F.count_if("third_party").alias("theirs"), F.min("package").alias("low"), F.max("package").alias("high"))
    several = several.where("holders > 1 AND (theirs BETWEEN 1 AND holders - 1 OR (theirs = 0 AND low <> high))").select("line", (F.col("theirs") > 0).alias("of_theirs"))
    # files with the same lines are one source
    shared = written(held.join(several, "line").join(sizes, "path").withColumn("source", F.xxhash64("mark", "n")), "handwritten-shared")
    sizes = sizes.select("path", "n")
    own = shared.where("NOT third_party").select("path", "package", "line", "of_theirs", "n", "source")
    one = _in_one(own.where("of_theirs").select("path", "line"), shared.where("third_party").select("line", "source").distinct(), sizes, copied)

    spread = _spread(own.where("NOT of_theirs"), copied_unmarked, 2 * least_lines, packages)

    found = named.select("file_id", "path").join(known, "path").join(one, "path", "left").join(spread, "path", "left")
    return found.withColumns({"contained": F.coalesce("contained", F.lit(0.0)), "spread": F.coalesce("spread", F.lit(False))})


def not_handwritten(evidence: DataFrame, min_contained: float = 0.5) -> DataFrame:
    return evidence.where(F.col("third_party") | F.col("generated") | F.col("minified") | F.col("data") | F.col("foreign") | (F.col("contained") >= min_contained) | F.col("spread"))

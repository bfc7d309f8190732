"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed per (source, language, topic) cell. Raking scales the cells in turn until the sources have their
target shares of all tokens and languages and topics keep theirs, never above the repeats that a source allows. Sweeps end when
the weights stand still; the last steps are on sources alone and end when every source has its target or all it may give. A
cell's weight is the expected number of copies of each of its documents; documents are then drawn with that calibrated
probability, systematically within a source in order of their size, so that the tokens drawn stay close to their expectation.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import written

# Fixed value: the public pattern by which this byte-level vocabulary splits text.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


_ENCODINGS: dict[str, Any] = {}


def _encoding(name: str):
    """The tokenizer of a file that the session ships to its workers, parsed once per process."""
    if name not in _ENCODINGS:
        import tiktoken

        with open(SparkFiles.get(name), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        _ENCODINGS[name] = tiktoken.Encoding("codeloom", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[name]


def _count_tokens(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(name)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            sizes = pa.array([len(encoding.encode_ordinary(t)) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes], [*batch.schema.names[:-1], "tokens"])

    return run


def token_counts(documents: DataFrame, keep: list[Column], text_col: str, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """The kept columns and `tokens`, the length of the text in tokens (0 for null)."""
    rows = documents.select(*keep, F.col(text_col).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    documents.sparkSession.sparkContext.addFile(ranks_path)
    return rows.mapInArrow(_count_tokens(os.path.basename(ranks_path)), f"{fields}, tokens long")


def _scaled(cells: DataFrame, column: str) -> DataFrame:
    """One raking step: scale the cells of each value of `column` to its target, up to the cap."""
    mass, below, target = F.col("weight") * F.col("tokens"), F.col("weight") < F.col("cap"), F.col(f"{column}_target")
    sums = cells.groupBy(column).agg(F.sum(F.when(below, mass).otherwise(0.0)).alias("_free"), F.sum(F.when(below, 0.0).otherwise(mass)).alias("_fixed"))
    free, fixed = F.col("_free"), F.col("_fixed")
    scale = F.when(target < fixed, target / (fixed + free)).when(below & (free > 0), (target - fixed) / free).otherwise(1.0)
    # topics grow with the data, languages and sources don't
    return cells.join(sums.hint("merge") if column == "topic" else sums, column).withColumn("weight", F.least(F.col("cap"), F.col("weight") * scale)).select(*cells.columns)


def raked_weights(counted: DataFrame, targets: DataFrame, total_tokens: float | None = None, tolerance: float = 1e-3, max_sweeps: int = 12) -> DataFrame:
    """(source, lang, topic, tokens, cap, weight, goal): expected copies per document of each cell, and the goal of its source.

    `counted` has source, lang, topic, tokens; `targets` source, target_share, max_repeats. The total defaults to the tokens of
    all rows of `counted`, with a target or not. A source's goal is its share of the total, or all its tokens as often as they
    may be repeated if that is less; languages and topics keep the shares they have among the sources with a target. Sweeps end
    when no weight changes by more than `tolerance` of its cap, or after `max_sweeps`; the sources' goals are met in any case.
    """
    aim = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    aim = aim.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.greatest(F.lit(0.0), F.coalesce(F.col("max_repeats"), F.lit(1)).cast("double")).alias("cap"))
    total = float((counted.agg(F.sum("tokens")).first()[0] or 0) if total_tokens is None else total_tokens)
    cells = counted.groupBy("source", "lang", "topic").agg(F.sum("tokens").cast("double").alias("tokens")).where("tokens > 0").join(aim.hint("merge"), "source")
    cells = written(cells, "mixing-cells")
    goals = cells.groupBy("source", "cap", "target_share").agg(F.sum("tokens").alias("have")).select("source", F.least(F.col("target_share") * total, F.col("cap") * F.col("have")).alias("source_target"))
    sums = cells.agg(F.sum("tokens").alias("have")).first().have or 0.0
    scale = (goals.agg(F.sum("source_target").alias("s")).first().s or 0.0) / sums if sums else 0.0
    cells = cells.join(goals.hint("merge"), "source").withColumn("weight", F.least(F.lit(1.0), F.col("cap")))
    for column in ("lang", "topic"):
        cells = cells.join(cells.groupBy(column).agg((F.sum("tokens") * scale).alias(f"{column}_target")).hint("merge"), column)
    for _ in range(max_sweeps):
        cells = cells.withColumn("was", F.col("weight"))
        for column in ("topic", "lang", "source"):
            cells = _scaled(cells, column)
        seen = Observation()
        cells = written(cells.observe(seen, F.max(F.abs(F.col("weight") - F.col("was")) / F.col("cap")).alias("change")).drop("was"), "mixing-sweep")
        if (seen.get["change"] or 0.0) <= tolerance:
            break
    short = F.col("source_target") - F.col("reached")
    while True:  # each round caps further cells of the sources that are short, so it ends; mostly after one
        reached = cells.groupBy("source", "source_target", "cap").agg(F.sum(F.col("weight") * F.col("tokens")).alias("reached"), F.sum(F.col("cap") * F.col("tokens")).alias("most"))
        if reached.where(F.abs(short) > 1e-9 * total).isEmpty():
            break
        for _ in range(3):
            cells = _scaled(cells, "source")
        cells = written(cells, "mixing-sweep")
    return cells.select("source", "lang", "topic", "tokens", "cap", "weight", F.col("source_target").alias("goal"))


def mixed_documents(counted: DataFrame, weights: DataFrame, seed: int = 0, per_bucket: int = 20_000) -> DataFrame:
    """(doc_id, source, tokens, copies) for the documents that are drawn at least once.

    Each is taken as often as its weight says, its fraction by a systematic draw over the documents of a source in the order of
    classes of size. A class is cut into parts of about `per_bucket` documents by hash, each ordered by size, so that no task
    takes a whole source.
    """
    rows = counted.join(weights.select("source", "lang", "topic", "weight").hint("merge"), ["source", "lang", "topic"])
    parts = max(1, counted.count() // per_bucket)
    place = F.xxhash64("doc_id", F.lit(seed))
    rows = rows.select("doc_id", "source", "tokens", F.floor("weight").alias("whole"), (F.col("weight") - F.floor("weight")).alias("part"), place.alias("place"))
    rows = rows.withColumns({"size": F.floor(F.log2(F.col("tokens") + 1) * 4), "bucket": F.pmod("place", F.lit(parts))})
    sums = rows.groupBy("source", "size", "bucket").agg(F.sum("part").alias("s"))
    before = sums.withColumn("before", F.coalesce(F.sum("s").over(Window.partitionBy("source").orderBy("size", "bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    within = F.sum("part").over(Window.partitionBy("source", "size", "bucket").orderBy("tokens", "place", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_upto", within).join(before.select("source", "size", "bucket", "before").hint("merge"), ["source", "size", "bucket"])
    rows = rows.withColumn("_end", F.round(F.col("before") + F.col("_upto"), 9) + 0.5)
    drawn = F.col("whole") + F.floor("_end") - F.floor(F.col("_end") - F.col("part"))
    return rows.select("doc_id", "source", "tokens", drawn.cast("long").alias("copies")).where("copies > 0")


def mix_report(mixed: DataFrame, counted: DataFrame, targets: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(source, target_share, reached_share, total_share, goal_share, tokens, documents, copies, available_tokens) per target source.

    reached_share is the source's part of the tokens of the mix, total_share its tokens over all tokens of `counted`, which is
    what target_share speaks of, and goal_share the part that its documents and repeats allow (null without `weights`).
    """
    total = mixed.agg(F.sum(F.col("tokens") * F.col("copies")).alias("total"))
    every = counted.agg(F.sum("tokens").alias("every"))
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("got"), F.count("*").alias("documents"), F.sum("copies").alias("copies"))
    have = counted.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    aim = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"))
    goals = weights.groupBy("source").agg(F.first("goal").alias("goal")) if weights is not None else aim.select("source", F.lit(None).cast("double").alias("goal"))
    zero = F.lit(0).cast("long")
    out = aim.join(got, "source", "left").join(have, "source", "left").join(goals, "source", "left").crossJoin(total).crossJoin(every)  # one row each
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return out.select(
        "source", "target_share", share(F.col("got"), F.col("total")).alias("reached_share"), share(F.col("got"), F.col("every")).alias("total_share"),
        (share(F.col("goal"), F.col("every")) if weights is not None else F.lit(None).cast("double")).alias("goal_share"), F.coalesce("got", zero).alias("tokens"),
        F.coalesce("documents", zero).alias("documents"), F.coalesce("copies", zero).alias("copies"), F.coalesce("available_tokens", zero).alias("available_tokens"),
    )


def mix_inputs(documents: DataFrame, mix_targets: DataFrame, ranks_path: str = DEFAULT_RANKS) -> tuple[DataFrame, DataFrame]:
    """(counted, targets) with sources trimmed and lower-cased, languages likewise (`und` where null) and packages as topics.

    `counted` has all documents with an id, as all tokens count for the total, also those of sources without a target; a
    document delivered twice under one id counts once.
    """
    clean = lambda c: F.lower(F.trim(F.col(c)))
    targets = mix_targets.select(clean("source").alias("source"), "target_share", "max_repeats").where("source IS NOT NULL")
    rows = documents.where("doc_id IS NOT NULL").select("doc_id", "text", clean("source").alias("source"), F.coalesce(clean("lang"), F.lit("und")).alias("lang"), F.coalesce("package", F.lit("")).alias("topic"))
    counted = token_counts(rows, [F.col(c) for c in ("doc_id", "source", "lang", "topic")], "text", ranks_path)
    return written(counted.dropDuplicates(["doc_id"]), "mixing-counted"), targets

"""Near-duplicate records by a MinHash LSH forest with exact verification.

Every distinct text has one signature of min-hashes per tree. The signatures of a tree, sorted, are the leaves of a prefix trie;
two texts meet at a node when they share its prefix. A pair of similarity s shares d min-hashes of a tree with probability
s**d, so for each record the prefixes are made as short as the target recall asks for, and as long as crowding asks for:

1. All trees start at `forest_depth`, the longest prefix at which the least similar pair that counts meets in one of the trees
   with the target recall. Nodes of up to `crowd` texts make candidates there.
2. A crowded node (boilerplate that many texts begin with in hash order) isn't paired but followed down the trie, for its
   texts only, until its parts are small or `max_depth` is reached.
3. Longer prefixes cost recall. For each record the recall that its own depths leave is worked out; records that stay below
   the target are compared among themselves by an exact prefix filter (the rarest shingles of each, of which a pair that
   counts must share one), so nothing is lost. A pair can only be short of recall when both of its records are.
4. Pairs that met are verified on their whole shingle sets, after a filter on the sets' sizes.

Texts with the same words are one class: only one of each class enters the forest, and the copies are joined back to
the verified pairs at the end, so a text repeated a million times costs one entry.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import textvec as tv

_SIG_TYPE = "id long, h1 long, h2 long, keys array<long>"
_DEEP_TYPE = "rep long, tree int, keys array<long>"


def forest_depth(threshold: float, target_recall: float, trees: int, max_depth: int) -> int:
    """The longest prefix at which a pair of similarity `threshold` meets with probability `target_recall`."""
    for depth in range(max_depth, 1, -1):
        if 1 - (1 - threshold**depth) ** trees >= target_recall:
            return depth
    return 1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _prefix_keys(grams: np.ndarray, starts: np.ndarray, trees: int, shallow: int, deep: int) -> np.ndarray:
    """For each text and tree the keys of its prefixes of `shallow` to `deep` min-hashes."""
    mult, add = tv.seeds(trees * 64, 11) | tv.U64(1), tv.seeds(trees * 64, 12)
    tree_salt, prefix_salt = tv.seeds(trees, 13), tv.seeds(deep, 14) | tv.U64(1)
    keys = np.empty((len(starts), trees, deep - shallow + 1), tv.U64)
    for t in range(trees):
        key = np.full(len(starts), tree_salt[t])
        for d in range(deep):
            low_hash = np.minimum.reduceat((grams * mult[t * 64 + d] + add[t * 64 + d]) >> tv.U64(32), starts)
            key = tv.mixed(key + low_hash * prefix_salt[d])
            if d + 1 >= shallow:
                keys[:, t, d + 1 - shallow] = key
    return keys


def _long_texts(batch: pa.RecordBatch, k: int, min_words: int) -> Iterator[tuple]:
    """(ids, words, start of each text's words, shingles, start of each text's shingles) of the texts that are long enough."""
    raw, offsets = tv.utf8(batch.column(1))
    ids = np.asarray(batch.column(0))
    for low, high in tv.chunks(offsets):
        at = offsets[low : high + 1]
        words, rows = tv.ascii_words(raw[at[0] : at[-1]], at - at[0])
        keep = (np.bincount(rows, minlength=high - low) >= max(min_words, k))[rows]
        words, rows = words[keep], rows[keep]
        if len(rows):
            kept, starts = tv.row_starts(rows)
            grams, gram_rows = tv.shingles(words, rows, k)
            yield ids[low:high][kept], words, starts, grams, tv.row_starts(gram_rows)[1]


def _signatures(k: int, min_words: int, trees: int, depth: int):
    """Arrow batches (id, text) -> id, a 128-bit hash of the words and one prefix key per tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, starts, grams, gram_starts in _long_texts(batch, k, min_words):
                place = (np.arange(len(words)) - np.repeat(starts, np.diff(np.append(starts, len(words))))).astype(tv.U64)
                h1 = np.add.reduceat(tv.mixed(words + place * tv._MULT), starts)
                h2 = np.add.reduceat(tv.mixed(words ^ tv.mixed(place + tv.U64(99))), starts)
                keys = _prefix_keys(grams, gram_starts, trees, depth, depth)[:, :, 0]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * trees), _signed(keys.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids), _signed(h1), _signed(h2), lists], ["id", "h1", "h2", "keys"])

    return run


def _deeper(k: int, trees: int, depth: int, max_depth: int):
    """Arrow batches (rep, text) -> one row per text and tree with the keys of its prefixes below `depth`."""
    steps = max_depth - depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, _, grams, gram_starts in _long_texts(batch, k, 1):
                keys = _prefix_keys(grams, gram_starts, trees, depth + 1, max_depth)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) * trees + 1, dtype=np.int32) * steps), _signed(keys.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, trees)), pa.array(np.tile(np.arange(trees, dtype=np.int32), len(ids))), lists], ["rep", "tree", "keys"])

    return run


def _shingle_sets(k: int):
    """Arrow batches (id, text) -> id and the sorted distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = tv.utf8(batch.column(1))
            ids = np.asarray(batch.column(0))
            for low, high in tv.chunks(offsets):
                at = offsets[low : high + 1]
                grams, rows = tv.shingles(*tv.ascii_words(raw[at[0] : at[-1]], at - at[0]), k)
                if not len(rows):
                    continue
                order = np.lexsort((grams, rows))
                grams, rows = grams[order], rows[order]
                new = np.concatenate(([True], (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])))
                grams, rows = grams[new], rows[new]
                kept, starts = tv.row_starts(rows)
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(rows)).astype(np.int32)), _signed(grams))
                yield pa.RecordBatch.from_arrays([pa.array(ids[low:high][kept]), lists], ["id", "grams"])

    return run


class NearDuplicates:
    """Near-duplicate structure of a collection.

    `classes` (id, rep): every record that is long enough, with the least id of those that have the same words.
    `links` (rep_a, rep_b, similarity), rep_a < rep_b: classes whose similarity reaches the threshold.
    """

    def __init__(self, classes: DataFrame, links: DataFrame):
        self.classes, self.links = classes, links

    def pairs(self) -> DataFrame:
        """(id_a, id_b), id_a < id_b: every pair of records that counts, copies expanded."""
        a = self.classes.select(F.col("id").alias("x"), F.col("rep").alias("rep_a"))
        b = self.classes.select(F.col("id").alias("y"), F.col("rep").alias("rep_b"))
        linked = self.links.select("rep_a", "rep_b").join(a, "rep_a").join(b, "rep_b").select("x", "y")
        copies = a.join(b, F.col("rep_a") == F.col("rep_b")).where("x < y").select("x", "y")
        return linked.unionByName(copies).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    def memberships(self) -> DataFrame:
        """(id, rep, n_links): one row per record with its class and the number of other classes it is linked to."""
        ends = self.links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
        return self.classes.join(ends, "rep", "left").select("id", "rep", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _met(buckets: DataFrame) -> DataFrame:
    """(rep_a, rep_b), rep_a < rep_b, of (key, rep): all pairs under one key."""
    left, right = (buckets.select("key", F.col("rep").alias(c)) for c in ("rep_a", "rep_b"))
    return left.join(right, "key").where("rep_a < rep_b").select("rep_a", "rep_b")


def _crowded(buckets: DataFrame, crowd: int) -> DataFrame:
    return buckets.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key")


def _followed_down(texts: DataFrame, hot: DataFrame, k: int, threshold: float, target_recall: float, trees: int, depth: int, max_depth: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """What becomes of the texts at crowded nodes, (rep, tree): pairs that meet further down, and the records short of recall."""
    reps = hot.select("rep").distinct()
    deep = texts.withColumnRenamed("id", "rep").join(reps, "rep", "left_semi").dropDuplicates(["rep"]).mapInArrow(_deeper(k, trees, depth, max_depth), _DEEP_TYPE)
    left = written(deep.join(hot, ["rep", "tree"], "left_semi"), "neardup-deep")
    missed = reps.join(hot.groupBy("rep").agg(F.count("*").alias("n")), "rep").select("rep", ((F.lit(trees) - F.col("n")) * math.log1p(-(threshold**depth))).alias("log_missed"))
    pairs = None
    for step in range(max_depth - depth):
        nodes = left.select("rep", "tree", "keys", F.element_at("keys", step + 1).alias("key"))
        crowded = written(_crowded(nodes, crowd), "neardup-crowded")
        small = nodes.join(crowded, "key", "left_anti")
        found = _met(small.select("key", "rep"))
        pairs = found if pairs is None else pairs.unionByName(found)
        missed = missed.unionByName(small.groupBy("rep").agg((F.count("*") * math.log1p(-(threshold ** (depth + step + 1)))).alias("log_missed")))
        left = written(nodes.join(crowded, "key", "left_semi").select("rep", "tree", "keys"), "neardup-deep")
    short = missed.groupBy("rep").agg(F.sum("log_missed").alias("log_missed")).where(F.col("log_missed") > math.log(1 - target_recall)).select("rep")
    return pairs, written(short, "neardup-short")


def _by_rarest(sets: DataFrame, threshold: float) -> DataFrame:
    """(rep_a, rep_b) of (rep, grams): all pairs that may reach the threshold, by the rarest shingles of each set.

    Sets whose intersection is `threshold` of their union share one of the first size - ceil(threshold * size) + 1 shingles in
    any common order; by frequency these are the rarest.
    """
    grams = sets.select("rep", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy("n", "gram"))
    first = grams.join(often, "gram").withColumn("place", place).where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1)
    first = first.where("n > 1")
    a, b = (first.select("gram", F.col("rep").alias(f"rep_{x}"), F.col("size").alias(f"size_{x}")) for x in "ab")
    fits = (F.col("rep_a") < F.col("rep_b")) & (F.least("size_a", "size_b") >= threshold * F.greatest("size_a", "size_b") - 1e-9)
    return a.join(b, "gram").where(fits).select("rep_a", "rep_b")


def near_duplicates(
    records: DataFrame,
    id_col: str,
    text_col: str,
    k: int = 5,
    threshold: float = 0.8,
    min_words: int = 1,
    trees: int = 28,
    max_depth: int = 8,
    target_recall: float = 0.999,
    crowd: int = 256,
) -> NearDuplicates:
    """Find records whose sets of k-word sequences have intersection / union >= threshold.

    Words are maximal runs of ASCII letters, digits and `_`, case kept. Records with fewer than `min_words` (or k) words,
    a null id or a null text are left out; a repeated id is one record and must carry one text; an empty table gives empty
    results; other columns are ignored, whatever their names. `crowd` is the most texts that are paired at one node; those of
    fuller nodes are found further down or by their rarest shingles, so it bounds work and not what is found.
    """
    depth = forest_depth(threshold, target_recall, trees, max_depth)
    texts = records.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    signed = written(texts.mapInArrow(_signatures(k, min_words, trees, depth), _SIG_TYPE), "neardup-signatures")
    classes = signed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first("keys").alias("keys"))
    members = signed.select("id", "h1", "h2").join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).select("id", "rep").distinct()
    buckets = classes.select("rep", F.posexplode("keys").alias("tree", "key"))
    crowded = written(_crowded(buckets, crowd), "neardup-crowded")
    if crowded.isEmpty():
        met = _met(buckets).distinct()
    else:
        met = _met(buckets.join(crowded, "key", "left_anti"))
        hot = written(buckets.join(crowded, "key", "left_semi").select("rep", "tree"), "neardup-hot")
        deeper, short = _followed_down(texts, hot, k, threshold, target_recall, trees, depth, max_depth, crowd)
        rest = texts.withColumnRenamed("id", "rep").join(short, "rep", "left_semi").dropDuplicates(["rep"])
        rest = written(rest.mapInArrow(_shingle_sets(k), "id long, grams array<long>").withColumnRenamed("id", "rep"), "neardup-rest")
        met = met.unionByName(deeper).unionByName(_by_rarest(rest, threshold)).distinct()
    met = written(met, "neardup-candidates")
    needed = met.select(F.explode(F.array("rep_a", "rep_b")).alias("id")).distinct()
    sets = texts.join(needed, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(_shingle_sets(k), "id long, grams array<long>")
    sets = written(sets, "neardup-sets")
    size_a, size_b = (sets.select(F.col("id").alias(f"rep_{x}"), F.size("grams").alias(f"size_{x}")) for x in "ab")
    fits = F.least("size_a", "size_b") >= threshold * F.greatest("size_a", "size_b") - 1e-9
    met = met.join(size_a, "rep_a").join(size_b, "rep_b").where(fits).select("rep_a", "rep_b")
    both = met.join(sets.select(F.col("id").alias("rep_a"), F.col("grams").alias("ga")), "rep_a").join(sets.select(F.col("id").alias("rep_b"), F.col("grams").alias("gb")), "rep_b")
    shared = both.select("rep_a", "rep_b", F.size(F.array_intersect("ga", "gb")).alias("both"), (F.size("ga") + F.size("gb")).alias("either"))
    links = shared.select("rep_a", "rep_b", (F.col("both") / (F.col("either") - F.col("both"))).alias("similarity")).where(F.col("similarity") >= threshold)
    return NearDuplicates(members, written(links, "neardup-links"))


def function_texts(functions: DataFrame) -> DataFrame:
    """(id, text): signature, a blank, body; a null part is empty."""
    return functions.select("id", F.concat(F.coalesce("signature", F.lit("")), F.lit(" "), F.coalesce("body", F.lit(""))).alias("text"))

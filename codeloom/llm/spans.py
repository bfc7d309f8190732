"""Long exact spans that records share, found through compact windows.

Tokens are the q-grams at every character position. A compact window is a node of the Cartesian tree over a record's token
hashes: all stretches around one token that is their least. For verbatim spans only its stretches of the shortest length that
counts, w tokens, are needed, as a longer span is a run of such. They begin at neighbouring places, so they are read off a
sliding minimum of width w, without building the tree: the rows are those that the tree's nodes, cut to length w, would give
(these are also known as minimiser windows). Every stretch of w tokens lies in exactly one window. Equal stretches have equal
minima at equal places, so they lie in windows that share their key. For verbatim spans one hash function finds every match,
more would only add rows; near-duplicate passages, for which the whole nodes and several hashes would be needed, aren't looked
for. The interval join of windows with equal keys needs no pairs either, as a character is shared as soon as its stretch has
two owners:

1. Windows whose key only one record has are left out; that is most of them.
2. Of the rest, a window content (by hash) with two owners is shared altogether.
3. Where a key has several contents, one holder of each content gives its characters, and every stretch of them that has
   two owners is shared (the verification by interval; one row per distinct content, however many records repeat it).
   Keys with up to `KEY_CONTENTS` contents are verified together; the stretches of larger keys are shuffled one by one. Both
   ways are exact.
4. Shared stretches go back to all windows with their content and are merged per record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import textvec as tv

#: Longer grams than boilerplate lines keep unlike windows out of one group; at most min_len.
QGRAM = 48
KEY_CONTENTS = 256
_WINDOWS = "rec long, key long, content long, first int, last int"


def _characters(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, code points, offsets) of parts of a batch."""
    raw, offsets = tv.utf8(batch.column(1))
    for low, high in tv.chunks(offsets):
        part = raw[offsets[low] : offsets[high]]
        is_start = (part & 0xC0) != 0x80
        before = np.concatenate(([0], np.cumsum(is_start)))
        chars = np.frombuffer(part.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        yield np.arange(low, high), chars, before[offsets[low : high + 1] - offsets[low]]


def _prefix(chars: np.ndarray) -> np.ndarray:
    return tv.prefix_hashes(tv.mixed(chars.astype(tv.U64) + tv.U64(1)))


def _compact_windows(min_len: int):
    """Arrow batches (rec, text) -> the compact windows of each record.

    `first` and `last` are the first positions of the earliest and latest stretch in the window.
    """
    gram = min(QGRAM, min_len)
    width = min_len - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recs = np.asarray(batch.column(0))
            for rows, chars, offsets in _characters(batch):
                if len(chars) < min_len:
                    continue
                prefix = _prefix(chars)
                at = np.arange(len(chars) - gram + 1)
                grams = tv.span_hashes(prefix, at, at + gram)
                place_bits = max(24, int(len(grams)).bit_length())
                packed = (grams >> tv.U64(place_bits) << tv.U64(place_bits)) | at.astype(tv.U64)
                pivot = (tv.sliding_minimum(packed, width) & tv.U64((1 << place_bits) - 1)).astype(np.int64)
                row = np.searchsorted(offsets, np.arange(len(pivot)), side="right") - 1
                whole = np.arange(len(pivot)) + min_len <= offsets[row + 1]
                starts = np.flatnonzero(whole)
                if not len(starts):
                    continue
                new = np.concatenate(([True], (pivot[starts[1:]] != pivot[starts[:-1]]) | (row[starts[1:]] != row[starts[:-1]]) | (np.diff(starts) != 1)))
                first = starts[new]
                last = np.append(starts[np.flatnonzero(new)[1:] - 1], starts[-1])
                owner, p = row[first], pivot[first]
                key = grams[p]
                content = tv.mixed(tv.span_hashes(prefix, first, last + min_len) + (p - first).astype(tv.U64))
                base = offsets[owner]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(recs[rows[owner]]), pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32))],
                    ["rec", "key", "content", "first", "last"],
                )

    return run


def _contexts(min_len: int):
    """Arrow batches (rec, text, windows) -> one row per listed window with the characters of all its stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            at, flat = np.asarray(lists.offsets), lists.values
            texts = batch.column(1).to_pylist()
            first, last = (np.asarray(flat.field(n)).tolist() for n in ("first", "last"))
            parts = [texts[i][first[j] : last[j] + min_len] for i in range(len(texts)) for j in range(at[i], at[i + 1])]
            kept = slice(int(at[0]), int(at[-1]))
            columns = [flat.field(n)[kept] for n in ("key", "content", "low", "high", "n")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(parts, pa.string())], ["key", "content", "low", "high", "n", "chars"])

    return run


def _stretch_hashes(batch: pa.RecordBatch, min_len: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, step, hash) of every stretch of the contexts in column 1."""
    for rows, chars, offsets in _characters(batch):
        prefix = _prefix(chars)
        counts = np.diff(offsets) - min_len + 1
        row = np.repeat(np.arange(len(counts)), counts)
        step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = offsets[row] + step
        yield rows[row], step, tv.span_hashes(prefix, begin, begin + min_len)


_SHARED = "key long, content long, run_from int, run_to int"


def _verified(min_len: int):
    """Arrow batches (key, chars, content, low, high), sorted by key -> runs of shared stretches of contents with one owner."""

    def shared(table: pa.Table) -> pa.RecordBatch:
        batch = table.combine_chunks().to_batches()[0]
        key, content, low, high = (np.asarray(batch.column(i)) for i in (0, 2, 3, 4))
        parts = list(_stretch_hashes(batch, min_len))
        row, step, stretch = (np.concatenate([p[i] for p in parts]) for i in range(3))
        stretch = tv.mixed(stretch + key[row].astype(np.int64).view(tv.U64) * tv._MULT)
        _, group = np.unique(stretch, return_inverse=True)
        order = np.argsort(group, kind="stable")
        _, starts = tv.row_starts(group[order])
        several = np.minimum.reduceat(low[row][order], starts) < np.maximum.reduceat(high[row][order], starts)
        hit = several[group] & (low == high)[row]
        row, step = row[hit], step[hit]
        if len(row):
            new = np.concatenate(([True], (row[1:] != row[:-1]) | (step[1:] != step[:-1] + 1)))
        else:
            new = np.zeros(0, bool)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(row))[: len(begin)] - 1
        owner = row[begin]
        return pa.RecordBatch.from_arrays(
            [pa.array(key[owner]), pa.array(content[owner]), pa.array(step[begin].astype(np.int32)), pa.array(step[end].astype(np.int32))], ["key", "content", "run_from", "run_to"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            keys = np.asarray(table.column(0).combine_chunks())
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            rest = table.slice(cut)
            if cut:
                yield shared(table.slice(0, cut))
        if rest is not None:
            yield shared(rest)

    return run


def _stretches(min_len: int):
    """Arrow batches (key, chars, content, low, high) -> one row per stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, step, stretch in _stretch_hashes(batch, min_len):
                columns = [batch.column(i).take(pa.array(row)) for i in (0, 2, 3, 4)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(step.astype(np.int32)), pa.array(stretch.view(np.int64))], ["key", "content", "low", "high", "step", "stretch"])

    return run


def _runs(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Runs of consecutive `at` per key: keys, run_from, run_to."""
    w = Window.partitionBy(*keys).orderBy(at)
    return (
        df.withColumn("_run", F.col(at) - F.row_number().over(w)).groupBy(*keys, "_run").agg(F.min(at).alias("run_from"), F.max(at).alias("run_to")).drop("_run")
    )


def shared_spans(records: DataFrame, rec_col: str, text_col: str, min_len: int = 120) -> DataFrame:
    """(rec, span_start, span_len): the maximal runs of characters that lie in a stretch of at least `min_len` characters
    which occurs verbatim in another record.

    `rec` is a long that names the record; rows that repeat it are the same record and must carry the same text. Positions
    count code points from 0. Null and short texts share nothing; an empty table gives an empty result; texts of any length
    are taken whole; repeats within one record alone don't count; other columns are ignored.
    """
    texts = records.select(F.col(rec_col).cast("long").alias("rec"), F.col(text_col).alias("text")).where(F.col("rec").isNotNull() & (F.length("text") >= min_len))
    windows = written(texts.mapInArrow(_compact_windows(min_len), _WINDOWS), "spans-windows")
    several = windows.groupBy("key").agg(F.min("rec").alias("a"), F.max("rec").alias("b")).where("a < b").select("key")
    windows = written(windows.join(several, "key", "left_semi"), "spans-met")
    contents = windows.groupBy("key", "content").agg(F.min("rec").alias("low"), F.max("rec").alias("high"), F.min(F.struct("rec", "first", "last")).alias("holder"))
    contents = written(contents.select("key", "content", "low", "high", "holder.*"), "spans-contents")
    equal = contents.where("low < high").select("key", "content", F.lit(0).alias("run_from"), (F.col("last") - F.col("first")).alias("run_to"))
    numbers = contents.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    held = contents.join(numbers, "key").groupBy("rec").agg(F.collect_list(F.struct("key", "content", "low", "high", "n", "first", "last")).alias("windows"))
    unclear = texts.dropDuplicates(["rec"]).join(held, "rec").select("rec", "text", "windows").mapInArrow(_contexts(min_len), "key long, content long, low long, high long, n long, chars string")
    unclear = written(unclear, "spans-contexts").select("key", "chars", "content", "low", "high", "n")
    few = unclear.where(F.col("n") <= KEY_CONTENTS).drop("n").repartition("key").sortWithinPartitions("key")
    partly = few.mapInArrow(_verified(min_len), _SHARED)
    many = unclear.where(F.col("n") > KEY_CONTENTS).drop("n")
    if not many.isEmpty():
        cut = written(many.mapInArrow(_stretches(min_len), "key long, content long, low long, high long, step int, stretch long"), "spans-stretches")
        owned = cut.groupBy("key", "stretch").agg(F.min("low").alias("a"), F.max("high").alias("b")).where("a < b").select("key", "stretch")
        hits = cut.where("low = high").join(owned, ["key", "stretch"], "left_semi").select("key", "content", "step").distinct()
        partly = partly.unionByName(_runs(hits, ["key", "content"], "step"))
    shared = equal.unionByName(partly)
    spans = windows.join(shared, ["key", "content"]).select(
        "rec", (F.col("first") + F.col("run_from")).cast("long").alias("s"), (F.col("first") + F.col("run_to") + min_len).cast("long").alias("e")
    )
    w = Window.partitionBy("rec").orderBy("s", "e")
    starts = spans.withColumn("reach", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    grouped = starts.withColumn("run", F.sum(F.when(F.col("reach") >= F.col("s"), 0).otherwise(1)).over(w))
    merged = grouped.groupBy("rec", "run").agg(F.min("s").alias("span_start"), F.max("e").alias("e"))
    return merged.select("rec", "span_start", (F.col("e") - F.col("span_start")).alias("span_len"))


def shared_amount(records: DataFrame, spans: DataFrame, rec_col: str, text_col: str) -> DataFrame:
    """(rec, n_chars, shared_chars, shared_share): how much of each record is shared elsewhere; 0 where nothing is."""
    sizes = records.select(F.col(rec_col).cast("long").alias("rec"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n_chars")).where("rec IS NOT NULL").dropDuplicates(["rec"])
    per_rec = spans.groupBy("rec").agg(F.sum("span_len").alias("shared_chars"))
    out = sizes.join(per_rec, "rec", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0).cast("long")))
    return out.withColumn("shared_share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(F.lit(0.0)))


def code_records(functions: DataFrame, routes: DataFrame) -> DataFrame:
    """(rec, text) of functions.body and routes.handler_body; rec is 2 * id, plus 1 for a route."""
    a = functions.select((F.col("id") * 2).alias("rec"), F.col("body").alias("text"))
    return a.unionByName(routes.select((F.col("id") * 2 + 1).alias("rec"), F.col("handler_body").alias("text")))


def named_records(spans: DataFrame) -> DataFrame:
    """Spans with record_kind and record_id instead of the `rec` of `code_records`."""
    kind = F.when(F.col("rec") % 2 == 0, "function").otherwise("route").alias("record_kind")
    return spans.select(kind, F.floor(F.col("rec") / 2).cast("long").alias("record_id"), *[c for c in spans.columns if c != "rec"])

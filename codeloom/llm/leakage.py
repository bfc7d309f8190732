"""Evaluation texts that leak into training text.

Every run of `n` words of an item contains one of the item's blocks of m = (n + 1) // 2 words that begin at multiples of m.
These blocks, as sequences of word codes, are the patterns of an Aho-Corasick automaton: three trie nodes per word of an item,
not n words' characters. A document is normalised and scanned once; where a block is met, the match is followed to both sides, and counts
when it reaches n words. Offsets are mapped back to the original text.

Workers read the items from the shared folder, never the driver, and keep the automaton as long as their process lives. Items
of more than `block_words` words are cut into blocks of whole items, one automaton each. The documents are then not scanned
once per block: they and the items are first joined on the least of each n - m + 1 neighbouring m-word hashes (equal runs of n
words have equal ones), and a document goes only to the automata of the blocks that it meets there.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_path, ship, written
from . import textvec as tv

_WORD = re.compile(r"[^\W_]+")
_HIT_TYPE = "doc_id long, item_id long, char_start long, char_len long"


def words(text: str) -> list[str]:
    """Maximal runs of Unicode letters and digits of the lower-cased text."""
    return _WORD.findall(text.lower())


def _offsets(text: str) -> list[tuple[int, int]]:
    """(start, end) in the original text of every word of its normalised form."""
    low, back = "", list(range(len(text) + 1))
    if len(text.lower()) != len(text):  # a character may have a longer lower-case form
        back = [i for i, c in enumerate(text) for _ in c.lower()] + [len(text)]
        low = "".join(c.lower() for c in text)
    else:
        low = text.lower()
    return [(back[m.start()], back[m.end() - 1] + 1) for m in _WORD.finditer(low)]


#: A word's code has one character of each of three alphabets, so that no node of the automaton has many children and no
#: match begins within a word. Words that no item has share a code of their own.
_DIGITS, _OTHER = 128, "\0\0\0"


def _code(number: int) -> str:
    return chr(1 + number % _DIGITS) + chr(1 + _DIGITS + number // _DIGITS % _DIGITS) + chr(1 + 2 * _DIGITS + number // _DIGITS**2)


class Passages:
    """The automaton of a block of items."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n, self.m = n, (n + 1) // 2
        self.codes: dict[str, str] = {}
        self.ids: list[int] = []
        self.flat: list[str] = []  # the items' codes one after another, each item ended by an empty one
        self.starts: list[int] = []
        places: dict[str, list[int]] = {}
        for item_id, text in items:
            w = words(text)
            if len(w) >= n:
                self.ids.append(item_id)
                self.starts.append(len(self.flat))
                coded = [self.codes.get(x) or self.codes.setdefault(x, _code(len(self.codes))) for x in w]
                for at in range(0, len(w) - self.m + 1, self.m):
                    places.setdefault("".join(coded[at : at + self.m]), []).append(len(self.flat) + at)
                self.flat += [*coded, ""]
        self.found = ahocorasick.Automaton()
        for pattern, at in places.items():
            self.found.add_word(pattern, at)
        if places:
            self.found.make_automaton()

    def runs(self, text: str) -> dict[int, list[list[int]]]:
        """Per item the (first word, end) of the merged passages of `text` that repeat n or more of its words."""
        known, flat, m = self.codes.get, self.flat, self.m
        seen = [known(w, _OTHER) for w in words(text)] if self.ids else []
        reach: dict[int, int] = {}  # by the distance of a match's places in item and document: where it ends
        out: dict[int, list[list[int]]] = {}
        for end, places in self.found.iter("".join(seen)) if len(seen) >= self.n else ():
            at = end // 3 - m + 1
            for place in places:
                if reach.get(place - at, -1) >= at + m:
                    continue
                low, high = at, at + m
                while low and seen[low - 1] == flat[place - (at - low) - 1]:
                    low -= 1
                while high < len(seen) and seen[high] == flat[place + high - at]:
                    high += 1
                reach[place - at] = high
                if high - low >= self.n:
                    out.setdefault(self.ids[bisect_right(self.starts, place) - 1], []).append([low, high])
        for item, spans in out.items():
            merged: list[list[int]] = []
            for low, high in sorted(spans):
                if merged and low <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], high)
                else:
                    merged.append([low, high])
            out[item] = merged
        return out


_KEPT: dict[tuple, Passages] = {}


def _passages(folder: str, block: int, n: int) -> Passages:
    """The automaton of a block, built once per process; the last one is kept."""
    key = (folder, block, n)
    if key not in _KEPT:
        _KEPT.clear()
        files, path = fs.FileSystem.from_uri(f"{folder}/block={block}")
        table = pq.ParquetDataset(path, filesystem=files, partitioning=None).read(["item_id", "text"])
        _KEPT[key] = Passages(sorted(zip(*(table.column(c).to_pylist() for c in ("item_id", "text")))), n)
    return _KEPT[key]


def _scan(folder: str, n: int):
    """Arrow batches (block, doc_id, text) -> passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[], [], [], []]
            for block, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = _passages(folder, block, n).runs(text)
                where = _offsets(text) if found else []
                for item, runs in found.items():
                    for first, last in runs:
                        for column, value in zip(out, (doc_id, item, where[first][0], where[last - 1][1] - where[first][0])):
                            column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "item_id", "char_start", "char_len"])

    return run


def _marks(n: int):
    """Arrow batches (id, text) -> the distinct hashes by which runs of n words are known: of each window the least m-word hash."""
    m = (n + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list[np.ndarray] = []
            marks: list[np.ndarray] = []
            for rec, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words(text)
                if len(w) >= n:
                    hashes = np.array([xxhash.xxh64_intdigest(x) for x in w], tv.U64)
                    least = np.unique(tv.sliding_minimum(tv.shingles(hashes, np.zeros(len(w), np.int64), m)[0], n - m + 1))
                    ids.append(np.full(len(least), rec))
                    marks.append(least.view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(marks))], ["id", "mark"])

    return run


def leaked_passages(documents: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_cols: list[str], n: int = 13, block_words: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, char_start, char_len): the passages of documents that repeat `n` or more consecutive words of an item.

    An item's words are those of its text columns joined by a blank. Null and empty texts hold nothing, items of fewer than
    `n` words can't leak; repeated documents or items give repeated rows only where their ids differ; empty tables give an
    empty result; other columns are ignored. `block_words` bounds the items of one automaton (about 400 bytes a word; up to two million words).
    """
    spark = documents.sparkSession
    ship(spark)
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    joined = items.select(F.col(item_col).cast("long").alias("item_id"), F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in item_text_cols]).alias("text"))
    joined = joined.where("item_id IS NOT NULL").distinct()
    size = joined.agg(F.sum(F.size(F.split("text", r"[^\p{L}\p{N}]+")))).first()[0] or 0
    if not size:
        return spark.createDataFrame([], _HIT_TYPE)
    blocks = -(-size // block_words)
    folder = shared_path(spark, "leakage-items")
    placed = joined.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    placed.write.partitionBy("block").parquet(folder)
    if blocks == 1:
        return texts.select(F.lit(0).alias("block"), "doc_id", "text").mapInArrow(_scan(folder, n), _HIT_TYPE).distinct()
    wanted = spark.read.schema("item_id long, text string, block int").parquet(folder)
    marks = wanted.select(F.col("block").cast("long").alias("block"), "text").mapInArrow(_marks(n), "id long, mark long").distinct()
    met = texts.mapInArrow(_marks(n), "id long, mark long").join(marks.select(F.col("id").cast("int").alias("block"), "mark"), "mark")
    met = met.select(F.col("id").alias("doc_id"), "block").distinct()
    met = written(met, "leakage-met")
    # documents of one block come together, so that a process builds few automata; a block that many meet is spread
    sent = texts.join(met, "doc_id").select("block", "doc_id", "text").repartitionByRange("block", "doc_id").sortWithinPartitions("block")
    return sent.mapInArrow(_scan(folder, n), _HIT_TYPE).distinct()

"""Keyword-stuffed and link-list pages.

Three kinds of evidence are joined. Phrases: the whole texts of all pages are exploded into k-word phrase shingles, and the
distinct hosts of each (a source and package here) say how much of a page is replicated on other hosts and how much of that one
other page alone could have given. List density: the words of a page that stand in lines which are nothing but links, tags,
counted labels or product entries. Stuffing: a sentence is stuffed when it repeats one of the page's own repeated word pairs.

Pages are read in blocks. A block sends each of its distinct phrases on once, with the least and the greatest host that have it
there, so a phrase that a third of all pages hold gives one entry per block, not one per page. The answers come back per block.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

_WORD = re.compile(r"[^\W_]+")
_URL = r"(?:https?://|www\.)[^\s<>\"')\]]+"
# no alternative runs over the start of another anchor, so a line is searched in linear time whatever it holds
_ANCHOR = re.compile(rf"\[[^\[\]\n]*\]\(\s*{_URL}\s*\)|<a\b[^<>]*>[^<]*(?:<(?!/?a\b)[^<]*)*</a>|<\s*{_URL}\s*>|{_URL}", re.I)
_GLUE = re.compile(r"(?:[\s\-*+•|,;·»>:]|\d+[.)]|</?(?:li|ul|ol|p|div|span|br|td|tr|nav)\b[^<>]*>)*", re.I)
_TAGS = re.compile(r"\s*(?:#[^\W_][\w-]*[\s,;|]*)+")
_COUNTED = re.compile(r"\s*[-*•]?\s*(?:[^\W\d_][^\W_]*(?:[ -][^\W_]+){0,3}\s*\(\d+\)[\s,;|·]*)+")
_PRICE = r"(?:(?<!\d)\d[\d.,]{0,15}\s?(?:USD|EUR|GBP|CHF|[$€£])|(?:USD|EUR|GBP|CHF|[$€£])\s?\d[\d.,]{0,15})(?![\w])"
_PRODUCT = re.compile(rf"^(?=.*{_PRICE})(?!.*[.!?]\s*$)(?:\S+\s+){{2,14}}\S+\s*$")
#: A short entry that ends or begins with an address and isn't a sentence.
_ENTRY = re.compile(rf"(?:\s*(?:\S+\s+){{1,14}}{_URL}|\s*{_URL}(?:\s+\S+){{1,13}}\s+\S*[^\s.!?])\s*", re.I)
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")


def _links(line: str) -> int:
    """How many links a line holds if it is nothing but links and what separates them."""
    rest, n = _ANCHOR.subn(" ", line)
    return n if n and _GLUE.fullmatch(rest) else 0


_MONEY = re.compile(r"USD|EUR|GBP|CHF|[$€£]")


def _items(line: str) -> int:
    """How many list items a line holds if it is nothing but such; 0 for other lines. What a pattern needs is looked for first."""
    low = line.lower()
    address = "http" in low or "www." in low
    if (address or "<a" in low) and (found := _links(line)):
        return found
    if "#" in line and _TAGS.fullmatch(line):
        return line.count("#")
    if "(" in line and _COUNTED.fullmatch(line):
        return line.count("(")
    return 1 if (_MONEY.search(line) and _PRODUCT.match(line)) or (address and _ENTRY.fullmatch(line)) else 0


def _keyword_pairs(words: list[str]) -> tuple[set[tuple[str, str]], set[tuple[str, str]]]:
    """Word pairs that the page repeats so often that they may be its keywords, and those that alone are a third of its words.

    The first bar is the same for pages of any length.
    """
    counts = {p: n for p, n in Counter(zip(words, words[1:])).items() if n >= 4}
    return set(counts), {p for p, n in counts.items() if 6 * n >= len(words) and p[0].isalpha() and p[1].isalpha() and p[0] != p[1]}


def page_evidence(text: str) -> tuple[int, int, int, list[str]]:
    """(words in list lines, list items, words in stuffed sentences, words) of one page.

    A sentence is stuffed when it holds one of the page's repeated word pairs twice or more, or one that alone is a third of
    the page's words.
    """
    words = _WORD.findall(text.lower())
    pairs, dense = _keyword_pairs(words)
    n_list = n_items = stuffed = 0
    for line in text.split("\n"):
        line = " ".join(line.split())
        found = _items(line) if line else 0
        if found:
            n_list += len(_WORD.findall(line))
            n_items += found
            continue
        for sentence in _SENTENCE.findall(line.lower()) if pairs else ():
            w = _WORD.findall(sentence)
            inside = Counter(p for p in zip(w, w[1:]) if p in pairs)
            if any(n > 1 or p in dense for p, n in inside.items()):
                stuffed += len(w)
    return n_list, n_items, stuffed, words


def _phrases(texts: list[list[str]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every distinct k-word phrase of each text, in order of the hash."""
    known: dict[str, int] = {}
    flat = [known[w] if w in known else known.setdefault(w, xxhash.xxh64_intdigest(w)) for words in texts for w in words]
    grams, rows = tv.shingles(np.array(flat, tv.U64), np.repeat(np.arange(len(texts)), [len(words) for words in texts]), k)
    order = np.lexsort((rows, grams))
    grams, rows = grams[order], rows[order]
    if len(rows):
        new = np.concatenate(([True], (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])))
        grams, rows = grams[new], rows[new]
    return grams, rows


#: Pages of a block, and slots that the pages which hold a page's copied phrases are counted in.
BLOCK, SLOTS = 4096, 9
_BLOCKS = "bucket int, block long, phrases binary, holders binary, hosts binary"
_ANSWERS = "block long, holders binary, slots binary, pages binary, members binary, given binary"
_SCORED = "doc_id long, n_words long, list_words long, list_items long, stuffed_words long, n_phrases long, copied_share double, one_source_share double"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _planes(values: np.ndarray, width: int) -> bytes:
    """The lower `width` bytes of each value, all first bytes before all second ones: sorted values compress that way."""
    return np.ascontiguousarray(np.ascontiguousarray(values.astype(np.int64)).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(packed: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((sum(map(len, packed)) // width, 8), np.uint8)
    out[:, :width] = np.concatenate([np.frombuffer(x, np.uint8).reshape(width, -1).T for x in packed]) if packed else 0
    return out.view(np.int64)[:, 0]


def _slot(block: np.ndarray, page: np.ndarray) -> np.ndarray:
    return (tv.mixed(block.astype(tv.U64) * tv.U64(65537) + page.astype(tv.U64)) % tv.U64(SLOTS)).astype(np.int64)


def _runs(first: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(first, n))


def _blocks(k: int, buckets: int):
    """Arrow batches (doc_id, host, text) -> the phrases of blocks of pages: one row per block and bucket, and one with the pages.

    An entry is a distinct phrase of the block: its lower 48 bits (the upper 16 give the bucket), its holder (a page's place, or
    BLOCK and more for a group of several pages) and its least and greatest host. Phrases that two hosts of the block have are
    counted at once and need no answer (holder -1). The row of the pages has a negative bucket: evidence per page, groups and counts.
    """

    def packed(block: int, part: pa.RecordBatch) -> pa.RecordBatch:
        n = part.num_rows
        seen = [page_evidence(text) for text in part.column(2).to_pylist()]
        grams, rows = _phrases([x[3] for x in seen], k)
        evidence = np.array([[len(x[3]), *x[:3]] for x in seen], np.int64).reshape(n, 4)
        pages = np.column_stack([part.column(0).to_numpy(), evidence, np.bincount(rows, minlength=n)])
        host = (part.column(1).to_numpy() & 0xFFFFFF)[rows]
        order = np.lexsort((host, grams))
        grams, rows, host = grams[order], rows[order], host[order]
        first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, np.int64)
        sizes = _runs(first, len(grams))
        low, high = host[first], host[first + sizes - 1]
        both, several = low != high, (low == high) & (sizes > 1)
        run = np.repeat(np.arange(len(first)), sizes)
        other = np.where(low[run] != host, first[run], first[run] + sizes[run] - 1)[both[run]]
        given = np.bincount(rows[both[run]] * SLOTS + _slot(np.full(len(other), block), rows[other]), minlength=n * SLOTS)
        groups = np.cumsum(several) - 1
        holder = np.where(both, -1, np.where(several, BLOCK + groups, rows[first]))
        inside = several[run]
        members = groups[run][inside] << 16 | rows[inside]
        bucket = (grams[first] >> tv.U64(48)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        names, at = tv.row_starts(bucket[order])
        cuts = [order[a:b] for a, b in zip(at, np.append(at[1:], len(order)))]
        phrases = [_planes(grams[first[c]].view(np.int64), 6) for c in cuts]
        hosts = [_planes(low[c] | (low[c] ^ high[c]) << 24, 6) for c in cuts]
        columns = [
            pa.array([*names.tolist(), -1 - int(tv.mixed(np.array([block], tv.U64))[0] % tv.U64(buckets))], pa.int32()), pa.array([block] * (len(cuts) + 1), pa.int64()), pa.array([*phrases, pages.astype(np.int64).tobytes()], pa.binary()),
            pa.array([*(_planes(holder[c], 3) for c in cuts), _planes(members, 5)], pa.binary()), pa.array([*hosts, given.astype(np.int64).tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, _names(_BLOCKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                yield packed(block, batch.slice(low, BLOCK))
                block += 1

    return run


def _answers(key: tuple, blocks: pa.Table) -> pa.Table:
    """The entries of one bucket -> per block the holders of phrases that another host has, each with the slot of a page that has it.

    Rows of pages pass through.
    """
    if key[0].as_py() < 0:
        none = pa.nulls(blocks.num_rows, pa.binary())
        return pa.table([blocks.column("block"), none, none, *(blocks.column(c) for c in ("phrases", "holders", "hosts"))], names=_names(_ANSWERS))
    at, holders = blocks.column("block").to_numpy(), blocks.column("holders").to_pylist()
    n = [len(x) // 3 for x in holders]
    grams, holder, hosts = _from_planes(blocks.column("phrases").to_pylist(), 6), _from_planes(holders, 3), _from_planes(blocks.column("hosts").to_pylist(), 6)
    block, low = np.repeat(np.arange(len(n)), n), hosts & 0xFFFFFF
    high = low ^ (hosts >> 24)
    order = np.lexsort((low, grams))
    grams, holder, block, low, high = (x[order] for x in (grams, holder, block, low, high))
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    run = np.repeat(np.arange(len(first)), _runs(first, len(grams)))
    top = np.lexsort((high, run))  # the last of each run has its greatest host
    top = top[np.append(first[1:], len(grams)) - 1][run]
    other = np.where(low[first][run] != low, first[run], top)  # an entry with another host, if the phrase has one
    asks = (holder != 0xFFFFFF) & ((low[other] != low) | (high[other] != low))
    slot = _slot(at[block[other]], holder[other])[asks]
    holder, block = holder[asks], block[asks]
    order = np.argsort(block, kind="stable")
    names, start = tv.row_starts(block[order])
    cuts = [order[a:b] for a, b in zip(start, np.append(start[1:], len(order)))]
    none = pa.nulls(len(cuts), pa.binary())
    return pa.table([pa.array(at[names]), pa.array([_planes(holder[c], 3) for c in cuts], pa.binary()), pa.array([slot[c].astype(np.uint8).tobytes() for c in cuts], pa.binary()), none, none, none], names=_names(_ANSWERS))


def _scored(key: tuple, rows: pa.Table) -> pa.Table:
    """The answers to one block and the row of its pages -> evidence per page."""
    known = {c: next(x for x in rows.column(c).to_pylist() if x is not None) for c in ("pages", "members", "given")}
    pages = np.frombuffer(known["pages"], np.int64).reshape(-1, 6)
    members = _from_planes([known["members"]], 5)
    group, member = members >> 16, members & 0xFFFF
    holders = [x for x in rows.column("holders").to_pylist() if x is not None]
    slots = np.frombuffer(b"".join(x for x in rows.column("slots").to_pylist() if x is not None), np.uint8).astype(np.int64)
    holder = _from_planes(holders, 3)
    counts = np.frombuffer(known["given"], np.int64) + np.bincount((holder * SLOTS + slots)[holder < BLOCK], minlength=len(pages) * SLOTS)
    answered = np.full(int(group.max(initial=-1)) + 1, -1)
    answered[holder[holder >= BLOCK] - BLOCK] = slots[holder >= BLOCK]
    hit = answered[group]
    counts = counts + np.bincount((member * SLOTS + hit)[hit >= 0], minlength=len(pages) * SLOTS)
    counts = counts.reshape(-1, SLOTS)
    copied = counts.sum(axis=1)
    shares = [copied / np.maximum(pages[:, 5], 1), counts.max(axis=1, initial=0) / np.maximum(copied, 1)]
    return pa.table([*(pa.array(pages[:, i]) for i in range(6)), *map(pa.array, shares)], names=_names(_SCORED))


def page_spam_evidence(documents: DataFrame, id_col: str, text_col: str, host_cols: list[str], k: int = 5, min_items: int = 10, only_list: float = 0.8) -> DataFrame:
    """(doc_id, n_words, spam_words, n_phrases, copied_share, one_source_share): evidence for every page with words.

    spam_words are the words of stuffed sentences and of list lines; lists of fewer than `min_items` items count when they are
    `only_list` of the page's words, as an ordinary short page may end in links that are more than half of its words.
    copied_share is the part of the distinct k-word phrases of the whole text that another host has too; one_source_share is
    the largest part of these that falls to one slot of the pages that have them: near 1 for a mirror of one page. A repeated
    id is one page; null and empty texts have no evidence; an empty table gives an empty result; other columns are ignored.
    """
    pages = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(*[F.coalesce(F.lower(F.trim(F.col(c).cast("string"))), F.lit("")) for c in host_cols]).alias("host"), F.col(text_col).alias("text"))
    pages = pages.where("doc_id IS NOT NULL AND text IS NOT NULL")
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * parts, min(32 * parts, 2048))  # many for each task, so that tasks get even parts
    answers = pages.mapInArrow(_blocks(k, buckets), _BLOCKS).groupBy("bucket").applyInArrow(_answers, _ANSWERS)
    scored = answers.groupBy("block").applyInArrow(_scored, _SCORED).where("n_words > 0").dropDuplicates(["doc_id"])
    spam = F.col("stuffed_words") + F.when((F.col("list_items") >= min_items) | (F.col("list_words") >= only_list * F.col("n_words")), F.col("list_words")).otherwise(0)
    return scored.select("doc_id", "n_words", spam.alias("spam_words"), "n_phrases", "copied_share", "one_source_share")


def spam_pages(
    evidence: DataFrame, min_share: float = 0.5, min_replicated: float = 0.25, clear_share: float = 0.7, min_copied: float = 0.9, max_one_source: float = 0.4, min_phrases: int = 50
) -> DataFrame:
    """Pages most of whose words are list items or stuffed sentences, joined with their phrases being replicated on other hosts,
    and pages stitched from phrases of several pages of other hosts.

    From `clear_share` on the words alone decide: a page may be the first of its kind in the collection. Copied phrases alone
    decide from `min_copied` on, unless one page alone may have given most of them: then the page is a mirror.
    """
    share = F.col("spam_words") / F.col("n_words")
    stitched = (F.col("n_phrases") >= min_phrases) & (F.col("copied_share") >= min_copied) & (F.col("one_source_share") <= max_one_source)
    return evidence.where(((share > min_share) & ((F.col("copied_share") >= min_replicated) | (share >= clear_share))) | stitched)

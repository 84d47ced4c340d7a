"""Benchmark decontamination: rare n-gram seeds find where a test item may stand, Smith-Waterman scores the place.

Texts and items become words by lower-casing A-Z and taking ASCII punctuation as blanks.  The corpus frequency of every
item n-gram is counted over all documents; an item's seeds are its rarest n-grams (``seed_share`` of them, four at
least).  Seeds of one item that hit a text near one diagonal mark a window, and a local alignment over words (match
2, mismatch -1, gap -1) of item and window is scored as a share of the item's perfect score.  So copies, and copies with
words replaced, added or left out, are found as long as ``least_seeds`` seeds survive.

The benchmark goes to the tasks in blocks of at most ``block_bytes`` of text, two passes over the documents each; one block's
index at a time is on the driver, and the documents are never shuffled.

Defined results: null texts and items, and items of fewer than ``n`` words, match nothing; repeated document rows give
repeated matches; repeated items match each; empty tables give an empty result; extra columns are left out, or kept
by ``keep_clean``.  The score of a document that holds an item twice is that of the better place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import as_bytes, id_text, mix, pieces

BLANKED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
MATCH, MISS, GAP = 2, -1, -1


def words_of(text: bytes) -> list[bytes]:
    return text.translate(BLANKED).split()


class Index:
    """The n-grams of a block of items, and the seeds among them once chosen."""

    def __init__(self, items: list[tuple[object, bytes]], n: int):
        self.n, self.ids = n, [i for i, _ in items]
        self.place: dict[bytes, int] = {}
        self.items = [np.array([self.place.setdefault(w, len(self.place)) for w in words_of(t)], np.int64) for _, t in items]
        keys, item, at = [], [], []
        for i, words in enumerate(self.items):
            k = self.grams(words)
            keys.append(k)
            item.append(np.full(len(k), i))
            at.append(np.arange(len(k)))
        keys, item, at = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (keys, item, at))
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.at = keys[order], item[order], at[order]
        self.distinct = np.unique(keys)

    def grams(self, words: np.ndarray) -> np.ndarray:
        """Keys of the n-grams, 62-bit digests; negative where a word is in no item.  Two that fall together make a false seed, no match."""
        m = len(words) - self.n + 1
        if m <= 0:
            return np.zeros(0, np.int64)
        key, known = np.zeros(m, np.uint64), np.ones(m, bool)
        for j in range(self.n):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + words[j : j + m].astype(np.uint64) + np.uint64(1))
            known &= words[j : j + m] >= 0
        return np.where(known, (key >> np.uint64(2)).astype(np.int64), -1)

    def encode(self, text: bytes) -> np.ndarray:
        get = self.place.get
        return np.array([get(w, -1) for w in words_of(text)], np.int64)

    def known(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of item n-grams in a text and their places in ``distinct``."""
        key = self.grams(words)
        at = np.flatnonzero(key >= 0)
        if not len(at) or not len(self.distinct):
            return at[:0], at[:0]
        found = np.minimum(np.searchsorted(self.distinct, key[at]), len(self.distinct) - 1)
        hit = self.distinct[found] == key[at]
        return at[hit], found[hit]

    def choose(self, frequency: np.ndarray, share: float, least: int = 4) -> None:
        """Keeps each item's rarest n-grams; ties go to the earlier place in the item."""
        often = frequency[np.searchsorted(self.distinct, self.keys)]
        order = np.lexsort((self.at, often, self.item))
        size = np.bincount(self.item, minlength=len(self.items))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
        wanted = np.maximum(np.ceil(size * share), least)[self.item[order]]
        kept = np.sort(order[rank < wanted])
        self.keys, self.item, self.at = self.keys[kept], self.item[kept], self.at[kept]
        self.seeds = np.bincount(self.item, minlength=len(self.items))

    def matches(self, text: bytes, least_seeds: int, least_score: float, slack: int) -> list[tuple[int, float, int, int, int]]:
        """(item, score, first word, end, seeds) of the items found in a text."""
        words = self.encode(text)
        at, found = self.known(words)
        if not len(at):
            return []
        key = self.distinct[found]
        low, high = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, side="right")
        n = high - low
        spot = np.repeat(at, n)
        entry = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, diagonal = self.item[entry], spot - self.at[entry]
        order = np.lexsort((diagonal, item))
        item, diagonal, seed = item[order], diagonal[order], self.at[entry][order]
        edges = np.flatnonzero((item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > slack)) + 1
        best: dict[int, tuple] = {}
        for a, b in zip([0, *edges], [*edges, len(item)]):
            if a == b:
                continue
            i, seeds = int(item[a]), len(np.unique(seed[a:b]))
            if seeds < min(least_seeds, self.seeds[i]):
                continue
            length = len(self.items[i])
            lo, hi = max(0, int(diagonal[a]) - slack), min(len(words), int(diagonal[b - 1]) + length + slack)
            for x in range(lo, hi, max(1, 8 * length)):  # a long chain of repeats is taken in overlapping windows
                y = min(hi, x + 8 * length + length + slack)
                score, first, end = align(self.items[i], words[x:y])
                got = (score / (MATCH * length), x + first, x + end, seeds)
                if got[0] >= least_score and got[0] > best.get(i, (0,))[0]:
                    best[i] = got
                if y == hi:
                    break
        return [(i, *best[i]) for i in sorted(best)]


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman over words: the best local score, and where its part of ``b`` starts and ends."""
    m = len(b)
    score, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
    places = np.arange(m + 1)
    top = (0, 0, 0)
    for x in a:
        diagonal = score[:-1] + np.where(b == x, MATCH, MISS)
        up = score[1:] + GAP
        value, origin = np.zeros(m + 1, np.int64), places.copy()
        better = (diagonal > 0) & (diagonal >= up)
        value[1:] = np.where(better, diagonal, np.maximum(up, 0))
        origin[1:] = np.where(better, start[:-1], np.where(up > 0, start[1:], places[1:]))
        lifted = value - GAP * places  # a gap in ``b`` costs the same at each step, so a running maximum spreads it
        best = np.maximum.accumulate(lifted)
        came = np.maximum.accumulate(np.where(lifted == best, places, 0))
        score, start = best + GAP * places, origin[came]
        j = int(np.argmax(score))
        if score[j] > top[0]:
            top = (int(score[j]), int(start[j]), j)
    return top


def indexes(docs: DataFrame, benchmark: DataFrame, n: int, seed_share: float, block_bytes: int, item_col: str, item_text: str) -> Iterator[Index]:
    """One index with chosen seeds for each block of the benchmark, made when it is asked for."""
    items = id_text(benchmark, item_col, item_text)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    for k in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("text", "doc_id"), F.lit(blocks)) == k).orderBy("doc_id", "text").collect()
        index = Index([(r["doc_id"], r["text"].encode()) for r in block], n)

        def count(batches, index=index):
            times = np.zeros(len(index.distinct), np.int64)
            for batch in pieces(batches):
                for text in as_bytes(batch.column("text")):
                    times += np.bincount(index.known(index.encode(text))[1], minlength=len(times)) if len(times) else 0
            at = np.flatnonzero(times)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(times[at])], ["gram", "times"])

        frequency = np.zeros(len(index.distinct), np.int64)
        for r in docs.mapInArrow(count, "gram bigint, times bigint").groupBy("gram").agg(F.sum("times").alias("times")).collect():  # as long as the block
            frequency[r["gram"]] = r["times"]
        index.choose(frequency, seed_share)
        yield index


def matches(docs: DataFrame, benchmark: DataFrame, n: int = 3, seed_share: float = 0.8, least_seeds: int = 2, least_score: float = 0.5, slack: int = 16, block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document row and item found in it: doc_id, item_id, score (0 to 1), n_seeds, first_word, end_word."""
    rows = id_text(docs, id_col, text_col)
    kind, item_type = rows.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    out = None
    for index in indexes(rows, benchmark, n, seed_share, block_bytes, item_col, item_text):
        shared = rows.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            index = shared.value
            for batch in pieces(batches):
                got = [(i, m) for i, text in enumerate(as_bytes(batch.column("text"))) for m in index.matches(text, least_seeds, least_score, slack)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array([i for i, _ in got], pa.int64())), pa.array([index.ids[m[0]] for _, m in got], pa.int64() if item_type == "bigint" else None), pa.array([m[1] for _, m in got], pa.float64()), *(pa.array([m[j] for _, m in got], pa.int64()) for j in (4, 2, 3))],
                    ["doc_id", "item_id", "score", "n_seeds", "first_word", "end_word"],
                )

        found = rows.mapInArrow(run, f"doc_id {kind}, item_id {item_type}, score double, n_seeds bigint, first_word bigint, end_word bigint")
        out = found if out is None else out.union(found)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, n: int = 3, seed_share: float = 0.8, least_seeds: int = 2, least_score: float = 0.5, slack: int = 16, block_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    for index in indexes(id_text(docs), benchmark, n, seed_share, block_bytes, "item_id", "text"):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in pieces(batches):
                yield batch.filter(pa.array([not shared.value.matches(t, least_seeds, least_score, slack) for t in as_bytes(batch.column("text"))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

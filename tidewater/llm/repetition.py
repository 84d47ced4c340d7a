"""Repetition inside a text, from its suffix array.

The words of a batch of texts form one sequence in which words of different texts never compare equal.
Prefix doubling sorts its suffixes and keeps the rank of every doubling level; the longest common prefix
of neighbours in the suffix array is read off those levels.  A suffix's longest repeat is the larger of its two
neighbours' common prefixes, so the intervals of the suffix array with a common prefix of at least
``min_repeat`` words are exactly the repeated substrings, and the union of the maximal ones' spans is covered.

Defined results: null or empty text has no words and zeros everywhere, and fails the base rule; repeated
rows give repeated results; an empty table gives an empty result; extra columns are left out.  Memory grows with
the longest text, not with the table: four bytes a word and doubling level, of which there are as many as its longest repeat has
binary digits (ordinary prose: under ten).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import as_bytes, id_text, pieces

BLANK = b" \t\n\r\x0b\x0c"
NOT_COUNTED = BLANK + bytes(range(0x80, 0xC0))  # blanks, and all but the first byte of a code point
SYMBOLS = b"#*$%&|<>"


def longest_repeats(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position of several joined texts, the length of the longest repeat within its text that starts there.

    words: ids; equal ids of different texts differ.  ends: for each position, where its text ends.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(words, kind="stable")
    rank = np.empty(n, np.int32 if n < 1 << 31 else np.int64)  # rank: place of the first suffix with this prefix, from 1
    rank[order] = _starts(words[order]) + 1
    levels, k = [rank], 1
    active = _tied(order, rank)
    while len(active):
        after = active + k
        second = np.where(after < ends[active], levels[-1][np.minimum(after, n - 1)], 0)
        first = levels[-1][active].astype(np.int64)
        key = first * (n + 1) + second
        by = np.argsort(key, kind="stable")
        active, first, key = active[by], first[by], key[by]
        rank = levels[-1].copy()
        rank[active] = first + _starts(key) - _starts(first)
        levels.append(rank)
        active = _tied(active, rank)
        k *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[levels[-1] - 1] = np.arange(n)
    pair = np.flatnonzero(levels[0][suffixes[:-1]] == levels[0][suffixes[1:]])
    a, b = suffixes[:-1][pair], suffixes[1:][pair]
    common = np.zeros(len(pair), np.int64)
    for t in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        same = (x < ends[a]) & (y < ends[b])
        same &= levels[t][np.minimum(x, n - 1)] == levels[t][np.minimum(y, n - 1)]
        common += same << t
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def _starts(ordered: np.ndarray) -> np.ndarray:
    """For each element, where its run of equal values starts."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(ordered)), 0))


def _tied(order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of suffixes in order, those that share their rank with a neighbour."""
    r = rank[order]
    same = r[1:] == r[:-1]
    return order[np.append(same, False) | np.append(False, same)]


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which positions lie in a repeat of at least ``least`` words."""
    change = np.zeros(len(longest) + 1, np.int64)
    at = np.flatnonzero(longest >= least)
    change[at] += 1
    np.add.at(change, at + longest[at], -1)
    return np.cumsum(change[:-1]) > 0


def measure(texts: list[bytes], min_repeat: int, passage: int) -> dict[str, np.ndarray]:
    split = [t.split() for t in texts]
    count = np.array([len(w) for w in split], np.int64)
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for ws in split for w in ws], np.int64)
    owner = np.repeat(np.arange(len(texts)), count)
    longest = longest_repeats(owner * (len(seen) + 1) + ids, np.repeat(np.cumsum(count), count))
    per_text = lambda x: np.bincount(owner, x, len(texts)).astype(np.int64)
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, owner, longest)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    return {
        "n_words": count,
        "word_chars": np.array([len(t.translate(None, NOT_COUNTED)) for t in texts], np.int64),
        "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": per_text(covered(longest, 5)),
        "covered_words": per_text(covered(longest, min_repeat)),
        "passage_words": per_text(covered(longest, passage)),
        "longest_repeat": most,
    }


FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "passage_words", "longest_repeat"]


def repetition(df: DataFrame, min_repeat: int = 5, max_covered: float = 0.2, max_longest: int = 100, passage: int = 10, max_passages: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, counts, base_failed and kept.

    A text is kept unless the base rule fails it, repeats of at least ``min_repeat`` words cover more than
    ``max_covered`` of its words, repeats of at least ``passage`` words - copied passages, not phrases that recur by
    themselves, so half the base rule's share is too much - cover more than ``max_passages`` of them, or its longest
    repeat has more than ``max_longest`` words.
    """

    def run(batches):
        for batch in pieces(batches, 2_000_000):
            m = measure(as_bytes(batch.column("text")), min_repeat, passage)
            failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
            kept = ~failed & (m["covered_words"] <= max_covered * m["n_words"]) & (m["passage_words"] <= max_passages * m["n_words"]) & (m["longest_repeat"] <= max_longest)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(m[f]) for f in FIELDS), pa.array(failed), pa.array(kept)], ["doc_id", *FIELDS, "base_failed", "kept"])

    rows = id_text(df, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{f} bigint" for f in FIELDS) + ", base_failed boolean, kept boolean")

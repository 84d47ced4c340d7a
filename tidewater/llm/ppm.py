"""Language-model scores: prediction by partial matching over bytes, beside a word unigram base.

Training documents' A-Z-lowered bytes, followed by an end symbol, give counts of all (order + 1)-byte grams; shorter
grams' counts are their sums, so the gram table is the whole context trie.  A byte's probability in its longest seen
context is (2 * count - 1) / (2 * total); the rest, distinct / (2 * total), is the escape (method D) to the context one
byte shorter, in which symbols seen in the longer one are excluded from counts and distinct symbols alike; after the
empty context the symbols left are equally likely.  A document's score is its log10 probability with the trained trie ("pretrained" code length).

All levels needed for a byte share the two bytes before it, so the trie is dealt out by those: contexts are derived
in parallel, and scored in blocks of at most ``block_grams`` grams, each broadcast for one pass over the documents.  The
``hot_words`` most frequent words' counts are broadcast too; rarer words meet their counts in a shuffle join.

Defined results: null or empty text: the end alone; a null id counts as the empty text for the split; without
training documents every byte costs log10(257) and nothing is known; repeated rows train and are scored each; an
empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import as_bytes, cut, pieces

END = 0xFF  # never a byte of UTF-8; before a text stand bytes 0xFE
BEFORE = 0xFE
SYMBOLS = 257
FLUSH = 400_000


def gram_keys(texts: list[bytes], order: int) -> np.ndarray:
    """For each byte of each text and its end, in turn, the gram that it closes: oldest byte highest."""
    joined = np.frombuffer(b"".join(bytes([BEFORE]) * order + t + bytes([END]) for t in texts), np.uint8).astype(np.int64)
    key = np.zeros(len(joined) - order, np.int64)
    for j in range(order + 1):
        key = key << 8 | joined[j : len(joined) - order + j]
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(sizes + order) - (sizes + order)
    return key[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


def train(rows: DataFrame, order: int) -> DataFrame:
    """(word, gram, n): counts of words (the end is the one blank) and of grams, over the rows with ``held_out`` false."""

    def run(batches):
        words: Counter = Counter()
        for batch in pieces(batches, 2_000_000):
            texts = [t.lower() for t in as_bytes(batch.column("text"))]
            if texts:
                key, n = np.unique(gram_keys(texts, order), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(key), pa.binary()), pa.array(key), pa.array(n)], ["word", "gram", "n"])
            for t in texts:
                words.update(t.split())
            words[b" "] += len(texts)
            if len(words) > FLUSH:
                yield out(words)
        if words:
            yield out(words)

    def out(words):
        got = pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64())], ["word", "gram", "n"])
        words.clear()
        return got

    counts = rows.filter("not held_out").select("text").mapInArrow(run, "word binary, gram bigint, n bigint")
    return cut(counts.groupBy("word", "gram").agg(F.sum("n").alias("n")))


def group_sums(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys of a sorted array and the sums of the values over each."""
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[at], *(np.add.reduceat(v, at) if len(at) else v[:0] for v in values)


def look_up(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table, and which are there."""
    if not len(table):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return at, table[at] == key


class Trie:
    """Log10 probabilities from gram counts; complete for contexts whose longest grams are all given.

    Level k holds grams of k + 1 bytes: ``key``, ``logn`` (of 2 * count - 1) and ``first`` (log probability when the search starts at
    this level); and contexts of k bytes: ``ctx``, ``esc`` (log escape when it starts there), and for a search that comes down from
    the context to the next shorter one, ``down`` (log of twice the counts left there) and ``pass_on`` (log escape).
    """

    def __init__(self, key: np.ndarray, n: np.ndarray, order: int, low: tuple[np.ndarray, np.ndarray] | None = None):
        by = np.argsort(key, kind="stable")
        grams = {order: (key[by], n[by])}
        for k in range(order - 1, -1, -1):
            if k == 1 and low is not None:  # contexts of one byte lie in many blocks, so their counts come complete
                grams[k] = low
                continue
            longer, m = grams[k + 1]
            short = longer & ((1 << 8 * (k + 1)) - 1)
            by = np.argsort(short, kind="stable")
            grams[k] = group_sums(short[by], m[by])
        self.order, self.levels = order, {}
        total = {}
        for k in range(order + 1):
            g, m = grams[k]
            ctx, t, d = group_sums(g >> 8, m, np.ones(len(g), np.int64))
            owner = np.searchsorted(ctx, g >> 8)
            first = np.log10(2 * m - 1) - np.log10(2 * t[owner]) if len(g) else np.zeros(0)
            level = {"key": g, "logn": np.log10(2 * m - 1) if len(g) else np.zeros(0), "first": first, "ctx": ctx, "esc": np.log10(d / (2 * t))}
            total[k] = (ctx, t, d)
            if k:
                at, _ = look_up(grams[k - 1][0], g & ((1 << 8 * k) - 1))
                excluded = np.bincount(owner, grams[k - 1][1][at], len(ctx)) if len(g) else np.zeros(0)
                up, _ = look_up(total[k - 1][0], ctx & ((1 << 8 * (k - 1)) - 1))
                left_n = total[k - 1][1][up] - excluded if len(ctx) else np.zeros(0)
                left_d = total[k - 1][2][up] - d if len(ctx) else np.zeros(0)
            else:
                left_n, left_d = np.zeros(len(ctx)), SYMBOLS - d
            whole = 2 * left_n if k else left_d
            level["down"] = np.log10(np.maximum(whole, 1))
            level["pass_on"] = np.where(left_d > 0, np.log10(np.maximum(left_d, 1)) - level["down"], 0.0) if k else np.zeros(len(ctx))
            self.levels[k] = {name: x.astype(np.float32) if x.dtype == np.float64 else x for name, x in level.items()}

    def score(self, key: np.ndarray) -> np.ndarray:
        """Log10 probability of the last byte of each gram after the others."""
        out = np.zeros(len(key))
        todo = np.arange(len(key))
        came, down, pass_on = np.zeros(len(key), bool), np.zeros(len(key)), np.zeros(len(key))
        for k in range(self.order, -1, -1):
            level, part = self.levels[k], key[todo] & ((1 << 8 * (k + 1)) - 1)
            at, here = look_up(level["key"], part)
            got = todo[here]
            out[got] += np.where(came[here], level["logn"][at[here]] - down[here], level["first"][at[here]]) if len(got) else 0
            todo, part, came, down, pass_on = todo[~here], part[~here], came[~here], down[~here], pass_on[~here]
            at, seen = look_up(level["ctx"], part >> 8)
            if len(todo) and len(level["ctx"]):
                out[todo] += np.where(came, pass_on, np.where(seen, level["esc"][at], 0.0))
                down, pass_on = np.where(seen, level["down"][at], 0.0), np.where(seen, level["pass_on"][at], 0.0)
            came = seen
        out[todo] -= np.where(came, down, math.log10(SYMBOLS))
        return out


def blocks(grams: DataFrame, order: int, block_grams: int) -> list[set[int]]:
    """The pairs of bytes before the last one, dealt into blocks of at most about ``block_grams`` grams.  At most 65,536 rows come to the driver."""
    sizes = grams.groupBy(F.expr("cast(shiftright(gram, 8) & 65535 as int)").alias("pair")).count().collect()
    out: list[set[int]] = []
    room = 0
    for r in sorted(sizes, key=lambda r: (-r["count"], r["pair"])):
        if not out or room < r["count"]:
            out.append(set())
            room = block_grams
        out[-1].add(r["pair"])
        room -= r["count"]
    return out


def score(df: DataFrame, order: int = 5, hot_words: int = 200_000, block_grams: int = 2_000_000, modulus: int = 7, remainder: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    if not 2 <= order <= 6:
        raise ValueError("order is 2 to 6, so that a gram fits a long and two bytes precede the last")
    rows = df.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == remainder).alias("held_out"),
    )
    counts = train(rows, order)
    words, grams = counts.filter("word is not null"), counts.filter("gram is not null").select("gram", "n")
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = words.orderBy(F.desc("n"), "word").limit(hot_words).toArrow()
    hot = dict(zip(top["word"].to_pylist(), top["n"].to_pylist()))
    del top
    spark = df.sparkSession
    shared_words = spark.sparkContext.broadcast(hot)
    low = grams.groupBy(F.expr("gram & 65535").alias("gram")).agg(F.sum("n").alias("n")).orderBy("gram").toArrow()  # at most 65,536 rows
    low = (low["gram"].to_numpy(), low["n"].to_numpy())
    base_log = math.log10(totals["n"] + totals["v"] + 1)

    def word_part(texts, rows_, hot_counts):
        """(row, n_tokens, n_known, sum of logs of known hot words) and the other words."""
        n, known, logs, rest_row, rest_word, rest_n = [], [], [], [], [], []
        for row, t in zip(rows_, texts):
            found = Counter(t.split())
            found[b" "] = 1
            k, s = 0, 0.0
            for w, m in found.items():
                c = hot_counts.get(w)
                if c is None:
                    rest_row.append(row)
                    rest_word.append(w)
                    rest_n.append(m)
                else:
                    k += m
                    s += m * logs_of[c] if c < len(logs_of) else m * math.log10(c + 1)
            n.append(sum(found.values()))
            known.append(k)
            logs.append(s)
        return n, known, logs, rest_row, rest_word, rest_n

    logs_of = [math.log10(c + 1) for c in range(2000)]
    columns = ["row", "n_tokens", "n_known", "logs", "code", "word", "n"]

    def scorer(block, shared_trie, first):
        def run(batches):
            trie, pairs = shared_trie.value
            for batch in pieces(batches, 2_000_000):
                row = batch.column("row").to_pylist()
                texts = [t.lower() for t in as_bytes(batch.column("text"))]
                key = gram_keys(texts, order)
                owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
                if pairs is not None:
                    mine = pairs[key >> 8 & 65535]
                    key, owner = key[mine], owner[mine]
                distinct, back = np.unique(key, return_inverse=True)
                code = np.bincount(owner, trie.score(distinct)[back], len(texts))
                nothing = [0] * len(texts)
                n, known, logs, *rest = word_part(texts, row, shared_words.value) if first else (nothing, nothing, [0.0] * len(texts), [], [], [])
                marks = [b" %d" % r for r in row]  # no word has a blank; spreads these rows over the join
                m = len(rest[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + rest[0], pa.int64()), pa.array(n + [0] * m, pa.int64()), pa.array(known + [0] * m, pa.int64()), pa.array(logs + [0.0] * m, pa.float64()), pa.array(list(code) + [0.0] * m, pa.float64()), pa.array(marks + rest[1], pa.binary()), pa.array(nothing + rest[2], pa.int64())],
                    columns,
                )

        return run

    scored = None
    dealt = blocks(grams, order, block_grams) or [set()]
    for i, block in enumerate(dealt):
        whole = len(dealt) == 1
        part = grams if whole else grams.filter(F.expr("cast(shiftright(gram, 8) & 65535 as int)").isin(sorted(block)))
        table = part.toArrow()  # at most about ``block_grams`` rows
        pairs = None
        if not whole:
            pairs = np.zeros(65536, bool)
            pairs[sorted(block if i else set(range(65536)) - set().union(*dealt[1:]))] = True
        trie = Trie(table["gram"].to_numpy(), table["n"].to_numpy(), order, low)
        del table
        run = scorer(block, spark.sparkContext.broadcast((trie, pairs)), i == 0)
        del trie
        got = rows.select("row", "text").mapInArrow(run, "row bigint, n_tokens bigint, n_known bigint, logs double, code double, word binary, n bigint")
        scored = got if scored is None else scored.union(got)
    c = F.coalesce("c", F.lit(0))
    summed = (
        scored.join(words.select("word", F.col("n").alias("c")), "word", "left").groupBy("row")
        .agg(*(F.sum(x).alias(x) for x in ("n_tokens", "code")), F.sum(F.col("n_known") + F.when(c > 0, F.col("n")).otherwise(0)).alias("n_known"), F.sum(F.col("logs") + F.col("n") * F.log10(c + 1)).alias("logs"))
    )
    return rows.select("row", "doc_id", "held_out").join(summed, "row").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(totals["n"]).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(base_log)).alias("base_score"), F.col("code").alias("score"),
    )

"""Packing by non-negative least squares on the histogram of lengths.

Documents are tokenised and those longer than a sequence are cut into full pieces and a rest.  All combinations of up to
``DEPTH`` lengths that fill a sequence exactly are enumerated; repeat counts that reproduce the histogram of lengths best are the solution
of a non-negative least squares problem.  Columns enter it as its gradient asks for them, so that few combinations carry large counts and rounding loses
little.  Rounded counts never take more pieces than there are.  What is left is packed greedily into further exact fills of any depth, and the
pieces that fit nowhere are laid end to end and cut at the sequences' edges, the tail at powers of two, so nothing is padded.

All this is on the histogram, which has at most ``capacity`` entries whatever the input (about capacity ** 2 / 12 combinations).
Pieces then take their places by their rank among those of their length, found with one counter per (length, bucket); buckets grow in
number with the pieces.  Ids travel, two bytes each for vocabularies of up to 65,536, since only the plan knows what is cut.

Defined results: null text is empty and gives one piece with the end token alone; repeated rows are packed once each; an empty table gives an
empty result; extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import as_bytes, cut, id_text, pieces
from .packing import encoder

DEPTH = 3


def tokenised(df: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids_crc32, ids): documents, and full pieces and rests of those longer than a sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        small = max(known.library.get_vocab_size() - 1, end_id) < 1 << 16
        for batch in pieces(batches, 2_000_000):
            at, start, length, total, crc, kept = [], [], [], [], [], []
            for i, ids in enumerate(known.encode([b.decode() for b in as_bytes(batch.column("text"))])):
                ids += end
                n = len(ids) // 4
                for a in range(0, n, capacity):
                    own = ids[4 * a : 4 * (a + capacity)]
                    at.append(i)
                    start.append(a)
                    length.append(len(own) // 4)
                    total.append(n)
                    crc.append(zlib.crc32(own))
                    kept.append(np.frombuffer(own, "<u4").astype("<u2").tobytes() if small else own)
            numbers = (pa.array(x, pa.int64()) for x in (start, length, total, crc))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *numbers, pa.array(kept, pa.binary())], ["doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids"])

    rows = id_text(df, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start bigint, length bigint, doc_tokens bigint, ids_crc32 bigint, ids binary")


def combinations(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows (a, b, c) with a >= b >= c and a + b + c = capacity; 0 stands for no length."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = there[0] = True
    rows = []
    for a in lengths[3 * lengths >= capacity]:
        b = np.flatnonzero(there[: min(a, capacity - a) + 1])
        c = capacity - a - b
        ok = (c <= b) & there[c]
        rows.append(np.column_stack([np.full(ok.sum(), a), b[ok], c[ok]]))
    return np.concatenate(rows).astype(np.int64) if rows else np.zeros((0, 3), np.int64)


def solved(columns: np.ndarray, x: np.ndarray, h: np.ndarray, steps: int = 300) -> np.ndarray:
    """Non-negative repeat counts of ``columns`` whose lengths come nearest to ``h`` in squares, by accelerated projected gradients from ``x``."""
    degree = np.bincount(columns.ravel(), minlength=len(h))
    degree[0] = 0
    step = 1 / (DEPTH * degree.max())
    y, t = x, 1.0
    for _ in range(steps):
        left = h - made(columns, y, len(h))
        new = np.maximum(0, y + step * left[columns].sum(1))
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y, x = new + (last - 1) / t * (new - x), new
    return x


def made(columns: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """How many pieces of each length the counts take; none of length 0."""
    out = np.bincount(columns.ravel(), np.repeat(x, columns.shape[1]), minlength=n)
    out[0] = 0
    return out


def least_squares(columns: np.ndarray, h: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(columns, counts) of the non-negative least squares fit to ``h``: per longest length, the column that the gradient wants most enters in each round."""
    first = np.flatnonzero(np.r_[True, np.diff(columns[:, 0]) != 0])
    parts = (columns > 0).sum(1)
    inside, x, best = np.zeros(0, np.int64), np.zeros(0), np.inf
    for _ in range(rounds):
        left = h - made(columns[inside], x, len(h))
        if (error := float(left @ left)) > 0.999 * best or error < 1:
            break
        best = error
        left[0] = 0
        want = left[columns].sum(1) / np.sqrt(parts)
        order = np.lexsort((-want, columns[:, 0]))
        new = order[first]  # the first of each longest length
        new = np.setdiff1d(new[want[new] > 1e-9], inside)
        inside, x = np.r_[inside, new], np.r_[x, np.zeros(len(new))]
        x = solved(columns[inside], x, h)
        inside, x = inside[x > 1e-6], x[x > 1e-6]
    return columns[inside], x


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[list[int], int]], list[tuple[int, int]]]:
    """(bins as (lengths, how many such bins), all exactly full; pieces to lay end to end as (length, how many)), from length -> count."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    bins: list[tuple[list[int], int]] = []

    def take(held: list[int], most: int) -> None:
        kinds, each = np.unique(held, return_counts=True)
        times = min(most, int((left[kinds] // each).min()))
        if times > 0:
            left[kinds] -= each * times
            bins.append((held, times))

    columns = combinations(np.flatnonzero(left), capacity)
    if len(columns):
        columns, x = least_squares(columns, left.astype(float))
        for i in np.argsort(-x, kind="stable"):
            take([int(v) for v in columns[i] if v], int(np.floor(x[i] + 0.5)))
    loose = []
    while len(lengths := np.flatnonzero(left)):
        a = int(lengths[-1])
        held = exact_fill(a, left, capacity)
        if held:
            take(held, int(left[a]))
        else:
            loose.append((a, int(left[a])))
            left[a] = 0
    return bins, loose


def exact_fill(a: int, left: np.ndarray, capacity: int) -> list[int] | None:
    """Lengths that fill a sequence together with ``a``: one that fits the gap, or two, or else the longest that fits and on from there."""
    free = left.copy()
    free[a] -= 1
    held, gap = [a], capacity - a
    while gap:
        if free[gap]:
            return held + [gap]
        low = np.arange(1, gap // 2 + 1)
        pair = np.flatnonzero((free[low] > 0) & (free[gap - low] > (low == gap - low)))
        if len(pair):
            return held + [gap - int(low[pair[-1]]), int(low[pair[-1]])]
        fits = np.flatnonzero(free[:gap])
        if not len(fits):
            return None
        b = int(fits[-1])
        n = min(int(free[b]), max(1, (gap - 1) // b))
        held += [b] * n
        free[b] -= n
        gap -= b * n
    return held


def places(bins: list[tuple[list[int], int]], loose: list[tuple[int, int]]) -> tuple[np.ndarray, int]:
    """Runs of places (length, first rank, laid end to end, first sequence or position, offset), in order of length and rank; the number of full sequences."""
    rank: dict[int, int] = {}
    runs, first, position = [], 0, 0
    for held, times in bins:
        offset = 0
        for length in held:
            runs.append((length, rank.get(length, 0), 0, first, offset))
            rank[length] = rank.get(length, 0) + times
            offset += length
        first += times
    for length, n in loose:
        runs.append((length, rank.get(length, 0), 1, position, 0))
        position += length * n
    return np.array(sorted(runs), np.int64).reshape(-1, 5), first


def tail_edges(total: int, capacity: int) -> np.ndarray:
    """Where the sequences end that hold the last ``total % capacity`` of ``total`` tokens: powers of two, the largest first."""
    at, rest = total - total % capacity, total % capacity
    sizes = [1 << i for i in reversed(range(rest.bit_length())) if rest >> i & 1]
    return at + np.cumsum(np.array(sizes, np.int64))


def pack(df: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, bucket_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    whole = cut(tokenised(df, tokenizer, capacity, end_id, id_col, text_col))
    buckets = whole.count() // bucket_rows + 1
    made = whole.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "length", "doc_tokens", "ids_crc32"), F.lit(buckets)))
    counts = made.groupBy("length", "bucket").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most ``capacity`` rows
    bins, loose = plan(histogram, capacity)
    runs, full = places(bins, loose)
    edges = tail_edges(sum(length * n for length, n in loose), capacity)
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).select("length", "bucket", "before")
    ids = F.when(F.col("length").isin([length for length, _ in loose]), F.col("ids"))  # no other piece is cut
    ranked = (
        made.withColumn("ids", ids).withColumn("within", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1)
        .join(before, ["length", "bucket"])
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", (F.col("before") + F.col("within")).alias("rank"))
    )
    shared = made.sparkSession.sparkContext.broadcast((runs, edges))  # as long as the plan, which the histogram bounds

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, edges = shared.value
        keys = runs[:, 0] << 40 | runs[:, 1]
        for batch in batches:
            length, rank, start, crc = (batch.column(c).to_numpy() for c in ("length", "rank", "start", "ids_crc32"))
            run = runs[np.searchsorted(keys, length << 40 | rank, side="right") - 1]
            at, out = [], []
            for i in np.flatnonzero(run[:, 2]):
                n, pos, ids = int(length[i]), int(run[i, 3] + (rank[i] - run[i, 1]) * length[i]), batch.column("ids")[i].as_py()
                wide = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4").tobytes()
                a = pos
                while a < pos + n:
                    k = int(np.searchsorted(edges, a, side="right"))
                    tail = len(edges) > 0 and a >= edges[-1] - edges[-1] % capacity
                    low, high = (int(edges[k - 1]) if k else int(edges[-1] // capacity * capacity), int(edges[k])) if tail else (a // capacity * capacity, (a // capacity + 1) * capacity)
                    b = min(high, pos + n)
                    at.append(i)
                    out.append((int(start[i]) + a - pos, b - a, zlib.crc32(wide[4 * (a - pos) : 4 * (b - pos)]), full + a // capacity + (k if tail else 0), a - low))
                    a = b
            exact = np.flatnonzero(run[:, 2] == 0)
            settled = np.column_stack([start[exact], length[exact], crc[exact], run[exact, 3] + rank[exact] - run[exact, 1], run[exact, 4]])
            rows = np.concatenate([settled, np.array(out, np.int64).reshape(-1, 5)])
            take = pa.array(np.r_[exact, np.array(at, np.int64)])
            s, n, c, q, o = (pa.array(rows[:, j]) for j in range(5))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), s, n, c, batch.column("doc_tokens").take(take), q, o], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = made.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")

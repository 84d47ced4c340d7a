"""Exact set-similarity self-join: what line deduplication and near-duplicate documents share.

The text of a row holds one or more units (lines, or the whole document); a unit is a set of 64-bit digests.  Digests are put
in one global order, rare before frequent: how often a digest occurs is read from one table of counters, whose size is fixed
whatever the corpus; digests that share a counter share its sum, so a frequent digest never passes for a rare one, and one whose
counter is 1 occurs nowhere else.  Two sets with a Jaccard similarity of at least num/den must share a digest within the first
k - ceil(k * num / den) + 1 of their k digests (prefix filter).  Where the first one they share is frequent, they must share a
second one within one place more, and the pair is the key, so a frequent digest makes no large group by itself.

Sets that share a key are paired if their sizes allow it (length filter), if what follows the shared digest may suffice
(positional filter), and if their parity maps differ in no more bits than the sets may differ in digests.  Pairs are dealt to a
square of blocks by the digests of both sides; a set's content goes to a block once, however many pairs need it there, and each
pair is verified on the whole sets.

Equal sets are one class, known by 128 bits: a sum of mixed digests and the parity map.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import BREAK, as_bytes, cut, mix, pieces, tidy, word_digests

COUNTERS = 24  # log2 of the number of counters: 64 MB in a task, 16 MB broadcast
SPAN = 1 << 16  # counters in one row of a shuffle
PIECE = 2_000_000  # bytes of text whose sets are held at once
PAIRS_AT_ONCE = 500_000
ITEMS_AT_ONCE = 1_000_000
KEYS_A_PART = 1_500_000
UNITS_A_BLOCK = 500_000  # a set may go to several blocks, so blocks grow with the units, and a side with their root
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
NOTHING = np.zeros(0, np.int64)

class Lines:
    """The lines of a text, each the set of its words (A-Z lowered)."""

    def digests(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Text of each unit, number of the unit in it, unit of each digest in ascending order, digest."""
        start, digest, breaks = word_digests(BREAK.join(texts))
        lengths = np.array([len(x) + 1 for x in texts], np.int64)
        first = np.searchsorted(breaks, np.cumsum(lengths) - lengths)  # the joining breaks end a text's last line
        counts = np.diff(np.append(first, len(breaks) + 1)) if texts else NOTHING
        return np.repeat(np.arange(len(texts)), counts), np.arange(counts.sum()) - np.repeat(first, counts), np.searchsorted(breaks, start), digest

    def parts(self, texts: list[bytes], at: np.ndarray, number: np.ndarray) -> list[bytes]:
        """The text of some units."""
        split = {i: texts[i].split(BREAK) for i in set(at.tolist())}
        return [split[i][j] for i, j in zip(at.tolist(), number.tolist())]


class Shingles:
    """Whole texts, each the set of its runs of ``width`` words; with fewer words the whole sequence is the only one."""

    def __init__(self, width: int):
        self.width = width

    def digests(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        width = self.width
        start, digest, _ = word_digests(BREAK.join(texts))
        ends = np.cumsum([len(x) + 1 for x in texts]) if texts else NOTHING
        owner = np.searchsorted(ends, start, side="right")
        short = np.bincount(owner, minlength=len(texts))[owner] < width
        first = np.append(True, owner[1:] != owner[:-1]) if len(owner) else np.zeros(0, bool)
        n = max(len(owner) - width + 1, 0)
        full = np.flatnonzero(owner[:n] == owner[len(owner) - n :])
        out = np.zeros(len(full), np.uint64)
        for i in range(width):
            out = mix(out * GOLDEN + digest[full + i])
        few = np.flatnonzero(short & first)
        rest = np.zeros(len(few), np.uint64)
        for i in range(width - 1):
            at = np.minimum(few + i, max(len(owner) - 1, 0))
            same = (few + i < len(owner)) & (owner[at] == owner[few]) if len(few) else np.zeros(0, bool)
            rest[same] = mix(rest[same] * GOLDEN + digest[at[same]] + np.uint64(1))
        unit, made = np.concatenate([owner[full], owner[few]]), np.concatenate([out, rest])
        order = np.argsort(unit, kind="stable")
        return np.arange(len(texts)), np.zeros(len(texts), np.int64), unit[order], made[order]

    def parts(self, texts: list[bytes], at: np.ndarray, number: np.ndarray) -> list[bytes]:
        return [texts[i] for i in at.tolist()]


Units = Lines | Shingles


@dataclass
class Sets:
    """The sets of a batch, each in the global order; ``unit`` says which of the batch's units has which set."""

    unit: np.ndarray
    digest: np.ndarray
    often: np.ndarray
    start: np.ndarray
    size: np.ndarray
    h1: np.ndarray
    h2: np.ndarray

    @classmethod
    def of(cls, unit: np.ndarray, digest: np.ndarray, levels: np.ndarray | None = None) -> Sets:
        distinct, at = np.unique(digest, return_inverse=True)
        often = np.zeros(len(distinct), np.uint8) if levels is None else levels[counter(distinct)]
        order = np.argsort(often, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        key = np.sort(unit << 32 | place[at]) if len(at) else NOTHING
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        owner, at = key >> 32, order[key & 0xFFFFFFFF]
        start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else NOTHING
        size = np.diff(np.append(start, len(owner)))
        mixed = mix(distinct)[at]
        sums = np.add.reduceat(mixed, start) if len(start) else np.zeros(0, np.uint64)
        parity = np.bitwise_xor.reduceat(np.uint64(1) << (mixed >> np.uint64(58)), start) if len(start) else sums
        return cls(owner[start], distinct[at], often[at], start, size, mix(sums ^ size.astype(np.uint64)).view(np.int64), parity.view(np.int64))

    @classmethod
    def joined(cls, some: list[Sets]) -> Sets:
        """Sets of many batches, their units numbered on; each batch must have had one set a unit."""
        all_of = lambda name: np.concatenate([getattr(x, name) for x in some])
        size = all_of("size")
        return cls(np.arange(len(size)), all_of("digest"), all_of("often"), np.cumsum(size) - size, size, all_of("h1"), all_of("h2"))

    def keys(self, num: int, den: int, frequent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each key: digest, set, and how many shared digests are still possible for the set."""
        first, _ = dense(self.h1, self.h2)
        first = np.sort(first[self.size[first] * den >= num * (self.size[first] + 1)])  # smaller sets have equal partners only
        prefix = self.size[first] - -(-self.size[first] * num // den) + 1
        at, which, place = spread(self.start[first], prefix, first)
        alone = self.often[at] <= level(frequent)
        single = alone & (self.often[at] > 1)  # a counter of 1: the digest is here alone
        out = [(self.digest[at[single]], which[single], (self.size[which] - place)[single])]
        at, which, place = at[~alone], which[~alone], place[~alone]
        ends = np.minimum((self.size - -(-self.size * num // den) + 2)[which], self.size[which])
        second, of, step = spread(at + 1, ends - place - 1, np.arange(len(at)))
        out.append((mix(self.digest[at[of]] * GOLDEN + self.digest[second]), which[of], self.size[which[of]] - place[of] - step))
        return tuple(np.concatenate(x) for x in zip(*out))


def counter(digest: np.ndarray) -> np.ndarray:
    return (digest >> np.uint64(64 - COUNTERS)).astype(np.int64)


def level(count: int | np.ndarray) -> int | np.ndarray:
    """Counts on a scale of 255 steps: 0, 1, and seven steps each doubling."""
    return np.minimum(255, np.where(np.asarray(count) > 0, 1 + np.floor(7 * np.log2(np.maximum(count, 1))), 0)).astype(np.uint8)


def spread(start: np.ndarray, count: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, start + 1, ... for each run, its label and the step within the run."""
    count = np.maximum(count, 0)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(start, count) + step, np.repeat(label, count), step


def squeeze(values: np.ndarray) -> bytes:
    raw = values.astype("<u4").tobytes()
    return len(values).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else bytes(4)


def swell(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    return np.frombuffer(pa.decompress(blob[4:], decompressed_size=4 * n, codec="zstd", asbytes=True), "<u4").astype(np.int64) if n else NOTHING


def dense(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each distinct combination, in the order of the columns, and the number of each row's combination."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    new[:1] = True
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values start and end."""
    if not len(values):
        return NOTHING, NOTHING
    start = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return start, np.append(start[1:], len(values))


def levels(rows: DataFrame, units: Units, extra: Callable | None = None, columns: dict[str, str] | None = None) -> tuple[np.ndarray, DataFrame]:
    """``rows``: (row, doc_id, text).  Counts the digests of all units, and names every unit in the same pass.

    Returns the level of each counter, and all units: row, doc_id, unit, h1, h2 and the ``columns`` (name to type) that ``extra`` adds.
    """
    kinds = {"row": "bigint", "doc_id": rows.schema["doc_id"].dataType.simpleString(), "unit": "int", "h1": "bigint", "h2": "bigint"} | (columns or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, names = np.zeros(1 << COUNTERS, np.uint32), []
        for batch in pieces(batches, PIECE):
            text, number, unit, digest = units.digests(as_bytes(batch.column("text")))
            np.add.at(counts, counter(digest), np.uint32(1))
            sets = Sets.of(unit, digest)
            at = pa.array(text[sets.unit])
            more = extra(batch.column("text"), text, sets) if extra else {}
            names = [batch.column("row").take(at), batch.column("doc_id").take(at), pa.array(number[sets.unit].astype(np.int32)), pa.array(sets.h1), pa.array(sets.h2), *more.values()]
            yield pa.RecordBatch.from_arrays([*names, pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.binary())], [*kinds, "span", "counts"])
        spans = [i for i in range(len(counts) // SPAN) if counts[i * SPAN : (i + 1) * SPAN].any()]
        made = pa.table({"span": pa.array(spans, pa.int32()), "counts": pa.array([squeeze(counts[i * SPAN : (i + 1) * SPAN]) for i in spans], pa.binary())})
        for batch in made.to_batches():
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(batch), x.type) for x in names), *batch.columns], [*kinds, "span", "counts"])
        del counts, made
        tidy()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for span, blob in zip(batch.column("span").to_pylist(), batch.column("counts").to_pylist()):
                sums[span] = sums.get(span, 0) + swell(blob)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([level(x).tobytes() for x in sums.values()], pa.binary())], ["span", "counts"])

    ddl = ", ".join(f"{name} {kind}" for name, kind in kinds.items())
    made = cut(rows.mapInArrow(run, f"{ddl}, span int, counts binary"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = made.filter("span is not null").select("span", "counts").repartition(min(parts, (1 << COUNTERS) // SPAN), "span").mapInArrow(add, "span int, counts binary").toArrow()
    out = np.zeros(1 << COUNTERS, np.uint8)
    for span, raw in zip(found["span"].to_pylist(), found["counts"].to_pylist()):
        out[span * SPAN : (span + 1) * SPAN] = np.frombuffer(raw, np.uint8)
    return out, made.filter("span is null").drop("span", "counts")


def pack(key: np.ndarray, which: np.ndarray, left: np.ndarray, sets: Sets) -> bytes:
    """Keys as one block of bytes, for a narrow shuffle: 40 bits of each key, which with the part are enough to meet by."""
    order = np.argsort(which, kind="stable")
    used, count = np.unique(which, return_counts=True)
    low = key[order] >> np.uint64(24)
    head = low.astype("<u4").tobytes() + (low >> np.uint64(32)).astype(np.uint8).tobytes() + sets.h1[used].astype("<i8").tobytes() + sets.h2[used].astype("<i8").tobytes()
    return len(key).to_bytes(4, "little") + len(used).to_bytes(4, "little") + head + squeeze(np.concatenate([sets.size[used], count, left[order]]))


def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    """key, h1, h2, size, left of each row of a block."""
    n, m = (int.from_bytes(blob[i : i + 4], "little") for i in (0, 4))
    key = np.frombuffer(blob, "<u4", n, 8).astype(np.int64) | np.frombuffer(blob, np.uint8, n, 8 + 4 * n).astype(np.int64) << 32
    h1, h2 = (np.frombuffer(blob, "<i8", m, 8 + 5 * n + 8 * m * i) for i in (0, 1))
    rest = swell(blob[8 + 5 * n + 16 * m :])
    at = np.repeat(np.arange(m), rest[m : 2 * m])
    return key, h1[at], h2[at], rest[:m][at], rest[2 * m :]


def dealt_keys(rows: DataFrame, units: Units, found: np.ndarray, parts: int, num: int, den: int, frequent: int) -> DataFrame:
    """The keys of all sets as blocks of bytes (part, blob), each part in a partition of its own."""
    shared = rows.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE):
            _, _, unit, digest = units.digests(as_bytes(batch.column("text")))
            sets = Sets.of(unit, digest, shared.value)
            key, which, left = sets.keys(num, den, frequent)
            part = (key % np.uint64(parts)).astype(np.int32)
            by = np.argsort(part, kind="stable")
            key, which, left, part = (x[by] for x in (key, which, left, part))
            start, end = grouped(part)
            yield pa.RecordBatch.from_arrays([pa.array(part[start]), pa.array([pack(key[i:j], which[i:j], left[i:j], sets) for i, j in zip(start, end)], pa.binary())], ["part", "blob"])

    return rows.select("text").mapInArrow(run, "part int, blob binary").repartitionById(parts, "part")


def candidates(key: np.ndarray, number: np.ndarray, size: np.ndarray, h2: np.ndarray, left: np.ndarray, num: int, den: int, group: np.ndarray | None = None, once: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b) of rows with equal keys, size[a] <= size[b], that pass all filters, for a bounded number of rows at a time.

    ``number`` names each row's set, in ascending order of size.  A group's square is never held.  With ``once`` a pair that shares
    several keys is given once a time, else for every key, also for those too late in the order to be the first.
    """
    start, _ = grouped(key)
    of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
    ends = np.searchsorted(of << 32 | size, of << 32 | den * size // num, side="right")
    after = ends - np.arange(len(key)) - 1
    upto, i = np.cumsum(after), 0
    while i < len(key):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PAIRS_AT_ONCE, side="right")))
        b, a, _ = spread(np.arange(i + 1, j + 1), after[i:j], np.arange(i, j))
        both = size[a] + size[b]
        need = -(-num * both // (num + den))
        ok = np.bitwise_count((h2[a] ^ h2[b]).view(np.uint64)) <= both - 2 * need  # of a signed number it counts the bits of the absolute value
        if group is not None:
            ok &= group[a] != group[b]
        if once:
            ok &= np.minimum(left[a], left[b]) >= need
        a, b = a[ok], b[ok]
        if once:
            _, at = np.unique(number[a] << 32 | number[b], return_index=True)
            a, b = a[at], b[at]
        yield a, b
        i = j


def in_order(key: np.ndarray, h1: np.ndarray, h2: np.ndarray, size: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """Rows of equal keys together, each set once a key, in ascending order of (size, h1, h2), with the number of each set."""
    _, number = dense(size, h1, h2)
    order = np.lexsort((number, key))
    new = np.ones(len(order), bool)
    k, n = key[order], number[order]
    new[1:] = (k[1:] != k[:-1]) | (n[1:] != n[:-1])
    return [x[order[new]] for x in (key, number, h1, h2, size, *more)]


def pair_blob(a: np.ndarray, b: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Pairs of sets, by number and in order, as one block of bytes; and the numbers used."""
    used = np.unique(np.concatenate([a, b]))
    x, y = np.searchsorted(used, a), np.searchsorted(used, b)
    ids = h1[used].astype("<i8").tobytes() + h2[used].astype("<i8").tobytes()
    return len(used).to_bytes(4, "little") + ids + squeeze(np.concatenate([np.bincount(x, minlength=len(used)), y])), used


def pairs_of(blob: bytes) -> tuple[np.ndarray, ...]:
    """h1, h2 of the sets of a block, and the pairs as numbers into those."""
    n = int.from_bytes(blob[:4], "little")
    h1, h2 = (np.frombuffer(blob, "<i8", n, 4 + 8 * n * i) for i in (0, 1))
    rest = swell(blob[4 + 16 * n :])
    return h1, h2, np.repeat(np.arange(n), rest[:n]).astype(np.int32), rest[n:].astype(np.int32)


def merged(blocks: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """As pairs_of, for several blocks: each set and each pair once, pairs in ascending order."""
    h1, h2 = (np.concatenate([x[i] for x in blocks]) for i in (0, 1))
    first, number = dense(h1, h2)
    base = np.cumsum([0, *(len(x[0]) for x in blocks)])
    pair = np.unique(np.concatenate([number[b + x[2]] << 32 | number[b + x[3]] for b, x in zip(base, blocks)]))
    return h1[first], h2[first], (pair >> 32).astype(np.int32), (pair & 0xFFFFFFFF).astype(np.int32)


def candidate_blocks(dealt: DataFrame, side: int, num: int, den: int) -> DataFrame:
    """Per block the candidate pairs, each once, as blocks of bytes (block, blob), and the classes that it needs the content of (block, h1, h2)."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [unpack(x) for batch in batches for x in batch.column("blob").to_pylist()]
        if not blobs:
            return
        key, number, h1, h2, size, left = in_order(*map(np.concatenate, zip(*blobs)))
        del blobs
        named = np.zeros((2, number.max() + 1 if len(number) else 0), np.int64)
        named[:, number] = h1, h2
        held: list[np.ndarray] = []
        for a, b in candidates(key, number, size, h2, left, num, den):
            held.append(number[a] << 32 | number[b])
            if sum(map(len, held)) > 2 * PAIRS_AT_ONCE:
                held = [np.unique(np.concatenate(held))]
                if len(held[0]) > PAIRS_AT_ONCE:
                    yield from blocks(held.pop(), *named)
        if held:
            yield from blocks(np.unique(np.concatenate(held)), *named)
        del key, number, h1, h2, size, left, held
        tidy()

    def blocks(pairs: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        block = (h1[a] % side * side + h1[b] % side).astype(np.int32)
        order = np.argsort(block, kind="stable")
        a, b, block = a[order], b[order], block[order]
        start, end = grouped(block)
        yield pa.RecordBatch.from_arrays([pa.array(block[start]), pa.array([pair_blob(a[i:j], b[i:j], h1, h2)[0] for i, j in zip(start, end)], pa.binary())], ["block", "blob"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, n, kept = None, [], 0, 0
        for batch in batches:
            for x in batch.column("blob").to_pylist():
                held.append(pairs_of(x))
                n += len(held[-1][2])
                if n > 2 * (kept + PAIRS_AT_ONCE):
                    held = [merged(held)]
                    n = kept = len(held[0][2])
            block = batch.column("block")[0].as_py() if len(batch) else block
        if held:
            h1, h2, a, b = merged(held)
            del held
            for i in range(0, len(a), PAIRS_AT_ONCE):
                blob, _ = pair_blob(a[i : i + PAIRS_AT_ONCE], b[i : i + PAIRS_AT_ONCE], h1, h2)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([blob], pa.binary())], ["block", "h1", "h2", "blob"])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h1), block, np.int32)), pa.array(h1), pa.array(h2), pa.nulls(len(h1), pa.binary())], ["block", "h1", "h2", "blob"])
        tidy()

    met = dealt.mapInArrow(meet, "block int, blob binary")
    return met.repartitionById(side * side, "block").mapInArrow(gather, "block int, h1 bigint, h2 bigint, blob binary")


def shared_keys(dealt: DataFrame) -> DataFrame:
    """The rows whose key more than one set has: key, h1, h2, size, left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [unpack(x) for batch in batches for x in batch.column("blob").to_pylist()]
        if blobs:
            key, _, h1, h2, size, left = in_order(*map(np.concatenate, zip(*blobs)))
            same = key[1:] == key[:-1]
            held = np.append(same, False) | np.append(False, same)
            yield pa.RecordBatch.from_arrays([pa.array(x[held]) for x in (key, h1, h2, size, left)], ["key", "h1", "h2", "size", "left"])

    return dealt.mapInArrow(run, "key bigint, h1 bigint, h2 bigint, size bigint, left bigint")


def open_pairs(keys: DataFrame, parts: int, num: int, den: int) -> DataFrame:
    """Candidates among ``keys`` (key, h1, h2, size, left, component) of different components, with how many keys they share, as
    partial sums: h1, h2, g1, g2, size, size2, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), keys_schema)
        if not len(held):
            return
        key, number, h1, h2, size, left, group = in_order(*(held[c].to_numpy() for c in ("key", "h1", "h2", "size", "left", "component")))
        for a, b in candidates(key, number, size, h2, left, num, den, group, once=False):
            _, at, n = np.unique(number[a] << 32 | number[b], return_index=True, return_counts=True)
            a, b = a[at], b[at]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1[a], h2[a], h1[b], h2[b], size[a], size[b], n)], ["h1", "h2", "g1", "g2", "size", "size2", "n"])

    keys_schema = pa.schema([(c, pa.int64()) for c in ("key", "h1", "h2", "size", "left", "component")])
    return keys.select(*keys_schema.names).repartition(parts, "key").mapInArrow(run, "h1 bigint, h2 bigint, g1 bigint, g2 bigint, size bigint, size2 bigint, n bigint")


def contents(rows: DataFrame, units: Units, needs: DataFrame, firsts: DataFrame, most_broadcast: int) -> DataFrame:
    """The sets that ``needs`` (block, h1, h2) asks for, with ``firsts`` (h1, h2, row, unit).

    Rows: block, row, doc_id, unit, and where the unit's text stands: place ``slot`` of the block of bytes ``pack``; that block is a
    row of its own, ``blob``, for all units that one batch of texts sends to one block.  The table of wanted units is broadcast
    where it has at most ``most_broadcast`` bytes; else the texts are shuffled to it.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    wanted = needs.join(firsts, ["h1", "h2"]).groupBy("row").agg(F.collect_list(F.expr("shiftleft(cast(unit as bigint), 32) + block")).alias("wanted"))  # at most blocks x units of one text
    wanted = cut(wanted)
    if wanted.agg(F.coalesce(F.sum(F.size("wanted") * 8 + 56), F.lit(0))).first()[0] <= most_broadcast:
        wanted = F.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE):
            asked = batch.column("wanted")
            flat = asked.flatten().to_numpy()
            if not len(flat):
                continue
            owner = np.repeat(np.arange(len(batch)), pa.compute.list_value_length(asked).to_numpy())
            order = np.argsort(flat & 0xFFFFFFFF, kind="stable")
            flat, owner = flat[order], owner[order]
            block, number = (flat & 0xFFFFFFFF).astype(np.int32), (flat >> 32).astype(np.int32)
            parts = units.parts(as_bytes(batch.column("text")), owner, number)
            start, end = grouped(block)
            name = np.full(len(start), batch.column("row")[0].as_py())  # with the block: a batch has a first row of its own
            slot = np.arange(len(flat)) - np.repeat(start, end - start)
            n, k = len(flat), len(start)
            both = lambda x, y: pa.concat_arrays([x, y])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([block, block[start]])), *(both(batch.column(c).take(pa.array(owner)), pa.nulls(k, batch.column(c).type)) for c in ("row", "doc_id")), both(pa.array(number), pa.nulls(k, pa.int32())),
                    pa.array(np.concatenate([np.repeat(name, end - start), name])), both(pa.array(slot.astype(np.int32)), pa.nulls(k, pa.int32())), both(pa.nulls(n, pa.binary()), pa.array([text_blob(parts[i:j]) for i, j in zip(start, end)], pa.binary())),
                ],
                ["block", "row", "doc_id", "unit", "pack", "slot", "blob"],
            )

    return rows.join(wanted, "row").mapInArrow(run, f"block int, row bigint, doc_id {kind}, unit int, pack bigint, slot int, blob binary")


def text_blob(texts: list[bytes]) -> bytes:
    """Texts as one compressed block of bytes."""
    raw, sizes = b"".join(texts), squeeze(np.array([len(x) for x in texts]))
    return len(sizes).to_bytes(4, "little") + sizes + len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def texts_of(blob: bytes) -> list[bytes]:
    n = int.from_bytes(blob[:4], "little")
    size = int.from_bytes(blob[4 + n : 12 + n], "little")
    raw = pa.decompress(blob[12 + n :], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    ends = np.cumsum(swell(blob[4 : 4 + n])).tolist()
    return [raw[i:j] for i, j in zip([0, *ends], ends)]


def overlaps(a: np.ndarray, b: np.ndarray, sets: Sets) -> np.ndarray:
    """How many digests the sets a[i] and b[i] share, for a bounded number of digests at a time; ``a`` ascends."""
    out, upto, i = np.zeros(len(a), np.int64), np.cumsum(sets.size[a] + sets.size[b]), 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + ITEMS_AT_ONCE, side="right")))
        used, side = np.unique(np.concatenate([a[i:j], b[i:j]]), return_inverse=True)
        at, _, _ = spread(sets.start[used], sets.size[used], used)
        _, token = np.unique(sets.digest[at], return_inverse=True)
        size = sets.size[used]
        start = np.cumsum(size) - size
        met = []
        for x in (side[: j - i], side[j - i :]):
            places, pair, _ = spread(start[x], size[x], np.arange(j - i))
            met.append(pair << 32 | token[places])
        met = np.sort(np.concatenate(met))
        out[i:j] = np.bincount(met[1:][met[1:] == met[:-1]] >> 32, minlength=j - i)
        i = j
    return out


def verified(content: DataFrame, pairs: DataFrame, units: Units, side: int, num: int, den: int, counts: bool) -> DataFrame:
    """The links among ``pairs``: rows with a blob, or with h1, h2, g1, g2.

    With ``counts`` the number of a class's links and whether one of them leads to an earlier row, as partial sums
    (h1, h2, n_links, later); else each link as (u, v), by the rows of both.
    """
    kind = content.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found, packs = [], [], {}
        for batch in batches:
            is_set = pa.compute.is_valid(batch.column("row"))
            held.append(batch.filter(is_set).select(["row", "doc_id", "unit", "pack", "slot"]))
            rest = batch.filter(pa.compute.invert(is_set))
            for name, blob in zip(rest.column("pack").to_pylist(), rest.column("blob").to_pylist()):
                if name is not None:
                    packs[name] = blob
                elif blob is not None:
                    found.append(pairs_of(blob))
            plain = rest.filter(pa.compute.is_valid(rest.column("g1")))
            if len(plain):
                h, g = (np.concatenate([plain.column(c).to_numpy() for c in x]) for x in (("h1", "g1"), ("h2", "g2")))
                found.append((h, g, np.arange(len(plain), dtype=np.int32), np.arange(len(plain), 2 * len(plain), dtype=np.int32)))
        if not packs or not found:
            return
        content = pa.Table.from_batches(held).combine_chunks().sort_by([("pack", "ascending"), ("slot", "ascending")])
        sets = Sets.joined([Sets.of(*units.digests(texts_of(packs.pop(x)))[2:]) for x in sorted(packs)])
        if len(sets.size) != len(content):
            raise ValueError("a candidate has no words: the input did not read the same twice")
        h1, h2, row = sets.h1, sets.h2, content["row"].to_numpy()
        g1, g2, a, b = merged(found)
        found.clear()
        first, number = dense(np.concatenate([h1, g1]), np.concatenate([h2, g2]))
        place = np.full(len(first), -1)
        place[number[: len(h1)]] = np.arange(len(h1))
        there = place[number[len(h1) :]]
        if len(there) and there.min() < 0:
            raise ValueError("the content of a candidate is missing: the input did not read the same twice")
        a, b = there[a], there[b]
        pair = np.sort(np.minimum(a, b) << 32 | np.maximum(a, b))
        a, b = pair >> 32, pair & 0xFFFFFFFF
        ok = (num + den) * overlaps(a, b, sets) >= num * (sets.size[a] + sets.size[b])
        a, b = a[ok], b[ok]
        if not counts:
            yield pa.RecordBatch.from_arrays([pa.array(row[a]), pa.array(row[b])], ["u", "v"])
            del sets, content
            tidy()
            return
        names = [(x is None, x, i, j) for x, i, j in zip(content["doc_id"].to_pylist(), row.tolist(), content["unit"].to_pylist())]
        order = np.empty(len(names), np.int64)
        order[sorted(range(len(names)), key=lambda i: (names[i][0], *(names[i][2:] if names[i][0] else names[i][1:])))] = np.arange(len(names))
        links = np.bincount(a, minlength=len(row)) + np.bincount(b, minlength=len(row))
        later = np.zeros(len(row), bool)
        later[np.where(order[a] > order[b], a, b)] = True
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(h1[some]), pa.array(h2[some]), pa.array(links[some]), pa.array(later[some])], ["h1", "h2", "n_links", "later"])
        del sets, content, names
        tidy()

    plain = [F.col(c) if c in pairs.columns else F.lit(None).cast(t).alias(c) for c, t in (("block", "int"), ("h1", "bigint"), ("h2", "bigint"), ("g1", "bigint"), ("g2", "bigint"), ("blob", "binary"))]
    rest = (("row", "bigint"), ("doc_id", kind), ("unit", "int"), ("pack", "bigint"), ("slot", "int"))
    pairs = pairs.select(*plain, *(F.lit(None).cast(t).alias(c) for c, t in rest))
    both = content.withColumns({c: F.lit(None).cast("bigint") for c in ("h1", "h2", "g1", "g2")}).unionByName(pairs)
    return both.repartitionById(side * side, "block").mapInArrow(run, "h1 bigint, h2 bigint, n_links bigint, later boolean" if counts else "u bigint, v bigint")


def sizes(spark, n_units: int, n_keys: int, units_a_block: int = UNITS_A_BLOCK) -> tuple[int, int]:
    """Parts that keys are dealt to, two for a shuffle partition, as their arrays are wide; and blocks a side that pairs are dealt to."""
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), n_keys // KEYS_A_PART)
    return parts, max(int((n_units / units_a_block) ** 0.5), 2)

"""Prefix trie of conversations: ternary search trees over dictionary-encoded turns, a tree per range shard.

Distinct turns (role, text) are numbered in their order, and a conversation is the sequence of its turns' numbers.  Sequences are dealt
into shards by ranges of (sequence, conversation), so that copies of one conversation may lie in many shards.  A shard puts its distinct
sequences into a ternary search tree, the median of each span first, which keeps it balanced; a walk without recursion then adds up
members, children, leaves and savings from the ends to the root.  Nodes that a shard may share with a neighbour, the common prefixes of
sequences on the two sides of an edge, are merged by their path's digest afterwards; all others are final in their shard.

Defined results: a null role or text is empty; rows without a conversation id are left out; turns that tie are ordered by role and then text, and repeated
rows are turns of their own; a conversation without turns ends at the root; an empty table gives an empty result; extra columns are left out.
A conversation's numbers form one row, so it may have some 100 million turns.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._text import cut, tidy
from .placing import positions

PIECE = 10_000  # ids of conversations that end at a shared node, in one row
NODES = "key binary, shard int, piece int, ends string, above array<binary>, last_bytes bigint, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def encoded(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, pos, id, size): each turn's place in its conversation, its number in the dictionary and its text's bytes."""
    rows = df.select(
        F.col(f"`{id_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
        *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((role_col, "role"), (text_col, "text"))),
    ).filter("conv_id is not null")
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("digest")
    words = rows.select("role", "text").distinct().repartitionByRange("role", "text").sortWithinPartitions("role", "text")
    dictionary = cut(words.select(digest, F.octet_length("text").cast("long").alias("size"), F.monotonically_increasing_id().alias("id")))
    turns = rows.select("conv_id", "turn", digest).join(dictionary, "digest").drop("digest")
    return positions(turns, "conv_id", ["turn", "id"]).select("conv_id", "pos", "id", "size")


def ordered(items: str) -> Column:
    return F.array_sort(F.collect_list(items))


def rebuilt(turns: DataFrame, period: int, modulus: int) -> DataFrame:
    """(conv_id, ids, sizes): the first h turns of the conversation that starts each run of ``period``, then the own turns from h on; h is the crc32 of the id modulo ``modulus``."""
    turns = turns.withColumn("item", F.struct("pos", "id", "size")).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % modulus)
    own = turns.groupBy("conv_id", "h").agg(F.array_sort(F.collect_list(F.when(F.col("pos") >= F.col("h"), F.col("item")))).alias("own"))
    heads = turns.filter((F.col("conv_id") % period == 0) & (F.col("pos") < modulus - 1)).groupBy(F.col("conv_id").alias("base")).agg(ordered("item").alias("head"))
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % period).join(heads, "base", "left")
    head = F.filter(F.coalesce("head", F.expr("cast(array() as array<struct<pos:bigint,id:bigint,size:bigint>>)")), lambda x: x["pos"] < F.col("h"))
    items = both.select("conv_id", F.concat(head, "own").alias("items"))
    return items.select("conv_id", F.transform("items", lambda x: x["id"]).alias("ids"), F.transform("items", lambda x: x["size"]).alias("sizes"))


class Tree:
    """A ternary search tree over sequences of numbers.  A node stands for a prefix: its number comes after its parent's prefix."""

    def __init__(self) -> None:
        self.number: list[int] = [0]  # node 0 is the root: the empty prefix
        self.low: list[int] = [0]
        self.high: list[int] = [0]
        self.middle: list[int] = [0]
        self.size: list[int] = [0]
        self.ends: list[list[int]] = [[]]

    def node(self, number: int, size: int) -> int:
        for column, value in ((self.number, number), (self.low, 0), (self.high, 0), (self.middle, 0), (self.size, size), (self.ends, [])):
            column.append(value)
        return len(self.number) - 1

    def insert(self, ids: list[int], sizes: list[int], members: list[int]) -> None:
        at = 0
        for number, size in zip(ids, sizes):
            if not self.middle[at]:
                self.middle[at] = at = self.node(number, size)
                continue
            at = self.middle[at]
            while number != self.number[at]:
                side = self.low if number < self.number[at] else self.high
                if not side[at]:
                    side[at] = self.node(number, size)
                at = side[at]
        self.ends[at] = members

    def insert_sorted(self, rows: list[tuple[list[int], list[int], list[int]]]) -> None:
        """The median of each span before its halves."""
        spans = [(0, len(rows))]
        while spans:
            a, b = spans.pop()
            if a < b:
                m = (a + b) // 2
                self.insert(*rows[m])
                spans += [(a, m), (m + 1, b)]

    def walk(self) -> list[tuple[int, int, int]]:
        """(node, parent, depth), parents first."""
        out, todo = [(0, -1, 0)], [(self.middle[0], 0, 1)]
        while todo:
            at, parent, depth = todo.pop()
            if at:
                out.append((at, parent, depth))
                todo += [(self.low[at], parent, depth), (self.high[at], parent, depth), (self.middle[at], at, depth + 1)]
        return out


def shard_nodes(shard: int, rows: list[tuple[list[int], list[int], list[int]]], before: int, after: int) -> Iterator[dict]:
    """The nodes of a shard from its sorted distinct sequences (ids, sizes, members).

    ``before`` and ``after``: how many turns its first and last sequence share with the neighbouring shards.  Prefixes within these have a ``key``
    and hold only what final nodes below them add.
    """
    tree = Tree()
    tree.insert_sorted(rows)
    n = len(tree.number)
    key: list[bytes | None] = [None] * n
    above: list[list[bytes]] = [[]] * n
    for ids, depth in ((rows[0][0], before), (rows[-1][0], after)):
        at, path = 0, [blake2b(b"", digest_size=16).digest()]
        key[0] = path[0]
        for number in ids[:depth]:
            at = tree.middle[at]
            while tree.number[at] != number:
                at = tree.low[at] if number < tree.number[at] else tree.high[at]
            path.append(blake2b(path[-1] + number.to_bytes(8, "little"), digest_size=16).digest())
            key[at], above[at] = path[-1], path[:-1]
    order = tree.walk()
    count, least = [len(e) for e in tree.ends], [e[0] if e else None for e in tree.ends]
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    for at, parent, _ in reversed(order):
        if key[at] is None:
            leaves[at] = leaves[at] or 1
            saved[at] += (count[at] - 1) * tree.size[at]
        if parent >= 0:
            count[parent] += count[at]
            least[parent] = least[at] if least[parent] is None else min(least[parent], least[at])
            if key[at] is None:
                children[parent] += 1
                leaves[parent] += leaves[at]
                saved[parent] += saved[at]
    for at, parent, depth in order:
        out = {"shard": shard, "piece": 0, "depth": depth, "conv_id": least[at], "n_convs": count[at], "n_children": children[at], "n_leaves": leaves[at], "saved_tokens": saved[at], "last_bytes": tree.size[at]}
        if key[at] is None:
            shared = key[parent] is not None
            yield out | {"above": [key[parent]] if shared else None, "parent_conv_id": None if shared else least[parent], "ends_sha256": sha256(",".join(map(str, tree.ends[at])).encode()).hexdigest()}
            continue
        ends = tree.ends[at]
        for piece in range(max(1, -(-len(ends) // PIECE))):
            yield out | {"key": key[at], "above": above[at], "piece": piece, "ends": ",".join(map(str, ends[piece * PIECE : (piece + 1) * PIECE]))}


def merged(shared: DataFrame) -> DataFrame:
    """The nodes of more than one shard: sums over shards first, then over what is below each."""
    nodes = shared.filter("piece = 0").groupBy("key").agg(
        F.first("above").alias("above"), F.first("depth").alias("depth"), F.first("last_bytes").alias("last_bytes"), F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
    )
    nodes = cut(nodes.withColumn("parent", F.try_element_at("above", F.lit(-1))))
    below = nodes.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("more"))
    nodes = nodes.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    own = nodes.select(F.explode(F.concat("above", F.array("key"))).alias("key"), (F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("l"), (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("last_bytes")).alias("s"))
    sums = own.groupBy("key").agg(F.sum("l").alias("n_leaves"), F.sum("s").alias("saved_tokens"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            for k, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
                if k != key:
                    if key is not None:
                        yield one(key, state)
                    key, state = k, sha256(ends.encode())
                else:
                    state.update(b"," + ends.encode())
        if key is not None:
            yield one(key, state)

    def one(key: bytes, state) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    pieces = shared.filter("ends <> ''").repartition("key").sortWithinPartitions("key", "shard", "piece").select("key", "ends")  # one digest reads its ids in order, whatever their number
    ends = pieces.mapInArrow(hashed, "key binary, ends_sha256 string")
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.drop("n_leaves", "saved_tokens").join(sums, "key").join(ends, "key", "left").join(parents, "parent", "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())))


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(sequences: DataFrame, shard_turns: int = 200_000) -> DataFrame:
    """A row a node of the trie over ``sequences`` (conv_id, ids, sizes)."""
    spark = sequences.sparkSession
    kept = cut(sequences)
    turns = kept.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), turns // shard_turns + 1)
    shards = cut(kept.repartitionByRange(n, "ids", "conv_id").sortWithinPartitions("ids", "conv_id").select(F.spark_partition_id().alias("shard"), "conv_id", "ids", "sizes"))
    ends = shards.groupBy("shard").agg(F.min("ids").alias("first"), F.max("ids").alias("last"))
    following = ends.select("shard", "last", F.lead("shard").over(Window.orderBy("shard")).alias("next"), F.lead("first").over(Window.orderBy("shard")).alias("there"))  # a row a shard
    alike = F.zip_with("last", "there", lambda x, y: x.eqNullSafe(y))
    shared = F.when(F.array_position(alike, False) > 0, F.array_position(alike, False) - 1).otherwise(F.size("last"))
    edges = following.filter("next is not null").select("shard", "next", shared.cast("int").alias("n")).collect()  # three numbers a shard
    before, after = {r["next"]: r["n"] for r in edges}, {r["shard"]: r["n"] for r in edges}
    schema = pa.schema([("key", pa.binary()), ("shard", pa.int32()), ("piece", pa.int32()), ("ends", pa.string()), ("above", pa.list_(pa.binary())), *((c, pa.int64()) for c in ("last_bytes", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string())])

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = -1, []
        for batch in batches:
            for shard, conv, ids, sizes in zip(*(batch.column(c).to_pylist() for c in ("shard", "conv_id", "ids", "sizes"))):
                if rows and rows[-1][0] == ids:
                    rows[-1][2].append(conv)
                else:
                    rows.append((ids, sizes, [conv]))
        out = []
        for row in shard_nodes(shard, rows, before.get(shard, 0), after.get(shard, 0)) if rows else ():
            out.append(row)
            if len(out) == 2000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
        tidy()

    made = cut(shards.mapInArrow(nodes, NODES))
    joint = cut(merged(made.filter("key is not null")))
    parents = joint.select(F.col("key").alias("parent"), F.col("conv_id").alias("above_conv_id"))
    inner = made.filter("key is null").withColumn("parent", F.try_element_at("above", F.lit(1))).join(parents, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above_conv_id"))
    return inner.select(COLUMNS).union(joint.select(COLUMNS))


def conversation_trie(df: DataFrame, period: int = 5, modulus: int = 9, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of the rebuilt conversations; see ``rebuilt`` for how and ``trie`` for the rows."""
    return trie(rebuilt(encoded(df, id_col, turn_col, role_col, text_col), period, modulus))

"""Merkle manifest of a table with a proof for every row, by incremental witnesses.

Rows become leaves, leaves of a group (a source) form a tree of runs of ``FAN`` nodes, and the groups' roots form one more
such tree.  Leaves are appended in order, in blocks of ``FAN ** LEVELS`` aligned places, one block at a time in a task.  An open
run is the partial witness of all leaves below it: a node that is appended to it extends it, and once it is full, or its
block ends, it is complete for all of them and its digest is appended one level up.  So a witness is kept once a run, not once a leaf.  The roots
of blocks are further appends: they are dealt into blocks again until one node of each group is left, and then the groups' roots go
the same way.  What the rounds above a block add to its witnesses comes back in a join on the block.

Digests are lowercase hex sha256 and are hashed as text; they travel as 32 bytes.

Defined results: a null field is ``-`` in its leaf, a null group is a group of its own that comes first, null ids come first
in a group; rows that share an id are ordered by their leaves, so repeated rows are leaves side by side with proofs of their own;
a table of one row has the leaf as its root and the digest of the empty text as its proof; an empty table gives
an empty result; columns that are not among ``fields`` are left out, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import cut, lower_ascii, tidy
from .placing import positions

FAN = 16
LEVELS = 3
BLOCK = FAN**LEVELS
RUNS = "g string, block bigint, total bigint, run bigint, height int, root binary, digests binary, own array<{own}>, path array<struct<at:int,run:binary>>"


def digest(run: bytes) -> bytes:
    """The node above a run of digests."""
    return sha256(run.hex().encode()).digest()


def others(run: bytes, at: int) -> str:
    """The siblings of a run's node, as text."""
    return (run[: 32 * at] + run[32 * at + 32 :]).hex()


def folded(node: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The root above ``node`` with the siblings that ``path`` gives level by level."""
    for at, run in path:
        node = digest(run[: 32 * at] + node + run[32 * at + 32 :])
    return node


class Block:
    """A subtree that grows by appends."""

    def __init__(self) -> None:
        self.open = [bytearray() for _ in range(LEVELS + 1)]
        self.closed: list[list[bytes]] = [[] for _ in range(LEVELS)]

    def append(self, node: bytes, level: int = 0) -> None:
        """Extends the open run, the partial witness of all that is below it; a full run is closed and its digest goes one level up."""
        self.open[level] += node
        if level < LEVELS and len(self.open[level]) == 32 * FAN:
            self.complete(level)

    def complete(self, level: int) -> None:
        run = bytes(self.open[level])
        self.open[level].clear()
        self.closed[level].append(run)
        self.append(digest(run), level + 1)

    def close(self, height: int) -> bytes:
        """The root at ``height``: runs that are still open are closed as they are."""
        for level in range(height):
            if self.open[level]:
                self.complete(level)
        return bytes(self.open[height])

    def witness(self, run: int, height: int) -> list[tuple[int, bytes]]:
        """The levels above the ``run``-th run of leaves: (place, run) of each."""
        return [(run // FAN ** (level - 1) % FAN, self.closed[level][run // FAN**level]) for level in range(1, height)]


def appended(children: DataFrame) -> DataFrame:
    """A row a run of children, with its witness within the block and the block's root.  ``children``: g, pos, total, node, own."""

    def rows(key: tuple, total: int, nodes: bytearray, own: list[pa.Array]) -> pa.RecordBatch:
        """The runs of one block."""
        height = LEVELS if total > BLOCK else next(h for h in range(LEVELS + 1) if FAN**h >= total)
        block, n = Block(), len(nodes) // 32
        for i in range(n):
            block.append(bytes(nodes[32 * i : 32 * i + 32]))
        root = block.close(height)
        starts = list(range(0, n, FAN))
        k = len(starts)
        path = [[{"at": at, "run": run} for at, run in block.witness(r, height)] for r in range(k)]
        payload = pa.concat_arrays(own)
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]] * k, pa.string()), *(pa.array([x] * k, pa.int64()) for x in (key[1], total)), pa.array(range(k), pa.int64()), pa.array([height] * k, pa.int32()), pa.array([root] * k, pa.binary()),
             pa.array([bytes(nodes[32 * s : 32 * s + 32 * FAN]) for s in starts], pa.binary()), pa.ListArray.from_arrays(pa.array([*starts, n], pa.int32()), payload), pa.array(path, pa.list_(pa.struct([("at", pa.int32()), ("run", pa.binary())])))],
            ["g", "block", "total", "run", "height", "root", "digests", "own", "path"],
        )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, nodes, own = None, 0, bytearray(), []
        for batch in batches:
            keys = list(zip(batch.column("g").to_pylist(), batch.column("block").to_pylist()))
            start = 0
            while start < len(keys):
                end = start
                while end < len(keys) and keys[end] == keys[start]:
                    end += 1
                if keys[start] != key and key is not None:
                    yield rows(key, total, nodes, own)
                    nodes, own = bytearray(), []
                key, total = keys[start], batch.column("total")[start].as_py()
                nodes += b"".join(batch.column("node").slice(start, end - start).to_pylist())
                own.append(batch.column("own").slice(start, end - start))
                start = end
        if key is not None:
            yield rows(key, total, nodes, own)
        tidy()

    placed = children.withColumn("block", F.expr(f"pos div {BLOCK}"))
    dealt = placed.repartition("g", "block").sortWithinPartitions("g", "block", "pos").select("g", "block", "total", "node", "own")
    return cut(dealt.mapInArrow(stream, RUNS.format(own=children.schema["own"].dataType.simpleString())))


def forest(leaves: DataFrame) -> list[DataFrame]:
    """The rounds of appends, the first over ``leaves`` (g, pos, total, node, own), each later one over the roots of the blocks before."""
    rounds, most = [], leaves.agg(F.max("total")).first()[0] or 0
    while most:
        rounds.append(appended(leaves))
        most = -(-most // BLOCK) if most > BLOCK else 0
        leaves = rounds[-1].filter(f"run = 0 and total > {BLOCK}").select("g", F.col("block").alias("pos"), F.expr(f"(total - 1) div {BLOCK} + 1").alias("total"), F.col("root").alias("node"), F.struct(F.lit(0).alias("none")).alias("own"))
    return rounds


def roots(rounds: list[DataFrame]) -> DataFrame:
    """(g, node): each group's root, from the round in which one block was left of it."""
    tops = [r.filter(f"run = 0 and total <= {BLOCK}").select("g", F.col("root").alias("node")) for r in rounds]
    out = tops[0]
    for t in tops[1:]:
        out = out.union(t)
    return out


def above(rounds: list[DataFrame], outer: DataFrame) -> DataFrame:
    """(g, block, outer, node): what later rounds, and then ``outer`` (g, outer, node), add to the witnesses of the first round's blocks."""
    got = None
    for i in reversed(range(len(rounds))):
        tops = rounds[i].filter(f"run = 0 and total <= {BLOCK}").select("g", "block").join(outer, "g")
        got = tops if got is None else tops.unionByName(got)
        if i:
            got = children_paths(rounds[i], got)
    return got


def children_paths(r: DataFrame, got: DataFrame) -> DataFrame:
    """(g, block, outer, node) of the children of round ``r``, from those of its blocks."""
    wide = r.join(got, ["g", "block"]).select("g", F.col("block").alias("up"), "run", "digests", "height", "path", "outer", "node", F.posexplode("own").alias("at", "own"))
    first = F.when(F.col("height") > 0, F.array(F.struct(F.col("at").cast("int").alias("at"), F.col("digests").alias("run")))).otherwise(F.expr("array()").cast("array<struct<at:int,run:binary>>"))
    return wide.select("g", (F.col("up") * BLOCK + F.col("run") * FAN + F.col("at")).alias("block"), F.concat(first, "path", "outer").alias("outer"), "node")


def encoded(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: dict[str, Column]) -> Column:
    """The digest of the fields one after the other, each with its length in front of it."""
    return F.unhex(F.sha2(F.concat(*(encoded(c) for c in fields.values())), 256))


def proofs(df: DataFrame, fields: list[str], presented: dict[str, Column] | None = None, group_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """Per row: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``presented`` gives other values for some fields: folded_root is what the row's proof makes of the leaf that has those, and verified says whether
    that is the root.  proof_sha256 is the digest of the siblings, level by level from the leaf to the root, left to right.
    """
    own = {c: F.col(f"`{c}`") for c in fields}
    key = F.col(f"`{group_col}`").cast("string")
    rows = df.select(F.when(key.isNull(), "").otherwise(F.concat(F.lit("+"), key)).alias("g"), F.col(f"`{id_col}`").alias("id"), leaf(own).alias("node"), leaf(own | (presented or {})).alias("shown"))
    kind = rows.schema["id"].dataType.simpleString()
    rounds = forest(positions(rows, "g", ["id", "node"]).withColumn("own", F.struct("id", "shown")))
    if not rounds:
        return df.sparkSession.createDataFrame([], f"`{id_col}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    groups = roots(rounds).select(F.lit("").alias("one"), "g", "node")
    upper = forest(positions(groups, "one", ["g"]).select(F.col("one").alias("g"), "pos", "total", "node", F.struct(F.col("g").alias("of")).alias("own")))
    root = roots(upper).first()["node"]  # one digest
    nothing = F.expr("cast(array() as array<struct<at:int,run:binary>>)")
    tips = above(upper, upper[-1].filter("run = 0").select("g", nothing.alias("outer"), F.col("root").alias("node")))
    of = upper[0].select("block", "g", "run", F.posexplode("own").alias("at", "own")).select((F.col("block") * BLOCK + F.col("run") * FAN + F.col("at")).alias("block"), F.col("own.of").alias("of"))
    outer = children_paths(upper[0], tips).join(of, "block").select(F.col("of").alias("g"), "outer").join(groups.select("g", "node"), "g")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves, sub, proof, fold = [], [], [], []
            runs = zip(*(batch.column(c).to_pylist() for c in ("height", "digests", "path", "outer", "node")), batch.column("own").to_pylist())
            for height, run, path, outside, subroot, rows in runs:
                path = [(x["at"], x["run"]) for x in path + outside]
                rest = "".join(others(r, at) for at, r in path)
                genuine = folded(digest(run) if height else run, path)
                for i, row in enumerate(rows):
                    node = run[32 * i : 32 * i + 32]
                    leaves.append(node.hex())
                    sub.append(subroot.hex())
                    proof.append(sha256(((others(run, i) if height else "") + rest).encode()).hexdigest())
                    fold.append((genuine if row["shown"] == node else folded(row["shown"], [(i, run)] * (height > 0) + path)).hex())
            ids = pa.compute.struct_field(batch.column("own").flatten(), "id")
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.string()) for x in (leaves, sub, proof, fold))], ["id", "leaf", "subroot", "proof_sha256", "folded_root"])

    done = rounds[0].join(above(rounds, outer), ["g", "block"]).select("height", "digests", "path", "outer", "node", "own")
    out = done.mapInArrow(check, f"id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string")
    return out.select(F.col("id").alias(id_col), "leaf", "subroot", F.lit(root.hex()).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root.hex()).alias("verified"))


def tampered(text: Column, id_col: Column) -> Column:
    """The text with A-Z lower-cased where 5 divides the crc32 of the id, else as it is."""
    return F.when(F.crc32(id_col.cast("string")) % 5 == 0, lower_ascii(text)).otherwise(text)

"""Near-duplicate documents: SimHash first, then an exact set-similarity join over word shingles.

A document is the set of its shingles, known by 64-bit digests.  Two documents are linked where the Jaccard similarity of
their sets is at least num/den, and one document of each connected group stays.  Equal sets form one class, and only
classes are joined (``set_join``: prefix, length and position, then verification on whole sets).  Two similar sets share many
digests of their prefixes: all but few of the set whose prefix ends first must be in the other (count filter).

A first round verifies few pairs: fingerprints within two bits of each other, and each class with the smallest and the largest
one it shares a key with.  The second round verifies every pair that passes the filters and is not yet in one group, so no pair
at the similarity is missed, and a large group of copies does not cost its square in comparisons.

Defined results: null text is empty; texts without words are one class; with fewer words than a shingle the whole
sequence is the only shingle; rows without an id come after all others; an empty table gives an empty result; extra columns are kept
whatever their names.  Rows are told apart by their place in the input, so ``docs`` must be a table that reads the same each time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import set_join
from ._text import cut, fields_of, placed_rows
from .components import components
from .simhash import fold, links


DOCUMENTS_A_BLOCK = 12_500  # a document's set is some forty times a line's


def keep_one(docs: DataFrame, shingle: int = 5, num: int = 4, den: int = 5, most_broadcast: int = 16_000_000) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest doc_id, and of rows that repeat it the first."""
    spark, rows = docs.sparkSession, placed_rows(docs)
    units = set_join.Shingles(shingle)

    def fingerprints(_, text: np.ndarray, sets: set_join.Sets) -> dict[str, pa.Array]:
        fps = [fold(sets.digest[i : i + n]) for i, n in zip(sets.start, sets.size)]
        return {"fp": pa.array(np.array(fps, np.uint64).view(np.int64))}

    levels, worded = set_join.levels(rows, units, fingerprints, {"fp": "bigint"})
    blank = rows.filter(~F.col("text").rlike("[^ \\t-\\r]")).select("row", "doc_id", F.lit(0).alias("unit"), *(F.lit(0).cast("bigint").alias(c) for c in ("h1", "h2", "fp")))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    named = cut(worded.union(blank).select("h1", "h2", "fp", place.alias("place")))
    firsts = cut(named.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.first("fp").alias("fp")))
    found = firsts.select("h1", "h2", "fp", F.col("first.row").alias("row"))
    words = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 6
    parts, side = set_join.sizes(spark, firsts.count(), words // 4, DOCUMENTS_A_BLOCK)
    met = cut(set_join.shared_keys(set_join.dealt_keys(rows, units, levels, parts, num, den, 1 << 40)))  # no pairs of keys: all shared keys count

    def verified(pairs: DataFrame) -> DataFrame:
        """Links (u, v), by the rows of both, among the pairs (h1, h2, g1, g2)."""
        block: Column = F.pmod(F.col("h1"), F.lit(side)) * side + F.pmod(F.col("g1"), F.lit(side))
        swap = F.struct("h1", "h2") > F.struct("g1", "g2")
        pairs = pairs.select(*(F.when(swap, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("g1", "h1", "h1"), ("g2", "h2", "h2"), ("h1", "g1", "g1"), ("h2", "g2", "g2"))))
        pairs = cut(pairs.distinct().withColumn("block", block.cast("int")))
        needs = pairs.select("block", "h1", "h2").union(pairs.select("block", "g1", "g2")).distinct()
        content = set_join.contents(rows, units, needs, found.select("h1", "h2", "row", F.lit(0).alias("unit")), most_broadcast)
        return cut(set_join.verified(content, pairs, units, side, num, den, counts=False))

    # of the set that ends first within the prefixes, all but size - overlap must be shared; one less, as two keys of 40 bits may fall together
    enough = f"n >= ceil({num} * (size + size2) / {num + den}) - ceil(greatest(size, size2) * {num} / {den})"
    near = fingerprint_pairs(found).union(star_pairs(met).filter(enough).select("h1", "h2", "g1", "g2"))
    some = verified(near)
    group = components(some).withColumnRenamed("node", "row")
    of_class = found.join(group, "row", "left").select("h1", "h2", F.coalesce("component", "row").alias("component"))
    split = met.join(of_class, ["h1", "h2"])
    mixed = split.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("key")
    rest = set_join.open_pairs(split.join(mixed, "key"), parts, num, den).groupBy("h1", "h2", "g1", "g2", "size", "size2").agg(F.sum("n").alias("n")).filter(enough)
    group = components(some.union(verified(rest.select("h1", "h2", "g1", "g2")))).withColumnRenamed("node", "row")
    of_class = found.join(group, "row", "left").select("h1", "h2", F.coalesce("component", "row").alias("component"))
    grouped = cut(named.join(of_class, ["h1", "h2"]))
    stays = grouped.groupBy("component").agg(F.min("place").alias("stays"))
    gone = grouped.join(stays, "component").filter("place.row <> stays.row").select(F.col("place.row").alias("row"))
    return fields_of(docs).join(gone, "row", "left_anti").select("fields.*")


def fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (h1, h2, g1, g2) that connect all ``classes`` (h1, h2, fp) of one fingerprint, and of fingerprints within two bits."""
    worded = classes.filter("h1 <> 0 or h2 <> 0")
    hubs = worded.groupBy("fp").agg(F.min(F.struct("h1", "h2")).alias("hub"))
    same = worded.join(hubs, "fp").filter(F.struct("h1", "h2") != F.col("hub")).select("h1", "h2", "hub.h1", "hub.h2")
    close = links(worded).join(hubs.toDF("u", "x"), "u").join(hubs.toDF("v", "y"), "v").select("x.h1", "x.h2", "y.h1", "y.h2")
    return same.union(close).toDF("h1", "h2", "g1", "g2")


def star_pairs(met: DataFrame) -> DataFrame:
    """Each class with the smallest and the largest class that it shares a key with, and how many keys those share."""
    who = F.struct("size", "h1", "h2")
    ends = met.groupBy("key").agg(F.array(F.min(who), F.max(who)).alias("ends"))
    pairs = met.join(ends, "key").select("h1", "h2", "size", F.explode("ends").alias("end")).select("h1", "h2", F.col("end.h1").alias("g1"), F.col("end.h2").alias("g2"), "size", F.col("end.size").alias("size2"))
    return pairs.filter("h1 <> g1 or h2 <> g2").groupBy("h1", "h2", "g1", "g2", "size", "size2").agg(F.count("*").alias("n"))

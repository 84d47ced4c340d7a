"""Line deduplication by an exact set-similarity join.

A line is the set of its words (A-Z lowered); ``set_join`` puts words in one order by rarity, finds candidates by prefix, length and
position, and verifies Jaccard similarity of at least num/den on whole sets.

A line goes if an earlier line - smaller doc_id, then earlier row, then earlier in the text - is similar to it, whether
or not that one goes too.  Equal sets form one class; a class's later lines all go, and only the first lines of classes are joined.
A class's links to all others are counted, so a group of n near copies that all differ costs n * n comparisons of 64-bit maps and
as many verifications; exact copies cost nothing.

Defined results: null or empty texts and blank lines have no tokens, match nothing and stay as they are; rows
without an id come after all others; repeated rows are later copies of the first; an empty table gives an empty result;
extra columns are left out by ``report`` and kept by ``remove_lines`` whatever their names, which recounts n_chars where there is
such a column.  Rows are told apart by their place in the input, so ``docs`` must be a table that reads the same each time, as
files do.  Words are known by 64-bit digests and classes by 128 bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import set_join
from ._text import cut, fields_of, placed_rows


def judged(docs: DataFrame, num: int = 4, den: int = 5, frequent: int = 1000, most_broadcast: int = 16_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every line with a word: row, doc_id, line, class_doc_id, class_line, n_links, removed."""
    if not den < 2 * num < 2 * den:
        raise ValueError("the similarity must be over a half and under one")
    spark, rows = docs.sparkSession, placed_rows(docs, id_col, text_col)
    levels, all_lines = set_join.levels(rows, set_join.Lines())
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row", "unit")
    firsts = cut(all_lines.groupBy("h1", "h2").agg(F.min(place).alias("first")))
    n = firsts.count()
    parts, side = set_join.sizes(spark, n, 10 * n)
    found = cut(set_join.candidate_blocks(set_join.dealt_keys(rows, set_join.Lines(), levels, parts, num, den, frequent), side, num, den))
    needs = found.filter("blob is null").select("block", "h1", "h2")
    content = set_join.contents(rows, set_join.Lines(), needs, firsts.select("h1", "h2", "first.row", "first.unit"), most_broadcast)
    parts_of = set_join.verified(content, found.filter("blob is not null").select("block", "blob"), set_join.Lines(), side, num, den, counts=True)
    linked = parts_of.groupBy("h1", "h2").agg(F.sum("n_links").alias("n_links"), F.max("later").alias("later"))
    linked = cut(linked)
    is_first = (F.col("row") == F.col("first.row")) & (F.col("unit") == F.col("first.unit"))
    return all_lines.select("row", "doc_id", "unit", "h1", "h2").join(firsts, ["h1", "h2"]).join(linked, ["h1", "h2"], "left").select(
        "row", "doc_id", F.col("unit").alias("line"), F.col("first.doc_id").alias("class_doc_id"), F.col("first.unit").alias("class_line"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), (~is_first | F.coalesce("later", F.lit(False))).alias("removed"),
    )


def report(docs: DataFrame, **options) -> DataFrame:
    """Per line with a word: doc_id, line (from 0), class_doc_id and class_line (the first line of its class), n_links
    (other classes similar to it), removed."""
    return judged(docs, **options).drop("row")


def remove_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the removed lines, in the same columns."""
    id_col, text_col, most = options.get("id_col", "doc_id"), options.get("text_col", "text"), options.get("most_broadcast", 16_000_000)
    gone = cut(judged(docs, **options).filter("removed").groupBy("row").agg(F.collect_list("line").alias("gone")))
    if gone.agg(F.coalesce(F.sum(F.size("gone") * 4 + 48), F.lit(0))).first()[0] <= most:
        gone = F.broadcast(gone)  # else the texts are shuffled
    joined = fields_of(docs).join(gone, "row", "left")
    text = F.col(f"fields.`{text_col}`")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("gone", i)), "\n")
    out = {c: F.col(f"fields.`{c}`") for c in docs.columns}
    out[text_col] = F.when(F.col("gone").isNull(), text).otherwise(kept)
    if "n_chars" in out and id_col != "n_chars":
        out["n_chars"] = F.when(F.col("gone").isNull(), out["n_chars"]).otherwise(F.length(kept).cast(docs.schema["n_chars"].dataType))
    return joined.select(F.struct(*(c.alias(name) for name, c in out.items())).alias("out")).select("out.*")  # a struct: names of the table do not shadow ours

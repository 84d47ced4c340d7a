"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade <= k) = sigmoid(theta_k - w.x) with one weight vector w for all thresholds theta_0 < theta_1 < ...; a document's
expected severity is the sum of grade * P(grade).  Features are a word (stripped of outer punctuation, A-Z lowered) and
its prefixes of 4, 5 and 6 characters; a feature's value is log(1 + its count).  Only features that toxic training
documents carry clearly more often than others get a weight, so a clean document is usually all zeros: labels have noise, and what a few long
documents with wrong labels share must not crowd out the words that matter.

``fit`` uses at most ``max_rows`` rows of labelled documents, chosen by a hash of their ids; feature counts are made by Spark,
and the driver gets only the vectors over the chosen features: the ``max_features`` with the best lift in that sample.  Grades: 0 where the label is not toxic; toxic documents
get 1, 2 or 3 by thirds of the sum of their features' values, since the label itself is binary.  The model adds up the same values, so a higher grade
asks for a higher sum; grades by another measure, such as a share of the words, hold the weights of telling words down.

Defined results: null or empty text has no features and so the lowest severity; without a toxic and a clean
training document every score is zero and nothing is toxic; null labels and ids that are missing on one side
do not train; repeated label rows: the larger label counts once; extra columns are left out or, in ``keep_clean``, kept.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import as_bytes, cut, id_text, pieces

PREFIXES = (4, 5, 6)
EDGES = b"".join(bytes([c]) for c in range(33, 127) if not chr(c).isalnum())


def features(word: bytes) -> list[bytes]:
    """Features of a lower-cased word: itself, and its prefixes marked with *."""
    word = word.strip(EDGES)
    if not word:
        return []
    text = word.decode()
    return [word] + [text[:n].encode() + b"*" for n in PREFIXES if len(text) > n]


class Weights(dict):
    """Word -> indices of the features that have a weight; filled as words are met, emptied when large."""

    def __init__(self, index: dict[bytes, int], most: int = 300_000):
        self.index, self.most = index, most

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        self[word] = got = tuple(self.index[f] for f in features(word) if f in self.index)
        return got


def vector(text: bytes, index: Weights) -> Counter:
    """Feature counts."""
    return Counter(i for x in map(index.__getitem__, text.lower().split()) for i in x)


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int) -> DataFrame:
    """(doc_id, text, toxic) of at most ``max_rows`` rows of labelled documents, written once.

    The ids are at most ``max_rows`` and so broadcast; of rows that repeat an id, the first by a hash of the text are taken.
    """
    chosen = labels.select("doc_id", F.col(label_col).cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = id_text(docs).join(F.broadcast(chosen), "doc_id")
    return cut(rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(max_rows))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows: int = 8000, least_docs: int = 4, least_ratio: float = 4.0, least_excess: float = 6.0, max_features: int = 4000, steps: int = 300) -> dict:
    """{"features": [...], "weights": array, "thresholds": array}

    ``least_excess``: by how many times the root of the toxic documents that chance alone would give a feature its toxic documents must exceed these.
    """
    sample = training_sample(docs, labels, label_col, max_rows)

    def count(batches):
        seen: dict[bool, Counter] = {False: Counter(), True: Counter()}
        n = [0, 0]
        for batch in pieces(batches):
            for text, toxic in zip(as_bytes(batch.column("text")), batch.column("toxic").to_pylist()):
                n[toxic > 0] += 1
                seen[toxic > 0].update({f for w in set(text.lower().split()) for f in features(w)})
        keys = list(seen[True])  # a feature no toxic document has cannot be chosen
        others = [f for f in seen[False] if f not in seen[True]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([b"", *keys, *others], pa.binary()), pa.array([n[1], *(seen[True][f] for f in keys), *(0 for _ in others)], pa.int64()), pa.array([n[0], *(seen[False][f] for f in keys), *(seen[False][f] for f in others)], pa.int64())],
            ["feature", "toxic", "clean"],
        )

    counts = sample.mapInArrow(count, "feature binary, toxic bigint, clean bigint").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    total = counts.filter("feature = X''").first()
    if not total or not total["toxic"] or not total["clean"]:
        return {"features": [], "weights": np.zeros(0), "thresholds": np.array([30.0, 31.0, 32.0])}
    ratio = (F.col("toxic") + 0.5) / (total["toxic"] + 1) / ((F.col("clean") + 0.5) / (total["clean"] + 1))
    chance = (F.col("toxic") + F.col("clean")) * (total["toxic"] / (total["toxic"] + total["clean"]))
    clear = F.col("toxic") - chance >= least_excess * F.sqrt(chance)
    chosen = counts.filter("feature <> X''").filter((F.col("toxic") >= least_docs) & (ratio >= least_ratio) & clear).orderBy((ratio * F.sqrt("toxic")).desc(), "feature").limit(max_features)
    names = [bytes(r[0]) for r in chosen.select("feature").collect()]
    place = {f: i for i, f in enumerate(names)}

    def vectors(batches):
        index = Weights(place)
        for batch in pieces(batches):
            got = [vector(t, index) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array([list(c) for c in got], pa.list_(pa.int32())), pa.array([list(c.values()) for c in got], pa.list_(pa.int32()))],
                ["toxic", "at", "n"],
            )

    rows = sample.mapInArrow(vectors, "toxic int, at array<int>, n array<int>").collect()  # at most ``max_rows``
    rows.sort(key=lambda r: (r["toxic"], r["at"], r["n"]))  # so that sums do not depend on the order of tasks
    owner = np.repeat(np.arange(len(rows)), [len(r["at"]) for r in rows])
    at = np.array([i for r in rows for i in r["at"]], np.int64)
    value = np.log1p(np.array([i for r in rows for i in r["n"]], float))
    toxic = np.array([r["toxic"] > 0 for r in rows])
    amount = np.bincount(owner, value, len(rows)) if len(at) else np.zeros(len(rows))
    thirds = np.quantile(amount[toxic], [1 / 3, 2 / 3])
    grade = np.where(toxic, 1 + np.searchsorted(thirds, amount, side="left"), 0)
    weights, thresholds = cumulative_link(owner, at, value, grade, len(names), 4, steps)
    return {"features": names, "weights": weights, "thresholds": thresholds}


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def cumulative_link(owner, at, value, grade, n_features: int, n_grades: int, steps: int, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the mean negative log-likelihood; thresholds are a first one plus exponentiated gaps."""
    n = len(grade)
    par = np.zeros(n_features + n_grades - 1)
    par[n_features] = 2.0
    mean, square = np.zeros_like(par), np.zeros_like(par)
    rows = np.arange(n)
    for step in range(1, steps + 1):
        w, raw = par[:n_features], par[n_features:]
        theta = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
        eta = np.bincount(owner, w[at] * value, n) if len(at) else np.zeros(n)
        edge = np.concatenate([np.zeros((n, 1)), sigmoid(theta[None, :] - eta[:, None]), np.ones((n, 1))], axis=1)
        slope = edge * (1 - edge)
        p = np.maximum(edge[rows, grade + 1] - edge[rows, grade], 1e-12)
        d_eta = (slope[rows, grade + 1] - slope[rows, grade]) / p / n
        d_theta = np.zeros(n_grades - 1)
        for k in range(n_grades - 1):
            d_theta[k] = (np.sum((slope[:, k + 1] / p)[grade == k + 1]) - np.sum((slope[:, k + 1] / p)[grade == k])) / n
        d_raw = np.cumsum(d_theta[::-1])[::-1] * np.concatenate([[1.0], np.exp(raw[1:])])
        g = np.concatenate([(np.bincount(at, d_eta[owner] * value, n_features) if len(at) else np.zeros(n_features)) + ridge * w, d_raw])
        mean = 0.9 * mean + 0.1 * g
        square = 0.999 * square + 0.001 * g * g
        par -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    return par[:n_features], np.cumsum(np.concatenate([par[n_features : n_features + 1], np.exp(par[n_features + 1 :])]))


def score_texts(texts: list[bytes], model: dict, index: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Expected severity and P(grade >= 1)."""
    eta = np.array([sum(model["weights"][i] * np.log1p(n) for i, n in vector(t, index).items()) for t in texts], float)
    above = 1 - sigmoid(model["thresholds"][None, :] - eta[:, None])
    return above.sum(axis=1), above[:, 0]


def score(df: DataFrame, model: dict, reject_at: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, severity (expected grade, 0 to 3), p_toxic, grade (severity rounded), toxic (p_toxic >= reject_at)."""
    place = {f: i for i, f in enumerate(model["features"])}

    def run(batches):
        index = Weights(place)
        for batch in pieces(batches):
            severity, p = score_texts(as_bytes(batch.column("text")), model, index)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(severity), pa.array(p), pa.array(np.rint(severity).astype(np.int32)), pa.array(p >= reject_at)], ["doc_id", "severity", "p_toxic", "grade", "toxic"])

    rows = id_text(df, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, severity double, p_toxic double, grade int, toxic boolean")


def keep_clean(docs: DataFrame, model: dict, reject_at: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text is toxic."""
    place = {f: i for i, f in enumerate(model["features"])}

    def run(batches):
        index = Weights(place)
        for batch in pieces(batches):
            _, p = score_texts(as_bytes(batch.column("text")), model, index)
            yield batch.filter(pa.array(p < reject_at))

    return docs.mapInArrow(run, docs.schema)

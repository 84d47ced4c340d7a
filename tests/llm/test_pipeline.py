"""The pipeline against a brute-force version of every stage."""

import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

from .test_operators import words  # noqa: E402

ITEM = "name the seven bridges that cross the river between the old town and the harbour in the north"


def sentence(r):
    return " ".join("".join(r.choice("ka lo mi re su ta vo ne".split()) for _ in range(r.randint(1, 4))) for _ in range(r.randint(6, 14)))


def make_docs():
    r = random.Random(8)
    docs = []
    for k in range(160):
        lines = [sentence(r) for _ in range(r.randint(2, 8))]
        if k % 5 == 0:
            lines[0] += " idiot scum moron idiot"
        if k in (31, 77):
            lines.insert(1, ITEM)
        docs.append((k, "\n".join(lines)))
    docs += [(200, docs[3][1]), (201, docs[4][1] + "\n" + sentence(r)), (202, None), (203, ""), (204, docs[6][1].split("\n")[0])]
    return docs


def brute(docs, tokenizer):
    clean = [(i, t or "") for i, t in docs if "idiot" not in (t or "")]
    seen, out = [], []
    for i, t in clean:
        kept = []
        for line in t.split("\n"):
            s = frozenset(words(line))
            if s and any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                continue
            kept.append(line)
            if s:
                seen.append(s)
        # a removed line still removes later ones, so it is remembered as well
        seen += [frozenset(words(x)) for x in t.split("\n") if words(x)]
        out.append((i, "\n".join(kept)))
    import xxhash

    def fingerprint(t):
        w = words(t)
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(len(w) - 2)] or ([xxhash.xxh64_intdigest(" ".join(w).encode(), 42)] if w else [])
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fingerprint(t) for _, t in out]
    group = list(range(len(out)))
    for a in range(len(out)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                group = [group[b] if g == group[a] else g for g in group]
    single = [out[k] for k in range(len(out)) if k == min(j for j in range(len(out)) if group[j] == group[k])]
    final = [(i, t) for i, t in single if ITEM not in t]
    rows = set()
    for i, t in final:
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [0], "<u4")
        rows.add((i, 0, 0, len(ids), zlib.crc32(ids.tobytes())))
    return rows


def test_pipeline_equals_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = make_docs()
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int("idiot" in (t or ""))) for i, t in docs if i < 120], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, ITEM)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {tuple(map(int, r)) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)} == brute(docs, tokenizer)
    ordered = got.sort_values(["sequence_id", "offset"])
    assert ((ordered.groupby("sequence_id").length.cumsum() - ordered.length) == ordered.offset).all() and got.groupby("sequence_id").length.sum().max() <= 2048


def test_stages_keep_the_columns_of_documents():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]


def test_near_dedup_finds_every_similar_pair(spark):
    """Copies with a few words changed and lines broken elsewhere, which neither line dedup nor two bits of a fingerprint find."""
    r = random.Random(3)
    docs = []
    for k in range(30):
        w = " ".join(sentence(r) for _ in range(12)).split()
        docs.append((k * 10, " ".join(w)))
        for copy in range(1, 4):
            x = list(w)
            for _ in range(copy):
                x[r.randrange(len(x))] = f"new{r.randrange(10**6)}"
            docs.append((k * 10 + copy, "\n".join(" ".join(x[i : i + 7 + copy]) for i in range(0, len(x), 7 + copy))))
    docs += [(1000 + k, docs[0][1] + f" end{k} of it") for k in range(60)] + [(2000, "a b c"), (2001, "A b\nc"), (2002, "a b d"), (2003, None), (2004, ""), (None, docs[4][1]), (None, "alone " + docs[8][1][::-1]), (300, docs[0][1]), (300, docs[0][1])]

    def shingles(t):
        w = words(t)
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in docs]
    group = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0, k))
    first = {}
    for k in order:
        first.setdefault(group[k], k)
    expected = sorted(((docs[k][0], docs[k][1]) for k in first.values()), key=str)
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1)
    got = corpus_pipeline.near_dedup_stage(spark, frame, "")
    assert got.columns == frame.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == expected
    assert corpus_pipeline.near_dedup_stage(spark, frame.limit(0), "").count() == 0

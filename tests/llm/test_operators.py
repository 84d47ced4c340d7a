"""Each operator against a brute-force version, and on the texts of cases.py."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

public_tokenizers = pytest.importorskip("public_tokenizers")

from tidewater.llm import decontamination, license_scan, line_dedup, packing, ppm, repetition, simhash, token_counts, toxicity, url_filter  # noqa: E402

from .cases import TEXTS, WORDS, empty, frame, prose  # noqa: E402

BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def test_token_counts(spark, library):
    expected = sorted(((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in TEXTS), key=str)
    assert rows(token_counts.count_tokens(frame(spark), BPE)) == expected
    chunked = token_counts.count_tokens(frame(spark), BPE, chunk_chars=7, split_chars=40)
    assert rows(chunked) == expected
    assert rows(token_counts.count_tokens(empty(spark), BPE)) == []


def test_transducer_equals_library_on_random_bytes(library):
    counter = token_counts.Counter(BPE)
    rng = np.random.default_rng(5)
    alphabet = list("abcdefgh ehtnoi\n\t  'sA1,.-é中 ") + ["<|endoftext|>", "the", "ing", " of"]
    for _ in range(300):
        text = "".join(rng.choice(alphabet, size=rng.integers(1, 60)))
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)
        for size in (3, 9):
            assert composed(text, size, counter) == counter.count(text), repr(text)


def composed(text, size, counter):
    chunks = token_counts.chunks_of(text, size, counter)
    assert "".join(c for c, _, _ in chunks) == text
    return token_counts.composed([token_counts.chunk_map(*x, counter) for x in chunks], counter)


def test_chunk_maps_compose_without_spaces(spark, library):
    """Runs without a token's edge: other alphabets, one repeated letter, signs, digits; the maps meet, not the texts."""
    counter, r = token_counts.Counter(BPE), random.Random(6)
    texts = ["".join(r.choice("中文字测试語学校時間") for _ in range(9000)), "a" * 9001, "=" * 8000 + "-" * 777, "1234567890" * 700, "word" * 1999 + "'s" * 50, "ab" * 3000 + "<|endoftext|>" * 9 + "é" * 3000, " " * 5000 + "x", "\n" * 400]
    for text in texts:
        n = len(library.encode(text, add_special_tokens=False).ids)
        maps = [token_counts.chunk_map(*x, counter) for x in token_counts.chunks_of(text, 500, counter)]
        assert token_counts.composed(maps, counter) == n == counter.count(text), text[:20]
        if " " not in text[:2] and "\n" not in text:
            assert len(maps) > 10 and max(len(m["head"]) for m in maps) <= token_counts.WINDOW
    long = "".join(r.choice("的一是不了人我在有他这中大来上国") for _ in range(60_000))
    got = token_counts.count_tokens(frame(spark, [(1, long), (2, "short"), (3, None)]), BPE, chunk_chars=2000, split_chars=10_000)
    assert {(x["doc_id"], x["n_bytes"], x["n_tokens"]) for x in got.collect()} == {(1, 180_000, len(library.encode(long, add_special_tokens=False).ids)), (2, 5, len(library.encode("short", add_special_tokens=False).ids)), (3, 0, 0)}


def test_license_rules_equal_brute_force():
    """Every placement of a rule's identifiers among the sentences, in the order of the rules, over random sequences."""
    r = random.Random(9)
    names = list(license_scan.SENTENCES)[:14]
    rules = [(f"L{k}", [r.choice(names) for _ in range(r.randint(1, 3))]) for k in range(25)]
    for _ in range(400):
        ids = [r.choice([*names, None, None, None]) for _ in range(r.randint(0, 14))]
        for gap in (0, 1, 3):
            left, expected = dict(enumerate(ids)), []
            for name, wanted in rules:
                for start in range(len(ids)):
                    taken, at = [], start
                    for x in wanted:
                        while at < len(ids) and ids[at] is None and taken:
                            at += 1
                        if at >= len(ids) or ids[at] != x or at not in left or taken and at - taken[-1] - 1 > gap:
                            break
                        taken.append(at)
                        at += 1
                    if len(taken) == len(wanted):
                        expected.append((taken[0], name))
                        for x in taken:
                            del left[x]
            assert license_scan.apply_rules(ids, rules, gap) == [n for _, n in sorted(expected)], (ids, gap)


def test_every_known_license_sentence_is_found(spark):
    """Each rule's own sentences, wrapped and commented as in source files, give that rule's licence first."""
    texts = []
    for k, (_, wanted) in enumerate(license_scan.RULES):
        body = " ".join(license_scan.SENTENCES[x] for x in wanted).split(" ")
        lines = [" ".join(body[i : i + 9]) for i in range(0, len(body), 9)]
        texts.append((k, "/*\n" + "\n".join(" * " + x for x in lines) + "\n */\nint main() {}"))
    got = {x["doc_id"]: x["license"] for x in license_scan.scan(frame(spark, texts)).collect()}
    assert {k: got[k] for k in got} == {k: name for k, (name, _) in enumerate(license_scan.RULES)}


def test_packing(spark, library):
    capacity = 64
    got = packing.pack(frame(spark), BPE, capacity=capacity, bucket_rows=4).toPandas()
    sizes = collections.Counter()
    for i, t in TEXTS:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        first = len(ids) % capacity or capacity
        edges = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            sizes[None if i is None else float(i), k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    found = collections.Counter((None if math.isnan(r.doc_id) else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples())
    assert found == sizes
    ordered = got.sort_values(["sequence_id", "offset"])
    assert ((ordered.groupby("sequence_id").length.cumsum() - ordered.length) == ordered.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= capacity
    assert rows(packing.pack(empty(spark), BPE)) == []


def test_best_two_fit_beats_greedy():
    bins = packing.plan({6: 1, 3: 1, 5: 1, 2: 2}, 10)  # greedy 6 + 3 leaves one place; 6 + 2 + 2 fills it
    assert sorted(bins[0][0]) == [2, 2, 6]
    rng = np.random.default_rng(1)
    histogram = collections.Counter(int(x) for x in rng.integers(1, 100, 2000))
    bins = packing.plan(histogram, 100)
    assert collections.Counter(x for held, n in bins for x in held for _ in range(n)) == histogram
    gaps: list[int] = []  # first-fit decreasing
    for length in sorted(histogram.elements(), reverse=True):
        at = next((i for i, g in enumerate(gaps) if g >= length), None)
        if at is None:
            gaps.append(100 - length)
        else:
            gaps[at] -= length
    assert sum(n for _, n in bins) <= len(gaps)


def test_repetition(spark):
    texts = TEXTS + [(20, "a b c d e f " * 3 + "q r s"), (21, "p q r s t u\nlonger here p q r s t u end of it now"), (22, prose(9, 4))]
    got = {(r["doc_id"], r["n_words"]): r for r in repetition.repetition(frame(spark, texts)).collect()}
    for i, t in texts:
        w = WORD.findall(t or "")
        grams = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i, len(w)]
        assert (r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(cover) > 20 * len(w))
        if len(w) < 200:
            longest = max((n for n in range(len(w)) for a in range(len(w) - n + 1) for b in range(a + 1, len(w) - n + 1) if w[a : a + n] == w[b : b + n]), default=0)
            assert r["longest_repeat"] == longest
    assert rows(repetition.repetition(empty(spark))) == []


def test_repetition_rejects_passages_that_the_base_rule_keeps(spark):
    own = [f"w{k}" for k in range(800)]
    twice = own[:400] + own[100:160] + own[400:740]  # 60 words twice: 120 of 800
    phrases = [w for k in range(0, 680, 34) for w in own[k : k + 34] + own[: 6 * (k % 68 == 0)]]  # 6 words again and again: 66 of 740
    got = {r["doc_id"]: r for r in repetition.repetition(frame(spark, [(1, " ".join(twice)), (2, " ".join(phrases)), (3, " ".join(own))])).collect()}
    assert (got[1]["n_words"], got[1]["passage_words"], got[2]["passage_words"]) == (800, 120, 0) and got[2]["covered_words"] > 50
    assert [(got[i]["base_failed"], got[i]["kept"]) for i in (1, 2, 3)] == [(False, False), (False, True), (False, True)]


def test_simhash(spark):
    def fingerprint(t):
        w = words(t)
        shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    texts = TEXTS + [(100 + k, prose(400, 9) + " tail" * k) for k in range(6)]
    got = rows(simhash.near_duplicates(frame(spark, texts)))
    fps = [(i, fingerprint(t)) for i, t in texts]
    group = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 2:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min(i for (i, _), h in zip(fps, group) if h == g and i is not None) if any(i is not None for (i, _), h in zip(fps, group) if h == g) else None for g in set(group)}
    assert got == sorted(((i, f"{f:016x}", least[g]) for (i, f), g in zip(fps, group)), key=str)
    kept = rows(simhash.keep_one(frame(spark)).select("doc_id"))
    assert (10,) in kept and kept.count((10,)) == 1 and (5,) not in kept
    assert rows(simhash.near_duplicates(empty(spark))) == []


def test_line_dedup(spark):
    base = prose(40, 5).replace("\n", " ").split()
    near = [(200 + k, "\n".join([" ".join(base[:30]), " ".join(base[:30] + ["new"] * (k % 2) + [f"w{k}"]), "", "short one", f"own line {k} of the document here"])) for k in range(8)]
    texts = TEXTS + near
    got = {(r["doc_id"], r["line"]): r for r in line_dedup.report(frame(spark, texts), frequent=2).collect()}
    order = sorted(range(len(texts)), key=lambda k: (texts[k][0] is None, texts[k][0] or 0, k))
    lines = [(texts[k][0], k, j, frozenset(words(x))) for k in order for j, x in enumerate((texts[k][1] or "").split("\n")) if words(x)]
    sets = list(dict.fromkeys(s for *_, s in lines))
    similar = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    seen = set()
    for i, k, j, s in lines:
        earlier = next((t for t in sets[: sets.index(s)] if similar(s, t)), None)
        removed = s in seen or earlier is not None
        if texts.count(texts[k]) == 1:
            r = got[i, j]
            assert r["removed"] == removed and r["n_links"] == sum(similar(s, t) for t in sets if t != s), (i, j)
        seen.add(s)
    left = {r["doc_id"]: r["text"] for r in line_dedup.remove_lines(frame(spark, near)).collect()}
    assert left[201].split("\n") == ["", "own line 1 of the document here"] or left[201].split("\n") == [""], left[201]
    assert set(line_dedup.remove_lines(frame(spark)).columns) == set(frame(spark).columns)
    assert rows(line_dedup.report(empty(spark))) == []


def test_line_dedup_links_every_similar_pair(spark):
    """Random edits of a few lines, long and short, against all pairs; also where hardly any token counts as rare, and by the shuffled join."""
    r = random.Random(11)
    pool = [f"tok{k}" for k in range(90)]
    lines = []
    for k in range(24):
        base = r.sample(pool, r.choice((5, 8, 20, 45)))
        for _ in range(10):
            edited = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 6))):
                edited[r.randrange(len(edited))] = r.choice(pool)
            lines.append(" ".join(edited))
    docs = [(k // 3 if k // 3 != 5 else None, lines[k : k + 3]) for k in range(0, len(lines), 3)]
    docs = [(i, "\n".join(x)) for i, x in docs]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0, k))
    placed = [(docs[k][0], j, frozenset(x.split())) for k in order for j, x in enumerate(docs[k][1].split("\n"))]
    sets = list(dict.fromkeys(s for *_, s in placed))
    similar = {(a, b) for a in sets for b in sets if a != b and 5 * len(a & b) >= 4 * len(a | b)}
    expected, seen = [], []
    for i, j, s in placed:
        expected.append((i, j, sum(a == s for a, _ in similar), s in seen or any((s, t) in similar for t in seen)))
        seen.append(s)
    for options in ({}, {"frequent": 3}, {"frequent": 20, "most_broadcast": -1}):
        got = [(x["doc_id"], x["line"], x["n_links"], x["removed"]) for x in line_dedup.report(frame, **options).collect()]
        assert sorted(got, key=str) == sorted(expected, key=str), options


def test_line_dedup_keeps_names(spark):
    """Columns with the operator's own names, empty tables, and the text that is left."""
    docs = spark.createDataFrame([(1, "a b c d e\nx", 7, "g", 11), (2, "A b c d e\ny", 8, "h", 11), (3, None, 9, None, 0)], "doc_id bigint, text string, row int, gone string, n_chars bigint").coalesce(1)
    out = line_dedup.remove_lines(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(1, "a b c d e\nx", 7, "g", 11), (2, "y", 8, "h", 1), (3, None, 9, None, 0)]
    assert line_dedup.remove_lines(docs.limit(0)).collect() == []


def test_ppm(spark):
    texts = [(k, prose(80, k)) for k in range(60)] + [(i, t) for i, t in TEXTS if i is None or i > 60 or i in (9, 12)] + [(61, None), (62, "")]
    got = ppm.score(frame(spark, texts), order=3, hot_words=5).toPandas()
    blocks = ppm.score(frame(spark, texts), order=3, hot_words=5, block_grams=200).toPandas()
    train = collections.Counter()
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in texts}
    for i, t in texts:
        if not held[i]:
            train.update(words(t) + ["\n"])
    n, v = sum(train.values()), len(train)
    base = sorted(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words(t) + ["\n"]) for _, t in texts)
    assert np.allclose(base, np.sort(got.base_score)) and (got.train_tokens == n).all()
    assert sorted(got.n_known) == sorted(sum(train[w] > 0 for w in words(t) + ["\n"]) for _, t in texts)
    assert np.allclose(np.sort(got.score), np.sort(blocks.score), atol=1e-2)
    assert rows(ppm.score(empty(spark))) == []


def test_ppm_equals_brute_force(spark):
    """Method D with exclusion, byte by byte from counted contexts, over texts that share contexts and some that share none."""
    order, texts = 3, [(k, prose(30, k)) for k in range(25)] + [(90, None), (91, "ÿ new bytes \x00 here"), (92, "zzzz" * 9), (93, "the river")]
    lowered = {i: (t or "").translate(LOWER).encode() for i, t in texts}
    counts: dict[bytes, collections.Counter] = collections.defaultdict(collections.Counter)
    for i, t in lowered.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            padded = bytes([0xFE]) * order + t + bytes([0xFF])
            for at in range(order, len(padded)):
                for k in range(order + 1):
                    counts[padded[at - k : at]][padded[at]] += 1

    def cost(context, symbol):
        p, excluded = 1.0, set()
        for k in range(order, -1, -1):
            seen = counts.get(context[len(context) - k :])
            if not seen:
                continue
            left = {x: n for x, n in seen.items() if x not in excluded}
            total = 2 * sum(left.values())
            if symbol in left:
                return p * (2 * left[symbol] - 1) / total
            p *= len(left) / total if left else 1.0
            excluded |= set(seen)
        return p / (257 - len(excluded))

    expected = {}
    for i, t in lowered.items():
        padded = bytes([0xFE]) * order + t + bytes([0xFF])
        expected[i] = sum(math.log10(cost(padded[at - order : at], padded[at])) for at in range(order, len(padded)))
    for block in (2_000_000, 500):
        got = {r["doc_id"]: r["score"] for r in ppm.score(frame(spark, texts), order=order, block_grams=block).collect()}
        assert got.keys() == expected.keys() and all(abs(got[i] - expected[i]) < 1e-4 * max(1, abs(expected[i])) for i in expected)


def test_ppm_predicts_held_out_text_from_context(spark):
    """Where each word mostly decides the next, contexts predict what word counts cannot; noise alone gains nothing."""
    r = random.Random(4)

    def walk(k):
        out, at = [], r.randrange(len(WORDS))
        for _ in range(60):
            out.append(WORDS[at])
            at = (at + 1) % len(WORDS) if r.random() < 0.9 else r.randrange(len(WORDS))
        return " ".join(out)

    got = ppm.score(frame(spark, [(k, walk(k)) for k in range(120)]), order=5).toPandas()
    held = got[got.held_out]
    assert len(held) > 5 and held.score.sum() > 0.6 * held.base_score.sum() and (held.score > held.base_score).all()


def test_ppm_probabilities_sum_to_one():
    texts = [prose(200, k).encode() for k in range(3)]
    key, n = np.unique(ppm.gram_keys(texts, 3), return_counts=True)
    trie = ppm.Trie(key, n, 3)
    for context in (b"the", b"zzz", b"ive", b"q x"):
        grams = np.array([int.from_bytes(context, "big") << 8 | b for b in range(256)])
        p = 10.0 ** trie.score(grams)
        left = p[0]  # a byte that is never seen has the probability of the one symbol beyond the 256
        assert abs(p.sum() + left - 1) < 1e-4


def test_decontamination(spark):
    item = "what is the capital of the old river kingdom beyond yellow stone hills near seven lakes and nine towers"
    edited = item.replace("old", "ancient").replace("seven", "eight").split()
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, prose(30, 77))], "item_id bigint, text string")
    docs = frame(spark, TEXTS + [(50, prose(50, 6) + " " + item.upper() + ". " + prose(9, 7)), (51, prose(50, 8) + " " + " ".join(edited) + " " + prose(20, 9)), (52, "the capital of the old market")])
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.matches(docs, benchmark).collect()}
    assert got[50, 1] == 1.0 and 0.6 < got[51, 1] < 1.0 and (52, 1) not in got
    assert {i for i, _ in got} == {50, 51}
    kept = {r[0] for r in decontamination.keep_clean(docs, benchmark).select("doc_id").collect()}
    assert kept == {i for i, _ in TEXTS} | {52}
    assert rows(decontamination.matches(empty(spark), benchmark)) == [] and rows(decontamination.matches(docs, benchmark.limit(0))) == []


def test_decontamination_misses_no_edited_item(spark):
    """Every pair of text and item that aligns well enough anywhere, by brute force over all pairs; also with longer n-grams."""
    r = random.Random(12)
    vocabulary = [f"v{k}" for k in range(400)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(14, 40)))) for k in range(12)]
    docs = []
    for k in range(60):
        inner = items[r.randrange(len(items))][1].split()
        for _ in range(r.randint(0, len(inner) // 5)):
            at = r.randrange(len(inner))
            inner[at : at + 1] = r.choice(([], ["changed"], [inner[at], "added"]))
        docs.append((k, " ".join([*(r.choice(vocabulary) for _ in range(40)), *(inner if k % 3 else []), *(r.choice(vocabulary) for _ in range(30))])))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    number = {w: i for i, w in enumerate({w for _, t in items + docs for w in t.split()})}
    coded = lambda t: np.array([number[w] for w in t.split()])
    expected = {(i, j) for i, t in docs for j, x in items if decontamination.align(coded(x), coded(t))[0] >= 0.5 * 2 * len(x.split())}
    assert len(expected) >= 40
    for n in (3, 4):
        assert {(x["doc_id"], x["item_id"]) for x in decontamination.matches(frame(spark, docs), benchmark, n=n).collect()} == expected


def test_alignment_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = rng.integers(0, 5, 8), rng.integers(0, 5, 15)
        h = np.zeros((9, 16), int)
        for i in range(1, 9):
            for j in range(1, 16):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontamination.align(a, b)[0] == h.max()


def test_toxicity(spark):
    bad = ["idiot", "scum", "moron"]
    docs = [(k, prose(40, k) + (" " + " ".join(bad[: 1 + k % 3]) * (1 + k % 4) if k % 4 == 0 else "")) for k in range(400)]
    labels = spark.createDataFrame([(k, None if k % 50 == 1 else int(k % 4 == 0)) for k in range(300)] + [(None, 1), (9999, 1)], "doc_id bigint, toxic int")
    df = frame(spark, docs + [(i, t) for i, t in TEXTS if i in (2, 3, 12)])
    model = toxicity.fit(df, labels)
    assert list(model["thresholds"]) == sorted(model["thresholds"])
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    held_out = [got[k]["toxic"] == (k % 4 == 0) for k in range(300, 400)]
    assert sum(held_out) >= 98
    assert all(0 <= r["severity"] <= 3 for r in got.values())
    assert toxicity.keep_clean(df, model).filter("doc_id % 4 = 0 and doc_id between 300 and 399").count() <= 2
    nothing = toxicity.fit(df, labels.filter("false"))
    assert toxicity.score(df, nothing).filter("toxic").count() == 0
    assert rows(toxicity.score(empty(spark), model)) == []


def test_thresholds_are_shared_and_ordered():
    rng = np.random.default_rng(0)
    x = rng.normal(size=600)
    grade = np.digitize(x + rng.normal(scale=0.3, size=600), [-0.5, 0.5, 1.5])
    w, theta = toxicity.cumulative_link(np.arange(600), np.zeros(600, int), x, grade, 1, 4, 400)
    assert w[0] > 2 and all(np.diff(theta) > 0)
    assert np.mean(np.abs(np.digitize(x * w[0], theta) - grade)) < 0.3


def test_license_scan(spark):
    apache = license_scan.SENTENCES["apache2-long"] + " " + license_scan.SENTENCES["apache2-copy"]
    mit = "Intro text.\n" + license_scan.SENTENCES["mit-grant"].replace("to any person", "to\nany person") + "\n\n" + license_scan.SENTENCES["asis"]
    texts = TEXTS + [(60, "Hello there.\nReleased under the MIT License.\nBye."), (61, apache), (62, mit), (63, "We like licenses. The licence is open."), (64, "Released under the MIT License. Licensed under CC BY-NC 4.0.")]
    got = {r["doc_id"]: r for r in license_scan.scan(frame(spark, texts)).collect()}
    assert {i: got[i]["licenses"] for i in range(60, 65)} == {60: ["MIT"], 61: ["Apache-2.0"], 62: ["MIT"], 63: [], 64: ["MIT", "CC-BY-NC-4.0"]}
    assert got[62]["sentence_ids"] == ["mit-grant", "asis"] and got[2]["license"] is None
    assert rows(license_scan.scan(empty(spark))) == []


MIT = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """   Copyright 2020 A. Person

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""
BSD = """Copyright (c) 2020, A. Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""


def test_license_scan_knows_published_texts(spark):
    texts = {"MIT": MIT, "Apache-2.0": APACHE, "BSD-2-Clause": BSD, "GPL-3.0-or-later": GPL}
    whole = {"MIT": ["mit-grant", "asis"], "Apache-2.0": ["apache2-long", "apache2-copy", "apache2-basis"], "BSD-2-Clause": ["bsd-redistribution", "bsd-source", "bsd-binary"], "GPL-3.0-or-later": ["gpl-redistribute", "gpl-hope"]}
    flowed = lambda t: "\n\n".join(" ".join(x.split()) for x in t.split("\n\n"))
    commented = lambda t: "\n".join(f" * {x}".rstrip() for x in t.split("\n"))
    forms = [str, flowed, commented, lambda t: t.replace("\n", "\r\n"), lambda t: "print(1)\n" + t + "\nmore text"]
    rows = [(name, form(t)) for name, t in texts.items() for form in forms]
    got = {r["doc_id"]: r for r in license_scan.scan(frame(spark, [(k, t) for k, (_, t) in enumerate(rows)])).collect()}
    for k, (name, text) in enumerate(rows):
        assert (got[k]["licenses"], got[k]["sentence_ids"]) == ([name], whole[name]), text


def test_url_filter(spark):
    urls = [(1, "http://a.example.com/en/7x?q=1"), (2, "https://EXAMPLE.com/en/8"), (3, "http://shop.net/de/1#x"), (4, "http://example.net/de/8/9"), (5, "http://notorg/es/"), (6, None), (7, "no scheme com/en/"), (8, "http://x.org"), (9, "ftp://b.org/es/?"), (9, "ftp://b.org/es/?"), (None, "http://com/en/")]
    rules = spark.createDataFrame([("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")], "verdict string, host string, path string")
    names = ["digest", "won", "rule", "verdict", "host", "path", "start", "fields"]  # all clash with the operator's own
    pages = spark.createDataFrame([(i, u, *names) for i, u in urls], f"page_id bigint, url string, {', '.join(f'{n} string' for n in names)}")
    got = rows(url_filter.judge(pages, rules).select("fields.page_id", "host", "path", "rule", "verdict"))
    assert got == sorted([(1, "a.example.com", "/en/7x", "example.com/en/7", "allow"), (2, "example.com", "/en/8", "com/en/", "block"), (3, "shop.net", "/de/1", "net/de/", "block"), (4, "example.net", "/de/8/9", "example.net/de/8", "block"), (5, "notorg", "/es/", None, "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "x.org", "", None, "allow"), (9, "b.org", "/es/", "org/es/", "block"), (9, "b.org", "/es/", "org/es/", "block"), (None, "com", "/en/", "com/en/", "block")], key=str)
    assert rows(url_filter.judge(pages.limit(0), rules)) == []
    assert url_filter.judge(pages, rules.limit(0)).filter("rule is not null").count() == 0

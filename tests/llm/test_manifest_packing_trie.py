"""The Merkle manifest, least-squares packing and the conversation trie against brute-force versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tidewater.llm import merkle, nnls_packing, prefix_trie  # noqa: E402

from .cases import TEXTS, empty, frame, prose  # noqa: E402

BPE = public_tokenizers.path("byte_bpe_50k.json")
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        out.append(nodes)
    return out


def manifest(rows):
    """Every row's leaf, subroot, root, proof, folded root and verdict, from whole trees in memory."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = tree([leaf_of(r) for r in groups[g]])
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for place, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node, proof = leaf_of((*r[:4], lower(r[4])) if hit else r), ""
            for levels, k in ((trees[g], i), (top, place)):
                for nodes in levels[:-1]:
                    run, j = nodes[k // 16 * 16 : k // 16 * 16 + 16], k % 16
                    proof += "".join(run[:j] + run[j + 1 :])
                    node, k = sha("".join(run[:j] + [node] + run[j + 1 :])), k // 16
            out.append((r[0], leaf_of(r), trees[g][-1][0], top[-1][0], sha(proof), node, node == top[-1][0]))
    return Counter(out)


def proved(df):
    return Counter(tuple(r) for r in merkle.proofs(df, FIELDS, {"text": merkle.tampered(F.col("text"), F.col("doc_id"))}).collect())


def test_manifest_of_odd_rows(spark):
    rows = [(i, None if i == 3 else "Ünïcode" if i == 9 else f"s{(i or 0) % 3}", None if i == 5 else "en", 7, t) for i, t in TEXTS] + [(5, None, "en", 1, "UPPER"), (None, None, None, None, None)]
    # columns that the operator uses itself are data like any other
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, node string, pos int")
    assert proved(df) == manifest(rows)


def test_manifest_over_many_blocks_and_many_groups(spark):
    schema = "doc_id bigint, source string, lang string, n_chars bigint, text string"
    rows = [(i * 7 % 5003, "hot" if i < 4500 else f"s{i}", "en", i, f"Text {i}") for i in range(9000)]  # two blocks in one group, two blocks of groups
    got = proved(spark.createDataFrame(rows, schema).repartition(7))
    assert got == manifest(rows)
    assert 0 < sum(n for r, n in got.items() if not r[6]) < 9000
    assert len({r[3] for r in got}) == 1


def test_manifest_of_one_row_and_none(spark):
    schema = "doc_id bigint, source string, lang string, n_chars bigint, text string"
    one = [(1, "a", "en", 2, "hi")]
    got = proved(spark.createDataFrame(one, schema))
    assert got == manifest(one) and next(iter(got))[4] == sha("")
    assert not proved(spark.createDataFrame([], schema))


def check_packing(got, docs, library, capacity, end_id):
    """Ids, places and padding; returns how many cuts there are beside those of long documents."""
    by, sequences, cuts = defaultdict(list), defaultdict(list), 0
    for r in got:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    texts = defaultdict(list)
    for i, t in docs:
        texts[i].append(t or "")
    for i, own in texts.items():
        want = Counter()
        for t in own:
            ids = np.array([*library.encode(t, add_special_tokens=False).ids, end_id], "<u4")
            want[len(ids)] += 1
            cuts -= (len(ids) - 1) // capacity + 1
            if len(own) == 1:
                at = 0
                for p in sorted(by[i], key=lambda p: p.start):
                    assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
                    at += p.length
                assert at == len(ids)
        assert sum(p.length for p in by[i]) == sum(n * k for n, k in want.items())
        cuts += len(by[i])
    assert by.keys() == texts.keys()
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at and length > 0
            at += length
        assert at == capacity or at < capacity and at & (at - 1) == 0  # nothing is padded
    return cuts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def test_packing_of_odd_texts(spark, library):
    for capacity in (32, 2048):
        check_packing(nnls_packing.pack(frame(spark), BPE, capacity).collect(), TEXTS, library, capacity, 1)
    assert nnls_packing.pack(empty(spark), BPE).collect() == []


def test_packing_cuts_few(spark, library):
    docs = [(i, prose(random.Random(i).randint(1, 120), i)) for i in range(600)]
    got = nnls_packing.pack(spark.createDataFrame(docs, "doc_id bigint, text string"), BPE, 128, bucket_rows=50).collect()
    assert check_packing(got, docs, library, 128, 1) < 0.05 * len(docs)


def test_least_squares_finds_an_exact_mix():
    h = np.zeros(101)
    for columns, n in (((50, 30, 20), 40), ((60, 40), 25), ((100,), 7)):
        for length in columns:
            h[length] += n
    columns, x = nnls_packing.least_squares(nnls_packing.combinations(np.flatnonzero(h), 100), h)
    assert np.abs(nnls_packing.made(columns, x, 101) - h).max() < 0.5
    bins, loose = nnls_packing.plan({int(i): int(h[i]) for i in np.flatnonzero(h)}, 100)
    assert sum(n for _, n in bins) == 72 and not loose


def test_plan_keeps_every_piece():
    r = random.Random(3)
    for _ in range(20):
        capacity = r.choice([16, 100, 257])
        histogram = {n: r.randint(1, 30) for n in r.sample(range(1, capacity + 1), r.randint(1, 12))}
        bins, loose = nnls_packing.plan(histogram, capacity)
        used = Counter()
        for held, n in bins:
            assert sum(held) == capacity
            for length in held:
                used[length] += n
        for length, n in loose:
            used[length] += n
        assert used == Counter(histogram)


def trie_of(rows):
    """The trie's rows from all prefixes in memory."""
    original = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            original[c].append((turn is not None, turn or 0, role or "", text or ""))
    original = {c: [t[2:] for t in sorted(ts)] for c, ts in original.items()}
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(list)
    for c in sorted(original):
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(original.get(c - c % 5, [])[:h] + original[c][h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = sum(saved[q] for q in children[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    return Counter((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), leaves[p], saved[p], sha(",".join(map(str, ends[p])))) for p, m in members.items())


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, key string, shard int")


def test_trie_equals_all_prefixes(spark):
    r = random.Random(11)
    said = ["", "Grüße", "yes", "no", "yes no", None]
    for size in (1, 40, 400):
        rows = [(c, r.choice([None, t, t]), r.choice(["user", "bot", None]) if r.random() < 0.2 else "user", r.choice(said[: 2 + c % 5])) for c in range(size) for t in range(r.randint(1, 12))]
        rows += rows[:5] + [(None, 1, "user", "no conversation")]
        got = prefix_trie.conversation_trie(conversations(spark, rows))
        assert Counter(tuple(x) for x in got.collect()) == trie_of(rows)


def test_trie_of_one_hot_conversation_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = [(c, t, "user", f"turn {t}" if c % 3 else f"turn {t} {c % 7 if t > 4 else ''}") for c in range(600) for t in range(9)]
    sequences = prefix_trie.rebuilt(prefix_trie.encoded(conversations(spark, rows), "conv_id", "turn", "role", "text"), 5, 9)
    got = prefix_trie.trie(sequences, shard_turns=150)  # some forty shards, most of them inside one path
    assert Counter(tuple(x) for x in got.collect()) == trie_of(rows)


def test_trie_of_long_conversations_and_of_none(spark):
    rows = [(c, t, "user", str(t % 50) if t < 700 else f"{c}") for c in range(3) for t in range(800)]
    assert Counter(tuple(x) for x in prefix_trie.conversation_trie(conversations(spark, rows)).collect()) == trie_of(rows)
    assert prefix_trie.conversation_trie(conversations(spark, [])).collect() == []

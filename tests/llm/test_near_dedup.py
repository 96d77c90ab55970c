"""The pipeline's near-dedup against all pairs, and rows told apart by text."""

import random

import corpus_pipeline
import numpy as np
from helpers import edge_docs, no_docs
from test_text_operators import LOWER, docs_of, slow_components

from gaugewell.llm import near_dedup, simhash


def sets_of(text):
    words = (text or "").translate(LOWER).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_roots(texts):
    sets, root = [sets_of(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def edited_texts():
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    texts = [None, "", "  ", "A b", "a B"]
    for i in range(25):
        base = [word() for _ in range(rng.randint(20, 200))] + passage * (i % 2)
        for edits in (0, 1, 2, 4, 7):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    big = [word() for _ in range(150)]
    for _ in range(120):
        copy = list(big)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    return texts


def test_near_groups_find_all_similar_texts(spark):
    texts = edited_texts()
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs_of(spark, texts)).collect()}
    want = brute_roots(texts)
    assert [got[i] for i in range(len(texts))] == want
    # fingerprints at radius 4 leave many of these pairs
    assert len(set(want)) < len({r.component_id for r in simhash.near_groups(docs_of(spark, texts)).collect()})


def test_sketches_rule_out_no_similar_pair():
    rng = np.random.default_rng(5)
    ruled_out = 0
    for size in (1, 2, 9, 40, 300, 5000):
        for edits in (0, 1, size // 10, size // 9 + 1, size // 2):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            b = np.unique(np.concatenate([a[edits:], rng.integers(0, 1 << 63, edits, dtype=np.uint64)]))
            bits = np.stack([near_dedup.sketch(a), near_dedup.sketch(b)]).view(np.uint64)
            kept = near_dedup._near(np.array([len(a), len(b)]), bits, np.array([0]), np.array([1]))[0]
            assert kept or not near_dedup.similar(a, b)
            assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(np.setxor1d(a, b))
            ruled_out += not kept
    assert ruled_out >= 5


def test_near_groups_cases(spark):
    assert not near_dedup.near_groups(no_docs(spark)).collect()
    docs = edge_docs(spark)
    kept = simhash.keep_one(docs, near_dedup.near_groups(docs))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 7, 8, 9]


def test_keep_one_tells_rows_without_ids_apart(spark):
    long = lambda name: " ".join(f"{name}{i}" for i in range(60))
    rows = [(None, long("a")), (None, long("b")), (None, long("c")), (None, long("c")), (1, long("d")), (None, long("d")), (7, long("e")), (7, long("f"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted([("", long("a")), ("", long("b")), ("", long("c")), ("1", long("d")), ("7", long("e")), ("7", long("f"))])
    for near_groups in (near_dedup.near_groups, simhash.near_groups):
        kept = simhash.keep_one(docs, near_groups(docs)).collect()
        assert sorted(("" if r.doc_id is None else str(r.doc_id), r.text) for r in kept) == want
    one = docs.filter("doc_id = 1 or text like 'd%'")
    assert [r.doc_id for r in simhash.keep_one(one, simhash.near_groups(one)).collect()] == [1]


def test_forest_consists_of_links():
    rng = np.random.default_rng(9)
    seeds = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (300, 4), dtype=np.uint64), axis=1)
    fps = np.unique(np.repeat(seeds, 60) ^ flips)
    a, b = simhash.forest(fps, None, 4)
    assert (np.bitwise_count(a ^ b) <= 4).all()
    root = dict(zip(fps.tolist(), fps.tolist()))
    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root[x], root[y]
        assert x != y  # no link is one too many
        root = {k: min(x, y) if r in (x, y) else r for k, r in root.items()}
    want = slow_components(fps.tolist(), fps.tolist(), 4)
    assert len(set(zip(root.values(), want))) == len(set(root.values())) == len(set(want))


def test_simhash_brings_up_links(spark):
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = []
    for i in range(60):
        base = [word() for _ in range(rng.randint(6, 300))]
        copy = list(base)
        copy[-1] = word()
        texts += [" ".join(base), " ".join(copy).upper()]
    texts.append(texts[0].replace(" ", "\n"))
    fps = [simhash.fingerprint(t, 5) for t in texts]
    # each text is near to one other at most, the third of the first pair apart
    want = {(i, i + 1) for i in range(0, 120, 2) if (fps[i] ^ fps[i + 1]).bit_count() <= 4 and len(set(brute_roots(texts[i : i + 2]))) == 1}
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key long, text string")
    for tile in (4, simhash.TILE):
        got = {(r.a, r.b) for r in near_dedup.simhash_links(frame, tile=tile).collect()}
        assert got == want | {(0, 120)} and 10 < len(want) < 60


def test_the_stage_compares_fingerprints_first(spark, monkeypatch):
    compared, joined = [], []
    near_links, links = simhash.near_links, near_dedup._links
    monkeypatch.setattr(simhash, "near_links", lambda *a: compared.append(a[1:]) or near_links(*a))
    monkeypatch.setattr(near_dedup, "_links", lambda *a: joined.append({r.node for r in a[3].collect()}) or links(*a))
    base = " ".join(f"w{i}" for i in range(400))
    docs = docs_of(spark, [base, base.upper(), base + " more", "another text"])
    kept = corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == [0, 3]
    # what the exact join is given is joined already
    assert compared == [(4, simhash.TILE)] and [len(j) for j in joined] == [3, 3]

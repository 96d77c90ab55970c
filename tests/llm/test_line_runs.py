"""Line dedup against brute force over all earlier documents, with no owner rule."""

import random
from collections import Counter

from helpers import ROWS, edge_docs, no_docs
from test_text_operators import docs_of

from gaugewell.llm import line_dedup


def brute(texts, least=8):
    """Each line that is in a common block of ``least`` words with any earlier document goes."""
    out = []
    for i, text in enumerate(texts):
        lines, gone = line_dedup._lines(text), set()
        for other in texts[:i]:
            theirs = line_dedup._lines(other) if other != text or texts.index(text) < i else []
            for a in range(len(lines)):
                for b in range(len(theirs)):
                    k = 0
                    while a + k < len(lines) and b + k < len(theirs) and lines[a + k] == theirs[b + k]:
                        k += 1
                    if sum(len(x.split()) for x in lines[a : a + k]) >= least:
                        gone |= set(range(a, a + k))
        out.append(None if text is None else line_dedup.cut(text, gone))
    return out


def rest_of(spark, texts, **options):
    rows = line_dedup.drop_common_lines(docs_of(spark, texts), **options).collect()
    return [r.text for r in sorted(rows, key=lambda r: r.doc_id)]


def test_shortest_runs():
    rng = random.Random(2)
    for _ in range(300):
        words = [rng.randint(1, 11) for _ in range(rng.randint(0, 12))]
        want = set()
        for a in range(len(words)):
            ends = [b for b in range(a + 1, len(words) + 1) if sum(words[a:b]) >= 8]
            want |= {(a, b) for b in ends[:1]}
            starts = [s for s in range(a + 1) if sum(words[s : a + 1]) >= 8]
            want |= {(s, a + 1) for s in starts[-1:]}
        assert line_dedup.shortest_runs(words, 8) == want


def test_against_all_earlier_documents(spark):
    rng = random.Random(9)
    lines = [f"line {i} " + "word " * rng.randint(0, 6) for i in range(25)]
    texts = ["\n".join(rng.choice([*lines, ""]) for _ in range(rng.randint(1, 15))) for _ in range(60)]
    assert rest_of(spark, texts, min_words=8) == brute(texts)


def test_copy_of_lines_first_seen_elsewhere(spark):
    lines = [f"here is short line {i}" for i in range(10)]
    assert rest_of(spark, [*lines, "\n".join(lines), "\n".join(lines)]) == [*lines, "\n".join(lines), ""]


def test_cases(spark):
    docs = edge_docs(spark)
    out = line_dedup.drop_common_lines(docs)
    assert out.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in out.collect()]
    assert Counter(i for i, _ in rows) == Counter(i for i, _ in ROWS)
    texts = dict(ROWS)
    assert all(t == ("" if i == 6 or i is None and t is not None else texts[i] if i else None) for i, t in rows)
    assert not line_dedup.drop_common_lines(no_docs(spark)).collect()


def test_repeated_and_swapped_passages(spark):
    passage = lambda name: "\n".join(f"{name} one two three four five {i}" for i in range(6))
    a, b = passage("a"), passage("b")
    texts = [f"{a}\nbetween\n{a}", f"head\n{a}", f"{a}\nmiddle\n{a}", b, f"{b}\nmore\n{b}", f"{passage('c')}\n{passage('d')}", f"{passage('d')}\n{passage('c')}"]
    assert rest_of(spark, texts) == [texts[0], "head", "middle", b, "more", texts[5], ""]


def test_scripts_without_spaces(spark):
    lines = [f"これは共有された行の{c}番です。" for c in "一二三四五六七"]
    texts = ["\n".join(lines), "頭\n" + "\n".join(lines), "一二三\n四五六\n七八九", "一二三\n四五六\n七八九"]
    assert rest_of(spark, texts) == [texts[0], "頭", texts[2], texts[3]]  # nine characters are too few


def test_alignment():
    words = lambda lines: [5] * len(lines)
    align = lambda a, b, least=10: line_dedup.align(a, words(a), [0] * len(a), b, least)
    assert line_dedup.patience([1, 2, 3, 4], [1, 9, 2, 3, 4]) == [(0, 0), (1, 2), (2, 3), (3, 4)]
    assert align([1, 2, 3, 4], [1, 9, 2, 3, 4]) == {1, 2, 3} and align([1, 2, 3, 4], [1, 9, 2, 3, 4], 5) == {0, 1, 2, 3}
    # moved: one of two passages is in order, the other is looked up
    assert line_dedup.patience([1, 2, 3, 4, 5], [4, 5, 1, 2, 3]) == [(0, 2), (1, 3), (2, 4)] and align([1, 2, 3, 4, 5], [4, 5, 1, 2, 3]) == {0, 1, 2, 3, 4}
    # no line occurs once: the longest common block
    assert line_dedup.patience([7, 8, 7, 8, 1], [2, 7, 8, 7, 8, 3, 7, 8]) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert align([7, 8, 0, 7, 8], [7, 8]) == {0, 1, 3, 4} and align([], [1]) == set() == align([1, 1], [])


def test_alignment_finds_every_common_block(monkeypatch):
    rng = random.Random(12)
    for tries in (line_dedup._TRIES, 3):
        monkeypatch.setattr(line_dedup, "_TRIES", tries)
        for _ in range(1500):
            kinds = rng.choice([2, 4, 30])
            size = [rng.randint(1, 9) for _ in range(kinds)]
            a, b = ([rng.randrange(kinds) for _ in range(rng.randint(0, 14))] for _ in range(2))
            words, want = [size[x] for x in a], set()
            for i in range(len(a)):
                for j in range(len(b)):
                    k = 0
                    while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                        k += 1
                    if sum(words[i : i + k]) >= 8:
                        want |= set(range(i, i + k))
            assert line_dedup.align(a, words, [0] * len(a), b, 8) == want
            pairs = line_dedup.patience(a, b)
            assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))

"""The filter audit, web archives and lexical search against brute force, and on the awkward cases."""

import gzip
import hashlib
import itertools
import math
import pathlib
import random
import re
from collections import Counter

import pytest
from helpers import CLASH, ROWS, edge_docs, no_docs
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from gaugewell.llm import filter_audit, lexical, warc

# --- filter audit ---

VALUES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failed(rows):
    """The letters that each (doc_id, text, part) fails."""
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
        smaller = [i for i, t, _ in rows if (t or "") == text and None not in (i, doc_id) and i < doc_id]
        out.append("".join(letter for letter, fails in zip("ABCDE", (
            len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            any(c in "#$%&*|" for c in text), bool(smaller),
        )) if fails))
    return out


def brute_audit(rows, labels):
    letters, out = failed(rows), {}
    good, toxic = ({i for i, *x in labels if x[k] == 1} for k in (0, 1))
    for part in {p or "" for _, _, p in rows}:
        mine = [(i, f) for (i, _, p), f in zip(rows, letters) if (p or "") == part]
        share = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                share[letter] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(letter in f for _, f in mine) - len(gone), sum(f == letter for _, f in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(share[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(docs, labels, **options):
    rows = filter_audit.audit(docs, labels, **options).collect()
    assert len({(r.part, r.filter_order, r.step) for r in rows}) == len(rows)
    return {(r.part, r.filter_order, r.step): tuple(r[v] for v in VALUES) for r in rows}


def test_audit(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "日本", "CAPITALS LOUD", "50%"]
    text = lambda: rng.choice([" ", "\n", "\x0b", " "]).join(rng.choices(vocabulary, k=rng.choice([0, 3, 99, 100, 101, 400])))
    texts = [text() for _ in range(60)] + [None, "", "A" * 10 + "b" * 90, "A" * 11 + "b" * 89]
    rows = [(rng.choice([None, *range(90)]), rng.choice(texts), rng.choice([None, "", "en", "x"])) for _ in range(150)]
    labels = [(rng.choice([None, *range(90)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    labels = [x for x in labels if x[0] is not None]
    assert audited(docs, known) == brute_audit(rows, labels)
    assert "E" in set("".join(failed(rows)))


def test_audit_cases(spark):
    known = spark.createDataFrame([(5, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    docs = edge_docs(spark).withColumns({"lang": F.lit(None).cast("string"), "part": F.lit("p"), "mask": F.lit(3), "first": F.lit(0), "digest": F.lit("d")})
    assert audited(docs, known) == brute_audit([(i, t, None) for i, t in ROWS], [(5, 1, 1), (6, 1, 0)])
    assert not audited(no_docs(spark).withColumn("lang", F.lit("en")), known)
    assert len(audited(docs, known.filter("false"))) == 600


# --- web archives ---

PAGES = [
    (1, "http://a.example/1", "x" * 99), (2, "http://a.example/2", "x" * 99),  # too short to be revisited
    (5, "http://a.example/5", "é" * 50), (4, None, "é" * 50), (9, "http://a.example/ö ?q=a b\r\nWARC-Type: x", "é" * 50),
    (7, "", "long \r\n\r\nWARC/1.1\r\n" * 40), (8, "u", "WARC/1.1"), (10, "u", "\r\n\r\nWARC/1.1"), (11, "u", "\r\n\r\n"),
    (12, "u", None), (13, "u", ""), (14, "u", "日本語\U0001f600" * 333), (14, "u", "other text of the same page" * 9),
    (None, "u", "é" * 50), (None, "u", "q" * 120), (None, None, "q" * 120), (4, None, "é" * 50), (15, "u", "\x00\x01 \x85"),
]


def want_records(pages):
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        first = min((j for j, _, h in pages if (h or "") == (html or "") and j is not None), default=None)
        again = len(data) >= 100 and first is not None and (i is None or first < i)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return Counter(out)


def pages_of(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"page_id {kind}, url string, html string")


def records_of(spark, path, **options):
    rows = warc.read_chunks(spark, path, data=False, **options).collect()
    return Counter((r.page_id, r["size"], r.digest, r.record_type, r.refers_to) for r in rows)


@pytest.mark.parametrize("size", [7, 64, warc.CHUNK])
def test_archives(spark, tmp_path, size):
    pages = pages_of(spark, PAGES).withColumns({c: F.lit("own") for c in CLASH + ["refers_to", "c", "last", "data", "whole"]})
    warc.write_archives(pages.repartition(3), f"{tmp_path}/a", size=size)
    records = warc.read_chunks(spark, f"{tmp_path}/a")
    assert records_of(spark, f"{tmp_path}/a") == want_records(PAGES)
    assert not warc.unresolved(records.filter("last")).collect()
    # what is read back chunk by chunk is what was written
    got = {}
    for r in sorted(records.filter("record_type = 'response' AND page_id IS NOT NULL").collect(), key=lambda r: r.chunk):
        before = got.setdefault((r.page_id, r.uri, r.digest if r.last else None), b"")
        got[r.page_id, r.uri, r.digest if r.last else None] = before + r.data
        assert len(r.data) <= size and r["size"] >= len(r.data)
    assert max(len(r.data) for r in records.collect()) <= size
    if size == warc.CHUNK:
        assert {hashlib.sha256(x).hexdigest() for x in got.values()} >= {hashlib.sha256((PAGES[11][2]).encode()).hexdigest()}
    assert {r.uri for r in records.collect() if r.page_id == 9} == {"http://a.example/%C3%B6%20?q=a%20b%0D%0AWARC-Type:%20x"}


def test_chunk_rows_carry_digests(spark):
    text = "0123456789é" * 30
    rows = warc.chunk_rows(pages_of(spark, [(1, "u", text), (2, "u", None)]), size=50).collect()
    mine = [r for r in rows if r.page_id == 1]
    whole = text.encode()
    assert [r.chunk for r in mine] == list(range(8)) and [r.last for r in mine] == [False] * 7 + [True]
    assert [r.digest for r in mine] == [hashlib.sha256(whole[: 50 * (k + 1)]).hexdigest() for k in range(8)]
    assert b"".join(r.data for r in mine) == whole and [r["size"] for r in rows if r.page_id == 2] == [0]


def test_archive_format(spark, tmp_path):
    warc.write_archives(pages_of(spark, [(1, "http://a.example/", "abc" * 50)]).coalesce(1), f"{tmp_path}/a", size=100)
    (file,) = [f for f in pathlib.Path(tmp_path, "a").glob("*.gz") if f.stat().st_size > 30]
    first, second = gzip.decompress(file.read_bytes()).split(b"\r\n\r\nWARC/1.1\r\n")
    head, http, body = first.split(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    assert lines[0] == "WARC/1.1" and {"WARC-Type: response", "WARC-Target-URI: http://a.example/", "WARC-Segment-Number: 1"} <= set(lines)
    assert f"Content-Length: {len(http) + 4 + 100}" in lines and body == (b"abc" * 34)[:100] and http.startswith(b"HTTP/1.1 200 OK")
    assert b"WARC-Segment-Total-Length: 150" in second and second.endswith((b"abc" * 50)[100:] + b"\r\n\r\n")


def test_damaged_archives(spark, tmp_path):
    warc.write_archives(pages_of(spark, [(1, "u", "abc" * 50), (2, "u", "z")]).coalesce(1), f"{tmp_path}/a", size=100)
    (file,) = [f for f in pathlib.Path(tmp_path, "a").glob("*.gz") if f.stat().st_size > 30]
    good = gzip.decompress(file.read_bytes())
    records = good.split(b"\r\n\r\nWARC/1.1\r\n")
    for i, bad in enumerate([good.replace(b"abcabc", b"abcabd", 1), good.replace(b"cabc", b"cab", 1), b"\r\n\r\nWARC/1.1\r\n".join([records[0], records[2]]), records[0] + b"\r\n\r\n"]):
        pathlib.Path(tmp_path, f"b{i}.gz").write_bytes(gzip.compress(bad))
        with pytest.raises(PythonException, match="ValueError"):
            warc.read_chunks(spark, f"{tmp_path}/b{i}.gz").collect()


def test_archives_without_pages_and_with_text_ids(spark, tmp_path):
    warc.write_archives(pages_of(spark, []), f"{tmp_path}/none")
    assert not records_of(spark, f"{tmp_path}/none")
    rows = [("a b", "u", "t" * 100), ("ü#1>", "u", "t" * 100), ("", "u", "s"), (None, "u", "s")]
    warc.write_archives(pages_of(spark, rows, "string"), f"{tmp_path}/text")
    assert records_of(spark, f"{tmp_path}/text", id_kind="string") == want_records(rows)


# --- lexical search ---


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_search(docs, items, k=10):
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    documents, length = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = {}
    for name in {i for i, _ in items}:
        wanted = {t for i, text in items if i == name for t in terms_of(text)}
        scores = []
        for doc_id, c in counted:
            if not c:
                continue
            m = 10 + 90 * sum(c.values()) * documents // length
            score = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        if scores:
            out[name] = [(None if none else d, -s) for s, none, d in sorted(scores)[:k]]
    return out


def searched(docs, items, **options):
    out = {}
    for r in sorted(lexical.search(docs, items, **options).collect(), key=lambda r: r["rank"]):
        rows = out.setdefault(r.item_id, [])
        rows.append((r.doc_id, r.score))
        assert r["rank"] == len(rows)
    return out


@pytest.mark.parametrize("block", [lexical.BLOCK, 20])
def test_search(spark, monkeypatch, block):
    monkeypatch.setattr(lexical, "_CELLS", 64)  # many small rounds of scoring
    rng = random.Random(8)
    vocabulary = ["a", "B", "ab", "aba", "É", "é", "x1", "1", "日本", "İ", "the", "then", "hen", "ß"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "_", "--"]) for _ in range(n))
    docs = [(rng.choice([None, *range(60)]), rng.choice([None, "", "--", *(text(rng.randint(0, 40)) for _ in range(40))])) for _ in range(120)]
    items = [(i, text(rng.randint(0, 6))) for i in [*range(12), None, 3]] + [(40, None), (41, "nowhere"), (42, "?")]
    items.append(items[0])
    found = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({"term": F.lit(1), "words": F.lit(2)})
    assert searched(found, asked, block=block) == brute_search(docs, items)
    assert searched(found, asked, k=3) == brute_search(docs, items, 3)


def test_search_cases(spark):
    items = [("one", "ONE two"), ("école", "École straße"), ("none", None)]
    asked = spark.createDataFrame(items, "item_id string, text string")
    docs = edge_docs(spark).withColumns({c: F.lit(0) for c in ("item", "rank", "share", "item_id")})
    assert searched(docs, asked) == brute_search(ROWS, items)
    assert not searched(no_docs(spark), asked)
    assert not searched(docs, asked.filter("false"))
    assert lexical.search(docs, asked.filter("false")).dtypes == lexical.search(docs, asked).dtypes

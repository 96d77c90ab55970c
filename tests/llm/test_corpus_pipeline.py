"""The stages one by one against brute force, and on awkward and empty documents."""

import pathlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from helpers import edge_docs, no_docs
from pyspark.sql import functions as F
from test_line_runs import brute
from test_near_dedup import brute_roots
from test_text_operators import check_packing, contaminated

from gaugewell.llm import encoding, line_dedup, packing, quality
from gaugewell.llm.common import stored

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="needs the test tables")


def rows_of(df):
    return {r.doc_id: r.asDict() for r in df.collect()}


def test_stages(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "line_dedup", "near_dedup", "decontaminate", "pack"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    all_ = rows_of(docs)

    good = stored(stages["quality"](spark, docs, SF), "t")
    verdicts = {r.doc_id: r.predicted for r in quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    now = rows_of(good)
    assert now == {i: r for i, r in all_.items() if verdicts[i] == 1} and 0 < len(now) < len(all_)

    cut = stored(stages["line_dedup"](spark, good, SF), "t")
    ids = sorted(now)
    texts = brute([now[i]["text"] for i in ids], line_dedup.MIN_WORDS)
    want = {i: t for i, t in zip(ids, texts) if t.strip() or t == now[i]["text"]}
    now = rows_of(cut)
    assert {i: r["text"] for i, r in now.items()} == want and all(r["n_chars"] == len(r["text"]) for r in now.values())

    single = stored(stages["near_dedup"](spark, cut, SF), "t")
    ids = sorted(now)
    heads = {ids[root] for root in brute_roots([now[i]["text"] for i in ids])}
    assert rows_of(single) == {i: now[i] for i in heads}
    now = rows_of(single)

    clean = stored(stages["decontaminate"](spark, single, SF), "t")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    ids = sorted(now)
    hits = [n for _, n, _ in contaminated([now[i]["text"] for i in ids], items, 10)]
    assert rows_of(clean) == {i: now[i] for i, n in zip(ids, hits) if not n}
    for df in (good, cut, single, clean):
        assert df.dtypes == docs.dtypes

    vocabulary = encoding.vocabulary("word_bpe_49k.json")
    encode = encoding.WordEncoder(vocabulary)
    now = rows_of(clean)
    ids = {i: np.array([*np.frombuffer(encode(r["text"]), "<u4"), 1]) for i, r in now.items()}
    check_packing(packing.pack(clean, vocabulary).collect(), ids, packing.Limits())
    pieces = stages["pack"](spark, clean, SF)
    whole = corpus_pipeline.run(spark, SF)
    key = lambda df: Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.select("doc_id", "start", "length", "ids_crc32").collect())
    assert sum(r.length for r in pieces.collect()) == sum(map(len, ids.values())) == sum(r.length for r in whole.collect())
    assert {k[0] for k in key(whole)} == set(now)


@pytest.mark.parametrize("make", [edge_docs, no_docs])
def test_awkward_documents(spark, make):
    docs = make(spark).withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), f"t_{name}")
        assert name == "pack" or docs.columns == columns
    assert make is edge_docs or docs.count() == 0

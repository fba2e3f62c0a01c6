import os
import random

import pytest

import corpus_pipeline
from kpiforge.llm import queries
from kpiforge.llm.queries import tokenizer_path
from tests.llm.helpers import docs_frame, sentence
from tests.llm.test_omh import base, edited

SF = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for i in range(150):
        w = [f"p{rng.randrange(3_000)}" for _ in range(rng.randint(30, 90))]
        if i % 5 == 0:
            w[::9] = ["vile"] * len(w[::9])
        rows.append((i, " ".join(w), "abc"[i % 3]))
    for k in range(10):   # near copies and a leaked item
        rows.append((200 + k, " ".join(edited(base(k), k % 2, k)), "a"))
        rows.append((300 + k, " ".join(base(k)), "b"))
    rows.append((400, sentence(30) + " " + sentence(40, tag="bench"), "c"))
    docs_frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i % 5 == 0)) for i in range(150)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, sentence(40, tag="bench"))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows


def test_each_stage_takes_effect(spark, tables):
    sf, rows = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        path = f"{sf}/out-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.collect()
    ids = {k: sorted(r.doc_id for r in v) for k, v in seen.items()}
    clean = sorted(r[0] for r in rows if not (r[0] < 150 and r[0] % 5 == 0))
    assert ids["toxicity"] == clean
    assert ids["near_duplicates"] == [i for i in clean if not 300 <= i < 400]
    assert ids["decontamination"] == [i for i in ids["near_duplicates"] if i != 400]
    assert set(ids["source_mix"]) <= set(ids["decontamination"]) and max(map(ids["source_mix"].count, ids["source_mix"])) <= 2
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    text = dict((r[0], r[1]) for r in rows)
    want = sorted((i, len(tok.encode(text[i], add_special_tokens=False).ids) + 1) for i in ids["source_mix"])
    assert sorted((r.doc_id, r.n_tokens) for r in seen["token_files"]) == want
    again = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.ids_crc32, r.start) for r in again) == sorted((r.doc_id, r.ids_crc32, r.start) for r in seen["token_files"])


def test_pipeline_on_an_empty_table(spark, tables, tmp_path):
    sf, _ = tables
    docs = docs_frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_their_sql(spark, name):
    from tools.oracle_check import compare, duck

    ok, message = compare(spark, duck(SF), name, queries.QUERIES[name], queries.SQL[name], SF)
    assert ok, message

"""The pipeline against a brute-force version, stage by stage, on the smallest table."""

from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from tokenizers import Tokenizer

import corpus_pipeline
from custspark.llm import toxicity
from custspark.llm.queries import tokenizer_path

from ..conftest import SF_SMALL
from .test_operators import brute_contamination, brute_jaccard, brute_windows, got


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.score(docs, model).where(f"score >= {toxicity.THRESHOLD}").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect() if r["doc_id"] not in rejected]
    rows = [r for r, (_, n, c) in zip(rows, brute_jaccard(rows)) if not n or r[0] == c]
    rows = [(r[0], r[1] if not n else kept) for r, (_, _, n, kept) in zip(rows, brute_windows(rows, 35))]
    items = pq.read_table(f"{SF_SMALL}/benchmark.parquet").to_pylist()
    rows = [r for r, b in zip(rows, brute_contamination(rows, [(i["item_id"], i["text"]) for i in items])) if not b[2]]
    tok = Tokenizer.from_file(tokenizer_path())
    want = {r[0]: tok.encode(r[1], add_special_tokens=False).ids for r in rows}
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in corpus_pipeline.run(spark, SF_SMALL).collect()}
    assert got == want


def test_encoding_stage_decodes(spark, docs, rows):
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL)
    assert got(out, "doc_id", "decoded") == Counter((r[0], r[1] or "") for r in rows)


def test_stages_keep_odd_rows(spark, docs, empty):
    """Nulls, empty texts and further columns with clashing names pass every stage; so does an empty table."""
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF_SMALL)
        assert out.columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, out, SF_SMALL).where("n_tokens = 0").count() >= 3
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF_SMALL).count() == 0

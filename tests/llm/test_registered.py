"""The registered queries of the operators: against DuckDB where SQL can express them, else against brute force."""

import hashlib
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry_mod
from custspark.llm import queries, toxicity

from ..conftest import SF_SMALL
from ..oracle import compare, duck_connection

QUERIES, ORACLE = entry_mod.queries(), entry_mod.oracle_sql()
OPERATORS = sorted(n for n in QUERIES if n.startswith("op"))


def test_every_operator_is_registered():
    assert [int(n[2:].split("_")[0]) for n in sorted(OPERATORS, key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 14))


@pytest.mark.parametrize("name", [n for n in OPERATORS if n in ORACLE])
def test_against_sql(spark, name):
    con = duck_connection(SF_SMALL)
    ok, msg = compare(QUERIES[name](spark, SF_SMALL), con, ORACLE[name])
    assert ok, msg


def test_links_between_vectors_against_sql(spark, tmp_path):
    """The given small tables hold no near vectors, so here is one that does."""
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 64))
    rows = [*base, *(base[:20] + 0.1 * rng.standard_normal((20, 64))), *[base[5]] * 10, None, np.zeros(64), np.full(64, np.nan)]
    pq.write_table(pa.table({"vec_id": pa.array(range(len(rows)), pa.int64()), "label": pa.array([1] * len(rows), pa.int32()),
                             "embedding": pa.array([None if r is None else r.astype(np.float32).tolist() for r in rows], pa.list_(pa.float32()))}),
                   str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet')")
    df = QUERIES["op7_embedding_dedup"](spark, str(tmp_path))
    ok, msg = compare(df, con, ORACLE["op7_embedding_dedup"])
    assert ok and df.where("n_links > 0").count() >= 30, msg


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF_SMALL}/documents.parquet", columns=["doc_id", "text"])
    return {r["doc_id"]: r["text"] or "" for r in t.to_pylist()}


@pytest.fixture(scope="module")
def ids(texts):
    tok = Tokenizer.from_file(queries.tokenizer_path())
    return {d: tok.encode(t, add_special_tokens=False).ids for d, t in texts.items()}, tok


def rows_of(spark, name):
    return QUERIES[name](spark, SF_SMALL).collect()


def test_token_files(spark, ids):
    want, start = {}, 0
    for d in sorted(ids[0]):
        x = [*ids[0][d], 2]
        want[d] = (start, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        start += len(x)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows_of(spark, "op1_token_files")} == want


def test_token_counts(spark, ids, texts):
    assert {r.doc_id: r.n_tokens for r in rows_of(spark, "op6_token_counts")} == {d: len(x) for d, x in ids[0].items()}


def test_bpe_roundtrip(spark, ids):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {d: (len(x), sha(np.array(x, "<u4").tobytes()), sha(ids[1].decode(x, skip_special_tokens=False).encode())) for d, x in ids[0].items()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows_of(spark, "op10_bpe_roundtrip")} == want


def test_toxicity(spark, texts):
    rows = rows_of(spark, "op2_toxicity")
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= toxicity.THRESHOLD)


def test_shards(spark, texts):
    rows = rows_of(spark, "op5_shards")
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == {d: (len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts.items()}
    total, held = sum(r["size"] for r in rows), {}
    for r in rows:
        held.setdefault(r.shard, []).append(r)
    assert set(held) <= set(range(16)) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    for part in held.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
        assert sum(r["size"] for r in part) <= total / 16 + max(r["size"] for r in rows)

"""The registered queries themselves, against SQL where it can express them, and by their contracts' plain columns."""

import hashlib
import zlib
from pathlib import Path

import duckdb
import pytest

from callweave.llm import common, queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op2_lm": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op3_substrings": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op4_simhash": ["doc_id", "fingerprint", "component_id"],
    "op5_quality": ["doc_id", "held_out", "score", "predicted"],
    "op6_exact": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op7_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op8_pieces": ["doc_id", "n_tokens", "ids", "decoded_sha256"],
    "op9_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op10_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op11_merkle": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    "op12_resample": ["doc_id", "n_features", "weight", "score", "rank"],
    "op13_minhash": ["doc_id", "n_shingles", "component_id", "kept"],
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    want = duck.sql(queries.oracle_sql()[name])
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(spark, duck, name):
    with common.scratch(spark):
        rows = queries.queries()[name](spark, SF)
        assert rows.columns == COLUMNS[name]
        rows = rows.collect()
    key = COLUMNS[name][0]
    source = dict(duck.sql("SELECT page_id, html FROM pages" if key == "page_id" else "SELECT doc_id, text FROM documents").fetchall())
    assert sorted(r[key] for r in rows) == sorted(source)
    data = {k: (v or "").encode() for k, v in source.items()}
    crc = lambda k: zlib.crc32(str(k).encode())
    for r in rows:
        text = data[r[key]]
        if name == "op2_lm":
            assert r["held_out"] == (crc(r[key]) % 7 == 2) and r["score"] < 0 and r["n_tokens"] == len(text.translate(bytes(32 if 9 <= c <= 13 else c for c in range(256))).split(b" ")) - text.translate(bytes(32 if 9 <= c <= 13 else c for c in range(256))).split(b" ").count(b"") + 1
        elif name == "op5_quality":
            assert r["held_out"] == (crc(r[key]) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        elif name == "op8_pieces":
            assert r["decoded_sha256"] == hashlib.sha256(text).hexdigest() and r["n_tokens"] == len(r["ids"])
        elif name == "op9_sharding":
            assert (r["size"], r["text_crc32"], r["law"]) == (len(text) + 1, zlib.crc32(text), "bytes") and 0 <= r["shard"] < 8


def test_scratch_leaves_nothing(spark):
    before = set(Path(common.shared_folder(spark)).iterdir())
    with common.scratch(spark):
        queries.queries()["op4_simhash"](spark, SF).collect()
    assert set(Path(common.shared_folder(spark)).iterdir()) <= before

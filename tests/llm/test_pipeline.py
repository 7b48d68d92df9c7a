"""The pipeline, stage by stage, against brute force; and the registered queries."""

import hashlib
import os
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.llm.test_dedup import plain_repeats
from tests.llm.test_near_copies import plain_kept
from tests.llm.test_text import plain_overlaps

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


def test_stages(spark, scratch):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in C.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = scratch.keep(stage(spark, docs, SF), name)
        after = docs.collect()
        seen[name] = len(after)
        if name != "packs":
            assert docs.columns == columns
            assert all(r.n_chars == len(r.text) for r in after)
        kept = {r.doc_id: r.text if "text" in docs.columns else None for r in after}
        if name == "language":
            assert all(any(c.isalpha() for c in t) for t in kept.values())
            assert all(not any(c.isalpha() for c in before[i]) for i in before.keys() - kept.keys())
        elif name == "near_duplicates":
            assert Counter(list(kept)) == plain_kept(sorted(before.items()))
            assert kept.items() <= before.items()
        elif name == "repeats":
            want = {i: (removed, sha) for i, _, removed, _, sha in plain_repeats(list(before.items()), 200)}
            assert kept.keys() == before.keys()
            for i, text in kept.items():
                removed, sha = want[i]
                lost = len(before[i].encode()) - len(text.encode())
                assert removed - 6 * 60 <= lost <= removed
                if lost == removed:
                    assert hashlib.sha256(text.encode()).hexdigest() == sha
        elif name == "benchmarks":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert kept.keys() == {x[0] for x in plain_overlaps(list(before.items()), items) if not x[4]}
        else:
            assert Counter(r.doc_id for r in after).keys() == before.keys()
    assert seen["near_duplicates"] <= seen["language"]
    whole = C.run(spark, SF)
    assert Counter(map(tuple, whole.select("doc_id", "segment", "n_tokens").collect())) == Counter((r.doc_id, r.segment, r.n_tokens) for r in after)


@pytest.mark.parametrize("name", ["op5_decontaminate", "op6_chat", "op8_embeddings"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from weftline.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(ORACLES[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = [sorted(map(tuple, x[sorted(want.columns)].astype(str).to_numpy().tolist())) for x in (got, want)]
    assert rows[0] == rows[1]


def test_each_operator_has_one_query():
    from weftline.llm.queries import QUERIES

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_op7_digest(spark):
    import zlib

    from weftline.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op7_shards"](spark, SF).collect():
        body = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(body) + 8, zlib.crc32(body), "key")
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)


def test_op1_accuracy(spark):
    from weftline.llm.queries import QUERIES

    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op1_language_id"](spark, SF).join(truth, "doc_id").filter("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] >= 0.95

"""Linkage by code and by tokens: what their plans write and join does not grow with the pairs, and results stay as they were."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.catalog import QUERIES
from weftline.functions import tokens as T
from weftline.operators import blocking, linkage, tiles

CODE = "9131000012345678"


def nodes(plan):
    """Nodes of an executed plan, stages of adaptive execution opened."""
    yield plan
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        inner = [plan.executedPlan()]
    elif kind.endswith("QueryStageExec"):
        inner = [plan.plan()]
    else:
        children = plan.children()
        inner = [children.apply(i) for i in range(children.size())]
    for child in inner:
        yield from nodes(child)


def most(df, metric, kinds=""):
    """The largest value of a metric among the nodes whose name has `kinds`, after a run."""
    df.collect()
    values = [n.metrics().apply(metric).value() for n in nodes(df._jdf.queryExecution().executedPlan()) if kinds in n.getClass().getSimpleName() and n.metrics().contains(metric)]
    return max(values, default=0)


@pytest.fixture(scope="module")
def one_code(spark, tmp_path_factory):
    """Tables of 300 customers and 2,000 orders of the same code: 600,000 pairs."""
    at = str(tmp_path_factory.mktemp("one_code"))
    spark.range(300).select((F.col("id") * 700).alias("c_custkey"), F.lit("n").alias("c_name"), F.when(F.col("id") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("c_mktsegment")).write.parquet(f"{at}/customer.parquet")
    spark.range(2000).select((F.col("id") * 900).alias("o_orderkey"), F.when(F.col("id") % 3 == 0, "F").otherwise("O").alias("o_orderstatus"), F.timestamp_seconds(F.col("id") % 50 * 86400).alias("o_orderdate")).write.parquet(f"{at}/orders.parquet")
    return at


def odd_registries(spark, seed=1):
    """Sources and targets with missing values, values alike but for case, and repeated ids."""
    pick = random.Random(seed)
    codes = [CODE + "01", CODE + "02", f" {CODE[:9]}-{CODE[9:]}02", CODE, "", None]
    people, places, phones = ["Li Ming", "li ming", "Li Mingg", "无", "", None], ["天宝路1号2室", "天宝路1号", "", None], ["13800001111", "8613800001111", "0001111", "", None]
    s = [(pick.randrange(50), pick.choice(codes), pick.choice(["a", "", None]), pick.choice(people), pick.choice(places), pick.choice(phones)) for _ in range(60)]
    t = [(pick.choice([1, 10, 100]) * pick.randrange(1, 90), pick.choice(codes), pick.choice(["a", "b", "", "null", None]), pick.choice(people), pick.choice(places), pick.choice(phones), pick.choice(["2024-01-01", "2023-05-05", None])) for _ in range(120)]
    source = spark.createDataFrame(s, "src long, s_code string, s_name string, s_person string, s_address string, s_phone string")
    target = spark.createDataFrame(t, "tgt long, t_code string, t_name string, t_person string, t_address string, t_phone string, t_date string")
    return source, target


@pytest.mark.parametrize("ids", ["long", "string"])
def test_best_by_classes(spark, ids):
    source, target = odd_registries(spark)
    source, target = source.withColumn("src", F.col("src").cast(ids)), target.withColumn("tgt", F.col("tgt").cast(ids))
    columns = ["src", "tgt", "match_key", "selection_score", "duplicate_count"]
    # by pairs, the code of two that are equal in score and target is open
    expected = {tuple(r) for r in linkage.best(linkage.code_join(source, target), linkage.selection_score()).select(*columns).collect()}
    found = {tuple(r) for r in linkage.code_best(source, target).select(*columns).collect()}
    assert len(found) > 20
    assert {(r[0], r[1], r[3], r[4]) for r in found} == {(r[0], r[1], r[3], r[4]) for r in expected}


def test_rank_joins_classes(spark, one_code):
    found = QUERIES["exact_join_rank"](spark, one_code)
    assert most(found, "numOutputRows", "Join") < 10_000  # 600,000 before
    assert {(r.tgt, r.duplicate_count) for r in found.collect()} == {(1_000_800, 2000), (1_001_700, 2000)} and found.count() == 300  # longer ids score more


@pytest.mark.parametrize("chunk", [linkage.CHUNK, 3])
def test_matches_by_targets(spark, monkeypatch, chunk):
    monkeypatch.setattr(linkage, "CHUNK", chunk)
    source, target = odd_registries(spark, 2)
    columns = ["src", "tgt", "match_key", "date", "is_primary", "total_matches", "latest", "earliest"]
    for rows in (source, source.dropDuplicates(["src"]).localCheckpoint()):
        expected = linkage.all_matches(linkage.code_join(rows, target), linkage.selection_score(), F.col("t_date"))
        found = linkage.code_matches(rows, target)
        assert sorted(map(repr, found.select(*columns).collect())) == sorted(map(repr, expected.select(*columns).collect()))
        ranks = [sorted((r.src, r.match_rank) for r in x.collect()) for x in (found, expected)]
        assert ranks[0] == ranks[1] and len(ranks[0]) > 100


def test_all_shuffles_no_pairs(spark, one_code):
    found = QUERIES["exact_join_all"](spark, one_code)
    assert most(found, "shuffleRecordsWritten") <= 2_000  # 600,000 before
    assert found.count() == 600_000 and found.filter("is_primary").count() == 300
    assert {(r.src, r.match_rank) for r in found.filter("tgt = 0").collect()} == {(700 * i, 1961) for i in range(300)}


def test_all_writes_runs(spark, one_code, tmp_path):
    """What a file of the pairs takes: targets one after the other, each beside a block's sources in turn."""
    QUERIES["exact_join_all"](spark, one_code).write.parquet(f"{tmp_path}/pairs")
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 0.5 * 600_000
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == 600_000


@pytest.mark.parametrize("block", [1, 7])
def test_matches_by_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(linkage, "BLOCK", block)
    monkeypatch.setattr(linkage, "CHUNK", 5)
    source, target = odd_registries(spark, 2)
    rows = source.dropDuplicates(["src"]).localCheckpoint()
    columns = ["src", "tgt", "match_key", "date", "is_primary", "total_matches", "latest", "earliest"]
    expected = linkage.all_matches(linkage.code_join(rows, target), linkage.selection_score(), F.col("t_date"))
    assert sorted(map(repr, linkage.code_matches(rows, target).select(*columns).collect())) == sorted(map(repr, expected.select(*columns).collect())) != []


def test_tiled_join(spark, monkeypatch):
    pick = random.Random(3)
    names = ["".join(pick.choice("abc ") for _ in range(pick.randrange(0, 16))) for _ in range(90)] + ["", None, "ab", "zzzzz", "abc" * 40]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, name string")
    source, target = (rows.filter(f"id % 5 {c}").select(F.col("id").alias(i), F.col("name").alias(n)) for c, i, n in (("> 1", "src", "s_name"), ("< 3", "tgt", "t_name")))
    grams = [T.ngrams(F.col(n), 2) for n in ("s_name", "t_name")]
    for tile in (100, 7):
        monkeypatch.setattr(tiles, "TILE", tile)
        for least in (0.1, 0.5, 1.0):
            expected = blocking.token_join(source.select("src", grams[0].alias("tokens")), target.select("tgt", grams[1].alias("tokens")), least)
            found = tiles.tiled_join(source, target, tuple(grams), least)
            assert sorted((r.src, r.tgt, r.hits, r.score) for r in found.collect()) == sorted((r.src, r.tgt, r.hits, r.score) for r in expected.collect()) != []
    by_name = {r.src: r.s_name for r in found.collect()}
    assert by_name and all(names[i] == n for i, n in by_name.items())
    assert tiles.tiled_join(source, target.limit(0), tuple(grams), 0.5).count() == 0


@pytest.mark.parametrize("tested", [1 << 16, 3])
def test_tiles_in_batches(monkeypatch, tested):
    """Candidates tested a few at a time, against sets."""
    monkeypatch.setattr(tiles, "TESTED", tested)
    pick = random.Random(4)
    s, t = ([set(pick.sample("abcdefghij", pick.randrange(0, 8))) for _ in range(n)] for n in (40, 60))

    def tile(rows):
        one, words = tiles._Tile.__new__(tiles._Tile), sorted(set().union(*rows))
        one.id, one.name, one.token = pa.array(range(len(rows))), pa.array([str(sorted(r)) for r in rows]), pa.array(words, pa.string())
        one.n, one.code = np.array([len(r) for r in rows]), np.array([words.index(w) for r in rows for w in sorted(r)], np.int64)
        one.start = np.cumsum(one.n) - one.n
        return one

    found = sorted((a, b, h) for x in tiles._pairs(tile(s), tile(t), 0.5) for a, b, h in zip(x["src"].to_pylist(), x["tgt"].to_pylist(), x["hits"].to_pylist(), strict=True))
    assert found == sorted((i, j, len(a & b)) for i, a in enumerate(s) for j, b in enumerate(t) if a & b and 2 * len(a & b) >= len(a))


def test_labels_shuffle_no_hits(spark, tmp_path):
    spark.range(2000).select(F.col("id").alias("p_partkey"), F.lit("large widget").alias("p_name")).write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["link_part_labels"](spark, str(tmp_path))
    assert most(found, "shuffleRecordsWritten") <= 2_000
    assert found.count() == 1000 and {r.tgt - r.src for r in found.filter("score > 0.9").collect()} == {1}

"""WARC, chat and sharding operators: round trips, laws, brute force."""

import hashlib
import io
import random
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import chat, sharding, warc

CLASH = ("digest", "original", "archive", "range", "capture", "node", "leaf", "c", "n", "shard", "bucket", "slot", "before")


def table(spark, ints=(), **cols):
    n = len(next(iter(cols.values())))
    made = {k: pa.array(v, pa.int64() if k in ints else pa.string()) for k, v in cols.items()}
    return spark.createDataFrame(pa.table(made | {c: pa.array(["own"] * n) for c in CLASH if c not in cols})).repartition(3)


# --- WARC -----------------------------------------------------------------------------------------------------


def pages(seed=1):
    r = random.Random(seed)
    bodies = ["<p>a</p>", "", None, "ü" * 50, "x" * 5000, "\r\n\r\nWARC/1.1\r\n", "&lt;"]
    rows = [(i, r.choice(["http://WWW.Example.com/b/", "https://example.com:443/b", "http://example.org/a?x=1#y", "ftp://h/ä b", "bad\r\nInjected: 1", None, ""]), r.choice(bodies)) for i in range(80)]
    return rows + [(200, "http://a/", "only"), (3, rows[3][1], rows[3][2]), (None, "http://a/", "only"), (None, "http://b/", "nobody"), (-5, "http://c/", "x" * 5000)]


@pytest.mark.parametrize(("min_bytes", "archive", "per_range"), [(0, 32 << 20, 100_000), (0, 2000, 9), (6, 700, 20)])
def test_archives_and_index(spark, scratch, min_bytes, archive, per_range):
    rows = pages()
    df = table(spark, ints=("page_id",), page_id=[x[0] for x in rows], url=[x[1] for x in rows], html=[x[2] for x in rows])
    found = warc.capture_index(warc.archive_pages(df, scratch, min_bytes, archive), scratch, per_range).collect()
    first = {}
    for i, _, html in rows:
        body = (html or "").encode()
        if i is not None and len(body) >= min_bytes:
            first[body] = min(i, first.get(body, i))
    times = Counter((html or "").encode() for _, _, html in rows)
    want = Counter()
    for i, url, html in rows:
        body = (html or "").encode()
        again = len(body) >= min_bytes and times[body] > 1 and body in first and first[body] != i
        want[i, len(body), warc.base32_sha1(body), "revisit" if again else "response", first[body] if again else None, warc.url_key(url)] += 1
    safe = {warc.url_key(warc._header_safe(u)) if u is not None else "": warc.url_key(u) for _, u, _ in rows}
    assert Counter((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to, safe[x.urlkey]) for x in found) == want
    by_url = defaultdict(list)
    for x in found:
        by_url[x.urlkey].append(x)
    for own in by_url.values():
        own.sort(key=lambda x: x.capture)
        assert [x.capture for x in own] == list(range(len(own)))
        order = [(x.timestamp, x.page_id is not None, x.page_id or 0) for x in own]
        assert order == sorted(order)


def test_index_is_globally_ordered(spark, scratch):
    rows = pages(3)
    df = table(spark, ints=("page_id",), page_id=[x[0] for x in rows], url=[x[1] for x in rows], html=[x[2] for x in rows])
    found = warc.capture_index(warc.archive_pages(df, scratch, archive=900), scratch, 10).orderBy("place").collect()
    order = [(x.urlkey, x.timestamp, x.page_id is not None, x.page_id or 0) for x in found]
    assert order == sorted(order)


def test_no_pages(spark, scratch):
    df = table(spark, ints=("page_id",), page_id=[], url=[], html=[])
    assert warc.capture_index(warc.archive_pages(df, scratch), scratch).count() == 0


def test_records_round_trip():
    bodies = [b"", b"abc", bytes(range(256)) * 3000, b"\r\n\r\n"]
    data = b"".join(warc.record(i, "http://x/", b, None) for i, b in enumerate(bodies)) + warc.record(9, None, b"abc", 1)
    found = list(warc.records(io.BytesIO(data)))
    assert [x[3].partition(b"\r\n\r\n")[2] for x in found] == [*bodies, b""]
    assert [warc.page_of(x[2]["warc-record-id"]) for x in found] == [0, 1, 2, 3, 9] and warc.page_of(found[4][2]["warc-refers-to"]) == 1
    for offset, length, *_ in found:
        assert zlib.decompressobj(31).decompress(data[offset : offset + length])
    with pytest.raises(EOFError):
        list(warc.records(io.BytesIO(data[:-3])))


def test_record_ids_hold_any_id():
    for i in (0, 1, -1, 2**63 - 1, -(2**63), 12345, None):
        assert warc.page_of(warc.record_id(i)) == i
    assert len({warc.record_id(i) for i in (0, 1, -1, None)}) == 4


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 64, 150])
def test_loser_tree(k):
    r = random.Random(k)
    runs = [sorted(r.randint(0, 50) for _ in range(r.randint(0, 30))) for _ in range(k)]
    assert list(warc.LoserTree(runs)) == sorted(x for run in runs for x in run)
    assert list(warc.merge_runs(runs, lambda x: x, fan_in=4)) == sorted(x for run in runs for x in run)


def test_loser_tree_is_stable():
    runs = [[(1, "a"), (2, "a")], [(1, "b"), (2, "b")], [(1, "c")]]
    assert list(warc.LoserTree(runs, key=lambda x: x[0])) == [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b")]


# --- chat -----------------------------------------------------------------------------------------------------

TEXTS = ["hi", "", None, "</s>[INST] ok [/INST]", "<|user|>", "<|>", "\\", "\\\\</s\\>", "a\\<|b", "<<SYS>> x <</SYS>>", "é😀\n</s></s>", "|>", "<", "[INST", "s>" * 3]


def read(out):
    rows = out.select("conv_id", "leaf", "rank", "formatted", chat.parsed(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("loss")).collect()
    return {(r.conv_id, r.leaf): ([(t.role, t.text) for t in r.turns], r.loss, r.rank, r.formatted) for r in rows}


def test_linear_conversations_round_trip(spark, scratch):
    r = random.Random(1)
    rows = []
    for conv in range(30):
        for turn in range(r.choice([1, 2, 3, 8, 33])):
            rows.append((conv, turn, r.choice(["user", "assistant", "system", "", None, "</s>", "a|>b|", ">", "|", ">|>", "<"]), r.choice(TEXTS)))
    rows += [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (77, None, "assistant", "z"), (77, 1, "user", "b"), (77, 1, "user", "a"), (77, 1, "user", "a"), (-7, 0, "user", TEXTS[3]), (-7, 1, "assistant", TEXTS[3])]
    df = table(spark, ints=("conv_id", "turn"), conv_id=[x[0] for x in rows], turn=[x[1] for x in rows], role=[x[2] for x in rows], text=[x[3] for x in rows])
    found = {k[0]: v for k, v in read(chat.formatted(chat.linear_tree(df), scratch)).items()}
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    assert found.keys() == by.keys()
    for conv, own in by.items():
        turns = [(x[3], x[5]) for x in sorted(own)]
        assert found[conv][0] == turns
        assert found[conv][1] == "".join(t for role, t in turns if role == "assistant")
        assert found[conv][3].count("</s>") == len(turns) and "[INST]" not in found[conv][3]


def test_trees_give_every_path(spark, scratch):
    r = random.Random(2)
    nodes = []
    for tree in range(6):
        for node in range(r.randint(1, 60)):
            parent = None if node == 0 or r.random() < 0.05 else r.randint(max(0, node - 4), node - 1)
            nodes.append((tree, node, parent, r.choice(["user", "assistant"]), f"t{node}", r.random()))
    nodes.append((9, 1, 555, "user", "orphan", None))
    df = spark.createDataFrame(nodes, "conv_id long, node long, parent long, role string, text string, score double").repartition(3)
    found = read(chat.formatted(df, scratch))
    by = {(t, n): (p, role, text, s) for t, n, p, role, text, s in nodes}
    inner = {(t, p) for t, _, p, *_ in nodes if p is not None}
    want, scores = {}, defaultdict(list)
    for t, n in by:
        if (t, n) in inner:
            continue
        path, at = [], n
        while at is not None and (t, at) in by:
            path.append(by[t, at])
            at = by[t, at][0]
        want[t, n] = [(p[1], p[2]) for p in reversed(path)]
        scores[t].append((-sum(p[3] or 0 for p in path) / len(path), n))
    assert {k: v[0] for k, v in found.items()} == want
    for t, own in scores.items():
        own.sort()
        assert [found[t, n][2] for _, n in own] == list(range(1, len(own) + 1))
    best = read(chat.formatted(df, scratch, best=1))
    assert set(best) == {(t, min(own)[1]) for t, own in scores.items()}


def test_long_paths_and_cycles(spark, scratch):
    df = spark.range(700).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    found = chat.paths(df, scratch).collect()
    assert {(x.leaf, x.node, x.depth) for x in found} == {(699, i, 699 - i) for i in range(700)}
    ring = spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "conv_id long, node long, parent long")
    with pytest.raises(ValueError):
        chat.paths(ring, scratch, most_rounds=4)


def test_no_conversations(spark, scratch):
    df = table(spark, ints=("conv_id", "turn"), conv_id=[], turn=[], role=[], text=[])
    assert chat.formatted(chat.linear_tree(df), scratch).count() == 0


def test_formatting_is_native(spark, scratch):
    df = table(spark, ints=("conv_id", "turn"), conv_id=[1, 1], turn=[0, 1], role=["user", "assistant"], text=["a", "b"])
    plan = chat.formatted(chat.linear_tree(df), scratch)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- sharding -------------------------------------------------------------------------------------------------


def documents(spark, n=400):
    r = random.Random(3)
    rows = [(i, r.choice(["", "a", "hello " * 20, "é" * r.randint(1, 90)])) for i in range(n)]
    rows += [(n, None), (7, rows[7][1]), (7, "other"), (None, "x"), (None, None)]
    return rows, table(spark, ints=("doc_id",), doc_id=[x[0] for x in rows], text=[x[1] for x in rows])


@pytest.mark.parametrize("bucket_bytes", [16 << 20, 300])
def test_shards(spark, scratch, bucket_bytes):
    rows, df = documents(spark)
    out = sharding.sharded(df, scratch, shards=5, bucket_bytes=bucket_bytes)
    found = out.withColumn("grown", sharding.shard_of(F.col("doc_id"), 6)).collect()
    assert Counter((x.doc_id, x.text) for x in found) == Counter(rows)
    by = defaultdict(list)
    for x in found:
        by[x.shard].append(x.slot)
        assert x.grown in (x.shard, 5)
    assert set(by) <= set(range(5)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert all(30 < len(s) for s in by.values())
    again = sharding.sharded(df.repartition(7), scratch, shards=5, bucket_bytes=bucket_bytes).collect()
    assert {(x.doc_id, x.text, x.shard, x.slot) for x in found} == {(x.doc_id, x.text, x.shard, x.slot) for x in again}


def test_shards_shuffle(spark, scratch):
    _, df = documents(spark)
    own = sharding.sharded(df, scratch, shards=1).orderBy("slot").collect()
    ids = [x.doc_id for x in own if x.doc_id is not None]
    assert ids != sorted(ids) and sum(a < b for a, b in zip(ids, ids[1:], strict=False)) < 0.65 * len(ids)


def test_shards_of_one_id_are_bounded(spark, scratch):
    df = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("t" * 50), F.col("id").cast("string")).alias("text"))
    found = sharding.sharded(df, scratch, shards=3, bucket_bytes=2000).collect()
    assert len({x.shard for x in found}) == 1 and sorted(x.slot for x in found) == list(range(3000))


def test_columns_of_clashing_names_are_kept(spark, scratch):
    _, df = documents(spark, 20)
    out = sharding.sharded(df.withColumnRenamed("slot", "Slot"), scratch, shards=2)
    assert {"shard_", "bucket_", "before_", "Slot_", "shard", "bucket", "slot"} <= set(out.columns)
    assert all(x.shard_ == x.bucket_ == x.before_ == x.Slot_ == "own" for x in out.collect())


def test_no_rows_to_shard(spark, scratch):
    _, df = documents(spark)
    assert sharding.sharded(df.limit(0), scratch).count() == 0


def test_permutation_is_uniform():
    seen = Counter(tuple(sharding.permutation(3, s).tolist()) for s in range(3000))
    assert len(seen) == 6 and all(400 < n < 600 for n in seen.values())
    assert sharding.permutation(0, 1).tolist() == []


def test_sha_of_text_is_utf8():
    assert hashlib.sha1("é".encode()).digest() == hashlib.sha1(b"\xc3\xa9").digest()

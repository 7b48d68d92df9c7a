"""Linkage, graphs, sources, sinks and streams end to end on small rows."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import graph, incremental, linkage, profile, stats
from weftline.plans import mapping
from weftline.sources import readers, writers

CODE = "91310101MA1FPX12"


def registries(spark):
    s = [(1, "上海宏达电子有限公司", "上海市虹口区天宝路1号", CODE + "01", "王明"), (2, "上海永兴机械有限公司", "上海市虹口区四平路2号", "", ""), (3, "无关", "", "", ""), (4, "上海金源贸易有限公司", "", CODE + "04", "")]
    t = [(11, "宏达电子", "", CODE + "01", "李明", "2024-01-01"), (12, "宏达", "天宝路", CODE + "01", "王明", "2023-01-01"), (13, "上海市永兴机械有限公司", "上海市虹口区四平路2号", "", "", ""), (14, "x", "", "", "", "")]
    src = linkage.Registry("id", "name", "addr", "code", "person").rows(spark.createDataFrame(s, "id int, name string, addr string, code string, person string"), "src", "s")
    tgt = linkage.Registry("id", "name", "addr", "code", "person", date="day").rows(spark.createDataFrame(t, "id int, name string, addr string, code string, person string, day string"), "tgt", "t")
    return src, tgt


def test_registry_linkage(spark):
    src, tgt = registries(spark)
    found = {r.src: r for r in linkage.registry_linkage(src, tgt).collect()}
    assert (found[1].tgt, found[1].match_type) == (12, "exact_credit_code")
    assert found[2].tgt == 13 and found[2].match_type.startswith("fuzzy")
    assert found[3].tgt is None and found[3].match_type == "none" and found[4].tgt is None
    every = linkage.registry_matches(src, tgt)
    assert {(r.src, r.tgt, r.match_rank, r.is_primary) for r in every.collect() if r.src == 1} == {(1, 11, 1, False), (1, 12, 2, True)}
    summary = {r.src: r for r in linkage.match_summary(every).collect()}
    assert (summary[1].total_matches, summary[1].latest, summary[1].earliest) == (2, "2024-01-01", "2023-01-01")
    assert {r.src for r in linkage.unmatched(src, every).collect()} == {3, 4}


def test_mapped_strategies(spark):
    a = spark.createDataFrame([(1, "small ring", "13800001111"), (2, "red plate", None)], "id int, name string, phone string")
    b = spark.createDataFrame([(5, "small rings", "13800001111"), (6, "red plates", "1"), (7, "other", None)], "id int, title string, tel string")
    maps = [mapping.Mapping("name", "title", "levenshtein", primary=True), mapping.Mapping("phone", "tel", "phone", weight=0.5)]
    for strategy in ("fallback", "hierarchical", "simple", "dual"):
        best = {r.src: r.tgt for r in mapping.linked(a, b, maps, "id", "id", strategy).filter("rank = 1").collect()}
        assert best[1] == 5
    with pytest.raises(ValueError):
        mapping.linked(a, b, maps, "id", "id", "none")
    found = mapping.suggestions(a, b)
    assert {(x["source_field"], x["target_field"]) for x in found if x["rank"] == 1} >= {("id", "id"), ("phone", "tel")}
    assert {r.source_field: r.coverage for r in mapping.coverage(a, maps).collect()} == {"name": 1.0, "phone": 0.5}
    assert mapping.applied(a, maps).columns == ["title", "tel"]
    mapping.register("same", lambda x, y: (x == y).cast("double"))
    assert "same" in mapping.SIMILARITIES
    assert mapping.join_conditions({"a": a, "b": b})[0]["left"] == "a.id"


def test_graph_build(spark):
    rows = spark.createDataFrame([(1, "宏达有限公司", "王明", "上海市天宝路1号"), (2, "永兴有限公司", "李小红", "上海市四平路2号"), (3, "宏达有限公司", "王明", "")], "id int, unit string, manager string, address string")
    fields = graph.entity_columns(rows.columns)
    assert fields[graph.ORGANISATION] == ["unit"] and fields[graph.PERSON] == ["manager"] and fields[graph.LOCATION] == ["address"]
    fields.pop(graph.IDENTIFIER, None)
    entities, triples = graph.build({"t": (rows, "id", fields)}, [(graph.MANAGED_BY, "unit", "manager"), (graph.LOCATED_IN, "unit", "address")])
    got = {(r.subject_label, r.predicate, r.object_label) for r in triples.collect()}
    assert ("宏达有限公司", "MANAGED_BY", "王明") in got and ("王明", "REPRESENTS", "宏达有限公司") in got and ("永兴有限公司", "LOCATED_IN", "上海市四平路2号") in got
    assert entities.count() == 6
    found = {r.id: r.component for r in graph.components(entities, triples).collect()}
    assert len(set(found.values())) == 2
    assert graph.edges(triples, entities).count() == triples.count()
    assert graph.new_entities(entities, entities).count() == 0
    lines = [r.value for r in writers.turtle(entities, triples).collect()]
    assert len(lines) == entities.count() + triples.count()
    assert all(x.value.startswith(("CREATE", "MATCH")) for x in writers.cypher(entities, triples).collect())
    said = spark.createDataFrame([("宏达有限公司位于上海市天宝路1号",)], "text string")
    assert graph.text_triples(said, "text", entities).first().predicate == graph.LOCATED_IN
    assert graph.merged_triples(triples.drop("times").unionByName(triples.drop("times"))).count() == triples.count()
    again = graph.merged_triples(triples.drop("times").withColumn("evidence", F.expr("transform(sequence(1, 30), i -> concat('e', i))")).unionByName(triples.drop("times")))
    assert again.filter("times = 2 and size(evidence) = 10").count() == triples.count()
    one = entities.filter("label = '宏达有限公司'").first()
    assert one.records == 2 and one.properties["unit"] == "宏达有限公司"
    assert graph.remapped(entities, {"PERSON": "HUMAN"}, {"unit": "name"}).filter("type = 'HUMAN'").count() == 2


def test_triangles(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "a"), ("b", "a")], "subject_id string, object_id string")
    assert graph.triangles(df).first()[0] == 1


def test_upserts(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    writers.upsert_table(spark, spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, "k")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    for _ in range(2):
        out = writers.upsert_table(spark, new, path, "k")
        assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert writers.verify_keys(new, out, "k").count() == 0
    assert writers.clear(spark, path, F.col("k") == 1) == 1
    assert spark.read.parquet(path).count() == 2


@pytest.mark.parametrize(("encoding", "sep"), [("utf-8", ","), ("utf-8-sig", ";"), ("gbk", "\t"), ("utf-8", "|")])
def test_csv(spark, tmp_path, encoding, sep):
    path = tmp_path / "上海 file.csv"
    path.write_bytes(f" 名称{sep}n{sep}x{sep}empty\r\n宏达{sep}1{sep}1.5{sep}\r\n永兴{sep}2{sep}NA{sep}NULL\r\n宏达{sep}1{sep}1.5{sep}\r\n".encode(encoding))
    rows = readers.read_csv(spark, f"file://{path}")
    assert dict(rows.dtypes)["n"] == "bigint" and rows.count() == 3
    clean = readers.cleaned(rows)
    assert clean.columns == ["名称", "n", "x"]
    assert {tuple(r) for r in clean.collect()} == {("宏达", 1, 1.5), ("永兴", 2, None)}
    assert {t for _, t in readers.read_csv(spark, f"file://{path}", strings_only=True).dtypes} == {"string"}
    assert readers.validate_file(spark, f"file://{path}") == [] and readers.validate_file(spark, f"file://{path}x") == ["missing"]


def test_csv_names():
    assert readers.collection_name("My file (1).csv") == "my_file_1" and readers.collection_name(".csv") == "table"
    assert readers.detect_delimiter("a;b\n1;2") == ";" and readers.detect_delimiter("abc") == ","


def test_profile_of_nulls(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, None, None)], "n int, s string, e string")
    got = {r.column: (r.nulls, r.distinct_values) for r in profile.counts(df).collect()}
    assert got == {"n": (0, 2), "s": (1, 1), "e": (3, 0)}
    basics = profile.basics(df).first()
    assert (basics.rows, basics.duplicates, basics.empty_rows) == (3, 1, 0)
    assert profile.counts(df.limit(0)).count() == 3
    assert {r.column: r.data_type for r in profile.value_types(df).collect()} == {"n": "number", "s": "string", "e": "unknown"}


def test_validation_finds_issues(spark):
    df = spark.createDataFrame([("a@b.cc", "13800001111", "2020-01-01"), ("bad", "1", "1800-01-01")], "email string, phone string, day_date string")
    got = profile.validity(df).first()
    assert got.issues == 3 and got.score == pytest.approx(0.0)


def test_incremental(spark):
    src = spark.createDataFrame([(1,), (2,), (3,)], "src int")
    done = spark.createDataFrame([(1, "fuzzy"), (2, "none")], "src int, match_type string")
    assert {r.src for r in incremental.unprocessed(src, done).collect()} == {3}
    assert {r.src for r in incremental.unprocessed(src, done, retry_unmatched=True).collect()} == {2, 3}
    kept, gone = incremental.deleted(done, F.col("src") == 1)
    assert kept.count() == 1 and gone.first()[0] == 1


def test_association_skips_empty_keys(spark):
    df = spark.createDataFrame([(1, "k", 0.5), (2, "k", None), (3, None, 1.0), (4, "", 1.0), (5, "", 1.0), (6, "z", 1.0)], "id int, b string, s double")
    groups = stats.associations(df, "b", F.col("s"), ["b", "s"])
    got = groups.collect()
    assert {r.id for r in stats.association_records(df, groups, "b").collect()} == {1, 2}
    assert [(r.association_id, r.members, r.confidence, r.quality) for r in got] == [("k", 2, 0.5, 0.75)]


def test_linkage_stream(spark, tmp_path):
    from weftline.streaming.incremental import file_stream, linked_stream

    src, tgt = registries(spark)
    src.write.parquet(f"{tmp_path}/in")
    results = f"file://{tmp_path}/out"
    for _ in range(2):
        linked_stream(file_stream(spark, f"{tmp_path}/in", src.schema), lambda batch: linkage.name_join(batch, tgt.withColumn("t_name", F.lit("无关"))), results, f"{tmp_path}/checkpoint").awaitTermination(120)
    assert [r.src for r in spark.read.parquet(results).collect()] == [3]


def test_windows_on_a_stream(spark, tmp_path):
    from weftline.streaming.incremental import file_stream, tumbling

    rows = spark.createDataFrame([(0, "a", 1.0), (30, "a", 2.0), (4000, "a", 3.0)], "s int, kind string, value double").select(F.timestamp_seconds("s").alias("ts"), "kind", "value")
    rows.write.parquet(f"{tmp_path}/in")
    out = tumbling(file_stream(spark, f"{tmp_path}/in", rows.schema), "1 minute", "kind", "value", late="10 seconds")
    q = out.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.n, r.total) for r in spark.sql("SELECT * FROM windows").collect()] == [(2, 3.0)]


def test_other_joins(spark):
    from weftline.operators import blocking

    src, tgt = registries(spark)
    found = {(r.src, r.tgt): r.score for r in linkage.simple_pairs(src, tgt, [("s_name", "t_name")]).collect()}
    assert found == {(1, 11): 0.7, (1, 12): 0.7}
    tables = linkage.per_table(src, {"a": tgt, "b": tgt}, lambda s, t: linkage.simple_pairs(s, t, [("s_name", "t_name")]).drop("rank"), keep=1)
    assert {(r.src, r.tgt, r.target_table) for r in tables.collect()} == {(1, 11, "a"), (1, 11, "b")}
    one, two = (spark.createDataFrame(rows, "src int, tgt int, score double") for rows in ([(1, 11, 1.0)], [(1, 12, 0.5), (2, 13, 0.5)]))
    assert {(r.src, r.tgt, r.step) for r in blocking.cascade(src, ("x", one), ("y", two)).collect()} == {(1, 11, "x"), (2, 13, "y")}
    assert {(r.src, r.tgt) for r in blocking.candidate_union(one, two).collect()} == {(1, 11), (1, 12), (2, 13)}
    lifted = {r.tgt: r.score for r in linkage.boosted_by_shared(spark.createDataFrame([(1, 11, 0.8), (1, 12, 0.6), (1, 13, 0.9)], "src int, tgt int, score double"), two.union(one).unionByName(spark.createDataFrame([(1, 11, 0.0)], "src int, tgt int, score double"))).collect()}
    assert lifted == {11: 0.98, 12: 0.6, 13: 0.9}
    assert linkage.details(one, src, tgt).first().t_name == "宏达电子"
    assert linkage.slice_name_scores(spark.createDataFrame([("ab", "ab")], "s_name string, t_name string")).first().score == 1.0


def test_rules(spark):
    from weftline.operators import scoring

    df = spark.createDataFrame([("爱心养老院", "爱心护理院"), ("a集团", "a分公司")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    assert [r[0] for r in df.select(scoring.synonym_threshold(a, b)).collect()] == [0.15, 0.25]
    assert [r[0] for r in df.select(scoring.conflicting_words(a, b, (("集团", "分公司"),))).collect()] == [False, True]
    assert [r[0] for r in df.select(scoring.precheck(a, b)).collect()] == [True, False]
    bands = spark.createDataFrame([(0.97, 3), (0.85, 2), (0.75, 1), (0.65, 1), (0.1, 0)], "s double, n int")
    assert [r[0] for r in bands.select(scoring.match_kind(F.col("s"), F.col("n"))).collect()] == ["exact_match", "strong_match", "good_match", "weak_match", "poor_match"]
    assert [r[0] for r in bands.select(scoring.decision(F.col("s"))).collect()] == ["accept", "accept", "suspect", "suspect", "reject"]
    assert scoring.merged_thresholds([{"high": 0.8}, {}])["high"] == pytest.approx(0.85)
    flags = df.select(scoring.consistency({"name": (a, b), "address": (a, b)}, F.lit(True)).alias("c")).first().c
    assert (flags.name, flags.address) == (False, True)


def test_cleaning_and_exports(spark, tmp_path):
    tasks = spark.createDataFrame([("a", "done", "2024-01-10"), ("b", "failed", "2024-01-10"), ("c", "done", "2023-01-01")], "id string, status string, day string").withColumn("created_at", F.to_timestamp("day"))
    assert [r.id for r in incremental.cleaned(tasks, F.to_timestamp(F.lit("2024-01-11")), 30, ["failed"]).collect()] == ["a"]
    rows = spark.createDataFrame([(1, "-", "x", 0.951)], "id int, a string, b string, s double")
    out = writers.export_rows(rows, {"Id": "id", "Name": ["a", "b"], "Score": "s"}, ["Score"], ["Id"]).first()
    assert tuple(out) == ('="1"', "x", "95.1%")
    writers.write_csv(rows, f"file://{tmp_path}/csv")
    assert readers.read_csv(spark, f"file://{tmp_path}/csv").first().b == "x"
    entities = spark.createDataFrame([("e1", "PERSON", 'A"B', {"k": "v"}, 0.9)], "id string, type string, label string, properties map<string,string>, confidence double")
    triples = spark.createDataFrame([("e1", "P", "e1", 0.5, ["x"])], "subject_id string, predicate string, object_id string, confidence double, evidence array<string>")
    for kind in ("json", "csv", "rdf", "cypher"):
        writers.write_graph(entities, triples, f"file://{tmp_path}/{kind}", kind)
    with pytest.raises(ValueError):
        writers.write_graph(entities, triples, f"file://{tmp_path}/x", "x")
    assert writers.upsert_edges(spark, triples, entities, f"file://{tmp_path}/edges", "p").count() == 1
    assert writers.upsert_entities(spark, entities, f"file://{tmp_path}/nodes", "p").count() == 1
    assert stats.sampled(tasks, 2).count() == 2
    assert profile.place_hierarchy(["nation", "district", "x"]) == [("nation", "district")]
    assert profile.naming_patterns(["a_b", "aB", "AB"])["snake_case"] == 1

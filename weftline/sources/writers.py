"""Exports and keyed sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.values import first_present
from weftline.operators.incremental import upsert
from weftline.session import kept


def percent(value: Column) -> Column:
    """0.9512 -> 95.1%."""
    return F.format_string("%.1f%%", F.round(value * 100, 1))


def spreadsheet_text(value: Column) -> Column:
    """An id that a spreadsheet keeps as text."""
    return F.when(value.isNotNull(), F.concat(F.lit('="'), value.cast("string"), F.lit('"')))


def export_rows(results: DataFrame, columns: dict[str, str | list[str]], percents: list[str] = (), texts: list[str] = ()) -> DataFrame:
    """Columns renamed (title -> column, or the first of several that has a value), shares as percents, ids as text."""
    out = []
    for title, source in columns.items():
        value = first_present(*[F.col(c) for c in source]) if isinstance(source, list) else F.col(source)
        out.append((percent(value) if title in percents else spreadsheet_text(value) if title in texts else value).alias(title))
    return results.select(*out)


def write_csv(rows: DataFrame, path: str) -> None:
    """A CSV export with headers; executors write their parts. The encoding is UTF-8."""
    rows.write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def recovered(spark: SparkSession, path: str) -> bool:
    """Whether there is a table, after an overwrite that broke off between its two moves is undone."""
    fs, now = _hadoop(spark, path)
    _, old = _hadoop(spark, f"{path}.old")
    if not fs.exists(now) and fs.exists(old):
        fs.rename(old, now)
    return fs.exists(now)


def overwrite(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """Replaces a table by rows that may derive from it: written beside it first, then moved into its place. The old table
    is moved aside and deleted last, so that at no time it is lost; recovered() puts it back."""
    fs, now = _hadoop(spark, path)
    (_, new), (_, old) = _hadoop(spark, f"{path}.new"), _hadoop(spark, f"{path}.old")
    recovered(spark, path)
    rows.write.mode("overwrite").parquet(f"{path}.new")
    fs.delete(old, True)
    if (fs.exists(now) and not fs.rename(now, old)) or not fs.rename(new, now):
        raise OSError(f"{path}.new could not be moved")
    fs.delete(old, True)
    return spark.read.parquet(path)


def upsert_table(spark: SparkSession, new: DataFrame, path: str, key: str | list[str]) -> DataFrame:
    """Writes rows to a keyed table: those of a key replace what is there. Doing it twice changes nothing."""
    if not recovered(spark, path):
        new.write.parquet(path)
        return spark.read.parquet(path)
    return overwrite(spark, upsert(spark.read.parquet(path), new, key), path)


def upsert_parts(spark: SparkSession, new: DataFrame, path: str, key: str | list[str], parts: int = 256) -> DataFrame:
    """The same for a table of many rows and few new ones: it is parted by a hash of the key (column key_part), and only the
    parts that new rows fall in are read and written again."""
    keys = [key] if isinstance(key, str) else key
    new = kept(new.withColumn("key_part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")), "new")
    fs, at = _hadoop(spark, path)
    rows = new
    if fs.exists(at):
        touched = [r.key_part for r in new.select("key_part").distinct().limit(parts).collect()]
        rows = kept(upsert(spark.read.parquet(path).filter(F.col("key_part").isin(touched)), new, keys), "merged")
    rows.repartition("key_part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key_part").parquet(path)
    return spark.read.parquet(path)


def verify_keys(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Keys of new rows that the stored table lacks."""
    return new.select(key).join(stored.select(key), key, "left_anti")


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def upsert_entities(spark: SparkSession, entities: DataFrame, path: str, project: str) -> DataFrame:
    """Entities of a project, keyed by project and id."""
    return upsert_table(spark, entities.withColumn("project_name", F.lit(project)), path, ["project_name", "id"])


def upsert_edges(spark: SparkSession, triples: DataFrame, entities: DataFrame, path: str, project: str) -> DataFrame:
    """Triples whose ends exist, keyed by project and their three parts."""
    from weftline.operators.graph import edges

    return upsert_table(spark, edges(triples, entities).withColumn("project_name", F.lit(project)), path, ["project_name", "subject_id", "predicate", "object_id"])


def clear(spark: SparkSession, path: str, condition: Column | None = None) -> int:
    """Deletes the rows that fulfil a condition, all by default; how many there were."""
    rows = spark.read.parquet(path)
    hit = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
    n = rows.filter(hit).count()
    overwrite(spark, rows.filter(~hit), path)
    return n


# --- graph exports --------------------------------------------------------------------------------------------


def _quoted(value: Column) -> Column:
    x = F.coalesce(value.cast("string"), F.lit(""))
    return F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def turtle(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """Lines of RDF in Turtle: types and labels of entities, then the triples."""
    kg = F.lit("kg:")  # readers need a prefix line: @prefix kg: <http://example.org/kg/> .
    nodes = entities.select(F.concat(kg, "id", F.lit(" a "), kg, "type", F.lit(" ; kg:label "), _quoted(F.col("label")), F.lit(" .")).alias("value"))
    return nodes.unionByName(triples.select(F.concat(kg, "subject_id", F.lit(" "), kg, "predicate", F.lit(" "), kg, "object_id", F.lit(" .")).alias("value")))


def cypher(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """Statements that build the graph."""
    pairs = F.array_join(F.transform(F.map_entries("properties"), lambda e: F.concat(F.lit(", `"), e["key"], F.lit("`: "), _quoted(e["value"]))), "")
    nodes = entities.select(F.concat(F.lit("CREATE (:"), "type", F.lit(" {id: "), _quoted(F.col("id")), F.lit(", label: "), _quoted(F.col("label")), pairs, F.lit("})")).alias("value"))
    ends = F.concat(F.lit("MATCH (s {id: "), _quoted(F.col("subject_id")), F.lit("}), (o {id: "), _quoted(F.col("object_id")), F.lit("}) CREATE (s)-[:"), "predicate", F.lit(" {confidence: "), F.col("confidence").cast("string"), F.lit("}]->(o)"))
    return nodes.unionByName(triples.select(ends.alias("value")))


def flat_entities(entities: DataFrame) -> DataFrame:
    return entities.withColumn("properties", F.to_json("properties"))


def write_graph(entities: DataFrame, triples: DataFrame, path: str, kind: str = "json") -> None:
    """Exports a graph as json, csv, rdf or cypher."""
    if kind == "json":
        json_lines(entities).write.mode("overwrite").text(f"{path}/entities")
        json_lines(triples).write.mode("overwrite").text(f"{path}/triples")
    elif kind == "csv":
        write_csv(flat_entities(entities), f"{path}/entities")
        write_csv(triples.drop("evidence"), f"{path}/triples")
    elif kind in ("rdf", "cypher"):
        lines = turtle(entities, triples) if kind == "rdf" else cypher(entities, triples)
        lines.write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown format: {kind}")

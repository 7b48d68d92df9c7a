"""Delimited files, spreadsheets, and ingest cleaning."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.values import CSV_MISSING

#: Encodings in the order they are tried, delimiters, and what an upload may be.
ENCODINGS = ("utf-8-sig", "utf-8", "gbk", "gb18030", "big5", "latin-1")
DELIMITERS = (",", ";", "\t", "|")
EXTENSIONS = (".csv", ".txt", ".xlsx", ".xls")
MOST_BYTES = 500 << 20
_HEAD = 64 << 10


def head(spark: SparkSession, path: str, n: int = _HEAD) -> bytes:
    """The first bytes of a file, or of the first file of a folder, through Spark's file systems."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    if fs.getFileStatus(at).isDirectory():
        files = [s.getPath() for s in fs.listStatus(at) if not s.getPath().getName().startswith(("_", "."))]
        at = min(files, key=lambda p: p.getName())
    stream = fs.open(at)
    try:
        size = min(n, fs.getFileStatus(at).getLen())
        return bytes(stream.readNBytes(int(size)))
    finally:
        stream.close()


def detect_encoding(data: bytes) -> str:
    """The first encoding that reads the bytes; a character cut off at their end doesn't count against it."""
    for name in ENCODINGS:
        if name == "utf-8-sig" and not data.startswith(b"\xef\xbb\xbf"):
            continue
        for cut in range(4):
            try:
                data[: len(data) - cut].decode(name)
            except UnicodeDecodeError:
                continue
            return name
    return "latin-1"


def detect_delimiter(text: str) -> str:
    """The delimiter that is in each of the first ten lines equally often, most often; a comma if none is."""
    lines = [x for x in text.splitlines()[:10] if x.strip()]
    found = {d: {line.count(d) for line in lines} for d in DELIMITERS}
    steady = {d: n.pop() for d, n in found.items() if len(n) == 1 and 0 not in n}
    return max(steady, key=lambda d: steady[d]) if steady else ","


def validate_file(spark: SparkSession, path: str, most: int = MOST_BYTES) -> list[str]:
    """What speaks against reading a file; nothing if it is fine."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return ["missing"]
    out = [] if path.lower().endswith(EXTENSIONS) or fs.getFileStatus(at).isDirectory() else ["extension"]
    size = fs.getContentSummary(at).getLength()
    return out + (["empty"] if size == 0 else ["too large"] if size > most else [])


def collection_name(name: str) -> str:
    """Letters, digits and ideographs of a file name, underscores between."""
    stem = re.sub(r"\.[^.]*$", "", name)
    return re.sub(r"_+", "_", re.sub(r"[^\w一-鿿]", "_", stem)).strip("_").lower() or "table"


def free_name(spark: SparkSession, name: str) -> str:
    """The name, or the name with the first number that no table has."""
    if not spark.catalog.tableExists(name):
        return name
    return next(f"{name}_{i}" for i in range(1, 10_000) if not spark.catalog.tableExists(f"{name}_{i}"))


def read_csv(spark: SparkSession, path: str, strings_only: bool = False, encoding: str | None = None, delimiter: str | None = None) -> DataFrame:
    """A delimited file with a header, its encoding and delimiter detected. strings_only: all columns as they are
    written; otherwise tokens for nothing are null and types are inferred from the values. A file without quoted
    line breaks is read in splits, one with any as a whole."""
    data = head(spark, path)
    encoding = encoding or detect_encoding(data)
    delimiter = delimiter or detect_delimiter(data.decode(encoding, "ignore"))
    java = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "gbk": "GBK", "gb18030": "GB18030", "big5": "Big5", "latin-1": "ISO-8859-1"}[encoding]
    if java in ("GBK", "GB18030", "Big5"):  # Spark reads these only under this setting
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    # a quoted line break leaves a line with an odd number of quotes; without one the file can be split
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    broken = not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()
    rows = spark.read.option("header", True).option("encoding", java).option("sep", delimiter).option("quote", '"').option("escape", '"').option("multiLine", broken).option("nullValue", "\x00").option("emptyValue", "").csv(path)
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    return rows if strings_only else typed(nulled(rows))


def nulled(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.when(~F.trim(F.col(f"`{c}`")).isin(*CSV_MISSING), F.col(f"`{c}`")).alias(c) for c in rows.columns])


def typed(rows: DataFrame) -> DataFrame:
    """Text columns whose values all are whole numbers, numbers or timestamps, in that type; decided over all rows."""
    tests = {"bigint": r"^-?(0|[1-9][0-9]{0,17})$", "double": r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$", "timestamp": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2})?.*)?$"}
    all_ = rows.agg(*[F.coalesce(F.every(F.trim(F.col(f"`{c}`")).rlike(p)), F.lit(False)).alias(f"{i}|{t}") for i, c in enumerate(rows.columns) for t, p in tests.items()]).first().asDict()
    kind = {i: next((t for t in tests if all_[f"{i}|{t}"]), None) for i in range(len(rows.columns))}
    return rows.select(*[F.trim(F.col(f"`{c}`")).try_cast(kind[i]).alias(c) if kind[i] else F.col(f"`{c}`") for i, c in enumerate(rows.columns)])


def read_excel(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """A spreadsheet, read by the driver; needs a spreadsheet library that pandas knows."""
    import io

    import pandas as pd

    data = head(spark, path, (1 << 31) - 1)
    frame = pd.read_excel(io.BytesIO(data), sheet_name=sheet, na_values=list(CSV_MISSING))
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None))


def cleaned(rows: DataFrame) -> DataFrame:
    """Names trimmed, rows and columns of nulls only dropped, equal rows once."""
    rows = rows.toDF(*[c.strip() for c in rows.columns])
    there = rows.agg(*[F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(rows.columns)]).first()
    kept = [c for i, c in enumerate(rows.columns) if there[i]]
    if not kept:
        return rows.limit(0)
    some = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNotNull() for c in kept])
    return rows.select(*[f"`{c}`" for c in kept]).filter(some).dropDuplicates()


def preview(rows: DataFrame, n: int = 10) -> DataFrame:
    return rows.limit(n)


def ingest(spark: SparkSession, path: str, name: str | None = None) -> str:
    """Validates, reads, cleans and saves a file as a new table; its name."""
    if problems := validate_file(spark, path):
        raise ValueError(f"{path}: {', '.join(problems)}")
    rows = read_excel(spark, path) if path.lower().endswith((".xlsx", ".xls")) else read_csv(spark, path)
    table = free_name(spark, collection_name(name or path.rsplit("/", 1)[-1]))
    cleaned(rows).write.saveAsTable(table)
    return table


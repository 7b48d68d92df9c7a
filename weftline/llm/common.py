"""What the operators share: durable intermediate tables, text columns as bytes, vectorised hashing."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_LOCAL: dict[str, str] = {}
#: Short rows that a file of a kept table has at least, where their number is known.
_FILE = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a
    single-machine session gets a temporary folder; a cluster session is refused."""
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return f"file://{_LOCAL[app]}"


def bounded_batches(spark: SparkSession, most: str = "4m") -> None:
    """From now on, rows of the session travel to Python workers in batches of about so many bytes, so that neither
    side holds thousands of long texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


class Scratch:
    """Tables of one run in the shared folder. keep() writes a table and returns it reread, which cuts
    the lineage and outlives lost executors; drop() removes one that nothing reads any more; sweep() removes all
    tables of the runs that began since mark(), once their result is written elsewhere."""

    _begun: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        bounded_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        Scratch._begun.append(self)

    @staticmethod
    def mark() -> int:
        return len(Scratch._begun)

    @staticmethod
    def sweep(mark: int) -> None:
        for begun in Scratch._begun[mark:]:
            begun.drop("")
        del Scratch._begun[mark:]

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """rows: at most so many short rows; they then go to few files, whatever the number of shuffle partitions."""
        if rows is not None:
            df = df.coalesce(1 + rows // _FILE)
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
            at.getFileSystem(conf).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cleared(df: DataFrame, *names: str) -> DataFrame:
    """df with its columns of these names, in any case, renamed by trailing underscores, to make room for them."""
    wanted = {n.lower() for n in names}
    taken, out = wanted | {c.lower() for c in df.columns}, []
    for c in df.columns:
        if c.lower() in wanted:
            while c.lower() in taken:
                c += "_"
            taken.add(c.lower())
        out.append(c)
    return df.toDF(*out)


def crc32_of(column: Column) -> Column:
    """CRC-32 of a value written as text, as unsigned long."""
    return F.crc32(column.cast("string").cast("binary"))


def utf8(array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string or binary array as (n + 1 offsets, bytes); null rows are empty."""
    import pyarrow as pa

    if len(array) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if array.null_count:
        array = array.fill_null("" if "string" in str(array.type) else b"")
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most so many bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


class Rolling:
    """Hashes of all windows of a sequence, from prefix sums of value * base^position modulo 2^64."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, most: int):
        self.grow(most)

    def grow(self, most: int) -> None:
        self.most = most
        self.power = np.full(most + 1, self.BASE, U64)
        self.power[0] = 1
        np.cumprod(self.power, out=self.power)
        self.inverse = np.full(most + 1, pow(self.BASE, -1, 1 << 64), U64)
        self.inverse[0] = 1
        np.cumprod(self.inverse, out=self.inverse)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        if len(values) > self.most:
            self.grow(len(values))
        sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self.power[: len(values)], out=sums[1:])
        return sums

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((sums[ends] - sums[starts]) * self.inverse[starts])

    def windows(self, sums: np.ndarray, k: int) -> np.ndarray:
        if len(sums) <= k:
            return np.zeros(0, U64)
        out = sums[k:] - sums[:-k]
        out *= self.inverse[: len(out)]
        return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the high bits of uint64 values over all bits, in place."""
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def word_hashes(raw: np.ndarray, rolling: Rolling, piece: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the runs of non-blanks in bytes that end with a blank, piece by piece, so that
    memory follows the words and not the bytes. A word longer than a piece is hashed by another function;
    which one depends on the word alone."""
    found, at = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64))], 0
    while at < len(raw):
        end = min(at + piece, len(raw))
        blanks = np.flatnonzero(raw[at:end] == 32)
        if not len(blanks):
            while not len(blanks := np.flatnonzero(raw[end : end + piece] == 32)):
                end += piece
            end += int(blanks[0])
            found.append((np.array([at]), np.array([end]), np.array([xxhash.xxh64_intdigest(raw[at:end])], U64)))
        else:
            end = at + int(blanks[-1]) + 1
            part = raw[at:end]
            edge = np.diff((part != 32).astype(np.int8), prepend=np.int8(0))
            first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            found.append((first + at, last + at, rolling.spans(rolling.prefix(part.astype(U64)), first, last)))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values (van Herk's block prefix and suffix minima)."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


class Forest:
    """Union-find over arbitrary keys; the smallest key of a tree is its root."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while up.get(root, root) != root:
            root = up[root]
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple]:
        return [(x, self.find(x)) for x in list(self.up)]


def dense_forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots (smallest index) of nodes 0..n-1 under edges a-b, by vectorised hooking and jumping."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        low, high = np.minimum(ra[open_], rb[open_]), np.maximum(ra[open_], rb[open_])
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root

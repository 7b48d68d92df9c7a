"""Sharding by a two-pass external shuffle: seeded scatter into buckets, then a shuffle within each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, cleared, release

SHARDS = 24
SEED = 7
#: UTF-8 bytes of a bucket, about; a task holds one bucket at a time.
BUCKET = 16 << 20
#: Tasks of the second pass, at most; with more buckets than that, a task takes several, one after another.
TASKS = 50_000
#: Bytes that a row takes besides its text.
ROW_BYTES = 8
LAW = "key"


def shard_of(id_col: Column, shards: int, seed: int = SEED) -> Column:
    """The shard whose hash with the id is the largest (rendezvous hashing). It depends on the id and the
    number of shards only, and one more shard takes rows into itself and moves no others."""
    drawn = [F.struct(F.xxhash64(F.lit(seed), id_col, F.lit(i)).alias("hash"), F.lit(-i).alias("shard")) for i in range(shards)]
    return (-F.greatest(*drawn)["shard"]).cast("int") if shards > 1 else F.lit(0)


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def permutation(n: int, *seeds: int) -> np.ndarray:
    """Fisher-Yates: from the last place down, each is swapped with one drawn among itself and those before."""
    draw = np.random.default_rng(seeds)
    order = np.arange(n)
    swap = draw.integers(0, np.arange(n, 0, -1)) if n else []
    for i, j in zip(range(n - 1, 0, -1), swap, strict=False):
        order[i], order[j] = order[j], order[i]
    return order


def _shuffled(seed: int, most: int):
    """Rows in the order of shard and bucket -> each bucket's rows in a new order, with their slots. A
    bucket of over `most` bytes, which only rows of one id can make, is shuffled in several pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, piece, done = None, [], 0, 0, 0

        def out():
            rows = pa.Table.from_batches(held).combine_chunks()
            n = rows.num_rows
            rows = rows.take(pa.array(permutation(n, seed, *now, piece)))
            slots = rows.column("before").to_numpy() + np.arange(done, done + n)
            yield from rows.drop_columns(["before"]).append_column("slot", pa.array(slots)).to_batches(max_chunksize=2000)

        for batch in batches:
            shard, bucket = (batch.column(c).to_numpy() for c in ("shard", "bucket"))
            edges = np.flatnonzero((np.diff(shard) != 0) | (np.diff(bucket) != 0)) + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(shard)], strict=True):
                if i == j:
                    continue
                key = int(shard[i]), int(bucket[i])
                if key != now:
                    if held:
                        yield from out()
                    now, held, size, piece, done = key, [], 0, 0, 0
                elif size > most:
                    yield from out()
                    done += sum(x.num_rows for x in held)
                    held, size, piece = [], 0, piece + 1
                held.append(batch.slice(i, j - i))
                size += held[-1].nbytes
        if held:
            yield from out()

    return run


def sharded(docs: DataFrame, scratch: Scratch, shards: int = SHARDS, bucket_bytes: int = BUCKET, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """Writes the rows in shuffled order to one folder per shard and returns them reread, with shard, bucket
    and slot (gapless from 0 in the shard: the row's place in its order). docs has id_col and text; other
    columns go along, those called shard, bucket, before or slot under that name and an underscore.

    Pass one scatters the rows by seeded hashes into so many buckets a shard that each has about
    bucket_bytes, pass two shuffles each bucket in memory and writes it. A bucket's slots start after
    those of the buckets before, counted ahead from the ids alone. Rows of equal id go to one bucket,
    in the order of their texts before the shuffle; null ids are one such id; null texts have no bytes.
    A text is never cut; one longer than bucket_bytes makes its bucket larger. An empty table gives none. The result is the same however tasks are dealt or repeated."""
    spark = scratch.spark
    docs = cleared(docs, "shard", "bucket", "before", "slot")
    total = docs.agg(F.sum(row_size(F.col("text")))).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    key = F.col(id_col)
    place = {"shard": shard_of(key, shards, seed), "bucket": F.pmod(F.xxhash64(F.lit(seed + 1), key), F.lit(buckets))}
    sizes = docs.select(id_col).withColumns(place).groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = scratch.keep(sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before")), "sizes")
    rows = docs.withColumns(place).join(sizes, ["shard", "bucket"])
    dealt = rows.repartition(min(TASKS, shards * buckets), "shard", "bucket").sortWithinPartitions("shard", "bucket", id_col, F.xxhash64("text"), "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "before")
    out = dealt.mapInArrow(_shuffled(seed, 8 * bucket_bytes), f"{fields}, slot long")
    out.write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(scratch.path("shards"))
    release(spark)
    return spark.read.schema(out.schema).parquet(scratch.path("shards"))

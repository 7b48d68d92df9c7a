"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weftline.llm.common import Forest, Scratch, dense_forest

#: Edges whose components one task finds at once.
WHOLE = 1 << 19


def _forests(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    forest = Forest()
    for part in parts:
        for a, b in zip(part["a"].tolist(), part["b"].tolist(), strict=True):
            forest.join(a, b)
        if len(forest.up) > 500_000:
            yield pd.DataFrame(forest.edges(), columns=["a", "b"])
            forest = Forest()
    if forest.up:
        yield pd.DataFrame(forest.edges(), columns=["a", "b"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges -> (node, root)."""
    parts = [np.stack([x.column(i).to_numpy() for i in (0, 1)]) for x in batches]
    if not parts:
        return
    nodes, ends = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    a, b = ends.reshape(2, -1)
    yield pa.record_batch({"node": nodes, "root": nodes[dense_forest(len(nodes), a, b)]})


def _stars(now: DataFrame) -> DataFrame:
    """A large-star step, which hangs the larger neighbours of each node on its smallest one, and a small-star step for
    the smaller ones; minima are partially aggregated before the shuffle and joined back, so that AQE can
    split a node of very many edges. moved: whether an edge was hung anew."""
    both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") < F.col("u")).alias("moved"))
    least = large.groupBy("u").agg(F.min("v").alias("m"), F.bool_or("moved").alias("moved"))
    rest = large.join(least.select("u", "m"), "u").filter("v > m")
    return least.select(F.col("u").alias("a"), F.col("m").alias("b"), "moved").union(rest.select("v", "m", F.lit(True)))


def components(edges: DataFrame, scratch: Scratch, name: str = "edges", most_rounds: int = 60, rounds: int | None = None, whole: int = WHOLE) -> DataFrame:
    """Edges (a, b) of type long -> one row (node, root) per node that has an edge to another; root is the smallest
    node of its component. Null ends must not occur; loops and repeated edges don't count.

    Each task first replaces its edges by a spanning forest (in runs of bounded size). Where at most `whole`
    edges are left, one task finds their components, as rounds would write hundreds of files of a few
    edges each. Else large-star and small-star steps alternate; each round is a table in the shared
    folder, and it ends with one that moves nothing. With `rounds`, it ends after so many: nodes of equal
    root then are in one component, but not the other way round."""
    now = scratch.keep(edges.select("a", "b").mapInPandas(_forests, "a long, b long"), f"{name}-0")
    if now.count() <= whole:
        found = scratch.keep(now.coalesce(1).mapInArrow(_whole, "node long, root long"), f"{name}-whole")
        scratch.drop(f"{name}-0")
        return found
    for i in range(1, (rounds or most_rounds) + 1):
        seen = Observation()
        now = scratch.keep(_stars(now).observe(seen, F.max(F.col("moved").cast("int")).alias("moved")), f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        if not seen.get["moved"]:
            break
    else:
        if not rounds:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        now = now.groupBy("a").agg(F.min("b").alias("b"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b").distinct().select("b", "b"))

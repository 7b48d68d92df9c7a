"""Embedding near-duplicates by an exact metric range join within labels."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, dense_forest
from weftline.llm.components import components

COSINE = 0.98
#: Vectors of a cell, about, and of a block of a large cell that meets the others in a task of its own.
CELL = 2000
BLOCK = 2000
#: Pivots of all labels together: what the broadcast has at most. Beyond it cells grow, and are cut in blocks.
PIVOTS = 2048
#: Compared pairs that are held at once.
_PAIRS = 1 << 22
#: Distances to pivots that are held at once.
_DISTANCES = 1 << 20
#: Rounding slack of the bounds, so that they never exclude a pair that the comparison links.
_SLACK = 1e-9


def _matrix(column) -> np.ndarray:
    """An Arrow list column of equally long lists as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of very large or small components are lost
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that may link: label not null, vector not null, not empty, without null, infinite or nan
    components, not zero."""
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return vectors.filter(F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0))


def _bounded(label: np.ndarray, dim: np.ndarray, pivots: dict) -> Iterator[tuple[tuple, np.ndarray]]:
    """(label and dimension, rows of it), of so many rows that their distances to all its pivots stay a bounded matrix."""
    for key in {*zip(label.tolist(), dim.tolist(), strict=True)}:
        at = np.flatnonzero((label == key[0]) & (dim == key[1]))
        step = max(1, _DISTANCES // max(len(pivots.get(key, ())), key[1], 1))
        for i in range(0, len(at), step):
            yield key, at[i : i + step]


def near_pairs(classes: DataFrame, scratch: Scratch, cosine: float = COSINE, cell: int = CELL, block: int = BLOCK, most_pivots: int = PIVOTS) -> DataFrame:
    """Distinct usable vectors (id, label, vector, n: rows that have it) -> rows (a, b, times): for each vector a
    of some cell, how many rows of other vectors it is linked with there (b null), and edges a-b (times null)
    that span the components of the cell's links.

    Vectors of a label and dimension are parted by their nearest pivot on the unit sphere, where cosine c is
    the distance sqrt(2 - 2c). A pair within radius r of each other that has different nearest pivots p
    and q lies within r of the plane between p and q, by the triangle inequality in the plane's normal
    direction; so each vector is copied to the cells of higher number whose plane is that near, and every
    pair meets in exactly one cell. Within a cell, vectors whose distances to its pivot differ by more than
    r are not compared. Cells join independently; a large one is cut into blocks, each with a task of its own.

    Pivots are existing vectors, drawn by hash, in number bounded by most_pivots; more (label,
    dimension) groups than that share no pivots and are one cell each."""
    radius = math.sqrt(2 - 2 * cosine)
    keyed = classes.withColumn("dim", F.size("vector"))
    keyed = scratch.keep(keyed.withColumn("draw", F.xxhash64(F.lit(3), "vector")), "classes")
    groups = keyed.groupBy("label", "dim").agg(F.count("*").alias("m"))
    total = keyed.count()
    per = max(cell, -(-total // most_pivots) * 2)
    wanted = F.floor(F.col("m") / per)
    chosen = keyed.join(groups.filter(wanted > 1).select("label", "dim", "m"), ["label", "dim"])
    # about 4 candidates a pivot are drawn, and the first of them by hash taken
    likely = chosen.filter(F.pmod("draw", F.lit(1 << 30)) < F.lit(float(1 << 32)) * wanted / F.col("m"))
    pivots: dict[tuple[int, int], list[np.ndarray]] = {}
    for r in likely.select("label", "dim", "vector", "draw", wanted.alias("want")).orderBy(F.pmod("draw", F.lit(1 << 30)), "draw").limit(4 * most_pivots).collect():
        own = pivots.setdefault((r.label, r.dim), [])
        if len(own) < r.want:
            own.append(np.array(r.vector, np.float64))
    pivots = {k: _unit(np.array(v)) for k, v in pivots.items()}
    shared = scratch.spark.sparkContext.broadcast(pivots)

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector at home (visits 0) in its nearest pivot's cell and, as a visitor, in each cell of higher number that may hold a partner."""
        for batch in batches:
            label, dim = batch.column("label").to_numpy(zero_copy_only=False), batch.column("dim").to_numpy()
            for key, at in _bounded(label, dim, shared.value):
                rows = batch.take(pa.array(at))
                x = _unit(_matrix(rows.column("vector")))
                p = shared.value.get(key)
                if p is None:
                    home, gaps = np.zeros(len(at), np.int64), np.zeros(len(at))
                    visits = np.zeros((0, 2), np.int64)
                else:
                    near = x @ p.T
                    home = near.argmax(axis=1)
                    gaps = np.sqrt(np.maximum(0, 2 - 2 * near))
                    between = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))[home]
                    ahead = near[np.arange(len(x)), home][:, None] - near  # over between: distance to the plane
                    visits = np.argwhere(((ahead <= (radius + _SLACK) * between) | (between < 1e-6)) & (np.arange(len(p)) > home[:, None]))
                for place, cells, visiting in ((np.arange(len(at)), home, 0), (visits[:, 0], visits[:, 1], 1)):
                    took = rows.take(pa.array(place))
                    gap = gaps[place, cells] if p is not None else gaps[place]
                    cols = {c: took.column(c) for c in ("label", "dim", "id", "n", "vector")}
                    yield pa.RecordBatch.from_pydict(cols | {"cell": pa.array(cells, pa.int64()), "visits": pa.array(np.full(len(place), visiting), pa.int8()), "gap": pa.array(gap, pa.float64())})

    label = keyed.schema["label"].dataType.simpleString()
    kinds = f"label {label}, dim int, id long, n long, vector {keyed.schema['vector'].dataType.simpleString()}, cell long, visits byte, gap double"
    placed = scratch.keep(keyed.mapInArrow(celled, kinds), "cells")
    homes = placed.filter("visits = 0").groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / block).alias("blocks"))
    parted = placed.join(homes, ["label", "dim", "cell"])
    own = F.pmod(F.xxhash64(F.lit(5), "id"), F.col("blocks"))
    at_home = parted.filter("visits = 0").withColumn("block", own)
    first = F.when(F.col("visits") == 0, own + 1).otherwise(F.lit(0).cast("long"))
    guests = parted.withColumn("first", first).filter("first < blocks").withColumn("block", F.explode(F.sequence("first", F.col("blocks") - 1))).withColumn("visits", F.lit(1).cast("byte")).drop("first")
    dealt = at_home.unionByName(guests).repartition("label", "dim", "cell", "block").sortWithinPartitions("label", "dim", "cell", "block", "visits")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, home, guests, held = None, [], [], 0
        met = [False]

        def stack(rows):
            x = _unit(np.concatenate([_matrix(r.column("vector")) for r in rows]))
            return x, *(np.concatenate([r.column(c).to_numpy() for r in rows]) for c in ("id", "n", "gap"))

        def links():
            x, ids, n, gap = stack(home)
            order = np.argsort(gap, kind="stable")
            x, ids, n, gap = x[order], ids[order], n[order], gap[order]
            count = np.zeros(len(x), np.int64)
            sides = [] if met[0] else [(x, ids, n, gap, True)]
            met[0] = True
            sides += [(*stack(guests), False)] if guests else []
            for y, ids_y, n_y, gap_y, same in sides:
                count_y, ends = np.zeros(len(y), np.int64), []
                step = max(1, _PAIRS // len(x))
                by = np.argsort(gap_y, kind="stable")
                for i in range(0, len(y), step):
                    at = by[i : i + step]
                    low = np.searchsorted(gap, gap_y[at[0]] - radius - _SLACK)
                    high = np.searchsorted(gap, gap_y[at[-1]] + radius + _SLACK, "right")
                    linked = y[at] @ x[low:high].T >= cosine
                    p, q = np.nonzero(linked)
                    p, q = at[p], q + low
                    if same:
                        p, q = p[p < q], q[p < q]
                    np.add.at(count, q, n_y[p])
                    np.add.at(count if same else count_y, p, n[q])
                    ends.append((p, q))
                p, q = (np.concatenate(e) for e in zip(*ends, strict=True))
                if same:
                    root = dense_forest(len(x), p, q)
                    a, b = ids[root], ids
                else:
                    root = dense_forest(len(x) + len(y), len(x) + p, q)
                    both = np.concatenate([ids, ids_y])
                    a, b = both[root], both
                    some = np.flatnonzero(count_y)
                    yield pa.record_batch({"a": ids_y[some], "b": pa.nulls(len(some), pa.int64()), "times": count_y[some]})
                edge = np.flatnonzero(a != b)
                yield pa.record_batch({"a": a[edge], "b": pa.array(b[edge]), "times": pa.nulls(len(edge), pa.int64())})
            some = np.flatnonzero(count)
            yield pa.record_batch({"a": ids[some], "b": pa.nulls(len(some), pa.int64()), "times": count[some]})

        for batch in batches:
            key_cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "dim", "cell", "block", "visits")]
            change = np.zeros(max(0, batch.num_rows - 1), bool)
            for c in key_cols:
                change |= c[1:] != c[:-1]
            edges = (np.flatnonzero(change) + 1).tolist()
            for i, j in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if i == j:
                    continue
                key = tuple(c[i] for c in key_cols[:4])
                if key != now:
                    if home:
                        yield from links()
                    now, home, guests, held, met[0] = key, [], [], 0, False
                if key_cols[4][i] == 0:
                    home.append(batch.slice(i, j - i))
                elif home:
                    guests.append(batch.slice(i, j - i))
                    held += j - i
                    if held > 50_000:  # guests may be many: they are met in turns
                        yield from links()
                        guests, held = [], 0
        if home:
            yield from links()

    return dealt.select("label", "dim", "cell", "block", "visits", "gap", "id", "n", "vector").mapInArrow(compared, "a long, b long, times long")


def near_duplicates(embeddings: DataFrame, scratch: Scratch, cosine: float = COSINE, **options: int) -> DataFrame:
    """One row per vector: vec_id, n_links (other rows linked directly), component_id (smallest vec_id
    reachable by links), kept (it is its own). All pairs of equal, not null label and at least that
    cosine in double precision are links.

    Equal vectors of a label are one class whose rows are all linked with each other. Vectors that are
    null, empty, zero, or have null or not finite components, rows of null label, and vectors of
    different lengths link with nothing. Rows of equal vec_id count as rows of their own; a null vec_id
    is never the smallest: where a component has no other, component_id and kept are null."""
    rows = embeddings.select("vec_id", "label", F.col("embedding").alias("vector"))
    rows = scratch.keep(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    fine = usable(rows)
    classes = fine.groupBy("label", "vector").agg(F.min("row").alias("id"), F.count("*").alias("n"), F.min("vec_id").alias("rep"))
    classes = scratch.keep(classes, "vectors")
    pairs = scratch.keep(near_pairs(classes.select("id", "label", "vector", "n"), scratch, cosine, **options), "pairs")
    roots = components(pairs.filter("b is not null").select("a", "b"), scratch)
    counts = pairs.filter("b is null").groupBy("a").agg(F.sum("times").alias("others"))
    told = classes.join(roots, F.col("id") == F.col("node"), "left").join(counts, F.col("id") == F.col("a"), "left")
    told = told.select("label", "vector", "rep", F.coalesce("root", "id").alias("root"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    told = scratch.keep(told, "told")
    smallest = told.groupBy("root").agg(F.min("rep").alias("component"))
    told = told.join(smallest, "root").select("label", "vector", "n_links", "component").withColumnsRenamed({"label": "l", "vector": "v"})
    linked = fine.join(told, (F.col("label") == F.col("l")) & (F.col("vector") == F.col("v"))).select("vec_id", "row", "n_links", F.col("component").alias("component_id"))
    alone = rows.join(fine.select("row"), "row", "left_anti").select("vec_id", "row", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select("vec_id", "n_links", F.col("component_id").cast("long").alias("component_id"), (F.col("vec_id") == F.col("component_id")).alias("kept"))

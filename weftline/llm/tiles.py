"""Tiled comparison of points: every pair of tiles whose signatures may hold a pair meets in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import slices

#: Copies that a task makes at once, and visitors that meet a tile at once.
_COPIES = 1 << 16
_TASKS = 20_000

Columns = dict[str, np.ndarray]


def signature_sizes(points: DataFrame) -> dict[int, int]:
    """Points of each signature, a bounded number of which there must be."""
    return {r.sig: r.n for r in points.groupBy("sig").agg(F.count("*").alias("n")).collect()}


def tiled(points: DataFrame, sizes: dict[int, int], steps: Callable[[np.ndarray], Iterator[np.ndarray]], links: Callable[[Columns, Columns | None], Iterator[pa.RecordBatch]], schema: str, tile: int) -> DataFrame:
    """Points (columns of longs, among them sig: a signature, and spot: any hash) -> what links() gives.

    links(x, None) sees the points of a tile, links(x, y) those of two different tiles, or of a part of the
    second; each pair of tiles of one signature, and of signatures that steps() leads to, is seen once.
    steps() gives arrays of target signatures for an array of them, -1 where there is none, one of each
    opposite pair. All other tile pairs are skipped.

    A signature with more points than a tile holds is cut into several tiles, each of which has a task of
    its own. sizes are those of signature_sizes()."""
    keys = np.array(sorted(sizes), np.int64)
    tiles = np.array([-(-sizes[k] // tile) for k in keys.tolist()], np.int64)
    names = points.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """visits 0: in its own tile; 1: a visitor there."""

        def rows(part, at, group, block, visits):
            took = part.take(pa.array(at))
            own = {c: took.column(c) for c in names} | {"sig": pa.array(group)}
            return pa.RecordBatch.from_pydict(own | {"tile": pa.array(block), "visits": pa.array(np.full(len(at), visits, np.int8))})

        def spread(part, at, group, first, last):
            """Visitors in tiles first..last-1 of the group."""
            n = np.maximum(last - first, 0)
            ends = np.concatenate([[0], np.cumsum(n)])
            for i, j in slices(ends, _COPIES):
                of = np.repeat(np.arange(i, j), n[i:j])
                yield rows(part, at[of], group[of], first[of] + np.arange(len(of)) - (ends[of] - ends[i]), 1)

        for batch in batches:
            sig, spot = batch.column("sig").to_numpy(), batch.column("spot").to_numpy()
            every = np.arange(len(sig))
            n = tiles[np.searchsorted(keys, sig)]
            own = (spot.view(np.uint64) % n.astype(np.uint64)).astype(np.int64)
            yield rows(batch, every, sig, own, 0)
            yield from spread(batch, every, sig, own + 1, n)
            for to in steps(sig):
                at = np.minimum(np.searchsorted(keys, to), len(keys) - 1)
                some = np.flatnonzero(keys[at] == to)
                if len(some):
                    yield from spread(batch, some, to[some], np.zeros(len(some), np.int64), tiles[at[some]])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, home, guests, held, fresh = None, [], [], 0, True

        def columns(parts) -> Columns:
            return {c: np.concatenate([p.column(c).to_numpy() for p in parts]) for c in names}

        def met():
            own = columns(home)
            if fresh:
                yield from links(own, None)
            if guests:
                yield from links(own, columns(guests))

        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("sig", "tile", "visits")]
            edges = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if i == j:
                    continue
                key = (cols[0][i], cols[1][i])
                if key != now:
                    if home:
                        yield from met()
                    now, home, guests, held, fresh = key, [], [], 0, True
                if not cols[2][i]:
                    home.append(batch.slice(i, j - i))
                elif home:
                    guests.append(batch.slice(i, j - i))
                    held += j - i
                    if held > _COPIES:  # visitors may be many: they are met in turns
                        yield from met()
                        guests, held, fresh = [], 0, False
        if home and (fresh or guests):
            yield from met()

    tasks = min(_TASKS, 1 + sum(sizes.values()) // 2048)  # little data, much work: the number is not left to sizes in bytes
    dealt = points.mapInArrow(placed, f"{kinds}, tile long, visits byte").repartition(tasks, "sig", "tile").sortWithinPartitions("sig", "tile", "visits")
    return dealt.mapInArrow(compared, schema)

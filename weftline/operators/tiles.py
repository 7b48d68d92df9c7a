"""Candidate pairs by shared tokens, tile by tile.

blocking.token_join() writes a row for each token that a looked-up source and a target share, to count them by pair. Where
those are many times the pairs that are found, they are counted here in memory instead: both sides are cut into tiles, each
tile of sources meets each tile of targets in one task, and only the pairs found leave it. The tiles are written once, as
one row each, and read again for each meeting; nothing else is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import kept

#: Rows of a tile.
TILE = 100_000
#: What testing a candidate costs, in postings read.
TEST = 20
#: Flags of tokens that a batch of sources holds, and candidates that are tested at once.
FLAGS, TESTED = 1 << 22, 1 << 16


def tiled_join(source: DataFrame, target: DataFrame, tokens: tuple[Column, Column], least: float) -> DataFrame:
    """blocking.token_join() with the names: source (src, s_name), target (tgt, t_name) and the distinct tokens of each ->
    (src, s_name, tgt, t_name, hits, score). Exact; memory is that of two tiles."""
    s, t = _tiles(source.select("src", "s_name"), tokens[0], "s"), _tiles(target.select("tgt", "t_name"), tokens[1], "t")
    ids = {x: frame.schema[x].dataType.simpleString() for frame, x in ((source, "src"), (target, "tgt"))}
    schema = f"src {ids['src']}, s_name string, tgt {ids['tgt']}, t_name string, hits bigint, score double"

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("s"), batch.column("t"), strict=True):
                yield from _pairs(_Tile(a.as_buffer()), _Tile(b.as_buffer()), least)

    return s.crossJoin(t.hint("shuffle_replicate_nl")).mapInArrow(meet, schema)


def _tiles(rows: DataFrame, tokens: Column, name: str) -> DataFrame:
    """The rows (id, name) with their tokens as tiles, one binary value each."""
    id_, label = rows.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        if own:
            tile = pa.Table.from_batches(own).combine_chunks()
            found = tile.column("tokens").chunk(0)
            coded = found.flatten().dictionary_encode()
            columns = {"id": tile.column(id_).chunk(0), "name": tile.column(label).chunk(0), "n": pc.fill_null(pc.list_value_length(found), 0), "token": coded.dictionary, "code": coded.indices}
            one = pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns.values()], list(columns))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, one.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(one)
            yield pa.record_batch([pa.array([sink.getvalue().to_pybytes()], pa.binary())], [name])

    dealt = rows.repartition(max(1, -(-rows.count() // TILE))).withColumn("tokens", tokens)
    return kept(dealt.mapInArrow(pack, f"{name} binary"), "tiles")


class _Tile:
    """A tile read again: ids, names, distinct tokens, and of each row the codes of its tokens (code[start:start + n])."""

    def __init__(self, value: pa.Buffer):
        one = pa.ipc.open_stream(value).read_next_batch()
        self.id, self.name, n, self.token, code = (one.column(c).flatten() for c in ("id", "name", "n", "token", "code"))
        self.n, self.code = n.to_numpy().astype(np.int64), code.to_numpy().astype(np.int64)
        self.start = np.cumsum(self.n) - self.n


def _pairs(s: _Tile, t: _Tile, least: float) -> Iterator[pa.RecordBatch]:
    """Of n tokens that must share m, at least k are among the rarest n - m + k: those are looked up, k chosen for each
    source by what reading their postings and testing the rows with k of them will cost."""
    # sources' tokens by the targets' codes, rarest first, -1 those that no target has
    kinds, rows = len(t.token), len(t.n)
    frequency = np.append(np.bincount(t.code, minlength=kinds), 0)  # the last is that of -1
    code = pc.fill_null(pc.index_in(s.token, value_set=t.token), -1).to_numpy().astype(np.int64)[s.code]
    code = code[np.lexsort((code, frequency[code], np.repeat(np.arange(len(s.n)), s.n)))]
    posting, first = np.repeat(np.arange(rows, dtype=np.int32), t.n)[np.argsort(t.code, kind="stable")], np.cumsum(frequency) - frequency

    needed = np.maximum(1, np.ceil(s.n * least - 1e-9).astype(np.int64))
    read = np.append(0, np.cumsum(frequency[code]))
    cost, most = np.full((3, len(s.n)), np.inf), np.zeros((3, len(s.n)), np.int64)
    for k in (1, 2, 3):
        fits = (s.n >= needed) & (k <= needed)
        most[k - 1] = np.where(fits, s.n - needed + k, 0)
        postings = (read[s.start + most[k - 1]] - read[s.start]).astype(float)
        cost[k - 1] = np.where(fits, postings + TEST * postings**k / (float(rows) ** (k - 1) * (1, 2, 6)[k - 1]), np.inf)
    chosen = np.argmin(cost, axis=0)
    looked, asked = most[chosen, np.arange(len(s.n))], np.flatnonzero(np.isfinite(cost.min(axis=0)) & (cost.min(axis=0) > 0))

    batch, size, each = [], 0, max(1, FLAGS // (kinds + 1))
    for i in asked.tolist():
        a, k = s.start[i], chosen[i] + 1
        own = code[a : a + looked[i]]
        own = own[np.searchsorted(own >= 0, True) :]
        lists = [posting[p:q] for p, q in zip(first[own].tolist(), (first[own] + frequency[own]).tolist(), strict=True)]
        hits = np.concatenate(lists) if lists else posting[:0]
        if len(hits) < k:
            continue
        hits.sort()
        found = hits[k - 1 :][hits[k - 1 :] == hits[: len(hits) - k + 1]]
        if not len(found):
            continue
        found = found[np.append(True, found[1:] != found[:-1])]
        batch.append((i, found))
        size += len(found)
        if size >= TESTED or len(batch) >= each:
            yield from _tested(s, t, code, batch, least)
            batch, size = [], 0
    yield from _tested(s, t, code, batch, least)


def _tested(s: _Tile, t: _Tile, code: np.ndarray, batch: list[tuple[int, np.ndarray]], least: float) -> Iterator[pa.RecordBatch]:
    """Of candidates, those that share enough of all their tokens."""
    if not batch:
        return
    has = np.zeros((len(batch), len(t.token) + 1), bool)
    for j, (i, _) in enumerate(batch):
        has[j, code[s.start[i] : s.start[i] + s.n[i]]] = True
    has[:, -1] = False  # tokens that no target has
    which, found = np.repeat(np.arange(len(batch)), [len(f) for _, f in batch]), np.concatenate([f for _, f in batch])
    for at in range(0, len(found), TESTED):
        j, row = which[at : at + TESTED], found[at : at + TESTED]
        n = t.n[row]
        ends = np.cumsum(n)
        places = np.arange(ends[-1]) + np.repeat(t.start[row] - ends + n, n)
        hits = np.add.reduceat(has[np.repeat(j, n), t.code[places]].astype(np.int64), ends - n)
        src = np.array([i for i, _ in batch])[j]
        score = hits / s.n[src]
        good = score >= least - 1e-9
        if good.any():
            a, b = pa.array(src[good]), pa.array(row[good])
            yield pa.record_batch([s.id.take(a), s.name.take(a), t.id.take(b), t.name.take(b), pa.array(hits[good]), pa.array(score[good])], ["src", "s_name", "tgt", "t_name", "hits", "score"])

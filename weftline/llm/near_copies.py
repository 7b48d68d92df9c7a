"""Near copies by SimHash: wide fingerprints of 5-word shingles, compared in tiles, and confirmed on whole sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import U64, Rolling, Scratch, fresh, mixed, slices, utf8, word_hashes
from weftline.llm.components import components
from weftline.llm.tiles import signature_sizes, tiled

WORDS = 5
#: Least Jaccard similarity of a link, as a fraction.
SIMILAR = (4, 5)
SEED = 42
#: Bits of a fingerprint, and those in which candidates may differ. Sets of Jaccard 0.8 have an angle of arccos(8/9),
#: so that 19.4 of 128 bits differ, with a deviation of 4.1: over 36 do once in 50,000 such pairs.
BITS = 128
RADIUS = 36
TILE = 8192
#: 64-bit numbers of a parity sketch.
SKETCH = 8
_PIECE = 1 << 19
_PAIRS = 1 << 17

#: Bytes to themselves (A-Z lowered), ASCII white space to a blank.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else 32 if c == 32 or 9 <= c <= 13 else c for c in range(256)], np.uint8)


def shingle_sets(array, rolling: Rolling | None = None) -> Iterator[np.ndarray]:
    """The set of 5-word shingles of each whole text of an Arrow array, as ascending 64-bit hashes. Words are split
    at ASCII white space, A-Z lowered; a text of one to four words is one shingle; null, empty and blank texts
    have none."""
    rolling = rolling or Rolling(1)
    offsets, data = utf8(array)
    for i, j in slices(offsets, _PIECE):
        own = offsets[i : j + 1] - offsets[i]
        raw = np.full(int(own[-1]) + j - i, 32, np.uint8)  # a blank after each text
        raw[np.arange(int(own[-1])) + np.repeat(np.arange(j - i), np.diff(own))] = _FOLD[data[offsets[i] : offsets[j]]]
        starts, _, hashes = word_hashes(raw, rolling, _PIECE)
        first = np.searchsorted(starts, own + np.arange(j - i + 1))
        sums = np.zeros(max(0, len(hashes)), U64)
        for k in range(WORDS):  # of each word and the four after it
            sums[: max(0, len(hashes) - k)] += hashes[k:] * rolling_power(WORDS - 1 - k)
        sums = mixed(sums)
        for a, b in pairwise(first.tolist()):
            if b - a >= WORDS:
                yield np.unique(sums[a : b - WORDS + 1])
            elif b > a:
                few = sum((int(h) * int(rolling_power(k + WORDS)) for k, h in enumerate(hashes[a:b])), 0)
                yield mixed(np.array([few % (1 << 64)], U64))
            else:
                yield np.zeros(0, U64)


def rolling_power(k: int) -> np.uint64:
    return U64(pow(Rolling.BASE, k, 1 << 64))


def set_key(found: np.ndarray) -> int:
    """A set of shingles as one signed 64-bit number."""
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63)


def fingerprint(found: np.ndarray) -> np.ndarray:
    """128-bit SimHash of a set: a bit is 1 if over half of the members' hashes have it."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(found), 1 << 16):
        x = found[i : i + (1 << 16)]
        wide = np.stack([x, mixed(x * U64(Rolling.BASE) + U64(SEED))], axis=1)
        ones += np.unpackbits(wide.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(found)).view(np.int64)


def sketch(found: np.ndarray) -> np.ndarray:
    """Whether each of 64 * SKETCH buckets has an odd number of the shingles. Two sets differ in at least as
    many shingles as their sketches in bits."""
    odd = np.bincount((found % U64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of two ascending sets of at least SIMILAR."""
    over, under = SIMILAR
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return under * common >= over * (len(both) - common)


_SKETCH = [f"s{i}" for i in range(SKETCH)]
_PRINT = ["f0", "f1"]


def _digests(id_type: str):
    """Rows (doc_id, th, text) -> their ids, key of the shingle set, its size, fingerprint and sketch."""
    schema = f"doc_id {id_type}, th long, key long, n long, " + ", ".join(f"{c} long" for c in [*_PRINT, *_SKETCH])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(2 * _PIECE)
        for batch in batches:
            rows = [(set_key(x), len(x), *fingerprint(x), *sketch(x)) for x in shingle_sets(batch.column("text"), rolling)]
            cols = np.array(rows, np.int64).reshape(-1, 2 + len(_PRINT) + SKETCH)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "th": batch.column("th")} | {c: pa.array(cols[:, i]) for i, c in enumerate(["key", "n", *_PRINT, *_SKETCH])})

    return run, schema


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds spot and sig: the size of the set on a scale that similar sets differ by one step on, and the
    fingerprint's population count on one of steps beyond the radius."""
    over, under = SIMILAR
    for batch in batches:
        size = np.floor(np.log(np.maximum(1, batch.column("n").to_numpy())) / math.log(under / over + 1e-9)).astype(np.int64)
        ones = sum(np.bitwise_count(batch.column(c).to_numpy().view(U64)).astype(np.int64) for c in _PRINT)
        yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in batch.schema.names} | {"spot": batch.column("key"), "sig": pa.array(size * 8 + ones // (RADIUS + 1))})


def _neighbours(sig: np.ndarray) -> Iterator[np.ndarray]:
    for size, ones in ((0, 1), (1, -1), (1, 0), (1, 1)):
        to = sig % 8 + ones
        yield np.where((to >= 0) & (to < 8), sig + 8 * size + ones, -1)


def _candidates(nearest: bool):
    """Pairs of two tiles whose fingerprints are near, whose sizes and sketches allow the similarity, and whose roots
    differ: of each row the nearest only, or all."""
    over, under = SIMILAR

    def links(x, y):
        z = x if y is None else y
        prints = [(x[c].view(U64), z[c].view(U64)) for c in _PRINT]
        bits = [np.stack([t[c] for c in _SKETCH], axis=1).view(U64) for t in (x, z)]
        best = np.full((2, max(len(x["key"]), len(z["key"]))), np.iinfo(np.int64).max)
        step = max(1, _PAIRS // len(z["key"]))
        for i in range(0, len(x["key"]), step):
            far = sum(np.bitwise_count(f[i : i + step, None] ^ g[None, :]) for f, g in prints)
            a, b = np.nonzero(far <= RADIUS)
            far = far[a, b].astype(np.int64)
            a = a + i
            n_a, n_b = x["n"][a], z["n"][b]
            fits = (under * np.minimum(n_a, n_b) >= over * np.maximum(n_a, n_b)) & (x["root"][a] != z["root"][b])
            if y is None:
                fits &= a < b
            a, b, far = a[fits], b[fits], far[fits]
            # similar sets differ in at most (under - over) / (under + over) of both
            differ = np.bitwise_count(bits[0][a] ^ bits[1][b]).sum(axis=1, dtype=np.int64)
            fits = differ * (over + under) <= (x["n"][a] + z["n"][b]) * (under - over)
            a, b, far = a[fits], b[fits], far[fits]
            if nearest:
                np.minimum.at(best[0], a, far << 40 | b)
                np.minimum.at(best[1], b, far << 40 | a)
            elif len(a):
                yield pa.record_batch({"a": x["key"][a], "b": z["key"][b]})
        if nearest:
            low = (1 << 40) - 1
            for own, (f, g) in zip(best, ((x, z), (z, x)), strict=True):
                at = np.flatnonzero(own != np.iinfo(np.int64).max)
                yield pa.record_batch({"a": f["key"][at], "b": g["key"][own[at] & low]})

    return links


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rolling = Rolling(2 * _PIECE)
    known = lru_cache(64)(lambda text: next(shingle_sets(pa.array([text], pa.large_string()), rolling)))
    for batch in batches:
        texts = zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True)
        yield batch.select(["a", "b"]).filter(pa.array([alike(known(a), known(b)) for a, b in texts], pa.bool_()))


def similar_links(docs: DataFrame, classes: DataFrame, scratch: Scratch, tile: int = TILE) -> DataFrame:
    """Texts (th, text), any number of rows each, and their distinct sets (key, th, n, fingerprint, sketch) -> edges
    (a, b) between keys, which span the components of the graph of all pairs of Jaccard >= 0.8.

    All pairs of tiles whose set sizes and population counts can hold such a pair are compared by exclusive-or
    and bit count. In a first round each set is linked with its nearest in each tile that it meets; the
    second round gives all candidates whose sets the first has not joined, so that a group of copies
    never gives all its pairs. Each candidate is confirmed on the whole texts' sets."""

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        ends = scratch.keep(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-pairs")
        met = ends.select(F.col("a").alias("key")).union(ends.select("b")).distinct().join(classes.select("key", "th"), "key")
        texts = docs.join(met.select(F.col("th").alias("met"), "key"), F.col("th") == F.col("met")).groupBy("key").agg(F.first("text").alias("text"))
        texts = scratch.keep(texts, f"{name}-texts")
        for side in "ab":
            ends = ends.join(texts.select(F.col("key").alias(side), F.col("text").alias(f"text_{side}")), side)
        return scratch.keep(ends.select("a", "b", "text_a", "text_b").mapInArrow(_confirmed, "a long, b long"), f"{name}-links")

    own = classes.select("key", "n", *_PRINT, *_SKETCH)
    kinds = "key long, n long, " + ", ".join(f"{c} long" for c in [*_PRINT, *_SKETCH]) + ", root long, spot long, sig long"
    points = scratch.keep(own.withColumn("root", F.col("key")).mapInArrow(_signed, kinds), "points")
    sizes = signature_sizes(points)
    first = confirmed(tiled(points, sizes, _neighbours, _candidates(True), "a long, b long", tile), "first")
    joined = scratch.keep(components(first, scratch, "chained", rounds=2).groupBy("node").agg(F.min("root").alias("to")), "joined")
    rooted = points.join(joined, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("to", "root")).select(*points.columns)
    second = confirmed(tiled(rooted, sizes, _neighbours, _candidates(False), "a long, b long", tile), "second")
    return joined.select(F.col("node").alias("a"), F.col("to").alias("b")).union(second)


def keep_one(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """One row of each component of near copies (5-word shingles of Jaccard >= 0.8): that of the smallest id, of equal
    ids that of the smallest text hash, of equal texts that of the smallest row written as JSON.

    Texts without words are copies of each other. Rows without an id stay only where no row of their
    component has one. Rows of equal ids and unlike texts are told apart. An empty table stays empty;
    all columns stay as they are."""
    hash_ = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    slim = docs.select(F.col(id_col).alias("doc_id"), hash_.alias("th"), F.col(text).alias("text"))
    run, schema = _digests(slim.schema["doc_id"].dataType.simpleString())
    rows = scratch.keep(slim.mapInArrow(run, schema), "digests")
    low = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("low")
    classes = rows.groupBy("key").agg(low, F.count("*").alias("times"), F.min("th").alias("th"), *[F.first(c).alias(c) for c in ["n", *_PRINT, *_SKETCH]])
    classes = scratch.keep(classes, "classes")
    roots = components(similar_links(slim.select("th", "text"), classes, scratch, tile), scratch)
    told = classes.join(roots, F.col("key") == F.col("node"), "left").filter("times > 1 or root is not null").select("key", F.coalesce("root", "key").alias("root"), "low")
    told = scratch.keep(told, "told")
    best = told.groupBy("root").agg(F.min("low").alias("best"))
    fate = rows.select("doc_id", "th", "key").join(told.join(best, "root").select("key", "best"), "key")
    chosen = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("th") == F.col("best.th"))
    fate = fate.groupBy("doc_id", "th").agg(F.bool_or(chosen).alias("stays"), F.count("*").alias("times"))
    fate = scratch.keep(fate.filter("times > 1 or not stays"), "fate")

    own, key, th, stays = (fresh(docs, x) for x in ("__th", "__id", "__key", "__stays"))
    hashed = docs.withColumn(own, hash_)
    same = F.col(id_col).eqNullSafe(F.col(key)) & (F.col(own) == F.col(th))
    fate = fate.select(F.col("doc_id").alias(key), F.col("th").alias(th), F.col("stays").alias(stays))
    columns = [f"`{c}`" for c in docs.columns]
    single = hashed.join(fate, same, "left_anti").select(*columns)
    whole = F.struct(*columns)
    several = hashed.join(fate.filter(F.col(stays)), same).groupBy(F.col(id_col).alias(key), own).agg(F.min_by(whole, F.to_json(whole)).alias(stays))
    return single.union(several.select(*[f"`{stays}`.{c}" for c in columns]))

"""SimHash near-duplicate detection by tiled exact comparison of fingerprints."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from weftline.llm.common import Scratch, dense_forest
from weftline.llm.components import components
from weftline.llm.tiles import signature_sizes, tiled

WORDS = 3
SEED = 42
RADIUS = 2
#: A fingerprint's population counts are taken over so many equal parts of its bits.
PARTS = 4
#: Fingerprints of one signature that meet in a task at once.
TILE = 4096
_PIECE = 1 << 20
#: Pairs that are compared at once.
_PAIRS = 1 << 17
#: Links of a tile that are held at once.
_LINKS = 1 << 19


def _set_bits(hashes: list[int]) -> np.ndarray:
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a whole text: words split at ASCII white space, A-Z lowered, 3-word shingles
    with repeats hashed by XXH64 (seed 42); a bit is 1 if over half of the hashes have it. A text of
    one or two words is one shingle; null, empty and blank texts have fingerprint 0. Read in pieces,
    so that memory does not grow with a text's shingles."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    hashed, ones, n, words, at = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, [], 0
    while at < len(data):
        end = at + _PIECE
        if end < len(data):  # move on to the end of a word
            while end < len(data) and not data[end : end + 1].isspace():
                end += 1
        words += data[at:end].split()
        at = end
        if len(words) >= WORDS:
            found = [hashed(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:], strict=False)]
            ones += _set_bits(found)
            n += len(found)
            words = words[-(WORDS - 1) :]
    if not n:
        if not words:
            return 0
        ones, n = _set_bits([hashed(b" ".join(words), SEED)]), 1
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


@F.pandas_udf(LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series(np.array([fingerprint(x) for x in part], np.uint64).view(np.int64))


def with_fingerprint(docs: DataFrame, text: str = "text", to: str = "fp") -> DataFrame:
    """Adds the fingerprint as a signed long."""
    return docs.withColumn(to, _fingerprints(F.col(text)))


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def signature(fps: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """Population counts of equal parts of each fingerprint as the digits of one number."""
    width = 64 // parts
    out = np.zeros(len(fps), np.int64)
    for i in range(parts):
        part = (fps.view(np.uint64) >> np.uint64(i * width)) & np.uint64((1 << width) - 1)
        out = out * (width + 1) + np.bitwise_count(part)
    return out


def _steps(radius: int, parts: int) -> list[tuple[int, ...]]:
    """Differences between signatures at most radius apart in sum, one of each opposite pair."""
    found = [x for x in itertools.product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, x)) <= radius]
    return [x for x in found if x > (0,) * parts]


def _close(radius: int):
    """Links of two tiles' fingerprints: edges that span the components of all pairs at most radius bits apart."""

    def links(x, y):
        own = x["fp"].view(np.uint64)
        others = own if y is None else y["fp"].view(np.uint64)
        both = own if y is None else np.concatenate([own, others])
        rows, first = max(1, _PAIRS // len(others)), len(both) - len(others)
        ends_a, ends_b, held = [], [], 0

        def forest():
            root = dense_forest(len(both), np.concatenate(ends_a), np.concatenate(ends_b))
            at = np.flatnonzero(root != np.arange(len(both)))
            return root[at], at

        for i in range(0, len(own), rows):
            a, b = np.nonzero(np.bitwise_count(own[i : i + rows, None] ^ others[None, :]) <= radius)
            keep = a + i < b if y is None else slice(None)
            ends_a.append(a[keep] + i)
            ends_b.append(b[keep] + first)
            held += len(ends_a[-1])
            if held > _LINKS:  # many near copies: their links so far make way for a spanning forest
                a, b = forest()
                ends_a, ends_b, held = [a], [b], 0
        a, b = forest()
        both = both.view(np.int64)
        yield pa.record_batch({"a": both[a], "b": both[b]})

    return links


def near_links(fps: DataFrame, scratch: Scratch, radius: int = RADIUS, parts: int = PARTS, tile: int = TILE, rows: int | None = None) -> DataFrame:
    """Distinct fingerprints (column fp) -> edges (a, b) that span, within each compared pair of tiles,
    the components of the graph of all pairs at most radius bits apart. Every such pair is compared
    by exclusive-or and bit count.

    A difference of at most radius bits changes the population counts of the parts by at most radius
    in sum, so a tile only meets tiles whose counts are that close; all other tile pairs are
    skipped. There are at most (64 / parts + 1) ** parts signatures, 83,521 here, whatever the input.
    rows: at most so many fingerprints, where that is known."""
    width = 64 // parts
    base = [(width + 1) ** (parts - 1 - i) for i in range(parts)]
    steps = _steps(radius, parts)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy()
            yield pa.record_batch({"fp": x, "spot": x, "sig": signature(x, parts)})

    def close(sig: np.ndarray) -> Iterator[np.ndarray]:
        digits = [sig // b % (width + 1) for b in base]
        for step in steps:
            fits = np.ones(len(sig), bool)
            for d, s in zip(digits, step, strict=True):
                fits &= (d + s >= 0) & (d + s <= width)
            yield np.where(fits, sig + sum(s * b for s, b in zip(step, base, strict=True)), -1)

    with_sig = scratch.keep(fps.select("fp").mapInArrow(signed, "fp long, spot long, sig long"), "signatures", rows)
    return tiled(with_sig, signature_sizes(with_sig), close, _close(radius), "a long, b long", tile).filter("a <> b")


def _classes(hashed: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, fp) -> one row per fingerprint: key, rep (its smallest id), root (its component)."""
    classes, most = hashed.groupBy("fp").agg(F.min("doc_id").alias("rep")), hashed.count()
    roots = components(near_links(classes, scratch, rows=most), scratch)
    rooted = classes.join(roots, classes.fp == roots.node, "left").select(F.col("fp").alias("key"), "rep", F.coalesce("root", "fp").alias("root"))
    return scratch.keep(rooted, "roots", most)


def simhash_groups(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, fp (signed long), component_id: the smallest id among the documents
    reachable by links of at most RADIUS differing bits, itself included.

    Documents of equal fingerprint are one class, so groups of copies meet the comparison once. Rows
    with equal ids each keep their own row; null ids are never the smallest, and a component of null
    ids only has a null component_id. Other columns are not read."""
    hashed = scratch.keep(with_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "fp"), "fingerprints")
    rooted = _classes(hashed, scratch)
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return hashed.join(rooted.join(smallest, "root").select(F.col("key").alias("fp"), "component_id"), "fp").select("doc_id", "fp", "component_id")

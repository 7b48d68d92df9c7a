"""Benchmark decontamination by winnowed fingerprints of word k-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import U64, Rolling, Scratch, fresh, mixed, sliding_min, slices, utf8, word_hashes

WINDOW = 13
#: Words in a fingerprinted k-gram; each WINDOW - GRAM + 1 consecutive k-grams give their smallest hash.
GRAM = 8
#: Bits of the filter of the benchmark's fingerprints that training texts are sent through before the join, whatever
#: the benchmark's size, and the rows it travels in.
BITS, SLICES = 1 << 24, 16
_PIECE = 1 << 19

#: Word bytes to themselves (A-Z lowered), all others to a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_FOLDED = np.frombuffer(_FOLD, np.uint8)


class Words:
    """The words of several texts: where they start and end in the folded bytes, their hashes, and to
    which text they belong."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, rolling: Rolling):
        lengths = np.diff(offsets)
        raw = np.full(len(data) + len(lengths) + 1, 32, np.uint8)  # a blank after each text
        for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
            raw[a + i : b + i] = _FOLDED[data[a:b]]
        self.raw = raw
        self.starts, self.ends, self.hashes = word_hashes(raw, rolling, _PIECE)
        self.first = np.searchsorted(self.starts, offsets + np.arange(len(offsets)))
        self.text = np.repeat(np.arange(len(lengths)), np.diff(self.first))
        self.sums = rolling.prefix(self.hashes)
        self.rolling = rolling

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words, and which of them lie within one text."""
        found = self.rolling.windows(self.sums, k)
        return found, self.text[: len(found)] == self.text[k - 1 : k - 1 + len(found)]

    def winnowed(self, k: int, window: int) -> np.ndarray:
        """Positions of the chosen k-grams: the leftmost smallest of each window's. Every run of window
        words within one text holds one, and equal runs hold the same one at the same place."""
        found, _ = self.grams(k)
        if len(found) < window - k + 1:
            return np.zeros(0, np.int64)
        low = U64((1 << 32) - 1)
        key = (found & ~low) | (np.arange(len(found), dtype=U64) & low)
        least = sliding_min(key, window - k + 1)
        least = least[self.text[: len(least)] == self.text[window - 1 : window - 1 + len(least)]] & low
        return least[np.flatnonzero(np.diff(least, prepend=U64(1 << 32)))].astype(np.int64)

    def prints(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, fingerprints) of the winnowed k-grams of texts of at least window words."""
        at = self.winnowed(gram, window)
        return at, _tagged(self.grams(gram)[0][at], 0)

    def short_prints(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, fingerprints) of all runs of k words, which an item of k words has one of."""
        found, within = self.grams(k)
        at = np.flatnonzero(within)
        return at, _tagged(found[at], k)

    def words(self, a: int, b: int) -> list[bytes]:
        return [self.raw[i:j].tobytes() for i, j in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True)]


def _tagged(hashes: np.ndarray, k: int) -> np.ndarray:
    """Those of items of k words, or of k-grams (0), apart from others."""
    return mixed(hashes + U64(k * Rolling.BASE % (1 << 64)))


def _texts(batch: pa.RecordBatch, column: str, rolling: Rolling) -> Iterator[tuple[int, int, Words]]:
    offsets, data = utf8(batch.column(column))
    for i, j in slices(offsets, _PIECE):
        yield i, j, Words(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]], rolling)


def _lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """Distinct values of rows 0..n-1 as an Arrow array of lists."""
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    if len(rows):
        keep = np.ones(len(rows), bool)
        keep[1:] = (np.diff(rows) != 0) | (values[1:] != values[:-1])
        rows, values = rows[keep], values[keep]
    ends = np.searchsorted(rows, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64)))


def _item_prints(window: int, gram: int):
    """(item, text) -> (item, words, print). Items of window words or more are winnowed; a shorter one is found by the
    hash of all its words, so that it needs no winnowing guarantee."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(2 * _PIECE)
        for batch in batches:
            ids = batch.column("item").to_numpy()
            for i, j, found in _texts(batch, "text", rolling):
                n = np.diff(found.first)
                at, prints = found.prints(window, gram)
                of, short = found.text[at], np.flatnonzero((n > 0) & (n < window))
                whole = rolling.spans(found.sums, found.first[short], found.first[short + 1])
                whole = np.concatenate([_tagged(whole[m : m + 1], int(k)) for m, k in enumerate(n[short])] or [whole])
                of, prints = np.concatenate([of, short]), np.concatenate([prints, whole])
                yield pa.record_batch({"item": ids[i:j][of], "words": n[of].astype(np.int32), "print": prints.view(np.int64)})

    return run


def _bitmap(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits, bool)
        for batch in batches:
            seen[batch.column("print").to_numpy().view(U64) % U64(bits)] = True
        parts = [np.packbits(x).tobytes() for x in np.split(seen, SLICES)]
        yield pa.record_batch({"slice": pa.array(range(SLICES), pa.int32()), "bits": pa.array(parts, pa.binary())})

    return run


def _either(part: pa.Table) -> pa.Table:
    seen = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in part.column("bits")])
    return pa.table({"slice": part.column("slice")[:1], "bits": pa.array([seen.tobytes()], pa.binary())})


def _filter(prints: DataFrame, bits: int) -> np.ndarray:
    """Which of so many counters a fingerprint has; what is collected has that many bits, whatever the benchmark."""
    seen = np.zeros((SLICES, bits // SLICES // 8), np.uint8)
    for r in prints.select("print").mapInArrow(_bitmap(bits), "slice int, bits binary").groupBy("slice").applyInArrow(_either, "slice int, bits binary").collect():
        seen[r["slice"]] = np.frombuffer(r.bits, np.uint8)
    return seen.ravel()


def _scan(seen: np.ndarray, short: list[int], window: int, gram: int):
    """Texts -> their other columns, n_words, and those of their fingerprints that the filter lets through."""
    bits = U64(8 * len(seen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(2 * _PIECE)
        for batch in batches:
            for i, j, found in _texts(batch, "text", rolling):
                rows, prints = [], []
                for at, own in (found.prints(window, gram), *(found.short_prints(k) for k in short)):
                    place = (own % bits).astype(np.int64)
                    pass_ = (seen[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
                    rows.append(found.text[at[pass_]])
                    prints.append(own[pass_])
                out = {c: batch.column(c).slice(i, j - i) for c in batch.schema.names if c != "text"}
                out |= {"n_words": pa.array(np.diff(found.first)), "prints": _lists(np.concatenate(rows), np.concatenate(prints), j - i)}
                yield pa.RecordBatch.from_pydict(out)

    return run


def _spans(doc: Words, item: Words, window: int, gram: int, covered: np.ndarray) -> bool:
    """Marks the words of one text that lie within any window of an item; whether there are any.

    Fingerprints that both sides have tell on which diagonals (place in the text less place in the item) to look; on
    each, runs of equal words are extended as far as they go, and those of a window or more are hits.
    A diagonal is passed over where all its words are covered, so that repetitive texts, which have very many,
    take few; words are compared as words in the end, not as hashes."""
    n, m = len(doc.hashes), len(item.hashes)
    least = min(window, m)
    at, prints = doc.prints(window, gram) if m >= window else doc.short_prints(m)
    at_item, of_item = item.prints(window, gram) if m >= window else item.short_prints(m)
    order = np.argsort(of_item, kind="stable")
    at_item, of_item = at_item[order], of_item[order]
    low, high = np.searchsorted(of_item, prints), np.searchsorted(of_item, prints, "right")
    marked = np.zeros(n + m + 1, bool)
    met = np.flatnonzero(high > low)
    for h in np.unique(prints[met]):
        p = at[met][prints[met] == h]
        q = at_item[of_item == h]
        few, many, sign = (p, q, -1) if len(p) < len(q) else (q, p, 1)
        for x in few.tolist():
            marked[(sign * (many - x)) + m] = True
    hit = False
    for d in (np.flatnonzero(marked) - m).tolist():
        a, b = max(0, d), min(n, m + d)
        if hit and covered[a:b].all():
            continue
        turn = np.diff((doc.hashes[a:b] == item.hashes[a - d : b - d]).astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        for x, y in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist(), strict=True):
            if y - x >= least and doc.words(a + x, a + y) == item.words(a + x - d, a + y - d):
                covered[a + x : a + y] = True
                hit = True
    return hit


def _runs(covered: np.ndarray) -> list[list[int]]:
    turn = np.diff(covered.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    return [list(x) for x in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist(), strict=True)]


def _extended(window: int, gram: int):
    """Rows sorted by text_key, of each a text (kind 0) before the items that may occur in it (kind 1) -> (text_key, spans,
    items) of texts that hold a window."""
    span_list, name_list = pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(2 * _PIECE)
        now, doc, covered, names = None, None, None, set()

        def words(text):
            raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
            return Words(np.array([0, len(raw)]), raw, rolling)

        def told():
            return pa.record_batch({"text_key": pa.array([now], pa.int64()), "spans": pa.array([_runs(covered)], span_list), "items": pa.array([sorted(names)], name_list)})

        for batch in batches:
            for key, kind, name, text in zip(*(batch.column(c).to_pylist() for c in ("text_key", "kind", "name", "text")), strict=True):
                if not kind:
                    if names:
                        yield told()
                    now, doc, names = key, words(text), set()
                    covered = np.zeros(len(doc.hashes), bool)
                else:
                    own = np.zeros(len(covered), bool) if names else covered
                    if _spans(doc, words(text), window, gram, own):
                        names.add(name)
                        covered |= own
        if names:
            yield told()

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, text_key (a hash of the text), n_words, n_hit (words inside any occurrence of an item's window),
    spans (their runs), items (names of items with occurring windows), contaminated.

    Training and benchmark texts are winnowed where they lie. Fingerprints of training texts that pass a filter of
    fixed size, made of the benchmark's, are joined with those; the pairs of text and item that share one
    meet in a task, sorted so that a text is read once before its items, and hits are extended word by word.
    Neither side comes to the driver.

    Null and blank texts have no words; items without words match nothing; a null item_id counts under
    the empty name; repeated rows are judged each; texts are whole, however long; without documents there are no
    rows, without items no hits."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "overlaps")
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text").filter(F.length("text") > 0)
    items = scratch.keep(named.withColumn("item", F.xxhash64("name", "text")).groupBy("item").agg(F.first("name").alias("name"), F.first("text").alias("text")), "items")
    prints = scratch.keep(items.select("item", "text").mapInArrow(_item_prints(window, gram), "item long, words int, print long").distinct(), "prints")
    short = sorted(r.words for r in prints.filter(F.col("words") < window).select("words").distinct().collect())
    source = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, n_words long, prints array<long>"
    scanned = scratch.keep(source.mapInArrow(_scan(_filter(prints, bits), short, window, gram), kinds), "scanned")

    asked = scanned.filter(F.size("prints") > 0).select("text_key", F.explode("prints").alias("print")).distinct()
    pairs = scratch.keep(asked.join(prints.select("print", "item"), "print").select("text_key", "item").distinct(), "pairs")
    texts = source.join(pairs.select(F.col("text_key").alias("met")).distinct(), F.col("text_key") == F.col("met")).groupBy("text_key").agg(F.first("text").alias("text"))
    both = texts.select("text_key", F.lit(0).alias("kind"), F.lit("").alias("name"), "text").unionByName(pairs.join(items, "item").select("text_key", F.lit(1).alias("kind"), "name", "text"))
    both = both.repartition("text_key").sortWithinPartitions("text_key", "kind")
    found = scratch.keep(both.mapInArrow(_extended(window, gram), "text_key long, spans array<array<long>>, items array<string>"), "found")

    told = scanned.drop("prints").join(found, "text_key", "left")
    spans, names = F.coalesce("spans", F.array().cast("array<array<long>>")), F.coalesce("items", F.array().cast("array<string>"))
    told = told.select("doc_id", "text_key", "n_words", spans.alias("spans"), names.alias("items"))
    counted = told.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0]))
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = BITS) -> DataFrame:
    """The documents that are not contaminated, all rows and columns of them, whatever their names. Repeated rows
    stay or go together."""
    bad = overlaps(docs, benchmark, window, gram, bits).filter("contaminated").select("text_key").distinct()
    key = fresh(docs, "__key")
    bad = Scratch(docs.sparkSession, "contaminated").keep(bad.withColumnRenamed("text_key", key), "keys")
    return docs.join(bad, F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad[key], "left_anti")

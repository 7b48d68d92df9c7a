"""Exact-substring deduplication: repeats of many bytes, found in sparse enhanced suffix arrays."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftline.llm.common import U64, Rolling, Scratch, fresh, release, sliding_min, utf8

LENGTH = 200
#: Bytes of an anchor; each LENGTH-byte string holds one, the smallest hash among its ANCHOR-byte strings.
ANCHOR = 40
#: Suffixes that meet in one suffix array, at about 600 bytes each; those of a more frequent anchor are divided
#: by longer and longer common surroundings until so few agree, or until all agree on LENGTH bytes.
MEET = 20_000
_PIECE = 1 << 19


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        mid = (low + n) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            n = mid
    return low


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int, list[tuple[int, int]]]]:
    """Nodes of the common-prefix interval tree, children first: (depth, first, last + 1, children's
    ranges), by one stack scan over the common-prefix lengths of neighbours in the suffix array
    (lcp[i] is that of suffixes i and i + 1; single suffixes are leaves and given as children)."""
    stack: list[list] = []  # depth, first, children
    for i, depth in enumerate([*lcp, -1]):
        node = (i, i + 1)
        first = i
        while stack and stack[-1][0] > depth:
            d, first, children = stack.pop()
            children.append(node)
            yield d, first, i + 1, children
            node = (first, i + 1)
        if depth < 0:
            break
        if stack and stack[-1][0] == depth:
            stack[-1][2].append(node)
        else:
            stack.append([depth, first, [node]])


def extents(contexts: list[tuple[bytes, bytes]], least: int) -> list[tuple[int, int]]:
    """For strings around one anchor, as distinct pairs (bytes before it, backwards; bytes from its start):
    (before, after) by pair: how far the repeats of at least so many bytes reach that hold the anchor
    there and anywhere else, (0, 0) if there is none.

    The pairs are a sparse suffix array in the order of their second parts. At a node of depth r of
    its interval tree, any two suffixes of different children agree on just r bytes after the anchor's
    start. How diverse the left extensions are decides the rest: a node keeps its suffixes in the order
    of their first parts, children are merged into the largest one, and each suffix that is merged in is
    tested against its two neighbours there, with which it shares the longest left extension l.
    l + r >= least makes a repeat for both."""
    n = len(contexts)
    best = [(0, 0)] * n
    if n < 2:
        return best

    def meet(x: int, y: int, r: int) -> None:
        left = _common(contexts[x][0], contexts[y][0])
        if left + r >= least:
            for i in (x, y):
                a, b = best[i]
                best[i] = (max(a, left), max(b, r))

    if n == 2:
        meet(0, 1, _common(contexts[0][1], contexts[1][1]))
        return best
    order = sorted(range(n), key=lambda i: contexts[i][1])
    lcp = [_common(contexts[a][1], contexts[b][1]) for a, b in zip(order, order[1:], strict=False)]
    rank = [0] * n
    by_left = sorted(range(n), key=lambda i: contexts[i][0])
    for k, i in enumerate(by_left):
        rank[i] = k
    members: dict[tuple[int, int], list[int]] = {}  # ranks by the first parts, sorted
    for depth, first, end, children in intervals(lcp):
        sets = [members.pop(c) if c in members else [rank[order[c[0]]]] for c in children]
        sets.sort(key=len)
        large = sets.pop()
        for small in sets:
            for x in small:
                at = bisect_left(large, x)
                if at:
                    meet(by_left[x], by_left[large[at - 1]], depth)
                if at < len(large):
                    meet(by_left[x], by_left[large[at]], depth)
                large.insert(at, x)
        members[first, end] = large
    return best


def repeats(contexts: list[tuple[bytes, bytes]], least: int) -> Iterator[tuple[int, int, list[int]]]:
    """For the same pairs: (before, after, pairs) of each maximal repeat of at least so many bytes that holds the anchor, with
    all pairs it occurs in. At a node of the interval tree over the second parts, the pairs in the order of their first parts
    make a second such tree, of which each node with pairs of several children is a repeat that no byte on either
    side could be added to."""
    order = sorted(range(len(contexts)), key=lambda i: contexts[i][1])
    by_left = sorted(range(len(contexts)), key=lambda i: contexts[i][0])
    rank = {i: k for k, i in enumerate(by_left)}
    lcp = [_common(contexts[a][1], contexts[b][1]) for a, b in zip(order, order[1:], strict=False)]
    held: dict[tuple[int, int], list[int]] = {}
    for depth, first, end, children in intervals(lcp):
        labelled = sorted((x, k) for k, c in enumerate(children) for x in (held.pop(c) if c in held else [rank[order[c[0]]]]))
        held[first, end] = [x for x, _ in labelled]
        lefts = [_common(contexts[by_left[a]][0], contexts[by_left[b]][0]) for (a, _), (b, _) in zip(labelled, labelled[1:], strict=False)]
        for left, i, j, _ in intervals(lefts):
            if left + depth >= least and any(k != labelled[i][1] for _, k in labelled[i + 1 : j]):
                yield left, depth, [by_left[x] for x, _ in labelled[i:j]]


class Anchors:
    """Content-chosen positions: the leftmost smallest hash of ANCHOR-byte strings in each string of LENGTH
    bytes. Equal strings of LENGTH bytes hold equal anchors at the same place."""

    def __init__(self, length: int, anchor: int):
        self.length, self.anchor = length, anchor
        self.values = mixed_bytes()
        self.rolling = Rolling(2 * _PIECE)

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[tuple[np.ndarray, ...], list[tuple[int, int, int]]]:
        """(hash, text number, position in the text) of the anchors, and (text number, start, stop) of periodic
        runs; texts are read in overlapping pieces.

        In a run of a short period each string starts again one period later, so the run is covered as it
        is, and only the strings of its first period are looked at further: all others are equal to one
        of those. Else such runs would have an anchor in every period."""
        out, runs = [], []
        n, low = len(data), U64((1 << 24) - 1)
        for at in range(0, max(1, n - self.length + 1), _PIECE):
            piece = data[at : at + _PIECE + self.length - 1]
            sums = self.rolling.prefix(self.values[piece])
            found = self.rolling.windows(sums, self.anchor)
            key = (found & ~low) | np.arange(len(found), dtype=U64)
            least = (sliding_min(key, self.length - self.anchor + 1) & low).astype(np.int64)
            start = at + np.arange(len(least))
            text = np.searchsorted(offsets, start, "right") - 1
            fine = start + self.length <= offsets[text + 1]
            chosen = _distinct(least[fine])
            gaps = np.diff(chosen)
            for period in np.unique(gaps[(found[chosen[1:]] == found[chosen[:-1]]) & (gaps < self.length)]).tolist():
                for a, b in self._periodic(piece, offsets - at, period):
                    fine[a + period : b - self.length + period + 1] = False
                    i = int(np.searchsorted(offsets, at + a, "right")) - 1
                    runs.append((i, at + a - int(offsets[i]), at + b + period - int(offsets[i])))
            chosen = _distinct(least[fine])
            text = np.searchsorted(offsets, at + chosen, "right") - 1
            out.append((found[chosen].view(np.int64), text, at + chosen - offsets[text]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)), runs

    def _periodic(self, piece: np.ndarray, starts: np.ndarray, period: int) -> list[tuple[int, int]]:
        """Ranges [a, b) of at least length bytes that are equal to those one period later in the same text."""
        same = piece[:-period] == piece[period:]
        edge = np.zeros(len(piece) + 1, np.int32)  # texts that start within the period
        inner = starts[(starts > 0) & (starts < len(piece))]
        np.add.at(edge, np.maximum(inner - period, 0), 1)
        np.add.at(edge, inner, -1)
        same &= np.cumsum(edge)[: len(same)] == 0
        turn = np.diff(same.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        a, b = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        long = b - a >= self.length
        return list(zip(a[long].tolist(), b[long].tolist(), strict=True))


def _distinct(positions: np.ndarray) -> np.ndarray:
    """Of ascending positions, each once."""
    return positions[np.flatnonzero(np.diff(positions, prepend=-1))]


def mixed_bytes() -> np.ndarray:
    """A fixed random value for each byte."""
    return np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


def _anchors(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from weftline.llm.common import slices

        find = Anchors(length, anchor)
        for batch in batches:
            ids = batch.column("tid").to_numpy()
            offsets, data = utf8(batch.column("body"))
            for i, j in slices(offsets, _PIECE):
                (h, text, pos), runs = find.of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                keep = np.ones(len(h), bool)
                if len(h) > 1:  # pieces of one text overlap and may choose a position twice
                    keep[1:] = (np.diff(text) != 0) | (np.diff(pos) > 0)
                n = int(keep.sum())
                yield pa.record_batch({"h": h[keep], "tid": ids[i:j][text[keep]], "pos": pos[keep], "stop": np.full(n, -1)})
                if runs:
                    text, first, stop = (np.array(x, np.int64) for x in zip(*runs, strict=True))
                    yield pa.record_batch({"h": np.zeros(len(runs), np.int64), "tid": ids[i:j][text], "pos": first, "stop": stop})

    return run


def _meet(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []

        def spans(group, out):
            """group: (text, position, bytes before, context) of one anchor's occurrences."""
            distinct: dict[tuple[int, bytes], int] = {}
            times: list[int] = []
            at = []
            for _, _, before, context in group:
                k = distinct.setdefault((before, context), len(times))
                if k == len(times):
                    times.append(0)
                times[k] += 1
                at.append(k)
            pairs = [(c[:b][::-1], c[b:]) for b, c in distinct]
            best = extents(pairs, length)
            for k, (left, right) in enumerate(pairs):
                if times[k] > 1 and len(left) + len(right) >= length:
                    best[k] = (len(left), len(right))
            for (tid, pos, _, _), k in zip(group, at, strict=True):
                a, b = best[k]
                if b:
                    out[0].append(tid)
                    out[1].append(pos - a)
                    out[2].append(pos + b)

        def made(out):
            return pa.record_batch({k: pa.array(v, pa.int64()) for k, v in zip(("tid", "start", "stop"), out, strict=True)})

        for batch in batches:
            out = ([], [], [])
            for h, *row in zip(*(batch.column(c).to_pylist() for c in ("h", "tid", "pos", "before", "context")), strict=True):
                if h != now:
                    if len(group) > 1:
                        spans(group, out)
                    now, group = h, []
                group.append(row)
            yield made(out)
        out = ([], [], [])
        if len(group) > 1:
            spans(group, out)
        yield made(out)

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of covered positions; touching spans make one run."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def distinct_texts(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(sha, body, times, tid): one row per distinct text of column text, as bytes, with its number of rows."""
    body = F.coalesce("text", F.lit("")).cast("binary")
    keyed = docs.select(body.alias("body")).withColumn("sha", F.sha2("body", 256))
    once = keyed.groupBy("sha").agg(F.first("body").alias("body"), F.count("*").alias("times"))
    return scratch.keep(once.withColumn("tid", F.monotonically_increasing_id()), "texts")


def _around(texts: DataFrame, anchors: DataFrame, before: int, after: int) -> DataFrame:
    """Anchors (tid, pos, ...) with the bytes around them: before (their number before the anchor) and context."""
    context = F.expr(f"substring(body, cast(pos - least(pos, {before}) + 1 as int), cast(least(pos, {before}) + {after} as int))")
    found = texts.select("tid", "body").join(anchors, "tid")
    return found.withColumn("before", F.least("pos", F.lit(before)).cast("int")).withColumn("context", context).drop("body")


def _contexts(around: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Occurrences (h, tid, pos, before, context) -> (c, tid, pos), and the distinct surroundings (cid, c, h, before,
    context, times)."""
    keyed = around.withColumn("c", F.sha2(F.concat(F.col("before").cast("string").cast("binary"), F.lit(b":"), "context"), 256))
    once = keyed.groupBy("c", "h", "before", "context").agg(F.count("*").alias("times"))
    return keyed.select("c", "tid", "pos"), scratch.keep(once.withColumn("cid", F.monotonically_increasing_id()), "contexts")


def divided(contexts: DataFrame, scratch: Scratch, length: int, anchor: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Distinct surroundings (cid, h, before, context) -> (groups (key, cid, before, context) of at most so many, in which
    any two that agree on length bytes around their anchor meet; the rest (cid, before, context, a, b), in groups larger
    than that which agree on the a bytes before and the b from the anchor's start, length bytes in all).

    A group agrees on a bytes before and b after. Two of it that agree on length bytes in all agree on half of what
    is missing more after, or on the other half more before: a group that is too large is divided by both, until none is
    or nothing is missing. So each node of the interval tree that matters lies whole in a group, and each level halves
    what is missing."""
    work = contexts.select(F.col("h").cast("string").alias("key"), "cid", "before", "context", F.lit(0).alias("a"), F.lit(anchor).alias("b"))
    missing = F.lit(length) - F.col("a") - F.col("b")
    half = F.ceil(missing / 2).cast("int")
    boxes = F.array(
        F.struct(F.col("a").alias("a"), (F.col("b") + half).alias("b")),
        F.struct((F.col("a") + missing - half + 1).alias("a"), F.col("b").alias("b")),
    )
    common = F.expr("substring(context, before - a + 1, a + b)")
    key = F.sha2(F.concat(F.col("a").cast("string").cast("binary"), F.lit(b":"), common), 256)
    few, whole, level = None, None, 0
    while True:
        work = scratch.keep(work, f"divided{level}")
        large = work.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("key")
        large = scratch.keep(large, f"large{level}")
        small = work.join(large, "key", "left_anti").select("key", "cid", "before", "context")
        few = small if few is None else few.union(small)
        many = work.join(large, "key", "left_semi")
        done = many.filter(missing <= 0).select("cid", "before", "context", "a", "b")
        whole = done if whole is None else whole.union(done)
        if large.isEmpty():
            return few, whole
        boxed = many.filter(missing > 0).select("cid", "before", "context", F.explode(boxes).alias("box")).select("cid", "before", "context", "box.*")
        held = (F.col("a") <= F.col("before")) & (F.col("b") <= F.octet_length("context") - F.col("before"))
        work = boxed.filter(held).select(key.alias("key"), "cid", "before", "context", "a", "b")
        level += 1


def _far(around: DataFrame, scratch: Scratch, length: int, anchor: int, meet: int) -> DataFrame:
    """Occurrences of frequent anchors -> (tid, start, stop) of the repeats that hold them."""
    places, contexts = _contexts(around, scratch)
    few, whole = divided(contexts, scratch, length, anchor, meet)
    met = few.select(F.col("key").alias("h"), F.col("cid").alias("tid"), F.lit(0).cast("long").alias("pos"), "before", "context")
    met = met.repartition("h").sortWithinPartitions("h").mapInArrow(_meet(length), "tid long, start long, stop long")
    met = met.select(F.col("tid").alias("cid"), (-F.col("start")).alias("a"), F.col("stop").alias("b"))
    size = F.octet_length("context")
    same = contexts.filter((F.col("times") > 1) & (size >= length)).select("cid", F.col("before").alias("a"), (size - F.col("before")).alias("b"))
    reach = met.union(whole.select("cid", "a", "b")).union(same).groupBy("cid").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    reach = contexts.select("cid", "c").join(reach, "cid").select("c", "a", "b")
    return places.join(reach, "c").select("tid", (F.col("pos") - F.col("a")).alias("start"), (F.col("pos") + F.col("b")).alias("stop"))


def repeated_spans(texts: DataFrame, scratch: Scratch, length: int = LENGTH, anchor: int = ANCHOR, meet: int = MEET) -> DataFrame:
    """Texts (tid, body, times), distinct, -> (tid, start, stop): spans that cover exactly the bytes in
    strings of so many bytes that also start anywhere else; spans of one text may overlap.

    Anchors of all texts are counted; those that occur twice or more bring the bytes around them to
    one place, where extents() finds every repeat that holds them. Of an anchor with more than `meet` occurrences
    equal surroundings are made one first, and the rest is divided(). Periodic runs, and texts that have
    several rows, repeat as a whole."""
    spark = scratch.spark
    kept = scratch.keep(texts.select("tid", "body").mapInArrow(_anchors(length, anchor), "h long, tid long, pos long, stop long"), "anchors")
    runs = kept.filter("stop >= 0").select("tid", F.col("pos").alias("start"), "stop")
    found = kept.filter("stop < 0").drop("stop")
    often = scratch.keep(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "often")
    frequent = not often.filter(F.col("n") > meet).isEmpty()
    shared = scratch.keep(found.join(often, "h").select("h", (F.col("n") > meet).alias("many"), "tid", "pos"), "shared")
    release(spark)
    scratch.drop("often")

    size = F.octet_length("body")
    around = scratch.keep(_around(texts, shared, length - anchor, length).select("h", "many", "tid", "pos", "before", "context"), "around")
    release(spark)
    scratch.drop("shared")
    near = around.filter(~F.col("many")).select("h", "tid", "pos", "before", "context")
    near = near.repartition("h").sortWithinPartitions("h").mapInArrow(_meet(length), "tid long, start long, stop long")
    near = scratch.keep(near, "near")
    if frequent:
        near = near.union(scratch.keep(_far(around.filter("many"), scratch, length, anchor, meet), "far"))
    release(spark)
    scratch.drop("around")
    whole = texts.filter((F.col("times") > 1) & (size >= length)).select("tid", F.lit(0).cast("long").alias("start"), size.cast("long").alias("stop"))
    return near.union(whole).union(runs)


def _groups(length: int, reach: int):
    """Distinct surroundings sorted by key -> (group, n_bytes, open, cid, a: bytes before the anchor) of their repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []

        def made(rows):
            cols = zip(*rows, strict=True)
            types = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["group", "n_bytes", "open", "cid", "a"])

        def found(group):
            pairs = [(c[:b][::-1], c[b:]) for _, b, c in group]
            for left, right, members in repeats(pairs, length):
                a, b = pairs[members[0]]
                name = hashlib.md5(a[:left][::-1] + b[:right]).hexdigest()
                for i in members:
                    yield name, left + right, left == reach or right == reach, group[i][0], left

        for batch in batches:
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "cid", "before", "context")), strict=True):
                if key != now:
                    out += found(held)
                    now, held = key, []
                held.append(row)
                if len(out) > 10_000:
                    yield made(out)
                    out = []
        out += found(held)
        if out:
            yield made(out)

    return run


def repeat_groups(docs: DataFrame, scratch: Scratch, length: int = LENGTH, anchor: int = ANCHOR, reach: int = 1024, most: int = MEET) -> DataFrame:
    """Maximal repeats of at least so many bytes, each with all its occurrences: (group: MD5 of the repeat, n_bytes, open, sha:
    of the text, times: its rows, start).

    Read up to `reach` bytes on both sides of an anchor; a repeat that goes on there is open: cut at the reach. Where more
    than `most` unlike surroundings agree on length bytes, these are the group, open, again with all occurrences. Runs
    of a short period are groups of their own. Null and empty texts have no repeats; rows of equal texts are
    one text of several times."""
    texts = distinct_texts(docs, scratch)
    kept = scratch.keep(texts.select("tid", "body").mapInArrow(_anchors(length, anchor), "h long, tid long, pos long, stop long"), "anchors")
    found = kept.filter("stop < 0").drop("stop")
    often = found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    around = scratch.keep(_around(texts, found.join(often, "h"), reach, reach).select("h", "tid", "pos", "before", "context"), "around")
    places, contexts = _contexts(around, scratch)
    few, whole = divided(contexts, scratch, length, anchor, most)
    kinds = "group string, n_bytes long, open boolean, cid long, a long"
    groups = few.repartition("key").sortWithinPartitions("key").mapInArrow(_groups(length, reach), kinds)
    size, before = F.octet_length("context"), F.col("before")
    common = F.md5(F.expr("substring(context, before - a + 1, a + b)"))
    groups = groups.union(whole.select(common, (F.col("a") + F.col("b")).cast("long"), F.lit(True), "cid", F.col("a").cast("long")))
    same = contexts.filter((F.col("times") > 1) & (size >= length))
    groups = groups.union(same.select(F.md5("context"), size.cast("long"), (before == reach) | (size - before == reach), "cid", before.cast("long")))
    groups = groups.distinct().join(contexts.select("cid", "c"), "cid").join(places, "c")
    groups = groups.select("group", "n_bytes", "open", "tid", (F.col("pos") - F.col("a")).alias("start"))
    run = F.expr("substring(body, cast(pos + 1 as int), cast(stop - pos as int))")
    runs = texts.select("tid", "body").join(kept.filter("stop >= 0"), "tid").select(F.md5(run).alias("group"), (F.col("stop") - F.col("pos")).alias("n_bytes"), F.lit(False).alias("open"), "tid", F.col("pos").alias("start"))
    both = groups.union(runs).distinct()  # a repeat with several anchors is found from each
    return both.join(texts.select("tid", "sha", "times"), "tid").drop("tid")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = {"sha": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "runs": []}
        for sha, body, spans in zip(*(batch.column(c).to_pylist() for c in ("sha", "body", "spans")), strict=True):
            runs = merged([(s["start"], s["stop"]) for s in spans or ()])
            kept, at = hashlib.sha256(), 0
            for a, b in runs:
                kept.update(body[at:a])
                at = b
            kept.update(body[at:])
            for k, v in zip(rows, (sha, len(body), sum(b - a for a, b in runs), len(runs), kept.hexdigest() if runs else sha, [list(x) for x in runs]), strict=True):
                rows[k].append(v)
        yield pa.record_batch([pa.array(v, t) for v, t in zip(rows.values(), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))), strict=True)], names=list(rows))


def repeated_bytes(docs: DataFrame, scratch: Scratch, length: int = LENGTH, anchor: int = ANCHOR, meet: int = MEET) -> DataFrame:
    """One row per document: doc_id, sha (of the whole text), n_bytes, n_removed, n_spans, kept_sha256 and
    runs (the removed runs of bytes, [start, stop)), for all strings of so many bytes that start twice.

    Null texts are empty; empty texts and texts shorter than length lose nothing; copies of a text of
    length bytes or more lose all of it; repeated rows count as copies."""
    texts = distinct_texts(docs, scratch)
    release(scratch.spark)
    spans = repeated_spans(texts, scratch, length, anchor, meet).groupBy("tid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    cut = texts.select("tid", "sha", "body").join(spans, "tid", "left").select("sha", "body", "spans")
    cut = cut.mapInArrow(_cut, "sha string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, runs array<array<long>>")
    cut = scratch.keep(cut, "cut")
    release(scratch.spark)
    rows = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))
    return rows.join(cut, "sha").select("doc_id", "sha", "n_bytes", "n_removed", "n_spans", "kept_sha256", "runs")


@F.pandas_udf(StringType())
def _without(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    def cut(text, runs):
        if text is None or runs is None or not len(runs):
            return text
        body = text.encode("utf-8", "surrogatepass")
        out, at = [], 0
        for a, b in runs:
            while a < b and body[a] & 0xC0 == 0x80:  # a character that is repeated in part stays whole
                a += 1
            while b > a and b < len(body) and body[b] & 0xC0 == 0x80:
                b -= 1
            out.append(body[at:a])
            at = b
        return b"".join([*out, body[at:]]).decode("utf-8", "surrogatepass")

    for texts, runs in parts:
        yield pd.Series([cut(t, r) for t, r in zip(texts, runs, strict=True)], dtype=object)


def without_repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH, anchor: int = ANCHOR, meet: int = MEET) -> DataFrame:
    """The documents with their repeated bytes cut from text; a character that is repeated in part stays
    whole. All rows and other columns stay, in the same order of columns."""
    sha, other, runs = fresh(docs, "__sha"), fresh(docs, "__other"), fresh(docs, "__runs")
    found = repeated_bytes(docs, scratch, length, anchor, meet).filter("n_removed > 0").select(F.col("sha").alias(other), F.col("runs").alias(runs)).distinct()
    keyed = docs.withColumn(sha, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    cut = keyed.join(found, F.col(sha) == F.col(other), "left")
    return cut.withColumn("text", _without("text", runs)).select(*docs.columns)
